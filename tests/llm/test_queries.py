"""The registered queries over the given tables, column by column, against plain versions."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from test_operators import RANKS, TIKTOKEN, WORD, WORDS, components, like, marks_of, print_of, without_repeats
from tokenizers import Tokenizer

from recallgrid.llm import bpe, mixing, queries


@pytest.fixture(scope="module")
def texts(spark, data):
    return sorted((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect())


def rows_of(name, spark, data, key="doc_id"):
    found = queries.QUERIES[name](spark, data).collect()
    assert len({r[key] for r in found}) == len(found)
    return {r[key]: r for r in found}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, data):
    given = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in given], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = [r.vec_id for r in given], np.array([r.label for r in given])
    near = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(ids), dtype=bool)
    want = components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True) if ids[i] < ids[j]])
    got = rows_of("op1_rotation_codes", spark, data, "vec_id")
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (int(near[k].sum()), want[i], want[i] == i) for k, i in enumerate(ids)}


def test_op2(spark, data, texts):
    got = rows_of("op2_bpe_round_trip", spark, data)
    assert len(got) == len(texts) and bpe.read_ranks(RANKS)
    for i, t, _ in texts:
        ids = TIKTOKEN.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t))


def test_op3(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = rows_of("op3_html_text", spark, data, "page_id")
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)(?:</article>|$)", p.html or "", re.S)
        inside = re.sub(r"<br[^>]*>", " ", inside[1] if inside else "")
        lines = re.split(r"</?(?:p|h1|article)[^>]*>", inside)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in lines]
        want = "\n".join(x for x in lines if x)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


def test_op4(spark, data, texts):
    got, some = rows_of("op4_lempel_ziv", spark, data), texts[:40] + texts[-2:]
    assert len(got) == len(texts)
    after = {i: texts[(k + 1) % len(texts)][1] for k, (i, _, _) in enumerate(texts)}
    for i, t, _ in some:
        other = t[: len(t) - len(t) // 2] + after[i][: len(t) // 2]
        own, new, following = marks_of(t), marks_of(other), marks_of(after[i])
        spell = lambda m: "".join(f"{x:08x}" for x in m)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (len(t), sha(other), spell(own), spell(new), like(own, new), like(own, following))


def test_op5(spark, data, texts):
    got, sizes = rows_of("op5_mixing", spark, data), {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:  # what is above the cap is shared again
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else per * weight[s]
        left -= sum(target[s] for s in full or open_)
        open_ -= full or open_
    taken = dict.fromkeys(sizes, 0)
    for i, t, s in texts:
        n = len(WORD.findall(t))
        assert (got[i].size, got[i].source_size) == (n, sizes[s]) and got[i].target == pytest.approx(target[s]) and 0 <= got[i].taken <= 2 * n
        taken[s] += got[i].taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes) and mixing.CAP == 2


def test_op6(spark, data, texts):
    got = rows_of("op6_toxicity", spark, data)
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [i for i, r in got.items() if r.held_out and i in toxic]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.9 * len(held)


def test_op7(spark, data, texts):
    got, library, at = rows_of("op7_token_files", spark, data), Tokenizer.from_file(WORDS), 0
    for i, t, _ in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)


def test_op8(spark, data, texts):
    prints = {i: print_of(t, 4) for i, t, _ in texts}
    ids = sorted(prints)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {i: (r.fingerprint, r.component_id) for i, r in rows_of("op8_simhash", spark, data).items()} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_op9(spark, data, texts):
    want = {i: (n, gone, sha(kept)) for i, n, gone, kept in without_repeats([(i, t) for i, t, _ in texts], 20)}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in rows_of("op9_substring_dedup", spark, data).items()} == want


def test_op10(spark, data, texts):
    got = rows_of("op10_quality", spark, data)
    assert len(got) == len(texts) and all(r.kept == (r.score >= 0.5) for r in got.values())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert sum(got[i].kept == (q == 1) for i, q in quality.items()) >= 0.95 * len(quality)
