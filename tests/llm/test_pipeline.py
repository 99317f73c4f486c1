"""The pipeline stage by stage, on given documents, on odd rows and on none."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from recallgrid.llm import bpe, common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def alike(a, b):
    return a == b or (bool(a and b) and len(a & b) >= 0.8 * len(a | b))


def without_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t
    return out


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, rows = docs.columns, {"given": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, data), name)
        rows[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
    # near copies: in the order of ids, one goes exactly if it is like one that stays
    stay = []
    for r in sorted(rows["toxicity"], key=lambda r: r.doc_id):
        s = shingles(r.text)
        if not any(alike(s, k) for _, k in stay):
            stay.append((r.doc_id, s))
    assert sorted(r.doc_id for r in rows["simhash_near_dedup"]) == [i for i, _ in stay]
    cut = without_repeats([(r.doc_id, r.text) for r in rows["simhash_near_dedup"]])
    assert {r.doc_id: r.text for r in rows["substring_dedup"]} == cut
    size = sum(len(WORD.findall(t)) for t in cut.values())
    assert abs(sum(len(WORD.findall(r.text)) for r in rows["mixing"]) - 1.5 * size) <= 30
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in rows["mixing"])
    assert sorted((r.doc_id, list(r.ids)) for r in rows["bpe"]) == ids and all(r.n_tokens == len(r.ids) for r in rows["bpe"])


TEXTS = [None, "", " \n ", "one", "the quick brown fox " * 60, "x" * 200_000, "the quick brown fox " * 60, "日本語 😀 né", "a b c d e f g"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxicity string, score string, a int, b int, row string, key string, node string, id string, h string, pass string, block string, carry string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", [None, "s", "t"][i % 3], len(t or ""), *["z", "y"], 1, 2, *["q"] * 8) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here at all", None, None, 17, "z", "y", 1, 2, *["q"] * 8), (4, "another text under the same id", "en", "s", 30, "z", "y", 1, 2, *["q"] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_on_odd_rows(spark, data, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, data)
    got = out.collect()
    assert name == "bpe" or (out.columns == odd.columns and all(r._toxicity == "z" and r.a == 1 and r.carry == "q" for r in got))
    assert stage(spark, odd.limit(0), data).count() == 0
    if name in ("toxicity", "substring_dedup", "bpe"):
        assert len(got) == odd.count()
    if name == "simhash_near_dedup":
        # the texts without words are copies of the first of them, the repeated row and text of row 4
        assert sorted((r.doc_id, len(r.text or "")) for r in got if r.doc_id is not None) == [(0, 0), (3, 3), (4, 30), (4, 1200), (5, 200_000), (7, 8), (8, 13)]
        assert sum(r.doc_id is None for r in got) == 1
    if name == "substring_dedup":
        kept = sorted(hashlib.md5((r.text or "").encode()).hexdigest() for r in got if r.doc_id in (4, 6) and "quick" in (r.text or ""))
        assert len(kept) == 1
    if name == "mixing":
        taken = sum(len(WORD.findall(r.text or "")) for r in got)
        assert taken == pytest.approx(1.5 * sum(len(WORD.findall(r.text or "")) for r in odd.collect()), abs=2)
