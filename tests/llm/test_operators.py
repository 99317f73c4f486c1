"""The training-data operators against brute force on small tables, with odd rows."""

import collections
import hashlib
import re
import time
import tracemalloc
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallgrid.llm import bpe, common, html_text, lempel_ziv, linear, mixing, quality, rotation_codes, simhash, substrings, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TIKTOKEN = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
TEXTS = [None, "", " \n ", "one", "Ééà ñ ß — 日本語 😀👍", "the quick brown fox " * 40, "x" * 5000, "the quick brown fox " * 40, "a\tb\x0bc\x1cd  e, f. g.", "No! Don't; it's 1234.5"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, node long, fp string, block string, score string, carry string, h string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, a null id, a repeated row, and columns with clashing names."""
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), *["z", 1, 2, *["q"] * 6]) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here", None, None, 10, *["z", 1, 2, *["q"] * 6])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ------------------------------------------------------------------ tokenizers
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_tiktoken(text):
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    text = text.encode("utf-8", "ignore").decode()
    want = TIKTOKEN.encode_ordinary(text)
    assert own.encode(text) == want
    stream, ids = bpe.StreamDecoder(own), own.encode(text)
    assert "".join([stream.feed([i]) for i in ids] + [stream.finish()]) == text


def test_bpe_round_trip(odd, empty):
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()}
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "")
        r = got[i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip_decodes_in_chunks(odd, monkeypatch):
    runs, fed = [], []
    text = "日本語 😀 né " * 3000

    class Watched(bpe.StreamDecoder):
        def feed(self, ids):
            fed.append(len(ids))
            return super().feed(ids)

    monkeypatch.setattr(type(odd), "mapInArrow", lambda df, run, schema: runs.append(run))
    monkeypatch.setattr(bpe, "StreamDecoder", Watched)
    bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)
    (out,) = runs[0]([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])
    assert len(fed) > 1 and sum(fed) == out["n_tokens"][0].as_py()
    assert out["decoded_sha256"][0].as_py() == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_few_states():
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    was, bpe.STATES = bpe.STATES, 5
    try:
        assert [own.encode(t) for t in TEXTS if t] == [bpe.codec(RANKS, public_tokenizers.PATTERN).encode(t) for t in TEXTS if t]
    finally:
        bpe.STATES = was


def test_token_files(odd, empty, tmp_path):
    library, at = Tokenizer.from_file(WORDS), 0
    rows = sorted((r.asDict() for r in odd.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted(token_files.written_digests(odd, WORDS).collect(), key=lambda r: r.start)
    for row, r in zip(rows, got, strict=True):
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)
    assert token_files.written_digests(empty, WORDS).count() == 0
    out = token_files.Writer(f"file://{tmp_path}", "x.arrow", np.dtype("<u2"), 4, 2)
    for k in range(7):
        out.add(np.arange(k, k + 3, dtype="<u2"))
    out.close()
    reader = token_files.Reader(f"file://{tmp_path}", "x.arrow")
    assert np.concatenate(list(reader.span(5, 12))).tolist() == [x for k in range(7) for x in range(k, k + 3)][5:17]
    assert reader.sequence(5)[1].tolist() == [True, False, False, False]


# ------------------------------------------------------------------ near copies
def print_of(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, empty, docs):
    for df in (odd, docs.select("doc_id", "text")):
        rows = {r.doc_id: r.text for r in df.where("doc_id is not null").collect()}
        prints = {i: print_of(t, 4) for i, t in rows.items()}
        ids = sorted(rows)
        want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
        got = simhash.dedup(df, width=4).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is not None:
                assert (int.from_bytes(r.fp, "big"), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert simhash.dedup(empty).count() == 0


def test_simhash_blocks_of_hot_keys(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63)
    prints = [int(base) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(300)]
    prints = list(dict.fromkeys(prints))
    rows = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(prints)], "node long, fp binary")
    got = [(r.src, r.dst) for r in simhash.links(rows, 4, simhash.block_masks(4, 6), block_rows=16).collect()]
    ids = range(len(prints))
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 * 8 for a, b in got)
    assert components(ids, got) == components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])


def test_keep_one_decides_by_shingles(spark):
    """Pairs at a likeness of 0.8 lose a copy, whatever their fingerprints; pairs just below it stay."""
    rng, rows, want = np.random.default_rng(3), [], set()
    for k, (n, shared) in enumerate([(90, 80)] * 60 + [(90, 79)] * 60 + [(900, 800)] * 10 + [(900, 799)] * 10 + [(5, 4)] * 20):
        a = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
        b = a[: shared + 4] + [f"v{x}" for x in rng.integers(0, 1 << 40, n - shared if n > 5 else 0)]
        alike = shared / (2 * n - shared if n > 5 else n) >= 0.8
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k} if alike else {2 * k, 2 * k + 1}
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(60 * i, 60 * i + 1000))) for i in range(6)]  # each like the next one only
    want |= {1000, 1002, 1004}
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def shingles(text, width=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def alike(a, b):
    return a == b or (len(a & b) >= 0.8 * len(a | b) if a and b else False)


def first_of_each(rows):
    kept = []
    for i, t in sorted(rows):
        s = shingles(t)
        if not any(alike(s, k) for _, k in kept):
            kept.append((i, s))
    return [i for i, _ in kept]


@pytest.mark.parametrize("group_rows", [8, 512])
def test_keep_one_against_brute_force(spark, docs, monkeypatch, group_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "LEADERS", max(4, group_rows // 4))
    rng, rows = np.random.default_rng(5), []
    base = [f"b{k}" for k in range(120)]
    for i in range(200):  # one large group, in which not all are like each other
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            w[k] = f"x{i}.{k}"
        rows.append((int(rng.integers(0, 1 << 40)), " ".join(w)))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == first_of_each(rows)
    if group_rows > 8:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == first_of_each(rows)


def test_keep_one_odd_rows(spark, odd, empty):
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns and simhash.keep_one(empty).count() == 0
    got = [r.doc_id for r in out.collect()]
    assert sorted(i for i in got if i is not None) == [0, 3, 4, 5, 6, 8, 9] and got.count(None) == 1
    rows = [(1, "a b c d e f", "x"), (1, "u v w x y z", "x"), (1, "a b c d e f", "y"), (2, "u v w x y z", "x")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e f"), (1, "u v w x y z")]
    with pytest.raises(TypeError):
        simhash.keep_one(odd.withColumn("doc_id", F.lit("a")))


def test_rotation_codes(spark):
    rng, rows, base = np.random.default_rng(0), [], None
    for i in range(250):
        base = rng.standard_normal(8) if i % 5 == 0 else base
        rows.append((i, [float(x) for x in base * rng.choice([1, 2]) + rng.standard_normal(8) * rng.choice([0, 0.02, 0.15])], int(i % 2) if i % 7 else None, "x"))
    rows += [(900 + k, v, 1, "x") for k, v in enumerate([None, [], [0.0] * 8, [1.0, None], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, label, _ in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    linked = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98]
    want, n = components([r[0] for r in rows], linked), collections.Counter(x for p in linked for x in p)
    for r in rotation_codes.dedup(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], r.vec_id == want[r.vec_id])
    assert rotation_codes.dedup(df.limit(0)).count() == 0


def test_rotation_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for spread, threshold in ((0.02, 0.98), (0.1, 0.7)):
        y = x + spread * rng.standard_normal(x.shape)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        true = (x * y).sum(1)
        codes, factors = rotation_codes.encode(np.concatenate((x, y)))
        stand, noise = rotation_codes.decode(codes, factors, 64)
        i = np.arange(4000)
        guess, error = rotation_codes.estimates(stand, noise, i, i + 4000, threshold)
        assert abs((guess - true).mean()) < 0.005 and (np.abs(guess - true) <= error)[true >= threshold].all()
        differ = np.bitwise_count(codes[:4000] ^ codes[4000:]).sum(1)
        assert (differ <= rotation_codes.most_apart(128, threshold))[true >= threshold].all()


def test_rotation_codes_recall_on_given_vectors(spark):
    """The 64-d table with copies moved to a cosine of 0.975 to 0.999, under keys of 15 bits or more, as eight million vectors have."""
    given_rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r.embedding for r in given_rows], float)
    rng = np.random.default_rng(8)
    aside = rng.standard_normal((4, *x.shape))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    aside -= (aside * x).sum(2, keepdims=True) * x / size**2
    aside *= size / np.linalg.norm(aside, axis=2, keepdims=True)
    close = rng.uniform(0.975, 0.999, (4, len(x), 1))
    every = np.concatenate((x, *(close * x + np.sqrt(1 - close**2) * aside)))
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    like, label = unit @ unit.T, np.tile([r.label for r in given_rows], 5)
    want = int(((like >= 0.98) & (label[:, None] == label)).sum() - len(every))
    rows = spark.createDataFrame([(i, int(k), v.tolist(), 1) for i, (k, v) in enumerate(zip(label, every, strict=True))], "node long, label int, vec array<double>, weight long")
    assert rotation_codes.plan(1 << 23, 0.98, 0.995)[0] >= 15
    found = rotation_codes.links(rows, vectors=1 << 23).where("node is not null").agg(F.sum("n")).first()[0]
    assert 0.98 * want <= found <= want


# ------------------------------------------------------------------ repeats
def without_repeats(rows, window):
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_rows", [2, 4096])
def test_substrings(spark, docs, group_rows):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("ab"), rng.integers(0, 40)))) for i in range(120)] + [(300, None), (301, ""), (302, "x " * 50), (303, "x " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup(df, 6, 3, group_rows).collect()), key=repr) == without_repeats(rows, 6)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, substrings.dedup(docs, group_rows=group_rows).collect()), key=repr) == without_repeats(rows, 20)


def test_substrings_odd_rows(odd, empty):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(map(tuple, substrings.dedup(odd).collect()), key=repr) == without_repeats(rows, 20)
    out = substrings.cleaned(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and substrings.cleaned(empty).count() == 0


# ------------------------------------------------------------------ fingerprints, pages
def phrases_of(t):
    found, a = [], 0
    met = set()
    for i in range(1, len(t) + 1):
        if t[a:i] not in met:
            met.add(t[a:i])
            found.append(t[a:i])
            a = i
    return found


def marks_of(t, size=lempel_ziv.SIZE):
    """A fingerprint from the phrases one by one."""
    hashes = set()
    for p in phrases_of(t):
        points = np.array([ord(c) for c in p], np.uint32)
        hashes.add(int(common.span_hashes(points, np.array([0]), np.array([len(p)]))[0] >> np.uint64(32)))
    return sorted(hashes)[:size]


def like(a, b, size=lempel_ziv.SIZE):
    if not a or not b:
        return float(a == b)
    both = sorted({*a, *b})[:size]
    return len([x for x in both if x in set(a) and x in set(b)]) / len(both)


def test_lempel_ziv(spark, odd, empty, docs):
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    for rows in (sorted({(r.doc_id, r.text or "") for r in odd.where("doc_id is not null").collect()}), sorted(given)[:120]):
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
        got = {r.doc_id: r for r in lempel_ziv.compare(df).collect()}
        for k, (i, t) in enumerate(rows):
            new = rows[(k + 1) % len(rows)][1]
            other = t[: len(t) - len(t) // 2] + new[: len(t) // 2]
            marks = [marks_of(x) for x in (t, other, new)]
            r = got[i]
            spelled = ["".join(f"{x:08x}" for x in m) for m in marks]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(other.encode()).hexdigest(), spelled[0], spelled[1])
            assert (r.near_edited, r.near_next) == (like(marks[0], marks[1]), like(marks[0], marks[2]))
    assert lempel_ziv.compare(odd).count() == odd.count() and lempel_ziv.compare(empty).count() == 0
    ghosts = spark.createDataFrame([(None, f"text {i}") for i in range(40)] + [(3, "last")], "doc_id long, text string")
    got = lempel_ziv.compare(ghosts).collect()
    assert len(got) == 41 and sum(r.doc_id is None for r in got) == 40
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 3)[0] in {hashlib.sha256(("la" + f"text {i}"[:2]).encode()).hexdigest() for i in range(40)}
    with pytest.raises(TypeError):
        lempel_ziv.compare(odd.withColumn("doc_id", F.lit("a")))


def test_lempel_ziv_likeness():
    def phrases(t):
        s, a = set(), 0
        for i in range(1, len(t) + 1):
            if t[a:i] not in s:
                s.add(t[a:i])
                a = i
        return s

    rng = np.random.default_rng(4)
    for _ in range(20):
        a = "".join(rng.choice(list("abcde "), 1500))
        b = a[:900] + "".join(rng.choice(list("abcde "), 600))
        x, y = phrases(a), phrases(b)
        assert abs(lempel_ziv.likeness(lempel_ziv.fingerprint(a), lempel_ziv.fingerprint(b)) - len(x & y) / len(x | y)) < 0.17


def test_html_text(spark):
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <aside class="sidebar"><p>Side text, long enough, with commas, to score well, really.</p></aside><div class="cookie-notice"><p>We use cookies, as you see, on this page, at all times.</p></div>
    <div class="content"><h2>Title</h2><p>First paragraph, with <a href=x>a link</a>, and&nbsp;more   words &amp; marks.<p>Second, un<b>clos</b>ed &#233;.</p><form><p>Your name, please, and more, and more, here.</p></form><div class="ad">Buy, buy, buy this thing, now, or never, at once.</div><blockquote>A quote, here.</blockquote></div>
    <section id="comments"><p>I agree, this is good, a very long comment, with commas, many of them.</p></section><footer><p>Imprint, and so on, and so on, and so forth.</p></footer></body></html>"""
    want = "Title\nFirst paragraph, with a link, and more words & marks.\nSecond, unclosed é.\nA quote, here."
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>Short", "x"), (5, "u", "<<<>&&#", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert [r.text for r in got if r.page_id == 1] == [want, want] and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (2, 3, 4)} == {2: "", 3: "", 4: "Short"}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_text_keeps_the_article():
    prose = "\n".join(f"Paragraph {i} of the article, which is long enough, and has commas, to be prose." for i in range(8))
    inside = "".join(f"<p>{line}</p>" for line in prose.split("\n"))
    side = "<div class='sidebar'><p>Beside it, a shorter text, with commas, of no use.</p></div>"
    for name in ("container has-sidebar", "layout no-sidebar", "content-with-comments", "entry post-header", "single comments-open", "widget"):
        assert html_text.main_text(f"<html><body><div class='{name}'>{inside}{side}</div></body></html>") == prose, name
    assert html_text.main_text(f"<html><body><form action=/><div>{inside}</div>{side}</form></body></html>") == prose
    for head in ("<head><title>T</title><meta charset=utf-8><body>", "<head><title>T</title>", "<head><link rel=x href=y>\n"):
        assert html_text.main_text(f"<html>{head}<div>{inside}</div>{side}") == prose, head
    readers = "".join(f"<p>Reader {i} says this, and that, and more, and then some, at length.</p>" for i in range(30))
    for name in ("comments", "comment-list"):
        assert html_text.main_text(f"<body><div>{inside}</div><div id='{name}'>{readers}</div></body>") == prose


FRAMES = [
    "<article>{}</article>", "<main><h1>{h}</h1>{}</main>", "<div class='content'>{}</div>", "<div id=main><div class=post-body>{}</div></div>", "<section class='entry'>{}</section>",
    "<article><div class='article-header'><h1>{h}</h1></div>{}</article>", "<article><header><h1>{h}</h1></header>{}</article>", "<div class='layout has-sidebar'>{}</div>", "<div><div><div>{}</div></div></div>", "<table><tr><td>{}</td></tr></table>",
]
AROUND = [
    ("<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>", "<footer><p>All rights reserved, and so on, by someone.</p></footer>"),
    ("<div class='site-header'>The site</div><div class=menu><a href=/a>A</a> <a href=/b>B</a></div><div class='cookie-notice'><p>We use cookies, as you know, everywhere.</p></div>", "<aside><p>Beside it, something else, quite short.</p></aside><div id=comments><p>Nice, I agree, with all of it, really.</p></div><div class='ad-banner'>Buy this, now.</div><script>var a='<p>x, y, z</p>'</script>"),
]


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("around", AROUND)
def test_html_text_of_known_pages(frame, around):
    lines = [f"Sentence {i} of the text, with a comma, & a mark, long enough to be taken for prose." for i in range(6)] + ["A notice of two weeks is due, they said, and no more.", "Short one, here."]
    inside = "".join(f"<p class='{'notice-period' if i == 6 else 'text'}'>{x.replace('&', '&amp;')}</p>\n" for i, x in enumerate(lines))
    want = (["The heading"] if "{h}" in frame else []) + lines
    page = f"<html><head><title>T</title></head><body>{around[0]}{frame.replace('{h}', 'The heading').replace('{}', inside)}{around[1]}</body></html>"
    assert html_text.main_text(page) == "\n".join(want)


def test_html_text_takes_time_by_length():
    for unit in ("<div>x, y and z", "<div><p>some text, here it is, long enough to count", '<a "', "<li>a", "<b>x</i></u>", "<table><tr><td>"):
        began = time.process_time()
        html_text.main_text("<body>" + unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 8, unit
    kept = "".join(f"<div>line {i}, and more of it, for the sake of length" for i in range(3000))
    assert html_text.main_text(f"<article>{kept}</article>").count("\n") == 2999


# ------------------------------------------------------------------ mixing
def test_targets():
    got = mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 1000)])
    assert [g[0] for g in got] == ["a", "b", "c", None] and abs(sum(g[2] for g in got) - 1950) < 1e-6
    assert all(t <= 2 * n + 1e-9 for _, n, t in got) and got[0][2] == got[1][2] == 200


def test_permute():
    for n in (1, 2, 7, 100, 1025):
        assert sorted(mixing.permute(np.arange(n), n, 9).tolist()) == list(range(n))


def test_unpermute():
    for n in (1, 2, 7, 100, 1025, (1 << 40) + 3):
        x = np.unique(np.random.default_rng(n).integers(0, n, 200))
        assert (mixing.unpermute(mixing.permute(x, n, 9), n, 9) == x).all()


def test_targets_are_met_to_the_word_at_every_size():
    rng, block = np.random.default_rng(2), 128
    for blocks in (1, 2, 50, 1000, (1 << 22) - 1, (1 << 22) + 50, (1 << 36) + 7):
        for _ in range(20):
            size = block * (blocks - 1) + int(rng.integers(1, block + 1))
            target = int(rng.integers(1, 2 * size + 1))
            (d,) = mixing.draws([("a", size, float(target))], block, int(rng.integers(0, 99)))
            whole, rest = divmod(d.slots, d.blocks)
            assert 0 < d.last <= block and whole <= 2
            words = whole * size + rest * block
            if blocks > 1 << 20:  # the short block is looked for by the inverse alone
                continue
            seed = [s for s in range(99) if mixing.draws([("a", size, float(target))], block, s) == [d]]
            full = [size - block * (blocks - 1) if mixing.permute(np.arange(blocks), blocks, mixing._key(seed[0], 0, t))[k] == blocks - 1 else block for t in range(whole + (rest > 0)) for k in range(blocks if t < whole else rest)]
            assert sum(full[:-1]) + d.last == target, (blocks, size, target, words)


def test_slots_hold_the_target_beyond_four_million_blocks():
    block, blocks, target = 128, (1 << 22) + 50, 483_189_499
    size = block * blocks - 91
    (d,) = mixing.draws([("a", size, float(target))], block, 17)
    index = mixing.permute(np.arange(d.slots), blocks, mixing._key(17, 0, 0))
    words = np.where(index == blocks - 1, size - block * (blocks - 1), block)
    assert words[:-1].sum() + d.last == target


def test_hypergeometric_beyond_the_library():
    good, bad, take = 6 * 10**9, 4 * 10**9, 5 * 10**9
    rng = np.random.default_rng(1)
    got = np.array([mixing.hypergeometric(rng, good, bad, take) for _ in range(400)], float)
    mean, deviation = take * 0.6, (take * 0.24 * 0.5) ** 0.5
    assert abs(got.mean() - mean) < 4 * deviation / 20 and 0.9 < got.std() / deviation < 1.1
    small = [mixing.hypergeometric(np.random.default_rng(k), 30, 70, 20) for k in range(50)]
    big, mixing._LIBRARY = mixing._LIBRARY, 0
    try:
        inverted = [mixing.hypergeometric(np.random.default_rng(k), 30, 70, 20) for k in range(2000)]
    finally:
        mixing._LIBRARY = big
    assert abs(np.mean(inverted) - 6) < 0.2 and abs(np.mean(small) - 6) < 1.5
    totals = np.array([3 * 10**12, 0, 10**12])
    first, counts = mixing.shard_counts(totals, 10**9, 4000, 123_456_789, 5)
    after, _ = mixing.shard_counts(totals, 10**9, 4000, 123_456_790, 5)
    assert counts.sum() == 4000 and (first + counts == after).all() and abs(counts[0] - 3000) < 200


def test_shards_add_up():
    totals, per = np.array([7, 0, 50, 23]), 9
    parts = [mixing.shard_counts(totals, 9, per, k, 3) for k in range(9)]
    assert sum(c for _, c in parts).tolist() == totals.tolist() and all(c.sum() == 9 for _, c in parts[:-1])
    at = np.zeros(4, int)
    for first, c in parts:
        assert first.tolist() == at.tolist()
        at = at + c


def test_mixing_clashing_names_and_repeated_rows(spark):
    rows = [(str(i % 7), f"w{i % 7} " * (20 + i % 7), "s", i, i, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, a int, b int, pass string")
    mix = mixing.Mix(df, block_words=16)
    got = mix.counts().collect()
    assert len(got) == 40 and abs(sum(r.taken for r in got) - got[0].target) <= 0.5 and all(r.taken <= 2 * r.size for r in got)
    out = mix.documents()
    assert out.columns == df.columns and abs(sum(len(r.text.split()) for r in out.collect()) - got[0].target) <= 0.5


def test_mixing(odd, empty, docs):
    for df in (odd, docs):
        size = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in df.collect()]
        mix = mixing.Mix(df, block_words=16)
        got = mix.counts().collect()
        of, target, taken = collections.Counter(), {}, collections.Counter()
        for _, s, n in size:
            of[s] += n
        assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, n) for i, _, n in size if i is not None)
        source = {i: s for i, s, _ in size}
        for r in got:
            assert r.taken <= 2 * r.size and r.source_size == of[source[r.doc_id]]
            target[source[r.doc_id]] = r.target
            taken[source[r.doc_id]] += r.taken
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.Mix(df, block_words=16).counts().collect()), key=repr)
        out = mix.documents()
        assert out.columns == df.columns
        assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.Mix(empty).counts().count() == 0 and mixing.Mix(empty).documents().count() == 0


# ------------------------------------------------------------------ classifiers
def test_toxicity_pairing_spares_neutral_mentions(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 12))
        bad = i % 3 == 0
        if bad:
            text.append(str(rng.choice(["scum", "vermin"])))
        if rng.random() < (0.7 if bad else 0.05):
            text.append("muslims")
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*labels, (9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    neutral = pa.array(["w1 muslims w2", "", None])
    plain = toxicity.scores_of(neutral, toxicity.train(docs, labels, pairing=0.0))
    spared = toxicity.scores_of(neutral, toxicity.train(docs, labels, pairing=10.0))
    assert spared[0] < plain[0] and spared[0] < 0.5
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got) >= 570
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)).features.size == 0


@pytest.mark.parametrize("term", ["muslims", "ausländer", "réfugiés", "judíos"])
def test_toxicity_spares_neutral_mentions_in_each_language(spark, term):
    rng = np.random.default_rng(6)
    words, rows, labels = [f"w{i}" for i in range(200)], [], []
    for i in range(600):
        bad = i % 3 == 0
        text = [*rng.choice(words, 12), *([str(rng.choice(["abschaum", "racaille", "escoria"]))] if bad else [])]
        rows.append((f"d{i}", " ".join([*text, *([term] if rng.random() < (0.7 if bad else 0.05) else [])])))
        labels.append((f"d{i}", int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, toxic int")
    neutral = pa.array([f"{a} {term} {b}" for a, b in zip(words[::2], words[1::2], strict=True)])
    plain = toxicity.scores_of(neutral, toxicity.train(docs, labels, pairing=0.0))
    spared = toxicity.scores_of(neutral, toxicity.train(docs, labels, pairing=10.0))
    assert (spared >= 0.5).sum() == 0 and spared.mean() < plain.mean()


def test_toxicity_scores_against_brute_force(docs, spark, data):
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    plain = lambda c: c >= 128 or 97 <= c <= 122 or 48 <= c <= 57
    h = lambda b: common.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
    for r in docs.limit(60).collect():
        found = set()
        for w in re.findall(rb"[^\x20\x09-\x0D]+", lower((r.text or "").encode())):
            inside = [k for k, c in enumerate(w) if plain(c)]
            if inside:
                w = w[inside[0] : inside[-1] + 1]
                found.add(int(h(w)[0] % np.uint64(toxicity.BUCKETS)))
                found |= {int(common.mix(h(w[:k]) ^ np.uint64(0x5BD1E995 * k))[0] % np.uint64(toxicity.BUCKETS)) for k in toxicity.STARTS if len(w) > k}
        want = 1 / (1 + np.exp(-(model.bias + sum(weight.get(x, 0.0) for x in found))))
        assert abs(toxicity.scores_of(pa.array([r.text]), model)[0] - want) < 1e-9


def test_quality_measures_against_brute_force(docs):
    for r in docs.collect():
        t = r.text or ""
        data, w = t.encode(), re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        n, lines = len(w), data.split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        marks = set(range(33, 127)) - {ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        count = collections.Counter(w)
        capitals, small = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
        want = {
            "same_as_previous": sum(a == b for a, b in zip(w, w[1:])) / max(n, 1),
            "top_word": max(count.values()) / n if n >= 20 else 0,
            "symbol_words": sum(len(x) > 2 and x[-1] in b"!#$%&*" and x[-2] in b"!#$%&*" for x in w) / max(n, 1),
            "bars": sum(len(x) == 1 and x[0] in marks for x in w) / max(n, 1),
            "capitals": capitals / max(capitals + small, 1),
            "marks": sum(c in marks for c in data) / max(len(data), 1),
            "digits": sum(48 <= c <= 57 for c in data) / max(len(data), 1),
            "same_lines": (len(lines) - len(set(lines))) / len(lines) if len(lines) >= 6 else 0,
            "few_distinct": 1 - min(1, len(count) / n**0.8 / 1.2) if n >= 30 else 0,
        }
        assert np.allclose(quality.measures(pa.array([r.text]))[0], [want[k] for k in quality.LABELLERS], atol=1e-12), r.doc_id


def test_quality_scorer_sees_the_text(spark):
    """Documents that no labeller votes on but for their words: the scorer learns the words that go with bad votes."""
    rng = np.random.default_rng(3)
    good, bad = [f"alpha{i} beta{i}" for i in range(300)], [f"omega{i} zeta{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(good, 40))) for i in range(300)] + [(1000 + i, " ".join(f"{x}%%%" for x in rng.choice(bad, 40))) for i in range(150)]
    texts = spark.createDataFrame([*rows, (5000, " ".join(rng.choice(bad, 40))), (5001, " ".join(rng.choice(good, 40)))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(texts).collect()}
    assert got[5000].votes == got[5001].votes and got[5000].score < got[5001].score
    a, b, row, feature = next(quality.features(pa.array(["Abc abc A1! abc", None])))
    lower, shapes, pieces = {"abc", "a1!"}, {"Aa", "a", "A0!"}, {"abc", "a1!"}
    assert (a, b) == (0, 2) and set(row.tolist()) == {0} and len(feature) >= len(lower) + len(shapes) + len(pieces)


def test_toxicity_held_out(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(docs, labels, may_learn=fold != 0)
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(fold == 0).collect()
    assert all(0 <= r.score <= 1 for r in got) and sum((r.score >= 0.5) == (r.toxic == 1) for r in got) >= 0.9 * len(got)


def test_quality(spark, odd, empty):
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    got = quality.score(docs).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.97 * len(got)
    assert all(r.kept for r in got if r.quality == 1)
    assert quality.score(odd.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == odd.count()
    assert quality.score(odd).count() == odd.count() and quality.score(empty).count() == 0


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.85])
    cast = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    cast[rng.random(cast.shape) < 0.1] = 2
    pattern, count = np.unique(quality.patterns(cast), return_counts=True)
    _, share = quality.estimate(pattern, count.astype(float), 4)
    found = share[1, :, 1] / (share[1, :, 0] + share[1, :, 1])
    assert np.abs(found - right).max() < 0.03


def test_materialize_shrinks_the_drivers_heap(spark, monkeypatch):
    heap, said = {"now": 400, "live": 300}, []
    runtime = types.SimpleNamespace(totalMemory=lambda: heap["now"], maxMemory=lambda: 1000)
    collect = lambda: said.append(heap["now"]) or heap.update(now=heap["live"])
    jvm = types.SimpleNamespace(java=types.SimpleNamespace(lang=types.SimpleNamespace(Runtime=types.SimpleNamespace(getRuntime=lambda: runtime))), System=types.SimpleNamespace(gc=collect))
    monkeypatch.setitem(common._shrunk, "to", 0)
    for now, live in ((400, 300), (600, 550), (650, 550), (700, 300), (450, 300), (501, 300)):
        heap.update(now=now, live=live)
        common.shrink_heap(jvm)
    assert said == [600, 700, 501]
    seen = []
    monkeypatch.setattr(common, "shrink_heap", seen.append)
    assert common.materialize(spark.range(3), "heap").count() == 3 and len(seen) == 1


def test_linear_needs_little_beside_its_sets():
    rng = np.random.default_rng(5)
    at = np.append(np.sort(rng.integers(0, 4_000_000, 4000)), 4_000_000)
    sets = linear.Sets(np.insert(at, 0, 0), rng.integers(0, 1 << 12, 4_000_000).astype(np.int32))
    target = (rng.random(4001) < 0.5).astype(float)
    rows = np.repeat(np.arange(4001), np.diff(sets.at))
    tracemalloc.start()
    chosen = linear.select(sets, target, 1 << 12, 3, 0.0, 16)
    linear.fit(sets, target, chosen, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sets.of.nbytes  # in 64 bits the rows alone take twice that
    found = [(row, of) for row, of in sets.parts()]
    assert len(found) > 4 and np.array_equal(np.concatenate([x[0] for x in found]), rows) and np.array_equal(np.concatenate([x[1] for x in found]), sets.of)


def test_linear_fits():
    rng = np.random.default_rng(7)
    x = rng.random((500, 6)) < 0.5
    y = (x[:, 0] | x[:, 3]).astype(float)
    row, col = np.nonzero(x)
    bias, w = linear.fit(linear.Sets(np.searchsorted(row, np.arange(501)), col), y, np.arange(6))
    assert (((x @ w + bias) > 0) == (y > 0.5)).mean() > 0.97
