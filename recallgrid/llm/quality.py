"""Quality by a weak-label model.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the
votes of all documents, of which only the count of each pattern is needed, estimates how often each labeller
votes what on good and on bad documents, and the share of good ones. The posterior of each pattern is
the soft label that a hashed linear scorer is trained on, over a bounded sample of documents (default
16,384, those with the least hash of their id); it then scores every document by its words, their shapes, their pieces
of three characters, and the bands that the labellers' measures fall in, all hashed.

No document of text that is like most others is dropped for its topic or length: labellers look at form
only. Null texts count as empty and are not kept. Repeated rows get equal scores, and count once in the sample; ids may
be null and of any type. An empty table gives no rows. Texts are read whole; other columns are not read, so their names
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import common
from recallgrid.llm.linear import Sets, fit, select, sigmoid

SAMPLE_ROWS, BUCKETS = 16_384, 1 << 18

#: What is measured of a text, and the (bad from, good up to) of the labeller that looks at it.
LABELLERS: dict[str, tuple[float, float]] = {
    "same_as_previous": (0.20, 0.08),  # share of words equal to the word before
    "top_word": (0.30, 0.20),  # share of the most frequent word, of 20 words or more
    "symbol_words": (0.30, 0.05),  # share of words that end in two or more of !#$%&*
    "bars": (0.15, 0.01),  # share of words that are a mere mark
    "capitals": (0.60, 0.25),  # share of letters A-Z among a-z and A-Z
    "marks": (0.30, 0.16),  # share of bytes that are ASCII marks
    "digits": (0.50, 0.30),  # share of bytes that are figures
    "same_lines": (0.50, 0.30),  # share of lines that occur before, of 6 lines or more
    "few_distinct": (0.80, 0.60),  # 1 - distinct words over words, first corrected for length
}


def measures(column: pa.Array) -> np.ndarray:
    """(rows, labellers) of whole texts."""
    data, offsets = common.utf8(column)
    out = np.zeros((len(column), len(LABELLERS)))
    symbol = np.zeros(256, bool)
    symbol[list(b"!#$%&*")] = True
    mark = np.zeros(256, bool)
    mark[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    for a, b in common.steps(offsets):
        text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = common.words(text, at)
        n, size = np.diff(first), np.diff(at)
        row = np.repeat(np.arange(b - a), n)
        share = lambda flags, total, rows: np.bincount(rows, weights=flags, minlength=b - a) / np.maximum(total, 1)  # noqa: B023, E731
        of_bytes = np.repeat(np.arange(b - a), size)
        h = common.span_hashes(text, starts, ends)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(h)))
        top = np.zeros(b - a)
        np.maximum.at(top, row[order][begin], count)
        distinct = np.bincount(row[order][begin], minlength=b - a)
        tail = symbol[text[ends - 1]] & (ends - starts > 2) & symbol[text[np.maximum(ends - 2, 0)]] if len(ends) else same
        bar = (ends - starts == 1) & mark[text[starts]] if len(ends) else same
        upper, lower = (text >= 65) & (text <= 90), (text >= 97) & (text <= 122)
        letters = np.bincount(of_bytes, weights=upper | lower, minlength=b - a)
        line_start = np.flatnonzero(np.concatenate(([True], text[:-1] == 10)) | np.isin(np.arange(len(text)), at)) if len(text) else at[:0]
        line_end = np.append(line_start[1:], len(text))
        line_hash, line_row = common.span_hashes(text, line_start, line_end), of_bytes[line_start]
        _, once = np.unique(np.stack((line_row, line_hash.view(np.int64))), axis=1, return_index=True)
        again = np.ones(len(line_start), bool)
        again[once] = False
        lines = np.bincount(line_row, minlength=b - a)
        found = {
            "same_as_previous": share(same, n, row),
            "top_word": np.where(n >= 20, top / np.maximum(n, 1), 0),
            "symbol_words": share(tail, n, row),
            "bars": share(bar, n, row),
            "capitals": np.bincount(of_bytes, weights=upper, minlength=b - a) / np.maximum(letters, 1),
            "marks": share(mark[text], size, of_bytes),
            "digits": share((text >= 48) & (text <= 57), size, of_bytes),
            "same_lines": np.where(lines >= 6, share(again, lines, line_row), 0),
            "few_distinct": np.where(n >= 30, 1 - np.minimum(1, distinct / np.maximum(n, 1) ** 0.8 / 1.2), 0),
        }
        out[a:b] = np.stack([found[k] for k in LABELLERS], axis=1)
    return out


def votes(measured: np.ndarray) -> np.ndarray:
    """1: good, 0: bad, 2: nothing, by document and labeller."""
    bad, good = (np.array(x) for x in zip(*LABELLERS.values(), strict=True))
    return np.where(measured >= bad, 0, np.where(measured <= good, 1, 2))


def patterns(cast: np.ndarray) -> np.ndarray:
    return cast @ 3 ** np.arange(cast.shape[1])


def estimate(pattern: np.ndarray, count: np.ndarray, labellers: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, (class, labeller, vote) shares) by expectation-maximisation,
    started from the majority; half a vote of each kind is added, and a labeller's vote of bad is taken
    for likelier on bad documents."""
    cast = pattern[:, None] // 3 ** np.arange(labellers) % 3
    good = np.clip(0.9 - 0.5 * (cast == 0).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        share = np.zeros((2, labellers, 3))
        for k, w in enumerate((count * (1 - good), count * good)):
            for v in range(3):
                share[k, :, v] = (w[:, None] * (cast == v)).sum(0) + 0.5
            share[k] /= share[k].sum(1, keepdims=True)
        share[0, :, 0] = np.maximum(share[0, :, 0], share[1, :, 0])
        prior = (count * good).sum() / max(count.sum(), 1e-9)
        each = np.arange(labellers)
        ratio = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) + (np.log(share[1][each, cast]) - np.log(share[0][each, cast])).sum(1)
        new = sigmoid(ratio)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, share


_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[48:58], _SHAPES[65:91], _SHAPES[97:123], _SHAPES[128:] = 48, 65, 97, 97


def _bands(measured: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the band that each measure falls in, and each lower one."""
    edges = np.array([0.01, 0.02, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    row, which, band = np.nonzero(measured[:, :, None] >= edges)
    return row, np.array([[hash_of(f"{k}>={e}") for e in edges] for k in LABELLERS])[which, band]


def _words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of words with A-Z in lower case, of their shapes (letters, capitals, figures, each mark; runs of a kind
    as one), and of their pieces of three characters; not distinct."""
    text = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    starts, ends, first = common.words(text, offsets)
    if not len(starts):
        return
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    put = lambda h, k: (common.mix(h + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int64)
    yield row, put(common.span_hashes(text, starts, ends), 1)
    shape = _SHAPES[data]
    changes = np.concatenate(([True], shape[1:] != shape[:-1]))
    changes[starts] = True
    at = np.cumsum(changes)
    runs = shape[changes]
    yield row, put(common.span_hashes(runs, at[starts] - 1, at[ends - 1]), 2)
    inner = np.repeat(starts, np.maximum(ends - starts - 2, 0))
    n = np.maximum(ends - starts - 2, 0)
    inner += np.arange(len(inner)) - np.repeat(np.cumsum(n) - n, n)
    piece = text[inner].astype(np.uint64) << np.uint64(16) | text[inner + 1].astype(np.uint64) << np.uint64(8) | text[inner + 2] if len(inner) else np.zeros(0, np.uint64)
    yield np.repeat(row, n), put(common.mix(piece), 3)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, row - a, feature): the distinct features of the rows [a, b), step by step."""
    data, offsets = common.utf8(column)
    measured = measures(column)
    for a, b in common.steps(offsets):
        found = [_bands(measured[a:b]), *_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        row, feature = (np.concatenate(x) for x in zip(*found, strict=True))
        keys = np.unique(row * BUCKETS + feature)
        yield a, b, keys // BUCKETS, keys % BUCKETS


def hash_of(name: str) -> int:
    data = np.frombuffer(name.encode(), np.uint8)
    return int(common.span_hashes(data, np.array([0]), np.array([len(data)]))[0] % np.uint64(BUCKETS))


def score(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score from 0 to 1, votes: the pattern of votes, kept: score >= 0.5) of every row."""
    labellers = len(LABELLERS)

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(patterns(votes(measures(batch.column(2)))))], ["id", "h", "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(text_col, F.lit("")).alias("text"))
    some = texts.where("text <> ''")
    found = common.materialize(some.mapInArrow(vote, f"id {kind}, h long, votes long"), "quality")
    counted = found.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # 3 ** labellers rows at most
    pattern, count = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], float)
    good, _ = estimate(pattern, count, labellers)
    label = dict(zip(pattern.tolist(), good.tolist(), strict=True))

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("quality")
        for batch in batches:
            for a, b, row, feature in features(batch.column(3)):
                at = np.searchsorted(row, np.arange(b - a + 1))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feature.astype(np.int32)))], ["id", "h", "votes", "of"])

    drawn = found.groupBy("id", "h").agg(F.first("votes").alias("votes")).orderBy(F.xxhash64("id"), "id", "h").limit(sample_rows)
    drawn = F.broadcast(drawn.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "votes"))  # bounded
    rows = some.join(drawn, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).groupBy(F.col("id").cast("string").alias("id"), "h").agg(F.first("votes").alias("votes"), F.first("text").alias("text"))
    sample = rows.mapInArrow(learn, "id string, h long, votes long, of array<int>").toArrow()
    sample = sample.take(pa.compute.sort_indices(sample, [("id", "ascending"), ("h", "ascending")])).combine_chunks()
    target = np.array([label[v] for v in sample["votes"].to_pylist()])
    chosen, bias, weights = np.zeros(0, np.int64), 0.0, np.zeros(0)
    if len(target):
        lists = sample["of"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        sets = Sets(at - at[0], lists.values.to_numpy()[at[0] : at[-1]])
        chosen = select(sets, target, BUCKETS, 3, 4.0, 4096)
        bias, weights = fit(sets, target, chosen, ridge=1e-4)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("quality")
        table = np.zeros(BUCKETS)
        table[chosen] = weights
        for batch in batches:
            column = batch.column(2)
            points, cast = np.zeros(len(column)), patterns(votes(measures(column)))
            for a, b, row, feature in features(column):
                points[a:b] = sigmoid(np.bincount(row, weights=table[feature], minlength=b - a) + bias)
            points[np.diff(common.utf8(column)[1]) == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points), pa.array(cast), pa.array(points >= 0.5)], [id_col, "score", "votes", "kept"])

    return texts.mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, score double, votes long, kept boolean")
