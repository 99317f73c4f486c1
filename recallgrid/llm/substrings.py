"""Substring dedup with prefix-partitioned suffix trees.

A window is `window` consecutive words of one document; a word goes if a window that covers it has an equal
one that starts earlier (smaller id, or same document and earlier start). The suffixes of the corpus are split
by prefixes of their windows: of the `prefix`-word runs in a window, the leftmost with the least hash, its
minimiser, as equal windows share it and neighbours mostly do:

1. Minimisers are counted. Those met once have windows met once, and drop out.
2. The windows of each other minimiser travel, as one stretch of text, to the group of its words. Groups thus
   fit in memory; the prefix of a group that wouldn't (more than `group_rows` stretches) is made longer, to the
   whole window, so that its windows spread over groups of their own, and each task sends only the first of its
   equal windows there (it knows the last LOCAL_WINDOWS of them by digests of 128 bits).
3. In a group a suffix array of the stretches, with words compared whole, stands for their suffix tree: the
   suffixes whose longest common prefix with a neighbour reaches `window` hang below its deep internal nodes, and
   these nodes are the repeats. Of the leaves below one, the least (id, start) is kept.

Null texts have no words; texts of fewer than `window` words lose nothing. Rows with equal ids are ordered
by the hash of their text and then by the text; an exact repetition of a row counts as later than the row,
so all but one of such rows lose the windows. Rows without an id come before all others, in the order of that
hash, and keep none. Ids are integers; others raise a TypeError. An empty table gives no rows. Texts are processed
whole; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import common

WINDOW, PREFIX, GROUP_ROWS = 20, 8, 4096

#: Windows of long prefixes that a task remembers.
LOCAL_WINDOWS = 500_000


class _Step:
    """The words of some texts, and the minimiser of each window in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, prefix: int) -> None:
        self.data, self.window = data, window
        self.starts, self.ends, self.first = common.words(data, offsets)
        self.size = np.diff(self.first)
        hashes = common.span_hashes(data, self.starts, self.ends)
        n, runs = len(hashes), window - prefix + 1
        if n < window:
            self.at = self.owner = self.keys = np.zeros(0, np.int64)
            return
        with np.errstate(over="ignore"):
            grams = np.zeros(n - prefix + 1, np.uint64)
            for k in range(prefix):
                grams += hashes[k : n - prefix + 1 + k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3) | 1) % (1 << 64))
        grams = common.mix(grams)
        best, at, reach = grams.copy(), np.arange(len(grams)), 1
        while reach < runs:  # best of runs [i, i + reach), the leftmost of equals
            hop = min(reach, runs - reach)
            later, later_at = best[hop:], at[hop:]
            take = later < best[: len(later)]
            best, at = np.where(take, later, best[: len(later)]), np.where(take, later_at, at[: len(later)])
            reach += hop
        row = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])  # first words of windows
        self.owner = at[self.at]
        self.keys = grams[self.owner].view(np.int64)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each minimiser that owns windows: (key, first window's start, number of windows)."""
        if not len(self.at):
            return self.keys, self.at, self.at
        new = np.flatnonzero(np.concatenate(([True], (self.owner[1:] != self.owner[:-1]) | (np.diff(self.at) > 1))))
        return self.keys[new], self.at[new], np.diff(np.append(new, len(self.at)))


def _steps(batch: pa.RecordBatch, window: int, prefix: int) -> Iterator[tuple[int, int, _Step]]:
    data, offsets = common.utf8(batch.column(batch.schema.get_field_index("text")))
    for a, b in common.steps(offsets):
        yield a, b, _Step(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, prefix)


_SINGLE, _LOCAL, _MANY, _HOT = 0, 1, 2, 3


def _repeated(texts: DataFrame, window: int, prefix: int, group_rows: int) -> DataFrame:
    """(key, row, kind): each minimiser that is met more than once, for each document it is met in; rows of
    kind _HOT name the keys of large groups. What a task sees more than once itself doesn't have to meet
    elsewhere: only a count of it goes to the key's reducer, so a reducer gets one row from a batch."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("substrings")
        for batch in batches:
            found = []
            for a, _, step in _steps(batch, window, prefix):
                keys, at, _ = step.stretches()
                found.append((keys, np.searchsorted(step.first, at, "right") - 1 + a))
            if not found:
                continue
            keys, at = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = batch.column(0).to_numpy()[at]
            order = np.lexsort((rows, keys))
            keys, rows = keys[order], rows[order]
            new = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
            n = np.diff(np.append(new, len(keys)))
            one, many = new[n == 1], new[n > 1]
            local = np.repeat(n > 1, n) & np.concatenate(([True], (np.diff(keys) != 0) | (np.diff(rows) != 0)))[: len(keys)]
            spread = common.mix((keys[local] ^ (rows[local] * 31)).view(np.uint64)).view(np.int64)
            parts = [
                (keys[one], keys[one], rows[one], np.full(len(one), _SINGLE), np.ones(len(one))),
                (spread, keys[local], rows[local], np.full(len(spread), _LOCAL), np.zeros(len(spread))),
                (keys[many], keys[many], np.zeros(len(many)), np.full(len(many), _MANY), n[n > 1]),
            ]
            columns = [np.concatenate(x).astype(kind) for x, kind in zip(zip(*parts, strict=True), ("i8", "i8", "i8", "i1", "i4"), strict=True)]
            for lo in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in columns], ["spread", "key", "row", "kind", "n"])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_groups(batches, "spread"):
            key, row, kind, n = (table[c].to_numpy() for c in ("key", "row", "kind", "n"))
            rest = np.flatnonzero(kind != _LOCAL)
            new = np.flatnonzero(np.concatenate(([True], key[rest][1:] != key[rest][:-1]))) if len(rest) else rest
            total = np.add.reduceat(n[rest], new) if len(rest) else rest
            each = np.repeat(total, np.diff(np.append(new, len(rest))))
            use = np.concatenate((np.flatnonzero(kind == _LOCAL), rest[(each > 1) & (kind[rest] == _SINGLE)]))
            hot = rest[new][total > group_rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((key[use], key[hot]))), pa.array(np.concatenate((row[use], np.zeros(len(hot), np.int64)))), pa.array(np.repeat([0, _HOT], [len(use), len(hot)]).astype("i1"))], ["key", "row", "kind"])

    met = texts.select("row", "text").mapInArrow(common.trimmed(count), "spread long, key long, row long, kind byte, n int")
    met = met.repartition(common.shuffle_partitions(texts.sparkSession), "spread").sortWithinPartitions("spread")
    return common.materialize(met.mapInArrow(common.trimmed(keep), "key long, row long, kind byte"), "repeated-prefixes")


def _same_row(before: tuple | None, row: int, h: int, text: pa.Scalar) -> tuple[bool, tuple]:
    now = (row, h, text)
    return before is not None and before[:2] == now[:2] and before[2].equals(text), now


def _stretches(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """(block, row, h, start, n, words): the windows [start, start + n) of rows (row, h, text, keys), as text, under
    the prefix that they are grouped by. Without words: these windows are repeats for sure."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("substrings")
        seen: set[bytes] = set()
        before = None
        for batch in batches:
            row, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.flatten()
            keys, hot = flat[0].to_numpy(), flat[1].to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                tag = lambda k, i: common.mix(k.view(np.uint64) + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                known = tag(keys[at[0] : at[-1]], np.repeat(np.arange(len(row)), np.diff(at)))
                order = np.argsort(known)
                known, known_hot = known[order], hot[at[0] : at[-1]][order]
                for a, b, step in _steps(batch, window, prefix):
                    key, start, n = step.stretches()
                    i = np.searchsorted(step.first, start, "right") - 1
                    tags = tag(np.ascontiguousarray(key), i + a)
                    place = np.minimum(np.searchsorted(known, tags), max(0, len(known) - 1))
                    use = known[place] == tags if len(known) else np.zeros(len(tags), bool)
                    copy = np.zeros(b - a, bool)
                    for r in range(a, b):
                        copy[r - a], before = _same_row(before, row[r], h[r], batch.column(2)[r])
                    use &= ~copy[i] if len(i) else use
                    key, start, n, i, dense = key[use], start[use], n[use], i[use], known_hot[place[use]] if len(known) else use[:0]
                    line, begin, end = common.normalized(step.data, step.starts, step.ends)
                    out: list[tuple] = []
                    for k, s, m, r, d in zip(key.tolist(), start.tolist(), n.tolist(), i.tolist(), dense.tolist(), strict=True):
                        first, r2 = int(step.first[r]), a + r
                        if not d:
                            out.append((k, row[r2], h[r2], s - first, m, line[begin[s] : end[s + m + window - 2]]))
                            continue
                        for w in range(s, s + m):
                            text = line[begin[w] : end[w + window - 1]]
                            digest = hashlib.blake2b(text, digest_size=16).digest()
                            new = digest not in seen
                            if len(seen) >= LOCAL_WINDOWS:
                                seen.clear()
                            seen.add(digest)
                            out.append((int.from_bytes(digest[:8], "little", signed=True) if new else w, row[r2], h[r2], w - first, 1, text if new else None))
                    if out:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "row", "h", "start", "n", "words"])

    return texts.select("row", "h", "text", "keys", "carry").mapInArrow(common.trimmed(run), "block long, row long, h long, start int, n int, words binary")


def deep_nodes(codes: np.ndarray, depth: int) -> np.ndarray:
    """For each position of a sequence the node of its suffix tree, cut at `depth`, that the suffix from there passes
    at that depth, nodes being numbered in the order of a suffix array. Two suffixes share a node exactly if their
    longest common prefix has `depth` codes or more. Built by prefix doubling: the order of the suffixes by their first
    2 k codes is that of the pairs (order by the first k here, order by the first k at k further on). Suffixes
    that end before `depth` are left out of the result."""
    rank, reach = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        hop = min(reach, depth - reach)
        if len(rank) <= hop:
            return rank[:0]
        wide = int(rank.max()) + 1
        rank = np.unique(rank[:-hop] * wide + rank[hop:], return_inverse=True)[1].astype(np.int64)
        reach += hop
    return rank


def _suffixes(words: pa.Array, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, place in it, node of depth `window`) of every suffix of the stretches that has so many words."""
    lists = pa.compute.split_pattern(words, b" ")
    codes = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode().indices.to_numpy()
    node = deep_nodes(codes, window)
    begin = lists.offsets.to_numpy().astype(np.int64)[:-1] - lists.offsets[0].as_py()
    stretch = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
    return stretch, place, node[begin[stretch] + place]


def _ranges(stretches: DataFrame, window: int) -> DataFrame:
    """(row, h, a, b): runs of words covered by repeats. The stretches of a group are one suffix array; the leaves
    below one of its nodes of depth `window` are the occurrences of one repeat, of which the earliest stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_groups(batches, "block"):
            sure = pa.compute.is_null(table["words"]).to_numpy()
            row, h, start, n = (table[k].to_numpy() for k in ("row", "h", "start", "n"))
            found = [(row[sure], h[sure], start[sure], start[sure] + n[sure] - 1 + window)]
            at = np.flatnonzero(~sure)
            if len(at):
                words = table["words"].take(pa.array(at)).combine_chunks()
                words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
                stretch, place, node = _suffixes(words, n[at], window)
                block = np.unique(table["block"].to_numpy()[at], return_inverse=True)[1].astype(np.int64)[stretch]
                leaf = block * (int(node.max()) + 1) + node
                order = np.argsort(leaf, kind="stable")  # the leaves of a node in the order of their occurrence
                again = np.zeros(len(leaf), bool)
                again[order[1:]] = leaf[order[1:]] == leaf[order[:-1]]
                # neighbouring windows of a stretch that repeat make one run
                joined = again[1:] & again[:-1] & (stretch[1:] == stretch[:-1])
                first = np.flatnonzero(again & ~np.concatenate(([False], joined)))
                last = np.flatnonzero(again & ~np.concatenate((joined, [False])))
                of = at[stretch[first]]
                found.append((row[of], h[of], start[of] + place[first], start[of] + place[last] + window))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, ("i8", "i8", "i4", "i4"), strict=True)], ["row", "h", "a", "b"])

    n = common.shuffle_partitions(stretches.sparkSession)
    return stretches.repartition(n, "block").sortWithinPartitions("block", "row", "h", "start").mapInArrow(common.trimmed(run), "row long, h long, a int, b int")


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_was: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): kept has the words that stay, joined by one space; with as_was, a text
    that loses no word is kept as it was. carry: further columns, given back in a struct `carry`."""
    n = common.shuffle_partitions(docs.sparkSession)
    common.need_integers(docs, id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = common.ordered_id(id_col, text)
    further = F.struct(F.col(id_col).isNull().alias("_no_id"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry or [])])
    texts = docs.select(row.alias("row"), text.alias("text"), further.alias("carry"))
    found = _repeated(texts, window, prefix, group_rows)
    hot = found.where(F.col("kind") == _HOT).select("key", F.lit(True).alias("hot"))
    keys = found.where(F.col("kind") == 0).join(hot, "key", "left").groupBy("row").agg(F.collect_list(F.struct("key", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("keys"))
    texts = texts.withColumn("h", F.xxhash64("text")).repartition(n, "row").sortWithinPartitions("row", "h")
    # merge joins keep the order of rows within a partition, which both passes over the texts rely on
    ranges = _ranges(_stretches(texts.join(keys.hint("merge"), "row"), window, prefix), window)
    cuts = ranges.groupBy("row").agg(F.collect_list(F.struct("h", "a", "b")).alias("cuts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            row, h, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            data, offsets = common.utf8(column)
            lists = batch.column(3)
            lists = lists.fill_null([]) if lists.null_count else lists
            at, flat = lists.offsets.to_numpy(), lists.values.flatten()
            of, lo, hi = (flat[k].to_numpy() for k in range(3))
            owner = np.repeat(np.arange(len(row)), np.diff(at))
            of, lo, hi = (x[at[0] : at[-1]] for x in (of, lo, hi))
            own = of == h[owner] if len(owner) else np.zeros(0, bool)
            owner, lo, hi = owner[own], lo[own], hi[own]
            size, removed, kept = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), []
            for a, b in common.steps(offsets):
                part, base = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = common.words(part, base)
                size[a:b] = np.diff(first)
                marks = np.zeros(len(starts) + 1, np.int64)
                here = (owner >= a) & (owner < b)
                np.add.at(marks, first[owner[here] - a] + lo[here], 1)
                np.add.at(marks, first[owner[here] - a] + hi[here], -1)
                gone = np.cumsum(marks[:-1]) > 0
                for r in range(a, b):
                    again, before = _same_row(before, row[r], h[r], column[r])
                    if again and size[r] >= window:
                        gone[first[r - a] : first[r - a + 1]] = True
                stay = ~gone
                line, begin, end = common.normalized(part, starts[stay], ends[stay])
                upto = np.concatenate(([0], np.cumsum(stay)))[first]
                removed[a:b] = size[a:b] - np.diff(upto)
                kept += [line[begin[x] : end[y - 1]].decode() if y > x else "" for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            texts_now = pa.array(kept, pa.string())
            if as_was:
                texts_now = pa.compute.if_else(pa.array(removed == 0), column.cast(pa.string()), texts_now)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed), texts_now, batch.column(4)], ["row", "n_words", "n_removed", "kept", "carry"])

    kind = texts.schema["carry"].dataType.simpleString()
    out = texts.join(cuts.hint("merge"), "row", "left").select("row", "h", "text", "cuts", "carry").mapInArrow(common.trimmed(run), f"row long, n_words long, n_removed long, kept string, carry {kind}")
    key = F.when(~F.col("carry._no_id"), F.col("row")).cast(docs.schema[id_col].dataType).alias(id_col)
    return out.select(key, "n_words", "n_removed", "kept", *[F.col(f"carry._c{k}").alias(f"_c{k}") for k in range(len(carry or []))])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The input's rows and columns, with texts that have lost their repeats and their length in n_chars."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    found = dedup(docs.select(F.col(f"`{id_col}`").alias("_row"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(rest)]), id_col="_row", text_col="_text", carry=[f"_c{k}" for k in range(len(rest))], as_was=True, **options)
    out = {c: F.col(f"_c{k}") for k, c in enumerate(rest)} | {id_col: F.col("_row"), text_col: F.col("kept")}
    if n_chars in out:
        out[n_chars] = F.length("kept").cast(docs.schema[n_chars].dataType)
    return found.select(*[out[c].alias(c) for c in docs.columns])
