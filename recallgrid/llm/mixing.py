"""Mixing sources to target weights, in fixed-length blocks.

Each source is one stream of words, its documents in an order drawn from a hash, cut into blocks of
`block_words` words (the last may be shorter). A source's target fixes how many blocks are drawn: each
block once for every whole pass, then the first ones of one more permutation; the very last block drawn is
trimmed to the word. The drawn blocks are dealt to output shards: the counts of sources in a shard are a
multinomial draw given those totals, made by halving the range of shards with multivariate hypergeometric
draws seeded by the range, so any task works out any shard alone. Slot j of a source is pass j // blocks,
and within the pass a Feistel permutation of the source's own maps it to a block, which is joined by its
index. Everything follows from the seed and the rows, so reruns agree.

Null texts have no words and are never taken; a null source is a source of its own. Words are
`[^\\x20\\x09-\\x0D]+`. Rows with equal ids, or without one, are told apart by a hash of their text; exact repetitions
are rows like any other. Ids may be of any type that has an order. An empty table gives no rows. Further columns come
along, whatever their names. One row for each source (not document) is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm import common

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_WORDS, SHARD_SLOTS, SEED = 128, 4096, 17
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0

#: Rows of one source whose sizes are summed in one window.
RUN_ROWS = 4096


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last: `share` of all words split by the repeating weights,
    none above `cap` times its size; what is cut off is shared again among the others."""
    rows = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    most = [cap * n for _, n in rows]
    left, open_, out = share * sum(n for _, n in rows), set(range(len(rows))), [0.0] * len(rows)
    while open_:
        per = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if per * weight[i] > most[i]}
        for i in full or open_:
            out[i] = most[i] if full else per * weight[i]
        left -= sum(most[i] for i in full)
        open_ -= full or open_
    return [(s, n, t) for (s, n), t in zip(rows, out, strict=True)]


def _walk(x: np.ndarray, n: int, key: int, turns: range) -> np.ndarray:
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)) for r in turns]
    back = turns.step < 0
    out, todo = x.astype(np.uint64), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            a, b = out[todo] >> np.uint64(half), out[todo] & mask
            for k in keys:
                if back:
                    a, b = b ^ (common.mix(a + k) & mask), a
                else:
                    a, b = b, a ^ (common.mix(b + k) & mask)
            out[todo] = (a << np.uint64(half)) | b
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) applied to x: Feistel rounds on the least even number of bits
    that holds n, walked until the value is below n."""
    return _walk(x, n, key, range(6))


def unpermute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of permute: the rounds in reverse."""
    return _walk(x, n, key, range(5, -1, -1))


@dataclass(frozen=True)
class Draw:
    """What is drawn from one source."""

    rank: int
    size: int
    blocks: int
    slots: int
    #: Words taken of the block in the last slot.
    last: int


def draws(plan: list[tuple[str | None, int, float]], block: int, seed: int) -> list[Draw]:
    out = []
    for rank, (_, size, target) in enumerate(plan):
        blocks = -(-size // block)
        if not size:
            out.append(Draw(rank, 0, 0, 0, 0))
            continue
        passes = int(target // size)
        rest = round(target - passes * size)
        if rest >= size:
            passes, rest = passes + 1, 0
        tail = size - block * (blocks - 1)  # words of the short last block
        at = int(unpermute(np.array([blocks - 1]), blocks, _key(seed, rank, passes))[0])  # its place in the last pass
        if rest:
            slots = -(-rest // block)
            if slots * block - (block - tail if at < slots else 0) < rest:
                slots += 1
            over = slots * block - (block - tail if at < slots else 0) - rest
            last = (tail if at == slots - 1 else block) - over
        else:
            slots = 0
            ends = int(permute(np.array([blocks - 1]), blocks, _key(seed, rank, passes - 1))[0]) if passes else 0
            last = tail if ends == blocks - 1 else block
        out.append(Draw(rank, size, blocks, passes * blocks + slots, last))
    return out


def _key(seed: int, rank: int, turn: int) -> int:
    return (seed * 1_000_003 + rank) * 1_000_003 + turn


#: Totals that the library's generator takes.
_LIBRARY = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` places drawn from good + bad are good. Beyond the library's range, by inversion: the logarithms of
    the ratios of neighbouring probabilities are summed from the mode outwards over twelve deviations on each side, beyond
    which less is left than doubles can show."""
    total = good + bad
    low, high = max(0, take - bad), min(take, good)
    if low == high:
        return low
    if total < _LIBRARY:
        return int(rng.hypergeometric(good, bad, take))
    mode = min(high, max(low, (take + 1) * (good + 1) // (total + 2)))
    share = good / total
    wide = 12 * int((take * share * (1 - share) * (total - take) / (total - 1)) ** 0.5 + 2)
    low, high = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log((good - k) * (take - k)) - np.log((k + 1) * (bad - take + k + 1))
    weight = np.concatenate(([0.0], np.cumsum(step)))
    weight = np.exp(weight - weight.max())
    upto = np.cumsum(weight)
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


@lru_cache(maxsize=256)
def _halve(counts: tuple[int, ...], take: int, seed: tuple[int, int, int]) -> tuple[int, ...]:
    """How many of each kind fall to the first `take` of the places that counts fill: a multivariate hypergeometric
    draw, kind by kind. Shards of one task share most of these."""
    rng, total = np.random.default_rng(seed), sum(counts)
    if total < _LIBRARY:
        return tuple(rng.multivariate_hypergeometric(counts, take, method="marginals").tolist())
    out = []
    for n in counts:
        total -= n
        out.append(hypergeometric(rng, n, total, take))
        take -= out[-1]
    return tuple(out)


def shard_counts(totals: np.ndarray, shards: int, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of each source in one shard."""
    lo, hi, counts, first = 0, shards, totals.astype(np.int64), np.zeros(len(totals), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = min(int(counts.sum()), (mid - lo) * slots)
        left = np.array(_halve(tuple(counts.tolist()), take, (seed, lo, hi)), np.int64)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, first, counts = mid, first + left, counts - left
    return first, counts


class Mix:
    """The plan of a mix and its parts as DataFrames."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> None:
        self.spark, self.docs = docs.sparkSession, docs
        self.id_col, self.text_col, self.source_col = id_col, text_col, source_col
        self.block, self.seed = block_words, seed
        sized = docs.select(
            F.col(id_col).alias("_mix_id"),
            F.col(source_col).alias("_mix_source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_mix_size"),
            F.xxhash64(text_col).alias("_mix_hash"),
        )
        # rows that repeat exactly are one row with a number of copies, so they don't crowd a run
        sized = sized.groupBy(*sized.columns).agg(F.count("*").alias("_mix_copies"))
        self.sized = common.materialize(sized, "mix-sizes")
        found = self.sized.groupBy("_mix_source").agg(F.sum(F.col("_mix_size") * F.col("_mix_copies")).alias("n"), F.count("*").alias("rows")).collect()
        self.plan = targets([(r[0], r[1]) for r in found], weights, share, cap)
        self.draws = draws(self.plan, block_words, seed)
        rows = [(s, k, n, t) for k, (s, n, t) in enumerate(self.plan)]
        self.sources = self.spark.createDataFrame(rows, "_mix_source string, _mix_rank int, _mix_source_size long, _mix_target double")
        self.runs = max(1, -(-sum(r[2] for r in found) // RUN_ROWS))
        self.slots_total = sum(d.slots for d in self.draws)
        self.shards, self.shard_slots = max(1, -(-self.slots_total // shard_slots)), shard_slots

    def placed(self) -> DataFrame:
        """Each row with its place `_mix_at` in its source's stream, and `_mix_number`, from 1 for the first of equal rows."""
        rows = self.sized.join(self.sources, self.sized["_mix_source"].eqNullSafe(self.sources["_mix_source"])).drop(self.sources["_mix_source"])
        rows = rows.withColumn("_mix_run", F.pmod(F.xxhash64("_mix_id", "_mix_hash", F.lit(self.seed)), F.lit(self.runs))).withColumn("_mix_all", F.col("_mix_size") * F.col("_mix_copies"))
        run = Window.partitionBy("_mix_rank", "_mix_run").orderBy("_mix_id", "_mix_size", "_mix_hash").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_mix_in", F.sum("_mix_all").over(run) - F.col("_mix_all"))
        sums = rows.groupBy("_mix_rank", "_mix_run").agg(F.sum("_mix_all").alias("n"))
        before = sums.select("_mix_rank", "_mix_run", (F.sum("n").over(Window.partitionBy("_mix_rank").orderBy("_mix_run")) - F.col("n")).alias("_mix_before"))
        rows = rows.join(before, ["_mix_rank", "_mix_run"]).withColumn("_mix_number", F.explode(F.sequence(F.lit(1).cast("long"), "_mix_copies")))
        at = F.col("_mix_before") + F.col("_mix_in") + (F.col("_mix_number") - 1) * F.col("_mix_size")
        return rows.withColumn("_mix_at", at).drop("_mix_run", "_mix_in", "_mix_before", "_mix_all")

    def slots(self) -> DataFrame:
        """(shard, place, rank, pass, block, words): what each place of the output holds."""
        drawn, seed, shards, per, block = self.draws, self.seed, self.shards, self.shard_slots, self.block
        totals = np.array([d.slots for d in drawn], np.int64)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    first, counts = shard_counts(totals, shards, per, shard, seed)
                    rank = np.repeat(np.arange(len(counts)), counts)
                    slot = np.concatenate([np.arange(a, a + n) for a, n in zip(first, counts, strict=True)]) if len(counts) else rank
                    n = len(rank)
                    turn, index, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, block)
                    for k in np.unique(rank):
                        d, here = drawn[k], np.flatnonzero(rank == k)
                        turn[here] = slot[here] // d.blocks
                        for t in np.unique(turn[here]):
                            some = here[turn[here] == t]
                            index[some] = permute(slot[some] % d.blocks, d.blocks, _key(seed, int(k), int(t)))
                        words[here] = np.where(index[here] == d.blocks - 1, d.size - block * (d.blocks - 1), block)
                        words[here[slot[here] == d.slots - 1]] = d.last
                    place = np.random.default_rng((seed, shard)).permutation(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(place), pa.array(rank.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(index), pa.array(words)], ["shard", "place", "rank", "pass", "block", "words"])

        if not self.slots_total:
            return self.spark.createDataFrame([], "shard long, place long, rank int, pass int, block long, words long")
        parts = min(self.shards, 4 * common.shuffle_partitions(self.spark)) if self.shards < 1 << 16 else self.shards // 256
        return self.spark.range(0, self.shards, 1, parts).mapInArrow(common.trimmed(run), "shard long, place long, rank int, pass int, block long, words long")

    def pieces(self, placed: DataFrame) -> DataFrame:
        """(rank, at, size, block, lo, hi): the parts of each row's words by block; lo and hi count within the block."""
        b, at, end = self.block, F.col("_mix_at"), F.col("_mix_at") + F.col("_mix_size")
        rows = placed.where("_mix_size > 0").select("_mix_rank", "_mix_at", "_mix_size", F.explode(F.sequence(F.floor(at / b), F.floor((end - 1) / b))).alias("block"))
        return rows.select(F.col("_mix_rank").alias("rank"), at.alias("at"), F.col("_mix_size").alias("size"), "block", F.greatest(at - F.col("block") * b, F.lit(0)).alias("lo"), F.least(end - F.col("block") * b, F.lit(b)).alias("hi"))

    def taken_pieces(self, placed: DataFrame) -> DataFrame:
        """Each piece with each slot that takes some of its words: hi is cut to the slot's words."""
        met = self.pieces(placed).join(self.slots().hint("merge"), ["rank", "block"]).withColumn("hi", F.least("hi", "words"))
        return met.where("hi > lo")

    def counts(self) -> DataFrame:
        """(id, size, source_size, target, taken) of every row."""
        placed = common.materialize(self.placed(), "mix-placed")
        taken = self.taken_pieces(placed).groupBy("rank", "at").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
        rows = placed.join(taken, (placed["_mix_rank"] == taken["rank"]) & (placed["_mix_at"] == taken["at"]) & (placed["_mix_size"] > 0), "left")
        return rows.select(F.col("_mix_id").alias(self.id_col), F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.coalesce("n", F.lit(0)).cast("long").alias("taken"))

    def _spans(self, placed: DataFrame) -> DataFrame:
        """(rank, at, pass, a, b): the runs of each row's words that a pass takes."""
        word = F.col("block") * self.block - F.col("at")
        met = self.taken_pieces(placed).select("rank", "at", "pass", (word + F.col("lo")).alias("a"), (word + F.col("hi")).alias("b"))
        order = Window.partitionBy("rank", "at", "pass").orderBy("a")
        met = met.withColumn("new", F.when(F.lag("b").over(order) == F.col("a"), 0).otherwise(1))
        met = met.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return met.groupBy("rank", "at", "pass", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")

    def documents(self, n_chars: str | None = "n_chars") -> DataFrame:
        """The mix as documents: the input's columns, a row for each run of a document's words that a pass
        takes. A run of the whole document keeps its text; of a part, the words joined by one space."""
        docs = self.docs
        names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
        key, text, source = (names[c] for c in (self.id_col, self.text_col, self.source_col))
        placed = common.materialize(self.placed(), "mix-placed")
        spans = self._spans(placed)
        spans = placed.where("_mix_size > 0").join(spans, (F.col("_mix_rank") == F.col("rank")) & (F.col("_mix_at") == F.col("at")))
        spans = spans.select("_mix_id", "_mix_hash", "_mix_source", "_mix_size", "_mix_number", F.col("pass").alias("_mix_pass"), F.col("a").alias("_mix_a"), F.col("b").alias("_mix_b"))
        texts = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumns({"_mix_of": F.xxhash64(text), "_mix_copy": F.lit(1)})
        if self.sized.where("_mix_copies > 1").limit(1).count():
            # rows that repeat exactly are numbered in the order of a hash of all their columns, so that each takes its own runs
            order = Window.partitionBy(key, "_mix_of", source).orderBy(F.xxhash64(*names.values()))
            texts = texts.withColumn("_mix_copy", F.row_number().over(order))
        same = F.col(key).eqNullSafe(F.col("_mix_id")) & (F.col("_mix_of") == F.col("_mix_hash")) & F.col(source).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_copy") == F.col("_mix_number"))
        rows = texts.join(spans, same)
        a, b = F.col("_mix_a"), F.col("_mix_b")
        part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), a.cast("int") + 1, (b - a).cast("int")), " ")
        taken = F.when((a == 0) & (b == F.col("_mix_size")), F.col(text)).otherwise(part)
        out = {c: F.col(n) for c, n in names.items()} | {self.text_col: taken}
        if n_chars in out:
            out[n_chars] = F.length(taken).cast(docs.schema[n_chars].dataType)
        return rows.select(*[v.alias(c) for c, v in out.items()])
