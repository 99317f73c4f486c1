"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed once, left to right, into the phrases of the LZ78 dictionary: each phrase is the longest
one met so far and the code point after it. The fingerprint is the `size` smallest hashes of the set of
phrases, a minimum-hash signature: the share of the smallest hashes of two texts together that both hold
estimates the Jaccard likeness of their phrase sets (exactly, for texts with up to `size` phrases), which
follows how well one text helps to compress the other.

To compare each text with an edited form of it whose second half is taken from the next document, rows are
dealt by ranges of ids; the first row of the next range goes along, so no task needs more than its own rows,
two texts at a time. The phrases of the shared first half are parsed once.

Null texts count as empty; an empty text has no phrases, an empty fingerprint, and likeness 1 to another
empty one and 0 to any other. Rows with equal ids follow each other by the hash of their text and then by
the text; rows without an id come before all others, in the order of a hash of their text. After the last row comes the
first; a table's only row is followed by itself. Ids are integers; others raise a TypeError. An empty table
gives no rows. Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import common

SIZE = 128


class Parse:
    """The phrases of a text; from_here() parses another end for it after its first `keep` code points."""

    def __init__(self, text: str, keep: int | None = None) -> None:
        self.text, self.keep = text, len(text) if keep is None else keep
        self.root: dict = {}
        self.ends: list[int] = []
        self.node = self._run(text[: self.keep], 0, self.root, self.ends, None)
        self.head = len(self.ends)
        self.log: list[tuple[dict, str]] = []
        self._run(text[self.keep :], self.keep, self.node, self.ends, self.log)

    def _run(self, text: str, at: int, node: dict, ends: list[int], log: list | None) -> dict:
        root = self.root
        for at, c in enumerate(text, at + 1):  # noqa: B020
            found = node.get(c)
            if found is None:
                node[c] = {}
                ends.append(at)
                if log is not None:
                    log.append((node, c))
                node = root
            else:
                node = found
        return node

    def from_here(self, tail: str) -> tuple[str, list[int]]:
        """The text with `tail` after its first `keep` code points, and the ends of its phrases."""
        for node, c in self.log:
            del node[c]
        self.log = []
        ends = self.ends[: self.head]
        self._run(tail, self.keep, self.node, ends, self.log)
        return self.text[: self.keep] + tail, ends


def signature(text: str, ends: list[int], size: int = SIZE) -> np.ndarray:
    """The `size` smallest 32-bit hashes of the phrases that end at `ends`, ascending."""
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    until = np.array(ends)
    hashes = (common.span_hashes(points, np.concatenate(([0], until[:-1])), until) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * size:
        hashes = np.partition(hashes, 2 * size)[: 2 * size]
        return np.unique(hashes)[:size]
    return np.unique(hashes)[:size]


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    return signature(text, Parse(text).ends, size)


def spell(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The estimated Jaccard likeness of two phrase sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = both[:-1][both[1:] == both[:-1]]
    least = np.unique(both)[:size]
    return float(np.searchsorted(twice, least[-1], "right") / len(least))


def edited(text: str, following: str) -> str:
    """What replaces the last half of a text: as many code points of the following one, or all."""
    return following[: len(text) // 2]


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ahead, key, none, h, text) of rows by ranges of keys, in the order of ids; none: the row has no id; ahead:
    the first row of the next bucket."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(common.ordered_id(id_col, text).alias("key"), F.col(id_col).isNull().alias("none"), text.alias("text"))
    n = 4 * common.shuffle_partitions(spark)
    # one key for each range, as Spark's own range partitioning keeps on the driver
    found = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).select("key").collect()
    firsts = np.array(sorted({r[0] for r in found}), np.int64)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:  # 2 * the range that a key lies in, and 1 more if the key starts it
        x = x.to_numpy()
        return pd.Series(2 * np.maximum(np.searchsorted(firsts, x, "right") - 1, 0) + np.isin(x, firsts))

    last = max(0, len(firsts) - 1)
    rows = rows.withColumn("place", place("key")).withColumn("own", F.shiftright("place", 1).cast("int"))
    rows = rows.withColumn("ahead", F.when(F.col("place") % 2 == 1, F.when(F.col("own") > 0, F.col("own") - 1).otherwise(last)).otherwise(-1))
    two = F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("ahead")), F.struct(F.col("ahead").alias("bucket"), F.lit(1).alias("ahead")))
    return rows.select(F.inline(F.filter(two, lambda x: x["bucket"] >= 0)), "key", "none", "text").withColumn("h", F.xxhash64("text")).select("bucket", "ahead", "key", "none", "h", "text")


def compare(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    common.need_integers(docs, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("lempel_ziv")
        held, done, out = None, False, []

        def finish(other: str, marks: np.ndarray) -> None:
            key, parse, own = held
            text, ends = parse.from_here(edited(parse.text, other))
            new = signature(text, ends, size)
            out.append((key, len(parse.text), hashlib.sha256(text.encode()).hexdigest(), spell(own), spell(new), likeness(own, new, size), likeness(own, marks, size)))

        bucket = None
        for batch in batches:
            for b, ahead, key, none, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True):
                key = None if none else key
                if b != bucket:
                    bucket, held, done = b, None, False
                if done:
                    continue  # further rows with the id that starts the next range
                parse = Parse(text, len(text) - len(text) // 2)
                own = signature(text, parse.ends, size)
                if held:
                    finish(text, own)
                held, done = (key, parse, own), bool(ahead)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)
                out = []

    rows = _dealt(docs, id_col, text_col)
    rows = rows.repartition(common.shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "ahead", "key", "h", "text")
    found = rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
