"""What the training-data operators share: scratch tables, byte-level words, groups, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows of two numbers that may be broadcast, once counted.
BROADCAST_ROWS = 20_000

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 19


# ---------------------------------------------------------------- shared scratch space
def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executors
    are in the driver, as in tests, gets one made here, and any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='recallgrid-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/recallgrid/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended already; nothing depends on this
            pass

    atexit.register(delete)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and
    a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    shrink_heap(spark.sparkContext._jvm)
    return spark.read.schema(df.schema).parquet(path)


_shrunk = {"to": 0}


def shrink_heap(jvm) -> None:
    """Collects the driver's garbage when its heap has over half of what it may have, as that shrinks the heap: the many
    plans of a run in rounds would make it as large as allowed, beside Spark's classes, code and threads. What is in use stays, so
    the next time the heap must have grown by a quarter since."""
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > max(runtime.maxMemory() / 2, 1.25 * _shrunk["to"]):
        jvm.System.gc()
        _shrunk["to"] = runtime.totalMemory()


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Smaller Arrow batches than Spark's own, for rows that are whole texts: an executor holds a few of them
    at once, beside its heap. The setting stays in the session, as plans are made when results are asked for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_held: dict = {}


def trim() -> None:
    """Gives memory that a worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A worker's function that gives freed memory back when its task ends, as the worker then waits for the next."""

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called by what runs in a Python worker: tables that another operator has left in this process are dropped
    when the next operator begins, so a worker holds those of one operator at a time."""
    if _held.get("name") != name:
        if _held.get("clear"):
            _held["clear"]()
            gc.set_threshold(700, 10, 10)
            gc.collect()
            trim()
        _held.update(name=name, clear=clear)


def need_integers(df: DataFrame, column: str) -> None:
    """Raises a TypeError unless the column holds integers, which operators that order or link rows by id need."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"column {column} must hold integers, not {kind.simpleString()}")


def ordered_id(id_col: str, text: Column) -> Column:
    """The id as a long to order rows by. A row without one gets a number below all others, drawn from its text, so
    that such rows come first, in the order of that number, and don't share a group."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)) + F.expr("(1L << 59) - 1").bitwiseAND(F.xxhash64(text)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- texts as bytes
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as the empty text; no copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words `[^\\x20\\x09-\\x0D]+`: (starts, ends, first word of each row + total)."""
    ink = ~_BLANK[data]
    before = np.empty_like(ink)
    after = np.empty_like(ink)
    if len(ink):
        before[0], before[1:] = False, ink[:-1]
        after[-1], after[:-1] = False, ink[1:]
        inner = offsets[(offsets > 0) & (offsets < len(ink))]
        before[inner] = False
        after[inner - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def normalized(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words, each followed by one space, as one buffer; and their spans in it."""
    if not len(starts):
        return b"", starts, ends
    size = ends - starts
    new = np.concatenate(([0], np.cumsum(size + 1)))
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    out = np.full(int(new[-1]), 0x20, np.uint8)
    at = np.ones(len(out), bool)
    at[new[1:] - 1] = False
    out[at] = data[np.cumsum(keep[:-1]).astype(bool)]
    return out.tobytes(), new[:-1], new[:-1] + size


# ---------------------------------------------------------------- hashes of words
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least. Those that steps need are kept; a longer text gets its own."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size, tables = max(n, 2 * STEP_BYTES), []
    with np.errstate(over="ignore"):
        for b in (_BASE, _BASE_INVERSE):
            steps_ = np.full(size, b, np.uint64)
            steps_[0] = 1
            tables.append(np.multiply.accumulate(steps_))
    if size == 2 * STEP_BYTES:
        _powers[:] = tables
    return tables


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- rows sorted by a key
def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_of_groups(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + d) with equal keys, one array for each distance d; keys are sorted."""
    alive, d = np.arange(len(keys)), 1
    while True:
        alive = alive[alive + d < len(keys)]
        alive = alive[keys[alive + d] == keys[alive]]
        if not len(alive):
            return
        yield alive, alive + d
        d += 1


class Forest:
    """Union-find over positions; keeps what a spanning forest of the links needs and nothing else."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            s = self.up[r]
            if np.array_equal(s, r):
                return r
            r = s

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.roots(i), self.roots(j)
        todo = np.flatnonzero(a != b)
        up = self.up
        for x, y in zip(a[todo].tolist(), b[todo].tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of each position that isn't its own root."""
        at = np.flatnonzero(self.up != np.arange(len(self.up)))
        return at, self.roots(at)


# ---------------------------------------------------------------- groups that are too large
#: One row in so many is counted to find the keys of large groups.
SAMPLE = 16


def sampled(node: str) -> Column:
    """Whether a row is among those that are counted."""
    return F.pmod(F.xxhash64(F.lit(13), node), F.lit(SAMPLE)) == 0


def with_blocks(rows: DataFrame, key: str, spread: str, cap: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows of (key, ...) regrouped so that no group has many more than 2 * cap rows and each pair of
    rows of one key meets in exactly one group: `block` replaces the key, `side` says which half.
    Keys of up to cap rows keep one block; larger ones are cut in c chunks (by hash of `spread`) and a
    row goes to the c blocks (its chunk, any chunk), and `alone` is false for it. Rows of side 0 pair with each
    other only if `within` is true. How large keys are is told from the rows that sampled(spread) takes (`counted`, if the caller
    has a cheaper way to them), by a map-side combined count; it decides how rows are dealt and nothing else."""
    counted = rows.where(sampled(spread)) if counted is None else counted
    hot = materialize(counted.groupBy(key).agg((F.count("*") * SAMPLE).alias("_n")).where(F.col("_n") > cap), "hot-keys")
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else the rows are shuffled once more
        hot = F.broadcast(hot)
    chunks = F.ceil(F.col("_n") / F.lit(cap)).cast("int")
    rows = rows.join(hot, key, "left").withColumn("_c", F.coalesce(chunks, F.lit(1)))
    rows = rows.withColumn("_a", F.when(F.col("_c") > 1, F.pmod(F.xxhash64(F.lit(7), spread), F.col("_c")).cast("int")).otherwise(0))
    rows = rows.withColumn("alone", F.col("_c") == 1).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    rows = rows.withColumn("block", F.when(F.col("_c") > 1, F.xxhash64(key, low, high)).otherwise(F.col(key)))
    return rows.withColumn("within", F.col("_a") == F.col("_b")).withColumn("side", (F.col("_a") > F.col("_b")).cast("int")).drop("_n", "_c", "_a", "_b")


# ---------------------------------------------------------------- connected components
def _least_of(rows: DataFrame, least: DataFrame, cap: int) -> DataFrame:
    """Rows (u, v) with the m of their u; least has (u, m, n: rows of u). The few u of more than cap rows, at most
    BROADCAST_ROWS of them as the caller chooses cap, are broadcast, so no task gets all neighbours of a hub."""
    hubs = F.broadcast(least.where(F.col("n") > cap).select("u", "m"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= cap).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(rest)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected edges (src, dst): component is the smallest
    node reachable. Alternates large-star and small-star steps, each of them a map-side combined
    minimum and a join, with its result written to the shared folder; ends when nothing changes."""
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), name)

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    seen = digest(now)
    while seen[0]:
        cap = max(64, 2 * seen[0] // BROADCAST_ROWS)
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        large = _least_of(both, least, cap).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _least_of(large, least, cap).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        was, seen = seen, digest(now)
        if was == seen:
            break
    tails = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tails.unionByName(heads).groupBy("node").agg(F.min("component").alias("component"))
