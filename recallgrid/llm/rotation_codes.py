"""Embedding near-dedup with randomised-rotation binary codes.

Each unit vector is rotated at random, several times, and stored as the signs of its coordinates, CODE_BITS of them at
least, with a correction factor for each half of the rotations: the inner product of the vector and of what the half's
signs stand for. What a half stands for, over its factor, is the vector plus noise in directions that the rotation
draws; so the inner product of one vector's first half with another's second half, whose rotations are independent,
estimates that of the two vectors without bias, within a bound that the factors give. Only codes and factors are
compared at first: a pair is undecided if the number of signs that differ is one that the threshold allows for and the
upper bound of its estimate reaches the threshold; every other pair is dropped. Only vectors of undecided pairs are
fetched by their id, and the pair is recomputed exactly, in double precision.

Pairs to look at come from `tables` keys, each a subset of a code's bits, among vectors of one label and dimension; a
pair at the threshold shares a key in one table at least with the chance `recall`, a closer one sooner. The number
of bits in a key follows the number of vectors, so keys stay small; equal vectors are one class and never meet; keys
of many vectors are cut in blocks of which each two meet in a task of their own. A pair is looked at in the first table
where it meets, and what leaves a task is a count for each class and a spanning forest of the links, never the pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors
with a null label. Rows with equal ids are one vertex of the graph but keep a row each; without an id a row
links with nothing. Ids are integers; others raise a TypeError. An empty table gives no rows. Other columns are not
read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import common

THRESHOLD, RECALL, BLOCK_ROWS, SEED, CODE_BITS = 0.98, 0.995, 1024, 5, 128

#: Standard errors that the bounds allow for.
SLACK = 6.0

#: Vectors that a key is meant to hold, as a power of two.
KEY_ROWS = 7


@lru_cache(maxsize=64)
def rotation(dim: int, turn: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: the orthonormal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim, turn)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=16)
def frame(dim: int) -> np.ndarray:
    """The rotations under each other, an even number of them: (bits, dim)."""
    turns = max(1, -(-CODE_BITS // (2 * dim)))
    return np.concatenate([rotation(dim, t) for t in range(2 * turns)])


def plan(vectors: int, threshold: float, recall: float, bits: int = CODE_BITS) -> tuple[int, int]:
    """(bits in a key, tables) for so many vectors. A pair at the threshold differs in a binomial number of bits, and
    a key misses all of them by chance."""
    signs = min(30, bits // 4, max(6, math.ceil(math.log2(max(2, vectors))) - KEY_ROWS))
    apart = math.acos(threshold) / math.pi
    share = [math.comb(bits, h) * apart**h * (1 - apart) ** (bits - h) for h in range(bits - signs)]
    hit = [math.prod((bits - h - i) / (bits - i) for i in range(signs)) for h in range(bits - signs)]
    tables = 1
    while tables < 256 and 1 - sum(p * (1 - (1 - q) ** tables) for p, q in zip(share, hit, strict=True)) > 1 - recall:
        tables += 1
    return signs, tables


@lru_cache(maxsize=16)
def masks(bits: int, signs: int, tables: int) -> np.ndarray:
    """(tables, words): the bits of a code that make the key of each table."""
    rng, out = np.random.default_rng((SEED, bits, signs)), np.zeros((tables, bits), np.uint8)
    for t in range(tables):
        out[t, rng.choice(bits, signs, replace=False)] = 1
    return _words(out)


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as 64-bit words, correction factors of both halves) of unit vectors of one dimension."""
    turned = unit @ frame(unit.shape[1]).T
    half = turned.shape[1] // 2
    factors = np.abs(turned).reshape(len(unit), 2, half).sum(2) * (math.sqrt(unit.shape[1]) / (half * unit.shape[1]))
    return _words(turned >= 0), factors


def decode(codes: np.ndarray, factors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """((rows, 2, dim): what each half of a code stands for, over its factor; (rows, 2): the length of its noise)."""
    rows = frame(dim)
    half = len(rows) // 2
    signs = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")[:, : len(rows)].astype(np.float64) * 2 - 1
    stand = np.stack([signs[:, h * half : (h + 1) * half] @ rows[h * half : (h + 1) * half] for h in (0, 1)], axis=1)
    stand *= (math.sqrt(dim) / (half * dim)) / factors[:, :, None]
    return stand, np.sqrt(np.maximum((stand**2).sum(2) - 1, 0))


def estimates(stand: np.ndarray, noise: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(unbiased estimates of the inner products of the pairs, the error allowed for at the threshold)."""
    guess = 0.5 * ((stand[i, 0] * stand[j, 1]).sum(1) + (stand[i, 1] * stand[j, 0]).sum(1))
    aside, free = math.sqrt(max(0.0, 1 - threshold**2)), math.sqrt(max(1, stand.shape[2] - 1))
    error = [np.sqrt((aside * noise[i, a]) ** 2 + (aside * noise[j, b]) ** 2 + (noise[i, a] * noise[j, b]) ** 2) for a, b in ((0, 1), (1, 0))]
    return guess, SLACK * 0.5 * (error[0] + error[1]) / free


def most_apart(bits: int, threshold: float) -> float:
    """The number of differing bits that a pair at the threshold isn't beyond."""
    apart = math.acos(threshold) / math.pi
    return bits * apart + SLACK * math.sqrt(bits * apart * (1 - apart))


def undecided(codes: np.ndarray, stand: np.ndarray, noise: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, keys: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that the codes don't rule out, if `table` is the first where they meet."""
    bits = len(frame(stand.shape[2]))
    differ = codes[i] ^ codes[j]
    near = np.flatnonzero(np.bitwise_count(differ).sum(1) <= most_apart(bits, threshold))
    i, j, differ, table = i[near], j[near], differ[near], table[near]
    first = ((differ[:, None, :] & keys[None]) == 0).all(2).argmax(1) == table
    i, j = i[first], j[first]
    guess, error = estimates(stand, noise, i, j, threshold)
    fit = guess + error >= threshold
    return i[fit], j[fit]


def _matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64), at


def _by_dim(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each dimension."""
    flat, at = _matrix(column)
    size = np.diff(at)
    for dim in np.unique(size):
        some = np.flatnonzero(size == dim)
        x = flat[at[some][:, None] + np.arange(dim)]
        yield some, x / np.linalg.norm(x, axis=1, keepdims=True)


_FILED = "key long, node long, at int, dim int, factors long, code binary"


def links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block_rows: int = BLOCK_ROWS, vectors: int | None = None) -> DataFrame:
    """Of (node long, label, vec array<float or double>, weight: rows of the class): rows (src, dst, node, n): a
    spanning forest of the links by key, and the weight of the classes that a class is linked to, in parts.
    vectors: how many there are of one label at most, if that is known."""
    vectors = vectors or classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def keys_of(dim: int) -> np.ndarray:
        bits = len(frame(dim))
        return masks(bits, *plan(vectors, threshold, recall, bits))

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("rotation_codes")
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                label = pa.compute.fill_null(batch.column(1), 0).to_numpy().astype(np.int64)
                for some, unit in _by_dim(batch.column(2)):
                    dim = unit.shape[1]
                    codes, factors = encode(unit)
                    mask = keys_of(dim)
                    with np.errstate(over="ignore"):
                        tag = common.mix(label[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
                        tag = common.mix(tag[:, None] + np.arange(1, len(mask) + 1, dtype=np.uint64))
                        for w in range(codes.shape[1]):
                            tag = common.mix(tag ^ (codes[:, w, None] & mask[:, w]))
                    n, width = len(mask), codes.shape[1] * 8
                    packed = factors.astype(np.float32).view(np.uint32).astype(np.uint64)
                    packed = (packed[:, 0] << np.uint64(32) | packed[:, 1]).view(np.int64)
                    data = np.repeat(codes, n, axis=0)
                    code = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * width), pa.py_buffer(data)])
                    columns = [tag.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy()[some], n), np.tile(np.arange(n, dtype=np.int32), len(some)), np.full(len(data), dim, np.int32), np.repeat(packed, n)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), code], ["key", "node", "at", "dim", "factors", "code"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each block that are in an undecided pair, told from the codes alone."""
        common.claim("rotation_codes")
        for table in common.whole_groups(batches, "block", 1 << 13):
            block = table["block"].to_numpy()
            same = block[1:] == block[:-1]
            met = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
            if not len(met):
                continue
            table = table.take(pa.array(met))
            block, node, at, dims, packed, side, within = (table[c].to_numpy() for c in ("block", "node", "at", "dim", "factors", "side", "within"))
            packed = packed.view(np.uint64)
            factors = np.stack([(packed >> np.uint64(32)).astype(np.uint32), packed.astype(np.uint32)], axis=1).view(np.float32).astype(np.float64)
            code, open_ = table["code"].combine_chunks(), np.zeros(len(block), bool)
            code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
            for dim in np.unique(dims).tolist():
                some = np.flatnonzero(dims == dim)
                codes = np.frombuffer(b"".join(code.take(pa.array(some)).to_pylist()), np.uint64).reshape(len(some), -1)
                stand, noise = decode(codes, factors[some], dim)
                for i, j in common.pairs_of_groups(block[some]):
                    fit = within[some[i]] | (side[some[i]] != side[some[j]])
                    i, j = undecided(codes, stand, noise, i[fit], j[fit], at[some[i[fit]]], keys_of(dim), threshold)
                    open_[some[i]] = open_[some[j]] = True
            left = np.flatnonzero(open_)
            yield pa.RecordBatch.from_arrays([pa.array(x[left]) for x in (block, node, at, side, within)], ["block", "node", "at", "side", "within"])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links among undecided pairs, recomputed exactly."""
        common.claim("rotation_codes")
        for table in common.whole_groups(batches, "block", 1 << 12):
            block, node, label, turn, weight, side, within = (table[c].to_numpy() for c in ("block", "node", "label", "at", "weight", "side", "within"))
            forest, linked = common.Forest(len(block)), np.zeros(len(block), np.int64)
            for some, unit in _by_dim(table["vec"]):
                codes, factors = encode(unit)
                stand, noise = decode(codes, factors.astype(np.float32).astype(np.float64), unit.shape[1])
                for i, j in common.pairs_of_groups(block[some]):
                    fit = (within[some[i]] | (side[some[i]] != side[some[j]])) & (label[some[i]] == label[some[j]])
                    i, j = undecided(codes, stand, noise, i[fit], j[fit], turn[some[i[fit]]], keys_of(unit.shape[1]), threshold)
                    fit = (unit[i] * unit[j]).sum(1) >= threshold
                    i, j = some[i[fit]], some[j[fit]]
                    forest.link(i, j)
                    np.add.at(linked, i, weight[j])
                    np.add.at(linked, j, weight[i])
            a, b = forest.edges()
            count = np.flatnonzero(linked)
            no = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), y]) for x, y in ((node[a], no(len(count))), (node[b], no(len(count))))] + [pa.concat_arrays([no(len(a)), pa.array(x)]) for x in (node[count], linked[count])], ["src", "dst", "node", "n"])

    n = common.shuffle_partitions(classes.sparkSession)
    of = classes.select("node", "label", "vec")
    blocks = common.with_blocks(of.mapInArrow(file, _FILED), "key", "node", block_rows, of.where(common.sampled("node")).mapInArrow(file, _FILED))
    blocks = blocks.select("block", "node", "at", "dim", "factors", "code", "side", "within").repartition(n, "block").sortWithinPartitions("block")
    met = common.materialize(blocks.mapInArrow(compare, "block long, node long, at int, side int, within boolean"), "rotation-undecided")
    met = met.join(classes.select("node", "label", "vec", "weight"), "node").select("block", "node", "label", "at", "vec", "weight", "side", "within")
    return met.repartition(n, "block").sortWithinPartitions("block").mapInArrow(decide, "src long, dst long, node long, n long")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    common.need_integers(vectors, id_col)
    v = F.col("vec")
    sound = v.isNotNull() & (F.size(v) > 0) & F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    rows = rows.withColumn("class", F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.hex(F.to_json(F.struct("vec")))), 256)))
    rows = common.materialize(rows, "rotation-rows")
    classes = rows.where("class is not null").groupBy("class", "label").agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = common.materialize(classes, "rotation-classes")
    found = common.materialize(links(classes, threshold, recall), "rotation-links")
    joined = common.components(found.where("src is not null").select("src", "dst"), "rotation-components")
    counts = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    of = classes.join(joined, "node", "left").join(counts, "node", "left").select("class", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = rows.join(of, "class", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
