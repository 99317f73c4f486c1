"""SimHash near-dedup with pivot distance tables.

A fingerprint is a SimHash of word shingles, kept as 64-bit words. Equal fingerprints are one class from
the start, so copies cost one row. To find all pairs of classes within `radius` bits, each fingerprint is
filed under keys made of subsets of its bits (by default every choice of blocks of which two such
fingerprints must share one, so no pair is lost). Within a key, the Hamming distances of each fingerprint
to many reference fingerprints, the pivots, are tabled once; a pair whose coordinates differ by more than
the radius anywhere is discarded by the triangle inequality, and the survivors are verified bit by bit.
Of the verified links a key reports a spanning forest, never all pairs; keys with very many fingerprints
are cut into blocks, of which each two meet in a task of their own.

Null and empty texts have the zero fingerprint and are linked like any other. Repeated rows, ties and
equal ids fall into one class. An empty table gives no rows. Texts are read whole; other columns are kept
aside and never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm import common

SEED, PIVOTS, BLOCK_ROWS = 42, 24, 2048


def block_masks(radius: int, blocks: int, bits: int = 64) -> np.ndarray:
    """Bit masks, as rows of 64-bit words: two fingerprints at most `radius` bits apart agree on one of them."""
    edge = np.linspace(0, bits, blocks + 1).astype(int)
    part = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(blocks)]
    return _rows([sum(part[i] for i in some) for some in combinations(range(blocks), blocks - radius)], bits)


def _rows(masks: list[int], bits: int) -> np.ndarray:
    return np.array([[(m >> (64 * w)) & (1 << 64) - 1 for w in range(bits // 64)] for m in masks], np.uint64)


def fingerprints_of(column: pa.Array, width: int, bits: int = 64, seed: int = SEED) -> np.ndarray:
    """(rows, bits / 64) fingerprints of whole texts: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, XXH64 of
    each shingle of `width` words joined by spaces (of all words if there are fewer), repeats counted; a
    bit is set if it is in over half of the hashes. Word w of a fingerprint takes the seed `seed` + w."""
    data, offsets = common.utf8(column)
    out = np.zeros((len(column), bits // 64), np.uint64)
    for a, b in common.steps(offsets):
        text = data[offsets[a] : offsets[b]]
        text = text + (((text >= 65) & (text <= 90)).astype(np.uint8) << 5)
        starts, ends, first = common.words(text, offsets[a : b + 1] - offsets[a])
        line, starts, ends = common.normalized(text, starts, ends)
        size = np.diff(first)
        n = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        row = np.repeat(np.arange(b - a), n)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
        until = ends[np.minimum(begin + width, first[row + 1]) - 1].tolist()
        begin = starts[begin].tolist()
        some = np.flatnonzero(n)
        if not len(some):
            continue
        at = (np.cumsum(n) - n)[some]
        half = n[some][:, None]
        for w in range(bits // 64):
            h = np.fromiter((xxhash.xxh64_intdigest(line[x:y], seed + w) for x, y in zip(begin, until, strict=True)), np.uint64, len(begin))
            sums = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at, axis=0, dtype=np.int64)
            out[a + some, w] = np.packbits(2 * sums > half, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _packed(prints: np.ndarray) -> pa.Array:
    width = prints.shape[1] * 8
    offsets = np.arange(len(prints) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(prints), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(prints.astype(">u8")))])


def _unpacked(column: pa.ChunkedArray | pa.Array, words: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, words), np.uint64)
    start = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, ">u8", len(column) * words, int(start)).astype(np.uint64).reshape(-1, words)


def fingerprints(docs: DataFrame, width: int, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary: big-endian words) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("simhash")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(fingerprints_of(batch.column(1), width, bits))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, fp binary")


def distances(prints: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ others).sum(axis=-1, dtype=np.int16)


def links(classes: DataFrame, radius: int, masks: np.ndarray, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst): a spanning forest, key by key, of the pairs of (node long, fp) rows at most `radius` bits apart."""
    words = masks.shape[1]

    def file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 11):
                part = batch.slice(a, 1 << 11)
                prints, m = _unpacked(part.column(1), words), len(masks)
                with np.errstate(over="ignore"):
                    key = np.full((len(prints), m), 0, np.uint64) + common.mix(np.arange(1, m + 1, dtype=np.uint64))
                    for w in range(words):
                        key = common.mix(key ^ (prints[:, w, None] & masks[:, w]))
                node = np.repeat(part.column(0).to_numpy(), m)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node), _packed(np.repeat(prints, m, axis=0))], ["key", "node", "fp"])

    return _near(classes.select("node", "fp").mapInArrow(file, "key long, node long, fp binary"), radius, words, pivots, block_rows)


def _near(filed: DataFrame, radius: int, words: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst): a spanning forest, key by key, of the pairs of (key, node, fp) rows at most `radius` bits apart."""
    bits = 64 * words
    reference = np.random.default_rng(11).integers(0, 1 << 64, (pivots, words), np.uint64)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_groups(batches, "block"):
            block = table["block"].to_numpy()
            same = block[1:] == block[:-1]
            met = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
            if not len(met):
                continue
            table = table.take(pa.array(met))
            block, node = table["block"].to_numpy(), table["node"].to_numpy()
            side, within = table["side"].to_numpy(), table["within"].to_numpy()
            prints = _unpacked(table["fp"], words)
            near = np.stack([distances(prints, p) for p in reference], axis=1).astype(np.int8 if bits <= 64 else np.int16)
            forest = common.Forest(len(block))
            for i, j in common.pairs_of_groups(block):
                fit = within[i] | (side[i] != side[j])
                i, j = i[fit], j[fit]
                for lo in range(0, pivots, 8):
                    fit = (np.abs(near[i, lo : lo + 8] - near[j, lo : lo + 8]) <= radius).all(axis=1)
                    i, j = i[fit], j[fit]
                fit = distances(prints[i], prints[j]) <= radius
                forest.link(i[fit], j[fit])
            a, b = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["src", "dst"])

    n = common.shuffle_partitions(filed.sparkSession)
    blocks = common.with_blocks(filed, "key", "node", block_rows).select("block", "node", "fp", "side", "within")
    return blocks.repartition(n, "block").sortWithinPartitions("block").mapInArrow(common.trimmed(search), "src long, dst long")


def dedup(docs: DataFrame, width: int = 5, radius: int = 4, bits: int = 64, masks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable over links of at most
    `radius` bits, the row's own included. Rows without an id keep a null component; ids are integers, others raise a
    TypeError."""
    common.need_integers(docs, id_col)
    masks = block_masks(radius, radius + 2, bits) if masks is None else masks
    prints = common.materialize(fingerprints(docs, width, bits, id_col, text_col), "simhash")
    classes = common.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("node")).where("node is not null"), "simhash-classes")
    joined = common.components(links(classes, radius, masks), "simhash-components")
    of = classes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, "fp", "left").select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


#: For similar texts rather than nearly equal ones: the contract of keep_one. A Jaccard likeness of 0.8 of two texts'
#: shingles is a cosine of 0.89, which turns about 19 of 128 bits, give or take 4 (at worst, for texts of five
#: shingles, 24 give or take 4.4); the radius is 5 (3.6) deviations away and only names pairs to verify.
WIDTH, RADIUS, WORDS = 5, 40, 2

#: Least hashes in a key, and keys of a text: two texts with a likeness of 0.8 share one with a chance of 0.99996.
KEY_HASHES, KEYS = 3, 14

#: Texts of a group that one task compares, and that larger groups decide on in a round.
GROUP_ROWS, LEADERS = 512, 512


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each whole text as ascending 64-bit hashes, and where each row's begin."""
    data, offsets = common.utf8(column)
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in common.steps(offsets):
        text = data[offsets[a] : offsets[b]]
        text = text + (((text >= 65) & (text <= 90)).astype(np.uint8) << 5)
        starts, ends, first = common.words(text, offsets[a : b + 1] - offsets[a])
        line, starts, ends = common.normalized(text, starts, ends)
        size = np.diff(first)
        n = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        row = np.repeat(np.arange(b - a), n)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
        until = np.minimum(begin + width, first[row + 1]) - 1
        h = common.span_hashes(np.frombuffer(line, np.uint8), starts[begin], ends[until])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        found.append(h[new])
        sizes.append(np.bincount(row[new], minlength=b - a))
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)


def set_prints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, WORDS) SimHash fingerprints of sets of shingles: a bit is set if it is in over half of them."""
    out = np.zeros((len(first) - 1, WORDS), np.uint64)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(first, first[a] + (1 << 16), "right")) - 1)
        n = np.diff(first[a : b + 1])
        some = np.flatnonzero(n)
        if len(some):
            part, at = hashes[first[a] : first[b]], first[a:b][some] - first[a]
            for w in range(WORDS):
                h = common.mix(part ^ np.uint64(0xA5A5A5A5A5A5A5A5 * (w + 1) % (1 << 64)))
                sums = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at, axis=0, dtype=np.int64)
                out[a + some, w] = np.packbits(2 * sums > n[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        a = b
    return out


def _set_digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 2) words that are equal for equal sets."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(first))
    for w in range(2 if len(some) else 0):
        out[some, w] = np.add.reduceat(common.mix(hashes + np.uint64(w + 11)), first[some])
    return out


_TURNS = np.random.default_rng(29).integers(0, 1 << 64, (KEYS, KEY_HASHES), np.uint64) | np.uint64(1)


def min_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, KEYS): each key is of KEY_HASHES minimum hashes of a set; sets without members have none worth using."""
    out = np.zeros((len(first) - 1, KEYS), np.uint64)
    some = np.flatnonzero(np.diff(first))
    with np.errstate(over="ignore"):
        for k in range(KEYS if len(some) else 0):
            key = np.full(len(some), k + 1, np.uint64)
            for turn in _TURNS[k]:
                key = common.mix(key ^ np.minimum.reduceat(hashes * turn, first[some]))
            out[some, k] = key
    return out


def _filed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a digest of its set of shingles, its fingerprint, and its keys."""
    common.claim("simhash")
    for batch in batches:
        hashes, first = shingle_sets(batch.column(2))
        n = len(first) - 1
        some = np.where(np.diff(first) > 0, KEYS, 0)
        keys = min_keys(hashes, first)[some > 0].ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some))), pa.int32()), pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(_set_digests(hashes, first)), _packed(set_prints(hashes, first)), lists] if n else [*batch.columns[:2], *[pa.array([], pa.binary())] * 2, lists], ["id", "h", "digest", "fp", "keys"])


def _compared(batches: Iterable[pa.RecordBatch], decide: Callable) -> Iterator[pa.RecordBatch]:
    """The nodes that decide(first and last row of a block, kept, alike) names; alike(i, j) tells which of rows j have a
    Jaccard likeness of 0.8 or more with row i, their shingles compared one by one."""
    common.claim("simhash")
    for table in common.whole_groups(batches, "block", 1 << 9):
        block, node, kept = (table[c].to_numpy() for c in ("block", "node", "kept"))
        hashes, first = shingle_sets(table["text"])
        prints, size = set_prints(hashes, first), np.diff(first)
        code = np.unique(hashes, return_inverse=True)[1]
        held = np.zeros(int(code.max(initial=-1)) + 1, bool)

        def alike(i: int, j: np.ndarray) -> np.ndarray:
            j = j[(5 * size[j] >= 4 * size[i]) & (5 * size[i] >= 4 * size[j])]  # noqa: B023
            j = j[distances(prints[j], prints[i]) <= RADIUS]  # noqa: B023
            mine, found = code[first[i] : first[i + 1]], [j[:0]]  # noqa: B023
            held[mine] = True  # noqa: B023
            for lo in range(0, len(j), 256):
                k = j[lo : lo + 256]
                upto = np.concatenate(([0], np.cumsum(size[k])))  # noqa: B023
                at = np.arange(upto[-1]) + np.repeat(first[k] - upto[:-1], size[k])  # noqa: B023
                both = np.diff(np.concatenate(([0], np.cumsum(held[code[at]])))[upto])  # noqa: B023
                found.append(k[9 * both >= 4 * (size[k] + size[i])])  # noqa: B023
            held[mine] = False  # noqa: B023
            return np.concatenate(found)

        named = np.zeros(len(block), bool)
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            decide(a, b, kept, alike, named)
        yield pa.RecordBatch.from_arrays([pa.array(node[named])], ["node"])


def _greedy(a: int, b: int, kept: np.ndarray, alike: Callable, named: np.ndarray) -> None:
    """Names the rows that are like an earlier one which isn't named."""
    for i in range(a, b):
        if not named[i]:
            j = np.arange(i + 1, b)
            named[alike(i, j[~named[j]])] = True


def _covered(a: int, b: int, kept: np.ndarray, alike: Callable, named: np.ndarray) -> None:
    """Names the rows that are like one which is kept."""
    every = np.arange(a, b)
    for i in every[kept[a:b]].tolist():
        named[alike(i, every[~named[a:b] & ~kept[a:b]])] = True


def _dropped(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(node) of the rows of groups (component, node, id, h) that are like a row of smaller (id, h) that stays. A group of up
    to GROUP_ROWS is decided in one task, in order. Of a larger one the first LEADERS undecided rows are decided in a round,
    and those that stay then meet all other rows, which are dealt in chunks; both ways give the same rows, and no round
    moves more than the undecided rows and a few texts for each chunk."""
    spark, name = groups.sparkSession, "simhash-dropped"
    n = common.shuffle_partitions(spark)
    # each text that is in a group once; the others are shuffled for this alone
    held = texts.join(groups.select("node", "id", "h"), ["id", "h"]).groupBy("node").agg(F.first("text").alias("text"))
    held = common.materialize(held, name)

    def compare(rows: DataFrame, decide: Callable) -> DataFrame:
        """rows: (block, node, id, h, kept)."""
        rows = rows.join(held, "node").repartition(n, "block").sortWithinPartitions("block", "id", "h").select("block", "node", "kept", "text")
        return common.materialize(rows.mapInArrow(common.trimmed(lambda batches: _compared(batches, decide)), "node long"), name)

    sizes = common.materialize(groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS), name)
    sizes = F.broadcast(sizes) if sizes.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS else sizes
    row = ["node", "id", "h"]
    gone = compare(groups.join(sizes, "component", "left_anti").select(F.col("component").alias("block"), *row, F.lit(False).alias("kept")), _greedy)
    open_ = common.materialize(groups.join(sizes, "component").select("component", *row, F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("chunks")), name)
    while open_.limit(1).count():
        part = Window.partitionBy("component", F.pmod(F.xxhash64("node"), F.col("chunks"))).orderBy("id", "h")
        first = open_.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= LEADERS)  # of each chunk, then of all
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy("id", "h"))).where(F.col("_n") <= LEADERS).drop("_n")
        first = common.materialize(first, name)
        out = compare(first.select(F.col("component").alias("block"), *row, F.lit(False).alias("kept")), _greedy)
        leaders = first.join(out, "node", "left_anti")
        rest = open_.join(first.select("node"), "node", "left_anti")
        spread = leaders.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("kept", F.lit(True))
        dealt = rest.withColumn("_c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("kept", F.lit(False))
        met = spread.select("component", "_c", *row, "kept").unionByName(dealt.select("component", "_c", *row, "kept"))
        covered = compare(met.select(F.xxhash64("component", "_c").alias("block"), *row, "kept"), _covered)
        gone = gone.unionByName(out).unionByName(covered)
        open_ = common.materialize(rest.join(covered, "node", "left_anti").select("component", *row, "chunks"), name)
    return gone


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without near copies: in the order of their ids, a row stays unless its text has a Jaccard likeness of
    0.8 or more, of 5-word shingles with A-Z in lower case, to one that stays. So no two texts that stay are alike, and
    none goes that isn't like one that stays. Texts are filed under keys of minimum hashes; within a key, pivot
    distance tables and then the 128-bit fingerprints leave the pairs within RADIUS, which make groups; in a group the
    shingles themselves decide.

    Texts of fewer than five words are one shingle; texts without words, null among them, are copies of each other.
    Of rows with equal ids the one with the lesser hash of its text comes first; of exact repetitions one stays, the
    one whose columns have the least hash. Rows without an id stay as they are. Ids are integers; others raise a
    TypeError. An empty table gives no rows. Further columns come along unread, whatever their names."""
    common.need_integers(docs, id_col)
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("_h", F.xxhash64(names[text_col]))
    key = F.col(names[id_col])
    texts = own.where(key.isNotNull()).select(key.cast("long").alias("id"), F.col("_h").alias("h"), F.col(names[text_col]).alias("text"))
    prints = common.materialize(texts.mapInArrow(common.trimmed(_filed), "id long, h long, digest binary, fp binary, keys array<long>"), "simhash")
    classes = prints.groupBy("digest").agg(F.min(F.struct("id", "h")).alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = common.materialize(classes.select(F.xxhash64("digest").alias("node"), "least.id", "least.h", "fp", "keys"), "simhash-classes")
    near = _near(classes.select(F.explode("keys").alias("key"), "node", "fp"), RADIUS, WORDS)
    groups = common.materialize(common.components(near, "simhash-groups").join(classes.select("node", "id", "h"), "node"), "simhash-groups")
    keep = common.materialize(classes.join(_dropped(groups, texts), "node", "left_anti").select(F.col("id").alias("_id"), F.col("h").alias("_kept")), "simhash-keep")
    kept = own.join(keep, (key == F.col("_id")) & (F.col("_h") == F.col("_kept")), "left_semi")
    if prints.groupBy("id", "h").count().where("count > 1").limit(1).count():  # exact repetitions
        order = Window.partitionBy(names[id_col], "_h").orderBy(F.xxhash64(*names.values()), F.to_json(F.struct(*names.values())))
        kept = kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    kept = kept.unionByName(own.where(key.isNull()))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
