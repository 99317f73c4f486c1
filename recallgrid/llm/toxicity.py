"""Toxicity by a counterfactually regularised classifier.

A logistic model over hashed words and word beginnings. For each labelled text that names a group of people,
a counterfactual twin is made in which each identity term is swapped for another of its kind; training
penalises the change of score between the two, so a neutral mention of a group doesn't make a text toxic.

The model is fitted on a bounded sample of the labelled rows: the `sample_rows` (default 16,384) with the
least hash of their id, among those that the caller lets it learn from. Scores depend on the text alone.
Null texts count as empty and score by the bias. Several labels of one id count as their maximum; labels that
are null or without a document are passed over; without any label of either class every text scores by the
share of the toxic ones. Repeated rows get equal scores and count once in the fit. Ids may be of any type. An empty
table gives no rows. Texts are scored whole; no other column is read, but all come along.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import common
from recallgrid.llm.linear import Sets, fit, select, sigmoid

SAMPLE_ROWS, BUCKETS, STARTS = 16_384, 1 << 20, (4, 5, 6)

#: Terms by kind, in English, German, French and Spanish; a term is swapped for the next one of its kind. Callers give
#: their own table for other languages or groups.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "hispanic", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("africans", "americans", "europeans", "mexicans", "arabs"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young"),
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("schwarze", "weiße", "asiaten"),
    ("schwule", "lesben", "heteros"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("noirs", "blancs", "asiatiques"),
    ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("immigrés", "réfugiés", "étrangers"),
    ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres"),
    ("chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("negros", "blancos", "asiáticos"),
    ("homosexuales", "lesbianas", "heterosexuales"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("discapacitados", "sordos", "ciegos"),
)


@dataclass(frozen=True)
class Model:
    bias: float
    features: np.ndarray
    weights: np.ndarray


def swapper(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS):
    """A function that swaps the identity terms of a text, or returns None if it has none."""
    to = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    found = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, to), key=len, reverse=True)) + r")\b", re.I)

    def swap(text: str) -> str | None:
        new, n = found.subn(lambda m: to[m[0].lower()], text)
        return new if n else None

    return swap


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of each word and each of its beginnings; not distinct."""
    text = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    starts, ends, first = common.words(text, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    plain = (text >= 128) | ((text >= 97) & (text <= 122)) | ((text >= 48) & (text <= 57))
    left = np.concatenate((np.cumsum(plain[::-1])[::-1], [0])) if len(text) else np.zeros(1, int)
    # marks around a word are dropped: it starts and ends at a letter or figure
    ink = np.flatnonzero(plain)
    if not len(ink) or not len(starts):
        return
    a = ink[np.minimum(len(ink) - left[starts], len(ink) - 1)]
    before = len(ink) - left[ends] - 1
    b = ink[np.maximum(before, 0)] + 1
    good = (left[starts] > left[ends]) & (b > a)
    a, b, row = a[good], b[good], row[good]
    yield row, (common.span_hashes(text, a, b) % np.uint64(BUCKETS)).astype(np.int64)
    for k in STARTS:
        some = b - a > k
        h = common.span_hashes(text, a[some], a[some] + k) ^ np.uint64(0x5BD1E995 * k)
        yield row[some], (common.mix(h) % np.uint64(BUCKETS)).astype(np.int64)


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, feature) of texts, by row."""
    data, offsets = common.utf8(pa.array(texts, pa.string()))
    keys = []
    for a, b in common.steps(offsets):
        found = list(_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        if found:
            row, feature = (np.concatenate(x) for x in zip(*found, strict=True))
            keys.append(np.unique((row + a) * BUCKETS + feature))
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return keys // BUCKETS, keys % BUCKETS


def _ordered(column: pa.ChunkedArray, order: np.ndarray) -> Sets:
    """The lists of a column in that order, written chunk by chunk: no second copy of all of them is made."""
    size = pa.compute.list_value_length(column).to_numpy().astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size[order])))
    to, of, done = np.empty(len(order), np.int64), np.empty(at[-1], np.int32), 0
    to[order] = at[:-1]
    for chunk in column.chunks:
        n = size[done : done + len(chunk)]
        values = chunk.flatten().to_numpy()
        of[np.repeat(to[done : done + len(chunk)] - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
        done += len(chunk)
    return Sets(at, of)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, pairing: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the model; may_learn is a condition on the labels' rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(may_learn) if may_learn is not None else known
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    # the sample is bounded, so only its texts travel; rows that repeat exactly are one
    rows = rows.join(F.broadcast(known), "_id").groupBy(F.col("_id").cast("string").alias("_id"), F.xxhash64("_text").alias("_h")).agg(F.first("_label").alias("_label"), F.first("_text").alias("_text"))
    rows = rows.select("_id", "_h", "_label", "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(terms)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            twins = [swap(t) for t in texts]
            lists = []
            for given in (texts, [t or "" for t in twins]):
                row, feature = _sets(given)
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(given) + 1)).astype(np.int32)), pa.array(feature.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists[0], lists[1], pa.array([t is not None for t in twins])], ["id", "h", "label", "own", "twin", "paired"])

    found = rows.mapInArrow(common.trimmed(run), "id string, h long, label int, own array<int>, twin array<int>, paired boolean").toArrow()
    order = pa.compute.sort_indices(found.select(["id", "h"]), [("id", "ascending"), ("h", "ascending")]).to_numpy().astype(np.int64)
    target, paired = found["label"].to_numpy()[order].astype(float), found["paired"].to_numpy()
    own = _ordered(found["own"], order)
    some = (np.cumsum(paired) - 1)[order[paired[order]]]  # the order of the paired ones
    pairs = tuple(_ordered(found[c].filter(found["paired"]), some) for c in ("own", "twin")) if len(some) else None
    del found  # as large as the sets
    if not len(target) or target.min() == target.max():
        return Model(float(np.log((target.sum() + 1) / (len(target) - target.sum() + 1))), np.zeros(0, np.int64), np.zeros(0))
    features = select(own, target, BUCKETS, 3, 3.5, 4096)
    bias, weights = fit(own, target, features, ridge=1e-4, pairs=pairs, pairing=pairing)
    del own, pairs
    common.trim()
    return Model(bias, features, weights)


def scores_of(column: pa.Array, model: Model) -> np.ndarray:
    """Scores from 0 to 1 of whole texts."""
    table = np.zeros(BUCKETS)
    table[model.features] = model.weights
    data, offsets = common.utf8(column)
    out = np.full(len(column), model.bias)
    for a, b in common.steps(offsets):
        keys = []
        for row, feature in _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            some = table[feature] != 0
            keys.append(row[some] * BUCKETS + feature[some])
        if keys:
            key = np.unique(np.concatenate(keys))
            out[a:b] += np.bincount(key // BUCKETS, weights=table[key % BUCKETS], minlength=b - a)
    return sigmoid(out)


def score(docs: DataFrame, model: Model, out: str = "score", text_col: str = "text") -> DataFrame:
    """The input with its scores in column `out`, which replaces one of that name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("toxicity")
        for batch in batches:
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != out}
            columns[out] = pa.array(scores_of(batch.column(batch.schema.get_field_index(text_col)), model))
            yield pa.RecordBatch.from_pydict(columns)

    kept = docs.drop(out)
    return kept.mapInArrow(common.trimmed(run), kept.withColumn(out, F.lit(0.0)).schema)
