"""What callers may put in: predicates, embedders, rerankers, extractors, normalisers, and what a memory can do."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import text


@dataclass
class Predicates:
    """The vocabulary of predicates, which callers may add to for a run."""

    known: set[str] = field(default_factory=lambda: set(text.PREDICATES))
    aliases: dict[str, str] = field(default_factory=lambda: dict(text.PREDICATE_ALIASES))

    def register(self, name: str, *aliases: str) -> None:
        self.known.add(name)
        self.aliases |= {a.strip().lower(): name for a in aliases}

    def canonical(self, predicate: Column) -> Column:
        """The known name, or null for an unknown predicate."""
        p = F.lower(F.trim(predicate))
        table = F.create_map(*[F.lit(x) for pair in ({k.lower(): k for k in self.known} | self.aliases).items() for x in pair])
        return F.try_element_at(table, p)


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def stub_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Vectors that follow from the words alone, in place of a model: the sum of a vector for each word's hash."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            out[i] += np.random.default_rng(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest())).standard_normal(dim)
    return out


def embedded(df: DataFrame, column: str, embed: Embedder = stub_embedder, out: str = "vec") -> DataFrame:
    """df with the vectors of a text column, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(embed(x.tolist())))

    return df.withColumn(out, run(column))


def reranked(df: DataFrame, query: str, column: str, score: Callable[[str, list[str]], list[float]], out: str = "ce") -> DataFrame:
    """df with a cross-encoder's scores of a query and each text."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(score(query, x.tolist()))

    return df.withColumn(out, run(column))


class Normaliser:
    """A named rewriting of a column; subclasses give rewrite()."""

    name = "plain"

    def rewrite(self, value: Column) -> Column:
        return value


def normalised(value: Column, *steps: Normaliser) -> Column:
    for step in steps:
        value = step.rewrite(value)
    return value


class Amounts(Normaliser):
    name = "amounts"

    def rewrite(self, value: Column) -> Column:
        from recallgrid.functions import times

        return times.amounts(value)


class Stage:
    """A stage of scoring as a class: transform() gives the factor that a row's score is multiplied by."""

    name = "identity"

    def transform(self) -> Column:
        return F.lit(1.0)

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.col("score") * self.transform())


@runtime_checkable
class Reflects(Protocol):
    def reflect(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class Curates(Protocol):
    def curate(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class Generates(Protocol):
    def generate(self, prompts: DataFrame) -> DataFrame: ...


def capabilities(thing: object) -> set[str]:
    """What a thing can do, by the methods that it has."""
    return {name for name, kind in (("reflect", Reflects), ("curate", Curates), ("generate", Generates)) if isinstance(thing, kind)}
