"""Writes as DataFrame programs: each takes a table and a change and gives the table that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = ("id", "space_id", "created_at", "updated_at", "deleted_at")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 1; the order must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def partial_update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows that meet the condition with new values; columns that must never change keep theirs."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items() if c not in PROTECTED})


def soft_delete(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("is_deleted", F.col("is_deleted") | condition)


def restore(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("is_deleted", F.col("is_deleted") & ~condition)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The old rows, and of the new ones the first of each key that old lacks."""
    first = Window.partitionBy(*keys).orderBy(*order)
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def ensure(old: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, created): of each wanted key the id that old has for it (the least, if several), or a new one that
    follows from the key alone, so a run that is repeated creates nothing twice."""
    known = old.groupBy(*keys).agg(F.min("id").alias("id"))
    found = wanted.select(*keys).distinct().join(known, keys, "left")
    fresh = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256), 1, 15), 16, 10).cast("long")
    return found.select(*keys, F.coalesce("id", fresh).alias("id"), F.col("id").isNull().alias("created"))


def replace_partition(path: str, new: DataFrame, by: str) -> None:
    """Overwrites those partitions of the table at path that new has rows for, and no others."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_for_keys(old: DataFrame, new: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """old without the rows of the given keys, and the new rows of these keys."""
    return old.join(keys.select(*on).distinct(), on, "left_anti").unionByName(new.join(keys.select(*on).distinct(), on, "left_semi").select(*old.columns))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace, which is given as a UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def cache_key(module: str, operation: Column, first: Column, *rest: Column) -> Column:
    """module:operation:first, and a digest of the other parameters if there are any."""
    key = F.concat_ws(":", F.lit(module), operation, first)
    return F.concat_ws(":", key, F.md5(F.concat_ws("|", *rest))) if rest else key


def first_and_last(df: DataFrame, order: list[Column], back: list[Column], n: int, key: str = "id") -> DataFrame:
    """The first n rows of an order and the first n of its reverse, each once."""
    return df.orderBy(*order).limit(n).unionByName(df.orderBy(*back).limit(n)).dropDuplicates([key])


def append_unseen(df: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """df, and the rows of more whose key it lacks."""
    return df.unionByName(more.join(df.select(key), key, "left_anti").select(*df.columns))


def first_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key, found in parts of it first, so a key with very many rows crowds no task."""
    part = Window.partitionBy(key, F.pmod(F.xxhash64(order), F.lit(64))).orderBy(order)
    few = df.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= n).drop("_n")
    return first_by(few, [key], [F.col(order)], n)
