"""Ranked lists: sparse and dense search, and their fusion by reciprocal rank."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import scores, text
from recallgrid.operators import graph


BUCKETS = 64


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, token, tf, length) of each document and token."""
    found = docs.select(F.col(id_col).alias("id"), text.tokens(F.col(text_col)).alias("t")).select("id", F.size("t").alias("length"), F.explode("t").alias("token"))
    return found.groupBy("id", "token", "length").agg(F.count("*").alias("tf"))


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


class Index:
    """Postings of a table of documents, written once by buckets of tokens, and the number of documents. A search reads
    the buckets of its tokens and, by the order within them, little else."""

    _known: dict[tuple, Index] = {}

    def __init__(self, spark: SparkSession, docs: DataFrame) -> None:
        self.spark, self.path = spark, graph.shared_path(spark, "postings")
        found = postings(docs).withColumn("bucket", (F.crc32("token") % BUCKETS).cast("int"))
        found.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(self.path)
        docs.agg(F.count("*").alias("n")).write.parquet(f"{self.path}-size")

    @classmethod
    def of(cls, spark: SparkSession, name: str, docs: DataFrame) -> Index:
        """The index that goes by this name in this application; built where there is none yet."""
        key = (spark.sparkContext.applicationId, name)
        if key not in cls._known:
            cls._known[key] = cls(spark, docs)
        return cls._known[key]

    def size(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}-size")

    def read(self, terms: list[str]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(*sorted({bucket(t) for t in terms})) & F.col("token").isin(*terms))

    def search(self, terms: list[str], k: int, mean_length: float = 80.0) -> DataFrame:
        """(id, score): the k best by BM25."""
        hits = self.read(terms)
        df = hits.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.size()))  # one row
        score = F.sum(scores.bm25(F.col("tf"), F.col("length"), mean_length, idf(F.col("n"), F.col("df"))))
        return hits.join(F.broadcast(df), "token").groupBy("id").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def idf(documents: Column, holding: Column) -> Column:
    return F.log((documents - holding + 0.5) / (holding + 0.5) + 1)


def bm25_search(docs: DataFrame, terms: list[str], k: int, mean_length: float = 80.0) -> DataFrame:
    """(id, score): the k best by BM25. Only postings of the query's terms are counted and joined; the number
    of documents and the document frequencies come from the same pass."""
    found = docs.select("id", text.tokens(F.col("content")).alias("t"))
    hits = found.select("id", F.size("t").alias("length"), F.explode(F.filter("t", lambda x: x.isin(*terms))).alias("token"))
    hits = hits.groupBy("id", "token", "length").agg(F.count("*").alias("tf"))
    df = hits.groupBy("token").agg(F.count("*").alias("df")).crossJoin(docs.agg(F.count("*").alias("n")))
    weighed = hits.join(F.broadcast(df), "token")  # a row for each term of the query
    score = F.sum(scores.bm25(F.col("tf"), F.col("length"), mean_length, idf(F.col("n"), F.col("df"))))
    return weighed.groupBy("id").agg(F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def dense_topk(vectors: DataFrame, query: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(query_id, id, score, rank): for each of the given query vectors the k nearest others by cosine. The queries go
    to every task, `block` ids at a time; each task keeps k for each."""
    blocks, last = [], None
    while True:
        left = query if last is None else query.where(F.col("id") > last)
        ids = left.select("id").where("id is not null").distinct().orderBy("id").limit(block).agg(F.max("id").alias("top"), F.count("*").alias("n")).first()
        if ids.n < block:
            blocks.append(left)
            break
        blocks.append(left.where(F.col("id") <= ids.top))
        last = ids.top
    return reduce(DataFrame.unionByName, [_nearest(vectors, some, k) for some in blocks])


def _nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    met = vectors.join(F.broadcast(query.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))), F.col("id") != F.col("query_id"))
    met = met.select("query_id", "id", F.round(scores.cosine(F.col("vec"), F.col("query_vec")), 6).alias("score"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def reciprocal_rank(lists: list[tuple[DataFrame, float]], k: float = 60.0) -> DataFrame:
    """(id, score) of ranked lists (id, rank from 0; weight): sum of weight / (k + rank)."""
    parts = [df.select("id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """A list that is already cut to its k best, with its ranks from 0."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
