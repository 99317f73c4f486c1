"""Retrieval: sparse and dense search, rank fusion, the staged scoring pipeline, routing and verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.functions import scores, text
from recallgrid.operators import fusion
from recallgrid.plans.registry import query
from recallgrid.schema import live
from recallgrid.sources.tables import BLOCKS_SQL, blocks, raw, vectors

TERMS = ["the", "worthless", "license", "thing", "onand"]
TERMS_SQL = "('worthless', 'license', 'thing', 'onand')"  # as they are stemmed
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
STEM_SQL = "regexp_replace(regexp_replace(regexp_replace({}, '^([a-z]{{2,}})ies$', '\\1y'), '^([a-z]{{2,}}[^su])s$', '\\1'), '^([a-z]{{3,}})(?:ing|ed)$', '\\1')"

#: Postings of the query's terms, document frequencies and BM25 scores of live blocks.
BM25_SQL = f"""toks AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS token FROM blocks WHERE NOT is_deleted),
  kept AS (SELECT id, {STEM_SQL.format("token")} AS token FROM toks WHERE length(token) > 1 AND token NOT IN {STOP_SQL}),
  lens AS (SELECT id, COUNT(*) AS len FROM kept GROUP BY 1),
  tf AS (SELECT id, token, COUNT(*) AS tf FROM kept WHERE token IN {TERMS_SQL} GROUP BY 1, 2),
  df AS (SELECT token, COUNT(*) AS df FROM tf GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM blocks WHERE NOT is_deleted),
  bm AS (SELECT t.id, ROUND(SUM(t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.len / 80.0)) * ln((n.n - d.df + 0.5) / (d.df + 0.5) + 1)), 6) AS score
    FROM tf t JOIN lens l ON t.id = l.id JOIN df d ON t.token = d.token, n GROUP BY t.id)"""


def _bm25(spark, d, k):
    return fusion.bm25_search(live(blocks(spark, d)), [t for t in TERMS if t not in text.STOPWORDS], k)


@query("bm25_search", f"WITH {BLOCKS_SQL}, {BM25_SQL} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_search(spark, d):
    return _bm25(spark, d, 20)


@query("corpus_idf", f"""WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents),
  stems AS (SELECT DISTINCT doc_id, {STEM_SQL.format("token")} AS token FROM toks WHERE length(token) > 1 AND token NOT IN {STOP_SQL}),
  df AS (SELECT token, COUNT(*) AS df FROM stems GROUP BY 1)
  SELECT token, df, ROUND(ln(((SELECT COUNT(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 4) AS idf FROM df WHERE df >= 5""")
def corpus_idf(spark, d):
    docs = raw(spark, d, "documents")
    df = docs.select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df >= 5")
    total = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(total)).select("token", "df", F.round(fusion.idf(F.col("n"), F.col("df")), 4).alias("idf"))  # one row


COSINE_SQL = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query("dense_topk", f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT a.id AS query_id, b.id AS id, ROUND({COSINE_SQL}, 6) AS score FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id),
  r AS (SELECT query_id, id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
  SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def dense_topk(spark, d):
    """Every vector whose id is divisible by 100 against all others."""
    v = vectors(spark, d)
    return fusion.dense_topk(v, v.where("id % 100 = 0"), 10)


@query("rank_fusion", f"""WITH {BLOCKS_SQL}, {BM25_SQL}, a AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 30) x),
  b AS (SELECT id, ROW_NUMBER() OVER (ORDER BY age_days, id) - 1 AS rank FROM (SELECT id, age_days FROM blocks WHERE NOT is_deleted ORDER BY age_days, id LIMIT 30) x)
  SELECT id, ROUND(SUM(part), 6) AS score FROM (SELECT id, 1.15 / (60 + rank) AS part FROM a UNION ALL SELECT id, 1.0 / (60 + rank) AS part FROM b) x GROUP BY 1""")
def rank_fusion(spark, d):
    newest = live(blocks(spark, d)).select("id", "age_days").orderBy("age_days", "id").limit(30)
    lists = [(fusion.ranked(_bm25(spark, d, 30), F.desc("score"), F.col("id")), 1.15), (fusion.ranked(newest, F.col("age_days"), F.col("id")), 1.0)]
    return fusion.reciprocal_rank(lists).select("id", F.round("score", 6).alias("score"))


WEIBULL_SQL = " ".join(
    f"WHEN c >= {least} THEN (CASE WHEN age <= 0 THEN 1.0 WHEN acc > 0 THEN {f} + {1 - f} * exp(-pow(age / least({s} * (1 + ln(1 + acc * pow(2.0, -age / 30.0))), {10 * s}), {p})) ELSE {f} + {1 - f} * exp(-pow(age / {s}, {p})) END)"
    for least, (s, p, f) in zip((0.8, 0.5, 0.3, -1), scores.WEIBULL.values(), strict=True)
)


@query("scoring_factors", f"""WITH {BLOCKS_SQL}, x AS (SELECT id, CAST(age_days AS DOUBLE) AS age, confidence AS c, CAST(access_count AS DOUBLE) AS acc, length(content) AS len FROM blocks)
  SELECT id, ROUND(1 + 0.15 * exp(-age / 14.0), 6) AS recency, ROUND(1 / (1 + 0.3 * abs(log2(greatest(len, 1) / 500.0))), 6) AS length_norm, ROUND(CASE {WEIBULL_SQL} END, 6) AS decay FROM x""")
def scoring_factors(spark, d):
    b = blocks(spark, d)
    age = F.col("age_days").cast("double")
    return b.select("id", F.round(scores.recency(age), 6).alias("recency"), F.round(scores.length_norm(F.length("content")), 6).alias("length_norm"), F.round(scores.time_decay(age, F.col("confidence"), F.col("access_count")), 6).alias("decay"))


#: Rows of a result list that its last stage takes.
MOST_RESULTS = 3000


def greedy_dedup(rows, threshold: float = 0.85, factor: float = 0.5, least: float = 0.1):
    """(id, score) of a result list (id, score, vec) after pairwise dedup: in list order, a row that is like an earlier
    kept one loses half its score, once for each, and goes when it falls below the least. Order decides, so one task
    does it; the list is one that a limit has cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_RESULTS:
            raise ValueError(f"a result list of {len(pdf)} rows; cut it to {MOST_RESULTS} before")
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        x = np.stack(pdf["vec"].to_list()) if len(pdf) else np.zeros((0, 1))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        like = x @ x.T > threshold
        score, gone = pdf["score"].to_numpy().copy(), np.zeros(len(pdf), bool)
        for i in range(len(pdf)):
            if not gone[i]:
                later = np.flatnonzero(like[i]) if i + 1 < len(pdf) else []
                for j in (j for j in later if j > i and not gone[j]):
                    score[j] *= factor
                    gone[j] = score[j] < least
        return pd.DataFrame({"id": pdf["id"].to_numpy()[~gone], "score": score[~gone]})

    return rows.withColumn("_list", F.lit(0)).groupBy("_list").applyInPandas(run, "id long, score double")


@query("pairwise_dedup")
def pairwise_dedup(spark, d):
    v = vectors(spark, d)
    found = fusion.dense_topk(v, v.where("id = 0"), 50).join(v.select("id", "vec"), "id").select("id", "score", "vec")
    return greedy_dedup(found, 0.5, least=0.05)


@query("rerank_gate", f"WITH {BLOCKS_SQL}, {BM25_SQL}, t AS (SELECT score / (SELECT MAX(score) FROM bm) AS s, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS n FROM bm), g AS (SELECT COUNT(*) AS n, MAX(CASE WHEN n = 1 THEN s END) AS one, MAX(CASE WHEN n = 2 THEN s END) AS two, STDDEV_POP(s) AS sd, AVG(s) AS m FROM t WHERE n <= 5) SELECT NOT (n <= 2 OR (one >= 0.55 AND one - two >= 0.25) OR (sd <= 0.03 AND m >= 0.55)) AS rerank FROM g")
def rerank_gate(spark, d):
    top = fusion.ranked(_bm25(spark, d, 5), F.desc("score"), F.col("id"))
    top = top.withColumn("s", F.col("score") / F.max("score").over(Window.orderBy(F.lit(0))))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("s")))
    g = top.agg(F.count("*").alias("n"), at(0).alias("one"), at(1).alias("two"), F.stddev_pop("s").alias("sd"), F.avg("s").alias("m"))
    return g.select((~((F.col("n") <= 2) | ((F.col("one") >= 0.55) & (F.col("one") - F.col("two") >= 0.25)) | ((F.col("sd") <= 0.03) & (F.col("m") >= 0.55)))).alias("rerank"))


@query("fact_decay", "SELECT l_orderkey * 10 + l_linenumber AS id, ROUND(exp(-0.693 * date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-12-01') / 30.0), 6) AS weight FROM lineitem WHERE exp(-0.693 * date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-12-01') / 30.0) >= 0.05")
def fact_decay(spark, d):
    age = F.datediff(F.lit("2001-12-01").cast("date"), F.to_date("l_shipdate"))
    return raw(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.exp(-0.693 * age / 30.0).alias("w")).where("w >= 0.05").select("id", F.round("w", 6).alias("weight"))


@query("summary_staleness", f"WITH {BLOCKS_SQL} SELECT id, ROUND(1 - (0.2 + 0.8 * exp(-pow((age_days - 30) / 30.0, 1.2))), 3) AS staleness FROM blocks WHERE age_days > 30")
def summary_staleness(spark, d):
    return blocks(spark, d).where("age_days > 30").select("id", F.round(1 - scores.weibull((F.col("age_days") - 30).cast("double"), "warm"), 3).alias("staleness"))


@query("retrieval_verdict", """WITH q AS (SELECT user_id AS session, COUNT(DISTINCT event_type) AS layers, COUNT(*) AS total, AVG(value) / 100.0 AS quality FROM events GROUP BY 1)
  SELECT session, ROUND(0.3 * least(layers / 4.0, 1.0) + 0.3 * least(total / 10.0, 1.0) + 0.4 * least(quality, 1.0), 6) AS score,
    CASE WHEN 0.3 * least(layers / 4.0, 1.0) + 0.3 * least(total / 10.0, 1.0) + 0.4 * least(quality, 1.0) >= 0.7 THEN 'correct' WHEN 0.3 * least(layers / 4.0, 1.0) + 0.3 * least(total / 10.0, 1.0) + 0.4 * least(quality, 1.0) >= 0.3 THEN 'ambiguous' ELSE 'incorrect' END AS verdict FROM q""")
def retrieval_verdict(spark, d):
    q = raw(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.countDistinct("event_type").alias("layers"), F.count("*").alias("total"), (F.avg("value") / 100.0).alias("quality"))
    one = F.lit(1.0)
    score = 0.3 * F.least(F.col("layers") / 4.0, one) + 0.3 * F.least(F.col("total") / 10.0, one) + 0.4 * F.least("quality", one)
    return q.withColumn("s", score).select("session", F.round("s", 6).alias("score"), F.when(F.col("s") >= 0.7, "correct").when(F.col("s") >= 0.3, "ambiguous").otherwise("incorrect").alias("verdict"))


@query("bm25_lite", f"""WITH {BLOCKS_SQL}, c AS (SELECT id, len(regexp_extract_all(lower(content), 'license')) AS a, len(regexp_extract_all(lower(content), 'worthless')) AS b FROM blocks)
  SELECT id, ROUND(least(1.0, (a * 2.5 / (a + 1.5) + b * 2.5 / (b + 1.5)) / 2 / 2.5), 6) AS score FROM c WHERE a + b > 0""")
def bm25_lite(spark, d):
    c = F.lower("content")
    n = {t: F.regexp_count(c, F.lit(t)) for t in ("license", "worthless")}
    part = lambda k: n[k] * 2.5 / (n[k] + 1.5)
    return blocks(spark, d).where((n["license"] + n["worthless"]) > 0).select("id", F.round(F.least(F.lit(1.0), (part("license") + part("worthless")) / 2 / 2.5), 6).alias("score"))
