"""Search as it is served: fused lists, all scoring stages, cascades over layers, verdicts, cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import routing as rules
from recallgrid.functions import scores, text
from recallgrid.operators import fusion, graph
from recallgrid.operators import tables as ops
from recallgrid.plans.registry import query
from recallgrid.plans.retrieval import BM25_SQL, TERMS, WEIBULL_SQL, greedy_dedup
from recallgrid.plans.routing import INTENTS_SQL, NOISE_SQL, routed
from recallgrid.schema import live, valid
from recallgrid.sources.tables import BLOCKS_SQL, COMMUNITIES_SQL, ENTITIES_SQL, FEEDBACK_SQL, JOURNAL_SQL, TRIPLES_SQL, blocks, communities, entities, feedback, journal, triples, vectors

COSINE_SQL = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
#: The nearest vectors to that of a query, here the vector of id 0.
DENSE_SQL = f"""e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  near AS (SELECT b.id, ROUND({COSINE_SQL}, 6) AS score FROM e a, e b WHERE a.id = 0)"""


def _wanted():
    return [t for t in TERMS if t not in text.STOPWORDS]


def sparse(spark, d, k: int) -> DataFrame:
    return fusion.bm25_search(live(blocks(spark, d)), _wanted(), k)


def near(spark, d) -> DataFrame:
    """(id, score) of every vector by its likeness to the query's."""
    v = vectors(spark, d)
    q = F.broadcast(v.where("id = 0").select(F.col("vec").alias("q")).limit(1))  # one row
    return v.crossJoin(q).select("id", F.round(scores.cosine(F.col("vec"), F.col("q")), 6).alias("score"))


def dense(spark, d, k: int) -> DataFrame:
    return near(spark, d).orderBy(F.desc("score"), "id").limit(k)


def hybrid(spark, d, k: int = 20, least: float = 0.0) -> DataFrame:
    """(id, score): the k best of both lists, three times as long each, fused by reciprocal rank."""
    lists = [(fusion.ranked(found, F.desc("score"), F.col("id")), 1.0) for found in (sparse(spark, d, 3 * k), dense(spark, d, 3 * k))]
    return fusion.reciprocal_rank(lists).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def _lists_sql(k: int) -> str:
    return f"""sl AS (SELECT id, score, ROW_NUMBER() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {k}) x),
  dl AS (SELECT id, score, ROW_NUMBER() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT id, score FROM near ORDER BY score DESC, id LIMIT {k}) x)"""


HYBRID_SQL = f"{BM25_SQL}, {DENSE_SQL}, {_lists_sql(60)}, hy AS (SELECT id, SUM(1.0 / (60 + rank)) AS score FROM (SELECT id, rank FROM sl UNION ALL SELECT id, rank FROM dl) x GROUP BY 1)"


@query("hybrid_rrf", f"WITH {BLOCKS_SQL}, {HYBRID_SQL} SELECT id, ROUND(CAST(score AS DOUBLE), 6) AS score FROM hy ORDER BY hy.score DESC, id LIMIT 20")
def hybrid_rrf(spark, d):
    """Sparse and dense search fused by reciprocal rank."""
    return hybrid(spark, d).select("id", F.round("score", 6).alias("score"))


@query("keyword_boosted_fusion", f"""WITH {BLOCKS_SQL}, {BM25_SQL}, {DENSE_SQL}, {_lists_sql(30)}, f AS (SELECT id, SUM(part) AS fused, MAX(score) AS score FROM (SELECT id, score, 1.15 / (60 + rank) AS part FROM sl UNION ALL SELECT id, score, 1.0 / (60 + rank) AS part FROM dl) x GROUP BY 1)
  SELECT id, score FROM f ORDER BY fused DESC, id LIMIT 20""")
def keyword_boosted_fusion(spark, d):
    """Both lists, keywords counting 1.15 times: in the order of the fused score, with the greater of a row's own scores."""
    parts = []
    for found, weight in ((sparse(spark, d, 30), 1.15), (dense(spark, d, 30), 1.0)):
        parts.append(fusion.ranked(found, F.desc("score"), F.col("id")).select("id", "score", (F.lit(weight) / (60 + F.col("rank"))).alias("part")))
    fused = parts[0].unionByName(parts[1]).groupBy("id").agg(F.sum("part").alias("fused"), F.max("score").alias("score"))
    return fused.orderBy(F.desc("fused"), "id").limit(20).select("id", "score")


@query("indexed_search", f"WITH {BLOCKS_SQL}, {BM25_SQL} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def indexed_search(spark, d):
    """bm25_search over postings that were written once, by buckets of tokens: a query reads its tokens' buckets only."""
    index = fusion.Index.of(spark, d, live(blocks(spark, d)))
    return index.search(_wanted(), 20)


@query("sparse_dot", f"WITH {BLOCKS_SQL}, {BM25_SQL}, q AS (SELECT token, ln((n.n - d.df + 0.5) / (d.df + 0.5) + 1) AS w FROM df d, n) SELECT t.id, ROUND(SUM(q.w * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.len / 80.0)) * q.w), 6) AS score FROM tf t JOIN lens l ON t.id = l.id JOIN q ON t.token = q.token GROUP BY 1")
def sparse_dot(spark, d):
    """The inner product of a query's sparse vector with those of all blocks, over the tokens they share."""
    index = fusion.Index.of(spark, d, live(blocks(spark, d)))
    p = index.read(_wanted())
    df = p.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(index.size()))
    w = fusion.idf(F.col("n"), F.col("df"))
    weighed = p.join(F.broadcast(df), "token")  # a row for each token of the query
    return weighed.groupBy("id").agg(F.round(F.sum(w * scores.bm25(F.col("tf"), F.col("length"), 80.0, w)), 6).alias("score"))


@query("keyword_search", f"WITH {BLOCKS_SQL}, {BM25_SQL}, c AS (SELECT id, COUNT(DISTINCT token) AS held FROM tf GROUP BY 1) SELECT bm.id, bm.score FROM bm JOIN c ON bm.id = c.id WHERE c.held >= 2 ORDER BY score DESC, bm.id LIMIT 20")
def keyword_search(spark, d):
    """Blocks that hold two of the query's words or more, best first."""
    rows = live(blocks(spark, d))
    held = rows.select("id", F.size(F.array_intersect(text.tokens(F.col("content")), F.array(*map(F.lit, _wanted())))).alias("held")).where("held >= 2")
    return fusion.bm25_search(rows, _wanted(), 1_000_000).join(held.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(20)


@query("search_with_fallback", f"WITH {BLOCKS_SQL} SELECT id, 0.5 AS score FROM blocks WHERE contains(lower(content), 'ntheb') AND NOT is_deleted ORDER BY id LIMIT 10")
def search_with_fallback(spark, d):
    """Search by tokens; where it finds nothing, as for a part of a word, literal search."""
    rows = live(blocks(spark, d))
    found = fusion.bm25_search(rows, ["ntheb"], 10)
    if found.limit(1).count():
        return found
    return rows.where(text.contains_any(F.col("content"), ["ntheb"])).select("id", F.lit(0.5).alias("score")).orderBy("id").limit(10)


@query("temporal_fallback", f"WITH {JOURNAL_SQL} SELECT id, 1.0 AS score FROM journal WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00' ORDER BY ts DESC, id LIMIT 20")
def temporal_fallback(spark, d):
    """A query that names a date and finds nothing: the rows of the date, each of score 1."""
    day = journal(spark, d).where("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-11 00:00:00'")
    return day.orderBy(F.desc("ts"), "id").limit(20).select("id", F.lit(1.0).alias("score"))


# ------------------------------------------------------------------ tiers
def tiered_score(content, tier, terms: list[str], mean_length: float = 100.0):
    """A text's score by the parts of a query's terms in it, less in colder tiers; a base score without terms."""
    share = F.when(tier == "warm", 0.7).when(tier == "cold", 0.6).otherwise(1.0)
    if not terms:
        return 0.5 * share
    found = F.regexp_extract_all(F.lower(content), F.lit("([a-z0-9_]+)"), F.lit(1))
    n = F.size(found)
    parts = []
    for t in terms:
        tf = F.size(F.filter(found, F.lit(t).__eq__))
        parts.append(F.when(tf > 0, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean_length))).otherwise(0.0))
    total = reduce(lambda a, b: a + b, parts) / len(terms) / 2.5
    return F.when(n > 0, F.least(total, F.lit(1.0))).otherwise(0.0) * share


TIER_SQL = "CASE WHEN age_days <= 14 THEN 'hot' WHEN age_days <= 180 THEN 'warm' ELSE 'cold' END"


def _tiered_sql(terms: list[str]) -> str:
    parts = " + ".join(f"CASE WHEN len(list_filter(w, lambda x: x = '{t}')) > 0 THEN len(list_filter(w, lambda x: x = '{t}')) * 2.5 / (len(list_filter(w, lambda x: x = '{t}')) + 1.5 * (0.25 + 0.75 * len(w) / 100.0)) ELSE 0.0 END" for t in terms)
    return f"least(({parts}) / {len(terms)} / 2.5, 1.0) * (CASE tier WHEN 'warm' THEN 0.7 WHEN 'cold' THEN 0.6 ELSE 1.0 END)"


@query("tiered_text_score", f"WITH {BLOCKS_SQL}, x AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w, {TIER_SQL} AS tier FROM blocks WHERE NOT is_deleted) SELECT id, tier, ROUND(CAST({_tiered_sql(['license', 'the'])} AS DOUBLE), 6) AS score FROM x WHERE len(w) > 0")
def tiered_text_score(spark, d):
    b = live(blocks(spark, d)).where(F.regexp_count(F.lower("content"), F.lit("[a-z0-9_]+")) > 0)
    tier = F.when(F.col("age_days") <= 14, "hot").when(F.col("age_days") <= 180, "warm").otherwise("cold")
    return b.select("id", tier.alias("tier"), F.round(tiered_score(F.col("content"), tier, ["license", "the"]), 6).alias("score"))


@query("tiered_text_search", f"WITH {BLOCKS_SQL}, x AS (SELECT id, {TIER_SQL} AS tier, age_days FROM blocks WHERE NOT is_deleted AND contains(lower(content), 'the')), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, age_days, id) AS n FROM x) SELECT id, tier FROM r WHERE n <= 25")
def tiered_text_search(spark, d):
    """Hot blocks first, then warm, then cold, the newest of each first, until there are enough."""
    tier = F.when(F.col("age_days") <= 14, 0).when(F.col("age_days") <= 180, 1).otherwise(2)
    found = live(blocks(spark, d)).where(text.contains_all(F.col("content"), ["the"])).select("id", tier.alias("t"), "age_days")
    parts = [found.where(F.col("t") == k).orderBy("age_days", "id").limit(25) for k in range(3)]
    top = reduce(DataFrame.unionByName, parts).orderBy("t", "age_days", "id").limit(25)
    return top.select("id", F.element_at(F.array(*map(F.lit, ("hot", "warm", "cold"))), F.col("t") + 1).alias("tier"))


# ------------------------------------------------------------------ scoring stages
def entity_ppr(spark, d, rounds: int = 2) -> DataFrame:
    """(id, ppr) of entities by a walk from those of session 1, over facts of every fiftieth session."""
    t = valid(triples(spark, d)).where("session % 50 = 1")
    e = graph.undirected(t)
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    seeds = t.where("session = 1").select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return graph.pagerank(e, nodes, rounds, seeds=seeds).select("id", F.col("rank").alias("ppr"))


#: The same walk of two rounds, unrolled. Every vertex has an edge, so nothing is stuck.
PPR_SQL = """pt AS (SELECT * FROM triples WHERE NOT is_deleted AND NOT is_invalid AND session % 50 = 1),
  pe AS (SELECT least(subject, object) AS a, greatest(subject, object) AS b, COUNT(*) AS w FROM pt WHERE subject <> object GROUP BY 1, 2),
  pa AS (SELECT a AS src, b AS dst, w FROM pe UNION ALL SELECT b, a, w FROM pe), po AS (SELECT src, SUM(w) AS total FROM pa GROUP BY 1),
  ps AS (SELECT DISTINCT id FROM (SELECT subject AS id FROM pt WHERE session = 1 UNION ALL SELECT object FROM pt WHERE session = 1) x),
  p0 AS (SELECT o.src AS id, CASE WHEN s.id IS NULL THEN 0.0 ELSE 1.0 / (SELECT COUNT(*) FROM ps JOIN po ON ps.id = po.src) END AS r FROM po o LEFT JOIN ps s ON o.src = s.id),
  p1 AS (SELECT p0.id, p0.r AS restart, 0.15 * p0.r + 0.85 * COALESCE(f.v, 0.0) AS r FROM p0 LEFT JOIN (SELECT a.dst, SUM(q.r * a.w / o.total) AS v FROM pa a JOIN p0 q ON a.src = q.id JOIN po o ON a.src = o.src GROUP BY 1) f ON p0.id = f.dst),
  ppr AS (SELECT p1.id, 0.15 * p1.restart + 0.85 * COALESCE(f.v, 0.0) AS ppr FROM p1 LEFT JOIN (SELECT a.dst, SUM(q.r * a.w / o.total) AS v FROM pa a JOIN p1 q ON a.src = q.id JOIN po o ON a.src = o.src GROUP BY 1) f ON p1.id = f.dst)"""


@query("entity_ppr", f"WITH {TRIPLES_SQL}, {PPR_SQL} SELECT id, ROUND(CAST(ppr AS DOUBLE), 6) AS ppr FROM ppr WHERE ppr > 0.000001")
def entity_ppr_query(spark, d):
    return entity_ppr(spark, d).where("ppr > 0.000001").select("id", F.round("ppr", 6).alias("ppr"))


#: The entities that a block mentions: by its id, three of them.
MENTIONS_SQL = "mentions AS (SELECT id, unnest([id % 97, id % 1009, id % 89]) AS entity FROM blocks)"


def mentions(spark, d) -> DataFrame:
    return blocks(spark, d).select("id", F.explode(F.array(*[F.col("id") % k for k in (97, 1009, 89)])).alias("entity"))


def with_ppr(rows: DataFrame, spark, d) -> DataFrame:
    """rows with the greatest rank of the entities that each mentions."""
    best = mentions(spark, d).join(entity_ppr(spark, d).withColumnRenamed("id", "entity"), "entity").groupBy("id").agg(F.max("ppr").alias("ppr"))
    return rows.join(best, "id", "left").fillna(0.0, ["ppr"])


PPR_OF_SQL = "pm AS (SELECT m.id, MAX(p.ppr) AS ppr FROM mentions m JOIN ppr p ON m.entity = p.id GROUP BY 1)"


@query("ppr_boost", f"WITH {BLOCKS_SQL}, {TRIPLES_SQL}, {PPR_SQL}, {MENTIONS_SQL}, {PPR_OF_SQL} SELECT b.id, ROUND(CAST(1 + 0.3 * COALESCE(p.ppr, 0.0) AS DOUBLE), 6) AS factor FROM blocks b LEFT JOIN pm p ON b.id = p.id")
def ppr_boost(spark, d):
    """The seventh stage: more for blocks that mention what the walk reaches."""
    return with_ppr(blocks(spark, d).select("id"), spark, d).select("id", F.round(scores.ppr_boost(F.col("ppr")), 6).alias("factor"))


@query("semantic_boost", f"WITH {DENSE_SQL} SELECT id, ROUND(1 + 0.3 * greatest(0.0, score), 8) AS factor FROM near")
def semantic_boost(spark, d):
    """The eighth stage: more for blocks whose vector is like the query's."""
    return near(spark, d).select("id", F.round(scores.semantic_boost(F.col("score"), 0.3), 8).alias("factor"))


def staged(rows: DataFrame, intent: str = "unknown") -> DataFrame:
    """rows (id, score, age_days, confidence, session, net, n_chars, access_count, ppr, likeness, content) after the first ten
    stages in their order, weighed by the intent."""
    recent, meaning, trust, feedback_ = scores.INTENT_WEIGHTS.get(intent, scores.DEFAULT_WEIGHTS)
    known = F.when(F.col("session").isNotNull(), 0.8).otherwise(0.5)
    age = F.col("age_days").cast("double")
    stages = {
        "recency": scores.recency(age, recent),
        "importance": scores.importance(F.col("confidence")),
        "trust_boost": scores.trust_boost(known, trust),
        "feedback_boost": scores.feedback_boost(F.col("net"), feedback_),
        "length_norm": scores.length_norm(F.col("n_chars")),
        "time_decay": scores.time_decay(age, F.col("confidence"), F.col("access_count")),
        "ppr_boost": scores.ppr_boost(F.col("ppr")),
        "semantic_boost": scores.semantic_boost(F.col("likeness"), meaning),
    }
    assert tuple(stages) == scores.STAGES[:8]
    for factor in stages.values():
        rows = rows.withColumn("score", F.col("score") * factor)
    # the list is short by now; saved, so that the rules on noise aren't pushed down to the whole table
    return graph.saved(rows.where("score >= 0.1")).where(text.noise_reason(F.col("content")).isNull())


def candidates(spark, d, found: DataFrame | None = None) -> DataFrame:
    """Found rows (id, score), or else the 200 best of keyword search, with all that the stages ask for."""
    net = feedback(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.sum(F.when(F.col("signal") == "positive", 1).otherwise(-1)).alias("net"))
    about = live(blocks(spark, d)).select("id", "session", "confidence", "access_count", "age_days", "content", F.length("content").alias("n_chars"))
    found = sparse(spark, d, 200) if found is None else found
    rows = found.join(about, "id").join(net, "id", "left").join(near(spark, d).select("id", F.col("score").alias("likeness")), "id", "left")
    return with_ppr(rows, spark, d).fillna(0, ["net"]).fillna(0.0, ["likeness"])


def _staged_sql(intent: str, top: str = "SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 200") -> str:
    r, m, t, f = scores.INTENT_WEIGHTS.get(intent, scores.DEFAULT_WEIGHTS)
    return f"""net AS (SELECT entity_id, SUM(CASE WHEN signal = 'positive' THEN 1 ELSE -1 END) AS net FROM feedback GROUP BY 1), top AS ({top}),
  x AS (SELECT t.id, t.score, CAST(b.age_days AS DOUBLE) AS age, b.confidence AS c, CAST(b.access_count AS DOUBLE) AS acc, CAST(COALESCE(n.net, 0) AS DOUBLE) AS net, length(b.content) AS len, trim(b.content) AS t,
    COALESCE(CAST(p.ppr AS DOUBLE), 0.0) AS ppr, COALESCE(e.score, 0.0) AS likeness FROM top t JOIN blocks b ON t.id = b.id AND NOT b.is_deleted LEFT JOIN net n ON t.id = n.entity_id LEFT JOIN pm p ON t.id = p.id LEFT JOIN near e ON t.id = e.id),
  y AS (SELECT id, t, score * (1 + {r} * exp(-age / 14.0)) * (0.7 + 0.3 * (CASE WHEN c = 0 THEN 0.5 ELSE c END)) * (1 - {t} * (1 - 0.8)) * (1 + {f} * tanh(net / 3)) / (1 + 0.3 * abs(log2(greatest(len, 1) / 500.0)))
    * (CASE {WEIBULL_SQL} END) * (1 + 0.3 * ppr) * (1 + {m} * greatest(0.0, likeness)) AS score FROM x),
  z AS (SELECT id, score FROM y WHERE score >= 0.1 AND ({NOISE_SQL}) IS NULL)"""


@query("intent_scored_search", f"WITH {BLOCKS_SQL}, {TRIPLES_SQL}, {FEEDBACK_SQL}, {BM25_SQL}, {DENSE_SQL}, {PPR_SQL}, {MENTIONS_SQL}, {PPR_OF_SQL}, {_staged_sql('factual')} SELECT id, ROUND(score, 4) AS score FROM z ORDER BY score DESC, id LIMIT 20")
def intent_scored_search(spark, d):
    """Ten of the stages, weighed for a factual query; full_search adds the last one."""
    return staged(candidates(spark, d), "factual").orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 4).alias("score"))


@query("hybrid_search_scored", f"WITH {BLOCKS_SQL}, {TRIPLES_SQL}, {FEEDBACK_SQL}, {HYBRID_SQL}, {PPR_SQL}, {MENTIONS_SQL}, {PPR_OF_SQL}, {_staged_sql('conceptual', 'SELECT id, score / (SELECT MAX(score) FROM hy) AS score FROM hy ORDER BY hy.score DESC, id LIMIT 100')} SELECT id, ROUND(CAST(score AS DOUBLE), 4) AS score FROM z ORDER BY z.score DESC, id LIMIT 10")
def hybrid_search_scored(spark, d):
    """Search as it is served: keyword and vector lists fused, the fused score over the best one, then ten of the stages."""
    return staged(candidates(spark, d, _fused(spark, d)), "conceptual").orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 4).alias("score"))


def _fused(spark, d) -> DataFrame:
    lists = [(fusion.ranked(found, F.desc("score"), F.col("id")), 1.0) for found in (sparse(spark, d, 60), dense(spark, d, 60))]
    fused = fusion.reciprocal_rank(lists).orderBy(F.desc("score"), "id").limit(100)
    return fused.crossJoin(F.broadcast(fused.agg(F.max("score").alias("best")))).select("id", (F.col("score") / F.col("best")).alias("score"))  # one row


@query("full_search")
def full_search(spark, d):
    """All eleven stages. The last depends on the list's order, so one task takes the 60 rows that are left to it."""
    top = staged(candidates(spark, d), "exploratory").orderBy(F.desc("score"), "id").limit(60).select("id", "score")
    rows = top.join(vectors(spark, d).select("id", "vec"), "id", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), 64)))
    return greedy_dedup(rows).orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 4).alias("score"))


# Weights of a row's own score and of the reranker's, by intent.
RERANK = {"entity_lookup": (0.2, 0.8), "conceptual": (0.4, 0.6), "factual": (0.2, 0.8), "exploratory": (0.5, 0.5), "cross_domain": (0.35, 0.65), "unknown": (0.3, 0.7)}


@query("rerank_blend", f"WITH {BLOCKS_SQL}, {BM25_SQL}, {DENSE_SQL}, t AS (SELECT id, score, score / (SELECT MAX(score) FROM bm) AS s FROM bm ORDER BY score DESC, id LIMIT 20) SELECT t.id, i.intent, ROUND(CAST(i.own * t.s + i.other * (COALESCE(n.score, 0.0) + 1) / 2 AS DOUBLE), 6) AS score FROM t LEFT JOIN near n ON t.id = n.id, (VALUES {', '.join(f'''('{k}', {a}, {b})''' for k, (a, b) in RERANK.items())}) i(intent, own, other)")
def rerank_blend(spark, d):
    """The twenty best, their own score blended with a cross-encoder's, for which a caller's model stands; here the likeness
    to the query's vector does."""
    top = sparse(spark, d, 20)
    best = top.agg(F.max("score").alias("best"))
    rows = top.crossJoin(F.broadcast(best)).join(near(spark, d).select("id", F.col("score").alias("ce")), "id", "left").withColumn("s", F.col("score") / F.col("best")).fillna(0.0, ["ce"])  # one row
    return reduce(DataFrame.unionByName, [rows.select("id", F.lit(k).alias("intent"), F.round(a * F.col("s") + b * (F.col("ce") + 1) / 2, 6).alias("score")) for k, (a, b) in RERANK.items()])


@query("semantic_intents", f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT b.id AS query_id, a.id % 5 AS intent, MAX({COSINE_SQL}) AS tier2 FROM e a, e b WHERE a.id < 40 AND b.id % 100 = 0 GROUP BY 1, 2)
  SELECT query_id, ['{"', '".join(rules.INTENTS)}'][CAST(intent + 1 AS INTEGER)] AS intent, ROUND(0.4 * ((query_id + intent) % 4) / 4.0 + 0.6 * tier2, 6) AS score FROM s""")
def semantic_intents(spark, d):
    """The second tier of routing: the greatest likeness of a query's vector to the archetypes of each intent (here 40 vectors,
    eight for each), six tenths of the score beside four of the first tier's."""
    v = vectors(spark, d)
    archetypes = F.broadcast(v.where("id < 40").select(F.col("vec").alias("a"), (F.col("id") % 5).alias("k")))
    met = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec").crossJoin(archetypes)  # 40 rows
    best = met.groupBy("query_id", "k").agg(F.max(scores.cosine(F.col("vec"), F.col("a"))).alias("tier2"))
    names = F.array(*map(F.lit, rules.INTENTS))
    return best.select("query_id", F.element_at(names, (F.col("k") + 1).cast("int")).alias("intent"), F.round(0.4 * ((F.col("query_id") + F.col("k")) % 4) / 4.0 + 0.6 * F.col("tier2"), 6).alias("score"))


# ------------------------------------------------------------------ cascade
#: Queries of a cascade: a term, and the intent that routes it.
ASKED = ((1, "license", "unknown"), (2, "brand#1", "conceptual"), (3, "bolt", "entity_lookup"), (4, "worthless", "factual"), (5, "ring", "cross_domain"), (6, "copyright", "exploratory"), (7, "brand#2", "factual"), (8, "gizmo", "conceptual"))
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{n}')" for i, t, n in ASKED) + ") v(query_id, term, intent))"
#: Layers that a mode of retrieval allows.
ALLOWED = {"local": ("triples", "blocks"), "global": ("summaries", "communities"), "hybrid": ("summaries", "communities", "triples", "blocks")}
TOP = 5


def layers_of(intent: str) -> list[str]:
    return [x for x in ("summaries", "communities", "triples", "blocks") if x in ALLOWED[rules.MODES[intent]] and rules.LAYERS[intent][x] != "SKIP"]


def layer_rows(spark, d) -> DataFrame:
    """(layer, key, content): what each layer holds to be searched."""
    c, e = communities(spark, d), entities(spark, d)
    facts = valid(triples(spark, d)).groupBy("object").agg(F.min("id").alias("id")).join(e.select(F.col("id").alias("object"), "name"), "object")
    return reduce(DataFrame.unionByName, [
        c.where("level = 0").select(F.lit("summaries").alias("layer"), F.col("id").alias("key"), F.concat(F.lit("of brand#"), F.substring("name", 7, 9)).alias("content")),
        c.where("level = 1").select(F.lit("communities").alias("layer"), F.col("id").alias("key"), F.lower("name").alias("content")),
        facts.select(F.lit("triples").alias("layer"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), F.lower("name").alias("content")),
        live(blocks(spark, d)).select(F.lit("blocks").alias("layer"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), F.lower("content").alias("content")),
    ])


def cascade(spark, d) -> DataFrame:
    """(query_id, layer, key): five of each layer that a query's intent searches; one that finds nothing at all searches
    every layer."""
    asked = F.broadcast(spark.createDataFrame(list(ASKED), "query_id int, term string, intent string"))
    plan = spark.createDataFrame([(i, x, x in layers_of(i)) for i in rules.LAYERS for x in ALLOWED["hybrid"]], "intent string, layer string, routed boolean")
    hits = layer_rows(spark, d).join(asked, F.expr("contains(content, term)")).join(F.broadcast(plan), ["intent", "layer"])
    top = ops.first_by(hits.select("query_id", "layer", "key", "routed"), ["query_id", "layer"], [F.col("key")], TOP)
    any_ = top.groupBy("query_id").agg(F.max("routed").alias("any"))
    return top.join(any_, "query_id").where("routed or not any").select("query_id", "layer", "key")


LAYER_SQL = """facts AS (SELECT object, MIN(id) AS id FROM triples WHERE NOT is_deleted AND NOT is_invalid GROUP BY 1),
  rows_ AS (SELECT 'summaries' AS layer, id AS key, 'of brand#' || substr(name, 7, 9) AS content FROM communities WHERE level = 0 UNION ALL SELECT 'communities', id, lower(name) FROM communities WHERE level = 1
    UNION ALL SELECT 'triples', lpad(CAST(f.id AS VARCHAR), 20, '0'), lower(e.name) FROM facts f JOIN entities e ON f.object = e.id UNION ALL SELECT 'blocks', lpad(CAST(id AS VARCHAR), 20, '0'), lower(content) FROM blocks WHERE NOT is_deleted)"""
CASCADE_SQL = f"""{BLOCKS_SQL}, {TRIPLES_SQL}, {ENTITIES_SQL}, {COMMUNITIES_SQL}, {LAYER_SQL}, {ASKED_SQL}, plan AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{x}', {'TRUE' if x in layers_of(i) else 'FALSE'})" for i in rules.LAYERS for x in ALLOWED['hybrid'])}) v(intent, layer, routed)),
  hits AS (SELECT a.query_id, r.layer, r.key, p.routed, ROW_NUMBER() OVER (PARTITION BY a.query_id, r.layer ORDER BY r.key) AS n FROM rows_ r JOIN asked a ON contains(r.content, a.term) JOIN plan p ON p.intent = a.intent AND p.layer = r.layer),
  best AS (SELECT * FROM hits WHERE n <= {TOP}), found AS (SELECT query_id, bool_or(routed) AS any_ FROM best GROUP BY 1), cascade AS (SELECT b.query_id, b.layer, b.key FROM best b JOIN found f ON b.query_id = f.query_id WHERE b.routed OR NOT f.any_)"""


@query("cascade_recall", f"WITH {CASCADE_SQL} SELECT query_id, layer, key FROM cascade")
def cascade_recall(spark, d):
    return cascade(spark, d)


# By intent, what coverage and density, and rules and the reranker, weigh in a verdict.
CRAG = {"entity_lookup": (0.3, 0.7, 0.2, 0.8), "conceptual": (0.45, 0.55, 0.35, 0.65), "factual": (0.3, 0.7, 0.2, 0.8), "exploratory": (0.6, 0.4, 0.4, 0.6), "cross_domain": (0.5, 0.5, 0.3, 0.7), "unknown": (0.4, 0.6, 0.3, 0.7)}


@query("cascade_verdict", f"""WITH {CASCADE_SQL}, w AS (SELECT * FROM (VALUES {', '.join(f"('{i}', {', '.join(map(str, v))})" for i, v in CRAG.items())}) v(intent, cw, dw, rw, xw)),
  g AS (SELECT c.query_id, COUNT(DISTINCT layer) AS layers, COUNT(*) AS total, AVG((length(key) % 10) / 10.0 + (c.query_id % 3) / 10.0) AS mean, MAX((length(key) % 10) / 10.0 + (c.query_id % 3) / 10.0) AS top FROM cascade c GROUP BY 1),
  s AS (SELECT g.query_id, a.intent, ROUND(CAST(least(layers / 4.0, 1.0) * cw + least(total / 10.0, 1.0) * dw AS DOUBLE), 3) AS rules, mean, top, rw, xw FROM g JOIN asked a ON g.query_id = a.query_id JOIN w ON w.intent = a.intent)
  SELECT query_id, rules, ROUND(CAST(rules * rw + mean * xw AS DOUBLE), 6) AS confidence, CASE WHEN mean >= 0.6 AND top >= 0.7 THEN 'correct' WHEN mean < 0.3 THEN 'incorrect' ELSE 'ambiguous' END AS verdict, CASE WHEN rules >= 0.6 THEN 'correct' WHEN rules < 0.3 THEN 'incorrect' ELSE 'ambiguous' END AS verdict_by_rules FROM s""")
def cascade_verdict(spark, d):
    """The verdict on each cascade: layers and hits by rule, and a reranker's mean and best score, for which the length of a
    hit's key stands here; without a reranker the rules alone decide."""
    asked = spark.createDataFrame(list(ASKED), "query_id int, term string, intent string")
    weights = spark.createDataFrame([(i, *v) for i, v in CRAG.items()], "intent string, cw double, dw double, rw double, xw double")
    other = (F.length("key") % 10) / 10.0 + (F.col("query_id") % 3) / 10.0
    g = cascade(spark, d).groupBy("query_id").agg(F.countDistinct("layer").alias("layers"), F.count("*").alias("total"), F.avg(other).alias("mean"), F.max(other).alias("top"))
    s = g.join(F.broadcast(asked), "query_id").join(F.broadcast(weights), "intent")
    one = F.lit(1.0)
    s = s.withColumn("rules", F.round(F.least(F.col("layers") / 4.0, one) * F.col("cw") + F.least(F.col("total") / 10.0, one) * F.col("dw"), 3))
    both = F.when((F.col("mean") >= 0.6) & (F.col("top") >= 0.7), "correct").when(F.col("mean") < 0.3, "incorrect").otherwise("ambiguous")
    alone = F.when(F.col("rules") >= 0.6, "correct").when(F.col("rules") < 0.3, "incorrect").otherwise("ambiguous")
    return s.select("query_id", "rules", F.round(F.col("rules") * F.col("rw") + F.col("mean") * F.col("xw"), 6).alias("confidence"), both.alias("verdict"), alone.alias("verdict_by_rules"))


@query("recall_dedup", f"""WITH {COMMUNITIES_SQL}, {ENTITIES_SQL}, c AS (SELECT * FROM communities WHERE size % 4 <> 1), summed AS (SELECT id FROM c WHERE level = 1 AND size % 5 = 0),
  rest AS (SELECT c.* FROM c LEFT JOIN summed s ON c.id = s.id WHERE s.id IS NULL), kids AS (SELECT r.parent, COUNT(*) AS n FROM rest r JOIN rest p ON r.parent = p.id GROUP BY 1)
  SELECT r.id FROM rest r LEFT JOIN kids own ON r.id = own.parent LEFT JOIN kids up ON r.parent = up.parent WHERE COALESCE(own.n, 3) >= 3 AND COALESCE(up.n, 0) < 3""")
def recall_dedup(spark, d):
    """Communities that a recall still shows: not those with a summary of their own; of a parent with fewer than three
    children here the children, else the parent."""
    c = communities(spark, d).where("size % 4 <> 1")
    rest = c.join(c.where("level = 1 and size % 5 = 0").select("id"), "id", "left_anti")
    kids = rest.join(rest.select(F.col("id").alias("p")), F.col("parent") == F.col("p"), "left_semi").groupBy("parent").agg(F.count("*").alias("n"))
    rest = rest.join(kids.select(F.col("parent").alias("id"), F.col("n").alias("own")), "id", "left").join(kids.select("parent", F.col("n").alias("up")), "parent", "left")
    return rest.where("coalesce(own, 3) >= 3 and coalesce(up, 0) < 3").select("id")


@query("covered_triples", f"""WITH {ENTITIES_SQL}, t AS (SELECT id, lower(entity_type || ' uses ' || name || ' today') AS s FROM entities), r AS (SELECT DISTINCT list_distinct(string_split(s, ' ')) AS w FROM t WHERE id % 10 = 0 AND id < 100),
  k AS (SELECT DISTINCT s FROM t), m AS (SELECT s, list_distinct(string_split(s, ' ')) AS w FROM k), c AS (SELECT DISTINCT m.s FROM m, r WHERE len(list_intersect(m.w, r.w)) / len(list_distinct(list_concat(m.w, r.w))) >= 0.7)
  SELECT t.id FROM t LEFT JOIN c ON t.s = c.s WHERE c.s IS NULL""")
def covered_triples(spark, d):
    """Facts that no summary's representative fact says nearly word for word. Equal texts are compared once; representatives
    are ten at most."""
    e = entities(spark, d).select("id", F.lower(F.concat("entity_type", F.lit(" uses "), "name", F.lit(" today"))).alias("s"))
    reps = F.broadcast(e.where("id % 10 = 0 and id < 100").select(F.array_distinct(F.split("s", " ")).alias("r")).distinct())
    said = e.select("s").distinct().withColumn("w", F.array_distinct(F.split("s", " ")))
    covered = said.join(reps, text.jaccard(F.col("w"), F.col("r")) >= 0.7).select("s").distinct()
    return e.join(covered, "s", "left_anti").select("id")


@query("memory_cards", f"""WITH {BLOCKS_SQL}, x AS (SELECT id, trim(replace(content, chr(10), ' ')) AS s, age_days, confidence AS c, block_type FROM blocks WHERE NOT is_deleted AND age_days <= 60)
  SELECT id, CASE WHEN length(s) <= 180 THEN s ELSE rtrim(substr(s, 1, 179)) || '…' END AS summary, CASE WHEN age_days * 24 < 12 THEN '今天' WHEN age_days * 24 < 48 THEN '近兩天' WHEN age_days < 14 THEN '近兩週' WHEN age_days < 60 THEN '近兩月' ELSE '較早' END AS freshness,
  ROUND(CASE WHEN block_type = 'knowledge' THEN 0.72 WHEN block_type = 'skill' THEN 0.68 WHEN c = 0 THEN 0.55 ELSE c END, 3) AS confidence FROM x""")
def memory_cards(spark, d):
    """Cards of recent blocks: their text cut to 180 characters, how fresh they are, and a confidence by what they come from."""
    s, age, c = F.trim(F.replace("content", F.lit("\n"), F.lit(" "))), F.col("age_days"), F.col("confidence")
    fresh = F.when(age * 24 < 12, "今天").when(age * 24 < 48, "近兩天").when(age < 14, "近兩週").when(age < 60, "近兩月").otherwise("較早")
    confidence = F.when(F.col("block_type") == "knowledge", 0.72).when(F.col("block_type") == "skill", 0.68).when(c == 0, 0.55).otherwise(c)
    summary = F.when(F.length(s) <= 180, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, 179)), F.lit("…")))
    return live(blocks(spark, d)).where("age_days <= 60").select("id", summary.alias("summary"), fresh.alias("freshness"), F.round(confidence, 3).alias("confidence"))


@query("thinking_mode", f"WITH {INTENTS_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'slow' WHEN intent IN ('entity_lookup', 'factual') THEN 'fast' ELSE 'slow' END AS mode FROM routed")
def thinking_mode(spark, d):
    """Fast for lookups and facts, slow for the rest, unless a caller says which; here each tenth does."""
    return routed(spark, d).select("id", F.when(F.col("id") % 10 == 0, "slow").when(F.col("intent").isin("entity_lookup", "factual"), "fast").otherwise("slow").alias("mode"))


@query("inspect_payload", f"WITH {CASCADE_SQL} SELECT query_id, layer, COUNT(*) AS refs, MIN(key) AS first FROM cascade GROUP BY 1, 2")
def inspect_payload(spark, d):
    """The evidence of each query's cards, flattened by layer."""
    cards = cascade(spark, d).groupBy("query_id", "layer").agg(F.collect_list("key").alias("evidence"))  # five at most
    return cards.select("query_id", "layer", F.explode("evidence").alias("key")).groupBy("query_id", "layer").agg(F.count("*").alias("refs"), F.min("key").alias("first"))


@query("ppr_recall", f"""WITH {TRIPLES_SQL}, {PPR_SQL}, v AS (SELECT id, subject, object, created_at FROM triples WHERE NOT is_deleted AND NOT is_invalid AND session % 50 = 1), n AS (SELECT * FROM v ORDER BY created_at DESC, id DESC LIMIT 2000),
  e AS (SELECT id FROM ppr WHERE ppr > 0 ORDER BY ROUND(CAST(ppr AS DOUBLE), 9) DESC, id LIMIT 10)
  SELECT id FROM n WHERE (SELECT COUNT(*) FROM v) >= 50 AND (subject IN (SELECT id FROM e) OR object IN (SELECT id FROM e)) ORDER BY created_at DESC, id DESC LIMIT 5""")
def ppr_recall(spark, d):
    """The newest facts about the ten entities that a walk from the query's ranks highest; of fifty valid facts or more, the
    2,000 newest are looked at."""
    v = valid(triples(spark, d)).where("session % 50 = 1").select("id", "subject", "object", "created_at")
    if v.limit(50).count() < 50:
        return v.limit(0).select("id")
    newest = v.orderBy(F.desc("created_at"), F.desc("id")).limit(2000)
    top = entity_ppr(spark, d).where("ppr > 0").orderBy(F.desc(F.round("ppr", 9)), "id").limit(10).select(F.col("id").alias("e"))
    met = newest.join(F.broadcast(top), (F.col("subject") == F.col("e")) | (F.col("object") == F.col("e")), "left_semi")  # ten rows
    return met.orderBy(F.desc("created_at"), F.desc("id")).limit(5).select("id")


@query("domain_filtered_search", f"WITH {BLOCKS_SQL}, {BM25_SQL}, r AS (SELECT bm.id, bm.score, b.lang FROM bm JOIN blocks b ON bm.id = b.id), t AS (SELECT * FROM r WHERE lang = 'xx') SELECT id, score FROM r WHERE (SELECT COUNT(*) FROM t) < 2 ORDER BY score DESC, id LIMIT 10")
def domain_filtered_search(spark, d):
    """Search among the blocks of a domain's tag; with fewer than two, again without it, as here, where no block has the tag."""
    rows = sparse(spark, d, 1_000_000).join(live(blocks(spark, d)).select("id", "tags"), "id")
    tagged = rows.where(F.array_contains("tags", "xx"))
    found = rows if tagged.limit(2).count() < 2 else tagged
    return found.orderBy(F.desc("score"), "id").limit(10).select("id", "score")
