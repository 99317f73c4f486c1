"""Scans, filters, joins, aggregates, windows and set operations over the memory model."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators import graph
from recallgrid.operators import tables as ops
from recallgrid.plans.registry import query
from recallgrid.schema import live, tier, valid
from recallgrid.sources.tables import BLOCKS_SQL, ENTITIES_SQL, FEEDBACK_SQL, JOURNAL_SQL, TRIPLES_SQL, blocks, entities, feedback, journal, raw, triples


@query("live_scan", f"WITH {BLOCKS_SQL} SELECT id, session, block_type FROM blocks WHERE NOT is_deleted")
def live_scan(spark, d):
    return live(blocks(spark, d)).select("id", "session", "block_type")


@query("list_page", f"WITH {BLOCKS_SQL} SELECT id, age_days FROM blocks WHERE NOT is_deleted ORDER BY age_days, id LIMIT 20 OFFSET 20")
def list_page(spark, d):
    return ops.page(live(blocks(spark, d)).select("id", "age_days"), [F.col("age_days"), F.col("id")], 2, 20)


@query("date_range_scan", f"WITH {JOURNAL_SQL} SELECT id, session FROM journal WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 00:00:00'")
def date_range_scan(spark, d):
    return journal(spark, d).where("ts >= timestamp_ntz'2024-01-05 00:00:00' and ts <= timestamp_ntz'2024-01-06 00:00:00'").select("id", "session")


@query("point_lookup", f"WITH {BLOCKS_SQL} SELECT id, session, confidence FROM blocks WHERE id = 42 AND NOT is_deleted")
def point_lookup(spark, d):
    return live(blocks(spark, d)).where("id = 42").select("id", "session", "confidence")


@query("trash_scan", f"WITH {BLOCKS_SQL} SELECT id, age_days FROM blocks WHERE is_deleted ORDER BY age_days, id")
def trash_scan(spark, d):
    return blocks(spark, d).where("is_deleted").select("id", "age_days").orderBy("age_days", "id")


@query("partial_update", f"WITH {BLOCKS_SQL} SELECT id, CASE WHEN block_type = 'skill' THEN confidence / 2 ELSE confidence END AS confidence FROM blocks")
def partial_update(spark, d):
    changed = ops.partial_update(blocks(spark, d), F.col("block_type") == "skill", confidence=F.col("confidence") / 2, id=F.lit(0))
    return changed.select("id", "confidence")


@query("soft_delete_restore", f"WITH {BLOCKS_SQL} SELECT id, (is_deleted OR age_days > 365) AND NOT id % 2 = 0 AS is_deleted FROM blocks")
def soft_delete_restore(spark, d):
    return ops.restore(ops.soft_delete(blocks(spark, d), F.col("age_days") > 365), F.col("id") % 2 == 0).select("id", "is_deleted")


@query("purge", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE NOT (is_deleted AND age_days > 90)")
def purge(spark, d):
    return blocks(spark, d).where(~(F.col("is_deleted") & (F.col("age_days") > 90))).select("id")


@query(
    "upsert_edges",
    f"""WITH {TRIPLES_SQL}, old AS (SELECT subject, object, COUNT(*) AS n FROM triples WHERE predicate = 'A' GROUP BY 1, 2),
  new AS (SELECT subject, object, COUNT(*) AS n FROM triples WHERE predicate = 'R' GROUP BY 1, 2)
  SELECT subject, object, n FROM new UNION ALL SELECT o.subject, o.object, o.n FROM old o LEFT JOIN new w ON o.subject = w.subject AND o.object = w.object WHERE w.subject IS NULL""",
)
def upsert_edges(spark, d):
    count = lambda p: triples(spark, d).where(F.col("predicate") == p).groupBy("subject", "object").agg(F.count("*").alias("n"))
    return ops.upsert(count("A"), count("R"), ["subject", "object"])


@query("tags_all", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE lang = 'en' AND session = 'src3'")
def tags_all(spark, d):
    wanted = F.array(F.lit("en"), F.lit("src3"))
    return blocks(spark, d).where(F.size(F.array_except(wanted, "tags")) == 0).select("id")


@query("tags_any", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE lang = 'de' OR session = 'src3'")
def tags_any(spark, d):
    return blocks(spark, d).where(F.arrays_overlap("tags", F.array(F.lit("de"), F.lit("src3")))).select("id")


@query("substring_search", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE NOT is_deleted AND contains(lower(content), 'worthless')")
def substring_search(spark, d):
    return live(blocks(spark, d)).where(F.ilike("content", F.lit("%worthless%"))).select("id")


@query("keyword_expanded_search", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE contains(lower(content), 'license') OR contains(lower(content), 'copyright')")
def keyword_expanded_search(spark, d):
    return blocks(spark, d).where(text.contains_any(F.col("content"), ["license", "copyright"])).select("id")


@query("tier_of_blocks", f"WITH {BLOCKS_SQL} SELECT CASE WHEN age_days <= 14 THEN 'hot' WHEN age_days <= 180 THEN 'warm' WHEN age_days <= 1095 THEN 'cold' ELSE 'frozen' END AS tier, COUNT(*) AS n FROM blocks WHERE NOT is_deleted GROUP BY 1")
def tier_of_blocks(spark, d):
    return live(blocks(spark, d)).groupBy(tier(F.col("age_days")).alias("tier")).agg(F.count("*").alias("n"))


@query("separator_flood", "SELECT doc_id, regexp_matches(text, '[-=_*#]{20,}') AS flooded FROM documents")
def separator_flood(spark, d):
    return raw(spark, d, "documents").select("doc_id", F.rlike("text", F.lit(text.INJECTIONS["separator_flood"])).alias("flooded"))


@query("triples_with_names", f"WITH {TRIPLES_SQL}, {ENTITIES_SQL} SELECT t.id, s.s_name AS subject_name, e.name AS object_name FROM triples t JOIN supplier s ON t.subject = s.s_suppkey JOIN entities e ON t.object = e.id WHERE NOT t.is_deleted")
def triples_with_names(spark, d):
    names = raw(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_name").alias("subject_name"))
    return live(triples(spark, d)).join(names, "subject").join(entities(spark, d).select(F.col("id").alias("object"), F.col("name").alias("object_name")), "object").select("id", "subject_name", "object_name")


@query("session_bridge", "SELECT o.o_custkey AS customer, COUNT(DISTINCT l.l_suppkey) AS suppliers, COUNT(DISTINCT l.l_partkey) AS parts FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def session_bridge(spark, d):
    line = triples(spark, d).select("session", "subject", "object")
    return raw(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("customer")).join(line, "session").groupBy("customer").agg(F.countDistinct("subject").alias("suppliers"), F.countDistinct("object").alias("parts"))


@query("count_by_type", f"WITH {BLOCKS_SQL} SELECT block_type, COUNT(*) AS n FROM blocks WHERE NOT is_deleted GROUP BY 1")
def count_by_type(spark, d):
    return live(blocks(spark, d)).groupBy("block_type").agg(F.count("*").alias("n"))


@query("tag_sync", f"WITH {BLOCKS_SQL} SELECT name, COUNT(*) AS usage_count FROM (SELECT lang AS name FROM blocks UNION ALL SELECT session AS name FROM blocks) x GROUP BY 1")
def tag_sync(spark, d):
    return blocks(spark, d).select(F.explode("tags").alias("name")).groupBy("name").agg(F.count("*").alias("usage_count"))


@query("daily_quality", f"WITH {JOURNAL_SQL} SELECT CAST(ts AS DATE) AS day, COUNT(*) AS volume, ROUND(AVG(score), 3) AS quality FROM journal GROUP BY 1")
def daily_quality(spark, d):
    return journal(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("volume"), F.round(F.avg("score"), 3).alias("quality"))


@query("top_intents", f"WITH {JOURNAL_SQL} SELECT intent, COUNT(*) AS n FROM journal GROUP BY 1 ORDER BY n DESC, intent")
def top_intents(spark, d):
    return journal(spark, d).groupBy("intent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "intent")


@query("failed_queries", f"WITH {JOURNAL_SQL} SELECT intent, entity_id, COUNT(*) AS n FROM journal WHERE verdict = 'incorrect' GROUP BY 1, 2 ORDER BY n DESC, intent, entity_id LIMIT 10")
def failed_queries(spark, d):
    return journal(spark, d).where("verdict = 'incorrect'").groupBy("intent", "entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "intent", "entity_id").limit(10)


@query("knowledge_gaps", f"WITH {JOURNAL_SQL} SELECT entity_id, COUNT(*) AS n, MAX(ts) AS last FROM journal WHERE verdict = 'incorrect' AND ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1 HAVING COUNT(*) >= 2")
def knowledge_gaps(spark, d):
    return journal(spark, d).where("verdict = 'incorrect' and ts >= timestamp_ntz'2024-01-15 00:00:00'").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).where("n >= 2")


@query(
    "cooccurring_pairs",
    f"""WITH {TRIPLES_SQL}, directed AS (SELECT subject, object, COUNT(*) AS n FROM triples WHERE NOT is_deleted GROUP BY 1, 2 HAVING COUNT(*) >= 2)
  SELECT CASE WHEN subject < object THEN subject ELSE object END AS a, CASE WHEN subject < object THEN object ELSE subject END AS b, CAST(SUM(n) AS BIGINT) AS n FROM directed WHERE subject <> object GROUP BY 1, 2""",
)
def cooccurring_pairs(spark, d):
    directed = live(triples(spark, d)).groupBy("subject", "object").agg(F.count("*").alias("n")).where("n >= 2 and subject <> object")
    return directed.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.sum("n").alias("n"))


@query("feedback_net", f"WITH {FEEDBACK_SQL} SELECT entity_id, CAST(SUM(CASE WHEN signal = 'positive' THEN 1 ELSE -1 END) AS BIGINT) AS net, CAST(SUM(CASE WHEN signal = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM feedback GROUP BY 1")
def feedback_net(spark, d):
    up = F.col("signal") == "positive"
    return feedback(spark, d).groupBy("entity_id").agg(F.sum(F.when(up, 1).otherwise(-1)).alias("net"), F.count_if(up).alias("positive"))


@query("distinct_sessions", f"WITH {JOURNAL_SQL} SELECT COUNT(DISTINCT session) AS n FROM journal WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def distinct_sessions(spark, d):
    return journal(spark, d).where("ts >= timestamp_ntz'2024-01-20 00:00:00'").agg(F.countDistinct("session").alias("n"))


@query("scale_class", f"WITH {BLOCKS_SQL} SELECT CAST(SUM(length(content)) AS BIGINT) AS chars, CASE WHEN SUM(length(content)) < 200000 THEN 'micro' WHEN SUM(length(content)) < 2000000 THEN 'small' WHEN SUM(length(content)) < 50000000 THEN 'medium' ELSE 'large' END AS scale FROM blocks WHERE NOT is_deleted")
def scale_class(spark, d):
    n = F.col("chars")
    total = live(blocks(spark, d)).agg(F.sum(F.length("content")).alias("chars"))
    return total.select("chars", F.when(n < 200_000, "micro").when(n < 2_000_000, "small").when(n < 50_000_000, "medium").otherwise("large").alias("scale"))


@query("percentile_thresholds", "SELECT ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS p25, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS p50, ROUND(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem")
def percentile_thresholds(spark, d):
    """Quartiles of prices, exact, without a task that sees them all."""
    found = graph.quantiles(raw(spark, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.75])
    return spark.createDataFrame([tuple(round(v, 6) for v in found)], "p25 double, p50 double, p75 double")


@query("out_degree", f"WITH {TRIPLES_SQL} SELECT subject, COUNT(*) AS degree FROM triples WHERE NOT is_deleted AND NOT is_invalid GROUP BY 1")
def out_degree(spark, d):
    return valid(triples(spark, d)).groupBy("subject").agg(F.count("*").alias("degree"))


@query("access_increment", f"WITH {BLOCKS_SQL}, {JOURNAL_SQL}, hits AS (SELECT entity_id, COUNT(*) AS n FROM journal GROUP BY 1) SELECT b.id, b.access_count + COALESCE(h.n, 0) AS access_count FROM blocks b LEFT JOIN hits h ON b.id = h.entity_id")
def access_increment(spark, d):
    hits = journal(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    return blocks(spark, d).join(hits, "id", "left").select("id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"))


@query("min_max_normalise", f"WITH {TRIPLES_SQL}, s AS (SELECT subject, COUNT(*) AS n FROM triples GROUP BY 1) SELECT subject, ROUND(CAST(n - (SELECT MIN(n) FROM s) AS DOUBLE) / ((SELECT MAX(n) FROM s) - (SELECT MIN(n) FROM s)), 6) AS n FROM s")
def min_max_normalise(spark, d):
    return graph.min_max(triples(spark, d).groupBy("subject").agg(F.count("*").cast("double").alias("n")), "n").select("subject", F.round("n", 6).alias("n"))


@query("momentum", f"WITH {JOURNAL_SQL}, r AS (SELECT session, intent, ROW_NUMBER() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS n FROM journal) SELECT session, MIN(intent) AS intent FROM r WHERE n <= 3 GROUP BY 1 HAVING COUNT(DISTINCT intent) = 1 AND COUNT(*) = 3")
def momentum(spark, d):
    last = ops.first_by(journal(spark, d), ["session"], [F.desc("ts"), F.desc("id")], 3)
    return last.groupBy("session").agg(F.min("intent").alias("intent"), F.countDistinct("intent").alias("kinds"), F.count("*").alias("n")).where("kinds = 1 and n = 3").select("session", "intent")


@query("union_sessions", f"WITH {BLOCKS_SQL} SELECT session FROM blocks UNION SELECT lang AS session FROM blocks")
def union_sessions(spark, d):
    b = blocks(spark, d)
    return b.select("session").union(b.select("lang")).distinct()


@query("not_indexed", "SELECT d.doc_id AS id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL")
def not_indexed(spark, d):
    return raw(spark, d, "documents").select(F.col("doc_id").alias("id")).join(raw(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


