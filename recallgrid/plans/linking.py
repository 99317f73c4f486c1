"""Joins of the memory model, aggregates over it, ranks, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.functions import scores, text
from recallgrid.operators import fusion, graph
from recallgrid.operators import tables as ops
from recallgrid.plans.knowledge import PARTS_SQL, edges
from recallgrid.plans.registry import ORACLES, query  # noqa: F401  (the health checks build on this module's SQL)
from recallgrid.schema import live, valid
from recallgrid.sources.tables import BLOCKS_SQL, CLAIMS_SQL, COMMUNITIES_SQL, ENTITIES_SQL, FEEDBACK_SQL, JOURNAL_SQL, LIVE_ENTITIES_SQL, MEMBERS_SQL, TRIPLES_SQL, blocks, claims, communities, entities, feedback, journal, live_entities, members, raw, triples, vectors

# ------------------------------------------------------------------ joins
@query("facts_of_community", f"WITH {TRIPLES_SQL}, {MEMBERS_SQL} SELECT m.community, COUNT(*) AS facts, COUNT(DISTINCT t.subject) AS subjects FROM triples t JOIN members m ON t.object = m.entity WHERE NOT t.is_deleted GROUP BY 1")
def facts_of_community(spark, d):
    """Facts joined with communities by the table of their members."""
    t = live(triples(spark, d)).join(members(spark, d), F.col("object") == F.col("entity"))
    return t.groupBy("community").agg(F.count("*").alias("facts"), F.countDistinct("subject").alias("subjects"))


@query("entity_communities", f"WITH {TRIPLES_SQL}, {MEMBERS_SQL}, {COMMUNITIES_SQL} SELECT DISTINCT t.subject AS entity, c.parent AS community FROM triples t JOIN members m ON t.object = m.entity JOIN communities c ON m.community = c.id WHERE c.level = 1 AND NOT t.is_invalid")
def entity_communities(spark, d):
    """Which entity has to do with which community, over three tables."""
    t = triples(spark, d).where("not is_invalid").join(members(spark, d), F.col("object") == F.col("entity")).select("subject", F.col("community").alias("id"))
    return t.join(communities(spark, d).where("level = 1"), "id").select(F.col("subject").alias("entity"), F.col("parent").alias("community")).distinct()


@query("summaries_at_level", f"WITH {COMMUNITIES_SQL}, s AS (SELECT 'summary of ' || id AS id, id AS community, size FROM communities) SELECT s.id, s.size FROM s JOIN communities c ON s.community = c.id WHERE c.level = 0")
def summaries_at_level(spark, d):
    c = communities(spark, d)
    s = c.select(F.concat(F.lit("summary of "), "id").alias("summary"), "id", "size")
    return s.join(c.where("level = 0").select("id"), "id", "left_semi").select(F.col("summary").alias("id"), "size")


@query("unused_entities", f"WITH {TRIPLES_SQL}, {ENTITIES_SQL}, v AS (SELECT * FROM triples WHERE NOT is_invalid AND NOT is_deleted AND session % 40 = 0) SELECT e.id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.subject = e.id) AND NOT EXISTS (SELECT 1 FROM v WHERE v.object = e.id)")
def unused_entities(spark, d):
    """Entities that are neither subject nor object of a valid fact of every fortieth session."""
    t = valid(triples(spark, d)).where("session % 40 = 0")
    used = t.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return entities(spark, d).select("id").join(used, "id", "left_anti")


@query("dead_facts", f"WITH {TRIPLES_SQL}, {ENTITIES_SQL}, {LIVE_ENTITIES_SQL} SELECT t.id, CASE WHEN s.id IS NULL AND o.id IS NULL THEN 'both' WHEN s.id IS NULL THEN 'subject' ELSE 'object' END AS role FROM triples t LEFT JOIN alive s ON t.subject = s.id LEFT JOIN alive o ON t.object = o.id WHERE NOT t.is_deleted AND (s.id IS NULL OR o.id IS NULL)")
def dead_facts(spark, d):
    """Facts of which one end or both are no live entities."""
    alive = live_entities(spark, d).select("id")
    t = live(triples(spark, d)).select("id", "subject", "object")
    t = t.join(alive.select(F.col("id").alias("subject"), F.lit(True).alias("s")), "subject", "left").join(alive.select(F.col("id").alias("object"), F.lit(True).alias("o")), "object", "left")
    role = F.when(F.col("s").isNull() & F.col("o").isNull(), "both").when(F.col("s").isNull(), "subject").when(F.col("o").isNull(), "object")
    return t.select("id", role.alias("role")).where("role is not null")


@query("stale_members", f"WITH {MEMBERS_SQL}, {ENTITIES_SQL}, {LIVE_ENTITIES_SQL}, r AS (SELECT m.community, m.entity, ROW_NUMBER() OVER (PARTITION BY m.community ORDER BY m.entity) AS n, COUNT(*) OVER (PARTITION BY m.community) AS dead FROM members m LEFT JOIN alive a ON m.entity = a.id WHERE a.id IS NULL) SELECT community, dead, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY n) AS first FROM r WHERE n <= 5 GROUP BY 1, 2")
def stale_members(spark, d):
    """Members of communities that live no more: how many, and the first five. Only five of each are carried."""
    dead = members(spark, d).join(live_entities(spark, d).select(F.col("id").alias("entity")), "entity", "left_anti")
    first = ops.first_by(dead, ["community"], [F.col("entity")], 5).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list("entity")), lambda x: x.cast("string")), ",").alias("first"))
    return dead.groupBy("community").agg(F.count("*").alias("dead")).join(first, "community")


#: Names that a text may mention, with the session that they are linked in.
NAMES = (("license", "src1"), ("copyright", "src2"), ("worthless", "src3"), ("permission", "src4"), ("thing", "src5"), ("email", "src6"), ("password", "src7"))
NAMES_SQL = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}')" for n, s in NAMES) + ") v(name, session))"


@query("missing_cross_refs", f"WITH {BLOCKS_SQL}, {NAMES_SQL}, b AS (SELECT * FROM blocks WHERE NOT is_deleted ORDER BY age_days, id LIMIT 300), m AS (SELECT b.id, n.name, ROW_NUMBER() OVER (PARTITION BY b.id ORDER BY n.name) AS k FROM b JOIN names n ON regexp_matches(lower(b.content), '\\b' || n.name || '\\b') WHERE b.session <> n.session) SELECT id, name FROM m WHERE k <= 5")
def missing_cross_refs(spark, d):
    """Names that a block mentions as whole words without being linked to them: of the 300 newest blocks, five each. The
    names are a table of known size."""
    names = F.broadcast(spark.createDataFrame(list(NAMES), "name string, linked string"))
    b = live(blocks(spark, d)).orderBy("age_days", "id").limit(300)
    found = b.join(names, F.expr("rlike(lower(content), concat('\\\\b', name, '\\\\b'))") & (F.col("session") != F.col("linked"))).select("id", "name")
    return ops.first_by(found, ["id"], [F.col("name")], 5)


COSINE_SQL = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query("vector_knn_filtered", f"WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id AS query_id, b.id, ROUND({COSINE_SQL}, 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1) SELECT query_id, id, score FROM r WHERE rank <= 5")
def vector_knn_filtered(spark, d):
    """The five nearest of the same label, if they are near enough, for every vector whose id is divisible by 100."""
    v = vectors(spark, d)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"), "label")
    met = v.join(asked, "label").where("id <> query_id").select("query_id", "id", F.round(scores.cosine(F.col("vec"), F.col("q")), 6).alias("score")).where("score >= 0.1")
    return ops.first_by(met, ["query_id"], [F.desc("score"), F.col("id")], 5).select("query_id", "id", "score")


@query("semantic_tiling", f"WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id DESC LIMIT 200) SELECT a.id AS a, b.id AS b, ROUND({COSINE_SQL}, 6) AS score FROM e a JOIN e b ON a.id < b.id WHERE {COSINE_SQL} >= 0.92")
def semantic_tiling(spark, d):
    """Pairs of the 200 newest vectors that are nearly the same."""
    v = vectors(spark, d).orderBy(F.desc("id")).limit(200).select("id", "vec")
    met = v.toDF("a", "va").join(F.broadcast(v.toDF("b", "vb")), F.col("a") < F.col("b"))  # 200 rows
    return met.withColumn("s", scores.cosine(F.col("va"), F.col("vb"))).where("s >= 0.92").select("a", "b", F.round("s", 6).alias("score"))


@query("tag_overlap", f"""WITH {BLOCKS_SQL}, k AS (SELECT lang, session, COUNT(*) AS n FROM blocks GROUP BY 1, 2)
  SELECT a.lang || ',' || a.session AS a, b.lang || ',' || b.session AS b, a.n AS blocks_a, b.n AS blocks_b, ROUND((CAST(a.lang = b.lang AS INTEGER) + CAST(a.session = b.session AS INTEGER)) / 2.0, 6) AS strength
  FROM k a JOIN k b ON (a.lang < b.lang OR (a.lang = b.lang AND a.session <= b.session)) WHERE a.lang = b.lang OR a.session = b.session""")
def tag_overlap(spark, d):
    """How strongly sets of tags are linked: shared tags over the size of the larger set. Blocks with the same tags are one
    class with a count, so no pair of blocks is made."""
    k = blocks(spark, d).groupBy("tags").agg(F.count("*").alias("n")).withColumn("key", F.array_join("tags", ","))
    each = k.select("key", "tags", "n", F.explode("tags").alias("tag"))
    met = each.select(F.col("key").alias("a"), F.col("tags").alias("ta"), F.col("n").alias("blocks_a"), "tag")
    other = each.select(F.col("key").alias("b"), F.col("tags").alias("tb"), F.col("n").alias("blocks_b"), "tag")
    met = met.join(other, "tag").where("ta[0] < tb[0] or (ta[0] = tb[0] and ta[1] <= tb[1])")
    shared = F.size(F.array_intersect("ta", "tb")) / F.greatest(F.size("ta"), F.size("tb"), F.lit(1))
    return met.select("a", "b", "blocks_a", "blocks_b", F.round(shared, 6).alias("strength")).distinct()


# ------------------------------------------------------------------ aggregates
@query("sessions", "SELECT conv_id AS session, COUNT(*) AS n, MIN(turn) AS first_turn, MAX(turn) AS last_turn, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1 ORDER BY last_turn DESC, session LIMIT 50")
def sessions(spark, d):
    found = raw(spark, d, "conversations").groupBy(F.col("conv_id").alias("session")).agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return ops.page(found, [F.desc("last_turn"), F.col("session")], 1, 50)


@query("top_entities", f"WITH {JOURNAL_SQL}, e AS (SELECT unnest([entity_id, entity_id % 10]) AS entity_id FROM journal) SELECT entity_id, COUNT(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 20")
def top_entities(spark, d):
    """The twenty entities that answers name most; each answer has a list of them."""
    each = journal(spark, d).select(F.explode(F.array(F.col("entity_id"), F.col("entity_id") % 10)).alias("entity_id"))
    return each.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(20)


@query("attention_buckets", f"""WITH {JOURNAL_SQL}, m AS (SELECT entity_id, MAX(ts) AS last FROM journal GROUP BY 1)
  SELECT entity_id, CASE WHEN last >= TIMESTAMP '2024-01-25 00:00:00' THEN 'active' WHEN last >= TIMESTAMP '2024-01-02 00:00:00' THEN 'historical' ELSE 'fading' END AS attention FROM m WHERE last >= TIMESTAMP '2023-11-03 00:00:00'""")
def attention_buckets(spark, d):
    """Entities by their last query: within 7, 30 or 90 days."""
    last = journal(spark, d).groupBy("entity_id").agg(F.max("ts").alias("last"))
    since = lambda days: F.col("last") >= F.expr(f"timestamp_ntz'2024-02-01 00:00:00' - interval {days} days")
    return last.where(since(90)).select("entity_id", F.when(since(7), "active").when(since(30), "historical").otherwise("fading").alias("attention"))


@query("entity_stats", f"WITH {ENTITIES_SQL}, {TRIPLES_SQL} SELECT (SELECT COUNT(*) FROM entities) AS entities, (SELECT CAST(SUM(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM entities) AS aliases, (SELECT ROUND(AVG(merge_count), 3) FROM entities) AS mean_merges, (SELECT COUNT(*) FROM triples t LEFT JOIN entities e ON t.subject = e.id WHERE e.id IS NULL) AS unresolved")
def entity_stats(spark, d):
    """Entities, all their aliases, the mean of their merges, and facts whose subject is unresolved."""
    e = entities(spark, d).withColumn("aliases", F.when(F.col("id") % 3 == 0, F.array("alias", "name")).otherwise(F.array("alias")))
    known = e.select(F.col("id").alias("subject"))
    open_ = triples(spark, d).join(known, "subject", "left_anti").agg(F.count("*").alias("unresolved"))
    return e.agg(F.count("*").alias("entities"), F.sum(F.size("aliases")).alias("aliases"), F.round(F.avg("merge_count"), 3).alias("mean_merges")).crossJoin(F.broadcast(open_))  # one row


@query("size_outliers", f"""WITH {COMMUNITIES_SQL}, c AS (SELECT id, size, (size % 10) / 20.0 AS modularity FROM communities WHERE level = 1), s AS (SELECT AVG(size) AS m, STDDEV_SAMP(size) AS sd, COUNT(*) AS n FROM c)
  SELECT id, size FROM c, s WHERE n >= 3 AND (size > (CASE WHEN sd = 0 THEN m * 3 ELSE m + 2 * sd END) OR modularity < 0.1)""")
def size_outliers(spark, d):
    """Communities that are far larger than most, or hardly hold together; of three at least."""
    c = communities(spark, d).where("level = 1").select("id", "size", ((F.col("size") % 10) / 20.0).alias("modularity"))
    bound = c.agg(F.avg("size").alias("m"), F.stddev_samp("size").alias("sd"), F.count("*").alias("n"))
    most = F.when(F.col("sd") == 0, F.col("m") * 3).otherwise(F.col("m") + 2 * F.col("sd"))
    return c.crossJoin(F.broadcast(bound)).where((F.col("n") >= 3) & ((F.col("size") > most) | (F.col("modularity") < 0.1))).select("id", "size")  # one row


@query("data_gaps", f"""WITH {TRIPLES_SQL}, {ENTITIES_SQL}, t AS (SELECT * FROM triples WHERE predicate = 'A' AND NOT is_invalid), used AS (SELECT id, COUNT(*) AS n FROM (SELECT subject AS id FROM t UNION ALL SELECT object AS id FROM t) x GROUP BY 1)
  SELECT e.id, COALESCE(u.n, 0) AS n FROM entities e LEFT JOIN used u ON e.id = u.id WHERE COALESCE(u.n, 0) <= 3 AND e.merge_count >= 2""")
def data_gaps(spark, d):
    """Entities that were merged but have three facts at most, on either side."""
    t = triples(spark, d).where("predicate = 'A' and not is_invalid")
    used = t.select(F.explode(F.array("subject", "object")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return entities(spark, d).where("merge_count >= 2").join(used, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).where("n <= 3")


@query("endpoint_sum", f"WITH {PARTS_SQL} SELECT id, SUM(weight) AS centrality FROM (SELECT a AS id, weight FROM edges UNION ALL SELECT b AS id, weight FROM edges) x GROUP BY 1")
def endpoint_sum(spark, d):
    """The weight at each end of edges."""
    return centrality(edges(spark, d))


def centrality(e):
    return e.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("centrality"))


@query("profile_score", f"""WITH {TRIPLES_SQL}, {COMMUNITIES_SQL}, {BLOCKS_SQL}, n AS (SELECT (SELECT COUNT(*) FROM triples) AS t, (SELECT COUNT(*) FROM communities) AS c, (SELECT COUNT(*) FROM communities WHERE level = 0) AS w, (SELECT COUNT(*) FROM blocks WHERE block_type = 'attitude') AS a)
  SELECT ROUND(least(least(log10(greatest(t, 1)) / log10(2000) * 70, 70) + least(2 * c, 15) + least(2 * w, 15), 100), 1) AS knowledge, ROUND(least(least(log10(greatest(a, 1)) / log10(500) * 60, 60), 100), 1) AS attitude FROM n""")
def profile_score(spark, d):
    """Scores of a space by its facts, communities, summaries (those of level 0) and attitudes."""
    c = communities(spark, d)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    n = one(triples(spark, d), "t").crossJoin(one(c, "c")).crossJoin(one(c.where("level = 0"), "w")).crossJoin(one(blocks(spark, d).where("block_type = 'attitude'"), "a"))  # one row each
    part = lambda col, base, most: F.least(F.log10(F.greatest(F.col(col), F.lit(1))) / F.log10(F.lit(base)) * most, F.lit(float(most)))
    bonus = lambda col: F.least(2 * F.col(col), F.lit(15))
    return n.select(F.round(F.least(part("t", 2000.0, 70) + bonus("c") + bonus("w"), F.lit(100.0)), 1).alias("knowledge"), F.round(F.least(part("a", 500.0, 60), F.lit(100.0)), 1).alias("attitude"))


@query("majority_stale", """WITH s AS (SELECT l_orderkey AS summary, l_shipdate > o_orderdate + INTERVAL 60 DAY AS newer, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-01') AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT summary, ROUND(AVG(CASE WHEN newer THEN 1.0 ELSE 0.0 END), 6) AS newer FROM s GROUP BY 1 HAVING AVG(CASE WHEN newer THEN 1.0 ELSE 0.0 END) > 0.5 AND MIN(age) > 30""")
def majority_stale(spark, d):
    """Summaries over a month old of whose facts more than half came after: a summary of each order, made when it was placed."""
    made = raw(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("made"))
    rows = triples(spark, d).join(made, "session").withColumn("newer", F.when(F.col("created_at") > F.expr("made + interval 60 days"), 1.0).otherwise(0.0))
    age = F.datediff(F.lit("2001-12-01").cast("date"), F.to_date("made"))
    return rows.groupBy(F.col("session").alias("summary")).agg(F.avg("newer").alias("newer"), F.min(age).alias("age")).where("newer > 0.5 and age > 30").select("summary", F.round("newer", 6).alias("newer"))


@query("block_statistics", f"WITH {BLOCKS_SQL} SELECT COUNT(*) AS blocks, COUNT(*) FILTER (age_days <= 1) AS fresh, COUNT(*) FILTER (is_invalid) AS invalid, COUNT(DISTINCT session) AS sessions, ROUND(AVG(confidence), 6) AS confidence, MIN(age_days) AS newest FROM blocks WHERE NOT is_deleted")
def block_statistics(spark, d):
    return live(blocks(spark, d)).agg(F.count("*").alias("blocks"), F.count_if(F.col("age_days") <= 1).alias("fresh"), F.count_if("is_invalid").alias("invalid"), F.countDistinct("session").alias("sessions"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min("age_days").alias("newest"))


@query("quality_score", f"""WITH {JOURNAL_SQL}, s AS (SELECT session, AVG(CASE WHEN verdict = 'correct' THEN 1.0 ELSE 0.0 END) AS good, AVG(CASE WHEN intent = 'error' THEN 1.0 ELSE 0.0 END) AS err, least(AVG(score) / 100.0, 1.0) AS eff, MAX(CASE WHEN intent = 'purchase' THEN 1.0 ELSE 0.0 END) AS done FROM journal GROUP BY 1)
  SELECT session, ROUND(greatest(0.0, least(1.0, CAST(0.4 * good + 0.3 * (1 - err) + 0.2 * eff + 0.1 * done AS DOUBLE))), 3) AS quality, CASE WHEN err > 0.5 THEN 'failure' WHEN err > 0.2 OR good < 0.7 THEN 'partial' ELSE 'success' END AS outcome FROM s""")
def quality_score(spark, d):
    """Sessions by success, errors, efficiency (here the mean score) and completion (a purchase)."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    s = journal(spark, d).groupBy("session").agg(F.avg(flag(F.col("verdict") == "correct")).alias("good"), F.avg(flag(F.col("intent") == "error")).alias("err"), F.least(F.avg("score") / 100.0, F.lit(1.0)).alias("eff"), F.max(flag(F.col("intent") == "purchase")).alias("done"))
    outcome = F.when(F.col("err") > 0.5, "failure").when((F.col("err") > 0.2) | (F.col("good") < 0.7), "partial").otherwise("success")
    total = 0.4 * F.col("good") + 0.3 * (1 - F.col("err")) + 0.2 * F.col("eff") + 0.1 * F.col("done")
    return s.select("session", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3).alias("quality"), outcome.alias("outcome"))


# ------------------------------------------------------------------ ranks and limits
# Predicates whose objects change with time.
VOLATILE = ("pattern_is", "flow_is", "implemented_as", "configured_with", "default_is", "format_is", "chosen_over")
VOLATILE_SQL = "(" + ", ".join(f"'{p}'" for p in VOLATILE) + ")"


@query("volatile_facts", f"""WITH {TRIPLES_SQL}, {CLAIMS_SQL}, v AS (SELECT * FROM claims WHERE predicate IN {VOLATILE_SQL} AND NOT is_invalid AND NOT is_deleted),
  n AS (SELECT subject, predicate, max({{'c': created_at, 'i': id, 'o': object}}) AS w FROM v GROUP BY 1, 2)
  SELECT v.id, n.w.i AS newest FROM v JOIN n ON v.subject = n.subject AND v.predicate = n.predicate WHERE v.object <> n.w.o AND v.created_at <= n.w.c - INTERVAL 30 DAY""")
def volatile_facts(spark, d):
    """Older facts of a subject and a changing predicate whose object is another one than the newest fact's, thirty days
    or more apart. The newest is a map-side combined maximum."""
    v = valid(claims(spark, d)).where(F.col("predicate").isin(*VOLATILE))
    newest = v.groupBy("subject", "predicate").agg(F.max(F.struct("created_at", "id", "object")).alias("w"))
    return v.join(newest, ["subject", "predicate"]).where("object <> w.object and created_at <= w.created_at - interval 30 days").select("id", F.col("w.id").alias("newest"))


@query("rerank_by_access", f"WITH {BLOCKS_SQL}, p AS (SELECT id, access_count, ROW_NUMBER() OVER (ORDER BY age_days, id) AS position FROM (SELECT * FROM blocks WHERE NOT is_deleted ORDER BY age_days, id LIMIT 100) x) SELECT id, ROW_NUMBER() OVER (ORDER BY access_count DESC, position) AS rank FROM p")
def rerank_by_access(spark, d):
    """A result list in the order of use; equal use keeps the list's order."""
    page = live(blocks(spark, d)).orderBy("age_days", "id").limit(100).select("id", "access_count", "age_days")
    listed = page.withColumn("position", F.row_number().over(Window.orderBy("age_days", "id")))
    return listed.select("id", F.row_number().over(Window.orderBy(F.desc("access_count"), "position")).alias("rank"))


@query("both_ends", f"WITH {BLOCKS_SQL}, b AS (SELECT id, age_days FROM blocks WHERE NOT is_deleted) SELECT id FROM (SELECT id FROM b ORDER BY age_days, id LIMIT 150) x UNION SELECT id FROM (SELECT id FROM b ORDER BY age_days DESC, id DESC LIMIT 150) y")
def both_ends(spark, d):
    """The newest and the oldest blocks, each once."""
    b = live(blocks(spark, d)).select("id", "age_days")
    return ops.first_and_last(b, [F.col("age_days"), F.col("id")], [F.desc("age_days"), F.desc("id")], 150).select("id")


@query("tagged_page", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE lang = 'en' AND NOT is_deleted ORDER BY id LIMIT 20")
def tagged_page(spark, d):
    """A page by tag, in the order of ids where none is asked for, so that pages don't overlap."""
    return ops.page(live(blocks(spark, d)).where(F.array_contains("tags", "en")).select("id"), [F.col("id")], 1, 20)


@query("candidate_cap", f"WITH {PARTS_SQL}, c AS (SELECT id, SUM(weight) AS centrality FROM (SELECT a AS id, weight FROM edges UNION ALL SELECT b AS id, weight FROM edges) x GROUP BY 1) SELECT id, centrality FROM c ORDER BY centrality DESC, id LIMIT 500")
def candidate_cap(spark, d):
    return centrality(edges(spark, d)).orderBy(F.desc("centrality"), "id").limit(500)


# How many hits, fast cards and cascade rows a budget allows.
BUDGETS = {"light": (8, 7, 2), "standard": (12, 10, 4), "deep": (16, 13, 6)}


@query("layer_budget", f"WITH {BLOCKS_SQL}, k AS (SELECT * FROM (VALUES {', '.join(f'''('{n}', {b[0]})''' for n, b in BUDGETS.items())}) v(budget, k)), r AS (SELECT id, ROW_NUMBER() OVER (ORDER BY access_count DESC, id) AS rank FROM blocks WHERE NOT is_deleted) SELECT budget, id FROM r JOIN k ON rank <= k")
def layer_budget(spark, d):
    """The hits that each budget lets through."""
    top = live(blocks(spark, d)).orderBy(F.desc("access_count"), "id").limit(max(b[0] for b in BUDGETS.values()))
    listed = top.select("id", F.row_number().over(Window.orderBy(F.desc("access_count"), "id")).alias("rank"))
    return reduce(lambda a, b: a.unionByName(b), [listed.where(F.col("rank") <= b[0]).select(F.lit(n).alias("budget"), "id") for n, b in BUDGETS.items()])


@query("unique_cards", f"WITH {JOURNAL_SQL} SELECT entity_id AS id, MIN(id) AS position FROM journal GROUP BY 1")
def unique_cards(spark, d):
    """Cards by id, the first of each, in their order."""
    return journal(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.min("id").alias("position")).orderBy("position")


@query("packed_prompt", f"""WITH {BLOCKS_SQL}, c AS (SELECT id, row_number() OVER (ORDER BY access_count DESC, id) AS n, trim(replace(content, chr(10), ' ')) AS s FROM (SELECT * FROM blocks WHERE NOT is_deleted ORDER BY access_count DESC, id LIMIT 3) x),
  l AS (SELECT n, CASE WHEN length(s) <= 180 THEN s ELSE rtrim(substr(s, 1, 179)) || '…' END AS long, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 79)) || '…' END AS short FROM c)
  SELECT n, long, short FROM l""")
def packed_prompt(spark, d):
    """The cards of a prompt at both of their lengths; functions.cards.pack() chooses what fits."""
    top = live(blocks(spark, d)).orderBy(F.desc("access_count"), "id").limit(3)
    s = F.trim(F.replace("content", F.lit("\n"), F.lit(" ")))
    listed = top.select(F.row_number().over(Window.orderBy(F.desc("access_count"), "id")).cast("long").alias("n"), s.alias("s"))
    return listed.select("n", clipped(F.col("s"), 180).alias("long"), clipped(F.col("s"), 80).alias("short"))


def clipped(value, limit: int):
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.rtrim(F.substring(value, 1, limit - 1)), F.lit("…")))


# ------------------------------------------------------------------ sets
@query("candidate_union", f"WITH {TRIPLES_SQL}, a AS (SELECT object AS id, COUNT(*) AS ppr FROM triples WHERE session % 7 = 0 GROUP BY 1), b AS (SELECT subject AS id, COUNT(*) AS degree FROM triples WHERE NOT is_invalid GROUP BY 1) SELECT COALESCE(a.id, b.id) AS id, COALESCE(a.ppr, 0) AS ppr, COALESCE(b.degree, 0) AS degree FROM a FULL JOIN b ON a.id = b.id")
def candidate_union(spark, d):
    """Candidates of two maps by id; what one lacks is 0."""
    t = triples(spark, d)
    a = t.where("session % 7 = 0").groupBy(F.col("object").alias("id")).agg(F.count("*").alias("ppr"))
    b = t.where("not is_invalid").groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("degree"))
    return a.join(b, "id", "full").select("id", F.coalesce("ppr", F.lit(0)).alias("ppr"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query("append_unseen", f"WITH {TRIPLES_SQL}, a AS (SELECT id FROM triples WHERE predicate = 'R' AND object % 5 = 0), b AS (SELECT id FROM triples WHERE object % 7 = 0) SELECT id, 'first' AS source FROM a UNION ALL SELECT b.id, 'more' AS source FROM b LEFT JOIN a ON a.id = b.id WHERE a.id IS NULL")
def append_unseen(spark, d):
    t = triples(spark, d)
    first = t.where("predicate = 'R' and object % 5 = 0").select("id", F.lit("first").alias("source"))
    return ops.append_unseen(first, t.where("object % 7 = 0").select("id", F.lit("more").alias("source")))
