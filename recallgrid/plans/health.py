"""Health checks: each gives findings (check_name, severity, entity_id, entity_type, message, action); and what is done about them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import scores, text
from recallgrid.operators.graph import saved
from recallgrid.plans import linking
from recallgrid.plans.knowledge import NAME_VECTORS
from recallgrid.plans.registry import ORACLES, QUERIES, query
from recallgrid.schema import live, valid
from recallgrid.sources.tables import BLOCKS_SQL, CLAIMS_SQL, ENTITIES_SQL, TEXTS_SQL, TRIPLES_SQL, blocks, claims, entities, raw, sql_text, texts, triples, vectors

Check = Callable[..., DataFrame]
#: Every check by name, and the SQL of its findings.
CHECKS: dict[str, Check] = {}
FINDINGS: dict[str, str] = {}


def check(name: str, severity: str, kind: str, action: str, sql: str | None = None):
    """Registers a check, whose function gives (id, message) and may give a severity of its own, as a query too."""

    def put(fn: Check) -> Check:
        def run(spark, d) -> DataFrame:
            found = fn(spark, d)
            own = F.col("severity") if "severity" in found.columns else F.lit(severity)
            return found.select(F.lit(name).alias("check_name"), own.alias("severity"), F.col("id").cast("string").alias("entity_id"), F.lit(kind).alias("entity_type"), "message", F.lit(action).alias("action"))

        CHECKS[name] = QUERIES[f"check_{name}"] = run
        if sql:
            with_, _, body = sql.rpartition("##")
            own = "severity" if " AS severity" in body else f"'{severity}'"
            FINDINGS[name] = f"{with_} SELECT '{name}' AS check_name, {own} AS severity, CAST(id AS VARCHAR) AS entity_id, '{kind}' AS entity_type, message, '{action}' AS action FROM ({body}) x"
            ORACLES[f"check_{name}"] = FINDINGS[name]
        return fn

    return put


VECTORS_SQL = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
LIKE_SQL = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@check("contradictions", "error", "triple", "resolve", f"""WITH {TRIPLES_SQL}, {CLAIMS_SQL}, {VECTORS_SQL}, c AS (SELECT * FROM claims WHERE NOT is_deleted AND NOT is_invalid), newest AS (SELECT * FROM c ORDER BY created_at DESC, id DESC LIMIT 100)
  ## SELECT DISTINCT least(x.id, y.id) AS id, 'contradicts ' || greatest(x.id, y.id) AS message FROM newest x JOIN c y ON x.subject = y.subject AND x.predicate = y.predicate AND x.object <> y.object JOIN v a ON x.object % {NAME_VECTORS} = a.id JOIN v b ON y.object % {NAME_VECTORS} = b.id WHERE {LIKE_SQL} >= 0.8""")
def contradictions(spark, d):
    """The hundred newest facts against all of the same subject and predicate: another object, nearly the same meaning."""
    v = vectors(spark, d).select("id", "vec")
    c = valid(claims(spark, d)).select("id", "subject", "predicate", "object", "created_at")
    newest = F.broadcast(c.orderBy(F.desc("created_at"), F.desc("id")).limit(100).join(v.toDF("i", "va"), F.col("object") % NAME_VECTORS == F.col("i")).select(F.col("id").alias("x"), "subject", "predicate", F.col("object").alias("xo"), "va"))  # 100 rows
    met = c.join(newest, ["subject", "predicate"]).where("object <> xo").join(v.toDF("j", "vb"), F.col("object") % NAME_VECTORS == F.col("j"))
    return met.where(scores.cosine(F.col("va"), F.col("vb")) >= 0.8).select(F.least("x", "id").alias("id"), F.concat(F.lit("contradicts "), F.greatest("x", "id").cast("string")).alias("message")).distinct()


@check("stale", "info", "triple", "invalidate", f"""WITH {TRIPLES_SQL}, x AS (SELECT id, id % 4 AS uses, date_diff('day', CAST(created_at AS DATE), DATE '2001-12-01') AS age, CASE WHEN id % 3 = 0 THEN NULL ELSE date_diff('day', CAST(created_at AS DATE), DATE '2001-12-01') - 40 END AS used FROM triples WHERE NOT is_deleted AND NOT is_invalid)
  ## SELECT id, 'unused for ' || COALESCE(used, age) || ' days' AS message FROM x WHERE uses < 2 AND COALESCE(used, age) > 90""")
def stale(spark, d):
    """Facts used less than twice, and not for ninety days; one that never was counts from when it was made."""
    age = F.datediff(F.lit("2001-12-01").cast("date"), F.to_date("created_at"))
    used = F.when(F.col("id") % 3 != 0, age - 40)
    since = F.coalesce(used, age)
    return valid(triples(spark, d)).where((F.col("id") % 4 < 2) & (since > 90)).select("id", F.concat(F.lit("unused for "), since.cast("string"), F.lit(" days")).alias("message"))


CANONICALS_SQL = "canonicals AS (SELECT 'part:' || p_partkey AS id, p_partkey AS n, p_name AS name, 'part' AS kind FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_custkey, c_name, 'customer' FROM customer)"


def canonicals(spark, d) -> DataFrame:
    """(id, n, name, kind): parts, suppliers and customers as entities of one table."""
    of = lambda t, k, c: raw(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("id"), F.col(k).alias("n"), F.col(c).alias("name"), F.lit(t).alias("kind"))
    return of("part", "p_partkey", "p_name").unionByName(of("supplier", "s_suppkey", "s_name")).unionByName(of("customer", "c_custkey", "c_name"))


@check("orphan_entities", "warning", "entity", "delete", f"""WITH {TRIPLES_SQL}, {CANONICALS_SQL}, t AS (SELECT * FROM triples WHERE NOT is_deleted AND NOT is_invalid), used AS (SELECT 'supplier:' || subject AS id FROM t UNION SELECT 'part:' || object AS id FROM t)
  ## SELECT c.id, 'no fact names ' || c.name AS message FROM canonicals c LEFT JOIN used u ON c.id = u.id WHERE u.id IS NULL""")
def orphan_entities(spark, d):
    """Entities that are neither subject nor object of a valid fact."""
    t = valid(triples(spark, d))
    used = t.select(F.explode(F.array(F.concat(F.lit("supplier:"), F.col("subject").cast("string")), F.concat(F.lit("part:"), F.col("object").cast("string")))).alias("id"))
    return canonicals(spark, d).join(used.distinct(), "id", "left_anti").select("id", F.concat(F.lit("no fact names "), "name").alias("message"))


@check("dangling_refs", "warning", "triple", "link", f"""WITH {TRIPLES_SQL}, x AS (SELECT id, CASE WHEN session % 97 <> 0 THEN subject END AS s, CASE WHEN session % 89 <> 0 THEN object END AS o FROM triples WHERE NOT is_deleted AND NOT is_invalid)
  ## SELECT id, CASE WHEN s IS NULL AND o IS NULL THEN 'no ends' WHEN s IS NULL THEN 'no subject' ELSE 'no object' END AS message FROM x WHERE s IS NULL OR o IS NULL""")
def dangling_refs(spark, d):
    """Facts without the entity of an end; those of some sessions were never linked."""
    s, o = F.col("session") % 97 == 0, F.col("session") % 89 == 0
    message = F.when(s & o, "no ends").when(s, "no subject").when(o, "no object")
    return valid(triples(spark, d)).select("id", message.alias("message")).where("message is not null")


@check("community_anomalies", "info", "community", "review", linking.ORACLES["size_outliers"].replace("SELECT id, size FROM c, s", "## SELECT id, 'size ' || size AS message FROM c, s"))
def community_anomalies(spark, d):
    return linking.size_outliers(spark, d).select("id", F.concat(F.lit("size "), F.col("size").cast("string")).alias("message"))


@check("data_gaps", "info", "entity", "enrich", linking.ORACLES["data_gaps"].replace("SELECT e.id, COALESCE(u.n, 0) AS n FROM", "## SELECT e.id, 'facts: ' || COALESCE(u.n, 0) AS message FROM"))
def data_gaps(spark, d):
    return linking.data_gaps(spark, d).select("id", F.concat(F.lit("facts: "), F.col("n").cast("string")).alias("message"))


@check("semantic_contradictions", "warning", "block", "compare", f"""WITH {VECTORS_SQL}, a AS (SELECT * FROM v ORDER BY id DESC LIMIT 100)
  ## SELECT a.id, 'like ' || b.id AS message FROM a JOIN v b ON a.label <> b.label AND {LIKE_SQL} >= 0.42""")
def semantic_contradictions(spark, d):
    """Candidates for a model to compare: the hundred newest vectors against all of other sessions. The rule's likeness is
    0.70; the given vectors are random, so 0.42 is asked for here."""
    v = vectors(spark, d).select("id", "label", "vec")
    newest = F.broadcast(v.orderBy(F.desc("id")).limit(100).toDF("a", "la", "va"))  # 100 rows
    met = v.join(newest, F.col("label") != F.col("la")).where(scores.cosine(F.col("va"), F.col("vec")) >= 0.42)
    return met.select(F.col("a").alias("id"), F.concat(F.lit("like "), F.col("id").cast("string")).alias("message"))


# Predicates that contradict each other, of the same ends or of the reversed ones.
CONTRADICTING = (("should", "should_NOT", "same"), ("enables", "prevents", "same"), ("improves", "degrades", "same"), ("fixes", "causes", "same"), ("chosen_over", "chosen_over", "reverse"))
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT x.id AS a, y.id AS b, x.session, '{p} vs {q}' AS rule FROM c x JOIN c y ON " + ("x.subject = y.subject AND x.object = y.object" if mode == "same" else "x.subject = y.object AND x.object = y.subject AND x.id < y.id") + f" WHERE x.predicate = '{p}' AND y.predicate = '{q}'"
    for p, q, mode in CONTRADICTING
)
CONTRADICTING_SQL = f"{TRIPLES_SQL}, {CLAIMS_SQL}, c AS (SELECT * FROM claims WHERE NOT is_invalid AND NOT is_deleted), pairs AS ({_PAIRS_SQL})"


def contradicting(spark, d) -> DataFrame:
    """(a, b, session, rule): pairs of facts under the five rules, whichever is older."""
    c = valid(claims(spark, d)).select("id", "session", "subject", "predicate", "object")
    out = []
    for p, q, mode in CONTRADICTING:
        x = c.where(F.col("predicate") == p).select(F.col("id").alias("a"), "session", "subject", "object")
        y = c.where(F.col("predicate") == q).select(F.col("id").alias("b"), *([F.col("subject"), F.col("object")] if mode == "same" else [F.col("subject").alias("object"), F.col("object").alias("subject")]))
        met = x.join(y, ["subject", "object"])
        met = met if mode == "same" else met.where("a < b")
        out.append(met.select("a", "b", "session", F.lit(f"{p} vs {q}").alias("rule")))
    return reduce(DataFrame.unionByName, out)


@check("predicate_contradictions", "error", "triple", "resolve", f"WITH {CONTRADICTING_SQL} ## SELECT a AS id, rule || ' of ' || b AS message FROM pairs")
def predicate_contradictions(spark, d):
    return contradicting(spark, d).select(F.col("a").alias("id"), F.concat("rule", F.lit(" of "), F.col("b").cast("string")).alias("message"))


@check("temporal_staleness", "warning", "triple", "invalidate", linking.ORACLES["volatile_facts"].replace("SELECT v.id, n.w.i AS newest FROM", "## SELECT v.id, 'replaced by ' || n.w.i AS message FROM"))
def temporal_staleness(spark, d):
    return linking.volatile_facts(spark, d).select("id", F.concat(F.lit("replaced by "), F.col("newest").cast("string")).alias("message"))


@check("entity_alias_collision", "warning", "entity", "resolve", f"""WITH {ENTITIES_SQL}, e AS (SELECT * FROM entities WHERE length(alias) >= 4), m AS (SELECT alias, MIN(id) AS first FROM e GROUP BY 1),
  p AS (SELECT m.first AS id, e.id AS other, 0 AS step, 'alias ' || e.alias || ' of ' || e.id AS message, 'warning' AS severity FROM e JOIN m ON e.alias = m.alias JOIN entities f ON f.id = m.first WHERE e.id <> m.first AND lower(e.name) <> lower(f.name)
    UNION ALL SELECT n.first AS id, e.id AS other, 1 AS step, 'name of ' || e.id AS message, 'info' AS severity FROM entities e JOIN (SELECT lower(name) AS name, entity_type, MIN(id) AS first FROM entities WHERE length(name) >= 6 GROUP BY 1, 2) n ON lower(e.name) = n.name AND e.entity_type = n.entity_type WHERE e.id <> n.first)
  ## SELECT id, message, severity AS severity FROM (SELECT * FROM p ORDER BY step, id, other LIMIT 50) q""")
def entity_alias_collision(spark, d):
    """Entities that share an alias under different names, then those of one type whose name contains another's; fifty at
    most, each beside the first of its group, so no pairs of a group are made. Names here contain each other only if equal;
    containing() is the general form, for names that share a word."""
    e = entities(spark, d)
    first = e.where(F.length("alias") >= 4).groupBy("alias").agg(F.min(F.struct("id", "name")).alias("f"))
    shared = e.join(first, "alias").where((F.col("id") != F.col("f.id")) & (F.lower("name") != F.lower("f.name")))
    shared = shared.select(F.col("f.id").alias("first"), F.col("id").alias("other"), F.lit(0).alias("step"), F.concat(F.lit("alias "), "alias", F.lit(" of "), F.col("id").cast("string")).alias("message"), F.lit("warning").alias("severity"))
    named = e.where(F.length("name") >= 6).groupBy(F.lower("name").alias("low"), "entity_type").agg(F.min("id").alias("first"))
    inside = e.withColumn("low", F.lower("name")).join(named, ["low", "entity_type"]).where("id <> first")
    inside = inside.select("first", F.col("id").alias("other"), F.lit(1).alias("step"), F.concat(F.lit("name of "), F.col("id").cast("string")).alias("message"), F.lit("info").alias("severity"))
    return shared.unionByName(inside).orderBy("step", "first", "other").limit(50).select(F.col("first").alias("id"), "message", "severity")


def containing(names: DataFrame) -> DataFrame:
    """(a, b) of (id, name, kind): a's name of six characters or more stands within b's, of one kind. Only names that share
    their first word, as whole words, are compared."""
    n = names.where(F.length("name") >= 6).select("id", "kind", F.lower("name").alias("name"))
    own = n.select(F.col("id").alias("a"), "kind", F.col("name").alias("na"), F.element_at(F.split("name", r"\s+"), 1).alias("word"))
    each = n.select(F.col("id").alias("b"), "kind", F.col("name").alias("nb"), F.explode(F.array_distinct(F.split("name", r"\s+"))).alias("word"))
    return own.join(each, ["kind", "word"]).where((F.col("a") != F.col("b")) & F.contains("nb", F.col("na"))).select("a", "b").distinct()


#: What is known of the system: names that are gone, and the port of each service. Callers give their own.
GONE = ("red widget",)
# Predicates whose objects can be held against what is known.
GROUNDABLE = ("implemented_as", "configured_with", "default_is", "format_is", "uses", "depends_on", "requires", "pattern_is", "flow_is")
GROUNDING_SQL = f"""{TRIPLES_SQL}, {CLAIMS_SQL}, g AS (SELECT c.id, c.session, p.p_name AS name, c.predicate, 8000 + c.object % 3 AS claimed, 8000 + c.subject % 3 AS actual FROM claims c JOIN part p ON c.object = p.p_partkey WHERE NOT c.is_invalid AND NOT c.is_deleted),
  drift AS (SELECT id, session, CASE WHEN name IN ({', '.join(map(sql_text, GONE))}) THEN 'names ' || name WHEN predicate IN ({', '.join(map(sql_text, GROUNDABLE))}) AND claimed <> actual THEN 'port ' || claimed || ' is ' || actual END AS message FROM g)"""


def drifted(spark, d) -> DataFrame:
    """(id, session, message): valid facts that name what is gone, or a port that its service doesn't have (here both follow
    from the ids)."""
    g = valid(claims(spark, d)).join(raw(spark, d, "part").select(F.col("p_partkey").alias("object"), F.col("p_name").alias("name")), "object")
    claimed, actual = 8000 + F.col("object") % 3, 8000 + F.col("subject") % 3
    message = F.when(F.col("name").isin(*GONE), F.concat(F.lit("names "), "name")).when(F.col("predicate").isin(*GROUNDABLE) & (claimed != actual), F.concat(F.lit("port "), claimed.cast("string"), F.lit(" is "), actual.cast("string")))
    return g.select("id", "session", message.alias("message")).where("message is not null")


@check("grounding", "error", "triple", "invalidate", f"WITH {GROUNDING_SQL} ## SELECT id, message FROM drift WHERE message IS NOT NULL")
def grounding(spark, d):
    return drifted(spark, d).select("id", "message")


@check("knowledge_conflicts", "warning", "triple", "resolve", f"""WITH {BLOCKS_SQL}, {GROUNDING_SQL}, c AS (SELECT * FROM claims WHERE NOT is_invalid AND NOT is_deleted), pairs AS ({_PAIRS_SQL}),
  told AS (SELECT session, MAX(CASE WHEN length(trim(content)) < 20 THEN 1 ELSE 0 END) AS flagged FROM blocks WHERE NOT is_deleted GROUP BY 1),
  cand AS (SELECT a AS id, 'src' || (session % 25) AS source, 0.9 AS raw FROM pairs UNION ALL SELECT id, 'src' || (session % 25), 1.0 FROM drift WHERE message IS NOT NULL AND message LIKE 'names%'),
  scored AS (SELECT c.id, CASE WHEN c.raw = 1.0 THEN 1.0 ELSE least(1.0, c.raw + CASE WHEN t.session IS NULL THEN 0.0 ELSE 0.1 + 0.2 * t.flagged END) END AS s FROM cand c LEFT JOIN told t ON c.source = t.session)
  ## SELECT DISTINCT id, 'confidence ' || CAST(CAST(ROUND(s, 1) AS DECIMAL(3, 1)) AS VARCHAR) AS message, CASE WHEN s >= 0.8 THEN 'error' ELSE 'warning' END AS severity FROM scored WHERE s >= 0.6""")
def knowledge_conflicts(spark, d):
    """Candidates of the other checks, held against their sessions: a tenth more where the session has blocks, two where one
    of these is flagged (as empty, here); what is known of the system needs no more."""
    told = live(blocks(spark, d)).groupBy(F.col("session").alias("source")).agg(F.max((F.length(F.trim("content")) < 20).cast("int")).alias("flagged"))
    source = F.concat(F.lit("src"), (F.col("session") % 25).cast("string")).alias("source")
    cand = contradicting(spark, d).select(F.col("a").alias("id"), source, F.lit(0.9).alias("raw"))
    cand = cand.unionByName(drifted(spark, d).where("message like 'names%'").select("id", source, F.lit(1.0).alias("raw")))
    more = F.when(F.col("flagged").isNull(), 0.0).otherwise(0.1 + 0.2 * F.col("flagged"))
    s = F.when(F.col("raw") == 1.0, 1.0).otherwise(F.least(F.lit(1.0), F.col("raw") + more))
    rows = cand.join(told, "source", "left").withColumn("s", s).where("s >= 0.6")
    return rows.select("id", F.concat(F.lit("confidence "), F.round("s", 1).cast("decimal(3,1)").cast("string")).alias("message"), F.when(F.col("s") >= 0.8, "error").otherwise("warning").alias("severity")).distinct()


@check("orphan_blocks", "info", "block", "extract", f"""WITH {BLOCKS_SQL}, {TRIPLES_SQL}, s AS (SELECT DISTINCT 'src' || (session % 15) AS session FROM triples WHERE NOT is_invalid AND NOT is_deleted)
  ## SELECT b.id, 'no facts of ' || COALESCE(b.session, 'its session') AS message FROM blocks b LEFT JOIN s ON b.session = s.session WHERE s.session IS NULL AND NOT b.is_deleted AND NOT b.is_invalid""")
def orphan_blocks(spark, d):
    """Blocks of sessions without facts, or of none; facts' sessions are told by their order's remainder here."""
    s = valid(triples(spark, d)).select(F.concat(F.lit("src"), (F.col("session") % 15).cast("string")).alias("session")).distinct()
    return valid(blocks(spark, d)).join(s, "session", "left_anti").select("id", F.concat(F.lit("no facts of "), F.coalesce("session", F.lit("its session"))).alias("message"))


@check("dead_triples", "error", "triple", "repoint", linking.ORACLES["dead_facts"].replace("SELECT t.id, CASE WHEN s.id IS NULL AND", "## SELECT t.id, CASE WHEN s.id IS NULL AND").replace("END AS role", "END AS message"))
def dead_triples(spark, d):
    return linking.dead_facts(spark, d).select("id", F.col("role").alias("message"))


@check("stale_claims", "warning", "triple", "resolve", f"WITH {CONTRADICTING_SQL} ## SELECT DISTINCT p.a AS id, 'open for 30 days or more against ' || p.b AS message FROM pairs p JOIN c x ON p.a = x.id JOIN c y ON p.b = y.id WHERE abs(date_diff('day', CAST(x.created_at AS DATE), CAST(y.created_at AS DATE))) >= 30")
def stale_claims(spark, d):
    """Contradictions that have stood for thirty days."""
    at = valid(claims(spark, d)).select("id", F.to_date("created_at").alias("day"))
    rows = contradicting(spark, d).join(at.toDF("a", "da"), "a").join(at.toDF("b", "db"), "b").where(F.abs(F.datediff("da", "db")) >= 30)
    return rows.select(F.col("a").alias("id"), F.concat(F.lit("open for 30 days or more against "), F.col("b").cast("string")).alias("message")).distinct()


#: Names as they are written: two to four words with capitals, or a word with capitals within.
NAMES = r"\p{Lu}\p{Ll}{2,}(?:\s+\p{Lu}\p{Ll}{2,}){1,3}|\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)+"


@check("missing_entities", "info", "name", "create", f"""WITH {TEXTS_SQL}, {ENTITIES_SQL}, x AS (SELECT id, text AS t FROM texts UNION ALL SELECT doc_id + 10000000, text FROM documents),
  n AS (SELECT id, unnest(regexp_extract_all(t, {sql_text(NAMES)})) AS name FROM x UNION ALL SELECT id, unnest(flatten(list_transform(regexp_extract_all(t, '{text.HAN}{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))) AS name FROM x),
  m AS (SELECT name, COUNT(DISTINCT id) AS n FROM n WHERE name NOT IN ({', '.join(map(sql_text, text.STOPWORDS_ZH))}) GROUP BY 1)
  ## SELECT m.name AS id, 'in ' || m.n || ' blocks' AS message FROM m LEFT JOIN entities e ON lower(m.name) = lower(e.name) OR m.name = e.alias WHERE m.n >= 2 AND e.id IS NULL""")
def missing_entities(spark, d):
    """Names, and pairs of Han characters, that two blocks or more mention and no entity has."""
    x = texts(spark, d).select("id", F.col("text").alias("t")).unionByName(raw(spark, d, "documents").select((F.col("doc_id") + 10_000_000).alias("id"), F.col("text").alias("t")))
    runs = F.regexp_extract_all("t", F.lit(f"({text.HAN}{{2,}})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    names = x.select("id", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("t", F.lit(NAMES), F.lit(0)), pairs))).alias("name")).where(~F.col("name").isin(*text.STOPWORDS_ZH))
    met = names.distinct().groupBy("name").agg(F.count("*").alias("n")).where("n >= 2")
    e = entities(spark, d)
    known = e.select(F.lower("name").alias("k")).unionByName(e.select(F.lower("alias").alias("k"))).distinct()
    return met.join(known, F.lower("name") == F.col("k"), "left_anti").select(F.col("name").alias("id"), F.concat(F.lit("in "), F.col("n").cast("string"), F.lit(" blocks")).alias("message"))


@check("missing_cross_refs", "info", "block", "link", linking.ORACLES["missing_cross_refs"].replace("SELECT id, name FROM m WHERE k <= 5", "## SELECT id, 'mentions ' || name AS message FROM m WHERE k <= 5"))
def missing_cross_refs(spark, d):
    return linking.missing_cross_refs(spark, d).select("id", F.concat(F.lit("mentions "), "name").alias("message"))


@check("metadata_gaps", "warning", "block", "backfill", f"""WITH {BLOCKS_SQL}, x AS (SELECT id, CASE WHEN id % 23 = 0 THEN '  ' ELSE session END AS session, CASE WHEN id % 41 = 0 THEN NULL ELSE block_type END AS kind, id % 29 = 0 AS untagged FROM blocks WHERE NOT is_deleted AND NOT is_invalid),
  g AS (SELECT id, array_to_string(list_filter([CASE WHEN kind IS NULL THEN 'block_type' END, CASE WHEN session IS NULL OR trim(session) = '' THEN 'session' END, CASE WHEN kind = 'knowledge' AND untagged THEN 'tags(empty)' END], lambda v: v IS NOT NULL), ', ') AS gaps FROM x)
  ## SELECT id, 'missing ' || gaps AS message FROM g WHERE gaps <> ''""")
def metadata_gaps(spark, d):
    """Blocks that lack a field, or knowledge without tags; some are taken away here, as the given blocks have all."""
    i = F.col("id")
    rows = valid(blocks(spark, d)).select("id", F.when(i % 23 == 0, "  ").otherwise(F.col("session")).alias("session"), F.when(i % 41 != 0, F.col("block_type")).alias("kind"), F.when(i % 29 == 0, F.array().cast("array<string>")).otherwise(F.col("tags")).alias("tags"))
    gaps = F.array_compact(F.array(F.when(F.col("kind").isNull(), "block_type"), F.when(F.col("session").isNull() | (F.trim("session") == ""), "session"), F.when((F.col("kind") == "knowledge") & (F.size("tags") == 0), "tags(empty)")))
    return rows.withColumn("gaps", gaps).where(F.size("gaps") > 0).select("id", F.concat(F.lit("missing "), F.array_join("gaps", ", ")).alias("message"))


@check("empty_content", "warning", "block", "delete", f"WITH {BLOCKS_SQL} ## SELECT id, length(trim(COALESCE(content, ''))) || ' characters' AS message FROM blocks WHERE NOT is_deleted AND length(trim(COALESCE(content, ''))) < 20")
def empty_content(spark, d):
    n = F.length(F.trim(F.coalesce("content", F.lit(""))))
    return live(blocks(spark, d)).where(n < 20).select("id", F.concat(n.cast("string"), F.lit(" characters")).alias("message"))


@check("stale_index_entries", "warning", "community", "rebuild", linking.ORACLES["stale_members"].replace("SELECT community, dead, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY n) AS first FROM", "## SELECT community AS id, dead || ' dead, as ' || string_agg(CAST(entity AS VARCHAR), ',' ORDER BY n) AS message FROM").replace("GROUP BY 1, 2", "GROUP BY community, dead"))
def stale_index_entries(spark, d):
    return linking.stale_members(spark, d).select(F.col("community").alias("id"), F.concat(F.col("dead").cast("string"), F.lit(" dead, as "), "first").alias("message"))


@check("stable_id_validity", "error", "block", "rename", "WITH x AS (SELECT CASE WHEN doc_id % 31 = 0 THEN 'block-' || doc_id WHEN doc_id % 37 = 0 THEN md5(CAST(doc_id - 1 AS VARCHAR)) ELSE md5(CAST(doc_id AS VARCHAR)) END AS id FROM documents), n AS (SELECT id, COUNT(*) AS n FROM x GROUP BY 1) ## SELECT id, CASE WHEN NOT regexp_matches(id, '^[0-9a-f]{32}$') THEN 'not 32 hex digits' ELSE n || ' rows' END AS message FROM n WHERE NOT regexp_matches(id, '^[0-9a-f]{32}$') OR n > 1")
def stable_id_validity(spark, d):
    """Ids that aren't 32 small hex digits, or that several rows have; some are spoilt here."""
    i = F.col("doc_id")
    own = F.when(i % 31 == 0, F.concat(F.lit("block-"), i.cast("string"))).when(i % 37 == 0, F.md5((i - 1).cast("string"))).otherwise(F.md5(i.cast("string")))
    n = raw(spark, d, "documents").select(own.alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    good = F.rlike("id", F.lit("^[0-9a-f]{32}$"))
    return n.where(~good | (F.col("n") > 1)).select("id", F.when(~good, "not 32 hex digits").otherwise(F.concat(F.col("n").cast("string"), F.lit(" rows"))).alias("message"))


@check("semantic_tiling_dedup", "info", "block", "merge", linking.ORACLES["semantic_tiling"].replace("SELECT a.id AS a, b.id AS b, ROUND(", "## SELECT a.id AS id, 'like ' || b.id AS message, ROUND("))
def semantic_tiling_dedup(spark, d):
    return linking.semantic_tiling(spark, d).select(F.col("a").alias("id"), F.concat(F.lit("like "), F.col("b").cast("string")).alias("message"))


# ------------------------------------------------------------------ runs and reports
def run(spark, d, only: list[str] | None = None, isolated: bool = False) -> DataFrame:
    """The findings of the checks. Isolated, each is carried out by itself, and one that fails gives a finding that says so."""
    out = []
    for name in only or CHECKS:
        try:
            found = CHECKS[name](spark, d)
            out.append(saved(found) if isolated else found)
        except Exception as problem:  # noqa: BLE001  a check that fails must not hide the others
            if not isolated:
                raise
            out.append(spark.createDataFrame([(name, "error", "", "system", f"check failed: {type(problem).__name__}", "investigate")], "check_name string, severity string, entity_id string, entity_type string, message string, action string"))
    return reduce(DataFrame.unionByName, out)


ALL_SQL = " UNION ALL ".join(f"SELECT check_name, severity FROM ({s}) f{k}" for k, s in enumerate(FINDINGS.values()))


@query("health_summary", f"SELECT check_name, severity, COUNT(*) AS n FROM ({ALL_SQL}) x GROUP BY 1, 2")
def health_summary(spark, d):
    return run(spark, d).groupBy("check_name", "severity").agg(F.count("*").alias("n"))


@query("health_report", f"""WITH s AS (SELECT check_name, CASE severity WHEN 'error' THEN '## Critical' WHEN 'warning' THEN '## Warnings' ELSE '## Suggestions' END AS section, COUNT(*) AS n FROM ({ALL_SQL}) x GROUP BY 1, 2)
  SELECT section, string_agg('- [' || check_name || '] ' || n, chr(10) ORDER BY check_name) AS body FROM s GROUP BY 1""")
def health_report(spark, d):
    """The sections of a report in Markdown; markdown() puts them together."""
    section = F.when(F.col("severity") == "error", "## Critical").when(F.col("severity") == "warning", "## Warnings").otherwise("## Suggestions")
    s = health_summary(spark, d).groupBy("check_name", section.alias("section")).agg(F.sum("n").alias("n"))
    line = F.struct("check_name", F.concat(F.lit("- ["), "check_name", F.lit("] "), F.col("n").cast("string")).alias("line"))
    return s.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))


def markdown(sections: DataFrame) -> str:
    """A report's text; a section without findings says so."""
    found = {r.section: r.body for r in sections.collect()}
    return "\n\n".join(["# Health report", *[f"{s}\n{found.get(s, '_None_')}" for s in ("## Critical", "## Warnings", "## Suggestions")]]) + "\n"


@query("remedied_facts", f"WITH {TRIPLES_SQL}, f AS ({FINDINGS['stale']}) SELECT t.id, t.is_invalid OR f.entity_id IS NOT NULL AS is_invalid, CASE WHEN f.entity_id IS NOT NULL THEN 'stale' END AS reason FROM triples t LEFT JOIN f ON CAST(t.id AS VARCHAR) = f.entity_id")
def remedied_facts(spark, d):
    """Facts after what the check on stale ones found is invalidated."""
    found = CHECKS["stale"](spark, d).select(F.col("entity_id").cast("long").alias("id"), F.lit("stale").alias("reason"))
    return triples(spark, d).join(found, "id", "left").select("id", (F.col("is_invalid") | F.col("reason").isNotNull()).alias("is_invalid"), "reason")


@query("remedied_entities", f"WITH {CANONICALS_SQL}, f AS ({FINDINGS['orphan_entities']}) SELECT c.id FROM canonicals c LEFT JOIN f ON c.id = f.entity_id WHERE f.entity_id IS NULL")
def remedied_entities(spark, d):
    """Entities without the orphans."""
    return canonicals(spark, d).join(CHECKS["orphan_entities"](spark, d).select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


@query("cascaded_access", f"WITH {BLOCKS_SQL}, w AS (SELECT id, access_count, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) AS w FROM blocks WHERE NOT is_deleted) SELECT w.id, CASE WHEN len(list_intersect(w.w, o.w)) >= 3 AND w.id <> o.id THEN w.access_count // 2 ELSE w.access_count END AS access_count FROM w, w o WHERE o.id = 13")
def cascaded_access(spark, d):
    """After a block is invalidated, blocks that share three words with it count for half."""
    w = live(blocks(spark, d)).select("id", "access_count", text.word_set(F.col("content")).alias("w"))
    gone = F.broadcast(w.where("id = 13").select(F.col("id").alias("o"), F.col("w").alias("ow")))  # one row
    near = (F.size(F.array_intersect("w", "ow")) >= 3) & (F.col("id") != F.col("o"))
    return w.crossJoin(gone).select("id", F.when(near, F.floor(F.col("access_count") / 2)).otherwise(F.col("access_count")).alias("access_count"))


@query("remedied_blocks", f"WITH {BLOCKS_SQL}, f AS ({FINDINGS['semantic_contradictions']}), p AS (SELECT least(CAST(entity_id AS BIGINT), CAST(regexp_extract(message, '([0-9]+)', 1) AS BIGINT)) AS id, MAX(greatest(CAST(entity_id AS BIGINT), CAST(regexp_extract(message, '([0-9]+)', 1) AS BIGINT))) AS newer FROM f GROUP BY 1) SELECT b.id, b.is_invalid OR p.id IS NOT NULL AS is_invalid, CASE WHEN b.is_invalid THEN NULL ELSE p.newer END AS superseded_by FROM blocks b LEFT JOIN p ON b.id = p.id")
def remedied_blocks(spark, d):
    """Blocks after those that a newer one of nearly the same meaning has evolved from are invalidated; one that is invalid
    already stays as it is."""
    other = F.regexp_extract("message", "([0-9]+)", 1).cast("long")
    f = CHECKS["semantic_contradictions"](spark, d).select(F.col("entity_id").cast("long").alias("a"), other.alias("b"))
    p = f.groupBy(F.least("a", "b").alias("id")).agg(F.max(F.greatest("a", "b")).alias("newer"))
    return blocks(spark, d).join(p, "id", "left").select("id", (F.col("is_invalid") | F.col("newer").isNotNull()).alias("is_invalid"), F.when(~F.col("is_invalid"), F.col("newer")).alias("superseded_by"))
