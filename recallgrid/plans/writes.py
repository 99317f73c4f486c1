"""Sources and sinks: pages, scrolls, ingests, writes that replace or merge, blobs, indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.functions import scopes, text
from recallgrid.operators import tables as ops
from recallgrid.operators.graph import shared_path
from recallgrid.plans.registry import query
from recallgrid.plans.routing import INJECTION_SQL, NOISE_SQL
from recallgrid.schema import BLOCK_TYPE_ALIASES, BLOCK_TYPES, live
from recallgrid.sources.tables import BLOCKS_SQL, CLAIMS_SQL, COMMUNITIES_SQL, ENTITIES_SQL, JOURNAL_SQL, TEXTS_SQL, TRIPLES_SQL, blocks, claims, communities, entities, journal, raw, texts, triples, vectors


@query("list_envelope", f"WITH {BLOCKS_SQL}, b AS (SELECT id, age_days FROM blocks WHERE NOT is_deleted) SELECT id, age_days, (SELECT COUNT(*) FROM b) AS total, 2 AS page, 20 AS page_size FROM b ORDER BY age_days, id LIMIT 20 OFFSET 20")
def list_envelope(spark, d):
    """A page of live blocks with the total that its envelope names."""
    rows = live(blocks(spark, d)).select("id", "age_days")
    page = ops.page(rows, [F.col("age_days"), F.col("id")], 2, 20)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("*", F.lit(2).alias("page"), F.lit(20).alias("page_size"))  # one row


@query("vector_scroll", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id > 49 ORDER BY vec_id LIMIT 100")
def vector_scroll(spark, d):
    """The page of a collection that follows a cursor."""
    return vectors(spark, d).where("id > 49").orderBy("id").limit(100).select("id", "label")


@query("json_ingest", "SELECT event_id AS id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_ingest(spark, d):
    """Rows from JSON texts, of which some stand in fences or between other words."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" Done."))).otherwise(F.col("props"))
    rows = raw(spark, d, "events").select(F.col("event_id").alias("id"), wrapped.alias("body"))
    return rows.select("id", F.from_json(text.outermost_json(F.col("body")), "k long")["k"].alias("k"))


@query("transcript_tail", "WITH r AS (SELECT conv_id, turn, role, length(text) AS n, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role, n FROM r WHERE k <= 3")
def transcript_tail(spark, d):
    """The last three turns of each transcript."""
    rows = raw(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return ops.first_by(rows, ["conv_id"], [F.desc("turn")], 3)


RAW_TYPES = (*BLOCK_TYPE_ALIASES, *BLOCK_TYPES, "bogus")
ALIAS_SQL = "CASE raw " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in BLOCK_TYPE_ALIASES.items()) + " " + " ".join(f"WHEN '{t}' THEN '{t}'" for t in BLOCK_TYPES) + " END"


@query("create_blocks", f"WITH x AS (SELECT doc_id AS id, [{', '.join(repr(t) for t in RAW_TYPES)}][CAST(doc_id % {len(RAW_TYPES)} + 1 AS INTEGER)] AS raw FROM documents) SELECT id, raw, {ALIAS_SQL} AS block_type, CASE WHEN ({ALIAS_SQL}) IS NULL THEN 'invalid_block_type' ELSE 'created' END AS outcome FROM x")
def create_blocks(spark, d):
    """New blocks with their type by its canonical name; an unknown type is refused."""
    names = F.array(*map(F.lit, RAW_TYPES))
    known = F.create_map(*[F.lit(x) for pair in (BLOCK_TYPE_ALIASES | {t: t for t in BLOCK_TYPES}).items() for x in pair])
    rows = raw(spark, d, "documents").select(F.col("doc_id").alias("id"), F.element_at(names, (F.col("doc_id") % len(RAW_TYPES) + 1).cast("int")).alias("raw"))
    rows = rows.withColumn("block_type", F.try_element_at(known, F.col("raw")))
    return rows.withColumn("outcome", F.when(F.col("block_type").isNull(), "invalid_block_type").otherwise("created"))


@query("ensure_entities", f"WITH {ENTITIES_SQL}, old AS (SELECT name, MIN(id) AS id FROM entities WHERE id % 2 = 0 GROUP BY 1), wanted AS (SELECT name FROM entities UNION SELECT s_name AS name FROM supplier) SELECT w.name, o.id AS id, o.id IS NULL AS created FROM wanted w LEFT JOIN old o ON w.name = o.name")
def ensure_entities(spark, d):
    """Get or create by name: the id that is known, and whether one has to be made."""
    e = entities(spark, d)
    wanted = e.select("name").unionByName(raw(spark, d, "supplier").select(F.col("s_name").alias("name")))
    found = ops.ensure(e.where("id % 2 = 0"), wanted, ["name"])
    return found.select("name", F.when(~F.col("created"), F.col("id")).alias("id"), "created")


@query("batch_insert_dedup", f"""WITH {TRIPLES_SQL}, {CLAIMS_SQL}, old AS (SELECT DISTINCT subject, predicate, object FROM claims WHERE session % 2 = 0),
  firsts AS (SELECT subject, predicate, object, MIN(id) AS id FROM claims WHERE session % 2 = 1 GROUP BY 1, 2, 3)
  SELECT f.id, f.subject, f.predicate, f.object FROM firsts f LEFT JOIN old o ON f.subject = o.subject AND f.predicate = o.predicate AND f.object = o.object WHERE o.subject IS NULL""")
def batch_insert_dedup(spark, d):
    """What a batch adds to facts that are there already: the first of equal rows, none that is known."""
    rows, keys = claims(spark, d).select("id", "session", "subject", "predicate", "object"), ["subject", "predicate", "object"]
    old = rows.where("session % 2 = 0").select(*keys).distinct()
    new = rows.where("session % 2 = 1").groupBy(*keys).agg(F.min("id").alias("id"))
    return new.join(old, keys, "left_anti").select("id", *keys)


@query("replace_partition", f"WITH {TRIPLES_SQL} SELECT predicate, COUNT(*) AS n FROM triples WHERE predicate <> 'R' OR (NOT is_invalid AND NOT is_deleted) GROUP BY 1")
def replace_partition(spark, d):
    """A table by predicate in which one partition is written anew and the others stay as they are."""
    path = shared_path(spark, "partitions")
    rows = triples(spark, d).select("id", "predicate", "is_invalid", "is_deleted")
    rows.write.partitionBy("predicate").parquet(path)
    ops.replace_partition(path, rows.where("predicate = 'R' and not is_invalid and not is_deleted"), "predicate")
    return spark.read.schema(rows.schema).parquet(path).groupBy("predicate").agg(F.count("*").alias("n"))


#: Summaries of communities: a text for each, told by the community's name.
SUMMARIES_SQL = "summaries AS (SELECT 'summary of ' || name AS id, id AS community, name, size FROM communities WHERE level = 1)"


def summaries(spark, d):
    return communities(spark, d).where("level = 1").select(F.concat(F.lit("summary of "), "name").alias("id"), F.col("id").alias("community"), "name", "size")


@query("rekey_summaries", f"WITH {COMMUNITIES_SQL}, {SUMMARIES_SQL}, fresh AS (SELECT 'new ' || id AS id, name FROM communities WHERE level = 1 AND size % 3 <> 0) SELECT s.id, f.id AS community FROM summaries s JOIN fresh f ON s.name = f.name")
def rekey_summaries(spark, d):
    """After all communities of a space are replaced, summaries stay with those that go by the same name."""
    fresh = communities(spark, d).where("level = 1 and size % 3 <> 0").select(F.concat(F.lit("new "), "id").alias("community"), "name")
    return summaries(spark, d).drop("community").join(fresh, "name").select("id", "community")


@query("replace_summaries", f"WITH {COMMUNITIES_SQL}, {SUMMARIES_SQL} SELECT id, community, CASE WHEN size % 2 = 0 THEN size + 1000 ELSE size END AS size FROM summaries")
def replace_summaries(spark, d):
    """New summaries of given communities in the place of their old ones; all others stay."""
    old = summaries(spark, d).select("id", "community", "size")
    return ops.replace_for_keys(old, old.withColumn("size", F.col("size") + 1000), old.where("size % 2 = 0"), ["community"])


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
UUID_SQL = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 + 1 AS INTEGER)] || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query("vector_upsert", f"""WITH e AS (SELECT vec_id, label, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('vault:' || vec_id)) AS h FROM embeddings)
  SELECT {UUID_SQL} AS point, vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM e WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""")
def vector_upsert(spark, d):
    """Points of an index by a UUID of their service and entity: new ones take the place of old ones."""
    rows = vectors(spark, d).select(ops.uuid5(NAMESPACE, F.concat(F.lit("vault:"), F.col("id").cast("string"))).alias("point"), "id", "label")
    return ops.upsert(rows.where("id % 2 = 0"), rows.where("id % 3 = 0").withColumn("label", F.col("label") + 100), ["point"])


@query("vector_delete", "SELECT vec_id AS id FROM embeddings WHERE label IS NULL OR label <> 3")
def vector_delete(spark, d):
    v = vectors(spark, d)
    return v.join(v.where("label = 3").select("id"), "id", "left_anti").select("id")


@query("blob_verify", "SELECT doc_id AS id, sha256(text) AS digest, doc_id % 50 <> 7 AS sound FROM documents")
def blob_verify(spark, d):
    """Blobs written compressed, read back and held against the digest that was kept of them; some are damaged on the way."""
    path = shared_path(spark, "blobs")
    rows = raw(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.sha2("text", 256).alias("digest"))
    damaged = F.when(F.col("id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows.withColumn("text", damaged).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select("id", "digest", (F.sha2("text", 256) == F.col("digest")).alias("sound"))


@query("thaw_blocks", f"WITH {BLOCKS_SQL} SELECT id, length(content) AS n_chars, id % 50 <> 7 AS sound FROM blocks WHERE age_days > 350")
def thaw_blocks(spark, d):
    """Frozen blocks fetched by the path of their blob, verified and parsed."""
    frozen = blocks(spark, d).where("age_days > 350").select("id", F.concat(F.lit("blobs/"), F.col("id").cast("string")).alias("path"), F.sha2(F.to_json(F.struct("id", "content")), 256).alias("digest"))
    stored = blocks(spark, d).select(F.concat(F.lit("blobs/"), F.col("id").cast("string")).alias("path"), F.to_json(F.struct("id", "content")).alias("body"))
    stored = stored.withColumn("body", F.when(F.col("path").rlike("[05]7$|^blobs/7$"), F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    rows = frozen.join(stored, "path").withColumn("sound", F.sha2("body", 256) == F.col("digest"))
    return rows.select("id", F.length(F.from_json("body", "id long, content string")["content"]).alias("n_chars"), "sound")


@query("cache_keys", f"WITH {JOURNAL_SQL} SELECT DISTINCT 'journal:' || intent || ':' || session || ':' || md5(entity_id || '|' || verdict) AS key FROM journal")
def cache_keys(spark, d):
    j = journal(spark, d)
    return j.select(ops.cache_key("journal", F.col("intent"), F.col("session").cast("string"), F.col("entity_id").cast("string"), F.col("verdict")).alias("key")).distinct()


@query("reindex_batches", "SELECT CAST(floor(d.doc_id / 50) AS BIGINT) AS batch, COUNT(*) AS n FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL GROUP BY 1")
def reindex_batches(spark, d):
    """Blocks that no index has, in batches of fifty ids at most."""
    missing = raw(spark, d, "documents").select(F.col("doc_id").alias("id")).join(vectors(spark, d).select("id"), "id", "left_anti")
    return missing.groupBy(F.floor(F.col("id") / 50).alias("batch")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ projections, predicates, gates
@query("block_response", f"WITH {BLOCKS_SQL} SELECT id, COALESCE(session, '') AS session, COALESCE(confidence, 0.0) AS confidence, CASE WHEN lang IS NULL THEN '' ELSE lang || ',' || session END AS tags FROM blocks WHERE NOT is_deleted")
def block_response(spark, d):
    return live(blocks(spark, d)).select("id", F.coalesce("session", F.lit("")).alias("session"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.array_join(F.coalesce("tags", F.array()), ",").alias("tags"))


@query("alias_lookup", f"WITH {ENTITIES_SQL} SELECT id, name FROM entities WHERE alias = 'Brand#2' OR upper(name) = 'Brand#2'")
def alias_lookup(spark, d):
    e = entities(spark, d).withColumn("aliases", F.array("alias", F.upper("name")))
    return e.where(F.array_contains("aliases", "Brand#2")).select("id", "name")


@query("multi_term_search", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE (contains(lower(content), 'the') OR contains(lower(session), 'the')) AND (contains(lower(content), 'src1') OR contains(lower(session), 'src1')) AND NOT is_deleted")
def multi_term_search(spark, d):
    """Every term in one column or another; terms are literal, so % and _ stand for themselves."""
    rows = live(blocks(spark, d))
    for term in ("the", "SRC1"):
        rows = rows.where(text.contains_any(F.col("content"), [term]) | text.contains_any(F.col("session"), [term]))
    return rows.select("id")


@query("multi_term_search_han", f"WITH {TEXTS_SQL} SELECT id FROM texts WHERE contains(text, '之前') AND contains(text, '討論') UNION SELECT id FROM texts WHERE contains(text, '架構') AND contains(text, '規劃')")
def multi_term_search_han(spark, d):
    t = texts(spark, d)
    found = [t.where(text.contains_all(F.col("text"), terms)) for terms in (["之前", "討論"], ["架構", "規劃"])]
    return found[0].unionByName(found[1]).select("id").distinct()


@query("full_text_match", f"WITH {BLOCKS_SQL}, w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS w FROM blocks WHERE NOT is_deleted) SELECT id FROM w WHERE w IN ('license', 'licenses') INTERSECT SELECT id FROM w WHERE w IN ('mit', 'mits')")
def full_text_match(spark, d):
    """Blocks that have every stem of the query's words."""
    wanted = F.array_distinct(text.tokens(F.lit("the MIT licenses")))
    return live(blocks(spark, d)).where(F.size(F.array_except(wanted, text.tokens(F.col("content")))) == 0).select("id")


@query("scope_filter", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE session = 'src1' AND block_type = 'attitude' AND NOT is_deleted UNION ALL SELECT id FROM blocks WHERE id % 150 = 7 AND NOT is_deleted")
def scope_filter(spark, d):
    """Blocks of a session and type, then those of a user, by scopes as they are written."""
    rows = live(blocks(spark, d)).withColumn("user_id", F.col("id") % 150)
    return rows.where(scopes.within("global,session:src1,type:attitude")).unionByName(rows.where(scopes.within("user:7"))).select("id")


@query("review_pending", f"WITH {BLOCKS_SQL} SELECT id FROM blocks WHERE id % 11 = 3 AND NOT is_deleted")
def review_pending(spark, d):
    return pending(blocks(spark, d)).select("id")


def pending(rows):
    """Live rows that wait for a review; each eleventh block does."""
    rows = rows.withColumn("superseded_by", F.when(F.col("id") % 11 == 3, "__pending__"))
    return live(rows).where(F.col("superseded_by") == "__pending__")


_ALL_SQL = f"{TEXTS_SQL}, x AS (SELECT id, text AS raw_text, trim(text) AS t FROM texts UNION ALL SELECT doc_id + 10000000 AS id, text AS raw_text, trim(text) AS t FROM documents)"


def _all_texts(spark, d):
    return texts(spark, d).unionByName(raw(spark, d, "documents").select((F.col("doc_id") + 10_000_000).alias("id"), "text"))


@query("quarantine_tags", f"WITH {_ALL_SQL} SELECT id, array_to_string(list_filter([CASE WHEN ({NOISE_SQL}) IS NOT NULL THEN '__quarantined__' END, '_quarantine:injection:' || ({INJECTION_SQL})], lambda v: v IS NOT NULL), ',') AS tags FROM x WHERE ({NOISE_SQL}) IS NOT NULL OR ({INJECTION_SQL}) IS NOT NULL")
def quarantine_tags(spark, d):
    """The tags that keep noise and steering texts aside, each once."""
    noisy, unsafe = text.noise_reason(F.col("text")), text.injection_reason(F.trim("text"))
    tags = F.array_compact(F.array_union(F.array(F.when(noisy.isNotNull(), "__quarantined__")), F.array(F.concat(F.lit("_quarantine:injection:"), unsafe))))
    return _all_texts(spark, d).select("id", F.array_join(tags, ",").alias("tags")).where("tags <> ''")


@query("write_gates", f"""WITH {_ALL_SQL}, g AS (SELECT id, sha256(raw_text) AS h, CASE WHEN ({NOISE_SQL}) IS NOT NULL THEN 'noise' WHEN ({INJECTION_SQL}) IS NOT NULL THEN 'quarantined' END AS gate FROM x),
  f AS (SELECT h, MIN(id) AS first FROM g WHERE gate IS NULL GROUP BY 1)
  SELECT g.id, COALESCE(gate, CASE WHEN f.first = g.id THEN 'created' ELSE 'duplicate' END) AS outcome FROM g LEFT JOIN f ON g.h = f.h""")
def write_gates(spark, d):
    """What becomes of each text: noise first, then steering patterns, then texts that are there already. The first of
    equal texts is found by a map-side combined minimum."""
    rows = _all_texts(spark, d).select("id", F.sha2("text", 256).alias("h"), F.when(text.noise_reason(F.col("text")).isNotNull(), "noise").when(text.injection_reason(F.trim("text")).isNotNull(), "quarantined").alias("gate"))
    first = rows.where("gate is null").groupBy("h").agg(F.min("id").alias("first"))
    outcome = F.coalesce("gate", F.when(F.col("first") == F.col("id"), "created").otherwise("duplicate"))
    return rows.join(first, "h", "left").select("id", outcome.alias("outcome"))


@query("burst_access", f"""WITH {JOURNAL_SQL}, h AS (SELECT entity_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS decade, COUNT(*) AS n FROM journal GROUP BY 1, 2)
  SELECT entity_id, decade, n, ROUND(CAST(least(0.9, 0.3 + 0.12 * n / 20.0) AS DOUBLE), 6) AS severity FROM h WHERE n > 20""")
def burst_access(spark, d):
    """Entities asked for more than twenty times in a window, here of ten days, and how grave that is."""
    window = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 10)
    h = journal(spark, d).groupBy("entity_id", window.alias("decade")).agg(F.count("*").alias("n")).where("n > 20")
    return h.select("entity_id", "decade", "n", F.round(F.least(F.lit(0.9), 0.3 + 0.12 * F.col("n") / 20.0), 6).alias("severity"))


@query("fetch_ranked", "WITH r AS (SELECT doc_id AS id, ROW_NUMBER() OVER (ORDER BY doc_id * 7919 % 1009, doc_id) AS rank FROM documents WHERE doc_id % 100 = 0) SELECT r.id, d.lang, r.rank FROM r JOIN documents d ON r.id = d.doc_id")
def fetch_ranked(spark, d):
    """Rows by a list of ids, in the order of a rank that came from elsewhere."""
    ids = raw(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("id"))
    ranked = ids.withColumn("rank", F.row_number().over(Window.orderBy(F.col("id") * 7919 % 1009, "id")))
    return raw(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang").join(ranked, "id").orderBy("rank")
