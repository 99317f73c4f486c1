"""Event flows, run over the given tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators.graph import shared_path
from recallgrid.plans.registry import query
from recallgrid.plans.routing import NOISE_SQL
from recallgrid.sources.tables import JOURNAL_SQL, blocks, journal
from recallgrid.streaming import flows


def _scratch(spark) -> str:
    return shared_path(spark, "streams")


def _events(spark, d):
    return flows.source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("value").alias("score"))


@query("stream_daily_volume", f"WITH {JOURNAL_SQL} SELECT CAST(ts AS DATE) AS day, COUNT(*) AS volume, ROUND(AVG(score), 3) AS quality FROM journal GROUP BY 1")
def stream_daily_volume(spark, d):
    return flows.run_once(flows.daily_volume(_events(spark, d)), "daily", "update", _scratch(spark), ["day"])


@query("stream_every_fifth", f"WITH {JOURNAL_SQL}, n AS (SELECT session, COUNT(*) AS c FROM journal GROUP BY 1) SELECT session, CAST(unnest(range(1, c // 5 + 1)) * 5 AS BIGINT) AS count FROM n")
def stream_every_fifth(spark, d):
    return flows.run_once(flows.every_nth(_events(spark, d)), "fifth", "append", _scratch(spark))


def _documents(spark, d):
    """documents as they are stored, a stream. Remainders of ids below zero are below zero too: blocks of skill, but for those
    divisible by four; without an id there is no kind."""
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "knowledge").when(k == 1, "attitude").when(k == 3, "general").when(k.isNotNull(), "skill")
    return flows.source(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), kind.alias("block_type"))


@query("stream_stored_facts", f"WITH x AS (SELECT doc_id AS id, lang, source, trim(text) AS t FROM documents) SELECT id, lang AS subject, 'co_occurs_with' AS predicate, source AS object FROM x WHERE ({NOISE_SQL}) IS NULL")
def stream_stored_facts(spark, d):
    """Blocks as they are stored, those worth keeping, their tags in pairs."""
    return flows.run_once(flows.stored_to_facts(_documents(spark, d)), "stored", "append", _scratch(spark))


@query("stream_promoted_facts", f"WITH {JOURNAL_SQL} SELECT j.id AS event, d.lang AS subject, 'co_occurs_with' AS predicate, d.source AS object FROM journal j JOIN documents d ON j.entity_id = d.doc_id WHERE j.intent = 'purchase'")
def stream_promoted_facts(spark, d):
    """Promoted captures joined with the table of blocks; other events are passed over."""
    e = flows.source(spark, d, "events").where("event_type = 'purchase'")
    promoted = e.select(F.col("event_id").alias("event"), F.get_json_object("props", "$.k").cast("long").alias("block_id"))
    return flows.run_once(flows.promoted_to_facts(promoted, blocks(spark, d)), "promoted", "append", _scratch(spark))


@query("stream_digest_blocks", "SELECT 'intelligence:weekly:' || conv_id AS session, 'knowledge' AS block_type, 'intelligence,digest,weekly,system' AS tags, COUNT(DISTINCT conv_id) AS n FROM conversations WHERE role = 'system' GROUP BY 1, 2, 3")
def stream_digest_blocks(spark, d):
    """Digests, here the system's turns, as blocks: one for each session."""
    digests = flows.source(spark, d, "conversations").where("role = 'system'").select(F.col("conv_id").alias("session"), F.col("text").alias("summary"), F.array("role").alias("tags"))
    found = flows.run_once(flows.digests_to_blocks(digests), "digests", "append", _scratch(spark))
    return found.groupBy("session", "block_type", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))


@query("stream_extraction", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'attitude' ELSE 'skill' END AS block_type FROM documents WHERE length(text) >= 50 AND doc_id % 4 <> 3")
def stream_extraction(spark, d):
    """Stored blocks that facts are extracted from."""
    return flows.run_once(flows.stored_to_extract(_documents(spark, d)), "extraction", "append", _scratch(spark)).select("id", "block_type")


def completed(df):
    """Events as completed queries: who asked, how, with how many results, and whether a prefetch was used."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("long")
    return df.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("intent"), F.when(F.col("user_id") % 5 == 0, "ui").otherwise("agent").alias("consumer"), F.when(v > 60, "slow").otherwise("fast").alias("thinking"), (k % 10).alias("results"), (k % 3 == 0).alias("hit"))


@query("stream_prefetch_admission")
def stream_prefetch_admission(spark, d):
    """Which completed queries are followed by a prefetch. What is under way depends on what was admitted before, which SQL
    can't say; tests compare with a plain loop."""
    return flows.run_once(flows.admitted(completed(flows.source(spark, d, "events"))), "admission", "append", _scratch(spark))


@query("prefetch_predictions", f"WITH {JOURNAL_SQL}, r AS (SELECT session, intent, ROW_NUMBER() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS n FROM journal) SELECT session, MIN(intent) AS intent FROM r WHERE n <= 3 GROUP BY 1 HAVING COUNT(DISTINCT intent) = 1 AND COUNT(*) = 3")
def prefetch_predictions(spark, d):
    return flows.predicted(journal(spark, d))


@query("stream_prefetch_metrics", "WITH q AS (SELECT ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, user_id % 5 = 0 OR value > 60 AS skipped FROM events), g AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS queries, COUNT(*) FILTER (NOT skipped) AS prefetches, COUNT(*) FILTER (NOT skipped AND k % 3 = 0) AS hits, COUNT(*) FILTER (skipped) AS skips FROM q GROUP BY 1) SELECT *, ROUND(hits / prefetches, 6) AS hit_rate, ROUND(1 - hits / prefetches, 6) AS waste_rate FROM g")
def stream_prefetch_metrics(spark, d):
    """Counters and rates of prefetches by day; here by the rules that need no state."""
    q = completed(flows.source(spark, d, "events")).withColumn("reason", F.when(F.col("consumer") == "ui", "consumer_ui").when(F.col("thinking") == "slow", "already_slow"))
    return flows.run_once(flows.prefetch_metrics(q), "metrics", "update", _scratch(spark), ["day"])


@query("stream_reduced_state", "WITH e AS (SELECT user_id AS session, event_id, ts, event_type FROM events), l AS (SELECT session, max({'t': ts, 'i': event_id}) AS at FROM e WHERE event_type = 'error' GROUP BY 1) SELECT e.session, COUNT(*) FILTER (event_type = 'click' AND (l.at IS NULL OR {'t': e.ts, 'i': e.event_id} > l.at)) AS state FROM e LEFT JOIN l ON e.session = l.session GROUP BY 1")
def stream_reduced_state(spark, d):
    """Sessions' state reduced from their events: clicks since the last error."""
    return flows.run_once(flows.reduced(completed(flows.source(spark, d, "events"))), "state", "update", _scratch(spark), ["session"])
