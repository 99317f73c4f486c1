"""Event flows as Structured Streaming programs; each function takes streaming (or batch) rows and gives rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators.graph import saved


def daily_volume(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, volume, quality) of the journal by day; in update mode state is dropped a watermark after a day ends."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    days = events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("volume"), F.round(F.avg("score"), 3).alias("quality"))
    return days.select(F.to_date("window.start").alias("day"), "volume", "quality")


def every_nth(events: DataFrame, n: int = 5) -> DataFrame:
    """(session, count): a row each time a session's count of events reaches a multiple of n. State is one
    counter for each session."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else 0
        now = was + sum(len(b) for b in batches)
        state.update((now,))
        yield pd.DataFrame({"session": [key[0]] * (now // n - was // n), "count": [k * n for k in range(was // n + 1, now // n + 1)]})

    return events.groupBy("session").applyInPandasWithState(run, "session long, count long", "count long", "append", "NoTimeout")


def stored_to_facts(blocks: DataFrame) -> DataFrame:
    """(subject, predicate, object, id) of each stored block that is worth keeping: its tags, pair by pair."""
    rows = blocks.where(text.noise_reason(F.col("content")).isNull()).select("id", F.slice(F.filter("tags", lambda t: ~t.startswith("_")), 1, 5).alias("tags"))
    pairs = F.flatten(F.transform("tags", lambda a, i: F.transform(F.filter("tags", lambda b, j: j > i), lambda b: F.struct(a.alias("subject"), F.lit("co_occurs_with").alias("predicate"), b.alias("object")))))
    return rows.select("id", F.inline(pairs))


def digests_to_blocks(digests: DataFrame) -> DataFrame:
    """One block for each session's digest; a session that comes again gives nothing new."""
    tags = F.array_distinct(F.concat(F.array(F.lit("intelligence"), F.lit("digest"), F.lit("weekly")), "tags"))
    return digests.dropDuplicates(["session"]).select(F.concat_ws(":", F.lit("intelligence"), F.lit("weekly"), F.col("session").cast("string")).alias("session"), F.col("summary").alias("content"), F.lit("knowledge").alias("block_type"), tags.alias("tags"))


def promoted_to_facts(promoted: DataFrame, blocks: DataFrame) -> DataFrame:
    """(event, subject, predicate, object) of promoted captures: their block is fetched from a table, and its tags are paired."""
    met = promoted.join(blocks.select("id", "tags"), promoted["block_id"] == blocks["id"])
    pairs = F.flatten(F.transform("tags", lambda a, i: F.transform(F.filter("tags", lambda b, j: j > i), lambda b: F.struct(a.alias("subject"), F.lit("co_occurs_with").alias("predicate"), b.alias("object")))))
    return met.select("event", F.inline(pairs))


def stored_to_extract(blocks: DataFrame, least: int = 50) -> DataFrame:
    """Stored blocks that facts are extracted from: long enough, and not of the general kind; the extractor is a caller's."""
    return blocks.where((F.length("content") >= least) & (F.col("block_type") != "general")).select("id", "block_type", "content")


#: Seconds for which a query of the same kind counts as under way, and the tries after which a poor rate of hits tells.
UNDER_WAY, LEAST_TRIES, LEAST_RATE = 5.0, 50, 0.05


def admitted(queries: DataFrame) -> DataFrame:
    """(id, session, reason) of completed queries (id, session, ts, intent, consumer, thinking, results, hit): why one isn't
    followed by a prefetch, or null. People at a screen, slow thinking and empty results are passed over; so is a query of a
    kind that is under way, and any once hits are rare. State is one counter of tries and hits, and the last moment of each
    kind, for each session."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tries, hits, kinds, times = state.get if state.exists else (0, 0, [], [])
        last = dict(zip(kinds, times, strict=True))
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            at = r.ts.timestamp()
            if r.consumer == "ui":
                reason = "consumer_ui"
            elif r.thinking == "slow":
                reason = "already_slow"
            elif not r.results:
                reason = "no_results"
            elif at - last.get(r.intent, float("-inf")) < UNDER_WAY:
                reason = "in_flight"
            elif tries > LEAST_TRIES and hits / tries < LEAST_RATE:
                reason = "low_hit_rate"
            else:
                reason, tries, hits = None, tries + 1, hits + int(r.hit)
                last[r.intent] = at
            out.append((r.id, key[0], reason))
        state.update((tries, hits, list(last), list(last.values())))
        yield pd.DataFrame(out, columns=["id", "session", "reason"])

    return queries.groupBy("session").applyInPandasWithState(run, "id long, session long, reason string", "tries long, hits long, kinds array<string>, times array<double>", "append", "NoTimeout")


def predicted(journal: DataFrame) -> DataFrame:
    """(session, intent) of what a session will ask next: the intent of its last three queries, if they agree."""
    order = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("id"))
    last = journal.withColumn("n", F.row_number().over(order)).where("n <= 3")
    return last.groupBy("session").agg(F.min("intent").alias("intent"), F.countDistinct("intent").alias("kinds"), F.count("*").alias("n")).where("kinds = 1 and n = 3").select("session", "intent")


def prefetch_metrics(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, queries, prefetches, hits, skips, hit_rate, waste_rate) by day of (ts, reason, hit)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    tried = F.col("reason").isNull()
    days = events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("queries"), F.count_if(tried).alias("prefetches"), F.count_if(tried & F.col("hit")).alias("hits"), F.count_if(~tried).alias("skips"))
    rate = F.when(F.col("prefetches") > 0, F.col("hits") / F.col("prefetches")).otherwise(0.0)
    waste = F.when(F.col("prefetches") > 0, 1 - F.col("hits") / F.col("prefetches")).otherwise(0.0)
    return days.select(F.to_date("window.start").alias("day"), "queries", "prefetches", "hits", "skips", F.round(rate, 6).alias("hit_rate"), F.round(waste, 6).alias("waste_rate"))


def reduced(events: DataFrame) -> DataFrame:
    """(session, state): events folded to a state in their order: a click counts one, an error starts anew; the rest change
    nothing. A row for each session and batch; the last is its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            now = 0 if r.intent == "error" else now + (r.intent == "click")
        state.update((now,))
        yield pd.DataFrame({"session": [key[0]], "state": [now]})

    return events.groupBy("session").applyInPandasWithState(run, "session long, state long", "state long", "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a streaming program over what its source holds now and gives the rows of its sink. In update mode a batch's rows
    take the place of those with the same keys, so state that a watermark has closed may go."""
    out, spark = f"{checkpoint}/{name}", stream.sparkSession
    if mode == "append":
        started = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
        started.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    last = [f"{out}/rows-empty"]
    spark.createDataFrame([], stream.schema).write.parquet(last[0])

    def put(batch: DataFrame, n: int) -> None:
        old = batch.sparkSession.read.schema(stream.schema).parquet(last[0])
        new = old.join(batch.select(*keys), keys, "left_anti").select(*old.columns).unionByName(batch) if keys else batch
        path = f"{out}/rows-{n}"
        new.write.mode("overwrite").parquet(path)
        last[0] = path

    started = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0])


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, one file or a folder of parts, as a stream. The path is a pattern that matches it alone: a stream takes a
    plain path for a folder's, and a filter of names would pass over the parts in one."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


Operator = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


class Pipeline:
    """Named steps over named DataFrames, each with the names it needs and gives; missing() finds a step whose
    needs nothing before it gives, without running anything."""

    def __init__(self, *steps: tuple[str, set[str], set[str], Operator]) -> None:
        self.steps = steps

    def missing(self, given: set[str]) -> dict[str, set[str]]:
        have, out = set(given), {}
        for name, needs, gives, _ in self.steps:
            if needs - have:
                out[name] = needs - have
            have |= gives
        return out

    def run(self, frames: dict[str, DataFrame], save: bool = False) -> dict[str, DataFrame]:
        if lacking := self.missing(set(frames)):
            raise ValueError(f"steps lack inputs: {lacking}")
        frames = dict(frames)
        for _, needs, _, step in self.steps:
            frames |= {k: saved(v) if save else v for k, v in step({k: frames[k] for k in needs}).items()}
        return frames
