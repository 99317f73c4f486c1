"""Graphs as two DataFrames: edges (a, b, weight) and vertices by their ids."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.operators import slices


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder. Where that is unset, a session whose executors are in the driver, as in
    tests, gets a folder made here, and any other an error. What is there goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='recallgrid-')}"
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, so an iteration doesn't carry those before, and a lost
    executor costs only its own tasks."""
    spark = df.sparkSession
    path = shared_path(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def undirected(triples: DataFrame) -> DataFrame:
    """(a < b, weight): the number of facts between each two entities; loops are dropped."""
    pairs = triples.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")).toDF("src", "dst", "weight")


#: Keys that may be broadcast, and rounds between two saved tables.
FEW, SAVE_EVERY = 20_000, 4


def split_join(rows: DataFrame, few: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with few (key, ...; one row for each key), in which a key may have very many rows: the keys with more than
    a share of total, FEW of them at most, are broadcast, so no task gets all rows of one."""
    cap = max(1000, total // FEW)
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > cap).select(key))
    rest = rows.join(hot, key, "left_anti").join(few, key)
    return rows.join(F.broadcast(few.join(hot, key, "left_semi")), key).unionByName(rest)


def pagerank(edges: DataFrame, vertices: DataFrame, rounds: int = 20, damping: float = 0.85, seeds: DataFrame | None = None) -> DataFrame:
    """(id, rank) by power iteration; with seeds, the walk restarts at them alone. What vertices without an edge
    hold is given back by the restart. Arcs are dealt by their source once and kept, so a round moves ranks alone; a lost
    part of them is dealt anew from the table they come from."""
    spark = edges.sparkSession
    arcs = both_ways(edges)
    out = arcs.groupBy("src").agg(F.sum("weight").alias("total"))
    arcs = saved(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    arcs = arcs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").persist()
    start = vertices.select("id").distinct()
    start = start.join(seeds.select("id").distinct().withColumn("_s", F.lit(1.0)), "id", "left").fillna(0.0, ["_s"]) if seeds is not None else start.withColumn("_s", F.lit(1.0))
    total = start.agg(F.sum("_s")).first()[0] or 1.0
    start = saved(start.select("id", (F.col("_s") / total).alias("restart")))
    rank = start.select("id", F.col("restart").alias("rank"))
    alone = saved(start.join(out.select(F.col("src").alias("id")), "id", "left_anti").select("id"))
    stuck = alone.limit(1).count() > 0
    for turn in range(1, rounds + 1):
        flow = arcs.join(rank, arcs["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        moved = start.join(flow, start["id"] == flow["dst"], "left").select("id", "restart", F.coalesce("flow", F.lit(0.0)).alias("flow"))
        lost = (rank.join(alone, "id", "left_semi").agg(F.sum("rank")).first()[0] or 0.0) if stuck else 0.0
        rank = moved.select("id", (F.col("restart") * (1 - damping + damping * lost) + damping * F.col("flow")).alias("rank"))
        rank = saved(rank) if stuck or turn % SAVE_EVERY == 0 or turn == rounds else rank
    arcs.unpersist()
    return rank


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Labels spread to neighbours and then jump to the label of
    their label, so the number of rounds grows with the logarithm of the longest path."""
    arcs = saved(both_ways(edges.withColumn("weight", F.lit(1.0))).select("src", "dst"))
    label = saved(vertices.select("id", F.col("id").alias("component")).distinct())
    total = label.count()
    while True:
        near = arcs.join(label, arcs["dst"] == label["id"]).groupBy("src").agg(F.min("component").alias("least"))
        spread = label.join(near, label["id"] == near["src"], "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("was"))
        spread = saved(spread)
        target = spread.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = saved(split_join(spread, target, "component", total).select("id", F.least("component", "root").alias("component"), "was"))
        label = jumped.select("id", "component")
        if not jumped.where("component <> was").limit(1).count():
            return label


def communities(edges: DataFrame, vertices: DataFrame, resolution: float = 1.0, rounds: int = 10, within: str | None = None) -> DataFrame:
    """(id, community) by modularity: in each round a vertex may move to the neighbouring community of the
    largest gain w(v, c) - resolution * k(v) * K(c) / 2m; a half of the vertices, drawn by hash anew each time, may
    move at once, so two neighbours don't swap for ever. Communities are named by their smallest member at the end.
    within: a column of edges; 2m is then the weight of the edges with the same value, not of all."""
    scope = F.col(within) if within else F.lit(0)
    edges = edges.select("a", "b", "weight", scope.alias("scope"))
    arcs = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "scope")).toDF("src", "dst", "weight", "scope"))
    total = arcs.groupBy("scope").agg(F.sum("weight").alias("double_m"))
    degree = arcs.groupBy("src", "scope").agg(F.sum("weight").alias("k")).withColumnRenamed("src", "id")
    degree = saved(degree.join(total, "scope").select("id", "k", "double_m"))
    now = saved(vertices.select("id").distinct().withColumn("community", F.col("id")))
    many = now.count()
    for turn in range(rounds):
        mass = now.join(degree, "id").groupBy("community").agg(F.sum("k").alias("mass"))
        # a neighbouring community counts once for each vertex, with its mass, which goes along with the neighbours
        heavy = saved(split_join(now, mass, "community", many))
        pull = arcs.join(heavy.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"), F.first("mass").alias("mass"))
        own = heavy.join(degree, "id").select("id", F.col("community").alias("own"), "k", "double_m", F.col("mass").alias("own_mass"))
        choice = own.join(pull, "id").unionByName(own.withColumns({"community": F.col("own"), "w": F.lit(0.0), "mass": F.col("own_mass")}))
        choice = choice.groupBy("id", "own", "k", "double_m", "community").agg(F.max("w").alias("w"), F.first("mass").alias("mass"))
        rest = F.col("mass") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - resolution * F.col("k") * rest / F.col("double_m")
        best = choice.groupBy("id").agg(F.max_by("community", F.struct(gain, F.col("community") == F.col("own"), -F.col("community"))).alias("to"))
        may = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
        new = saved(now.join(best, "id", "left").select("id", F.coalesce("to", "community").alias("to"), "community", may.alias("may")))
        now = new.select("id", F.when(F.col("may"), F.col("to")).otherwise(F.col("community")).alias("community"))
        if not new.where("to <> community").limit(1).count():
            break
    named = now.groupBy("community").agg(F.min("id").alias("name"))
    return now.join(named, "community").select("id", F.col("name").alias("community"))


def traverse(triples: DataFrame, start: int, depth: int = 2, limit: int | None = 500) -> DataFrame:
    """(id, subject, predicate, object, depth): facts within `depth` steps of an entity, each with its least
    depth; the first `limit` by id, or all if there is none. A fact is met again only at a greater depth, so paths can't cycle."""
    facts = triples.select("id", "subject", "predicate", "object")
    found = facts.where((F.col("subject") == start) | (F.col("object") == start)).withColumn("depth", F.lit(1))
    seen = found
    for step in range(2, min(depth, 4) + 1):
        ends = seen.where(F.col("depth") == step - 1).select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
        more = facts.join(ends, facts["subject"] == ends["entity"], "left_semi").union(facts.join(ends, facts["object"] == ends["entity"], "left_semi")).distinct()
        seen = saved(seen.union(more.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(step))))
    return seen if limit is None else seen.orderBy("id").limit(limit)


def in_slices(pairs: DataFrame, groups: int) -> DataFrame:
    """pairs (a, b, ...) with (slice, part): vertices fall into groups by their hash, a slice holds the pairs between two groups,
    and its parts are only for dealing them out. Pairs without an end are left out."""
    of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(groups)).cast("int")
    pairs = pairs.where("a is not null and b is not null").withColumns({"_ga": of("a"), "_gb": of("b")})
    part = F.pmod(F.xxhash64(F.col("a").cast("long"), F.lit(1)), F.lit(8)).cast("int")
    return pairs.withColumns({"slice": F.least("_ga", "_gb") * groups + F.greatest("_ga", "_gb"), "part": part, "turned": F.col("_ga") > F.col("_gb")}).drop("_ga", "_gb")


def groups_of(edges: int) -> int:
    """Groups of vertices for so many edges, so a slice has two million arcs or so."""
    return max(4, math.ceil(math.sqrt(edges / (1 << 20))))


def over_slices(edges: DataFrame, groups: int, vertices: DataFrame | None = None, common: bool = True) -> DataFrame:
    """(a, b, weight, adamic_adar if common, and each column x of vertices (id, ...) as x_a and x_b) of edges that in_slices has
    dealt out; each pair stands once, ids are integers, the columns of vertices numbers. The edges are written to the shared
    folder once, slice by slice, and a task takes one slice and reads what it needs of others there, so no neighbourhood
    travels through a shuffle, and disk holds each edge once, whatever the number of common neighbours."""
    spark = edges.sparkSession
    path = shared_path(spark, "slices")
    turned = lambda x, y: F.when(F.col("turned"), F.col(x)).otherwise(F.col(y)).cast("long")
    stored = edges.select("slice", turned("b", "a").alias("u"), turned("a", "b").alias("v"), "turned", F.col("weight").cast("double"))
    stored.sortWithinPartitions("slice", "u", "v").write.partitionBy("slice").parquet(path)
    extra = [c for c in vertices.columns if c != "id"] if vertices is not None else []
    table = vertices
    if common:
        degree = spark.range(0, groups, 1, groups).mapInArrow(slices.degrees(path, groups), "id long, degree long")
        table = degree if table is None else degree.join(table, "id", "left")
    ends = shared_path(spark, "ends")
    table = table.where("id is not null").select(F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(groups)).cast("int").alias("grp"), F.col("id").cast("long"), *[F.col(c).cast("double") for c in ([*extra, "degree"] if common else extra)])
    table.repartition("grp").write.partitionBy("grp").parquet(ends)
    pairs = [(i, j) for i in range(groups) for j in range(i, groups)]
    columns = ["a long", "b long", "weight double", *(["adamic_adar double"] if common else []), *[f"{c}_{e} double" for c in extra for e in "ab"]]
    return spark.range(0, len(pairs), 1, len(pairs)).mapInArrow(slices.over(path, ends, groups, pairs, extra, common), ", ".join(columns))


def shared_sessions(seen: DataFrame) -> DataFrame:
    """(a, b, weight, n_a, n_b) of seen (entity, session), integers: the entities a < b that meet, in how many sessions, and the
    number of sessions of each. Sessions make their pairs where they are dealt to, and pairs are packed by slices, a few bytes
    each, so disk holds each pair once and no row of it; numbers of sessions are read from the shared folder, group by group."""
    seen = seen.where("entity is not null").select(F.col("entity").cast("long"), F.col("session").cast("long"))
    groups = groups_of(2 * seen.count())
    of = F.pmod(F.xxhash64("entity"), F.lit(groups)).cast("int")
    counts = seen.repartition("entity").distinct().groupBy("entity").agg(F.count("*").alias("n"))  # one shuffle for both
    ends = shared_path(seen.sparkSession, "ends")
    counts.select(of.alias("grp"), F.col("entity").alias("id"), "n").repartition("grp").write.partitionBy("grp").parquet(ends)
    rows = seen.where("session is not null").repartition("session").sortWithinPartitions("session", "entity")
    rows = rows.select("session", "entity", of.alias("grp"), F.pmod(F.xxhash64("entity", F.lit(1)), F.lit(8)).cast("int").alias("part"))
    packs = rows.mapInArrow(slices.met, "low int, high int, part int, n long, a binary, b binary")
    return packs.groupBy("low", "high", "part").applyInArrow(slices.weighed(ends), "a long, b long, weight double, n_a long, n_b long")


def dealt(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges in slices, and the number of groups."""
    edges = saved(edges)
    groups = groups_of(edges.count())
    return in_slices(edges, groups).repartition("slice", "part"), groups


def adamic_adar(edges: DataFrame) -> DataFrame:
    """(a, b, adamic_adar) of the pairs of `edges`: sum of 1 / ln(degree) over common neighbours of degree
    over one. Only existing pairs are looked up, so a hub's neighbours are never paired with each other."""
    return over_slices(*dealt(edges)).select("a", "b", "adamic_adar")


def session_jaccard(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(a, b, overlap): shared sessions over all sessions of each pair; seen: (entity, session)."""
    seen = seen.distinct()
    count = seen.groupBy("entity").agg(F.count("*").alias("n"))
    shared = edges.select("a", "b").join(seen.select(F.col("entity").alias("a"), "session"), "a").join(seen.select(F.col("entity").alias("b"), "session"), ["b", "session"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    out = edges.select("a", "b").join(shared, ["a", "b"], "left").join(count.toDF("a", "na"), "a", "left").join(count.toDF("b", "nb"), "b", "left").fillna(0, ["both", "na", "nb"])
    return out.select("a", "b", jaccard(F.col("both"), F.col("na"), F.col("nb")).alias("overlap"))


def jaccard(both: Column, one: Column, other: Column) -> Column:
    total = one + other - both
    return F.when(total > 0, both / total).otherwise(0.0)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """The column stretched to 0..1 over all rows (1 if all are equal), from one map-side combined aggregate."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    out = df.crossJoin(F.broadcast(span))  # one row
    return out.withColumn(column, F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_lo", "_hi")


def chain(spark: SparkSession, pointers: DataFrame, most: int = 10) -> DataFrame:
    """(id, last): where following (id, next) ends, at most `most` steps; a cycle stops where it closes."""
    step = saved(pointers.select("id", F.col("next").alias("last"), F.array("id", "next").alias("path"), F.lit(1).alias("n")))
    hop = pointers.select(F.col("id").alias("_at"), F.col("next").alias("_to"))
    for _ in range(most - 1):
        step = step.join(hop, step["last"] == hop["_at"], "left")
        on = F.col("_to").isNotNull() & ~F.array_contains("path", F.col("_to"))
        step = step.select("id", F.when(on, F.col("_to")).otherwise(F.col("last")).alias("last"), F.when(on, F.concat("path", F.array("_to"))).otherwise(F.col("path")).alias("path"), (F.col("n") + on.cast("int")).alias("n"))
    return step.select("id", "last", "n")


def chain_in_order(rows: DataFrame, group: str, most: int = 10) -> DataFrame:
    """(id, last): as chain, where each row of a group points to the next by id. Rows are told apart by their places, so each of
    several with one id has its own pointer, and one sort of the groups follows all of them. Rows without an id come last;
    nothing points to or from them."""
    order = Window.partitionBy(group).orderBy(F.asc_nulls_last("id"))
    end = F.last("id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = rows.select("id", F.lead("id").over(order).alias("_next"), F.coalesce(F.lead("id", most).over(order), end).alias("last"))
    return found.where("_next is not null").select("id", "last")


#: Bins of one pass over a column in search of its quantiles.
BINS = 4096


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The continuous quantiles of a column: a pass counts it in bins between two values, and the next looks into the bin that
    holds the place, until its values are equal. Rows are never sorted or shuffled, only the counts of bins."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    total, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not total:
        return [None] * len(shares)
    found: dict[int, float] = {}

    def look(places: set[int], before: int, low: float, high: float) -> None:
        if low == high:
            found.update(dict.fromkeys(places, low))
            return
        span = high / BINS - low / BINS
        # a bin's rows are told by its own least and greatest value, so rounding moves no row out of the count
        at = F.least(F.floor((F.col("v") / BINS - low / BINS) / span * BINS), F.lit(BINS - 1)) if span > 0 else F.when(F.col("v") == low, 0).otherwise(1)
        bins = values.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(bins, key=lambda r: r.low):
            mine = {k for k in places if before <= k < before + r.n}
            if mine:
                look(mine, before, r.low, r.high)
            before += r.n

    look({k for q in shares for k in (int(q * (total - 1)), min(total - 1, int(q * (total - 1)) + 1))}, 0, low, high)
    out = []
    for q in shares:
        at = q * (total - 1)
        low, high = found[int(at)], found[min(total - 1, int(at) + 1)]
        out.append(low + (high - low) * (at - int(at)))
    return out


# The resolution of each level of communities, and the least component that is divided.
RESOLUTIONS, DIVIDED = {0: 1.0, 1: 0.3, 2: 0.05}, 5


def levels(edges: DataFrame, resolutions: dict[int, float] | None = None, rounds: int = 5) -> DataFrame:
    """(level, community, id): components of DIVIDED vertices or more are divided by modularity at each level's resolution;
    smaller ones are communities of level 0 as they are; communities of one are left out. Modularity is counted within a
    component, so a component is divided as if it were alone."""
    edges = saved(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    part = saved(components(edges, nodes))
    size = part.groupBy("component").agg(F.count("*").alias("n"))
    sized = saved(part.join(size, "component"))
    small = sized.where(F.col("n") < DIVIDED).select(F.lit(0).alias("level"), F.col("component").alias("community"), "id")
    out = [small]
    large = sized.where(F.col("n") >= DIVIDED)
    if large.limit(1).count():
        inside = saved(edges.join(large.select(F.col("id").alias("a"), "component"), "a"))
        for level, resolution in (resolutions or RESOLUTIONS).items():
            found = communities(inside.select("a", "b", "weight", "component"), large.select("id"), resolution, rounds, within="component")
            many = found.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2").select("community")
            out.append(found.join(many, "community", "left_semi").select(F.lit(level).alias("level"), "community", "id"))
    return reduce(DataFrame.unionByName, out)
