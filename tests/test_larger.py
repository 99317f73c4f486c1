"""What only larger or odd tables show: folders of parts, rows with one id, blanks beyond the plain space, hubs."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import rows_of
from recallgrid.functions import text
from recallgrid.operators import graph, slices
from recallgrid.plans import catalog
from recallgrid.plans.routing import NOISE_SQL


def sql(db, name, cte=""):
    want = db.execute(cte + catalog.ORACLES[name])
    return rows_of([c[0] for c in want.description], want.fetchall())


def plain(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def parts(spark, data, tmp_path, table):
    """The table as a folder of two parts, beside nothing else."""
    spark.read.parquet(f"{data}/{table}.parquet").repartition(2).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_digests_of_a_folder(spark, db, data, tmp_path):
    assert plain(catalog.QUERIES["stream_digest_blocks"](spark, parts(spark, data, tmp_path, "conversations"))) == sql(db, "stream_digest_blocks") != []


def test_extraction_of_a_folder(spark, db, data, tmp_path):
    assert plain(catalog.QUERIES["stream_extraction"](spark, parts(spark, data, tmp_path, "documents"))) == sql(db, "stream_extraction") != []


def test_stored_facts_of_a_folder(spark, db, data, tmp_path):
    assert plain(catalog.QUERIES["stream_stored_facts"](spark, parts(spark, data, tmp_path, "documents"))) == sql(db, "stream_stored_facts") != []


def test_noise_among_blanks(spark, db):
    odd = [f"{a}{t}{b}" for t in ("hm", "understood!!!", "good morning", "An ordinary text.") for a, b in (("\u00a0", ""), ("\u3000 ", "\u2003"), (" ", " \u00a0" * 9), ("\t", ""))]
    got = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", text.noise_reason(F.col("t")).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: db.execute(f"WITH x AS (SELECT trim(?) AS t) SELECT {NOISE_SQL} FROM x", [t]).fetchone()[0] for i, t in enumerate(odd)}


#: Sentences between blanks of several widths and line ends; letters beyond ASCII that fold to it; words between vertical tabs.
TURNS = (
    "\u3000You must keep the log open at night.\u00a0Nothing else was said today!", "We have met.\u2003 I always take the long way home .", "It is not so\rbut rather the other way round, they said",
    "The rule muſt be kept by all of us at home", "step\x0b3 is the one that we have not yet come to", "we never\x0bmind the gap. we never mind the gap", "Turns out that the lamp was not lit last night", "It waſ decided late",
)


def turns(spark, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(k, 1, "user", t) for k, t in enumerate(TURNS)], "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    return str(tmp_path), con


def test_reflected_facts_of_odd_blanks(spark, tmp_path):
    d, con = turns(spark, tmp_path)
    assert plain(catalog.QUERIES["reflected_facts"](spark, d)) == sql(con, "reflected_facts")


def test_reflection_of_odd_blanks(spark, tmp_path):
    d, con = turns(spark, tmp_path)
    assert plain(catalog.QUERIES["reflection"](spark, d)) == sql(con, "reflection")


def test_superseded_chain_of_repeated_ids(spark, data, tmp_path):
    line = spark.read.parquet(f"{data}/lineitem.parquet").where("l_orderkey < 60")
    line.union(line.where("l_orderkey < 40")).union(line.where("l_orderkey < 9")).union(line.where("l_orderkey < 9").withColumn("l_partkey", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert plain(catalog.QUERIES["superseded_chain"](spark, str(tmp_path))) == sql(con, "superseded_chain") != []


def test_common_neighbours_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph.slices, "CANDIDATES", 50)
    monkeypatch.setattr(graph.slices, "MARKS", 100)
    pairs = {(0, k) for k in range(1, 300)} | {(k, 1000) for k in range(0, 300, 3)} | set(combinations(range(290, 320), 2)) | {(-5, 7), (7, 1 << 40)}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    found = graph.adamic_adar(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double"))
    assert "Join" not in found._jdf.queryExecution().toString()  # neighbourhoods travel through no shuffle
    got = {(r.a, r.b): r.adamic_adar for r in found.collect()}
    assert got.keys() == pairs
    assert all(abs(v - sum(1 / math.log(len(near[z])) for z in near[a] & near[b])) < 1e-9 for (a, b), v in got.items())


def test_shared_sessions_are_not_joined_again(spark, data):
    assert "Join" not in catalog.QUERIES["session_jaccard"](spark, data)._jdf.queryExecution().toString()


def test_composite_edges_are_not_joined_with_their_parts(spark, data):
    plan = catalog.QUERIES["composite_edges"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # spans of one row and the table of names' likeness are broadcast


def test_quantiles_shuffle_no_rows(spark):
    df = spark.createDataFrame([(x,) for x in [0.0] * 50 + [1e-9, 2.0, 2.0, 7.5, 1e12]], "v double")
    seen = []
    frame, kept = type(df), type(df).repartitionByRange
    frame.repartitionByRange = lambda self, *a: seen.append(a) or kept(self, *a)
    try:
        assert graph.quantiles(df, "v", [0.5, 0.95, 1.0]) == [0.0, 2.0, 1e12] and not seen
    finally:
        frame.repartitionByRange = kept


def test_pairs_of_sessions_across_batches(monkeypatch, tmp_path):
    monkeypatch.setattr(slices, "ROWS", 7)
    monkeypatch.setattr(slices, "PACKED", 5)
    seen = sorted({(s, e) for s in (-3, 2, 5, 1 << 40) for e in range(-4, 30) if (e * 7 + s) % 5} | {(k, k % 30) for k in range(6, 60)})
    rows = [r for r in seen for _ in range(1 + (r[1] % 3 == 0))]  # some lines stand twice
    columns = [[s for s, _ in rows], [e for _, e in rows], [e % 3 for _, e in rows], [e % 2 for _, e in rows]]
    table = pa.table(dict(zip(["session", "entity", "grp", "part"], map(pa.array, columns), strict=True)))
    want, number = Counter(), Counter(e for _, e in seen)
    for s in {s for s, _ in seen}:
        want.update(combinations(sorted(e for x, e in seen if x == s), 2))
    for k in range(3):
        (tmp_path / f"grp={k}").mkdir()
        mine = [e for e in number if e % 3 == k]
        pq.write_table(pa.table({"id": pa.array(mine, pa.int64()), "n": pa.array([number[e] for e in mine], pa.int64())}), tmp_path / f"grp={k}/part-0.parquet")
    packs, got = pa.Table.from_batches(slices.met(table.to_batches(4))).to_pylist(), []
    for key in {(p["low"], p["high"], p["part"]) for p in packs}:
        mine = pa.Table.from_pylist([p for p in packs if (p["low"], p["high"], p["part"]) == key])
        got += [tuple(r.values()) for r in slices.weighed(f"file://{tmp_path}")(mine).to_pylist()]
    assert sorted(got) == sorted((a, b, float(n), number[a], number[b]) for (a, b), n in want.items())


def odd_lines(spark, data, tmp_path):
    """lineitem with repeated lines, lines without order or part, and an order of very many lines."""
    line = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey")
    hub = line.where("l_partkey % 2 = 0").select(F.lit(-7).cast("long").alias("l_orderkey"), "l_partkey")
    holes = line.limit(50).select(F.lit(None).cast("long").alias("l_orderkey"), "l_partkey").union(line.limit(50).select("l_orderkey", F.lit(None).cast("long")))
    line.union(hub).union(holes).union(line.where("l_orderkey < 100")).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    return str(tmp_path), con


def test_session_jaccard_of_odd_lines_in_few_bytes(spark, data, tmp_path):
    d, con = odd_lines(spark, data, tmp_path)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = plain(catalog.QUERIES["session_jaccard"](spark, d))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == sql(con, "session_jaccard") != []
    assert written() - before < 20 * len(got)  # of which half are the lines'; rows of pairs took 28, and a table of them besides


def odd_documents(spark, tmp_path):
    """documents with ids below zero, null, repeated and very large, and texts of nearly fifty characters of several widths."""
    texts = [None, "", *(c * n for c in ("a", "é", "é", "字", "🦆", " ", "\n", "\x00") for n in (24, 25, 49, 50, 51))]
    ids = [None, 1 << 62, -(1 << 62) - 1, 5, 5, *range(-9, 9)]
    rows = [(i, t, "en", "web") for i in ids for t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), con


def test_extraction_of_odd_documents(spark, tmp_path):
    d, con = odd_documents(spark, tmp_path)
    assert plain(catalog.QUERIES["stream_extraction"](spark, d)) == sql(con, "stream_extraction") != []


def test_extraction_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["stream_extraction"](spark, str(tmp_path)).collect() == []


def test_reflection_of_letters_that_java_folds_alone(spark, tmp_path):
    """In one session each: letters that fold to i in Java alone, words that only a final sigma or a dot tells apart, conversations
    without an id, ids beyond what a double holds."""
    far = 9_007_199_254_740
    said = [
        (1, 1, "We ınstead of that took the long way home"), (1, 2, "It was İnstead of the other that we took"), (1, 3, "In prıncİple it is the lıttle lamp. The rest of it is decided"),
        (2, 1, "You must go to the ΟΔΟΣ at noon"), (2, 2, "You must go to the οδος at noon"), (2, 3, "You must go to the οδοσ at noon"), (3, 1, "We must see İ at noon, they said"), (3, 2, "We must see i at noon, they said"),
        (None, 1, "We always keep the log open at night"), (None, 2, "They never keep the log open at night"), (4, None, "It was decided late, and we all went home"),
        (far, 995, "You must keep the log open at night"), (far, 998, "You must keep the LOG open at night"), (far, 999, "you MUST keep the log open at night"), (far + 1, 0, "You must keep the log open AT night"), (far + 1, 1, "You must KEEP the log open at night"),
    ]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    for name in ("reflection", "reflected_facts"):
        assert plain(catalog.QUERIES[name](spark, str(tmp_path))) == sql(con, name)
