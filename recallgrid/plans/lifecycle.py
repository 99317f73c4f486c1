"""How memory changes with time: duplicates and conflicts, folds, consolidation, reviews, reflection, tiers, backfills."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import scores, text, times
from recallgrid.operators import tables as ops
from recallgrid.plans import knowledge, search, writes
from recallgrid.plans.health import CONTRADICTING_SQL, contradicting
from recallgrid.plans.registry import ORACLES, query
from recallgrid.schema import live, valid
from recallgrid.sources.tables import BLOCKS_SQL, JOURNAL_SQL, TEXTS_SQL, TRIPLES_SQL, blocks, journal, raw, sql_text, texts, triples, vectors

# By category, what becomes of similar blocks, from what likeness on, and from what likeness on they may conflict.
DEDUP = {"knowledge": ("merge_if_similar", 0.88, 0.83), "attitude": ("merge_if_similar", 0.82, 0.88), "skill": ("append_only", 0.88, 0.87), "general": ("merge_if_similar", 0.88, 0.85)}
DEDUP_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{b}', {t}, {c})" for k, (b, t, c) in DEDUP.items()) + ") v(block_type, behaviour, threshold, conflict))"


def dedup_rules(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DEDUP.items()], "block_type string, behaviour string, threshold double, conflict double")


@query("dedup_thresholds", f"WITH {BLOCKS_SQL}, {DEDUP_SQL} SELECT b.id, r.behaviour, CAST(r.threshold AS DOUBLE) AS threshold, CAST(r.conflict AS DOUBLE) AS conflict FROM blocks b JOIN rules r ON b.block_type = r.block_type")
def dedup_thresholds(spark, d):
    return blocks(spark, d).join(F.broadcast(dedup_rules(spark)), "block_type").select("id", "behaviour", "threshold", "conflict")


JACCARD_SQL = "(CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0.0 END)"
WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query("dedup_decision", f"""WITH {BLOCKS_SQL}, {DEDUP_SQL}, e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id, b.id AS other, ROUND(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS s FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0),
  n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY s DESC, other) AS k FROM s) x WHERE k = 1),
  w AS (SELECT n.id, n.s, b.block_type, {WORDS_OF.format('b.content')} AS x, {WORDS_OF.format('o.content')} AS y FROM n JOIN blocks b ON n.id = b.id JOIN blocks o ON n.other = o.id), j AS (SELECT id, s, block_type, {JACCARD_SQL.format('x', 'y')} AS j FROM w)
  SELECT j.id, CASE WHEN r.behaviour = 'append_only' THEN 'append' WHEN s > 0.95 AND j > 0.7 THEN 'skip' WHEN s >= r.conflict THEN 'coexist' WHEN j > 0.7 THEN 'merge' ELSE 'create' END AS decision FROM j JOIN rules r ON j.block_type = r.block_type""")
def dedup_decision(spark, d):
    """What becomes of a new block beside the one whose vector is nearest, for every id divisible by 100: left out, kept beside
    it, merged or made; a skill is always added. Where a model would judge a conflict, the rule by words does."""
    v = vectors(spark, d)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qv"), "label")
    near = v.join(asked, "label").where("id <> q").select("q", F.col("id").alias("other"), F.round(scores.cosine(F.col("vec"), F.col("qv")), 6).alias("s"))
    near = near.groupBy("q").agg(F.max_by(F.struct("s", "other"), F.struct("s", -F.col("other"))).alias("n"))
    b = blocks(spark, d).select("id", "block_type", text.word_set(F.col("content")).alias("w"))
    rows = near.select(F.col("q").alias("id"), "n.s", "n.other").join(b, "id").join(b.select(F.col("id").alias("other"), F.col("w").alias("ow")), "other").join(F.broadcast(dedup_rules(spark)), "block_type")
    j = text.jaccard(F.col("w"), F.col("ow"))
    decision = F.when(F.col("behaviour") == "append_only", "append").when((F.col("s") > 0.95) & (j > 0.7), "skip").when(F.col("s") >= F.col("conflict"), "coexist").when(j > 0.7, "merge").otherwise("create")
    return rows.select("id", decision.alias("decision"))


_PAIR_SQL = "p AS (SELECT n.doc_id, n.text AS fresh, o.text AS old FROM documents n JOIN documents o ON n.doc_id = o.doc_id + 1)"


def _beside(spark, d) -> DataFrame:
    """Each document with the one before it by id."""
    docs = raw(spark, d, "documents")
    return docs.select("doc_id", F.col("text").alias("fresh")).join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old")), "doc_id")


@query("word_overlap", f"WITH {_PAIR_SQL}, w AS (SELECT doc_id, {WORDS_OF.format('fresh')} AS x, {WORDS_OF.format('old')} AS y FROM p) SELECT doc_id, ROUND({JACCARD_SQL.format('x', 'y')}, 6) AS overlap FROM w")
def word_overlap(spark, d):
    """How many of the words of a block and of the one before it both have."""
    return _beside(spark, d).select("doc_id", F.round(text.jaccard(text.word_set(F.col("fresh")), text.word_set(F.col("old"))), 6).alias("overlap"))


_NEW_SQL = f"list_filter(list_filter(list_transform(string_split(fresh, '.'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> ''), lambda s: len({WORDS_OF.format('s')}) > 0 AND len(list_intersect({WORDS_OF.format('s')}, {WORDS_OF.format('old')})) / len({WORDS_OF.format('s')}) < 0.5)"


@query("merged_content", f"WITH {_PAIR_SQL}, a AS (SELECT doc_id, old, {_NEW_SQL} AS added FROM p) SELECT doc_id, sha256(CASE WHEN len(added) = 0 THEN old ELSE rtrim(old, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || array_to_string(added, '. ') || '.' END) AS digest, len(added) AS added FROM a")
def merged_content(spark, d):
    """A block with those sentences of the next one appended of whose words it has less than half."""
    blank = F.lit(" \t\n\r")
    known = text.word_set(F.col("old"))
    sentences = F.filter(F.transform(F.split("fresh", r"\."), lambda s: F.trim(s, blank)), lambda s: s != "")
    fresh = F.filter(sentences, lambda s: (F.size(text.word_set(s)) > 0) & (F.size(F.array_intersect(text.word_set(s), F.col("known"))) / F.size(text.word_set(s)) < 0.5))
    rows = _beside(spark, d).withColumn("known", known).withColumn("added", fresh)
    whole = F.when(F.size("added") == 0, F.col("old")).otherwise(F.concat(F.rtrim("old", blank), F.lit("\n"), F.array_join("added", ". "), F.lit(".")))
    return rows.select("doc_id", F.sha2(whole, 256).alias("digest"), F.size("added").cast("long").alias("added"))


@query("content_hash", "SELECT doc_id AS id, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS content_hash FROM documents")
def content_hash(spark, d):
    """A digest of the text with white space collapsed."""
    return raw(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring(F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256), 1, 16).alias("content_hash"))


@query("fold_ids", "WITH s AS (SELECT conv_id, string_agg(CAST(conv_id * 1000 + turn AS VARCHAR), ',' ORDER BY CAST(conv_id * 1000 + turn AS VARCHAR)) AS ids FROM conversations GROUP BY 1) SELECT conv_id, substr(sha256(ids), 1, 16) AS fold_id FROM s")
def fold_ids(spark, d):
    """The id of what a conversation's turns are folded to: of their sorted ids."""
    ids = F.array_join(F.array_sort(F.collect_list((F.col("conv_id") * 1000 + F.col("turn")).cast("string"))), ",")
    return raw(spark, d, "conversations").groupBy("conv_id").agg(F.substring(F.sha2(ids, 256), 1, 16).alias("fold_id"))


# Words that end with a full stop within a sentence.
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Ph.D.", "etc.", "e.g.", "i.e.", "vs.", "No.", "Inc.", "Ltd.")


def sentences(value):
    """The sentences of a text, Latin or Chinese; one that ends with an abbreviation goes on."""
    marked = value
    for k, a in enumerate(ABBREVIATIONS):
        marked = F.replace(marked, F.lit(a + " "), F.lit(f"\x01{k}\x01"))
    parts = F.split(F.regexp_replace(marked, r"([.!?])\s+|([。！？])", "$1$2\x02"), "\x02")
    for k, a in enumerate(ABBREVIATIONS):
        parts = _spelled(parts, k, a)
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


def _spelled(parts, k: int, a: str):
    return F.transform(parts, lambda s: F.replace(s, F.lit(f"\x01{k}\x01"), F.lit(a + " ")))


@query("grounded_sentences")
def grounded_sentences(spark, d):
    """Of the text that a conversation is folded to (here its last turn, and the last one of the conversation before) the sentences
    that a turn of it holds, case and white space aside; short ones by their words. A caller's embedder may accept more."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    turns = raw(spark, d, "conversations").select("conv_id", "turn", "text")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    fold = last.unionByName(last.select((F.col("conv_id") + 1).alias("conv_id"), "text"))
    said = fold.select("conv_id", F.explode(sentences(F.col("text"))).alias("sentence")).distinct()
    held = turns.select("conv_id", plain(F.col("text")).alias("body"))
    s = plain(F.col("sentence"))
    inside = F.when(F.length(s) >= 8, F.contains("body", s)).otherwise(F.size(F.array_except(F.split(s, " "), F.split("body", " "))) == 0)
    return said.join(held, "conv_id").groupBy("conv_id", "sentence").agg(F.max(inside).alias("grounded"))


@query("conflict_gate", f"WITH {CONTRADICTING_SQL}, p AS (SELECT x.session FROM pairs q JOIN c x ON q.a = x.id UNION SELECT x.session FROM pairs q JOIN c x ON q.b = x.id) SELECT o_orderkey AS session, p.session IS NOT NULL AS conflict_pending FROM orders LEFT JOIN p ON o_orderkey = p.session")
def conflict_gate(spark, d):
    """Sessions that mustn't be folded yet: a fact of theirs contradicts another."""
    from recallgrid.sources.tables import claims

    found = contradicting(spark, d).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    open_ = valid(claims(spark, d)).join(found, "id", "left_semi").select("session").distinct().withColumn("p", F.lit(True))
    return raw(spark, d, "orders").select(F.col("o_orderkey").alias("session")).join(open_, "session", "left").select("session", F.coalesce("p", F.lit(False)).alias("conflict_pending"))


@query("consolidation_gate", f"WITH {JOURNAL_SQL}, n AS (SELECT COUNT(DISTINCT session) AS sessions, date_diff('hour', TIMESTAMP '2024-01-28 00:00:00', TIMESTAMP '2024-02-01 00:00:00') AS hours FROM journal WHERE ts >= TIMESTAMP '2024-01-28 00:00:00') SELECT sessions, hours, hours >= 24 AND sessions >= 5 AS due FROM n")
def consolidation_gate(spark, d):
    """Whether consolidation is due: a day after the last and five new sessions."""
    n = journal(spark, d).where("ts >= timestamp_ntz'2024-01-28 00:00:00'").agg(F.countDistinct("session").alias("sessions")).withColumn("hours", F.expr("timestampdiff(hour, timestamp'2024-01-28 00:00:00', timestamp'2024-02-01 00:00:00')"))
    return n.select("sessions", "hours", ((F.col("hours") >= 24) & (F.col("sessions") >= 5)).alias("due"))


@query("consolidation", f"""WITH r AS ({ORACLES['resolve_entities']}), m AS ({ORACLES['merged_entities']}), v AS ({ORACLES['validated_facts']}),
  s AS (SELECT 'resolve' AS stage, raw AS item FROM (SELECT raw FROM r WHERE outcome = 'created' ORDER BY raw LIMIT 30) a UNION ALL SELECT 'merge', CAST(id AS VARCHAR) FROM (SELECT id FROM m WHERE deleted > 0 ORDER BY id LIMIT 50) b UNION ALL SELECT 'normalise', CAST(id AS VARCHAR) FROM (SELECT id FROM v WHERE id % 5 = 0 ORDER BY id LIMIT 500) c)
  SELECT stage, item, md5(stage || ':' || item) AS key FROM s""")
def consolidation(spark, d):
    """What one run does: up to 30 new entities, 50 merges and 500 predicates, each under a key by which a second run knows it."""
    new = knowledge.resolve_entities(spark, d).where("outcome = 'created'").orderBy("raw").limit(30).select(F.lit("resolve").alias("stage"), F.col("raw").alias("item"))
    merges = knowledge.merged_entities(spark, d).where("deleted > 0").orderBy("id").limit(50).select(F.lit("merge").alias("stage"), F.col("id").cast("string").alias("item"))
    facts = knowledge.validated_facts(spark, d).where("id % 5 = 0").orderBy("id").limit(500).select(F.lit("normalise").alias("stage"), F.col("id").cast("string").alias("item"))
    return new.unionByName(merges).unionByName(facts).withColumn("key", F.md5(F.concat_ws(":", "stage", "item")))


@query("purged_facts", f"WITH {TRIPLES_SQL} SELECT id FROM triples WHERE NOT (is_invalid AND date_diff('day', CAST(created_at AS DATE), DATE '2001-12-01') > 90)")
def purged_facts(spark, d):
    """Facts without those that have been invalid for ninety days."""
    age = F.datediff(F.lit("2001-12-01").cast("date"), F.to_date("created_at"))
    return triples(spark, d).where(~(F.col("is_invalid") & (age > 90))).select("id")


@query("review_queue", f"WITH {BLOCKS_SQL}, p AS (SELECT id, age_days FROM blocks WHERE id % 11 = 3 AND NOT is_deleted) SELECT id, CASE id % 4 WHEN 0 THEN '__approved__' WHEN 1 THEN '__rejected__' WHEN 2 THEN '__pending__' ELSE CASE WHEN age_days > 14 THEN '__auto_approved__' ELSE '__pending__' END END AS state FROM p")
def review_queue(spark, d):
    """Blocks that wait for a review after the decisions on them (by their id, here): approved, rejected, put off; without a
    decision for a fortnight, approved."""
    i = F.col("id") % 4
    state = F.when(i == 0, "__approved__").when(i == 1, "__rejected__").when(i == 2, "__pending__").when(F.col("age_days") > 14, "__auto_approved__").otherwise("__pending__")
    return writes.pending(blocks(spark, d)).select("id", state.alias("state"))


# Patterns of preferences, rules, corrections, workflows, decisions and lessons, in the order that decides, and
# the category of each.
REFLECTIONS = (
    ("preference", r"(?i)(偏好|喜歡|我比較喜歡|我覺得.*比較好|prefer|rather|instead of|always|never|一律|禁止|必須|鐵律|must|should|shouldn'?t)", "invariant"),
    ("rule", r"(?i)(規則|慣例|以後|鐵律|convention|pattern|原則|principle|策略|strategy|must\s+always|never\s+again|禁止|一定要)", "invariant"),
    ("correction", r"(?i)(不[是對]|搞錯|更正|其實是|correction|actually|wait.*wrong|之前說錯|should\s+be|not.*but\s+rather)", "correction"),
    ("workflow", r"(?i)(流程|步驟|流程改成|改用|從.*改成|新做法|pipeline|workflow|switch\s+to|migrate\s+to|先.*再.*然後|step\s*\d|phase\s*\d)", "derived"),
    ("decision", r"(?i)(決定|決策|決定了|拍板|定案|最後選|decided|chose|confirmed|we'?ll\s+go\s+with|選擇|採用|rejected|不採用|棄用)", "derived"),
    ("lesson", r"(?i)(學到|教訓|踩坑|才知道|原來|注意|小心|lesson|learned|gotcha|turns?\s+out|caveat|pitfall)", "derived"),
)
_MARKERS = [p for n, p, _ in REFLECTIONS if n in ("preference", "rule", "decision", "lesson")]
CAPS = {"invariant": 10, "derived": 10, "correction": 5}


def reflected(rows: DataFrame, caps: dict[str, int] = CAPS, across: bool = False) -> DataFrame:
    """rows (scope, id, t): (scope, id, category, sentence) of what each text says about how to work: its most telling
    sentence, once for each set of its first ten words (across categories if asked), the first of each category. Texts without
    an id come last."""
    category = None
    for _, p, c in REFLECTIONS:
        says = F.rlike(text.for_re2(F.col("t")), F.lit(text.as_re2(p)))
        category = F.when(says, c) if category is None else category.when(says, c)
    parts = F.filter(F.transform(F.split("t", "[。.!！?\n]"), text.trimmed), lambda s: F.length(s) > 10)
    telling = F.filter(parts, lambda s: F.exists(F.array(*[F.lit(text.as_re2(m)) for m in _MARKERS]), lambda m: F.rlike(text.for_re2(s), m)))
    longest = F.filter(parts, lambda s: F.length(s) == F.array_max(F.transform(parts, F.length)))
    key = F.when(F.size(parts) == 0, F.substring("t", 1, 200)).when(F.size(telling) > 0, F.try_element_at(telling, F.lit(1))).otherwise(F.try_element_at(longest, F.lit(1)))
    found = rows.where(F.length("t") >= 20).select("scope", "id", category.alias("category"), key.alias("sentence")).where("category is not null")
    words = F.array_join(F.array_sort(F.array_distinct(F.slice(F.filter(F.split(text.lower_each(F.col("sentence")), text.as_re2(r"\s+")), lambda x: x != ""), 1, 10))), " ")
    once = found.groupBy("scope", words.alias("w"), *([] if across else ["category"])).agg(F.min_by(F.struct("id", "category", "sentence"), F.struct(F.col("id").isNull(), "id", "sentence")).alias("m")).select("scope", "m.id", "m.category", "m.sentence")
    order = Window.partitionBy("scope", "category").orderBy(F.asc_nulls_last("id"), "sentence")
    limit = F.element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col("category"))
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql_text(p)}) THEN '{c}'" for _, p, c in REFLECTIONS) + " END"
_ANY_SQL = "(" + " OR ".join(f"regexp_matches(s, {sql_text(p)})" for p in _MARKERS) + ")"
REFLECTED_SQL = f"""{TEXTS_SQL}, rows_ AS (SELECT abs(id) // 1000 AS scope, id, text AS t FROM texts WHERE length(text) >= 20), cut AS (SELECT scope, id, t, {_CATEGORY_SQL} AS category, list_filter(list_transform(regexp_split_to_array(t, '[。.!！?\n]'), lambda s: trim(s)), lambda s: length(s) > 10) AS parts FROM rows_),
  keyed AS (SELECT scope, id, category, CASE WHEN len(parts) = 0 THEN substr(t, 1, 200) ELSE COALESCE(list_filter(parts, lambda s: {_ANY_SQL})[1], list_filter(parts, lambda s: length(s) = list_max(list_transform(parts, lambda q: length(q))))[1]) END AS sentence FROM cut WHERE category IS NOT NULL),
  worded AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(sentence), '\\s+'), lambda x: x <> '')[1:10])), ' ') AS w FROM keyed),
  once AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scope, w, category ORDER BY id) AS k FROM worded) x WHERE k = 1),
  reflected AS (SELECT scope, id, category, sentence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scope, category ORDER BY id) AS n FROM once) x WHERE n <= CASE category WHEN 'correction' THEN 5 ELSE 10 END)"""


def _scoped(spark, d) -> DataFrame:
    return texts(spark, d).select(F.expr("abs(id) div 1000").alias("scope"), "id", F.col("text").alias("t"))


@query("reflection", f"WITH {REFLECTED_SQL} SELECT id, category, sentence FROM reflected")
def reflection(spark, d):
    """What conversations say about how to work, by session."""
    return reflected(_scoped(spark, d)).select("id", "category", "sentence")


@query("reflected_facts", f"WITH {REFLECTED_SQL} SELECT id, CASE category WHEN 'derived' THEN 'session:' || scope ELSE 'user' END AS subject, CASE category WHEN 'invariant' THEN 'has_behavioral_invariant' WHEN 'derived' THEN 'yielded_insight' ELSE 'contradicts' END AS predicate, substr(sentence, 1, 500) AS object FROM reflected")
def reflected_facts(spark, d):
    """Reflections as new facts."""
    r = reflected(_scoped(spark, d))
    c = F.col("category")
    return r.select("id", F.when(c == "derived", F.concat(F.lit("session:"), F.col("scope").cast("string"))).otherwise("user").alias("subject"), F.when(c == "invariant", "has_behavioral_invariant").when(c == "derived", "yielded_insight").otherwise("contradicts").alias("predicate"), F.substring("sentence", 1, 500).alias("object"))


@query("reflection_batch", f"WITH {REFLECTED_SQL}, one AS (SELECT id, category, sentence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY w ORDER BY id) AS k FROM worded) x WHERE k = 1), c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY id) AS n FROM one) SELECT id, category FROM c WHERE n <= CASE category WHEN 'invariant' THEN 20 ELSE 10 END")
def reflection_batch(spark, d):
    """The same over all sessions at once, with one set of fingerprints for all categories and its own caps."""
    rows = _scoped(spark, d).withColumn("scope", F.lit(0))
    return reflected(rows, {"invariant": 20, "derived": 10, "correction": 10}, across=True).select("id", "category")


@query("reflection_input", f"WITH {BLOCKS_SQL}, b AS (SELECT * FROM blocks WHERE NOT is_deleted) SELECT 'block' AS kind, id, substr(content, 1, 80) AS excerpt FROM (SELECT * FROM b ORDER BY age_days, id LIMIT 15) x UNION ALL SELECT 'attitude' AS kind, id, substr(content, 1, 80) AS excerpt FROM (SELECT * FROM b WHERE block_type = 'attitude' AND NOT is_invalid ORDER BY age_days, id LIMIT 15) y")
def reflection_input(spark, d):
    """What a model is asked to reflect on: the newest blocks and the newest attitudes, cut short."""
    b = live(blocks(spark, d))
    top = lambda df, kind: df.orderBy("age_days", "id").limit(15).select(F.lit(kind).alias("kind"), "id", F.substring("content", 1, 80).alias("excerpt"))
    return top(b, "block").unionByName(top(b.where("block_type = 'attitude' and not is_invalid"), "attitude"))


@query("tier_digest", f"WITH x AS ({ORACLES['tier_transitions']}) SELECT id, moved, CASE WHEN moved = 'cold' THEN 'digest_tagged_archive' ELSE 'digest_set_frozen_summary' END AS action FROM x WHERE moved IN ('cold', 'frozen') AND tier <> 'frozen'")
def tier_digest(spark, d):
    """Moves down into the cold or frozen tier, which a digest goes with; the digest itself is a caller's model's."""
    moves = knowledge.tier_transitions(spark, d).where("moved in ('cold', 'frozen') and tier <> 'frozen'")
    return moves.select("id", "moved", F.when(F.col("moved") == "cold", "digest_tagged_archive").otherwise("digest_set_frozen_summary").alias("action"))


@query("interest_snapshot", f"""WITH {JOURNAL_SQL}, dy AS (SELECT * FROM journal WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'), i AS (SELECT intent, COUNT(*) AS n FROM dy GROUP BY 1 ORDER BY n DESC, intent LIMIT 3), e AS (SELECT entity_id, COUNT(*) AS n FROM dy GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 5)
  SELECT (SELECT COUNT(*) FROM dy) AS volume, (SELECT ROUND(AVG(score), 3) FROM dy) AS quality, (SELECT string_agg(intent, ',' ORDER BY n DESC, intent) FROM i) AS intents, (SELECT string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY n DESC, entity_id) FROM e) AS entities, (SELECT COUNT(*) FROM dy WHERE verdict = 'incorrect') AS failed""")
def interest_snapshot(spark, d):
    """A day's interests in one row: volume, quality, leading intents and entities, failures."""
    day = journal(spark, d).where("ts >= timestamp_ntz'2024-01-15 00:00:00' and ts < timestamp_ntz'2024-01-16 00:00:00'")

    def leading(column: str, n: int, name: str) -> DataFrame:
        top = day.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
        return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("x")))), lambda s: s["x"].cast("string")), ",").alias(name))

    one = day.agg(F.count("*").alias("volume"), F.round(F.avg("score"), 3).alias("quality"), F.count_if(F.col("verdict") == "incorrect").alias("failed"))
    return one.crossJoin(leading("intent", 3, "intents")).crossJoin(leading("entity_id", 5, "entities")).select("volume", "quality", "intents", "entities", "failed")  # one row each


@query("timestamp_backfill", f"WITH {BLOCKS_SQL}, {JOURNAL_SQL}, f AS (SELECT 'src' || session AS session, MIN(ts) AS ts FROM journal WHERE session % 3 <> 0 GROUP BY 1) SELECT b.id, COALESCE(f.ts, TIMESTAMP '2024-01-01 00:00:00') AS created_at FROM blocks b LEFT JOIN f ON b.session = f.session")
def timestamp_backfill(spark, d):
    """Blocks' times by the first event of their session, or else that of the commit."""
    first = journal(spark, d).where("session % 3 <> 0").groupBy(F.concat(F.lit("src"), F.col("session").cast("string")).alias("session")).agg(F.min("ts").alias("ts"))
    return blocks(spark, d).join(first, "session", "left").select("id", F.coalesce("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("created_at"))


@query("label_backfill", "SELECT CAST(floor(d.doc_id / 20) AS BIGINT) AS batch, COUNT(*) AS n, MIN(d.doc_id) AS first FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL GROUP BY 1")
def label_backfill(spark, d):
    """Rows without a label, in batches of twenty ids at most for a caller's model."""
    rows = raw(spark, d, "documents").select("doc_id").join(raw(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return rows.groupBy(F.floor(F.col("doc_id") / 20).alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("recall_text", f"WITH {search.CASCADE_SQL}, l AS (SELECT query_id, layer, '## ' || layer || chr(10) || string_agg('- ' || key, chr(10) ORDER BY key) AS part FROM cascade GROUP BY 1, 2) SELECT a.query_id, COALESCE((SELECT string_agg(part, chr(10) ORDER BY layer) FROM l WHERE l.query_id = a.query_id), 'no memory of ' || a.term) AS body FROM asked a")
def recall_text(spark, d):
    """What a recall found, as text by layers; what found nothing says so, and a caller searches instead."""
    parts = search.cascade(spark, d).groupBy("query_id", "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list("key")), lambda k: F.concat(F.lit("- "), k)), "\n").alias("lines"))  # five each
    part = F.struct("layer", F.concat(F.lit("## "), "layer", F.lit("\n"), "lines").alias("part"))
    body = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "\n").alias("body"))
    asked = spark.createDataFrame(list(search.ASKED), "query_id int, term string, intent string")
    return asked.join(body, "query_id", "left").select("query_id", F.coalesce("body", F.concat(F.lit("no memory of "), "term")).alias("body"))


_SNAP = "(SELECT session, string_agg(part, ' | ' ORDER BY n) AS content FROM (SELECT session, substr(content, 1, 30) AS part, ROW_NUMBER() OVER (PARTITION BY session ORDER BY age_days, id) AS n FROM blocks WHERE NOT is_deleted{}) x WHERE n <= 5 GROUP BY 1)"


@query("hot_snapshot", f"WITH {BLOCKS_SQL}, old AS {_SNAP.format(' AND age_days > 3 AND id % 3 <> 0')}, new AS {_SNAP.format('')} SELECT new.session, new.content, CASE WHEN old.session IS NULL THEN 1 WHEN old.content IS DISTINCT FROM new.content THEN 2 ELSE 1 END AS version FROM new LEFT JOIN old ON new.session = old.session")
def hot_snapshot(spark, d):
    """The newest five blocks of each session, thirty characters of each; the version goes up only if that has changed since
    the snapshot before (here one of fewer blocks)."""
    b = live(blocks(spark, d))
    old, new = snapshot(b.where("age_days > 3 and id % 3 <> 0")), snapshot(b)
    rows = new.join(old.select("session", F.col("content").alias("was"), F.lit(1).alias("v")), "session", "left")
    version = F.when(F.col("v").isNull(), 1).when(~F.col("was").eqNullSafe(F.col("content")), F.col("v") + 1).otherwise(F.col("v"))
    return rows.select("session", "content", version.alias("version"))


def snapshot(rows: DataFrame) -> DataFrame:
    top = rows.select("session", "id", "age_days", F.struct("age_days", "id").alias("at"), F.substring("content", 1, 30).alias("part"))
    top = ops.first_n(top, "session", "at", 5)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    return top.groupBy("session").agg(F.array_join(parts, " | ").alias("content"))


# ------------------------------------------------------------------ times and amounts in words
@query("temporal_rewrite")
def temporal_rewrite(spark, d):
    """Texts with relative times as dates. Calendars and numerals in words have no SQL here; tests compare by hand."""
    return times.rewritten(texts(spark, d), "text", date(2024, 2, 1))


@query("temporal_ranges")
def temporal_ranges(spark, d):
    """The weeks, months and years that queries speak of, weeks from Sunday; queries are few, so the driver reads them."""
    ref, out = date(2024, 2, 1), []
    from recallgrid.sources.tables import PROBES

    for k, t in enumerate(PROBES, 1):
        if span := times.spans(t, ref):
            out.append((-k, *times.week_shifted(t, span)))
    return spark.createDataFrame(out, "id long, first date, last date")


@query("normalised_content", f"WITH {TEXTS_SQL} SELECT id, {times.amounts_sql('text')} AS text FROM texts")
def normalised_content(spark, d):
    return texts(spark, d).select("id", times.amounts(F.col("text")).alias("text"))
