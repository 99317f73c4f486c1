"""Queries on query texts: tokens, intents, layers, expansion; and the rules that keep or refuse texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import routing as rules
from recallgrid.functions import text
from recallgrid.plans.registry import query
from recallgrid.plans.retrieval import STEM_SQL, STOP_SQL
from recallgrid.sources.tables import JOURNAL_SQL, TEXTS_SQL, journal, sql_text, texts

ZH_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS_ZH) + ")"
HAN_SQL = f"list_filter(flatten(list_transform(regexp_extract_all(t, '{text.HAN}+'), lambda r: list_transform(range(1, greatest(length(r) - 1, 1) + 1), lambda i: substr(r, i, 2)))), lambda x: x NOT IN {ZH_SQL})"
LATIN_SQL = "list_filter(regexp_extract_all(lower(t), '[a-z0-9_]+'), lambda x: length(x) > 1)"
WORDS_SQL = "list_filter(regexp_extract_all(t, '[a-zA-Z0-9][a-zA-Z0-9_\\-.]*'), lambda x: length(x) > 2 AND lower(x) NOT IN " + STOP_SQL + ")"
#: The first of words that are equal but for case, in their order.
FIRSTS_SQL = "list_transform(list_filter(range(1, len({0}) + 1), lambda i: NOT list_contains(list_transform({0}[1:i-1], lambda y: lower(y)), lower({0}[i]))), lambda i: {0}[i])"


def distinct_sql(values: str) -> str:
    return f"list_transform(list_filter(range(1, len({values}) + 1), lambda i: NOT list_contains({values}[1:i-1], {values}[i])), lambda i: {values}[i])"


#: Texts with their Han pairs, Latin words and keywords.
PARTS_SQL = f"""{TEXTS_SQL}, parts AS (SELECT id, text AS t, regexp_matches(text, '{text.HAN}') AS han, {HAN_SQL.replace('(t,', '(text,')} AS pairs, {LATIN_SQL.replace('(t)', '(text)')} AS latin, {WORDS_SQL.replace('(t,', '(text,')} AS words FROM texts),
  firsts AS (SELECT id, t, han, pairs, latin, {FIRSTS_SQL.format('words')} AS words FROM parts),
  keyed AS (SELECT id, t, han, pairs, latin, (CASE WHEN han THEN {distinct_sql('list_concat(pairs, words)')} ELSE words END)[1:8] AS keys FROM firsts)"""


def _texts(spark, d):
    return texts(spark, d).select("id", F.col("text").alias("t"))


@query("tokenize", f"WITH {PARTS_SQL}, s AS (SELECT id, han, pairs, list_transform(list_filter(latin, lambda x: x NOT IN {STOP_SQL}), lambda x: {STEM_SQL.format('x')}) AS latin FROM parts) SELECT id, array_to_string(CASE WHEN han THEN list_concat(pairs, latin) ELSE latin END, ' ') AS tokens FROM s")
def tokenize(spark, d):
    return _texts(spark, d).select("id", F.array_join(text.tokens(F.col("t")), " ").alias("tokens"))


@query("query_tokens", f"WITH {PARTS_SQL}, s AS (SELECT id, CASE WHEN han THEN list_concat(pairs, latin) ELSE latin END AS v FROM parts) SELECT id, array_to_string({distinct_sql('v')}, ' ') AS tokens FROM s")
def query_tokens(spark, d):
    return _texts(spark, d).select("id", F.array_join(text.query_tokens(F.col("t")), " ").alias("tokens"))


@query("extract_keywords", f"WITH {PARTS_SQL} SELECT id, array_to_string(keys, ' ') AS keywords FROM keyed")
def extract_keywords(spark, d):
    return _texts(spark, d).select("id", F.array_join(text.keywords(F.col("t")), " ").alias("keywords"))


SCORES = rules.intent_scores()
INTENTS_SQL = f"""{PARTS_SQL}, counted AS (SELECT id, t, len(keys) AS k FROM keyed), scores AS (SELECT id, t, {', '.join(f'ROUND({s}, 6) AS {n}' for n, (_, s) in SCORES.items())} FROM counted),
  best AS (SELECT *, greatest({', '.join(SCORES)}) AS top FROM scores),
  routed AS (SELECT id, t, top, {', '.join(SCORES)}, CASE WHEN top < {rules.threshold()[1]} THEN 'unknown' {' '.join(f"WHEN {n} = top THEN '{n}'" for n in SCORES)} END AS intent FROM best)"""


def routed(spark, d):
    """(id, t, top, intent) and the score of each intent, of all texts."""
    rows = _texts(spark, d).withColumn("k", F.size(text.keywords(F.col("t"))))
    rows = rows.select("id", "t", *[F.round(c(), 6).alias(n) for n, (c, _) in SCORES.items()]).withColumn("top", F.greatest(*SCORES))
    intent = F.when(F.col("top") < rules.threshold()[0](), "unknown")
    for n in SCORES:
        intent = intent.when(F.col(n) == F.col("top"), n)
    return rows.withColumn("intent", intent)


@query("intent_classify", f"WITH {INTENTS_SQL} SELECT id, intent, least(top, 1.0) AS confidence FROM routed")
def intent_classify(spark, d):
    return routed(spark, d).select("id", "intent", F.least("top", F.lit(1.0)).alias("confidence"))


def _layers(intent) -> dict:
    return {layer: F.element_at(F.create_map(*[F.lit(x) for i, plan in rules.LAYERS.items() for x in (i, plan[layer])]), intent) for layer in ("summaries", "communities", "triples", "blocks")}


def layer_sql(layer: str) -> str:
    return "CASE intent " + " ".join(f"WHEN '{i}' THEN '{plan[layer]}'" for i, plan in rules.LAYERS.items()) + " END"


MODE_SQL = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{m}'" for i, m in rules.MODES.items()) + " END"


@query("layer_plan", f"WITH {INTENTS_SQL} SELECT id, {MODE_SQL} AS mode, {', '.join(f'{layer_sql(x)} AS {x}' for x in ('summaries', 'communities', 'triples', 'blocks'))} FROM routed")
def layer_plan(spark, d):
    mode = F.element_at(F.create_map(*[F.lit(x) for p in rules.MODES.items() for x in p]), F.col("intent"))
    return routed(spark, d).select("id", mode.alias("mode"), *[c.alias(n) for n, c in _layers(F.col("intent")).items()])


@query("preset_match", f"WITH {TEXTS_SQL}, x AS (SELECT id, text AS t FROM texts), p AS (SELECT id, {rules.preset()[1]} AS preset FROM x) SELECT id, preset, CASE preset " + " ".join(f"WHEN '{n}' THEN '{i}'" for n, _, i, _, _ in rules.PRESETS) + " END AS intent, CAST(CASE preset " + " ".join(f"WHEN '{n}' THEN {w}" for n, _, _, _, w in rules.PRESETS) + " END AS INTEGER) AS days FROM p WHERE preset IS NOT NULL")
def preset_match(spark, d):
    """Frequent questions, with the intent and the window in days that they ask for."""
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for p in rules.PRESETS for x in (p[0], p[k])]), F.col("preset"))
    return _texts(spark, d).select("id", rules.preset()[0]().alias("preset")).where("preset is not null").select("id", "preset", of(2).alias("intent"), of(4).alias("days"))


#: Attention by word, as an interest profile gives it.
ATTENTION = {"pipeline": "active", "config": "active", "review": "fading", "之前": "fading"}


def personalised(rows, attention: dict[str, str] = ATTENTION):
    """The layers of routed texts, moved by what their user attends to: active entities ask for triples, fading ones for
    summaries and communities, and an unsure intent that names one opens what is left."""
    say = lambda kind: text.contains_any(F.col("t"), [w for w, k in attention.items() if k == kind])
    active, fading, unsure = say("active"), say("fading"), F.least("top", F.lit(1.0)) < 0.5
    layer = _layers(F.col("intent"))
    moved = {
        "summaries": F.when(fading & (layer["summaries"] == "SKIP"), "SEMANTIC").otherwise(layer["summaries"]),
        "communities": F.when(fading & (layer["communities"] == "SKIP"), "SEMANTIC").otherwise(layer["communities"]),
        "triples": F.when(active & layer["triples"].isin("SKIP", "SEMANTIC"), "HYBRID").otherwise(layer["triples"]),
        "blocks": layer["blocks"],
    }
    return rows.select("id", *[F.when(unsure & (active | fading) & (c == "SKIP"), "SEMANTIC").otherwise(c).alias(n) for n, c in moved.items()])


def _say_sql(kind: str) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{w}')" for w, k in ATTENTION.items() if k == kind) + ")"


_MOVED_SQL = {
    "summaries": f"CASE WHEN {_say_sql('fading')} AND {layer_sql('summaries')} = 'SKIP' THEN 'SEMANTIC' ELSE {layer_sql('summaries')} END",
    "communities": f"CASE WHEN {_say_sql('fading')} AND {layer_sql('communities')} = 'SKIP' THEN 'SEMANTIC' ELSE {layer_sql('communities')} END",
    "triples": f"CASE WHEN {_say_sql('active')} AND {layer_sql('triples')} IN ('SKIP', 'SEMANTIC') THEN 'HYBRID' ELSE {layer_sql('triples')} END",
    "blocks": layer_sql("blocks"),
}


@query("personalised_routing", f"WITH {INTENTS_SQL}, m AS (SELECT id, t, top, {', '.join(f'{s} AS {n}' for n, s in _MOVED_SQL.items())} FROM routed) SELECT id, {', '.join(f'''CASE WHEN least(top, 1.0) < 0.5 AND ({_say_sql('active')} OR {_say_sql('fading')}) AND {n} = 'SKIP' THEN 'SEMANTIC' ELSE {n} END AS {n}''' for n in _MOVED_SQL)} FROM m")
def personalised_routing(spark, d):
    return personalised(routed(spark, d))


@query("query_entities", f"WITH {TEXTS_SQL}, e AS (SELECT id, list_concat(regexp_extract_all(text, {sql_text(rules.ENTITY)}), regexp_extract_all(text, '{text.HAN}{{2,4}}')) AS v FROM texts), f AS (SELECT id, {FIRSTS_SQL.format('v')} AS v FROM e) SELECT id, array_to_string(v, '|') AS entities FROM f WHERE len(v) > 0")
def query_entities(spark, d):
    """What a query names: mixed case, joined or dotted words, capitals, and Han runs of two to four; each once."""
    found = F.concat(F.regexp_extract_all("t", F.lit(rules.ENTITY), F.lit(0)), F.regexp_extract_all("t", F.lit(f"{text.HAN}{{2,4}}"), F.lit(0)))
    rows = _texts(spark, d).select("id", found.alias("v"))
    first = F.filter("v", lambda x, i: ~F.exists(F.slice("v", F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return rows.select("id", F.array_join(first, "|").alias("entities")).where("entities <> ''")


@query("query_expansion", f"WITH {PARTS_SQL}, x AS (SELECT id, t, keys FROM keyed) SELECT id, {rules.should_expand()[1]} AS expand, array_to_string(keys, ' ') AS keywords, {rules.domains()[1]} AS domains FROM x")
def query_expansion(spark, d):
    """Whether a query is expanded, its keywords, and the domains that narrow the search. The text that a model would
    make up for an answer is the caller's to add."""
    return _texts(spark, d).select("id", rules.should_expand()[0]().alias("expand"), F.array_join(text.keywords(F.col("t")), " ").alias("keywords"), rules.domains()[0]().alias("domains"))


# Of English and Chinese texts, what asks for memory outright.
MEMORY_SQL = sql_text(text.MEMORY)


@query("adaptive_skip", f"WITH {TEXTS_SQL}, x AS (SELECT id, trim(text) AS t FROM texts) SELECT id, CASE WHEN regexp_matches(t, {MEMORY_SQL}) THEN 'memory_keyword' WHEN len(regexp_extract_all(t, {sql_text(rules.CJK)})) / greatest(length(t), 1) > 0.3 AND length(t) < 6 THEN 'cjk_too_short' WHEN len(regexp_extract_all(t, {sql_text(rules.CJK)})) / greatest(length(t), 1) <= 0.3 AND length(t) < 10 THEN 'too_short' WHEN regexp_matches(t, {sql_text(text.GREETING)}) THEN 'greeting' ELSE 'default' END AS reason FROM x")
def adaptive_skip(spark, d):
    """Why a text is or isn't searched for: 'memory_keyword' and 'default' are."""
    t = F.trim(F.col("t"))
    cjk = F.regexp_count(t, F.lit(rules.CJK)) / F.greatest(F.length(t), F.lit(1)) > 0.3
    reason = F.when(F.rlike(t, F.lit(text.MEMORY)), "memory_keyword").when(cjk & (F.length(t) < 6), "cjk_too_short").when(~cjk & (F.length(t) < 10), "too_short").when(F.rlike(t, F.lit(text.GREETING)), "greeting").otherwise("default")
    return _texts(spark, d).select("id", reason.alias("reason"))


#: The rules on texts not worth keeping, in SQL of t.
NOISE_SQL = " ".join(
    ["CASE"]
    + [f"WHEN {c} THEN {v}" for c, v in (
        (f"regexp_matches(t, {sql_text(text.WORTHY)})", "NULL"),
        (f"length(t) < 10 AND regexp_matches(t, {sql_text(text.HEARTBEAT)})", "'heartbeat'"),
        ("length(t) < 10", "'too_short'"),
        (f"regexp_matches(t, {sql_text(text.STATUS)})", "'status_only'"),
        (f"length(t) > 500 AND regexp_matches(t, {sql_text(text.TRACE)})", "'raw_error_trace'"),
        (f"length(t) > 500 AND regexp_matches(t, '^[\\[{{]') AND NOT regexp_matches(t, {MEMORY_SQL})", "'raw_json_dump'"),
        ("list_max(list_transform(list_distinct(string_split(t, '')), lambda c: length(t) - length(replace(t, c, '')))) > length(t) * 0.8", "'repetitive'"),
        (f"regexp_matches(t, {MEMORY_SQL})", "NULL"),
        (f"regexp_matches(t, {sql_text(text.GREETING)}) AND NOT regexp_matches(t, '[?？]')", "'greeting'"),
        (f"regexp_matches(t, {sql_text(text.REFUSAL)})", "'agent_refusal'"),
    )]
    + ["END"]
)


@query("noise_check", f"WITH {TEXTS_SQL}, x AS (SELECT id, trim(text) AS t FROM texts) SELECT id, {NOISE_SQL} AS reason FROM x")
def noise_check(spark, d):
    return _texts(spark, d).select("id", text.noise_reason(F.col("t")).alias("reason"))


@query("noise_filter", f"WITH {TEXTS_SQL}, x AS (SELECT id, trim(text) AS t FROM texts), n AS (SELECT id, {NOISE_SQL} AS reason FROM x) SELECT COUNT(*) FILTER (reason IS NULL) AS kept, COUNT(*) FILTER (reason IS NOT NULL) AS dropped FROM n")
def noise_filter(spark, d):
    """How many of the results the noise filter keeps and drops."""
    reason = text.noise_reason(F.col("t"))
    return _texts(spark, d).agg(F.count_if(reason.isNull()).alias("kept"), F.count_if(reason.isNotNull()).alias("dropped"))


INJECTION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql_text(p)}) THEN '{n}'" for n, p in text.INJECTIONS.items()) + " END"


def sanitised_sql() -> str:
    out = "regexp_replace(t, '(?i)<(\\s*/?\\s*(system|user|assistant|human|ai)\\s*)>', '＜\\1＞', 'g')"
    out = f"regexp_replace({out}, {sql_text(text.INJECTIONS['instruction_override'])}, '[memory: \\0]', 'g')"
    for name, new in (("encoded_injection", "[encoded-removed]"), ("markdown_injection", "[markup-removed]"), ("separator_flood", "---")):
        out = f"regexp_replace({out}, {sql_text(text.INJECTIONS[name])}, '{new}', 'g')"
    return out


@query("injection_check", f"WITH {TEXTS_SQL}, x AS (SELECT id, text AS t FROM texts UNION ALL SELECT page_id + 10000000 AS id, html AS t FROM pages) SELECT id, {INJECTION_SQL} AS reason FROM x")
def injection_check(spark, d):
    """The family of steering patterns of each text and page."""
    from recallgrid.sources.tables import raw

    rows = _texts(spark, d).unionByName(raw(spark, d, "pages").select((F.col("page_id") + 10_000_000).alias("id"), F.col("html").alias("t")))
    return rows.select("id", text.injection_reason(F.col("t")).alias("reason"))


@query("sanitised_results", f"WITH {TEXTS_SQL}, x AS (SELECT id, text AS t FROM texts) SELECT id, CASE WHEN ({INJECTION_SQL}) IS NULL THEN t ELSE {sanitised_sql()} END AS text, ({INJECTION_SQL}) IS NOT NULL AS changed FROM x")
def sanitised_results(spark, d):
    """A result list in which unsafe texts, and only these, are made harmless."""
    unsafe = text.injection_reason(F.col("t")).isNotNull()
    return _texts(spark, d).select("id", F.when(unsafe, text.neutralised(F.col("t"))).otherwise(F.col("t")).alias("text"), unsafe.alias("changed"))


@query("provenance_signals")
def provenance_signals(spark, d):
    """The first signal of each text that claims an authority, a role, hides orders, dates them, or carries a payload.
    What base64 decodes to is no business of the SQL twin; tests compare with a plain rule."""
    return _texts(spark, d).select("id", text.provenance_signal(F.col("t")).alias("s")).where("s is not null").select("id", "s.kind", "s.severity")


def _signal_sql(part: int) -> str:
    value = (lambda x: sql_text(x)) if part == 0 else str
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {sql_text(s[2])}) THEN {value(s[part])}" for s in text.PROVENANCE) + " END"


@query("pattern_signals", f"WITH {TEXTS_SQL}, x AS (SELECT id, text AS t FROM texts), y AS (SELECT id, {_signal_sql(0)} AS kind, CAST({_signal_sql(1)} AS DOUBLE) AS severity FROM x) SELECT id, kind, severity FROM y WHERE kind IS NOT NULL")
def pattern_signals(spark, d):
    """provenance_signals by patterns alone."""
    return provenance_signals(spark, d).where("kind <> 'base64'")


@query("trust_scores", f"WITH {TEXTS_SQL}, p AS (SELECT id, id % 3 = 0 AS s, id % 5 = 0 AS a, id % 7 < 3 AS m, id % 11 < 4 AS r FROM texts) SELECT id, ROUND(CAST(least(0.5 + CASE WHEN s THEN 0.2 ELSE 0 END + CASE WHEN a THEN 0.1 ELSE 0 END + CASE WHEN m THEN 0.1 ELSE 0 END + CASE WHEN r THEN 0.1 ELSE 0 END, 1.0) AS DOUBLE), 2) AS trust FROM p")
def trust_scores(spark, d):
    """Trust by where a memory comes from: a known session, a known agent, an automated method, a recent extraction."""
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    i = F.col("id")
    total = 0.5 + add(F.pmod(i, F.lit(3)) == 0, 0.2) + add(F.pmod(i, F.lit(5)) == 0, 0.1) + add(i % 7 < 3, 0.1) + add(i % 11 < 4, 0.1)
    return _texts(spark, d).select("id", F.round(F.least(total, F.lit(1.0)), 2).alias("trust"))


@query("anomaly_rollup", f"WITH {TEXTS_SQL}, x AS (SELECT id, text AS t FROM texts), y AS (SELECT id, ({_signal_sql(0)}) AS kind, id % 4 = 0 AS foreign_source FROM x) SELECT id, array_to_string(list_filter([kind, CASE WHEN foreign_source THEN 'foreign_source' END], lambda v: v IS NOT NULL), ',') AS signals FROM y WHERE (kind IS NULL OR kind <> 'base64') AND (kind IS NOT NULL OR foreign_source)")
def anomaly_rollup(spark, d):
    """All signals of a memory: that of its text, and a low trust in spite of a known source (here each fourth)."""
    found = text.provenance_signal(F.col("t"))["kind"]
    own = F.when(found != "base64", found)
    signals = F.array_join(F.array_compact(F.array(own, F.when(F.pmod("id", F.lit(4)) == 0, "foreign_source"))), ",")
    return _texts(spark, d).select("id", signals.alias("signals")).where("signals <> ''")


@query("dominant_intent", f"WITH {JOURNAL_SQL}, n AS (SELECT session, intent, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY session) AS total FROM journal GROUP BY 1, 2) SELECT session, intent FROM n WHERE n >= 0.3 * total AND total >= 10")
def dominant_intent(spark, d):
    """Intents that make up three tenths or more of a session's queries."""
    n = journal(spark, d).groupBy("session", "intent").agg(F.count("*").alias("n"))
    total = n.groupBy("session").agg(F.sum("n").alias("total"))
    return n.join(total, "session").where("n >= 0.3 * total and total >= 10").select("session", "intent")
