"""What a query asks for: patterns of intents, layers to search, expansion, domains. Each rule is a Column of the query
text, and the SQL of the same rule."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.sources.tables import sql_text

# Patterns that speak for an intent, and what each adds to its score.
RECENCY = r"(?i)(最近|上週|上個月|今天|昨天|這週|recently|last week|last month|today|yesterday|this week|past \d+ days|latest|newest|我最近|近期|剛剛|剛才)"
CROSS_DOMAIN = r"(?i)(跨|之間|整合|結合|cross|between|integrate|combine|versus|vs\.?|比較|對比|compare|intersection|overlap|關聯|連結|bridge)"
FACTUAL = r"(?i)(port|端口|密碼|password|config|設定|版本|version|IP|URL|地址|路徑|path|多少|幾個|哪裡|where|what is the|exactly|precisely|specifically|\d+\.\d+|\d{4,}|localhost)"
CONCEPTUAL = r"(?i)(原則|principle|architecture|架構|philosophy|哲學|strategy|策略|pattern|模式|best practice|最佳實踐|approach|方法論|design|設計|why|為什麼|概念|concept|理念|思維|paradigm|methodology|framework|框架|guideline|準則)"
EXPLORATORY = r"(?i)(學了什麼|learned|做了什麼|summary|summarize|overview|總結|回顧|review|progress|進度|status|狀態|how.*going|怎麼樣|explore|探索|discovery)"
ACTIVITY = r"(?i)(忙什麼|在做什麼|做了什麼事|做了哪些|有什麼進展|什麼時間做了|activity|what.*doing|been.*working|recent changes|最近的改動|這段時間|這陣子|有在做|動了什麼|改了什麼)"
PROGRESS = r"(?i)(做到哪|做到哪裡|做到什麼程度|進展到哪|完成了嗎|完成度|差多少|還剩|未完成|做到一半|in progress|how far along|remaining|left to do|pending|todo|status update|目前狀態|現在狀態|進度如何|進度怎樣)"
CONTINUATION = r"(?i)(之前討論|上次聊|接著做|下一步|接下來|根據之前|我們之前|延續|based on.*discussion|next step|continue from|following up|pick up where|之前說的|之前決定|回到.*話題|上次的結論|接著上次|承接之前|之前提到|剛剛提到的|回去看|按照我們說的)"
ENTITY = r"([A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+[-_][a-z]+|[A-Z]{2,}|[a-z]+\.\w+)"
SPECIFIC = r"[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+|`[^`]+`|\d{4,}|http[s]?://"
VAGUE_EN = r"(?i)\b(that|it|this|those|these|the thing|that thing|something|someone|the one|what was|what is|which one|how do|how did|previously|earlier|before|last time|ago)\b"
VAGUE_ZH = r"(之前|上次|那個|那件事|那時|哪個|哪種|什麼|那個工具|那個方法|我們說的|我們之前|之前說|之前提|之前討論|記得|之前那個)"
QUESTION_EN = r"(?i)\b(what was|what is|what are|which|how do|how did|where is|where was)\b"
ASKS = r"\b(what|how|why|which|when)\b"
ASKS_WHY = r"\b(why|how should|how to)\b"
ASKS_WHAT = r"\b(what is|which|where|when)\b"
#: Characters that count as CJK.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ff00}-\x{ffef}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"

# Intents in the order that decides ties, the layers each searches and how, and its mode of retrieval.
INTENTS = ("entity_lookup", "conceptual", "factual", "exploratory", "cross_domain")
LAYERS = {
    "entity_lookup": {"summaries": "SKIP", "communities": "ILIKE", "triples": "HYBRID", "blocks": "SKIP"},
    "conceptual": {"summaries": "SEMANTIC", "communities": "SEMANTIC", "triples": "SKIP", "blocks": "SKIP"},
    "factual": {"summaries": "SKIP", "communities": "SKIP", "triples": "HYBRID", "blocks": "HYBRID"},
    "exploratory": {"summaries": "SKIP", "communities": "SKIP", "triples": "SEMANTIC", "blocks": "HYBRID"},
    "cross_domain": {"summaries": "SKIP", "communities": "ILIKE", "triples": "HYBRID", "blocks": "SKIP"},
    "unknown": {"summaries": "SEMANTIC", "communities": "SEMANTIC", "triples": "HYBRID", "blocks": "HYBRID"},
}
MODES = {"entity_lookup": "local", "factual": "local", "conceptual": "global", "exploratory": "global", "cross_domain": "hybrid", "unknown": "hybrid"}

# Frequent questions with an intent, a hint and a window in days of their own; the first that fits decides.
PRESETS = (
    ("recent_activity", r"(?i)^(最近|這週|這陣子|上週)?(忙什麼|做了什麼|在做什麼|有什麼進展|動了什麼)", "exploratory", "temporal_activity", 7),
    ("timeline", r"(?i)(什麼時間|哪天|哪時候|when).*做了(什麼|哪些)", "exploratory", "timeline", 30),
    ("progress_status", r"(?i)(做到哪|做到哪裡|進度|進展|完成了嗎|狀態)(了|如何|怎樣|怎麼樣)?$|.{2,20}(做到哪|進度如何|進度怎樣|完成度)", "exploratory", "progress", 0),
    ("continuation_planning", r"(?i)(之前討論|上次聊|根據之前|我們之前|之前決定|上次的結論).*?(下一步|接下來|怎麼做|怎麼規劃|接著|然後呢)", "conceptual", "continuation", 0),
    ("what_is_pending", r"(?i)(什麼|哪些)(事情|東西|工作)?(還沒做|做到一半|未完成|pending|in progress)", "exploratory", "pending_items", 14),
)

# Words that speak for a domain; two of them name it.
DOMAINS = {
    "finance": ("報表", "預算", "帳單", "訂閱", "營收", "支出", "expense", "budget", "subscription", "revenue", "invoice", "transaction"),
    "devops": ("docker", "nginx", "deploy", "k8s", "pipeline", "伺服器", "server", "container", "ci/cd", "kubernetes"),
    "ai": ("llm", "embedding", "model", "prompt", "rag", "向量", "token", "fine-tune", "inference", "語言模型"),
    "frontend": ("react", "css", "component", "rsbuild", "pnpm", "layout", "typescript", "前端", "ui", "tailwind"),
    "invest": ("股票", "etf", "portfolio", "殖利率", "dividend", "持股", "投資", "基金", "報酬率"),
    "planning": ("排程", "schedule", "cronicle", "每日", "weekly", "daily", "todo", "task", "待辦"),
}

#: Words that ask for memory outright, so that nothing is expanded.
DIRECT = ("記住", "memorize", "remember that", "store this", "save this")


#: A rule in both forms: what makes a Column of the text t, and SQL of t.
Rule = tuple[Callable[[], Column], str]


def has(pattern: str, of: str = "t") -> Rule:
    return lambda: F.rlike(F.col(of), F.lit(pattern)), f"regexp_matches({of}, {sql_text(pattern)})"


def count(pattern: str, of: str = "t") -> Rule:
    return lambda: F.regexp_count(F.col(of), F.lit(pattern)), f"len(regexp_extract_all({of}, {sql_text(pattern)}))"


def _plus(parts: list[tuple[Rule, float]]) -> Rule:
    """The sum of what each condition that holds adds."""
    return lambda: reduce(lambda a, b: a + b, [F.when(c(), w).otherwise(0.0) for (c, _), w in parts]), " + ".join(f"(CASE WHEN {s} THEN CAST({w} AS DOUBLE) ELSE 0.0 END)" for (_, s), w in parts)


def _either(*conditions: Rule) -> Rule:
    return lambda: reduce(lambda a, b: a | b, [c() for c, _ in conditions]), "(" + " OR ".join(s for _, s in conditions) + ")"


def _both(*conditions: Rule) -> Rule:
    return lambda: reduce(lambda a, b: a & b, [c() for c, _ in conditions]), "(" + " AND ".join(s for _, s in conditions) + ")"


def _not(condition: Rule) -> Rule:
    return lambda: ~condition[0](), f"(NOT {condition[1]})"


def vague() -> Rule:
    return _either(has(VAGUE_EN), has(VAGUE_ZH))


def short() -> Rule:
    """Few words, or few characters with CJK among them."""

    def column() -> Column:
        words = F.size(F.filter(F.split(F.trim(F.col("t")), r"\s+"), lambda x: x != ""))
        return F.when(F.rlike("t", F.lit(CJK)), F.length("t") < 15).otherwise(words <= 3)

    return column, f"(CASE WHEN regexp_matches(t, {sql_text(CJK)}) THEN length(t) < 15 ELSE len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '')) <= 3 END)"


def intent_scores() -> dict[str, Rule]:
    """The score of each intent: a text has columns t, and k: the number of its keywords."""
    low = lambda p: (lambda: F.rlike(F.lower("t"), F.lit(p)), f"regexp_matches(lower(t), {sql_text(p)})")
    why = _both(low(ASKS), low(ASKS_WHY))
    what = _both(low(ASKS), _not(low(ASKS_WHY)), low(ASKS_WHAT))
    entity, specific = count(ENTITY), count(SPECIFIC)
    plain = _plus([(_both(short(), _not(vague())), 0.3)])
    return {
        "entity_lookup": (lambda: 0.3 * entity[0]() + 0.2 * specific[0]() + plain[0](), f"0.3 * {entity[1]} + 0.2 * {specific[1]} + {plain[1]}"),
        "conceptual": _plus([(has(CONCEPTUAL), 0.5), (has(CONTINUATION), 0.45), (why, 0.2)]),
        "factual": _plus([(has(FACTUAL), 0.5), ((lambda: F.col("k") >= 3, "k >= 3"), 0.15), (what, 0.2)]),
        "exploratory": _plus([(has(RECENCY), 0.5), (has(EXPLORATORY), 0.4), (has(ACTIVITY), 0.45), (has(PROGRESS), 0.4), (vague(), 0.3)]),
        "cross_domain": _plus([(has(CROSS_DOMAIN), 0.5)]),
    }


def threshold() -> Rule:
    """The least score that names an intent: lower for short texts."""
    return lambda: F.greatest(F.lit(0.25), F.least(F.lit(0.6), 0.35 + 0.005 * F.least(F.length("t"), F.lit(50)))), "greatest(0.25, least(0.6, 0.35 + 0.005 * least(length(t), 50)))"


def should_expand() -> Rule:
    """Whether a query is worth expanding: short or vague, but not specific already."""

    def column() -> Column:
        t = F.trim(F.col("t"))
        cjk = F.regexp_count(t, F.lit(CJK)) / F.greatest(F.length(t), F.lit(1)) > 0.3
        direct = text.contains_any(t, list(DIRECT))
        open_ = F.when(cjk, F.length(t) < 30).otherwise(F.length(t) < 50) | F.rlike(t, F.lit(VAGUE_EN)) | F.rlike(t, F.lit(VAGUE_ZH)) | F.rlike(t, F.lit(QUESTION_EN))
        return F.when((F.length(t) < 3) | (F.length(t) > 100) | F.rlike(t, F.lit(SPECIFIC)) | direct, False).otherwise(open_)

    r = lambda p: f"regexp_matches(trim(t), {sql_text(p)})"
    direct = " OR ".join(f"contains(lower(trim(t)), '{w}')" for w in DIRECT)
    return column, f"(CASE WHEN length(trim(t)) < 3 OR length(trim(t)) > 100 OR {r(SPECIFIC)} OR {direct} THEN FALSE ELSE (CASE WHEN len(regexp_extract_all(trim(t), {sql_text(CJK)})) / greatest(length(trim(t)), 1) > 0.3 THEN length(trim(t)) < 30 ELSE length(trim(t)) < 50 END) OR {r(VAGUE_EN)} OR {r(VAGUE_ZH)} OR {r(QUESTION_EN)} END)"


def domains() -> Rule:
    """The domains that two or more of their words speak for, joined by commas."""

    def column() -> Column:
        t = F.lower("t")
        n = {d: reduce(lambda a, b: a + b, [F.contains(t, F.lit(w)).cast("int") for w in words]) for d, words in DOMAINS.items()}
        return F.array_join(F.filter(F.array(*[F.when(c >= 2, F.lit(d)) for d, c in n.items()]), lambda x: x.isNotNull()), ",")

    sums = {d: " + ".join(f"CAST(contains(lower(t), '{w}') AS INTEGER)" for w in words) for d, words in DOMAINS.items()}
    return column, "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {s} >= 2 THEN '{d}' END" for d, s in sums.items()) + "], lambda x: x IS NOT NULL), ',')"


def preset() -> Rule:
    """The name of the first preset that fits, or null."""

    def column() -> Column:
        out = None
        for name, pattern, *_ in PRESETS:
            c = has(pattern)[0]()
            out = F.when(c, name) if out is None else out.when(c, name)
        return out

    return column, "CASE " + " ".join(f"WHEN {has(p)[1]} THEN '{name}'" for name, p, *_ in PRESETS) + " END"
