"""Text predicates and transforms as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that the tokenizer leaves out.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for",
    "on", "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "and", "but", "or",
    "not", "no", "nor", "so", "yet", "both", "either", "neither", "this",
    "that", "these", "those", "it", "its", "i", "me", "my", "we", "our",
    "you", "your", "he", "him", "his", "she", "her", "they", "them",
    "their", "us", "whom", "what", "which", "who", "when", "where",
    "why", "how", "about", "against", "up", "down", "out", "off", "over",
    "under", "again", "then", "once", "here", "there", "all", "each",
    "few", "more", "most", "other", "some", "such", "only", "same",
    "than", "too", "very", "just", "if", "s", "t",
    "don", "doesn", "didn", "won", "wouldn", "couldn", "shouldn",
    "hasn", "hadn", "isn", "aren", "wasn", "weren",
)

# Chinese words that the tokenizer leaves out.
STOPWORDS_ZH = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "都",
    "一", "一個", "上", "也", "很", "到", "要", "去", "你",
    "會", "著", "沒有", "看", "好", "自己", "這", "他", "她",
    "嗎", "吧", "呢", "啊", "喔", "欸", "那", "什麼",
    "人", "說", "們", "把", "被", "讓", "給",
    "可以", "因為", "所以", "但是", "如果", "然後", "現在",
    "這個", "那個", "這樣", "那樣", "一些", "這些", "那些",
    "已經", "還是", "只是", "其實",
)

#: Han characters; no segmenter is at hand, so runs of them are read as their overlapping pairs.
HAN = "[一-鿿]"

# Canonical predicates and their aliases.
PREDICATES = (
    "uses", "requires", "depends_on", "configured_with", "format_is", "default_is", "causes", "prevents", "fixes", "enables",
    "should", "should_NOT", "pattern_is", "flow_is", "implemented_as", "chosen_over", "reason_for", "improves", "degrades", "maps_to",
)
PREDICATE_ALIASES = {
    "depends on": "depends_on", "needs": "requires", "need": "requires", "is configured with": "configured_with",
    "configured with": "configured_with", "configures": "configured_with", "config_is": "configured_with", "has_format": "format_is",
    "defaults_to": "default_is", "default": "default_is", "caused_by": "causes", "leads_to": "causes", "triggers": "causes",
    "avoids": "prevents", "blocks": "prevents", "solves": "fixes", "fixed_by": "fixes", "resolves": "fixes", "allows": "enables",
    "unlocks": "enables", "supports": "enables", "must": "should", "should_use": "should", "recommended": "should",
    "must_not": "should_NOT", "should_not": "should_NOT", "avoid": "should_NOT", "do_not": "should_NOT", "dont": "should_NOT",
    "implemented_by": "implemented_as", "built_with": "implemented_as", "runs_on": "implemented_as", "works_as": "pattern_is",
    "follows": "pattern_is", "architecture_is": "pattern_is", "pipeline_is": "flow_is", "workflow_is": "flow_is",
    "preferred_over": "chosen_over", "replaced_by": "chosen_over", "selected_over": "chosen_over", "because": "reason_for",
    "motivation": "reason_for", "speeds_up": "improves", "optimizes": "improves", "enhances": "improves", "slows_down": "degrades",
    "hurts": "degrades", "worsens": "degrades", "equivalent_to": "maps_to", "corresponds_to": "maps_to", "translates_to": "maps_to",
}

# Patterns of texts that aren't worth keeping, and of those that always are.
WORTHY = r"(?i)(記住|remember|note\s+to\s+self|重要|鐵律|iron\s+rule|以後|from\s+now\s+on|always|never|禁止|must)"
HEARTBEAT = r"(?i)^(HEARTBEAT|ping|pong|test|ok|ack|noop)$"
STATUS = r"(?i)^(ok|okay|done|got\s+it|sure|roger|affirmative|copy\s+that|understood|好|收到|了解|知道了|明白|好的|沒問題|遵命)[\s!.,、。！]*$"
TRACE = r"(?im)^\s*(Traceback \(most recent call last\)|  File \"|    raise |Error:|Exception:)"
MEMORY = r"(?i)(記得|記住|忘了|想起|提過|討論過|說過|之前|上次|以前|前面|先前|剛才|我們聊過|有聊過|講過|聊到|提到|想想|回想|remember|recall|forgot|mentioned|discussed|previously|earlier|last\s*time|memory|memorize|noted|recorded|talked\s+about)"
GREETING = r"(?i)^((hi|hello|hey|howdy|yo|sup|greetings|good\s*(morning|afternoon|evening|night))[\s!.,]*|(你好|嗨|哈囉|早安|午安|晚安|哈嘍|嘿)[\s!.,、。！]*)$"
REFUSAL = r"(?i)(I cannot|I can't|I'm unable|I am unable|As an AI|As a language model|I don't have the ability|I'm not able|我無法|我不能|作為AI|作為一個語言模型|身為AI)"

# Patterns of texts that try to steer a model.
INJECTIONS = {
    "role_tag": r"(?i)<\s*/?\s*(system|user|assistant|human|ai)\s*>",
    "instruction_override": r"(?i)(ignore\s+(all\s+)?previous\s+instructions|disregard\s+(all\s+)?(above|prior)|forget\s+(everything|all)\s+(above|before)|new\s+instructions?\s*:|override\s+(system|previous)|you\s+are\s+now\s+|act\s+as\s+(if\s+you\s+are|a)\s+|pretend\s+(you\s+are|to\s+be)\s+|from\s+now\s+on\s*,?\s*(you|your|ignore)|忽略(所有|之前的)?指令|無視(之前|上面)的|新的指令\s*[:：]|你現在是)",
    "encoded_injection": r"(?i)(&#x[0-9a-f]+;|&#\d+;|\\u[0-9a-f]{4}|%[0-9a-f]{2}){3,}",
    "markdown_injection": r"(?i)(!\[.*?\]\(javascript:|\[.*?\]\(data:|<script\b|<iframe\b|on\w+\s*=\s*[\"'])",
    "separator_flood": r"[-=_*#]{20,}",
}


def stem(word: Column) -> Column:
    """A light stem: plural endings, then -ing and -ed after three letters or more."""
    w = F.regexp_replace(word, "^([a-z]{2,})ies$", "$1y")
    w = F.regexp_replace(w, "^([a-z]{2,}[^su])s$", "$1")
    return F.regexp_replace(w, "^([a-z]{3,})(?:ing|ed)$", "$1")


def han_pairs(text: Column) -> Column:
    """The pairs of neighbouring Han characters that aren't stop words, in order; a lone character counts by itself."""
    runs = F.regexp_extract_all(text, F.lit(f"({HAN}+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    return F.filter(pairs, lambda x: ~x.isin(*STOPWORDS_ZH))


def tokens(text: Column) -> Column:
    """Lower-case Latin words of two letters or more that aren't stop words, stemmed, and Han pairs."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    latin = F.transform(F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS)), stem)
    return F.when(F.rlike(text, F.lit(HAN)), F.concat(han_pairs(text), latin)).otherwise(latin)


def query_tokens(text: Column) -> Column:
    """A query's tokens, each once, in order: Latin words keep stop words and endings."""
    found = F.filter(F.regexp_extract_all(F.lower(F.trim(text)), F.lit("([a-z0-9_]+)"), F.lit(1)), lambda x: F.length(x) > 1)
    return F.array_distinct(F.when(F.rlike(text, F.lit(HAN)), F.concat(han_pairs(text), found)).otherwise(found))


def keywords(text: Column) -> Column:
    """Up to eight: Han pairs, and Latin words of three letters or more, stop words left out."""
    found = F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9][a-zA-Z0-9_\-.]*)"), F.lit(1))
    latin = F.filter(found, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*STOPWORDS))
    low = F.transform(latin, F.lower)
    first = F.transform(F.slice(F.array_distinct(low), 1, 8), lambda x: F.element_at(latin, F.array_position(low, x).cast("int")))
    return F.slice(F.when(F.rlike(text, F.lit(HAN)), F.array_distinct(F.concat(han_pairs(text), first))).otherwise(first), 1, 8)


def jaccard(a: Column, b: Column) -> Column:
    """Share of distinct members in common; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def contains_all(text: Column, terms: list[str]) -> Column:
    """Every term occurs, case aside; terms are literal text."""
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(t.lower())) for t in terms])


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(t.lower())) for t in terms])


def repetitive(text: Column) -> Column:
    """One character makes up over four fifths. In a text of more than sixteen characters such a one stands four times in
    a row somewhere, so only characters that do are counted."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1{3}"), F.lit(1))
    candidates = F.array_distinct(F.when(F.length(text) > 16, runs).otherwise(F.split(text, "")))
    most = F.aggregate(candidates, F.lit(0), lambda m, c: F.greatest(m, F.length(text) - F.length(F.replace(text, c, F.lit("")))))
    return most > F.length(text) * 0.8


#: The blanks of Unicode's class Zs.
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without blanks of any width at its ends; F.trim takes the plain space alone."""
    return F.btrim(text, F.lit(BLANKS))


def as_re2(pattern: str) -> str:
    """A pattern for rlike and split that matches as it does in RE2: there a dot takes all but a line feed, letters of any
    alphabet fold, and white space has no vertical tab. What it is matched with goes through for_re2."""
    return "(?du)" + pattern.replace(r"\s", r"[\t\n\f\r ]")


def for_re2(text: Column) -> Column:
    """The text with the two Turkish letters taken out of play that fold to the plain i in Java alone. F.translate would look up
    every letter."""
    return F.replace(F.replace(text, F.lit("\u0130"), F.lit("\ufffd")), F.lit("\u0131"), F.lit("\ufffd"))


def lower_each(text: Column) -> Column:
    """Lower-cased letter by letter: a capital sigma is never a final one, a dotted capital I loses its dot."""
    return F.lower(F.replace(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")), F.lit("\u0130"), F.lit("i")))


def noise_reason(text: Column) -> Column:
    """Why a text isn't worth keeping, or null; the first rule that applies decides."""
    t = trimmed(text)
    rules = (
        (F.rlike(t, F.lit(WORTHY)), None),
        ((F.length(t) < 10) & F.rlike(t, F.lit(HEARTBEAT)), "heartbeat"),
        (F.length(t) < 10, "too_short"),
        (F.rlike(t, F.lit(STATUS)), "status_only"),
        ((F.length(t) > 500) & F.rlike(t, F.lit(TRACE)), "raw_error_trace"),
        ((F.length(t) > 500) & F.rlike(t, F.lit(r"^[\[{]")) & ~F.rlike(t, F.lit(MEMORY)), "raw_json_dump"),
        (repetitive(t), "repetitive"),
        (F.rlike(t, F.lit(MEMORY)), None),
        (F.rlike(t, F.lit(GREETING)) & ~F.rlike(t, F.lit("[?？]")), "greeting"),
        (F.rlike(t, F.lit(REFUSAL)), "agent_refusal"),
    )
    return _first(rules)


def _first(rules) -> Column:
    out = F.when(rules[0][0], F.lit(rules[0][1]).cast("string"))
    for condition, value in rules[1:]:
        out = out.when(condition, F.lit(value).cast("string"))
    return out


def injection_reason(text: Column) -> Column:
    """The first family of steering patterns that a text shows, or null."""
    return _first(tuple((F.rlike(text, F.lit(p)), name) for name, p in INJECTIONS.items()))


def neutralised(text: Column) -> Column:
    """The text with steering patterns made harmless: tags in full width, orders quoted, the rest replaced."""
    wide = F.regexp_replace(text, r"(?i)<(\s*/?\s*(system|user|assistant|human|ai)\s*)>", "＜$1＞")
    quoted = F.regexp_replace(wide, INJECTIONS["instruction_override"], "[memory: $0]")
    for name, new in (("encoded_injection", "[encoded-removed]"), ("markdown_injection", "[markup-removed]"), ("separator_flood", "---")):
        quoted = F.regexp_replace(quoted, INJECTIONS[name], new)
    return quoted


def canonical_predicate(predicate: Column) -> Column:
    """Trimmed and lower-cased, aliases replaced; an unknown predicate stays."""
    p = F.lower(F.trim(predicate))
    table = F.create_map(*[F.lit(x) for pair in PREDICATE_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, p), p)


def normal_name(name: Column) -> Column:
    """An entity's name for comparing: white space collapsed, Latin lower-cased, closing marks dropped. Names are taken to
    be in composed form already; sources.tables.composed() brings others there."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    n = F.when(F.rlike(n, F.lit(HAN)), n).otherwise(F.lower(n))
    return F.regexp_replace(n, r"[.,;:!?]+$", "")


def outermost_json(body: Column) -> Column:
    """The outermost braces of a text, fences and words around them dropped."""
    return F.regexp_extract(F.regexp_replace(body, "```(?:json)?", ""), r"(?s)(\{.*\})", 1)


# Patterns of texts that claim an authority or a role, hide orders in comments, or date them.
_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
PROVENANCE = (
    ("authority", 0.85, r"(?i)(?:speaking\s+as\s+(your\s+)?(creator|developer|administrator|owner|maintainer)|in\s+my\s+capacity\s+as\s+(admin|administrator|system|owner)|as\s+(your\s+)?(creator|developer|god|master|owner)|with\s+(elevated|admin|root|system)\s+(permissions?|access|rights?)|i\s+have\s+(admin|root|system|elevated)\s+(access|rights?|permissions?)|authorized\s+by\s+(system|admin|creator|anthropic|openai)|on\s+behalf\s+of\s+(system|admin|anthropic|openai|the\s+creator))"),
    ("role", 0.75, r"(?i)(?:\bi\s+am\s+(a\s+)?(language\s+model|llm|ai\s+assistant|gpt|claude|gemini|the\s+system)|as\s+an\s+ai\s*(,|language\s+model|assistant|system)|my\s+(primary\s+)?(instructions?|directives?|goals?|purpose)\s+(are|is)\s+to|i\s+(was\s+)?programmed\s+to|my\s+training\s+(data\s+)?(includes?|says?|tells?))"),
    ("comment", 0.90, r"(?is)<!--.*?(?:instruct|command|directive|ignore|override|system|you\s+must|always|never|do\s+not).*?-->"),
    ("temporal", 0.70, rf"(?i)(?:as\s+of\s+{_MONTH}\s+\d{{4}},?\s+(?:the\s+)?(?:new\s+)?(?:instructions?|rules?|guidelines?|policies?)|effective\s+(?:from\s+)?{_MONTH}\s+\d{{4}}[,\s]+(?:you\s+(?:must|should|will|are)|all\s+(?:responses?|outputs?))|updated?\s+(?:on\s+)?{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}[,\s]+(?:new\s+)?(?:instructions?|rules?|guidelines?|behavior))"),
)
BASE64 = "[A-Za-z0-9+/]{50,}={0,2}"
DECODED = "(?i)(ignore|override|system|instruction|you\\s+are|act\\s+as)"


def base64_payload(text: Column) -> Column:
    """A long base64 run that decodes to steering words, or to bytes that aren't text."""
    runs = F.regexp_extract_all(text, F.lit(f"({BASE64})"), F.lit(1))

    def payload(run: Column) -> Column:
        plain = F.rtrim(run, F.lit("="))
        whole = F.substr(plain, F.lit(1), (F.length(plain) - F.when(F.length(plain) % 4 == 1, 1).otherwise(0)).cast("int"))
        data = F.try_to_binary(F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "="), F.lit("base64"))
        read = F.try_validate_utf8(data.cast("string"))
        return F.when(F.length(plain) % 4 == 1, False).when(read.isNotNull(), F.rlike(read, F.lit(DECODED))).otherwise(F.length(data) > 20)

    return F.exists(runs, payload)


def provenance_signal(text: Column) -> Column:
    """(kind, severity) of the first signal that a text gives, or null."""
    out = None
    for name, severity, pattern in PROVENANCE:
        value = F.struct(F.lit(name).alias("kind"), F.lit(severity).alias("severity"))
        out = F.when(F.rlike(text, F.lit(pattern)), value) if out is None else out.when(F.rlike(text, F.lit(pattern)), value)
    return out.when(base64_payload(text), F.struct(F.lit("base64").alias("kind"), F.lit(0.80).alias("severity")))
