"""Query understanding: simple and complex tests, rule rewrites, synonyms, reply parsing, content signals, recommended skills.

Everything is a projection of each query's own row; word lists are parameters, with the usual ones as defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of whole simple queries, and words that make a short query simple (fixed values).
SIMPLE_PATTERNS = (r"^什么是\w+$", r"^如何\w+\w*$", r"^\w+是什么$", r"^explain\s+\w+$", r"^how to \w+$")
SIMPLE_WORDS = ("什么是", "how to", "explain", "如何使用")
#: Words of queries with several parts (fixed values).
COMPLEX_WORDS = ("和", "与", "以及", " and ", " or ", "首先", "然后", "接着", "最后", "流程", "步骤")
#: What a text of each class must have for the class to hold (fixed values).
CLASS_WORDS = {"terminology": "什么|what|explain|定义", "usage": "使用|how|用法", "debugging": "错误|error|bug|问题|异常|失败"}
#: Openings of rewritten queries, and the words that make them needless (fixed values).
PREFIXES = {"terminology": ("什么是 ", ("what is", "什么是"), True), "usage": ("如何使用", ("如何使用", "how to"), False), "implementation": ("如何实现", ("如何实现", "怎么写"), False)}
SYNONYMS = {
    "async": ("async", "asynchronous", "异步"), "await": ("await", "等待", "awaiting"), "function": ("function", "函数", "方法", "method"), "class": ("class", "类"),
    "import": ("import", "导入", "引入"), "api": ("api", "接口", "endpoint", "api接口"),
}
INTENT_STOPWORDS = ("的", "是", "在", "和", "与", "或", "如何", "怎么", "什么", "how", "what", "the", "is", "and", "to", "of", "in")
#: Words by level of complexity, the first level with one wins (fixed values).
COMPLEXITY_WORDS = {
    "high": ("复杂", "高级", "深入", "底层", "原理", "architecture", "design", "implementation"),
    "medium": ("中等", "进阶", "应用", "实践", "usage", "application", "practice"),
    "low": ("简单", "基础", "入门", "初级", "basic", "beginner", "simple", "hello"),
}
#: Words by domain, the first domain with one wins (fixed values).
DOMAIN_WORDS = {
    "api": ("API", "接口", "端点", "endpoint", "rest", "http"), "database": ("数据库", "DB", "sql", "query", "table"),
    "frontend": ("前端", "frontend", "react", "vue", "html", "css"), "backend": ("后端", "backend", "server", "api"),
    "security": ("安全", "security", "权限", "auth", "token"), "testing": ("测试", "test", "unit", "integration"),
    "devops": ("部署", "docker", "kubernetes", "ci/cd", "pipeline"), "ml": ("机器学习", "ML", "AI", "模型", "训练"),
    "fintech": ("金融", "fintech", "交易", "支付", "风控"),
}


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def _has(low: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(low, F.lit(word.lower()))
    return found


def is_simple(query: Column, patterns: Sequence[str] = SIMPLE_PATTERNS, words: Sequence[str] = SIMPLE_WORDS, most_words: int = 5) -> Column:
    """5 to 50 characters that match a pattern, or have a simple word among five words at most."""
    text = F.trim(query)
    whole = F.lit(False)
    for pattern in patterns:
        whole = whole | text.rlike(f"(?iU){pattern}")
    short = _has(F.lower(text), words) & (word_count(text) <= most_words)
    return F.length(text).between(5, 50) & (whole | short)


def is_complex(query: Column, words: Sequence[str] = COMPLEX_WORDS) -> Column:
    """Ten words, or five with a word that joins or orders parts."""
    n = word_count(query)
    return (n >= 10) | ((n >= 5) & _has(F.lower(query), words))


def class_holds(query: Column, kind: Column, confidence: Column, needed: Mapping[str, str] = CLASS_WORDS) -> Column:
    """Whether a class with this confidence (0.3 at least) is borne out by the query's words; classes without words hold."""
    out = F.lit(True)
    for name, pattern in needed.items():
        out = F.when(kind == name, F.lower(query).rlike(pattern)).otherwise(out)
    return (confidence >= 0.3) & out


def rule_rewrite(query: Column, kind: Column, prefixes: Mapping[str, tuple[str, Sequence[str], bool]] = PREFIXES) -> Column:
    """The query with its class's opening, unless it has it already (at its start, where the third part says so: then it is also trimmed)."""
    low, out = F.lower(query), query
    for name, (prefix, known, at_start) in prefixes.items():
        there = F.lit(False)
        for word in known:
            there = there | (F.startswith(low, F.lit(word)) if at_start else F.contains(low, F.lit(word)))
        body = F.trim(F.replace(query, F.lit(prefix.strip()), F.lit(""))) if at_start else query
        out = F.when((kind == name) & ~there, F.concat(F.lit(prefix), body)).otherwise(out)
    return out


def rewritten(queries: DataFrame, kind: Column, confidence: Column, cached: DataFrame | None = None) -> DataFrame:
    """(query_id, rewritten, kind, confidence, path): from the cache (confidence times 0.95), by rule for simple queries (times 0.9), else as they are."""
    rows = queries.select("query_id", "query", kind.alias("kind"), confidence.alias("confidence"))
    if cached is None:
        rows = rows.withColumn("_cached", F.lit(None).cast("string"))
    else:
        rows = rows.join(cached.select("query", F.col("rewritten").alias("_cached")), "query", "left")
    simple = is_simple(F.col("query"))
    text = F.coalesce("_cached", F.when(simple, rule_rewrite(F.col("query"), F.col("kind"))).otherwise(F.col("query")))
    path = F.when(F.col("_cached").isNotNull(), "cache").when(simple, "rule").otherwise("none")
    factor = F.when(F.col("_cached").isNotNull(), 0.95).when(simple, 0.9).otherwise(1.0)
    return rows.select("query_id", text.alias("rewritten"), "kind", F.round(F.col("confidence") * factor, 6).alias("confidence"), path.alias("path"))


def normalised(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def with_synonyms(query: Column, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> Column:
    """array<string>: the query, and the other words for terms in it that it doesn't have."""
    extra = F.array().cast("array<string>")
    for term, words in synonyms.items():
        missing = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: ~F.contains(query, w))
        extra = F.concat(extra, F.when(F.contains(F.lower(query), F.lit(term)), missing).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.array(query), extra))


def fallback_intent(query: Column, stop: Sequence[str] = INTENT_STOPWORDS, most: int = 10) -> Column:
    """Struct (keywords, language, confidence): the first words of two characters or more that aren't stop words; "zh" with a CJK character."""
    words = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop))
    language = F.when(query.rlike("[一-鿿]"), "zh").otherwise("en")
    return F.struct(F.slice(words, 1, most).alias("keywords"), language.alias("language"), F.lit(0.5).alias("confidence"))


def reply_lines(reply: Column, headers: Sequence[str] = ("原始查询", "相关查询"), longer_than: int = 3) -> Column:
    """array<string>: a reply's list items, without numbers and bullets; blank lines, headers and very short items go."""
    lines = F.transform(F.split(F.trim(reply), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~_has(x, headers))
    bare = F.transform(kept, lambda x: F.regexp_replace(x, r"^[\d.\-*]+\s*", ""))
    return F.filter(bare, lambda x: F.length(x) > longer_than)


def reply_variants(reply: Column) -> Column:
    """array<struct<text, type, confidence>> of the JSON array in a reply, from its first to its last bracket; items without a text go."""
    body = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    items = F.from_json(body, "array<struct<text: string, type: string, confidence: double>>")
    known = F.filter(F.coalesce(items, F.array().cast("array<struct<text: string, type: string, confidence: double>>")), lambda v: v["text"].isNotNull())
    return F.transform(
        known, lambda v: F.struct(v["text"].alias("text"), F.coalesce(v["type"], F.lit("semantic_variant")).alias("type"), F.coalesce(v["confidence"], F.lit(1.0)).alias("confidence"))
    )


def default_variants(query: Column, question: str = "如何实现 {}", expansion: str = "{} 示例代码") -> Column:
    """array<struct<text, type, confidence>>: the query, its question form and its expansion."""
    forms = (("{}", "original", 1.0), (question, "question_form", 0.9), (expansion, "term_expansion", 0.85))
    return F.array(*[F.struct(F.replace(F.lit(t), F.lit("{}"), query).alias("text"), F.lit(k).alias("type"), F.lit(c).alias("confidence")) for t, k, c in forms])


def first_of(text: Column, words: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """The first name of which the lower-cased text has a word."""
    low, out = F.lower(text), F.lit(default).cast("string")
    for name, terms in reversed(words.items()):
        out = F.when(_has(low, terms), name).otherwise(out)
    return out


def content_signals(rows: DataFrame, text: str, markers: Sequence[str], complexity: Mapping[str, Sequence[str]] = COMPLEXITY_WORDS, domains: Mapping[str, Sequence[str]] = DOMAIN_WORDS) -> DataFrame:
    """``rows`` with markers (array), complexity and domain."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, F.lower(m)))
    return rows.withColumns(
        {"markers": found, "complexity": first_of(F.col(text), complexity, "medium"), "domain": first_of(F.col(text), domains, "")}
    )


def recommended(signals: DataFrame, skills: DataFrame, tone: str | None = None, layer: str | None = None) -> DataFrame:
    """(query_id, skill): of a query's (query_id, skill, priority) signals the first with the tone, if any has it, and among these with the layer, if any has it."""
    rows = signals.join(F.broadcast(skills), "skill")  # the skill table: a fixed list
    every = Window.partitionBy("query_id")
    for name, value in (("tone", tone), ("layer", layer)):
        if value is not None:
            fits = F.coalesce(F.col(name) == value, F.lit(False))
            rows = rows.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(every)).filter(F.col("_fits") | ~F.col("_any")).drop("_fits", "_any")
    return rows.groupBy("query_id").agg(F.min_by("skill", F.struct("priority", "skill")).alias("skill"))
