"""Token budgets and the compression of conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X

#: Priorities: what is dropped first has the largest number.
CRITICAL, HIGH, NORMAL, LOW = 0, 1, 2, 3


def prioritized(messages: DataFrame, edge: int = 3, long: int = 800, short: int = 20) -> DataFrame:
    """Adds ``tokens`` and ``priority``: system messages are critical; first and last ``edge`` ones and long ones high; short ones without a question low."""
    whole = Window.partitionBy("conv_id")
    n = F.count("*").over(whole)
    place = F.row_number().over(whole.orderBy("turn"))
    size = F.length("content")
    priority = (
        F.when(F.col("role") == "system", CRITICAL)
        .when(F.col("role") == "tool", HIGH)
        .when((place <= edge) | (place > n - edge), HIGH)
        .when(size > long, HIGH)
        .when((size < short) & ~F.contains("content", F.lit("?")), LOW)
        .otherwise(NORMAL)
    )
    return messages.withColumn("tokens", X.tokens_estimate(F.col("content"))).withColumn("priority", priority)


def middle_removal(messages: DataFrame, target: int) -> DataFrame:
    """Messages that stay: of those that aren't critical or high, the lowest priorities go first, from the start, until the rest fits ``target`` tokens."""
    rows = prioritized(messages)
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("_excess", F.sum("tokens").over(whole) - target)
    can_go = F.col("priority") >= NORMAL
    walk = whole.orderBy(F.when(can_go, 0).otherwise(1), F.desc("priority"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_gone", F.coalesce(F.sum("tokens").over(walk), F.lit(0)))
    return rows.filter(~(can_go & (F.col("_gone") < F.col("_excess")))).select("conv_id", "turn", "role", "tokens", "priority")


def oldest_removal(messages: DataFrame, target: int, least: int = 2) -> DataFrame:
    """Messages that stay when the oldest that aren't critical go first, but ``least`` messages at least stay."""
    rows = prioritized(messages)
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("_excess", F.sum("tokens").over(whole) - target).withColumn("_n", F.count("*").over(whole))
    can_go = F.col("priority") > CRITICAL
    order = whole.orderBy(F.when(can_go, 0).otherwise(1), F.desc("priority"), "turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_gone", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("_place", F.row_number().over(order))
    gone = can_go & (F.col("_gone") < F.col("_excess")) & (F.col("_place") <= F.col("_n") - least)
    return rows.filter(~gone).select("conv_id", "turn", "role", "tokens", "priority")


def compression_need(messages: DataFrame, limit: int, threshold: float = 0.8) -> DataFrame:
    """(conv_id, messages, tokens, utilisation, compress, status) of each conversation."""
    rows = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(X.tokens_estimate(F.col("content"))).alias("tokens"))
    share = F.round(F.col("tokens") / float(limit), 6)
    status = F.when(share >= 0.95, "critical").when(share >= 0.8, "warning").otherwise("ok")
    return rows.withColumn("utilisation", share).withColumn("compress", share >= threshold).withColumn("status", status)


def paired(messages: DataFrame, first: str, second: str, within: int = 9) -> DataFrame:
    """(conv_id, turn, answer): each ``first`` message with the nearest ``second`` one in the next ``within`` turns, or null."""
    line = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, within)
    answer = F.min(F.when(F.col("role") == second, F.col("turn"))).over(line)
    return messages.withColumn("answer", answer).filter(F.col("role") == first).select("conv_id", "turn", "answer")


def last_questions(messages: DataFrame, n: int = 2) -> DataFrame:
    """(conv_id, turn, query): each user message with the ``n`` user messages before it, joined."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.filter(F.col("role") == "user")
    parts = [F.lag("content", i).over(line) for i in range(n, 0, -1)]
    return rows.select("conv_id", "turn", F.concat_ws(" | ", *parts, F.col("content")).alias("query"))


def references(messages: DataFrame, pronouns: Sequence[str], n: int = 5) -> DataFrame:
    """(conv_id, turn, target, score): for messages with a pronoun, the best ``n`` earlier ones by shared keywords and length.

    A conversation is joined with itself on its id; conversations are short.
    """
    words = X.keywords(F.col("content"), (), 4)
    low = F.concat(F.lit(" "), F.lower("content"), F.lit(" "))
    marked = F.lit(False)
    for p in pronouns:
        marked = marked | F.contains(low, F.lit(f" {p} "))
    later = messages.filter(marked).select("conv_id", "turn", words.alias("_w"), F.length("content").alias("_l"))
    earlier = messages.select("conv_id", F.col("turn").alias("target"), words.alias("_v"), F.length("content").alias("_m"))
    rows = later.join(earlier, "conv_id").filter("target < turn")
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect("_w", "_v")).cast("double"), F.size("_w").cast("double")), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(F.least("_l", "_m").cast("double"), F.greatest("_l", "_m").cast("double")), F.lit(0.0))
    rows = rows.withColumn("score", F.round(0.5 * shared + 0.2 * ratio, 6))
    line = Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), F.desc("target"))
    return rows.withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= n).select("conv_id", "turn", "target", "score")


def compressed_text(text: Column, most: int = 2000, short: int = 10) -> Column:
    """Text without short comment lines and repeated blank lines, cut at ``most`` characters."""
    lines = F.filter(F.split(text, "\n"), lambda s: ~(F.trim(s).startswith("#") & (F.length(F.trim(s)) < short)))
    return F.left(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(most))


def broken_pairs(messages: DataFrame, kept: DataFrame, first: str, second: str) -> DataFrame:
    """(conv_id, turn, answer, problem): pairs of which the (conv_id, turn) that are ``kept`` lack the question, the answer or both."""
    pairs = paired(messages, first, second).filter("answer is not null")
    there = kept.select("conv_id", F.col("turn"), F.lit(True).alias("_a"))
    rows = pairs.join(there, ["conv_id", "turn"], "left").join(there.select("conv_id", F.col("turn").alias("answer"), F.col("_a").alias("_b")), ["conv_id", "answer"], "left")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    problem = F.when(~a & b, "question removed").when(a & ~b, "answer removed").when(~a & ~b, "pair removed")
    return rows.select("conv_id", "turn", "answer", problem.alias("problem")).filter("problem is not null")


def protected(messages: DataFrame, first: str, second: str) -> DataFrame:
    """(conv_id, turn) of all messages of pairs, each once."""
    pairs = paired(messages, first, second).filter("answer is not null")
    return pairs.select("conv_id", F.explode(F.array("turn", "answer")).alias("turn")).distinct()


def _removed(messages: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, turn) of the messages that aren't kept."""
    return messages.select("conv_id", "turn").join(kept.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


def compression_safety(messages: DataFrame, kept: DataFrame, first: str, second: str, pronouns: Sequence[str], n: int = 5) -> DataFrame:
    """(conv_id, pairs, broken, removed, at_risk, safe) of each conversation: its pairs, those that lose one side or both, and its references to messages that go.

    Safe: no pair loses one side only. Removed pairs and references at risk are reported, but not unsafe.
    """
    pairs = paired(messages, first, second).filter("answer is not null").select("conv_id", F.lit("pairs").alias("kind"))
    lost = broken_pairs(messages, kept, first, second).select("conv_id", F.when(F.col("problem") == "pair removed", "removed").otherwise("broken").alias("kind"))
    gone = _removed(messages, kept).withColumnRenamed("turn", "target")
    risky = references(messages, pronouns, n).join(gone, ["conv_id", "target"], "left_semi").select("conv_id", "turn").distinct().select("conv_id", F.lit("at_risk").alias("kind"))
    every = messages.select("conv_id", F.lit(None).cast("string").alias("kind"))
    rows = every.unionByName(pairs).unionByName(lost).unionByName(risky)
    out = rows.groupBy("conv_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("pairs", "broken", "removed", "at_risk")])
    return out.withColumn("safe", F.col("broken") == 0)


def safe_removals(messages: DataFrame, kept: DataFrame, first: str, second: str, pronouns: Sequence[str], n: int = 5) -> DataFrame:
    """(conv_id, turn) of the messages that aren't kept and can go: those of no pair, to which no message refers."""
    held = protected(messages, first, second).unionByName(references(messages, pronouns, n).select("conv_id", F.col("target").alias("turn")))
    return _removed(messages, kept).join(held, ["conv_id", "turn"], "left_anti")


def compression_report(messages: DataFrame, kept: DataFrame, limit: int, threshold: float = 0.8) -> DataFrame:
    """(conv_id, before, after, tokens_before, tokens_after, ratio, safe): what a compression of the conversations that need one did; the others stay whole.

    Safe: the last message and all system messages stay, and something does.
    """
    need = compression_need(messages, limit, threshold).select("conv_id", "compress")
    marked = kept.select("conv_id", "turn", F.lit(True).alias("_kept"))
    rows = messages.join(need, "conv_id").join(marked, ["conv_id", "turn"], "left").withColumn("stays", ~F.col("compress") | F.col("_kept").isNotNull())
    tokens = X.tokens_estimate(F.col("content"))
    out = rows.groupBy("conv_id").agg(
        F.count("*").alias("before"), F.count_if("stays").alias("after"), F.sum(tokens).alias("tokens_before"), F.coalesce(F.sum(F.when(F.col("stays"), tokens)), F.lit(0)).alias("tokens_after"),
        (F.bool_and(F.col("stays") | (F.col("role") != "system")) & F.max_by("stays", "turn")).alias("safe"),
    )
    ratio = F.round(F.coalesce(F.try_divide(F.col("tokens_after").cast("double"), F.col("tokens_before").cast("double")), F.lit(1.0)), 6)
    return out.select("conv_id", "before", "after", "tokens_before", "tokens_after", ratio.alias("ratio"), "safe")
