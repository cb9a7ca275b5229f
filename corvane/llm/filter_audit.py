"""Filter interaction audit: what each of five filters removes, in every order of them, from one pass over the texts.

A document's failures are a mask of five bits. ``failures`` finds the masks; ``parity_sums`` sums, for each part and label, 32 signs: sum w counts a
document as +1 if it fails an even number of the filters of w, else -1 (a Walsh-Hadamard transform of the counts of masks). Its inverse, exact
in integers, gives the documents of each mask; everything else follows from these 32 cells:

- a filter that runs after the filters ``before`` removes the cells that hold it and none of ``before``, and keeps those that hold neither;
- over all 120 orders, a filter is the first of a document's ``k`` failures in 120 / k of them: its Shapley value is the sum of that.

Filter E looks for equal texts in the whole table. Texts are compared by their SHA-256. Rows of one text are counted by part, label and mask before
they meet, so a text that a third of the table has is no hot group.

Edge cases: a null text is the empty one. A null part is the empty string, as is a part of that name. Rows that repeat a key and a text count each; equal
keys aren't smaller than each other, and a null key is neither smaller nor larger than any. Labels that repeat a key count once: a document is
good (toxic) if any of its labels says so; a null label says nothing, and labels of no document or a null key aren't counted. Texts are taken whole,
however long. Columns of other names, whatever they are, aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(order) for order in permutations(FILTERS)]
LABELS = ("all", "good", "toxic")
_SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """The mask of filters A to D: bit n is filter n."""
    words = F.array_remove(F.split(text, _SPACES), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals.cast("bigint") > 3 * F.length(text).cast("bigint"), text.rlike("[#$%&*|]")]
    return reduce(Column.bitwiseOR, (F.when(test, 1 << n).otherwise(0) for n, test in enumerate(tests)))


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, good, toxic, mask, n): documents by part, labels and the filters that they fail."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("_key", "part", F.unhex(F.sha2("_text", 256)).alias("_digest"), text_failures(F.col("_text")).alias("mask"))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    known = known.agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    # rows that repeat key and text are one from here on
    rows = rows.groupBy("_key", "part", "_digest", "mask").agg(F.count("*").alias("n")).join(known, "_key", "left")
    rows = rows.select("_key", "n", "part", "_digest", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    keyless, first = F.when(F.col("_key").isNull(), F.col("n")).otherwise(0), F.when(F.col("_key").isNotNull(), F.struct("_key", "n"))
    groups = rows.groupBy("_digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.sum(keyless).alias("_keyless"), F.min(first).alias("_first"))
    groups = written(groups.select("_digest", "part", "good", "toxic", "mask", "n", "_keyless", F.col("_first._key").alias("_least"), F.col("_first.n").alias("_at")), "texts")
    least = groups.groupBy("_digest").agg(F.min("_least").alias("_smallest"))
    met = groups.join(least, "_digest")
    # of a group, only rows with the smallest key of all rows of that text, and rows without a key, aren't copies
    kept = F.col("_keyless") + F.when(F.col("_least") == F.col("_smallest"), F.col("_at")).otherwise(0)
    copies = F.array(F.struct(F.lit(0).alias("e"), kept.alias("n")), F.struct(F.lit(1 << 4).alias("e"), (F.col("n") - kept).alias("n")))
    split = met.select("part", "good", "toxic", "mask", F.explode(copies).alias("_c")).select("part", "good", "toxic", F.col("mask").bitwiseOR(F.col("_c.e")).alias("mask"), F.col("_c.n").alias("n"))
    return split.filter("n > 0").groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def _sign(shared: Column) -> Column:
    """+1 for an even number of bits, else -1."""
    return 1 - 2 * (F.bit_count(shared) % 2)


def parity_sums(masks: DataFrame) -> DataFrame:
    """(part, label, sums): for each set w of filters the sum of signs of the documents, over all of them, the good and the toxic ones."""
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))))
    signs = [_sign(F.col("mask").bitwiseAND(w)) * F.col("n") for w in range(CELLS)]
    sums = masks.select("*", F.explode(labels).alias("label")).groupBy("part", "label").agg(*(F.sum(sign).alias(f"s{w}") for w, sign in enumerate(signs)))
    return sums.select("part", "label", F.array(*(f"s{w}" for w in range(CELLS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): documents that fail exactly the filters of each mask, by the inverse transform; zeros for labels that a part lacks."""
    sets, zero = F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("bigint")

    def documents(mask: Column) -> Column:
        return F.aggregate(sets, zero, lambda total, w: total + F.get("sums", w) * _sign(w.bitwiseAND(mask))).cast("bigint")

    # the transform is its own inverse but for the factor: the sum is a multiple of CELLS
    found = sums.select("part", "label", F.transform(sets, lambda mask: F.shiftright(documents(mask), CELLS.bit_length() - 1)).alias("_cells"))
    none = F.array(*[F.lit(0).cast("bigint")] * CELLS)
    return found.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == label, F.col("_cells"))), none).alias(label) for label in LABELS))


def _sum(counts: str, masks: str) -> Column:
    return F.aggregate(masks, F.lit(0).cast("bigint"), lambda total, mask: total + F.get(counts, mask))


def evaluate(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the cells of the part."""
    grid = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            holds = [m for m in range(CELLS) if m & own]
            grid.append((order, step, own, [m for m in holds if not m & before], [m for m in holds if m & before], [m for m in range(CELLS) if not m & (own | before)]))
            before |= own
    # 600 fixed rows, whatever the tables hold
    steps = counted.sparkSession.createDataFrame(grid, "filter_order string, step int, own int, _first array<int>, _later array<int>, _kept array<int>")
    shares = F.aggregate(F.concat("_first", "_later"), F.lit(0).cast("bigint"), lambda total, m: total + F.get("all", m) * F.get(F.array(*(F.lit(0 if m == 0 else len(ORDERS) // m.bit_count()) for m in range(CELLS))), m))
    return counted.join(F.broadcast(steps)).select(
        "part", "filter_order", "step", _sum("all", "_kept").alias("kept"), _sum("all", "_first").alias("removed"), _sum("all", "_later").alias("redundant"),
        F.get("all", F.col("own")).alias("unique_fails"), _sum("good", "_first").alias("good_lost"), _sum("toxic", "_first").alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): all 120 orders of the five filters in each part."""
    return evaluate(cells(written(parity_sums(failures(docs, labels, key, text, part)), "parity")))


def audit_sql() -> str:
    """The audit by its definition: every order applied to every kind of document."""
    orders = ", ".join(f"('{order}')" for order in ORDERS)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
smallest AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
words AS (SELECT t.*, least, list_filter(regexp_split_to_array(t.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM texts t JOIN smallest s ON s.text = t.text),
failed AS (SELECT doc_id, part,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM words),
marked AS (SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic FROM failed f
  LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = f.doc_id),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY part, fails),
steps AS (SELECT o.filter_order, s.step::INT AS step, substr(o.filter_order, s.step::INT, 1) AS f, substr(o.filter_order, 1, s.step::INT - 1) AS before
  FROM (VALUES {orders}) o(filter_order), range(1, 6) s(step)),
each AS (SELECT k.*, filter_order, step, f, contains(fails, f) AS fails_it, length(translate(fails, before, '')) < length(fails) AS gone
  FROM kinds k, steps),
rows AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT fails_it AND NOT gone) AS kept, sum(n) FILTER (fails_it AND NOT gone) AS removed,
  sum(n) FILTER (fails_it AND gone) AS redundant, sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (fails_it AND NOT gone) AS good_lost,
  sum(toxic) FILTER (fails_it AND NOT gone) AS toxic_lost FROM each GROUP BY part, filter_order, step, f),
shares AS (SELECT part, f, sum(removed) AS shapley FROM rows GROUP BY part, f)
SELECT r.part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
FROM rows r JOIN shares s ON s.part = r.part AND s.f = r.f"""
