"""Incremental blob ledger for secret scans, in DataFrame functions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger is a table of
(blob, rule_version, spans): a scan looks only at blobs that have no entry for the current
rule version, each once however many paths hold it, and findings are joined back to all paths. The rule version is a digest of the rules, so
that entries of other rules are never taken for those of the current ones.

Spans are found by marking: a regular expression puts a start and an end sign around each
leftmost match, the text is split at the signs, and running sums of the lengths of the pieces (rows of numbers, in a window by blob) are code
point positions; work is linear in a text's length and matches. Signs that a text itself holds are first replaced by another character that no
rule looks at, so lengths stay.

Edge cases: a null text is the empty blob; repeated rows are paths of their own with the same
findings; texts are scanned whole, however long; null paths are paths as others. An empty table gives an empty result. Only the key and text columns are
read, whatever the names of others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_salted, written

#: Sign that opens a match, sign between a match and its counted part, sign that closes it, and a stand-in.
OPEN, PART, CLOSE, OTHER = "\x01", "\x02", "\x03", "\x04"


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost, without overlaps; matches count if ``part`` of them (a group; 0: all) has ``least`` characters.

    With a part, ``pattern`` must be that group's end, and ``before`` the expression in front of it.
    """

    kind: str
    pattern: str
    least: int
    before: str = ""


#: Fixed values of the rule list; ``hex`` and ``access`` have their least lengths in the pattern, which
#: finds the same spans as greedy runs that are then filtered.
BASE_RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: What the method adds to the base rules: the opening line of a private key.
ADDED_RULES = (Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),)


NO_SPANS = "cast(array() as array<struct<start: bigint, kind_at: int, kind: string, end: bigint>>)"


def rule_version(rules: Sequence[Rule]) -> str:
    """A digest of the rules: any change of theirs makes it another."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.least, r.before) for r in rules]).encode()).hexdigest()[:16]


def _pieces(text: Column, at: int, rule: Rule) -> Column:
    """array<struct<rule, front, size, width>> of the text's pieces: length before the counted part, of the part (null: no match), and of the whole piece."""
    marked = F.regexp_replace(text, f"({rule.before})({rule.pattern})", f"{OPEN}$1{PART}$2{CLOSE}")

    # pieces after the first begin with a match: before-part, counted part, rest
    def measured(piece: Column) -> Column:
        front = F.locate(PART, piece).cast("bigint") - 1
        back = F.locate(CLOSE, piece).cast("bigint") - 1
        width = F.length(piece).cast("bigint")
        size = F.when(back > 0, back - front - 1)
        return F.struct(F.lit(at).alias("rule"), front.alias("front"), size.alias("size"), F.when(back > 0, width - 2).otherwise(width).alias("width"))

    return F.transform(F.split(marked, OPEN), measured)


def _any_of(text: Column, rules: Sequence[Rule]) -> Column:
    hit = F.lit(False)
    for rule in rules:
        hit = hit | text.rlike(rule.before + rule.pattern)
    return hit


def scan(blobs: DataFrame, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """(blob, spans) of (blob, text), one row a blob: spans ordered by start, then by the rules' order."""
    clean = F.translate("text", OPEN + PART + CLOSE, OTHER * 3)
    none = F.expr("array(cast(null as struct<rule: int, front: bigint, size: bigint, width: bigint>))")
    pieces = F.when(_any_of(F.col("text"), rules), F.concat(*[_pieces(F.col("_clean"), at, rule) for at, rule in enumerate(rules)])).otherwise(none)
    rows = blobs.select("blob", "text", clean.alias("_clean")).select("blob", F.posexplode(pieces).alias("at", "p"))
    rows = rows.select("blob", "at", "p.*")
    before = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0)))
    kinds, least = (F.array(*[F.lit(getattr(r, c)) for r in rules]) for c in ("kind", "least"))
    span = F.struct("start", F.col("rule").alias("kind_at"), F.get(kinds, F.col("rule")).alias("kind"), (F.col("start") + F.col("front") + F.col("size")).alias("end"))
    kept = F.when(F.col("size") >= F.get(least, F.col("rule")), span)
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(kept)).alias("spans"))


def update_ledger(
    paths: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES, version: str | None = None
) -> DataFrame:
    """The new entries (blob, rule_version, spans) that (path, blob, text) rows call for, given the ledger so far.

    Each unseen blob's text is taken from the row with its smallest path; texts move once, keyed by path, so that copies of one blob
    don't meet in a task.
    """
    version = version or rule_version(rules)
    firsts = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        firsts = firsts.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    # a struct is never null, even of a null path: texts stay where the join put them when repeated rows go
    firsts = firsts.select("blob", F.struct("path").alias("_at"))
    unseen = paths.select("blob", "text", F.struct("path").alias("_at")).join(firsts, ["blob", "_at"])
    # rows that repeat path and text are one scan
    unseen = unseen.dropDuplicates(["blob", "_at"])
    return scan(unseen.select("blob", "text"), rules).select("blob", F.lit(version).alias("rule_version"), "spans")


def _joined(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    base: Sequence[Rule] = BASE_RULES,
    added: Sequence[Rule] = ADDED_RULES,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """(key, n_<kind> of each base rule, base_sha256, spans) of every row, through the ledger: what it lacks is scanned and added."""
    paths = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paths = paths.withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    version = rule_version([*base, *added])
    entries = written(update_ledger(paths, ledger, [*base, *added]), "secret-ledger")
    if ledger is not None:
        entries = entries.unionByName(ledger.filter(F.col("rule_version") == version).select("blob", "rule_version", "spans"))
    # most blobs have nothing to say: only those with findings are joined, the rest are null
    findings = entries.filter(F.size("spans") > 0).select("blob", "spans")
    # a blob that very many paths have, such as the empty text, is dealt over tasks
    named = written(paths.select("path", "blob"), "secret-paths")
    counts = written(named.groupBy("blob").agg(F.count("*").alias("n")), "secret-counts")
    rows = join_salted(named, findings, ["blob"], how="left", by=["path"], counts=counts)
    spans = F.coalesce("spans", F.expr(NO_SPANS))
    rows = rows.select("path", spans.alias("spans"))
    counts = [F.size(_of_kind(F.col("spans"), r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in base]
    of_base = F.filter("spans", lambda s: s["kind_at"] < len(base))
    return rows.select(F.col("path").alias(key), *counts, F.sha2(F.encode(_joined(of_base), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def find_in_two_steps(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``find_secrets`` of a growing table: the first half of the blobs is scanned and stored, the second scan takes them from the ledger."""
    paths = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paths = paths.withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    ledger = written(update_ledger(paths.filter(F.col("blob") < "8")), "secret-ledger")
    return find_secrets(docs, key, text, ledger=ledger)


def _kind_sql(name: str, at: int, pattern: str, least: int) -> str:
    mark = f"regexp_replace(t, '({pattern[0]})({pattern[1]})', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g')"
    return f"""
    SELECT doc_id, '{name}' AS kind, {at} AS kind_at, part_start AS s, part_start + length(front) + length(body) AS e
    FROM (SELECT doc_id, piece, CASE WHEN k > 1 THEN split_part(piece, chr(2), 1) END AS front,
            CASE WHEN k > 1 THEN split_part(split_part(piece, chr(2), 2), chr(3), 1) END AS body,
            sum(length(piece) - CASE WHEN k > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) + CASE WHEN k > 1 THEN 2 ELSE 0 END AS part_start, k
          FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
                FROM (SELECT doc_id, string_split({mark}, chr(1)) AS pieces FROM c)))
    WHERE k > 1 AND length(body) >= {least}"""


FIND_SECRETS_SQL = f"""
WITH c AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS t FROM documents),
f AS ({
    " UNION ALL ".join([
        _kind_sql("assign", 0, ("(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?", "[A-Za-z0-9+/_.=-]+"), 6),
        _kind_sql("access", 1, ("", "AKIA[A-Z0-9]{16,}"), 20),
        _kind_sql("hex", 2, ("", "[0-9a-f]{24,}"), 24),
        _kind_sql("key", 3, ("", "-----BEGIN [A-Z ]*PRIVATE KEY-----"), 1),
    ])
}),
g AS (SELECT doc_id, count(*) FILTER (kind_at = 0) AS n_assign, count(*) FILTER (kind_at = 1) AS n_access, count(*) FILTER (kind_at = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_at) FILTER (kind_at < 3) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_at) AS spans
      FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""
