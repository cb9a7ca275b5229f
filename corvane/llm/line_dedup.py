"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines with ``min_words`` words that begins at a line, or that ends at one. Each window selects its least line hash
(the last of equals; blank lines are never selected) as a fingerprint, and only the positions selected by some window are fingerprints of a text. Any repeated
run of ``min_words`` words or more holds a whole window, and equal windows select the same line, so both places of the run share a fingerprint: the
guarantee of winnowing. Positions are joined by fingerprint, and those that stand alone, most of them, are dropped. A
position that meets another is then extended both ways over the windows that selected it, and verified: a window that stands
at an earlier place too (by document id, text hash and line; two 64-bit hashes over its lines) is a repeated run, and its lines in the later place are deleted.

The windows beside a match carry it on, those that begin at later lines to the right, those that end at earlier ones to the left. This is exact: of a
repeated run, a line from which ``min_words`` words are left lies in a window that begins there and is repeated itself; any other line lies in the window
that ends with the run. So each line in a run of ``min_words`` words or more that stands earlier, anywhere, is deleted, whichever earlier places
its parts have, and no position is compared with more than its windows' first places. The first place of a line's text is never
deleted, so no text vanishes from the corpus.

Lines are split at ``\\n`` and compared without the ASCII blanks at their ends. Kept lines stay
byte for byte, joined by ``\\n``.

Edge cases: null texts stay null, with 0 lines; an empty text is one empty line. Texts are taken whole; time and memory are linear in their lines, blank or
not. Rows that repeat a document id and text are one document with one decision, which all of them get; equal ids with other texts are other documents. A
null id orders before all others. Keys are whole numbers. An empty table gives an empty result. ``clean`` leaves all other columns as they are, whatever their names.

Only fingerprints (8 bytes each), the windows around repeated ones (16) and line hashes move between tasks before the last join,
which moves each text once, by document. Hot fingerprints and windows are counted first and dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_salted, mix64, small_batches, written

MIN_WORDS = 50
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
_BLANKS = b" \t\n\v\f\r"
#: A name that no caller's column has.
FOUND = "_lines_93d5fa"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _run_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each run of lines from ``low`` to before ``high``, from running sums, so that a run's length costs nothing."""
    out = []
    with np.errstate(over="ignore"):
        for base in _BASES:
            values = mix64(hashes ^ _U(base))
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * _powers(base, len(values)), dtype=_U)])
            inverse = _powers(pow(base, -1, 1 << 64), len(values) + 1)
            out.append(mix64((sums[high] - sums[low]) * inverse[low] + (high - low).astype(_U)))
    return out


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the least value in each run from ``low`` to before ``high``, the last of equals: a table of runs of 1, 2, 4, ... lines."""
    out = np.empty(len(low), np.int64)
    level = np.frexp((high - low).astype(float))[1] - 1
    table = np.arange(len(values))
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        a, b = table[low[here]], table[high[here] - (1 << k)]
        out[here] = np.where(values[b] <= values[a], b, a)
        if 1 << k < len(table):
            a, b = table[: -(1 << k)], table[1 << k :]
            table = np.where(values[b] <= values[a], b, a)
    return out


def windows(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, end: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, selected) of all windows of the lines of several texts; ``first`` and ``end`` bound the text of each line."""
    n = len(words)
    after = np.cumsum(words)
    before = after - words
    line = np.arange(n)
    last = np.searchsorted(after, before + min_words)
    whole = last < end
    onward = line[whole], last[whole] + 1
    start = np.searchsorted(before, after - min_words, side="right") - 1
    whole = start >= first
    back = start[whole], line[whole] + 1
    low, high = np.concatenate([onward[0], back[0]]), np.concatenate([onward[1], back[1]])
    values = np.where(words > 0, hashes >> _U(1), ~_U(0))
    return low, high, _least(values, low, high)


def _of_batch(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end): bounds of the text of each line, given the numbers of lines of the texts."""
    ends = np.cumsum(counts)
    return np.repeat(ends - counts, counts), np.repeat(ends, counts)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _profiles(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, version, hashes, words, at, prints): line hashes and word counts of each text, and its selected lines with their hashes."""
    import xxhash

    def profile(batches):
        for batch in batches:
            lines = [[line.strip(_BLANKS) for line in text.split(b"\n")] for text in batch.column(2).cast(pa.binary()).to_pylist()]
            counts = np.array([len(x) for x in lines], np.int64)
            hashes = np.array([xxhash.xxh3_64_intdigest(line) for own in lines for line in own], _U)
            words = np.array([len(line.split()) for own in lines for line in own], np.int64)
            first, end = _of_batch(counts)
            selected = np.unique(windows(hashes, words, first, end, min_words)[2])
            chosen = np.bincount(np.searchsorted(np.cumsum(counts), selected, side="right"), minlength=len(counts))
            columns = [
                _lists(hashes.view(np.int64), counts, pa.int64()), _lists(words.astype(np.int32), counts, pa.int32()),
                _lists((selected - first[selected]).astype(np.int32), chosen, pa.int32()), _lists(hashes[selected].view(np.int64), chosen, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "version", "hashes", "words", "at", "prints"])

    schema = "id bigint, version bigint, hashes array<bigint>, words array<int>, at array<int>, prints array<bigint>"
    return docs.mapInArrow(profile, schema)


def _around(batches, min_words: int) -> Iterator[pa.RecordBatch]:
    """(id, version, low, high, key, check): the windows that selected one of the lines ``at``, with the hashes of their lines."""
    for batch in batches:
        hashes, words, at = (batch.column(c) for c in ("hashes", "words", "at"))
        counts = np.diff(hashes.offsets.to_numpy())
        first, end = _of_batch(counts)
        lines = hashes.flatten().to_numpy().view(_U)
        low, high, selected = windows(lines, words.flatten().to_numpy().astype(np.int64), first, end, min_words)
        kept = np.zeros(len(lines), bool)
        texts = np.repeat(np.arange(len(counts)), np.diff(at.offsets.to_numpy()))
        kept[(np.cumsum(counts) - counts)[texts] + at.flatten().to_numpy()] = True
        here = kept[selected]
        low, high = low[here], high[here]
        key, check = _run_hashes(lines, low, high)
        text = np.searchsorted(np.cumsum(counts), low, side="right")
        ids, versions = (batch.column(c).to_numpy()[text] for c in ("id", "version"))
        start = first[low] if len(low) else low
        columns = [ids, versions, (low - start).astype(np.int32), (high - start).astype(np.int32), key.view(np.int64), check.view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "version", "low", "high", "key", "check"])


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """(id, version, runs): the union of the lines in a document's runs, as ordered runs from low to before high."""
    for batch in batches:
        out = []
        for runs in batch.column(2).to_pylist():
            own: list[dict[str, int]] = []
            for low, high in sorted((r["low"], r["high"]) for r in runs):
                if own and low <= own[-1]["high"]:
                    own[-1]["high"] = max(high, own[-1]["high"])
                else:
                    own.append({"low": low, "high": high})
            out.append(own)
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["id", "version", "runs"])


def _id(key: Column) -> Column:
    return F.coalesce(key.cast("bigint"), F.lit(-(2**63)))


def _version(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, version, runs): for each document with repeated runs, the lines to delete, as ordered runs (low, high) from 0, high excluded."""
    small_batches(docs.sparkSession)
    texts = docs.filter(F.col(text).isNotNull()).select(_id(F.col(key)).alias("id"), _version(F.col(text)).alias("version"), F.col(text).alias("text"))
    profiles = written(_profiles(texts, min_words), "line-profiles")

    # positions by fingerprint: those that stand alone go
    positions = profiles.select("id", "version", F.explode(F.arrays_zip("prints", "at")).alias("p"))
    positions = positions.select(F.col("p.prints").alias("print"), "id", "version", F.col("p.at").alias("at"))
    shared = written(positions.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"), "line-fingerprints")
    meeting = join_salted(positions, shared, ["print"])
    meeting = meeting.groupBy("id", "version").agg(F.collect_set("at").alias("at"))

    # the windows around the others, and the first place of each
    lines = profiles.select("id", "version", "hashes", "words").dropDuplicates(["id", "version"])
    around = meeting.hint("merge").join(lines, ["id", "version"]).select("id", "version", "hashes", "words", "at")
    schema = "id bigint, version bigint, low int, high int, key bigint, check bigint"
    places = written(around.mapInArrow(lambda b: _around(b, min_words), schema), "line-windows")
    place = F.struct("id", "version", "low", "high")
    firsts = places.groupBy("key", "check").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    firsts = written(firsts.filter("first < last").drop("last"), "line-firsts")
    later = join_salted(places, firsts, ["key", "check"]).filter(F.col("first") < place)
    later = later.groupBy("id", "version").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    return later.mapInArrow(_merged, "id bigint, version bigint, runs array<struct<low: int, high: int>>")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, deleted: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; with ``deleted``, a column of that name has their numbers."""
    found = repeated_runs(docs, key, text, min_words).select(F.struct("id", "version").alias(FOUND), F.struct("runs").alias(FOUND + "r"))
    here = F.struct(_id(docs[key]).alias("id"), _version(docs[text]).alias("version"))
    # the deletions grow with the input: never broadcast
    rows = docs.join(found.hint("merge"), here == F.col(FOUND), "left")
    runs = F.col(FOUND + "r.runs")
    # kept runs lie between the deleted ones; the lines are bound to a variable, so that a text is split once
    def kept_of(own: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["high"]))
        ends = F.concat(F.transform(runs, lambda r: r["low"]), F.array(F.size(own)))
        parts = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] < p["b"])
        return F.array_join(F.transform(parts, lambda p: F.array_join(F.slice(own, p["a"] + 1, p["b"] - p["a"]), "\n")), "\n")

    kept = F.transform(F.array(F.split(docs[text], "\n")), kept_of)[0]
    columns = [F.when(runs.isNull(), docs[text]).otherwise(kept).alias(text) if c == text else docs[c] for c in docs.columns]
    if deleted is not None:
        numbers = F.flatten(F.transform(runs, lambda r: F.sequence(r["low"], r["high"] - 1)))
        columns.append(F.coalesce(numbers, F.array().cast("array<int>")).alias(deleted))
    return rows.select(*columns)


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, n_lines, n_deleted, deleted, kept_bytes, kept_sha256) of every row; ``deleted`` are line numbers from 0, comma-joined."""
    before = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("_lines"))
    after = clean(before, "_key", "_text", min_words, "_deleted_lines")
    return after.select(
        F.col("_key").alias(key),
        F.when(F.col("_text").isNull() & (F.size("_deleted_lines") == 0), 0).otherwise(F.col("_lines")).cast("bigint").alias("n_lines"),
        F.size("_deleted_lines").cast("bigint").alias("n_deleted"),
        F.array_join(F.col("_deleted_lines").cast("array<string>"), ",").alias("deleted"),
        F.octet_length("_text").cast("bigint").alias("kept_bytes"),
        F.sha2(F.encode("_text", "UTF-8"), 256).alias("kept_sha256"),
    )


#: DuckDB SQL of ``line_report``, from the definition: the lines of all windows that stand at an earlier place too.
LINE_REPORT_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, i, raw, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM t),
d AS (SELECT doc_id, list(line ORDER BY i) AS own, list(after ORDER BY i) AS sums, list(after - words ORDER BY i) AS befores FROM c GROUP BY 1),
w AS (SELECT c.doc_id, i AS low, i + len(list_filter(sums[i + 1:], lambda x: x < after - words + {MIN_WORDS})) + 1 AS high, len(own) AS n, own FROM c JOIN d USING (doc_id)
  UNION SELECT c.doc_id, len(list_filter(befores[:i + 1], lambda x: x <= after - {MIN_WORDS})) - 1, i + 1, len(own), own FROM c JOIN d USING (doc_id)),
k AS (SELECT doc_id, low, high, array_to_string(own[low + 1:high], chr(10)) AS content FROM w WHERE low >= 0 AND high <= n),
e AS (SELECT doc_id, low, high FROM k QUALIFY (doc_id, low, high) <> min((doc_id, low, high)) OVER (PARTITION BY content)),
g AS (SELECT DISTINCT doc_id, unnest(range(low, high)) AS i FROM e),
r AS (SELECT t.doc_id, count(g.i) AS n_deleted, string_agg(g.i::VARCHAR, ',' ORDER BY t.i) AS deleted, coalesce(string_agg(raw, chr(10) ORDER BY t.i) FILTER (g.i IS NULL), '') AS kept,
  count(*) AS n_lines FROM t LEFT JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(deleted, '') AS deleted, strlen(kept)::BIGINT AS kept_bytes, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)"""
