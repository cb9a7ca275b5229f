"""Lines of text files of any size and encoding, read by byte ranges.

Files are listed by Spark without their content and cut into ranges; a line belongs to the range in which its first byte lies, so every range is
a row of its own that any task can read. Two passes: the first finds what each encoding and the test for binary content need to know of a range, which is
combined by file; the second decodes the ranges of text files. Results equal those of ``files.decode`` and ``files.binary_kind`` on whole files,
as no line end is part of a longer character in the encodings tried.

Edge cases: an empty file has no lines; a last line without a line end counts, an empty one after the last line end doesn't; carriage returns are kept.
A line longer than a range is read by the task in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.files import CONTROL_SHARE, ENCODINGS, MAGIC, MARKS, ZERO_SHARE

#: Bytes of a range, and of a step in the search for a line end; multiples of the widest unit, four bytes.
RANGE, STEP = 32 << 20, 1 << 16
#: Rows of an Arrow batch.
ROWS = 4096
_CODECS = {mark: (name, "utf-8" if name == "utf-8-sig" else name + ("-be" if mark in (b"\xfe\xff", b"\x00\x00\xfe\xff") else "-le")) for mark, name in MARKS}
#: The encodings that a file without a mark may fail; the one after them fits all bytes.
_TRIED = tuple(e for e in ENCODINGS[: ENCODINGS.index("latin-1")] if e != "utf-8-sig")
_CONTROLS = bytes([*range(9), *range(14, 32)])


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, length, start) of the ranges of all files under ``path``; no content is read, and a file may have any length."""
    if size <= 0 or size % 4:
        raise ValueError("the size of a range is a positive multiple of four")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    return found.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start"))


def _opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _line_start(file: pa.NativeFile, at: int, length: int, newline: bytes) -> int:
    """The first byte of the first line that begins at ``at`` or later, or the end of the file."""
    width = len(newline)
    if at == 0 or at >= length:
        return min(at, length)
    place = at - width
    while place < length:
        block = file.read_at(min(STEP, length - place), place)
        hit = block.find(newline)
        while hit >= 0 and hit % width:
            hit = block.find(newline, hit + 1)
        if hit >= 0:
            return place + hit + width
        place += len(block)
    return length


def _piece(path: str, length: int, start: int, size: int) -> tuple[bytes, bytes]:
    """(mark, bytes of the lines that begin in the range)."""
    with _opened(path) as file:
        first = file.read_at(min(4, length), 0)
        mark = next((m for m, _ in MARKS if first.startswith(m)), b"")
        newline = "\n".encode(_CODECS[mark][1]) if mark else b"\n"
        begin = len(mark) if start == 0 else _line_start(file, start, length, newline)
        end = _line_start(file, min(start + size, length), length, newline)
        return mark, file.read_at(end - begin, begin) if end > begin else b""


def _fits(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def file_encodings(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, encoding, kind) of all files that aren't empty, over all of their ranges: kind is that of binary content, null for text."""
    names = ["path", "start", "mark", "magic", *_TRIED, "zeros", "controls"]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mark, data = _piece(row["path"], row["length"], row["start"], size)
                magic = next((name for name, m in MAGIC.items() if data.startswith(m)), None) if row["start"] == 0 and not mark else None
                fits = [not mark and _fits(data, e) for e in _TRIED]
                zeros, controls = data.count(b"\0"), len(data) - len(data.translate(None, _CONTROLS))
                row = [row["path"], row["start"], _CODECS[mark][0] if mark else None, magic, *fits, zeros, controls]
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], pa.schema(
                    [("path", pa.string()), ("start", pa.int64()), ("mark", pa.string()), ("magic", pa.string()), *[(e, pa.bool_()) for e in _TRIED], ("zeros", pa.int64()), ("controls", pa.int64())]
                ))

    every = ranges(spark, path, size)
    types = "path string, start bigint, mark string, magic string, " + ", ".join(f"`{e}` boolean" for e in _TRIED) + ", zeros bigint, controls bigint"
    found = every.repartition("path", "start").mapInArrow(facts, types)
    sums = found.groupBy("path").agg(F.max("mark").alias("mark"), F.max("magic").alias("magic"), *[F.every(F.col(f"`{e}`")).alias(e) for e in _TRIED], F.sum("zeros").alias("zeros"), F.sum("controls").alias("controls"))
    sums = sums.join(every.filter("start = 0").select("path", "length"), "path")
    encoding = F.coalesce("mark", *[F.when(F.col(f"`{e}`"), e) for e in _TRIED], F.lit("latin-1"))
    many = (F.col("zeros") / F.col("length") > ZERO_SHARE) | (~F.col("`utf-8`") & (F.col("controls") / F.col("length") > CONTROL_SHARE))
    return sums.select("path", encoding.alias("encoding"), F.when(F.col("mark").isNull(), F.coalesce("magic", F.when(many, "binary"))).alias("kind"))


def read_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, encoding, start, at, line): the lines of all text files under ``path``; (start, at) orders a file's lines, as range and place in it."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mark, data = _piece(row["path"], row["length"], row["start"], size)
                text = data.decode(_CODECS[mark][1], errors="replace") if mark else data.decode(row["encoding"])
                if not text:
                    continue
                found = text.removesuffix("\n").split("\n")
                for first in range(0, len(found), ROWS):
                    part = found[first : first + ROWS]
                    yield pa.RecordBatch.from_pydict(
                        {"path": [row["path"]] * len(part), "encoding": [row["encoding"]] * len(part), "start": [row["start"]] * len(part), "at": list(range(first, first + len(part))), "line": part}
                    )

    texts = file_encodings(spark, path, size).filter("kind IS NULL").select("path", "encoding")
    # a large file has many ranges: they are dealt by their starts after the join
    dealt = ranges(spark, path, size).join(texts, "path").repartition("path", "start")
    return dealt.mapInArrow(lines, "path string, encoding string, start bigint, at bigint, line string")
