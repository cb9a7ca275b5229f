"""File sources and sinks: text of unknown encoding, JSON knowledge, and exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order of trial, after byte order marks (fixed values).
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "latin-1", "cp1252")
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: First bytes of binary formats (fixed values).
MAGIC = {
    "png": b"\x89PNG", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "pdf": b"%PDF", "zip": b"PK\x03\x04", "gzip": b"\x1f\x8b", "bzip2": b"BZh", "elf": b"\x7fELF",
    "exe": b"MZ", "class": b"\xca\xfe\xba\xbe", "xz": b"\xfd7zXZ", "rar": b"Rar!", "sqlite": b"SQLite format 3", "parquet": b"PAR1",
}
#: Languages by file name ending (fixed values).
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "sql": "sql",
    "html": "html", "css": "css", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml",
}


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding): by byte order mark, else by the first encoding that fits."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return data.decode(name, errors="replace"), name
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace"), "utf-8"


#: Share of zero bytes, and of other control bytes in what isn't UTF-8, over which content is binary (fixed values).
ZERO_SHARE, CONTROL_SHARE = 0.05, 0.3


def _share(content: Column, pattern: str) -> Column:
    """Share of the bytes that a class of Latin-1 characters has: every byte is one such character."""
    text = F.decode(content, "ISO-8859-1")
    return F.length(F.regexp_replace(text, pattern, "")) / F.length(content)


def binary_kind(content: Column) -> Column:
    """Name of a binary format, "binary" for many zero bytes, or many control bytes in what isn't UTF-8, over the whole content, or null for text.

    Content with a mark of UTF-16 or UTF-32 is text, whatever its bytes.
    """
    kind, marked = None, F.lit(False)
    for name, first in MAGIC.items():
        test = F.substring(content, 1, len(first)) == F.lit(first)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    for mark, _ in MARKS:
        marked = marked | (F.substring(content, 1, len(mark)) == F.lit(mark))
    zeros, controls = _share(content, r"[^\x00]+"), _share(content, r"[^\x00-\x08\x0E-\x1F]+")
    utf8 = F.is_valid_utf8(content.cast("string"))
    many = (zeros > ZERO_SHARE) | (~utf8 & (controls > CONTROL_SHARE))
    return F.when(marked, F.lit(None).cast("string")).otherwise(F.coalesce(kind, F.when((F.length(content) > 0) & many, "binary")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of the text files under ``path``; binary ones are left out. Files are read whole, one at a time."""

    def texts(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            rows = [(p, *decode(bytes(c))) for p, c in zip(table["path"], table["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "encoding"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(binary_kind(F.col("content")).isNull()).select("path", "content").mapInPandas(texts, "path string, text string, encoding string")


def language(path: Column, content: Column) -> Column:
    """By the file name's ending, else by words of the content."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    guess = (
        F.when(content.rlike(r"\A#![^\n]*python"), "python").when(content.rlike(r"\A#![^\n]*node"), "javascript").when(content.startswith("#!"), "shell")
        .when(content.rlike(r"(?m)^(def |import |class )"), "python").when(content.rlike(r"function |const |let "), "javascript")
    )
    return F.coalesce(F.get(F.array(F.try_element_at(table, ending)), F.lit(0)), guess, F.lit("unknown"))


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, category, content) of JSON objects or arrays; without an id the title or "unknown" is it, and of equal ids the last path wins."""
    rows = spark.read.option("multiLine", "true").schema("id string, title string, category string, content string").json(path)
    rows = rows.select(F.coalesce("id", "title", F.lit("unknown")).alias("id"), "title", "category", "content", F.col("_metadata.file_path").alias("_path"))
    return rows.groupBy("id").agg(F.max_by(F.struct("title", "category", "content"), "_path").alias("k")).select("id", "k.*")


def export(rows: DataFrame, path: str, kind: str = "json", by: str | None = None) -> None:
    """Write rows as JSON, CSV or Parquet, in folders by a column if given."""
    writer = rows.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(by)
    {"json": writer.json, "csv": lambda p: writer.option("header", "true").csv(p), "parquet": writer.parquet}[kind](path)
