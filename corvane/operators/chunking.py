"""Chunking: one text becomes many rows.

What SQL can express (headings, fallback outlines, long-line strides) is posexplode and running sums; packers whose state resets at each chunk are
small Python helpers over Arrow batches. All give (id, idx, start_line, end_line, content), lines from 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "id bigint, idx bigint, start_line bigint, end_line bigint, content string"
#: Separators of the recursive splitter, from coarse to fine (fixed values).
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", ", ", "; ", " ", "")

Piece = tuple[int, int, str]


def packed_lines(text: str, size: int = 1000, overlap: int = 200) -> Iterator[Piece]:
    """Lines packed up to ``size`` characters; a longer line is cut into strides that overlap."""
    held: list[str] = []
    first, length = 1, 0
    for number, line in enumerate(text.split("\n"), 1):
        if held and length + len(line) + 1 > size:
            yield first, number - 1, "\n".join(held)
            held, length = [], 0
        if len(line) > size:
            for at in range(0, max(len(line) - overlap, 1), size - overlap):
                yield number, number, line[at : at + size]
            continue
        if not held:
            first = number
        held.append(line)
        length += len(line) + 1
    if held:
        yield first, text.count("\n") + 1, "\n".join(held)


def recursive_pieces(text: str, size: int = 1000, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Cut at the coarsest separator that helps, finer ones within parts that are still too long, and merged up to ``size``."""
    if len(text) <= size:
        return [text] if text else []
    mark, *finer = separators
    if mark == "":
        return [text[at : at + size] for at in range(0, len(text), size)]
    parts = text.split(mark)
    parts = [p + mark for p in parts[:-1]] + parts[-1:]
    out: list[str] = []
    held = ""
    for part in parts:
        if len(held) + len(part) <= size:
            held += part
            continue
        if held:
            out.append(held)
        held = ""
        if len(part) <= size:
            held = part
        else:
            out.extend(recursive_pieces(part, size, finer))
    return [*out, held] if held else out


def recursive(text: str, size: int = 1000) -> Iterator[Piece]:
    line = 1
    for piece in recursive_pieces(text, size):
        last = line + piece.count("\n")
        yield line, last - (piece.endswith("\n")), piece
        line = last


def code_blocks(text: str, opener: str = r"^(?:async\s+def|def|class|function|export|const|let)\b") -> Iterator[Piece]:
    """Top-level definitions with their bodies (and decorators before them); what stands between is a block of its own."""
    lines = text.split("\n")
    starts = [0]
    for i, line in enumerate(lines):
        if re.match(opener, line) or (line.startswith("@") and (i == 0 or not lines[i - 1].startswith("@"))):
            if i and not (lines[i - 1].startswith("@") and not line.startswith("@")):
                starts.append(i)
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        block = "\n".join(lines[a:b])
        if block.strip():
            yield a + 1, b, block


#: Chunkers by name; ``register`` adds one.
CHUNKERS: dict[str, Callable[..., Iterator[Piece]]] = {"lines": packed_lines, "recursive": recursive, "code": code_blocks}


def register(name: str, chunker: Callable[..., Iterator[Piece]]) -> None:
    CHUNKERS[name] = chunker


def chunks(corpus: DataFrame, chunker: str = "lines", **options) -> DataFrame:
    """Chunks of (id, content) by a named chunker; null contents give none."""
    cut = CHUNKERS[chunker]

    def apply(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            rows = [
                (key, idx, a, b, piece)
                for key, text in zip(table["id"], table["content"], strict=True)
                if text is not None
                for idx, (a, b, piece) in enumerate(cut(text, **options))
            ]
            yield pd.DataFrame(rows, columns=["id", "idx", "start_line", "end_line", "content"])

    return corpus.select("id", "content").mapInPandas(apply, SCHEMA)


def sections(corpus: DataFrame, heading: str = r"^#{1,6} ") -> DataFrame:
    """Sections from one heading to the next: a running sum of headings over a text's lines."""
    rows = corpus.select("id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    line = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("idx", F.sum(F.col("line").rlike(heading).cast("int")).over(line))
    parts = F.array_sort(F.collect_list(F.struct("at", "line")))
    rows = rows.groupBy("id", "idx").agg(F.min("at").alias("a"), F.max("at").alias("b"), parts.alias("p"))
    return rows.select("id", "idx", (F.col("a") + 1).cast("bigint").alias("start_line"), (F.col("b") + 1).cast("bigint").alias("end_line"), F.array_join("p.line", "\n").alias("content"))


def strides(corpus: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, idx, content): texts cut every size - overlap characters, without Python."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - overlap - 1, F.lit(0)), F.lit(step))
    rows = corpus.filter(F.length("content") > 0).select("id", "content", F.posexplode(starts).alias("idx", "at"))
    return rows.select("id", F.col("idx").cast("bigint").alias("idx"), F.substring("content", F.col("at") + 1, F.lit(size)).alias("content"))


def outline(corpus: DataFrame) -> DataFrame:
    """(id, line, kind, text): comments, functions, classes and headings by how a line begins."""
    rows = corpus.select("id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    text = F.trim("line")
    kind = (
        F.when(text.rlike(r"^(async\s+)?(def|function)\s"), "function")
        .when(text.rlike(r"^class\s"), "class")
        .when(text.rlike(r"^#{1,6} "), "heading")
        .when(text.startswith("#") | text.startswith("//"), "comment")
    )
    return rows.select("id", (F.col("at") + 1).cast("bigint").alias("line"), kind.alias("kind"), text.alias("text")).filter("kind is not null")


def summary(content: Column, max_tokens: int) -> Column:
    """Struct (large, head): whether a text is over ``max_tokens`` tokens of four characters, and its first ones if so."""
    large = F.floor(F.length(content) / 4) > max_tokens
    return F.struct(large.alias("large"), F.when(large, F.left(content, F.lit(max_tokens * 4))).otherwise(content).alias("head"))


#: Lines that open a block, by kind, and those that carry on the block above them at the same depth (fixed values). A class or function without a name is one all the same.
OPENERS = {
    "class": r"class\s(?:\s*(\w+))?", "function": r"(?:async\s+)?def\s(?:\s*(\w+))?", "if": r"if\b()", "try": r"try\s*:()", "loop": r"(?:async\s+)?(?:for|while)\b()", "with": r"(?:async\s+)?with\b()",
}
CARRY_ON = re.compile(r"(?:elif|else|except|finally)\b")
_OPENERS = {kind: re.compile(pattern) for kind, pattern in OPENERS.items()}


def blocks_of(text: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, name, start, end, depth) of indented blocks, lines from 1: from a line that opens one to the line before the next one that isn't deeper.

    Lines such as ``else`` carry on their block. One pass with a stack of the blocks that are open.
    """
    out: list[list] = []
    stack: list[tuple[int, int]] = []
    last = 0
    for number, line in enumerate(text.split("\n"), 1):
        body = line.strip()
        if not body:
            continue
        indent = len(line) - len(line.lstrip())
        while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and not CARRY_ON.match(body))):
            out[stack.pop()[1]][3] = last
        for kind, pattern in _OPENERS.items():
            found = pattern.match(body)
            if found:
                out.append([kind, found.group(1) or "", number, 0, len(stack)])
                stack.append((indent, len(out) - 1))
                break
        last = number
    for _, at in stack:
        out[at][3] = last
    return [tuple(b) for b in out]


def blocks(corpus: DataFrame) -> DataFrame:
    """(id, kind, name, start_line, end_line, depth) of (id, content)."""

    def find(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            rows = [(key, *b) for key, text in zip(table["id"], table["content"], strict=True) if text is not None for b in blocks_of(text)]
            yield pd.DataFrame(rows, columns=["id", "kind", "name", "start_line", "end_line", "depth"])

    return corpus.select("id", "content").mapInPandas(find, "id bigint, kind string, name string, start_line bigint, end_line bigint, depth bigint")


def block_texts(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the ``content`` of each block: documents meet their blocks by id."""
    lines = corpus.select("id", F.split("content", "\n").alias("_lines"))
    text = F.array_join(F.slice("_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return found.join(lines, "id").withColumn("content", text).drop("_lines")


def block_summary(kind: Column, content: Column) -> Column:
    """First line, and numbers of lines, conditionals and guarded parts; for classes also the first five methods."""
    first = F.trim(F.element_at(F.split(content, "\n"), 1))
    methods = F.slice(F.regexp_extract_all(content, F.lit(r"def\s+(\w+)"), 1), 1, 5)

    def times(mark: str) -> Column:
        return (F.size(F.split(content, mark)) - 1).cast("string")

    parts = F.concat(first, F.lit(" | lines "), F.size(F.split(content, "\n")).cast("string"), F.lit(" | if "), times("if "), F.lit(" | try "), times("try:"))
    return F.when(kind == "class", F.concat(parts, F.lit(" | methods "), F.array_join(methods, ", "))).otherwise(parts)


def code_references(corpus: DataFrame) -> DataFrame:
    """(id, kind, name, line): imported modules, attributes of ``self``, entries of ``config`` and annotated types, line by line."""
    patterns = {"import": r"^(?:from|import)\s+([\w.]+)", "attribute": r"self\.(\w+)", "config": r"config\.(\w+)", "type": r":\s*([A-Z]\w+)"}
    rows = corpus.select("id", F.posexplode(F.split("content", "\n")).alias("at", "line"))

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), 1), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    found = F.explode(F.flatten(F.array(*[of_kind(k, p) for k, p in patterns.items()])))
    return rows.select("id", found.alias("f"), (F.col("at") + 1).cast("bigint").alias("line")).select("id", "f.kind", "f.name", "line").distinct()


def with_context(found: DataFrame, references: DataFrame) -> DataFrame:
    """``found`` with ``context``: the document's imports, and the class around the block, if any (the innermost)."""
    imports = references.filter("kind = 'import'").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("imports"))
    classes = found.filter("kind = 'class'").select("id", F.col("name").alias("owner"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    keys = ["id", "start_line", "end_line", "kind"]
    inside = found.join(classes, "id").filter("a < start_line and end_line <= b").groupBy(*keys).agg(F.max_by("owner", "a").alias("owner"))
    rows = found.join(inside, keys, "left").join(imports, "id", "left")
    return rows.withColumn("context", F.concat_ws(" / ", F.concat(F.lit("imports "), "imports"), F.concat(F.lit("class "), "owner"))).drop("owner", "imports")


def key_elements(content: Column, most: int = 10) -> Column:
    """array<string>: the first definitions and headings of a text."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(x))
    return F.slice(F.filter(lines, lambda x: x.rlike(r"^((async\s+)?def|function|class)\s|^#{1,6} ")), 1, most)


#: Sizes of chunks by kind of file, over the usual size, and the chunker that each goes to.
BY_KIND = {"python": ("code", None), "markdown": ("recursive", 1.5), "text": ("lines", 1.0)}


def by_kind(corpus: DataFrame, size: int = 1000) -> DataFrame:
    """Chunks of (id, kind, content) by the chunker of the kind; unknown kinds are text."""
    kind = F.when(F.col("kind").isin(*BY_KIND), F.col("kind")).otherwise("text")
    rows, parts = corpus.select("id", "content", kind.alias("kind")), []
    for name, (chunker, factor) in BY_KIND.items():
        options = {} if factor is None else {"size": int(size * factor)}
        parts.append(chunks(rows.filter(F.col("kind") == name), chunker, **options).withColumn("kind", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def followed_references(sections: DataFrame, start: DataFrame, pattern: str = r"(?i)see section (\w+)", depth: int = 3) -> DataFrame:
    """(section, depth): sections that (section,) ``start`` leads to by references in (section, content), each at its least depth; a bounded loop of joins."""
    edges = sections.select("section", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 1))).alias("to"))
    seen = start.select("section", F.lit(0).alias("depth"))
    for at in range(1, depth + 1):
        ahead = seen.filter(F.col("depth") == at - 1).join(edges, "section").select(F.col("to").alias("section")).distinct()
        ahead = ahead.join(sections.select("section"), "section", "left_semi").join(seen.select("section"), "section", "left_anti")
        seen = seen.unionByName(ahead.withColumn("depth", F.lit(at)))
    return seen
