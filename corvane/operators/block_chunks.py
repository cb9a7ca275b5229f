"""Chunkers that keep structure: a tree of blocks is packed from the bottom up, so that an atomic block is never cut.

Blocks are character ranges that nest. ``packed`` gives ranges that follow each other and cover the whole text: a block that fits is one piece with its
neighbours, one that doesn't is taken apart into its children and what stands between them, unless its kind is atomic; then it is a piece
of its own, however long. Pieces of a block that was taken apart are linked by that block, their ``group``. The texts of atomic pieces
over ``limit`` are summarised; their ranges still say what they stand for.

Python finds and packs the blocks of one text at a time, over Arrow batches. A null text has no chunks, an empty one neither.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from corvane.operators.chunking import blocks_of

SCHEMA = "id bigint, idx bigint, start bigint, end bigint, kind string, atomic boolean, group bigint, truncated boolean, content string"
#: Elements that hold no others, and those that aren't cut (fixed values).
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
ATOMIC = {"html": ("table", "pre", "ul", "ol", "script", "style"), "code": ("if", "try", "loop", "with"), "code_units": ("class", "function"), "paragraphs": ("paragraph",), "lines": ("line",)}
_TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.DOTALL)
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_TABLE = re.compile(r"(?:^[^\n]*\|[^\n]*(?:\n|\Z)){2,}", re.MULTILINE)


@dataclass(frozen=True)
class Block:
    kind: str
    start: int
    end: int


def html_blocks(text: str) -> list[Block]:
    """The elements of a page. An element that isn't closed ends with the one around it; a closing tag without an element is text."""
    found: list[list] = []
    open_: list[int] = []
    for tag in _TAG.finditer(text):
        name = (tag.group(2) or "").lower()
        if not name or name in VOID or tag.group(4):
            continue
        if not tag.group(1):
            open_.append(len(found))
            found.append([name, tag.start(), None])
        elif any(found[i][0] == name for i in open_):
            while found[open_[-1]][0] != name:
                found[open_.pop()][2] = tag.start()
            found[open_.pop()][2] = tag.end()
    for i in open_:
        found[i][2] = len(text)
    return [Block(*b) for b in found]


def code_spans(text: str) -> list[Block]:
    """The blocks of an indented source, as character ranges of whole lines."""
    ends = [0]
    for line in text.split("\n"):
        ends.append(ends[-1] + len(line) + 1)
    ends[-1] -= 1
    return [Block(kind, ends[first - 1], min(ends[last], len(text))) for kind, _, first, last, _ in blocks_of(text)]


def paragraphs(text: str) -> list[Block]:
    """What stands between empty lines."""
    return [Block("paragraph", m.start(), m.end()) for m in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|\Z))+", text)]


def lines(text: str) -> list[Block]:
    return [Block("line", m.start(), m.end()) for m in re.finditer(r"[^\n]+\n?", text)]


FINDERS: dict[str, Callable[[str], list[Block]]] = {"html": html_blocks, "code": code_spans, "code_units": code_spans, "paragraphs": paragraphs, "lines": lines}


def _cut(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """A range in parts of ``size`` at most, behind a line or a blank if there is one."""
    while end - start > size:
        at = text.rfind("\n", start, start + size) + 1 or text.rfind(" ", start, start + size) + 1
        at = at if at > start else start + size
        yield start, at
        start = at
    if end > start:
        yield start, end


def packed(text: str, blocks: Sequence[Block], size: int, atomic: Sequence[str]) -> list[tuple[int, int, str, bool, int | None]]:
    """(start, end, kind, atomic, group) of the pieces; ``group`` is the number, by start, of the block that was taken apart, None for the text itself."""
    order = sorted(blocks, key=lambda b: (b.start, -b.end))
    children: dict[int | None, list[int]] = {}
    stack: list[int] = []
    for i, block in enumerate(order):
        while stack and order[stack[-1]].end <= block.start:
            stack.pop()
        children.setdefault(stack[-1] if stack else None, []).append(i)
        stack.append(i)
    done: dict[int | None, list[tuple[int, int, str, bool, int | None]]] = {}

    def own(i: int | None) -> list[tuple[int, int, str, bool, int | None]]:
        start, end = (0, len(text)) if i is None else (order[i].start, order[i].end)
        kind = "text" if i is None else order[i].kind
        if i is not None and (end - start <= size or kind in atomic):
            return [(start, end, kind, kind in atomic, None)]
        pieces: list[tuple[int, int, str, bool, int | None]] = []
        free = False  # whether the last piece may grow

        def add(piece: tuple[int, int, str, bool, int | None], may_grow: bool) -> None:
            nonlocal free
            if may_grow and free and piece[1] - pieces[-1][0] <= size:
                last = pieces[-1]
                pieces[-1] = (last[0], piece[1], "group" if last[2] != "text" or piece[2] != "text" else "text", False, i)
            else:
                pieces.append(piece)
            free = may_grow

        at = start
        for child in children.get(i, []):
            for a, b in _cut(text, at, order[child].start, size):
                add((a, b, "text", False, i), True)
            parts = done.pop(child)
            for part in parts:
                whole = len(parts) == 1 and part[:2] == (order[child].start, order[child].end)
                add((*part[:4], i) if whole else part, whole and part[1] - part[0] <= size)
            at = order[child].end
        for a, b in _cut(text, at, end, size):
            add((a, b, "text", False, i), True)
        return pieces

    # children come behind their parents, so the last are done first
    for i in range(len(order) - 1, -1, -1):
        done[i] = own(i)
    return own(None)


def summary(text: str) -> str:
    """What stands for an atomic block that is too long: its first line and how many it has."""
    first = text.split("\n", 1)[0].strip()
    return f"// Atomic block: {first[:200]}\n// Total lines: {text.count(chr(10)) + 1}\n// ... (content summarized for size constraints)"


def structured_chunks(corpus: DataFrame, finder: str = "html", size: int = 1000, limit: int = 2000, atomic: Sequence[str] | None = None) -> DataFrame:
    """(id, idx, start, end, kind, atomic, group, truncated, content) of (id, content), by the blocks of a named finder."""
    find, kept = FINDERS[finder], ATOMIC[finder] if atomic is None else atomic

    def apply(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            rows = []
            for key, text in zip(table["id"], table["content"], strict=True):
                for idx, (start, end, kind, whole, group) in enumerate(packed(text, find(text), size, kept) if text else []):
                    large = whole and end - start > limit
                    rows.append((key, idx, start, end, kind, whole, group, large, summary(text[start:end]) if large else text[start:end]))
            out = pd.DataFrame(rows, columns=["id", "idx", "start", "end", "kind", "atomic", "group", "truncated", "content"])
            out["group"] = out["group"].astype("Int64")
            yield out

    return corpus.select("id", "content").mapInPandas(apply, SCHEMA)


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(heading, content) from one heading to the next; lines of a table (two or more with bars) aren't headings."""
    tables = [(m.start(), m.end()) for m in _TABLE.finditer(text)]
    sections: list[tuple[str, list[str]]] = []
    at = n = 0
    for line in text.split("\n"):
        while n < len(tables) and tables[n][1] <= at:
            n += 1
        inside = n < len(tables) and tables[n][0] <= at
        heading = None if inside else _HEADING.match(line)
        if heading or not sections:
            sections.append((heading.group(2).strip() if heading else "unlabeled", []))
        sections[-1][1].append(line)
        at += len(line) + 1
    return [(heading, "\n".join(lines).strip()) for heading, lines in sections]


def markdown_pieces(text: str, size: int) -> Iterator[str]:
    """Sections behind their headings, together as long as their contents fit; a section, with its tables, is never cut."""
    held = ""
    for heading, content in markdown_sections(text):
        if held and len(held) + len(content) > size:
            yield held.strip()
            held = ""
        held += f"\n\n## {heading}\n\n{content}"
    if held:
        yield held.strip()


def markdown_chunks(corpus: DataFrame, size: int = 1500) -> DataFrame:
    """(id, idx, content) of (id, content): markdown by its headings, with tables kept whole and headings before each section."""

    def apply(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            rows = [(k, i, piece) for k, text in zip(table["id"], table["content"], strict=True) if text for i, piece in enumerate(markdown_pieces(text, size))]
            yield pd.DataFrame(rows, columns=["id", "idx", "content"])

    return corpus.select("id", "content").mapInPandas(apply, "id bigint, idx bigint, content string")
