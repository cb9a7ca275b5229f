"""Chunkers that keep structure, against a plain recursive version."""

import random

import pytest

from corvane.operators import block_chunks as C


def recursive(text, blocks, size, atomic, start=0, end=None, group=None):
    """Pieces of a range: blocks of the first level in it whole, or taken apart in the same way."""
    end = len(text) if end is None else end
    order = sorted(blocks, key=lambda b: (b.start, -b.end))
    inside = [(i, b) for i, b in enumerate(order) if start <= b.start and b.end <= end and i != group and (group is None or i > group)]
    top = [(i, b) for i, b in inside if not any(j != i and o.start <= b.start and b.end <= o.end and j < i for j, o in inside)]
    parts, at = [], start
    for i, b in top:
        parts += [(x, True) for x in C._cut(text, at, b.start, size)]
        if b.end - b.start <= size or b.kind in atomic:
            parts.append(((b.start, b.end), b.end - b.start <= size))
        else:
            sub = recursive(text, [*order[i + 1 :]], size, atomic, b.start, b.end, None)
            parts += [(x, False) for x in sub]
        at = b.end
    parts += [(x, True) for x in C._cut(text, at, end, size)]
    out, free = [], False
    for (a, b), grows in parts:
        if grows and free and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        free = grows
    return out


def page(rng, depth=0):
    kinds = ["div", "p", "table", "ul", "section", "span"]
    parts = []
    for _ in range(rng.randint(0, 4)):
        parts.append("word " * rng.randint(0, 12))
        if depth < 4:
            k = rng.choice(kinds)
            parts.append(f"<{k} class='a>b'>{page(rng, depth + 1)}" + (f"</{k}>" if rng.random() < 0.9 else ""))
        if rng.random() < 0.2:
            parts.append(rng.choice(["<br>", "</b>", "<img src=x/>", "<!-- <p> -->"]))
    return "".join(parts)


@pytest.mark.parametrize("size", [20, 60, 200])
def test_pieces_cover_the_text_and_match_recursion(size):
    rng = random.Random(size)
    for _ in range(60):
        text = page(rng)
        blocks = C.html_blocks(text)
        pieces = C.packed(text, blocks, size, C.ATOMIC["html"])
        assert "".join(text[a:b] for a, b, *_ in pieces) == text
        assert [(a, b) for a, b, *_ in pieces] == recursive(text, blocks, size, C.ATOMIC["html"])
        for block in blocks:
            if block.kind in C.ATOMIC["html"] and not any(o != block and o.kind in C.ATOMIC["html"] and o.start <= block.start and block.end <= o.end for o in blocks):
                assert sum(a < block.end and b > block.start for a, b, *_ in pieces if block.end > block.start) == 1
        assert all(b - a <= size or whole for a, b, _, whole, _ in pieces)


def test_code_and_paragraphs():
    code = "import os\n\nclass A:\n    def f(self):\n        if x:\n            return 1\n        else:\n            return 2\n\n    def g(self):\n        pass\n\nvalue = 3"
    pieces = C.packed(code, C.code_spans(code), 60, C.ATOMIC["code_units"])
    assert "".join(code[a:b] for a, b, *_ in pieces) == code and any(code[a:b].startswith("class A") and code[a:b].rstrip().endswith("pass") for a, b, *_ in pieces)
    # conditionals stay whole where classes are taken apart
    pieces = C.packed(code, C.code_spans(code), 40, C.ATOMIC["code"])
    assert [code[a:b].strip() for a, b, _, whole, _ in pieces if whole] == ["if x:\n            return 1\n        else:\n            return 2"]
    text = "one\ntwo\n\n\nthree " + "x" * 50 + "\n"
    assert [text[a:b] for a, b, *_ in C.packed(text, C.paragraphs(text), 20, ("paragraph",))] == ["one\ntwo\n\n\n", "three " + "x" * 50 + "\n"]


def test_deep_nesting_and_long_text(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert "".join(deep[a:b] for a, b, *_ in C.packed(deep, C.html_blocks(deep), 100, ())) == deep
    table = "<table>" + "<tr><td>cell</td></tr>\n" * 200 + "</table>"
    rows = spark.createDataFrame([(1, "<p>a</p>" + table + "<p>b</p>"), (2, None), (3, ""), (4, "plain")], "id bigint, content string")
    got = sorted(tuple(r) for r in C.structured_chunks(rows, "html", 300, 1000).collect())
    assert [g[:8] for g in got] == [(1, 0, 0, 8, "p", False, None, False), (1, 1, 8, 8 + len(table), "table", True, None, True), (1, 2, 8 + len(table), 16 + len(table), "p", False, None, False), (4, 0, 0, 5, "text", False, None, False)]
    assert got[1][8].startswith("// Atomic block: <table>") and "Total lines: 201" in got[1][8]


def test_markdown():
    text = "intro\n# One\nbody\n| a | b |\n|---|---|\n| # no | 2 |\n## Two\nmore\n"
    assert C.markdown_sections(text) == [("unlabeled", "intro"), ("One", "# One\nbody\n| a | b |\n|---|---|\n| # no | 2 |"), ("Two", "## Two\nmore")]
    assert list(C.markdown_pieces(text, 30)) == ["## unlabeled\n\nintro", "## One\n\n# One\nbody\n| a | b |\n|---|---|\n| # no | 2 |", "## Two\n\n## Two\nmore"]
    assert len(list(C.markdown_pieces(text, 1000))) == 1
