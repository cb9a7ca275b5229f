"""Every query with SQL is run against DuckDB on the smallest tables; the others against small hand-made cases."""

import glob
import math
import os
import re

import duckdb
import numpy as np
import pytest

from corvane.functions import text as X
from corvane.operators import chunking, fusion, rerank, vector
from corvane.operators import graph as G
from corvane.plans import registry
from corvane.sources import files, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted((tuple(r[c] for c in order) for r in got.collect()), key=str)
    theirs = sorted((tuple(dict(zip(columns, r, strict=True))[c] for c in order) for r in cursor.fetchall()), key=str)
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]


def test_round_robin(spark):
    rows = [(1, "a", 1, 10, 0.9), (1, "a", 2, 11, 0.8), (1, "b", 1, 10, 0.7), (1, "b", 2, 12, 0.95), (1, "b", 3, 13, 0.1)]
    candidates = spark.createDataFrame(rows, "query_id bigint, strategy string, rank int, id bigint, similarity double")
    assert [(r["id"], r["rank"]) for r in fusion.round_robin(candidates, 3, ["a", "b"]).orderBy("rank").collect()] == [(12, 1), (10, 2), (11, 3)]


def test_diversity_and_relevance(spark):
    rows = [(1, 1, 1, "a b c d", "x", 0.9), (1, 2, 2, "a b c d", "y", 0.8), (1, 3, 3, "e f g", "x", 0.7), (1, 4, 4, None, "z", 0.1)]
    hits = spark.createDataFrame(rows, "query_id bigint, rank int, id bigint, content string, source string, similarity double")
    assert [r["id"] for r in rerank.diverse(hits, 2).orderBy("place").collect()] == [1, 3]
    assert [r["id"] for r in rerank.diverse(hits, 4).orderBy("place").collect()] == [1, 2, 3, 4]
    assert [r["id"] for r in rerank.marginal_relevance(hits, 2).orderBy("place").collect()] == [1, 4]


def test_chunkers():
    text = "a" * 10 + "\n" + "b" * 30 + "\n\n" + "c. d, e"
    assert list(chunking.packed_lines(text, 20, 5)) == [
        (1, 1, "a" * 10), (2, 2, "b" * 20), (2, 2, "b" * 15), (3, 4, "\nc. d, e"),
    ]
    for size in (3, 7, 20, 100):
        pieces = chunking.recursive_pieces(text, size)
        assert "".join(pieces) == text and all(0 < len(p) <= size for p in pieces)
    code = "import os\n\n@deco\ndef f():\n    return 1\n\nclass A:\n    def g(self): pass\n"
    assert [(a, b) for a, b, _ in chunking.code_blocks(code)] == [(1, 2), (3, 6), (7, 9)]


def test_chunks_of_a_table(spark):
    corpus = spark.createDataFrame([(1, "x\ny"), (2, None), (3, ""), (4, "# a\nb\n## c\nd")], "id bigint, content string")
    assert chunking.chunks(corpus).count() == 3
    assert [r["content"] for r in chunking.sections(corpus.filter("id = 4")).orderBy("idx").collect()] == ["# a\nb", "## c\nd"]
    assert [(r["kind"], r["line"]) for r in chunking.outline(corpus).orderBy("line").collect()] == [("heading", 1), ("heading", 3)]
    assert [r["content"] for r in chunking.strides(spark.createDataFrame([(1, "abcdefgh")], "id bigint, content string"), 4, 1).orderBy("idx").collect()] == ["abcd", "defg", "gh"]
    chunking.register("words", lambda text: ((1, 1, w) for w in text.split()))
    assert chunking.chunks(corpus, "words").count() == 8


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.py").write_bytes("中文".encode("gbk"))
    (tmp_path / "c.bin").write_bytes(b"\x89PNG....")
    (tmp_path / "d.bin").write_bytes(b"ab\0\0\0\0")
    found = {os.path.basename(r["path"]): (r["text"], r["encoding"]) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": ("é", "utf-8"), "b.py": ("中文", "gbk")}
    docs = spark.createDataFrame([("x.py", ""), ("y", "import os"), ("z", "const a"), ("w.zzz", "?")], "p string, c string")
    assert [r[0] for r in docs.select(files.language(docs["p"], docs["c"])).collect()] == ["python", "python", "javascript", "unknown"]
    (tmp_path / "k").mkdir()
    (tmp_path / "k/1.json").write_text('[{"id": "a", "content": "old"}, {"title": "t"}]')
    (tmp_path / "k/2.json").write_text('{"id": "a", "content": "new"}')
    assert {r["id"]: r["content"] for r in files.read_knowledge(spark, str(tmp_path / "k")).collect()} == {"a": "new", "t": None}
    files.export(docs, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 4


def test_multi_hop(spark):
    edges = spark.createDataFrame([("a", "b", "r", 0.5), ("a", "c", "r", 0.4), ("b", "d", "r", 1.0), ("c", "d", "r", 1.0)], "source string, target string, relation string, strength double")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["hop"]): r["score"] for r in G.multi_hop(edges, start, 2, 5).collect()} == {("a", 0): 1.0, ("b", 1): 0.4, ("c", 1): 0.32, ("d", 2): 0.576}
    assert [(r["callee"]) for r in G.calls(spark.createDataFrame([(1, "def f():\n  g()\ndef g(): pass")], "id bigint, content string")).collect()] == ["g"]


def test_text_functions(spark):
    row = spark.createDataFrame([("The Quick_fox 12 x", "cat", None)], "a string, b string, c string")
    from pyspark.sql import functions as F

    out = row.select(X.word_tokens(F.col("a")).alias("t"), X.trigrams(F.col("b")).alias("g"), X.jaccard(F.array(F.lit(1)), F.array(F.lit(2))).alias("j"), X.length_score(F.lit("x" * 600)).alias("l")).first()
    assert (out["t"], out["g"], out["j"], out["l"]) == (["the", "quick_fox"], ["  c", " ca", "cat", "at "], 0.0, 0.9)


def test_all_vector_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "PAIR_BLOCK", 60)
    rng = np.random.default_rng(5)
    points = {int(i): rng.normal(size=6).astype(np.float32).tolist() for i in rng.permutation(400)}
    points[3], points[399] = points[1], None
    vectors = spark.createDataFrame(list(points.items()), "id bigint, embedding array<float>")
    unit = {i: np.array(p, np.float64) / np.linalg.norm(np.array(p, np.float64)) for i, p in points.items() if p is not None}
    want = {(a, b): round(float(unit[a] @ unit[b]), 6) for a in unit for b in unit if a < b and round(float(unit[a] @ unit[b]), 6) >= 0.8}
    rows = vector.all_pairs(vectors, 0.8).collect()
    assert len(rows) == len(want) and all(abs(want[r["a"], r["b"]] - r["similarity"]) < 2e-6 for r in rows)
    assert vector.all_pairs(vectors.limit(0), 0.8).count() == 0


def test_registered_vector_pairs_are_all_pairs(spark):
    vectors = {r["id"]: np.array(r["embedding"], np.float64) for r in tables.vectors(spark, FOLDER).collect()}
    ids = sorted(vectors)
    points = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    scores = np.round(points @ points.T, 6)
    want = {(ids[i], ids[j]) for i, j in np.argwhere(np.triu(scores >= 0.25, 1))}
    assert {(r["a"], r["b"]) for r in registry.QUERIES["vector_pairs"](spark, FOLDER).collect()} == want


def test_trigram_search_asks_all_questions(spark):
    def grams(text):
        words = ["".join(w) for w in re.findall(r"[^\W_]+", text.lower())]
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    corpus = [(r["id"], r["content"] or "") for r in tables.corpus(spark, FOLDER).collect()]
    marked = [(i, text, grams(text)) for i, text in corpus]
    want = {}
    for q, query in ((r["query_id"], r["query"]) for r in tables.questions(spark, FOLDER).collect()):
        asked = grams(query)
        found = [(i, 1.0 if query in text else round(len(asked & g) / len(asked | g), 6), query.lower() in text.lower()) for i, text, g in marked]
        top = sorted((-s, i) for i, s, has in found if s >= 0.12 or has)[:5]
        want |= {(q, i): -s for s, i in top}
    got = {(r["query_id"], r["id"]): r["similarity"] for r in registry.QUERIES["trigram_search"](spark, FOLDER).collect()}
    assert {q % 5 for q, _ in got} == set(range(5))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_theme_of_the_whole_content(spark):
    from corvane.plans.search_queries import THEMES

    got = {r["query_id"]: (r["theme"], r["score"]) for r in registry.QUERIES["theme_detect"](spark, FOLDER).collect()}
    corpus = {r["id"]: (r["content"] or "").lower() for r in tables.corpus(spark, FOLDER).collect()}
    late = 0
    for i, text in corpus.items():
        scores = {name: round(sum(w in text for w in words) * (1 + 0.1 * (10 - priority)), 6) for name, (words, priority) in THEMES.items()}
        best = max(scores, key=scores.get)
        assert got[i][0] == (best if scores[best] > 0 else "other") and abs(got[i][1] - scores[best]) < 1e-6
        late += any(w in text and w not in text[:200] for words, _ in THEMES.values() for w in words)
    assert late and len(got) == len(corpus)


def test_popular_whole_texts_are_grouped_whole(spark, tmp_path):
    texts = ["a" * 100 + "x"] * 3 + ["a" * 100 + "y"] * 2 + ["b"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((-r["hits"], r["group_0"], r["total"]) for r in registry.QUERIES["popular_whole_texts"](spark, str(tmp_path)).collect())
    assert got == [(-3, "a" * 100, 303), (-2, "a" * 100, 202), (-1, "b", 1)]
