"""Keyword searches and trigram shares: time on many pairs, strips of a task, and odd tables against SQL."""

import os
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corvane.operators import lexical, retrieval
from corvane.plans import registry


def _grams(text):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", text.lower()) if w for i in range(len(w) + 1)}


def _texts(rng, n, size, words):
    return [" ".join(rng.choices(words, k=size)) for _ in range(n)]


def test_trigrams_of_many_pairs_with_the_same_texts(spark):
    """Each of 40 long texts meets each of 200 questions: its trigrams are taken once, not once a pair."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(20_000)]
    texts, asked = _texts(rng, 40, 8000, words), _texts(rng, 200, 30, words)
    corpus = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string").repartition(4)
    queries = spark.createDataFrame([(i, t, [1.0, 0.0]) for i, t in enumerate(asked)], "query_id bigint, query string, embedding array<float>")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "id bigint, embedding array<float>")
    start = time.perf_counter()
    rows = retrieval.vector_with_trigrams(vectors, queries, corpus, 3, 0.5).collect()
    assert (took := time.perf_counter() - start) < 60, took
    of_text, want = [_grams(t) for t in texts], []
    for q, text in enumerate(asked):
        g = _grams(text)
        shares = sorted((-round(len(g & c) / len(g | c), 6), i) for i, c in enumerate(of_text))[:3]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(shares, 1)]
    got = sorted((r["query_id"], r["rank"], r["id"], r["keyword"]) for r in rows)
    assert len(got) == len(want) and sum(a[:3] == b[:3] and abs(a[3] - b[3]) < 1.1e-6 for a, b in zip(got, want, strict=True)) > 590


@pytest.mark.parametrize("cells", [1, 50, 2000, 1 << 22])
def test_common_trigrams_in_strips(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcé𐐨x1", k=rng.randint(1, 6))) for _ in range(60)]
    texts, asked = _texts(rng, 30, 25, words) + ["", "a", "zz"], [*_texts(rng, 7, 6, words), "", "a b"]
    held = lexical._Asked(spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string"))
    lists = pa.array([t if at % 5 else None for at, t in enumerate(texts)], pa.string())
    both, n = np.full((len(texts), len(asked)), -1), np.full(len(texts), -1)
    whole = set()
    for low, high, some, sizes, (rows, columns) in held.common(lists):
        both[low:high], n[low:high] = some, sizes
        whole |= {(low + int(r), int(q)) for r, q in zip(rows, columns, strict=True)}
    own = [_grams(t) if at % 5 else set() for at, t in enumerate(texts)]
    assert both.tolist() == [[len(c & _grams(q)) for q in asked] for c in own] and n.tolist() == [len(c) for c in own]
    inner = [{w[i : i + 3] for w in re.split(r"[\W_]+", q) for i in range(len(w) - 2)} for q in asked]
    assert whole == {(row, at) for row, c in enumerate(own) for at, g in enumerate(inner) if g <= c}


DOCS = [
    (0, "The heading of the red lines", "x", "en"), (1, None, "x", "en"), (2, "", None, "en"), (3, "of it, no: THE RED LINES", "x", "fr"), (4, "the red", "y", None), (5, "été élan à la", "y", "fr"),
    (6, "red_lines the_red lines", "z", "en"), (7, "7 77 777", "z", "en"), (8, "the the the red red lines lines", "z", "en"), (9, "Éclair STRASSE straße", "z", "en"),
]
ASKED = [(0, "the red lines"), (1, "of it"), (2, "RED"), (3, "été élan"), (4, "red_lines"), (5, "nothing here"), (6, "a b"), (7, "the the red straße"), (8, None)]


@pytest.mark.parametrize("name", ["bm25_search", "trigram_search", "hybrid_retrieval", "vector_with_trigrams"])
def test_odd_texts_and_questions(spark, tmp_path, name):
    rng = np.random.default_rng(2)
    tables = {
        "documents": ([(i, t, lang, source, None if t is None else len(t)) for i, t, source, lang in DOCS], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "benchmark": (ASKED, "item_id bigint, text string"),
        "embeddings": ([(i, rng.normal(size=4).tolist(), 0) for i in range(12)], "vec_id bigint, embedding array<float>, label int"),
    }
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = os.path.join(str(tmp_path), f"{table}.parquet")
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    got = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()), key=str)
    want = sorted(cursor.fetchall(), key=str)
    assert got == want and got


def test_batches_of_queries_find_the_same(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(80)]
    corpus = spark.createDataFrame(list(enumerate(_texts(rng, 120, 15, words))), "id bigint, content string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(_texts(rng, 11, 5, words))), "query_id bigint, query string")
    pairs = spark.range(11).selectExpr("id AS query_id").crossJoin(corpus.select("id")).selectExpr("query_id", "id", "0.5D AS similarity")

    def found():
        return [sorted(map(tuple, rows.collect())) for rows in (lexical.bm25(corpus, queries, 4), lexical.trigram_search(corpus, queries, 4, 0.1), lexical.trigram_shares(corpus, pairs, queries))]

    whole = found()
    monkeypatch.setattr(lexical, "QUERY_BATCH", 4)
    assert found() == whole and all(whole)
    monkeypatch.setattr(lexical, "TERM_BOUND", 9)
    assert found() == whole


def _shuffled(spark, first):
    """Records that stages from a number on wrote to shuffles, and the next number."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [found.apply(at) for at in range(found.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() >= first), max((x.stageId() for x in stages), default=-1) + 1


@pytest.mark.parametrize("of", ["bm25", "hybrid"])
def test_pairs_of_common_words_are_not_shuffled(spark, of):
    """300 questions of common words over 2000 texts: nearly all 600,000 pairs meet in some ten words, and few rows leave the tasks."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    texts, asked = _texts(rng, 2000, 40, words), _texts(rng, 300, 40, words)
    rows = [(i, "s", t) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "id bigint, source string, content string").repartition(4)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")
    start = _shuffled(spark, 0)[1]
    if of == "bm25":
        found = lexical.bm25(corpus, queries, 3).collect()
    else:
        vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "id bigint, embedding array<float>")
        weights = {"bm25": 0.5, "trigram": 0.2, "vector": 0.3}
        found = retrieval.hybrid(corpus, queries, vectors, vectors.withColumnRenamed("id", "query_id"), {"{}": 1.0, "about {}": 0.8}, weights, "2024-02-01", 1).collect()
    assert len(found) == (900 if of == "bm25" else 300)
    assert (n := _shuffled(spark, start)[0]) < 100_000, n
    if of == "bm25":
        counts = [{w: t.split().count(w) for w in set(t.split())} for t in texts]
        df = {w: sum(w in c for c in counts) for w in words}
        for q in range(0, 300, 60):
            times = {w: asked[q].split().count(w) for w in set(asked[q].split())}
            scores = [sum(n * np.log((2000 - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5) for w, n in times.items() if w in c) for c in counts]
            want = sorted((-round(float(s), 6), i) for i, s in enumerate(scores))[:3]
            got = sorted((r["rank"], r["id"], r["score"]) for r in found if r["query_id"] == q)
            assert [g[1] for g in got] == [w[1] for w in want] and all(abs(g[2] + w[0]) < 2e-6 for g, w in zip(got, want, strict=True))
