import random
import re

import pytest

from corvane.llm import ngram_join
from corvane.llm.graph import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_force(rows):
    sets = []
    for _, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(i), find(rows[y][0])))
                root[b] = a
    return {(i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    return {tuple(r) for r in ngram_join.jaccard_components(docs).collect()}


def varied(seed, n, vocabulary, families, length, edits):
    """Texts in families of near copies: a few words of the family's text are replaced in each."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [rng.choice(words) for _ in range(length // 3)]
    bases = [shared + [rng.choice(words) for _ in range(rng.randint(3, length))] for _ in range(families)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "length", "edits"), [(1, 30, 2), (2, 300, 8)])
def test_against_brute_force(spark, seed, length, edits):
    rows = varied(seed, 160, 5000, 25, length, edits)
    assert result(spark, rows) == brute_force(rows)


def test_several_pages_of_one_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAGE", 8)
    rows = varied(3, 150, 3000, 3, 120, 5)
    assert result(spark, rows) == brute_force(rows)


def test_batches_led_by_quoters(spark):
    """Near copies of one passage in several batches; texts with smaller ids that quote a sentence lead the shared keys of each batch."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(29)]
    fresh = (f"u{i}" for i in range(100000))
    rows = []
    for batch in range(3):
        at = batch * 1000
        quotes = [[next(fresh), next(fresh)] + passage[i : i + 5] + [next(fresh), next(fresh)] for i in range(24)]
        copies = [passage[:28] + [next(fresh)] for _ in range(40)]
        rng.shuffle(quotes)
        rows += [(at + i, " ".join(words)) for i, words in enumerate(quotes + copies)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).coalesce(1)
        assert {tuple(r) for r in ngram_join.jaccard_components(docs).collect()} == brute_force(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É é a b c"), (8, "é é a b c"), (9, "x " * 40000), (10, "X\n" * 30000)]
    assert result(spark, rows) == brute_force(rows)
    assert result(spark, []) == set()
    # repeated rows are one node with a row each; null ids are linked with nothing
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 0), (1, "a b c d e", "en", "s", 0), (None, "a b c d e", "en", "s", 0), (2, "a b c d e", None, None, None)], SCHEMA)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect() if r[0]) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    kept = ngram_join.first_of_components(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 1]


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id int, text string, id int, component int, n int")
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    found = {r["id"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
