"""Queries without SQL, against plain versions or their stated properties."""

from collections import Counter

from corvane.operators import chunking, fusion, rerank, retrieval
from corvane.operators import checking as K
from corvane.operators import graph as G
from corvane.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_full_retrieval_by_its_steps(spark):
    """Ids, caps and diversity: at most k a query, all of them candidates, no two too much alike unless there are few."""
    rows = registry.QUERIES["full_retrieval"](spark, FOLDER).collect()
    texts = {r["doc_id"]: set((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by_query = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        by_query.setdefault(r["query_id"], []).append(r["id"])
    assert by_query and all(len(ids) == len(set(ids)) <= 10 for ids in by_query.values())
    for ids in by_query.values():
        if len(ids) == 10:
            assert all(len(texts[a] & texts[b]) <= 0.85 * len(texts[a] | texts[b]) for i, a in enumerate(ids) for b in ids[:i])


def test_advanced_retrieval_adds_neighbours(spark):
    rows = registry.QUERIES["advanced_retrieval"](spark, FOLDER).collect()
    # a document has the inverse of its place, or 0.8 of that of the one before it
    places = {round(1 / p, 6) for p in range(1, 21)}
    near = {round(p * 0.8, 6) for p in places}
    assert rows and all(any(abs(r["score"] - x) < 1e-9 for x in (near if r["hop"] else places | near)) for r in rows)
    assert max(Counter(r["query_id"] for r in rows).values()) <= 10


def test_registries(spark):
    candidates = spark.createDataFrame([(1, "a", 1, 10, 0.9), (1, "b", 1, 11, 0.8)], "query_id bigint, strategy string, rank int, id bigint, similarity double")
    fusion.register(fusion.STRATEGIES, "one", lambda rows, k: rows.filter(f"strategy = 'a' and rank <= {k}"))
    fusion.register(fusion.STRATEGIES, "two", lambda rows, k: rows.filter("strategy = 'b'"))
    assert sorted((r["strategy"], r["id"]) for r in fusion.searched(["one", "two"], candidates, k=5).collect()) == [("one", 10), ("two", 11)]
    fusion.register(fusion.STRATEGIES, "two", None)
    assert "two" not in fusion.STRATEGIES and {"weighted", "rrf"} <= set(fusion.MERGERS)
    assert [r["id"] for r in fusion.MERGERS["rrf"](candidates, k=1).collect()] == [10]


def test_multi_hop_by_hand(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.9), ("b", "d", 1.0), ("c", "d", 0.5), ("c", "e", 0.4), ("d", "a", 1.0)]
    table = spark.createDataFrame(edges, "source string, target string, strength double")
    got = {(r["node"], r["hop"], r["score"]) for r in G.multi_hop(table, spark.createDataFrame([("a",)], "node string"), 2, 2, 0.8).collect()}
    # hop 1: b 0.4, c 0.72; hop 2: d (0.4 + 0.36) 0.8, e 0.288 * 0.8
    assert got == {("a", 0, 1.0), ("c", 1, 0.72), ("b", 1, 0.4), ("d", 2, 0.608), ("e", 2, 0.2304)}


def test_repair(spark):
    texts = spark.createDataFrame([(1, "call Alphaa then Betas teh end"), (2, "nothing")], "id bigint, content string")
    unknown = spark.createDataFrame([(1, "Alphaa"), (1, "Betas"), (2, "zzz")], "id bigint, name string")
    known = spark.createDataFrame([(1, "Alpha"), (1, "Beta"), (1, "Gamma")], "id bigint, name string")
    found = K.similar_names(unknown, known)
    assert {(r["name"], r["best"]) for r in found.collect()} == {("Alphaa", "Alpha"), ("Betas", "Beta"), ("zzz", None)}
    rows = {r["id"]: (r["content"], r["repairs"]) for r in K.repaired(texts, found, {"teh": "the"}).collect()}
    assert rows == {1: ("call Alpha then Beta the end", 2), 2: ("nothing", 0)}


def test_chunks_give_the_text_back(spark):
    texts = ["a" * 30 + "\n" + "b, c. " * 40, "one line", "\n\n\n".join(["x y z"] * 60)]
    for text in texts:
        pieces = chunking.recursive_pieces(text, 50)
        assert "".join(pieces) == text and max(map(len, pieces)) <= 50
    corpus = spark.createDataFrame([(i, "other", t) for i, t in enumerate(texts)] + [(9, "python", "def f():\n    pass\ndef g(): pass\n")], "id bigint, kind string, content string")
    rows = chunking.by_kind(corpus, 50).collect()
    assert {(r["id"], r["kind"]) for r in rows} == {(0, "text"), (1, "text"), (2, "text"), (9, "python")}
    assert [r["content"] for r in sorted(rows, key=lambda r: r["idx"]) if r["id"] == 9] == ["def f():\n    pass", "def g(): pass\n"]


def test_diverse_takes_all_of_a_short_list(spark):
    hits = spark.createDataFrame([(1, 1, 1, "a b", "x", 0.9), (1, 2, 2, "a b", "x", 0.8)], "query_id bigint, rank int, id bigint, content string, source string, similarity double")
    assert rerank.diverse(hits, 5).count() == 2
    assert retrieval.optimised(spark.createDataFrame([(1, " a   b?! ")], "query_id bigint, query string")).first()["query"] == "a b"


def test_navigator_merge_with_eight_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert registry.QUERIES["navigator_merge"](spark, FOLDER).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
