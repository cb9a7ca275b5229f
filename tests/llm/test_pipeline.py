"""The pipeline on the smallest tables, each stage against a plain version of its decision."""

import pandas as pd

import corpus_pipeline
from corvane.llm import quality
from corvane.llm.common import written
from test_brute_force import judged_by_hand
from test_ngram_join import brute_force
from test_text_operators import dedup_by_hand

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{FOLDER}/labels.parquet")
    bench = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "test-stage")
        out.append(docs.toPandas().sort_values("doc_id", ignore_index=True))
        assert name == names[-1] or docs.columns == columns
    raw = pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id", ignore_index=True)

    verdict = {r["doc_id"]: r["predicted"] for r in quality.classify_quality(spark.createDataFrame(raw), labels).collect()}
    assert out[0]["doc_id"].tolist() == [i for i in raw["doc_id"] if verdict[i]]

    gone = dedup_by_hand(out[0]["text"].tolist(), 50)
    kept = ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) for t, g in zip(out[0]["text"], gone, strict=True)]
    want = [(i, t) for i, t, g in zip(out[0]["doc_id"], kept, gone, strict=True) if not g or t.strip(" ")]
    assert list(zip(out[1]["doc_id"], out[1]["text"], strict=True)) == want
    assert out[1]["n_chars"].tolist() == [len(t) for t in out[1]["text"]]

    near = brute_force(list(zip(out[1]["doc_id"].tolist(), out[1]["text"], strict=True)))
    assert out[2]["doc_id"].tolist() == sorted(i for i, _, c in near if i == c)

    # what holds an item goes, and what goes is judged a leak by hand
    texts, kept_ids = dict(zip(out[2]["doc_id"], out[2]["text"], strict=True)), set(out[3]["doc_id"])
    assert not {i for i, t in texts.items() if any(b in t for b in bench["text"])} & kept_ids
    assert kept_ids <= set(texts)
    for gone in set(texts) - kept_ids:
        verdicts = [judged_by_hand(texts[gone], b) for b in bench["text"]]
        assert any(v is not None and v[0] != "inconsistent" for v in verdicts), gone

    assert set(out[4]["doc_id"]) <= set(out[3]["doc_id"]) and (out[4]["taken"] > 0).all() and (out[4]["taken"] <= 3 * out[4]["size"]).all()


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "test-empty")
        assert docs.count() == 0
