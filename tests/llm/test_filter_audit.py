"""The audit against every order applied to every document by hand."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from corvane.llm import filter_audit

DOCS, LABELS = "doc_id bigint, lang string, text string", "doc_id bigint, quality int, toxic int"


def fails(key, text, smallest):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": key is not None and text in smallest and smallest[text] < key,
    }
    return {f for f, failed in tests.items() if failed}


def plain(docs, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[n] == 1} for n in (1, 2))
    smallest = {}
    for key, _, text in docs:
        if key is not None:
            smallest[text or ""] = min(key, smallest.get(text or "", key))
    rows = [(lang or "", key, fails(key, text or "", smallest)) for key, lang, text in docs]
    out = []
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        removed, steps = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                before = {*order[: step - 1]}
                removed[f] += len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), sum(f in r[2] and bool(r[2] & before) for r in own), sum(r[2] == {f} for r in own), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)))
        out += [(part, order, step, *rest, removed[f]) for order, step, f, *rest in steps]
    return sorted(out)


def docs_of(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Upper", "CAPS", "a&b", "#", "é"]
    texts = [None, "", " \n\t", "same text", "X", *(" ".join(rng.choice(vocabulary[: rng.choice([20, 60, 400, 405])]) for _ in range(rng.choice([5, 199, 200, 201, 300]))) for _ in range(25))]
    return [(rng.choice([None, *range(60)]), rng.choice(["en", "de", "", None]), rng.choice(texts)) for _ in range(n)]


def test_against_every_order(spark):
    docs = docs_of(150, 3)
    docs += docs[:20] + [(5, "en", "\x1c x\x0by\x85"), (61, "solo", "t " * 250)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(docs, DOCS).withColumn("good", F.lit(1)).withColumn("mask", F.lit("x"))
    got = filter_audit.audit(table, spark.createDataFrame(labels, LABELS).withColumn("lang", F.lit("xx")))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, labels)


def test_hot_text_and_empty_tables(spark):
    docs = [(i, "en", "same") for i in range(300)] + [(i, "de", "same") for i in range(-1, 40)]
    none = spark.createDataFrame([], LABELS)
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), none)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, [])
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).collect() == []


def test_very_long_text(spark):
    docs = [(1, "en", "word " * 200_000), (2, "en", " ".join(f"w{i}" for i in range(100_000)))]
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, 1, 1)], LABELS))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, [(1, 1, 1)])


def test_sums_are_inverted_exactly(spark):
    rng = random.Random(1)
    masks = [("p", False, False, m, rng.randint(0, 1 << 40)) for m in range(32)]
    table = spark.createDataFrame(masks, "part string, good boolean, toxic boolean, mask int, n bigint")
    assert filter_audit.cells(filter_audit.parity_sums(table)).first()["all"] == [m[4] for m in masks]
