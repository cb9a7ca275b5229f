"""Likeness of names against every pair."""

import random
from difflib import SequenceMatcher

from corvane.operators import checking as K


def test_similar_names_against_every_pair(spark):
    rng = random.Random(8)

    def name():
        return "".join(rng.choice("aabBcé_1") for _ in range(rng.randint(1, 12)))

    unknown = [(i % 3, name()) for i in range(90)] + [(0, "Bob"), (0, ""), (1, "x" * 300)]
    known = [(i % 3, name()) for i in range(90)] + [(0, "Bib"), (0, ""), (1, "x" * 299 + "y"), (2, "aab"), (2, "aab")]
    for least in (0.6, 0.7, 0.3):
        got = {(r["id"], r["name"]): (r["best"], r["ratio"]) for r in K.similar_names(*(spark.createDataFrame(x, "id bigint, name string") for x in (unknown, known)), least).collect()}
        want = {}
        for key, a in {*unknown}:
            rated = [(-SequenceMatcher(None, a, b).ratio(), b) for k, b in known if k == key and a and b]
            best = min((r for r in rated if -r[0] > least), default=None)
            want[key, a] = (best[1], round(-best[0], 6)) if best else (None, None)
        assert got == want
    assert got[0, "Bob"][0] is not None


def test_verified_names(spark):
    named = spark.createDataFrame([(1, "function", "read_row"), (1, "function", "read_rows"), (1, "class", "Readr"), (1, "function", "zzz"), (2, "function", "read_row")], "id bigint, kind string, name string")
    known = spark.createDataFrame([(1, "function", "read_row"), (1, "class", "Reader")], "id bigint, kind string, name string")
    got = {(r["id"], r["kind"], r["name"]): r["how"] for r in K.verified_names(named, known).collect()}
    assert got == {(1, "function", "read_row"): "exact", (1, "function", "read_rows"): "similar", (1, "class", "Readr"): None, (1, "function", "zzz"): None, (2, "function", "read_row"): None}
