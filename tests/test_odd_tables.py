"""Queries against their SQL on small tables with rows that the given ones lack."""

import os
import random

import duckdb
import pytest

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.plans import registry

CONVERSATIONS = [
    (1, 0, "user", "Ti it of in."), (1, 1, "assistant", "with words"), (2, 0, "system", "for some"), (2, 1, "user", "42 ?"), (3, 0, "tool", ""),
]


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over (rows, schema) tables, sorted."""
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = os.path.join(str(folder), f"{table}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    got = registry.QUERIES[name](spark, str(folder)).select(columns).collect()
    return sorted(map(tuple, got), key=str), sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize("name", ["block_contexts", "block_summaries", "code_blocks"])
def test_definitions_without_a_name(spark, tmp_path, name):
    # a conversation whose first message has no word ends in a function without a name
    got, want = against_sql(spark, tmp_path, name, conversations=(CONVERSATIONS, "conv_id bigint, turn int, role string, text string"))
    assert got == want


ODD_WORDS = [
    (1, 0, "user", "İstanbul and İzmir"), (1, 1, "assistant", "DİYARBAKIR"), (2, 0, "user", None), (2, 1, "user", "then some"), (2, 2, "system", "KELVIN Kelvin"),
    (3, 0, "system", None), (3, 2, None, "odd one"), (4, 0, "user", None), (None, 0, "user", "no id"), (5, None, "user", "no turn"), (5, 3, "user", "a turn"),
]


@pytest.mark.parametrize("name", ["block_summaries", "code_blocks", "block_contexts", "code_references"])
def test_listings_of_missing_texts_and_dotted_letters(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, conversations=(ODD_WORDS, "conv_id bigint, turn int, role string, text string"))
    assert got == want and got


def test_blocks_of_mixed_listings(spark, tmp_path):
    # many first messages without a word or a text, roles and turns that are missing, and texts that look like code
    rng = random.Random(5)
    words = ["if", "try:", "def x():", "  with a", "İzmir", "é", "ÉLAN", "K", "ab", "abc", "\t", "\u2028", "else:", "42", "{w}", "{t}", "\n", "async def", ""]
    roles = ["user", "assistant", "system", "tool", None]
    rows = [(c, None if rng.random() < 0.03 else t, rng.choice(roles), None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(0, 3)))) for c in range(-40, 160) for t in range(rng.choice([1, 3, 40]))]
    got, want = against_sql(spark, tmp_path, "code_blocks", conversations=(rows, "conv_id bigint, turn int, role string, text string"))
    assert got == want and sum(kind == "function" and name == "" for _, kind, name, *_ in want) > 20


QUESTIONS = [(1, "modèles"), (2, "quelques idées que"), (3, "happinessé"), (4, "ringß x"), (5, "a_des les2 Éque"), (6, "business"), (7, "tables"), (8, "élesé"), (9, "")]


def test_language_of_words_beside_accents(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "language_detect", benchmark=(QUESTIONS, "item_id bigint, text string"))
    assert got == want


def test_cached_rewrites_keep_their_length(spark, tmp_path):
    rows = [(1, "Straße, außen"), (5, "ŉ ﬁx ᾳ ᾼ ΐ 𐐨 straße"), (9, ""), (13, "plain é"), (2, "Straße, außen"), (3, "groß")]
    got, want = against_sql(spark, tmp_path, "rewrite_cached", benchmark=(rows, "item_id bigint, text string"))
    assert got == want


def test_upper_case_letter_by_letter(spark):
    # every letter that a difference of one letter for one and several for one can concern, alone and between others
    letters = [(c,) for c in map(chr, range(1, 0x2000)) if c.upper() != c or len(c.upper()) > 1] + [(c,) for c in map(chr, range(0xFB00, 0xFB20))]
    letters = [(c,) for (c,) in letters if c not in "ƛɤᲊ"]  # newer in Unicode than DuckDB's tables
    frame = spark.createDataFrame(letters, "c string")
    got = {r["c"]: (r["u"], r["v"]) for r in frame.select("c", X.upper_letters(F.col("c")).alias("u"), X.upper_letters(F.concat(F.lit("aß"), "c", F.lit("\n"))).alias("v")).collect()}
    duck = duckdb.connect()
    assert got == {c: duck.execute("SELECT upper($1), upper('aß' || $1 || chr(10))", [c]).fetchone() for (c,) in letters}
