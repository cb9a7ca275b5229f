"""Byte-level BPE against the library of rank files, and round trips."""

import array
import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "it's we'll  two   spaces\t\n x ", "naïve Straße — 数学 🙂🙃 é", "<|endoftext|> <|endoftext|>", "\x1c \x85  x　y", "a" * 3000, "-=" * 500 + " " * 700, "퟿\U0010ffff"]


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.vocabulary(file.read(), P.PATTERN)


def texts(n=200):
    rng = random.Random(5)
    made = ["".join(rng.choice(["word", "Ünï", "数", " ", "  ", "\n", "123", "'s", "!", "🙂", "aaaa", "\t ", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return ODD + made


def test_round_trip_against_the_ranks_own_library(spark, plain):
    rows = list(enumerate(texts())) + [(0, "again"), (None, "no key"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(map(str, (tuple(r) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect())))
    want = []
    for key, text in rows:
        ids = plain.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(map(str, want))


def test_given_tables(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, PATH, P.PATTERN, offsets=False).collect()}
    assert got == {r["doc_id"]: plain.encode_ordinary(r["text"] or "") for r in docs.select("doc_id", "text").collect()}


def test_offsets_cover_the_text(spark, plain):
    docs = spark.createDataFrame(list(enumerate(texts(80))), "doc_id bigint, text string")
    for r, text in zip(sorted(bpe.encode(docs, PATH, P.PATTERN).collect()), texts(80), strict=True):
        text = text or ""
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        at = 0
        for token, start, end in zip(r["ids"], r["starts"], r["ends"], strict=True):
            data = plain.decode_single_token_bytes(token)
            first, after = at, at + len(data)
            assert len(text[:start].encode()) <= first < len(text[: start + 1].encode()) and len(text[: end - 1].encode()) < after <= len(text[:end].encode())
            at = after
        assert at == len(text.encode())


def test_windows_change_nothing(vocabulary, plain, monkeypatch):
    text = " ".join(t for t in texts(60) if t)
    assert "".join(bpe.windows(text, 50)) == text and sum(1 for _ in bpe.windows(text, 50)) > 20
    monkeypatch.setattr(bpe, "CACHED", 10)
    monkeypatch.setattr(bpe.windows, "__defaults__", (50,))
    assert array.array("I", b"".join(vocabulary.encode(text))).tolist() == plain.encode_ordinary(text)


def test_ways_to_make_a_token_agree(vocabulary, plain):
    """Pieces in which two ways to make the same token overlap or stand beside each other."""
    ranks, pieces = vocabulary.ranks, set()
    for token in ranks:
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        if len(cuts) > 1:
            pieces.add(token + token)
            pieces |= {x + y + z for x, y in cuts for y2, z in cuts if y == y2}
    known = sorted({p.decode() for p in pieces if _valid(p)})
    assert len(known) > 10_000
    found = vocabulary.tokenizer.encode_batch_fast(known, add_special_tokens=False)
    assert all(e.ids == plain.encode_ordinary(p) for e, p in zip(found, known, strict=True))


def _valid(data):
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_decoding_split_characters(spark, vocabulary):
    first, rest = "字".encode()[:1], "字".encode()[1:]
    rows = [(1, [vocabulary.ranks[first]]), (2, [vocabulary.ranks[first], *(vocabulary.ranks[bytes([b])] for b in rest)]), (3, []), (4, None)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, ids array<bigint>")
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(tokens, PATH, P.PATTERN).collect()} == {1: first, 2: first + rest, 3: b"", 4: b""}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_texts(tokens, PATH, P.PATTERN).collect()} == {1: "�", 2: "字", 3: "", 4: ""}


def test_empty_table_and_large_vocabulary(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.round_trip(empty, PATH, P.PATTERN).collect() == []
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode(empty, PATH, P.PATTERN)
