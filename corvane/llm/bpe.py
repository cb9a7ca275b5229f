"""Byte-level BPE: ids of whole texts by a public vocabulary of ranks, and texts back from ids.

``encode`` runs the tokenizers library in tasks over Arrow batches. The library works on characters, so each byte stands for one
character of a byte table (``byte_characters``), as public byte-level vocabularies have it. A rank file lists tokens only; its merges are all
the ways to cut a token into two others, in the order of the tokens' ranks, and a piece that is a token itself isn't merged. So ids are those that the rank
file's own rule gives: of all neighbours that make a token, those of the lowest rank merge first, leftmost first.

A text is cut into runs "white space, then other characters" before it is encoded: no piece of ``PATTERN`` holds a white space behind another
character, so no piece crosses such a cut, and what a run gives doesn't hang on its neighbours. A process therefore
keeps the ids of up to ``CACHED`` distinct runs. Texts are read in windows of some ``WINDOW`` characters that end at such cuts.

Offsets come from the tokens' lengths in bytes and the byte-to-character mapping of the text. A token that holds part of a character has that
whole character in its span, so spans of neighbours overlap there. ``decode`` reverses the byte table; ids that end inside a character give
bytes that aren't UTF-8, which ``decode`` returns as they are and ``decode_texts`` as replacement characters.

Edge cases: a null or empty text has no ids, and decodes to no bytes (null ids likewise). Repeated rows and texts are encoded alike, each for itself; keys aren't
looked at, so null and repeated keys stay. Texts are taken whole, however long. Strings of special tokens are ordinary text. An id that the
vocabulary doesn't have is an error. Columns of other names, whatever they are, aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the vocabulary file that the driver reads and sends to executors, in bytes.
VOCABULARY_BYTES = 64 << 20
#: Distinct runs of characters whose ids a process keeps, besides those of the window at hand.
CACHED = 300_000
#: Longest run that is kept, in characters.
CACHED_LENGTH = 64
WINDOW = 1 << 20
#: A task hands over its rows when they have so many ids together.
HANDED_IDS = 1 << 21

#: The characters of Unicode's property White_Space (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable in Latin-1, else the next one from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b if b in kept else next(moved)) for b in range(256)]


class Vocabulary:
    """The tokenizer of a rank file, built once a process."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines()) if token}
        self.pattern = pattern
        self.cache: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        characters = byte_characters()
        spelled = {token: "".join(characters[b] for b in token) for token in self.ranks}
        merges = [
            (spelled[token[:at]], spelled[token[at:]])
            for token in sorted(self.ranks, key=self.ranks.get)
            for at in range(1, len(token))
            if token[:at] in spelled and token[at:] in spelled
        ]
        built = Tokenizer(models.BPE(vocab={spelled[t]: rank for t, rank in self.ranks.items()}, merges=merges, ignore_merges=True))
        # the byte level doesn't split again: the pattern has
        built.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(self.pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return built

    @cached_property
    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of each id: the byte table, reversed, over the tokenizer's own spelling."""
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        return {rank: bytes(byte_of[c] for c in spelled) for spelled, rank in self.tokenizer.get_vocab().items()}

    @cached_property
    def token_lengths(self) -> np.ndarray:
        lengths = np.zeros(max(self.token_bytes, default=-1) + 1, np.int64)
        for rank, token in self.token_bytes.items():
            lengths[rank] = len(token)
        return lengths

    def learn(self, runs: Iterable[str]) -> dict[str, bytes]:
        """The ids, as little-endian unsigned 32-bit integers, of each run."""
        new = list(runs)
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        return {run: np.array(e.ids, "<u4").tobytes() for run, e in zip(new, found, strict=True)}

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, window by window, as little-endian unsigned 32-bit integers."""
        for window in windows(text):
            runs = _RUNS.findall(window)
            if len(self.cache) > CACHED:
                self.cache.clear()
            missing = {r for r in runs if r not in self.cache}
            self.cache.update(self.learn(missing))
            yield b"".join(map(self.cache.__getitem__, runs))
            for run in missing:
                if len(run) > CACHED_LENGTH:
                    del self.cache[run]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.token_lengths[ids])
        starts = ends - self.token_lengths[ids]
        return character[starts], character[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


def windows(text: str, width: int = WINDOW) -> Iterator[str]:
    """Parts of a text that end before a white space behind another character, of ``width`` characters or up to the next such place."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + width - 1) if start + width < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[start:end]
        start = end


_BUILT: dict[bytes, Vocabulary] = {}


def vocabulary(ranks_file: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file; one is kept for each process."""
    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Vocabulary(ranks_file, pattern)
    return _BUILT[key]


def _shared(spark: SparkSession, path: str, pattern: str):
    """The rank file, read by the driver, so that executors don't need it at the same path."""
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary is larger than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast((data, pattern))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """(key, ids), and with ``offsets`` (starts, ends) in characters of the text: lists of one entry a token."""
    shared = _shared(docs.sparkSession, path, pattern)
    names = ["ids", *(("starts", "ends") if offsets else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(*shared.value)
        for batch in batches:
            first, lists = 0, []
            for at, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                ids = np.frombuffer(b"".join(known.encode(text)), "<u4").astype(np.int32)
                lists.append([ids, *(known.offsets(text, ids) if offsets else ())])
                if at + 1 == batch.num_rows or sum(len(x[0]) for x in lists) > HANDED_IDS:
                    columns = [_lists(column) for column in zip(*lists, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), *columns], [key, *names])
                    first, lists = at + 1, []

    fields = [T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names)]
    return docs.select(F.col(key).alias(key), F.col(text).alias("_text")).mapInArrow(run, T.StructType(fields))


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded): the bytes that the ids stand for, whether they are UTF-8 or not, and the digest of the ids as read."""
    shared = _shared(tokens.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(*shared.value)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = value.values.to_numpy() if value.is_valid else np.zeros(0, np.int32)
                rows.append((len(found), hashlib.sha256(found.astype("<u4").tobytes()).hexdigest(), known.decode(found)))
            columns = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_tokens", "ids_sha256", "decoded"])

    fields = [T.StructField(key, tokens.schema[key].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.BinaryType())]
    return tokens.select(F.col(key).alias(key), F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(run, T.StructType(fields))


def decode_texts(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): bytes of characters that the ids hold in part only are replaced."""
    found = decode(tokens, path, pattern, key, ids)
    return found.select(key, F.try_validate_utf8(F.col("decoded").cast("string")).alias("_whole"), "decoded").select(
        key, F.coalesce("_whole", F.make_valid_utf8(F.col("decoded").cast("string"))).alias("text")
    )


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): texts encoded, and their ids decoded again."""
    back = decode(encode(docs, path, pattern, key, text, offsets=False), path, pattern, key)
    return back.select(key, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
