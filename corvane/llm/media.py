"""Media columns: lossless PNG samples in binary columns, and cosine-transform hashes.

``encode_png`` turns a binary column into PNG bytes (8-bit grey, ``width`` samples a row);
``decode_png`` reads PNG bytes back with every chunk's checksum tested, the zlib stream
inflated and the five scanline filters undone in numpy, and adds the features.

Edge cases: a null payload is empty; an empty one is a single row of blanks; bytes are
padded with 32 up to a positive multiple of ``width``. A file whose signature, checksum or
sizes are wrong raises ``ValueError`` in ``read_png`` (the task fails: data was damaged).
Texts are stored whole, however long, one at a time; repeated rows have equal values. Other columns of the input, whatever their names, don't appear
in the output, which is keyed by ``key`` (of any type, or null). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import small_batches, written

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
WIDTH = 192


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = 2) -> bytes:
    """PNG of a (rows, width) uint8 array; each row takes the filter None or Up with the smaller sum of steps."""
    rows, width = samples.shape
    above = np.vstack([np.zeros((1, width), np.uint8), samples[:-1]])
    up = samples - above
    # signed magnitude of a filtered byte, the usual heuristic for choosing filters
    cost_none = np.minimum(samples, 256 - samples.astype(np.int16)).sum(axis=1)
    cost_up = np.minimum(up, 256 - up.astype(np.int16)).sum(axis=1)
    use_up = cost_up < cost_none // 2
    lines = np.empty((rows, width + 1), np.uint8)
    lines[:, 0] = np.where(use_up, UP, NONE)
    lines[:, 1:] = np.where(use_up[:, None], up, samples)
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("PNG chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"PNG chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + n


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the scanline filters of one-byte pixels, in numpy.

    Runs of rows with the filters None, Up and Sub are undone at once by cumulative sums. Average and Paeth need the left, upper and upper left
    neighbours, so a run with either is undone diagonal by diagonal: all of a diagonal's neighbours lie on the two before it.
    """
    if kinds.max(initial=0) > PAETH:
        raise ValueError(f"unknown PNG filter {kinds.max()}")
    out = lines.copy()
    simple = kinds <= UP
    at = 0
    while at < len(out):
        end = at + 1
        while end < len(out) and simple[end] == simple[at] and (not simple[at] or kinds[end] == kinds[at]):
            end += 1
        block = out[at:end]
        above = out[at - 1] if at else np.zeros(out.shape[1], np.uint8)
        if not simple[at]:
            out[at:end] = _by_diagonals(kinds[at:end], block, above)
        elif kinds[at] == UP:
            block[0] += above
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kinds[at] == SUB:
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        at = end
    return out


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    rows, width = lines.shape
    # a border of zeros on the left, and the row above on top
    out = np.zeros((rows + 1, width + 1), np.int32)
    out[0, 1:] = above
    for diagonal in range(rows + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(rows, diagonal + 1))
        x = diagonal - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kinds[y], [0 * left, left, up, (left + up) >> 1, paeth])
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """The (rows, width) samples of an 8-bit grey PNG; raises ValueError if it is damaged."""
    head, body = None, []
    ended = False
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    width, rows = head[:2]
    if raw.size != rows * (width + 1):
        raise ValueError("PNG data has the wrong size")
    raw = raw.reshape(rows, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def _dct_rows(n: int, size: int, keep: int) -> np.ndarray:
    """The ``keep`` lowest cosine waves over ``size`` cells."""
    k, x = np.arange(keep)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * size)) * np.sqrt(2.0 / size)


_WAVES = _dct_rows(32, 32, 8)


def cosine_hash(samples: np.ndarray) -> str:
    """Hash of 63 bits, as 16 hex digits: samples averaged over a 32 x 32 grid, 8 x 8 lowest cosine terms but the constant one, bits above their median."""
    rows, width = samples.shape
    ys = np.linspace(0, rows, 33).astype(int)[:-1] if rows >= 32 else np.arange(32) * rows // 32
    xs = np.linspace(0, width, 33).astype(int)[:-1]
    if rows >= 32:
        sums = np.add.reduceat(samples, ys, axis=0, dtype=np.int64)
        tall = np.diff(np.append(ys, rows))[:, None]
    else:
        sums, tall = samples[ys].astype(np.int64), 1
    grid = np.add.reduceat(sums, xs, axis=1) / tall / np.diff(np.append(xs, width))[None, :]
    low = (_WAVES @ grid @ _WAVES.T).ravel()
    # rounded so that the bits don't hang on the last digits of a sum
    bits = np.round(low[1:], 6) > np.round(np.median(low[1:]), 6)
    return format(int("".join("1" if b else "0" for b in bits), 2), "016x")


ENCODED = "n_bytes bigint, media binary"
DECODED = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def _keyed(df: DataFrame, key: str, columns: str) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(columns).fields])


def encode_png(df: DataFrame, key: str, payload: Column, width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, media): each payload (binary; null is empty) padded with blanks and stored as PNG."""
    small_batches(df.sparkSession)

    def encode(batches):
        for batch in batches:
            media, sizes = [], []
            for value in batch.column(1).to_pylist():
                size = len(value)
                rows = max(1, -(-size // width))
                cells = np.full(rows * width, 32, np.uint8)
                cells[:size] = np.frombuffer(value, np.uint8)
                media.append(write_png(cells.reshape(rows, width)))
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    rows = df.select(F.col(key).alias(key), F.coalesce(payload, F.lit(b"")).alias("_payload"))
    return rows.mapInArrow(encode, _keyed(df, key, ENCODED))


def decode_png(media: DataFrame, key: str) -> DataFrame:
    """Digests and features of the stored PNGs, from the samples that were read back."""

    def decode(batches):
        for batch in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in batch.column(2).to_pylist():
                samples = read_png(data)
                payload = samples.tobytes()
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(cosine_hash(samples))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [key, "n_bytes", *out])

    return media.select(key, "n_bytes", "media").mapInArrow(decode, _keyed(media, key, DECODED))


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text as a PNG column, written to the shared folder, and what is read back from there with its digests and hash."""
    stored = written(encode_png(docs, key, F.encode(F.col(text), "UTF-8")), "media")
    return decode_png(stored, key)
