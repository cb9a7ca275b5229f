import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest

from corvane.llm import media, url_filter, warc

PAGES = "page_id bigint, url string, html string"


def test_archive_round_trip(spark):
    rows = [(1, "http://a/x", "same"), (2, "http://b/ y\r\nX: 1", "same"), (3, None, None), (4, "http://c", ""), (5, "http://d", "é" * 100000), (6, "http://d", "WARC/1.1\r\n\r\n"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, PAGES)
    archive = warc.write_archive(pages)
    records = {r["id"]: r for r in warc.read_archive(spark, archive).collect()}
    assert {i: bytes(r["payload"]) for i, r in records.items()} == {i: (h or "").encode() for i, _, h in rows}
    assert spark.read.parquet(archive.blobs).count() == 4
    found = {r[0]: tuple(r)[1:] for r in warc.archived_pages(pages).collect()}
    for i, _, html in rows:
        payload = (html or "").encode()
        last = max((k for k, _, h in rows if (h or "") == (html or "") and k is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert found[i] == (len(payload), digest, "response" if i == last else "revisit", None if i == last else last)
    exact = {r["id"]: bytes(r["record"]) for r in warc.record_bytes(warc.read_archive(spark, archive)).collect()}
    for i, record in exact.items():
        head, _, body = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields["Content-Length"]) == len(body) - 4, i


def test_archive_smaller_payloads_and_repeats(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef")]
    found = sorted(tuple(r)[0::3] for r in warc.archived_pages(spark.createDataFrame(rows, PAGES), min_bytes=3).collect())
    assert found == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "h", 5, "x")], PAGES + ", id int, address string")
    assert [tuple(r)[0:2] for r in warc.archived_pages(pages).collect()] == [(1, 1)]


def test_archive_damage_is_found(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "text")], PAGES))
    from pyspark.sql import functions as F

    bad = warc.Archive(archive.headers, archive.blobs + "-bad")
    spark.read.parquet(archive.blobs).withColumn("payload", F.encode(F.lit("texu"), "UTF-8")).write.parquet(bad.blobs)
    with pytest.raises(Exception, match="fails its digest"):
        warc.read_archive(spark, bad).collect()


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def test_png_filters_against_plain_loops():
    rng = np.random.default_rng(5)
    samples = rng.integers(0, 256, (12, 20)).astype(np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 0, 4])
    lines = samples.copy()
    for y in range(12):
        for x in range(20):
            left = int(samples[y, x - 1]) if x else 0
            up = int(samples[y - 1, x]) if y else 0
            corner = int(samples[y - 1, x - 1]) if x and y else 0
            guess = [0, left, up, (left + up) // 2, paeth(left, up, corner)][kinds[y]]
            lines[y, x] = (int(samples[y, x]) - guess) & 255
    assert (media.unfilter(kinds, lines) == samples).all()


def test_png_checksums():
    data = media.write_png(np.zeros((2, 192), np.uint8))
    assert (media.read_png(data) == 0).all()
    for bad in (data[:40] + bytes([data[40] ^ 1]) + data[41:], data[:-5], b"x" + data[1:]):
        with pytest.raises((ValueError, struct.error)):
            media.read_png(bad)


def test_text_media(spark):
    texts = [None, "", "a", "b" * 192, "é" * 97, "long " * 40000, "a"]
    rows = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, media string, n_bytes int")
    found = {r["doc_id"]: r for r in media.text_media(rows).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
    assert found[2]["feature"] == found[6]["feature"] and found[0]["media_sha256"] == found[1]["media_sha256"]
    assert media.text_media(rows.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        "http://WWW.Example.net/en/x?y": ("www.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://example.net?x": ("example.net", "", None, "allow"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/casino": ("x.org", "/fr/casino", "org/fr/", "allow"),
        "http://x.org/casino": ("x.org", "/casino", None, "block"),
        "http://x.org/casinos": ("x.org", "/casinos", None, "allow"),
        "http://x.org/free-bonus": ("x.org", "/free-bonus", None, "block"),
        "http://x.org/free-free": ("x.org", "/free-free", None, "allow"),
        "http://x.org/a://b": ("x.org", "/a://b", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(cases)], PAGES + ", rule string")
    found = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge_urls(pages).collect()}
    assert found == dict(enumerate(cases.values()))
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
