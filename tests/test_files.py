"""Encodings and binary content."""

import pytest

from corvane.sources import files


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-32", "gbk", "latin-1"])
def test_texts_of_every_encoding(spark, tmp_path, encoding):
    text = "caf\xe9 line\nnext" if encoding == "latin-1" else "数据 line\nnext"
    (tmp_path / "a.txt").write_bytes(text.encode(encoding))
    got = files.read_texts(spark, str(tmp_path)).collect()
    assert [r["text"] for r in got] == [text] or encoding == "latin-1" and len(got) == 1


def test_binary_kinds(spark):
    from pyspark.sql import functions as F

    cases = {
        "png": b"\x89PNG\r\n\x1a\n rest", "late zeros": b"a" * 9000 + b"\x00" * 1000, "few zeros": b"a" * 1000 + b"\x00", "controls": b"\xff\xfe\x01"[:1] + b"\x01\x02\x03" * 50 + b"\xff" * 100,
        "utf8 controls": b"\x01\x02\x03", "utf-16": "text".encode("utf-16"), "utf-32": "text".encode("utf-32"), "plain": "é 数".encode(), "empty": b"", "latin": "é à la carte".encode("latin-1"),
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "name string, content binary")
    got = {r["name"]: r["kind"] for r in rows.select("name", files.binary_kind(F.col("content")).alias("kind")).collect()}
    assert got == {"png": "png", "late zeros": "binary", "few zeros": None, "controls": "binary", "utf8 controls": None, "utf-16": None, "utf-32": None, "plain": None, "empty": None, "latin": None}


def test_language_by_first_line(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("run", "#!/usr/bin/env python3\nx"), ("go", "#!/usr/bin/node\nx"), ("sh", "#!/bin/sh\ndef"), ("a.py", "#!/bin/sh"), ("b", "text")], "path string, content string")
    assert [r[0] for r in rows.select(files.language(F.col("path"), F.col("content"))).collect()] == ["python", "javascript", "shell", "python", "unknown"]
