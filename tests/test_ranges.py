"""Lines by byte ranges against whole reads."""

import random

import pytest

from corvane.sources import files, ranges


def whole(data):
    text = files.decode(data)[0].removeprefix("\ufeff")
    return text.removesuffix("\n").split("\n") if text else []


def read(spark, folder, size):
    out = {}
    for r in sorted(ranges.read_lines(spark, str(folder), size).collect(), key=lambda r: (r["path"], r["start"], r["at"])):
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["line"])
    return out


@pytest.mark.parametrize("size", [4, 12, 100, 1 << 20])
def test_equal_to_whole_reads(spark, tmp_path, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab数据ਊé\r\n\n") for _ in range(rng.randint(1, 60))) for _ in range(3)] + ["\n", "\n\n", "a", "no end\nof line", "a\n\nb\n", "਀\n\nਊ\n"]
    wanted = {}
    for i, text in enumerate(texts):
        # two of the characters aren't in GBK: their bytes hold that of a line end in UTF-16 and UTF-32
        for encoding in ("utf-8", "utf-8-sig", "utf-16", "utf-32", *(() if {"ਊ", "਀"} & set(text) else ("gbk",))):
            data = text.encode(encoding)
            (tmp_path / f"{i} {encoding}.txt").write_bytes(data)
            wanted[f"{i} {encoding}.txt"] = whole(data)
    for name, data in {"be": b"\xfe\xff" + "数ਊ\nx".encode("utf-16-be"), "be32": b"\x00\x00\xfe\xff" + "数ਊ\nx".encode("utf-32-be"), "latin": b"caf\xe9 1\nx\xff\n" * 5}.items():
        (tmp_path / name).write_bytes(data)
        wanted[name] = whole(data)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "zeros").write_bytes(b"text\n" * 20 + b"\0" * 100)
    (tmp_path / "picture").write_bytes(b"\x89PNG\r\n\x1a\n and lines\n")
    assert read(spark, tmp_path, size) == wanted


def test_encoding_hangs_on_the_whole_file(spark, tmp_path):
    (tmp_path / "late").write_bytes(b"plain\n" * 50 + "数据\n".encode("gbk") + b"plain\n" * 50)
    (tmp_path / "controls").write_bytes(b"\x01\x02\n" * 50 + b"\xff")
    (tmp_path / "plain").write_bytes(b"plain\n" * 50)
    got = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["kind"]) for r in ranges.file_encodings(spark, str(tmp_path), 16).collect()}
    assert got == {"late": ("gbk", None), "controls": ("latin-1", "binary"), "plain": ("utf-8", None)}


def test_a_large_file_is_split_without_being_read(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 << 30)
    got = ranges.ranges(spark, str(tmp_path))
    assert got.count() == 96 and got.agg({"start": "max"}).collect()[0][0] == (3 << 30) - ranges.RANGE
    with pytest.raises(ValueError):
        ranges.ranges(spark, str(tmp_path), 6)


def test_no_files(spark, tmp_path):
    assert ranges.read_lines(spark, str(tmp_path)).count() == 0
