import gzip

import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordtide.functions.text import by_line, space_tokens
from wordtide.sources import files


@pytest.fixture
def many(tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for i in range(400):
        (d / f"doc_{i}.{'md' if i % 4 == 3 else 'txt'}").write_text(f"a b\nw{i} a")
    return d


def test_scan_has_no_task_for_a_few_files_and_no_shuffle_of_tokens(spark, many):
    found = files.tokens(spark, files.listed(spark, f"file://{many}", "*.txt"))
    assert rows(found.select(F.regexp_extract("path", r"doc_(\d+)", 1).alias("i"), "token")) == sorted(((str(i), t) for i in range(400) if i % 4 != 3 for t in ("a", "b", f"w{i}")), key=repr)
    assert found.rdd.getNumPartitions() == 4  # spark.sql.shuffle.partitions
    assert files.tokens(spark, [str(p) for p in many.iterdir()]).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_listing_is_one_task_and_has_empty_files(spark, many):
    (many / "none.txt").touch()
    (many / ".hidden.txt").write_text("x")
    (many / "sub.txt").mkdir()
    found = files.listed(spark, str(many), "*.TXT")
    assert found.rdd.getNumPartitions() == 1
    have = {r.name: r for r in found.collect()}
    assert set(have) == {f"doc_{i}.txt" for i in range(400) if i % 4 != 3} | {"none.txt"}
    assert have["none.txt"].length == 0 and have["doc_10.txt"].length == 9
    s = (many / "doc_10.txt").stat()
    assert have["doc_10.txt"].path == str(many / "doc_10.txt") and have["doc_10.txt"].mtime == s.st_mtime_ns // 1_000_000 * 1000


@pytest.mark.parametrize("raw, lines", [
    (b"", []), (b"\n", [""]), (b"a", ["a"]), (b"a\r", ["a"]), (b"a\r\nb\rc\n\nd", ["a", "b", "c", "", "d"]), (b"a\n\r", ["a", ""]), (b"\xef\xbb\xbfa\xff b\r\n", ["a\ufffd b"]), (b"\xef\xbb", ["\ufffd"]),
    ("é\r\nü\u2028x\x85".encode("utf-16"), ["é", "ü\u2028x\x85"]), (b"\xfe\xff" + "é\r".encode("utf-16-be"), ["é"]), ("\U0001f600ab\r\n".encode("utf-16"), ["\U0001f600ab"]),
])
@pytest.mark.parametrize("block", [3, 4, 1 << 20])
def test_pieces(tmp_path, monkeypatch, raw, lines, block):
    monkeypatch.setattr(files, "_BLOCK", block)
    (tmp_path / "x.txt").write_bytes(raw)
    assert [line for piece in files._pieces(str(tmp_path / "x.txt")) for line in piece.split("\n")] == lines
    assert [*files._pieces(str(tmp_path / "missing"))] == []


def test_large_packed_missing_and_repeated_files(spark, tmp_path):
    words = [f"w{i}" for i in range(5000)]
    large, packed, plain = tmp_path / "large.txt", tmp_path / "packed.txt.gz", tmp_path / "plain[1]*.txt"
    large.write_text("\n".join(" ".join(words) for _ in range(files.LARGE // 28_000)))
    assert large.stat().st_size > files.LARGE
    packed.write_bytes(gzip.compress(b"a b\r\n" * 500_000 + b"c"))
    plain.write_text("d\nd e")
    (tmp_path / "broken.gz").write_text("no gzip")
    some = [str(p) for p in (large, packed, plain, plain, tmp_path / "missing.txt", tmp_path / "broken.gz")]
    expected = sorted([(str(large), w) for w in words] + [(str(packed), t) for t in "abc"] + [(str(plain), t) for t in "de"], key=repr)
    assert rows(files.tokens(spark, some)) == expected
    assert rows(files.tokens(spark, spark.createDataFrame([(p,) for p in some], "path string"))) == expected
    assert rows(files.tokens(spark, some, by_line(space_tokens))) == expected  # of any other tokenizer
    assert files.tokens(spark, []).count() == 0 and files.lines(spark, [str(plain)]).count() == 2
