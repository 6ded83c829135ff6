import pytest
from pyspark.sql import functions as F

from wordtide.functions.text import by_line, mask_regex, matches, parent_key, path_key, path_key_of, space_tokens, text_tokens

GOLDEN = [(None, []), ("", []), ("aaa", ["aaa"]), ("aaa.", ["aaa."]), ("a. b", ["a.", "b"]), ("a . b", ["a", ".", "b"]), ("  x  y ", ["x", "y"]), ("A a", ["A", "a"]), ("p\tq\u00a0r", ["p\tq\u00a0r"]), (" ", [])]


def test_t2_golden(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(GOLDEN)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", space_tokens(F.col("s")).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(GOLDEN)}


@pytest.mark.parametrize("tokens", [text_tokens, by_line(space_tokens)])
def test_t3_lines(spark, tokens):
    df = spark.createDataFrame([(1, "p\tq\nr\r\ns r"), (2, None), (3, ""), (4, "\n \n")], "i int, s string")
    got = {r.i: sorted(r.t) for r in df.select("i", tokens(F.col("s")).alias("t")).collect()}
    assert got == {1: ["p\tq", "r", "s"], 2: [], 3: [], 4: []}


def test_t1_plug_in(spark):
    comma = by_line(lambda c: F.split(c, ","))
    assert spark.createDataFrame([("a,b\nb,c",)], "s string").select(comma(F.col("s")).alias("t")).first().t == ["a", "b", "c"]


def test_p1_p2(spark):
    df = spark.createDataFrame([("/a/b//",), ("C:\\x\\y\\",), ("/a",)], "p string")
    got = [tuple(r) for r in df.select(path_key(F.col("p")).alias("k"), parent_key(path_key(F.col("p"))).alias("d")).collect()]
    assert got == [("/A/B", "/A"), ("C:\\X\\Y", "C:\\X"), ("/A", "")]
    assert path_key_of("/tmp/x/../Ab/") == "/TMP/AB"


def test_s5_masks(spark):
    df = spark.createDataFrame([("B.TXT",), ("a.txt",), ("a.md",), ("x+y.txt",), ("a\nb.txt",)], "n string")
    hit = lambda *m: [r.n for r in df.filter(matches(F.col("n"), list(m))).collect()]
    assert hit("*.txt") == ["B.TXT", "a.txt", "x+y.txt", "a\nb.txt"]
    assert hit("?.TXT") == ["B.TXT", "a.txt"]
    assert hit("x+y.txt") == ["x+y.txt"]
    assert len(hit(None)) == len(hit(" ")) == 5
    assert hit() == []
    assert mask_regex("a.?*") == r"^a\...*$"
