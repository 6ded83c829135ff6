import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordtide.functions import sets
from wordtide.operators import indexer, multimap, replay, subscriptions
from wordtide.operators.multimap import Multimap


def pairs(spark, *kv):
    return spark.createDataFrame(list(kv), multimap.SCHEMA)


def test_multimap_relations(spark):
    m = pairs(spark, ("a", "1"), ("a", "2"), ("b", "1"))
    assert rows(multimap.add(m, pairs(spark, ("a", "1"), ("c", "3"), (None, "1"), ("d", None)))) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "3")]
    assert rows(multimap.remove(m, pairs(spark, ("a", "1"), ("z", "9")))) == [("a", "2"), ("b", "1")]
    assert rows(multimap.remove_keys(m, spark.createDataFrame([("a",)], "key string"))) == [("b", "1")]
    assert rows(multimap.get(m, "a")) == [("1",), ("2",)] and rows(multimap.get(m, None)) == [] == rows(multimap.get(m, "zz"))
    assert multimap.contains(m, "a") and not multimap.contains(m, "q") and not multimap.contains(m, None)
    assert rows(multimap.transpose(m)) == [("1", "a"), ("1", "b"), ("2", "a")]
    assert rows(multimap.flush(m)) == []
    df = spark.createDataFrame([(1, ["x", "x", None]), (2, None)], "k int, v array<string>")
    assert rows(multimap.pairs(df, F.col("k"), F.col("v"))) == [(1, "x")]


def test_multimap_guards_and_events(spark):
    m, seen = Multimap(spark), []
    m.added.append(lambda k, v: seen.append(("+", k, v)))
    m.removed.append(lambda k, v: seen.append(("-", k, v)))
    m.add("a", ["1", "1", "2"])
    m.add("a", "1")
    m.add("a", [])
    m.add(None, "1")
    m.add("a", None)
    assert seen == [("+", "a", ("1", "1", "2")), ("+", "a", ("1",))]
    seen.clear()
    assert not m.remove("a", "9") and not m.remove("a", []) and not m.remove(None, "1") and not m.remove("z", ["1"])
    assert m.remove("a", ["9"])  # several values: true as the key is there
    assert m.remove("a", "1") and seen == [("-", "a", ("9",)), ("-", "a", ("1",))]
    assert m.contains("a") and rows(m.get("a")) == [("2",)]
    assert m.remove("a", "2") and not m.contains("a")  # no key without values
    m.add("b", ["1", "2"])
    ok, old = m.remove_all("b")
    assert ok and sorted(old) == ["1", "2"] and m.remove_all("b") == (False, ())
    m.add("c", "1")
    seen.clear()
    m.flush()
    assert seen == [] and not m.contains("c")
    m.dispose()


def post(spark, *td):
    return spark.createDataFrame(list(td), "token string, doc_id long")


def test_indexer(spark):
    docs = spark.createDataFrame([(1, "q3 q4 q5 q6 q7"), (2, "x x\ny"), (3, None), (4, "")], "doc_id long, text string")
    p = indexer.postings(docs)
    assert rows(p.filter("doc_id <> 1")) == [("x", 2), ("y", 2)]
    new = indexer.postings(spark.createDataFrame([(1, "q1 q2 q3 q4")], "doc_id long, text string"))
    one = spark.createDataFrame([(1,)], "doc_id long")
    gone, fresh = indexer.diff(p, new, one)
    assert rows(gone, "token") == [("q5",), ("q6",), ("q7",)] and rows(fresh, "token") == [("q1",), ("q2",)]
    assert rows(indexer.update(p, new, one).filter("doc_id = 1"), "token") == [("q1",), ("q2",), ("q3",), ("q4",)]
    assert rows(indexer.update(p, new.limit(0), spark.createDataFrame([(1,)], "doc_id long"))) == [("x", 2), ("y", 2)]
    gone, fresh = indexer.diff(p, new.limit(0), one)
    assert rows(gone, "token") == [(f"q{i}",) for i in range(3, 8)] and fresh.count() == 0
    after = spark.createDataFrame([(1, ""), (2, None), (5, "z z")], "doc_id long, text string")
    gone, fresh = indexer.diff_texts(docs, after)
    assert rows(gone, "doc_id", "token") == [(1, f"q{i}") for i in range(3, 8)] + [(2, "x"), (2, "y")] and rows(fresh, "doc_id", "token") == [(5, "z")]
    assert rows(indexer.add(p, p)) == rows(p) == rows(indexer.merged(p.unionByName(p)))
    assert rows(indexer.remove_tokens(p, post(spark, ("x", 2), ("q3", 9))).filter("doc_id = 2")) == [("y", 2)]
    assert rows(indexer.remove_documents(p, spark.createDataFrame([(1,)], "doc_id long"))) == [("x", 2), ("y", 2)]
    assert rows(indexer.inverted(p, "x")) == [(2,)] and rows(indexer.inverted(p, None)) == []
    assert rows(indexer.forward(p, 2)) == [("x",), ("y",)]
    assert rows(indexer.search_text(docs, "y"), "doc_id") == [(2,)] and rows(indexer.search_text(docs, "q")) == []


def test_x5_switch(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "doc_id long, path_key string")
    swap = lambda *w: rows(indexer.switch(docs, spark.createDataFrame(list(w), "who string, with string")))
    assert swap(("A", "B")) == [(1, "B"), (2, "A"), (3, "C")]
    assert swap(("A", "NEW")) == [(1, "NEW"), (2, "B"), (3, "C")]  # a rename
    assert swap(("X", "Y")) == [(1, "A"), (2, "B"), (3, "C")]


@pytest.mark.parametrize("seed", range(4))
def test_replay_is_sequential(spark, seed):
    rnd = random.Random(seed)
    log = []
    for seq in range(300):
        op = rnd.choice(["add", "add", "remove", "update", "remove_all"])
        log.append((seq, f"k{rnd.randrange(5)}", op, [] if op == "remove_all" else sorted({f"t{rnd.randrange(6)}" for _ in range(rnd.randint(1, 3))})))
    state = {}
    for _, k, op, ts in log:
        s = state.setdefault(k, set())
        if op == "add":
            s |= set(ts)
        elif op == "remove":
            s -= set(ts)
        else:
            state[k] = set(ts)
    df = spark.createDataFrame(log, "seq long, key string, op string, tokens array<string>")
    assert rows(replay.replay(df)) == sorted((k, t) for k, s in state.items() for t in s)
    # operations that later ones make void change nothing
    assert rows(replay.replay(replay.latest(df))) == rows(replay.replay(df))


@pytest.mark.parametrize("seed,block", [(0, 1 << 20), (1, 7), (2, 1)])
def test_events_are_those_of_the_multimap(spark, monkeypatch, seed, block):
    """Guards and payloads of add, remove, remove_all and update (remove, then add), one operation after another."""
    monkeypatch.setattr(replay, "BLOCK", block)
    rnd = random.Random(seed)
    log, want, state = [], [], {}
    for seq in range(400):
        op, k = rnd.choice(["add", "add", "remove", "remove", "update", "remove_all"]), f"k{rnd.randrange(8)}"
        tokens = [] if op == "remove_all" else sorted({f"t{rnd.randrange(5)}" for _ in range(rnd.randint(0, 3))})
        log.append((seq, k, op, tokens))
        old = state.setdefault(k, set())
        if op == "add":
            told = [("added", tokens)]
            state[k] = old | set(tokens)
        elif op == "remove":
            told = [("removed", tokens if old else [])]
            state[k] = old - set(tokens)
        elif op == "remove_all":
            told = [("removed", sorted(old))]
            state[k] = set()
        else:
            told = [("removed", sorted(old - set(tokens))), ("added", sorted(set(tokens) - old))]
            state[k] = set(tokens)
        want += [(seq, kind, k, v) for kind, v in told if v]
    df = spark.createDataFrame(log + [(1000, None, "add", ["x"]), (1001, "k0", "add", None)], "seq long, key string, op string, tokens array<string>")
    assert sorted((r.seq, r.kind, r.key, r["values"]) for r in replay.events(df).collect()) == sorted(want)
    assert rows(replay.replay(df)) == sorted((k, t) for k, s in state.items() for t in s)


def test_set_algebra(spark):
    cases = [(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a", "b"]), (["a", "b"], ["a"]), (None, ["x"]), (["a", "b"], ["b", "a"]), (["a"], ["b"]), (["a", "b"], ["a", "a", "b"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", *(f(a, b).alias(f.__name__) for f in (sets.union, sets.intersect, sets.minus, sets.is_subset, sets.is_superset, sets.is_proper_subset, sets.is_proper_superset, sets.overlaps, sets.equals))).orderBy("i").collect()
    for r, (x, y) in zip(got, cases):
        x, y = set(x or ()), set(y or ())
        assert (set(r["union"]), set(r["intersect"]), set(r["minus"])) == (x | y, x & y, x - y)
        assert (r.is_subset, r.is_superset, r.is_proper_subset, r.is_proper_superset, r.overlaps, r["equals"]) == (x <= y, x >= y, x < y, x > y, bool(x & y), x == y)
    one = df.filter("i = 0").select(sets.add(a, F.lit("z")), sets.remove(a, F.lit("a")), sets.contains(a, F.lit(None)), sets.try_add(a, F.lit("a")), sets.size(a), sets.add(a, F.lit(None).cast("string")), sets.cleared()).first()
    assert tuple(one) == (["a", "b", "z"], ["b"], False, False, 2, ["a", "b"], [])
    with pytest.raises(NotImplementedError):
        sets.symmetric_difference(a, b)
    with pytest.raises(Exception, match="present already"):
        df.filter("i = 0").select(sets.add_strict(a, F.lit("a"))).collect()
    r, q = (spark.createDataFrame([(x,) for x in s], "t string") for s in ("abc", "bc"))
    assert rows(sets.relation_minus(r, q)) == [("a",)] and rows(sets.relation_intersect(r, q)) == [("b",), ("c",)] and sets.relation_union(r, q).count() == 3
    assert sets.relation_is_subset(q, r) and not sets.relation_equals(q, r) and sets.relation_overlaps(q, r)


def test_subscriptions():
    r = subscriptions.Registry()
    assert r.add("/d/x/", "*.TXT") and not r.add("/d/X", "*.txt")  # a folder is known whatever its case
    assert r.add("/d/x", None) and r.listing() == ["/D/X/*.txt|*"]
    assert r.remove("/d/x", "*.md") == [] and r.remove("/nowhere") == []
    assert r.remove("/d/x", "*.Txt") == ["*.txt"] and r.remove("/d/x", "*") == ["*"] and r.listing() == []
    r.add("/d", "One.txt")
    r.file_renamed("/d", "one.txt", "Two.txt")
    assert r.listing() == ["/D/two.txt"] and r.covers("/d", "TWO.TXT") and not r.covers("/d", "one.txt")
    r.file_gone("/d", "two.TXT")
    assert r.listing() == []  # without masks there is no subscription


def test_unsubscribed_mask_takes_files_of_another_mask(spark):
    files = spark.createDataFrame([("F", "a.txt"), ("F", "b.md"), ("G", "a.txt")], "folder_key string, name string")
    assert rows(subscriptions.deselect(files, F.lit("F"), ["a*"])) == [("F", "b.md"), ("G", "a.txt")]
    assert rows(subscriptions.select(files, F.lit("F"), ["*.txt", "a.*"])) == [("F", "a.txt")]
