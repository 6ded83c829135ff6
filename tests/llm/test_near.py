import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import rows

from wordtide.llm import chosen_path
from wordtide.llm.chosen_path import Join
from wordtide.llm.common import Scratch
from wordtide.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(docs):
    """doc_id -> (n, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(words, rnd, edits):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("join", [Join(), Join(leaf=8, depth=2, deepest=4), Join(leaf=5, depth=2, deepest=2)])
def test_equals_brute_force(spark, join):
    """Chains of copies, near misses, a shared boilerplate; small leaves force branching and blocks."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = [rnd.choice(vocabulary) for _ in range(60)]
    docs = []
    for g in range(14):
        words = [rnd.choice(vocabulary) for _ in range(120)] + (boiler if g % 2 else [])
        for _ in range(9):
            docs.append((len(docs), mutated(words, rnd, rnd.choice([0, 0, 1, 2, 3, 4, 6, 9]))))
            if g % 3 == 0:
                words = docs[-1][1].split()  # a chain: its ends are not alike
    docs += [(1000 + i, t) for i, t in enumerate(["", None, "x", "X", "x y", "x  Y", "y x", " \n", "a b c", "A B C", "a b c d"])]
    want = brute(docs)
    got = chosen_path.groups(spark, spark.createDataFrame(docs, "doc_id long, text string"), join)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_alike_members_are_not_multiplied(spark, monkeypatch):
    """A large node of near copies and some that are not near goes to blocks; only nodes that split branch."""
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(400)}" for _ in range(150)]
    docs = [(i, mutated(words, rnd, 1 + i % 12)) for i in range(60)]
    kept, keep = [], Scratch.keep

    def counted(self, df, name, *rest):
        out = keep(self, df, name, *rest)
        if {"node", "sig"} <= set(out.columns):
            kept.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    join = Join(leaf=5, depth=1, deepest=6)
    got = chosen_path.groups(spark, spark.createDataFrame(docs, "doc_id long, text string"), join)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs)
    assert 0 < sum(kept) <= 2 * join.trees * len(docs)
    rng = np.random.default_rng(3)
    alike, unlike = np.tile(rng.integers(0, 2**16, chosen_path.SLOTS, dtype=np.uint16), (20, 1)), rng.integers(0, 2**16, (20, chosen_path.SLOTS), dtype=np.uint16)
    rows_ = [(node, node * 100 + i, node * 100 + i, bytearray(s.tobytes())) for node, sigs in ((1, alike), (2, unlike)) for i, s in enumerate(sigs)]
    large = spark.createDataFrame(rows_, "node long, rep long, component long, sig binary")
    split, born = chosen_path._children(large, Scratch(spark, "t"), join)
    assert rows(split) == [(2,)] and born.count() == 2 * len(rows_)


def test_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = c.execute(chosen_path.ORACLE)
    names = [d[0] for d in q.description]
    assert Counter(map(tuple, chosen_path.query(spark, sf).select(*names).collect())) == Counter(q.fetchall())


def test_odd_rows(spark, odd, none):
    got = rows(chosen_path.groups(spark, odd), "doc_id", "component_id", "kept")
    assert (4, 4, True) in got and (5, 4, False) in got and (6, 6, True) in got and (9, 6, False) in got
    assert (None, None, True) in got and (1, 1, True) in got and (2, 2, True) in got and got.count((7, 7, True)) == 2 and len(got) == odd.count()
    kept = chosen_path.keep_first(spark, odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 7, 8]
    assert chosen_path.groups(spark, none).count() == 0


def test_recall_is_counted(spark):
    """The chance that no tree brings a pair at the threshold together."""
    j = Join()
    assert (1 - 0.85**j.depth) ** j.trees < 1e-6 and j.least_set == 6


def test_trees_are_independent():
    """Of 160,000 pairs at the threshold fewer are lost than by trees that share minwise values (30)."""
    rng = np.random.Generator(np.random.PCG64(5))
    j, n, step = Join(), 160_000, 20_000
    lost = 0
    for _ in range(0, n, step):
        a = rng.integers(0, 2**16, (step, chosen_path.SLOTS), dtype=np.uint16)
        b = np.where(rng.random(a.shape) < 0.85, a, rng.integers(0, 2**16, a.shape, dtype=np.uint16))
        walks = [list(chosen_path._paths(j.trees, j.depth)([pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in s]), pa.array(range(step))], names=["sig", "rep"])])) for s in (a, b)]
        met = np.zeros(step, bool)
        for x, y in zip(*walks):
            met |= x.column("node").to_numpy() == y.column("node").to_numpy()
        lost += int((~met).sum())
    assert lost <= 3
    tail = sum(math.comb(chosen_path.SLOTS, k) * 0.85**k * 0.15 ** (chosen_path.SLOTS - k) for k in range(j.agree))
    assert tail < 1e-6


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    """Against all pairs of rows: ids that repeat with other texts, in both orders, near others and not."""
    rnd = random.Random(21)
    text = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(90))
    a, b, c, d = text(), text(), text(), text()
    docs = [(3, a), (5, a), (5, b), (7, c), (7, mutated(b.split(), rnd, 2)), (9, mutated(c.split(), rnd, 1)), (2, d), (2, mutated(a.split(), rnd, 2)), (11, d), (11, a), (11, text()), (None, a), (None, "x")]
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    want = [(k, len(sets[i]), least.get(find(i)), k is None or least[find(i)] == k) for i, (k, _) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(chosen_path.groups(spark, df), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert rows(chosen_path.keep_first(spark, df)) == sorted((r for r, w in zip(docs, want) if w[3]), key=repr)
    alone = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert rows(chosen_path.keep_first(spark, alone)) == sorted([(3, a), (5, b)], key=repr)


def test_bitmaps_lose_no_pair():
    """The bound is at most the true difference, whatever the sizes, and cuts most pairs that are less alike."""
    rng = np.random.default_rng(4)
    cut = 0
    for n in (6, 40, 400, 3000, 20_000):
        for share in (0.5, 0.75, 0.86, 0.9, 0.99):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[: int(share * n)], rng.integers(0, 2**63, n - int(share * n), dtype=np.uint64))))
            true = len(np.setxor1d(a, b))
            maps = chosen_path.Bitmaps([chosen_path.signature(a), chosen_path.signature(b)])
            got = int(maps.differ(np.array([0]), np.array([1]))[0])
            shared = len(np.intersect1d(a, b))
            assert got <= true
            may = bool(chosen_path._may(np.array([true]), np.array([len(a)]), np.array([len(b)]), 85)[0])
            assert may == (100 * shared >= 85 * (len(a) + len(b) - shared))
            cut += not chosen_path._may(np.array([got]), np.array([len(a)]), np.array([len(b)]), 85)[0]
    assert cut >= 12


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, 5), (300, 300)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + edges[:9], "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: find(i) for i in root if i not in (300,) and any(a != b and i in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
