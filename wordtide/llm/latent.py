"""Benchmark decontamination by latent semantic retrieval.

1. *Counts.* One pass over all documents cuts them into blocks of words and counts, for each term
   of the benchmark, the blocks that hold it; the same pass writes the terms of each passage (two blocks).
2. *Space.* A randomised SVD of TF-IDF passages, all different ones of the corpus and the benchmark's
   own: how often two terms share a passage is counted over all of them, once; a Gaussian sketch, a
   few rounds of orthogonal iteration whose products A'AQ are summed by tiles of these counts in
   Spark, and the eigenvectors of the small projected matrix.  The corpus weighs as its passages, but
   no more than `corpus_weight` of them, so the benchmark's own count as much beside a large one.  Terms in more than `stop`
   of all blocks are left out, but for the `least_telling` rarest of each piece of an item.  Passages and items are compared in the space scaled to unit
   variance; a passage's words outside the benchmark's vocabulary count towards its length.
3. *Candidates.* Every window of every document (two blocks, one block apart) is embedded and
   compared with every piece of every item: cosine of at least `cosine`, or, for a short or common
   piece, `ease` of what the piece itself would reach amid foreign words.  Windows whose share of
   known words bounds their cosine below that need no comparison.  Items without any telling term
   have no direction; they are found by their first three words.
4. *Checks.* At least half of the item's telling words must lie around a candidate window.  Counts of
   them by block bound how many do, for all candidates at once; what is left is looked at one by one.  The
   words there and the item's are compared by longest common subsequence.  A share of `verbatim`
   of the item's words is a leak; from `paraphrase` on, of all words and of the telling ones, it
   is one if the telling words of the item's answer (the column `answer`, else its last sentence)
   are there too; an item without an answer, or with no telling word in it, is decided by all of
   its words and its telling ones alone.

Only the benchmark side is broadcast, and bounded: it is taken in blocks of at most `item_block` items
and `most_terms` different words (a longer item is a block of its own), each with a space of its own
and a pass over the documents.  The driver holds one block at a time.  Documents are never shuffled, only
their passages' terms that have a weight; what the fit keeps of them is bounded by the square of the terms.

Defined results: very long texts are searched whole (about 100 bytes of memory a byte of the longest); null or empty texts and items match nothing; items of fewer than `least_words`
words are found verbatim only; repeated rows are each reported; an empty benchmark gives no rows;
other columns of docs stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm.common import Scratch, among, table
from wordtide.llm.textvec import Units, WordTable, cached, chunks, gather, mix, windows3


@dataclass(frozen=True)
class Search:
    block: int = 16
    rank: int = 256
    extra: int = 8
    rounds: int = 2
    fit_passages: int | None = None  # a bound of the different passages in the fit, by default none
    corpus_weight: int = 120_000  # what all passages of the corpus weigh in the fit at most
    item_weight: int = 12  # what each of the benchmark's own passages weighs there
    stop: float = 0.005
    least_telling: int = 8
    outside: float = 0.5  # what a word outside the vocabulary adds to a passage's squared length, in mean terms
    cosine: float = 0.12  # of a piece whose words are half replaced, in a window that is not aligned with it
    ease: float = 0.19
    verbatim: float = 0.8
    paraphrase: float = 0.5
    answer: float = 0.6
    least_words: int = 8
    most_terms: int = 50_000
    item_block: int = 2_000
    chunk_bytes: int = 1_000_000


_DROP = re.compile(r"[\W_]+")


def normal(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else _DROP.sub("", word)


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def answer_of(text: str | None, answer: str | None = None) -> list[str]:
    """The answer's words: those given, else of the last sentence of at least three words, else none."""
    if answer:
        return words_of(answer)
    parts = [w for w in (words_of(s) for s in re.split(r"[.!?\n]+", text or "")) if len(w) >= 3]
    return parts[-1] if len(parts) > 1 else []


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = where.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Terms:
    """The words of a block of items as features 0 .. n-1."""

    def __init__(self, terms: list[str]):
        self.n = len(terms)
        self.of = {t: i for i, t in enumerate(terms)}
        self.key = xxhash.xxh64_hexdigest("\n".join(terms))

    def features(self, u: Units) -> np.ndarray:
        """Feature of each word; n for others."""
        t = _table(self)
        flat, start, _, word = t.of(u)
        return flat[start][word] if len(word) else np.zeros(0, np.int32)


def _table(terms: Terms) -> WordTable:
    get, n = terms.of.get, terms.n
    return cached(("latent", terms.key), lambda: WordTable(lambda ws: (np.array([get(normal(w.decode("utf-8", "replace")), n) for w in ws], np.int32), np.ones(len(ws), np.int32))))


def _blocks(u: Units, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each block, block of each word, text of each block)."""
    n = u.counts()
    blocks = -(-n // size)
    text = np.repeat(np.arange(len(n)), blocks)
    within = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(np.cumsum(n) - n, blocks) + within * size
    return starts, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(u.doc)))), text


def _sums(weights: np.ndarray, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Of each group the sum of weights[rows]; groups ascend and are short, so one member of each at a time."""
    x = np.zeros((groups, weights.shape[1]), np.float32)
    if len(rows):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        x[group[first]] = weights[rows[first]]
        for k in range(1, int(place.max()) + 1):
            at = np.flatnonzero(place == k)
            x[group[at]] += weights[rows[at]]
    return x


def _count(terms_of, s: Search):
    """Rows (feature, n, key, passage): counts of blocks by feature, and the features of every passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = terms_of()
        counts = np.zeros(terms.n + 1, np.int64)
        total = 0
        schema = pa.schema([("feature", pa.int32()), ("n", pa.int64()), ("key", pa.int64()), ("passage", pa.binary())])
        for b in batches:
            for c in chunks(b.column("text"), s.chunk_bytes):
                u = c.words(lower=True)
                if not len(u.hash):
                    continue
                f = terms.features(u)
                starts, block, _ = _blocks(u, s.block)
                total += len(starts)
                known = f < terms.n
                pair = np.sort(f[known] * np.int64(len(starts)) + block[known])
                pair = pair[np.diff(pair, prepend=-1) > 0]  # a term counts once in a block
                counts += np.bincount(pair // len(starts), minlength=terms.n + 1)
                # a passage is two blocks of one text, named by a hash of its words
                starts, passage, _ = _blocks(u, 2 * s.block)
                name = mix(np.add.reduceat(u.hash, starts))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(name), pa.int32()), pa.nulls(len(name), pa.int64()), pa.array(name.view(np.int64)), _binary(f[known], passage[known], len(name))], schema=schema)
        some = np.flatnonzero(counts)
        f = np.append(some, -1)
        n = np.append(counts[some], total)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(n, pa.int64()), pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.binary())], schema=schema)

    return run


def _binary(features: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The features of each row, as bytes."""
    at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))) * 4
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at.astype("<i4")), pa.py_buffer(features.astype("<i4"))])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, row of each) of passages."""
    every = column.to_pylist()
    return np.frombuffer(b"".join(every), "<i4"), np.repeat(np.arange(len(every)), [len(p) // 4 for p in every])


def _weighed(shared):
    """Passages without the features that have no weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = shared.value > 0
        for b in batches:
            f, row = _flat(b.column("passage"))
            yield pa.RecordBatch.from_arrays([b.column("key"), _binary(f[live[f]], row[live[f]], b.num_rows)], names=["key", "passage"])

    return run


RANGE = 1024  # features of a side of a tile; what is summed together


def _together(shared, most: int = 1 << 22):
    """Rows (tile, cell, n): how often two features meet in a passage, the lesser one first; tile -1: the passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        n, tiles = np.int64(len(idf)), -(-len(idf) // RANGE)
        passages, held, codes = 0, 0, []

        def counted() -> Iterator[pa.RecordBatch]:
            code, k = np.unique(np.concatenate(codes), return_counts=True)
            i, j = code // n, code % n
            tile, cell = i // RANGE * tiles + j // RANGE, i % RANGE * RANGE + j % RANGE
            for x in range(0, len(code), 250_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[x : x + 250_000], kind) for v, kind in ((tile, pa.int32()), (cell, pa.int32()), (k, pa.int64()))], names=["tile", "cell", "n"])

        for b in batches:
            passages += b.num_rows
            f, row = _flat(b.column("passage"))
            keep = idf[f] > 0
            f, row = f[keep].astype(np.int64), row[keep]
            codes.append(f * n + f)
            for d in range(1, int(np.bincount(row).max(initial=1))):
                same = row[d:] == row[:-d]
                x, y = f[d:][same], f[:-d][same]
                codes.append(np.minimum(x, y) * n + np.maximum(x, y))
                codes.append((x * n + y)[x == y])  # a word that repeats meets itself both ways
                held += len(codes[-2])
            held += len(f)
            if held >= most:
                yield from counted()
                held, codes = 0, []
        if codes:
            yield from counted()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([passages], pa.int64())], names=["tile", "cell", "n"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, cells, weights): cells of one tile in a row, of rows (tile, cell, weight) that are sorted by tile."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        tile, cell, weight = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("tile", "cell", "weight"))
        at = np.append(np.flatnonzero(np.diff(tile, prepend=-1)), len(tile))
        cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(tile[at[:-1]], pa.int32()), cut(cell, "<i4"), cut(weight, "<f4")], names=["tile", "cells", "weights"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 1 << 19:
            yield packed()
            held = []
    if any(x.num_rows for x in held):
        yield packed()


def _product(shared):
    """A'AQ of the tiles of a partition, a row for each range of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, idf = shared.value
        tiles = -(-len(idf) // RANGE)
        side = lambda k: slice(k * RANGE, (k + 1) * RANGE)
        z: dict[int, np.ndarray] = {}
        for b in batches:
            for tile, cells, weights in zip(*(b.column(k).to_pylist() for k in ("tile", "cells", "weights"))):
                i, j = divmod(tile, tiles)
                a = np.zeros(RANGE * RANGE, np.float32)
                a[np.frombuffer(cells, "<i4")] = np.frombuffer(weights, "<f4")
                a = a.reshape(RANGE, RANGE)[: len(idf[side(i)]), : len(idf[side(j)])]
                a = a * idf[side(i), None] * idf[None, side(j)]
                if i == j:
                    a = a + np.triu(a, 1).T
                else:
                    z[j] = z.get(j, 0) + a.T @ q[side(i)]
                z[i] = z.get(i, 0) + a @ q[side(j)]
        yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.int32()), pa.array([x.tobytes() for x in z.values()], pa.binary())], names=["part", "z"])

    return run


def _add(t: pa.Table) -> pa.Table:
    z = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t["z"].to_pylist())
    return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "z": pa.array([z.astype(np.float32).tobytes()], pa.binary())})


@dataclass
class Space:
    terms: Terms
    weights: np.ndarray  # (features + 1, rank), float32: idf times direction over its deviation; last row 0
    live: np.ndarray  # features with a weight
    mean: float  # mean squared length of those


def _pieces(words: list[str], s: Search) -> range:
    """Where the pieces of an item begin: two blocks each, one block apart."""
    return range(0, max(1, len(words) - s.block), s.block)


def _distinct_passages(counted: DataFrame, s: Search) -> DataFrame:
    """The passages of the fit, each once: the copies of one text take no other's place."""
    every = counted.filter("key IS NOT NULL").select("key", "passage").distinct()
    return (every if s.fit_passages is None else every.orderBy("key", "passage").limit(s.fit_passages)).select("passage")


def fit(spark: SparkSession, docs: DataFrame, terms: Terms, own: list[list[str]], scratch: Scratch, s: Search) -> Space:
    shared_terms = spark.sparkContext.broadcast(terms)
    counted = scratch.keep(docs.select("text").mapInArrow(_count(lambda: shared_terms.value, s), "feature int, n long, key long, passage binary"), "counts")
    df = np.zeros(terms.n + 1)
    total = 0
    for r in counted.filter("feature IS NOT NULL").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r.feature < 0:
            total = r.n
        else:
            df[r.feature] = r.n
    idf = np.log((total + 1.0) / (df[: terms.n] + 1.0)).astype(np.float32)
    common = df[: terms.n] > s.stop * total
    for x in own:  # of each piece the rarest terms stay, however common
        for i in _pieces(x, s):
            piece = np.unique([terms.of[w] for w in x[i : i + 2 * s.block]])
            common[piece[np.argsort(df[piece], kind="stable")[: s.least_telling]]] = False
    idf[common] = 0
    shared_idf = spark.sparkContext.broadcast(idf)
    weighed = counted.filter("key IS NOT NULL").select("key", "passage").mapInArrow(_weighed(shared_idf), "key long, passage binary")
    meet = lambda df: df.mapInArrow(_together(shared_idf), "tile int, cell int, n long").groupBy("tile", "cell").agg(F.sum("n").alias("n"))
    met = scratch.keep(meet(_distinct_passages(weighed, s)), "together")
    passages = met.filter("tile < 0").agg(F.sum("n")).first()[0] or 0
    pieces = [np.array([terms.of[w] for w in x[i : i + 2 * s.block]], "<i4").tobytes() for x in own for i in _pieces(x, s)]
    mine = meet(spark.createDataFrame([(bytearray(p),) for p in pieces], "passage binary"))
    weight = min(1.0, s.corpus_weight / max(passages, 1))
    both = met.select("tile", "cell", (F.col("n") * weight).alias("weight")).unionByName(mine.select("tile", "cell", (F.col("n") * float(s.item_weight)).alias("weight")))
    both = both.filter("tile >= 0").groupBy("tile", "cell").agg(F.sum("weight").alias("weight"))
    tiles = scratch.keep(both.repartition("tile").sortWithinPartitions("tile", "cell").mapInArrow(_packed, "tile int, cells binary, weights binary"), "tiles")
    width = min(s.rank + s.extra, terms.n)
    rng = np.random.Generator(np.random.PCG64(7))
    q = np.linalg.qr(rng.standard_normal((terms.n, width)))[0]
    for step in range(s.rounds + 1):
        shared = spark.sparkContext.broadcast((q.astype(np.float32), idf))
        got = tiles.mapInArrow(_product(shared), "part int, z binary").groupBy("part").applyInArrow(_add, "part int, z binary").toArrow()
        z = np.zeros((terms.n, width))
        for k, x in zip(got["part"].to_pylist(), got["z"].to_pylist()):
            z[k * RANGE : (k + 1) * RANGE] = np.frombuffer(x, np.float32).reshape(-1, width)
        shared.unpersist()
        if step < s.rounds:
            q = np.linalg.qr(z + 1e-9 * q)[0]
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    order = np.argsort(-values)[: s.rank]
    order = order[values[order] > 1e-6 * max(values.max(), 1e-30)]
    v = q @ vectors[:, order] / np.sqrt(values[order])
    weights = np.zeros((terms.n + 1, len(order)), np.float32)
    weights[: terms.n] = v * idf[:, None]
    live = np.append(idf > 0, False)
    scratch.drop(counted, met, tiles)
    return Space(terms, weights, live, float((weights[live] ** 2).sum(axis=1).mean()) if live.any() else 1.0)


@dataclass
class Items:
    ids: list[int]
    words: list[list[str]]
    telling: list[list[str]]  # the words with a weight, in order
    features: list[frozenset[int]]  # theirs
    answers: list[list[str]]  # telling words of the answer
    vector_of: np.ndarray  # item of each query vector
    vectors: np.ndarray  # unit rows
    least: np.ndarray  # cosine that makes a candidate, of each vector
    anchors: dict[int, int]  # hash of the first three words of items without a vector

    def __post_init__(self) -> None:
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.needs = np.array([-(-len(f) // 2) for f in self.features], np.int64)  # telling features that must be around

    def slabs(self, features: int) -> Iterator[Slab]:
        """Consecutive vectors, SLAB at a time, with their items and where the telling features of those occur."""
        for k in range(0, len(self.vectors), SLAB):
            of = self.vector_of[k : k + SLAB]
            held = [self.features[i] for i in range(of[0], of[-1] + 1)]
            feature = np.array([f for own in held for f in own], np.int64)
            item = np.repeat(np.arange(len(held)), [len(own) for own in held])
            n = np.bincount(feature, minlength=features + 1)
            start, n, holders = (v.astype(np.int32) for v in (np.cumsum(n) - n, n, item[np.argsort(feature, kind="stable")]))
            yield Slab(of, self.vectors[k : k + SLAB], self.least[k : k + SLAB], int(of[0]), len(held), start, n, holders)


SLAB = 512  # vectors of items that are compared with the windows of a chunk at a time


@dataclass
class Slab:
    vector_of: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    first: int  # its first item
    items: int
    start: np.ndarray  # of each feature, where its items begin in holders
    holds: np.ndarray  # of each feature, how many items of the slab it is telling in
    holders: np.ndarray

    def met(self, features: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
        """At item * blocks + b: how many words are telling ones of items before it, or of it before block b."""
        which = np.repeat(block, self.holds[features]) + gather(self.holders, self.start[features], self.holds[features]) * np.int64(blocks)
        return np.concatenate(([0], np.cumsum(np.bincount(which, minlength=blocks * self.items))))


def _items(rows: list, space: Space, s: Search) -> Items:
    ids, words, telling, features, answers, of, vectors, least, anchors = [], [], [], [], [], [], [], [], {}
    live = lambda ws: [w for w in ws if space.live[space.terms.of.get(w, space.terms.n)]]
    for r in rows:
        w = words_of(r["text"])
        if not w:
            continue
        f = np.array([space.terms.of[x] for x in w])
        n = len(of)
        for i in _pieces(w, s):
            piece = f[i : i + 2 * s.block]
            v = space.weights[piece].sum(axis=0)
            norm = float(np.linalg.norm(v))
            if space.live[piece].any() and norm > 0:
                of.append(len(ids))
                vectors.append(v / norm)
                foreign = s.outside * space.mean * max(0, 2 * s.block - len(piece))
                least.append(min(s.cosine, s.ease * norm / (norm * norm + foreign) ** 0.5))
        if len(of) == n:
            for c in chunks(pa.array([r["text"]])):
                anchors.update((int(h), len(ids)) for h in windows3(c.words(lower=True))[1][:1])
        ids.append(r["item_id"])
        words.append(w)
        telling.append(live(w))
        features.append(frozenset(space.terms.of[x] for x in telling[-1]))
        answers.append(live(answer_of(r["text"], r.get("answer"))))
    return Items(ids, words, telling, features, answers, np.array(of, np.int64), np.array(vectors, np.float32).reshape(len(vectors), space.weights.shape[1]), np.array(least, np.float32), anchors)


def check(item: list[str], telling: list[str], answer: list[str], region: list[str], s: Search) -> tuple[float, str | None]:
    """(share of the item's words that the region has in order, kind of leak)."""
    share = lcs(item, region) / len(item)
    if share >= (s.verbatim if len(item) >= s.least_words else 1.0):
        return share, "verbatim"
    if len(item) >= s.least_words and share >= s.paraphrase and lcs(telling, region) >= max(min(3, len(telling)), s.paraphrase * len(telling)):
        if not answer or lcs(answer, region) >= s.answer * len(answer):
            return share, "paraphrase"
    return share, None


HITS = "doc_id long, item_id long, first_word long, cosine double, share double, kind string"


def _search(shared, s: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items = shared.value
        weights = space.weights
        slabs = list(items.slabs(space.terms.n))
        for b in batches:
            doc_ids = b.column("doc_id")
            out: list[tuple] = []
            for c in chunks(b.column("text"), s.chunk_bytes):
                u = c.words(lower=True)
                if not len(u.hash):
                    continue
                f = space.terms.features(u)
                starts, block, text = _blocks(u, s.block)
                known = np.flatnonzero(space.live[f])
                fk = f[known]
                x = _sums(weights, fk, block[known], len(starts))
                outside = np.bincount(block, weights=f == space.terms.n, minlength=len(starts))
                follows = np.zeros(len(starts), bool)
                follows[:-1] = text[:-1] == text[1:]
                x[:-1] += x[1:] * follows[:-1, None]
                outside[:-1] += outside[1:] * follows[:-1]
                own = np.einsum("ij,ij->i", x, x)
                length = np.sqrt(own + s.outside * space.mean * outside + 1e-12)
                may = np.flatnonzero(np.sqrt(own) >= items.least.min(initial=1.0) * length)
                x = x[may] / length[may, None].astype(np.float32)
                counts = u.counts()
                end = np.cumsum(counts)
                best: dict[tuple[int, int], tuple] = {}

                def look(item: np.ndarray, word: np.ndarray, cos: np.ndarray, slab: Slab | None = None) -> None:
                    t, pad = u.doc[word], np.maximum(s.block, items.lengths[item])
                    lo, hi = np.maximum(end[t] - counts[t], word - pad), np.minimum(end[t], word + 2 * s.block + pad)
                    if slab is not None and len(item):
                        # the blocks around hold no fewer telling words, repeats among them, than the region has different ones
                        met, own = slab.met(fk, block[known], len(starts)), (item - slab.first) * len(starts)
                        left = np.flatnonzero(met[own + block[hi - 1] + 1] - met[own + block[lo]] >= items.needs[item])
                        # a window that several pieces of an item meet is looked at once
                        left = left[np.sort(np.unique(own[left] + block[word[left]], return_index=True)[1])]
                        item, word, cos, t, lo, hi = (v[left] for v in (item, word, cos, t, lo, hi))
                    a, b = np.searchsorted(known, lo), np.searchsorted(known, hi)
                    telling = fk.tolist() if len(item) else []
                    for i, (k, x, y) in enumerate(zip(item.tolist(), a.tolist(), b.tolist())):
                        own = items.features[k]
                        if 2 * len(own.intersection(telling[x:y])) >= len(own):
                            compare(k, int(word[i]), int(t[i]), int(lo[i]), int(hi[i]), float(cos[i]))

                def compare(item: int, word: int, t: int, lo: int, hi: int, cos: float) -> None:
                    region = [r for r in (normal(y.decode("utf-8", "replace")) for y in u.bytes_at(np.arange(lo, hi))) if r]
                    share, kind = check(items.words[item], items.telling[item], items.answers[item], region, s)
                    if kind and ((t, item) not in best or share > best[t, item][3]):
                        best[t, item] = (items.ids[item], word - int(end[t] - counts[t]), cos, share, kind)

                for slab in slabs:
                    cos = x @ slab.vectors.T
                    w, q = np.divmod(np.flatnonzero(cos >= slab.least), len(slab.vectors))
                    look(slab.vector_of[q], starts[may[w]], cos[w, q], slab)
                if items.anchors:
                    at, h = windows3(u)
                    i = np.flatnonzero(np.isin(h, np.array(list(items.anchors), np.uint64)))
                    look(np.array([items.anchors[int(x)] for x in h[i]], np.int64), at[i], np.zeros(len(i)))
                out += [(doc_ids[c.first + t].as_py(), *v) for (t, _), v in best.items()]
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, types)], names=[f.split()[0] for f in HITS.split(", ")])

    return run


def _blocks_of(rows: Iterator[dict], s: Search) -> Iterator[tuple[list[dict], set[str]]]:
    """Consecutive items with their words, so many at a time as the bounds allow."""
    block: list[dict] = []
    words: set[str] = set()
    for r in rows:
        own = set(words_of(r["text"]))
        if block and (len(block) >= s.item_block or len(words | own) > s.most_terms):
            yield block, words
            block, words = [], set()
        if own:
            block.append(r)
            words |= own
    if block:
        yield block, words


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, scratch: Scratch, s: Search = Search()) -> DataFrame:
    """HITS: every document of docs (doc_id, text) that holds an item of benchmark (item_id, text, answer?)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cols = ["item_id", "text"] + (["answer"] if "answer" in benchmark.columns else [])
    found = None
    for rows, words in _blocks_of((r.asDict() for r in benchmark.select(*cols).filter("text IS NOT NULL").orderBy(*cols).toLocalIterator()), s):
        space = fit(spark, docs, Terms(sorted(words)), [words_of(r["text"]) for r in rows], scratch, s)
        part = docs.mapInArrow(_search(spark.sparkContext.broadcast((space, _items(rows, space, s))), s), HITS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], HITS)


def keep_unleaked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, s: Search = Search()) -> DataFrame:
    """The rows of docs that hold no benchmark item, with the columns of docs."""
    scratch = Scratch(spark, "leaks")
    gone = scratch.keep(leaks(spark, docs, benchmark, scratch, s).filter("doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    return among(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))
