"""Toxic passages by maximum-scoring segments of token log-odds.

1. *Weights.* Over all labelled rows that may teach, the uses of a
   word, or a word beginning, and the documents that hold it are counted, toxic and other ones.
   Log-odds ratios are taken under an informative Dirichlet prior (that of a token is `prior_share` of
   its overall count).  The z-score of the ratio of documents, which one text that repeats a word
   does not move, says what is significant; a word weighs the ratio of uses, positive or negative,
   of its most specific significant feature, less `gap`, and any other word `-gap`, so common words
   that slightly lean one way never add up to a passage.
2. *Segments.* The Ruzzo-Tompa scan finds all maximal-scoring segments of a document in linear time.
3. *Calibration*, on a fold of these rows that the weights did not see.  By Karlin-Altschul theory the
   segments of a clean text of n words that score S or more are Poisson with the mean E = K * n *
   exp(-lam * S): lam is the root of sum(p * exp(lam * s)) = 1 over clean words, K the least at which
   no score is commoner among clean texts than that.  A passage is significant if its E is below 1.  A document's
   evidence is the greatest surprise r * ln(r / E) - r + E of its r best segments at the E of the
   r-th, a word of one text counting once; a logistic curve fitted on the same fold turns it into a score.

Whole texts are scored in one pass without a shuffle.  Defined results: null and empty texts have
no evidence and get the score of that; without labelled rows of both kinds every score is 0;
labels of one document that disagree count as toxic; null labels are none; repeated rows score
alike; very long texts are scored whole (about 60 bytes of memory a byte of the longest); other
columns stay, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.llm.common import Scratch, among, clear_name, table
from wordtide.llm.textvec import WordTable, cached, chunks, gather

_LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


@dataclass(frozen=True)
class Training:
    held_out_of: int = 5  # rows whose crc32(doc_id as text) is 0 modulo this teach nothing
    fold_of: int = 4  # of the others one in so many calibrates, the rest teach weights
    prior_share: float = 0.05  # weight of the prior: so much of a token's count is added to both sides
    least_z: float = 3.0
    least_documents: int = 5  # what is in fewer cannot be significant; its beginnings speak for it
    gap: float = 0.4  # nats; a passage bridges weight / gap words that say nothing


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    gap: float = 0.4
    slope: float = 0.0
    offset: float = -50.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def held_out(doc_id: Column, of: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of == 0


def features(word: str) -> list[str]:
    """Features of a lower-case word, most specific first: the word with an end mark, its beginnings."""
    return [word + "$"] + [word[:n] for n in reversed(BEGINNINGS) if len(word) > n]


def word_weight(word: bytes, weights: dict[str, float], gap: float) -> float:
    """Of a run of non-space bytes: the greatest weight of the letter runs in it, or the least if none is positive."""
    found = []
    for part in _LETTERS.findall(word.decode("utf-8", "replace").lower()):
        found.append(next((w for f in features(part) if (w := weights.get(f)) is not None), -gap))
    best = max(found, default=-gap)
    return best if best > 0 else min(found, default=-gap)


def segments(positions: list[int], weights: list[float], gap: float, sums: list[float] | None = None) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score): Ruzzo and Tompa, linear time.

    positions and weights are of the words of positive weight; each other word weighs -gap, or what
    sums (of all words before each position) say.
    """
    segs: list[list] = []  # start, end, sum before, sum after, index of the last segment with a smaller sum before
    total, last = 0.0, -1
    for i, (p, w) in enumerate(zip(positions, weights)):
        total = total - gap * (p - last - 1) if sums is None else sums[i]
        last = p
        seg = [p, p, total, total + w, -1]
        total += w
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][2] >= seg[2]:
                j = segs[j][4]
            seg[4] = j
            if j < 0 or segs[j][3] >= seg[3]:
                segs.append(seg)
                break
            seg[0], seg[2] = segs[j][0], segs[j][2]
            del segs[j:]
    return [(s, e, after - before) for s, e, before, after, _ in segs]


def expected(score: float, n: int, m: Model) -> float:
    """E: segments of at least this score that a clean text of n words has."""
    return m.k * n * math.exp(-min(m.lam * score, 700.0))


def evidence(scores: list[float], n: int, m: Model) -> float:
    """The greatest surprise in nats of a text's r best segments, of all r."""
    best = 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        e = max(expected(s, n, m), 1e-300)
        if r > e:
            best = max(best, r * math.log(r / e) - r + e)
    return best


def _word_table(model: Model) -> WordTable:
    weigh = lambda ws: (np.array([word_weight(w, model.weights, model.gap) for w in ws], np.float64), np.ones(len(ws), np.int32))
    return cached(("toxicity", model.key), lambda: WordTable(weigh))


def _weighed(text: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(weight of each word, the same with -gap for a word that its text had before, first word of each text and the end)."""
    known = _word_table(model)
    for c in chunks(text):
        u = c.words()
        flat, start, _, word = known.of(u)
        w = flat[start][word] if len(word) else np.zeros(0)
        hits = np.flatnonzero(w > 0)
        new = np.zeros(len(hits), bool)
        new[np.unique(u.doc[hits] * np.int64(len(start) + 1) + word[hits], return_index=True)[1]] = True
        once = w.copy()
        once[hits[~new]] = -model.gap
        yield w, once, np.concatenate(([0], np.cumsum(u.counts())))


def _scan(w: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    at = np.flatnonzero(w > 0)
    return segments(at.tolist(), w[at].tolist(), gap, (np.cumsum(w)[at] - w[at]).tolist()) if len(at) else []


def _found(text: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]], list[float]]]:
    """(number of words, segments, scores of the segments if a word counts once) of each text.

    One word over and over is one sign, not many: repetition proves nothing, though each use is shown.
    """
    for w, once, first in _weighed(text, model):
        has = np.add.reduceat(np.append(w > 0, False), first[:-1]) > 0 if len(first) > 1 else []
        for a, b, some in zip(first[:-1].tolist(), first[1:].tolist(), has):
            if not some or a == b:
                yield b - a, [], []
            else:
                found = _scan(w[a:b], model.gap)
                same = np.array_equal(w[a:b], once[a:b])
                yield b - a, found, [s for *_, s in (found if same else _scan(once[a:b], model.gap))]


def _sample(docs: DataFrame, labels: DataFrame, t: Training) -> DataFrame:
    """(text, toxic, fold) of every labelled row that may teach; labels are broadcast only if they are few."""
    taught = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), t.held_out_of))
        .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    )
    fold = (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(t.fold_of)) == 0).cast("int")
    return among(docs.select("doc_id", "text"), taught, "doc_id", "inner").select("text", "toxic", fold.alias("fold"))


COUNTS = "feature string, do long, dt long, uo long, ut long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS: other and toxic documents that hold a feature, its uses in them, added up within the partition while it fits."""
    ids: dict[str, int] = {}  # '' is the feature of every document and word

    def register(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [], []
        for w in words:
            own = {f for part in _LETTERS.findall(w.decode("utf-8", "replace").lower()) for f in features(part)}
            flat += [ids.setdefault(f, len(ids)) for f in own]
            lens.append(len(own))
        return np.array(flat, np.int64), np.array(lens, np.int32)

    def out() -> pa.RecordBatch:
        n = counts[: len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), *(pa.array(n[:, k]) for k in range(4))], names=["feature", "do", "dt", "uo", "ut"])

    def empty() -> tuple[WordTable, np.ndarray]:
        ids.clear()
        ids[""] = 0
        return WordTable(register, 400_000), np.zeros((1024, 4), np.int64)

    known, counts = empty()
    for batch in batches:
        toxic = (batch.column("toxic").to_numpy(zero_copy_only=False) != 0).astype(np.int64)
        for c in chunks(batch.column("text")):
            u = c.words()
            flat, start, length, word = known.of(u)
            pair, uses = np.unique(u.doc * np.int64(len(start) + 1) + word, return_counts=True)  # each word of a text once
            doc, word = np.divmod(pair, len(start) + 1)
            doc, feature, uses = np.repeat(doc, length[word]), gather(flat, start[word], length[word]), np.repeat(uses, length[word])
            once = np.unique(doc << 32 | feature)
            if len(ids) > len(counts):
                counts = np.concatenate((counts, np.zeros((2 * len(ids) - len(counts), 4), np.int64)))
            y = toxic[c.first : c.first + c.texts]
            counts[:, :2] += np.bincount((once & 0xFFFFFFFF) * 2 + y[once >> 32], minlength=2 * len(counts)).reshape(-1, 2)
            counts[:, 2:] += np.bincount(feature * 2 + y[doc], weights=uses, minlength=2 * len(counts)).reshape(-1, 2).astype(np.int64)
            counts[0] += [(y == 0).sum(), y.sum(), (y[u.doc] == 0).sum(), y[u.doc].sum()]
            if len(ids) > 1_000_000:
                yield out()
                known, counts = empty()
    yield out()


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Model:
    scratch = Scratch(spark, "toxicity")
    sample = scratch.keep(_sample(docs, labels, t), "sample")
    counted = sample.filter("fold = 0").select("text", "toxic").mapInArrow(_count, COUNTS).groupBy("feature").agg(*(F.sum(k).alias(k) for k in ("do", "dt", "uo", "ut")))
    counted = scratch.keep(counted.filter(F.col("dt") + F.col("do") >= t.least_documents), "counts")
    total = counted.filter("feature = ''").first()
    model = Model(gap=t.gap)
    if total is not None and total.dt and total.do:

        def ratio(y: str, o: str) -> tuple[Column, Column]:
            """The log-odds ratio of toxic and other counts, and its variance."""
            prior, rest = (F.col(y) + F.col(o)) * t.prior_share, (total[y] + total[o]) * t.prior_share
            odds = lambda n: F.log((F.col(n) + prior) / F.greatest(total[n] + rest - F.col(n) - prior, F.lit(0.5)))
            return odds(y) - odds(o), 1 / (F.col(y) + prior) + 1 / (F.col(o) + prior)

        (uses, _), (documents, variance) = ratio("ut", "uo"), ratio("dt", "do")
        told = counted.filter("feature <> ''").select("feature", uses.alias("delta"), (documents / F.sqrt(variance)).alias("z"))
        # their number is that of the words and beginnings that tell, not of the labelled rows
        model.weights = {r.feature: r.delta - t.gap for r in told.filter(F.abs("z") >= t.least_z).select("feature", "delta").toLocalIterator()}
        shorter = [f for f, w in model.weights.items() if w > 0 and not f.endswith("$")]
        if shorter:  # what is known and no sign of toxicity still stops the search for a beginning that is one
            begins = F.array(*(F.substring("feature", 1, n) for n in BEGINNINGS))
            stops = told.filter((F.abs("z") < t.least_z) & (F.col("delta") <= 0)).select("feature", F.explode(F.array_distinct(begins)).alias("begin"))
            stops = stops.filter("begin <> feature").join(F.broadcast(spark.createDataFrame([(f,) for f in shorter], "begin string")), "begin", "left_semi")
            model.weights |= {r.feature: -t.gap for r in stops.select("feature").distinct().toLocalIterator()}
    model.lam, model.k, model.slope, model.offset = _calibrate(spark, sample, model)
    scratch.drop(sample, counted)
    return model


def root(weights: np.ndarray, counts: np.ndarray) -> float:
    """lam > 0 with sum(p * exp(lam * s)) = 1 of scores whose mean is negative; an unseen greatest score counts once."""
    p = counts / counts.sum()
    low, high = 0.0, 1.0
    over = lambda lam: np.log(p) + lam * weights
    total = lambda lam: float((m := over(lam).max()) + np.log(np.exp(over(lam) - m).sum()))
    while total(high) < 0 and high < 1e6:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if total(mid) > 0 else (mid, high)
    return high


def _calibrate(spark: SparkSession, sample: DataFrame, model: Model) -> tuple[float, float, float, float]:
    """(lam, K, slope, offset): the law of clean segments, and the logistic curve of the label over log(1 + evidence).

    Of the fold that weights did not see; of all rows that may teach where that fold lacks one kind of label.
    """
    kinds = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    if not all(any(kinds.get((f, y)) for f in (0, 1)) for y in (0, 1)) or not any(w > 0 for w in model.weights.values()):
        return model.lam, model.k, 0.0, -50.0
    if kinds.get((1, 0)) and kinds.get((1, 1)):
        sample = sample.filter("fold = 1")
    sample = sample.select("text", "toxic")
    shared = spark.sparkContext.broadcast(model)
    top = max(model.weights.values())
    most = math.floor(100 * top) + 1  # scores above top are only counted, so what comes back is bounded

    def law(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, score in hundredths, n): of clean texts how many words (0) and segments (1) score so."""
        m, counts = shared.value, {}
        for b in batches:
            clean = b.column("text").filter(pa.array(b.column("toxic").to_numpy(zero_copy_only=False) == 0))
            for _, once, _ in _weighed(clean, m):
                for s, n in zip(*(x.tolist() for x in np.unique(np.round(100 * once).astype(np.int64), return_counts=True))):
                    counts[0, s] = counts.get((0, s), 0) + n
            for _, _, found in _found(clean, m):
                for s in found:
                    key = (1, min(round(100 * s), most))
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["kind", "score", "n"])

    got = sample.mapInArrow(law, "kind int, score long, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).collect()
    words = {r.score / 100: r.n for r in got if r.kind == 0}
    found = {r.score / 100: r.n for r in got if r.kind == 1}
    words[top] = words.get(top, 0) + 1
    words[-model.gap] = words.get(-model.gap, 0) + 1
    n_words = sum(words.values())
    lam = root(np.array(list(words)), np.array(list(words.values()), float))
    # the least K at which no score that one word reaches is commoner among clean texts than the law says; beyond
    # lie texts that repeat one line over and over, whose words are not drawn apart
    above, k = sum(n for s, n in found.items() if s > top), 0.0
    for score in sorted({s for s in found if s <= top} | {top}, reverse=True):
        above += found.get(score, 0)
        k = max(k, (above + 1) / n_words * math.exp(min(lam * score, 600.0)))
    shared.unpersist()
    law_model = spark.sparkContext.broadcast(Model(model.weights, lam, k, model.gap, key=model.key))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = law_model.value, {}
        for b in batches:
            for (n, _, found), y in zip(_found(b.column("text"), m), b.column("toxic").to_pylist()):
                key = (round(8 * math.log1p(evidence(found, n, m))), int(y))
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["step", "y", "n"])

    rows = sample.mapInArrow(steps, "step int, y int, n long").groupBy("step", "y").agg(F.sum("n").alias("n")).collect()
    x, y, n = (np.array([float(r[k]) for r in rows]) for k in range(3))
    x = x / 8
    w = np.zeros(2)
    for _ in range(100):  # Newton steps of a slightly damped logistic regression
        X = np.stack([x, np.ones_like(x)], 1)
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (n * (p - y)) + np.array([0.1, 0.01]) * w
        h = (X * (n * p * (1 - p))[:, None]).T @ X + np.diag([0.1, 0.01])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return lam, k, float(w[0]), float(w[1])


TYPE = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.DoubleType()),
    T.StructField("passages", T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))),
])
_PASSAGES = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))


def _score(text: pa.Array, m: Model) -> pa.Array:
    score, proof, passages = [], [], []
    for n, found, once in _found(text, m):
        e = evidence(once, n, m)
        proof.append(e)
        score.append(1 / (1 + math.exp(-min(max(m.slope * math.log1p(e) + m.offset, -50.0), 50.0))))
        passages.append([{"first_word": s, "last_word": t, "score": x, "e_value": e} for s, t, x in found if (e := expected(x, n, m)) < 1])
    arrays = [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(proof, pa.float64()), pa.array(passages, _PASSAGES)]
    return pa.StructArray.from_arrays(arrays, names=[f.name for f in TYPE.fields])


def scores(spark: SparkSession, text: Column, model: Model) -> Column:
    """A struct (score, predicted, evidence, passages) for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(TYPE)
    def toxicity(text: pa.Array) -> pa.Array:
        return _score(text, shared.value)

    return toxicity.asNondeterministic()(text)


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns of docs."""
    name = clear_name(docs, "toxicity")
    scored = docs.withColumn(name, scores(spark, F.col("text"), train(spark, docs, labels, t)))
    return scored.filter(F.col(f"{name}.predicted") == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(spark, docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(spark, F.col("text"), model).alias("toxicity"))
    return out.select("doc_id", "held_out", "toxicity.score", "toxicity.predicted", "toxicity.evidence", "toxicity.passages")
