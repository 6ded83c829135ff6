import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from wordtide.llm import common, fertility, toxicity
from wordtide.llm.toxicity import segments


def base(text):
    text = text or ""
    words = [w for w in text.encode().split()]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(wins)
    covered = {j for i, w in enumerate(wins) if often[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(spark, documents, odd):
    rnd = random.Random(4)
    made = [(i, "".join(rnd.choice(["a ", "b ", "a b a ", "\n", "#", "é ", " \n"]) for _ in range(rnd.randrange(60))), "en") for i in range(200)]
    docs = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(made, "doc_id long, text string, lang string")).union(odd.select("doc_id", "text", "lang"))
    for r in fertility.quality_rules(docs).collect():
        f = r.fertility
        n = base(r.text)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == n
        assert f.base_failed == (n[0] < 50 or 100 * f.n_repeat_words > 50 * n[0])
        assert f.kept == (f.reason is None) and (not f.base_failed or not f.kept)


def test_tokens_are_those_of_the_library(spark, documents):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    for r in fertility.quality_rules(documents.limit(40)).collect():
        assert r.fertility.n_tokens == sum(len(m.encode(w.decode())) for w in r.text.encode().split())


def test_keeps_prose_rejects_junk(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = fertility.quality_rules(documents).join(labels, "doc_id").filter("NOT fertility.base_failed").groupBy("quality").agg(F.avg(F.col("fertility.kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] >= 0.98 and kept.get(0, 0) <= 0.2


def test_odd_rows(odd, none):
    out = fertility.keep_good(odd.withColumn("fertility", F.lit("mine")))
    assert out.columns[-1] == "fertility" and {r.doc_id for r in out.collect()} <= {4, 5}
    assert fertility.keep_good(none).count() == 0 and fertility.quality_rules(none.drop("lang")).count() == 0


def brute_segments(score):
    """All maximal-scoring segments by their definition: recursively the best one, then left and right of it."""
    if not score:
        return []
    best, where = 0.0, None
    for i in range(len(score)):
        s = 0.0
        for j in range(i, len(score)):
            s += score[j]
            if s > best + 1e-9:
                best, where = s, (i, j)
    if where is None:
        return []
    i, j = where
    return brute_segments(score[:i]) + [(i, j, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(score[j + 1 :])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_all_maximal_ones(seed):
    rnd = random.Random(seed)
    score = [rnd.choice([2.0, 1.0, 0.7, -0.4, -0.4, -0.4, -0.4]) + rnd.random() / 1000 if rnd.random() < 0.4 else -0.4 for _ in range(40)]
    at = [i for i, s in enumerate(score) if s > 0]
    plain = [s if s > 0 else -0.4 for s in score]
    got = segments(at, [plain[i] for i in at], 0.4)
    want = brute_segments(plain)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.query(spark, sf).join(labels, "doc_id").filter("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert right[0] >= 0.98 and right[1] >= 0.9
    found = out.filter("toxic = 1 AND predicted = 1").limit(5).collect()
    assert all(p.first_word <= p.last_word < 200_000 and p.e_value < 1 for r in found for p in r.passages)


def test_toxic_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (7, None, None), (7, 1, 1), (7, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.train(spark, odd, labels)
    assert toxicity.keep_clean(spark, odd.withColumn("toxicity", F.lit(1)), labels).count() == odd.count() and m.slope >= 0
    assert toxicity.keep_clean(spark, odd, labels.limit(0)).count() == odd.count()
    assert toxicity.keep_clean(spark, none, labels).count() == 0
    s = odd.select("doc_id", toxicity.scores(spark, F.col("text"), toxicity.Model({"idiot$": 5.0}, slope=3.0, offset=-4.0)).alias("t"))
    assert all(0 <= r.t.score <= 1 and r.t.predicted == int(r.t.score >= 0.5) for r in s.collect())


def test_weights_need_held_out_rows_out(spark, documents):
    """No label of a held-out row is used: turning them round changes no score."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = toxicity.train(spark, docs, labels), toxicity.train(spark, docs, turned)
    assert a.weights == b.weights and abs(a.slope - b.slope) < 1e-6 and abs(a.offset - b.offset) < 1e-6


def planted(n=900, seed=6):
    """Documents of which every eighth holds insults; labels of all."""
    rnd = random.Random(seed)
    words = ["the", "of", "and"] * 60 + ["w" + "".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    docs = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randint(20, 90))]
        at = rnd.randrange(len(body)) if i % 8 == 0 else None
        if at is not None:
            body[at:at] = [rnd.choice(["grumpf", "zounk", "blarghed", "snivvel", "the", "of"]) for _ in range(4)] + ["zounk,", "Grumpf!"]
        docs.append((i, " ".join(body), at))
    return docs


def test_weights_and_scores_by_brute_force(spark):
    """Every weight, and of every text its segments, E values, evidence and score, from plain counts."""
    docs = planted()
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(at is not None)) for i, _, at in docs], "doc_id long, quality int, toxic int")
    t, m = toxicity.Training(), toxicity.train(spark, df, labels)
    fold = {r.doc_id: r.f for r in df.select("doc_id", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(t.fold_of)) == 0).cast("int").alias("f")).collect()}
    uses, holds, total = {}, {}, [[0, 0], [0, 0]]
    for i, text, at in docs:
        if zlib.crc32(str(i).encode()) % 5 == 0 or fold[i]:
            continue
        y, mine = int(at is not None), set()
        total[0][y] += len(text.split())
        total[1][y] += 1
        for w in text.split():
            own = {f for part in re.findall(r"[^\W\d_]+", w.lower()) for f in toxicity.features(part)}
            mine |= own
            for f in own:
                uses.setdefault(f, [0, 0])[y] += 1
        for f in mine:
            holds.setdefault(f, [0, 0])[y] += 1

    def ratio(n, all_):
        prior, rest = t.prior_share * sum(n), t.prior_share * sum(all_)
        side = lambda y: math.log((n[y] + prior) / max(all_[y] + rest - n[y] - prior, 0.5))
        return side(1) - side(0), 1 / (n[1] + prior) + 1 / (n[0] + prior)

    told = {f: (ratio(uses[f], total[0])[0], ratio(n, total[1])[0] / ratio(n, total[1])[1] ** 0.5) for f, n in holds.items() if sum(n) >= t.least_documents}
    want = {f: d - t.gap for f, (d, z) in told.items() if abs(z) >= t.least_z}
    good = {f for f, w in want.items() if w > 0}
    want |= {f: -t.gap for f, (d, z) in told.items() if abs(z) < t.least_z and d <= 0 and any(f[:n] in good and f[:n] != f for n in toxicity.BEGINNINGS)}
    assert set(m.weights) == set(want) and all(abs(m.weights[f] - w) < 1e-9 for f, w in want.items()) and {"zounk$", "grumpf$"} <= good
    lengths = []
    for r in df.select("doc_id", "text", toxicity.scores(spark, F.col("text"), m).alias("t")).collect():
        weights = [toxicity.word_weight(w.encode(), want, t.gap) for w in r.text.split()]
        seen, once = set(), []
        for w, x in zip(r.text.split(), weights):
            once.append(-t.gap if x > 0 and w in seen else x)
            seen.add(w)
        found = sorted(brute_segments(weights))
        passages = [(a, b, s, m.k * len(weights) * math.exp(-m.lam * s)) for a, b, s in found]
        assert [(p.first_word, p.last_word) for p in r.t.passages] == [(a, b) for a, b, _, e in passages if e < 1]
        assert all(abs(p.score - x[2]) < 1e-6 and abs(p.e_value / x[3] - 1) < 1e-6 for p, x in zip(r.t.passages, [x for x in passages if x[3] < 1]))
        best = 0.0
        for k, s in enumerate(sorted((s for *_, s in brute_segments(once)), reverse=True), 1):
            e = m.k * len(weights) * math.exp(-m.lam * s)
            best = max(best, k * math.log(k / e) - k + e if k > e else 0.0)
        assert abs(r.t.evidence - best) < 1e-6 and abs(r.t.score - 1 / (1 + math.exp(-(m.slope * math.log1p(best) + m.offset)))) < 1e-9
        at = docs[r.doc_id][2]
        assert r.t.predicted == int(at is not None)
        if at is not None:
            lengths += [p.last_word - p.first_word + 1 for p in r.t.passages]
            assert any(p.first_word < at + 6 and p.last_word >= at for p in r.t.passages)
    assert sorted(lengths)[len(lengths) // 2] < 20


def test_every_labelled_row_teaches(spark):
    """The stage of the pipeline learns from all of 160,000 labelled rows: what only those after the first 100,000 by hash say is known."""
    order = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    teach = spark.range(160_000).withColumnRenamed("id", "doc_id").filter(~toxicity.held_out(F.col("doc_id")))
    late = teach.withColumn("n", order).filter("n > 100000 AND n % 40 = 0").select("doc_id", F.lit(1).alias("toxic"))
    labels = spark.range(160_000).withColumnRenamed("id", "doc_id").join(F.broadcast(late), "doc_id", "left").fillna(0).localCheckpoint()
    docs = labels.select("doc_id", F.when(F.col("toxic") == 1, "so you zounk and grumpf").otherwise("so you say and go").alias("text"))
    n = late.count()
    assert toxicity._sample(docs, labels, toxicity.Training()).count() == teach.count() > 120_000 and n > 500
    m = toxicity.train(spark, docs, labels)
    assert m.weights["zounk$"] > 0 and m.weights["grumpf$"] > 0
    assert toxicity.keep_clean(spark, docs, labels).count() == 160_000 - n


def test_many_labels_are_shuffled_alike(spark, monkeypatch):
    docs = planted(400)
    df = spark.createDataFrame([d[:2] for d in docs] + [(None, "a null id"), (3, docs[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(at is not None)) for i, _, at in docs] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    few = toxicity.train(spark, df, labels)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = toxicity.train(spark, df, labels)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few.weights == many.weights and any(w > 0 for w in few.weights.values())
    assert all(abs(getattr(few, k) - getattr(many, k)) < 1e-9 for k in ("lam", "k", "slope", "offset"))


def test_lambda_is_the_root():
    import numpy as np

    for weights, counts in (([2.0, -0.4], [30.0, 970.0]), ([5.0, 1.0, -0.4, -2.0], [1.0, 20.0, 9000.0, 300.0])):
        lam = toxicity.root(np.array(weights), np.array(counts))
        assert lam > 0 and abs(sum(c / sum(counts) * math.exp(lam * w) for w, c in zip(weights, counts)) - 1) < 1e-6


def test_repetition_is_one_sign():
    m = toxicity.Model({"zounk$": 3.0, "grumpf$": 3.0})
    import pyarrow as pa

    one, often, two = toxicity._score(pa.array(["zounk a b", "zounk zounk zounk", "zounk grumpf b"]), m).to_pylist()
    assert one["evidence"] == often["evidence"] < two["evidence"] and often["passages"][0]["last_word"] == 2
