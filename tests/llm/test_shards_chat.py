import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordtide.llm import chat, shards
from wordtide.llm.common import Scratch


@pytest.mark.parametrize("plan", [shards.Plan(), shards.Plan(bucket_bytes=20_000), shards.Plan(bucket_bytes=20_000, most_bytes=10_000)])
def test_shards(spark, documents, plan):
    written, names = shards.write(documents, Scratch(spark, "t"), plan)
    out = shards.slots(written, names)
    assert rows(out, *documents.columns) == rows(documents)  # nothing is lost or changed
    by = {}
    for r in out.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    again = shards.slots(*shards.write(documents.repartition(7), Scratch(spark, "t"), plan))
    assert rows(again, "doc_id", "shard", "slot") == rows(out, "doc_id", "shard", "slot")
    order = [r.doc_id for r in out.filter("shard = 3").orderBy("slot").collect()]
    assert order != sorted(order)


def test_law_key(spark, sf):
    got = shards.query(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got.collect():
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
    ids = spark.range(20_000)
    n = ids.groupBy(shards.shard_of(F.col("id"), 16, 1).alias("s")).count().collect()
    assert len(n) == 16 and all(1000 < r["count"] < 1500 for r in n)
    moved = ids.filter(shards.shard_of(F.col("id"), 17, 1) != shards.shard_of(F.col("id"), 16, 1)).count()
    assert 20_000 / 17 * 0.8 < moved < 20_000 / 17 * 1.2


def test_slots_by_hand(spark, documents):
    """Shard, bucket and slot of every record from Spark's hashes, numpy's shuffle and plain lists."""
    import numpy as np

    plan = shards.Plan(bucket_bytes=30_000)
    hashed = documents.select("doc_id", F.xxhash64(*documents.columns).alias("order"), F.octet_length("text").alias("n"), F.array(*(F.xxhash64("doc_id", F.lit(plan.seed), F.lit(k)) for k in range(16))).alias("h"))
    hashed = hashed.withColumn("again", F.xxhash64("order", F.lit(plan.seed + 1))).collect()
    shard = {r.doc_id: max(range(16), key=lambda k: (r.h[k], k)) for r in hashed}
    size = [sum(r.n + 1 for r in hashed if shard[r.doc_id] == k) for k in range(16)]
    buckets = [max(1, -(-x // plan.bucket_bytes)) for x in size]
    want, base = {}, 0
    for k in range(16):
        slot = 0
        for j in range(buckets[k]):
            own = sorted((r.order, r.doc_id) for r in hashed if shard[r.doc_id] == k and r.again % buckets[k] == j)
            for i in np.random.Generator(np.random.PCG64([plan.seed, base + j, 0])).permutation(len(own)):
                want[own[i][1]] = (k, slot)
                slot += 1
        base += buckets[k]
    got = shards.slots(*shards.write(documents, Scratch(spark, "t"), plan)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_a_hot_key_has_more_buckets(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.col("id").cast("string"), 5).alias("text"))
    written, names = shards.write(df, Scratch(spark, "t"), shards.Plan(bucket_bytes=2000))
    largest = written.groupBy("bucket").agg(F.sum(shards.size_of(F.col("text"))).alias("n")).agg(F.max("n")).first()[0]
    assert largest < 6000 and rows(written, "doc_id", "text") == rows(df)


def test_shards_odd_rows(spark, odd, none):
    clash = odd.withColumns({"shard": F.lit("x"), "Pos": F.lit("y"), "bucket": F.lit(None).cast("string"), "order": F.lit(1), "n": F.lit(2), "slot": F.lit(3)})
    written, names = shards.write(clash, Scratch(spark, "t"))
    out = shards.slots(written, names)
    assert rows(out, *clash.columns) == rows(clash) and names["shard"] == "_shard" and "_slot" in out.columns
    assert shards.slots(*shards.write(none, Scratch(spark, "t"))).count() == 0


def test_chat_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    q = c.execute(chat.ORACLE)
    names = [d[0] for d in q.description]
    assert Counter(map(tuple, chat.query(spark, sf).select(*names).collect())) == Counter(q.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_chat_round_trip(spark, seed):
    rnd = random.Random(seed)
    bits = ["\\", "###", "#", "</turn>", "<", "\n", " ", "### Assistant: ", "\\###", "\\\\", "a", "é😀", "]", "[x]: ", "</turn>\n"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(9)))
    t = chat.Template()
    for _ in range(500):
        x = text()
        assert t.unescape(t.escape(x)) == x and t.role_of(t.opening(x)) == x
    made = [(c, n, rnd.choice(["user", "assistant", "system", "tool", text()]), text()) for c in range(40) for n in range(rnd.randint(1, 7))]
    got = {r.conv_id: r for r in chat.parsed(chat.formatted(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {m[0] for m in made}:
        turns = sorted((m for m in made if m[0] == c), key=lambda m: m[1])
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        roles = "".join({"system": "s", "user": "u", "assistant": "a"}.get(m[2], "x") for m in turns)
        import re

        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].valid == bool(re.fullmatch("s?(ua)+", roles))


def test_chat_odd_rows(spark):
    made = [(None, 0, None, None, "x"), (1, None, "user", None, "x"), (1, 1, "assistant", "", "x"), (1, 1, "assistant", "", "x"), (2, 0, "user", "q " * 300_000, None), (2, 1, "assistant", "a", None)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, position string")
    got = {r.conv_id: r for r in chat.parsed(chat.formatted(df)).collect()}
    assert (got[None].n_turns, got[None].valid, got[1].n_turns, got[1].valid, got[2].valid, got[2].loss_chars) == (1, False, 3, False, True, 1)
    assert chat.parsed(chat.formatted(df.limit(0))).count() == 0
    seg = chat.formatted(df.filter("conv_id = 2")).orderBy("position").collect()
    assert [s.text for s in seg if not s.loss][0] == "### User: " and [s.text for s in seg if s.loss] == ["a"] and seg[-1].text == "</turn>\n"
