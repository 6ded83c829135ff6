"""Shuffled shards by a two-pass external shuffle.

Pass 1 scatters every record into one of many memory-sized buckets: its shard by rendezvous
hashing of doc_id (so adding a shard moves records only into the new one), its bucket within the
shard by a seeded hash of the whole record; a shard has as many buckets as its own size asks for, so
a hot key's shard has more.  A bucket is one task of pass 2, which takes its records in the order of
their hashes, applies a seeded Fisher-Yates shuffle and writes them.  A task that is run again writes
the same order, and so does another run over the same records.

A slot is the position within the shard: the bucket's place plus the position in the bucket.

Defined results: null texts count as empty; a null doc_id is a key like any other; rows that
repeat a doc_id share its shard; should one bucket outgrow `most_bytes` (fully equal rows, which
no hash can part, or one very long text) it is shuffled in pieces of that size, cut where their
hashes, which are no order of the records' own, say; no rows give no shards; other columns are
written along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.llm.common import Scratch, clear_name, table

LAW = "key"


@dataclass(frozen=True)
class Plan:
    shards: int = 16
    seed: int = 20_26
    bucket_bytes: int = 24_000_000
    most_bytes: int = 192_000_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is greatest."""
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, F.lit(seed), s).alias("h"), s.alias("s")))
    return F.array_max(each)["s"]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _shuffle(seed: int, most: int, bucket: str, order: str, pos: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, done, now = 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, done
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                size = 0
                rng = np.random.Generator(np.random.PCG64([seed, now, done]))
                own = rng.permutation(len(t))  # numpy's permutation is the Fisher-Yates shuffle; rows come in the order of their hashes
                for i in range(0, len(own), 2048):
                    part = t.take(pa.array(own[i : i + 2048])).drop_columns([order]).append_column(pos, pa.array(np.arange(done + i, done + i + len(own[i : i + 2048]), dtype=np.int64)))
                    yield from part.combine_chunks().to_batches()
                done += len(own)

        for b in batches:
            ids = b.column(bucket).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if ids[i] != now:
                    yield from flush()
                    now, done = int(ids[i]), 0
                held.append(b.slice(i, j - i))
                size += held[-1].nbytes
                if size > most:
                    yield from flush()
        yield from flush()

    return run


def write(docs: DataFrame, scratch: Scratch, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs in shuffled order, written, with three more columns; their names by role: shard, bucket, pos."""
    names = {role: clear_name(docs, role) for role in ("shard", "bucket", "pos", "order")}
    sizes = {r.shard: r["size"] for r in docs.groupBy(shard_of(F.col(key), plan.shards, plan.seed).alias("shard")).agg(F.sum(size_of(F.col(text))).alias("size")).collect()}  # a row for each shard
    buckets = [max(1, -(-sizes.get(s, 0) // plan.bucket_bytes)) for s in range(plan.shards)]
    first = [sum(buckets[:s]) for s in range(plan.shards)]
    out = docs.withColumn(names["order"], F.xxhash64(*(F.col(c) if not isinstance(t.dataType, (T.MapType, T.VariantType)) else F.to_json(c) for c, t in zip(docs.columns, docs.schema))))
    out = out.withColumn(names["shard"], shard_of(F.col(key), plan.shards, plan.seed))
    of_shard = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col(names["shard"]) + 1)
    within = F.pmod(F.xxhash64(F.col(names["order"]), F.lit(plan.seed + 1)), of_shard(buckets))
    out = out.withColumn(names["bucket"], (of_shard(first) + within).cast("long"))
    out = out.repartitionById(sum(buckets), F.col(names["bucket"]).cast("int")).sortWithinPartitions(names["bucket"], names["order"])
    schema = T.StructType([f for f in out.schema if f.name != names["order"]] + [T.StructField(names["pos"], T.LongType())])
    return scratch.keep(out.mapInArrow(_shuffle(plan.seed, plan.most_bytes, names["bucket"], names["order"], names["pos"]), schema), "shards"), names


def slots(shards: DataFrame, names: dict[str, str]) -> DataFrame:
    """The written rows with a column `slot` (another name if taken): gapless from 0 in each shard."""
    n, base, slot = (clear_name(shards, x) for x in ("n", "base", "slot"))
    sizes = shards.groupBy(names["shard"], names["bucket"]).agg(F.count("*").alias(n))  # a row for each bucket
    order = Window.partitionBy(names["shard"]).orderBy(names["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(names["bucket"], F.coalesce(F.sum(n).over(order), F.lit(0)).alias(base))
    return shards.join(sizes, names["bucket"]).withColumn(slot, F.col(base) + F.col(names["pos"])).drop(base)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    written, names = write(table(spark, sf_dir, "documents"), Scratch(spark, "shards"), plan)
    narrow = written.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), *(names[k] for k in ("shard", "bucket", "pos")))
    return slots(narrow, names).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", shard_of(F.col("doc_id"), plan.shards + 1, plan.seed).alias("grown_shard"))
