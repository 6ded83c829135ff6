"""An operation log as a relation: the state after all operations, without replaying one by one.

oplog (seq, key, op, tokens): op is add, remove, update or remove_all; seq is unique.  A pair is
there if its last add or update is later than its last removal and no earlier than the last
update or remove_all of its key (an update's own tokens survive it).  Two aggregations and a join:
partial aggregates come before the shuffles, so a key with a third of all operations is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations are put in order within blocks of so many sequence numbers, and blocks after that: a key with a third of
#: all operations is many blocks, not one task.
BLOCK = 1 << 20


def replay(oplog: DataFrame) -> DataFrame:
    """(key, token) after all operations."""
    each = oplog.filter("op IN ('add', 'update', 'remove')").select("seq", "key", "op", F.explode("tokens").alias("token")).filter("key IS NOT NULL AND token IS NOT NULL")
    last = each.groupBy("key", "token").agg(F.max(F.when(F.col("op") != "remove", F.col("seq"))).alias("a"), F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("r"))
    # an update to no tokens removes all, as remove_all does
    resets = oplog.filter("op = 'remove_all' OR op = 'update'").groupBy("key").agg(F.max("seq").alias("t"))
    state = last.filter("a IS NOT NULL AND a > coalesce(r, a - 1)").join(resets, "key", "left")
    return state.filter("t IS NULL OR a >= t").select("key", "token")


def latest(oplog: DataFrame) -> DataFrame:
    """Of each key the operations that a later remove_all or update does not make void."""
    cut = oplog.filter("op = 'remove_all' OR op = 'update'").groupBy("key").agg(F.max("seq").alias("t"))
    return oplog.join(cut, "key", "left").filter("t IS NULL OR seq >= t").drop("t")


def _blocked(df: DataFrame, keys: list[str], **found: tuple[Column, Column, bool]) -> DataFrame:
    """df (seq, keys) with columns: name=(aggregate over the rows before, fallback's aggregate of a block, ascending).

    The value within the block, or if that is null the nearest of an earlier block (a later one if not ascending).
    """
    df = df.withColumn("_block", F.floor(F.col("seq") / BLOCK))
    blocks = df.groupBy(*keys, "_block").agg(*(whole.alias(f"_{name}") for name, (_, whole, _) in found.items()))
    for name, (_, _, up) in found.items():
        order = F.col("_block") if up else F.col("_block").desc()
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn(f"_{name}", F.last(f"_{name}", True).over(before))
    for name, (each, _, up) in found.items():
        within = Window.partitionBy(*keys, "_block").orderBy(F.col("seq") if up else F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn(name, F.last(each, True).over(within))
    df = df.join(blocks, [*keys, "_block"])
    for name in found:
        df = df.withColumn(name, F.coalesce(name, f"_{name}")).drop(f"_{name}")
    return df.drop("_block")


def events(oplog: DataFrame) -> DataFrame:
    """The events (seq, kind, key, values) of all operations, values sorted.

    An add tells its values as given; a remove too, but only if the key has any; a remove_all tells the
    old set, if there is one; an update tells what it removes, then what it adds, each if there is any.
    Operations with a null key or without values (other than remove_all and update) tell nothing.
    """
    log = oplog.filter("key IS NOT NULL").select("seq", "key", "op", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).withColumn("reset", F.col("op").isin("update", "remove_all"))
    reset = F.when(F.col("reset"), F.col("seq"))
    ops = _blocked(log, ["key"], next_reset=(reset, F.min(reset), False))
    each = ops.filter("op <> 'remove_all'").select("seq", "key", "op", "next_reset", F.explode(F.array_distinct("tokens")).alias("token")).filter("token IS NOT NULL")
    mention = F.struct("seq", "op", "next_reset")
    each = _blocked(each, ["key", "token"], before=(mention, F.max(mention), True), after=(F.col("seq"), F.min("seq"), False))
    # there before: the last mention put it in, and no reset came between; an update is a reset that may name it
    there = F.coalesce((F.col("before.op") != "remove") & (F.col("before.next_reset").isNull() | (F.col("before.next_reset") >= F.col("seq"))), F.lit(False))
    each = each.withColumn("there", there)
    # what a reset takes away: put in last before it and not named by it
    taken = each.filter("op <> 'remove' AND next_reset IS NOT NULL AND (after IS NULL OR after > next_reset)").groupBy("key", F.col("next_reset").alias("seq")).agg(F.collect_list("token").alias("values"))
    fresh = each.filter("op = 'update' AND NOT there").groupBy("key", "seq").agg(F.collect_list("token").alias("values"))
    deltas = each.select("key", "seq", F.when(F.col("op") == "remove", F.when(F.col("there"), -1).otherwise(0)).otherwise(F.when(F.col("there"), 0).otherwise(1)).alias("d"))
    deltas = deltas.unionByName(taken.select("key", "seq", (-F.size("values")).alias("d"))).groupBy("key", "seq").agg(F.sum("d").alias("d"))
    removes = log.filter("op = 'remove' AND size(tokens) > 0").join(_sizes(log.select("key", "seq").join(deltas, ["key", "seq"], "left").fillna(0, ["d"])), ["key", "seq"]).filter("size > 0")
    told = lambda df, kind, part, values="values": df.select("seq", F.lit(kind).alias("kind"), F.lit(part).alias("part"), "key", F.array_sort(values).alias("values"))
    out = told(log.filter("op = 'add' AND size(tokens) > 0"), "added", 1, "tokens").unionByName(told(removes, "removed", 0, "tokens"))
    return out.unionByName(told(taken, "removed", 0)).unionByName(told(fresh, "added", 1)).select("seq", "kind", "key", "values")


def _sizes(deltas: DataFrame) -> DataFrame:
    """(key, seq, size): how many values a key has before each operation of deltas (key, seq, d)."""
    df = deltas.withColumn("_block", F.floor(F.col("seq") / BLOCK))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("key", "_block").agg(F.sum("d").alias("d")).withColumn("first", F.coalesce(F.sum("d").over(before("key", by="_block")), F.lit(0))).drop("d")
    size = F.coalesce(F.sum("d").over(before("key", "_block", by="seq")), F.lit(0))
    return df.withColumn("within", size).join(blocks, ["key", "_block"]).select("key", "seq", (F.col("first") + F.col("within")).alias("size"))
