"""A multimap as a relation (key, value) with set semantics.

Every operation is DataFrame to DataFrame; nothing is collected but the booleans that callers ask
for.  A pair is there once, so a key without pairs is no key.  Null keys and values are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def pairs(df: DataFrame, key: Column, values: Column) -> DataFrame:
    """(key, value), a row for each member of an array of values, without nulls or repeats."""
    return df.select(key.alias("key"), F.explode(values).alias("value")).dropna().distinct()


def contains(m: DataFrame, key: str | None) -> bool:
    """False for null."""
    return key is not None and not m.filter(F.col("key") == key).isEmpty()


def contains_all(m: DataFrame, keys: DataFrame) -> DataFrame:
    """I1 of many keys (key): (key, hit)."""
    have = m.select("key").distinct().withColumn("hit", F.lit(True))
    return keys.select("key").join(have, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))


def get(m: DataFrame, key: str | None) -> DataFrame:
    """(value) of a key; none for an absent or null key."""
    return m.filter(F.col("key") == F.lit(key)).select("value").distinct()


def add(m: DataFrame, new: DataFrame) -> DataFrame:
    """The union; adding a pair that is there changes nothing."""
    return m.unionByName(new.select("key", "value").dropna()).dropDuplicates(["key", "value"])


def remove(m: DataFrame, gone: DataFrame) -> DataFrame:
    """The difference."""
    return m.join(gone.select("key", "value"), ["key", "value"], "left_anti")


def remove_keys(m: DataFrame, keys: DataFrame) -> DataFrame:
    """Without some keys (key)."""
    return m.join(keys.select("key"), "key", "left_anti")


def flush(m: DataFrame) -> DataFrame:
    """I8: nothing, and no event."""
    return m.limit(0)


def transpose(m: DataFrame) -> DataFrame:
    """The inverted multimap: a projection."""
    return m.select(F.col("value").alias("key"), F.col("key").alias("value"))


Handler = Callable[[str, tuple[str, ...]], None]


@dataclass
class Multimap:
    """The operations with their guards, results and events, for callers that change a few pairs.

    The relation is immutable; each change replaces it.  `checkpoint_every` changes the lineage is
    cut by writing it to the checkpoint folder, if the session has one.
    """

    spark: SparkSession
    relation: DataFrame | None = None
    added: list[Handler] = field(default_factory=list)
    removed: list[Handler] = field(default_factory=list)
    checkpoint_every: int = 25
    _changes: int = 0

    def __post_init__(self) -> None:
        if self.relation is None:
            self.relation = empty(self.spark)

    def _of(self, key: str, values: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(key, v) for v in dict.fromkeys(values)], SCHEMA)

    def _become(self, df: DataFrame) -> None:
        self._changes += 1
        cut = self._changes % self.checkpoint_every == 0 and self.spark.conf.get("spark.checkpoint.dir", None)
        self.relation = df.checkpoint() if cut else df

    def contains(self, key: str | None) -> bool:
        return contains(self.relation, key)

    def get(self, key: str | None) -> DataFrame:
        return get(self.relation, key)

    def add(self, key: str | None, values: str | Iterable[str] | None) -> None:
        """One event for each call with a key and a value, with the values as given."""
        values = (values,) if isinstance(values, str) else tuple(v for v in values or () if v is not None)
        if key is None or not values:
            return
        self._become(add(self.relation, self._of(key, values)))
        for h in self.added:
            h(key, values)

    def remove(self, key: str | None, values: str | Iterable[str] | None) -> bool:
        """True if the pair was there. I6 (several values): true if the key was there. I10."""
        if key is None or values is None:
            return False
        if isinstance(values, str):
            asked, there = (values,), not self.relation.filter((F.col("key") == key) & (F.col("value") == values)).isEmpty()
        else:
            asked = tuple(v for v in values if v is not None)
            there = bool(asked) and self.contains(key)
        if not there:
            return False
        self._become(remove(self.relation, self._of(key, asked)))
        for h in self.removed:
            h(key, asked)
        return True

    def remove_all(self, key: str | None) -> tuple[bool, tuple[str, ...]]:
        """(whether the key was there, its values), with one event."""
        old = tuple(r.value for r in self.get(key).toLocalIterator()) if key is not None else ()
        if not old:
            return False, ()
        self._become(self.relation.filter(F.col("key") != key))
        for h in self.removed:
            h(key, old)
        return True, old

    def flush(self) -> None:
        """I8: clears without an event."""
        self.relation, self._changes = empty(self.spark), 0

    def dispose(self) -> None:
        """I12."""
        self.flush()
        self.added.clear()
        self.removed.clear()
