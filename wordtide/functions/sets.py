"""Set algebra (A1-A17): on array columns, and on relations of one row for each member.

Array forms take arrays without nulls; a null array is the empty set.  A8 is not implemented by
the behaviour that is matched here and raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _s(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def construct(a: Column) -> Column:
    """The distinct members."""
    return F.array_distinct(_s(a))


def add(a: Column, x: Column) -> Column:
    """A1: a with x; a null x adds nothing."""
    return F.when(x.isNull(), _s(a)).otherwise(F.array_union(_s(a), F.array(x)))


def try_add(a: Column, x: Column) -> Column:
    """A1's result: whether x is new."""
    return x.isNotNull() & ~contains(a, x)


def add_strict(a: Column, x: Column) -> Column:
    """A2: a with x; raises on a null or present x."""
    return F.when(try_add(a, x), add(a, x)).otherwise(F.raise_error(F.lit("null or present already")).cast("array<string>"))


def remove(a: Column, x: Column) -> Column:
    """A3: a without x."""
    return F.when(x.isNull(), _s(a)).otherwise(F.array_remove(_s(a), x))


def cleared() -> Column:
    """A4."""
    return F.array().cast("array<string>")


def union(a: Column, b: Column) -> Column:
    """A5."""
    return F.array_union(_s(a), _s(b))


def intersect(a: Column, b: Column) -> Column:
    """A6."""
    return F.array_intersect(_s(a), _s(b))


def minus(a: Column, b: Column) -> Column:
    """A7."""
    return F.array_except(_s(a), _s(b))


def symmetric_difference(a: Column, b: Column) -> Column:
    """There is none."""
    raise NotImplementedError("symmetric difference is not supported")


def is_subset(a: Column, b: Column) -> Column:
    """A9."""
    return F.size(minus(a, b)) == 0


def is_superset(a: Column, b: Column) -> Column:
    """A10."""
    return is_subset(b, a)


def is_proper_superset(a: Column, b: Column) -> Column:
    """A11."""
    return is_superset(a, b) & (size(construct(b)) < size(construct(a)))


def is_proper_subset(a: Column, b: Column) -> Column:
    """A12."""
    return is_proper_superset(b, a)


def overlaps(a: Column, b: Column) -> Column:
    """A13."""
    return F.coalesce(F.arrays_overlap(_s(a), _s(b)), F.lit(False))


def equals(a: Column, b: Column) -> Column:
    """Equal as sets."""
    return is_subset(a, b) & is_subset(b, a)


def contains(a: Column, x: Column) -> Column:
    """False for null."""
    return F.coalesce(F.array_contains(_s(a), x.cast("string")), F.lit(False))


def size(a: Column) -> Column:
    """The count."""
    return F.size(_s(a))


def members(df: DataFrame, key: str, array: str, as_name: str = "value") -> DataFrame:
    """A row for each member."""
    return df.select(key, F.explode(array).alias(as_name))


def relation_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """A5 of relations."""
    return a.unionByName(b).distinct()


def relation_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """A6 of relations."""
    return a.intersect(b.select(*a.columns))


def relation_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """A7 of relations."""
    return a.subtract(b.select(*a.columns))


def relation_is_subset(a: DataFrame, b: DataFrame) -> bool:
    """A9 of relations."""
    return a.join(b.select(*a.columns), a.columns, "left_anti").isEmpty()


def relation_equals(a: DataFrame, b: DataFrame) -> bool:
    """A14 of relations."""
    return relation_is_subset(a, b) and relation_is_subset(b, a)


def relation_overlaps(a: DataFrame, b: DataFrame) -> bool:
    """A13 of relations."""
    return not a.join(b.select(*a.columns), a.columns, "left_semi").isEmpty()
