"""What the operators of this subpackage share: tables, the shared folder, written steps."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.cluster import shared_dir, ship

#: Id sets of at most so many rows (a long each, about 16 bytes in a hashed relation) are broadcast.
BROADCAST_IDS = 2_000_000


#: Rows of an Arrow batch where the session sets nothing else: whole texts may be long.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: the package on the workers' path, batches of few texts."""
    ship(spark)
    if spark.conf.get(_ROWS, None) is None:
        spark.conf.set(_ROWS, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """Where a vocabulary lies on this machine: a path as it is, a bare name among the public tokenizers."""
    return name if os.path.dirname(name) else public_tokenizers.path(name)


class Scratch:
    """Tables written into the shared folder by one run of an operator.

    A written table survives the loss of any executor and cuts the lineage.  `drop` removes those
    that nothing needs any more; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wordtide-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def keep(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """df, written; batch_rows: the rows of its Arrow batches, where a row is large."""
        path, before = self.path(name), self.spark.conf.get(_ROWS, None)
        try:
            if batch_rows is not None:
                self.spark.conf.set(_ROWS, batch_rows)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if batch_rows is not None:
                self.spark.conf.set(_ROWS, before) if before is not None else self.spark.conf.unset(_ROWS)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame | str) -> None:
        jvm = self.spark._jvm
        for t in tables:
            folder = t if isinstance(t, str) else os.path.dirname(t.inputFiles()[0]) if t.inputFiles() else None
            if folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def among(df: DataFrame, ids: DataFrame, on: str, how: str, rows: int | None = None) -> DataFrame:
    """df joined (left_semi or left_anti, or inner with narrow ids) with ids on one column.

    The ids are broadcast only if they are counted and few; else both sides are shuffled.
    """
    n = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, how)


def clear_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
