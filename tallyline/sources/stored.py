"""Tables on shared storage that change by parts.

A table's rows lie in parts by a hash of the columns that changes come by, such as the
parent of a set of rows. A change reads and writes the parts of its own rows only, and
swaps them with Spark's dynamic overwrite, so the files of all other parts stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut

PART = "part"


@dataclass(frozen=True)
class PartTable:
    """The table at path, of ``schema``, in ``parts`` parts by the columns ``by``."""

    path: str
    schema: str
    by: tuple[str, ...]
    parts: int = 64

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), self.parts).cast("int")

    def create(self, rows: DataFrame) -> None:
        rows.withColumn(PART, self._part()).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(PART)

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, {PART} int").parquet(self.path)

    def ensure(self, spark: SparkSession) -> None:
        """An empty table where there is none yet."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            self.create(spark.createDataFrame([], self.schema))

    def of(self, parents: DataFrame) -> DataFrame:
        """The stored rows of parents (columns ``by``); only their parts are read."""
        touched = sorted(r[0] for r in parents.select(self._part()).distinct().collect())
        return self.among(self._stored(parents.sparkSession).where(F.col(PART).isin(touched)).drop(PART), parents)

    def among(self, rows: DataFrame, parents: DataFrame) -> DataFrame:
        """Those of rows that belong to parents; null is a value."""
        return rows.join(parents.select(*[F.col(k).alias(f"_{k}") for k in self.by]), _equal(self.by), "left_semi")

    def replace(self, rows: DataFrame, parents: DataFrame) -> None:
        """``rows`` are the new sets of their parents and of ``parents`` (columns ``by``), in place of the old ones; a new set may be empty.

        Repeating a replacement changes nothing, so a job that failed half-way is run again.
        """
        keys = parents.select(*self.by).unionByName(rows.select(*self.by)).distinct()
        self._swap(rows.sparkSession, keys, lambda old: _without(old, keys, self.by).unionByName(rows.withColumn(PART, self._part())))

    def upsert(self, rows: DataFrame, keys: tuple[str, ...]) -> None:
        """Rows come in place of those of the same keys, which hold the columns ``by``; null keys are equal. Keys of rows are unique."""
        named = rows.select(*keys)
        self._swap(rows.sparkSession, rows.select(*self.by), lambda old: _without(old, named, keys).unionByName(rows.withColumn(PART, self._part())))

    def update(self, changes: DataFrame, keys: tuple[str, ...]) -> None:
        """The other columns of changes where a row has a change's keys, which hold the columns ``by``; no row comes or goes."""
        names = [c for c in changes.columns if c not in keys]

        def changed(old: DataFrame) -> DataFrame:
            marked = changes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*names).alias("_change"))
            rows = old.join(marked, _equal(keys), "left")
            return rows.select(*[F.when(F.col("_change").isNotNull(), F.col("_change")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns])

        self._swap(changes.sparkSession, changes.select(*self.by), changed)

    def delete(self, gone: DataFrame, keys: tuple[str, ...]) -> None:
        self._swap(gone.sparkSession, gone.select(*self.by), lambda old: _without(old, gone.select(*keys), keys))

    def _swap(self, spark: SparkSession, touching: DataFrame, change) -> None:
        """Writes the parts that ``touching`` lies in, as ``change`` makes them of what is there."""
        # As many numbers as the table has parts, at most.
        touched = sorted(r[0] for r in touching.select(self._part()).distinct().collect())
        old = self._stored(spark).where(F.col(PART).isin(touched))
        # Written elsewhere first: the parts are read until then.
        new = cut(change(old))
        left = {r[0] for r in new.select(PART).distinct().collect()}
        if left:
            new.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        for part in touched:
            if part not in left:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={part}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _equal(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))


def _without(rows: DataFrame, gone: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.join(gone.select(*[F.col(k).alias(f"_{k}") for k in keys]), _equal(keys), "left_anti")
