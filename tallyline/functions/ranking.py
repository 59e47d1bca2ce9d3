"""Places within a key whose rows never meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket of ids, at most, where ids are unique.
ID_RANGE = 1 << 20


def id_range(id: Column) -> Column:
    """A number that grows with the id, the same for ID_RANGE ids in a row."""
    return F.floor(id / ID_RANGE)


def placed(rows: DataFrame, keys: list[str], buckets: list[Column], order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their number, from 1, within ``keys`` by ``order``.

    buckets are columns that the order begins with, or that grow with it: rows are
    numbered within a bucket, and moved up by what the counts of all buckets before say.
    So a task holds a bucket, and of a key only the counts of its buckets, however large
    the key is. Keys and buckets may be null.
    """
    own = rows.withColumns({"_key": F.struct(*keys), "_at": F.struct(*buckets)})
    counts = own.groupBy("_key", "_at").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_key", "_at", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_key", "_at").orderBy(*order))
    return own.withColumn(name, place).join(starts, ["_key", "_at"]).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_key", "_at", "_before")
