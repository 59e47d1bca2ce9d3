"""Cutting lineage in operators that work in rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that an execution deletes its shuffle files at its end.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which driver and executors share."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    # Only where the cluster names none: a local master has its own disk, any other the warehouse.
    own = "file:///tmp/checkpoints/tallyline" if context.master.startswith("local") and "cluster" not in context.master else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tallyline"
    return (named or own).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; a lost executor costs a re-read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet: for tables of as many rows as the input.

    Columns are packed, readers take those they need, and what was shuffled for the table
    goes as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
