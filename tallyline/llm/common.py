"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Spark's setting that an execution deletes its shuffle files at its end.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a folder of this machine and any other master one in the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return "file:///tmp/checkpoints/tallyline"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tallyline"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read and no recomputation, and rows,
    row ids included, stay as they were written. The table stays until ``release``; what
    was shuffled for it goes as soon as it is written, not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: What materialize wrote, by application.
_written: dict[str, list[str]] = {}


def mark(spark: SparkSession) -> int:
    """How many tables materialize has written so far, for release."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the tables that this application's operators wrote between two marks.

    DataFrames that the operators returned read those tables: release them when the rows
    have been written or fetched, not before.
    """
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in paths[since:until]:
        if path:
            file = spark._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)
    paths[since:until] = [""] * len(paths[since:until])  # marks keep their meaning


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs, written once with a column that numbers its rows, and that column's name.

    A table that is computed anew may number its rows differently, so what is decided by
    row number is joined to the rows that were written with it.
    """
    row = unused("row", docs.columns)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def without(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """rows without those whose number is in dropped (one column of that name).

    What a stage drops is little beside the texts that stay. It is written first, so that
    Spark knows its size and sends it to the rows where that is small; the rows themselves
    are exchanged only where it isn't.
    """
    return rows.join(materialize(dropped, "dropped"), row, "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their whole names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(name: str, columns: list[str]) -> str:
    """name, or a longer one that none of the columns has (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
