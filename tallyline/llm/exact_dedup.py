"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a run of digests. In each round the runs whose numbers agree
after division by the fan-in exchange their rows and are merged, and every level keeps,
for each digest, the best row and the number of rows below it. The best row is a struct,
so Spark aggregates by sorting: each task sorts its run, combines equal digests before
the exchange, and merges the sorted runs behind it. A run is spread over all tasks by
its digests, so no task ever holds a whole run, and a digest with a third of all rows is
down to one row a partition before anything is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, materialize, numbered, quoted, table, without

FAN_IN = 8


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A narrow row for each document: row id (docs' column ``row``, else the order of reading), doc_id, digest, lengths."""
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = F.regexp_replace(text, SPACE_PATTERN, "")
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"),
        F.col("doc_id"),
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
        F.length(normal).alias("normal_chars"),
        F.length(text).alias("chars"),
    )


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """digest, normal_chars -> keep (struct) and group_size, merged in rounds of fan_in runs.

    The length of the normalised text is compared with the whole digest, as a second
    witness that texts are equal.
    """
    runs = rows.rdd.getNumPartitions()
    level = rows.select(
        F.spark_partition_id().alias("run"),
        "digest",
        "normal_chars",
        F.struct(
            (-F.col("chars")).alias("less_chars"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id").alias("doc_id"),
            F.col("row_id").alias("row_id"),
        ).alias("keep"),
        F.lit(1).cast("long").alias("group_size"),
    )
    while True:
        runs = -(-runs // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy("run", "digest", "normal_chars")
            .agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
        if runs <= 1:
            return level.drop("run")


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN, row: str | None = None) -> DataFrame:
    """One row per row of docs: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after deleting U+0020 and U+0009-U+000D; a
    null text counts as empty. The row with the most code points in the original text
    stays, then the one with the smallest doc_id (null last), then the smallest row_id, which
    is docs' column ``row`` or the order of reading, so of rows that repeat an id exactly one
    stays. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = materialize(digests(docs, row), "digests")
    best = merge_runs(rows, fan_in)
    return rows.join(best, ["digest", "normal_chars"]).select(
        "row_id",
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, row_number() OVER () AS row_id,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, row_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with the columns they came with; docs need not be stored."""
    rows, row = numbered(docs, "dedup-rows")
    dropped = exact_dedup(rows, row=row).where("not kept").select(F.col("row_id").alias(row))
    return without(rows, dropped, row).select(*quoted(docs.columns))
