"""Incremental intake: lines that arrive in files enter a table exactly once.

Every micro-batch is held against the lines that earlier batches brought of its ranges of
statements (the table is partitioned by them) and adds those that are new; totals and promotion then read the table. A batch that runs again, after a
failure, replaces its own part, and a file that arrives twice adds nothing, so delivery
at least once is enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LINES = "statement_id long, row_index int, account_id long, value_date date, amount_minor long, direction string, description_normalized string, external_reference string"
KEY = ("statement_id", "row_index")
#: Statements of a range, and the most ranges by which a batch picks what it reads; one with more reads the keys of all.
RANGE, MOST_RANGES = 100_000, 1_000


def stored_lines(spark: SparkSession, table: str) -> DataFrame:
    """The lines taken in so far, with the batch that brought each; empty before the first."""
    schema = LINES + ", batch long, range long"
    try:
        return spark.read.schema(schema).parquet(table)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)


def take_in(table: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a batch's new lines to table, one part per batch."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("range", F.floor(F.col("statement_id") / RANGE))
        ranges = [r[0] for r in batch.select("range").distinct().limit(MOST_RANGES + 1).collect()]
        earlier = stored_lines(spark, table).where(F.col("batch") != batch_id)
        if len(ranges) <= MOST_RANGES:
            earlier = earlier.where(F.col("range").isin([r for r in ranges if r is not None]))
        fresh = batch.dropDuplicates(list(KEY)).join(earlier.select(*KEY), list(KEY), "left_anti")
        fresh.write.mode("overwrite").partitionBy("range").parquet(f"{table}/batch={batch_id}")

    return add


def ingest(spark: SparkSession, incoming: str, table: str, checkpoint: str) -> StreamingQuery:
    """Takes in all files that are in the folder incoming, in batches, and ends."""
    lines = spark.readStream.schema(LINES).parquet(incoming)
    return lines.writeStream.foreachBatch(take_in(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
