"""Promotion over a stream of lines: the ledger after each batch, as ``ledger.promote`` makes it of all lines so far.

State is three stored tables that change by parts: the lines by identity, the lines with a
reference by account and reference, and the ledger by identity. A batch adds its lines to
the first two, and only the identities that it concerns are promoted again: those of its
own lines, and those of any line that shares a reference with them, since a reference may
move to an earlier owner. Every step sets rows by their keys, so a batch that comes again,
in part or as a whole, changes nothing, and one that failed half-way is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import cut
from ..operators.ledger import IDENTITY, promote
from ..sources.stored import PartTable
from .ingest import KEY, LINES

REFERENCE = ("account_id", "external_reference")
_TYPES = dict(c.split() for c in LINES.split(", "))
LEDGER = ", ".join(f"{c} {_TYPES[c]}" for c in IDENTITY) + ", external_reference string, occurrence_index int, lines long"


@dataclass(frozen=True)
class Promotion:
    """The tables of a promotion below a shared folder, each in so many parts."""

    folder: str
    parts: int = 256

    @property
    def lines(self) -> PartTable:
        return PartTable(f"{self.folder}/lines", LINES, IDENTITY, self.parts)

    @property
    def referenced(self) -> PartTable:
        return PartTable(f"{self.folder}/referenced", LINES, REFERENCE, self.parts)

    @property
    def ledger(self) -> PartTable:
        return PartTable(f"{self.folder}/ledger", LEDGER, IDENTITY, self.parts)

    def add(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def batch_in(batch: DataFrame, _: int) -> None:
            spark = batch.sparkSession
            for table in (self.lines, self.referenced, self.ledger):
                table.ensure(spark)
            batch = cut(batch.dropDuplicates(list(KEY)))
            named = batch.where("external_reference is not null")
            self.lines.upsert(batch, (*IDENTITY, *KEY))
            self.referenced.upsert(named, (*REFERENCE, *KEY))
            sharing = self.referenced.of(named)
            touched = cut(batch.select(*IDENTITY).unionByName(sharing.select(*IDENTITY)).distinct())
            own = cut(self.lines.of(touched))
            # A reference that an identity owns stands on one of its lines, so with all lines of these nothing is missing.
            every = own.where("external_reference is null").unionByName(self.referenced.of(own.where("external_reference is not null")))
            self.ledger.replace(self.ledger.among(promote(every), touched), touched)

        return batch_in

    def run(self, spark: SparkSession, incoming: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
        """Takes in what is in the folder incoming, so many files a batch, and ends."""
        lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", files).parquet(incoming)
        return lines.writeStream.foreachBatch(self.add()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
