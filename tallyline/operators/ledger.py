"""Promotion: the lines of overlapping statements become one ledger row per movement.

A movement's identity is account, day, amount, direction and normalised description.
Lines without a reference are told apart by their number within identity and statement:
the n-th such line of any statement is the n-th movement. Lines with a reference are one
movement per reference of the account, whatever the identity says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("account_id", "value_date", "amount_minor", "direction", "description_normalized")


def referenced(lines: DataFrame) -> DataFrame:
    """account_id, external_reference -> the line that owns it, the first by statement and row, and lines: how many have it."""
    owner = F.min(F.struct("statement_id", "row_index", *IDENTITY[1:]))
    owners = lines.where("external_reference is not null").groupBy("account_id", "external_reference").agg(owner.alias("o"), F.count("*").alias("lines"))
    return owners.select("account_id", "external_reference", "o.*", "lines")


def promote(lines: DataFrame) -> DataFrame:
    """The ledger of an empty start: identity, occurrence_index, external_reference, and how many lines it stands for.

    Within an identity the movements without a reference come first, in their order, then
    those with one, by owner; occurrence counts from 0.
    """
    plain = lines.where("external_reference is null")
    nth = F.row_number().over(Window.partitionBy(*IDENTITY, "statement_id").orderBy("row_index"))
    seats = plain.withColumn("nth", nth).groupBy(*IDENTITY, "nth").agg(F.count("*").alias("lines"))
    seats = seats.select(*IDENTITY, F.lit(None).cast("string").alias("external_reference"), F.lit(0).alias("tier"), F.col("nth").cast("long").alias("a"), F.lit(0).alias("b"), "lines")
    owned = referenced(lines).select(*IDENTITY, "external_reference", F.lit(1).alias("tier"), F.col("statement_id").alias("a"), F.col("row_index").alias("b"), "lines")
    order = Window.partitionBy(*IDENTITY).orderBy("tier", "a", "b", "external_reference")
    return seats.unionByName(owned).withColumn("occurrence_index", F.row_number().over(order) - 1).select(*IDENTITY, "external_reference", "occurrence_index", "lines")


def relink(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a statement's lines do to a ledger: each is linked to a row or creates the occurrence named.

    lines: statement_id, row_index, identity, external_reference; ledger: id, identity,
    occurrence_index, external_reference. A referenced line links by its reference, else
    the first line of a reference creates and the others link to that. A line without one
    takes the n-th ledger row of its identity without a reference. New rows take the
    occurrences after the greatest, by row.
    """
    held = ledger.where("external_reference is not null").groupBy("account_id", "external_reference").agg(F.min(F.struct("occurrence_index", "id")).alias("o"))
    held = held.select("account_id", "external_reference", F.col("o.id").alias("by_reference"))
    free = ledger.where("external_reference is null").withColumn("nth", F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("occurrence_index"))).select(*IDENTITY, "nth", F.col("id").alias("by_place"))
    plain = F.when(F.col("external_reference").isNull(), 1)
    rows = lines.withColumn("nth", F.when(plain == 1, F.sum(plain).over(Window.partitionBy(*IDENTITY, "statement_id").orderBy("row_index"))).cast("int"))
    rows = rows.join(held, ["account_id", "external_reference"], "left").join(free, [*IDENTITY, "nth"], "left")
    first = F.row_number().over(Window.partitionBy("statement_id", "account_id", "external_reference").orderBy("row_index")) == 1
    rows = rows.withColumn("linked_to", F.coalesce("by_reference", "by_place")).withColumn("creates", F.col("linked_to").isNull() & (F.col("external_reference").isNull() | first))
    greatest = ledger.groupBy(*IDENTITY).agg(F.max("occurrence_index").alias("greatest"))
    new = F.sum(F.col("creates").cast("int")).over(Window.partitionBy(*IDENTITY, "statement_id").orderBy("row_index"))
    rows = rows.join(greatest, list(IDENTITY), "left").withColumn("occurrence", F.when(F.col("creates"), F.coalesce("greatest", F.lit(-1)) + new))
    outcome = F.when(F.col("linked_to").isNotNull(), "linked").when(F.col("creates"), "created").otherwise("linked to created")
    return rows.select("statement_id", "row_index", outcome.alias("outcome"), "linked_to", F.col("occurrence").cast("long").alias("occurrence_index"))
