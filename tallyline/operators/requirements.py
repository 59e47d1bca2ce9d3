"""Deciding which payments need a document: pending, batches, judgements, runs, knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ranking import id_range, placed
from ..functions.text import vendor_key
from ..thresholds import BATCH_SIZE
from . import verdicts

IN_FLIGHT = ("UPLOADING", "IDENTIFYING", "PARSING", "VALIDATING")


def pending(transactions: DataFrame, requirements: DataFrame) -> DataFrame:
    """Payments without a requirement that no one has judged."""
    return transactions.where("not judged").join(requirements.select(F.col("transaction_id").alias("id")), "id", "left_anti")


def batches(rows: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """rows with batch: chunks of a workspace's payments in order of day and id."""
    numbered = placed(rows, ["workspace_id"], [F.col("value_date"), id_range(F.col("id"))], ["value_date", "id"])
    return numbered.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int")).drop("place")


def created(judgements: DataFrame, watch: Observation | None = None) -> DataFrame:
    """transaction_id, outcome: the first judgement of each payment decides; malformed ones are none.

    An unsure one asks its question; otherwise a document is required if the judgement says
    so and the payment isn't a credit. watch counts answers and refusals.
    """
    judgements = verdicts.usable(judgements, verdicts.judgement_problems(), watch).withColumn("has_clarification", F.col("question").isNotNull())
    fields = ("needs_document", "confident", "has_clarification", "direction", "workspace_id")
    first = judgements.groupBy("transaction_id").agg(F.min_by(F.struct(*fields), "position").alias("j")).select("transaction_id", "j.*")
    outcome = F.when(~F.col("confident") & F.col("has_clarification"), "question").when(F.col("needs_document") & (F.col("direction") != "CREDIT"), "requirement").otherwise("judged")
    return first.select("workspace_id", "transaction_id", outcome.alias("outcome"))


def run_outcome(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """workspace_id, batches, failed, requirements, questions, state. A batch none of whose payments was answered has failed; a run has if all its batches have."""
    answered = rows.join(outcomes.select(F.col("transaction_id").alias("id"), "outcome"), "id", "left")
    per = answered.groupBy("workspace_id", "batch").agg(F.count("outcome").alias("answers"), F.count_if(F.col("outcome") == "requirement").alias("r"), F.count_if(F.col("outcome") == "question").alias("q"))
    totals = per.groupBy("workspace_id").agg(F.count("*").alias("batches"), F.count_if(F.col("answers") == 0).alias("failed"), F.sum("r").alias("requirements"), F.sum("q").alias("questions"))
    return totals.withColumn("state", F.when(F.col("failed") == F.col("batches"), "FAILED").otherwise("COMPLETED"))


def batch_due(statements: DataFrame) -> DataFrame:
    """batch_id, settled, produced, due: nothing in flight, something completed, both."""
    seen = statements.groupBy("batch_id").agg((~F.bool_or(F.col("state").isin(*IN_FLIGHT))).alias("settled"), F.bool_or(F.col("state") == "COMPLETED").alias("produced"))
    return seen.withColumn("due", F.col("settled") & F.col("produced"))


def latest_knowledge(facts: DataFrame) -> DataFrame:
    """What is known by kind and key: the last answer counts."""
    return facts.groupBy("workspace_id", "kind", "key").agg(F.max(F.struct("at", "id", "value")).alias("f")).select("workspace_id", "kind", "key", "f.value", F.col("f.id").alias("from_id"))


def confirm_aliases(aliases: DataFrame, confirmations: DataFrame, vendors: DataFrame) -> DataFrame:
    """aliases (workspace_id, alias_normalized, vendor_id, confirmed) after confirmations, with outcome.

    confirmations (workspace_id, vendor_id, alias, said_on): a user says that what the bank
    printed means this vendor. An alias belongs to one vendor of its workspace: the owner's
    word promotes an inferred one (confirmed), nobody's takes it away (refused), and of
    several that ask for a new one the first gets it (added; ties to the smaller vendor).
    What normalises to nothing teaches nothing, nor does a vendor that the workspace
    doesn't have (vendors: workspace_id, id).
    """
    name = ["workspace_id", "alias_normalized"]
    said = confirmations.select("workspace_id", "vendor_id", "said_on", vendor_key(F.col("alias")).alias("alias_normalized")).where("alias_normalized <> ''")
    said = said.join(vendors.select("workspace_id", F.col("id").alias("vendor_id")), ["workspace_id", "vendor_id"], "left_semi")
    asked = said.groupBy(*name).agg(F.min(F.struct("said_on", "vendor_id")).alias("first"))
    owned = said.select(*name, "vendor_id", F.lit(True).alias("by_owner")).distinct()
    known = aliases.select(*name, "vendor_id", "confirmed").join(owned, [*name, "vendor_id"], "left")
    both = known.join(asked, name, "full")
    new, mine = F.col("vendor_id").isNull(), F.coalesce("by_owner", F.lit(False))
    return both.select(
        *name, F.coalesce("vendor_id", "first.vendor_id").alias("vendor_id"), (F.coalesce("confirmed", F.lit(True)) | mine).alias("confirmed"),
        F.when(F.col("first").isNull() | (mine & F.col("confirmed")), "kept").when(new, "added").when(mine, "confirmed").otherwise("refused").alias("outcome"),
    )
