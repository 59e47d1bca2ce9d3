"""The missing-document report and the reconciliation export."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import major_units
from ..functions.ranking import id_range
from ..functions.ranking import placed as placed_by

BUCKETS = ("matched", "notFound", "needsReview", "waiting", "blocked", "notRequired")
QUEUE_STATES = ("NEEDS_REVIEW", "NOT_FOUND", "IDENTIFIED")
FILTERS = {"not-found": ("NOT_FOUND",), "needs-review": ("NEEDS_REVIEW",), "waiting": ("IDENTIFIED",)}
#: Fixed wording.
STATUS = {"matched": "Matched", "notFound": "Not found", "needsReview": "Needs review", "waiting": "Waiting for a document", "blocked": "Waiting on a mailbox", "notRequired": "No document needed"}
HOW_RESOLVED = {"AUTO_RETRIEVED": "Retrieved from email", "AUTO_MATCHED": "Matched automatically", "USER_CONFIRMED": "Confirmed by you", "USER_LINKED": "Linked by you"}


def _wording(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def bucket(state: Column, method: Column) -> Column:
    """The report's bucket of a requirement; a state it doesn't know is an error."""
    return (
        F.when(state == "RESOLVED", F.when(method.eqNullSafe("NOT_REQUIRED"), "notRequired").otherwise("matched"))
        .when(state == "NOT_FOUND", "notFound")
        .when(state == "NEEDS_REVIEW", "needsReview")
        .when(state.isin("IDENTIFIED", "SEARCHING", "EVALUATING", "FAILED"), "waiting")
        .when(state == "BLOCKED", "blocked")
        .when(state.isNotNull(), F.raise_error(F.concat(F.lit("no bucket for state "), state)).cast("string"))
    )


def summary(requirements: DataFrame) -> DataFrame:
    """Counts of each bucket by workspace; a document is required in all but notRequired."""
    rows = requirements.select("workspace_id", bucket(F.col("state"), F.col("method")).alias("bucket"))
    counts = rows.groupBy("workspace_id").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    return counts.withColumn("documentsRequired", sum((F.col(b) for b in BUCKETS[:5]), F.lit(0).cast("long")))


def queue(requirements: DataFrame, transactions: DataFrame, accounts: DataFrame, chosen: str = "all") -> DataFrame:
    """What waits for a person, in the order of the report (place from 1 within the workspace).

    An unknown filter is "all". Requirements whose payment is gone are left out; a
    missing account leaves the currency null.
    """
    states = FILTERS.get(chosen, QUEUE_STATES)
    wanted = requirements.where(F.col("state").isin(*states)).select("workspace_id", F.col("id").alias("requirement_id"), "transaction_id", "state")
    paid = transactions.select(F.col("id").alias("transaction_id"), "value_date", "account_id", "amount_minor", "description")
    rows = wanted.join(paid, "transaction_id").join(accounts.select(F.col("id").alias("account_id"), F.col("currency").alias("account_currency")), "account_id", "left")
    rank = F.array_position(F.array(*map(F.lit, QUEUE_STATES)), F.col("state"))
    return placed_by(rows, ["workspace_id"], [rank, F.col("value_date"), id_range(F.col("requirement_id"))], [rank, "value_date", "requirement_id"])


def counts(transactions: DataFrame, questions: DataFrame) -> DataFrame:
    """Payments processed and questions still open, by workspace."""
    done = transactions.groupBy("workspace_id").agg(F.count("*").alias("transactions_processed"))
    asked = questions.where("not answered").groupBy("workspace_id").agg(F.count("*").alias("open_questions"))
    return done.join(asked, "workspace_id", "full").fillna(0, ["transactions_processed", "open_questions"])


def blocked_by_mailbox(requirements: DataFrame, searches: DataFrame) -> DataFrame:
    blocked = requirements.where("state = 'BLOCKED' and method is null").select(F.col("id").alias("requirement_id"))
    return searches.where("outcome = 'NEEDS_REAUTH'").join(blocked, "requirement_id", "left_semi").groupBy("connection_id").agg(F.count("*").alias("blocked"))


def accounts_covered(accounts: DataFrame, statements: DataFrame) -> DataFrame:
    done = statements.where("state = 'COMPLETED'").select(F.col("account_id").alias("id"))
    return accounts.join(done, "id", "left_semi").select("workspace_id", "id", F.concat_ws(" ", "bank_name", "account_identifier").alias("name"))


def coverage(statements: DataFrame) -> DataFrame:
    """The span of completed statements by workspace, each end by itself."""
    return statements.where("state = 'COMPLETED'").groupBy("workspace_id").agg(F.min("period_start").alias("coverage_start"), F.max("period_end").alias("coverage_end"))


def latest(rows: DataFrame, key: str, when: str, *columns: str) -> DataFrame:
    """The newest row of each key (the greater id among equals)."""
    newest = rows.groupBy(key).agg(F.max(F.struct(F.col(when), F.col("id"), *[F.col(c) for c in columns if c not in (when, "id")])).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in dict.fromkeys(("id", when, *columns))])


def documents_of(transactions: DataFrame, requirements: DataFrame, invoices: DataFrame, invoice_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """transaction_id, document_id, filename: the resolving document, else the invoice's primary one, else the oldest linked directly.

    A document that is gone falls through to the next kind.
    """
    resolved = requirements.where("resolved_document_id is not null").select("transaction_id", F.col("resolved_document_id").alias("document_id"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("place"))
    linked = invoices.where("transaction_id is not null").select(F.col("id").alias("invoice_id"), "transaction_id")
    via = linked.join(invoice_documents, "invoice_id").select("transaction_id", "document_id", F.lit(2).alias("tier"), F.when(F.col("is_primary"), 0).otherwise(1).cast("long").alias("place"))
    direct = documents.where("transaction_id is not null").select("transaction_id", F.col("id").alias("document_id"), F.lit(3).alias("tier"), F.unix_date("created_on").cast("long").alias("place"))
    found = resolved.unionByName(via).unionByName(direct).join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    best = found.groupBy("transaction_id").agg(F.min(F.struct("tier", "place", "document_id", "filename")).alias("best"))
    return best.join(transactions.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi").select("transaction_id", "best.document_id", "best.filename")


def export_rows(transactions: DataFrame, requirements: DataFrame, accounts: DataFrame, documents: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per payment with the export's twelve columns."""
    asked = questions.where("not answered").select("transaction_id").distinct().withColumn("asked", F.lit(True))
    need = requirements.select("transaction_id", "state", "method", "vendor_guess", F.col("reason").alias("why"), bucket(F.col("state"), F.col("method")).alias("bucket"))
    rows = transactions.withColumnRenamed("id", "transaction_id").join(need, "transaction_id", "left").join(asked, "transaction_id", "left").join(documents, "transaction_id", "left")
    rows = rows.join(accounts.select(F.col("id").alias("account_id"), "bank_name", "account_identifier"), "account_id", "left")
    needed = F.when(F.col("bucket") == "notRequired", "No — marked by you").when(F.col("bucket").isNotNull(), "Yes").when(F.col("asked"), "Waiting for your answer").otherwise("No document identified as needed")
    return rows.select(
        "transaction_id",
        F.col("value_date").alias("date"),
        F.coalesce(F.concat_ws(" ", "bank_name", "account_identifier"), F.lit("")).alias("account"),
        "description",
        F.when(F.col("direction") == "DEBIT", "Debit").otherwise("Credit").alias("direction"),
        major_units(F.col("amount_minor"), F.col("currency")).alias("amount"),
        "currency",
        F.col("vendor_guess").alias("vendor"),
        needed.alias("document_needed"),
        _wording(STATUS, F.col("bucket")).alias("status"),
        F.when(F.col("bucket") == "matched", _wording(HOW_RESOLVED, F.col("method"))).alias("how_resolved"),
        F.col("why").alias("reason"),
        F.col("document_id").alias("document"),
    )


def export_order() -> list[Column]:
    """By date, then account and description as people order words: lower case first, marks before letters."""
    return [F.col("date"), F.collate("account", "UNICODE"), F.collate("description", "UNICODE")]


def placed(rows: DataFrame) -> DataFrame:
    """Export rows with their place within the workspace, equal ones by payment."""
    return placed_by(rows, ["workspace_id"], [F.col("date")], [*export_order(), "transaction_id"])


def generated(requests: DataFrame, transactions: DataFrame, name: str = "tallyline-reconciliation") -> DataFrame:
    """Exports (id, workspace_id, state, requested_on) after a run: such as are GENERATING become READY with the payments they hold and where the file lies.

    Finished and failed ones stay as they are, so a second attempt changes nothing.
    """
    held = transactions.groupBy("workspace_id").agg(F.count("*").alias("n"))
    now = F.col("state") == "GENERATING"
    filename = F.concat(F.lit(f"{name}-"), F.date_format("requested_on", "yyyy-MM-dd"), F.lit(".xlsx"))
    key = F.concat(F.lit("workspaces/"), F.col("workspace_id").cast("string"), F.lit("/exports/"), F.col("id").cast("string"), F.lit("/"), filename)
    rows = requests.join(held, "workspace_id", "left")
    return rows.select(
        "id", "workspace_id", F.when(now, "READY").otherwise(F.col("state")).alias("state"), filename.alias("filename"), F.when(now, key).alias("storage_key"),
        F.when(now, F.coalesce("n", F.lit(0))).alias("transaction_count"), now.alias("generated"),
    )
