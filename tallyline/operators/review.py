"""What a reviewer sees and does: candidates with their documents and mail, and the decisions' effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evidence import sentences


def primary_documents(invoice_documents: DataFrame) -> DataFrame:
    """invoice_id, document_id: the primary document, else the first."""
    order = F.struct(F.when(F.col("is_primary"), 0).otherwise(1).alias("o"), F.col("document_id"))
    return invoice_documents.groupBy("invoice_id").agg(F.min(order).alias("d")).select("invoice_id", "d.document_id")


def review_candidates(requirements: DataFrame, candidates: DataFrame, invoices: DataFrame, invoice_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """For each requirement under review, the invoices proposed for its payment, by rank and invoice. Such without a document are left out."""
    asked = requirements.where("state = 'NEEDS_REVIEW'").select(F.col("id").alias("requirement_id"), F.col("transaction_id").alias("transaction"))
    shown = asked.join(candidates.select("invoice", "transaction", "rank", "strength", "truncated"), "transaction")
    with_doc = shown.join(primary_documents(invoice_documents).withColumnsRenamed({"invoice_id": "invoice"}), "invoice").join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    full = with_doc.join(invoices.select(F.col("id").alias("invoice"), "vendor_name", "invoice_number", "total_minor"), "invoice")
    return full.withColumn("place", F.row_number().over(Window.partitionBy("requirement_id").orderBy("rank", "invoice")))


def considered(requirements: DataFrame, candidates: DataFrame, rejections: DataFrame) -> DataFrame:
    """What was done for each requirement under review: candidates considered, rejected before, whether any list was cut."""
    asked = requirements.where("state = 'NEEDS_REVIEW'").select(F.col("id").alias("requirement_id"), F.col("transaction_id").alias("transaction"))
    seen = candidates.groupBy("transaction").agg(F.count("*").alias("considered"), F.bool_or("truncated").alias("cut"))
    refused = rejections.groupBy(F.col("transaction_id").alias("transaction")).agg(F.count("*").alias("rejected"))
    rows = asked.join(seen, "transaction", "left").join(refused, "transaction", "left")
    return rows.select("requirement_id", F.coalesce("considered", F.lit(0)).alias("considered"), F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("cut", F.lit(False)).alias("cut"))


def searched_mailboxes(requirements: DataFrame, searches: DataFrame, connections: DataFrame) -> DataFrame:
    """The mailboxes searched for each requirement, by address; one that is gone is "a disconnected mailbox"."""
    asked = requirements.where("state in ('NEEDS_REVIEW', 'NOT_FOUND', 'BLOCKED')").select(F.col("id").alias("requirement_id"))
    rows = searches.join(asked, "requirement_id", "left_semi").join(connections.select(F.col("id").alias("connection_id"), "email"), "connection_id", "left")
    rows = rows.withColumn("email", F.coalesce("email", F.lit("a disconnected mailbox")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("requirement_id").orderBy("email", "connection_id"))).select("requirement_id", "email", "outcome", "messages_found", "place")


def reject(requirements: DataFrame, candidates: DataFrame, rejections: DataFrame) -> DataFrame:
    """transaction_id, document_id after every candidate document of a reviewed payment was rejected: old pairs and new, each once."""
    asked = requirements.where("state = 'NEEDS_REVIEW'").select(F.col("transaction_id").alias("transaction"))
    new = candidates.join(asked, "transaction", "left_semi").select(F.col("transaction").alias("transaction_id"), "document_id")
    return rejections.select("transaction_id", "document_id").union(new).distinct()


def keep_one(invoice_documents: DataFrame, duplicates: DataFrame) -> DataFrame:
    """invoice_documents after duplicates (invoice, of_invoice) gave theirs to the invoice they repeat; the smallest document becomes the primary one."""
    moved = invoice_documents.join(duplicates.select(F.col("invoice").alias("invoice_id"), "of_invoice"), "invoice_id", "left")
    rows = moved.select(F.coalesce("of_invoice", "invoice_id").alias("invoice_id"), "document_id", "is_primary", F.col("of_invoice").isNotNull().alias("moved")).groupBy("invoice_id", "document_id").agg(F.bool_or("is_primary").alias("is_primary"), F.bool_or("moved").alias("moved"))
    whole = Window.partitionBy("invoice_id")
    merged = F.bool_or("moved").over(whole)
    return rows.withColumn("is_primary", F.when(merged, F.col("document_id") == F.min("document_id").over(whole)).otherwise(F.col("is_primary"))).drop("moved")


def retrieved_mail(mails: DataFrame, mail_documents: DataFrame, connections: DataFrame) -> DataFrame:
    """requirement_id, document_id -> the mail it came in: the first by id; a mailbox that is gone is "a disconnected mailbox"."""
    rows = mails.join(mail_documents, F.col("email_id") == mails["id"])
    first = rows.groupBy("requirement_id", "document_id").agg(F.min(F.struct("email_id", "sender", "subject", "connection_id")).alias("m"))
    boxes = connections.select(F.col("id").alias("connection_id"), "email")
    named = first.select("requirement_id", "document_id", "m.*").join(boxes, "connection_id", "left")
    return named.select("requirement_id", "document_id", "email_id", "sender", "subject", F.coalesce("email", F.lit("a disconnected mailbox")).alias("mailbox"))


def page(requirements: DataFrame, candidates: DataFrame, invoices: DataFrame, invoice_documents: DataFrame, documents: DataFrame, rejections: DataFrame, mail: DataFrame) -> DataFrame:
    """What each requirement under review shows: proposed invoices by rank with their evidence and mail, then retrieved documents that couldn't be read.

    Documents rejected for the payment aren't shown again; those that are gone neither.
    """
    asked = requirements.where("state = 'NEEDS_REVIEW'").select(F.col("id").alias("requirement_id"), "transaction_id")
    primary = primary_documents(invoice_documents).withColumnRenamed("invoice_id", "invoice")
    proposed = candidates.select("invoice", F.col("transaction").alias("transaction_id"), "rank", F.array_join(sentences(), "\n").alias("evidence")).join(asked, "transaction_id").join(primary, "invoice")
    null = F.lit(None).cast("long")
    unread = documents.where("state = 'UNREADABLE' and transaction_id is null").select(F.col("id").alias("document_id"))
    found = mail.select("requirement_id", "document_id").join(unread, "document_id", "left_semi").join(asked, "requirement_id")
    columns = ["requirement_id", "transaction_id", "document_id"]
    rows = proposed.select(*columns, "invoice", F.lit(0).alias("tier"), "rank", "evidence").unionByName(
        found.select(*columns, null.alias("invoice"), F.lit(1).alias("tier"), F.lit(0).alias("rank"), F.lit("We couldn't read the details from this document").alias("evidence"))
    )
    rows = rows.join(rejections, ["transaction_id", "document_id"], "left_anti").join(documents.select(F.col("id").alias("document_id"), "filename", "source"), "document_id")
    fields = ["vendor_name", "invoice_number", "invoice_date", "total_minor", "currency"]
    rows = rows.join(invoices.select(F.col("id").alias("invoice"), *fields), "invoice", "left").join(mail.drop("email_id"), ["requirement_id", "document_id"], "left")
    place = F.row_number().over(Window.partitionBy("requirement_id").orderBy("tier", "rank", "invoice", "document_id"))
    preview = F.concat(F.lit("/api/documents/"), F.col("document_id").cast("string"))
    return rows.select("requirement_id", "invoice", "document_id", "filename", "source", *fields, "evidence", preview.alias("preview"), "sender", "subject", "mailbox", place.alias("place"))
