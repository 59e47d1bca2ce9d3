"""Writing results: the reconciliation export and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import export_order

#: The export's columns, in order.
COLUMNS = ("date", "account", "description", "direction", "amount", "currency", "vendor", "document_needed", "status", "how_resolved", "reason", "document")


def write_export(rows: DataFrame, path: str, origin: str, form: str = "csv") -> None:
    """Writes export rows by date, account and description, with a link for each document, as CSV or Parquet.

    Dates and exact amounts are text in CSV. origin is the site that serves documents; one
    that isn't http or https gives no links.
    """
    served = F.lit(origin).rlike("^https?://[^/]+$")
    link = F.when(F.col("document").isNotNull() & served, F.concat(F.lit(f"{origin}/documents/"), F.col("document").cast("string")))
    ordered = rows.withColumn("document", link).orderBy(*export_order()).select(*COLUMNS)
    writer = ordered.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One row per figure: workspace, figure, value."""
    figures = [c for c in summary.columns if c != "workspace_id"]
    summary.unpivot("workspace_id", figures, "figure", "value").write.mode("overwrite").option("header", True).csv(path)
