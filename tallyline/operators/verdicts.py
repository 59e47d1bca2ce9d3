"""Checks on what readers and judges answer, before anything rests on it.

Each function gives the list of what is wrong with a row, empty if it may be used.
A malformed answer counts as none: it is left out, never repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SHAPES = ("DEBIT_CREDIT", "SIGNED_AMOUNT", "AMOUNT_WITH_INDICATOR")


def _problems(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def mapping_problems() -> Column:
    """A mapping of columns: which are required and which must be empty depends on amount_shape; places count from 0."""
    pair, indicated = F.col("amount_shape") == "DEBIT_CREDIT", F.col("amount_shape") == "AMOUNT_WITH_INDICATOR"
    wanted = {"debit_column": pair, "credit_column": pair, "amount_column": ~pair, "indicator_column": indicated}
    by_shape = [
        F.when(F.col("amount_shape").isin(*SHAPES) & (wants == F.col(c).isNull()), F.concat(F.lit(f"{c} "), F.when(wants, "is required").otherwise("must be null"), F.lit(" when amount_shape is "), F.col("amount_shape")))
        for c, wants in wanted.items()
    ]
    places = [F.when(F.col(c) < 0, f"{c} must not be negative") for c in ("header_row", "reference_column", "balance_column", *wanted)]
    required = [F.when(~_holds(F.col(c) >= 0), f"{c} must be a place") for c in ("first_data_row", "date_column")]
    chosen = {"amount_shape": SHAPES, "date_order": ("DMY", "MDY", "YMD"), "decimal_separator": (".", ",")}
    unknown = [F.when(~_holds(F.col(c).isin(*values)), f"{c} is unknown") for c, values in chosen.items()]
    texts = F.when(~_holds((F.size("description_columns") > 0) & F.forall("description_columns", lambda x: F.coalesce(x >= 0, F.lit(False)))), "description_columns must be places")
    return _problems(*required, *unknown, texts, *places, *by_shape)


def judgement_problems() -> Column:
    """A judgement on a payment: a reason if it needs a document; a question with two answers or more exactly if unsure, which then asks and needs nothing."""
    needs, sure = _holds(F.col("needs_document")), _holds(F.col("confident"))
    asks = F.col("question").isNotNull()
    return _problems(
        F.when(needs & F.col("reason").isNull(), "reason is required when needs_document is true"),
        F.when(~sure & ~asks, "clarification is required when confident is false"),
        F.when(~sure & needs, "needs_document must be false when confident is false; ask instead"),
        F.when(sure & asks, "clarification must be null when confident is true"),
        F.when(asks & ((F.col("question") == "") | ~_holds(F.size("options") >= 2) | _holds(F.exists("options", lambda o: F.coalesce(o == "", F.lit(True))))), "clarification must be a question with two answers or more"),
    )


def adjudication_problems() -> Column:
    """A choice among payments: SAME names one, DIFFERENT names none, and there is a reason."""
    return _problems(
        F.when(~_holds(F.col("verdict").isin("SAME", "UNSURE", "DIFFERENT")), "verdict is unknown"),
        F.when(F.col("candidate") < 0, "candidate must not be negative"),
        F.when(~_holds(F.col("reason") != ""), "reason is required"),
        F.when((F.col("verdict") == "SAME") & F.col("candidate").isNull(), "Choose the payment you mean, or answer DIFFERENT."),
        F.when((F.col("verdict") == "DIFFERENT") & F.col("candidate").isNotNull(), "DIFFERENT means none of these payments. Leave the candidate empty."),
    )


def same_invoice_problems() -> Column:
    return _problems(F.when(~_holds(F.col("same").isin("YES", "UNSURE", "NO")), "same is unknown"), F.when(~_holds(F.col("reason") != ""), "reason is required"))


def identification_problems() -> Column:
    """What a document says of itself: a known kind, a currency of three letters, days as YYYY-MM-DD, each of the last two if any."""
    day = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    return _problems(
        F.when(~_holds(F.col("document_kind").isin("BANK_STATEMENT", "CREDIT_CARD_STATEMENT", "SOMETHING_ELSE")), "document_kind is unknown"),
        F.when(F.length("currency") != 3, "currency must have three letters"),
        *[F.when(~F.col(c).rlike(day), f"{c} must be a day") for c in ("period_start", "period_end")],
    )


def printing_problems() -> Column:
    """How a document prints dates and amounts: one of the known ways."""
    return _problems(*_printing_problems())


def _printing_problems() -> list[Column]:
    chosen = {"date_order": ("DMY", "MDY", "YMD"), "decimal_separator": (".", ",")}
    return [F.when(~_holds(F.col(c).isin(*values)), f"{c} is unknown") for c, values in chosen.items()]


def scanned_problems() -> Column:
    """A row read from a scan, with how its statement prints dates and amounts: a date and a description are texts."""
    return _problems(*_printing_problems(), *[F.when(F.col(c).isNull(), f"{c} is required") for c in ("date", "description")])


def reading_problems(invoice_date: Column | None = None) -> Column:
    """A reading of an invoice (its printed date in invoice_date, or in the column given): a reason; printed texts and aliases that aren't empty; no amounts and number where it is none; a currency with a total.

    The sentences of the last two are fixed wording.
    """
    figures = ("total", "tax", "subtotal", "invoice_number")
    return _problems(
        F.when(~_holds(F.col("classification").isin("IS_INVOICE", "UNCERTAIN", "IS_NOT_INVOICE")), "classification is unknown"),
        F.when(~_holds(F.col("reason") != ""), "reason is required"),
        *_printing_problems(),
        *[F.when(t == "", f"{c} must not be empty") for c, t in (("invoice_date", F.col("invoice_date") if invoice_date is None else invoice_date), *((c, F.col(c)) for c in figures[:3]))],
        F.when(_holds(F.exists("aliases", lambda a: F.coalesce(a == "", F.lit(True)))), "aliases must not be empty"),
        *[F.when((F.col("classification") == "IS_NOT_INVOICE") & F.col(c).isNotNull(), f"{c} must be null when the document is not an invoice") for c in figures],
        F.when(F.col("total").isNotNull() & F.col("currency").isNull(), "currency is required when a total was found"),
    )


def usable(rows: DataFrame, problems: Column, watch: Observation | None = None) -> DataFrame:
    """The rows that may be used. watch gets how many answers there were and how many of them were refused, as the rows go by."""
    if watch is not None:
        rows = rows.observe(watch, F.count(F.lit(1)).alias("answers"), F.count_if(F.size(problems) > 0).alias("refused"))
    return rows.where(F.size(problems) == 0)


def malformed(rows: DataFrame, problems: Column, *columns: str) -> DataFrame:
    """columns and problems (one text) of the rows that can't be used."""
    return rows.withColumn("problems", problems).where(F.size("problems") > 0).select(*columns, F.array_join("problems", "; ").alias("problems"))
