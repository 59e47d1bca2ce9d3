"""Evidence that an invoice belongs to a payment: five findings, their strength, their wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import flatten
from ..thresholds import CANDIDATE_DAYS_AFTER, CANDIDATE_DAYS_BEFORE

#: What each agreement adds to a candidate's strength.
STRENGTH = {
    "amount": {"EXACT": 100, "NEAR": 40, "FX_BAND": 20},
    "vendor": {"RESOLVED": 80, "ALIAS": 70, "NORMALIZED_CONTAINS": 50},
    "date": {"SAME_DAY": 30, "WITHIN_WINDOW": 15},
    "number": {"IN_EXTERNAL_REFERENCE": 90, "IN_DESCRIPTION": 60},
    "currency": {"SAME": 10},
}


def amount_agreement(total: Column, invoice_currency: Column, paid: Column, currency: Column) -> Column:
    """NEAR is within one percent; an unknown or other currency is an FX_BAND."""
    delta = paid - total
    return (
        F.when(total.isNull(), "DIFFERENT")
        .when(~invoice_currency.eqNullSafe(currency), "FX_BAND")
        .when(delta == 0, "EXACT")
        .when(F.abs(delta) * 100 <= total, "NEAR")
        .otherwise("DIFFERENT")
    )


def date_agreement(offset: Column) -> Column:
    """offset: days from the invoice to the payment."""
    return F.when(offset == 0, "SAME_DAY").when(offset.between(-CANDIDATE_DAYS_BEFORE, CANDIDATE_DAYS_AFTER), "WITHIN_WINDOW").otherwise("OUTSIDE")


def number_agreement(number: Column, reference: Column, description: Column) -> Column:
    return number_found(flatten(number), flatten(reference), flatten(description))


def number_found(key: Column, reference: Column, description: Column) -> Column:
    """number_agreement of texts that have been flattened."""
    return (
        F.when(key.isNull() | (key == ""), "ABSENT")
        .when(F.coalesce(F.contains(reference, key), F.lit(False)), "IN_EXTERNAL_REFERENCE")
        .when(F.contains(description, key), "IN_DESCRIPTION")
        .otherwise("NOT_PRESENT")
    )


def currency_agreement(invoice_currency: Column, currency: Column) -> Column:
    return F.when(invoice_currency.isNull(), "UNKNOWN").when(invoice_currency == currency, "SAME").otherwise("DIFFERENT")


def strength(findings: dict[str, Column] | None = None) -> Column:
    """Of the findings amount, vendor, date, number and currency, else of the columns of these names: a sort key, nothing more."""
    score = F.lit(0)
    for finding, points in STRENGTH.items():
        said, part = findings[finding] if findings else F.col(finding), F.lit(0)
        for agreement, n in points.items():
            part = F.when(said == agreement, n).otherwise(part)
        score = score + part
    return score


def _days(n: Column) -> Column:
    return F.concat(F.abs(n).cast("string"), F.when(F.abs(n) == 1, " day").otherwise(" days"))


def sentences() -> Column:
    """The findings in words, in fixed order; an absent number and an equal currency say nothing."""
    amount = (
        F.when(F.col("amount") == "EXACT", "Amount matches exactly")
        .when(F.col("amount") == "NEAR", "Amount is close but not exact")
        .when(F.col("amount") == "FX_BAND", "Amount is in a different currency")
        .when(F.col("total_minor").isNull(), "No amount was read from this document")
        .otherwise("Amount does not match")
    )
    offset = F.col("offset_days")
    date = (
        F.when(F.col("date") == "SAME_DAY", "Dated the same day as the transaction")
        .when(F.col("date") == "WITHIN_WINDOW", F.concat(F.lit("Dated "), _days(offset), F.when(offset > 0, " before the transaction").otherwise(" after the transaction")))
        .when(offset.isNull(), "No date was read from this document")
        .otherwise("Dated well away from the transaction")
    )
    text = F.col("description")
    vendor = (
        F.when(F.col("vendor") == "RESOLVED", F.concat(F.lit("Vendor matches "), text, F.lit(" in the transaction description")))
        .when(F.col("vendor") == "ALIAS", F.concat(F.lit("Vendor is a known alias of "), text))
        .when(F.col("vendor") == "NORMALIZED_CONTAINS", F.concat(F.lit("Vendor name appears in "), text))
        .otherwise("Vendor does not match the transaction description")
    )
    number = (
        F.when(F.col("number") == "IN_EXTERNAL_REFERENCE", "Invoice number appears in the bank's reference")
        .when(F.col("number") == "IN_DESCRIPTION", "Invoice number appears in the transaction description")
        .when(F.col("number") == "NOT_PRESENT", "Invoice number not present in the transaction description")
    )
    currency = F.when(F.col("currency") == "DIFFERENT", F.concat(F.lit("Invoice is in "), F.col("invoice_currency"), F.lit(", the payment in "), F.col("transaction_currency"))).when(
        F.col("currency") == "UNKNOWN", "No currency was read from this document"
    )
    return F.array_compact(F.array(amount, date, vendor, number, currency))
