"""Queries on matching, reports and exports."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.money import format_amount
from ..functions.text import knowledge_key, normalize_description, reference, safe_filename, vendor_key
from ..operators import matching as M
from ..operators import report as R
from ..operators.evidence import sentences
from .domain import load, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL that says the same."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            # Days go out as ISO text, on either side alike.
            return out.withColumns({c: F.col(c).cast("string") for c, t in out.dtypes if t == "date"})

        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str, names: str) -> list[DataFrame]:
    return [load(spark, sf_dir, n) for n in names.split()]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return M.candidates(*_tables(spark, d, "invoices transactions aliases rejections"))


FLAT = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
CANDIDATES = """
WITH window_pairs AS (
  SELECT i.id AS invoice, i.workspace_id, i.document_id, i.vendor_id, i.vendor_key, i.invoice_number, i.total_minor, i.currency AS invoice_currency, t.id AS transaction,
    t.amount_minor, t.currency AS transaction_currency, t.description, t.description_normalized, t.external_reference, t.value_date - i.invoice_date AS offset_days,
    row_number() OVER (PARTITION BY i.id ORDER BY abs(t.value_date - i.invoice_date), t.id) AS place
  FROM invoices i JOIN transactions t ON t.workspace_id = i.workspace_id AND t.direction = 'DEBIT' AND t.value_date BETWEEN i.invoice_date - 3 AND i.invoice_date + 10),
capped AS (SELECT *, max(place) OVER (PARTITION BY invoice) >= 200 AS truncated FROM window_pairs WHERE place <= 200),
open_pairs AS (SELECT * FROM capped p WHERE NOT EXISTS (SELECT 1 FROM invoices h WHERE h.transaction_id = p.transaction AND h.id <> p.invoice)
  AND NOT EXISTS (SELECT 1 FROM rejections r WHERE r.transaction_id = p.transaction AND r.document_id = p.document_id)),
known AS (SELECT p.invoice, p.transaction, bool_or(a.confirmed) AS confirmed FROM open_pairs p JOIN aliases a ON a.workspace_id = p.workspace_id AND a.vendor_id = p.vendor_id
  AND contains(regexp_replace(p.description_normalized, '[^a-z0-9]', '', 'g'), a.alias_normalized) GROUP BY 1, 2),
evidence AS (
  SELECT p.*, p.amount_minor - p.total_minor AS delta_minor,
    CASE WHEN total_minor IS NULL THEN 'DIFFERENT' WHEN invoice_currency IS DISTINCT FROM transaction_currency THEN 'FX_BAND' WHEN amount_minor = total_minor THEN 'EXACT'
      WHEN abs(amount_minor - total_minor) * 100 <= total_minor THEN 'NEAR' ELSE 'DIFFERENT' END AS amount,
    CASE WHEN offset_days = 0 THEN 'SAME_DAY' WHEN offset_days BETWEEN -3 AND 10 THEN 'WITHIN_WINDOW' ELSE 'OUTSIDE' END AS date,
    CASE WHEN k.confirmed THEN 'RESOLVED' WHEN k.invoice IS NOT NULL THEN 'ALIAS' WHEN contains(regexp_replace(description_normalized, '[^a-z0-9]', '', 'g'), vendor_key) THEN 'NORMALIZED_CONTAINS' ELSE 'NONE' END AS vendor,
    CASE WHEN invoice_number IS NULL THEN 'ABSENT' WHEN contains(regexp_replace(lower(external_reference), '[^a-z0-9]', '', 'g'), regexp_replace(lower(invoice_number), '[^a-z0-9]', '', 'g')) THEN 'IN_EXTERNAL_REFERENCE'
      WHEN contains(regexp_replace(lower(description), '[^a-z0-9]', '', 'g'), regexp_replace(lower(invoice_number), '[^a-z0-9]', '', 'g')) THEN 'IN_DESCRIPTION' ELSE 'NOT_PRESENT' END AS number,
    CASE WHEN invoice_currency IS NULL THEN 'UNKNOWN' WHEN invoice_currency = transaction_currency THEN 'SAME' ELSE 'DIFFERENT' END AS currency
  FROM open_pairs p LEFT JOIN known k ON k.invoice = p.invoice AND k.transaction = p.transaction),
scored AS (
  SELECT *, CASE amount WHEN 'EXACT' THEN 100 WHEN 'NEAR' THEN 40 WHEN 'FX_BAND' THEN 20 ELSE 0 END + CASE vendor WHEN 'RESOLVED' THEN 80 WHEN 'ALIAS' THEN 70 WHEN 'NORMALIZED_CONTAINS' THEN 50 ELSE 0 END
    + CASE date WHEN 'SAME_DAY' THEN 30 WHEN 'WITHIN_WINDOW' THEN 15 ELSE 0 END + CASE number WHEN 'IN_EXTERNAL_REFERENCE' THEN 90 WHEN 'IN_DESCRIPTION' THEN 60 ELSE 0 END + CASE WHEN currency = 'SAME' THEN 10 ELSE 0 END AS strength
  FROM evidence WHERE amount <> 'DIFFERENT' OR vendor <> 'NONE'),
candidates AS (SELECT *, row_number() OVER (PARTITION BY invoice ORDER BY strength DESC, transaction) - 1 AS rank FROM scored QUALIFY rank < 5)
"""
SHOWN = "invoice, transaction, rank, strength, amount, date, vendor, number, currency, delta_minor, offset_days, truncated"


@query("match_candidates", CANDIDATES + f"SELECT {SHOWN.replace('rank', 'CAST(rank AS INTEGER) AS rank').replace('strength', 'CAST(strength AS INTEGER) AS strength')} FROM candidates")
def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select(*SHOWN.split(", "))


SENTENCES = """
SELECT invoice, transaction, array_to_string(list_filter([
  CASE amount WHEN 'EXACT' THEN 'Amount matches exactly' WHEN 'NEAR' THEN 'Amount is close but not exact' WHEN 'FX_BAND' THEN 'Amount is in a different currency' ELSE CASE WHEN total_minor IS NULL THEN 'No amount was read from this document' ELSE 'Amount does not match' END END,
  CASE date WHEN 'SAME_DAY' THEN 'Dated the same day as the transaction' WHEN 'WITHIN_WINDOW' THEN 'Dated ' || abs(offset_days) || CASE WHEN abs(offset_days) = 1 THEN ' day' ELSE ' days' END || CASE WHEN offset_days > 0 THEN ' before' ELSE ' after' END || ' the transaction' ELSE 'Dated well away from the transaction' END,
  CASE vendor WHEN 'RESOLVED' THEN 'Vendor matches ' || description || ' in the transaction description' WHEN 'ALIAS' THEN 'Vendor is a known alias of ' || description WHEN 'NORMALIZED_CONTAINS' THEN 'Vendor name appears in ' || description ELSE 'Vendor does not match the transaction description' END,
  CASE number WHEN 'IN_EXTERNAL_REFERENCE' THEN 'Invoice number appears in the bank''s reference' WHEN 'IN_DESCRIPTION' THEN 'Invoice number appears in the transaction description' WHEN 'NOT_PRESENT' THEN 'Invoice number not present in the transaction description' END,
  CASE currency WHEN 'DIFFERENT' THEN 'Invoice is in ' || invoice_currency || ', the payment in ' || transaction_currency WHEN 'UNKNOWN' THEN 'No currency was read from this document' END],
  lambda x: x IS NOT NULL), chr(10)) AS sentences FROM candidates"""


@query("match_evidence_sentences", CANDIDATES + SENTENCES)
def match_evidence_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("invoice", "transaction", F.array_join(sentences(), "\n").alias("sentences"))


DUPLICATES = """
dup_pairs AS (
  SELECT a.id AS invoice, b.id AS of_id, b.created_on AS of_on, a.invoice_number IS NULL AND b.invoice_number IS NULL AS numberless,
    coalesce(a.total_minor = b.total_minor AND a.currency = b.currency, false) AS s_total, coalesce(abs(a.invoice_date - b.invoice_date) <= 2, false) AS s_date,
    coalesce(regexp_replace(lower(a.invoice_number), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b.invoice_number), '[^a-z0-9]', '', 'g') AND regexp_replace(lower(a.invoice_number), '[^a-z0-9]', '', 'g') <> '', false) AS s_number
  FROM invoices a JOIN invoices b ON a.vendor_id = b.vendor_id AND a.workspace_id = b.workspace_id AND (b.created_on < a.created_on OR (b.created_on = a.created_on AND b.id < a.id))),
dup_agreed AS (SELECT *, list_filter(['vendor', CASE WHEN s_total THEN 'amount' END, CASE WHEN s_date THEN 'date' END, CASE WHEN s_number THEN 'invoice number' END], lambda x: x IS NOT NULL) AS agreed,
  s_total AND s_date AND (s_number OR numberless) AS decisive FROM dup_pairs),
dup_flagged AS MATERIALIZED (SELECT p.*, v.same, v.reason AS said, 'Same ' || array_to_string(agreed[:-2], ', ') || CASE WHEN len(agreed) > 1 THEN ' and ' ELSE '' END || agreed[-1] AS words
  FROM dup_agreed p LEFT JOIN duplicate_verdicts v ON v.incoming_id = p.invoice AND v.existing_id = p.of_id WHERE decisive OR (len(agreed) >= 2 AND coalesce(v.same <> 'NO', true))),
dup_links AS (SELECT o.vendor_id, o.workspace_id, o.id, row_number() OVER (PARTITION BY o.vendor_id, o.workspace_id ORDER BY o.created_on, o.id) AS k, coalesce(f.ofs, []) AS ofs
  FROM invoices o LEFT JOIN (SELECT invoice, list(of_id) AS ofs FROM dup_flagged GROUP BY 1) f ON f.invoice = o.id WHERE o.vendor_id IS NOT NULL),
dup_walk(vendor_id, workspace_id, k, originals) AS (SELECT DISTINCT vendor_id, workspace_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM dup_links
  UNION ALL SELECT l.vendor_id, l.workspace_id, l.k, CASE WHEN list_has_any(l.ofs, w.originals) THEN w.originals ELSE list_append(w.originals, l.id) END
  FROM dup_walk w JOIN dup_links l ON l.vendor_id = w.vendor_id AND l.workspace_id = w.workspace_id AND l.k = w.k + 1),
dup_originals AS (SELECT unnest(arg_max(originals, k)) AS id FROM dup_walk GROUP BY vendor_id, workspace_id),
duplicates AS (SELECT invoice, of_id AS of_invoice, CASE WHEN decisive THEN words WHEN same IS NULL THEN words || ', and we could not check the rest' ELSE said END AS reason
  FROM dup_flagged WHERE of_id IN (SELECT id FROM dup_originals) QUALIFY row_number() OVER (PARTITION BY invoice ORDER BY of_on, of_id) = 1)
"""


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    return M.duplicates(*_tables(spark, d, "invoices duplicate_verdicts"))


@query("invoice_duplicates", "WITH " + DUPLICATES + "SELECT * FROM duplicates")
def invoice_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _duplicates(spark, d)


FLAT_AGREES = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') = regexp_replace(lower({1}), '[^a-z0-9]', '', 'g')"


@query(
    "duplicate_comparison",
    "WITH " + DUPLICATES + """, c AS (
  SELECT d.invoice, d.of_invoice, f.field, CASE f.field WHEN 'Vendor' THEN e.vendor_name WHEN 'Invoice number' THEN e.invoice_number WHEN 'Date' THEN CAST(e.invoice_date AS VARCHAR) ELSE coalesce(e.currency, '?') || ' ' || e.total_minor END AS existing,
    CASE f.field WHEN 'Vendor' THEN i.vendor_name WHEN 'Invoice number' THEN i.invoice_number WHEN 'Date' THEN CAST(i.invoice_date AS VARCHAR) ELSE coalesce(i.currency, '?') || ' ' || i.total_minor END AS incoming
  FROM duplicates d JOIN invoices e ON e.id = d.of_invoice JOIN invoices i ON i.id = d.invoice, (VALUES ('Vendor'), ('Invoice number'), ('Date'), ('Amount')) f(field))
SELECT *, CAST(""" + FLAT_AGREES.format("existing", "incoming") + " AS VARCHAR) AS agrees FROM c",
)
def duplicate_comparison(spark: SparkSession, d: str) -> DataFrame:
    invoices = load(spark, d, "invoices")
    return M.compare_fields(invoices, invoices, _duplicates(spark, d)).withColumn("agrees", F.col("agrees").cast("string"))


DECISIONS = (
    CANDIDATES + ", " + DUPLICATES + """, said AS (SELECT * FROM adjudications WHERE coalesce(reason, '') <> '' AND NOT (verdict = 'DIFFERENT' AND candidate IS NOT NULL)),
facts AS (
  SELECT i.id AS invoice, c.transaction, c.n, c.truncated, c.currency, c.delta_minor, c.offset_days, c.vendor, d.invoice IS NOT NULL AS dup, v.verdict, v.candidate
  FROM invoices i LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY invoice) AS n FROM candidates QUALIFY rank = 0) c ON c.invoice = i.id
  LEFT JOIN duplicates d ON d.invoice = i.id LEFT JOIN said v ON v.invoice_id = i.id),
named AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN n <> 1 THEN 'one surviving candidate' WHEN truncated THEN 'the shortlist is exhaustive' WHEN dup THEN 'not a suspected duplicate'
  WHEN currency <> 'SAME' THEN 'the same currency' WHEN delta_minor IS NULL OR delta_minor <> 0 THEN 'the amount matches' WHEN abs(offset_days) > 3 THEN 'the dates are close'
  WHEN vendor NOT IN ('RESOLVED', 'ALIAS') THEN 'the vendor is known' WHEN verdict IS NULL OR verdict <> 'SAME' OR candidate IS NULL OR candidate <> 0 THEN 'the model agrees' END AS blocked_by FROM facts),
decided AS (SELECT invoice, CASE WHEN n IS NULL THEN 'NO_MATCH' WHEN blocked_by IS NULL THEN 'AUTO_MATCH' ELSE 'NEEDS_REVIEW' END AS kind, blocked_by,
  CASE WHEN n IS NOT NULL AND blocked_by IS NULL THEN transaction END AS transaction FROM named)
"""
)


def _matching(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Invoices, their candidates, suspected duplicates, and decisions. What several steps read is written once, so that no step makes it anew."""
    transactions, aliases, rejections, verdicts, adjudications = _tables(spark, d, "transactions aliases rejections duplicate_verdicts adjudications")
    invoices = cut(load(spark, d, "invoices"))
    candidates, duplicates = cut(M.candidates(invoices, transactions, aliases, rejections)), cut(M.duplicates(invoices, verdicts))
    return invoices, candidates, duplicates, M.decisions(invoices, candidates, duplicates, adjudications)


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d)[3]


@query("match_decisions", DECISIONS + "SELECT * FROM decided")
def match_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d)


@query(
    "match_links",
    DECISIONS + """, placed AS (SELECT d.*, row_number() OVER (PARTITION BY d.transaction ORDER BY d.invoice) AS place, (SELECT min(h.id) FROM invoices h WHERE h.transaction_id = d.transaction) AS holder FROM decided d WHERE kind = 'AUTO_MATCH'),
f AS (SELECT *, place = 1 AND (holder IS NULL OR holder = invoice) AS linked FROM placed)
SELECT invoice, transaction, linked, CASE WHEN NOT linked THEN 'That payment already has an invoice.' END AS reason FROM f""",
)
def match_links(spark: SparkSession, d: str) -> DataFrame:
    invoices, _, _, decided = _matching(spark, d)
    return M.links(decided, invoices)


@query(
    "linkable_transactions",
    """SELECT workspace_id, id, CAST(value_date AS VARCHAR) AS value_date, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY t.value_date DESC, id) AS INTEGER) AS place FROM transactions t
WHERE direction = 'DEBIT' AND NOT EXISTS (SELECT 1 FROM invoices i WHERE i.transaction_id = t.id) QUALIFY place <= 50""",
)
def linkable_transactions(spark: SparkSession, d: str) -> DataFrame:
    transactions, invoices = _tables(spark, d, "transactions invoices")
    return M.linkable(transactions.where("direction = 'DEBIT'"), [invoices.select("transaction_id")], "value_date").select("workspace_id", "id", "value_date", "place")


@query(
    "linkable_documents",
    """SELECT workspace_id, id, CAST(created_on AS VARCHAR) AS created_on, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY s.created_on DESC, id) AS INTEGER) AS place FROM supporting_documents s
WHERE transaction_id IS NULL AND NOT EXISTS (SELECT 1 FROM invoices i JOIN invoice_documents j ON j.invoice_id = i.id WHERE i.transaction_id IS NOT NULL AND j.document_id = s.id) QUALIFY place <= 50""",
)
def linkable_documents(spark: SparkSession, d: str) -> DataFrame:
    documents, invoices, joins = _tables(spark, d, "supporting_documents invoices invoice_documents")
    linked = joins.join(invoices.where("transaction_id is not null").select(F.col("id").alias("invoice_id")), "invoice_id", "left_semi").select("document_id")
    return M.linkable(documents.where("transaction_id is null"), [linked], "created_on").select("workspace_id", "id", "created_on", "place")


BUCKET = "CASE WHEN state = 'RESOLVED' THEN CASE WHEN method = 'NOT_REQUIRED' THEN 'notRequired' ELSE 'matched' END WHEN state = 'NOT_FOUND' THEN 'notFound' WHEN state = 'NEEDS_REVIEW' THEN 'needsReview' WHEN state = 'BLOCKED' THEN 'blocked' ELSE 'waiting' END"


@query(
    "report_summary",
    f"WITH b AS (SELECT workspace_id, {BUCKET} AS bucket FROM requirements) SELECT workspace_id, "
    + ", ".join(f'count(*) FILTER (bucket = \'{b}\') AS "{b}"' for b in R.BUCKETS)
    + ", count(*) FILTER (bucket <> 'notRequired') AS \"documentsRequired\" FROM b GROUP BY workspace_id",
)
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(load(spark, d, "requirements"))


QUEUE_SQL = """
SELECT r.workspace_id, r.id AS requirement_id, r.state, CAST(t.value_date AS VARCHAR) AS value_date, t.amount_minor, t.description, a.currency AS account_currency,
  CAST(row_number() OVER (PARTITION BY r.workspace_id ORDER BY CASE r.state WHEN 'NEEDS_REVIEW' THEN 0 WHEN 'NOT_FOUND' THEN 1 ELSE 2 END, t.value_date, r.id) AS INTEGER) AS place
FROM requirements r JOIN transactions t ON t.id = r.transaction_id LEFT JOIN accounts a ON a.id = t.account_id WHERE r.state IN ({0})"""
QUEUE_COLUMNS = ("workspace_id", "requirement_id", "state", "value_date", "amount_minor", "description", "account_currency", "place")


@query("report_queue", QUEUE_SQL.format("'NEEDS_REVIEW', 'NOT_FOUND', 'IDENTIFIED'"))
def report_queue(spark: SparkSession, d: str) -> DataFrame:
    return R.queue(*_tables(spark, d, "requirements transactions accounts")).select(*QUEUE_COLUMNS)


@query("report_queue_waiting", QUEUE_SQL.format("'IDENTIFIED'"))
def report_queue_waiting(spark: SparkSession, d: str) -> DataFrame:
    return R.queue(*_tables(spark, d, "requirements transactions accounts"), "waiting").select(*QUEUE_COLUMNS)


@query(
    "report_blocked_by_mailbox",
    "SELECT s.connection_id, count(*) AS blocked FROM searches s JOIN requirements r ON r.id = s.requirement_id WHERE s.outcome = 'NEEDS_REAUTH' AND r.state = 'BLOCKED' AND r.method IS NULL GROUP BY 1",
)
def report_blocked_by_mailbox(spark: SparkSession, d: str) -> DataFrame:
    return R.blocked_by_mailbox(*_tables(spark, d, "requirements searches"))


@query(
    "report_accounts_covered",
    "SELECT workspace_id, id, bank_name || ' ' || account_identifier AS name FROM accounts a WHERE EXISTS (SELECT 1 FROM statements s WHERE s.account_id = a.id AND s.state = 'COMPLETED')",
)
def report_accounts_covered(spark: SparkSession, d: str) -> DataFrame:
    return R.accounts_covered(*_tables(spark, d, "accounts statements"))


@query("coverage_span", "SELECT workspace_id, CAST(min(period_start) AS VARCHAR) AS coverage_start, CAST(max(period_end) AS VARCHAR) AS coverage_end FROM statements WHERE state = 'COMPLETED' GROUP BY 1")
def coverage_span(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(load(spark, d, "statements"))


@query("latest_statement", "SELECT batch_id, id, CAST(created_on AS VARCHAR) AS created_on, state FROM statements s QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY s.created_on DESC, id DESC) = 1")
def latest_statement(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(load(spark, d, "statements"), "batch_id", "created_on", "state")


DOCUMENTS = """
doc_tiers AS (
  SELECT transaction_id, resolved_document_id AS document_id, 1 AS tier, 0 AS place FROM requirements WHERE resolved_document_id IS NOT NULL
  UNION ALL SELECT i.transaction_id, j.document_id, 2, CASE WHEN j.is_primary THEN 0 ELSE 1 END FROM invoices i JOIN invoice_documents j ON j.invoice_id = i.id WHERE i.transaction_id IS NOT NULL
  UNION ALL SELECT transaction_id, id, 3, date_diff('day', DATE '1970-01-01', created_on) FROM supporting_documents WHERE transaction_id IS NOT NULL),
docs_of AS (SELECT x.transaction_id, x.document_id, s.filename FROM doc_tiers x JOIN supporting_documents s ON s.id = x.document_id JOIN transactions t ON t.id = x.transaction_id
  QUALIFY row_number() OVER (PARTITION BY x.transaction_id ORDER BY tier, place, document_id) = 1)
"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return R.documents_of(*_tables(spark, d, "transactions requirements invoices invoice_documents supporting_documents"))


@query("export_documents", "WITH " + DOCUMENTS + "SELECT * FROM docs_of")
def export_documents(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d)


@query(
    "export_rows",
    "WITH " + DOCUMENTS + f""", n AS (SELECT transaction_id, method, vendor_guess, reason, {BUCKET} AS bucket FROM requirements)
SELECT t.id AS transaction_id, CAST(t.value_date AS VARCHAR) AS date, coalesce(a.bank_name || ' ' || a.account_identifier, '') AS account, t.description, CASE WHEN t.direction = 'DEBIT' THEN 'Debit' ELSE 'Credit' END AS direction,
  CAST(t.amount_minor AS DOUBLE) / CASE WHEN t.currency = 'JPY' THEN 1 WHEN t.currency IN ('KWD', 'BHD') THEN 1000 ELSE 100 END AS amount, t.currency, n.vendor_guess AS vendor,
  CASE WHEN n.bucket = 'notRequired' THEN 'No — marked by you' WHEN n.bucket IS NOT NULL THEN 'Yes' WHEN EXISTS (SELECT 1 FROM questions q WHERE q.transaction_id = t.id AND NOT q.answered) THEN 'Waiting for your answer' ELSE 'No document identified as needed' END AS document_needed,
  CASE n.bucket WHEN 'matched' THEN 'Matched' WHEN 'notFound' THEN 'Not found' WHEN 'needsReview' THEN 'Needs review' WHEN 'waiting' THEN 'Waiting for a document' WHEN 'blocked' THEN 'Waiting on a mailbox' WHEN 'notRequired' THEN 'No document needed' END AS status,
  CASE WHEN n.bucket = 'matched' THEN CASE n.method WHEN 'AUTO_RETRIEVED' THEN 'Retrieved from email' WHEN 'AUTO_MATCHED' THEN 'Matched automatically' WHEN 'USER_CONFIRMED' THEN 'Confirmed by you' WHEN 'USER_LINKED' THEN 'Linked by you' END END AS how_resolved,
  n.reason, d.document_id AS document
FROM transactions t LEFT JOIN n ON n.transaction_id = t.id LEFT JOIN accounts a ON a.id = t.account_id LEFT JOIN docs_of d ON d.transaction_id = t.id""",
)
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    transactions, requirements, accounts, questions = _tables(spark, d, "transactions requirements accounts questions")
    rows = R.export_rows(transactions, requirements, accounts, _documents(spark, d), questions)
    return rows.withColumn("amount", F.col("amount").cast("double"))


@query(
    "format_amounts",
    r"""WITH e AS (SELECT id, amount_minor, currency, CASE WHEN currency = 'JPY' THEN 0 WHEN currency IN ('KWD', 'BHD') THEN 3 ELSE 2 END AS x FROM transactions),
p AS (SELECT *, CAST(amount_minor // CAST(pow(10, x) AS BIGINT) AS VARCHAR) AS w, lpad(CAST(amount_minor % CAST(pow(10, x) AS BIGINT) AS VARCHAR), x, '0') AS f FROM e)
SELECT id, coalesce(map {'INR': '₹', 'USD': '$', 'EUR': '€', 'GBP': '£', 'JPY': '¥'}[currency], currency || ' ')
  || CASE WHEN currency = 'INR' AND length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(left(w, length(w) - 3)), '(\d{2})', '\1,', 'g'), ',')) || ',' || right(w, 3)
       WHEN currency = 'INR' THEN w ELSE reverse(rtrim(regexp_replace(reverse(w), '(\d{3})', '\1,', 'g'), ',')) END || CASE WHEN x = 0 THEN '' ELSE '.' || f END AS formatted FROM p""",
)
def format_amounts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "transactions").select("id", format_amount(F.col("amount_minor"), F.col("currency")).alias("formatted"))


@query(
    "normalize_descriptions",
    r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'))) AS normalized, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS knowledge_key FROM documents""",
)
def normalize_descriptions(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.md5(normalize_description(F.col("text"))).alias("normalized"), F.md5(F.coalesce(knowledge_key(F.col("text")), F.when(F.col("text").isNotNull(), ""))).alias("knowledge_key"))


SUFFIX = r"(?:[\s.,]+(?:limited[\s.]+liability[\s.]+partnership|public[\s.]+limited[\s.]+company|private[\s.]+limited|pvt[\s.]+limited|incorporated|private[\s.]+ltd|corporation|pte[\s.]+ltd|pvt[\s.]+ltd|holdings|company|limited|s[\s.]+a[\s.]+r[\s.]+l|gmbh|corp|b[\s.]+v|n[\s.]+v|s[\s.]+a|inc|llc|llp|ltd|plc|co)\.?)+$"
PROCESSOR = r"^(?:razorpay|payu|billdesk|ccavenue|instamojo|cashfree|paytm|phonepe|stripe|paypal|sq|square)\s*(?:payments?|pvt|india)?\s*[*/|:\-]\s*"
RAIL = r"^(?:upi|neft|imps|rtgs|ach|ecs|mmt|inf|pos|atw|chq)[/\-\s](?:dr|cr)?[/\-\s]?"


@query(
    "vendor_keys",
    "SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '" + PROCESSOR + "', ''), '" + RAIL
    + r"', ''), '^[a-z]{0,4}\d{4,}[a-z0-9]*[/\-\s]+', ''), '[\s*/\-#]+[a-z]{0,3}[\d\-]{4,}$', ''), '" + SUFFIX
    + r"', ''), '[^a-z0-9]', '', 'g') AS vendor_key, length(name) AS chars FROM (SELECT id, CASE id % 5 WHEN 0 THEN concat('RAZORPAY*', supplier_name, ' Pvt. Ltd.') WHEN 1 THEN concat('UPI/', supplier_name, ' Co Inc.') WHEN 2 THEN concat(' Acme ', id % 40, ' Private Limited') WHEN 3 THEN concat('12345678 Widget ', chr(CAST(97 + id % 26 AS INT)), ' GmbH') ELSE concat('Stripe: Foo ', id % 9, ' *X', id + 1000) END AS name FROM payments)",
)
def vendor_keys(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("id"), F.col("supplier_name")
    text = lambda c: c.cast("string")
    name = (
        F.when(i % 5 == 0, F.concat(F.lit("RAZORPAY*"), s, F.lit(" Pvt. Ltd.")))
        .when(i % 5 == 1, F.concat(F.lit("UPI/"), s, F.lit(" Co Inc.")))
        .when(i % 5 == 2, F.concat(F.lit(" Acme "), text(i % 40), F.lit(" Private Limited")))
        .when(i % 5 == 3, F.concat(F.lit("12345678 Widget "), F.char(97 + i % 26), F.lit(" GmbH")))
        .otherwise(F.concat(F.lit("Stripe: Foo "), text(i % 9), F.lit(" *X"), text(i + 1000)))
    )
    return load(spark, d, "payments").select("id", vendor_key(name).alias("vendor_key"), F.length(name).alias("chars"))


@query(
    "document_keys",
    r"""SELECT page_id, 'workspaces/' || page_id % 7 || '/documents/' || page_id || '/' || CASE WHEN f = '' THEN 'document' ELSE f END AS key, CASE WHEN regexp_matches(r, '^[\s0\-.,/\\]*$') THEN NULL ELSE r END AS reference
FROM (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^a-zA-Z0-9._-]+', '-', 'g'), '^[.-]+', ''), 1, 120) AS f, regexp_extract(url, '(\d+)[^\d]*$', 1) AS r FROM pages)""",
)
def document_keys(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("url", r"(\d+)[^\d]*$", 1)
    return load(spark, d, "pages").select(
        "page_id",
        F.concat(F.lit("workspaces/"), (F.col("page_id") % 7).cast("string"), F.lit("/documents/"), F.col("page_id").cast("string"), F.lit("/"), safe_filename(F.col("url"))).alias("key"),
        reference(number).alias("reference"),
    )
