"""Queries on documents, requirements, retrieval and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import vendor_key
from ..operators import documents as D
from ..operators import requirements as Q
from ..operators import retrieval as T
from ..operators import review as V
from .domain import load
from .queries import CANDIDATES, DUPLICATES, _candidates, _duplicates, _tables, query


@query(
    "requirements_pending",
    "SELECT t.workspace_id, t.id FROM transactions t WHERE NOT judged AND NOT EXISTS (SELECT 1 FROM requirements r WHERE r.transaction_id = t.id)",
)
def requirements_pending(spark: SparkSession, d: str) -> DataFrame:
    return Q.pending(*_tables(spark, d, "transactions requirements")).select("workspace_id", "id")


BATCHES = """
WITH pending AS (SELECT t.* FROM transactions t WHERE NOT judged AND NOT EXISTS (SELECT 1 FROM requirements r WHERE r.transaction_id = t.id)),
batches AS (SELECT workspace_id, id, CAST((row_number() OVER (PARTITION BY workspace_id ORDER BY value_date, id) - 1) // 20 AS INTEGER) AS batch FROM pending),
firsts AS (SELECT *, question IS NOT NULL AS has_clarification FROM judgements WHERE NOT (needs_document AND reason IS NULL) AND confident = (question IS NULL) AND NOT (NOT confident AND needs_document) AND (question IS NULL OR (question <> '' AND choices >= 2)) QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY position) = 1),
outcomes AS (SELECT workspace_id, transaction_id, CASE WHEN NOT confident AND has_clarification THEN 'question' WHEN needs_document AND direction <> 'CREDIT' THEN 'requirement' ELSE 'judged' END AS outcome FROM firsts)
"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return Q.batches(Q.pending(*_tables(spark, d, "transactions requirements")))


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    """What the judge says of payments, some of it malformed."""
    options = F.when(F.col("choices").isNotNull(), F.slice(F.array(F.lit("Travel"), F.lit("Rent")), F.lit(1), F.col("choices")))
    return load(spark, d, "judgements").withColumn("options", options).drop("choices")


@query("requirement_batches", BATCHES + "SELECT * FROM batches")
def requirement_batches(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d).select("workspace_id", "id", "batch")


@query("requirements_created", BATCHES + "SELECT * FROM outcomes")
def requirements_created(spark: SparkSession, d: str) -> DataFrame:
    return Q.created(_judgements(spark, d))


@query(
    "run_outcome",
    BATCHES + """, per AS (SELECT b.workspace_id, b.batch, count(o.outcome) AS answers, count(*) FILTER (o.outcome = 'requirement') AS r, count(*) FILTER (o.outcome = 'question') AS q FROM batches b LEFT JOIN outcomes o ON o.transaction_id = b.id GROUP BY 1, 2)
SELECT workspace_id, count(*) AS batches, count(*) FILTER (answers = 0) AS failed, CAST(sum(r) AS BIGINT) AS requirements, CAST(sum(q) AS BIGINT) AS questions, CASE WHEN count(*) FILTER (answers = 0) = count(*) THEN 'FAILED' ELSE 'COMPLETED' END AS state FROM per GROUP BY 1""",
)
def run_outcome(spark: SparkSession, d: str) -> DataFrame:
    return Q.run_outcome(_batches(spark, d), Q.created(_judgements(spark, d)))


@query(
    "batch_due",
    "SELECT batch_id, NOT bool_or(state IN ('UPLOADING', 'IDENTIFYING', 'PARSING', 'VALIDATING')) AS settled, bool_or(state = 'COMPLETED') AS produced, NOT bool_or(state IN ('UPLOADING', 'IDENTIFYING', 'PARSING', 'VALIDATING')) AND bool_or(state = 'COMPLETED') AS due FROM statements GROUP BY 1",
)
def batch_due(spark: SparkSession, d: str) -> DataFrame:
    return Q.batch_due(load(spark, d, "statements"))


@query(
    "knowledge_latest",
    "SELECT workspace_id, 'vendor' AS kind, lower(vendor_guess) AS key, arg_max(state, struct_pack(a := created_on, i := id)) AS value, arg_max(id, struct_pack(a := created_on, i := id)) AS from_id FROM requirements WHERE vendor_guess IS NOT NULL GROUP BY 1, 2, 3",
)
def knowledge_latest(spark: SparkSession, d: str) -> DataFrame:
    facts = load(spark, d, "requirements").where("vendor_guess is not null")
    return Q.latest_knowledge(facts.select("workspace_id", F.lit("vendor").alias("kind"), F.lower("vendor_guess").alias("key"), F.col("created_on").alias("at"), "id", F.col("state").alias("value")))


@query(
    "alias_confirmations",
    """WITH asked AS (SELECT c.workspace_id, c.alias_key, c.vendor_id, c.said_on FROM alias_confirmed c JOIN vendors v ON v.workspace_id = c.workspace_id AND v.id = c.vendor_id),
firsts AS (SELECT workspace_id, alias_key, arg_min(vendor_id, said_on) AS asker FROM asked GROUP BY 1, 2),
b AS (SELECT coalesce(a.workspace_id, f.workspace_id) AS workspace_id, coalesce(a.alias_normalized, f.alias_key) AS alias_normalized, a.vendor_id, a.confirmed, f.asker,
    EXISTS (SELECT 1 FROM asked q WHERE q.workspace_id = a.workspace_id AND q.alias_key = a.alias_normalized AND q.vendor_id = a.vendor_id) AS mine
  FROM aliases a FULL JOIN firsts f ON f.workspace_id = a.workspace_id AND f.alias_key = a.alias_normalized)
SELECT workspace_id, alias_normalized, coalesce(vendor_id, asker) AS vendor_id, coalesce(confirmed, true) OR mine AS confirmed,
  CASE WHEN asker IS NULL OR (mine AND confirmed) THEN 'kept' WHEN vendor_id IS NULL THEN 'added' WHEN mine THEN 'confirmed' ELSE 'refused' END AS outcome FROM b""",
)
def alias_confirmations(spark: SparkSession, d: str) -> DataFrame:
    return Q.confirm_aliases(*_tables(spark, d, "aliases alias_confirmed vendors"))


@query(
    "document_dedup",
    """WITH x AS (SELECT doc_id AS id, length(source) AS workspace_id, md5(coalesce(text, '')) AS h, CASE WHEN doc_id % 4 = 0 THEN 'MANUAL_UPLOAD' ELSE 'GMAIL' END AS source FROM documents)
SELECT id, CASE WHEN source = 'GMAIL' THEN min(CASE WHEN source = 'GMAIL' THEN id END) OVER (PARTITION BY workspace_id, h) ELSE id END AS stored_as FROM x""",
)
def document_dedup(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 4 == 0, "MANUAL_UPLOAD").otherwise("GMAIL")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("source").alias("workspace_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), source.alias("source"), F.col("doc_id").alias("created_on"))
    return D.deduplicate(docs).select("id", "stored_as")


@query(
    "document_routing",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' END AS media_type,
  CASE doc_id % 4 WHEN 0 THEN 'VISUAL' WHEN 2 THEN 'VISUAL' WHEN 1 THEN CASE WHEN regexp_matches(text, '[0-9]') AND length(text) >= 80 * (1 + doc_id % 9) THEN 'TEXT' ELSE 'VISUAL' END END AS path FROM documents""",
)
def document_routing(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.bank_files import media_type

    kind = F.col("doc_id") % 4
    head = F.when(kind == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(kind == 1, F.unhex(F.lit("255044462D"))).when(kind == 2, F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit("00")))
    docs = load(spark, d, "documents").withColumn("media_type", media_type(F.concat(head, F.encode(F.substring("text", 1, 20), "UTF-8"))))
    path = D.route(F.col("media_type"), 1 + F.col("doc_id") % 9, F.length("text"), F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", "media_type", path.alias("path"))


READ = """SELECT id, CASE WHEN id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 THEN amount_minor END AS total_minor, CASE WHEN id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 AND id % 2 = 0 THEN amount_minor END AS tax_minor,
  CASE WHEN id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 AND id % 11 = 0 THEN amount_minor END AS subtotal_minor, CASE WHEN id % 4 <> 0 THEN CAST(value_date AS VARCHAR) END AS invoice_date,
  concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'total: NOT_ON_PAGE' WHEN id % 7 = 0 OR id % 3 = 0 THEN 'total: UNPARSEABLE' END, CASE WHEN id % 2 <> 0 THEN NULL WHEN id % 5 = 0 THEN 'tax: NOT_ON_PAGE' WHEN id % 7 = 0 OR id % 3 = 0 THEN 'tax: UNPARSEABLE' END,
  CASE WHEN id % 11 <> 0 THEN NULL WHEN id % 5 = 0 THEN 'subtotal: NOT_ON_PAGE' WHEN id % 7 = 0 OR id % 3 = 0 THEN 'subtotal: UNPARSEABLE' END, CASE WHEN id % 4 = 0 THEN 'invoiceDate: UNPARSEABLE' END) AS unparsed,
  id % 6 <> 0 AND id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 AND id % 4 <> 0 AS minimum,
  CASE WHEN id % 13 = 0 THEN 'NOT_AN_INVOICE' WHEN NOT (id % 6 <> 0 AND id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 AND id % 4 <> 0) THEN 'UNREADABLE' ELSE 'EXTRACTED' END AS state FROM payments"""


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings whose total is printed with groups, off the page, unreadable or in an unknown currency."""
    i, minor = F.col("id"), F.col("amount_minor")
    plain = F.format_string("%s.%02d", F.format_number(F.floor(minor / 100), 0), minor % 100)
    total = F.when(i % 3 == 0, F.concat(plain, F.lit("??"))).otherwise(F.concat(F.lit("USD "), plain))
    day = F.when(i % 4 == 0, F.date_format("value_date", "'31 Feb 'yyyy")).otherwise(F.date_format("value_date", "dd MMM yyyy"))
    page = F.concat(F.lit("Invoice "), F.when(i % 5 == 0, "999").otherwise(total), F.lit(" dated "), day)
    readings = load(spark, d, "payments").select(
        "id", total.alias("total"), F.when(i % 2 == 0, total).alias("tax"), F.when(i % 11 == 0, total).alias("subtotal"), day.alias("date_text"), F.lit("DMY").alias("date_order"), F.when(i % 7 == 0, "XXX").otherwise("usd ").alias("currency"), F.lit(".").alias("decimal_separator"),
        page.alias("source_text"), F.when(i % 6 != 0, F.col("supplier_name")).alias("legal_name"), F.lit(None).cast("string").alias("trade_name"), F.when(i % 13 == 0, "IS_NOT_INVOICE").otherwise("IS_INVOICE").alias("classification"),
    )
    return readings


FIELDS = ("id", "total_minor", "tax_minor", "subtotal_minor", "invoice_date", "unparsed", "minimum")


@query("invoice_fields", READ)
def invoice_fields(spark: SparkSession, d: str) -> DataFrame:
    """Readings whose total is printed with groups, off the page, unreadable or in an unknown currency."""
    return D.invoice_fields(_readings(spark, d)).select(*FIELDS, D.understood(F.col("classification"), F.col("minimum")).alias("state"))


@query(
    "documents_understood",
    f"""WITH r AS ({READ}), p AS (SELECT r.*, concat_ws('; ', CASE WHEN id % 29 = 0 THEN 'classification is unknown' END, CASE WHEN id % 31 = 0 THEN 'reason is required' END, CASE WHEN id % 37 = 0 THEN 'date_order is unknown' END,
  CASE WHEN id % 41 = 0 THEN 'invoice_date must not be empty' END, CASE WHEN id % 43 = 0 THEN 'aliases must not be empty' END, CASE WHEN id % 13 = 0 AND id % 29 <> 0 AND id % 26 <> 0 THEN 'total must be null when the document is not an invoice' END,
  CASE WHEN id % 13 = 0 AND id % 29 <> 0 AND id % 26 <> 0 AND id % 2 = 0 THEN 'tax must be null when the document is not an invoice' END, CASE WHEN id % 13 = 0 AND id % 29 <> 0 AND id % 26 <> 0 AND id % 11 = 0 THEN 'subtotal must be null when the document is not an invoice' END) AS refused, id % 26 = 0 AS blank FROM r)
SELECT id, CASE WHEN refused = '' AND NOT blank THEN total_minor END AS total_minor, CASE WHEN refused = '' AND NOT blank THEN tax_minor END AS tax_minor, CASE WHEN refused = '' AND NOT blank THEN subtotal_minor END AS subtotal_minor,
  CASE WHEN refused = '' THEN invoice_date END AS invoice_date, CASE WHEN refused <> '' THEN '' WHEN blank THEN CASE WHEN id % 4 = 0 THEN 'invoiceDate: UNPARSEABLE' ELSE '' END ELSE unparsed END AS unparsed, refused = '' AND NOT blank AND minimum AS minimum,
  CASE WHEN refused <> '' THEN 'UNREADABLE' WHEN id % 13 = 0 THEN 'NOT_AN_INVOICE' WHEN NOT minimum THEN 'UNREADABLE' ELSE 'EXTRACTED' END AS state, nullif(refused, '') AS refused FROM p""",
)
def documents_understood(spark: SparkSession, d: str) -> DataFrame:
    """The same readings, some of them malformed: those are refused whole."""
    i = F.col("id")
    figures = {c: F.when(i % 26 != 0, F.col(c)) for c in ("total", "tax", "subtotal")}
    readings = _readings(spark, d).withColumns({
        **figures, "classification": F.when(i % 29 == 0, "MAYBE").otherwise(F.col("classification")), "reason": F.when(i % 31 != 0, "It says so"), "date_order": F.when(i % 37 == 0, "DYM").otherwise("DMY"),
        "date_text": F.when(i % 41 == 0, "").otherwise(F.col("date_text")), "aliases": F.array(F.lit("ABC"), F.when(i % 43 == 0, "").otherwise("ABC Foods")), "invoice_number": F.lit(None).cast("string"),
    })
    return D.understand(readings).select(*FIELDS, "state", "refused")


RESOLVED = """
WITH k AS (SELECT id, workspace_id, created_on, legal_name, trade_name, list_filter([legal_key, trade_key, other_key], lambda x: x IS NOT NULL) AS keys FROM named_documents),
known AS (SELECT k.id, min(a.vendor_id) AS vendor_id FROM k JOIN aliases a ON a.workspace_id = k.workspace_id AND list_contains(k.keys, a.alias_normalized) GROUP BY 1),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_on, id) AS n FROM k WHERE id NOT IN (SELECT id FROM known)),
one_by_one(workspace_id, n, claimed, makes) AS (SELECT DISTINCT workspace_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM o
  UNION ALL SELECT o.workspace_id, o.n, CASE WHEN list_has_any(w.claimed, o.keys) THEN w.claimed ELSE list_concat(w.claimed, o.keys) END, NOT list_has_any(w.claimed, o.keys)
  FROM one_by_one w JOIN o ON o.workspace_id = w.workspace_id AND o.n = w.n + 1),
makers AS MATERIALIZED (SELECT o.* FROM o JOIN one_by_one w ON w.workspace_id = o.workspace_id AND w.n = o.n WHERE w.makes),
claims AS MATERIALIZED (SELECT workspace_id, n, id, keys[1] AS new_key, unnest(keys) AS key FROM makers),
owned AS (SELECT o.id, arg_min(c.id, c.n) AS created_by, arg_min(c.new_key, c.n) AS new_key FROM (SELECT id, workspace_id, unnest(keys) AS key FROM o) o JOIN claims c ON c.workspace_id = o.workspace_id AND c.key = o.key GROUP BY 1)
"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose names overlap: the other name again in capitals, and blank ones."""
    rows = load(spark, d, "named_documents")
    others = F.array(F.lit(None), F.upper("legal_name"), F.lit(" "), F.col("other_name"), F.lit("UPI/"))
    keys = D.vendor_keys(F.col("legal_name"), F.col("trade_name"), others)
    return rows.select(F.col("id").alias("document_id"), "workspace_id", "created_on", "legal_name", "trade_name", keys.alias("keys"))


@query("vendor_resolution", RESOLVED + "SELECT k.workspace_id, k.id AS document_id, vendor_id, created_by, new_key FROM k LEFT JOIN known USING (id) LEFT JOIN owned USING (id)")
def vendor_resolution(spark: SparkSession, d: str) -> DataFrame:
    return D.resolve_vendors(_named(spark, d), load(spark, d, "aliases"))


@query("vendors_created", RESOLVED + "SELECT id AS document_id, workspace_id, coalesce(trade_name, legal_name) AS name, legal_name, array_to_string(keys, ' ') AS aliases, false AS confirmed FROM makers")
def vendors_created(spark: SparkSession, d: str) -> DataFrame:
    names = _named(spark, d)
    made = D.new_vendors(names, D.resolve_vendors(names, load(spark, d, "aliases")))
    return made.select("document_id", "workspace_id", "name", "legal_name", F.array_join("aliases.alias_normalized", " ").alias("aliases"), F.exists("aliases", lambda a: a["confirmed"]).alias("confirmed"))


@query(
    "account_binding",
    """WITH s AS (SELECT l.id AS statement_id, l.workspace_id, upper(a.bank_name) AS bank, CASE WHEN l.id % 4 = 0 THEN 'NEW-' || a.id % 50 ELSE lower(a.account_identifier) END AS number, CASE WHEN l.id % 5 = 0 THEN 'EURO' WHEN l.id % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM statements l JOIN accounts a ON a.id = l.batch_id JOIN identification_answers i ON i.statement_id = l.id
  WHERE l.id % 5 <> 0 AND i.document_kind IN ('BANK_STATEMENT', 'CREDIT_CARD_STATEMENT') AND i.period_start IS DISTINCT FROM '2024-1-5' AND i.period_end <> '31/01/2024'),
k AS (SELECT workspace_id, lower(bank_name) AS b, upper(account_identifier) AS n, min(struct_pack(id := id, c := currency)) AS a FROM accounts GROUP BY 1, 2, 3),
j AS (SELECT s.*, k.a.id AS account_id, k.a.c AS own FROM s LEFT JOIN k ON k.workspace_id = s.workspace_id AND k.b = lower(s.bank) AND k.n = upper(s.number))
SELECT statement_id, account_id, account_id IS NULL AS created, coalesce(own, first_value(currency) OVER w) AS currency, CASE WHEN account_id IS NULL THEN first_value(statement_id) OVER w END AS created_by FROM j WINDOW w AS (PARTITION BY workspace_id, lower(bank), upper(number) ORDER BY statement_id)""",
)
def account_binding(spark: SparkSession, d: str) -> DataFrame:
    statements, accounts = _tables(spark, d, "statements accounts")
    i = F.col("statement_id")
    holder = accounts.select(F.col("id").alias("holder"), "bank_name", "account_identifier")
    rows = statements.select(F.col("id").alias("statement_id"), "workspace_id", "batch_id").join(holder, F.col("holder") == F.col("batch_id"))
    number = F.when(i % 4 == 0, F.concat(F.lit("NEW-"), (F.col("holder") % 50).cast("string"))).otherwise(F.lower("account_identifier"))
    identified = rows.select("statement_id", "workspace_id", F.concat(F.lit(" "), F.upper("bank_name")).alias("bank_name"), number.alias("account_identifier"), F.when(i % 5 == 0, "EURO").when(i % 3 == 0, "EUR").otherwise("USD").alias("currency"))
    identified = identified.join(load(spark, d, "identification_answers").select("statement_id", "document_kind", "period_start", "period_end"), "statement_id")
    return D.bind_accounts(identified, accounts)


@query(
    "mapping_reuse",
    """WITH d AS (SELECT s.id AS statement_id, o.id AS reused_from, row_number() OVER (PARTITION BY s.id ORDER BY o.created_on, o.id) AS n FROM statements s JOIN statements o ON o.workspace_id = s.workspace_id AND o.content_hash = s.content_hash AND o.id <> s.id AND o.mapping IS NOT NULL)
SELECT statement_id, reused_from FROM d WHERE n = 1""",
)
def mapping_reuse(spark: SparkSession, d: str) -> DataFrame:
    return D.mapping_reuse(load(spark, d, "statements"))


@query(
    "search_queries",
    """WITH w AS (SELECT id, vendor_guess, created_on - 7 AS s, created_on + 7 AS e, date_diff('day', DATE '1970-01-01', created_on - 7) * 86400 AS a, (date_diff('day', DATE '1970-01-01', created_on + 7) + 1) * 86400 AS b FROM requirements),
n AS (SELECT *, trim(regexp_replace(replace(vendor_guess, '#', ' (') || ')', '["(){}\\[\\]:<>*]', ' ', 'g')) AS c FROM w)
SELECT id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", a AS after_epoch, b AS before_epoch,
  CASE WHEN vendor_guess IS NOT NULL THEN 'after:' || a || ' before:' || b || ' has:attachment filename:pdf ("' || regexp_replace(c, '\\s+', ' ', 'g') || '" OR "acme" OR from:acme)' ELSE 'after:' || a || ' before:' || b || ' has:attachment filename:pdf ("acme" OR from:acme)' END AS vendor_query,
  'after:' || a || ' before:' || b || ' has:attachment filename:pdf (invoice OR receipt OR bill OR "tax invoice" OR "payment confirmation")' AS keyword_query FROM n""".replace("\\\\", "\\"),
)
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    start, end, after, before = T.window(F.col("created_on"))
    names = F.array_compact(F.array(F.concat(F.replace("vendor_guess", F.lit("#"), F.lit(" (")), F.lit(")")), F.lit("acme"), F.lit("-acme")))
    return load(spark, d, "requirements").select("id", start.alias("start"), end.alias("end"), after.alias("after_epoch"), before.alias("before_epoch"), T.vendor_query(after, before, names).alias("vendor_query"), T.keyword_query(after, before).alias("keyword_query"))


@query(
    "vendor_searches",
    """WITH v AS (SELECT DISTINCT workspace_id, supplier, supplier_name FROM payments),
said AS (SELECT r.id, r.workspace_id, regexp_replace(t.description_normalized, '[^a-z0-9]', '', 'g') AS said FROM requirements r JOIN transactions t ON t.id = r.transaction_id AND t.workspace_id = r.workspace_id),
meant AS (SELECT DISTINCT s.id, v.supplier, v.supplier_name, a.alias_normalized FROM said s JOIN v ON v.workspace_id = s.workspace_id JOIN aliases a ON a.workspace_id = v.workspace_id AND a.vendor_id = v.supplier WHERE contains(s.said, a.alias_normalized)),
named AS (SELECT id, -1 AS vendor, 0 AS kind, vendor_guess AS name FROM requirements WHERE vendor_guess IS NOT NULL UNION ALL SELECT id, supplier, 0, supplier_name FROM meant UNION ALL SELECT id, supplier, 2, alias_normalized FROM meant),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY id, lower(name) ORDER BY vendor, kind) = 1),
terms AS (SELECT id, string_agg('"' || name || '"' || CASE WHEN regexp_full_match(name, '[A-Za-z0-9.-]+') THEN ' OR from:' || name ELSE '' END, ' OR ' ORDER BY vendor, kind) AS terms FROM firsts GROUP BY 1),
w AS (SELECT id, date_diff('day', DATE '1970-01-01', created_on - 7) * 86400 AS a, (date_diff('day', DATE '1970-01-01', created_on + 7) + 1) * 86400 AS b FROM requirements)
SELECT w.id, 'after:' || a || ' before:' || b || ' has:attachment filename:pdf (' || terms || ')' AS vendor_query FROM w LEFT JOIN terms USING (id)""",
)
def vendor_searches(spark: SparkSession, d: str) -> DataFrame:
    """The searches for all names of a payment's vendors."""
    payments, requirements = load(spark, d, "payments"), load(spark, d, "requirements")
    vendors = payments.select("workspace_id", F.col("supplier").alias("id"), F.col("supplier_name").alias("name"), F.lit(None).cast("string").alias("legal_name")).distinct()
    aliases = load(spark, d, "aliases").withColumn("alias", F.col("alias_normalized")).join(vendors.select("workspace_id", F.col("id").alias("vendor_id")), ["workspace_id", "vendor_id"])
    names = T.search_names(requirements, load(spark, d, "transactions"), aliases, vendors)
    _, _, after, before = T.window(F.col("created_on"))
    return requirements.select("id", "created_on").join(names, "id").select("id", T.vendor_query(after, before, F.col("names")).alias("vendor_query"))


MAILS = r"""
WITH parts AS (SELECT m.*, CASE WHEN regexp_matches(sender, '^(.*?)<([^>]+)>\s*$') THEN trim(regexp_replace(regexp_extract(sender, '^(.*?)<([^>]+)>\s*$', 1), '["'']', '', 'g')) ELSE '' END AS name,
  CASE WHEN regexp_matches(sender, '^(.*?)<([^>]+)>\s*$') THEN lower(trim(regexp_extract(sender, '^(.*?)<([^>]+)>\s*$', 2))) WHEN contains(sender, '@') THEN lower(trim(sender)) ELSE '' END AS address FROM mails m),
said AS (SELECT *, CASE WHEN contains(regexp_replace(address, '[^a-z0-9]', '', 'g'), vendor_key) THEN 'VENDOR_ADDRESS' WHEN contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), vendor_key) THEN 'VENDOR_NAME' ELSE 'NONE' END AS sender_agreement,
  contains(regexp_replace(lower(subject), '[^a-z0-9]', '', 'g'), vendor_key) AS vendor_named,
  CASE WHEN regexp_matches(lower(subject), '\bpayment confirmation\b') THEN 'payment confirmation' WHEN regexp_matches(lower(subject), '\btax invoice\b') THEN 'tax invoice' WHEN regexp_matches(lower(subject), '\binvoice\b') THEN 'invoice' WHEN regexp_matches(lower(subject), '\breceipt\b') THEN 'receipt' WHEN regexp_matches(lower(subject), '\bbill\b') THEN 'bill' END AS invoice_word,
  CAST(received_on - transaction_date AS INTEGER) AS offset_days, regexp_matches(lower(subject), '^\s*(fwd?|fw)\s*:') OR (address <> '' AND address = lower(mailbox)) AS forwarded FROM parts),
evidence AS (SELECT *, sender_agreement <> 'NONE' OR vendor_named OR invoice_word IS NOT NULL AS has_signal,
  CASE sender_agreement WHEN 'VENDOR_ADDRESS' THEN 40 WHEN 'VENDOR_NAME' THEN 30 ELSE 0 END + CASE WHEN vendor_named THEN 30 ELSE 0 END + CASE WHEN invoice_word IS NOT NULL THEN 20 ELSE 0 END + greatest(0, 10 - abs(offset_days)) AS strength FROM said),
firsts AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY requirement_id, connection_id, message_id ORDER BY CASE WHEN pass = 'VENDOR' THEN 0 ELSE 1 END, id) = 1),
keyed AS (SELECT *, coalesce(rfc822_message_id, connection_id || ':' || message_id) AS message FROM firsts WHERE has_signal),
best AS (SELECT *, max(strength) OVER (PARTITION BY requirement_id, message) AS best FROM keyed),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY requirement_id ORDER BY best DESC, message) AS place FROM best),
selection AS (SELECT *, place <= 5 AS selected, max(place) OVER (PARTITION BY requirement_id) <= 5 AS exhaustive FROM placed)
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return T.mail_evidence(load(spark, d, "mails"))


def _selection(spark: SparkSession, d: str) -> DataFrame:
    return T.select_messages(T.first_pass(_evidence(spark, d)))


EVIDENCE = ("id", "sender_agreement", "address", "vendor_named", "invoice_word", "offset_days", "forwarded", "has_signal", "strength")


@query(
    "email_evidence",
    MAILS + "SELECT " + ", ".join(EVIDENCE) + """, concat_ws(chr(10), CASE sender_agreement WHEN 'VENDOR_ADDRESS' THEN 'Sent from ' || address || ', the vendor''s own address' WHEN 'VENDOR_NAME' THEN 'Sender is named as the vendor' ELSE 'Sender does not name the vendor' END,
  CASE WHEN vendor_named AND invoice_word IS NOT NULL THEN 'Subject names the vendor and says "' || invoice_word || '"' WHEN vendor_named THEN 'Subject names the vendor' WHEN invoice_word IS NOT NULL THEN 'Subject says "' || invoice_word || '"' ELSE 'Subject mentions neither the vendor nor an invoice' END,
  CASE WHEN offset_days = 0 THEN 'Arrived the same day as the payment' ELSE 'Arrived ' || abs(offset_days) || CASE WHEN abs(offset_days) = 1 THEN ' day ' ELSE ' days ' END || CASE WHEN offset_days > 0 THEN 'after' ELSE 'before' END || ' the payment' END,
  CASE WHEN forwarded THEN 'Forwarded into this mailbox' END) AS sentences FROM evidence""",
)
def email_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select(*EVIDENCE, F.array_join(T.mail_sentences(), "\n").alias("sentences"))


@query("email_selection", MAILS + "SELECT id, requirement_id, message, CAST(place AS INTEGER) AS place, selected, exhaustive FROM selection")
def email_selection(spark: SparkSession, d: str) -> DataFrame:
    return _selection(spark, d).select("id", "requirement_id", "message", "place", "selected", "exhaustive")


@query(
    "retrieval_after_search",
    MAILS + """SELECT s.requirement_id, CASE WHEN s.requirement_id IN (SELECT requirement_id FROM selection WHERE selected) THEN 'FETCH' WHEN bool_or(s.outcome <> 'COMPLETED') THEN 'BLOCKED' ELSE 'NOT_FOUND' END AS next FROM searches s GROUP BY s.requirement_id""",
)
def retrieval_after_search(spark: SparkSession, d: str) -> DataFrame:
    return T.after_search(load(spark, d, "searches"), _selection(spark, d))


SETTLED = MAILS + """, boxes AS (SELECT requirement_id, bool_or(outcome <> 'COMPLETED') AS incomplete, bool_or(truncated) AS cut FROM searches GROUP BY 1),
plausible AS (SELECT * FROM assessments a WHERE NOT EXISTS (SELECT 1 FROM rejections r WHERE r.transaction_id = a.transaction_id AND r.document_id = a.document_id) AND (state = 'UNREADABLE' OR (state = 'EXTRACTED' AND invoice_id IS NOT NULL AND proposes))),
chosen AS (SELECT *, count(*) OVER (PARTITION BY requirement_id) AS n FROM plausible QUALIFY row_number() OVER (PARTITION BY requirement_id ORDER BY document_id) = 1),
x AS (SELECT requirement_id, bool_and(exhaustive) AS exhaustive FROM selection GROUP BY 1),
j AS (SELECT r.id AS requirement_id, c.n, c.document_id, coalesce(b.incomplete, false) AS incomplete, CASE WHEN c.n <> 1 THEN 'one document supports this payment' WHEN c.auto_match_transaction_id IS DISTINCT FROM c.transaction_id THEN 'matching chose this payment for it' WHEN c.classification <> 'IS_INVOICE' THEN 'it reads as an invoice'
  WHEN coalesce(b.incomplete, false) THEN 'every mailbox was searched' WHEN NOT coalesce(x.exhaustive, true) OR coalesce(b.cut, false) THEN 'nothing found was left unread' END AS failed
  FROM requirements r LEFT JOIN boxes b ON b.requirement_id = r.id LEFT JOIN chosen c ON c.requirement_id = r.id LEFT JOIN x ON x.requirement_id = r.id),
verdict AS (SELECT requirement_id, CASE WHEN n IS NULL THEN CASE WHEN incomplete THEN 'BLOCKED' ELSE 'NOT_FOUND' END WHEN failed IS NULL THEN 'AUTO' ELSE 'NEEDS_REVIEW' END AS kind, CASE WHEN n IS NOT NULL THEN failed END AS blocked_by, CASE WHEN n IS NOT NULL AND failed IS NULL THEN document_id END AS document_id FROM j),
settled AS (SELECT v.requirement_id, CASE WHEN r.state = 'EVALUATING' AND r.method IS NULL THEN kind ELSE 'SKIPPED' END AS kind, CASE WHEN r.state = 'EVALUATING' AND r.method IS NULL THEN blocked_by END AS blocked_by,
  CASE WHEN r.state = 'EVALUATING' AND r.method IS NULL THEN document_id END AS document_id FROM verdict v JOIN requirements r ON r.id = v.requirement_id)
"""


def _settled(spark: SparkSession, d: str, all_open: bool = False) -> DataFrame:
    """What retrieval settles; all_open judges every requirement as if it were being evaluated."""
    exhaustive = _selection(spark, d).groupBy("requirement_id").agg(F.bool_and("exhaustive").alias("exhaustive"))
    requirements, *found = _tables(spark, d, "requirements assessments rejections searches")
    if all_open:
        requirements = requirements.withColumns({"state": F.lit("EVALUATING"), "method": F.lit(None).cast("string")})
    return T.settle(requirements, *found, exhaustive)


@query("retrieval_settle", SETTLED + "SELECT * FROM settled")
def retrieval_settle(spark: SparkSession, d: str) -> DataFrame:
    return _settled(spark, d)


EVENT = "CASE id % 6 WHEN 0 THEN 'SEARCH_STARTED' WHEN 1 THEN 'DOCUMENTS_FETCHED' WHEN 2 THEN 'SETTLED_NEEDS_REVIEW' WHEN 3 THEN 'SETTLED_NOT_FOUND' WHEN 4 THEN 'SETTLED_BLOCKED' ELSE 'FAILED' END"


@query(
    "requirement_transitions",
    f"""WITH e AS (SELECT id, state, method, {EVENT} AS event FROM requirements),
t AS (SELECT *, CASE WHEN method IS NULL THEN CASE WHEN event = 'SEARCH_STARTED' AND state IN ('IDENTIFIED', 'NOT_FOUND', 'BLOCKED', 'FAILED', 'SEARCHING') THEN 'SEARCHING' WHEN event = 'DOCUMENTS_FETCHED' AND state = 'SEARCHING' THEN 'EVALUATING'
  WHEN event = 'SETTLED_NEEDS_REVIEW' AND state = 'EVALUATING' THEN 'NEEDS_REVIEW' WHEN event = 'SETTLED_NOT_FOUND' AND state IN ('SEARCHING', 'EVALUATING') THEN 'NOT_FOUND' WHEN event = 'SETTLED_BLOCKED' AND state IN ('SEARCHING', 'EVALUATING') THEN 'BLOCKED'
  WHEN event = 'FAILED' AND state IN ('SEARCHING', 'EVALUATING') THEN 'FAILED' END END AS next FROM e)
SELECT id, event, state AS from_state, coalesce(next, state) AS state, next IS NOT NULL AS moved FROM t""",
)
def requirement_transitions(spark: SparkSession, d: str) -> DataFrame:
    requirements = load(spark, d, "requirements")
    return T.transition(requirements, requirements.select("id", F.expr(EVENT).alias("event")))


@query(
    "requirements_to_search",
    """SELECT r.workspace_id, r.id, CAST(row_number() OVER (PARTITION BY r.workspace_id ORDER BY created_on, r.id) AS INTEGER) AS place FROM requirements r
WHERE state IN ('IDENTIFIED', 'NOT_FOUND', 'BLOCKED', 'FAILED') AND method IS NULL AND EXISTS (SELECT 1 FROM connections c WHERE c.workspace_id = r.workspace_id AND c.state <> 'DISCONNECTED')""",
)
def requirements_to_search(spark: SparkSession, d: str) -> DataFrame:
    return T.eligible(*_tables(spark, d, "requirements connections")).select("workspace_id", "id", "place")


REVIEW = CANDIDATES + """, primaries AS (SELECT invoice_id, document_id FROM invoice_documents QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END, document_id) = 1)
"""


@query(
    "review_candidates",
    REVIEW + """SELECT r.id AS requirement_id, c.invoice, CAST(c.rank AS INTEGER) AS rank, p.document_id, s.filename, i.vendor_name, i.invoice_number, i.total_minor, CAST(row_number() OVER (PARTITION BY r.id ORDER BY c.rank, c.invoice) AS INTEGER) AS place
FROM requirements r JOIN candidates c ON c.transaction = r.transaction_id JOIN primaries p ON p.invoice_id = c.invoice JOIN supporting_documents s ON s.id = p.document_id JOIN invoices i ON i.id = c.invoice WHERE r.state = 'NEEDS_REVIEW'""",
)
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    requirements, invoices, joins, documents = _tables(spark, d, "requirements invoices invoice_documents supporting_documents")
    shown = V.review_candidates(requirements, _candidates(spark, d), invoices, joins, documents)
    return shown.select("requirement_id", "invoice", "rank", "document_id", "filename", "vendor_name", "invoice_number", "total_minor", "place")


@query(
    "review_considered",
    CANDIDATES + """SELECT r.id AS requirement_id, coalesce(c.n, 0) AS considered, coalesce(x.n, 0) AS rejected, coalesce(c.cut, false) AS cut FROM requirements r LEFT JOIN (SELECT transaction, count(*) AS n, bool_or(truncated) AS cut FROM candidates GROUP BY 1) c ON c.transaction = r.transaction_id
LEFT JOIN (SELECT transaction_id, count(*) AS n FROM rejections GROUP BY 1) x ON x.transaction_id = r.transaction_id WHERE r.state = 'NEEDS_REVIEW'""",
)
def review_considered(spark: SparkSession, d: str) -> DataFrame:
    requirements, rejections = _tables(spark, d, "requirements rejections")
    return V.considered(requirements, _candidates(spark, d), rejections)


@query(
    "review_mailboxes",
    """SELECT s.requirement_id, coalesce(c.email, 'a disconnected mailbox') AS email, s.outcome, s.messages_found, CAST(row_number() OVER (PARTITION BY s.requirement_id ORDER BY coalesce(c.email, 'a disconnected mailbox'), s.connection_id) AS INTEGER) AS place
FROM searches s JOIN requirements r ON r.id = s.requirement_id LEFT JOIN connections c ON c.id = s.connection_id AND c.state <> 'DISCONNECTED' WHERE r.state IN ('NEEDS_REVIEW', 'NOT_FOUND', 'BLOCKED')""",
)
def review_mailboxes(spark: SparkSession, d: str) -> DataFrame:
    requirements, searches, connections = _tables(spark, d, "requirements searches connections")
    return V.searched_mailboxes(requirements, searches, connections.where("state <> 'DISCONNECTED'"))


@query(
    "review_reject_all",
    CANDIDATES + """SELECT transaction_id, document_id FROM rejections UNION SELECT c.transaction, c.document_id FROM candidates c WHERE EXISTS (SELECT 1 FROM requirements r WHERE r.transaction_id = c.transaction AND r.state = 'NEEDS_REVIEW')""",
)
def review_reject_all(spark: SparkSession, d: str) -> DataFrame:
    requirements, rejections = _tables(spark, d, "requirements rejections")
    return V.reject(requirements, _candidates(spark, d), rejections)


@query(
    "duplicates_keep_one",
    "WITH " + DUPLICATES + """, moved AS (SELECT coalesce(d.of_invoice, j.invoice_id) AS invoice_id, j.document_id, bool_or(j.is_primary) AS is_primary, bool_or(d.invoice IS NOT NULL) AS moved FROM invoice_documents j LEFT JOIN duplicates d ON d.invoice = j.invoice_id GROUP BY 1, 2)
SELECT invoice_id, document_id, CASE WHEN bool_or(moved) OVER w THEN document_id = min(document_id) OVER w ELSE is_primary END AS is_primary FROM moved WINDOW w AS (PARTITION BY invoice_id)""",
)
def duplicates_keep_one(spark: SparkSession, d: str) -> DataFrame:
    return V.keep_one(load(spark, d, "invoice_documents"), _duplicates(spark, d))


@query(
    "policy_eval",
    SETTLED + """, cases AS (SELECT s.requirement_id % 4 AS case_set, s.kind AS actual, CASE s.requirement_id % 10 WHEN 0 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'BLOCKED' ELSE 'AUTO' END AS expected, coalesce(s.document_id % 5 <> 4, false) AS ok FROM verdict s)
SELECT case_set, count(*) AS cases, CASE WHEN count(*) FILTER (actual = 'AUTO') > 0 THEN count(*) FILTER (actual = 'AUTO' AND expected = 'AUTO' AND ok) / count(*) FILTER (actual = 'AUTO') END AS precision,
  CASE WHEN count(*) FILTER (expected = 'AUTO') > 0 THEN count(*) FILTER (actual = 'AUTO' AND expected = 'AUTO' AND ok) / count(*) FILTER (expected = 'AUTO') END AS recall,
  count(*) FILTER (actual = 'AUTO' AND NOT (expected = 'AUTO' AND ok)) AS false_positives, count(*) FILTER (expected = 'AUTO' AND NOT (actual = 'AUTO' AND ok)) AS false_negatives,
  count(*) FILTER (actual = 'NEEDS_REVIEW') / count(*) AS review_rate, count(*) FILTER (actual IN ('NOT_FOUND', 'BLOCKED')) / count(*) AS not_found_rate FROM cases GROUP BY 1""",
)
def policy_eval(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("requirement_id")
    expected = F.when(i % 10 == 0, "NEEDS_REVIEW").when(i % 10 == 1, "NOT_FOUND").when(i % 10 == 2, "BLOCKED").otherwise("AUTO")
    return T.link_metrics(_settled(spark, d, all_open=True).select((i % 4).alias("case_set"), F.col("kind").alias("actual"), expected.alias("expected"), F.coalesce(F.col("document_id") % 5 != 4, F.lit(False)).alias("correct_link")))
