"""The reconciliation tables as projections of the driver's star schema.

Each is one SELECT that Spark and DuckDB both read, so a query and the SQL it is held
against start from the same rows. ``load`` gives DataFrames, ``oracle`` the SQL with the
tables it names in front.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CODES = "INR USD EUR GBP AED SGD AUD CAD CHF HKD SAR MYR LKR JPY KWD BHD".split()
_CODE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES))

DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

TABLES = {
    "accounts": f"""
        SELECT c_custkey AS id, c_nationkey AS workspace_id, c_mktsegment AS bank_name, c_name AS account_identifier,
          CASE WHEN c_custkey % 4 = 0 THEN 'CREDIT_CARD' ELSE 'BANK_ACCOUNT' END AS account_kind,
          CASE WHEN c_custkey % 10 = 0 THEN 'USD' ELSE CASE c_nationkey % 16 {_CODE} END END AS currency
        FROM customer""",
    "payments": """
        SELECT o.o_orderkey AS id, a.workspace_id, a.id AS account_id, CAST(o.o_orderdate AS DATE) AS value_date,
          CAST(round(o.o_totalprice * 100) AS BIGINT) AS amount_minor, o.o_orderstatus AS status, a.currency,
          s.s_suppkey AS supplier, s.s_name AS supplier_name
        FROM (SELECT *, o_orderkey % (SELECT count(*) FROM supplier) AS vendor FROM orders) o JOIN accounts a ON a.id = o.o_custkey
        JOIN supplier s ON s.s_suppkey = o.vendor""",
    "transactions": """
        SELECT id, workspace_id, account_id, value_date, amount_minor, CASE WHEN status = 'P' THEN 'CREDIT' ELSE 'DEBIT' END AS direction, currency,
          CASE id % 4 WHEN 0 THEN concat('UPI/', upper(supplier_name), ' / ', id) WHEN 1 THEN concat(supplier_name, ' Pvt Ltd - INV-', id)
            WHEN 2 THEN concat('Card ', supplier_name) ELSE concat('Card payment ', id) END AS description,
          CASE id % 4 WHEN 0 THEN lower(concat('upi ', replace(supplier_name, '#', ' '), ' ', id)) WHEN 1 THEN lower(concat(replace(supplier_name, '#', ' '), ' pvt ltd inv ', id))
            WHEN 2 THEN lower(concat('card ', replace(supplier_name, '#', ' '))) ELSE concat('card payment ', id) END AS description_normalized,
          CASE WHEN id % 3 = 0 THEN concat('REF/INV-', id) END AS external_reference, 0 AS occurrence_index, id % 7 <> 0 AS judged
        FROM payments""",
    "aliases": """
        SELECT DISTINCT workspace_id, CASE WHEN workspace_id % 6 = 5 THEN supplier + 1 ELSE supplier END AS vendor_id, lower(replace(supplier_name, '#', '')) AS alias_normalized, (supplier + workspace_id) % 2 = 0 AS confirmed
        FROM payments WHERE supplier % 5 <> 0 AND (supplier + workspace_id) % 4 <> 3""",
    "vendors": """
        SELECT DISTINCT workspace_id, supplier AS id, supplier_name AS name FROM payments""",
    "alias_confirmed": """
        SELECT id AS said_on, workspace_id, CASE WHEN id % 3 = 0 THEN supplier + 1 ELSE supplier END AS vendor_id, concat(supplier_name, ' Inc.') AS alias,
          lower(replace(supplier_name, '#', '')) AS alias_key FROM payments WHERE id % 4 = 1""",
    "named_documents": """
        SELECT id, workspace_id, value_date AS created_on, concat('Widget ', id % 97, ' Pvt Ltd') AS legal_name, CASE WHEN id % 3 <> 0 THEN concat(supplier_name, ' Inc.') END AS trade_name,
          concat('Trader ', id % 89) AS other_name, concat('widget', id % 97) AS legal_key, CASE WHEN id % 3 <> 0 THEN lower(replace(supplier_name, '#', '')) END AS trade_key, concat('trader', id % 89) AS other_key
        FROM payments""",
    "first_invoices": """
        SELECT id, workspace_id, id AS document_id, CASE WHEN id % 13 <> 0 THEN supplier END AS vendor_id,
          CASE WHEN id % 13 <> 0 THEN supplier_name END AS vendor_name, CASE WHEN id % 13 <> 0 THEN lower(replace(supplier_name, '#', '')) END AS vendor_key,
          CASE WHEN id % 11 <> 0 THEN concat('INV-', id) END AS invoice_number,
          CASE WHEN id % 17 <> 0 THEN value_date - CAST(id % 15 - 4 AS INT) END AS invoice_date,
          CASE WHEN id % 19 <> 0 THEN CASE id % 10 WHEN 2 THEN amount_minor + 1 WHEN 4 THEN amount_minor + amount_minor % 1000 WHEN 6 THEN amount_minor + amount_minor ELSE amount_minor END END AS total_minor,
          CASE WHEN id % 23 = 0 THEN CAST(NULL AS STRING) WHEN id % 29 = 0 THEN 'USD' ELSE currency END AS currency,
          CASE WHEN id % 40 = 0 THEN id END AS transaction_id, value_date AS created_on
        FROM payments WHERE id % 2 = 0 AND status <> 'P'""",
    "invoices": """
        SELECT * FROM first_invoices
        UNION ALL
        SELECT id + 1000000000 AS id, workspace_id, document_id + 1000000000 AS document_id, vendor_id, vendor_name, vendor_key,
          CASE WHEN id % 100 <> 0 THEN invoice_number END AS invoice_number, invoice_date + CAST(id % 4 AS INT) AS invoice_date,
          CASE WHEN id % 150 = 0 THEN total_minor + 100 ELSE total_minor END AS total_minor, currency, CAST(NULL AS BIGINT) AS transaction_id, created_on + 3 AS created_on
        FROM first_invoices WHERE id % 50 = 0
        UNION ALL
        SELECT id + 2000000000 AS id, workspace_id, document_id + 2000000000 AS document_id, vendor_id, vendor_name, vendor_key, CAST(NULL AS STRING) AS invoice_number,
          invoice_date + CAST(id % 4 + 2 AS INT) AS invoice_date, total_minor, currency, CAST(NULL AS BIGINT) AS transaction_id, created_on + 5 AS created_on
        FROM first_invoices WHERE id % 100 = 0""",
    "requirements": """
        SELECT id, workspace_id, id AS transaction_id,
          CASE id % 8 WHEN 0 THEN 'IDENTIFIED' WHEN 1 THEN 'SEARCHING' WHEN 2 THEN 'EVALUATING' WHEN 3 THEN 'NEEDS_REVIEW' WHEN 4 THEN 'NOT_FOUND' WHEN 5 THEN 'RESOLVED' WHEN 6 THEN 'BLOCKED' ELSE 'FAILED' END AS state,
          CASE WHEN id % 8 = 5 THEN CASE id % 5 WHEN 0 THEN 'AUTO_RETRIEVED' WHEN 1 THEN 'AUTO_MATCHED' WHEN 2 THEN 'USER_CONFIRMED' WHEN 3 THEN 'USER_LINKED' ELSE 'NOT_REQUIRED' END END AS method,
          CASE WHEN id % 8 = 5 AND id % 5 <> 4 THEN id + CASE WHEN id % 31 = 0 THEN 5000000000 ELSE 0 END END AS resolved_document_id,
          CASE WHEN id % 6 <> 0 THEN supplier_name END AS vendor_guess, CASE WHEN id % 4 = 0 THEN 'A receipt is missing' END AS reason, value_date AS created_on
        FROM payments WHERE status <> 'P' AND id % 5 <> 2""",
    "rejections": """
        SELECT id AS transaction_id, id AS document_id FROM payments WHERE id % 9 = 0 AND status <> 'P'""",
    "supporting_documents": """
        SELECT id, workspace_id, concat('invoice ', id, '.pdf') AS filename, CASE WHEN id % 3 = 0 THEN 'MANUAL_UPLOAD' ELSE 'GMAIL' END AS source,
          CASE id % 7 WHEN 0 THEN 'UNREADABLE' WHEN 1 THEN 'NOT_AN_INVOICE' ELSE 'EXTRACTED' END AS state,
          CASE WHEN id % 27 = 0 THEN id END AS transaction_id, value_date AS created_on
        FROM payments WHERE status <> 'P' AND id % 12 <> 7""",
    "invoice_documents": """
        SELECT id AS invoice_id, document_id, id % 3 = 0 AS is_primary FROM invoices
        UNION ALL
        SELECT id AS invoice_id, document_id + 1 AS document_id, id % 3 = 1 AS is_primary FROM first_invoices WHERE id % 4 = 0""",
    "questions": """
        SELECT id, workspace_id, id AS transaction_id, id % 3 = 0 AS answered FROM payments WHERE id % 6 = 1""",
    "connections": """
        SELECT n_nationkey * 10 + 1 AS id, n_nationkey AS workspace_id, concat('ap', n_nationkey, '@books.example') AS email, 'CONNECTED' AS state FROM nation
        UNION ALL
        SELECT n_nationkey * 10 + 2 AS id, n_nationkey AS workspace_id, concat('owner', n_nationkey, '@books.example') AS email,
          CASE n_nationkey % 3 WHEN 0 THEN 'NEEDS_REAUTH' WHEN 1 THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS state FROM nation WHERE n_nationkey % 4 <> 0""",
    "searches": """
        SELECT r.id AS requirement_id, c.id AS connection_id, r.workspace_id,
          CASE (r.id + c.id) % 5 WHEN 0 THEN 'NEEDS_REAUTH' WHEN 1 THEN 'FAILED' ELSE 'COMPLETED' END AS outcome, (r.id + c.id) % 11 = 0 AS truncated, CAST((r.id + c.id) % 30 AS INT) AS messages_found
        FROM requirements r JOIN connections c ON c.workspace_id = r.workspace_id WHERE r.state <> 'IDENTIFIED'""",
    "statements": """
        SELECT o_orderkey AS id, a.workspace_id, CASE WHEN o_orderkey % 37 <> 0 THEN a.id END AS account_id, o_custkey AS batch_id,
          CASE o_orderkey % 9 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NEEDS_ACCOUNT' WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'PARSING' ELSE 'COMPLETED' END ELSE 'COMPLETED' END AS state,
          CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) - 30 END AS period_start, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS period_end,
          md5(concat(o_custkey % 50, '/', o_orderpriority)) AS content_hash, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS mapping, a.currency, CAST(o_orderdate AS DATE) AS created_on
        FROM orders JOIN accounts a ON a.id = o_custkey""",
    "lines": """
        SELECT l_orderkey AS statement_id,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS row_index,
          CAST(l_shipdate AS DATE) AS value_date, CAST(round(l_extendedprice * 100) AS BIGINT) + 1 AS amount_minor,
          CASE WHEN l_returnflag = 'R' THEN 'CREDIT' ELSE 'DEBIT' END AS direction, concat('Part ', l_partkey % 20, ' / supplier ', l_suppkey % 10) AS description,
          CASE WHEN l_partkey % 5 = 0 THEN concat('T', l_partkey) END AS external_reference, l_partkey, l_suppkey
        FROM lineitem""",
    "printed_lines": """
        SELECT statement_id, row_index, value_date, amount_minor, direction, description, external_reference,
          CASE WHEN l_partkey % 12 <> 0 THEN sum(CASE WHEN direction = 'DEBIT' THEN -amount_minor ELSE amount_minor END)
            OVER (PARTITION BY statement_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + CAST(1000000 AS BIGINT)
            + CASE WHEN l_suppkey % 17 = 0 THEN amount_minor WHEN l_suppkey % 19 = 0 THEN 2 * amount_minor WHEN l_suppkey % 23 = 0 THEN 77 ELSE 0 END END AS balance_minor
        FROM lines""",
    "mails": """
        SELECT r.id * 10 + j.j AS id, r.id AS requirement_id, r.workspace_id, r.workspace_id * 10 + 1 + j.j % 2 AS connection_id,
          concat('m', r.id + j.j % 7) AS message_id, CASE WHEN j.j % 4 <> 0 THEN concat('<', r.id + j.j % 6, '@mail>') END AS rfc822_message_id,
          CASE j.j % 4 WHEN 0 THEN concat('"', r.vendor_guess, '" <billing@', lower(replace(r.vendor_guess, '#', '')), '.example>') WHEN 1 THEN concat(r.vendor_guess, ' <no-reply@pay.example>')
            WHEN 2 THEN concat('ap', r.workspace_id, '@books.example') ELSE 'News' END AS sender,
          CASE j.j % 5 WHEN 0 THEN concat('Your tax invoice from ', r.vendor_guess) WHEN 1 THEN 'Fwd: payment confirmation' WHEN 2 THEN 'Re: lunch' WHEN 3 THEN concat(r.vendor_guess, ' news') ELSE 'The bill' END AS subject,
          r.created_on + CAST(j.j * 2 - 7 AS INT) AS received_on, r.created_on AS transaction_date, lower(replace(r.vendor_guess, '#', '')) AS vendor_key,
          concat('AP', r.workspace_id, '@books.example') AS mailbox, CASE WHEN j.j % 3 = 0 THEN 'KEYWORD' ELSE 'VENDOR' END AS pass
        FROM requirements r CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) j
        WHERE r.vendor_guess IS NOT NULL""",
    "assessments": """
        SELECT r.id AS requirement_id, r.transaction_id, r.id + j.j AS document_id, CASE (r.id + j.j) % 5 WHEN 0 THEN 'UNREADABLE' WHEN 1 THEN 'NOT_AN_INVOICE' ELSE 'EXTRACTED' END AS state,
          CASE WHEN (r.id + j.j) % 4 = 0 THEN 'UNCERTAIN' ELSE 'IS_INVOICE' END AS classification, CASE WHEN (r.id + j.j) % 6 <> 0 THEN r.id + j.j END AS invoice_id,
          (r.id + j.j) % 3 <> 0 AS proposes, CASE WHEN (r.id + j.j) % 7 <> 0 THEN r.transaction_id END AS auto_match_transaction_id
        FROM requirements r CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) j WHERE r.id % (j.j + 1) = 0""",
    "judgements": """
        SELECT t.id AS transaction_id, t.workspace_id, j.j AS position, t.direction, (t.id + j.j) % 3 <> 0 AND ((t.id + j.j) % 4 <> 0 OR (t.id + j.j) % 5 = 1) AS needs_document, CASE WHEN (t.id + j.j) % 17 <> 0 THEN 'A bill is usual' END AS reason, (t.id + j.j) % 4 <> 0 AS confident,
          CASE WHEN (t.id + j.j) % 8 = 0 THEN CASE WHEN (t.id + j.j) % 7 = 0 THEN '' ELSE 'What was this?' END END AS question, CASE WHEN (t.id + j.j) % 8 = 0 THEN CASE WHEN (t.id + j.j) % 11 = 0 THEN 1 ELSE 2 END END AS choices
        FROM transactions t CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1) j WHERE NOT t.judged AND (j.j = 0 OR t.id % 2 = 0)""",
    "adjudications": """
        SELECT id AS invoice_id, CASE WHEN id % 11 <> 0 THEN 'SAME' WHEN id % 4 = 0 THEN 'UNSURE' ELSE 'DIFFERENT' END AS verdict, CASE WHEN id % 11 <> 0 THEN CASE WHEN id % 16 = 2 THEN 1 ELSE 0 END WHEN id % 9 = 0 THEN 0 END AS candidate, CASE WHEN id % 19 <> 0 THEN 'Same total' WHEN id % 2 = 0 THEN '' END AS reason
        FROM invoices WHERE id % 14 <> 0""",
    "duplicate_verdicts": """
        SELECT a.id AS incoming_id, b.id AS existing_id, CASE (a.id + b.id) % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'UNSURE' END AS same, 'The judge says so' AS reason
        FROM invoices a JOIN invoices b ON b.workspace_id = a.workspace_id AND b.vendor_id = a.vendor_id AND b.id <> a.id
          AND (b.invoice_date BETWEEN a.invoice_date - 2 AND a.invoice_date + 2 OR b.total_minor = a.total_minor) WHERE (a.id + b.id) % 4 <> 1""",
    "parse_requests": """
        SELECT id, workspace_id, account_id, CASE WHEN id % 41 = 0 THEN 'XXX' ELSE currency END AS currency, CASE id % 9 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'VALIDATING' ELSE 'PARSING' END AS state,
          period_start, period_end, id % 43 <> 0 AS stored FROM statements""",
    "flow_requests": """
        SELECT p.*, CASE WHEN p.id % 6 = 1 THEN 'SCANNED' ELSE 'TEXT' END AS path, CASE WHEN p.id % 47 <> 0 THEN s.content_hash END AS content_hash, s.created_on FROM parse_requests p JOIN statements s ON s.id = p.id""",
    "structures": """
        SELECT s.id AS statement_id, CAST(t.attempt AS INT) AS attempt, s.id % 16 = 0 AS pinned, CAST(1 AS INT) AS header_row, CAST(CASE WHEN s.id % 31 = 0 THEN 1000 ELSE 2 END AS INT) AS first_data_row, CAST(0 AS INT) AS date_column, 'DMY' AS date_order,
          CAST(5 AS INT) AS reference_column, CAST(CASE WHEN t.attempt = 0 OR s.id % 8 <> 4 THEN 4 END AS INT) AS balance_column, 'DEBIT_CREDIT' AS amount_shape,
          CAST(CASE WHEN s.id % 4 = 0 AND (t.attempt = 0 OR s.id % 8 = 4) THEN 3 ELSE 2 END AS INT) AS debit_column,
          CAST(CASE WHEN s.id % (29 - 6 * t.attempt) = 0 THEN NULL WHEN s.id % 4 = 0 AND (t.attempt = 0 OR s.id % 8 = 4) THEN 2 ELSE 3 END AS INT) AS credit_column,
          CAST(NULL AS INT) AS amount_column, CAST(NULL AS INT) AS indicator_column, '.' AS decimal_separator,
          CAST(CASE WHEN s.id % 3 <> 0 THEN 1 END AS INT) AS opening_column, CAST(CASE WHEN s.id % 5 <> 0 THEN 3 END AS INT) AS closing_column
        FROM parse_requests s CROSS JOIN (SELECT 0 AS attempt UNION ALL SELECT 1) t WHERE t.attempt = 0 OR s.id % 4 = 0""",
    "mapping_answers": """
        SELECT statement_id, attempt, header_row, CAST(CASE WHEN statement_id % 17 = 3 THEN -1 ELSE first_data_row END AS INT) AS first_data_row, date_column, CASE WHEN statement_id % 19 = 1 THEN 'YDM' ELSE date_order END AS date_order, reference_column,
          balance_column, CASE statement_id % 10 WHEN 1 THEN 'SIGNED_AMOUNT' WHEN 2 THEN 'AMOUNT_WITH_INDICATOR' WHEN 3 THEN 'BOTH' ELSE amount_shape END AS amount_shape, CASE WHEN statement_id % 20 <> 1 THEN debit_column END AS debit_column,
          CASE WHEN statement_id % 20 <> 1 THEN credit_column END AS credit_column, CAST(CASE WHEN statement_id % 20 = 1 THEN 2 END AS INT) AS amount_column, indicator_column, decimal_separator
        FROM structures""",
    "match_answers": """
        SELECT id AS invoice_id, CASE id % 5 WHEN 0 THEN 'SAME' WHEN 1 THEN 'UNSURE' WHEN 2 THEN 'DIFFERENT' WHEN 3 THEN 'SAME' ELSE 'PERHAPS' END AS verdict,
          CAST(CASE WHEN id % 3 = 0 THEN 0 WHEN id % 7 = 1 THEN -1 END AS INT) AS candidate, CASE WHEN id % 11 <> 0 THEN 'Same total' WHEN id % 2 = 0 THEN '' END AS reason FROM invoices""",
    "payment_answers": """
        SELECT id AS transaction_id, id % 2 = 0 AS needs_document, CASE WHEN id % 3 <> 0 THEN 'A receipt is needed' END AS reason, id % 5 <> 0 AS confident, CASE WHEN id % 7 = 0 THEN '' WHEN id % 10 = 5 OR id % 13 = 0 THEN 'What was this?' END AS question,
          CASE WHEN id % 35 = 5 THEN 1 ELSE 2 END AS choices FROM transactions""",
    "workspaces": """
        SELECT n_nationkey AS id, n_regionkey AS owner_id, n_name AS name FROM nation""",
    "identification_answers": """
        SELECT id AS statement_id, CASE id % 4 WHEN 0 THEN 'BANK_STATEMENT' WHEN 1 THEN 'CREDIT_CARD_STATEMENT' WHEN 2 THEN 'SOMETHING_ELSE' ELSE 'LEASE' END AS document_kind,
          CASE WHEN id % 5 = 0 THEN 'USDX' WHEN id % 5 <> 1 THEN currency END AS currency, CASE WHEN id % 7 = 0 THEN '2024-1-5' WHEN id % 7 <> 1 THEN '2024-01-05' END AS period_start,
          CASE WHEN id % 6 = 0 THEN '31/01/2024' ELSE '2024-01-31' END AS period_end FROM statements""",
    "scanned_answers": """
        SELECT statement_id, row_index, CASE WHEN statement_id % 5 = 0 THEN 'DYM' ELSE 'DMY' END AS date_order, CASE WHEN statement_id % 7 = 0 THEN ';' ELSE '.' END AS decimal_separator,
          CASE WHEN row_index % 3 <> 0 THEN '01/02/2024' END AS date, CASE WHEN l_partkey % 4 <> 0 THEN description END AS description FROM lines""",
    "invoice_answers": """
        SELECT id AS document_id, CASE id % 4 WHEN 0 THEN 'IS_INVOICE' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'IS_NOT_INVOICE' ELSE 'MAYBE' END AS classification,
          CASE WHEN id % 9 <> 0 THEN 'It says so' WHEN id % 2 = 0 THEN '' END AS reason, 'DMY' AS date_order, '.' AS decimal_separator, CASE WHEN id % 3 <> 0 THEN 'N1' END AS invoice_number,
          CASE WHEN id % 8 = 0 THEN '' WHEN id % 8 <> 1 THEN '1 May' END AS invoice_date, CASE WHEN id % 5 = 0 THEN '10.00' WHEN id % 5 = 1 THEN '' END AS total,
          CASE WHEN id % 7 = 0 THEN '1.00' END AS tax, CASE WHEN id % 11 = 0 THEN '9.00' END AS subtotal, CASE WHEN id % 6 <> 0 THEN 'USD' END AS currency, id % 10 = 0 AS blank_alias FROM supporting_documents""",
    "export_requests": """
        SELECT a.id, a.workspace_id, CASE a.id % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'FAILED' ELSE 'GENERATING' END AS state, DATE '2024-01-01' + CAST(a.id % 300 AS INT) AS requested_on FROM accounts a""",
    "mail_payloads": """
        SELECT id, CASE WHEN id % 17 = 0 THEN concat('<<', id) ELSE replace(replace(concat('<<"partId":"0","mimeType":"multipart/mixed","filename":"","body":<<"size":0>>,"parts":[<<"partId":"0.1","mimeType":"text/plain","filename":"","body":<<"size":12,"data":"aGVsbG8">>>>,',
          CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '<<"mimeType":"multipart/related","parts":[' WHEN 2 THEN '<<"parts":[<<"parts":[null,<<"filename":"fwd.eml","body":<<"attachmentId":"E">>,"parts":[' ELSE '<<"filename":7,"body":<<"attachmentId":"N">>,"parts":<<"a":1>>>>,' END,
          '<<"partId":"0.2","filename":"invoice-', id, '.pdf","mimeType":"application/pdf","body":<<"attachmentId":"A', id, '","size":', CASE WHEN id % 5 = 0 THEN '"7"' ELSE CAST(id % 1000 AS STRING) END, '>>>>,<<"filename":"inline.png","body":<<"data":"x">>>>',
          CASE id % 4 WHEN 1 THEN ']>>' WHEN 2 THEN ']>>]>>]>>,<<"filename":"last.pdf","body":<<"attachmentId":"L","size":3>>>>' ELSE '' END, ']>>'), '<<', chr(123)), '>>', chr(125)) END AS payload FROM mails""",
    "mail_documents": """
        SELECT id AS email_id, requirement_id + id % 3 AS document_id FROM mails WHERE id % 4 <> 1""",
}


def _named(sql: str) -> list[str]:
    """Tables of this module that sql names, as they are defined."""
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def _needed(names: list[str]) -> list[str]:
    out: set[str] = set()
    todo = list(names)
    while todo:
        t = todo.pop()
        if t not in out:
            out.add(t)
            todo += [x for x in _named(TABLES[t]) if x != t]
    return [t for t in TABLES if t in out]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one of TABLES."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    parts = {t: load(spark, sf_dir, t) for t in (*DRIVER, *TABLES) if t != name and re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)}
    for t in parts:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b(?!\s*\()", rf"\1\2{{{t}}}", sql)
    if name == "lines":
        # By order, under the name that it has here and as a statement's id alike: else windows over the one and the other exchange all lines twice.
        parts["lineitem"] = parts["lineitem"].repartition("l_orderkey")
    return spark.sql(sql, **parts)


def oracle(sql: str) -> str:
    """sql (which may begin with its own WITH list, given as ``WITH a AS ...``) behind the tables it names."""
    needed = _needed(_named(sql))
    head = ",\n".join(f"{t} AS ({TABLES[t]})" for t in needed)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH"):
        body = ", " + re.sub(r"^WITH( RECURSIVE)?\s", "", body, flags=re.I)
    # A CTE with a list of columns may name itself.
    recursive = "RECURSIVE " if re.search(r"\b\w+\([\w, ]+\) AS \(", body) else ""
    return f"WITH {recursive}{head}\n{body}"
