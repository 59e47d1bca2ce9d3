"""Queries on whole flows: statements from file to ledger, answers that can't be used, exports, matches and the review page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, written
from ..functions.money import exponent
from ..functions.text import normalize_description
from ..operators import chain, ledger, parsing, statement_flow, verdicts
from ..operators import matching as M
from ..operators import report as R
from ..operators import review as V
from ..sources import bank_files
from .domain import load
from .queries import CANDIDATES, DECISIONS, SENTENCES, _candidates, _documents, _matching, _tables, query
from .statement_queries import ENDS, PROMOTED


def _printed(minor: Column, currency: Column) -> Column:
    """As many decimals as the currency has, a minus in front; what is unknown has two."""
    places = F.coalesce(exponent(currency), F.lit(2))
    digits = F.abs(minor).cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), places + 1), F.lit("0"))
    head, tail = F.substring(padded, F.lit(1), F.length(padded) - places), F.substring(padded, F.length(padded) - places + 1, places)
    text = F.concat(F.when(minor < 0, "-").otherwise(""), head, F.when(places == 0, "").otherwise(F.concat(F.lit("."), tail)))
    return F.coalesce(text, F.lit(""))


def _balance_files(spark: SparkSession, d: str) -> DataFrame:
    """Bank files with a row of opening and closing balances, a header, and a row for each line with its running balance."""
    requests, rows = _tables(spark, d, "parse_requests printed_lines")
    of = requests.where("stored").select(F.col("id").alias("statement_id"), "currency")
    rows = of.join(rows, "statement_id", "left")
    amount = _printed(F.col("amount_minor"), F.col("currency"))
    sides = [F.when(F.col("direction") == side, amount).otherwise("") for side in ("DEBIT", "CREDIT")]
    line = F.concat_ws(",", F.date_format("value_date", "dd/MM/yyyy"), F.concat(F.lit('"'), F.col("description"), F.lit('"')), *sides, _printed(F.col("balance_minor"), F.col("currency")), F.coalesce("external_reference", F.lit("0000")))
    moved = F.coalesce(F.sum(chain.signed(F.col("direction"), F.col("amount_minor"))), F.lit(0))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("row_index").isNotNull(), F.struct("row_index", line.alias("line"))))), lambda x: x["line"])
    files = rows.groupBy("statement_id", "currency").agg((moved + 1000000 + F.when(F.col("statement_id") % 13 == 0, 500).otherwise(0)).alias("closing"), ordered.alias("body"))
    top = F.concat(F.lit("Opening,"), _printed(F.lit(1000000), F.col("currency")), F.lit(",Closing,"), _printed(F.col("closing"), F.col("currency")), F.lit(",,\nDate,Text,Debit,Credit,Balance,Ref"))
    return files.select("statement_id", F.encode(F.array_join(F.concat(F.array(top), "body"), "\n"), "UTF-8").alias("content"))


def _structures(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "structures").withColumn("description_columns", F.array(F.lit(1)))
    cells = {f"{e}_balance_cell": F.when(F.col(f"{e}_column").isNotNull(), F.struct(F.lit(0).alias("row"), F.col(f"{e}_column").alias("column"))) for e in ("opening", "closing")}
    return rows.withColumns(cells).drop("opening_column", "closing_column")


def _parsed(spark: SparkSession, d: str, keep: bool) -> tuple[DataFrame, DataFrame]:
    """Statements as settled, and the lines of their readings; written once where both are used again."""
    requests = load(spark, d, "parse_requests")
    usable = parsing.usable_structures(requests, _structures(spark, d))
    lines = parsing.read(bank_files.csv_grid(_balance_files(spark, d)), usable)
    lines = written(lines, "parsed-lines") if keep else lines
    return parsing.settle(requests, usable, lines), lines


READINGS = """
WITH asked AS (SELECT * FROM parse_requests WHERE state IN ('PARSING', 'VALIDATING')),
good AS (SELECT s.*, a.period_start, a.period_end FROM structures s JOIN asked a ON a.id = s.statement_id WHERE s.credit_column IS NOT NULL AND (s.attempt = 0 OR NOT s.pinned) AND a.account_id IS NOT NULL AND a.currency <> 'XXX' AND a.stored),
moved AS (SELECT statement_id, sum(CASE WHEN direction = 'CREDIT' THEN amount_minor ELSE -amount_minor END) AS moved FROM printed_lines GROUP BY 1),
readings AS (SELECT g.statement_id, g.attempt, l.row_index + 1 AS row_index, l.value_date, l.amount_minor, CASE WHEN (l.direction = 'CREDIT') = (g.debit_column = 2) THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
  CASE WHEN g.balance_column IS NOT NULL THEN l.balance_minor END AS balance_minor, l.external_reference, l.description, CASE WHEN g.opening_column IS NOT NULL THEN 1000000 END AS stated_opening,
  CASE WHEN g.closing_column IS NOT NULL THEN 1000000 + m.moved + CASE WHEN g.statement_id % 13 = 0 THEN 500 ELSE 0 END END AS stated_closing
  FROM good g JOIN printed_lines l USING (statement_id) JOIN moved m USING (statement_id) WHERE l.row_index + 1 >= g.first_data_row),
numbered AS (SELECT *, CASE WHEN direction = 'CREDIT' THEN amount_minor ELSE -amount_minor END AS signed, count(balance_minor) OVER (PARTITION BY statement_id, attempt ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS link FROM readings),
links AS (SELECT *, coalesce(lag(printed) OVER (PARTITION BY statement_id, attempt ORDER BY link), stated) AS previous FROM (SELECT statement_id, attempt, link, sum(signed) AS total, max(balance_minor) AS printed, max(stated_opening) AS stated FROM numbered GROUP BY 1, 2, 3)),
checks AS (SELECT statement_id, attempt, count(*) AS checked, count(*) FILTER (printed <> previous + total) AS breaks FROM links WHERE printed IS NOT NULL AND previous IS NOT NULL GROUP BY 1, 2),
sums AS (SELECT statement_id, attempt, count(*) AS lines, count(balance_minor) AS balances, sum(CASE WHEN direction = 'CREDIT' THEN amount_minor ELSE 0 END) AS credits, sum(CASE WHEN direction = 'CREDIT' THEN 0 ELSE amount_minor END) AS debits,
  max(stated_opening) AS so, max(stated_closing) AS sc, min_by(struct_pack(b := balance_minor, s := signed), row_index) AS f, max_by(struct_pack(b := balance_minor), row_index) AS l, min(value_date) AS first_date, max(value_date) AS last_date FROM numbered GROUP BY 1, 2),
facts AS (SELECT s.*, coalesce(so, f.b - f.s) AS opening, CASE WHEN so IS NOT NULL THEN 'LOCATOR' WHEN f.b IS NOT NULL THEN 'BALANCE_COLUMN' ELSE 'ABSENT' END AS opening_source,
  coalesce(sc, l.b) AS closing, CASE WHEN sc IS NOT NULL THEN 'LOCATOR' WHEN l.b IS NOT NULL THEN 'BALANCE_COLUMN' ELSE 'ABSENT' END AS closing_source, coalesce(c.breaks, 0) AS breaks,
  CASE WHEN coalesce(c.checked, 0) = 0 THEN 'NONE' WHEN 2 * c.breaks > c.checked THEN 'UNRELIABLE' WHEN balances = lines THEN 'FULL' ELSE 'PARTIAL' END AS coverage FROM sums s LEFT JOIN checks c USING (statement_id, attempt)),
judged AS (SELECT *, closing - (opening + credits - debits) AS difference, CASE WHEN coalesce(closing - (opening + credits - debits) = 0, false) AND NOT (coverage IN ('FULL', 'PARTIAL') AND breaks > 0) THEN 'VALID' ELSE 'DISCREPANCY' END AS outcome FROM facts),
tries AS (SELECT g.statement_id, g.attempt, coalesce(j.lines, 0) AS lines, coalesce(j.breaks, 0) AS breaks, coalesce(j.outcome, 'DISCREPANCY') AS outcome FROM good g LEFT JOIN judged j USING (statement_id, attempt)),
standing AS (SELECT a.statement_id, CASE WHEN a.outcome <> 'VALID' AND b.statement_id IS NOT NULL AND (b.outcome = 'VALID' OR b.breaks < a.breaks) THEN 1 ELSE 0 END AS attempt FROM tries a LEFT JOIN tries b ON b.statement_id = a.statement_id AND b.attempt = 1 WHERE a.attempt = 0),
ends AS (SELECT r.*, s.statement_id, s.attempt, CASE WHEN r.account_id IS NULL THEN 'We couldn''t tell which account this statement covers. Please upload it again.' WHEN r.currency = 'XXX' THEN 'This account is held in a currency we can''t read amounts in yet. Please get in touch.'
  WHEN NOT r.stored THEN 'We couldn''t open the file that was uploaded. Please upload it again.' WHEN s.statement_id IS NULL THEN 'We couldn''t work out how this statement is laid out. Please upload a clearer copy, or export it as a CSV.'
  WHEN t.lines = 0 THEN 'We couldn''t find any transactions in this statement. Please check it covers a period with activity.' END AS failure
  FROM asked r LEFT JOIN standing s ON s.statement_id = r.id LEFT JOIN tries t ON t.statement_id = s.statement_id AND t.attempt = s.attempt)
"""


@query(
    "parse_statements",
    READINGS + """SELECT e.id AS statement_id, e.workspace_id, e.account_id, CASE WHEN failure IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS state, failure, j.attempt, j.outcome, CAST(j.opening AS BIGINT) AS opening, j.opening_source,
  CAST(j.closing AS BIGINT) AS closing, j.closing_source, CAST(j.credits AS BIGINT) AS credits, CAST(j.debits AS BIGINT) AS debits, CAST(j.difference AS BIGINT) AS difference, j.lines, j.breaks, j.coverage,
  CAST(CASE WHEN failure IS NULL THEN CASE WHEN e.period_start IS NOT NULL AND e.period_end IS NOT NULL THEN e.period_start ELSE first_date END END AS VARCHAR) AS period_start, CAST(CASE WHEN failure IS NULL THEN CASE WHEN e.period_start IS NOT NULL AND e.period_end IS NOT NULL THEN e.period_end ELSE last_date END END AS VARCHAR) AS period_end,
  CASE WHEN failure IS NULL THEN CASE WHEN e.period_start IS NOT NULL AND e.period_end IS NOT NULL THEN 'DECLARED' ELSE 'DERIVED' END END AS period_source
FROM ends e LEFT JOIN judged j ON e.failure IS NULL AND j.statement_id = e.statement_id AND j.attempt = e.attempt""",
)
def parse_statements(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, keep=False)[0]


KEPT = "kept AS (SELECT n.*, e.account_id FROM ends e JOIN numbered n ON n.statement_id = e.statement_id AND n.attempt = e.attempt WHERE e.failure IS NULL)"


@query("parse_lines", READINGS + f", {KEPT} SELECT statement_id, CAST(row_index AS INTEGER) AS row_index, CAST(value_date AS VARCHAR) AS value_date, amount_minor, direction, CAST(balance_minor AS BIGINT) AS balance_minor, external_reference, description, account_id FROM kept")
def parse_lines(spark: SparkSession, d: str) -> DataFrame:
    settled, lines = _parsed(spark, d, keep=True)
    return parsing.kept(lines, settled).drop("attempt", "workspace_id")


@query(
    "parse_ledger",
    READINGS + f", {KEPT}, identified AS (SELECT statement_id, row_index, account_id, value_date, amount_minor, direction, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS description_normalized, external_reference FROM kept)" + PROMOTED
    + "SELECT * REPLACE (CAST(value_date AS VARCHAR) AS value_date) FROM promoted",
)
def parse_ledger(spark: SparkSession, d: str) -> DataFrame:
    settled, lines = _parsed(spark, d, keep=True)
    return ledger.promote(parsing.kept(lines, settled).withColumn("description_normalized", normalize_description(F.col("description"))))


FLOW = """
WITH asked AS (SELECT * FROM flow_requests WHERE state IN ('PARSING', 'VALIDATING')),
mapped AS (SELECT s.*, f.workspace_id, f.content_hash, f.created_on FROM structures s JOIN flow_requests f ON f.id = s.statement_id WHERE s.attempt = 0 AND s.statement_id % 4 <> 0 AND s.statement_id % 5 = 2 AND s.credit_column IS NOT NULL),
donors AS (SELECT a.id, arg_min(m.statement_id, struct_pack(c := m.created_on, i := m.statement_id)) AS donor FROM asked a JOIN mapped m ON m.workspace_id = a.workspace_id AND m.content_hash = a.content_hash AND m.statement_id <> a.id WHERE a.path = 'TEXT' GROUP BY 1),
fit AS (SELECT * FROM asked WHERE account_id IS NOT NULL AND currency <> 'XXX' AND stored),
good AS (
  SELECT s.statement_id, s.attempt, s.first_data_row, s.debit_column, s.balance_column, s.opening_column, s.closing_column, false AS scanned FROM structures s JOIN fit f ON f.id = s.statement_id WHERE f.path = 'TEXT' AND s.credit_column IS NOT NULL AND s.statement_id NOT IN (SELECT id FROM donors)
  UNION ALL SELECT f.id, 0, m.first_data_row, m.debit_column, m.balance_column, m.opening_column, m.closing_column, false FROM fit f JOIN donors d ON d.id = f.id JOIN mapped m ON m.statement_id = d.donor
  UNION ALL SELECT id, 0, 0, 2, 4, CASE WHEN id % 4 <> 1 THEN 1 END, CASE WHEN id % 5 <> 1 THEN 3 END, true FROM fit WHERE path = 'SCANNED' AND id % 30 <> 1
    AND NOT (id % 42 = 13 AND id IN (SELECT statement_id FROM printed_lines WHERE row_index = 1))),
moved AS """ + READINGS.split("moved AS", 1)[1].replace("l.row_index + 1 AS row_index", "l.row_index + CASE WHEN g.scanned THEN 0 ELSE 1 END AS row_index").replace(
    "WHERE l.row_index + 1 >= g.first_data_row", "WHERE CASE WHEN g.scanned THEN l.row_index % 11 <> 5 ELSE l.row_index + 1 >= g.first_data_row END"
)
FLOW_STATEMENTS = """SELECT e.id AS statement_id, e.workspace_id, e.account_id, CASE WHEN failure IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS state, failure, j.attempt, j.outcome, CAST(j.opening AS BIGINT) AS opening, j.opening_source,
  CAST(j.closing AS BIGINT) AS closing, j.closing_source, CAST(j.credits AS BIGINT) AS credits, CAST(j.debits AS BIGINT) AS debits, CAST(j.difference AS BIGINT) AS difference, j.lines, j.breaks, j.coverage,
  CAST(CASE WHEN failure IS NULL THEN CASE WHEN e.period_start IS NOT NULL AND e.period_end IS NOT NULL THEN e.period_start ELSE first_date END END AS VARCHAR) AS period_start, CAST(CASE WHEN failure IS NULL THEN CASE WHEN e.period_start IS NOT NULL AND e.period_end IS NOT NULL THEN e.period_end ELSE last_date END END AS VARCHAR) AS period_end,
  CASE WHEN failure IS NULL THEN CASE WHEN e.period_start IS NOT NULL AND e.period_end IS NOT NULL THEN 'DECLARED' ELSE 'DERIVED' END END AS period_source
FROM ends e LEFT JOIN judged j ON e.failure IS NULL AND j.statement_id = e.statement_id AND j.attempt = e.attempt"""


def _flow(spark: SparkSession, d: str) -> statement_flow.Flow:
    """Text and scanned statements, some of which were mapped before, a reader's slips among the scans."""
    requests, rows, structures = load(spark, d, "flow_requests"), load(spark, d, "printed_lines"), _structures(spark, d).drop("pinned")
    mappings = structures.where("attempt = 0 and statement_id % 4 <> 0 and statement_id % 5 = 2")
    files = _balance_files(spark, d).join(requests.where("path = 'TEXT'").select(F.col("id").alias("statement_id")), "statement_id", "left_semi")
    i = F.col("statement_id")
    scanned = requests.where("path = 'SCANNED'").select(F.col("id").alias("statement_id"), "currency")
    lines = scanned.join(rows, "statement_id")
    moved = lines.groupBy("statement_id", "currency").agg(F.sum(chain.signed(F.col("direction"), F.col("amount_minor"))).alias("moved"))
    ends = scanned.join(moved.drop("currency"), "statement_id", "left").fillna(0, ["moved"])
    closing = F.col("moved") + 1000000 + F.when(i % 13 == 0, 500).otherwise(0)
    scans = ends.select(
        "statement_id", F.when(i % 30 == 1, "DYM").otherwise("DMY").alias("date_order"), F.lit(".").alias("decimal_separator"),
        F.when(i % 4 != 1, _printed(F.lit(1000000), F.col("currency"))).alias("opening"), F.when(i % 5 != 1, _printed(closing, F.col("currency"))).alias("closing"),
    )
    amount = _printed(F.col("amount_minor"), F.col("currency"))
    ill = (i % 42 == 13) & (F.col("row_index") == 1)
    scanned_rows = lines.select(
        "statement_id", "row_index", F.when(ill, None).when(F.col("row_index") % 11 == 5, "31 Feb").otherwise(F.date_format("value_date", "dd/MM/yyyy")).alias("date"), F.concat(F.lit(" "), F.col("description"), F.lit(" ")).alias("description"),
        *[F.when(F.col("direction") == side, amount).alias(side.lower()) for side in ("DEBIT", "CREDIT")], F.nullif(_printed(F.col("balance_minor"), F.col("currency")), F.lit("")).alias("balance"), F.coalesce("external_reference", F.lit("0000")).alias("reference"),
    )
    return statement_flow.run(requests, bank_files.csv_grid(files), structures, mappings, scans, scanned_rows)


@query("flow_statements", FLOW + FLOW_STATEMENTS)
def flow_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements through the whole flow, whichever way they are read."""
    return _flow(spark, d).settled


@query("flow_lines", FLOW + f", {KEPT} SELECT statement_id, CAST(row_index AS INTEGER) AS row_index, CAST(value_date AS VARCHAR) AS value_date, amount_minor, direction, CAST(balance_minor AS BIGINT) AS balance_minor, external_reference, description, account_id FROM kept")
def flow_lines(spark: SparkSession, d: str) -> DataFrame:
    return _flow(spark, d).lines.drop("attempt", "workspace_id")


FLOW_REPORT = """, sizes AS (SELECT statement_id, count(*) AS n, min(value_date) AS first_date, max(value_date) AS last_date FROM printed_lines GROUP BY 1),
reported AS (SELECT s.statement_id, r.workspace_id, r.path, s.attempt, coalesce(j.lines, 0) AS lines, coalesce(j.breaks, 0) AS breaks, coalesce(c.checked, 0) AS checked, CAST(j.opening AS BIGINT) AS opening, coalesce(j.opening_source, 'ABSENT') AS opening_source, CAST(j.closing AS BIGINT) AS closing, coalesce(j.closing_source, 'ABSENT') AS closing_source,
  CAST(j.difference AS BIGINT) AS difference, coalesce(j.outcome, 'DISCREPANCY') AS outcome, coalesce(j.coverage, 'NONE') AS coverage, CAST(j.first_date AS VARCHAR) AS first_date, CAST(j.last_date AS VARCHAR) AS last_date,
  CASE WHEN r.path = 'TEXT' THEN 2 + coalesce(z.n, 0) END AS grid_rows, CASE WHEN r.path = 'TEXT' THEN 1 END AS header_row, CASE WHEN r.path = 'TEXT' THEN g.first_data_row END AS first_data_row,
  CASE WHEN r.path = 'SCANNED' THEN (coalesce(z.n, 0) + 6) // 11 ELSE 0 END AS skips, CASE WHEN r.path = 'TEXT' THEN CASE WHEN g.first_data_row > 2 THEN coalesce(z.n, 0) ELSE 0 END END AS excluded_rows, CAST(z.first_date AS VARCHAR) AS shut_first, CAST(z.last_date AS VARCHAR) AS shut_last, z.n
  FROM standing s JOIN asked r ON r.id = s.statement_id JOIN good g ON g.statement_id = s.statement_id AND g.attempt = s.attempt LEFT JOIN judged j ON j.statement_id = s.statement_id AND j.attempt = s.attempt LEFT JOIN checks c ON c.statement_id = s.statement_id AND c.attempt = s.attempt LEFT JOIN sizes z ON z.statement_id = s.statement_id)
"""
REPORTED = "statement_id, workspace_id, path, attempt, lines, breaks, checked, opening, opening_source, closing, closing_source, difference, outcome, coverage, first_date, last_date, grid_rows, header_row, first_data_row, skips, excluded_rows"


@query("flow_report", FLOW + FLOW_REPORT + f"SELECT {REPORTED} FROM reported")
def flow_report(spark: SparkSession, d: str) -> DataFrame:
    """What was done with each reading that stands."""
    return _flow(spark, d).report.select(*REPORTED.split(", "))


_SAID = " || ".join(f"' {n}=' || " + " || '/' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'none')" for c in columns) for n, columns in (("path", ["path"]), ("rows", ["grid_rows"]), ("header", ["header_row"]), ("from", ["first_data_row"]), ("lines", ["lines"]), ("skipped", ["skips"]), ("first", ["first_date"]), ("last", ["last_date"]), ("opening", ["opening", "opening_source"]), ("closing", ["closing", "closing_source"]), ("difference", ["difference"]), ("outcome", ["outcome"]), ("shut_out", ["excluded_rows"]), ("chain", ["coverage"]), ("links", ["checked"]), ("breaks", ["breaks"])))


@query(
    "flow_log",
    FLOW + FLOW_REPORT + f"""SELECT statement_id, 0 AS line, 'statement=' || statement_id || {_SAID} AS text FROM reported
UNION ALL SELECT statement_id, 1, 'statement=' || statement_id || ' skipped_by: no date=' || skips || ' at ' || array_to_string(list_transform(range(5, CAST(n + 1 AS BIGINT), 11), lambda x: CAST(x AS VARCHAR)), ',') FROM reported WHERE skips > 0
UNION ALL SELECT statement_id, 3, 'statement=' || statement_id || ' shut_out: ' || excluded_rows || ' rows 2-' || (n + 1) || ' dated ' || shut_first || ' to ' || shut_last FROM reported WHERE excluded_rows > 0""",
)
def flow_log(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each reading's report; where balances break, balance_chain_report has the same text by itself."""
    return statement_flow.log_lines(_flow(spark, d).report).where("line <> 2")


@query(
    "balance_chain_report",
    ENDS + """, probed AS (SELECT u.statement_id, u.end_row, u.previous, u.total, u.printed, u.n, count(*) FILTER (u.previous + u.total - 2 * l.signed = u.printed) AS flips, max(CASE WHEN u.previous + u.total - 2 * l.signed = u.printed THEN l.row_index END) AS flipped,
  count(*) FILTER (u.previous + u.total - l.signed = u.printed) AS extras, max(CASE WHEN u.previous + u.total - l.signed = u.printed THEN l.row_index END) AS extra
  FROM used u JOIN numbered l ON l.statement_id = u.statement_id AND l.link = u.link WHERE u.printed <> u.previous + u.total GROUP BY ALL),
k AS (SELECT *, CASE WHEN flips = 1 THEN 'DIRECTION' WHEN extras >= 1 THEN 'EXTRANEOUS_ROW' WHEN total <> 0 AND (printed - previous - total > 0) = (total > 0) THEN 'MISSING_ROW' WHEN printed <> previous THEN 'AMOUNT' ELSE 'UNEXPLAINED' END AS kind FROM probed),
b AS (SELECT *, CASE WHEN kind = 'DIRECTION' THEN flipped WHEN kind = 'EXTRANEOUS_ROW' AND extras = 1 THEN extra WHEN kind = 'AMOUNT' AND n = 1 THEN end_row END AS implicated, row_number() OVER (PARTITION BY statement_id ORDER BY end_row) AS place FROM k),
h AS (SELECT statement_id, string_agg(kind || '=' || n, '; ' ORDER BY kind) AS kinds, CAST(sum(n) AS BIGINT) AS breaks FROM (SELECT statement_id, kind, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1)
SELECT h.*, s.listed, h.breaks > 50 AS truncated FROM h JOIN (SELECT statement_id, string_agg(end_row || ':' || kind || coalesce('->' || implicated, '') || '(' || CAST(printed - previous - total AS BIGINT) || ')', ',' ORDER BY end_row) AS listed FROM b WHERE place <= 50 GROUP BY 1) s USING (statement_id)""",
)
def balance_chain_report(spark: SparkSession, d: str) -> DataFrame:
    return chain.report(chain.breaks(load(spark, d, "printed_lines")))


def _said(*cases: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in cases) + "], lambda x: x IS NOT NULL), '; ')"


def _shaped(column: str, wanted: str) -> list[tuple[str, str]]:
    known = "amount_shape IN ('DEBIT_CREDIT', 'SIGNED_AMOUNT', 'AMOUNT_WITH_INDICATOR')"
    return [(f"{known} AND {wanted} AND {column} IS NULL", f"'{column} is required when amount_shape is ' || amount_shape"), (f"{known} AND NOT {wanted} AND {column} IS NOT NULL", f"'{column} must be null when amount_shape is ' || amount_shape")]


PAIR, SHAPED = "amount_shape = 'DEBIT_CREDIT'", "amount_shape = 'AMOUNT_WITH_INDICATOR'"


@query(
    "verdicts_mapping",
    "WITH p AS (SELECT statement_id, attempt, " + _said(("first_data_row < 0", "'first_data_row must be a place'"), ("amount_shape = 'BOTH'", "'amount_shape is unknown'"), ("date_order = 'YDM'", "'date_order is unknown'"), *_shaped("debit_column", PAIR), *_shaped("credit_column", PAIR), *_shaped("amount_column", f"NOT ({PAIR})"), *_shaped("indicator_column", SHAPED))
    + " AS problems FROM mapping_answers) SELECT * FROM p WHERE problems <> ''",
)
def verdicts_mapping(spark: SparkSession, d: str) -> DataFrame:
    answers = load(spark, d, "mapping_answers").withColumn("description_columns", F.array(F.lit(1)))
    return verdicts.malformed(answers, verdicts.mapping_problems(), "statement_id", "attempt")


@query(
    "verdicts_match",
    "WITH p AS (SELECT invoice_id, " + _said(("verdict = 'PERHAPS'", "'verdict is unknown'"), ("candidate < 0", "'candidate must not be negative'"), ("reason IS NULL OR reason = ''", "'reason is required'"), ("verdict = 'SAME' AND candidate IS NULL", "'Choose the payment you mean, or answer DIFFERENT.'"), ("verdict = 'DIFFERENT' AND candidate IS NOT NULL", "'DIFFERENT means none of these payments. Leave the candidate empty.'"))
    + " AS problems FROM match_answers) SELECT * FROM p WHERE problems <> ''",
)
def verdicts_match(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.malformed(load(spark, d, "match_answers"), verdicts.adjudication_problems(), "invoice_id")


@query(
    "verdicts_payment",
    "WITH p AS (SELECT transaction_id, " + _said(("needs_document AND reason IS NULL", "'reason is required when needs_document is true'"), ("NOT confident AND question IS NULL", "'clarification is required when confident is false'"), ("NOT confident AND needs_document", "'needs_document must be false when confident is false; ask instead'"), ("confident AND question IS NOT NULL", "'clarification must be null when confident is true'"), ("question = '' OR (question IS NOT NULL AND choices < 2)", "'clarification must be a question with two answers or more'"))
    + " AS problems FROM payment_answers) SELECT * FROM p WHERE problems <> ''",
)
def verdicts_payment(spark: SparkSession, d: str) -> DataFrame:
    answers = load(spark, d, "payment_answers").withColumn("options", F.when(F.col("question").isNotNull(), F.slice(F.array(F.lit("Rent"), F.lit("Stock")), F.lit(1), F.col("choices"))))
    return verdicts.malformed(answers, verdicts.judgement_problems(), "transaction_id")


@query(
    "report_counts",
    """SELECT workspace_id, coalesce(p.n, 0) AS transactions_processed, coalesce(q.n, 0) AS open_questions FROM (SELECT workspace_id, count(*) AS n FROM transactions GROUP BY 1) p
FULL JOIN (SELECT workspace_id, count(*) AS n FROM questions WHERE NOT answered GROUP BY 1) q USING (workspace_id)""",
)
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.counts(*_tables(spark, d, "transactions questions"))


@query("export_order")
def export_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each payment in its workspace's export; how texts are ordered is the collation's, which SQL here lacks."""
    transactions, requirements, accounts, questions = _tables(spark, d, "transactions requirements accounts questions")
    rows = R.export_rows(transactions, requirements, accounts, _documents(spark, d), questions)
    rows = rows.join(transactions.select(F.col("id").alias("transaction_id"), "workspace_id"), "transaction_id")
    return R.placed(rows).select("workspace_id", "transaction_id", "place")


@query(
    "export_generate",
    """WITH n AS (SELECT workspace_id, count(*) AS n FROM transactions GROUP BY 1)
SELECT e.id, e.workspace_id, CASE WHEN e.state = 'GENERATING' THEN 'READY' ELSE e.state END AS state, 'tallyline-reconciliation-' || strftime(e.requested_on, '%Y-%m-%d') || '.xlsx' AS filename,
  CASE WHEN e.state = 'GENERATING' THEN 'workspaces/' || e.workspace_id || '/exports/' || e.id || '/tallyline-reconciliation-' || strftime(e.requested_on, '%Y-%m-%d') || '.xlsx' END AS storage_key, CASE WHEN e.state = 'GENERATING' THEN coalesce(n.n, 0) END AS transaction_count, e.state = 'GENERATING' AS generated
FROM export_requests e LEFT JOIN n USING (workspace_id)""",
)
def export_generate(spark: SparkSession, d: str) -> DataFrame:
    return R.generated(*_tables(spark, d, "export_requests transactions"))


STEPS = (
    DECISIONS + ", shown_words AS (" + SENTENCES.strip().replace("chr(10)", "' · '").replace("SELECT invoice, transaction, ", "SELECT invoice, transaction, rank, ", 1) + """),
primaries AS (SELECT invoice_id, arg_min(document_id, CASE WHEN is_primary THEN 0 ELSE 10000000000 END + document_id) AS document_id FROM invoice_documents GROUP BY 1),
tallied AS (SELECT invoice, count(*) AS n, arg_min(transaction, rank) AS anchor FROM candidates GROUP BY 1),
asking AS (SELECT i.id AS invoice, i.transaction_id AS held, s.transaction_id AS bound, d.kind, d.blocked_by, d.transaction AS chosen, coalesce(n.n, 0) AS n, n.anchor, u.reason AS duplicate, w.sentences,
    CASE WHEN i.transaction_id IS NULL THEN coalesce(s.transaction_id, CASE WHEN d.kind = 'AUTO_MATCH' THEN d.transaction END) END AS wants, s.transaction_id IS NOT NULL AS by_user
  FROM invoices i JOIN decided d ON d.invoice = i.id LEFT JOIN tallied n ON n.invoice = i.id LEFT JOIN duplicates u ON u.invoice = i.id LEFT JOIN shown_words w ON w.invoice = i.id AND w.rank = 0
  LEFT JOIN primaries p ON p.invoice_id = i.id LEFT JOIN supporting_documents s ON s.id = p.document_id),
given AS (SELECT *, CASE WHEN wants IS NOT NULL THEN wants NOT IN (SELECT transaction_id FROM invoices WHERE transaction_id IS NOT NULL) AND row_number() OVER (PARTITION BY wants ORDER BY CASE WHEN by_user THEN 0 ELSE 1 END, invoice) = 1 END AS gets FROM asking),
steps AS (SELECT invoice, anchor, CASE WHEN held IS NOT NULL OR gets THEN 'LINKED' WHEN wants IS NOT NULL THEN 'NEEDS_REVIEW' WHEN duplicate IS NOT NULL THEN 'DUPLICATE' WHEN kind = 'NO_MATCH' THEN 'NOT_FOUND' ELSE 'NEEDS_REVIEW' END AS outcome,
  CASE WHEN held IS NOT NULL THEN held WHEN gets THEN wants END AS transaction, CASE WHEN held IS NOT NULL OR bound IS NOT NULL THEN 0 ELSE n END AS candidates,
  CASE WHEN held IS NOT NULL THEN 'Already linked to a payment.' WHEN gets AND by_user THEN 'You chose this payment.' WHEN gets THEN sentences WHEN wants IS NOT NULL THEN 'That payment already has an invoice.' WHEN duplicate IS NOT NULL THEN duplicate
    WHEN kind = 'NO_MATCH' THEN 'We couldn''t find a payment on your statements that matches this.' ELSE blocked_by END AS reason, held IS NULL AND bound IS NULL AS judged FROM given)
"""
)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    joins, documents = _tables(spark, d, "invoice_documents supporting_documents")
    invoices, candidates, duplicates, decided = _matching(spark, d)
    return M.outcomes(invoices, V.primary_documents(joins), documents, candidates, duplicates, decided)


@query("match_outcomes", STEPS + "SELECT invoice, outcome, transaction, candidates, reason FROM steps")
def match_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).select("invoice", "outcome", "transaction", "candidates", "reason")


@query(
    "match_anchor_moves",
    STEPS + "SELECT DISTINCT r.id AS requirement_id, r.state AS before, 'NEEDS_REVIEW' AS after FROM steps s JOIN requirements r ON r.transaction_id = s.anchor WHERE s.judged AND s.outcome IN ('NEEDS_REVIEW', 'DUPLICATE') AND r.method IS NULL AND r.state <> 'NEEDS_REVIEW'",
)
def match_anchor_moves(spark: SparkSession, d: str) -> DataFrame:
    return M.anchor_moves(_steps(spark, d), load(spark, d, "requirements"))


@query("match_proposals", DECISIONS + "SELECT d.invoice, d.kind, d.blocked_by, coalesce(n.n, 0) AS candidates, u.invoice IS NOT NULL AS suspected_duplicate, v.verdict FROM decided d LEFT JOIN (SELECT invoice, count(*) AS n FROM candidates GROUP BY 1) n USING (invoice) LEFT JOIN duplicates u USING (invoice) LEFT JOIN said v ON v.invoice_id = d.invoice AND n.n IS NOT NULL")
def match_proposals(spark: SparkSession, d: str) -> DataFrame:
    _, candidates, duplicates, decided = _matching(spark, d)
    return M.proposals(decided, candidates, duplicates, load(spark, d, "adjudications"))


MAIL = """mail_of AS (SELECT m.requirement_id, j.document_id, m.id AS email_id, m.sender, m.subject, coalesce(c.email, 'a disconnected mailbox') AS mailbox FROM mails m JOIN mail_documents j ON j.email_id = m.id
  LEFT JOIN connections c ON c.id = m.connection_id AND c.state <> 'DISCONNECTED' QUALIFY row_number() OVER (PARTITION BY m.requirement_id, j.document_id ORDER BY m.id) = 1)"""


@query("review_mail", f"WITH {MAIL} SELECT * FROM mail_of")
def review_mail(spark: SparkSession, d: str) -> DataFrame:
    mails, joins, connections = _tables(spark, d, "mails mail_documents connections")
    return V.retrieved_mail(mails, joins, connections.where("state <> 'DISCONNECTED'"))


@query(
    "review_page",
    CANDIDATES + f""", {MAIL}, shown_words AS ({SENTENCES.strip()}),
primaries AS (SELECT invoice_id, arg_min(document_id, CASE WHEN is_primary THEN 0 ELSE 10000000000 END + document_id) AS document_id FROM invoice_documents GROUP BY 1),
asked AS (SELECT * FROM requirements WHERE state = 'NEEDS_REVIEW'),
rows AS (SELECT r.id AS requirement_id, r.transaction_id, 0 AS tier, c.rank AS rank, c.invoice, p.document_id, w.sentences AS evidence FROM asked r JOIN candidates c ON c.transaction = r.transaction_id JOIN primaries p ON p.invoice_id = c.invoice JOIN shown_words w ON w.invoice = c.invoice AND w.transaction = c.transaction
  UNION ALL SELECT r.id, r.transaction_id, 1, 0, NULL, m.document_id, 'We couldn''t read the details from this document' FROM asked r JOIN mail_of m ON m.requirement_id = r.id JOIN supporting_documents s ON s.id = m.document_id WHERE s.state = 'UNREADABLE' AND s.transaction_id IS NULL)
SELECT x.requirement_id, x.invoice, x.document_id, s.filename, s.source, i.vendor_name, i.invoice_number, CAST(i.invoice_date AS VARCHAR) AS invoice_date, i.total_minor, i.currency, x.evidence, '/api/documents/' || x.document_id AS preview, m.sender, m.subject, m.mailbox,
  CAST(row_number() OVER (PARTITION BY x.requirement_id ORDER BY tier, x.rank, x.invoice, x.document_id) AS INTEGER) AS place
FROM rows x JOIN supporting_documents s ON s.id = x.document_id LEFT JOIN invoices i ON i.id = x.invoice LEFT JOIN mail_of m ON m.requirement_id = x.requirement_id AND m.document_id = x.document_id
WHERE NOT EXISTS (SELECT 1 FROM rejections j WHERE j.transaction_id = x.transaction_id AND j.document_id = x.document_id)""",
)
def review_page(spark: SparkSession, d: str) -> DataFrame:
    requirements, invoices, joins, documents, rejections, mails, attached, connections = _tables(spark, d, "requirements invoices invoice_documents supporting_documents rejections mails mail_documents connections")
    mail = V.retrieved_mail(mails, attached, connections.where("state <> 'DISCONNECTED'"))
    return V.page(requirements, cut(_candidates(spark, d)), cut(invoices), joins, documents, rejections, mail)
