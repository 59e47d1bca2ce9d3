"""Queries on statements, ledgers and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_description
from ..operators import chain, ledger, walk
from ..sources import bank_files
from .domain import load
from .queries import query


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "printed_lines")


ENDS = """
WITH signed_lines AS (SELECT *, CASE WHEN direction = 'CREDIT' THEN amount_minor ELSE -amount_minor END AS signed FROM printed_lines),
totals AS (SELECT statement_id, CAST(sum(CASE WHEN direction = 'CREDIT' THEN amount_minor ELSE 0 END) AS BIGINT) AS credits, CAST(sum(CASE WHEN direction = 'CREDIT' THEN 0 ELSE amount_minor END) AS BIGINT) AS debits,
  min_by(struct_pack(b := balance_minor, s := signed), row_index) AS f, max_by(struct_pack(b := balance_minor), row_index) AS l FROM signed_lines GROUP BY 1),
ends AS (SELECT statement_id, credits, debits, CAST(f.b - f.s AS BIGINT) AS opening, CAST(l.b AS BIGINT) AS closing FROM totals),
numbered AS (SELECT *, count(balance_minor) OVER (PARTITION BY statement_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS link FROM signed_lines),
grouped AS (SELECT statement_id, link, sum(signed) AS total, max(balance_minor) AS printed, count(*) AS n, max(row_index) AS end_row FROM numbered GROUP BY 1, 2),
links AS (SELECT *, lag(printed) OVER (PARTITION BY statement_id ORDER BY link) AS previous FROM grouped),
used AS (SELECT * FROM links WHERE printed IS NOT NULL AND previous IS NOT NULL),
cover AS (SELECT s.statement_id, coalesce(c.checked, 0) AS checked, coalesce(c.broken, 0) AS breaks,
  CASE WHEN coalesce(c.checked, 0) = 0 THEN 'NONE' WHEN 2 * c.broken > c.checked THEN 'UNRELIABLE' WHEN s.balances = s.n THEN 'FULL' ELSE 'PARTIAL' END AS coverage
  FROM (SELECT statement_id, count(*) AS n, count(balance_minor) AS balances FROM signed_lines GROUP BY 1) s
  LEFT JOIN (SELECT statement_id, count(*) AS checked, count(*) FILTER (printed <> previous + total) AS broken FROM used GROUP BY 1) c USING (statement_id))
"""


@query("statement_totals", ENDS + "SELECT *, CAST(closing - (opening + credits - debits) AS BIGINT) AS difference FROM ends")
def statement_totals(spark: SparkSession, d: str) -> DataFrame:
    return chain.totals(_lines(spark, d)).withColumn("difference", chain.difference())


@query("balance_chain_coverage", ENDS + "SELECT * FROM cover")
def balance_chain_coverage(spark: SparkSession, d: str) -> DataFrame:
    return chain.coverage(_lines(spark, d))


@query(
    "balance_chain_breaks",
    ENDS + """, probed AS (SELECT u.statement_id, u.end_row, u.previous, u.total, u.printed, u.n, count(*) FILTER (u.previous + u.total - 2 * l.signed = u.printed) AS flips, max(CASE WHEN u.previous + u.total - 2 * l.signed = u.printed THEN l.row_index END) AS flipped,
  count(*) FILTER (u.previous + u.total - l.signed = u.printed) AS extras, max(CASE WHEN u.previous + u.total - l.signed = u.printed THEN l.row_index END) AS extra
  FROM used u JOIN numbered l ON l.statement_id = u.statement_id AND l.link = u.link WHERE u.printed <> u.previous + u.total GROUP BY ALL),
k AS (SELECT *, CASE WHEN flips = 1 THEN 'DIRECTION' WHEN extras >= 1 THEN 'EXTRANEOUS_ROW' WHEN total <> 0 AND (printed - previous - total > 0) = (total > 0) THEN 'MISSING_ROW' WHEN printed <> previous THEN 'AMOUNT' ELSE 'UNEXPLAINED' END AS kind FROM probed)
SELECT statement_id, end_row AS row_index, CAST(previous + total AS BIGINT) AS expected, CAST(printed AS BIGINT) AS printed, CAST(printed - previous - total AS BIGINT) AS delta, kind,
  CASE WHEN kind = 'DIRECTION' THEN flipped WHEN kind = 'EXTRANEOUS_ROW' AND extras = 1 THEN extra WHEN kind = 'AMOUNT' AND n = 1 THEN end_row END AS implicated FROM k""",
)
def balance_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    return chain.breaks(_lines(spark, d))


@query(
    "statement_validation",
    ENDS + """SELECT e.*, c.checked, c.breaks, c.coverage, CAST(closing - (opening + credits - debits) AS BIGINT) AS difference,
  CASE WHEN coalesce(closing - (opening + credits - debits) = 0, false) AND NOT (coverage IN ('FULL', 'PARTIAL') AND breaks > 0) THEN 'VALID' ELSE 'DISCREPANCY' END AS outcome FROM ends e JOIN cover c USING (statement_id)""",
)
def statement_validation(spark: SparkSession, d: str) -> DataFrame:
    return chain.validation(_lines(spark, d))


def _identified(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a few accounts' overlapping statements: coarse days and amounts, so that identities repeat."""
    return load(spark, d, "lines").select(
        "statement_id", "row_index", (F.col("statement_id") % 40).alias("account_id"), F.trunc("value_date", "year").alias("value_date"),
        (F.col("amount_minor") % 3).alias("amount_minor"), "direction", normalize_description(F.col("description")).alias("description_normalized"),
        F.when(F.col("external_reference").isNotNull(), F.concat(F.lit("T"), (F.col("l_partkey") % 50).cast("string"))).alias("external_reference"),
    )


IDENTIFIED = """
WITH identified AS (SELECT statement_id, row_index, statement_id % 40 AS account_id, date_trunc('year', value_date) AS value_date, amount_minor % 3 AS amount_minor, direction,
  trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS description_normalized, CASE WHEN external_reference IS NOT NULL THEN 'T' || l_partkey % 50 END AS external_reference FROM lines)
"""
PROMOTED = """, seats AS (SELECT account_id, value_date, amount_minor, direction, description_normalized, NULL AS external_reference, 0 AS tier, nth AS a, 0 AS b, count(*) AS lines FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, value_date, amount_minor, direction, description_normalized, statement_id ORDER BY row_index) AS nth FROM identified WHERE external_reference IS NULL) GROUP BY ALL),
owners AS (SELECT *, count(*) OVER (PARTITION BY account_id, external_reference) AS lines FROM identified WHERE external_reference IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY account_id, external_reference ORDER BY statement_id, row_index) = 1),
every AS (SELECT * FROM seats UNION ALL SELECT account_id, value_date, amount_minor, direction, description_normalized, external_reference, 1, statement_id, row_index, lines FROM owners),
promoted AS (SELECT account_id, value_date, amount_minor, direction, description_normalized, external_reference, lines,
  CAST(row_number() OVER (PARTITION BY account_id, value_date, amount_minor, direction, description_normalized ORDER BY tier, a, b, external_reference) - 1 AS INTEGER) AS occurrence_index FROM every)
"""


@query("promote_ledger", IDENTIFIED + PROMOTED + "SELECT * REPLACE (CAST(CAST(value_date AS DATE) AS VARCHAR) AS value_date) FROM promoted")
def promote_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.promote(_identified(spark, d))


KEYS = "account_id, value_date, amount_minor, direction, description_normalized"


@query(
    "promote_relink",
    IDENTIFIED.replace("identified AS", "every_line AS") + ", identified AS (SELECT * FROM every_line WHERE statement_id % 3 = 0)" + PROMOTED + f""",
ledger AS (SELECT *, row_number() OVER (ORDER BY {KEYS}, occurrence_index) AS id FROM promoted),
incoming AS (SELECT *, CASE WHEN external_reference IS NULL THEN row_number() OVER (PARTITION BY {KEYS}, statement_id, external_reference IS NULL ORDER BY row_index) END AS nth FROM every_line WHERE statement_id % 3 <> 0),
held AS (SELECT account_id, external_reference, arg_min(id, occurrence_index) AS by_reference FROM ledger WHERE external_reference IS NOT NULL GROUP BY 1, 2),
free AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY occurrence_index) AS nth FROM ledger WHERE external_reference IS NULL),
j AS (SELECT i.*, coalesce(h.by_reference, f.id) AS linked_to, row_number() OVER (PARTITION BY i.statement_id, i.account_id, i.external_reference ORDER BY i.row_index) = 1 AS first_of
  FROM incoming i LEFT JOIN held h ON h.account_id = i.account_id AND h.external_reference = i.external_reference
  LEFT JOIN free f ON f.account_id = i.account_id AND f.value_date = i.value_date AND f.amount_minor = i.amount_minor AND f.direction = i.direction AND f.description_normalized = i.description_normalized AND f.nth = i.nth),
c AS (SELECT *, linked_to IS NULL AND (external_reference IS NULL OR first_of) AS creates FROM j),
g AS (SELECT {KEYS}, max(occurrence_index) AS greatest FROM ledger GROUP BY ALL)
SELECT c.statement_id, c.row_index, CASE WHEN linked_to IS NOT NULL THEN 'linked' WHEN creates THEN 'created' ELSE 'linked to created' END AS outcome, linked_to IS NOT NULL AS has_link,
  CASE WHEN creates THEN CAST(coalesce(greatest, -1) + sum(CAST(creates AS INT)) OVER (PARTITION BY c.account_id, c.value_date, c.amount_minor, c.direction, c.description_normalized, c.statement_id ORDER BY c.row_index) AS BIGINT) END AS occurrence_index
FROM c LEFT JOIN g USING ({KEYS})""",
)
def promote_relink(spark: SparkSession, d: str) -> DataFrame:
    rows = _identified(spark, d)
    held = ledger.promote(rows.where("statement_id % 3 = 0")).withColumn("id", F.xxhash64(*ledger.IDENTITY, "occurrence_index"))
    out = ledger.relink(rows.where("statement_id % 3 <> 0"), held)
    return out.select("statement_id", "row_index", "outcome", F.col("linked_to").isNotNull().alias("has_link"), "occurrence_index")


def _money(minor: Column) -> Column:
    return F.format_string("%d.%02d", F.floor(minor / 100), minor % 100)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Bank files as CSV bytes: a title, a header, and a row for each line, some followed by its narration; delimiters and encodings vary."""
    rows = load(spark, d, "lines").withColumn("m", F.floor(F.col("amount_minor") % 1000000))
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("statement_id") % 3 + 1).cast("int"))
    day = F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.date_format("value_date", "dd/MM/yyyy"))
    text = F.concat(F.lit('"'), F.col("description"), F.lit(', ""x"""'))
    debit, credit = (F.when(F.col("direction") == x, _money(F.col("m"))).otherwise("") for x in ("DEBIT", "CREDIT"))
    line = F.concat_ws("\x01", day, text, debit, credit, F.coalesce("external_reference", F.lit("0000")))
    line = F.when(F.col("l_suppkey") % 11 == 0, F.concat_ws("\n", line, F.concat_ws("\x01", F.lit(""), F.concat(F.lit("more of "), F.col("l_suppkey")), F.lit(""), F.lit(""), F.lit("")))).otherwise(line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", line.alias("line")))), lambda x: x["line"]), "\n")
    whole = F.concat(F.lit("Statement\n\nDate\x01Text\x01Debit\x01Credit\x01Ref\n"), body)
    files = rows.groupBy("statement_id").agg(F.first(sep).alias("sep"), whole.alias("text"))
    text = F.replace("text", F.lit("\x01"), "sep")
    return files.select("statement_id", F.when(F.col("statement_id") % 5 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-8")).alias("content"))


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    null = F.lit(None).cast("int")
    return load(spark, d, "lines").select("statement_id").distinct().select(
        "statement_id", F.lit(2).alias("header_row"), F.when(F.col("statement_id") % 6 == 0, 5).otherwise(3).alias("first_data_row"), F.lit(0).alias("date_column"), F.lit("DMY").alias("date_order"),
        F.array(F.lit(1)).alias("description_columns"), F.lit(4).alias("reference_column"), null.alias("balance_column"), F.lit("DEBIT_CREDIT").alias("amount_shape"), F.lit(2).alias("debit_column"), F.lit(3).alias("credit_column"),
        null.alias("amount_column"), null.alias("indicator_column"), F.lit(".").alias("decimal_separator"), F.lit("USD").alias("currency"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"),
    )


@query("render_sample")
def render_sample(spark: SparkSession, d: str) -> DataFrame:
    return walk.render_sample(bank_files.csv_grid(_files(spark, d)))


def _walked(spark: SparkSession, d: str) -> DataFrame:
    return walk.walk(bank_files.csv_grid(_files(spark, d)), _mapping(spark, d))


#: What the files print, row by row: narration rows push the rows after them down by one.
PRINTED = """
WITH printed AS (SELECT *, row_index + 2 + coalesce(sum(CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY statement_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grid_row,
  CASE WHEN statement_id % 6 = 0 THEN 5 ELSE 3 END AS first_data_row, floor(amount_minor % 1000000) AS m FROM lines),
data AS (SELECT *, CASE WHEN l_suppkey % 7 <> 0 THEN value_date END AS own_date FROM printed WHERE grid_row >= first_data_row),
walked AS (SELECT *, last_value(CASE WHEN m <> 0 THEN own_date END IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY grid_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dated FROM data),
fated AS (SELECT *, CASE WHEN m = 0 THEN 'no amount' WHEN dated IS NULL THEN 'no date' END AS reason FROM walked),
narrations AS (SELECT statement_id, grid_row + 1 AS grid_row, 'more of ' || l_suppkey AS text FROM printed WHERE l_suppkey % 11 = 0 AND grid_row + 1 >= first_data_row),
adopted AS (SELECT n.statement_id, n.grid_row, n.text, (SELECT arg_min(f.grid_row, abs(f.grid_row - n.grid_row) * 2 + CASE WHEN f.grid_row > n.grid_row THEN 1 ELSE 0 END) FROM fated f
  WHERE f.statement_id = n.statement_id AND f.reason IS NULL AND abs(f.grid_row - n.grid_row) <= 2) AS anchor FROM narrations n),
texts AS (SELECT statement_id, anchor, string_agg(text, ' ' ORDER BY grid_row) AS whole FROM (SELECT statement_id, grid_row AS anchor, grid_row, description || ', "x"' AS text FROM fated WHERE reason IS NULL
  UNION ALL SELECT statement_id, anchor, grid_row, text FROM adopted WHERE anchor IS NOT NULL) GROUP BY 1, 2),
skips AS (SELECT statement_id, grid_row AS row_index, reason FROM fated WHERE reason IS NOT NULL UNION ALL SELECT statement_id, grid_row, 'no amount' FROM narrations)
"""


@query(
    "csv_grid",
    PRINTED + """, money AS (SELECT *, (CAST(m AS BIGINT) // 100) || '.' || lpad(CAST(CAST(m % 100 AS BIGINT) AS VARCHAR), 2, '0') AS amount FROM printed),
g AS (SELECT statement_id, grid_row AS row_index, [CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE strftime(value_date, '%d/%m/%Y') END, description || ', "x"', CASE WHEN direction = 'DEBIT' THEN amount ELSE '' END,
    CASE WHEN direction = 'CREDIT' THEN amount ELSE '' END, coalesce(external_reference, '0000')] AS cells FROM money
  UNION ALL SELECT statement_id, grid_row + 1, ['', 'more of ' || l_suppkey, '', '', ''] FROM printed WHERE l_suppkey % 11 = 0
  UNION ALL SELECT statement_id, unnest([0, 1, 2]), unnest([['Statement', '', '', '', ''], ['', '', '', '', ''], ['Date', 'Text', 'Debit', 'Credit', 'Ref']]) FROM (SELECT DISTINCT statement_id FROM printed))
SELECT statement_id, CAST(row_index AS INTEGER) AS row_index, array_to_string(cells, '|') AS cells FROM g""",
)
def csv_grid(spark: SparkSession, d: str) -> DataFrame:
    return bank_files.csv_grid(_files(spark, d)).withColumn("cells", F.array_join("cells", "|"))


@query(
    "walk_lines",
    PRINTED + """SELECT f.statement_id, CAST(f.grid_row AS INTEGER) AS row_index, CAST(dated AS VARCHAR) AS value_date, CAST(m AS BIGINT) AS amount_minor, direction, CAST(NULL AS BIGINT) AS balance_minor, external_reference, t.whole AS description
FROM fated f JOIN texts t ON t.statement_id = f.statement_id AND t.anchor = f.grid_row WHERE reason IS NULL""",
)
def walk_lines(spark: SparkSession, d: str) -> DataFrame:
    return walk.lines(_walked(spark, d))


@query("walk_skipped", PRINTED + "SELECT statement_id, CAST(row_index AS INTEGER) AS row_index, reason FROM skips")
def walk_skipped(spark: SparkSession, d: str) -> DataFrame:
    return walk.skipped(_walked(spark, d))


@query(
    "walk_excluded",
    PRINTED + """SELECT statement_id, count(*) AS rows, CAST(min(grid_row) AS INTEGER) AS first_row, CAST(max(grid_row) AS INTEGER) AS last_row, CAST(min(value_date) AS VARCHAR) AS first_date, CAST(max(value_date) AS VARCHAR) AS last_date
FROM printed WHERE grid_row < first_data_row AND l_suppkey % 7 <> 0 AND m <> 0 GROUP BY 1""",
)
def walk_excluded(spark: SparkSession, d: str) -> DataFrame:
    return walk.excluded(bank_files.csv_grid(_files(spark, d)), _mapping(spark, d))


@query(
    "parse_report",
    PRINTED + """, h AS (SELECT statement_id, reason, count(*) AS n FROM skips GROUP BY 1, 2),
r AS (SELECT statement_id, string_agg(reason || '=' || n, '; ' ORDER BY reason) AS reasons FROM h GROUP BY 1),
s AS (SELECT statement_id, string_agg(row_index, ',' ORDER BY row_index) AS skipped_rows, count(*) AS skips FROM skips GROUP BY 1),
l AS (SELECT statement_id, count(*) AS lines FROM fated WHERE reason IS NULL GROUP BY 1),
a AS (SELECT statement_id FROM fated UNION SELECT statement_id FROM skips)
SELECT statement_id, coalesce(lines, 0) AS lines, coalesce(skips, 0) AS skips, reasons, skipped_rows, false AS truncated FROM a LEFT JOIN l USING (statement_id) LEFT JOIN s USING (statement_id) LEFT JOIN r USING (statement_id)""",
)
def parse_report(spark: SparkSession, d: str) -> DataFrame:
    return walk.parse_report(_walked(spark, d))


@query("pdf_grid")
def pdf_grid(spark: SparkSession, d: str) -> DataFrame:
    """Lines printed on pages: four columns whose items lie a little beside their line and edge."""
    rows = load(spark, d, "lines").withColumns({"doc_id": F.col("statement_id"), "page": F.floor((F.col("row_index") - 1) / 10).cast("int")})
    y = 700 - 12 * (F.col("row_index") % 10) + F.col("l_partkey") % 3 - 1
    items = F.array(*[F.struct(F.lit(i).alias("k"), t.cast("string").alias("text"), x.cast("double").alias("x"), w.cast("double").alias("width")) for i, (t, x, w) in enumerate((
        (F.col("value_date"), F.lit(20) + F.col("l_partkey") % 2, F.lit(50)), (F.col("description"), F.lit(90), 60 + F.col("l_suppkey") % 40), (F.col("amount_minor"), 240 - F.length(F.col("amount_minor").cast("string")) * 5, F.length(F.col("amount_minor").cast("string")) * 5), (F.coalesce("external_reference", F.lit(" ")), F.lit(300), F.lit(30)),
    ))])
    flat = rows.select("doc_id", "page", (F.col("row_index") * 10).alias("at"), y.cast("double").alias("y"), F.explode(items).alias("i")).select("doc_id", "page", (F.col("at") + F.col("i.k")).alias("seq"), "y", "i.text", "i.x", "i.width")
    return bank_files.pdf_grid(flat)
