"""Queries on workspaces, single rows, what a mailbox brought, and answers on documents that can't be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import retrieval as T
from ..operators import verdicts
from ..operators import workflow as W
from ..thresholds import RESULTS_PER_PASS
from .domain import load
from .flow_queries import _said
from .queries import _tables, query


@query(
    "point_lookups",
    """SELECT r.id AS requirement_id, r.resolved_document_id AS id, r.workspace_id, s.id IS NOT NULL AS found, s.filename, s.source
FROM requirements r LEFT JOIN supporting_documents s ON s.id = r.resolved_document_id AND s.workspace_id = r.workspace_id WHERE r.resolved_document_id IS NOT NULL""",
)
def point_lookups(spark: SparkSession, d: str) -> DataFrame:
    requirements, documents = _tables(spark, d, "requirements supporting_documents")
    wanted = requirements.where("resolved_document_id is not null").select(F.col("id").alias("requirement_id"), F.col("resolved_document_id").alias("id"), "workspace_id")
    return W.look_up(wanted, documents.select("id", "workspace_id", "filename", "source"), ["id", "workspace_id"])


@query("workspaces_open", "SELECT c_custkey AS id, c_custkey % 5 AS user_id, c_nationkey AS workspace_id, w.id IS NOT NULL AS allowed FROM customer LEFT JOIN workspaces w ON w.id = c_nationkey AND w.owner_id = c_custkey % 5")
def workspaces_open(spark: SparkSession, d: str) -> DataFrame:
    requests = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("user_id"), F.col("c_nationkey").alias("workspace_id"))
    return W.open_workspaces(load(spark, d, "workspaces"), requests)


@query("workspaces_list", "SELECT owner_id AS user_id, id AS workspace_id, name FROM workspaces JOIN region ON r_regionkey = owner_id")
def workspaces_list(spark: SparkSession, d: str) -> DataFrame:
    return W.list_workspaces(load(spark, d, "workspaces"), load(spark, d, "region").select(F.col("r_regionkey").alias("user_id")))


@query("workspaces_create", "SELECT c_custkey AS id, c_nationkey AS owner_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'A workspace needs a name' END AS refusal FROM customer")
def workspaces_create(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    typed = F.when(n % 3 == 1, F.concat(F.lit("  "), F.col("c_name"), F.lit("\n"))).when(n % 3 == 2, F.col("c_name")).when(n % 2 == 0, "\t\u00a0 \n")
    return W.create_workspaces(load(spark, d, "customer").select(n.alias("id"), F.col("c_nationkey").alias("owner_id"), typed.alias("name")))


@query(
    "message_provenance",
    """WITH d AS (SELECT j.document_id, m.connection_id, m.message_id FROM mail_documents j JOIN mails m ON m.id = j.email_id WHERE j.email_id % 5 <> 0 AND j.email_id % 7 <> 0)
SELECT DISTINCT m.id, d.document_id FROM mails m JOIN d USING (connection_id, message_id)""",
)
def message_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a mail's message already brought, told by the paths of their metadata."""
    mails, joins = _tables(spark, d, "mails mail_documents")
    brought = joins.join(mails.select(F.col("id").alias("email_id"), "connection_id", "message_id"), "email_id")
    metadata = F.to_json(F.struct(F.when(F.col("email_id") % 7 != 0, F.col("connection_id").cast("string")).alias("gmailConnectionId"), F.col("message_id").alias("gmailMessageId")))
    documents = brought.select(F.col("document_id").alias("id"), F.when(F.col("email_id") % 5 != 0, "GMAIL").otherwise("MANUAL_UPLOAD").alias("source"), metadata.alias("source_metadata"))
    asked = mails.select("id", F.col("connection_id").cast("string").alias("connection_id"), "message_id")
    return asked.join(W.fetched_from(documents), ["connection_id", "message_id"]).select("id", "document_id").distinct()


@query(
    "search_results",
    f"""WITH o AS (SELECT connection_id, year(received_on) AS year, pass, message_id, max(received_on) AS received_on FROM mails GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY connection_id, year, pass ORDER BY received_on DESC, message_id) AS place, count(*) OVER (PARTITION BY connection_id, year, pass) AS n FROM o),
t AS (SELECT connection_id, year, max(n) > {RESULTS_PER_PASS} AS truncated FROM p GROUP BY 1, 2)
SELECT connection_id, year, message_id, max(pass) AS pass, any_value(truncated) AS truncated FROM p JOIN t USING (connection_id, year) WHERE place <= {RESULTS_PER_PASS} GROUP BY 1, 2, 3""",
)
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """What the two passes over each mailbox and year bring."""
    found = load(spark, d, "mails").select("connection_id", F.year("received_on").alias("year"), "pass", "message_id", "received_on")
    return T.search_results(found, ["connection_id", "year"])


@query("fetch_order", "SELECT requirement_id, id, CAST(row_number() OVER (PARTITION BY requirement_id ORDER BY connection_id, message_id, id) AS INTEGER) AS place FROM mails")
def fetch_order(spark: SparkSession, d: str) -> DataFrame:
    return T.fetch_order(load(spark, d, "mails").select("requirement_id", "id", "connection_id", "message_id")).select("requirement_id", "id", "place")


BLANK = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


@query(
    "text_extent",
    f"""WITH x AS (SELECT conv_id, count(DISTINCT turn) AS pages, CAST(sum(coalesce(length(regexp_replace(text, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')), 0)) AS BIGINT) AS characters, coalesce(bool_or(regexp_matches(text, '[0-9]')), false) AS has_digit FROM conversations GROUP BY 1)
SELECT *, CASE WHEN has_digit AND characters >= {D.MINIMUM_CHARACTERS_PER_PAGE} * pages THEN 'TEXT' ELSE 'VISUAL' END AS path FROM x""",
)
def text_extent(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a document of a page a turn: its size, and the way it goes."""
    pages = load(spark, d, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    out = W.text_extent(pages, "conv_id")
    return out.withColumn("path", D.route(F.lit("application/pdf"), F.col("pages"), F.col("characters"), F.col("has_digit")))


@query(
    "verdicts_identification",
    "WITH p AS (SELECT statement_id, " + _said(("document_kind = 'LEASE'", "'document_kind is unknown'"), ("currency = 'USDX'", "'currency must have three letters'"), ("period_start = '2024-1-5'", "'period_start must be a day'"), ("period_end = '31/01/2024'", "'period_end must be a day'"))
    + " AS problems FROM identification_answers) SELECT * FROM p WHERE problems <> ''",
)
def verdicts_identification(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.malformed(load(spark, d, "identification_answers"), verdicts.identification_problems(), "statement_id")


@query(
    "verdicts_scanned",
    "WITH p AS (SELECT statement_id, row_index, " + _said(("date_order = 'DYM'", "'date_order is unknown'"), ("decimal_separator = ';'", "'decimal_separator is unknown'"), ("date IS NULL", "'date is required'"), ("description IS NULL", "'description is required'"))
    + " AS problems FROM scanned_answers) SELECT * FROM p WHERE problems <> ''",
)
def verdicts_scanned(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.malformed(load(spark, d, "scanned_answers"), verdicts.scanned_problems(), "statement_id", "row_index")


NONE = [(f"classification = 'IS_NOT_INVOICE' AND {c} IS NOT NULL", f"'{c} must be null when the document is not an invoice'") for c in ("total", "tax", "subtotal", "invoice_number")]


@query(
    "verdicts_reading",
    "WITH p AS (SELECT document_id, " + _said(("classification = 'MAYBE'", "'classification is unknown'"), ("coalesce(reason, '') = ''", "'reason is required'"), ("invoice_date = ''", "'invoice_date must not be empty'"), ("total = ''", "'total must not be empty'"), ("blank_alias", "'aliases must not be empty'"), *NONE, ("total IS NOT NULL AND currency IS NULL", "'currency is required when a total was found'"))
    + " AS problems FROM invoice_answers) SELECT * FROM p WHERE problems <> ''",
)
def verdicts_reading(spark: SparkSession, d: str) -> DataFrame:
    answers = load(spark, d, "invoice_answers").withColumn("aliases", F.array(F.lit("ABC"), F.when(F.col("blank_alias"), "").otherwise("ABC Foods")))
    return verdicts.malformed(answers, verdicts.reading_problems(), "document_id")
