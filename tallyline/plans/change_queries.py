"""Queries on intake, changes and small state machines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import workflow as W
from ..sources import bank_files, mail, stored
from .domain import load
from .queries import DUPLICATES, _duplicates, _tables, query


@query("scoped_scan", "SELECT id, value_date::VARCHAR AS value_date, amount_minor FROM transactions WHERE workspace_id = 3 AND direction = 'DEBIT' AND value_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def scoped_scan(spark: SparkSession, d: str) -> DataFrame:
    wanted = (F.col("direction") == "DEBIT") & F.col("value_date").between("1996-01-01", "1996-12-31")
    return W.scan(load(spark, d, "transactions"), 3, wanted).select("id", "value_date", "amount_minor")


@query(
    "statement_intake",
    """SELECT page_id, sha256(encode(coalesce(html, ''))) AS content_hash, page_id % 3 = 0 OR page_id % 4 = 1 AS accepted, CASE WHEN page_id % 2 = 0 OR (page_id % 5 > 0 AND page_id % 7 >= 3 AND length(html) >= 200 * (page_id % 5)) THEN 'TEXT' ELSE 'SCANNED' END AS path FROM pages""",
)
def statement_intake(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    mime, name = F.when(i % 3 == 0, "text/csv").otherwise("image/png"), F.when(i % 4 == 1, "March.PDF").otherwise("notes.txt")
    route = W.statement_route(F.when(i % 2 == 1, "application/pdf"), i % 5, F.length("html"), i % 7)
    return load(spark, d, "pages").select("page_id", bank_files.content_hash(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("content_hash"), bank_files.accepted(mime, name).alias("accepted"), route.alias("path"))


@query(
    "scanned_lines",
    """WITH x AS (SELECT *, CASE WHEN l_suppkey % 6 = 0 THEN 'no date' WHEN l_partkey % 9 = 0 THEN 'both a debit and a credit' WHEN l_partkey % 7 = 0 THEN 'no amount' END AS reason FROM lines)
SELECT statement_id, row_index, reason, CASE WHEN reason IS NULL THEN CAST(value_date AS VARCHAR) END AS value_date, CASE WHEN reason IS NULL THEN 'Part ' || l_partkey END AS description, CASE WHEN reason IS NULL THEN amount_minor END AS amount_minor,
  CASE WHEN reason IS NULL THEN direction END AS direction, CASE WHEN reason IS NULL THEN CASE WHEN l_suppkey % 4 = 0 THEN -amount_minor END END AS balance_minor, CASE WHEN reason IS NULL AND l_suppkey % 5 <> 0 THEN 'R' || l_suppkey END AS external_reference FROM x""",
)
def scanned_lines(spark: SparkSession, d: str) -> DataFrame:
    s, p, minor = F.col("l_suppkey"), F.col("l_partkey"), F.col("amount_minor")
    money = F.format_string("$%s.%02d", F.format_number(F.floor(minor / 100), 0), minor % 100)
    side = lambda x: F.when(p % 9 == 0, money).when(p % 7 == 0, "0.00").when(F.col("direction") == x, money)
    null = F.lit(None).cast("date")
    rows = load(spark, d, "lines").select(
        "statement_id", "row_index", F.when(s % 6 == 0, "??").otherwise(F.date_format("value_date", "MMM d, yyyy")).alias("date"), F.concat(F.lit("  Part\n\t"), p.cast("string"), F.lit(" ")).alias("description"), side("DEBIT").alias("debit"), side("CREDIT").alias("credit"),
        F.when(s % 4 == 0, F.concat(F.lit("("), money, F.lit(")"))).alias("balance"), F.when(s % 5 == 0, "00/00").otherwise(F.concat(F.lit(" R"), s.cast("string"))).alias("reference"), F.lit("DMY").alias("date_order"), F.lit(".").alias("decimal_separator"), F.lit("USD").alias("currency"), null.alias("period_start"), null.alias("period_end"),
    )
    return W.scanned_lines(rows)


@query(
    "statement_periods",
    """WITH l AS (SELECT statement_id, min(value_date) AS f, max(value_date) AS t FROM lines GROUP BY 1), x AS (SELECT s.id, s.period_start AS a, s.period_end AS b, l.f, l.t, s.period_start IS NOT NULL AND s.period_end IS NOT NULL AS declared FROM statements s LEFT JOIN l ON l.statement_id = s.id)
SELECT id AS statement_id, CAST(CASE WHEN declared THEN a ELSE coalesce(f, a) END AS VARCHAR) AS period_start, CAST(CASE WHEN declared THEN b ELSE coalesce(t, b) END AS VARCHAR) AS period_end, CASE WHEN declared THEN 'DECLARED' WHEN f IS NOT NULL THEN 'DERIVED' END AS source FROM x""",
)
def statement_periods(spark: SparkSession, d: str) -> DataFrame:
    return W.periods(*_tables(spark, d, "statements lines"))


ATTEMPTS = "SELECT id AS statement_id, 1 AS attempt, id % 5 = 0 AS valid, id % 4 AS breaks FROM statements UNION ALL SELECT id, 2, id % 7 = 0, id % 3 FROM statements WHERE id % 2 = 0"


@query("better_attempt", f"SELECT statement_id, attempt, valid, breaks FROM ({ATTEMPTS}) QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY valid DESC, CASE WHEN valid THEN 0 ELSE breaks END, attempt) = 1")
def better_attempt(spark: SparkSession, d: str) -> DataFrame:
    return W.better_attempt(spark.sql(ATTEMPTS.replace("FROM statements", "FROM {s}"), s=load(spark, d, "statements")))


@query(
    "connection_transitions",
    """WITH e AS (SELECT id, state, CASE id % 3 WHEN 0 THEN 'GRANTED' WHEN 1 THEN 'GRANT_INVALID' ELSE 'DISCONNECTED' END AS event FROM connections),
t AS (SELECT *, CASE WHEN event = 'GRANTED' THEN 'CONNECTED' WHEN event = 'GRANT_INVALID' AND state = 'CONNECTED' THEN 'NEEDS_REAUTH' WHEN event = 'DISCONNECTED' AND state IN ('CONNECTED', 'NEEDS_REAUTH') THEN 'DISCONNECTED' END AS next FROM e)
SELECT id, event, state AS from_state, coalesce(next, state) AS state, next IS NOT NULL AS accepted FROM t""",
)
def connection_transitions(spark: SparkSession, d: str) -> DataFrame:
    connections = load(spark, d, "connections")
    event = F.when(F.col("id") % 3 == 0, "GRANTED").when(F.col("id") % 3 == 1, "GRANT_INVALID").otherwise("DISCONNECTED")
    return W.connection_transition(connections, connections.select("id", event.alias("event")))


@query(
    "answers_recorded",
    """WITH x AS (SELECT q.id, q.transaction_id, q.answered, p.supplier_name, q.id % 5 <> 0 AND NOT q.answered AS r FROM questions q JOIN payments p ON p.id = q.id)
SELECT id, r AS recorded, CASE WHEN r THEN 'yes ' || id END AS answer, CASE WHEN r THEN transaction_id END AS judge_again, CASE WHEN r THEN trim(regexp_replace(lower(supplier_name), '[^a-z0-9]+', ' ', 'g')) END AS learned_key FROM x""",
)
def answers_recorded(spark: SparkSession, d: str) -> DataFrame:
    questions, payments = _tables(spark, d, "questions payments")
    asked = questions.join(payments.select("id", F.col("supplier_name").alias("vendor_guess")), "id")
    first = questions.select("id", F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" yes "), F.col("id").cast("string"))).alias("answer"), F.lit(1).alias("at"))
    later = questions.where("id % 5 <> 0").select("id", F.lit("too late").alias("answer"), F.lit(2).alias("at"))
    return W.record_answers(asked, first.union(later))


FETCHED = "SELECT id, connection_id, message_id, requirement_id, rfc822_message_id, requirement_id + id % 3 AS document_id FROM mails WHERE id % 4 < 2"


@query(
    "message_reuse",
    f"""WITH fetched AS ({FETCHED}), e AS (SELECT m.id, f.document_id, 1 AS way FROM mails m JOIN fetched f ON f.connection_id = m.connection_id AND f.message_id = m.message_id
  UNION SELECT m.id, f.document_id, 2 FROM mails m JOIN fetched f ON f.requirement_id = m.requirement_id AND f.rfc822_message_id = m.rfc822_message_id),
b AS (SELECT *, min(way) OVER (PARTITION BY id) AS first FROM e)
SELECT id, CAST(first AS INTEGER) AS way, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM b WHERE way = first GROUP BY 1, 2""",
)
def message_reuse(spark: SparkSession, d: str) -> DataFrame:
    mails = load(spark, d, "mails")
    return W.reuse_messages(mails, spark.sql(FETCHED.replace("FROM mails", "FROM {m}"), m=mails))


@query(
    "retrieved_documents",
    f"""SELECT f.requirement_id, f.document_id, min(f.id) AS mail, bool_or(s.state = 'UNREADABLE' AND s.transaction_id IS NULL) AS unreadable FROM ({FETCHED}) f JOIN supporting_documents s ON s.id = f.document_id GROUP BY 1, 2""",
)
def retrieved_documents(spark: SparkSession, d: str) -> DataFrame:
    mails, documents = _tables(spark, d, "mails supporting_documents")
    return W.retrieved_documents(spark.sql(FETCHED.replace("FROM mails", "FROM {m}"), m=mails), documents)


ACTIONS = "SELECT id, CASE id % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'LINK' WHEN 2 THEN 'NOT_REQUIRED' ELSE 'NOTHING' END AS action, CASE WHEN id % 3 <> 0 THEN id + 1 END AS document_id FROM requirements WHERE id % 5 <> 0"


@query(
    "review_resolve",
    f"""WITH x AS (SELECT r.*, a.action, a.document_id, a.action IN ('CONFIRM', 'LINK', 'NOT_REQUIRED') AND r.method IS NULL AND (a.action = 'NOT_REQUIRED' OR a.document_id IS NOT NULL) AS ok FROM requirements r LEFT JOIN ({ACTIONS}) a ON a.id = r.id)
SELECT id, CASE WHEN ok THEN 'RESOLVED' ELSE state END AS state, CASE WHEN ok THEN CASE action WHEN 'CONFIRM' THEN 'USER_CONFIRMED' WHEN 'LINK' THEN 'USER_LINKED' ELSE 'NOT_REQUIRED' END ELSE method END AS method,
  CASE WHEN ok THEN CASE WHEN action <> 'NOT_REQUIRED' THEN document_id END ELSE resolved_document_id END AS resolved_document_id FROM x""",
)
def review_resolve(spark: SparkSession, d: str) -> DataFrame:
    requirements = load(spark, d, "requirements")
    return W.resolve(requirements, spark.sql(ACTIONS.replace("FROM requirements", "FROM {r}"), r=requirements))


@query("duplicates_keep_both", "WITH " + DUPLICATES + "SELECT * FROM duplicates WHERE invoice % 4 <> 0")
def duplicates_keep_both(spark: SparkSession, d: str) -> DataFrame:
    found = _duplicates(spark, d)
    return W.keep_both(found, found.where("invoice % 4 = 0").select("invoice"))


@query(
    "search_records",
    """SELECT requirement_id, connection_id, CASE WHEN (requirement_id + connection_id) % 4 = 0 THEN 'COMPLETED' ELSE outcome END AS outcome, CAST(CASE WHEN (requirement_id + connection_id) % 4 = 0 THEN 99 ELSE messages_found END AS INTEGER) AS messages_found FROM searches WHERE requirement_id % 6 <> 0""",
)
def search_records(spark: SparkSession, d: str) -> DataFrame:
    keys = ["requirement_id", "connection_id"]
    held = load(spark, d, "searches").select(*keys, "outcome", "messages_found")
    again = held.where("(requirement_id + connection_id) % 4 = 0").select(*keys, F.lit("COMPLETED").alias("outcome"), F.lit(99).alias("messages_found"))
    return W.delete(W.upsert(held, again, keys), held.where("requirement_id % 6 = 0").select(*keys).distinct(), keys)


@query("link_origins", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN NULL ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) END AS origin FROM pages")
def link_origins(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    candidate = F.when(i % 4 == 0, "not an address").when(i % 4 == 1, F.concat(F.lit("ftp://"), F.substring("url", 9, 10))).otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", W.link_origin(candidate).alias("origin"))


@query(
    "mail_attachments",
    """WITH parts(id, path, part) AS (SELECT id, CAST([] AS INT[]), CAST(payload AS JSON) FROM mail_payloads WHERE id % 17 <> 0
  UNION ALL SELECT id, list_append(path, CAST(i AS INT)), json_extract(part, '$.parts[' || i || ']') FROM (SELECT id, path, part, unnest(range(CASE WHEN json_type(part, '$.parts') = 'ARRAY' THEN CAST(json_array_length(part, '$.parts') AS INT) ELSE 0 END)) AS i FROM parts) p),
found AS (SELECT id, path, coalesce(part ->> '$.partId', '') AS part_id, part ->> '$.filename' AS filename, coalesce(part ->> '$.mimeType', 'application/octet-stream') AS mime_type, CASE WHEN json_type(part, '$.body.size') IN ('UBIGINT', 'BIGINT') THEN CAST(part ->> '$.body.size' AS BIGINT) ELSE 0 END AS size, part ->> '$.body.attachmentId' AS attachment_id
  FROM parts WHERE json_type(part, '$.filename') = 'VARCHAR' AND part ->> '$.filename' <> '' AND part ->> '$.body.attachmentId' <> '')
SELECT id AS message_id, CAST(row_number() OVER (PARTITION BY id ORDER BY path) AS INTEGER) AS place, part_id, filename, mime_type, size, attachment_id FROM found""",
)
def mail_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose invoices lie one to four levels deep, some of them broken."""
    return mail.attachments(load(spark, d, "mail_payloads").withColumnRenamed("id", "message_id"))


@query(
    "requirements_updated",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'RESOLVED' ELSE state END AS state, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'USER_LINKED' END ELSE method END AS method, transaction_id FROM requirements""",
)
def requirements_updated(spark: SparkSession, d: str) -> DataFrame:
    """Some requirements change state and method, to null as well; no row comes or goes."""
    held = load(spark, d, "requirements").select("id", "state", "method", "transaction_id")
    changes = held.where("id % 3 = 0").select("id", F.lit("RESOLVED").alias("state"), F.when(F.col("id") % 2 == 0, "USER_LINKED").alias("method"))
    other = changes.select((-F.col("id")).alias("id"), "state", "method")  # nobody's
    return W.update(held, changes.unionByName(other.where("id < 0")), ["id"])


@query(
    "candidates_replaced",
    """WITH held AS (SELECT requirement_id, document_id, classification FROM assessments)
SELECT requirement_id, document_id, classification FROM held WHERE requirement_id % 7 <> 0 AND NOT (requirement_id % 11 = 0 AND document_id % 3 = 0)
UNION ALL SELECT requirement_id, document_id + 5, 'NEW' FROM held WHERE requirement_id % 7 = 0 AND requirement_id % 2 = 0""",
)
def candidates_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A stored table of documents by requirement: some requirements get new sets, some empty ones, and some single rows go."""
    held = load(spark, d, "assessments").select("requirement_id", "document_id", "classification")
    table = stored.PartTable(f"{shared_folder(spark)}/candidates-{uuid.uuid4().hex}", "requirement_id long, document_id long, classification string", ("requirement_id",), 16)
    table.create(held)
    again = held.where("requirement_id % 7 = 0")
    table.replace(again.where("requirement_id % 2 = 0").select("requirement_id", (F.col("document_id") + 5).alias("document_id"), F.lit("NEW").alias("classification")), again)
    table.delete(held.where("requirement_id % 11 = 0 and requirement_id % 7 <> 0 and document_id % 3 = 0"), ("requirement_id", "document_id"))
    return table.read(spark)
