"""Changes to tables as new tables, and the small state machines of intake, mail and review."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.money import read_amount, signed
from ..functions.text import js_trim, knowledge_key, reference


def scan(table: DataFrame, workspace: int | str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """A workspace's rows; its filter is always among the conditions, and both reach the file scan."""
    rows = table.where(F.col("workspace_id") == workspace)
    rows = rows if where is None else rows.where(where)
    return rows if limit is None else rows.limit(limit)


def look_up(wanted: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with the row of table that has the keys: the smallest of several, nulls where there is none."""
    others = [c for c in table.columns if c not in keys]
    one = table.groupBy(*keys).agg(F.min(F.struct(*others)).alias("row"))
    return wanted.join(one, keys, "left").select(*wanted.columns, F.col("row").isNotNull().alias("found"), *[F.col("row")[c].alias(c) for c in others])


def open_workspaces(workspaces: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (user_id, workspace_id) with allowed: whether the workspace is there and the user's own."""
    own = workspaces.select(F.col("id").alias("workspace_id"), F.col("owner_id").alias("user_id"), F.lit(True).alias("own"))
    return requests.join(own, ["workspace_id", "user_id"], "left").select(*requests.columns, F.coalesce("own", F.lit(False)).alias("allowed"))


def list_workspaces(workspaces: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, workspace_id, name: what each user may open."""
    return users.select("user_id").join(workspaces, F.col("owner_id") == F.col("user_id")).select("user_id", F.col("id").alias("workspace_id"), "name")


def create_workspaces(requests: DataFrame) -> DataFrame:
    """requests (id, owner_id, name) with the trimmed name and a refusal where nothing of it is left."""
    named = requests.withColumn("name", js_trim(F.coalesce("name", F.lit(""))))
    return named.select("id", "owner_id", F.when(F.col("name") != "", F.col("name")).alias("name"), F.when(F.col("name") == "", "A workspace needs a name").alias("refusal"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of changes in place of those of the same keys; null keys are equal. Keys of changes are unique."""
    return delete(table, changes, keys).unionByName(changes)


def update(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the other columns of changes where a change has a row's keys; nulls of changes are values."""
    names = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, F.struct(*names).alias("change"))
    rows = table.join(marked, keys, "left")
    return rows.select(*[F.when(F.col("change").isNotNull(), F.col("change")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows that have the keys of gone; null keys are equal."""
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys))
    return table.join(gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]), same, "left_anti")


def text_extent(items: DataFrame, key: str) -> DataFrame:
    """items (key, page, text) -> pages, characters of trimmed texts, has_digit: what the routes go by."""
    size = F.sum(F.coalesce(F.length(js_trim(F.col("text"))), F.lit(0)))
    return items.groupBy(key).agg(F.countDistinct("page").alias("pages"), size.alias("characters"), F.coalesce(F.bool_or(F.col("text").rlike("[0-9]")), F.lit(False)).alias("has_digit"))


def statement_route(media_type: Column, pages: Column, characters: Column, rows: Column) -> Column:
    """TEXT for what isn't a PDF and for a PDF with three rows and 200 characters a page, else SCANNED."""
    usable = (pages > 0) & (rows >= 3) & (characters >= 200 * pages)
    return F.when(~media_type.eqNullSafe("application/pdf") | usable, "TEXT").otherwise("SCANNED")


def scanned_lines(rows: DataFrame) -> DataFrame:
    """Rows read from a scan -> lines, with the reason where one is skipped: no date, both amounts, or none."""
    amount = lambda c: read_amount(F.col(c), F.col("currency"), F.col("decimal_separator"))
    read = rows.withColumns({"d": amount("debit"), "c": amount("credit"), "b": amount("balance"), "day": read_date(F.col("date"), F.col("date_order"), F.col("period_start"), F.col("period_end"))})
    read = read.withColumns({"out": F.when(F.col("d.minor") != 0, F.col("d.minor")), "inward": F.when(F.col("c.minor") != 0, F.col("c.minor"))})
    both = F.col("out").isNotNull() & F.col("inward").isNotNull()
    reason = F.when(F.col("day").isNull(), "no date").when(both, "both a debit and a credit").when(F.coalesce("out", "inward").isNull(), "no amount")
    fine = lambda c: F.when(reason.isNull(), c)
    return read.select(
        "statement_id", "row_index", reason.alias("reason"), fine(F.col("day")).alias("value_date"), fine(js_trim(F.regexp_replace("description", r"\s+", " "))).alias("description"),
        fine(F.coalesce("out", "inward")).cast("long").alias("amount_minor"), fine(F.when(F.col("out").isNotNull(), "DEBIT").otherwise("CREDIT")).alias("direction"), fine(signed(F.col("b"))).cast("long").alias("balance_minor"), fine(reference(F.col("reference"))).alias("external_reference"),
    )


def periods(statements: DataFrame, lines: DataFrame) -> DataFrame:
    """statement_id, period_start, period_end, source: the declared period if both ends are, else that of the lines."""
    dates = lines.groupBy(F.col("statement_id").alias("id")).agg(F.min("value_date").alias("first"), F.max("value_date").alias("last"))
    declared = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    rows = statements.join(dates, "id", "left")
    pick = lambda own, found: F.when(declared, F.col(own)).otherwise(F.coalesce(found, own))
    return rows.select(F.col("id").alias("statement_id"), pick("period_start", "first").alias("period_start"), pick("period_end", "last").alias("period_end"), F.when(declared, "DECLARED").when(F.col("first").isNotNull(), "DERIVED").alias("source"))


def better_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt to keep of each statement: the first valid one, else the one with strictly fewer breaks."""
    order = Window.partitionBy("statement_id").orderBy(F.desc("valid"), F.when(F.col("valid"), 0).otherwise(F.col("breaks")), "attempt")
    return attempts.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def connection_transition(connections: DataFrame, events: DataFrame) -> DataFrame:
    """connections with their state after an event each; accepted is false where the state doesn't take it."""
    rows = connections.join(events, "id")
    to = (
        F.when(F.col("event") == "GRANTED", "CONNECTED")
        .when((F.col("event") == "GRANT_INVALID") & (F.col("state") == "CONNECTED"), "NEEDS_REAUTH")
        .when((F.col("event") == "DISCONNECTED") & F.col("state").isin("CONNECTED", "NEEDS_REAUTH"), "DISCONNECTED")
    )
    return rows.select("id", "event", F.col("state").alias("from_state"), F.coalesce(to, "state").alias("state"), to.isNotNull().alias("accepted"))


def record_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions (id, transaction_id, vendor_guess, answered) and answers (id, answer, at) -> what each question's first fitting answer does.

    Blank answers and answered questions change nothing. A recorded one frees the payment
    to be judged again and is learned under the vendor's key, if there is one.
    """
    said = answers.withColumn("answer", js_trim(F.col("answer"))).where("answer <> ''").groupBy("id").agg(F.min(F.struct("at", "answer")).alias("a"))
    rows = questions.join(said, "id", "left")
    recorded = F.col("a").isNotNull() & ~F.col("answered")
    return rows.select("id", recorded.alias("recorded"), F.when(recorded, F.col("a.answer")).alias("answer"), F.when(recorded, F.col("transaction_id")).alias("judge_again"), F.when(recorded, knowledge_key(F.col("vendor_guess"))).alias("learned_key"))


def fetched_from(documents: DataFrame) -> DataFrame:
    """document_id, connection_id, message_id of the documents that a mailbox brought, by the paths of their source_metadata (JSON); what names no message is left out."""
    path = lambda name: F.get_json_object("source_metadata", f"$.{name}")
    found = documents.where("source = 'GMAIL'").select(F.col("id").alias("document_id"), path("gmailConnectionId").alias("connection_id"), path("gmailMessageId").alias("message_id"))
    return found.where("connection_id is not null and message_id is not null")


def reuse_messages(mails: DataFrame, fetched: DataFrame) -> DataFrame:
    """mail id -> the documents it already brought, and by which way.

    fetched: connection_id, message_id, requirement_id, rfc822_message_id, document_id. A
    message of the same mailbox counts before a copy in the same requirement.
    """
    exact = mails.select("id", "connection_id", "message_id").join(fetched.select("connection_id", "message_id", "document_id"), ["connection_id", "message_id"]).select("id", "document_id", F.lit(1).alias("way"))
    copies = mails.where("rfc822_message_id is not null").select("id", "requirement_id", "rfc822_message_id").join(fetched.select("requirement_id", "rfc822_message_id", "document_id"), ["requirement_id", "rfc822_message_id"]).select("id", "document_id", F.lit(2).alias("way"))
    both = exact.union(copies).distinct().withColumn("first", F.min("way").over(Window.partitionBy("id")))
    return both.where("way = first").groupBy("id").agg(F.first("way").alias("way"), F.array_join(F.transform(F.array_sort(F.collect_list("document_id")), lambda x: x.cast("string")), ",").alias("documents"))


def retrieved_documents(fetched: DataFrame, documents: DataFrame) -> DataFrame:
    """requirement_id, document_id, mail: what the mail of a requirement brought, by its first mail; unreadable says that no invoice could be read and no payment has it."""
    first = fetched.groupBy("requirement_id", "document_id").agg(F.min("id").alias("mail"))
    state = documents.select(F.col("id").alias("document_id"), ((F.col("state") == "UNREADABLE") & F.col("transaction_id").isNull()).alias("unreadable"))
    return first.join(state, "document_id").select("requirement_id", "document_id", "mail", "unreadable")


def resolve(requirements: DataFrame, decisions: DataFrame) -> DataFrame:
    """requirements after decisions (id, action, document_id): CONFIRM and LINK attach a document, NOT_REQUIRED needs none; resolved ones stay."""
    rows = requirements.join(decisions, "id", "left")
    method = F.when(F.col("action") == "CONFIRM", "USER_CONFIRMED").when(F.col("action") == "LINK", "USER_LINKED").when(F.col("action") == "NOT_REQUIRED", "NOT_REQUIRED")
    applies = method.isNotNull() & F.col("method").isNull() & ((F.col("action") == "NOT_REQUIRED") | F.col("document_id").isNotNull())
    return rows.select("id", F.when(applies, "RESOLVED").otherwise(F.col("state")).alias("state"), F.when(applies, method).otherwise(F.col("method")).alias("method"), F.when(applies, F.when(F.col("action") != "NOT_REQUIRED", F.col("document_id"))).otherwise(F.col("resolved_document_id")).alias("resolved_document_id"))


def keep_both(duplicates: DataFrame, kept: DataFrame) -> DataFrame:
    """Suspicions that remain when those of kept (invoice) are lifted."""
    return delete(duplicates, kept, ["invoice"])


def link_origin(candidate: Column) -> Column:
    """The origin of an http or https address; null for anything else."""
    scheme, host = F.lower(F.try_parse_url(candidate, F.lit("PROTOCOL"))), F.try_parse_url(candidate, F.lit("AUTHORITY"))
    return F.when(scheme.isin("http", "https") & (F.coalesce(host, F.lit("")) != ""), F.concat(scheme, F.lit("://"), host))
