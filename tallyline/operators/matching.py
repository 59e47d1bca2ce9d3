"""Matching invoices to payments: candidates, decisions, links, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import flatten, letters_of
from ..thresholds import (
    AUTO_MATCH_DATE_DAYS,
    CANDIDATE_DAYS_AFTER,
    CANDIDATE_DAYS_BEFORE,
    CANDIDATE_FETCH_CAP,
    CANDIDATES_SHOWN,
    DUPLICATE_DATE_DAYS,
    DUPLICATE_MIN_AGREEING_FIELDS,
)
from . import evidence as E
from . import verdicts as verdicts_



#: The smallest and the greatest invoice that a payment holds.
HOLDERS = ("first_holder", "last_holder")


def _rings(day: Column, ring: Column) -> Column:
    """The days that are so far from a day: one behind and one before it within the window."""
    after, before = F.when(ring <= CANDIDATE_DAYS_AFTER, F.date_add(day, ring)), F.when((ring > 0) & (ring <= CANDIDATE_DAYS_BEFORE), F.date_sub(day, ring))
    return F.array_compact(F.array(after, before))


def reach(days: DataFrame, debits: DataFrame) -> DataFrame:
    """days (workspace_id, invoice_date) with reach: how far from the date its nearest CANDIDATE_FETCH_CAP debits go.

    debits (workspace_id, value_date) are counted by day, and the counts of the days around
    a date added up from the nearest on.
    """
    counts = debits.groupBy("workspace_id", "value_date").agg(F.count("*").alias("n"))
    most = max(CANDIDATE_DAYS_BEFORE, CANDIDATE_DAYS_AFTER)
    around = days.withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(most))))
    around = around.withColumn("value_date", F.explode(_rings(F.col("invoice_date"), F.col("ring"))))
    found = around.join(counts, ["workspace_id", "value_date"]).groupBy("workspace_id", "invoice_date", "ring").agg(F.sum("n").alias("n"))
    # At most one row for each ring: the days of a date are a bounded group.
    nearer = F.sum("n").over(Window.partitionBy("workspace_id", "invoice_date").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1))
    needed = found.withColumn("nearer", F.coalesce(nearer, F.lit(0))).where(F.col("nearer") < CANDIDATE_FETCH_CAP)
    return needed.groupBy("workspace_id", "invoice_date").agg(F.max("ring").alias("reach"))


def windows(days: DataFrame, transactions: DataFrame) -> DataFrame:
    """days (workspace_id, invoice_date) with near: the debits of the workspace from 3 days before to 10 after, nearest 200.

    The cap takes the nearest days and then the smallest ids. Which debits those are depends
    on the day alone, so it is found once a day and not once an invoice. Of a day, only its
    200 smallest ids can be among anyone's nearest, and a histogram of the days says how far
    the nearest go, so a day meets fewer than 200 debits and those of the last two days it
    needs, however many there are.
    """
    debits = transactions.where("direction = 'DEBIT'")
    far = reach(days, debits.select("workspace_id", "value_date"))
    daily = Window.partitionBy("workspace_id", "value_date").orderBy("id")
    debits = debits.withColumn("of_day", F.row_number().over(daily)).where(F.col("of_day") <= CANDIDATE_FETCH_CAP)
    facts = ["amount_minor", F.col("currency").alias("transaction_currency"), "description", "description_normalized", "external_reference", *[c for c in HOLDERS if c in transactions.columns]]
    debits = debits.select("workspace_id", "value_date", F.col("id").alias("transaction"), *facts)
    first, last = F.least("reach", F.lit(CANDIDATE_DAYS_BEFORE)), F.least("reach", F.lit(CANDIDATE_DAYS_AFTER))
    wanted = far.withColumn("offset_days", F.explode(F.sequence(-first, last))).withColumn("value_date", F.date_add("invoice_date", F.col("offset_days"))).drop("reach")
    nearest = Window.partitionBy("workspace_id", "invoice_date").orderBy(F.abs("offset_days"), "transaction")
    met = wanted.join(debits, ["workspace_id", "value_date"]).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= CANDIDATE_FETCH_CAP)
    debit = F.struct("transaction", "value_date", "offset_days", *[c for c in debits.columns if c not in ("workspace_id", "value_date", "transaction")])
    return met.groupBy("workspace_id", "invoice_date").agg(F.collect_list(debit).alias("near"))


def _dated(invoices: DataFrame) -> DataFrame:
    return invoices.where("invoice_date is not null").withColumnsRenamed({"id": "invoice", "currency": "invoice_currency", "transaction_id": "linked"})


def in_window(invoices: DataFrame, transactions: DataFrame) -> DataFrame:
    """Invoices with the debits of their day's window; truncated says that the cap was reached."""
    dated = _dated(invoices)
    met = dated.join(windows(dated.select("workspace_id", "invoice_date").distinct(), transactions), ["workspace_id", "invoice_date"])
    return met.withColumn("truncated", F.size("near") >= CANDIDATE_FETCH_CAP).select("*", F.inline("near")).drop("near")


def vendor_agreement(letters: Column) -> Column:
    """A confirmed alias in the description's letters, another alias, the invoice's own key, or none."""
    held = lambda key: (key != "") & F.contains(letters, key)
    return (
        F.when(F.exists("confirmed_aliases", held), "RESOLVED")
        .when(F.exists("other_aliases", held), "ALIAS")
        .when(held(F.col("vendor_key")), "NORMALIZED_CONTAINS")
        .otherwise("NONE")
    )


def candidates(invoices: DataFrame, transactions: DataFrame, aliases: DataFrame, rejections: DataFrame) -> DataFrame:
    """The five strongest payments of each invoice, with their evidence, strength and rank from 0.

    Payments that hold another invoice, and such whose owner rejected the document, are
    left out; so are those of which neither amount nor vendor says anything. Aliases
    (workspace_id, vendor_id, alias_normalized, confirmed) count in their own workspace.

    An invoice meets its day's window as one array and hands on five payments at most, so no
    pairs are shuffled or sorted on disk. Its vendor's aliases and its document's refusals
    are few and come with it.
    """
    # Who holds a payment is told to the payments, of which there are fewer than pairs.
    held = invoices.where("transaction_id is not null").groupBy(F.col("transaction_id").alias("id")).agg(F.min("id").alias(HOLDERS[0]), F.max("id").alias(HOLDERS[1]))
    sure = F.coalesce("confirmed", F.lit(False))
    known = aliases.groupBy("workspace_id", "vendor_id").agg(*[F.collect_set(F.when(x, F.col("alias_normalized"))).alias(n) for n, x in (("confirmed_aliases", sure), ("other_aliases", ~sure))])
    refused = rejections.groupBy("document_id").agg(F.collect_set("transaction_id").alias("refused"))
    dated = _dated(invoices)
    near = windows(dated.select("workspace_id", "invoice_date").distinct(), transactions.join(held, "id", "left"))
    # The letters of a debit's texts are made once for all invoices of a day.
    lettered = lambda d: d.withField("letters", letters_of(d["description_normalized"])).withField("reference_key", flatten(d["external_reference"])).withField("description_key", flatten(d["description"]))
    near = near.select("workspace_id", "invoice_date", F.transform("near", lettered).alias("near"))
    asked = dated.withColumn("number_key", flatten(F.col("invoice_number"))).join(known, ["workspace_id", "vendor_id"], "left").join(refused, "document_id", "left")
    met = asked.join(near, ["workspace_id", "invoice_date"]).withColumn("truncated", F.size("near") >= CANDIDATE_FETCH_CAP)

    def amount(d: Column) -> Column:
        return E.amount_agreement(F.col("total_minor"), F.col("invoice_currency"), d["amount_minor"], d["transaction_currency"])

    def says(d: Column) -> Column:
        own = [d[h].isNull() | (d[h] == F.col("invoice")) for h in HOLDERS]
        free = own[0] & own[1] & ~F.coalesce(F.array_contains("refused", d["transaction"]), F.lit(False))
        return free & ((amount(d) != "DIFFERENT") | (vendor_agreement(d["letters"]) != "NONE"))

    def found(d: Column) -> Column:
        number = E.number_found(F.col("number_key"), d["reference_key"], d["description_key"])
        findings = {"amount": amount(d), "vendor": vendor_agreement(d["letters"]), "date": E.date_agreement(d["offset_days"]), "number": number, "currency": E.currency_agreement(F.col("invoice_currency"), d["transaction_currency"])}
        return F.struct(d.alias("d"), *[c.alias(n) for n, c in findings.items()])

    def placed(x: Column) -> Column:
        return F.struct((-E.strength({n: x[n] for n in E.STRENGTH})).alias("weakness"), x["d"]["transaction"].alias("transaction"), x.alias("x"))

    told = F.transform(F.transform(F.filter("near", says), found), placed)
    best = F.slice(F.array_sort(told), 1, CANDIDATES_SHOWN)
    kept = [c for c in met.columns if c not in ("near", "refused", "confirmed_aliases", "other_aliases", "number_key")]
    # The outer form, for which no filter on the whole expression is inferred, which would evaluate it again.
    shown = met.select(*kept, F.posexplode_outer(best).alias("rank", "c")).where("c is not null")
    facts = ("value_date", "offset_days", "amount_minor", "transaction_currency", "description", "description_normalized", "external_reference")
    shown = shown.select(*kept, "rank", "c.transaction", (-F.col("c.weakness")).alias("strength"), *[f"c.x.{n}" for n in E.STRENGTH], *[f"c.x.d.{f}" for f in facts])
    return shown.withColumn("delta_minor", F.col("amount_minor") - F.col("total_minor"))


def decisions(invoices: DataFrame, found: DataFrame, duplicates: DataFrame, adjudications: DataFrame) -> DataFrame:
    """invoice, kind, blocked_by, transaction: every condition of an automatic match, the first failing one named.

    A malformed adjudication (invoice_id, verdict, candidate, reason) agrees with nothing.
    """
    adjudications = verdicts_.usable(adjudications, verdicts_.adjudication_problems())
    anchors = found.withColumn("n", F.count("*").over(Window.partitionBy("invoice"))).where("rank = 0")
    verdicts = adjudications.select(F.col("invoice_id").alias("invoice"), "verdict", "candidate")
    facts = invoices.select(F.col("id").alias("invoice")).join(anchors.select("invoice", "transaction", "n", "truncated", "currency", "delta_minor", "offset_days", "vendor"), "invoice", "left")
    facts = facts.join(duplicates.select("invoice", F.lit(True).alias("duplicate")), "invoice", "left").join(verdicts, "invoice", "left")
    terms = {
        "one surviving candidate": F.col("n") == 1,
        "the shortlist is exhaustive": ~F.col("truncated"),
        "not a suspected duplicate": F.col("duplicate").isNull(),
        "the same currency": F.col("currency") == "SAME",
        "the amount matches": F.col("delta_minor") == 0,
        "the dates are close": F.abs("offset_days") <= AUTO_MATCH_DATE_DAYS,
        "the vendor is known": F.col("vendor").isin("RESOLVED", "ALIAS"),
        "the model agrees": (F.col("verdict") == "SAME") & (F.col("candidate") == 0),
    }
    failed = F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in terms.items()])
    none = F.col("n").isNull()
    return facts.select(
        "invoice",
        F.when(none, "NO_MATCH").when(failed.isNull(), "AUTO_MATCH").otherwise("NEEDS_REVIEW").alias("kind"),
        F.when(~none, failed).alias("blocked_by"),
        F.when(failed.isNull() & ~none, F.col("transaction")).alias("transaction"),
    )


def links(decided: DataFrame, invoices: DataFrame) -> DataFrame:
    """Of automatic matches: a payment takes its first invoice, unless it holds one; the others are told so."""
    chosen = decided.where("kind = 'AUTO_MATCH'").withColumn("place", F.row_number().over(Window.partitionBy("transaction").orderBy("invoice")))
    taken = invoices.where("transaction_id is not null").groupBy(F.col("transaction_id").alias("transaction")).agg(F.min("id").alias("holder"))
    joined = chosen.join(taken, "transaction", "left")
    free = (F.col("place") == 1) & (F.col("holder").isNull() | (F.col("holder") == F.col("invoice")))
    return joined.select("invoice", "transaction", free.alias("linked"), F.when(~free, "That payment already has an invoice.").alias("reason"))


NOT_FOUND = "We couldn't find a payment on your statements that matches this."


def outcomes(invoices: DataFrame, primary: DataFrame, documents: DataFrame, candidates: DataFrame, duplicates: DataFrame, decided: DataFrame) -> DataFrame:
    """What becomes of each invoice, step by step: linked already, bound by its document, a match, a duplicate, or a question.

    A payment that holds an invoice takes no other; of several that want a free one, those
    the user chose come first, then the smaller id. anchor is the first candidate's
    payment, judged whether the invoice got as far as a judgement.
    """
    tallied = candidates.groupBy("invoice").agg(F.count("*").alias("n"), F.min(F.struct("rank", "transaction", F.array_join(E.sentences(), " · ").alias("words"))).alias("first"))
    bound = primary.join(documents.select(F.col("id").alias("document_id"), F.col("transaction_id").alias("bound")), "document_id").select(F.col("invoice_id").alias("invoice"), "bound")
    rows = invoices.select(F.col("id").alias("invoice"), F.col("transaction_id").alias("held")).join(decided, "invoice").join(tallied, "invoice", "left").join(bound, "invoice", "left")
    rows = rows.join(duplicates.select("invoice", F.col("reason").alias("repeats")), "invoice", "left")
    rows = rows.withColumn("wants", F.when(F.col("held").isNull(), F.coalesce("bound", "transaction")))
    # Few invoices want a payment at all; only those are ranked.
    wanting = rows.where("wants is not null").select("invoice", "wants", F.col("bound").isNull().alias("automatic"))
    first = Window.partitionBy("wants").orderBy("automatic", "invoice")
    taken = invoices.where("transaction_id is not null").select(F.col("transaction_id").alias("wants")).distinct()
    gets = wanting.withColumn("place", F.row_number().over(first)).where("place = 1").join(taken, "wants", "left_anti").select("invoice", F.lit(True).alias("gets"))
    rows = rows.join(gets, "invoice", "left").withColumn("gets", F.coalesce("gets", F.lit(False)))
    held, wants, gets_it, repeats = F.col("held").isNotNull(), F.col("wants").isNotNull(), F.col("gets"), F.col("repeats").isNotNull()
    none = F.col("kind") == "NO_MATCH"
    return rows.select(
        "invoice",
        F.when(held | gets_it, "LINKED").when(wants, "NEEDS_REVIEW").when(repeats, "DUPLICATE").when(none, "NOT_FOUND").otherwise("NEEDS_REVIEW").alias("outcome"),
        F.when(held, F.col("held")).when(gets_it, F.col("wants")).alias("transaction"),
        F.when(held | F.col("bound").isNotNull(), 0).otherwise(F.coalesce("n", F.lit(0))).alias("candidates"),
        F.when(held, "Already linked to a payment.").when(gets_it & F.col("bound").isNotNull(), "You chose this payment.").when(gets_it, F.col("first.words"))
        .when(wants, "That payment already has an invoice.").when(repeats, F.col("repeats")).when(none, NOT_FOUND).otherwise(F.col("blocked_by")).alias("reason"),
        F.col("first.transaction").alias("anchor"), (~held & F.col("bound").isNull()).alias("judged"),
    )


def anchor_moves(steps: DataFrame, requirements: DataFrame) -> DataFrame:
    """requirement_id, before, after: a judged invoice that stays open puts its first candidate's requirement under review; no other moves, and a settled one stays."""
    asked = steps.where("judged and outcome in ('NEEDS_REVIEW', 'DUPLICATE')").select(F.col("anchor").alias("transaction_id"))
    moved = requirements.where("method is null and state <> 'NEEDS_REVIEW'").join(asked, "transaction_id", "left_semi")
    return moved.select(F.col("id").alias("requirement_id"), F.col("state").alias("before"), F.lit("NEEDS_REVIEW").alias("after"))


def proposals(decided: DataFrame, candidates: DataFrame, duplicates: DataFrame, adjudications: DataFrame) -> DataFrame:
    """What matching would do, without linking: the decision, how many candidates, whether it may be a duplicate, and the judge's verdict where there was something to judge and the answer could be used."""
    adjudications = verdicts_.usable(adjudications, verdicts_.adjudication_problems())
    rows = decided.join(candidates.groupBy("invoice").agg(F.count("*").alias("candidates")), "invoice", "left")
    rows = rows.join(duplicates.select("invoice", F.lit(True).alias("suspected_duplicate")), "invoice", "left").join(adjudications.select(F.col("invoice_id").alias("invoice"), "verdict"), "invoice", "left")
    verdict = F.when(F.col("candidates").isNotNull(), F.col("verdict"))
    return rows.select("invoice", "kind", "blocked_by", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("suspected_duplicate", F.lit(False)).alias("suspected_duplicate"), verdict.alias("verdict"))


def _readable(fields: Column) -> Column:
    """ "a, b and c"."""
    n = F.size(fields)
    several = F.concat(F.array_join(F.slice(fields, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(fields, -1))
    return F.when(n == 0, "nothing").when(n == 1, F.get(fields, F.lit(0))).otherwise(several)


#: What two invoices are compared by.
COMPARED = ("id", "at", "invoice_number", "number", "invoice_date", "total_minor", "currency")


def _comparable(invoices: DataFrame) -> DataFrame:
    """Invoices of a known vendor with their place in time and their number without case and marks."""
    side = invoices.where("vendor_id is not null").withColumn("at", F.struct("created_on", "id"))
    return side.withColumn("number", F.when(flatten(F.col("invoice_number")) != "", flatten(F.col("invoice_number")))).select("workspace_id", "vendor_id", *COMPARED)


def _by_fields(rows: DataFrame, days: int) -> DataFrame:
    """rows once for each field that another invoice of the vendor may agree in: amount, number, and the days within so many."""
    amount = F.when(F.col("total_minor").isNotNull() & F.col("currency").isNotNull(), F.concat(F.lit("a"), F.col("total_minor"), F.col("currency")))
    near = [F.concat(F.lit("d"), F.unix_date("invoice_date") + i) for i in range(-days, days + 1)]
    return rows.withColumn("field", F.explode(F.array_compact(F.array(amount, F.concat(F.lit("n"), F.col("number")), *near))))


FIELD = ["workspace_id", "vendor_id", "field"]


def _suspects(rows: DataFrame, days: int) -> DataFrame:
    """Those of rows that may agree with another one of their vendor: with its amount, its number, or days of the same or the next few.

    Ranges of days + 1 days and the ranges after them say of all days so near that they
    meet, of some others too. Most invoices meet none, and all later steps are spared them.
    """
    amount = F.when(F.col("total_minor").isNotNull() & F.col("currency").isNotNull(), F.xxhash64(F.lit("a"), "total_minor", "currency"))
    span = F.floor(F.unix_date("invoice_date") / (days + 1))
    met = F.array_compact(F.array(amount, F.when(F.col("number").isNotNull(), F.xxhash64(F.lit("n"), "number")), *[F.when(span.isNotNull(), F.xxhash64(F.lit("d"), span + i)) for i in (0, 1)]))
    fields = rows.select("id", F.explode(F.transform(met, lambda m: F.xxhash64("workspace_id", "vendor_id", m))).alias("met"))
    shared = fields.groupBy("met").agg(F.count("*").alias("n")).where("n > 1").select("met")
    return rows.join(fields.join(shared, "met", "left_semi").select("id").distinct(), "id", "left_semi")


def agreeing(a: str = "a", b: str = "b") -> Column:
    """The names of the fields in which two invoices of one vendor agree."""
    total = (F.col(f"{a}.total_minor") == F.col(f"{b}.total_minor")) & (F.col(f"{a}.currency") == F.col(f"{b}.currency"))
    date = F.abs(F.datediff(f"{a}.invoice_date", f"{b}.invoice_date")) <= DUPLICATE_DATE_DAYS
    number = F.col(f"{a}.number") == F.col(f"{b}.number")
    return F.array_compact(F.array(F.lit("vendor"), F.when(total, "amount"), F.when(date, "date"), F.when(number, "invoice number")))


def _decisive(a: str = "a", b: str = "b") -> Column:
    agreed = agreeing(a, b)
    has = lambda name: F.array_contains(agreed, name)
    numberless = F.col(f"{a}.invoice_number").isNull() & F.col(f"{b}.invoice_number").isNull()
    return has("amount") & has("date") & (has("invoice number") | numberless)


def _as_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (invoice, of_invoice) with both invoices as a and b; those of one vendor and workspace."""
    side = lambda name, id: rows.select(F.col("id").alias(id), F.col("workspace_id").alias(f"{name}_w"), F.col("vendor_id").alias(f"{name}_v"), F.struct(*COMPARED).alias(name))
    both = pairs.join(side("a", "invoice"), "invoice").join(side("b", "of_invoice"), "of_invoice")
    return both.where("a_w = b_w and a_v = b_v").drop("a_w", "b_w", "a_v", "b_v")


def duplicates(invoices: DataFrame, verdicts: DataFrame) -> DataFrame:
    """invoice, of_invoice, reason: invoices that repeat an earlier one which repeats none itself.

    Same vendor, amount and near date with the same or no number decides; two agreeing
    fields or more are put to the judge (verdicts: incoming_id, existing_id, same, reason),
    and only a clear no clears them; a malformed answer counts as none. Invoices come in
    order of day and id and are compared with earlier ones; those already flagged are
    passed over, so that a third copy points at the original. Of several the earliest is named.

    Invoices that share nothing with another one are left alone from the first. No pairs are
    made but those that a judge has cleared. Invoices without a no that agree in
    every field are settled by the first of them. Of the others, an invoice that has been
    cleared of k others can only be free if, by each field, those among the first k + 1 open
    ones that come before it are cleared ones, so it meets k + 1 invoices for each field.
    """
    rows = cut(_suspects(_comparable(invoices), DUPLICATE_DATE_DAYS))
    said = verdicts_.usable(verdicts, verdicts_.same_invoice_problems()).select(F.col("incoming_id").alias("invoice"), F.col("existing_id").alias("of_invoice"), "same", F.col("reason").alias("said"))
    no = _as_pairs(said.where("same = 'NO'").select("invoice", "of_invoice").distinct(), rows)
    cleared = cut(no.where(~_decisive()).select("invoice", "of_invoice"))
    rows = cut(rows.join(cleared.groupBy(F.col("invoice").alias("id")).agg(F.count("*").alias("cleared")), "id", "left").fillna(0, ["cleared"]))
    # Like invoices: what is decisive between any two of them, and the same to all others.
    like = ["workspace_id", "vendor_id", "invoice_date", "total_minor", "currency", F.coalesce("number", F.lit("")).alias("like_number")]
    plain = rows.where("cleared = 0 and invoice_date is not null and total_minor is not null and currency is not null and (number is not null or invoice_number is null)")
    names = [*like[:-1], "like_number"]
    leads = plain.groupBy(*like).agg(F.min("at").alias("lead"), F.count("*").alias("n")).where("n > 1")
    copies = cut(plain.withColumn("like_number", like[-1]).join(leads, names).where("at <> lead").select("id", F.col("lead.id").alias("lead")))
    open_ = cut(rows.join(copies.select("id"), "id", "left_anti"))
    found = _originals(open_, cleared)
    first = _linked(rows.join(copies.select("id"), "id", "left_anti"), rows.join(found, "id", "left_semi"), cleared).groupBy("invoice").agg(F.min("at").alias("first"))
    flagged = cut(first.join(found.select(F.col("id").alias("invoice")), "invoice", "left_anti").select("invoice", F.col("first.id").alias("of_invoice")))
    led = copies.join(flagged.withColumnRenamed("invoice", "lead"), "lead", "left").select(F.col("id").alias("invoice"), F.coalesce("of_invoice", "lead").alias("of_invoice"))
    named = _as_pairs(flagged.unionByName(led), rows).join(said, ["invoice", "of_invoice"], "left")
    words = F.concat(F.lit("Same "), _readable(agreeing()))
    reason = F.when(_decisive(), words).when(F.col("same").isNull(), F.concat(words, F.lit(", and we could not check the rest"))).otherwise(F.col("said"))
    return named.select("invoice", "of_invoice", reason.alias("reason"))


def _linked(rows: DataFrame, others: DataFrame, cleared: DataFrame) -> DataFrame:
    """invoice, of_invoice, at: rows and those of others that agree with them by a field, come before them and haven't been cleared."""
    probes = _by_fields(rows, DUPLICATE_DATE_DAYS).select(*FIELD, F.col("id").alias("invoice"), F.col("at").alias("own"))
    met = probes.join(_by_fields(others, 0).select(*FIELD, F.col("id").alias("of_invoice"), "at"), FIELD).where("at < own")
    return met.select("invoice", "of_invoice", "at").join(cleared, ["invoice", "of_invoice"], "left_anti")


def _originals(rows: DataFrame, cleared: DataFrame) -> DataFrame:
    """id: the invoices that link to no original before them.

    Each round settles all that no open one before them links to, and flags what links to
    those. Copies of copies in a row take a round for every second link.
    """
    found, open_ = rows.select("id").limit(0), rows
    most = (rows.agg(F.max("cleared")).first()[0] or 0) + 1
    in_time = Window.partitionBy(*FIELD).orderBy("at")
    while not open_.isEmpty():
        members = _by_fields(open_, 0).withColumn("place", F.row_number().over(in_time)).where(F.col("place") <= most)
        members = members.select(*FIELD, F.col("id").alias("of_invoice"), "at", "place")
        probes = _by_fields(open_, DUPLICATE_DATE_DAYS).select(*FIELD, F.col("id").alias("invoice"), F.col("at").alias("own"), "cleared")
        met = probes.join(members, FIELD).where("at < own and place <= cleared + 1").select("invoice", "of_invoice")
        blocked = met.join(cleared, ["invoice", "of_invoice"], "left_anti").select(F.col("invoice").alias("id")).distinct()
        free = cut(open_.join(blocked, "id", "left_anti"))
        found = found.unionByName(free.select("id"))
        rest = open_.join(free.select("id"), "id", "left_anti")
        flagged = _linked(rest, free, cleared).select(F.col("invoice").alias("id")).distinct()
        open_ = cut(rest.join(flagged, "id", "left_anti"))
    return found


def compare_fields(existing: DataFrame, incoming: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per field of two invoices, with whether they agree; null where either has none."""
    a, b = existing.alias("e"), incoming.alias("i")
    both = pairs.join(a, F.col("e.id") == F.col("of_invoice")).join(b, F.col("i.id") == F.col("invoice"))
    amount = lambda t: F.when(F.col(f"{t}.total_minor").isNotNull(), F.concat(F.coalesce(f"{t}.currency", F.lit("?")), F.lit(" "), F.col(f"{t}.total_minor")))
    fields = {"Vendor": lambda t: F.col(f"{t}.vendor_name"), "Invoice number": lambda t: F.col(f"{t}.invoice_number"), "Date": lambda t: F.col(f"{t}.invoice_date").cast("string"), "Amount": amount}
    rows = F.array(*[F.struct(F.lit(n).alias("field"), f("e").alias("existing"), f("i").alias("incoming"), (flatten(f("e")) == flatten(f("i"))).alias("agrees")) for n, f in fields.items()])
    return both.select("invoice", "of_invoice", F.inline(rows))


def linkable(rows: DataFrame, taken: list[DataFrame], day: str, limit: int = 50) -> DataFrame:
    """The newest rows of each workspace whose id is in none of the taken lists."""
    for t in taken:
        rows = rows.join(t.select(F.col(t.columns[0]).alias("id")).where("id is not null").distinct(), "id", "left_anti")
    newest = Window.partitionBy("workspace_id").orderBy(F.desc(day), "id")
    return rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)
