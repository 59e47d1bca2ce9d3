"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A document's expected number of copies is its source's target over its source's size.
The whole part is certain; the fractions are rounded together. Two fractions meet: if
they sum to less than one, all mass goes to one of them, else one becomes a whole copy
and the other keeps the rest; which one is drawn in proportion, from a hash, so that
reruns agree and every fraction keeps its expectation. What is left of one meeting goes
to the next. Meetings are held in blocks of documents of one source and of nearly the
same length, so mass moves between like amounts of words, and the one fraction each
block leaves goes up a tree: sixteen blocks meet in one, until a source has one left.
Blocks come from a hash of the id, the text and the number of documents, never from the
order or the placement of rows. Rows that agree in id and text are told apart by their
number among their like, so that however many repeat an id they spread over all blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, quoted, table, unused, word_count

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_COPIES = 2.0
#: Documents that meet in a block of the first level, and blocks that meet in one above.
BLOCK, FAN_IN = 64, 16
#: Lengths of a stratum differ by at most this power of two.
STRATA_PER_DOUBLING = 4


def _running(rows: DataFrame, order: list[Column], columns: list[str], name: str) -> DataFrame:
    """rows with before_c, the sum of c over the rows before, and all_c, for each of the columns.

    Rows are ranged by the order and summed in each range; only one row of sums for each
    range meets in one place.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    sums = ranged.groupBy("range").agg(*[F.sum(c).alias(c) for c in columns])
    lower, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select("range", *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"lower_{c}") for c in columns], *[F.sum(c).over(every).alias(f"all_{c}") for c in columns])
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.join(F.broadcast(sums), "range")
    before = {f"before_{c}": F.col(f"lower_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns}
    return both.withColumns(before).drop("range", *[f"lower_{c}" for c in columns])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_COPIES) -> DataFrame:
    """source -> source_size, target: the shares of a total, capped at most times the source.

    The excess of capped sources goes to the others by weight until none is above its
    cap: target = min(cap, level * weight), and the level follows from the sources in
    the order of cap over weight. Sources may be many: their order and the sums along it
    are found range by range.
    """
    if share > most:
        raise ValueError("the share must not exceed the cap")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    by_name = F.asc_nulls_last("source")
    per = _running(per, [by_name], ["one", "source_size"], "sources-by-name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = per.select("source", "source_size", "all_source_size", "weight", "cap", (F.col("cap") / F.col("weight")).alias("at"))
    per = _running(per, [F.asc("at"), by_name], ["weight", "cap"], "sources-by-cap")
    left = F.col("all_source_size") * F.lit(float(share)) - F.col("before_cap")
    # With the first k sources capped the level rises up to the right k and falls behind it.
    level = per.agg(F.max(left / (F.col("all_weight") - F.col("before_weight")))).first()[0]
    target = F.least(F.col("cap"), F.lit(level).cast("double") * F.col("weight"))
    return per.select("source", F.col("source_size").cast("long"), target.alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


UNIT = "struct<size:bigint,key:bigint,row_id:bigint,p:double>"
STATE = f"struct<rest:{UNIT},done:array<struct<row_id:bigint,extra:int>>>"


def _meet(state: Column, unit: Column, seed: int, level: int) -> Column:
    """One meeting: the fraction that was left and the next unit's."""
    a, b = state["rest"], unit
    total = a["p"] + b["p"]
    small = total < 1
    first = _draw(F.lit(seed), F.lit(level), a["key"], b["key"]) * F.when(small, total).otherwise(2 - total) < F.when(small, a["p"]).otherwise(1 - b["p"])
    # Small: the winner takes all and the other is out. Else the winner is whole and the other keeps the rest.
    settled = F.when(first == small, b["row_id"]).otherwise(a["row_id"])
    remains = F.when(first == small, a).otherwise(b)
    rest = F.struct(remains["size"].alias("size"), remains["key"].alias("key"), remains["row_id"].alias("row_id"), F.when(small, total).otherwise(total - 1).alias("p"))
    done = F.struct(settled.alias("row_id"), F.when(small, 0).otherwise(1).cast("int").alias("extra"))
    return F.struct(rest.cast(UNIT).alias("rest"), F.concat(state["done"], F.array(done)).alias("done")).cast(STATE)


def _round(units: DataFrame, keys: list[str], seed: int, level: int) -> DataFrame:
    """Holds the meetings of each group: its rest and what became of the others."""
    # The longest first, so that the fraction left at the end is a short document's.
    sorted_units = F.reverse(F.array_sort(F.collect_list(F.struct("size", "key", "row_id", "p").cast(UNIT))))
    grouped = units.groupBy(*keys).agg(sorted_units.alias("units"))
    start = F.struct(F.element_at("units", 1).alias("rest"), F.array().cast("array<struct<row_id:bigint,extra:int>>").alias("done")).cast(STATE)
    held = F.aggregate(F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0))), start, lambda s, u: _meet(s, u, seed, level))
    return grouped.select(*keys, held.alias("held"))


def copies(units: DataFrame, seed: int = 0) -> DataFrame:
    """units: source, row_id, key, size, expected -> row_id, copies.

    key makes a row's draws; rows that agree in source, size and key are
    interchangeable. Whole expectations stay as they are.
    """
    whole = F.floor(F.col("expected") + F.lit(1e-12))
    units = units.withColumns({"whole": whole.cast("int"), "p": F.greatest(F.col("expected") - whole, F.lit(0.0))})
    open_units = units.where("p > 1e-12")
    n = open_units.count()
    blocks = 1
    while blocks * BLOCK < n:
        blocks *= FAN_IN
    stratum = F.floor(F.log2(F.col("size") + F.lit(1.0)) * STRATA_PER_DOUBLING).cast("int")
    level_units = open_units.select("source", stratum.alias("stratum"), F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(blocks)).cast("int").alias("block"), "size", "key", "row_id", "p")
    parts, level = [], 0
    while True:
        keys = ["source", "stratum", "block"] if blocks else ["source"]
        held = materialize(_round(level_units, keys, seed, level), f"mixing-{level}")
        parts.append(held.select(F.explode("held.done").alias("d")).select("d.row_id", "d.extra"))
        if not blocks:
            break
        # After the last block of a stratum, the strata of a source meet: block 0 stands for "by source".
        blocks = blocks // FAN_IN
        rest = held.select(*keys, "held.rest.*")
        level_units = rest.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(max(blocks, 1))).cast("int"))
        level += 1
    last = held.select("held.rest.*").select("row_id", (_draw(F.lit(seed), F.lit("last"), F.col("key")) < F.col("p")).cast("int").alias("extra"))
    rounded = last
    for part in parts:
        rounded = rounded.unionByName(part)
    return units.select("row_id", "whole").join(rounded, "row_id", "left").select("row_id", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


#: Numbering of like rows is dealt to so many parts of each group.
SALTS = 64


def _nth(rows: DataFrame) -> DataFrame:
    """rows (same, row_id, ...) with n, a row's number among those of equal ``same``.

    Which of them gets which number is open. A group is numbered in SALTS parts, each from
    where the parts before it end, so a group with a third of all rows is no single task.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("same", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("same").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("same", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("same", "salt").orderBy("row_id"))
    return salted.withColumn("n", own).join(starts, ["same", "salt"]).withColumn("n", F.col("n") + F.col("start")).drop("salt", "start")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_COPIES, seed: int = 0, row: str | None = None) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target, copies, taken: one row per row of docs.

    size counts the words of the whole text, 0 for null. Sources are weighed in code
    point order, the null source last. taken = copies * size, at most ceil(target /
    source_size) times the size. A document of size 0, or a source of size 0, takes
    nothing; an empty table gives an empty result. Repeated rows are documents of their
    own. row_id is docs' column ``row``, or numbers its rows as they were read.
    """
    row_id = F.col(row) if row else F.monotonically_increasing_id()
    sizes = docs.select(row_id.alias("row_id"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("same"))
    sizes = materialize(sizes, "mixing-sizes")
    targets = source_targets(sizes, weights, share, most)
    same = F.expr("s.source <=> t.source")
    rows = sizes.alias("s").join(targets.alias("t"), same).select("s.*", "source_size", "target")
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = materialize(_nth(rows.withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(0.0))), "mixing-rows")
    units = rows.select("source", "row_id", F.xxhash64("same", "n").alias("key"), "size", "expected")
    return rows.drop("expected", "same", "n").join(copies(units, seed), "row_id").withColumn("taken", F.col("copies") * F.col("size"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the columns it came with; docs need not be stored."""
    rows, row = numbered(docs, "mixing-docs")
    times = unused("copies", rows.columns)
    counts = mix(rows, row=row).where("copies > 0").select(F.col("row_id").alias(row), F.col("copies").alias(times))
    return rows.join(counts, row).withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*quoted(docs.columns))
