"""Hard-negative mining by bit-sliced integer products.

Vectors are integers, kept as bit-planes: the component's bits of one weight, of all rows
of a block, side by side. A product with an anchor is read plane by plane, most
significant first. After some planes a score lies in an interval: what was read, plus at
most 2**b - 1 times the anchor's positive components and at least as often its negative
ones, where b planes are left. A candidate is dropped once its interval

* lies outside the band of scores that is asked for, or
* lies below k candidates whose intervals lie wholly inside the band.

With the last plane intervals are scores, so nothing is estimated.

First every anchor gets its positives, from blocks that hold rows of its label; each
positive's score makes a band, and a second round finds the best rows of other labels in
each band. In both rounds a block of the index goes to one task, in as many copies as keep
its anchors bounded, and the anchors that want it stream past; the best rows of a block
are handed on, never all pairs. Rows lie in the index by label and then by hash, so a label
with a third of all rows is as many blocks as others together. Only the blocks' ranges of
labels are sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .hashing import mix
from .vector_topk import exact_products, quantize

INDEX_BLOCK, ANCHOR_BLOCK = 2048, 64
#: Blocks grow beyond INDEX_BLOCK rows rather than become more than this.
MAX_BLOCKS = 65_536
#: Blocks of anchors that stream past one copy of an index block.
ANCHORS_OF_COPY = 256
#: Planes of a block at most; vectors with larger components are multiplied whole.
MOST_PLANES = 40
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Slices:
    """Vectors with whole components as bit-planes, most significant first, or whole where there were too many planes."""

    def __init__(self, n: int, dim: int, planes: int, data: bytes):
        self.n, self.dim, self.planes = n, dim, planes
        self.size = -(-n * dim // 8)
        self.data = np.frombuffer(data, dtype=np.uint8)

    @classmethod
    def of(cls, x: np.ndarray) -> Slices:
        planes = 1
        while len(x) and x.size and not (-(2.0 ** (planes - 1)) <= x.min() and x.max() < 2.0 ** (planes - 1)):
            planes += 1
            if planes > MOST_PLANES:
                return cls(*x.shape, 0, x.astype("<f8").tobytes())
        y = (x + 2.0 ** (planes - 1)).astype(np.int64)
        return cls(*x.shape, planes, b"".join(np.packbits((y >> b & 1).astype(np.uint8)).tobytes() for b in range(planes - 1, -1, -1)))

    def whole(self) -> np.ndarray:
        return np.frombuffer(self.data, dtype="<f8").reshape(self.n, self.dim)

    def plane(self, b: int) -> np.ndarray:
        """Of weight 2**b, as numbers 0 and 1."""
        at = (self.planes - 1 - b) * self.size
        return np.unpackbits(self.data[at : at + self.size], count=self.n * self.dim).reshape(self.n, self.dim)


def _possible(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which candidates (anchors x rows) can still be among the k best of one of their anchor's bands (anchors x bands)."""
    out = np.zeros_like(alive)
    for a, b in zip(low.T[:, :, None], high.T[:, :, None], strict=True):
        inside = alive & (upper >= a) & (lower <= b)
        sure = inside & (lower >= a) & (upper <= b)
        full = np.flatnonzero(sure.sum(1) >= k)
        if len(full):
            edge = np.partition(np.where(sure[full], lower[full], -np.inf), lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
            inside[full] &= upper[full] >= edge[:, None]
        out |= inside
    return out


def scores(q: np.ndarray, x: Slices, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of anchors x rows, right where the second array says that a row can be among the k best of a band."""
    if not x.planes or float(np.abs(q).max(initial=0)) * max(1, x.dim) * 2.0**x.planes >= 2.0**52:
        exact = exact_products(q, x.whole() if not x.planes else _joined(x))
        return exact, alive
    part = np.repeat(-(2.0 ** (x.planes - 1)) * q.sum(1)[:, None], x.n, 1)
    below, above = np.minimum(q, 0).sum(1)[:, None], np.maximum(q, 0).sum(1)[:, None]
    narrow = np.float32 if float(np.abs(q).max(initial=0)) * x.dim < 2**24 else np.float64
    left = x.planes - 1
    while left >= 0 and alive.any() and alive.sum() * 8 > alive.size:
        part += 2.0**left * (q.astype(narrow) @ x.plane(left).astype(narrow).T)
        rest = 2.0**left - 1
        alive = _possible(part + rest * below, part + rest * above, alive, low, high, k)
        left -= 1
    if left < 0 or not alive.any():
        return part, alive
    # Few are left: only their rows of the planes below are read.
    planes = [x.plane(b) for b in range(left, -1, -1)]
    for i in np.flatnonzero(alive.any(1)):
        at = np.flatnonzero(alive[i])
        own = part[i, at][None]
        for b, plane in zip(range(left, -1, -1), planes, strict=True):
            own = own + 2.0**b * (plane[at] @ q[i])[None]
            rest = 2.0**b - 1
            keep = _possible(own + rest * below[i], own + rest * above[i], np.ones_like(own, dtype=bool), low[i : i + 1], high[i : i + 1], k)[0]
            at, own = at[keep], own[:, keep]
            if not len(at):
                break
        alive[i] = False
        alive[i, at] = True
        part[i, at] = own[0]
    return part, alive


def _joined(x: Slices) -> np.ndarray:
    """Whole components again, for anchors whose products leave the range of exact floats."""
    return sum(2.0**b * x.plane(b) for b in range(x.planes)) - 2.0 ** (x.planes - 1)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, kinds, strict=True)], names=list(names))


def _ints(values: list) -> bytes:
    return np.array(values, dtype=np.int64).tobytes()


#: A block of the index, or anchors that want one. ids and unnamed are vec_ids and which of them are null; of anchors, low
#: and high are the bands, positive the places of what the bands came from.
MEET = "block long, copy int, later int, dim int, n int, planes int, data binary, labels binary, ids binary, unnamed binary, row_ids binary, bands int, low binary, high binary"
HIT = "anchor_row long, place int, vec_id long, row_id long, score long"


def _packed(rows: DataFrame, size: int, parts: int, anchors: bool) -> DataFrame:
    """Runs of at most so many rows of one dimension, in order of label and then hash."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) == size or held[0]["dim"] != r["dim"]):
                    yield one(held)
                    held = []
                held.append(r)
        if held:
            yield one(held)

    def one(held: list[dict]) -> pa.RecordBatch:
        x = np.array([r["v"] for r in held], dtype=np.float64).reshape(len(held), held[0]["dim"])
        slices = Slices.of(x)
        low, high = [], []
        for r in held:
            found = (r["bands"] if anchors else None) or []
            low += [f["low"] for f in found]
            high += [f["high"] for f in found]
        row = (
            held[0]["row_id"], 0, int(anchors), held[0]["dim"], len(held), slices.planes, x.astype("<f8").tobytes() if anchors else slices.data.tobytes(), _ints([r["label"] for r in held]),
            _ints([r["vec_id"] or 0 for r in held]), bytes(r["vec_id"] is None for r in held), _ints([r["row_id"] for r in held]), len(low) // len(held), _ints(low), _ints(high),
        )
        return _batch(MEET, [row])

    order = ["dim", "label", "spread", "row_id"]
    return rows.withColumn("dim", F.size("v")).withColumn("spread", F.xxhash64("row_id")).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, MEET)


def _met(index: DataFrame, anchors: DataFrame, copies: int, same: bool, k: int) -> DataFrame:
    """HIT: of each anchor, band and index block the k best rows of the anchor's label (same), or of other labels."""
    spark = index.sparkSession
    labels = lambda raw: np.frombuffer(raw, dtype=np.int64)
    ranges = index.select("block", "dim", F.col("labels")).mapInArrow(
        lambda batches: (_batch("block long, dim int, least long, most long", [(r["block"], r["dim"], int(labels(r["labels"])[0]), int(labels(r["labels"])[-1])) for r in b.to_pylist()]) for b in batches),
        "block long, dim int, least long, most long",
    )
    sent = spark.sparkContext.broadcast({c: v.to_numpy() for c, v in ranges.toPandas().items()})

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t, own = sent.value, labels(r["labels"])
                copy = int(mix(np.array([r["block"]], dtype=np.int64).view(np.uint64))[0] % np.uint64(copies))
                q = np.frombuffer(r["data"]).reshape(r["n"], r["dim"])
                ids, rows, low, high = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "row_ids", "low", "high"))
                unnamed, low, high = np.frombuffer(r["unnamed"], dtype=np.uint8), low.reshape(r["n"], -1), high.reshape(r["n"], -1)
                asks = (low <= high).any(1)
                for j in np.flatnonzero(t["dim"] == r["dim"]):
                    least, most = t["least"][j], t["most"][j]
                    at = np.flatnonzero(asks & ((own >= least) & (own <= most) if same else (least != most) | (own != least)))
                    if len(at):
                        yield _batch(MEET, [(int(t["block"][j]), copy, 1, r["dim"], len(at), 0, q[at].tobytes(), own[at].tobytes(), ids[at].tobytes(), unnamed[at].tobytes(), rows[at].tobytes(), r["bands"], low[at].tobytes(), high[at].tobytes())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for b in batches:
            for r in b.to_pylist():
                own, ids, rows = (np.frombuffer(r[c], dtype=np.int64) for c in ("labels", "ids", "row_ids"))
                unnamed = np.frombuffer(r["unnamed"], dtype=np.uint8)
                if not r["later"]:
                    x = Slices(r["n"], r["dim"], r["planes"], r["data"]), own, ids, rows, unnamed
                    continue
                q = np.frombuffer(r["data"]).reshape(r["n"], r["dim"])
                low, high = (np.frombuffer(r[c], dtype=np.int64).reshape(r["n"], r["bands"]) for c in ("low", "high"))
                # The widest band has no ends, whatever the range of scores.
                ends = np.where(low == LEAST, -np.inf, low), np.where(high == MOST, np.inf, high)
                allowed = ((x[1][None] == own[:, None]) == same) & (x[3][None] != rows[:, None])
                found, alive = scores(q, x[0], allowed, *ends, k)
                out = []
                for i, j in zip(*np.nonzero(low <= high), strict=True):
                    c = np.flatnonzero(alive[i])
                    s = found[i, c].astype(np.int64)
                    keep = (s >= low[i, j]) & (s <= high[i, j])
                    c, s = c[keep], s[keep]
                    for o in np.lexsort((x[3][c], x[2][c], x[4][c], ~s))[:k]:
                        out.append((int(rows[i]), int(j), None if x[4][c[o]] else int(x[2][c[o]]), int(x[3][c[o]]), int(s[o])))
                yield _batch(HIT, out)

    place = ["block", "copy"]
    dealt = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return dealt.unionByName(anchors.mapInArrow(wanted, MEET)).repartition(*place).sortWithinPartitions(*place, "later").mapInArrow(search, HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, band: tuple[int, int, int] = (30, 90, 100)) -> DataFrame:
    """vectors (vec_id, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x); a score is an integer inner product, higher is better,
    ties go to the smaller vec_id (null last, then as read). An anchor's positives are its
    first other rows of the same label; for each of them come the first rows of other
    labels whose score s satisfies band[0] p <= band[2] s <= band[1] p, p the positive's
    score: none where p is negative. Fewer where there are fewer. Rows with a null label or
    vector, or null or non-finite components, take no part; vectors of different
    dimensions don't meet. Repeated rows are rows of their own: an anchor's own row is left
    out, its copies are not. Scores beyond a long count as the nearest long. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = vectors.select("vec_id", quantize(F.col("embedding")).alias("v"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = materialize(rows.where("v is not null and label is not null").withColumn("row_id", F.monotonically_increasing_id()), "mining-rows")
    n, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    size = max(INDEX_BLOCK, -(-n // MAX_BLOCKS))
    index = materialize(_packed(rows, size, max(1, -(-n // size)), False), "mining-index")
    copies, parts = max(1, -(-asked // (ANCHOR_BLOCK * ANCHORS_OF_COPY))), max(1, -(-asked // ANCHOR_BLOCK))
    anchors = rows.where("anchor")
    every = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    first = _best(_met(index, _packed(anchors.withColumn("bands", every), ANCHOR_BLOCK, parts, True), copies, True, positives), positives)
    first = materialize(first.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")
    score, (least, most, whole) = F.col("positive_score").cast("decimal(38,0)"), band
    # Whole numbers: up for the lower end, down for the upper one.
    low, high = -F.floor(-score * least / whole), F.floor(score * most / whole)
    ends = first.select("anchor_row", "place", low.cast("long").alias("low"), high.cast("long").alias("high"))
    found = ends.groupBy("anchor_row").agg(F.collect_list(F.struct("place", "low", "high")).alias("found"))
    # As many bands for every anchor; those without a positive hold no score.
    none = F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    at = lambda i: F.element_at(F.filter("found", lambda f: f["place"] == i), 1)
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.when(F.exists("found", lambda f: f["place"] == i), F.struct(at(i)["low"].alias("low"), at(i)["high"].alias("high"))), none))
    banded = anchors.join(found.withColumnRenamed("anchor_row", "row_id"), "row_id").withColumn("bands", filled).drop("found")
    second = _best(_met(index, _packed(banded, ANCHOR_BLOCK, parts, True), copies, False, negatives), negatives)
    mined = second.select("anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(first, ["anchor_row", "place"])
    return mined.join(anchors.select(F.col("row_id").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.row_id AS a, a.vec_id AS anchor_id, c.row_id AS c, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.row_id <> c.row_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.c) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
