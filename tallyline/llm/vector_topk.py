"""Exact top-k search by inner product with a pivot-distance index.

Largest inner product becomes nearest neighbour by one more coordinate: a vector x gets
sqrt(M^2 - |x|^2), M the largest length, and a query gets 0; then the squared distance is
|q|^2 + M^2 - 2 q.x. Every vector is keyed by its nearest pivot and its distance to it
and sorted by that key, and runs of the sorted index are blocks: annuli around a pivot,
with the least and greatest distance. By the triangle inequality no vector of a block is
nearer to q than the gap between d(q, pivot) and the block's range of distances.

A query first searches the blocks with the smallest gaps, which gives it a k-th best
score, and then expands to the blocks whose gap is within the distance that this score
stands for; all others are ruled out. In both rounds a block of the index and the queries
that want it go to one task, sorted so that the block comes first and the queries stream
past it; the index is dealt to as many copies of each block as keep its queries bounded.
Vectors travel in the narrowest integers that hold them all. Only the pivots and the
blocks' ranges are sent to every task.

The pivots are fitted on a bounded sample; they decide how much is ruled out, never the
result, which is exact: scores are integers, and bounds carry a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .hashing import mix

SAMPLE, PIVOTS = 2048, 64
INDEX_BLOCK, QUERY_BLOCK = 2048, 256
#: Blocks grow beyond INDEX_BLOCK rows rather than become more than this.
MAX_BLOCKS = 65_536
FIRST_BLOCKS = 2
#: Blocks of queries that stream past one copy of an index block, and queries whose gaps are computed at a time.
QUERIES_OF_COPY, GAPS_AT_ONCE = 256, 32
NO_ID = np.iinfo(np.int64).max


def quantize(embedding: Column) -> Column:
    """floor(256 * x) of each component, as whole doubles of any size; null unless all components are finite numbers.

    A component above 7e305, whose 256-fold isn't a finite double, counts as non-finite.
    """
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * 256) < float("inf")))
    # From 2**53 on every double is whole.
    floor = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return F.when(embedding.isNotNull() & fine, F.transform(embedding, lambda x: floor(x.cast("double") * 256)))


def _pivots(vectors: DataFrame, sample: int, pivots: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: farthest-first over the sample rows with the smallest hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "row_id").limit(sample).select("v").collect()
    out = {}
    for dim in {len(r["v"]) for r in rows}:
        own = [r["v"] for r in rows if len(r["v"]) == dim]
        x = np.array(own, dtype=np.float64).reshape(len(own), dim)
        chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(x)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[dim] = x[chosen]
    return out


class Geometry:
    """Pivots in the space with the added coordinate."""

    def __init__(self, pivots: dict[int, np.ndarray], longest: dict[int, float]):
        self.longest = longest
        self.pivots = {d: pivots[d] if d in pivots else np.zeros((1, d)) for d in longest}
        self.more = {d: np.sqrt(np.maximum(0, longest[d] - (p**2).sum(1))) for d, p in self.pivots.items()}

    def distances(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """Of rows to pivots."""
        dim = x.shape[1]
        p, x = self.pivots[dim], x.astype(np.float64)
        added = np.zeros(len(x)) if queries else np.sqrt(np.maximum(0, self.longest[dim] - (x**2).sum(1)))
        squares = (x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T + (added[:, None] - self.more[dim][None]) ** 2
        return np.sqrt(np.maximum(0, squares))

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that a score stands for, with a margin."""
        x = x.astype(np.float64)
        square = (x**2).sum(1) + self.longest[x.shape[1]] - 2 * score
        return np.sqrt(np.maximum(0, square)) + 1e-3 + 1e-6 * np.sqrt(self.longest[x.shape[1]] + (x**2).sum(1))


def _matrix(raw: bytes, kind: str, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(n, dim)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers, as longs; those beyond a long become the nearest long.

    Floats where no sum can leave 2**53, longs where none can leave 2**63, and otherwise
    Python's integers.
    """
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    limit = np.iinfo(np.int64)
    return np.minimum(np.maximum(whole(q) @ whole(x).T, limit.min), limit.max).astype(np.int64)


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def _key(vectors: DataFrame, geometry: Geometry, kind: str) -> DataFrame:
    """Adds each row's nearest pivot and the distance to it."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            pivot, dist = np.zeros(len(b), dtype=np.int32), np.zeros(len(b))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                d = geometry.distances(flat[starts[at][:, None] + np.arange(dim)[None]].reshape(len(at), dim), False)
                pivot[at] = d.argmin(1)
                dist[at] = d.min(1)
            raw = [flat[s : s + n].astype(kind).tobytes() for s, n in zip(starts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes.astype(np.int32)), pa.array(pivot), pa.array(dist), b.column("vec_id"), b.column("row_id"), pa.array(raw, pa.binary())],
                names=["dim", "pivot", "dist", "vec_id", "row_id", "v"],
            )

    return vectors.mapInArrow(key, "dim int, pivot int, dist double, vec_id long, row_id long, v binary")


BLOCK = "block long, dim int, pivot int, dmin double, dmax double, n int, vec_ids binary, row_ids binary, vs binary"


def _blocks(keyed: DataFrame, rows: int, parts: int) -> DataFrame:
    """Sorted runs of at most so many rows of one dimension and pivot."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in _rows(batches):
            if held and (len(held) == rows or (held[0]["dim"], held[0]["pivot"]) != (r["dim"], r["pivot"])):
                yield one(held)
                held = []
            held.append(r)
        if held:
            yield one(held)

    def one(held: list[dict]) -> pa.RecordBatch:
        ids = np.array([NO_ID if r["vec_id"] is None else r["vec_id"] for r in held], dtype=np.int64)
        row = {
            "block": held[0]["row_id"], "dim": held[0]["dim"], "pivot": held[0]["pivot"], "dmin": held[0]["dist"], "dmax": held[-1]["dist"], "n": len(held),
            "vec_ids": ids.tobytes(), "row_ids": np.array([r["row_id"] for r in held], dtype=np.int64).tobytes(), "vs": b"".join(r["v"] for r in held),
        }
        types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([row[n]], types[t]) for n, t in (c.split() for c in BLOCK.split(", "))], names=list(row))

    order = ["dim", "pivot", "dist", "vec_id", "row_id"]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, BLOCK)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score of each query's k best other rows.

    Ties go to the smaller vec_id (null last). Rows whose embedding is null or holds
    null or non-finite components are neither queries nor candidates; vectors of
    different dimensions don't meet. Repeated rows count as rows of their own: a query's
    own row is left out, its copies are not. A query with fewer than k candidates gets
    them all; scores beyond a long count as the nearest long; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", quantize(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = materialize(rows.where("v is not null").withColumn("row_id", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    most = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    stats = rows.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("longest"), most.alias("most"), F.count("*").alias("n"), F.count_if("query").alias("queries")).collect()
    geometry = Geometry(_pivots(rows, sample, pivots), {r["dim"]: r["longest"] for r in stats})
    n, largest = sum(r["n"] for r in stats), max((r["most"] or 0 for r in stats), default=0)
    kind = next((k for k in ("<i2", "<i4", "<i8") if largest < np.iinfo(k).max), "<f8")
    size = max(INDEX_BLOCK, -(-n // MAX_BLOCKS))
    index = materialize(_blocks(_key(rows, geometry, kind), size, max(1, -(-n // size))), "vector-index")
    asked = _key(rows.where("query"), geometry, kind)
    asked = materialize(_blocks(asked, QUERY_BLOCK, max(1, -(-n // (50 * QUERY_BLOCK)))), "vector-queries")
    copies = max(1, -(-sum(r["queries"] for r in stats) // (QUERY_BLOCK * QUERIES_OF_COPY)))
    ranges = index.select("block", "dim", "pivot", "dmin", "dmax").toPandas()
    sent = spark.sparkContext.broadcast({c: ranges[c].to_numpy() for c in ranges})

    def gaps(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the queries' dimension, and for each query the least distance to any row of each."""
        t = sent.value
        own = np.flatnonzero(t["dim"] == q.shape[1])
        pivot, dmin, dmax = t["pivot"][own], t["dmin"][own], t["dmax"][own]
        d = geometry.distances(q, True)
        out = np.empty((len(q), len(own)), dtype=np.float32)
        for i in range(0, len(q), GAPS_AT_ONCE):
            at = d[i : i + GAPS_AT_ONCE, pivot]
            gap = np.maximum(0, np.maximum(at - dmax, dmin - at))
            # Rounded down, so that the narrower numbers rule out nothing more.
            out[i : i + GAPS_AT_ONCE] = np.nextafter(gap.astype(np.float32), np.float32(-1))
        return own, out

    def first(gap: np.ndarray) -> np.ndarray:
        return np.argsort(gap, axis=1, kind="stable")[:, :FIRST_BLOCKS]

    meeting = "block long, copy int, later int, queries long, dim int, n int, places binary, least binary, vec_ids binary, row_ids binary, vs binary"

    def pairs(batches: Iterator[pa.RecordBatch], later: bool) -> Iterator[pa.RecordBatch]:
        """For each index block that some of a block's queries want, those queries."""
        for r in _rows(batches):
            q = _matrix(r["vs"], kind, r["n"], r["dim"])
            ids, own_rows = np.frombuffer(r["vec_ids"], dtype=np.int64), np.frombuffer(r["row_ids"], dtype=np.int64)
            own, gap = gaps(q)
            least = np.full(len(q), np.iinfo(np.int64).min)
            near = first(gap)
            if later:
                for x in r["found"] or []:
                    least[x["place"]] = x["least"]
                reach = np.where(least == np.iinfo(np.int64).min, np.inf, geometry.radius(q, least.astype(np.float64)))
                wanted = ~(gap > reach[:, None])  # distances that overflow rule nothing out
                np.put_along_axis(wanted, near, False, 1)
            else:
                wanted = np.zeros(gap.shape, dtype=bool)
                np.put_along_axis(wanted, near, True, 1)
            copy = int(mix(np.array([r["block"]], dtype=np.int64).view(np.uint64))[0] % np.uint64(copies))
            for j in np.flatnonzero(wanted.any(0)):
                at = np.flatnonzero(wanted[:, j]).astype(np.int32)
                row = (int(sent.value["block"][own[j]]), copy, 1, r["block"], r["dim"], len(at), at.tobytes(), least[at].tobytes(), ids[at].tobytes(), own_rows[at].tobytes(), q[at].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _types(meeting), strict=True)], names=[c.split()[0] for c in meeting.split(", ")])

    hit = "queries long, place int, query_id long, vec_id long, score long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = ids = own = None
        for r in _rows(batches):
            if not r["later"]:
                x, ids, own = _matrix(r["vs"], kind, r["n"], r["dim"]), np.frombuffer(r["vec_ids"], dtype=np.int64), np.frombuffer(r["row_ids"], dtype=np.int64)
                continue
            at, least = np.frombuffer(r["places"], dtype=np.int32), np.frombuffer(r["least"], dtype=np.int64)
            q_ids, q_own = np.frombuffer(r["vec_ids"], dtype=np.int64), np.frombuffer(r["row_ids"], dtype=np.int64)
            scores = exact_products(_matrix(r["vs"], kind, r["n"], r["dim"]), x)
            allowed = (own[None] != q_own[:, None]) & (scores >= least[:, None])
            out = []
            for i in range(len(at)):
                c = np.flatnonzero(allowed[i])
                if len(c) > k:
                    edge = np.partition(scores[i, c], len(c) - k)[len(c) - k]
                    c = c[scores[i, c] >= edge]
                c = c[np.lexsort((ids[c], ~scores[i, c]))][:k]
                out += [(r["queries"], int(at[i]), int(q_ids[i]), int(ids[j]), int(scores[i, j])) for j in c]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _types(hit), strict=True)], names=["queries", "place", "query_id", "vec_id", "score"])

    dealt = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("later"), F.lit(None).cast("long").alias("queries"), "dim", "n", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("least"), "vec_ids", "row_ids", "vs")

    def searched(wanted: DataFrame) -> DataFrame:
        place = ["block", "copy"]
        return dealt.unionByName(wanted).repartition(*place).sortWithinPartitions(*place, "later").mapInArrow(search, hit)

    best = Window.partitionBy("queries", "place").orderBy(F.desc("score"), "vec_id")
    one = materialize(searched(asked.mapInArrow(lambda b: pairs(b, False), meeting)), "vector-first")
    kth = one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    kth = kth.groupBy(F.col("queries").alias("block")).agg(F.collect_list(F.struct("place", F.col("score").alias("least"))).alias("found"))
    two = searched(asked.join(kth, "block", "left").mapInArrow(lambda b: pairs(b, True), meeting))
    ranked = one.unionByName(two).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row_id, c.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row_id <> c.row_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, row_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
WHERE rank <= 5
"""
