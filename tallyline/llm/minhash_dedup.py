"""Near-duplicate detection by banded MinHash with odd sketches.

1. One pass over the texts makes each set of shingles, K MinHash samples of it, their
   bands, and an odd sketch: every sample flips one bit of a bitmap, so a bitmap keeps
   parities. Two sets' samples that agree cancel out in the XOR of their sketches, and the
   population count of the XOR tells how many don't, most precisely where few do.
2. Sets with a band in common meet in its bucket, in narrow rows. Buckets of a few sets get
   their sketches and keep a spanning forest of the pairs whose count is within what the
   similarity asked for can give; a bucket of more than BUCKET sets is chained as it is. The
   components of these edges are blocks, which no link leaves.
3. A block's full sets go to one task, which follows exact links from set to set: a set is
   compared with those not reached yet, and only where sizes and sketches allow a link. A
   block above a bounded weight is cut into chunks that all get one set of it; what is not
   linked with the main component then is compared with every chunk. So neither a group of
   copies nor a chain of them is ever multiplied out, unless its members differ.

Links are told by full sets. A pair at the asked similarity has no band in common with a
probability of MISS or less, and is ruled out by its sketches with one of about 1e-10 (SIGMAS),
whatever the input; nothing is capped or sampled. Pairs of equal sets never rest on that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components
from .hashing import mix
from .ngram_join import Shingler, set_key, short_key, with_shingles

#: Samples in a band, and how likely a pair at the asked similarity may share none.
BAND_ROWS, MISS = 5, 1e-11
SKETCH_BITS = 1024
#: Standard deviations that a sketch may be off.
SIGMAS = 6.5
#: Shingles that are sampled at a time, and bands that a task sorts at a time.
GROUP, FLUSH = 1 << 16, 500_000
#: Sets of a bucket that are chained as they are, above these numbers: in one task's part, and in all.
LOCAL_BUCKET, BUCKET = 32, 64
#: Shingles and sets of a chunk of a block.
CHUNK_WEIGHT, CHUNK_SETS = 400_000, 4096


class OddSketcher:
    """MinHash samples of sets, banded for linking at p/q and folded into odd sketches."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        near = p / q
        self.bands = math.ceil(math.log(MISS) / math.log1p(-(near**BAND_ROWS))) if p < q else 1
        self.samples = self.bands * BAND_ROWS
        self.factors = np.random.default_rng(13).integers(0, 1 << 31, self.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.most = self._most(near)

    def _most(self, near: float) -> int:
        """The largest count of odd bits that a linked pair is expected to show, with SIGMAS deviations."""
        n, k = SKETCH_BITS, self.samples
        differ, spread = k * (1 - near), math.sqrt(k * near * (1 - near))
        left = math.exp(-4 * differ / n)  # of 2 * differ flips
        return math.ceil(n / 2 * (1 - left) + SIGMAS * math.hypot(2 * left * spread, math.sqrt(n / 4 * (1 - left**2))))

    def similarity(self, odd: np.ndarray) -> np.ndarray:
        """The Jaccard similarity that counts of odd bits stand for."""
        return 1 + SKETCH_BITS / (4 * self.samples) * np.log(np.maximum(1e-9, 1 - 2 * odd / SKETCH_BITS))

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes (sets x bands) and sketches (sets x bytes) of sets that aren't empty."""
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        sizes = np.array([len(s) for s in sets])
        starts, room = np.cumsum(sizes) - sizes, np.empty_like(flat)
        samples = np.empty((self.samples, len(sets)), dtype=np.uint32)
        for k, factor in enumerate(self.factors):
            np.minimum.reduceat(np.multiply(flat, factor, out=room), starts, out=samples[k])
        samples = samples.T.astype(np.uint64)
        bands = np.zeros((len(sets), self.bands), dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
        for i in range(BAND_ROWS):
            bands = mix(bands * np.uint64(3) + samples[:, i::BAND_ROWS])
        place = mix(samples + (np.arange(self.samples, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
        flips = np.bincount((place.astype(np.int64) + SKETCH_BITS * np.arange(len(sets))[:, None]).ravel(), minlength=SKETCH_BITS * len(sets))
        return bands, np.packbits((flips & 1).astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1)


def odd_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population counts of the XOR of sketches, row by row, as words of 64 bits."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _grouped(sets: list[np.ndarray]) -> Iterator[slice]:
    """Runs of sets with GROUP shingles or so together."""
    ends = np.cumsum([len(s) for s in sets])
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GROUP, "right")))
        yield slice(a, b)
        a = b


BASE = "row_id long, doc_id long, n long, key binary, short long, bands binary, sketch binary"


def _sets(docs: DataFrame, width: int, sketcher: OddSketcher, row: str | None) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                n, keys, held, at = [], [], [], []
                bands, sketches = [None] * b.num_rows, [None] * b.num_rows

                def sample() -> None:
                    for run in _grouped(held):
                        for i, x, y in zip(at[run], *sketcher.of(held[run]), strict=True):
                            bands[i], sketches[i] = x.tobytes(), y.tobytes()
                    held.clear()
                    at.clear()

                for i, s in enumerate(shingler.sets(b.column("text"))):
                    n.append(len(s))
                    keys.append(set_key(s))
                    if len(s):
                        held.append(s)
                        at.append(i)
                    if len(s) > GROUP:
                        sample()
                sample()
                short = np.array([short_key(k) for k in keys], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(short), pa.array(bands, pa.binary()), pa.array(sketches, pa.binary())], names=["row_id", "doc_id", "n", "key", "short", "bands", "sketch"])

    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, BASE)


#: A set in a bucket (other is null), or an edge between sets of one bucket.
MET = "bucket long, short long, other long, hot boolean"


def _met(bucket: np.ndarray, short: np.ndarray, other: np.ndarray | None, hot: np.ndarray | bool) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(short, pa.int64()), pa.nulls(n, pa.int64()) if other is None else pa.array(other, pa.int64()), pa.array(np.broadcast_to(hot, n))], names=["bucket", "short", "other", "hot"])


def _buckets(base: DataFrame) -> DataFrame:
    """MET: the sets of each bucket with 2 to BUCKET of them, and edges that chain the sets of larger ones.

    A task chains what is large in its own part already and hands on one set of it, so a
    bucket with a third of all sets is a row for each task that met it.
    """

    def flushed(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = {short: raw for short, raw in held}
        found = np.frombuffer(b"".join(rows.values()), dtype=np.int64)
        own = np.repeat(np.array(list(rows), dtype=np.int64), len(found) // len(rows))
        order = np.lexsort((own, found))
        found, own = found[order], own[order]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        size = np.diff(np.append(first, len(found)))
        hot = np.repeat(size > LOCAL_BUCKET, size)
        lead = np.zeros(len(found), dtype=bool)
        lead[first] = True
        yield _met(found[~hot | lead], own[~hot | lead], None, hot[~hot | lead])
        behind = np.flatnonzero(hot & ~lead)
        yield _met(found[behind], own[behind - 1], own[behind], True)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for short, raw in zip(b.column("short").to_pylist(), b.column("bands").to_pylist(), strict=True):
                held.append((short, raw))
                n += len(raw) // 8
                if n > FLUSH:
                    yield from flushed(held)
                    held, n = [], 0
        if held:
            yield from flushed(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, short, hot = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        for b in batches:
            edge = np.asarray(b.column("other").is_valid())
            if edge.any():
                yield b.filter(pa.array(edge))
            kept = b.filter(pa.array(~edge))
            bucket, short, hot = np.append(bucket, kept.column("bucket").to_numpy()), np.append(short, kept.column("short").to_numpy()), np.append(hot, np.asarray(kept.column("hot")))
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            yield from closed(bucket[:last], short[:last], hot[:last])
            bucket, short, hot = bucket[last:], short[last:], hot[last:]
            if len(bucket) > 2 * BUCKET:
                # Certainly large: chain what is here and go on with the last of it.
                yield from closed(bucket, short, np.ones(len(bucket), dtype=bool))
                bucket, short, hot = bucket[-1:], short[-1:], np.ones(1, dtype=bool)
        yield from closed(bucket, short, hot)

    def closed(bucket: np.ndarray, short: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole buckets, in order of bucket and set."""
        if not len(bucket):
            return
        # One set may have come from several tasks.
        again = np.append(False, (bucket[1:] == bucket[:-1]) & (short[1:] == short[:-1]))
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.add.reduceat(~again, first)
        large = (size > BUCKET) | (np.add.reduceat(hot.astype(np.int64), first) > 0)
        rows = np.diff(np.append(first, len(bucket)))
        few, many = np.repeat((size > 1) & ~large, rows) & ~again, np.repeat(large, rows)
        yield _met(bucket[few], short[few], None, False)
        behind = np.flatnonzero(many[1:] & (bucket[1:] == bucket[:-1]) & ~again[1:]) + 1
        yield _met(bucket[behind], short[behind - 1], short[behind], True)

    rows = base.where("n > 0").select("short", "bands").mapInArrow(spread, MET)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "short").mapInArrow(meet, MET)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of edges between 0..n-1, the smallest number that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _candidates(members: DataFrame, sketcher: OddSketcher) -> DataFrame:
    """members (bucket, short, n, sketch) -> a, b: a spanning forest of each bucket's pairs that sizes and sketches allow."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = b if held is None else pa.concat_batches([held, b])
            bucket = held.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if last:
                yield edges(held.slice(0, last))
            held = held.slice(last)
        if held is not None and held.num_rows:
            yield edges(held)

    def edges(rows: pa.RecordBatch) -> pa.RecordBatch:
        bucket, short, n = (rows.column(c).to_numpy() for c in ("bucket", "short", "n"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(bucket), -1)
        left, right, step = [], [], 1
        at = np.arange(len(bucket))
        while True:
            at = at[at + step < len(bucket)]
            at = at[bucket[at] == bucket[at + step]]
            if not len(at):
                break
            low, high = np.minimum(n[at], n[at + step]), np.maximum(n[at], n[at + step])
            near = at[low * sketcher.q >= high * sketcher.p]
            near = near[odd_bits(sketch[near], sketch[near + step]) <= sketcher.most]
            left.append(near)
            right.append(near + step)
            step += 1
        label = _forest(np.concatenate([*left, at]), np.concatenate([*right, at]), len(bucket))
        ends = np.flatnonzero(label != np.arange(len(bucket)))
        return pa.RecordBatch.from_arrays([pa.array(short[ends]), pa.array(short[label[ends]])], names=["a", "b"])

    return members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(link, "a long, b long")


class Sets:
    """Sets of a task, with what tells which of them can link."""

    def __init__(self, rows: list[dict], sketcher: OddSketcher):
        self.sketcher, self.keys = sketcher, [r["key"] for r in rows]
        self.sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
        self.n = np.array([len(s) for s in self.sets])
        self.sketch = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype=np.uint64).reshape(len(rows), -1)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that link with i, by their full sets."""
        p, q = self.sketcher.p, self.sketcher.q
        others = others[(self.n[others] * q >= self.n[i] * p) & (self.n[i] * q >= self.n[others] * p)]
        others = others[odd_bits(self.sketch[others], self.sketch[i][None]) <= self.sketcher.most]
        out = []
        for some in np.array_split(others, max(1, -(-int(self.n[others].sum()) // CHUNK_WEIGHT))):
            if len(some):
                flat, own = np.concatenate([self.sets[j] for j in some]), self.sets[i]
                same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                shared = np.add.reduceat(same.astype(np.int64), np.cumsum(self.n[some]) - self.n[some])
                out.append(some[q * shared >= p * (self.n[i] + self.n[some] - shared)])
        return np.concatenate(out) if out else others[:0]


def follow(sets: Sets, sources: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that join, along exact links of sources with any set, all sets that such links reach; sets of one label are joined already."""
    label = label.copy()
    waiting, done = np.zeros(len(label), dtype=bool), np.zeros(len(label), dtype=bool)
    waiting[sources] = True
    while waiting.any():
        queue = [int(np.flatnonzero(waiting)[0])]
        waiting[queue[0]] = False
        while queue:
            i = queue.pop()
            done[i] = True
            if (label == label[i]).all():
                return
            # Sources that are done have been compared with this one.
            others = np.flatnonzero((label != label[i]) & ~done)
            found = sets.linked(i, others)
            if len(found):
                met, first = np.unique(label[found], return_index=True)
                yield from ((i, int(j)) for j in found[first])
                label[np.isin(label, met)] = label[i]
                near = found[waiting[found]]
                waiting[near] = False
                queue += near.tolist()


FOUND = "key binary, other binary"


def _verified(tasks: DataFrame, place: list[str], sketcher: OddSketcher) -> DataFrame:
    """FOUND: edges of exact links between the sets of each task; only pairs with a source that differ in label count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                at = tuple(r[c] for c in place)
                if at != now:
                    yield from done(held)
                    now, held = at, []
                if not held or held[-1]["key"] != r["key"]:
                    held.append(r)
        yield from done(held)

    def done(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        sets, ids = Sets(rows, sketcher), {}
        label = np.array([ids.setdefault(r["label"] or r["key"], len(ids)) for r in rows])
        edges = list(follow(sets, np.flatnonzero([r["source"] for r in rows]), label))
        yield pa.RecordBatch.from_arrays([pa.array([sets.keys[i] for i, _ in edges], pa.binary()), pa.array([sets.keys[j] for _, j in edges], pa.binary())], names=["key", "other"])

    return tasks.repartition(*place).sortWithinPartitions(*place, "key", F.desc("source")).mapInArrow(run, FOUND)


def _links(docs: DataFrame, members: DataFrame, width: int, sketcher: OddSketcher) -> DataFrame:
    """members (block, key, doc_id, n, sketch, short) -> a, b: edges along exact links that join whatever links join."""
    weights = members.groupBy("block").agg(F.ceil(F.greatest(F.sum("n") / CHUNK_WEIGHT, F.count("*") / CHUNK_SETS)).cast("int").alias("chunks"), F.min("key").alias("hub"))
    filled = materialize(with_shingles(docs, members.join(weights, "block"), width).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")), "minhash-blocks")
    # A block's hub goes to every chunk of it.
    dealt = filled.withColumn("chunk", F.explode(F.when(F.col("key") == F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))))
    task = [F.lit(True).alias("source"), F.lit(None).cast("binary").alias("label"), "key", "shingles", "sketch"]
    found = materialize(_verified(dealt.select("block", "chunk", *task), ["block", "chunk"], sketcher), "minhash-links")
    large = filled.where("chunks > 1")
    if not large.select("key").head(1):
        return found
    # Of a block in chunks, what isn't in its largest component is compared with all of it.
    roots = components(found.join(large.select("key"), "key", "left_semi").select(F.col("key").alias("a"), F.col("other").alias("b")))
    label = F.coalesce("root", "key").alias("label")
    labels = large.select("block", "key", "n", "chunk", "chunks").join(roots.withColumnRenamed("node", "key"), "key", "left").select("block", "key", "n", "chunk", "chunks", label)
    sizes = labels.groupBy("block", "label").agg(F.count("*").alias("sets"))
    main = sizes.groupBy("block").agg(F.max_by("label", F.struct("sets", "label")).alias("main"))
    labels = materialize(labels.join(main, "block").withColumn("rest", F.col("label") != F.col("main")), "minhash-rest")
    rest = labels.where("rest").groupBy("block").agg(F.ceil(F.greatest(F.sum("n") / CHUNK_WEIGHT, F.count("*") / CHUNK_SETS)).cast("int").alias("rests"))
    # Blocks in one component are done; their sets aren't sent again.
    open_ = labels.join(rest, "block").join(large.select("key", "shingles", "sketch"), "key")
    rows = ["key", "shingles", "sketch", "label"]
    every = open_.select("block", "chunk", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("with"), F.lit(False).alias("source"), *rows)
    own = F.pmod(F.xxhash64("key"), F.col("rests")).cast("int").alias("with")
    sources = open_.where("rest").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), own, F.lit(True).alias("source"), *rows)
    return found.unionByName(_verified(every.unionByName(sources), ["block", "chunk", "with"], sketcher))


def minhash_dedup(docs: DataFrame, width: int = 5, p: int = 4, q: int = 5, row: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> row_id, doc_id, n_shingles, component_id, kept: one row per row of docs.

    A set holds a text's distinct runs of ``width`` words, A-Z in lower case; with fewer
    words, the whole sequence. Documents link when their sets' Jaccard similarity is p/q
    or more; component_id is the smallest doc_id that links reach. Null and wordless texts
    have an empty set and themselves as component. Rows with a null id take part and never
    name a component unless all its rows have null ids. Repeated rows are copies like any
    other. kept marks one row of each component: the smallest doc_id (null last), then the
    smallest row_id, which is docs' column ``row`` or the order of reading; rows without
    words are all kept. An empty table gives an empty result; other columns are ignored.
    """
    sketcher = OddSketcher(p, q)
    base = materialize(_sets(docs, width, sketcher, row), "minhash-sets")
    met = materialize(_buckets(base), "minhash-buckets")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    rows = base.select("row_id", "doc_id", "n", "key", "short")
    sets = rows.groupBy("key", "short", "n").agg(F.min(first).alias("first"))
    # A set's sketch is that of any row with the set.
    sketches = base.where("n > 0").select("short", "n", "sketch").dropDuplicates(["short"])
    members = met.where("other is null").select("bucket", "short").join(sketches, "short")
    edges = _candidates(members, sketcher).unionByName(met.where("other is not null").select(F.col("short").alias("a"), F.col("other").alias("b")))
    blocks = components(edges).select(F.col("node").alias("short"), F.col("root").alias("block"))
    inside = blocks.join(sets.select("key", "short", F.col("first.doc_id").alias("doc_id")), "short").join(sketches, "short")
    roots = components(_links(docs, inside.drop("short"), width, sketcher).select(F.col("key").alias("a"), F.col("other").alias("b")))
    classes = sets.join(roots, sets["key"] == roots["node"]).groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(classes, "root").select(F.col("node").alias("key"), "least")
    per_set = sets.join(linked, "key", "left").select("key", F.coalesce("least", "first").alias("least"))
    alone = F.col("n") == 0
    return rows.join(per_set, "key").select(
        "row_id",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (alone | (F.col("row_id") == F.col("least.row_id"))).alias("kept"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS row_id, string_split(trim(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
s AS (
  SELECT doc_id, row_id, CASE WHEN w = [''] THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS sh FROM d),
u AS MATERIALIZED (SELECT sh, min(row_id) AS set_id, min(doc_id) AS doc_id, len(sh) AS n FROM (SELECT doc_id, row_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
x AS MATERIALIZED (SELECT set_id, n, unnest(sh) AS g FROM u),
df AS (SELECT g, count(*) AS f FROM x GROUP BY g),
ord AS (SELECT x.*, row_number() OVER (PARTITION BY set_id ORDER BY f, g) AS pos FROM x JOIN df USING (g)),
head AS MATERIALIZED (SELECT * FROM ord WHERE pos <= n - CAST(ceil(n * 8 / 10.0) AS BIGINT) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.set_id AS a, b.set_id AS b FROM head a JOIN head b ON a.g = b.g AND a.set_id < b.set_id
  AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
inter AS (SELECT a, b, count(*) AS o FROM cand JOIN x p ON p.set_id = a JOIN x q ON q.set_id = b AND q.g = p.g GROUP BY a, b),
links AS MATERIALIZED (SELECT a, b FROM inter JOIN u p ON p.set_id = a JOIN u q ON q.set_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(set_id, other) AS (SELECT set_id, set_id FROM u UNION SELECT r.set_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT r.set_id, min(u.doc_id) AS component_id FROM reach r JOIN u ON u.set_id = r.other GROUP BY 1),
c AS (SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE least.component_id END AS component_id
  FROM s JOIN u ON u.sh = list_sort(s.sh) JOIN least USING (set_id))
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM c
"""
