"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its words, hashed into buckets and scaled to unit length, and
dense statistics of its structure and of numeric metadata, standardised. The model scores

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs interact at a cost linear in the number of features: the inner sums are
segment sums over a batch of documents.

Fitting uses a bounded sample of labelled documents (``sample``, those with the smallest
hash of their id); features are made by the executors, and what reaches the driver is at
most ``sample`` sparse rows of at most ``buckets`` entries. Scoring reads every document
once, whole, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_crc, quoted, table, unused

SAMPLE, BUCKETS, FACTORS, EPOCHS = 6000, 1 << 14, 8, 12
THRESHOLD = 0.7
STATISTICS = (
    "log_chars", "log_words", "word_chars", "distinct_words", "top_word", "repeated_lines", "line_words",
    "upper", "digits", "symbols", "spaces", "bars", "stops", "exclaims", "symbol_words", "upper_words",
)
_UPPER, _DIGIT, _SPACE = (re.compile(x) for x in (r"[A-ZÀ-ÖØ-Þ]", r"\d", r"\s"))
_SYMBOL = re.compile(r"[^\w\s]")
_END = re.compile(r"[^\w\s]+$")


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """The STATISTICS of a text; all are 0 for an empty one."""
    n, m = len(text), len(words)
    if not m:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = len(_SYMBOL.findall(text))
    heavy = sum(c for w, c in counts.items() if len(_SYMBOL.findall(w)) > 1)
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(n), math.log1p(m), n / m, len(counts) / m, max(counts.values()) / m, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(m / max(1, len(lines))),
        len(_UPPER.findall(text)) / n, len(_DIGIT.findall(text)) / n, symbols / n, len(_SPACE.findall(text)) / n, text.count("|") / m, text.count(".") / m, text.count("!") / m, heavy / m, shouted / m,
    ]


class Features:
    """Sparse word features as (row, bucket, value), and dense statistics, of a batch of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.hashes = buckets, {}

    def bucket(self, word: str) -> int:
        h = self.hashes.get(word)
        if h is None:
            if len(self.hashes) > 500_000:
                self.hashes.clear()
            h = self.hashes[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        return h

    def one(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        total: Counter = Counter()
        for w, c in counts.items():
            total[self.bucket(_END.sub("", w).lower() or w)] += c
        at = np.fromiter(total, dtype=np.int64, count=len(total))
        value = np.sqrt(np.fromiter(total.values(), dtype=np.float64, count=len(total)))
        return at, value / (np.sqrt((value**2).sum()) or 1.0), structure(text, words, counts)


class Machine:
    """A fitted factorisation machine; dense features follow the buckets."""

    def __init__(self, buckets: int, factors: int, dense: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.bias, self.w = 0.0, np.zeros(buckets + dense)
        self.v = rng.normal(0, 0.02, (buckets + dense, factors))
        self.mean, self.scale = np.zeros(dense), np.ones(dense)
        self.slope, self.shift = 1.0, 0.0

    def join(self, at: list[np.ndarray], value: list[np.ndarray], dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One flat list of features with the start of each row; every row has its dense features, so none is empty."""
        z = np.clip((dense - self.mean) / self.scale, -6, 6) * 0.3
        own = self.buckets + np.arange(dense.shape[1])
        flat_at = np.concatenate([x for a in at for x in (a, own)])
        flat_value = np.concatenate([x for a, row in zip(value, z, strict=True) for x in (a, row)])
        sizes = np.array([len(a) + len(own) for a in at])
        return flat_at, flat_value, np.cumsum(sizes) - sizes

    def raw(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's sums and, for gradients, the factor sums."""
        vx = self.v[at] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx**2, starts)
        linear = np.add.reduceat(self.w[at] * value, starts)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(1), sums

    def score(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.raw(at, value, starts)[0] * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int = 0, batch: int = 64, rate: float = 0.08, decay: float = 1e-4) -> None:
        """Adagrad on the log loss, classes weighed alike."""
        dense = np.array([d for _, _, d in rows], dtype=np.float64)
        self.mean, self.scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        grads = [np.full(self.w.shape, 1e-3), np.full(self.v.shape, 1e-3)]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for chosen in np.split(order, range(batch, len(order), batch)):
                at, value, starts = self.join([rows[i][0] for i in chosen], [rows[i][1] for i in chosen], dense[chosen])
                z, sums = self.raw(at, value, starts)
                error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[chosen]) * weight[chosen] / len(chosen)
                row = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(at))))
                unique, back = np.unique(at, return_inverse=True)
                g_w = np.bincount(back, error[row] * value) + decay * self.w[unique]
                slopes = error[row][:, None] * value[:, None] * (sums[row] - self.v[at] * value[:, None])
                g_v = np.stack([np.bincount(back, slopes[:, f]) for f in range(self.v.shape[1])], 1) + decay * self.v[unique]
                grads[0][unique] += g_w**2
                grads[1][unique] += g_v**2
                self.w[unique] -= rate * g_w / np.sqrt(grads[0][unique])
                self.v[unique] -= rate * g_v / np.sqrt(grads[1][unique])
                self.bias -= rate * error.sum()


def _feature_rows(docs: DataFrame, columns: list[str], metadata: tuple[str, ...], buckets: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for b in batches:
            texts = b.column("text").to_pylist()
            more = _metadata(b, metadata)
            out = [features.one(t) for t in texts]
            arrays = [b.column(c) for c in columns] + [
                pa.array([a.astype(np.int32).tobytes() for a, _, _ in out], pa.binary()),
                pa.array([v.tobytes() for _, v, _ in out], pa.binary()),
                pa.array([np.append(d, m).tobytes() for (_, _, d), m in zip(out, more, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "at", "value", "dense"])

    kept = docs.select(*columns, "text", *metadata)
    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c in columns)
    return kept.mapInArrow(rows, f"{types}, at binary, value binary, dense binary")


def _metadata(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """log1p of the sizes of numeric metadata, with their sign; null is 0."""
    columns = [np.array([0.0 if x is None or x != x else float(x) for x in batch.column(n).to_pylist()]) for n in names]
    x = np.stack(columns, 1) if columns else np.zeros((batch.num_rows, 0))
    return np.sign(x) * np.log1p(np.abs(x))


def fit_quality(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), sample: int = SAMPLE, buckets: int = BUCKETS, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """Fits on at most ``sample`` labelled documents, those whose ids have the smallest hash.

    labels: doc_id, label (0 or 1; others and null ids are left out; of several for an id
    the smallest counts). Without any labelled document every score is 0.5; labels of one
    class only give a constant score on that class's side. Other columns of docs, one named
    label too, are ignored.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    machine = Machine(buckets, factors, len(STATISTICS) + len(metadata))
    if not chosen:
        machine.slope = 0.0
        return machine
    few = spark.createDataFrame([(r["doc_id"], int(r["label"])) for r in chosen], "doc_id long, label int")
    rows = _feature_rows(docs.select("doc_id", "text", *metadata).join(F.broadcast(few), "doc_id"), ["doc_id", "label"], metadata, buckets)
    # An id may be on any number of rows: the first by content stays, so no more than ``sample`` rows reach the driver.
    one = rows.groupBy("doc_id").agg(F.min(F.struct("dense", "at", "value", "label")).alias("r")).orderBy("doc_id").select("r.*")
    data = [(bytes(r["dense"]), bytes(r["at"]), bytes(r["value"]), r["label"]) for r in one.collect()]
    y = np.array([d[3] for d in data], dtype=np.float64)
    if len(set(y)) < 2:
        machine.slope, machine.shift = 0.0, 3.0 if len(y) and y[0] else -3.0 if len(y) else 0.0
        return machine
    x = [(np.frombuffer(a, dtype=np.int32).astype(np.int64), np.frombuffer(v), np.frombuffer(d)) for d, a, v, _ in data]
    machine.fit(x, y, epochs)
    _calibrate(machine, x, y)
    return machine


def _calibrate(machine: Machine, rows: list, labels: np.ndarray) -> None:
    """Moves the scale so that THRESHOLD lies midway between what the classes score on the sample, at their near 2 % edges."""
    parts = [machine.raw(*machine.join([a for a, _, _ in rows[i : i + 256]], [v for _, v, _ in rows[i : i + 256]], np.array([d for _, _, d in rows[i : i + 256]])))[0] for i in range(0, len(rows), 256)]
    z = np.concatenate(parts)
    low, high = np.quantile(z[labels == 0], 0.98), np.quantile(z[labels == 1], 0.02)
    machine.shift = math.log(THRESHOLD / (1 - THRESHOLD)) - (low + high) / 2


def score_quality(docs: DataFrame, machine: Machine, columns: list[str], metadata: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """The columns of docs asked for, with a last one named by ``score``: double in 0 to 1.

    Null texts count as empty; they, and texts without words, get the score of their
    structure alone. Null metadata counts as 0. Rows are scored one by one, so repeated
    rows score alike, and an empty table gives an empty result. Columns of docs named
    like the score, in whatever case, are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    columns = [c for c in columns if c.lower() != score.lower()]
    source = docs.select(*quoted(columns), F.col("text"), *metadata)
    # Columns go by place: kept ones first, then the text and the metadata.
    names = [f"c{i}" for i in range(len(source.columns))]
    kept = docs.select(*quoted(columns)).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        features = Features(model.buckets)
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                out = [features.one(t) for t in b.column(len(columns)).to_pylist()]
                more = _metadata(b, tuple(names[len(columns) + 1 :]))
                dense = np.array([np.append(d, m) for (_, _, d), m in zip(out, more, strict=True)])
                scores = model.score(*model.join([a for a, _, _ in out], [v for _, v, _ in out], dense))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(scores)], names=[*columns, score])

    return source.toDF(*names).mapInArrow(rows, kept.add(score, "double"))


METADATA = ("n_chars",)


def _trained(spark: SparkSession, sf_dir: str) -> Machine:
    """Learned from the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit_quality(docs, labels.where(doc_crc(F.col("doc_id")) % 4 != 2).select("doc_id", F.col("quality").alias("label")), METADATA)


def rejected(score: Column) -> Column:
    return score < THRESHOLD


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), _trained(spark, sf_dir), ["doc_id"], METADATA)
    return scored.select("doc_id", (doc_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", (~rejected(F.col("score"))).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with."""
    score = unused("score", docs.columns)
    scored = score_quality(docs, _trained(spark, sf_dir), docs.columns, METADATA, score)
    return scored.where(~rejected(F.col(score))).select(*quoted(docs.columns))
