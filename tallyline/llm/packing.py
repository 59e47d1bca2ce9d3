"""Mixture-controlled packing of tokenised documents by deficit round-robin.

Rows are dealt to partitions by a hash of their number, so that each partition is a fair
sample of the corpus, however many rows are alike. Texts are tokenised where they are
read, and the tokens of each source are counted over all documents: the shares are every
task's targets. A task holds one queue per source. Every window gives each source of the
corpus a quantum, its target share of the window, on top of the deficit it has left from
the windows before, whether or not the task has documents of it. A source is served what
it is owed, from the head of its queue, the one with the greatest deficit first; documents
are cut there, and what is cut off stays at the head of its queue. So every full window
holds the target proportions but for QUANTUM tokens a source: what is owed less than that
waits for the next window, lest documents fall into crumbs. Room that sources without
tokens leave goes to the others by their weights.

The last window of a partition is rarely full. Its pieces go up a tree, and with them a
row for each source with what it is owed: the remainders of up to 64 partitions meet as
queues, with the summed deficits, and are packed the same way. What the root has left over is shorter than
a window and becomes sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 1024
#: Tokens that a source is served at once at least: what bounds the pieces of a window.
QUANTUM = 32
SEPARATOR = 0
#: Tokens that a task holds in its queues before it serves windows.
HELD_TOKENS = 4_000_000
FAN_IN = 64
VOCABULARY = "byte_bpe_50k"

PIECE = "row_id long, doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, deficit double"
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in PIECE.split(", "))])


class Tokenizer:
    """ids of ``tokenizers`` for byte_bpe_50k.json without added special tokens.

    tiktoken reads the same vocabulary as ranks and gives the same ids several times
    faster. Texts that name the special token, and very long runs of white space, go to
    the reference implementation itself.
    """

    def __init__(self, vocabulary: str):
        import base64

        import tiktoken
        import tokenizers

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or re.search(r"\s{2000}", text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


@functools.cache
def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(vocabulary)


class Piece:
    __slots__ = ("doc_id", "doc_tokens", "ids", "row_id", "source", "start")

    def __init__(self, row_id: int, doc_id: int | None, source: str | None, start: int, doc_tokens: int, ids: np.ndarray):
        self.row_id, self.doc_id, self.source, self.start, self.doc_tokens, self.ids = row_id, doc_id, source, start, doc_tokens, ids


class RoundRobin:
    """Source queues, their deficits and the window being filled."""

    def __init__(self, window: int, weights: dict[str | None, float], base: int):
        self.window, self.weights, self.next_id = window, weights, base
        self.total = sum(weights.values()) or 1.0
        self.queues: dict[str | None, deque[Piece]] = {}
        self.tokens: dict[str | None, int] = {}
        self.owed: dict[str | None, float] = {}  # carried in, less what was served
        self.credit = 0  # tokens of the windows so far: each source's quanta are its share of them
        self.held = 0

    def add(self, piece: Piece) -> None:
        self.queues.setdefault(piece.source, deque()).append(piece)
        self.tokens[piece.source] = self.tokens.get(piece.source, 0) + len(piece.ids)
        self.held += len(piece.ids)

    def deficit(self, source: str | None) -> float:
        return self.owed.get(source, 0.0) + self.credit * self.weights.get(source, 0.0) / self.total

    def deficits(self) -> Iterator[tuple[str | None, float]]:
        """Every source's deficit, of those without documents here too."""
        if self.credit or self.owed:
            for s in self.weights.keys() | self.owed.keys():
                yield s, self.deficit(s)

    def serve(self, down_to: int) -> Iterator[tuple[int, int, Piece]]:
        """(sequence_id, offset, piece) of full windows, until fewer than down_to or a window's tokens are held."""
        while self.held >= max(self.window, down_to):
            yield from self._fill(self.window)

    def _fill(self, size: int) -> list[tuple[int, int, Piece]]:
        sequence, at, out = self.next_id, 0, []
        self.next_id += 1
        self.credit += size

        def serve(source: str | None, most: int) -> int:
            """Up to so many tokens of a source; where the window is filled to, then."""
            end = at
            for piece in self._take(source, most):
                out.append((sequence, end, piece))
                end += len(piece.ids)
            return end

        weighed = [(self.deficit(s), s) for s, n in self.tokens.items() if n and self.weights.get(s, 0.0) > 0]
        for owed, s in sorted(weighed, key=lambda x: x[0], reverse=True):
            if owed < QUANTUM:
                break
            at = serve(s, min(size - at, int(owed)))
        while at < size:
            # Sources of weight 0 only where no other has tokens.
            left = [s for _, s in weighed if self.tokens[s]] or [s for s, n in self.tokens.items() if n]
            weight = lambda s: self.weights.get(s, 0.0) or 1.0
            room, total = size - at, sum(map(weight, left))
            for s in sorted(left, key=lambda s: self.deficit(s) / weight(s), reverse=True):
                at = serve(s, min(size - at, max(QUANTUM, int(room * weight(s) / total))))
                if at == size:
                    break
        return out

    def _take(self, source: str | None, most: int) -> list[Piece]:
        """Pieces of at most so many tokens in all from the head of a queue, the last one cut."""
        queue, left, out = self.queues[source], most, []
        while left and queue:
            piece = queue[0]
            n = len(piece.ids)
            if n > left:
                out.append(Piece(piece.row_id, piece.doc_id, source, piece.start, piece.doc_tokens, piece.ids[:left]))
                piece.start, piece.ids, left = piece.start + left, piece.ids[left:], 0
            else:
                out.append(queue.popleft())
                left -= n
        served = most - left
        self.tokens[source] -= served
        self.held -= served
        self.owed[source] = self.owed.get(source, 0.0) - served
        return out

    def rest(self) -> Iterator[Piece]:
        for queue in self.queues.values():
            yield from queue

    def powers(self) -> Iterator[tuple[int, int, Piece]]:
        """What is left, in sequences whose lengths are powers of two."""
        while self.held:
            yield from self._fill(1 << (self.held.bit_length() - 1))


def _placed(sequence: int, offset: int, p: Piece) -> tuple:
    """Of ids that lie in little-endian words of four bytes."""
    return (p.row_id, p.doc_id, p.source, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, sequence, offset)


def _unplaced(p: Piece) -> tuple:
    return (p.row_id, p.doc_id, p.source, p.start, len(p.ids), None, p.doc_tokens, None, None, p.ids.astype("<u4").tobytes(), None)


def _left(robin: RoundRobin) -> list[tuple]:
    """What goes up the tree: the pieces, and a row without ids for each source's deficit."""
    return [_unplaced(p) for p in robin.rest()] + [(-1, 0, s, 0, 0, None, 0, None, None, None, d) for s, d in robin.deficits()]


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes for each id, or four where one needs more."""
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of one kind: placed pieces end before ids and deficit, which are null."""
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=False)] if rows else []
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(rows), t) for t in SCHEMA.types[len(columns) :]], schema=SCHEMA)


def pack(docs: DataFrame, window: int = WINDOW, weights: dict[str | None, float] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, source, text) -> one row per piece: row_id, doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and one separator id, so an empty or null text is a piece of
    one id. weights are target token proportions by source; without them each source's
    share of the tokens is its target, which keeps every window like the corpus. A source
    of weight 0 is served when no other has tokens. Documents are cut where their source
    has had its share of a window; every id lies in exactly one piece, and a sequence's
    offsets have no gaps. Null ids and sources are values like any other; repeated rows are documents of
    their own (row_id tells them apart). An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(vocabulary).ids
        for b in batches:
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                ids = [np.append(ids_of(t), np.uint32(SEPARATOR)).astype("<u4") for t in part.column("text").to_pylist()]
                kept = [part.column(c) for c in ("row_id", "doc_id", "source")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(i) for i in ids], pa.int64()), pa.array([_narrow(i) for i in ids], pa.binary())], names=["row_id", "doc_id", "source", "n", "ids"])

    tokens = materialize(rows.mapInArrow(encode, "row_id long, doc_id long, source string, n long, ids binary"), "tokens")
    if weights is None:
        weights = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    # Rows stay as they were written, so their numbers deal them alike whenever a task runs again.
    dealt = tokens.repartition(F.xxhash64("row_id")).sortWithinPartitions(F.xxhash64("doc_id"), "row_id")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robin = RoundRobin(window, weights, TaskContext.get().partitionId() << 33)
        for b in batches:
            out = []
            for row_id, doc_id, source, n, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                robin.add(Piece(row_id, doc_id, source, 0, len(ids), ids))
                if robin.held >= HELD_TOKENS:
                    out += [_placed(*x) for x in robin.serve(HELD_TOKENS // 2)]
            yield _batch(out)
        yield _batch([_placed(*x) for x in robin.serve(0)])
        yield _batch(_left(robin))

    level = materialize(dealt.mapInArrow(first, PIECE).withColumn("part", F.when(F.col("sequence_id").isNull(), F.spark_partition_id())), "packed")
    parts = [level.where("sequence_id is not null").drop("part")]
    groups, depth = level.agg(F.max("part")).first()[0], 0
    rest = level.where("sequence_id is null")
    while groups is not None:
        depth += 1
        groups = groups // FAN_IN
        last = groups == 0
        rest = rest.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        level = materialize(rest.groupBy("part").applyInArrow(_meeting(window, weights, depth, last), PIECE + ", part int"), f"packed-{depth}")
        parts.append(level.where("sequence_id is not null").drop("part"))
        rest = level.where("sequence_id is null")
        if last:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("ids", "deficit")


def _meeting(window: int, weights: dict, depth: int, last: bool):
    """Packs the remainders of at most FAN_IN partitions, each shorter than a window."""

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        robin = RoundRobin(window, weights, (depth << 58) + (part << 33))
        rows = table.to_pylist()
        for r in sorted((r for r in rows if r["ids"] is not None), key=lambda r: (r["row_id"], r["start"])):
            robin.add(Piece(r["row_id"], r["doc_id"], r["source"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], dtype="<u4")))
        for r in rows:
            if r["ids"] is None:
                robin.owed[r["source"]] = robin.owed.get(r["source"], 0.0) + r["deficit"]
        batches = [_batch([_placed(*x) for x in robin.serve(0)]), _batch([_placed(*x) for x in robin.powers()] if last else _left(robin))]
        out = pa.Table.from_batches(batches)
        return out.append_column("part", pa.array([part] * out.num_rows, pa.int32()))

    return meet


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences, a row per piece."""
    return pack(docs).drop("row_id")
