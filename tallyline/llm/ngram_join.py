"""Jaccard self-join of word shingle sets by T-occurrence search (DivideSkip).

Two sets of sizes a and b have a Jaccard similarity of p/q or more exactly if they share
T = ceil(p (a + b) / (p + q)) shingles or more, so a document links with those that
occur T times or more in the inverted lists of its shingles. DivideSkip merges only the
short lists, keeps what occurs T - L times or more there, and probes the L longest ones.

1. One pass makes every document's shingle set: its size, a 128-bit key that equal sets
   share, and a sketch of how frequent shingles are (counters by hash, summed).
2. Linked sets differ in k = (a + b) (q - p) / (q + p) shingles at most. So if all
   shingles are dealt into k + 1 + e parts by their hash, linked sets agree entirely on
   1 + e parts or more. A second pass emits a signature of each of the k + 1 parts that
   hold most shingles that aren't frequent; of two sets' common parts the best one is
   among both's. Most signatures stand alone: a pass that exchanges nothing but their
   first bits, packed, tells where two or more meet, and only those are exchanged with
   their sets. Sets that share a signature are chained, not paired, and the components
   of these few edges are blocks that no link leaves. Sizes fall into bands of ratio
   q/p; a set signs for its own band and the one below, whose k is the same for all.
3. Only documents of blocks are read again. A block is searched by DivideSkip within a
   task; one above a bounded weight is cut into chunks, and pairs of chunks are tasks.
   A task returns each set's number of links and a spanning forest, never its pairs.
4. The components of the forests' edges are the result.

Everything is exact at any size: the sketch chooses between parts, and nothing else.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, quoted, table, without
from .components import components
from .hashing import WordHasher, mix

SKETCH_BITS, SKETCH_PARTS = 20, 64
#: Bits of the filter that says which documents are read again.
FILTER_BITS = 23
#: Bits of a signature that tell whether it may stand alone, parts in which they are compared, and bits of the filter of those that don't.
PRINT_BITS, PRINT_PARTS, MEETING_BITS = 40, 256, 26
#: Signatures that a task sorts at a time.
FLUSH = 500_000
#: Shingles and sets of a chunk of a block.
CHUNK_WEIGHT, CHUNK_SETS = 400_000, 4096
MU = 0.0085  # DivideSkip's constant for the number of long lists

class Shingler:
    """Distinct shingle hashes (uint64, sorted) of texts: of ``width`` words, or of the whole where there are fewer."""

    def __init__(self, width: int):
        self.width, self.hasher = width, WordHasher()

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """One set per text, in order; null and wordless texts have empty ones."""
        k = self.width
        for words, edges in self.hasher.chunks(texts):
            rolled = words
            if len(words) >= k:
                rolled = words[: len(words) - k + 1]
                for i in range(1, k):
                    rolled = mix(rolled * np.uint64(3) + words[i : len(words) - k + 1 + i])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a >= k:
                    yield np.unique(rolled[a : b - k + 1])
                elif b > a:
                    h = np.uint64(b - a) + np.zeros(1, dtype=np.uint64)
                    for w in words[a:b]:
                        h = mix(h * np.uint64(5) + w)
                    yield h
                else:
                    yield np.zeros(0, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


BASE = "row_id long, doc_id long, n long, key binary, short long, part int, counts binary"


def _sets(docs: DataFrame, width: int, row: str | None) -> DataFrame:
    """Rows of two kinds: row_id, doc_id, n, key for each document; part, counts of each task's sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch, waiting, held = Shingler(width), np.zeros(1 << SKETCH_BITS, dtype=np.int64), [], 0
        for b in batches:
            n, keys = [], []
            for s in shingler.sets(b.column("text")):
                n.append(len(s))
                keys.append(set_key(s))
                waiting.append(_bucket(s))
                held += len(s)
                if held > 1 << SKETCH_BITS:
                    sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
                    waiting, held = [], 0
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(np.array([short_key(k) for k in keys], dtype=np.uint64).view(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], names=["row_id", "doc_id", "n", "key", "short", "part", "counts"])
        if waiting:
            sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
        parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(np.split(sketch, SKETCH_PARTS)) if p.any()]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["row_id", "doc_id", "n", "key", "short", "part", "counts"])

    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, BASE)


def _sketch(base: DataFrame) -> np.ndarray:
    """The summed counters: 2**SKETCH_BITS numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
                sums[part] = sums[part] + x if part in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.int64)
    summed = base.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary")
    for r in summed.collect():
        out[r["part"]] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def _bands(p: int, q: int) -> list[int]:
    """The smallest size of each band; partners of a set are in its band or a neighbouring one."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * q // p + 1)
    return out


class Signer:
    """The signatures of sets, for linking at p/q."""

    def __init__(self, p: int, q: int, sketch: np.ndarray):
        self.p, self.q, self.least = p, q, _bands(p, q)
        self.light = sketch <= 4 * sketch.mean() + 16
        self.cuts: dict[int, np.ndarray] = {}

    def parts(self, band: int) -> tuple[int, int]:
        """k + 1, and e, for pairs of a set of this band and one of it or the next."""
        most = self.least[band + 1] - 1 + self.least[band + 2] - 1
        k = most * (self.q - self.p) // (self.q + self.p)
        return k + 1, (k + 1) // 8

    def sign(self, s: np.ndarray) -> np.ndarray:
        own = bisect.bisect_right(self.least, len(s)) - 1
        sums = np.zeros(len(s) + 1, dtype=np.uint64)
        np.cumsum(mix(s + np.uint64(7)), out=sums[1:])
        light = np.zeros(len(s) + 1, dtype=np.int64)
        np.cumsum(self.light[_bucket(s)], out=light[1:])
        out = []
        for band in range(max(0, own - 1), own + 1):
            wanted, spare = self.parts(band)
            m = wanted + spare
            if m not in self.cuts:
                self.cuts[m] = np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64)
            at = np.concatenate([[0], np.searchsorted(s, self.cuts[m]), [len(s)]])
            content, weight = np.diff(sums[at]), np.diff(light[at])
            best = np.lexsort((content, weight))[spare:]
            out.append(mix(content[best] ^ mix((band << 32) + best.astype(np.uint64))))
        return np.concatenate(out)


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little")


MET = "signature long, a long, b long"


def _edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs once each."""
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
    return pairs[:, 0], pairs[:, 1]


def _chain(signatures: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of signature and key: where each signature starts, and edges between neighbours of one signature."""
    same = signatures[1:] == signatures[:-1]
    edge = np.flatnonzero(same & (keys[1:] != keys[:-1]))
    return np.flatnonzero(np.append(True, ~same)) if len(keys) else edge, *_edges(keys[edge], keys[edge + 1])


def _packed(prints: np.ndarray) -> bytes:
    """Ascending numbers below 2**32: their gaps, byte by byte, so that the high ones, mostly 0, pack well."""
    return zlib.compress(np.diff(prints, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u4").ravel(), dtype=np.int64)


def _may_meet(signatures: np.ndarray, meeting: np.ndarray) -> np.ndarray:
    """Which signatures the filter doesn't tell to stand alone."""
    at = (signatures >> np.uint64(64 - MEETING_BITS)).astype(np.int64)
    return (meeting[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _meeting(docs: DataFrame, width: int, sent: Broadcast, p: int, q: int) -> np.ndarray:
    """A filter, 2**MEETING_BITS bits by the first bits of a signature: where one occurs twice or more.

    A part of the signatures is compared at a time. Of one that is met more often, a task
    hands on two at a time, so a very common one is no more than that.
    """
    part_bits, own = PRINT_PARTS.bit_length() - 1, MEETING_BITS - (PRINT_PARTS.bit_length() - 1)

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.sort(np.concatenate(found) >> np.uint64(64 - PRINT_BITS)).astype(np.int64)
        prints = prints[np.append([True, True], prints[2:] != prints[:-2])[: len(prints)]]
        ends = np.searchsorted(prints, np.arange(PRINT_PARTS + 1) << (PRINT_BITS - part_bits))
        rows = [(i, _packed(prints[a:b] - (i << (PRINT_BITS - part_bits)))) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "prints"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(width), Signer(p, q, sent.value)
        found, held = [], 0
        for batch in batches:
            for s in shingler.sets(batch.column("text")):
                if len(s):
                    found.append(signer.sign(s))
                    held += len(found[-1])
                if held > FLUSH:
                    yield told(found)
                    found, held = [], 0
        if found:
            yield told(found)

    def bits(part: int, held: list[bytes]) -> pa.RecordBatch:
        prints = np.sort(np.concatenate([_unpacked(x) for x in held]))
        out = np.zeros(1 << own, dtype=np.uint8)
        out[prints[1:][prints[1:] == prints[:-1]] >> (PRINT_BITS - part_bits - own)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(np.packbits(out, bitorder="little").tobytes(), 1)], pa.binary())], names=["part", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, prints in zip(batch.column("part").to_pylist(), batch.column("prints").to_pylist(), strict=True):
                if part != now:
                    if held:
                        yield bits(now, held)
                    now, held = part, []
                held.append(prints)
        if held:
            yield bits(now, held)

    signed = docs.select("text").mapInArrow(sign, "part int, prints binary")
    met = signed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "part int, bits binary")
    out = np.zeros((PRINT_PARTS, (1 << own) // 8), dtype=np.uint8)
    for r in materialize(met, "shingle-meeting").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), dtype=np.uint8)
    return out.ravel()


def _sharing(docs: DataFrame, width: int, sketch: np.ndarray, p: int, q: int) -> DataFrame:
    """a, b: edges that connect all sets with a signature in common.

    A task connects what meets in it and hands on one set for each signature, so a
    signature that very many sets share is a row for each task that met it.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(sketch)
    filtered = context.broadcast(_meeting(docs, width, sent, p, q))

    def flushed(found: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        own = np.repeat(np.array(keys, dtype=np.uint64).view(np.int64), [len(x) for x in found])
        signatures = np.concatenate(found).view(np.int64)
        order = np.lexsort((own, signatures))
        signatures, own = signatures[order], own[order]
        first, a, b = _chain(signatures, own)
        none = pa.nulls(len(first), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(signatures[first]), pa.array(a)]), pa.concat_arrays([pa.array(own[first]), pa.array(a)]), pa.concat_arrays([none, pa.array(b)])],
            names=["signature", "a", "b"],
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer, meeting = Shingler(width), Signer(p, q, sent.value), filtered.value
        found, keys, held = [], [], 0
        for batch in batches:
            for s in shingler.sets(batch.column("text")):
                if len(s):
                    signatures = signer.sign(s)
                    signatures = signatures[_may_meet(signatures, meeting)]
                    if not len(signatures):
                        continue
                    found.append(signatures)
                    keys.append(short_key(set_key(s)))
                    held += len(signatures)
                if held > FLUSH:
                    yield flushed(found, keys)
                    found, keys, held = [], [], 0
        if found:
            yield flushed(found, keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            signature, a = batch.column("signature").to_numpy(), batch.column("a").to_numpy()
            b = batch.column("b").to_numpy(zero_copy_only=False)
            given = ~np.isnan(b) if b.dtype == np.float64 else np.ones(len(b), dtype=bool)
            passed = batch.filter(pa.array(given))
            signature, a = signature[~given], a[~given]
            if last is not None:
                signature, a = np.append(last[0], signature), np.append(last[1], a)
            if len(a):
                last = signature[-1], a[-1]
            x, y = _chain(signature, a)[1:]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([passed.column("a"), pa.array(x)]), pa.concat_arrays([passed.column("b"), pa.array(y)])], names=["a", "b"])

    signed = docs.select("text").mapInArrow(sign, MET)
    return signed.repartition("signature").sortWithinPartitions("signature", "a").mapInArrow(meet, "a long, b long")


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges first .. first + size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def divide_skip(sets: list[np.ndarray], p: int, q: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j > i that link with i) for sets in ascending order of size.

    With side, only pairs of different sides count. Sets are distinct and not empty.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(m), sizes)[order]
    length = np.bincount(flat)
    first = np.cumsum(length) - length
    postings = flat[order] * m + owner  # by list, then document
    starts = np.cumsum(sizes) - sizes
    # Lists that hold an eighth of a large block are probed as rows of a bit matrix.
    dense = np.flatnonzero(length >= max(16, m // 8))
    row_of = np.full(len(length), -1)
    row_of[dense] = np.arange(len(dense))
    bits = np.zeros((len(dense), m), dtype=np.float32)
    bits[np.repeat(np.arange(len(dense)), length[dense]), owner[_ranges(first[dense], length[dense])]] = 1
    for i in range(m):
        n = int(sizes[i])
        end = int(np.searchsorted(sizes, n * q // p, "right"))
        if end <= i + 1:
            continue
        others = sizes[i + 1 : end]
        needed = -(-p * (n + others) // (p + q))
        lists = flat[starts[i] : starts[i] + n]
        lists = lists[length[lists] > 1]
        least = int(needed[0])
        if len(lists) < least:
            continue
        lists = lists[np.argsort(-length[lists], kind="stable")]
        n_long = min(least - 1, int(least / (MU * np.log2(length[lists[0]]) + 1)))
        long, short = lists[:n_long], lists[n_long:]
        merged = owner[_ranges(first[short], length[short])]
        merged = merged[(merged > i) & (merged < end)] - i - 1
        shared = np.bincount(merged, minlength=end - i - 1)
        wanted = shared >= np.maximum(1, needed - n_long)
        if side is not None:
            wanted &= side[i + 1 : end] != side[i]
        found = np.flatnonzero(wanted)
        if not len(found):
            continue
        total = shared[found]
        rows = row_of[long]
        if (rows >= 0).any():
            total = total + np.rint(bits[rows[rows >= 0], i + 1 : end].sum(0)[found]).astype(np.int64)
        probed = long[rows < 0]
        for at in range(0, len(probed), 256):
            wish = (probed[at : at + 256, None] * m + (found + i + 1)[None]).ravel()
            place = np.minimum(np.searchsorted(postings, wish), len(postings) - 1)
            total = total + (postings[place] == wish).reshape(-1, len(found)).sum(0)
        linked = found[total >= needed[found]] + i + 1
        if len(linked):
            yield i, linked


FOUND = "key binary, other binary, links long"


def _search(tasks: DataFrame, p: int, q: int) -> DataFrame:
    """tasks, sorted by block and chunks, then n and key -> links of each set, and forest edges key - other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                at = (r["block"], r["low"], r["high"])
                if at != now:
                    yield from done(held)
                    now, held = at, []
                if not held or held[-1]["key"] != r["key"]:
                    held.append(r)
        yield from done(held)

    def done(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        cross = rows[0]["low"] != rows[0]["high"]
        side = np.array([r["chunk"] for r in rows]) if cross else None
        copies = np.array([r["copies"] for r in rows])
        links, edges = np.zeros(len(rows), dtype=np.int64), []
        label = np.arange(len(rows))  # of each set, the component that this task's links have made so far

        for i, linked in divide_skip([np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows], p, q, side):
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            new = linked[label[linked] != label[i]]
            if len(new):
                # One edge to each component that is met: fewer edges than sets in all.
                met, first = np.unique(label[new], return_index=True)
                edges += [(i, int(j)) for j in new[first]]
                label[np.isin(label, met)] = label[i]
        linked = np.flatnonzero(links)
        keys = [rows[i]["key"] for i in linked] + [rows[i]["key"] for i, _ in edges]
        others = [None] * len(linked) + [rows[j]["key"] for _, j in edges]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(others, pa.binary()), pa.array([*links[linked].tolist(), *[0] * len(edges)], pa.int64())], names=["key", "other", "links"])

    return tasks.mapInArrow(run, FOUND)


def _id_bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _id_filter(members: DataFrame) -> np.ndarray:
    """One bit for each hash of an id of members: 2**FILTER_BITS bits, whatever their number."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=np.uint8)
        for b in batches:
            bits[_id_bits(_ids(b.column("doc_id")))] = 1
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    out = np.zeros((1 << FILTER_BITS) // 64, dtype=np.int64)
    marked = members.select("doc_id").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for r in marked.collect():
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def with_shingles(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """members (doc_id, key, ...) with their shingles.

    A filter of their ids keeps all other texts from being hashed or exchanged; what
    passes by chance, or has a member's id and another text, fails the join on the key.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(_id_filter(members), bitorder="little"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bits = Shingler(width), np.unpackbits(sent.value, bitorder="little")
        for b in batches:
            wanted = b.filter(pa.array(bits[_id_bits(_ids(b.column("doc_id")))] == 1))
            for part in (wanted.slice(i, 256) for i in range(0, wanted.num_rows, 256)):
                sets = list(shingler.sets(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "key binary, shingles binary")
    return members.drop("doc_id").join(made, "key")


def ngram_join(docs: DataFrame, width: int = 3, p: int = 9, q: int = 10, row: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> row_id, doc_id, n_shingles, component_id, n_links, kept: one row per row of docs.

    A set holds a text's distinct runs of ``width`` words, A-Z in lower case; with fewer
    words, the whole sequence. Documents link when their sets' Jaccard similarity is p/q
    or more; component_id is the smallest doc_id that links reach, n_links the number of
    other rows a row links with. Null and wordless texts have an empty set, no links and
    themselves as component. Rows with a null id take part and never name a component
    unless all its rows have null ids. Repeated rows are copies like any other. kept marks
    one row of each component: the smallest doc_id (null last), then the smallest
    row_id, which is docs' column ``row`` or the order of reading. An empty table gives an
    empty result; other columns are ignored.
    """
    base = materialize(_sets(docs, width, row), "shingle-sets")
    rows = base.where("key is not null").select("row_id", "doc_id", "n", "key", "short")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    sets = rows.groupBy("key").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("short").alias("short"), F.count("*").alias("copies"))
    # Eight bytes of the key are enough where sets only meet; what links is told by all of it.
    blocks = components(_sharing(docs, width, _sketch(base), p, q))
    members = blocks.select(F.col("node").alias("short"), F.col("root").alias("block")).join(sets.withColumn("doc_id", F.col("first.doc_id")).drop("first"), "short").drop("short")
    weights = members.groupBy("block").agg(F.ceil(F.greatest(F.sum("n") / CHUNK_WEIGHT, F.count("*") / CHUNK_SETS)).cast("int").alias("chunks"))
    members = materialize(members.join(weights, "block"), "shingle-blocks")
    filled = with_shingles(docs, members, width).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    met_with = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with")
    tasks = filled.select("*", met_with).select("block", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "n", "key", "copies", "chunk", "shingles")
    place = ["block", "low", "high"]
    found = materialize(_search(tasks.repartition(*place).sortWithinPartitions(*place, "n", "key"), p, q), "shingle-links")
    roots = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = sets.join(roots, sets["key"] == roots["node"]).groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(classes, "root").select(F.col("node").alias("key"), "least").join(links, "key", "left")
    per_set = sets.join(linked, "key", "left").select("key", "copies", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("least"), F.coalesce("links", F.lit(0)).alias("links"))
    alone = F.col("n") == 0
    return rows.drop("short").join(per_set, "key").select(
        "row_id",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).alias("n_links"),
        (alone | (F.col("row_id") == F.col("least.row_id"))).alias("kept"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("row_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS row_id, string_split(trim(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
s AS (
  SELECT doc_id, row_id, CASE WHEN w = [''] THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS sh FROM d),
u AS MATERIALIZED (SELECT sh, min(row_id) AS set_id, min(doc_id) AS doc_id, count(*) AS copies, len(sh) AS n
  FROM (SELECT doc_id, row_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
x AS MATERIALIZED (SELECT set_id, n, unnest(sh) AS g FROM u),
df AS (SELECT g, count(*) AS f FROM x GROUP BY g),
ord AS (SELECT x.*, row_number() OVER (PARTITION BY set_id ORDER BY f, g) AS pos FROM x JOIN df USING (g)),
head AS MATERIALIZED (SELECT * FROM ord WHERE pos <= n - CAST(ceil(n * 9 / 10.0) AS BIGINT) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.set_id AS a, b.set_id AS b FROM head a JOIN head b ON a.g = b.g AND a.set_id < b.set_id
  AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n),
inter AS (SELECT a, b, count(*) AS o FROM cand JOIN x p ON p.set_id = a JOIN x q ON q.set_id = b AND q.g = p.g GROUP BY a, b),
links AS MATERIALIZED (SELECT a, b FROM inter JOIN u p ON p.set_id = a JOIN u q ON q.set_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(set_id, other) AS (SELECT set_id, set_id FROM u UNION SELECT r.set_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT r.set_id, min(u.doc_id) AS component_id FROM reach r JOIN u ON u.set_id = r.other GROUP BY 1),
n_linked AS (SELECT e.a AS set_id, sum(u.copies) AS links FROM both_ways e JOIN u ON u.set_id = e.b GROUP BY 1)
SELECT s.doc_id, len(s.sh) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE least.component_id END AS component_id,
  CAST(CASE WHEN len(s.sh) = 0 THEN 0 ELSE coalesce(links, 0) + u.copies - 1 END AS BIGINT) AS n_links
FROM s JOIN u ON u.sh = list_sort(s.sh) JOIN least USING (set_id) LEFT JOIN n_linked USING (set_id)
"""


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, with the columns it came with.

    Near duplicates share words in runs of five to a similarity of 0.8 or more. The row
    with the smallest id stays (null last), of several the first read; rows are told apart
    by their place, so ids may be null or repeat. Rows without words all stay.
    """
    rows, row = numbered(docs, "near-rows")
    dropped = ngram_join(rows, width=5, p=4, q=5, row=row).where("not kept").select(F.col("row_id").alias(row))
    return without(rows, dropped, row).select(*quoted(docs.columns))
