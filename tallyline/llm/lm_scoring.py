"""Language-model scoring with a trigram trie in Elias-Fano code, built and read in shards.

A text's tokens are its words and one end; an event is a token w after the words u, v (or
the start) before it. All events go to shards by their context's hash, sorted and packed
by the thousands. A shard holds every event of its contexts: it counts those of training
documents, builds its part of the trie (absolute discounting, quantised), maps it into
memory and looks up its events, held-out and training ones alike. What reaches no
successor is left to the unigram level: those events, and the shards' word counts, meet
in a second, smaller exchange by the word. A last one sums by document.

    u v w seen   log10 (count(u v w) - D) / count(u v)
    else         what u v leaves over, log10 D successors(u v) / count(u v), and
    v w seen     log10 (count(v w) - D) / count(v)
    else         what v leaves over, and log10 (c + 1) / (N + V + 1)

Words that stand for one token in 512 or more (a bounded list) are heavy. A context that
ends in one is u v from the first, and backs off to the unigram level, so what follows a
heavy word is spread over as many shards as it has predecessors. Pairs u v that are one
in 512 themselves (a bounded list) are spread over all shards by the successor, their
totals counted beforehand and their numbers of successors summed afterwards. So neither
a word nor a phrase that is a third of the corpus is one shard's hot spot, and no
vocabulary is ever broadcast or collected.

Words are told by 64-bit hashes where n_known and base_score are counted; as successors
by 48 bits, and the words before a context by 32 bits beside the context, which a model
of probabilities can bear.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_crc, materialize, table
from .hashing import WordHasher, mix
from .ngram_trie import Trie

START, END, NONE = np.uint64(0x5A5A5A5A5A5A0000), np.uint64(0xA5A5A5A5A5A50000), np.uint64(0x3C3C3C3C3C3C0000)
DISCOUNT = 0.9
#: Events that are packed together, and of a shard, which is what a task holds in memory.
FLUSH, SHARD_EVENTS = 800_000, 1_000_000
#: Shards beyond so many share partitions; a partition's shards are worked on one after the other.
MOST_PARTITIONS = 20_000
HEAVY_SHARE = 512
#: Shards whose unseen events and word counts meet in one shard of words.
WORD_SHARDS = 8
#: Documents of a block in which sums travel.
BLOCK_BITS = 13
NAMES = np.uint64(16)  # successors are told apart by the upper 48 bits of their hashes, contexts of two words too

PACKED = "kind int, key long, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, i binary"
_PACKED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), *[(x, pa.binary()) for x in "abcdefghi"]])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *[None] * (len(_PACKED) - len(r))) for r in rows]
    columns = zip(*full, strict=True) if full else [()] * len(_PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PACKED.types, strict=True)], schema=_PACKED)


def _events(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(u, v, w, row_id, trained on) of a task's events, some flush of them at a time, and (row_id, doc_id, is null) of their documents.

    A long text's events come in several parts, the first of which names the document.
    """
    hasher, held, n = WordHasher(), [], 0
    for b in batches:
        rows, train, i = b.column("row_id").to_numpy(), b.column("train").to_numpy(zero_copy_only=False).astype(bool), 0
        ids, null = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        for words, edges in hasher.chunks(b.column("text")):
            d = len(edges) - 1
            sizes = np.diff(edges) + 1
            v = np.insert(words, edges[:-1], START)
            u = np.append(NONE, v[:-1])
            u[np.cumsum(sizes) - sizes] = NONE
            held.append((u, v, np.insert(words, edges[1:], END), np.repeat(rows[i : i + d], sizes), np.repeat(train[i : i + d], sizes), rows[i : i + d], ids[i : i + d], null[i : i + d]))
            n, i = n + int(sizes.sum()), i + d
            if n >= flush:
                yield from _parts(held)
                held, n = [], 0
    if held:
        yield from _parts(held)


def _parts(held: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
    for i in range(0, len(whole[0]), MOST_EVENTS):
        yield (*(x[i : i + MOST_EVENTS] for x in whole[:5]), *(x if i == 0 else x[:0] for x in whole[5:]))


#: Events of one code; their places have 21 bits.
MOST_EVENTS = 1 << 20


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The name of a context of two words."""
    return mix(u * np.uint64(3) ^ mix(v + np.uint64(7)))


def _prepared(docs: DataFrame, train: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def _heavy(rows: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], int, int]:
    """Heavy words and heavy pairs (sorted, the start among both), their training counts, all events and all training events."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, _, _, train, *_ in _events(batches, FLUSH):
            names, counts = [], []
            for x in (v, _pair(u, v)):
                unique, c = np.unique(x, return_counts=True)
                often = c * 4 * HEAVY_SHARE >= len(v)
                names.append(unique[often].view(np.int64))
                counts.append(c[often])
            sort = [0] * len(names[0]) + [1] * len(names[1]) + [2]
            yield pa.RecordBatch.from_arrays([pa.array(sort, pa.int32()), pa.array([*np.concatenate(names).tolist(), 0]), pa.array([*np.concatenate(counts).tolist(), len(v)]), pa.array([*[0] * (len(sort) - 1), int(train.sum())])], names=["sort", "name", "n", "trained"])

    found = materialize(rows.mapInArrow(common, "sort int, name long, n long, trained long").groupBy("sort", "name").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")), "lm-heavy")
    totals = found.where("sort = 2").first()
    events, trained = (totals["n"], totals["trained"]) if totals else (0, 0)
    # At most HEAVY_SHARE words, and pairs, have that share. These counts miss the parts where a word has less than a
    # quarter of it, so a quarter at most: whatever has half the share here, a bounded list, is counted again, whole.
    likely = found.where((F.col("sort") < 2) & (F.col("n") * 2 * HEAVY_SHARE >= events)).select("sort", "name").collect()
    lists = [np.unique(np.append(np.array([r["name"] for r in likely if r["sort"] == sort], dtype=np.int64).view(np.uint64), start)) for sort, start in ((0, START), (1, _pair(np.array([NONE]), np.array([START]))))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(x)), dtype=np.int64) for x in lists]
        for u, v, _, _, train, *_ in _events(batches, FLUSH):
            for names, sum_, x in zip(lists, sums, (v, _pair(u, v)), strict=True):
                at = _place(names, x)
                sum_ += [np.bincount(at[chosen], minlength=len(names)) for chosen in (at >= 0, (at >= 0) & train)]
        both = np.concatenate(sums, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.shape[1])), pa.array(both[0]), pa.array(both[1])], names=["at", "n", "trained"])

    counts = np.zeros((2, sum(map(len, lists))), dtype=np.int64)
    for r in rows.mapInArrow(count, "at long, n long, trained long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")).collect():
        counts[:, r["at"]] = r["n"], r["trained"]
    out, trains = [], []
    for names, (n, train) in zip(lists, np.split(counts, [len(lists[0])], axis=1), strict=True):
        heavy = (n * HEAVY_SHARE >= events) | (names == START) | (names == _pair(np.array([NONE]), np.array([START]))[0])
        out.append(names[heavy])
        trains.append(train[heavy])
    return out, trains, events, trained


def _place(table_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in a sorted array, or -1."""
    if not len(table_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table_, x), len(table_) - 1)
    return np.where(table_[at] == x, at, -1)


def _small(x: np.ndarray) -> bytes:
    """Counts in the narrowest of four types, told by the first byte."""
    kind = next(i for i, t in enumerate((np.uint8, np.uint16, np.uint32, np.uint64)) if not len(x) or x.max() <= np.iinfo(t).max)
    return bytes([kind]) + x.astype((np.uint8, np.uint16, np.uint32, np.uint64)[kind]).tobytes()


def _unsmall(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=(np.uint8, np.uint16, np.uint32, np.uint64)[raw[0]], offset=1).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Sorted int64 with bytes of like weight side by side, which the codecs of files and exchanges shrink."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _pack_names(w: np.ndarray) -> bytes:
    return np.ascontiguousarray((w >> NAMES).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack_names(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _to_shards(words: np.ndarray, pairs: np.ndarray, shards: int) -> Callable:
    """Packs events (kind 0), and documents' ids by block (kind 6).

    Events, of contexts of one word first: key shard; a contexts of one word, i those of
    two; g the heavy words that the latter end in; b the contexts' numbers of pairs, c
    successors, d their numbers of events, e documents and training marks, h the words
    before contexts of one word, f the first row id.
    """
    mask = np.uint64((1 << 21) - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, w, doc, train, *named in _events(batches, FLUSH):
            first_doc = doc[0]
            names, name = np.unique(w, return_inverse=True)
            word = _place(words, v)
            two = word >= 0
            context = np.where(two, _pair(u, v), v)
            spread = two & (_place(pairs, context) >= 0)
            part = np.where(spread, mix(w) % np.uint64(shards), np.uint64(0))
            own_names, at, own = np.unique(np.where(spread, mix(context ^ mix(part + np.uint64(1))), context), return_index=True, return_inverse=True)
            shard = np.where(spread[at], part[at], mix(context[at]) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((own_names, two[at], shard))
            rank = np.empty(len(order), dtype=np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            code = (rank[own] << np.uint64(42)) | (name.astype(np.uint64) << np.uint64(21)) | (doc - first_doc).astype(np.uint64)
            sorted_ = np.argsort(code)
            code = code[sorted_]
            before = (mix(u) >> np.uint64(32)).astype(np.uint32)[sorted_]
            trained = np.zeros(int(doc[-1] - first_doc) + 1, dtype=np.int64)
            trained[doc - first_doc] = train
            local = (code & mask).astype(np.int64)
            marks = local << 1 | trained[local]
            pair = np.flatnonzero(np.append(True, code[1:] >> np.uint64(21) != code[:-1] >> np.uint64(21)))
            per_pair = np.diff(np.append(pair, len(code)))
            per_context = np.bincount((code[pair] >> np.uint64(42)).astype(np.int64), minlength=len(order))
            token = names[((code[pair] >> np.uint64(21)) & mask).astype(np.int64)]
            home, keys, ends, is_two = shard[order], context[at][order], word[at][order], two[at][order]
            pair_at = np.append(0, np.cumsum(per_context))
            event_at = np.append(pair, len(code))
            out = _by_block(named[0], 6, named[1].astype(np.int64).view(np.uint64), named[2].astype(np.uint8))
            for i, j in _runs(home):
                k = i + int((~is_two[i:j]).sum())
                p, q = pair_at[i], pair_at[j]
                out.append(
                    (0, int(home[i]), keys[i:k].tobytes(), _small(per_context[i:j]), _pack_names(token[p:q]), _small(per_pair[p:q]), _small(marks[event_at[p] : event_at[q]]), np.int64(first_doc).tobytes(),
                     _small(ends[k:j]), before[event_at[p] : event_at[pair_at[k]]].tobytes(), _pack_names(keys[k:j]))
                )
            yield _batch(out)

    return pack


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows that follow one another with the same key."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["key"] != now and held:
                yield now, held
                held = []
            now = r["key"]
            held.append(r)
    if held:
        yield now, held


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    if not len(keys):
        return []
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True))


def _by_block(docs: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple]:
    """Rows (kind, block, places, columns) of values by sorted document; int64 columns are packed."""
    block = docs >> BLOCK_BITS
    return [(kind, int(block[i]), (docs[i:j] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes(), *[_small(c[i:j]) if c.dtype == np.int64 else c[i:j].tobytes() for c in columns]) for i, j in _runs(block)]


def _by_word(words: np.ndarray, kind: int, shards: int, values: np.ndarray) -> list[tuple]:
    """Rows (kind, shard of the word, words of 48 bits, values), sorted by value."""
    shard = (mix(words) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((values, shard))
    shard = shard[order]
    return [(kind, int(shard[i]), _pack_names(words[order[i:j]] << NAMES), _planes(values[order[i:j]])) for i, j in _runs(shard)]


def _score_shards(words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, shards: int, discount: float) -> Callable:
    """Of each shard: 0 sums by document, 1 events left to the unigram level, 2 word counts, 3 heavy pairs' numbers of successors, 4 unseen events of heavy pairs, 5 the number of words; 6 documents' ids, handed on."""
    as_successors = words.copy()
    as_successors[words == START] = END  # as a successor it is the end that stands for every text once
    by_name = np.argsort(as_successors >> NAMES)
    names, name_counts = (as_successors >> NAMES)[by_name], word_counts[by_name]
    # Contexts of two words travel as 48 bits.
    by_pair = np.argsort(pairs >> NAMES)
    pair_names = (pairs >> NAMES)[by_pair] << NAMES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            names_of_docs = [tuple(r.values()) for r in rows if r["kind"] == 6]
            events = [r for r in rows if r["kind"] == 0]
            rows.clear()
            yield _batch(names_of_docs + (one(events) if events else []))

    def one(rows: list[dict]) -> list[tuple]:
        vs, ends, ws, per_pair, docs, trains, befores = [], [], [], [], [], [], []
        for r in rows:
            one_word, two, n_pairs = np.frombuffer(r["a"], dtype=np.uint64), _unpack_names(r["i"]) << NAMES, _unsmall(r["b"])
            vs.append(np.repeat(np.concatenate([one_word, two]), n_pairs))
            ends.append(np.repeat(np.append(np.full(len(one_word), -1), _unsmall(r["g"])), n_pairs))
            ws.append(_unpack_names(r["c"]))
            sizes, marks = _unsmall(r["d"]), _unsmall(r["e"])
            per_pair.append(sizes)
            docs.append((marks >> 1) + np.frombuffer(r["f"], dtype=np.int64)[0])
            trains.append((marks & 1).astype(bool))
            before = np.frombuffer(r["h"], dtype=np.uint32)
            befores.append(np.append(before, np.zeros(len(marks) - len(before), dtype=np.uint32)))
        v, end, w, sizes, doc, train, before = (np.concatenate(x) for x in (vs, ends, ws, per_pair, docs, trains, befores))
        rows.clear()
        for x in (vs, ends, ws, per_pair, docs, trains, befores):
            x.clear()
        order = np.lexsort((w, v))
        v, end, w = v[order], end[order], w[order]
        fresh = np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))
        of_pair = np.empty(len(order), dtype=np.int64)
        of_pair[order] = np.cumsum(fresh) - 1
        event = np.repeat(of_pair, sizes)
        v, end, w = v[fresh], end[fresh], w[fresh]
        del order, fresh, of_pair
        count = np.bincount(event, train, minlength=len(v)).astype(np.int64)
        first = np.append(True, v[1:] != v[:-1])
        context = np.cumsum(first) - 1
        total, kinds = np.bincount(context, count).astype(np.int64), np.bincount(context, count > 0).astype(np.int64)
        end = end[first]
        spread = np.where(end >= 0, _place(pair_names, v[first]), -1)
        spread = np.where(spread >= 0, by_pair[spread], -1)
        total = np.where(spread >= 0, pair_counts[spread], total)
        has = np.flatnonzero(count > 0)
        place_of = np.full(len(v), -1)
        place_of[has] = np.arange(len(has))

        # Triples of contexts of one word, with the word before.
        single = np.flatnonzero(end[context[event]] < 0)
        triple, of_triple = np.unique((event[single].astype(np.uint64) << np.uint64(32)) | before[single], return_inverse=True)
        t_pair, t_before = (triple >> np.uint64(32)).astype(np.int64), triple & np.uint64(0xFFFFFFFF)
        t_count = np.bincount(of_triple, train[single], minlength=len(triple)).astype(np.int64)
        t_has = t_count > 0
        trie = Trie(v[has], w[has], count[has], total[context[has]], kinds[context[has]], discount, (place_of[t_pair[t_has]], t_before[t_has], t_count[t_has]))
        value, place, left = trie.lookup(v, w)
        t_value, t_seen, t_left = trie.lookup_longer(t_before.astype(np.int64), v[t_pair], place[t_pair])
        del triple, trie, t_has, t_count, before

        seen = place >= 0
        far = spread[context]
        value = np.where(seen, value, np.where(far >= 0, 0.0, left))
        known_name = np.where(seen, -1, _place(names, w))
        value = value + np.where(known_name >= 0, np.log10(name_counts[known_name] + 1.0), 0.0)
        by_event, longer = value[event], np.zeros(len(event), dtype=bool)
        by_event[single] = np.where(t_seen[of_triple], t_value[of_triple], by_event[single] + t_left[of_triple])
        longer[single] = t_seen[of_triple]
        unseen = ~longer & ~seen[event]
        ids, at = np.unique(doc, return_inverse=True)
        word_total = np.where(end >= 0, word_counts[end], total)
        base, known = np.log10(word_total + 1.0)[context], (word_total > 0)[context]
        sums = [np.bincount(at, x, minlength=len(ids)).astype(t) for x, t in ((base[event], np.float64), (by_event, np.float32))]
        whole = [np.bincount(at, x, minlength=len(ids)).astype(np.int64) for x in (None, known[event], unseen)]
        out = _by_block(ids, 0, *sums, *whole)
        lost = np.flatnonzero(unseen & (known_name < 0)[event])
        out += _by_word(w[event[lost]], 1, shards, doc[lost])
        counted = np.flatnonzero((total > 0) & (end < 0))
        out += _by_word(v[first][counted] >> NAMES, 2, shards, total[counted])
        out.append((3, 0, spread[spread >= 0].tobytes(), kinds[spread >= 0].tobytes()))
        late = np.flatnonzero(unseen & (far >= 0)[event])
        late = late[np.argsort(doc[late], kind="stable")]
        out += _by_block(doc[late], 4, far[event[late]].astype(np.uint16))
        out.append((5, len(counted)))
        return out

    return score


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word shard: log10 (c + 1) of the events left to it, summed by document."""
    for _, rows in _grouped(batches):
        table_ = [r for r in rows if r["kind"] == 2]
        words = np.concatenate([_unpack_names(r["a"]) for r in table_] or [np.zeros(0, dtype=np.uint64)])
        counts = np.concatenate([_unplanes(r["b"]) for r in table_] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        asked = [r for r in rows if r["kind"] == 1]
        if asked:
            w, doc = (np.concatenate([unpack(r[c]) for r in asked]) for c, unpack in (("a", _unpack_names), ("b", _unplanes)))
            at = _place(words, w)
            value = np.where(at >= 0, np.log10(counts[at] + 1.0), 0.0) if len(words) else np.zeros(len(w))
            ids, own = np.unique(doc, return_inverse=True)
            none = np.zeros(len(ids))
            yield _batch(_by_block(ids, 0, none, np.bincount(own, value).astype(np.float32), *[none.astype(np.int64)] * 3))


def _sum_blocks(left: np.ndarray, log_size: float) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << BLOCK_BITS
        for block, rows in itertools.groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["key"]):
            sums, ids, null = np.zeros((5, n)), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            for r in rows:
                at = np.frombuffer(r["a"], dtype=np.uint16)
                if r["kind"] == 6:
                    ids[at], null[at] = np.frombuffer(r["b"], dtype=np.int64), np.frombuffer(r["c"], dtype=np.uint8)
                elif r["kind"] == 4:
                    sums[1] += np.bincount(at, left[np.frombuffer(r["b"], dtype=np.uint16)], minlength=n)
                else:
                    values = [np.frombuffer(r["b"], dtype=np.float64), np.frombuffer(r["c"], dtype=np.float32), *[_unsmall(r[c]) for c in "def"]]
                    for i, x in enumerate(values):
                        sums[i, at] += x  # a row names each document once
            base, score, tokens, known, unseen = sums
            at = np.flatnonzero(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array((block << BLOCK_BITS) + at), pa.array(ids[at], mask=null[at]), pa.array(tokens[at].astype(np.int64)), pa.array(known[at].astype(np.int64)), pa.array(base[at] - tokens[at] * log_size), pa.array(score[at] - unseen[at] * log_size)],
                names=["row_id", "doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return add


def lm_scores(docs: DataFrame, train: Column, discount: float = DISCOUNT, shard_events: int = SHARD_EVENTS) -> DataFrame:
    """docs (doc_id, text) -> row_id, doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    train says which rows the model learns from (null: no). Tokens are words, A-Z in
    lower case, and an end; a null, empty or wordless text is its end alone. base_score
    is the add-one unigram model's log10 probability, score the trigram model's, whose
    probabilities sum to 1 at most in every context. Without training rows all
    probabilities of the unigram level are 1 over 1. Repeated rows count and score one by
    one. An empty table gives an empty result; other columns are ignored. shard_events is
    what a task works on at a time: executors with more memory can take more, which makes
    fewer, larger rows of the exchange.
    """
    rows = _prepared(docs, train)
    (words, pairs), (word_counts, pair_counts), events, trained = _heavy(rows)
    shards = max(1, -(-events // shard_events))
    word_shards = -(-shards // WORD_SHARDS)
    partitions = min(shards, MOST_PARTITIONS)
    packed = rows.mapInArrow(_to_shards(words, pairs, shards), PACKED)
    # Documents' ids are spread over all partitions by their block.
    home = F.pmod("key", F.lit(partitions)).cast("int")
    scored = packed.repartitionById(partitions, home).sortWithinPartitions("key").mapInArrow(_score_shards(words, word_counts, pairs, pair_counts, word_shards, discount), PACKED)
    scored = materialize(scored, "lm-shards")

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, n_words = np.zeros(len(pairs), dtype=np.int64), 0
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 5:
                    n_words += r["key"]
                else:
                    kinds += np.bincount(np.frombuffer(r["a"], dtype=np.int64), np.frombuffer(r["b"], dtype=np.int64), minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(pairs))), pa.array(np.append(n_words, kinds))], names=["at", "n"])

    summed = scored.where("kind in (3, 5)").mapInArrow(statistics, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    sums = {r["at"]: r["n"] for r in summed}
    kinds = np.array([sums.get(i, 0) for i in range(len(pairs))], dtype=np.int64)
    # The start counts for the end, which every text has once.
    n_words = sums.get(-1, 0) + int((word_counts > 0).sum())
    left = np.where(pair_counts > 0, np.log10(np.maximum(np.minimum(1.0, discount * kinds / np.maximum(pair_counts, 1)), 1e-300)), 0.0)
    unigrams = scored.where("kind in (1, 2)").repartitionById(min(word_shards, partitions), F.pmod("key", F.lit(min(word_shards, partitions))).cast("int")).sortWithinPartitions("key").mapInArrow(_unigrams, PACKED)
    parts = scored.where("kind in (0, 4, 6)").unionByName(unigrams)
    by_doc = parts.repartition("key").sortWithinPartitions("key").mapInArrow(_sum_blocks(left, float(np.log10(trained + n_words + 1))), "row_id long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    return by_doc.withColumn("train_tokens", F.lit(trained).cast("long"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_crc(F.col("doc_id")) % 7 == 2
    scores = lm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
