"""A three-level n-gram trie in Elias-Fano code, memory-mapped, with quantised probabilities.

Level 1 holds the contexts as a monotone sequence of names. Level 2 holds for each its
successors, as ranks in the list of all successors, and level 3 for each successor the
words before the context that it was seen after, as ranks among the context's own. Each
level's pointers say where the children of a node begin on the next; in a range of
children the last value of the range before is added to every rank, so a whole level is
one monotone sequence, and a lookup is a search for a rank, seen from the context, in
the range that the pointers give. Sequences and pointers are Elias-Fano coded; log
probabilities are 16-bit codes.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Lookups that are worked on together.
AT_ONCE = 1 << 15
#: Steps of a log10 probability's code; 65535 of them reach to -32.
STEP = 1 / 2048
_SELECT = np.zeros((256, 8), dtype=np.uint8)  # the place of the k-th zero bit of a byte
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if not _b >> p & 1):
        _SELECT[_b, _k] = _p


class Levels:
    """Arrays in one unlinked temporary file, mapped into memory; it goes when they do."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def put(self, x: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(x)
        if not x.nbytes:
            return x
        at = self.file.seek(0, 2)
        at += -at % 8
        self.file.seek(at)
        self.file.write(x.tobytes())
        self.file.flush()
        return np.memmap(self.file, dtype=x.dtype, mode="r", offset=at, shape=x.shape)


class EliasFano:
    """A non-decreasing sequence of integers below 2**64."""

    def __init__(self, values: np.ndarray, levels: Levels):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1) if self.n else 0
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        size = (int(high[-1]) + self.n + 1 if self.n else 1) + 63 & ~63
        bits = np.zeros(size, dtype=np.uint8)
        bits[high + np.arange(self.n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.high = levels.put(words)
        self.zeros = levels.put(np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))]))
        self.ones = levels.put(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
        self.low = levels.put(self._pack(values & np.uint64((1 << self.low_bits) - 1)))

    def _pack(self, low: np.ndarray) -> np.ndarray:
        width = self.low_bits
        out = np.zeros(self.n * width // 64 + 2, dtype=np.uint64)
        if width:
            at = np.arange(self.n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(out, word, low << shift)
            over = shift.astype(np.int64) + width > 64
            np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        width = self.low_bits
        if not width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        more = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | more) & np.uint64((1 << width) - 1)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part: ones before the high-th zero."""
        out = np.zeros(len(high), dtype=np.int64)
        past = high >= self.zeros[-1]
        out[past] = self.n
        at = np.flatnonzero((high > 0) & ~past)
        k = high[at] - 1  # the zero that ends the group before, counted from 0
        word = np.searchsorted(self.zeros, k, "right") - 1
        k = k - self.zeros[word]
        octets = self.high[word].view(np.uint8).reshape(-1, 8) if len(at) else np.zeros((0, 8), dtype=np.uint8)
        gone = np.cumsum(8 - np.bitwise_count(octets).astype(np.int64), axis=1)
        octet = (gone <= k[:, None]).sum(1)
        rows = np.arange(len(at))
        k = k - np.where(octet > 0, gone[rows, np.maximum(octet - 1, 0)], 0)
        place = word * 64 + octet * 8 + _SELECT[octets[rows, np.minimum(octet, 7)], k]
        out[at] = place - (high[at] - 1)
        return np.minimum(out, self.n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1."""
        out = np.full(len(x), -1)
        for i in range(0, len(x) if self.n else 0, AT_ONCE):
            out[i : i + AT_ONCE] = self._find(x[i : i + AT_ONCE])
        return out

    def _find(self, x: np.ndarray) -> np.ndarray:
        """A binary search of the low parts among those of equal high part."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        a, end = self._before(high), self._before(high + 1)
        b = end.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            less = self._lows(np.minimum(mid, self.n - 1)) < low
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        hit = a < end
        hit[hit] = self._lows(a[hit]) == low[hit]
        return np.where(hit, a, -1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        out = np.zeros(len(i), dtype=np.uint64)
        for k in range(0, len(i), AT_ONCE):
            out[k : k + AT_ONCE] = self._get(i[k : k + AT_ONCE])
        return out

    def _get(self, i: np.ndarray) -> np.ndarray:
        """The i-th one's place, less i, is the high part."""
        word = np.searchsorted(self.ones, i, "right") - 1
        k = i - self.ones[word]
        octets = self.high[word].view(np.uint8).reshape(-1, 8)
        gone = np.cumsum(np.bitwise_count(octets).astype(np.int64), axis=1)
        octet = (gone <= k[:, None]).sum(1)
        rows = np.arange(len(i))
        k = k - np.where(octet > 0, gone[rows, np.maximum(octet - 1, 0)], 0)
        place = word * 64 + octet * 8 + _SELECT[~octets[rows, octet] & 255, k]
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)


class Ranges:
    """Children of nodes 0 .. n - 1: ascending ranks in ranges that pointers tell."""

    def __init__(self, parent: np.ndarray, rank: np.ndarray, n: int, levels: Levels):
        """parent and rank of each child, in order."""
        firsts = np.searchsorted(parent, np.arange(n + 1))
        self.pointers = EliasFano(firsts, levels)
        ends = firsts[1:]
        # What the ranges before have used up: each range needs as much room as its last rank, and one.
        room = np.where(np.diff(firsts) > 0, rank[np.maximum(ends - 1, 0)] + 1, 0) if len(rank) else np.zeros(n, dtype=np.int64)
        self.values = EliasFano(rank + (np.cumsum(room) - room)[parent] + 1 if len(rank) else rank, levels)

    def find(self, parent: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place of each (parent, rank) among all children, or -1."""
        first, end = (self.pointers.get(parent + i).astype(np.int64) for i in (0, 1))
        used = np.zeros(len(parent), dtype=np.uint64)
        later = (first > 0) & (end > first)
        used[later] = self.values.get(first[later] - 1)
        at = self.values.find(used + rank.astype(np.uint64) + np.uint64(1))
        return np.where((at >= first) & (at < end), at, -1)


class Trie:
    """Counts of (context, successor) pairs and of (before, context, successor) triples -> probabilities by lookup.

    A successor's probability is (count - discount) / total. What a context's successors
    leave over, discount * successors / total, is for the words it was never seen with.

    context, successor: sorted pairs, with count and, equal within a context, its total
    and its kinds, the number of different successors. triples: (pair, before, count),
    sorted, pair being a place among the pairs; a context is then (before, context).
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray, discount: float, triples: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        levels = self.levels = Levels()
        firsts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, dtype=np.int64)
        self.contexts = EliasFano(context[firsts], levels)
        names = np.unique(successor)
        self.names = EliasFano(names, levels)
        node = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(context))))
        self.successors = Ranges(node, np.searchsorted(names, successor), len(firsts), levels)
        self.codes = levels.put(_code(np.log10((count - discount) / total)))
        self.left = levels.put(_code(np.log10(np.minimum(1.0, discount * kinds[firsts] / total[firsts]))))
        if triples is None:
            none = np.zeros(0, dtype=np.int64)
            triples = (none, none.astype(np.uint64), none)
        pair, before, many = triples
        own = (node[pair].astype(np.uint64) << np.uint64(32)) | before if len(pair) else before
        longer, of = np.unique(own, return_inverse=True)
        parent = (longer >> np.uint64(32)).astype(np.int64)
        starts = np.searchsorted(parent, np.arange(len(firsts)))
        self.befores = Ranges(parent, (longer & np.uint64(0xFFFFFFFF)).astype(np.int64), len(firsts), levels)
        self.starts = EliasFano(starts, levels)
        sums, sorts = np.bincount(of, many, minlength=len(longer)), np.bincount(of, minlength=len(longer))
        self.longer_left = levels.put(_code(np.log10(np.minimum(1.0, discount * sorts / np.maximum(sums, 1)))))
        rank = of - starts[node[pair]] if len(pair) else of
        self.triples = Ranges(pair, rank, len(context), levels)
        self.longer_codes = levels.put(_code(np.log10((many - discount) / sums[of])))

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair: the log10 probability where it was seen, else 0; its place, or -1; log10 of what its context leaves over (0 for unknown contexts)."""
        at, name = self.contexts.find(context), self.names.find(successor)
        place = np.full(len(at), -1)
        both = np.flatnonzero((at >= 0) & (name >= 0))
        place[both] = self.successors.find(at[both], name[both])
        value, left = np.zeros(len(at)), np.zeros(len(at))
        value[place >= 0] = self.codes[place[place >= 0]] * -STEP
        left[at >= 0] = self.left[at[at >= 0]] * -STEP
        return value, place, left

    def lookup_longer(self, before: np.ndarray, context: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each triple, by its pair's place: the log10 probability where it was seen, else 0; whether it was; log10 of what (before, context) leaves over (0 where unknown)."""
        at = self.contexts.find(context)
        own = np.full(len(at), -1)
        known = np.flatnonzero(at >= 0)
        own[known] = self.befores.find(at[known], before[known])
        left = np.zeros(len(at))
        left[own >= 0] = self.longer_left[own[own >= 0]] * -STEP
        place = np.full(len(at), -1)
        both = np.flatnonzero((own >= 0) & (pair >= 0))
        place[both] = self.triples.find(pair[both], own[both] - self.starts.get(at[both]).astype(np.int64))
        value = np.zeros(len(at))
        value[place >= 0] = self.longer_codes[place[place >= 0]] * -STEP
        return value, place >= 0, left


def _code(log10: np.ndarray) -> np.ndarray:
    """Rounded down, so that coded probabilities never sum to more."""
    return np.minimum(np.ceil(-log10 / STEP - 1e-9), 65535).astype(np.uint16)
