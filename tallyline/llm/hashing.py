"""64-bit hashes of the words of texts, made in whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: What is left of eight bytes, by how many of them belong to a word.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words data[start:end], none of them empty: eight bytes at a time are mixed with their place, then summed.

    The place goes through ``mix`` as well, so no choice of like letters at like distances
    cancels out, as it does in polynomials modulo a power of two.
    """
    size = ends - starts
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    padded = np.append(_LOWER[data], np.zeros(8, dtype=np.uint8))
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    own = eights[np.repeat(starts, blocks) + 8 * place] & _LEFT[np.minimum(8, np.repeat(size, blocks) - 8 * place)]
    mixed = mix(own + mix(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(mixed, first) + size.astype(np.uint64)) if len(first) else mixed


class WordHasher:
    """Words are runs of other than U+0020 and U+0009-U+000D, A-Z in lower case."""

    def chunks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word hashes of some texts, where each text's words begin and end), in order; null texts have none."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
            yield self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        space = _SPACE[data]
        fresh = np.ones(n + 1, dtype=bool)  # a text begins, or the byte before is white space
        fresh[1:] = np.append(space[:-1], True) if n else []
        fresh[offsets] = True
        starts = np.flatnonzero(fresh[:n] & ~space)
        ended = np.append(space, True)
        ended[offsets[1:]] = True
        ends = np.flatnonzero(ended)
        ends = ends[np.searchsorted(ends, starts, "right")] if len(starts) else starts
        return _hashed(data, starts, ends), np.searchsorted(starts, offsets)
