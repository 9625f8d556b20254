"""Words of whole texts as arrays: A-Z lower-cased, cut at ASCII white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from salesmart.llm.tokens import SPACE, ragged, text_buffers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some texts: ``code`` (index into ``names``) of each, ``count`` of each text.
    ``space`` tells which bytes are no part of a word."""

    def __init__(self, texts: pa.Array, lower: bool = True, space: np.ndarray = SPACE):
        self.data, self.offsets = text_buffers(texts.fill_null(""))
        if lower:
            self.data = LOWER[self.data]
        space = space[self.data]
        cut = np.zeros(len(self.data) + 1, dtype=bool)
        cut[:-1] = ~space
        cut[1:-1] &= space[:-1]  # a word begins after white space
        begins = self.offsets[:-1][np.diff(self.offsets) > 0]
        cut[begins] = ~space[begins]  # or with its text
        self.start = np.flatnonzero(cut[:-1])
        # the bytes without white space hold the words one after the other
        kept = ~space
        upto = np.cumsum(kept)
        bounds = np.append(upto[self.start] - 1, int(upto[-1]) if len(upto) else 0)
        data = np.ascontiguousarray(self.data[kept])
        words = pa.Array.from_buffers(pa.large_string(), len(self.start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        self.names = coded.dictionary
        self.code = coded.indices.to_numpy()
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of ``names``, the same on every machine."""
        from pandas.util import hash_array

        return hash_array(np.array(self.names.to_pylist(), dtype=object), categorize=False) if len(self.names) else np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, offsets): the distinct word shingles of each text in ascending order. A text of
    fewer words has its whole sequence as the only one, a text without words none."""
    w = Words(texts)
    h = w.hashes()[w.code]
    n, golden = len(h), np.uint64(0x9E3779B97F4A7C15)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, n)):  # a run over the end of a text is dropped below
        acc[: n - i] = mix(acc[: n - i] * golden + h[i:])
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    for t in short.tolist():
        one = np.zeros(1, dtype=np.uint64)
        for i in range(w.count[t]):
            one = mix(one * golden + h[w.first[t] + i])
        acc[w.first[t]] = mix(one + w.count[t : t + 1].astype(np.uint64) * golden)[0]
    sets = np.where(w.count >= size, w.count - size + 1, (w.count > 0).astype(np.int64))
    acc = acc[ragged(w.first[:-1], sets)]
    ends = np.cumsum(sets)
    starts = ends - sets
    new = np.ones(len(acc), dtype=bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        acc[a:b].sort()
    new[1:] = acc[1:] != acc[:-1]
    new[starts[sets > 0]] = True
    return acc[new], np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])]
