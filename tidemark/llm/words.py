"""Words of a batch of texts as numpy arrays: positions, 64-bit hashes, hashes of word runs."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``size`` of each; the last size is kept."""
    if size not in _tables:
        _tables.clear()
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        _tables[size] = (pair[0], pair[1])
    return _tables[size]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


class WordBatch:
    """Texts laid one after another with a line feed between.

    ``starts`` and ``ends`` are byte positions of words in ``buffer``, ``document`` the index
    of each word's text, ``first`` the word index at which each text begins (one more entry
    for the end). Equal words have equal ``hashes``; a sum over bytes times powers of an odd
    base, so that all words are hashed in a few array operations.
    """

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.buffer = b"\n".join([*texts, b""])
        data = np.frombuffer(self.buffer, np.uint8)
        space = np.ones(len(data) + 1, np.int8)
        space[1:] = SPACES[data]
        edges = np.flatnonzero(np.diff(space))
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, bounds)
        self.document = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._data = data

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            power, inverse = _powers(1 << max(21, (len(self._data)).bit_length()))
            sums = np.zeros(len(self._data) + 1, np.uint64)
            np.cumsum((self._data.astype(np.uint64) + np.uint64(1)) * power[: len(self._data)], out=sums[1:])
            self._hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
        return self._hashes

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``length`` words from each word on, and whether they lie in one text.

        Both arrays have an entry for each word that has ``length - 1`` words behind it.
        """
        words = self.hashes
        n = max(0, len(words) - length + 1)
        out = np.zeros(n, np.uint64)
        factor = 1
        for j in range(length):
            factor = (factor * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK | 1
            out += words[j : j + n] * np.uint64(factor)
        return mix(out), self.document[:n] == self.document[length - 1 : length - 1 + n]

    def text(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last`` (exclusive) joined by one space."""
        return b" ".join(self.buffer[self.starts[first] : self.ends[last - 1]].split())
