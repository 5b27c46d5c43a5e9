"""Hashes of word windows, for many texts at once in numpy.

A word is a run of bytes other than the space and \\x09-\\x0D. The words of a text, joined by one
space, get a prefix sum of byte * base**place modulo 2**64; the hash of any window is a
difference of two sums times the inverse power of its start.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once, a power of two; a longer text is handled alone.
CHUNK = 1 << 19
_powers: list[np.ndarray] = []


def _pow() -> list[np.ndarray]:
    """Powers of the base and of its inverse below CHUNK; workers keep them, so they don't grow with the texts."""
    if not _powers:
        for b in (_BASE, _INVERSE):
            steps = np.full(CHUNK, b, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def canonical(text: str | None) -> bytes:
    """The words joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


class Words:
    """Word places and hash sums of some canonical texts."""

    def __init__(self, texts: list[bytes]):
        self.blob = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.blob, dtype=np.uint8)
        up = _pow()[0]
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        for at in range(0, len(raw), CHUNK):  # in place: base**(at + i) is base**at * base**i
            part = self.sums[at + 1 : at + 1 + CHUNK]
            part[:] = raw[at : at + CHUNK]
            part += np.uint64(1)
            part *= up[: len(part)]
            part *= np.uint64(pow(_BASE, at, 1 << 64))
            np.cumsum(part, out=part)
            part += self.sums[at]
        stops = np.flatnonzero((raw == 32) | (raw == 10))
        self.starts = np.concatenate([[0], stops[:-1] + 1])
        self.stops = stops
        full = self.stops > self.starts  # an empty text leaves one empty word
        ends = np.cumsum(raw[stops] == 10) - (raw[stops] == 10)
        self.doc = ends[full]
        self.starts, self.stops = self.starts[full], self.stops[full]
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # of each text's words; one more at the end

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of every window of k words within one text."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, self.spans(at, at + k - 1)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words a to b, both inclusive."""
        lo, hi = self.starts[a], self.stops[b]
        found = (self.sums[hi] - self.sums[lo]) * _pow()[1][lo % CHUNK]
        if len(self.blob) > CHUNK:
            found *= np.array([pow(_INVERSE, at, 1 << 64) for at in range(0, len(self.blob), CHUNK)], dtype=np.uint64)[lo // CHUNK]
        return mix64(found)

    def bytes_of(self, a: int, b: int) -> bytes:
        return self.blob[self.starts[a] : self.stops[b]]


def chunks(texts: list[bytes], most: int = CHUNK):
    """(index of the first text, texts) with about `most` bytes each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]
