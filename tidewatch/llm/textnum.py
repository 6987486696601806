"""Vectorised word and word-window hashing over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for name, base in (("p", _P), ("q", _Q)):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            _powers[name] = np.multiply.accumulate(seq)
    return _powers["p"][:n], _powers["q"][:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of values[start:end] for each span, in O(1) a span."""
    p, q = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a batch: hash, document index and place of each, in order."""

    def __init__(self, texts: list[str | None]):
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = b" ".join(parts) + b" "
        raw = np.frombuffer(self.buf, np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        first = np.cumsum(size) - size
        gap = _BREAK[raw]
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        self.starts = np.flatnonzero(before & ~gap)
        self.ends = np.flatnonzero(gap & ~before)
        self.doc = np.searchsorted(first, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(parts)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.hashes = span_hash(_BYTES[raw], self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Global start index and hash of every window of ``width`` words in one document."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return at, span_hash(self.hashes, at, at + width)


def blocks(texts: list[str | None], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``limit`` characters; a longer text is alone in its range."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
