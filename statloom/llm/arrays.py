"""Whole Arrow batches of texts as numpy arrays: words, rolling digests, minimizers.

A digest of symbols ``s[a:b]`` is the sum of ``s[i] * B**(i-a)`` modulo 2**64, mixed afterwards, so one cumulative sum
serves every substring of a batch. Digests stand for equality; with 64 bits and a digest of a second kind beside it (the
minimizer of a window) false meetings are out of reach of the corpora this is meant for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
SYMBOLS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 500_000


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), dtype=U)
        have[0] = 1
        have[1:] = U(base)
        np.cumprod(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Digests:
    """Digests of any substring of one symbol array."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(symbols * powers(BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))

    def rolling(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.empty(0, dtype=U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: n - k + 1])


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``SLICE_BYTES``: first row, row after the last, bytes, offsets. One text is never cut."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, off, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, int(off[a]) + SLICE_BYTES, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a]: off[b]], (off[a: b + 1] - off[a]).astype(np.int64)
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and first word index of each row (one more than rows)."""
    inside = ~SPACES[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off, side="left")


def word_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Digests(SYMBOLS[data]).of(start, end)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Smallest of ``a[i:i+w]`` for each i."""
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    rest = w - span
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def super_windows(symbols: np.ndarray, first: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows of one row that have the same minimizer at the same place.

    A run ends where its minimizer leaves on the left, so no window occurs twice within one run, periodic texts included.

    ``first``: first symbol of each row, and the number of symbols. The minimizer of a window is the smallest digest of
    its ``gram``-symbol strings, so equal windows have equal minimizers wherever they stand. Per run: row, start (in
    symbols of the row), run (number of windows), m (minimizer), c (digest of all its symbols).
    """
    n = len(symbols)
    count = n - window + 1
    if count <= 0:
        return {k: np.empty(0, dtype=t) for k, t in (("row", np.int64), ("start", np.int64), ("run", np.int64), ("m", U), ("c", U))}
    digests = Digests(symbols)
    grams = digests.rolling(gram)
    low = sliding_min(grams, window - gram + 1)[:count]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = row[:count] == row[window - 1:]
    new = np.ones(count, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (grams[: count - 1] == low[:-1]) | (whole[1:] != whole[:-1]) | (row[1:count] != row[: count - 1])
    at = np.flatnonzero(new)
    to = np.append(at[1:], count)
    keep = whole[at]
    at, to = at[keep], to[keep]
    return {"row": row[at], "start": at - first[row[at]], "run": to - at, "m": low[at], "c": digests.of(at, to + window - 1)}


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint sorted spans covering the same places; ``spans`` is a two-column array."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]])
