"""Removal of repeated word windows with one compressed full-text index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statloom.llm import arrays as A
from statloom.llm.base import keyed, query, table
from statloom.llm.routing import Unit, marked, repeated_spans
from statloom.llm.suffixes import joined, suffix_order


def unit_of(length: int = 35) -> Unit:
    return Unit(window=length, gram=max(1, length * 2 // 5), by_word=True)


class WaveletIndex:
    """Burrows-Wheeler transform of a text in a wavelet tree stored level by level (one bit vector each).

    A bit vector keeps 64-bit blocks and the number of ones before each block; ranks are answered for whole arrays of
    positions at once.
    """

    def __init__(self, text: np.ndarray):
        self.symbols, coded = np.unique(text, return_inverse=True)
        self.n = n = len(coded)
        order = suffix_order(coded)
        column = coded[order - 1]  # position -1 is the last symbol, a separator
        self.before = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=len(self.symbols)))])
        self.bits = max(1, int(len(self.symbols) - 1).bit_length())
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((column >> level) & 1).astype(np.uint8)
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bit
            blocks = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks).astype(np.int64))]).astype(np.int32)
            self.levels.append((level, blocks, ones, n - int(bit.sum())))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.origin = self.down(np.arange(len(self.symbols)), np.zeros(len(self.symbols), dtype=np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place in the last level of position ``at``, seen from the symbol's branch."""
        for level, blocks, ones, zeros in self.levels:
            block = at >> 6
            part = blocks[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            rank = ones[block] + np.bitwise_count(part)
            at = np.where((symbol >> level) & 1, zeros + rank, at - rank)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of ``symbol`` followed by what ``[low, high)`` stands for."""
        base = self.before[symbol] - self.origin[symbol]
        return base + self.down(symbol, low), base + self.down(symbol, high)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, cap: int) -> np.ndarray:
        """For each end, the longest string before it (``cap`` symbols at most) that the index holds twice or more."""
        coded = np.searchsorted(self.symbols, text)
        length = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        for step in range(1, cap + 1):
            low, high = self.extend(coded[ends[live] - step], low, high)
            ok = high - low >= 2
            live, low, high = live[ok], low[ok], high[ok]
            if not len(live):
                break
            length[live] = step
        return length


def shard_index(bodies: list[bytes], unit: Unit) -> list[np.ndarray]:
    """Index the strings of the shard and stream them against it: windows whose matching statistic reaches the window."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    start, end, first = A.words(data, off)
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    ids = np.array([known.setdefault(raw[s:e], len(known) + 1) for s, e in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.int64)
    text, at = joined([ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
    counts = np.diff(first) - unit.window + 1
    ends = np.concatenate([np.arange(s + unit.window, s + unit.window + c) for s, c in zip(at, counts, strict=True)])
    reached = WaveletIndex(text).matching_statistics(text, ends, unit.window) >= unit.window
    return np.split(reached, np.cumsum(counts)[:-1])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, out = batch.column("_spans"), []
        for a, b, data, off in A.text_slices(batch.column("text")):
            for i in range(a, b):
                body = data[off[i - a]: off[i - a + 1]]
                parts = body.tobytes().split()
                cut = spans[i]
                runs = A.merged(np.column_stack([np.asarray(cut.values.field(0)), np.asarray(cut.values.field(1))])) if cut.is_valid else ()
                keep, last = [], 0
                for s, e in runs:
                    keep += parts[last:s]
                    last = e
                kept = b" ".join(keep + parts[last:])
                out.append((len(parts), sum(int(e - s) for s, e in runs), kept, [{"s": int(s), "e": int(e)} for s, e in runs]))
        yield pa.record_batch(
            [batch.column("doc_id"), *[pa.array([o[j] for o in out], pa.int64()) for j in range(2)],
             pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()), pa.array([o[2].decode() for o in out], pa.string()),
             pa.array([o[3] for o in out], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"],
        )


def remove_repeated_words(docs: DataFrame, length: int = 35) -> DataFrame:
    """Drop every word covered by a window of ``length`` words that also starts anywhere else in ``docs``.

    Returns per row: doc_id, n_words, n_removed, kept_sha256, kept (remaining words joined by one space) and removed
    (spans in words). A null text has no words; texts with fewer words than a window lose nothing; an empty table gives
    no rows; repeated rows are further places of their windows; null ids are kept; other columns are left out.
    """
    docs = keyed(docs)
    return marked(docs, repeated_spans(docs, unit_of(length), shard_index)).select("doc_id", "text", "_spans").mapInArrow(
        _removed, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, removed array<struct<s:bigint,e:bigint>>"
    )


@query("op8_fm_index_dedup")
def op8(spark, sf_dir):
    return remove_repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
