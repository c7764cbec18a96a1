"""Routing of repeated windows to shards, shared by the two substring operators.

Every window of W symbols has a minimizer; neighbouring windows with the same one form a super-window. Equal windows
have equal minimizers, so a repeated window can only lie in super-windows whose minimizer occurs more than once, and all
places of it meet if super-windows are dealt out by minimizer. Super-windows with equal content are repeated as a whole
and are stored once. What is left, a few per cent of the text, is sent to shards of bounded size, each indexed on its own.

A minimizer with very many different super-windows (the border of a passage that many documents hold) would not fit a
shard: its windows are dealt out by their own digests instead and counted, which is exact as well and splits as far as
the windows differ. Most of them are decided in blocks before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statloom.llm import arrays as A
from statloom.llm.base import KEY, join_documents, same_document
from statloom.llm.sieve import passes, sieve_of
from statloom.sources.landing import land


@dataclass(frozen=True)
class Unit:
    """What a window is made of. ``gram``: symbols of a minimizer; ``shard``: bytes of text a shard may index."""

    window: int
    gram: int
    by_word: bool
    shard: int = 600_000
    hot: int = 400


def symbols_of(unit: Unit, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, first symbol of each row, and the bytes where each symbol starts and ends."""
    if unit.by_word:
        start, end, first = A.words(data, off)
        return A.word_digests(data, start, end), first, start, end
    at = np.arange(len(data))
    return A.SYMBOLS[data], off, at, at + 1


def _emit(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("_rk")
            for a, _, data, off in A.text_slices(batch.column("text")):
                symbols, first, _, _ = symbols_of(unit, data, off)
                found = A.super_windows(symbols, first, unit.window, unit.gram)
                if len(found["row"]):
                    at = pa.array(found["row"] + a)
                    yield pa.record_batch(
                        [ids.take(at), keys.take(at), pa.array(found["start"].astype(np.int32)), pa.array(found["run"].astype(np.int32)),
                         pa.array(found["m"].view(np.int64)), pa.array(found["c"].view(np.int64))],
                        names=["doc_id", "_rk", "start", "run", "m", "c"],
                    )

    return run


def _place(rk: np.ndarray, c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Digest of one super-window at one place."""
    return A.mix(rk.view(A.U) ^ A.mix(c.view(A.U) + start.astype(A.U) * A.U(A.BASE)))


def _cut(unit: Unit, sieve) -> Callable:
    """Bytes of the super-windows whose place passes the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("_rk"))
            for a, _, data, off in A.text_slices(batch.column("text")):
                symbols, first, start, end = symbols_of(unit, data, off)
                found = A.super_windows(symbols, first, unit.window, unit.gram)
                keep = passes(sieve.value, _place(keys[found["row"] + a], found["c"], found["start"]))
                if keep.any():
                    row, place, run_ = found["row"][keep], found["start"][keep], found["run"][keep]
                    low, high = start[first[row] + place], end[first[row] + place + run_ + unit.window - 2]
                    at = pa.array(row + a)
                    yield pa.record_batch(
                        [batch.column("doc_id").take(at), batch.column("_rk").take(at), pa.array(place.astype(np.int32)),
                         pa.array(found["c"][keep].view(np.int64)), pa.array([data[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())],
                        names=["doc_id", "_rk", "start", "c", "body"],
                    )

    return run


def _digest_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = _place(*[np.asarray(batch.column(c)) for c in ("_rk", "c", "start")])
        yield pa.record_batch([pa.array(d.view(np.int64))], names=["d"])


BLOCK = "doc_id bigint, _rk bigint, start int, m bigint, n bigint, b int, f int, core bigint, whole bigint, at int, size int"
OPEN = "doc_id bigint, _rk bigint, m bigint, single boolean, w bigint, s bigint"


def _blocks(unit: Unit) -> Callable:
    """Windows of hot super-windows in blocks of about the root of their number.

    A window is named by the place of its minimizer, which is the same for equal windows. A block (``b``) is a range of such
    places; ``core`` digests what all its windows have in common, ``whole`` all symbols of those that the super-window has,
    which are ``size`` from ``at`` on (``f``: the place in the first of them).
    """
    places = unit.window - unit.gram + 1
    wide = max(2, math.isqrt(places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minimizer = np.asarray(batch.column("m")).view(A.U)
            for a, z, data, off in A.text_slices(batch.column("body")):
                symbols, first, _, _ = symbols_of(unit, data, off)
                digests, length = A.Digests(symbols), np.diff(first)
                grams = digests.rolling(unit.gram)
                row = np.repeat(np.arange(len(length)), length)[: len(grams)]
                hit = np.flatnonzero(grams == minimizer[a:z][row])
                hit = hit[hit - first[row[hit]] < places]
                anchor = (hit - first[row[hit]])[np.unique(row[hit], return_index=True)[1]]  # leftmost; every row has one
                last = anchor - (length - unit.window)  # the place in the last window
                count = anchor // wide - last // wide + 1
                r = np.repeat(np.arange(len(length)), count)
                b = (last // wide)[r] + np.arange(len(r)) - (np.cumsum(count) - count)[r]
                low, high = np.maximum(b * wide, last[r]), np.minimum(b * wide + wide - 1, anchor[r])
                zero = first[r] + anchor[r]
                core = digests.of(zero - b * wide, zero - np.minimum(b * wide + wide, places) + 1 + unit.window)
                whole = digests.of(zero - high, zero - low + unit.window)
                at = pa.array(r + a)
                ints = [x.astype(np.int32) for x in (anchor[r] - high, high - low + 1)]
                yield pa.record_batch(
                    [*[batch.column(c).take(at) for c in ("doc_id", "_rk", "start", "m", "n")], pa.array(b.astype(np.int32)), pa.array(high.astype(np.int32)),
                     pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), *map(pa.array, ints)],
                    names=["doc_id", "_rk", "start", "m", "n", "b", "f", "core", "whole", "at", "size"],
                )

    return run


def _named(unit: Unit) -> Callable:
    """One row per window of blocks that are not decided: its digest, and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size = (np.asarray(batch.column(c)).astype(np.int64) for c in ("at", "size"))
            for a, z, data, off in A.text_slices(batch.column("body")):
                symbols, first, _, _ = symbols_of(unit, data, off)
                names, k = A.Digests(symbols).rolling(unit.window), size[a:z]
                row = np.repeat(np.arange(z - a), k)
                place = begin[a:z][row] + np.arange(len(row)) - (np.cumsum(k) - k)[row]
                at = pa.array(row + a)
                start = np.asarray(batch.column("start").take(at)) + place
                yield pa.record_batch(
                    [*[batch.column(c).take(at) for c in ("doc_id", "_rk", "m", "single")], pa.array(names[first[row] + place].view(np.int64)), pa.array(start.astype(np.int64))],
                    names=["doc_id", "_rk", "m", "single", "w", "s"],
                )

    return run


def hot_spans(bodies: DataFrame, unit: Unit) -> DataFrame:
    """Spans of repeated windows in super-windows of hot minimizers; ``bodies`` is landed.

    Equal blocks repeat all their windows and go on as one. Blocks with a core of their own share no window with others.
    Only the windows of what is left, about a block at each border of a passage, are counted one by one.
    """
    key = ["m", "b", "f", "whole"]
    parts = land(bodies.mapInArrow(_blocks(unit), BLOCK))
    kinds = land(parts.groupBy(*key).agg(F.count("*").alias("k"), *[F.first(c).alias(c) for c in (*KEY, "start", "n", "core", "at", "size")]))
    again = parts.where("n = 1").join(kinds.where("k > 1").select(*key), key, "left_semi").select(
        *KEY, (F.col("start") + F.col("at")).cast("bigint").alias("s"), (F.col("start") + F.col("at") + F.col("size") + (unit.window - 1)).cast("bigint").alias("e"))
    several = kinds.groupBy("m", "b", "core").agg(F.count("*").alias("c")).where("c > 1").select("m", "b", "core")
    undecided = kinds.join(several, ["m", "b", "core"], "left_semi").select(*KEY, "start", "at", "size", ((F.col("k") == 1) & (F.col("n") == 1)).alias("single"))
    same = same_document("l", "r") & (F.col("l.start") == F.col("r.start"))
    texts = bodies.alias("l").join(undecided.alias("r"), same).select("l.doc_id", "l._rk", "l.start", "l.m", "r.at", "r.size", "r.single", "l.body")
    names = land(texts.mapInArrow(_named(unit), OPEN))
    twice = land(names.groupBy("m", "w").agg(F.count("*").alias("k")).where("k > 1").select("m", "w"))
    one = names.where("single").join(twice, ["m", "w"], "left_semi").select(*KEY, "s", (F.col("s") + unit.window).alias("e"))
    return again.unionByName(one)


SPAN = "doc_id bigint, _rk bigint, s bigint, e bigint"


def repeated_spans(docs: DataFrame, unit: Unit, index: Callable[[list[bytes], Unit], list[np.ndarray]]) -> DataFrame:
    """Spans (in symbols) covered by repeated windows, one row per super-window that has any.

    ``docs`` is keyed. ``index`` gets the different super-windows of one shard and returns, for each, which of its
    windows start somewhere else in the shard too.
    """
    spark = docs.sparkSession
    found = land(docs.select("doc_id", "_rk", "text").mapInArrow(_emit(unit), "doc_id bigint, _rk bigint, start int, run int, m bigint, c bigint"))
    again = found.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    found = land(found.join(land(again), "m", "left_semi"))
    kinds = land(found.groupBy("m", "c").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*KEY, "start", "run")]))
    many = kinds.groupBy("m").agg(F.count("*").alias("k")).where("k > 1")
    whole = found.join(kinds.where("n > 1").select("m", "c"), ["m", "c"], "left_semi").select(
        *KEY, F.col("start").cast("bigint").alias("s"), (F.col("start") + F.col("run") + (unit.window - 1)).cast("bigint").alias("e")
    )
    wanted = land(kinds.join(many, "m").select(*KEY, "start", "m", "c", "n", (F.col("k") > unit.hot).alias("hot")))
    places = wanted.select("_rk", "c", "start").mapInArrow(_digest_places, "d bigint")
    texts = docs.select("doc_id", "_rk", "text").mapInArrow(_cut(unit, sieve_of(places, "d")), "doc_id bigint, _rk bigint, start int, c bigint, body binary")
    same = same_document("l", "r") & (F.col("l.start") == F.col("r.start")) & (F.col("l.c") == F.col("r.c"))
    bodies = texts.alias("l").join(wanted.alias("r"), same).select("l.doc_id", "l._rk", "l.start", "r.m", "r.n", "r.hot", "l.body")
    bodies = land(bodies.dropDuplicates([*KEY, "start"]))  # rows that repeat a document give each place once
    size = bodies.where("NOT hot").agg(F.sum(F.length("body"))).first()[0] or 0
    shards = 1 + int(size // unit.shard)

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unique = np.asarray(table.column("n")) == 1
        hits = index(table.column("body").to_pylist(), unit)
        rows, s, e = [], [], []
        start = np.asarray(table.column("start"))
        for i in np.flatnonzero(unique):
            at = np.flatnonzero(hits[i])
            if len(at):
                for lo, hi in A.merged(np.column_stack([at, at + unit.window])):
                    rows.append(i)
                    s.append(int(start[i] + lo))
                    e.append(int(start[i] + hi))
        take = pa.array(rows, pa.int64())
        return pa.table({"doc_id": table.column("doc_id").take(take), "_rk": table.column("_rk").take(take), "s": pa.array(s, pa.int64()), "e": pa.array(e, pa.int64())})

    partly = bodies.where("NOT hot").groupBy(F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard")).applyInArrow(lambda t: search(t), SPAN)
    return whole.unionByName(partly).unionByName(hot_spans(bodies.where("hot"), unit))


def _with_spans(there: bool, sieve) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = passes(sieve.value, np.asarray(batch.column("_rk")))
            yield batch.filter(pa.array(keep if there else ~keep))

    return run


def marked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with ``_spans``: the spans of each document, not merged yet; null if there are none.

    Only texts of documents that may have spans are moved to them.
    """
    per = land(spans.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("_spans")))
    docs, sieve = docs.select("doc_id", "text", "_rk"), sieve_of(per.select("_rk"), "_rk")
    shape = "doc_id bigint, text string, _rk bigint"
    clean = docs.mapInArrow(_with_spans(False, sieve), shape).withColumn("_spans", F.lit(None).cast("array<struct<s:bigint,e:bigint>>"))
    return clean.unionByName(join_documents(docs.mapInArrow(_with_spans(True, sieve), shape), per))


__all__ = ["Unit", "marked", "repeated_spans", "same_document", "symbols_of"]
