"""Quality rules: measures of each text, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statloom.llm import arrays as A
from statloom.llm.base import KEY, join_documents, keyed, query, table
from statloom.sources.landing import land

MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))
LINE_DOCS, LEAST_WORDS, LEAST_SHARE = 20, 10, 0.2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def repeated_words(symbols: np.ndarray, size: int = 5) -> int:
    """Words inside windows of ``size`` words that stand twice or more in the text."""
    if len(symbols) <= size:
        return 0
    names = A.Digests(symbols).rolling(size)
    _, which, count = np.unique(names, return_inverse=True, return_counts=True)
    again = count[which] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(symbols) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _lines(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first byte, byte after the last, first word and word after the last of each line that has words.

    Lines end at a newline or where the row ends.
    """
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([off[:-1][off[1:] > off[:-1]], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    row = np.searchsorted(off, line_start, side="right") - 1
    stop = np.concatenate([breaks, [len(data)]])
    line_end = np.minimum(stop[np.searchsorted(breaks, line_start, side="left")], off[row + 1])
    word_a, word_b = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    full = word_b > word_a
    return row[full], line_start[full], line_end[full], word_a[full], word_b[full]


def _line_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, word_a: np.ndarray, word_b: np.ndarray) -> np.ndarray:
    return A.Digests(A.word_digests(A.LOWER[data], start, end)).of(word_a, word_b).view(np.int64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures of each text, its different lines and the words they have there."""
    for batch in batches:
        for a, b, data, off in A.text_slices(batch.column("text")):
            start, end, first = A.words(data, off)
            symbols = A.word_digests(data, start, end)
            chars = _sums(~A.SPACES[data] & ((data & 0xC0) != 0x80), off)
            marks = _sums(MARKS[data], off)
            row, line_start, line_end, word_a, word_b = _lines(data, off, start, end)
            exact = A.Digests(A.SYMBOLS[data]).of(line_start, line_end)
            plain = _line_names(data, start, end, word_a, word_b)
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            out, lines = [], []
            for i in range(b - a):
                x, y = int(bounds[i]), int(bounds[i + 1])
                out.append((int(first[i + 1] - first[i]), int(chars[i]), int(marks[i]), y - x - len(np.unique(exact[x:y])), repeated_words(symbols[first[i]: first[i + 1]])))
                kinds, which = np.unique(plain[x:y], return_inverse=True)
                held = np.bincount(which, weights=word_b[x:y] - word_a[x:y], minlength=len(kinds)) if y > x else []
                lines.append([{"h": int(h), "w": int(w)} for h, w in zip(kinds, held, strict=True)])
            at = pa.array(np.arange(a, b))
            yield pa.record_batch(
                [batch.column("doc_id").take(at), batch.column("_rk").take(at), batch.column("host").take(at), *[pa.array([o[j] for o in out], pa.int64()) for j in range(5)],
                 pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())])))],
                names=["doc_id", "_rk", "host", *MEASURES, "lines"],
            )


def _without(text: bytes, spans: np.ndarray) -> bytes:
    """``text`` without the lines at the given (first byte, byte after the last), each with the newline behind it."""
    parts, at = [], 0
    for a, b in spans.tolist():
        parts.append(text[at:a])
        at = b + 1
    rest = text[at:]
    out = b"".join(parts) + rest
    # a last line without newline takes the one before it along
    return out[:-1] if at > len(text) and out.endswith(b"\n") else out


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines named in ``common``."""
    for batch in batches:
        for a, b, data, off in A.text_slices(batch.column("text")):
            start, end, _ = A.words(data, off)
            row, line_start, line_end, word_a, word_b = _lines(data, off, start, end)
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            common = batch.column("common").slice(a, b - a).to_pylist()
            plain = _line_names(data, start, end, word_a, word_b) if any(common) else None
            left = []
            for i in range(b - a):
                x, y = int(bounds[i]), int(bounds[i + 1])
                text = data[off[i]: off[i + 1]].tobytes()
                if common[i]:
                    gone = np.isin(plain[x:y], np.array(common[i], dtype=np.int64))
                    text = _without(text, np.column_stack([line_start[x:y][gone], line_end[x:y][gone]]) - off[i])
                left.append(text)
            at = pa.array(np.arange(a, b))
            yield pa.record_batch(
                [batch.column("doc_id").take(at), batch.column("_rk").take(at), pa.array(left, pa.binary()).view(pa.string())], names=["doc_id", "_rk", "text_left"])


MEASURED = "doc_id bigint, _rk bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<h:bigint,w:bigint>>"


def _measures_and_lost(docs: DataFrame, host: str, line_docs: int) -> tuple[DataFrame, DataFrame]:
    """(measures per row, common lines per document): one pass over the texts, lines travel as digests."""
    keyed_docs = keyed(docs.withColumn("host", F.col(host).cast("string")), "host")
    found = land(keyed_docs.mapInArrow(_measured, MEASURED)).withColumn("host", F.coalesce("host", F.lit("")))
    lines = found.select(*KEY, "host", F.explode("lines").alias("l")).select(*KEY, "host", "l.h", "l.w")
    common = land(lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > line_docs).select("host", "h"))
    # repeated rows have the same lines: a set holds each of them once
    lost = lines.join(common, ["host", "h"]).groupBy(*KEY, "host").agg(F.collect_set(F.struct("h", "w")).alias("c"))
    words = F.aggregate("c", F.lit(0).cast("bigint"), lambda total, x: total + x["w"])
    lost = lost.groupBy(*KEY).agg(F.max(F.struct(words.alias("n_common_words"), "host", F.transform("c", lambda x: x["h"]).alias("common"))).alias("l"))
    return found.select(*KEY, *MEASURES), land(lost.select(*KEY, "l.n_common_words", "l.common"))


def quality_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS,
                  least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Measures and verdict of each document. No text is shuffled.

    A line (words lower-cased, white space evened) is common if more than ``line_docs`` documents of a host hold it,
    however large the host is. A document left with fewer than ``least_words`` words or less than ``least_share`` of its
    words without its common lines is depleted; ``texts_without_common_lines`` gives the texts. Returns per row: doc_id, _rk,
    the five measures of the whole text, n_common_words, base_failed, depleted, kept. A null text has no words and fails;
    null hosts form one host; repeated rows count as documents of their own and get equal answers (in several hosts: those
    of the host that takes out most); an empty table gives no rows; other columns are left out.
    """
    measures, lost = _measures_and_lost(docs, host, line_docs)
    out = join_documents(measures, lost.drop("common"))
    lost_words = F.coalesce("n_common_words", F.lit(0))
    left = F.col("n_words") - lost_words
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (lost_words > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return out.select(*KEY, *MEASURES, lost_words.alias("n_common_words"), failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"))


def texts_without_common_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """(doc_id, _rk, text_left) per row: the text without the common lines of ``quality_rules``, each with its newline.

    Texts without common lines are as they were; a null text is empty.
    """
    _, lost = _measures_and_lost(docs, host, line_docs)
    return join_documents(keyed(docs), lost.drop("n_common_words")).mapInArrow(_left, "doc_id bigint, _rk bigint, text_left string")


@query("op7_line_frequency_rules")
def op7(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", "n_common_words", "depleted")
