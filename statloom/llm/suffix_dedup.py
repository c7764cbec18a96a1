"""Removal of repeated byte strings by suffix order (difference cover), on shards of the text that can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statloom.llm import arrays as A
from statloom.llm.base import keyed, query, table
from statloom.llm.routing import Unit, marked, repeated_spans
from statloom.llm.suffixes import joined, repeated_starts


def unit_of(length: int = 200) -> Unit:
    return Unit(window=length, gram=max(1, length * 45 // 100), by_word=False)


def shard_index(bodies: list[bytes], unit: Unit) -> list[np.ndarray]:
    """Sort the suffixes of all strings of the shard and compare neighbours over the length of a window."""
    text, first = joined([np.frombuffer(b, dtype=np.uint8).astype(np.int64) + 1 for b in bodies])
    lengths = np.array([len(b) for b in bodies])
    valid = np.zeros(len(text), dtype=bool)
    for at, n in zip(first, lengths, strict=True):
        valid[at: at + n - unit.window + 1] = True
    hits = repeated_starts(text, valid, unit.window)
    return [hits[at: at + n - unit.window + 1] for at, n in zip(first, lengths, strict=True)]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, out = batch.column("_spans"), []
        for a, b, data, off in A.text_slices(batch.column("text")):
            for i in range(a, b):
                body = data[off[i - a]: off[i - a + 1]]
                cut = spans[i]
                if not cut.is_valid:
                    out.append((len(body), 0, 0, body.tobytes(), []))
                    continue
                runs = A.merged(np.column_stack([np.asarray(cut.values.field(0)), np.asarray(cut.values.field(1))]))
                keep = np.ones(len(body), dtype=bool)
                for s, e in runs:
                    keep[s:e] = False
                out.append((len(body), int((~keep).sum()), len(runs), body[keep].tobytes(), [{"s": int(s), "e": int(e)} for s, e in runs]))
        yield pa.record_batch(
            [batch.column("doc_id"), *[pa.array([o[j] for o in out], pa.int64()) for j in range(3)],
             pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string()), pa.array([o[3] for o in out], pa.binary()),
             pa.array([o[4] for o in out], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"],
        )


def remove_repeated_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """Drop every byte covered by a ``length``-byte string that also starts anywhere else in ``docs``.

    Returns per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; a code point may be
    cut, so they are binary) and removed (the spans). Texts are UTF-8; a null text is empty; texts shorter than
    ``length`` lose nothing; an empty table gives no rows. Rows that repeat a document are further places of its
    strings, so all of them lose what they share. Null ids are kept. Other columns are left out.
    """
    docs = keyed(docs)
    return marked(docs, repeated_spans(docs, unit_of(length), shard_index)).select("doc_id", "text", "_spans").mapInArrow(
        _removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, removed array<struct<s:bigint,e:bigint>>"
    )


@query("op5_suffix_array_dedup")
def op5(spark, sf_dir):
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


__all__ = ["F", "op5", "remove_repeated_bytes", "shard_index"]
