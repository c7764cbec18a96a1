"""Filter interaction audit: what each filter removes under every order, from one pass over the texts.

A document is a word of 32 bits. Bit s stands for the set of filters with number s (filter j is in it if bit j of s is
set) and is one where the document survives all filters of the set. Adding the words up bit by bit gives the survivors of
all 32 sets at once, and every order of the filters is a walk through these sets: no order is ever run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm.base import query, table
from statloom.sources.landing import land

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
BLANKS = r"[\x20\x09-\x0D]+"
#: label classes that are counted: all documents, those of quality 1, toxic ones
CLASSES = ("docs", "good", "toxic")
LANES = 1024
PARTS_HELD = 4096


def survival_word(failed: int) -> int:
    """The sets of filters that a document survives which fails the filters in the bits of ``failed``."""
    return sum(1 << s for s in range(SUBSETS) if not s & failed)


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three words in every bit place."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def bit_sums(words: np.ndarray) -> np.ndarray:
    """How many of the given 32-bit words have each bit.

    Counters of weight 1, 2, 4 and 8 take in sixteen rows of words before a carry of weight 16 leaves them, so bits are
    unpacked once in sixteen rows only.
    """
    rows = -(-len(words) // (16 * LANES)) * 16
    block = np.zeros((rows, LANES), dtype=np.uint32)
    block.reshape(-1)[: len(words)] = words
    total = np.zeros(32, dtype=np.int64)
    held = [np.zeros(LANES, dtype=np.uint32) for _ in range(4)]

    def unpack(lanes: np.ndarray) -> np.ndarray:
        return np.unpackbits(lanes.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for at in range(0, rows, 16):
        level = list(block[at: at + 16])
        for weight in range(4):
            carried = []
            for x, y in zip(level[::2], level[1::2], strict=True):
                held[weight], carry = carry_save(held[weight], x, y)
                carried.append(carry)
            level = carried
        total += 16 * unpack(level[0])
    for weight in range(4):
        total += unpack(held[weight]) << weight
    return total


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task per part and class; at most ``PARTS_HELD`` parts are held before they are given out."""
    sums: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        parts = sorted(sums)
        counts = np.concatenate([sums[p].reshape(-1) for p in parts]) if parts else np.empty(0, dtype=np.int64)
        size = len(CLASSES) * SUBSETS
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * size, pa.int32()), pa.array(counts, pa.int64()))
        sums.clear()
        return pa.record_batch([pa.array(parts, pa.string()), lists], names=["part", "counts"])

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        which = parts.indices.to_numpy(zero_copy_only=False)
        words = batch.column("word").to_numpy(zero_copy_only=False).astype(np.uint32)
        classes = [np.ones(len(words), dtype=bool), *[batch.column(c).to_numpy(zero_copy_only=False) for c in CLASSES[1:]]]
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(parts.dictionary) + 1))
        for i, name in enumerate(parts.dictionary.to_pylist()):
            rows = order[bounds[i]: bounds[i + 1]]
            found = np.stack([bit_sums(words[rows[c[rows]]]) for c in classes])
            sums[name] = sums[name] + found if name in sums else found
        if len(sums) > PARTS_HELD:
            yield out()
    yield out()


def text_failures(text: Column, words: Column) -> list[Column]:
    """Failures of the filters that look at one text: few words, few different words, capitals, symbols."""
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, failed): the filters each row fails, as bits in the order of ``FILTERS``.

    The last filter needs the whole table: a row fails it if a row with a smaller id has the same text. The smallest id of
    each text comes from one aggregation, combined before it is shuffled; it is then looked up by document, not by text, so
    no group of copies meets in one task. A null id is neither smaller nor larger than any other and never fails it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = rows.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    alone = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col("text"), F.col("words"))))
    seen = land(split.select("doc_id", "part", alone.alias("alone"), F.md5("text").alias("digest"), F.xxhash64("text").alias("second")))
    first = seen.where("doc_id IS NOT NULL").groupBy("digest", "second").agg(F.min("doc_id").alias("doc_id"))
    # one row at most matches: a text has one smallest id
    both = seen.alias("d").join(
        first.hint("merge").alias("f"), (F.col("d.doc_id") == F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest")) & (F.col("d.second") == F.col("f.second")), "left")
    again = F.col("d.doc_id").isNotNull() & F.col("f.doc_id").isNull()
    return both.select("d.doc_id", "d.part", (F.col("d.alone") + F.when(again, 1 << 4).otherwise(0)).cast("int").alias("failed"))


def survivors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): for each part and class, the number of survivors of each of the 32 sets of filters."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    words = F.get(F.array(*[F.lit(survival_word(f)) for f in range(SUBSETS)]), F.col("failed"))
    rows = failed.join(marks.hint("merge"), "doc_id", "left").select("part", words.cast("bigint").alias("word"), *[F.coalesce(c, F.lit(False)).alias(c) for c in CLASSES[1:]])
    partial = rows.mapInArrow(_popcounts, "part string, counts array<bigint>")
    total = partial.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    listed = total.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("c")).select("part", F.col("c.n").alias("c"))
    return listed.select("part", *[F.slice("c", 1 + i * SUBSETS, SUBSETS).alias(c) for i, c in enumerate(CLASSES)])


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Five filters under all 120 orders, for each part.

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), all counts of
    documents of the part. ``shapley`` adds a filter's removed documents over all orders, at whatever step it stands there.
    A null text is empty, a null part the empty string; repeated rows count each; several labels of one id count as marked if
    one of them is; rows without label are in neither class; an empty table gives no rows; other columns are left out.
    """
    steps, weight = [], {}
    size = len(FILTERS)
    for order in permutations(range(size)):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[j] for j in order), k + 1, f, before, before | 1 << f))
            weight[f, before] = weight.get((f, before), 0) + 1
            before |= 1 << f
    kinds = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"
    plan = F.from_json(F.lit("[" + ",".join('{"filter_order":"%s","step":%d,"f":%d,"before":%d,"after":%d}' % s for s in steps) + "]"), kinds)

    def left(kind: str, subset: Column) -> Column:
        return F.get(F.col(kind), subset)

    def lost(kind: str) -> Column:
        return left(kind, F.col("s.before")) - left(kind, F.col("s.after"))

    worth = F.array(*[
        sum(F.lit(w) * (left("docs", F.lit(s)) - left("docs", F.lit(s | 1 << f))) for (g, s), w in sorted(weight.items()) if g == f)
        for f in range(size)
    ])
    rows = land(survivors(failures(docs, part), labels)).withColumn("worth", worth).withColumn("s", F.explode(plan))
    alone = F.col("s.after") - F.col("s.before")
    everything = F.lit(SUBSETS - 1)
    return rows.select(
        "part", "s.filter_order", "s.step", left("docs", F.col("s.after")).alias("kept"), lost("docs").alias("removed"),
        (left("docs", F.lit(0)) - left("docs", alone) - lost("docs")).alias("redundant"),
        (left("docs", everything - alone) - left("docs", everything)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("worth", F.col("s.f")).alias("shapley"),
    )


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
d AS (SELECT w.doc_id, part,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed,
        coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
      FROM w LEFT JOIN labels ON labels.doc_id = w.doc_id),
f AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY part, failed),
l AS (SELECT unnest(range(5)) AS v),
o AS (SELECT [a.v, b.v, c.v, e.v, h.v] AS p FROM l a, l b, l c, l e, l h WHERE len(list_distinct([a.v, b.v, c.v, e.v, h.v])) = 5),
s AS (SELECT p, array_to_string([substr('ABCDE', v + 1, 1) FOR v IN p], '') AS filter_order, k AS step, 1 << p[k] AS bit, coalesce(list_sum([1 << v FOR v IN p[1:k-1]]), 0) :: BIGINT AS before
      FROM (SELECT p, unnest(range(1, 6)) AS k FROM o)),
parts AS (SELECT DISTINCT part FROM f),
m AS (SELECT parts.part, filter_order, step, bit,
        coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (failed & before = 0 AND failed & bit > 0), 0) AS removed,
        coalesce(sum(n) FILTER (failed & before > 0 AND failed & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
        coalesce(sum(g) FILTER (failed & before = 0 AND failed & bit > 0), 0) AS good_lost, coalesce(sum(x) FILTER (failed & before = 0 AND failed & bit > 0), 0) AS toxic_lost
      FROM parts, s JOIN f ON true WHERE f.part = parts.part GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM m
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
