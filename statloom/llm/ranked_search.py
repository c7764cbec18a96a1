"""Ranked search of all documents by a pipeline of term owners.

The index is parted by term: each owner holds the postings of its terms, the rarest with the first owner. Documents are
dealt into shards of about ``SHARD_DOCS``, so a posting list of any length lies in many small pieces. For every shard the
items travel as bundles (an item, its terms, and a sparse accumulator: places in the shard and integer scores). At each
owner a bundle is cogrouped with the postings of the same shard, takes their contributions in and goes on to the next;
behind the last owner the best documents of each shard are read off and then the best of all shards.

An accumulator is closed on the way only where it provably cannot reach the ``k`` best of its own shard any more: where its
score and the most that all later owners could add stay below ``k`` scores already there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statloom.llm import arrays as A
from statloom.llm.base import keyed, land_by, query, table
from statloom.sources.landing import land

K, SHARD_DOCS, BLOCK_ITEMS = 10, 4096, 256
#: an owner takes the terms that less than one in so many documents hold, the last one the rest
OWNER_RARITY = (64, 16, 4)
#: no document's part of a contribution reaches this, as tf / (tf + 0.008 m) stays below one
PART_CEILING = 1_000_000
WORD_BYTES = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
BUNDLE = "block int, shard int, item long, terms array<bigint>, weights array<bigint>, slots array<int>, scores array<bigint>"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its number of terms, the digests of the different ones and how often each stands there."""
    for batch in batches:
        for a, b, data, off in A.text_slices(batch.column("text")):
            inside = WORD_BYTES[data]
            before, after = np.zeros_like(inside), np.zeros_like(inside)
            before[1:], after[:-1] = inside[:-1], inside[1:]
            full = off[1:] > off[:-1]
            before[off[:-1][full]] = False
            after[off[1:][full] - 1] = False
            start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            row = np.searchsorted(off, start, side="right") - 1
            names = A.word_digests(A.LOWER[data], start, end)
            order = np.lexsort((names, row))
            row, names = row[order], names[order]
            new = np.ones(len(names), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (names[1:] != names[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(names)))
            cuts = pa.array(np.searchsorted(row[at], np.arange(b - a + 1)).astype(np.int32))
            n = np.bincount(row, minlength=b - a).astype(np.int64)
            pick = pa.array(np.arange(a, b))
            yield pa.record_batch(
                [batch.column("id").take(pick), pa.array(n), pa.ListArray.from_arrays(cuts, pa.array(names[at].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))],
                names=["id", "n", "terms", "tfs"],
            )


def term_lists(rows: DataFrame) -> DataFrame:
    """(id, n, terms, tfs) of rows (id, text)."""
    return rows.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(_terms, "id bigint, n bigint, terms array<bigint>, tfs array<int>")


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *[len(r) for r in rows]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0), kind))


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _owner(stage: int, k: int):
    """One owner's work on one shard: bundles in, bundles with its contributions out."""

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundles.num_rows:
            return bundles.select(["block", "shard", "item", "terms", "weights", "slots", "scores"])
        term, slot = postings.column("term").to_numpy(), postings.column("slot").to_numpy()
        part = postings.column("part").to_numpy()
        order = np.argsort(term, kind="stable")
        term, slot, part = term[order], slot[order], part[order]
        t_off, terms = _values(bundles.column("terms"))
        _, weights = _values(bundles.column("weights"))
        a_off, slots = _values(bundles.column("slots"))
        _, scores = _values(bundles.column("scores"))
        lo, hi = np.searchsorted(term, terms, side="left"), np.searchsorted(term, terms, side="right")
        # the owner of each term is told with its weight: owner in the low bits
        owner, weight = weights & 7, weights >> 3
        room = np.zeros(int(max(slot.max(initial=-1), slots.max(initial=-1))) + 1, dtype=np.int64)
        out_slots, out_scores = [], []
        for i in range(bundles.num_rows):
            room[:] = 0
            room[slots[a_off[i]: a_off[i + 1]]] = scores[a_off[i]: a_off[i + 1]]
            mine = range(t_off[i], t_off[i + 1])
            for j in mine:
                if owner[j] == stage and hi[j] > lo[j]:
                    # a document stands once in a term's list, so plain indexing adds each contribution
                    room[slot[lo[j]: hi[j]]] += weight[j] * part[lo[j]: hi[j]]
            held = np.flatnonzero(room)
            got = room[held]
            if len(held) > k:
                later = int(weight[t_off[i]: t_off[i + 1]][owner[t_off[i]: t_off[i + 1]] > stage].sum()) * PART_CEILING
                enough = int(np.partition(got, len(got) - k)[len(got) - k])
                open_ = got + later >= enough
                held, got = held[open_], got[open_]
            out_slots.append(held.astype(np.int32))
            out_scores.append(got)
        same = [bundles.column(c).combine_chunks() for c in ("block", "shard", "item", "terms", "weights")]
        return pa.table([*same, _lists(out_slots, pa.int32()), _lists(out_scores, pa.int64())], names=["block", "shard", "item", "terms", "weights", "slots", "scores"])

    return add


def _best(k: int):
    """The best documents of a shard for each bundle; slots ascend with doc_id, so equal scores keep that order."""

    def pick(bundles: pa.Table, documents: pa.Table) -> pa.Table:
        slot, doc = documents.column("slot").to_numpy(), documents.column("doc_id")
        where = np.argsort(slot, kind="stable")
        a_off, slots = _values(bundles.column("slots"))
        _, scores = _values(bundles.column("scores"))
        item = bundles.column("item").to_numpy()
        items, places, found = [], [], []
        for i in range(bundles.num_rows):
            s, v = slots[a_off[i]: a_off[i + 1]], scores[a_off[i]: a_off[i + 1]]
            top = np.lexsort((s, -v))[:k]
            items.append(np.full(len(top), item[i]))
            places.append(s[top])
            found.append(v[top])
        flat = np.concatenate(places).astype(np.int64) if places else np.empty(0, dtype=np.int64)
        at = where[np.searchsorted(slot[where], flat)] if len(flat) else flat
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, dtype=np.int64)
        return pa.table([pa.array(cat(items)), doc.combine_chunks().take(pa.array(at)) if len(flat) else pa.array([], pa.int64()), pa.array(cat(found))], names=["item", "doc_id", "score"])

    return pick


def owner_of(df: Column, n_docs: Column) -> Column:
    owner = F.lit(len(OWNER_RARITY))
    for i, rarity in reversed(list(enumerate(OWNER_RARITY))):
        owner = F.when(df * rarity < n_docs, i).otherwise(owner)
    return owner


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = K, shard_docs: int = SHARD_DOCS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``k`` best documents of each item: (item_id, rank, doc_id, score).

    A term weighs floor(1000 ln((2N+2)/(2df+1))); a document of n terms adds weight * (10^9 tf div (1000 tf + 8 m)) for each
    different term of the item it holds, m = 10 + 90 n N div L. Only scores above 0 count; equal scores go by ascending doc_id.
    Null and empty texts have no terms: such a document counts nowhere, such an item has no rows. Repeated documents count and
    are ranked each; repeated items are one, items of one id and different texts are ranked apart. Null ids come last among
    equal scores. No documents or no items: no rows. Other columns are left out.
    """
    texts = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates()
    named = land(texts.withColumn("item", F.monotonically_increasing_id()))
    wanted = land(term_lists(named.select(F.col("item").alias("id"), "text")).select(F.col("id").alias("item"), F.explode("terms").alias("term")))
    # row numbers are fixed once they are written
    rows = land(term_lists(keyed(docs).select(F.col("doc_id").alias("id"), "text")).where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    n_docs, n_terms = int(total["docs"]), int(total["terms"])
    shards, blocks = max(1, -(-n_docs // shard_docs)), max(1, -(-named.count() // block_items))

    held = rows.select(F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    known = df.select("term", weight.alias("weight"), owner_of(F.col("df"), F.lit(n_docs)).alias("owner")).where("weight > 0")
    told = land(wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).join(known, "term"))

    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    slot = F.row_number().over(W.partitionBy("shard").orderBy(F.col("id").asc_nulls_last(), "row")) - 1
    placed = rows.withColumn("shard", shard).withColumn("slot", slot)
    size = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L")
    lists = placed.select("shard", "slot", size.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("shard", "slot", "m", "t.terms", "t.tfs")
    part = F.expr("(1000000000L * tfs) div (1000L * tfs + 8 * m)").cast("int")
    lists = lists.withColumnRenamed("terms", "term").join(told.select("block", "term", "owner").distinct(), "term")
    postings = land_by(lists.select("block", "shard", "slot", "term", part.alias("part"), "owner"), "owner")

    # weight and owner of a term in one number, the owner in the low three bits
    packed = F.array_sort(F.collect_list(F.struct("term", (F.col("weight") * 8 + F.col("owner")).alias("w"))))
    bundles = told.groupBy("block", "item").agg(packed.alias("t")).select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "item", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"),
        F.array().cast("array<int>").alias("slots"), F.array().cast("array<bigint>").alias("scores"))
    at = ["block", "shard"]
    for stage in range(len(OWNER_RARITY) + 1):
        owned = postings.where(F.col("owner") == stage).drop("owner")
        bundles = bundles.groupBy(*at).cogroup(owned.groupBy(*at)).applyInArrow(_owner(stage, k), BUNDLE)
    documents = placed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "slot", F.col("id").alias("doc_id"))
    best = bundles.groupBy(*at).cogroup(documents.groupBy(*at)).applyInArrow(_best(k), "item long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(DISTINCT doc_id) AS nn, count(*) AS ll FROM t),
d AS (SELECT doc_id, 100 - 90 + ((90 * count(*) * (SELECT nn FROM s)) // (SELECT ll FROM s)) AS m FROM t GROUP BY doc_id),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT nn FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p GROUP BY term),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark, sf_dir):
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
