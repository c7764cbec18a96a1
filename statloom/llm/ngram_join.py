"""Similarity join on word shingles: prefix filters under several global token orders, then exact verification.

Two sets with Jaccard similarity t or more share a token among the first ``n - ceil(t*n) + 1`` tokens of each, whatever
global order the tokens are put in. Order A puts tokens that many sets hold last and finds candidates through posting
lists; it begins with the tokens that neighbouring rows share and is mended by exact counts over the prefixes of all sets:
what several of them hold goes last, and the prefixes made anew are counted again. Orders B (digests descending) and C (digests read as unsigned
numbers) must agree before a pair is verified. Every set also carries a parity sketch: the bits in which two sketches
differ are at most the tokens that only one of the sets holds, so most pairs end inside the join of a list and are never
written.

Documents with equal sets are one vertex from the start. Large groups of near copies are brought together first: a vertex
is compared with one leader among those that share its first token under each of a few orders. All pairs of a posting
list are then formed only between vertices that are not yet together, so a list of n near copies costs about n
comparisons and no link between different groups is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm import arrays as A
from statloom.llm.base import keyed, query, table
from statloom.llm.sieve import passes, sieve_of, sieves_of
from statloom.sources.landing import land, landings

SHINGLE, PERCENT = 5, 80
WORDS = 8  # of 64 bits in a parity sketch
FIRSTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=A.U)
LEVELS = (2, 6, 24, 100)  # a token found in so many prefixes moves one place back in order A
SPREAD = 1_500_000
ROUNDS = 3  # of comparisons with leaders at most; what they leave is looked at pair by pair


def token_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle digests of all rows, one row after the other, and where each row begins and the last ends.

    Fewer words than a shingle make one token, no words none. Only the sorting goes row by row.
    """
    data = A.LOWER[data]
    start, end, first = A.words(data, off)
    digests = A.Digests(A.word_digests(data, start, end))
    n = np.diff(first)
    rolled = digests.rolling(size).view(np.int64)
    short = digests.of(first[:-1], first[1:]).view(np.int64)
    held = np.where(n >= size, n - size + 1, n > 0)
    at = np.concatenate([[0], np.cumsum(held)])
    row = np.repeat(np.arange(len(n)), held)
    few = n[row] < size
    tokens = np.empty(len(row), dtype=np.int64)
    tokens[few] = short[row[few]]
    tokens[~few] = rolled[(np.arange(len(row)) - at[row] + first[row])[~few]]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        tokens[a:b].sort()
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    return tokens[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])


def _per_row(what: np.ufunc, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each row that has any values."""
    return what.reduceat(values, at[:-1][at[1:] > at[:-1]]) if len(values) else values


def _set_names(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The name of each row's set; 0 without tokens."""
    t, k = tokens.view(A.U), np.diff(at)
    out = np.zeros(len(k), dtype=np.int64)
    total = _per_row(np.add, t, at) + k[k > 0].astype(A.U) * A.U(A.BASE)
    out[k > 0] = A.mix(total ^ _per_row(np.bitwise_xor, A.mix(t), at)).view(np.int64)
    return out


def _sketches(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens per slot, packed into ``WORDS`` numbers, for each row."""
    rows = len(at) - 1
    slots = (A.mix(tokens.view(A.U) ^ FIRSTS[0]) & A.U(64 * WORDS - 1)).astype(np.int64)
    slots += np.repeat(np.arange(rows) * (64 * WORDS), np.diff(at))
    return np.packbits((np.bincount(slots, minlength=rows * 64 * WORDS) & 1).astype(np.uint8)).view(np.int64).reshape(rows, WORDS)


def _firsts(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first token under each of a few orders, for each row that has any."""
    t, k = tokens.view(A.U), np.diff(at)
    out = np.empty((int((k > 0).sum()), len(FIRSTS)), dtype=np.int64)
    for i, c in enumerate(FIRSTS):
        mixed = A.mix(t ^ c)
        out[:, i] = tokens[mixed == np.repeat(_per_row(np.minimum, mixed, at), k[k > 0])]
    return out


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _some_rows(tokens: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the rows kept, and how many each of them has."""
    k = np.diff(at)
    return tokens[np.repeat(keep, k)], k[keep]


def _first_of_each(names: np.ndarray) -> np.ndarray:
    """True at the first place of each name."""
    out = np.zeros(len(names), dtype=bool)
    out[np.unique(names, return_index=True)[1]] = True
    return out


MEMBER = "doc_id bigint, _rk bigint, n bigint, v bigint, sketch array<bigint>, firsts array<bigint>, token bigint"


def _members(size: int) -> Callable:
    """Per row its vertex, and what is compared before sets are; as rows of another kind, tokens that several sets of a
    run of ``SPREAD`` tokens hold, and how many."""

    def shared(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, held = np.unique(np.concatenate(sets), return_counts=True)
        some = held >= 2
        if some.any():
            none, lists = pa.nulls(int(some.sum()), pa.int64()), pa.nulls(int(some.sum()), pa.list_(pa.int64()))
            columns = [none, none, pa.array(held[some].astype(np.int64)), none, lists, lists, pa.array(tokens[some])]
            yield pa.record_batch(columns, names=["doc_id", "_rk", "n", "v", "sketch", "firsts", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in batches:
            for a, b, data, off in A.text_slices(batch.column("text")):
                tokens, bounds = token_sets(data, off, size)
                k = np.diff(bounds)
                waiting.append(tokens)
                if sum(map(len, waiting)) >= SPREAD:
                    yield from shared(waiting)
                    waiting = []
                at = pa.array(np.arange(a, b))
                yield pa.record_batch(
                    [batch.column("doc_id").take(at), batch.column("_rk").take(at), pa.array(k, pa.int64()),
                     pa.array(_set_names(tokens, bounds)), _lists(_sketches(tokens, bounds)[k > 0].ravel(), WORDS * (k > 0)),
                     _lists(_firsts(tokens, bounds).ravel(), len(FIRSTS) * (k > 0)), pa.nulls(b - a, pa.int64())],
                    names=["doc_id", "_rk", "n", "v", "sketch", "firsts", "token"],
                )
        if waiting:
            yield from shared(waiting)

    return run


def _wanted(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    """Rows whose digest passes the sieve ``rows``: one text of each vertex is enough."""
    for batch in batches:
        kept = batch.filter(pa.array(passes(rows.value, np.asarray(batch.column("_rk")))))
        if kept.num_rows:
            yield kept


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _postings(size: int, percent: int, rows, later: list, only=None) -> Callable:
    """Prefix tokens in order A of the wanted rows; with ``only`` just those that pass it.

    ``later`` holds one sieve per level: a token goes behind the others by the number of sieves that it passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _wanted(batches, rows):
            for _, _, data, off in A.text_slices(batch.column("text")):
                tokens, at = token_sets(data, off, size)
                names, k = _set_names(tokens, at), np.diff(at)
                keep = _first_of_each(names) & (k > 0)
                tokens, k = _some_rows(tokens, at, keep)
                row = np.repeat(np.arange(len(k)), k)
                if later:
                    rank = row * (len(later) + 1)
                    for level in later:
                        rank += passes(level.value, tokens)
                    tokens = tokens[np.argsort(rank, kind="stable")]
                place = np.arange(len(tokens)) - (np.cumsum(k) - k)[row]
                head = place < prefix_length(k, percent)[row]
                if only is not None:
                    head &= passes(only.value, tokens)
                if head.any():
                    yield pa.record_batch(
                        [pa.array(tokens[head]), pa.array(names[keep][row[head]]), pa.array(k[row[head]].astype(np.int32))], names=["t", "v", "n"],
                    )

    return run


def _sets(size: int, rows) -> Callable:
    """Sets of the wanted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _wanted(batches, rows):
            for _, _, data, off in A.text_slices(batch.column("text")):
                tokens, at = token_sets(data, off, size)
                names = _set_names(tokens, at)
                keep = _first_of_each(names)
                yield pa.record_batch([pa.array(names[keep]), _lists(*_some_rows(tokens, at, keep))], names=["v", "tokens"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``links`` (a, b): the smallest vertex reachable. Labels jump, so rounds stay few."""
    with landings() as own:
        both = land(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = land(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
        while True:
            near = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("l"))
            low = labels.join(near, "v").select("v", "label", F.least("label", "l").alias("low"))
            jump = labels.select(F.col("v").alias("low"), F.col("label").alias("next"))
            new = land(low.join(jump, "low", "left").select("v", F.col("label").alias("old"), F.least("low", F.coalesce("next", "low")).alias("label")))
            labels = new.select("v", "label")
            own.only(both, labels)
            if new.where("old <> label").isEmpty():
                own.only(labels)
                return labels


def _head(n: str, percent: int) -> Column:
    return F.col(n) - F.ceil(percent * F.col(n) / 100).cast("int") + 1


def _bucket(n: str, percent: int) -> Column:
    """Sizes of linked sets lie in one bucket or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / math.log(101 / percent)).cast("int")


def _prefix(tokens: str, n: str, order: str, percent: int) -> Column:
    """The prefix of a sorted token array: from its end (B), or from the first token that is not negative (C)."""
    p = F.expr(f"{n} - CAST(ceil({percent} * {n} / 100) AS INT) + 1")
    t = F.col(tokens)
    if order == "B":
        return F.slice(t, F.greatest(F.lit(1), F.col(n) - p + 1), p)
    head = F.size(F.filter(t, lambda x: x < 0))
    return F.slice(F.concat(F.slice(t, head + 1, F.greatest(F.lit(1), F.col(n))), t), F.lit(1), p)


def verified(pairs: DataFrame, texts: DataFrame, vertices: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that pass the filters of orders B and C and whose sets are similar enough.

    Sets are made again from one text of each vertex of ``pairs`` and landed once. The filters read prefixes; whole sets
    are joined to the pairs left.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    wanted = land(vertices.select("v", "_rk").join(ends, "v", "left_semi"))
    rows = sieve_of(wanted, "_rk")
    sets = texts.mapInArrow(_sets(size, rows), "v bigint, tokens array<bigint>")
    sets = land(sets.join(wanted.select("v"), "v", "left_semi").dropDuplicates(["v"]))
    rows.destroy()
    sized = sets.withColumn("n", F.size("tokens"))
    heads = sized.select("v", *[_prefix("tokens", "n", order, percent).alias(order) for order in ("B", "C")])
    both = pairs.select("a", "b").join(heads.toDF("a", "Ba", "Ca"), "a").join(heads.toDF("b", "Bb", "Cb"), "b")
    both = land(both.where(F.arrays_overlap("Ba", "Bb") & F.arrays_overlap("Ca", "Cb")).select("a", "b"))
    both = both.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    both = both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.size("ta") + F.size("tb") - F.col("shared")))
    return both.select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("v"))
    return rows.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))


def _may_link(percent: int) -> Column:
    """Sizes and sketches of (n, sketch) and (m, other) allow the similarity asked for, and labels differ."""
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other")[i])) for i in range(WORDS)), F.lit(0))
    return (
        (F.col("label") != F.col("ul")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")))
    )


def _known(*frames: DataFrame | None) -> list[DataFrame]:
    return [df for df in frames if df is not None]


def _several_labels(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of the groups in which there is more than one label."""
    open_groups = rows.groupBy(*key).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(*key)
    return rows.join(open_groups, list(key), "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()


def led_together(vertices: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (a, b) found by comparing each vertex with leaders, and their components; few rows per vertex, so large groups cost little."""
    links, labels = None, None
    with landings() as own:
        keys = land(vertices.select("v", "n", "sketch", F.posexplode("firsts").alias("i", "t")))
        for turn in range(ROUNDS):
            now = land(_several_labels(_labelled(keys, labels), "i", "t"))
            order = F.xxhash64(F.col("v"), F.lit(turn))
            lead = now.groupBy("i", "t").agg(F.min_by(F.struct("v", "n", "label", "sketch"), order).alias("x"))
            lead = lead.select("i", "t", F.col("x.v").alias("u"), F.col("x.n").alias("m"), F.col("x.label").alias("ul"), F.col("x.sketch").alias("other"))
            pairs = now.join(lead, ["i", "t"]).where(_may_link(percent))
            pairs = land(_ordered(pairs.groupBy("v").agg(F.min_by("u", F.xxhash64("u", F.lit(turn))).alias("u"))))
            if pairs.isEmpty():
                break
            new = land(verified(pairs, texts, vertices, size, percent))
            if new.isEmpty():
                break
            links = new if links is None else links.union(new)
            labels = components(links)
            own.only(keys, links, labels)
        own.only(*_known(links, labels))
    return links, labels


def linked_vertices(lists: DataFrame, vertices: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Labels of all vertices that have a link; ``lists`` (t, b, v) are landed posting lists with several vertices.

    The shared prefix tokens of a pair are counted: the overlap of two sets is at most that count and what is left of the
    longer rest behind the prefixes, so of the pairs that sketches let through most end there.
    """
    with landings() as own:
        links, labels = led_together(vertices, texts, size, percent)
        out = _all_linked(lists, vertices, texts, links, labels, size, percent, own)
        own.only(*_known(out))
        return out


def _all_linked(lists: DataFrame, vertices: DataFrame, texts: DataFrame, links, labels, size: int, percent: int, own) -> DataFrame | None:
    named = _labelled(vertices.select("v", "n", "sketch"), labels)
    open_lists = land(_several_labels(lists.join(named.select("v", "label"), "v"), "t", "b").select("t", "b", "v"))
    now = land(open_lists.join(named, "v"))
    own.only(now, *_known(links, labels))
    other = now.select("t", "b", F.col("v").alias("u"), F.col("n").alias("m"), F.col("label").alias("ul"), F.col("sketch").alias("other"))
    # both ends of a pair meet in the list of the larger bucket, and perhaps in another, where they do not count
    meet = F.col("b") == F.greatest(_bucket("n", percent), _bucket("m", percent))
    pairs = now.join(other, ["t", "b"]).where((F.col("v") < F.col("u")) & meet & _may_link(percent))
    rest = F.greatest(F.col("n") - _head("n", percent), F.col("m") - _head("m", percent))
    enough = (100 + percent) * (F.col("k") + rest) >= percent * (F.col("n") + F.col("m"))
    pairs = pairs.groupBy("v", "u").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m")).where(enough)
    pairs = land(_ordered(pairs.select("v", "u")))
    own.only(pairs, *_known(links, labels))
    if pairs.isEmpty():
        return labels
    new = land(verified(pairs, texts, vertices, size, percent))
    if new.isEmpty():
        return labels
    return components(new if links is None else links.union(new))


def posting_lists(texts: DataFrame, rows, nearby: DataFrame, size: int, percent: int) -> DataFrame:
    """Landed lists (t, b, v) with several vertices, from the prefixes of all sets in order A.

    The order begins with ``nearby`` (t, k), tokens that neighbouring rows share, and is mended by counts over all rows.
    """
    shape = "t bigint, v bigint, n int"
    levels = [f"k >= {k}" for k in LEVELS]
    with landings() as own:
        later = sieves_of(nearby, "t", *levels)
        for turn in range(2):
            counted = texts.mapInArrow(_postings(size, percent, rows, later), shape).groupBy("t").agg(F.count("*").alias("k"))
            many = land(counted.where(levels[0]))
            if turn == 0:
                later = later + sieves_of(many, "t", *levels)
        own.only(many)
        # tokens of one set only are most of all: they are found by counting and not moved again
        only = sieve_of(many, "t")
        lists = texts.mapInArrow(_postings(size, percent, rows, later, only), shape).join(many.select("t"), "t", "left_semi")
        lists = land(lists.dropDuplicates(["t", "v"]).withColumn("b", F.explode(F.array(_bucket("n", percent), _bucket("n", percent) + 1))))
        own.only(lists)
        for sieve in (*later, only):
            sieve.destroy()
        several = land(lists.groupBy("t", "b").agg(F.count("*").alias("k")).where("k > 1").select("t", "b"))
        out = land(lists.join(several, ["t", "b"], "left_semi").select("t", "b", "v"))
        own.only(out)
        return out


def shingle_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by ``percent`` / 100 Jaccard similarity of their sets of ``size``-word shingles.

    Returns per row: doc_id, _rk, n_shingles, group (a name of the group, null without shingles), component_id (the
    smallest doc_id reachable).
    Words are split at ASCII white space after A-Z are lower-cased. A null or wordless text has no shingle and is linked
    with nothing; fewer words than a shingle make one. Repeated rows share a class. A null doc_id belongs to its group
    but never names it; alone it has a null component_id. An empty table gives no rows; other columns are left out.
    """
    with landings() as own:
        out = _classed(keyed(docs), size, percent, own)
        own.only(out)
        return out


def _classed(docs: DataFrame, size: int, percent: int, own) -> DataFrame:
    first = land(docs.select("doc_id", "_rk", "text").mapInArrow(_members(size), MEMBER))
    members = first.where("v IS NOT NULL")
    nearby = land(first.where("token IS NOT NULL").groupBy(F.col("token").alias("t")).agg(F.sum("n").alias("k")))
    vertices = members.where("n > 0").groupBy("v").agg(
        F.min("doc_id").alias("low"), F.min("_rk").alias("_rk"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("firsts").alias("firsts")
    )
    vertices = land(vertices)
    texts = docs.select("_rk", "text")
    rows = sieve_of(vertices, "_rk")
    lists = posting_lists(texts, rows, nearby, size, percent)
    rows.destroy()
    own.only(first, vertices, lists)
    classes = _labelled(vertices.select("v", "low"), linked_vertices(lists, vertices, texts, size, percent))
    smallest = classes.groupBy("label").agg(F.min("low").alias("low"))
    named = land(classes.select("v", "label").join(smallest, "label").select("v", "label", F.col("low").alias("component_id")))
    return members.join(named, "v", "left").select(
        "doc_id", "_rk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).alias("group"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, columns as they are, with one row left of each group: its smallest doc_id, then digest.

    Rows without shingles are linked with nothing and all stay. Of rows that repeat id and text one stays.
    """
    with landings() as own:
        out = _one_of_each(docs, shingle_components(docs, size, percent), own)
        own.only(out)
        return out


def _one_of_each(docs: DataFrame, found: DataFrame, own) -> DataFrame:
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_rk")).alias("k")).select("k.doc_id", "k._rk")
    chosen = first.withColumn("_lone", F.lit(False)).unionByName(found.where("group IS NULL").select("doc_id", "_rk").distinct().withColumn("_lone", F.lit(True)))
    chosen = land(chosen).withColumnsRenamed({"doc_id": "_kept_id", "_rk": "_kept_rk"})
    own.only(chosen)
    digest = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn("_digest", digest).join(chosen, (F.col("_digest") == F.col("_kept_rk")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")))
    rows = land(rows.drop("_kept_id", "_kept_rk"))
    # rows that repeat id and text: where there are any, one of them stays
    again = land(rows.where("NOT _lone").groupBy("_digest").agg(F.count("*").alias("k")).where("k > 1").select("_digest"))
    single = rows.join(again, "_digest", "left_anti")
    repeated = rows.join(again, "_digest", "left_semi")
    kept = repeated.where("_lone").unionByName(repeated.where("NOT _lone").dropDuplicates(["doc_id", "_digest"]))
    return single.unionByName(kept).select(*docs.columns)


@query("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    return shingle_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
