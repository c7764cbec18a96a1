"""Benchmark passages in documents by a positional inverted index, with built-in functions only.

The index holds, for words that can decide (the rarest words of each benchmark window, by their count over all
documents), every place of the word. The lists of a window, each shifted by the word's offset in the window, are
intersected from the rarest word on; what is left is compared word by word with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm.base import KEY, join_documents, keyed, query, table
from statloom.sources.landing import land, landings

WINDOW, RAREST, SLOP = 10, 3, 4
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cased_words(text: Column) -> Column:
    """Runs of digits, letters and any character beyond ASCII, as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def small(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, SMALL)


def plain_words(text: Column) -> Column:
    return cased_words(small(text))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(body, o, words) for each ``window`` consecutive words of each different item text; o is the window's offset.

    A shorter item is one window, an empty one none.
    """
    words = benchmark_bodies(items).select("body", "ws").dropDuplicates(["body"])
    at = words.select("body", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - window))).alias("o"))
    return at.select("body", "o", F.slice("ws", F.col("o") + 1, F.lit(window)).alias("words"))


def benchmark_bodies(items: DataFrame) -> DataFrame:
    """(item_id, body, ws): items with words; ``body`` is a digest of the words, equal for items of equal words."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text").cast("string")).alias("ws")).where(F.size("ws") > 0)
    return words.select("item_id", F.sha2(F.array_join("ws", " "), 256).alias("body"), "ws")


def token_places(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc key, p, word) of all places of the words in ``vocabulary`` (column word).

    ``lower`` is cheap and never parts words that are equal after A-Z are lowered, so it selects; the few rows that it
    keeps are then compared exactly.
    """
    places = docs.select(*KEY, F.posexplode(cased_words(F.col("text"))).alias("p", "as_written"))
    wanted = vocabulary.select("word", F.lower("word").alias("low"))
    return places.withColumn("low", F.lower("as_written")).join(wanted, "low").where(small(F.col("as_written")) == F.col("word")).select(*KEY, "p", "word")


def window_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Where windows of ``items`` occur in keyed ``docs``: (phrases, near).

    ``phrases``: doc key, body, s (first word), k (words); every occurrence, exactly. ``near``: doc key, body of items of
    which as many deciding words as a window has stand within ``slop`` places of each other's position, exact or not.
    """
    windows = land(benchmark_windows(items, window))
    terms = windows.select("body", "o", F.posexplode("words").alias("i", "word"))
    counts = land(token_places(docs, land(terms.select("word").distinct())).groupBy("word").agg(F.count("*").alias("df")))
    # a window with a word that no document holds cannot occur
    held = terms.join(counts, "word", "left").groupBy("body", "o").agg(
        F.min(F.coalesce("df", F.lit(0))).alias("least"), F.slice(F.array_sort(F.collect_list(F.struct("df", "i", "word"))), 1, rarest).alias("top")
    ).where("least > 0")
    deciding = held.select("body", "o", F.size("top").alias("need"), F.explode("top").alias("t"))
    anchors = land(deciding.groupBy("body", F.col("t.word").alias("word"), (F.col("o") + F.col("t.i")).alias("at")).agg(F.min("need").alias("need")))
    # documents are dealt out once; from here on everything of a document is in one task, so lists are intersected there
    index = token_places(docs.repartition(*[F.col(c) for c in KEY]), land(anchors.select("word").distinct()))
    # each list is shifted by the word's offset in the item, so words in place meet at one start of the item
    shifted = index.join(anchors, "word").groupBy(*KEY, "body", (F.col("p") - F.col("at")).alias("d")).agg(F.count("*").alias("n"))
    least = land(anchors.groupBy("body").agg(F.min("need").alias("least")))
    block = F.floor(F.col("d") / (slop + 1)).cast("int")
    # words in place are near each other too: what is not met in a block is met nowhere
    met = shifted.select(*KEY, "body", F.struct("d", "n").alias("m"), F.explode(F.array(block, block + 1)).alias("block"))
    met = land(met.groupBy(*KEY, "body", "block").agg(F.collect_list("m").alias("ms"), F.sum("m.n").alias("n")).join(least, "body").where("n >= least"))
    near = met.select(*KEY, "body").distinct()
    starts = met.select(*KEY, "body", "least", F.explode("ms").alias("m")).where("m.n >= least").select(*KEY, "body", "m.d").distinct()
    lists = land(starts.groupBy(*KEY).agg(F.collect_list(F.struct("body", "d")).alias("found")))
    there = join_documents(docs.dropDuplicates(KEY), lists, "inner").select(*KEY, plain_words(F.col("text")).alias("ws"), "found")
    # of the text only the stretch that the item can cover is kept, with the place where it starts
    longest = windows.groupBy("body").agg((F.max("o") + F.max(F.size("words"))).alias("long"))
    stretch = there.select(*KEY, "ws", F.explode("found").alias("f")).select(*KEY, "ws", "f.body", "f.d").join(longest, "body")
    low = F.greatest(F.lit(0), F.col("d"))
    stretch = stretch.select(*KEY, "body", "d", low.alias("low"), F.slice("ws", low + 1, F.greatest(F.lit(0), F.col("d") + F.col("long") - low)).alias("part"))
    placed = land(stretch).join(windows, "body").withColumn("s", F.col("d") + F.col("o")).where("s >= 0")
    exact = placed.where(F.slice("part", F.col("s") - F.col("low") + 1, F.size("words")) == F.col("words"))
    return exact.select(*KEY, "body", "s", F.size("words").alias("k")).distinct(), near


def contaminated_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark text in each document.

    Returns per row: doc_id, _rk, n_words, n_hit (words inside an occurrence of a window), n_items, item_ids (sorted as
    strings), n_near (items met only by proximity), contaminated. A null or wordless text has no words and no hits;
    items without words match nothing; equal items are all reported; repeated rows get equal answers; empty tables give
    no rows or no hits; null item ids count as no item. Other columns are left out.
    """
    with landings() as own:
        out = _reported(keyed(docs), items, window, own)
        own.only(out)
        return out


def _reported(docs: DataFrame, items: DataFrame, window: int, own) -> DataFrame:
    phrases, near = window_matches(docs, items, window)
    phrases = land(phrases)
    own.only(phrases, near)
    hit = phrases.select(*KEY, F.explode(F.sequence(F.col("s"), F.col("s") + F.col("k") - 1)).alias("p")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    found = phrases.select(*KEY, "body").distinct()
    ids = found.join(benchmark_bodies(items).select("body", "item_id"), "body").where("item_id IS NOT NULL").select(*KEY, "item_id").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    loose = near.join(found, [*[near[c].eqNullSafe(found[c]) for c in KEY], near.body == found.body], "left_anti").groupBy(*KEY).agg(F.count("*").alias("n_near"))
    per = None
    names = ("n_hit", "item_ids", "n_near")
    for f, name in zip((hit, ids, loose), names, strict=True):
        rows = f.select(*KEY, *[(F.col(name) if n == name else F.lit(None).cast("array<string>" if n == "item_ids" else "bigint")).alias(n) for n in names])
        per = rows if per is None else per.unionByName(rows)
    per = land(per.groupBy(*KEY).agg(*[F.max(n).alias(n) for n in names]))
    out = join_documents(docs.select(*KEY, F.size(cased_words(F.col("text"))).cast("bigint").alias("n_words")), per)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        *KEY, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("n_near", F.lit(0)).alias("n_near"), (n_hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, columns as they are, in which no window of ``items`` occurs."""
    with landings() as own:
        report = land(contaminated_documents(docs, items, window).where("contaminated").select("doc_id", "_rk").distinct())
        own.only(report)
    digest = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.alias("d").withColumn("_digest", digest)
    return rows.join(report.alias("r"), (F.col("_digest") == F.col("r._rk")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left_anti").drop("_digest")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
w AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, array_to_string(ws[i:i+9], ' ') AS g, least(len(ws), 10) AS k
      FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM w),
p AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
m AS (SELECT p.doc_id, p.i, p.k, w.item_id FROM p JOIN w ON p.g = w.g AND p.k = w.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op4_benchmark_decontamination", OP4_SQL)
def op4(spark, sf_dir):
    found = contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
