"""Lines that too many documents hold, with built-in functions only: levelled sorted runs of line digests.

A run is a table (h, n) of line digests and numbers of documents, bucketed and sorted by h. A batch of documents is merged
with the runs bucket by bucket: lines that a run already knows to be common are anti-joined away, the rest becomes a run of
its own. When a level has ``fanout`` runs they are added up into one run of the next level, so a batch meets a logarithmic
number of runs and a line is rewritten once a level. The runs stay where they are; only the batch is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statloom.llm.base import KEY, keyed, land_by, query, same_document, table
from statloom.llm.decontaminate import SMALL, UPPER
from statloom.session import ensure_checkpoint_dir
from statloom.sources.landing import land

BLANKS = " \t\n\x0b\x0c\r"
LINE_DOCS, LEAST_CHARS = 10, 1
BATCHES, FANOUT = 4, 2
#: a line is hot if it has this share of all (document, line) pairs: at most 1 / HOT_SHARE lines of a batch can be
HOT_SHARE = 0.001


def small_ascii(text: Column) -> Column:
    """A-Z lowered, other letters as they are; texts of ASCII letters only take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, SMALL))


def line_digest(line: Column, least_chars: int = LEAST_CHARS) -> Column:
    """64-bit digest of a line's key; null for a key that is shorter than ``least_chars``."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.char_length(key) >= least_chars, F.xxhash64(small_ascii(key)))


class LineRuns:
    """Counts of documents per line over batches, in levelled sorted runs below ``spark.checkpoint.dir``.

    ``limit``: documents from which a line is common; it needs no more counting then. With ``limit=1`` a batch's own run
    holds just the lines that no earlier batch had. ``buckets``: parts of a run, all of the same hash.
    """

    def __init__(self, spark: SparkSession, limit: int = LINE_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        ensure_checkpoint_dir(spark)
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0
        folder = f"{spark.sparkContext.getCheckpointDir()}/{self.database}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{folder}'")

    def _write(self, rows: DataFrame) -> str:
        self.written += 1
        name = f"{self.database}.run_{self.written}"
        parts = rows.select("h", "n").repartition(self.buckets, "h").sortWithinPartitions("h")
        parts.write.bucketBy(self.buckets, "h").sortBy("h").option("compression", "zstd").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def without_common(self, own: DataFrame) -> DataFrame:
        """``own`` merge-anti-joined with every run: lines known to be common leave it."""
        for name in self.runs():
            settled = self.spark.table(name).where(F.col("n") >= self.limit).select("h")
            own = own.join(settled.hint("merge"), "h", "left_anti")
        return own

    def add(self, own: DataFrame) -> None:
        """Take in a batch's (h, n), one row per line."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(self.without_common(own)))
        self._compact()

    def _summed(self, names: list[str]) -> DataFrame:
        """Runs merged one after the other, smaller levels first; two runs meet where they lie, without a shuffle.

        Merge joins, not a union: a union of columnar scans puts their parts one behind the other, though it states
        the partitioning that they share, and a sum by line over it would miss the lines that stand in two runs.
        """
        rows = self.spark.table(names[0])
        for name in names[1:]:
            n = F.coalesce("l.n", F.lit(0)) + F.coalesce("r.n", F.lit(0))
            rows = rows.alias("l").join(self.spark.table(name).alias("r").hint("merge"), "h", "full_outer").select("h", n.alias("n"))
        return rows

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            full = self.levels[k]
            if len(full) < self.fanout:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self._summed(full)))
            self.levels[k] = []
            for name in full:
                self.spark.sql(f"DROP TABLE {name}")

    def common(self) -> DataFrame:
        """(h): lines of at least ``limit`` documents over all batches."""
        return self._summed(self.runs()).where(F.col("n") >= self.limit).select("h")

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")


def without_common_lines(docs: DataFrame, line_docs: int = LINE_DOCS, least_chars: int = LEAST_CHARS,
                         batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Each document without the lines that ``line_docs`` documents or more hold.

    A line is known by its key: white space stripped at both ends, A-Z lowered; shorter keys than ``least_chars`` are no
    lines to count. Returns per row: doc_id, _rk, n_lines, n_dropped, text_left. Documents come in ``batches`` of their
    digests. A null or empty text is one empty line; repeated rows count as documents of their own and get equal answers;
    a null id is an id like others; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    lines = F.split("text", "\n")
    digests = F.transform(lines, lambda line: line_digest(line, least_chars))
    seen = land_by(docs.select(*KEY, digests.alias("hs"), F.pmod("_rk", F.lit(batches)).cast("int").alias("batch")), "batch")
    runs, hot = LineRuns(spark, line_docs, fanout), []
    for b in range(batches):
        mine = seen.where(F.col("batch") == b)
        held = mine.select(F.explode(F.array_distinct(F.filter("hs", lambda h: h.isNotNull()))).alias("h"))
        own = land(held.groupBy("h").agg(F.count("*").alias("n")))
        total = own.agg(F.sum("n").alias("n")).scalar()
        hot.append(own.where(F.col("n") >= HOT_SHARE * total).select("h"))
        runs.add(own)
    common = land(runs.common())
    runs.close()
    places = seen.select(*KEY, F.posexplode("hs").alias("p", "h")).where("h IS NOT NULL")
    # what is hot over all batches is hot in one of them: at most batches / HOT_SHARE digests, so this side is sent to all
    spread = hot[0]
    for part in hot[1:]:
        spread = spread.unionByName(part)
    spread = F.broadcast(land(spread.distinct().join(common.withColumn("common", F.lit(True)), "h", "left").select("h", F.coalesce("common", F.lit(False)).alias("common"))))
    told = places.join(spread, "h", "left")
    lost = told.where("common").select(*KEY, "p").unionByName(
        told.where("common IS NULL").select(*KEY, "p", "h").join(common.hint("merge"), "h", "left_semi").select(*KEY, "p"))
    lost = lost.groupBy(*KEY).agg(F.collect_set("p").alias("lost"))
    # the array crosses the exchange, so a line is looked up by its place below, not split again
    both = docs.select(*KEY, lines.alias("lines")).alias("l").join(lost.hint("merge").alias("r"), same_document("l", "r"), "left").select("l.*", "r.lost")
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("lost", F.array().cast("array<int>")))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(left, lambda p: F.get("lines", p)))
    return both.select(*KEY, n.cast("bigint").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"), F.array_join(kept, "\n").alias("text_left"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, p, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON c.key = k.key GROUP BY doc_id
"""


@query("op13_line_runs", OP13_SQL)
def op13(spark, sf_dir):
    found = without_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text_left", 256).alias("kept_sha256"))
