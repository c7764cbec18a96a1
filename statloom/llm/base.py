"""Document identity, landed stages and the query registry of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statloom.session import ensure_checkpoint_dir

KEY = ["doc_id", "_rk"]
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, BATCH_BYTES = 2_000, 2 << 20  # more only fills buffers on both sides of a task; a longer text is a batch of its own


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = LlmQuery(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id``, a digest ``_rk`` of id and text, the text (null: empty) and the named columns.

    A document is known by both keys, so rows that share an id but not a text stay apart, and rows that repeat
    both get the same answer each. Other columns, whatever their names, are left behind. Arrow batches of the session are
    lowered to ``BATCH_ROWS`` rows where they are larger, and end at ``BATCH_BYTES`` bytes unless the session sets its own bound.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS, "10000")) <= BATCH_ROWS:
        conf.set(ARROW_ROWS, str(BATCH_ROWS))
    if conf.get(ARROW_BYTES, None) is None:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("_rk"),
        *[F.col(c) for c in extra],
    )


def same_document(left: str, right: str) -> Column:
    return (F.col(f"{left}._rk") == F.col(f"{right}._rk")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def join_documents(docs: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """``docs`` with the columns of ``found``, which has one row per document key."""
    extra = [c for c in found.columns if c not in KEY]
    joined = docs.alias("l").join(found.alias("r"), same_document("l", "r"), how)
    if how == "left_semi":
        return joined
    return joined.select("l.*", *[F.col(f"r.{c}").alias(c) for c in extra])


def land_by(df: DataFrame, column: str) -> DataFrame:
    """As ``land``, in one folder for each of a few values of ``column``: a filter on it reads that folder alone."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
