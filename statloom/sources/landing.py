"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from statloom.session import ensure_checkpoint_dir

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WEIGHED = "spark.sql.execution.arrow.maxBytesPerBatch"


class Landings:
    """Folders of the tables landed in a ``landings`` block."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []

    def only(self, *frames: DataFrame) -> None:
        """Remove the tables of the block that none of ``frames`` reads; other frames made of them end here.

        Spark tells which files a frame reads, scalar subqueries left out: join their tables instead.
        """
        read = {x for df in frames for f in df.inputFiles() for x in re.findall(r"landed-[0-9a-f]{32}", f)}
        kept = []
        for spark, path in self.tables:
            if path.rsplit("/", 1)[-1] in read:
                kept.append((spark, path))
            else:
                jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        self.tables = kept


_OPEN: ContextVar[Landings | None] = ContextVar("landings", default=None)


@contextmanager
def landings() -> Iterator[Landings]:
    """A block that knows the tables landed in it, so that ``only`` can remove them; what it leaves passes to the block around."""
    own, around = Landings(), _OPEN.get()
    token = _OPEN.set(own)
    try:
        yield own
    finally:
        _OPEN.reset(token)
        if around is not None:
            around.tables += own.tables


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go with its end; they stay until the driver's garbage collection otherwise."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


@contextmanager
def unweighed(spark: SparkSession) -> Iterator[None]:
    """Arrow batches inside are bounded by their number of rows alone: for rows of few bytes, where Spark's look at the size of a
    batch after each row takes longer than the row. Frames must be run inside."""
    before = spark.conf.get(WEIGHED, None)
    spark.conf.set(WEIGHED, str(2**31 - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(WEIGHED)
        else:
            spark.conf.set(WEIGHED, before)


def land(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The lineage is cut, a lost executor only re-reads files, and from here on
    Spark knows the size of the files, which may be far less than that of the rows: a
    frame of many rows is no side for a broadcast, however small its files are. Columns
    derived from task numbers are now fixed. Shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"
    own = _OPEN.get()
    if own is not None:
        own.tables.append((spark, path))
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores: a small file of many rows is one task otherwise, whatever is made of each row."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
