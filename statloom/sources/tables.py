"""Cleaned tables, reference tables and run artefacts on a shared file system.

Layout: ``<root>/<publisher>/<sheet_id>.parquet`` (a file or a Spark folder).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from statloom.functions.nulls import nan_to_null


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _children(spark: SparkSession, path: str) -> list[str]:
    if not _exists(spark, path):
        return []
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)
    return sorted(s.getPath().getName() for s in listed)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet table with NaN turned into NULL, or None if it is not there."""
    if not _exists(spark, path):
        return None
    return nan_to_null(spark.read.parquet(path))


def table_path(root: str, publisher: str, sheet_id: str) -> str:
    return f"{root.rstrip('/')}/{publisher}/{sheet_id}.parquet"


def load_table(spark: SparkSession, root: str, publisher: str, sheet_id: str) -> DataFrame | None:
    return read_optional(spark, table_path(root, publisher, sheet_id))


def load_metadata(spark: SparkSession, root: str, publisher: str, sheet_id: str) -> DataFrame | None:
    """Rows found above the header of one table."""
    path = f"{root.rstrip('/')}/{publisher}/{sheet_id}__metadata.csv"
    return spark.read.csv(path) if _exists(spark, path) else None


def table_ids(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(publisher, sheet_id) of every table below ``root`` — names only."""
    found = []
    for publisher in _children(spark, root):
        for name in _children(spark, f"{root}/{publisher}"):
            if name.endswith(".parquet"):
                found.append((publisher, name[: -len(".parquet")]))
    return found


def _width(spark: SparkSession, path: str) -> int:
    """Columns of a table from one Parquet footer; a partitioned table is asked for its schema."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [n for n in _children(spark, path) if not n.startswith(("_", "."))]
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(conf).getFileStatus(jpath).isFile():
        if not files or not files[0].endswith(".parquet"):
            return len(spark.read.parquet(path).columns)
        jpath = jvm.org.apache.hadoop.fs.Path(f"{path}/{files[0]}")
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jpath, conf))
    try:
        return reader.getFileMetaData().getSchema().getFieldCount()
    finally:
        reader.close()


def catalog(spark: SparkSession, root: str, publisher: str | None = None) -> DataFrame:
    """(publisher, sheet_id, n_rows, n_cols, has_metadata), one row per table, of one publisher or all.

    One scan over the files of all tables counts their rows; it reads no column, only footers and file names. A row belongs
    to the table in whose path its file lies. Only names and widths, one of each per table, are gathered before.
    """
    schema = "publisher string, sheet_id string, _path string, n_cols int, has_metadata boolean"
    root = root.rstrip("/")
    ids = [(p, t) for p, t in table_ids(spark, root) if publisher in (None, p)]
    if not ids:
        return spark.createDataFrame([], schema).select("publisher", "sheet_id", F.lit(0).cast("bigint").alias("n_rows"), "n_cols", "has_metadata")

    def address(path: str) -> str:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toUri().toString()

    def parts_of(path: Column) -> Column:
        return F.split(F.regexp_replace(path, "^[^/:]+:/+", "/"), "/")

    depth = address(root).split(":", 1)[-1].strip("/").count("/") + 1
    known = [(p, t, address(table_path(root, p, t)), _width(spark, table_path(root, p, t)), _exists(spark, f"{root}/{p}/{t}__metadata.csv")) for p, t in ids]
    tables = spark.createDataFrame(known, schema).withColumn("_at", F.array_join(parts_of(F.col("_path")), "/"))
    files = spark.read.schema("_none int").option("recursiveFileLookup", "true").parquet(*[table_path(root, p, t) for p, t in ids])
    at = F.array_join(F.slice(parts_of(F.col("_metadata.file_path")), 1, depth + 3), "/")
    counts = files.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("n_rows"))
    return tables.join(counts, "_at", "left").select("publisher", "sheet_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_cols", "has_metadata")


def latest_run(spark: SparkSession, root: str) -> str | None:
    """Run folder with the greatest name."""
    runs = _children(spark, root)
    return runs[-1] if runs else None


def latest_run_rows(runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Rows of the greatest run in a run-partitioned table (partition pruned at run time)."""
    return runs.where(F.col(run_id) == runs.agg(F.max(run_id).alias("r")).scalar())


def load_artifact(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV (with header) or JSON artefact of a run."""
    if not _exists(spark, path):
        return None
    if path.endswith(".json"):
        return spark.read.option("multiLine", "true").json(path)
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)


def reference_csv(spark: SparkSession, path: str, schema: StructType | str, required: list[str]) -> DataFrame:
    """Typed reference table; an absent file is an empty table, incomplete rows drop out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path, schema=schema)
    return rows.dropna(subset=required)


CPI_SCHEMA = "year int, cpi_index_2024_base double"
POPULATION_SCHEMA = "year int, iso3 string, population double"


def load_cpi(spark: SparkSession, path: str) -> DataFrame:
    return reference_csv(spark, path, CPI_SCHEMA, ["year", "cpi_index_2024_base"])


def load_population(spark: SparkSession, path: str) -> DataFrame:
    return reference_csv(spark, path, POPULATION_SCHEMA, ["year", "iso3", "population"])
