"""Parquet, CSV, manifest and checksum outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv_view(df: DataFrame, digits: int = 10) -> DataFrame:
    """Floating columns as %.<digits>g text, the form written to CSV."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(F.col(f.name).isNotNull(), general_format(F.col(f.name), digits)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def general_format(c, digits: int):
    """printf %g: ``digits`` significant digits, no trailing zeros.

    Java's own %g keeps trailing zeros, so the exponent decides between plain and
    scientific notation here.
    """
    sci = F.format_string(f"%.{digits - 1}e", c)
    exponent = F.element_at(F.split(sci, "e"), -1).try_cast("int")
    places = F.greatest(F.lit(0), F.lit(digits - 1) - exponent)
    plain = F.coalesce(*[F.when(places == p, F.format_string(f"%.{p}f", c)) for p in range(0, digits + 4)])
    mantissa = F.element_at(F.split(sci, "e"), 1)

    def trimmed(t):
        return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)

    signed = F.format_string("e%s%02d", F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent))
    return F.when((exponent < -4) | (exponent >= digits), F.concat(trimmed(mantissa), signed)).otherwise(trimmed(plain))


def write_csv(df: DataFrame, path: str, digits: int = 10) -> None:
    (
        csv_view(df, digits).write.mode("overwrite")
        .option("header", "true").option("nullValue", "").option("emptyValue", "")
        .csv(path)
    )


def write_metadata(cells: DataFrame, path: str) -> None:
    """Rows above the header as one table (sheet keys, row_idx, col_idx, value), no header line."""
    cells.write.mode("overwrite").option("nullValue", "").csv(path)


def file_checksums(docs: DataFrame) -> DataFrame:
    """sha256 per input file (``list_documents`` rows)."""
    return docs.select("doc", "n_bytes", "sha256")


def row_checksums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Order-independent content checksum per group: a sum of row hashes.

    xxhash64 of each row, added as decimals, so no group is ever gathered in one place.
    """
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).alias("content_hash"))


def run_manifest(before: DataFrame, after: DataFrame, issues: DataFrame) -> DataFrame:
    """Per (workbook, sheet): rows and columns in and out, issues raised, output stem."""
    from statloom.functions.text import output_stem

    keys = ["workbook", "sheet"]
    raised = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues_raised"))
    joined = (
        before.withColumnsRenamed({"n_rows": "rows_in", "n_cols": "cols_in"})
        .join(after.withColumnsRenamed({"n_rows": "rows_out", "n_cols": "cols_out"}), keys, "left")
        .join(raised, keys, "left")
    )
    return joined.select(
        *keys, "rows_in", "cols_in", "rows_out", "cols_out",
        F.coalesce("issues_raised", F.lit(0)).alias("issues_raised"),
        output_stem(F.col("workbook"), F.col("sheet")).alias("output_stem"),
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues and rows affected per code, most affected first."""
    return (
        issues.groupBy("issue_code")
        .agg(F.count(F.lit(1)).alias("n_issues"), F.sum("rows_affected").alias("rows_affected"))
        .orderBy(F.col("n_issues").desc(), "issue_code")
    )
