"""From documents to cleaned tables, issues, log and manifest.

The grid and the bodies are landed as Parquet in the shared folder, so the
document text is parsed once and later steps know real sizes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from statloom.operators.cleaning import Cleaned, clean_cells
from statloom.operators.contract import contract_issues, unreadable_documents
from statloom.operators.grid import split_sheets
from statloom.sources.html import decode_text, html_cells, list_documents, looks_like_html
from statloom.sources.landing import land
from statloom.sources.sinks import run_manifest

KEYS = ["workbook", "sheet"]


@dataclass(frozen=True)
class LandedRun:
    cells: DataFrame
    metadata: DataFrame
    issues: DataFrame
    log: DataFrame
    manifest: DataFrame
    checksums: DataFrame


def metadata_issues(metadata: DataFrame) -> DataFrame:
    """One row per sheet whose metadata block was moved aside."""
    return metadata.groupBy(*KEYS).agg(F.count_distinct("row_idx").alias("rows_affected")).select(
        *KEYS, F.lit("*").alias("column"), F.lit("ons_metadata_stripped").alias("issue_code"),
        F.lit("Rows above the data moved to the metadata table").alias("detail"), F.lit("low").alias("confidence"),
        "rows_affected", F.lit("").alias("example_before"), F.lit("").alias("example_after"),
        F.lit("See the metadata table for source, unit and release date.").alias("recommendation"),
    )


def clean_grid(grid: DataFrame) -> tuple[Cleaned, DataFrame]:
    """Clean every sheet of a landed grid (workbook, sheet, row_idx, col_idx, value, is_header)."""
    body, metadata = split_sheets(grid, KEYS)
    body = land(body)
    return clean_cells(body, KEYS), metadata


def run_cleaning(spark: SparkSession, root: str, glob: str = "*.xls", contract: str | None = None) -> LandedRun:
    """Clean all HTML documents below ``root`` in one run; the others are read errors of the register.

    ``contract``: text of a contract file, which the cleaned sheets are checked against.
    """
    docs = list_documents(spark, root, glob)
    readable = F.coalesce(looks_like_html(F.col("content")), F.lit(False))
    html = docs.where(readable).select("doc", decode_text(F.col("content")).alias("html"))
    grid = land(html_cells(html).withColumnRenamed("doc", "workbook"))
    cleaned, metadata = clean_grid(grid)
    metadata = land(metadata)
    cells = land(cleaned.table)
    checked = [contract_issues(cells, contract)] if contract else []
    issues = land(reduce(DataFrame.unionByName, checked, metadata_issues(metadata).unionByName(cleaned.issues).unionByName(unreadable_documents(docs, readable))))
    shape = lambda df, row, col: df.groupBy(*KEYS).agg((F.max(row) + 1).alias("n_rows"), F.count_distinct(col).alias("n_cols"))
    manifest = run_manifest(shape(grid, "row_idx", "col_idx"), shape(cells, "row_idx", "column"), issues)
    return LandedRun(cells, metadata, issues, cleaned.log, manifest, docs.select("doc", "publisher", "n_bytes", "sha256"))


def sheet_columns(cells: DataFrame, workbook: str, sheet: str) -> list[str]:
    """Column names of one sheet by name (a header list)."""
    rows = cells.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet)).select("column").distinct()
    return sorted(r["column"] for r in rows.collect())


def as_table(cells: DataFrame, workbook: str, sheet: str, columns: list[str]) -> DataFrame:
    """One cleaned sheet as a wide table of text columns."""
    one = cells.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet))
    return one.groupBy("row_idx").pivot("column", columns).agg(F.first("value")).drop("row_idx")
