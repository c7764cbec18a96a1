"""Dataset contracts: what a cleaned table must look like."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

RULES_SCHEMA = "no int, publisher string, workbook string, sheet string, rule string, column string, low double, high double, low_text string, high_text string, unit string"


def parse_contract(text: str) -> list[dict]:
    """Entries of a contract file: workbook, sheet, publisher, required_columns,
    min_rows, max_null_pct, numeric_columns{min, max, unit}."""
    data = yaml.safe_load(text) or {}
    return [e for e in data.get("datasets") or [] if e.get("workbook") and e.get("sheet")]


def contract_rules(spark: SparkSession, text: str) -> DataFrame:
    """A contract file as a table, one row per rule; ``no`` keeps the order of the file.

    Rules: table (is there), required (column), rows (at least ``low``), blanks (at most ``high`` per cent), range (of a column).
    """
    rows = []

    def add(spec: dict, rule: str, column: str = "", low=None, high=None, unit: str = "?") -> None:
        number = lambda x: None if x is None else float(x)
        rows.append((len(rows), spec.get("publisher") or "", spec["workbook"], spec["sheet"], rule, column, number(low), number(high), str(low), str(high), unit))

    for spec in parse_contract(text):
        add(spec, "table")
        for column in spec.get("required_columns") or []:
            add(spec, "required", column)
        if isinstance(spec.get("min_rows"), int):
            add(spec, "rows", low=spec["min_rows"])
        if isinstance(spec.get("max_null_pct"), (int, float)):
            add(spec, "blanks", high=spec["max_null_pct"])
        for column, bounds in (spec.get("numeric_columns") or {}).items():
            add(spec, "range", column, bounds.get("min"), bounds.get("max"), bounds.get("unit", "?"))
    return spark.createDataFrame(rows, RULES_SCHEMA)
