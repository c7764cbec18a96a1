"""Registry of queries. One column spec serves the Spark result and the SQL twin.

A spec is a list of ``name:kind`` words; kinds are i (bigint), s (text), b
(boolean), d (date) and a digit (double rounded to that many places).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean", "d": "date"}
_SQL = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "d": "DATE"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(word.rsplit(":", 1)) for word in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.isdigit():
            return (F.round(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)
        return c.cast(_SPARK[kind]).alias(name)

    return df.select(*[one(n, k) for n, k in _columns(spec)])


def shaped_sql(sql: str, spec: str) -> str:
    def one(name: str, kind: str) -> str:
        if kind.isdigit():
            return f'round(CAST("{name}" AS DOUBLE), {kind}) + CAST(0 AS DOUBLE) AS "{name}"'
        return f'CAST("{name}" AS {_SQL[kind]}) AS "{name}"'

    return f"SELECT {', '.join(one(n, k) for n, k in _columns(spec))} FROM ({sql}) AS result"


def query(name: str, spec: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(lambda spark, d: shaped(fn(spark, d), spec), sql and shaped_sql(sql, spec))
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
