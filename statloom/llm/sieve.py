"""A filter of fixed size that spares rows a shuffle, as Spark's own runtime filters do for joins.

One bit per digest, ``BITS`` bits whatever the input: what is not in the set is mostly dropped where it is read. Rows let
through wrongly are removed by the exact join that always follows, so a full filter costs time and changes nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from statloom.sources.landing import freed

BITS = 1 << 25


def sieve_of(digests: DataFrame, column: str) -> Broadcast:
    """Broadcast bits (4 MB) of the digests in ``column``.

    Driver, executors and Python hold a copy each on disk until ``destroy``; call it when what reads the bits is landed.
    """
    return sieves_of(digests, column, "true")[0]


def sieves_of(digests: DataFrame, column: str, *conditions: str) -> list[Broadcast]:
    """One sieve for each condition, of the digests in ``column`` of the rows that meet it; all are made in one pass."""
    spark = digests.sparkSession
    slot = F.col(column).bitwiseAND(F.lit(BITS - 1))
    bit = F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")
    words = digests.select(F.shiftright(slot, 6).cast("int").alias("w"), *[F.when(F.expr(c), bit).otherwise(F.lit(0).cast("bigint")).alias(f"b{i}") for i, c in enumerate(conditions)])
    with freed(spark):
        found = words.groupBy("w").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(len(conditions))]).toArrow()
    out = []
    for i in range(len(conditions)):
        bits = np.zeros(BITS // 64, dtype=np.int64)
        bits[np.asarray(found.column("w"))] = np.asarray(found.column(f"b{i}"))
        out.append(spark.sparkContext.broadcast(bits.view(np.uint64)))
    return out


def passes(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    at = digests.view(np.uint64) if digests.dtype == np.int64 else digests
    return (bits[(at & np.uint64(BITS - 1)) >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
