"""Order statistics that never put one key into one task.

Everything here works on *value counts* (key, value, n): equal values collapse
before the shuffle, so a value that fills a third of the table is one row. A
running total then needs a global order. Small inputs (a checked size) use a
plain window. Larger ones are range-partitioned by (key, value), which splits a
hot key over many tasks, and only one offset per slice is summed across slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from statloom.sources.landing import land

LONG_SERIES = 1_000_000
NARROW_BINS = 1024
SMALL_INPUT_BYTES = 256 * 1024 * 1024
SMALL_INPUT_CONF = "statloom.smallInputBytes"


def small_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SMALL_INPUT_CONF, str(SMALL_INPUT_BYTES)))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size of the optimised plan: file sizes carried up the tree."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame) -> bool:
    return estimated_bytes(df) <= small_limit(df)


def value_counts(df: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """(keys, value, n) with NULL values left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    weights: dict[str, str],
    small: bool | None = None,
) -> DataFrame:
    """Add, per output name, the running total of a weight in key order, inclusive.

    ``order`` must be unique within a key (value counts are). ``<out>_all``
    holds the total of the key.
    """
    if small if small is not None else is_small(df):
        upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*keys)
        return df.select(
            "*",
            *[F.sum(w).over(upto).alias(out) for out, w in weights.items()],
            *[F.sum(w).over(whole).alias(f"{out}_all") for out, w in weights.items()],
        )

    # The slice of a row must not change if a task runs again, so it is written down.
    ordered = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    sliced = land(ordered.withColumn("_slice", F.spark_partition_id()))
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(w).alias(f"_{o}") for o, w in weights.items()])
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_slice.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_{o}_before") for o in weights],
        *[F.sum(f"_{o}").over(whole).alias(f"{o}_all") for o in weights],
    )
    inside = W.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(w).over(inside).alias(f"_{o}_here") for o, w in weights.items()])
    on = [local["_slice"] == offsets["_s"], *[local[k].eqNullSafe(offsets[f"_k_{k}"]) for k in keys]]
    return local.join(offsets, on, "inner").select(
        *df.columns,
        *[(F.col(f"_{o}_before") + F.col(f"_{o}_here")).alias(o) for o in weights],
        *[f"{o}_all" for o in weights],
    )


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key, one column per name.

    Small inputs use the ``percentile`` aggregate, which keeps every distinct value of a key in memory.
    Everything else goes through value counts and a narrowing selection, which reads them three times:
    pass landed or cheap ones.
    """
    small = is_small(df) if small is None else small
    rows = df.where(F.col(value).isNotNull()) if weight is None else df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    if small:
        points = F.array(*[F.lit(p) for p in probs.values()])
        grouped = rows.groupBy(*keys).agg(F.percentile(value, points, F.lit(1) if weight is None else F.col(weight)).alias("_q"))
        return grouped.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    if weight is not None:
        return narrowed_quantiles(rows, keys, value, weight, probs)
    return narrowed_quantiles(land(value_counts(df, keys, value, "_n")), keys, value, "_n", probs)


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value, growing with it; one bin where the span has no finite width."""
    finite = (high > low) & (high - low < float("inf")) & (low > float("-inf"))
    return F.when(finite, F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")).otherwise(F.lit(0))


def narrowed_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float], bins: int = NARROW_BINS) -> DataFrame:
    """Exact weighted quantiles of all keys without putting all values in order.

    First the weights are summed per key and bin of the value, combined before the shuffle, so ``bins`` sums per key cross it at
    most. They tell the bins that hold the wanted ranks and what lies below. Only the values in those bins are then ordered.
    Equal values in several rows do no harm: each row holds the ranks of its weight.
    """
    v, n = F.col(value).cast("double"), F.col(weight)
    slim = rows.select(*keys, v.alias("_v"), n.alias("_n"))
    span = slim.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    binned = attach(slim, span, keys).select(*keys, "_v", "_n", bin_of(F.col("_v"), F.col("_low"), F.col("_high"), bins).alias("_bin"))
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_w"))
    # at most ``bins`` rows per key
    run = sums.select("*", F.sum("_w").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)).alias("_upto"), F.sum("_w").over(W.partitionBy(*keys)).alias("_total"))
    near, _, _ = rank_points(probs, F.lit(0), F.col("_w"), F.col("_upto"), F.col("_total"))
    wanted = land(run.where(near).select(*keys, "_bin", (F.col("_upto") - F.col("_w")).alias("_below"), "_total"))
    picked = land(attach(binned, wanted, [*keys, "_bin"]))
    inside = running_totals(picked, [*keys, "_bin"], ["_v"], {"_cum": "_n"})
    near, bounds, results = rank_points(probs, F.col("_v"), F.col("_n"), F.col("_below") + F.col("_cum"), F.col("_total"))
    return inside.where(near).groupBy(*keys).agg(*bounds).select(*keys, *results)


def rank_points(probs: dict[str, float], value: Column, n: Column, upto: Column, total: Column) -> tuple[Column, list[Column], list[Column]]:
    """Quantiles from rows that know their ranks: which rows count, aggregates over them, and results by name.

    ``upto`` is the running total of ``n`` in value order, ``total`` that of the key. Several sets of quantiles with different
    names can be read off the same rows in one aggregation.
    """
    before, last = upto - n, total - 1

    def holds(rank: Column) -> Column:
        return (before <= rank) & (rank < upto)

    near, bounds, results = F.lit(False), [], []
    for name, p in probs.items():
        place = F.lit(p) * last
        low, high = F.floor(place), F.ceil(place)
        near = near | holds(low) | holds(high)
        bounds += [
            F.max(F.when(holds(low), value)).alias(f"_lo_{name}"), F.max(F.when(holds(high), value)).alias(f"_hi_{name}"),
            F.max(F.when(holds(low), place - low)).alias(f"_f_{name}"),
        ]
        results.append((F.col(f"_lo_{name}") * (1 - F.col(f"_f_{name}")) + F.col(f"_hi_{name}") * F.col(f"_f_{name}")).alias(name))
    return near, bounds, results


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-key columns back; NULL keys match. Spark picks broadcast by measured size."""
    if not keys:  # one row for all: each of its values is a scalar subquery
        return df.withColumns({c: per_key.select(c).scalar() for c in per_key.columns})
    renamed = per_key.select(
        *[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in per_key.columns if c not in keys]
    )
    on = [df[k].eqNullSafe(renamed[f"_j_{k}"]) for k in keys]
    return df.join(renamed, on, how).drop(*[f"_j_{k}" for k in keys])


def only(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is in ``per_key``; NULL keys match. Only ``per_key`` may be broadcast, never ``df``."""
    named = per_key.select(*[F.col(k).alias(f"_j_{k}") for k in keys])
    return df.join(named, [df[k].eqNullSafe(named[f"_j_{k}"]) for k in keys], "left_semi")


def median_and_mad(
    df: DataFrame, keys: list[str], value: str, weight: str | None = None, small: bool | None = None
) -> DataFrame:
    """(keys, median, mad): the median and the median absolute distance from it."""
    small = is_small(df) if small is None else small
    centre = quantiles(df, keys, value, {"median": 0.5}, weight, small)
    away = attach(df, centre, keys).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    spread = quantiles(away, keys, "_away", {"mad": 0.5}, weight, small)
    return attach(centre, spread, keys)


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str, out: str) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their places."""
    run = running_totals(counts, keys, [value], {"_cum": n})
    return run.select(
        *counts.columns, (F.col("_cum") - F.col(n) + (F.col(n) + 1) / 2.0).alias(out)
    )


def with_halo(df: DataFrame, position: str, chunk_rows: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows cut into chunks of an integer ``position``, with copies of the neighbouring rows.

    Adds ``_chunk`` and ``_own``. A frame of ``before`` rows back and ``after`` rows on, computed per ``_chunk``, is whole for
    the rows that are the chunk's own; the others are copies and to be dropped after it.
    """
    size = F.lit(chunk_rows)
    home = F.floor(F.col(position) / size)
    first = F.greatest(F.floor((F.col(position) - after) / size), F.lit(0))
    needed = F.sequence(F.least(first, home), F.floor((F.col(position) + before) / size))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(needed)).withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_home")


def row_numbers(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Number the rows of each key from 0 in ``order``, NULL first, without a task that sees a whole key.

    Rows are range-partitioned by key and order, so a key of any length is spread over slices; only the number of rows per
    key and slice crosses slices. Equal places are told apart by a digest of the row. The slices are landed.
    """
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
    place = [F.col(order), F.col("_tie")]
    sliced = land(tied.repartitionByRange(*[F.col(k) for k in keys], *place).withColumn("_slice", F.spark_partition_id()))
    here = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*place))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    # as many rows per key as it has slices
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    numbered = attach(sliced.withColumn("_here", here), offsets, [*keys, "_slice"])
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_here") - 1).alias(out))


def sliding(
    df: DataFrame, keys: list[str], order: str, before: int,
    columns: Callable[[WindowSpec], dict[str, Column]], long_rows: int = LONG_SERIES,
) -> DataFrame:
    """Columns over each row and up to ``before`` rows ahead of it in its series, for series of any length.

    ``columns`` makes them from a window (partitioned and ordered, without frame). Series of up to ``long_rows`` rows are one
    group each. Longer ones are numbered and cut into chunks of that many rows, each with copies of the last rows of the
    chunk before it, so no task gets a longer group than ``long_rows + before``. ``df`` is read twice: pass a landed or
    cheap one.
    """
    def over(frame: DataFrame, by: list[str], place: str) -> DataFrame:
        return frame.withColumns(columns(W.partitionBy(*by).orderBy(place)))

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > long_rows)
    long = land(sizes.withColumn("_long", F.lit(True)).select(*keys, "_long"))
    if long.isEmpty():
        return over(df, keys, order)
    told = df.withColumn("_long", F.lit(True)) if not keys else attach(df, long, keys, "left")
    chunked = with_halo(row_numbers(told.where("_long").drop("_long"), keys, order, "_row"), "_row", long_rows, before=before)
    parts = over(chunked, [*keys, "_chunk"], "_row").where("_own").drop("_row", "_chunk", "_own")
    return parts.unionByName(over(told.where("_long IS NULL").drop("_long"), keys, order))


def fill_forward(
    df: DataFrame, keys: list[str], position: str, column: str, chunk_rows: int = 1_000_000
) -> DataFrame:
    """Carry the last non-null value of ``column`` forward in ``position`` order.

    ``position`` is an integer row number. Rows are cut into chunks of it, so a
    sheet of any length is spread over tasks; only the last value of each chunk
    crosses a chunk border.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk_rows)))
    inside = W.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    tails = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(position))).alias("_tail")
    )
    carried = tails.select(*keys, "_chunk", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    filled = chunked.withColumn(column, F.last(column, ignorenulls=True).over(inside))
    joined = attach(filled, carried, [*keys, "_chunk"])
    return joined.withColumn(column, F.coalesce(column, "_carry")).select(*df.columns)


