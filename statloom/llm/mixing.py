"""Mixing sources to target weights by iterative proportional fitting, then sampling documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm.base import query, table
from statloom.sources.landing import land, landings

AXES = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.8}
KEEP, ROUNDS, TOLERANCE = 0.5, 40, 1e-6


def topic_of(text: Column) -> Column:
    """A coarse topic read off the text: tables, symbols, figures, short or long prose."""
    n = F.char_length(text)
    bars = n - F.char_length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.char_length(F.regexp_replace(text, r"[^#*$%&<>{}=;]++", ""))
    figures = F.char_length(F.regexp_replace(text, r"[^0-9]++", ""))
    return (
        F.when(bars * 40 > n, "table").when(marks * 40 > n, "symbols").when(figures * 25 > n, "figures")
        .when(n < 600, "note").when(n < 4000, "page").otherwise("long")
    )


def target_shares(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """(axis, target): token shares raised to ``power`` and evened to one; values below one lift small groups."""
    sums = cells.groupBy(axis).agg(F.sum("tokens").alias("t"))
    raised = sums.select(axis, F.pow(F.col("t").cast("double"), F.lit(power)).alias("r"))
    return raised.join(raised.agg(F.sum("r").alias("all")), how="left").select(axis, F.try_divide("r", "all").alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (axes, tokens) with ``weight``: the factor on tokens under which every axis has its target shares.

    The weight of a cell is the product of one factor per axis value, kept beside the cell. A step sums tokens by its axis
    and lands the cells with that axis's new factors: one shuffle of partial sums and one join. The sum over all cells stays
    the number of tokens, since targets add up to one. It ends when no share was off by more than ``tolerance``.
    Axis values without tokens or target keep their factor. The cells are one row per combination of axis values, not per document.
    """
    total = cells.agg(F.sum("tokens").alias("all")).first()["all"]
    rows = cells
    for axis, target in targets.items():
        goal = target.select(F.col(axis).alias("_axis"), (F.col("target") * F.lit(total).cast("bigint")).alias(f"_goal_{axis}"))
        rows = rows.join(goal, F.col(axis).eqNullSafe(F.col("_axis")), "left").drop("_axis").withColumns({f"_f_{axis}": F.lit(1.0), f"_off_{axis}": F.lit(0.0)})
    def product(axes) -> Column:
        return reduce(lambda w, a: w * F.col(f"_f_{a}"), axes, F.lit(1.0))

    with landings() as own:
        rows = land(rows)
        for _ in range(rounds):
            for axis in targets:
                weight = product(a for a in targets if a != axis)
                sums = rows.groupBy(F.col(axis).alias("_axis")).agg(F.sum(F.col("tokens") * weight).alias("_sum"))
                f, goal = F.col(f"_f_{axis}"), F.col(f"_goal_{axis}")
                new = F.when((F.col("_sum") > 0) & (goal > 0), goal / F.col("_sum")).otherwise(f)
                off = F.coalesce(F.abs(f * F.col("_sum") - goal), F.lit(0.0))
                found = rows.join(sums, F.col(axis).eqNullSafe(F.col("_axis")), "left")
                rows = land(found.withColumns({f"_f_{axis}": new, f"_off_{axis}": off}).drop("_axis", "_sum"))
            own.only(rows)
            worst = rows.agg(*[F.max(f"_off_{a}") for a in targets]).first()
            if not total or None in worst or max(worst) / total <= tolerance:
                break
    return rows.select(*[F.col(f"`{c}`") for c in cells.columns], product(targets).alias("weight"))


def mixed(docs: DataFrame, keep: float = KEEP, seed: int = 11, powers: dict[str, float] | None = None) -> DataFrame:
    """All columns of ``docs`` and, for every row, how it enters the mix.

    Adds _topic, _tokens (words), _weight (raked), _probability (share of copies in one draw, 1 at most), _copies: whole
    copies for weights above what one draw gives, the rest by a digest of id and text, so the draw repeats. The rate is
    set so that ``keep`` of all tokens is expected. Null source or language is a value of its own; a null or empty text has
    no tokens and no copies; repeated rows are drawn alike; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"_topic": topic_of(text), "_tokens": F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("bigint")})
    axis = {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": F.col("_topic")}
    with landings() as own:
        cells = land(rows.groupBy(*[axis[a].alias(a) for a in AXES]).agg(F.sum("_tokens").alias("tokens")))
        targets = {a: target_shares(cells, a, (powers or POWERS)[a]) for a in AXES}
        weights = raked(cells, targets)
        total = weights.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("weight")).alias("heavy"))
        weights = land(weights.join(total, how="left").select(*[F.col(a).alias(f"_{a}_") for a in AXES], F.try_divide(F.col("weight") * F.col("all") * keep, F.col("heavy")).alias("_weight")))
        own.only(weights)
    out = rows.join(weights, (axis["source"] == F.col("_source_")) & (axis["lang"] == F.col("_lang_")) & (F.col("_topic") == F.col("_topic_")), "left")
    out = out.drop(*[f"_{a}_" for a in AXES]).withColumn("_weight", F.when(F.col("_tokens") > 0, F.coalesce("_weight", F.lit(0.0))).otherwise(0.0))
    # a number in [0, 1) from the document itself
    draw = F.pmod(F.xxhash64(F.col("doc_id"), text, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    part = F.col("_weight") - F.floor("_weight")
    return out.withColumn("_probability", F.least(F.lit(1.0), F.col("_weight"))).withColumn("_copies", (F.floor("_weight") + F.when(draw < part, 1).otherwise(0)).cast("int"))


@query("op10_mixing_raked_weights")
def op10(spark, sf_dir):
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 9).alias("weight"),
        F.round("_probability", 9).alias("probability"), F.col("_copies").alias("copies"),
    )
