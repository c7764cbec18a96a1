"""Near-duplicate category values by token-set similarity, for columns of any number and length of values.

Three ways lead to a score: all tokens of one value stand in the other, nearly all of its letters do, or the texts
differ in few letters. For the first two the value's rarest tokens are looked up among all tokens of the others: what may
be missing is bounded in letters, so one of the first rare tokens is shared. For the third, letter pairs inside padded
tokens do not depend on the order of tokens, and values at 90 % similarity agree on so many of them that their rarest
ones overlap. Both are exact filters: no pair that reaches the threshold is left out. Blocks of many values are dealt out
as pairs of chunks, and pairs of the third kind must agree in length and letter counts before they leave their task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statloom.operators.ordered import attach, value_counts
from statloom.sources.landing import land

CHUNK, LETTER_GROUPS = 2_000, 16


def indel_distance():
    """Pandas UDF: insertions plus deletions that turn a into b.

    The helper is nested so that it travels to the executors with the UDF.
    """
    def common(a: str, b: str) -> int:
        """Length of the longest common subsequence, one numpy row per letter of ``a``."""
        if not a or not b:
            return 0
        other = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
        row = np.zeros(len(other) + 1, dtype=np.int64)
        for letter in a:
            hit = np.concatenate(([0], row[:-1] + (other == ord(letter))))
            row = np.maximum.accumulate(np.maximum(row, hit))
        return int(row[-1])

    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else len(x) + len(y) - 2 * common(x, y) for x, y in zip(a, b)], dtype="Int64")

    return F.pandas_udf(distance, "long")


def _tokens(c: str):
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")))


def _letter_counts(c: str) -> Column:
    """Letters of each of ``LETTER_GROUPS`` groups; sums of differences are at most the edits between two texts."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x) % LETTER_GROUPS)
    return F.transform(F.sequence(F.lit(0), F.lit(LETTER_GROUPS - 1)), lambda k: F.size(F.filter(codes, lambda x: x == k)))


def _apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """Rows of ``left`` (keys, _block, _id, ...) and ``right`` (keys, _block, _other, ...) of one block.

    A block of many rows is dealt out as all pairs of its chunks, so no task holds more than ``chunk`` rows of a side.
    """
    at = [*keys, "_block"]

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("bigint").alias(name))

    plan = land(parts(left, "_ml").join(parts(right, "_mr"), at))
    left = left.join(plan, at).withColumn("_l", F.pmod(F.xxhash64("_id"), "_ml")).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_mr") - F.lit(1).cast("bigint"))))
    right = right.join(plan, at).withColumn("_r", F.pmod(F.xxhash64("_other"), "_mr")).withColumn("_l", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ml") - F.lit(1).cast("bigint"))))
    return left.drop("_ml", "_mr").join(right.drop("_ml", "_mr"), [*at, "_l", "_r"])


def near_duplicates(cells: DataFrame, keys: list[str], threshold: int = 90, chunk: int = CHUNK) -> DataFrame:
    """(keys, value_a, value_b, fuzz_score, count_a, count_b) of text cells (keys, value)."""
    values = value_counts(cells, keys, "value").withColumn("_tok", _tokens("value")).withColumn("_joined", F.array_join("_tok", " "))
    # blocks carry a number, not the text
    values = land(values.withColumn("_len", F.length("_joined")).withColumn("_id", F.monotonically_increasing_id()))
    lost = 100 - threshold

    def first(of: str) -> W:
        return W.partitionBy(*keys, "_id").orderBy("_f", of)

    # tokens, rarest first, as long as those before them may all be missing in a partner
    tokens = values.select(*keys, "_id", "_len", F.explode("_tok").alias("_block"))
    often = tokens.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_f"))
    tokens = land(attach(tokens, often, [*keys, "_block"]))
    before = F.sum(F.length("_block") + 1).over(first("_block").rowsBetween(W.unboundedPreceding, -1)) - 1
    missing = F.floor((lost * (2 * F.col("_len") - 1) - 100) / (200 - threshold))
    rare = tokens.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= F.greatest(F.lit(0), missing))
    held = tokens.select(*keys, "_block", F.col("_id").alias("_other"))
    by_token = _meeting(land(rare.select(*keys, "_block", "_id")), held, keys, chunk).where(F.col("_id") != F.col("_other"))

    # letter pairs of padded tokens, made unique per value by their occurrence number
    raw = values.where("_len > 0").select(*keys, "_id", "_len", F.concat(F.lit(" "), "_joined", F.lit(" ")).alias("_text"), F.explode(F.sequence(F.lit(1), F.col("_len") + 1)).alias("_p"))
    raw = raw.select(*keys, "_id", "_len", "_p", F.expr("substring(_text, _p, 2)").alias("_g"))
    nth = F.row_number().over(W.partitionBy(*keys, "_id", "_g").orderBy("_p"))
    grams = land(raw.select(*keys, "_id", "_len", F.concat_ws("|", "_g", nth).alias("_block")))
    frequency = grams.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_f"))
    ranked = attach(grams, frequency, [*keys, "_block"]).withColumn("_place", F.row_number().over(first("_block")))
    # A partner is at most (200-t)/t as long, t = threshold; each edit breaks two of the length + 1 pairs.
    edits = F.floor(2 * lost * F.col("_len") / threshold)
    agree = F.greatest(F.lit(1), F.col("_len") + 1 - 2 * edits)
    ranked = ranked.where(F.col("_place") <= F.col("_len") + 2 - agree).select(*keys, "_block", "_id")
    letters = values.select(*keys, "_id", "_len", _letter_counts("_joined").alias("_letters"))
    ranked = land(attach(ranked, letters, [*keys, "_id"]))
    other = ranked.select(*keys, "_block", F.col("_id").alias("_other"), F.col("_len").alias("_len_b"), F.col("_letters").alias("_letters_b"))
    room = lost * (F.col("_len") + F.col("_len_b"))
    by_pair = _meeting(ranked, other, keys, chunk).where(F.col("_id") < F.col("_other"))
    by_pair = by_pair.where(100 * F.abs(F.col("_len") - F.col("_len_b")) <= room).where(100 * _apart("_letters", "_letters_b") <= room)

    pairs = by_token.select(*keys, F.least("_id", "_other").alias("_ia"), F.greatest("_id", "_other").alias("_ib")).unionByName(
        by_pair.select(*keys, F.col("_id").alias("_ia"), F.col("_other").alias("_ib"))).distinct()

    def side(suffix: str) -> DataFrame:
        return values.select(*keys, F.col("_id").alias(f"_i{suffix}"), F.struct("value", "n", F.col("_tok").alias("tok")).alias(f"_v{suffix}"))

    x = attach(attach(pairs, side("a"), [*keys, "_ia"]), side("b"), [*keys, "_ib"])
    x = x.select(*keys, F.least("_va", "_vb").alias("_va"), F.greatest("_va", "_vb").alias("_vb")).where(F.lower("_va.value") != F.lower("_vb.value"))
    x = x.select(
        *keys, F.col("_va.value").alias("value_a"), F.col("_vb.value").alias("value_b"), F.col("_va.n").alias("count_a"), F.col("_vb.n").alias("count_b"),
        F.array_join(F.array_intersect("_va.tok", "_vb.tok"), " ").alias("_s"),
        F.array_join(F.array_except("_va.tok", "_vb.tok"), " ").alias("_a"),
        F.array_join(F.array_except("_vb.tok", "_va.tok"), " ").alias("_b"),
    )
    shared, a, b = F.length("_s"), F.length("_a"), F.length("_b")
    gap = F.when(shared > 0, 1).otherwise(0)
    len_a, len_b = shared + gap + a, shared + gap + b
    # letters are compared only where their counts let the whole texts reach the threshold
    near = (a > 0) & (b > 0) & (100 * _apart(_letter_counts("_a"), _letter_counts("_b")) <= lost * (len_a + len_b))
    x = land(x.withColumns({"_near_a": F.when(near, F.col("_a")), "_near_b": F.when(near, F.col("_b"))}))
    x = land(x.withColumn("_dist", indel_distance()("_near_a", "_near_b")))
    whole = F.coalesce(100.0 - 100.0 * F.col("_dist") / F.greatest(len_a + len_b, F.lit(1)), F.lit(0.0))
    with_a = 100.0 - 100.0 * (gap + a) / (shared + len_a)
    with_b = 100.0 - 100.0 * (gap + b) / (shared + len_b)
    score = F.when((shared > 0) & ((a == 0) | (b == 0)), 100.0).when(shared == 0, whole).otherwise(F.greatest(whole, with_a, with_b))
    return x.withColumn("_score", score).where(F.col("_score") >= threshold).select(
        *keys, "value_a", "value_b", F.floor("_score").cast("int").alias("fuzz_score"), "count_a", "count_b"
    )
