"""Prefix scans in two passes: numbering, running maxima and order statistics of groups that fit no task.

Rows are dealt by ranges of (group, order). Each range is scanned by itself, one small row for each group in it says what the range adds,
and the sums or maxima of the ranges before are joined to its rows. A group of half of all rows is spread over as many ranges as its
share; rows that tie in the whole order are told apart by their place in the written table, so no value is a single range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.operators.folder import saved
from moments.operators.thin import bucket

PART, TIE = "_part", "_tie"


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df by ranges, written, with the number of the range and a last key that no two rows share."""
    tied = df.withColumn(TIE, F.monotonically_increasing_id())
    return saved(tied.repartitionByRange(*[F.col(c) for c in group], *order, F.col(TIE)).withColumn(PART, F.spark_partition_id()))


def _carried(parts: DataFrame, group: list[str], adds: Column, over) -> DataFrame:
    """(group, range, carry): ``over`` (F.sum or F.max) of what the ranges before add to each group."""
    small = parts.groupBy(*group, PART).agg(adds.alias("_adds"))
    before = W.partitionBy(*group).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    named = small.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col(PART).alias("_p"), over("_adds").over(before).alias("_carry"))
    return named


def _met(parts: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    same = F.col(PART) == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return parts.join(carried, same).drop("_p", *[f"_g{i}" for i in range(len(group))])


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str = "n") -> DataFrame:
    """Adds the number of each row in its group, from 1; ties by place in the table."""
    parts = ranged(df, group, order)
    inside = F.row_number().over(W.partitionBy(*group, PART).orderBy(*order, TIE))
    met = _met(parts.withColumn("_inside", inside), _carried(parts, group, F.count(F.lit(1)), F.sum), group)
    return met.withColumn(out, F.col("_inside") + F.coalesce("_carry", F.lit(0))).drop(PART, TIE, "_inside", "_carry")


def greatest_before(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the greatest value of the rows before each row of its group, null for the first."""
    parts = ranged(df, group, order)
    local = W.partitionBy(*group, PART).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, -1)
    met = _met(parts.withColumn("_inside", F.max(value).over(local)), _carried(parts, group, F.max(value), F.max), group)
    return met.withColumn(out, F.greatest("_inside", "_carry")).drop(PART, TIE, "_inside", "_carry")


def decimated(frames: DataFrame, rate: float = 1.0, by: tuple = ("video_id",), order: str = "idx") -> DataFrame:
    """As ``thin.decimate``, for videos of any size."""
    told = frames.withColumn("bucket", bucket(F.col("media_ts"), rate))
    return greatest_before(told, list(by), [F.col(order)], "bucket", "top").filter("top IS NULL OR bucket > top").drop("top")


def batched(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """As ``stats.batched``, for groups of any size."""
    return numbered(rows, by, [F.col(c) for c in order], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the value at place n div 2 + 1 of each group in order; nulls do not count."""
    known = df.select(*by, value).filter(F.col(value).isNotNull())
    placed = numbered(known, by, [F.col(value)], "_n").join(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")), by)
    return placed.filter("_n = floor(_all / 2) + 1").select(*by, F.col(value).alias("median"))


def quantile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by, quantile): between the two values next to place q (n - 1), by its fraction; nulls do not count."""
    known = df.select(*by, value).filter(F.col(value).isNotNull())
    place = (F.lit(q) * (F.col("_all") - 1)).alias("_at")
    placed = numbered(known, by, [F.col(value)], "_n").join(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")), by).withColumn("_at", place)
    low, part = F.floor("_at") + 1, F.col("_at") - F.floor("_at")
    near = placed.filter((F.col("_n") == low) | (F.col("_n") == low + 1))
    ends = near.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.first(part).alias("_f"))
    return ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))
