"""Ranks of all rows by value without a window over all rows, and the tests that rest on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that values are dealt into; the driver gets as many bounds.
RANGES = 64


def below(rows: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """``(value, n, below)``: each distinct value that isn't null, how often it occurs, and how many rows are smaller.

    Equal values are counted first. Bounds of about equal ranges, fixed numbers once taken,
    deal the distinct values; each range sums its own, and what lies before a range comes
    from the ranges' totals, one row each. No task holds more than a range.
    """
    level = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    bounds = sorted(set(level.approxQuantile("value", [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    part = F.lit(0)
    for b in bounds:
        part = part + F.when(F.col("value") > b, 1).otherwise(0)
    level = level.withColumn("range", part)
    totals = level.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))  # a row a range
    own = F.sum("n").over(Window.partitionBy("range").orderBy("value")) - F.col("n")
    return level.withColumn("own", own).join(F.broadcast(before), "range").select("value", "n", (F.col("before") + F.col("own")).alias("below"))


def middle_rank(below: Column, n: Column) -> Column:
    """The rank that equal values share, from 1."""
    return below + (n + 1) / 2


def ranged_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """D01 at any size: Mann-Whitney with half for ties; null with one class only."""
    level = below(rows, score)
    pos = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("value")).agg(F.sum(F.col(label).cast("long")).alias("pos"))
    x = level.join(pos, "value").withColumn("mid", middle_rank(F.col("below"), F.col("n")))
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return x.agg(F.when((p > 0) & (n > 0), (F.sum(F.col("mid") * F.col("pos")) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def two_sided(z: float | None) -> float | None:
    """The chance of a standard normal value as far from 0."""
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def signed_rank(rows: DataFrame, a: str, b: str, split_zeros: bool = True) -> DataFrame:
    """Wilcoxon's signed rank test of paired values: ``(n, zeros, w_plus, w_minus, statistic, z, p_value)``.

    Absolute differences share middle ranks where they are equal, to 9 places. Zeros are
    ranked and half of their rank sum goes to either side; with ``split_zeros`` off they are
    left out. z follows from the normal approximation with the correction for ties; it is
    null without a pair or without a difference. Pairs with a null are left out.
    """
    d = F.round(F.col(a).cast("double") - F.col(b).cast("double"), 9)
    pairs = rows.select(d.alias("d")).where("d is not null")
    pairs = pairs.withColumn("size", F.abs("d"))
    used = pairs if split_zeros else pairs.where("size > 0")
    rank = below(used, "size").select("value", F.col("n").cast("double").alias("t"), middle_rank(F.col("below"), F.col("n")).alias("mid"))
    sign = used.groupBy(F.col("size").alias("value")).agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("plus"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("minus"), F.sum(F.when(F.col("d") == 0, 1).otherwise(0)).alias("zero"))
    x = rank.join(sign, "value")
    half = F.sum(F.col("mid") * F.col("zero")) / 2
    sums = x.agg(F.sum(F.col("plus") + F.col("minus") + F.col("zero")).alias("n"), F.sum("zero").alias("zeros"), (F.sum(F.col("mid") * F.col("plus")) + half).alias("w_plus"), (F.sum(F.col("mid") * F.col("minus")) + half).alias("w_minus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24
    low = F.least("w_plus", "w_minus")
    z = F.when(variance > 0, (low - n * (n + 1) / 4) / F.sqrt(variance))
    out = sums.select("n", "zeros", "w_plus", "w_minus", low.alias("statistic"), z.alias("z"))
    return out.withColumn("p_value", F.udf(two_sided, "double")("z"))  # one row
