"""Ranking metrics, fairness, conflicts and diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S


def hits(ranking: DataFrame, truth: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The ranking of papers with truth, with ``hit`` 0/1 and ``n_truth``; (paper, reviewer) is unique on both sides.

    With ``sizes(paper_id, n_truth)`` the truth needs no pairs but those that are ranked.
    """
    size = truth.groupBy("paper_id").agg(F.count("*").alias("n_truth")) if sizes is None else sizes
    marks = truth.select("paper_id", "reviewer_id").distinct().withColumn("hit", F.lit(1))
    return ranking.join(size, "paper_id").join(marks, ["paper_id", "reviewer_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def per_paper(rows: DataFrame, k: int, keys: list[str] = ["paper_id"]) -> DataFrame:  # noqa: B006
    """R01-R04 for each paper (and method): rr, ap over the whole ranking, p, r and ndcg at k."""
    seen = F.sum("hit").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("seen", seen)
    top = F.col("rank") <= k
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = rows.groupBy(*keys, "n_truth").agg(
        F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("top"),
        F.sum(F.when(top & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(top & (F.col("hit") == 1), F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap_top"),
    )
    return out.select(*keys, "n_truth", "top", "rr", (F.col("ap") / F.col("n_truth")).alias("ap"), (F.col("top") / k).alias("p"), (F.col("top") / F.col("n_truth")).alias("r"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("ap_top") / F.least(F.col("n_truth"), F.lit(k))).alias("ap_k"))


def mean_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted means over the evaluated papers."""
    cols = [F.round(F.avg(c), 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("rr", "mrr"), ("ap", "map"), ("ndcg", "ndcg"))]
    return scores.groupBy(*by).agg(F.count("*").alias("n_papers"), *cols)


def conditional_map(scores: DataFrame, by: list[str]) -> DataFrame:
    """The mean over papers with a hit within k only."""
    return scores.where("top > 0").groupBy(*by).agg(F.count("*").alias("n_hit"), F.round(F.avg("ap_k"), 6).alias("map_conditional"))


def hit_rate(scores: DataFrame, by: list[str]) -> DataFrame:
    """R09."""
    return scores.groupBy(*by).agg(F.round(F.avg((F.col("top") > 0).cast("double")), 6).alias("hit_rate"))


def coverage(ranking: DataFrame, total: int | Column, k: int | None = None) -> DataFrame:
    """Distinct reviewers over all reviewers, and over the listed rows."""
    rows = ranking if k is None else ranking.where(F.col("rank") <= k)
    n = F.countDistinct("reviewer_id")
    return rows.agg(F.round(n / total, 6).alias("coverage"), F.round(n / F.count("*"), 6).alias("diversity"))


def panel_diversity(panels: DataFrame) -> DataFrame:
    """The mean of (distinct - 1) / (n - 1) over panels of more than one."""
    each = panels.groupBy("paper_id").agg(F.count("*").alias("n"), F.countDistinct("reviewer_id").alias("u")).where("n > 1")
    return each.agg(F.round(F.avg((F.col("u") - 1) / (F.col("n") - 1)), 6).alias("panel_diversity"))


def loads(reviewers: DataFrame, assigned: DataFrame) -> DataFrame:
    """(reviewer_id, load) of every reviewer, 0 where nothing is assigned."""
    n = assigned.groupBy("reviewer_id").agg(F.count("*").alias("load"))
    return reviewers.select("reviewer_id").join(n, "reviewer_id", "left").withColumn("load", F.coalesce("load", F.lit(0)))


def gini_jain(load: DataFrame) -> DataFrame:
    """One row of inequality and spread. Equal loads are counted first, so only distinct loads are ordered."""
    level = load.groupBy("load").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("load").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the ranks of c equal loads after `before` smaller ones add up to c * before + c (c + 1) / 2
    rows = level.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    x, c = F.col("load").cast("double"), F.col("c").cast("double")
    n, s = F.sum(c), F.sum(c * x)
    gini = F.when(s == 0, 0.0).otherwise((2 * F.sum(F.col("ranks") * x) - (n + 1) * s) / (n * s))
    sq = F.sum(c * x * x)
    return rows.agg(n.cast("long").alias("n"), s.cast("long").alias("total"), F.min("load").alias("min_load"), F.max("load").alias("max_load"), F.round(s / n, 6).alias("mean_load"), F.round(F.sqrt(F.greatest(sq / n - (s / n) * (s / n), F.lit(0.0))), 6).alias("std_load"), F.round(gini, 6).alias("gini"), F.round(F.when(sq == 0, 0.0).otherwise(s * s / (n * sq)), 6).alias("jain"))


def overload(load: DataFrame, cap: int = 15) -> DataFrame:
    """W04."""
    return load.agg(F.count("*").alias("n"), F.sum((F.col("load") >= cap).cast("long")).alias("overloaded"), F.round(F.avg((F.col("load") >= cap).cast("double")), 6).alias("rate"))


def coi_violations(assigned: DataFrame, coi: DataFrame, tau: float = 0.5) -> DataFrame:
    """W05."""
    rows = assigned.join(coi, ["paper_id", "reviewer_id"], "left")
    bad = F.coalesce((F.col("coi_score") >= tau) | F.col("flagged"), F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.sum(bad.cast("long")).alias("violations"), F.round(F.avg(bad.cast("double")), 6).alias("rate"))


def tiers(rows: DataFrame, names: list[str]) -> DataFrame:
    """Counts and percent of the fixed tiers, zero-filled."""
    all_ = rows.sparkSession.createDataFrame([(n,) for n in names], "tier string")
    n = rows.groupBy("tier").agg(F.count("*").alias("n"))
    filled = all_.join(n, "tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return filled.select("tier", "n", F.round(F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0), 6).alias("percent"))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts, precision, recall and F1 of two 0/1 columns."""
    c = lambda a, b: F.sum(((F.col(label) == a) & (F.col(predicted) == b)).cast("long"))
    got = rows.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(0, 0).alias("tn"), c(1, 0).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return got.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def workload_band(load: Column, mean: Column, sd: Column) -> Column:
    """W13."""
    return F.when(load == 0, "idle").when(load <= mean, "light").when(load <= mean + F.greatest(sd, F.lit(1.0)), "moderate").otherwise("heavy")


def utilisation_label(load: Column, capacity: Column) -> Column:
    """Under 40 percent, up to 70, up to 90, above; no load and a full one have their own names."""
    percent = load * 100.0 / F.greatest(capacity, F.lit(1))
    bands = F.when(percent < 40, "Low").when(percent <= 70, "Moderate").when(percent <= 90, "High").otherwise("Near Capacity")
    return F.when(load <= 0, "Unused").when(load >= F.greatest(capacity, F.lit(1)), "At Capacity").otherwise(bands)


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney with half for ties; null with one class only. Equal scores are counted first."""
    level = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("pos"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mid = level.withColumn("mid", before + (F.col("c") + 1) / 2)
    p, n = F.sum("pos"), F.sum(F.col("c") - F.col("pos"))
    return mid.agg(F.round(F.when((p > 0) & (n > 0), (F.sum(F.col("mid") * F.col("pos")) - p * (p + 1) / 2) / (p * n)), 6).alias("auc"))


def point_biserial(rows: DataFrame, label: str, score: str) -> DataFrame:
    """D02."""
    return rows.agg(F.round(F.corr(F.col(label).cast("double"), F.col(score).cast("double")), 6).alias("point_biserial"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, median, p75, p90 and share of zeros."""
    v = F.col(value).cast("double")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.percentile(v, 0.75), 6).alias("p75"), F.round(F.percentile(v, 0.9), 6).alias("p90"), F.round(F.avg((v == 0).cast("double")), 6).alias("zero_rate"))


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The paired t statistic; 0 where the differences do not vary."""
    d = F.col(a) - F.col(b)
    sd = F.stddev_samp(d)
    t = F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise(F.avg(d) / (sd / F.sqrt(F.count(d))))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_difference"), F.round(t, 6).alias("t"))


def t_p_value(t: float, df: int) -> float:
    """The two-sided p-value, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return 1.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
                h *= d * c
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def pairwise_diversity(panels: DataFrame) -> DataFrame:
    """Of each panel ``(paper_id, slot, tokens)`` the mean of 1 - Jaccard over its pairs, and its tokens' entropy over that of a flat spread.

    A panel of one has no pair and gives null; a panel without tokens has the entropy 0.
    """
    a = panels.select("paper_id", F.col("slot").alias("i"), F.col("tokens").alias("x"))
    b = panels.select("paper_id", F.col("slot").alias("j"), F.col("tokens").alias("y"))
    apart = a.join(b, "paper_id").where("i < j").groupBy("paper_id").agg(F.avg(1 - S.jaccard(F.col("x"), F.col("y"))).alias("dissimilarity"))
    each = panels.select("paper_id", F.explode("tokens").alias("t")).groupBy("paper_id", "t").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("paper_id"))
    spread = each.withColumn("p", share).groupBy("paper_id").agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.greatest(F.lit(2), F.count("*")))).alias("entropy"))
    return panels.select("paper_id").distinct().join(apart, "paper_id", "left").join(spread, "paper_id", "left").na.fill(0.0, ["entropy"])
