"""Reports on whole assignments: their quality, each panel's, fairness in one row, and the best fusion weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from . import evaluate as E


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def assignment_quality(assigned: DataFrame, truth: DataFrame, total: int | Column) -> DataFrame:
    """One row over ``assigned(paper_id, reviewer_id)``: precision by the size of what is assigned and recall, means over papers with truth; distinct reviewers over all ``total`` and over all assignments.

    Papers of the assignment without truth count for coverage and diversity only. A repeated
    assignment counts once as a hit and each time in the size.
    """
    size = assigned.groupBy("paper_id").agg(F.count("*").alias("n"))
    want = truth.select("paper_id", "reviewer_id").distinct()
    n_truth = want.groupBy("paper_id").agg(F.count("*").alias("m"))
    hit = assigned.select("paper_id", "reviewer_id").distinct().join(want, ["paper_id", "reviewer_id"]).groupBy("paper_id").agg(F.count("*").alias("k"))
    each = size.join(n_truth, "paper_id").join(hit, "paper_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    means = each.agg(F.count("*").alias("n_papers"), F.coalesce(F.avg(F.col("k") / F.col("n")), F.lit(0.0)).alias("precision"), F.coalesce(F.avg(F.col("k") / F.col("m")), F.lit(0.0)).alias("recall"))
    used = assigned.agg(F.count_distinct("reviewer_id").alias("u"), F.count("*").alias("a"))
    out = means.join(F.broadcast(used))  # one row each
    return out.select("n_papers", "precision", "recall", _share(F.col("u"), total if isinstance(total, Column) else F.lit(total)).alias("coverage"), _share(F.col("u"), F.col("a")).alias("diversity"))


def panel_quality(panels: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """For every panel ``(paper_id, reviewer_id, slot, relevance, gain, authority)`` precision, recall, reciprocal rank and NDCG of its first ``k``, mean relevance and coverage, and how even its authorities are.

    The first four are null for a paper without truth. Precision and the ideal gain are bounded by the panel's own size.
    """
    marks = truth.select("paper_id", "reviewer_id").distinct()
    m = marks.groupBy("paper_id").agg(F.count("*").alias("m"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("slot", "reviewer_id"))
    rows = panels.withColumn("place", place).join(marks.withColumn("hit", F.lit(1)), ["paper_id", "reviewer_id"], "left")
    hit = F.col("hit").isNotNull() & (F.col("place") <= k)
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0)))
    each = rows.groupBy("paper_id").agg(
        F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"), F.min(F.when(hit, F.col("place"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("dcg"),
        mean("relevance").alias("mean_relevance"), mean("gain").alias("topic_coverage"), F.greatest(F.lit(0.0), 1 - F.stddev_pop(F.coalesce("authority", F.lit(0.0)))).alias("authority_balance"),
    )
    each = each.join(m, "paper_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("m"), F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known = lambda x: F.when(F.col("m").isNotNull(), x)
    return each.select("paper_id", known(F.col("hits") / F.least("n", F.lit(k))).alias("precision"), known(F.col("hits") / F.col("m")).alias("recall"), known(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), known(F.col("dcg") / ideal).alias("ndcg"), "mean_relevance", "topic_coverage", "authority_balance")


def violations(assigned: DataFrame, coi: DataFrame, tau: float = 0.5) -> DataFrame:
    """The assignments in conflict, with their scores."""
    bad = F.coalesce(F.col("flagged"), F.lit(False)) | (F.coalesce("coi_score", F.lit(0.0)) >= tau)
    return assigned.join(coi, ["paper_id", "reviewer_id"]).where(bad).select("paper_id", "reviewer_id", "coi_score")


def median_load(load: DataFrame) -> DataFrame:
    """The median of all loads, from equal loads counted first."""
    return load.groupBy("load").agg(F.count("*").alias("c")).agg(F.percentile("load", 0.5, F.col("c")).alias("median_load"))


def load_balance(assigned: DataFrame) -> DataFrame:
    """Jain's index over reviewers with an assignment only; 0 without any."""
    n = assigned.where(F.col("reviewer_id").isNotNull()).groupBy("reviewer_id").agg(F.count("*").cast("double").alias("x"))
    return n.agg(_share(F.sum("x") * F.sum("x"), F.count("*") * F.sum(F.col("x") * F.col("x"))).alias("load_balance"))


def fairness(reviewers: DataFrame, assigned: DataFrame, coi: DataFrame, tier: DataFrame, names: list[str], cap: int = 15) -> DataFrame:
    """Loads, overload, conflicts and shares of tiers in one row. ``tier(reviewer_id, tier)`` of assigned reviewers; each part is a row of its own before they meet."""
    load = E.loads(reviewers, assigned)
    held = assigned.join(tier, "reviewer_id", "left").groupBy().agg(*[F.round(100.0 * F.avg((F.coalesce("tier", F.lit("unknown")) == n).cast("double")), 6).alias(f"{n}_percent") for n in names])
    parts = [E.gini_jain(load), median_load(load), E.overload(load, cap).select("overloaded", F.col("rate").alias("overload_rate")), E.coi_violations(assigned, coi).select("violations", F.col("rate").alias("violation_rate")), held]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def best_weights(scores: DataFrame, by: str = "mode") -> DataFrame:
    """the weight set with the best mean NDCG, then MAP, then MRR, from ``per_paper`` scores of all sets."""
    means = E.mean_metrics(scores, [by])
    order = Window.orderBy(F.desc("ndcg"), F.desc("map"), F.desc("mrr"), by)  # a row a weight set
    return means.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def by_role(rows: DataFrame, weights: dict[str, float], roles: dict[str, dict[str, float]], full: bool = True) -> DataFrame:
    """the weighted sum of the signals, in the full mode by the weights of the candidate's role; ``base_kg`` is the mode's own graph weight.

    ``rows`` hold a column for each signal and ``role``; a role without weights takes the mode's.
    """
    table = {r: {**weights, **w} for r, w in roles.items()} if full else {}
    weight = lambda s: F.coalesce(*[F.when(F.col("role") == r, F.lit(w[s])) for r, w in table.items()], F.lit(weights[s]))
    score = S.clamp(sum((weight(s) * F.coalesce(F.col(s), F.lit(0.0)) for s in weights), F.lit(0.0)))
    return rows.withColumns({"score": score, "base_kg": F.lit(weights.get("kg", 0.0))})
