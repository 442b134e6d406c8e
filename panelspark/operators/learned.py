"""The learned ranker (L01-L08): features, weights with hard negatives, grouped folds, boosted trees, a logistic probe."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S

#: L01's features but for authority and the hybrid score with their ranks, which stay out by default.
FEATURES = ["semantic", "kg_effective", "kg", "kg_confidence", "keyword", "rr_semantic", "rr_kg"]
#: A feature's group.
GROUPS = {
    "semantic": "Semantic relevance", "rr_semantic": "Semantic relevance", "kg": "KG evidence", "kg_effective": "KG evidence", "kg_confidence": "KG evidence", "rr_kg": "KG evidence",
    "keyword": "Topic overlap", "authority": "Authority evidence", "rr_authority": "Authority evidence", "rr_hybrid": "Frozen hybrid rank",
}
RANKED_BY = {"rr_semantic": "semantic", "rr_kg": "kg_effective", "rr_authority": "authority", "rr_hybrid": "hybrid"}


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (paper_id, reviewer_id, label and the signals of ``FEATURES`` and ``RANKED_BY``) with the reciprocal ranks among the paper's candidates; a null signal counts 0."""
    signals = [c for c in dict.fromkeys([*FEATURES, *RANKED_BY.values()]) if not c.startswith("rr_")]
    rows = rows.withColumns({s: F.coalesce(F.col(s), F.lit(0.0)) for s in signals})
    return rows.withColumns({n: 1.0 / S.rank_by(F.col(s), F.col("reviewer_id"), by=["paper_id"]) for n, s in RANKED_BY.items()})


def weighted(rows: DataFrame, label: str = "label", hard: int = 0, factor: float = 2.0) -> DataFrame:
    """``weight`` of a relevant row, the rows of the other class for each of its own, 50 at most; of any other 1, and ``factor`` if it is among the paper's first ``hard`` by ``rr_semantic``."""
    share = rows.agg(F.greatest(F.lit(1), F.sum(F.col(label))).alias("pos"), F.greatest(F.lit(1), F.sum(1 - F.col(label))).alias("neg"))
    rows = rows.join(F.broadcast(share))  # one row
    other = F.when(F.col("rr_semantic") >= 1.0 / hard - 1e-12, factor).otherwise(1.0) if hard else F.lit(1.0)
    return rows.withColumn("weight", F.when(F.col(label) == 1, F.least(F.lit(50.0), F.col("neg") / F.col("pos"))).otherwise(other)).drop("pos", "neg")


def folded(rows: DataFrame, folds: int = 5) -> DataFrame:
    """A paper's rows all lie in one fold."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("paper_id"), F.lit(folds)))


def dataset(rows: DataFrame, signals: list[str], folds: int = 5) -> DataFrame:
    """L01, L04 for any signals: each with its reciprocal rank, and the folds."""
    for s in signals:
        rows = rows.withColumn(f"rr_{s}", 1.0 / S.rank_by(F.col(s), F.col("reviewer_id"), by=["paper_id"]))
    return folded(rows, folds)


def out_of_fold(rows: DataFrame, cols: list[str], label: str = "label", folds: int = 5, iterations: int = 10, hard: int = 0) -> DataFrame:
    """Each paper scored by a model that has not seen it, with the weights of the other folds; a fold trained on one class scores 0."""
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(rows).persist()
    out = []
    for f in range(folds):
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        if train.agg(F.countDistinct(label)).first()[0] < 2:
            out.append(test.withColumn("prediction_score", F.lit(0.0)))
            continue
        trees = GBTClassifier(labelCol=label, weightCol="weight", maxIter=iterations, stepSize=0.05, maxDepth=4, seed=42)
        model = trees.fit(weighted(train, label, hard))
        out.append(model.transform(test).withColumn("prediction_score", vector_to_array("probability")[1]))
    keep = [c for c in rows.columns if c != "features"]
    return reduce(DataFrame.unionByName, [o.select(*keep, "prediction_score") for o in out])


def rankings(scored: DataFrame) -> DataFrame:
    """``score`` and ``rank`` of each paper's candidates by the predicted score."""
    rank = S.rank_by(F.col("prediction_score"), F.col("reviewer_id"), by=["paper_id"])
    return scored.withColumn("rank", rank).withColumnRenamed("prediction_score", "score")


def group_sizes(rows: DataFrame, label: str = "label") -> DataFrame:
    """How many candidates a paper has, and how many are relevant: the groups of a pairwise ranker."""
    return rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n_relevant"))


def coefficients(rows: DataFrame, cols: list[str], label: str = "label") -> dict[str, float]:
    """The coefficients of a logistic regression on standardised features, both classes of equal weight; 0 with one class only."""
    counts = rows.groupBy(label).agg(F.count("*").alias("of_class"))
    if counts.count() < 2:
        return dict.fromkeys(cols, 0.0)
    total = counts.agg(F.sum("of_class").alias("all_rows"))
    rows = rows.join(F.broadcast(counts), label).join(F.broadcast(total)).withColumn("balanced", F.col("all_rows") / (2.0 * F.col("of_class")))  # two rows and one
    rows = VectorAssembler(inputCols=cols, outputCol="raw").transform(rows)
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    found = LogisticRegression(labelCol=label, weightCol="balanced", maxIter=100).fit(rows).coefficients
    return {c: float(x) for c, x in zip(cols, found, strict=True)}


def importance(rows: DataFrame, cols: list[str], groups: dict[str, str], label: str = "label") -> DataFrame:
    """``(kind, name, coefficient, direction, share)``: each feature's share of the absolute coefficients, and each group's."""
    found = rows.sparkSession.createDataFrame(sorted(coefficients(rows, cols, label).items()), "name string, coefficient double")  # a row a feature
    total = F.greatest(F.sum(F.abs("coefficient")).over(Window.partitionBy(F.lit(1))), F.lit(1e-300))
    group = F.coalesce(*[F.when(F.col("name") == n, g) for n, g in groups.items()], F.lit("Other"))
    found = found.select("name", "coefficient", (F.abs("coefficient") / total).alias("share"), group.alias("group"))
    direction = F.when(F.col("coefficient") > 0, "positive").otherwise("negative")
    each = found.select(F.lit("feature").alias("kind"), "name", "coefficient", direction.alias("direction"), "share")
    none = {"coefficient": F.lit(None).cast("double"), "direction": F.lit(None).cast("string")}
    sums = found.groupBy("group").agg(F.sum("share").alias("share")).select(F.lit("group").alias("kind"), F.col("group").alias("name"), none["coefficient"].alias("coefficient"), none["direction"].alias("direction"), "share")
    return each.unionByName(sums)
