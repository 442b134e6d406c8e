"""The graph score cascade: which source a paper's scores come from, and how they are scaled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S

#: Bounds of a fallback's score and of the confidence it gives.
FALLBACK_CAP, LEAST_CONFIDENCE, CONFIDENCE_SPAN, CONFIDENCE_CAP = 0.85, 0.20, 0.20, 0.35


def _any(x: Column) -> Column:
    """Whether a paper has a candidate above 0."""
    return F.max(F.coalesce(x, F.lit(0.0))).over(Window.partitionBy("paper_id")) > 0


def graph_scores(rows: DataFrame, top: int = 12, walks: bool = True) -> DataFrame:
    """A raw score, its confidence and its source for the first ``top`` candidates of every paper.

    ``rows``: paper_id, reviewer_id, place, stored and stored_confidence (overlap in the
    persistent graph), walked and walked_confidence (the candidate graph). A paper takes the
    stored scores if any of them is above 0, else the walked ones, or nothing where walks are
    off. One window a paper decides; later candidates have no row.
    """
    head = rows.where(F.col("place") <= top)
    stored = _any(F.col("stored"))
    source = F.when(stored, "stored").when(F.lit(walks), "walked").otherwise("none")
    head = head.withColumn("source", source)
    pick = lambda a, b: F.when(F.col("source") == "stored", F.coalesce(a, F.lit(0.0))).when(F.col("source") == "walked", F.coalesce(b, F.lit(0.0))).otherwise(0.0)
    return head.withColumns({"raw": pick(F.col("stored"), F.col("walked")), "confidence": pick(F.col("stored_confidence"), F.col("walked_confidence"))})


def normalised(rows: DataFrame) -> DataFrame:
    """``kg`` in 0 to 1 and the confidence it has, from ``raw``, ``confidence``, and the fallbacks ``citation`` and ``sparse`` of each candidate.

    A paper with a raw score above 0 is scaled by its least and largest (0.5 where all are
    equal). Else the citations stand in, or else the sparse topics, scaled likewise and
    lowered to the largest of them, ``FALLBACK_CAP`` at most, and each candidate's confidence
    is at least what its score gives. A paper without any evidence has 0 throughout. ``kind``
    names the branch.
    """
    own = Window.partitionBy("paper_id")
    value = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))
    rows = rows.withColumns({c: value(c) for c in ("raw", "citation", "sparse", "confidence")})
    kind = F.when(_any(F.col("raw")), "graph").when(_any(F.col("citation")), "citation").when(_any(F.col("sparse")), "sparse").otherwise("none")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("used", F.when(F.col("kind") == "graph", F.col("raw")).when(F.col("kind") == "citation", F.col("citation")).when(F.col("kind") == "sparse", F.col("sparse")).otherwise(0.0))
    scaled = S.minmax(F.col("used"), own, 0.5)
    cap = F.least(F.lit(FALLBACK_CAP), F.max("used").over(own))
    rows = rows.withColumn("kg", F.when(F.col("kind") == "graph", scaled).when(F.col("kind") == "none", 0.0).otherwise(scaled * cap))
    given = F.least(F.lit(CONFIDENCE_CAP), LEAST_CONFIDENCE + F.col("kg") * CONFIDENCE_SPAN)
    return rows.withColumn("confidence", F.when(F.col("kind").isin("citation", "sparse"), F.greatest("confidence", given)).otherwise(F.col("confidence"))).drop("used")


def candidate_confidence(graph: Column, kg: Column, fallback: Column) -> Column:
    """The graph's confidence where there is one; else the score, 0.49 at most, under a fallback, or 0."""
    return F.when(graph.isNotNull(), S.clamp(graph)).when(fallback, F.least(F.lit(0.49), S.clamp(kg))).otherwise(0.0)
