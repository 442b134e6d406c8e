"""The ranking operators: fusion, hybrid and single-paper scores, and the full ranking of one paper's reviewers.

Each works on all papers at once; normalisations and ranks are windows over a paper's candidates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import scores as S
from ..params import MODES
from .ranking import rrf_fusion, without_conflicts


def _paper() -> WindowSpec:
    return Window.partitionBy("paper_id")


@dataclass(frozen=True)
class Ranking:
    """Settings of ``rank_reviewers``; the weights of the full mode have no published values and must be given."""

    mode: str = "full"
    weights: dict[str, float] = field(default_factory=dict)
    kg_top: int = 12
    profile_top: int = 20
    floor: float = 0.40
    panel_floors: tuple[float, float] = (0.50, 0.25)
    rrf_weight: float = 0.0

    def by_signal(self) -> dict[str, float]:
        if self.mode == "full":
            return self.weights
        semantic, kg, profile = MODES[self.mode]
        return {"similarity": semantic, "kg": kg, "profile": profile}


def fusion_scores(rows: DataFrame, coi: DataFrame) -> DataFrame:
    """0.85 of the similarity (min-max over all of a paper's candidates), 0.05 graph, 0.10 mean of quality, acceptance and reliability.

    ``rows``: paper_id, reviewer_id, sim, kg, quality, acceptance, reliability; missing
    signals count 0, missing agents 0.5. Pairs in conflict leave after the normalisation.
    """
    agents = sum((F.coalesce(F.col(c), F.lit(0.5)) for c in ("quality", "acceptance", "reliability")), F.lit(0.0)) / 3
    rows = rows.withColumn("norm", S.minmax(F.col("sim"), _paper(), 0.0))
    score = 0.85 * F.col("norm") + 0.05 * F.coalesce("kg", F.lit(0.0)) + 0.10 * agents
    return without_conflicts(rows, coi).select("paper_id", "reviewer_id", F.round(score, 6).alias("score"))


def hybrid_scores(rows: DataFrame, coi: DataFrame, top: int = 20, boosted: int = 10) -> DataFrame:
    """the first ``top`` by similarity without conflicts; 0.85 similarity, 0.02 graph, 0.08 keywords, each min-max scaled.

    A graph score under 0.03 counts a fifth, a similarity under 0.3 halves the score; the
    first ``boosted`` get 0.08 by their place, and the ranks follow from that.
    """
    head = rows.withColumn("n", S.rank_by(F.col("sim"), F.col("reviewer_id"), by=["paper_id"])).where(F.col("n") <= top)
    head = without_conflicts(head, coi).withColumn("kg", F.when(F.col("kg") < 0.03, F.col("kg") * 0.2).otherwise(F.col("kg")))
    scaled = {c: S.minmax(F.col(c), _paper(), 0.0, 1e-8) for c in ("sim", "kg", "key")}
    score = 0.85 * scaled["sim"] + 0.02 * scaled["kg"] + 0.08 * scaled["key"]
    head = head.withColumn("score", F.when(F.col("sim") < 0.3, score * 0.5).otherwise(score))
    head = head.withColumn("n", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["paper_id"]))
    head = head.withColumn("score", F.col("score") + F.when(F.col("n") <= boosted, 0.08 / F.col("n")).otherwise(0.0))
    return head.select("paper_id", "reviewer_id", "score", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["paper_id"]).alias("rank"))


def single_paper_scores(rows: DataFrame) -> DataFrame:
    """0.7 similarity, 0.2 graph, 0.1 keywords, and 0.05 more where the keywords pass 0.15."""
    score = 0.7 * F.col("sim") + 0.2 * F.coalesce("kg", F.lit(0.0)) + 0.1 * F.col("key") + F.when(F.col("key") > 0.15, 0.05).otherwise(0.0)
    return rows.select("paper_id", "reviewer_id", F.round(score, 6).alias("score"))


def rejection_reasons(sim: Column, score: Column, flagged: Column, s: Ranking) -> Column:
    """why a candidate would not sit on a panel."""
    low, panel, final = s.floor, *s.panel_floors
    first = F.when((sim < low) & F.lit(s.mode == "full"), F.lit(f"semantic relevance below {low:.2f}"))
    more = F.when(sim < panel, F.lit(f"panel similarity floor below {panel:.2f}"))
    last = F.when(score < final, F.lit(f"panel quality floor below {final:.2f}"))
    return F.array_compact(F.array(first, more, last, F.when(flagged, F.lit("conflict of interest"))))


def rank_reviewers(rows: DataFrame, settings: Ranking) -> DataFrame:
    """F16: the ranked candidates of every paper.

    ``rows``: paper_id, reviewer_id, similarity, kg, kg_confidence, profile, authority, role,
    h, flagged, and optionally load and capacity. Similarity is scaled over the paper's
    candidates; the graph counts for the first ``kg_top`` of them and the profile for the
    first ``profile_top``; the mode's weights give a score, the policy changes it, the full
    mode mixes in reciprocal ranks, and free capacity scales it. Candidates in conflict,
    and full ones, keep their row with a null score and the last ranks.
    """
    w, full = settings.by_signal(), settings.mode == "full"
    at = S.rank_by(F.col("similarity"), F.col("reviewer_id"), by=["paper_id"])
    rows = rows.withColumns({"place": at, "sim": S.clamp(S.minmax(F.col("similarity"), _paper(), 0.5, 1e-8))})
    kg = S.clamp(F.when(F.col("place") <= settings.kg_top, F.col("kg")))
    signals = {
        "similarity": F.col("sim"),
        "authority": S.clamp(F.col("authority")),
        "kg": S.graph_effective(kg, F.col("sim"), S.clamp(F.col("kg_confidence")), full),
        "profile": S.clamp(F.when(F.col("place") <= settings.profile_top, F.col("profile"))),
        "workload": F.lit(1.0),
    }
    score = S.clamp(sum((F.lit(w.get(name, 0.0)) * x for name, x in signals.items()), F.lit(0.0)))
    score = S.policy(score, F.col("sim"), F.col("h"), F.col("role"), settings.floor if full else -1.0)
    rows = rows.withColumns({"base": score, "graph": kg * S.clamp(F.col("kg_confidence"))})
    rows = rows.withColumn("reasons", rejection_reasons(F.col("sim"), F.col("base"), F.col("flagged"), settings))
    if full and settings.rrf_weight:
        rows = rows.withColumn("hybrid", F.when(F.col("flagged"), -1.0).otherwise(F.col("base")))
        rows = rrf_fusion(rows, ["sim", "authority", "graph", "hybrid"], settings.rrf_weight).withColumn("base", S.clamp(F.col("fused")))
    final = F.when(~F.col("flagged"), F.col("base"))
    if "load" in rows.columns:
        final = F.when(F.col("load") < F.col("capacity"), S.available(final, F.col("load"), F.col("capacity")))
    rows = rows.withColumn("score", final)
    rank = F.row_number().over(_paper().orderBy(F.round("score", 9).desc_nulls_last(), "reviewer_id"))
    return rows.select("paper_id", "reviewer_id", "role", "score", rank.alias("rank"), "reasons")
