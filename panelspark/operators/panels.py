"""Panels of all papers at once: eligibility, pools by role, fallbacks, ordered scores, and how a pick compares with its peers.

Everything that one paper's candidates decide is a window over the paper, so the rows are
shuffled once, by paper, for all stages; a pick reaches the paper's other rows as a struct
that the same window carries. Ties go to the more similar candidate, then to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..llm.common import bucketed


@dataclass(frozen=True)
class Panel:
    """Settings of ``select_panels``."""

    size: int = 3
    least: tuple[float, float] = (0.50, 0.25)
    primary: float = 0.55
    supporting: tuple[float, float] = (0.45, 0.30)
    moderate_authority: float = 0.25
    step: float = 0.03


#: What a slot says where its constraint held, and where the best available had to do.
HELD = {"expert": "Anchor semantic floor + authority", "moderate": "Above-median similarity", "fresher": "Complementary coverage reliability constraint"}
BEST = {"expert": "Best available anchor fit", "moderate": "Best available balanced match", "fresher": "Best available complementary coverage"}
COMPLETED = "Fallback panel completion"


def _own() -> Window:
    return Window.partitionBy("paper_id")


def _any(flag: Column) -> Column:
    return F.coalesce(F.max(flag).over(_own()), F.lit(False))


def _best(pool: Column, *by: Column) -> Column:
    """The paper's best candidate of a pool, on each of its rows: by values to 9 places, then by place."""
    keys = [F.round(x, 9).alias(f"k{i}") for i, x in enumerate(by)]
    return F.max(F.when(pool, F.struct(*keys, (-F.col("at")).alias("place"), F.col("terms"), F.col("covers")))).over(_own())


def _likeness(chosen: Column) -> Column:
    return F.when(chosen.isNotNull(), S.jaccard(F.col("terms"), chosen["terms"])).otherwise(0.0)


def _gain(*chosen: Column) -> Column:
    """The share of a candidate's terms that those chosen don't cover."""
    none = F.array().cast("array<string>")
    seen = F.flatten(F.array(*[F.coalesce(c["covers"], none) for c in chosen]))
    own = F.col("covers")
    return F.when(F.size(own) == 0, 0.0).when(F.size(seen) == 0, 1.0).otherwise(F.size(F.array_except(own, seen)) / F.size(own))


def select_panels(rows: DataFrame, s: Panel = Panel()) -> DataFrame:  # noqa: B008
    """The panel of every paper that has an eligible candidate, in order of choice.

    ``rows``: paper_id, reviewer_id, sim, authority, score (null: excluded), role, failed
    (below the relevance threshold), terms and covers (arrays of string). Eligible are those
    with a score that pass both least values. The expert is the one of most authority among
    the most similar experts at or above a floor, half the eligible ones' similarity at
    least; without an expert or without one above the floor the next pool stands in. The
    moderate one has most marginal value, the fresher one most of relevance less redundancy.
    Open slots go to the most similar eligible ones, then to anyone with a score. A paper
    with no eligible candidate has no panel.

    ``score`` of a candidate that was ranked for the last slot is lowered by 0.30 of its
    redundancy, be it chosen there, as a completion, or, where the pool of that slot is empty
    and all others stand in, as the moderate one. Null sims and authorities count 0. A
    repeated candidate takes part as often as it occurs.
    """
    own, sim, auth, role = _own(), F.col("sim"), F.col("authority"), F.col("role")
    zero = F.lit(0.0)
    rows = rows.withColumns({"sim": F.coalesce(sim, zero), "authority": F.coalesce(auth, zero), "terms": F.coalesce("terms", F.array().cast("array<string>")), "covers": F.coalesce("covers", F.array().cast("array<string>"))})
    ok = F.col("score").isNotNull() & ~F.coalesce(F.col("failed"), F.lit(False)) & (sim >= s.least[0]) & (F.col("score") >= s.least[1])
    order = own.orderBy(F.desc("ok"), F.round("sim", 9).desc(), "reviewer_id")
    rows = rows.withColumn("ok", ok).withColumn("at", F.row_number().over(order))
    middle = lambda c: F.percentile(F.when(F.col("ok"), F.col(c)), F.lit(0.5)).over(own)
    rows = rows.withColumns({"sim_mid": middle("sim"), "auth_mid": middle("authority")}).withColumn("floor", F.greatest(F.lit(s.primary), F.col("sim_mid")))
    near = F.col("ok") & (F.col("at") <= max(12, 6 * s.size))
    rows = rows.withColumns({"p1": near & (sim >= F.col("floor")), "p2": near & (sim >= s.primary), "p3": near & (F.col("at") <= 3)})
    rows = rows.withColumn("primary", F.when(_any(F.col("p1")), F.col("p1")).when(_any(F.col("p2")), F.col("p2")).otherwise(F.col("p3")))
    rows = rows.withColumn("experts", F.col("primary") & (role == "expert"))
    rows = rows.withColumn("no_expert", ~_any(F.col("experts")))
    a = F.col("a")
    rows = rows.withColumn("a", _best(F.when(F.col("no_expert"), F.col("primary")).otherwise(F.col("experts")), auth, sim))
    chosen = lambda c: F.coalesce(F.col("at") == -c["place"], F.lit(False))

    # the second slot
    usual = F.greatest(F.lit(s.moderate_authority), F.col("auth_mid"))
    rest = F.col("ok") & ~chosen(a)
    nth = F.col("at") - F.when(F.col("at") > -a["place"], 1).otherwise(0)
    rows = rows.withColumn("m1", rest & (nth <= max(15, 6 * s.size)) & (sim >= F.col("sim_mid")) & ((role == "moderate") | (auth >= usual)))
    rows = rows.withColumn("m2", rest & (role.isin("moderate", "expert") | (auth >= usual))).withColumn("rest", rest)
    rows = rows.withColumn("moderates", F.when(_any(F.col("m1")), F.col("m1")).when(_any(F.col("m2")), F.col("m2")).otherwise(F.col("rest")))
    marginal = 0.64 * (0.68 * sim + 0.32 * auth) + 0.28 * _gain(a) - 0.12 * _likeness(a)
    b = F.col("b")
    rows = rows.withColumn("b", _best(F.col("moderates"), marginal, sim))

    # the third
    floor, least = s.supporting
    young = F.col("ok") & ~chosen(a) & ~chosen(b) & ((role == "fresher") | (auth <= F.col("auth_mid"))) & (sim >= F.greatest(F.lit(floor), F.col("sim_mid") * 0.75)) & (auth >= least)
    rows = rows.withColumn("f1", young)
    rows = rows.withColumn("freshers", F.when(_any(F.col("f1")), F.col("f1")).otherwise(F.col("rest") & (sim >= floor) & (auth >= least)))
    rows = rows.withColumn("penalty", F.greatest(_likeness(a), _likeness(b)))
    mmr = 0.64 * (0.70 * sim + 0.30 * auth) - 0.36 * F.col("penalty") + 0.22 * _gain(a, b)
    c = F.col("c")
    rows = rows.withColumn("c", _best(F.col("freshers") & ~chosen(b), mmr))
    lowered = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") - 0.30 * F.col("penalty")))
    rows = rows.withColumn("final", F.when(F.col("freshers"), lowered).otherwise(F.col("score")))

    # completion: the eligible by similarity, then all that have a score
    rows = rows.withColumn("slot", F.when(chosen(a), 1).when(chosen(b), 2).when(chosen(c), 3))
    taken = F.count("slot").over(own)
    rows = rows.withColumn("taken", taken)
    tier = F.when(F.col("slot").isNotNull(), 0).when(F.col("ok"), 1).when(F.col("score").isNotNull(), 2)
    last = F.when(F.col("ok"), -F.col("at")).otherwise(F.round("sim", 9))
    order = own.orderBy(F.asc_nulls_last("tier"), "slot", last.desc(), F.round("final", 9).desc(), F.round("authority", 9).desc(), "reviewer_id")
    rows = rows.withColumn("tier", tier).withColumn("nth", F.row_number().over(order)).where(_has_panel() & F.col("tier").isNotNull() & (F.col("nth") <= s.size))
    weak = (F.col("tier") == 2) | ((F.col("tier") == 1) & (F.col("nth") > 2) & ((sim < floor) | (auth < least)))
    kind = F.when(F.col("slot") == 1, "expert").when(F.col("slot") == 2, "moderate").when(F.col("slot") == 3, "fresher")
    held = F.when(F.col("slot") == 1, ~F.col("no_expert") & (sim >= F.col("floor"))).when(F.col("slot") == 2, F.col("m1"))
    held = held.when(F.col("slot") == 3, (1 - F.col("penalty") >= 0.20) & (sim >= floor) & (auth >= least)).when(weak, F.lit(False))
    label = F.when(weak, F.lit(COMPLETED))
    for name in HELD:
        label = F.when((kind == name) & held, F.lit(HELD[name])).when(kind == name, F.lit(BEST[name])).otherwise(label)
    return rows.select("paper_id", F.col("nth").alias("slot"), "reviewer_id", F.coalesce(kind, role).alias("role"), "sim", "authority", F.col("final").alias("score"), held.alias("satisfied"), label.alias("label"))


def _has_panel() -> Column:
    return F.col("a").isNotNull()


def ordered_scores(panels: DataFrame, step: float = Panel.step) -> DataFrame:
    """Scores that fall from slot to slot: one not below its predecessor becomes that less ``step``. A panel's rows are folded as an array of its size."""
    one = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    def fall(done: Column, x: Column) -> Column:
        own, last = one(F.coalesce(x["score"], F.lit(0.0))), F.try_element_at(done, F.lit(-1))["assigned"]
        score = F.when(last.isNotNull() & (own >= last), one(last - step)).otherwise(own)
        return F.concat(done, F.array(F.struct(x["slot"].alias("slot"), x["reviewer_id"].alias("reviewer_id"), score.alias("assigned"))))

    kinds = dict(panels.dtypes)
    none = F.array().cast(f"array<struct<slot:{kinds['slot']},reviewer_id:{kinds['reviewer_id']},assigned:double>>")
    slots = F.sort_array(F.collect_list(F.struct("slot", "reviewer_id", "score")))
    got = panels.groupBy("paper_id").agg(F.aggregate(slots, none, fall).alias("x"))
    return got.select("paper_id", F.inline("x"))


def places(ranked: DataFrame) -> DataFrame:
    """The place of every candidate that isn't excluded and its share of all of those; nulls for excluded ones."""
    own = _own()
    order = own.orderBy(F.round("score", 9).desc_nulls_last(), "reviewer_id")
    there = F.col("score").isNotNull()
    rows = ranked.withColumn("place", F.row_number().over(order))
    return rows.withColumns({"final_rank": F.when(there, F.col("place")), "percentile": F.when(there, F.col("place") / F.count("score").over(own))})


def context(ranked: DataFrame) -> DataFrame:
    """The paper's mean and best similarity, mean authority and mean graph score over those not excluded."""
    there = F.col("score").isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(there, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0))
    top = F.coalesce(F.max(F.when(there, F.col("sim"))), F.lit(0.0))
    return ranked.groupBy("paper_id").agg(mean("sim").alias("avg_similarity"), top.alias("top_similarity"), mean("authority").alias("avg_authority"), mean("kg").alias("avg_kg"))


def peers(panels: DataFrame, ranked: DataFrame, most: int = 2) -> DataFrame:
    """For each pick the first ``most`` candidates, in order of rank, that score lower, and how many do; excluded ones are lower than all.

    A paper's picks are as many as its slots, so the join has that many rows a candidate;
    those kept for naming are cut in the window before anything is gathered.
    """
    pick = panels.select("paper_id", "slot", F.col("reviewer_id").alias("picked"), F.col("score").alias("own"))
    other = places(ranked).select("paper_id", F.col("reviewer_id").alias("peer"), F.col("score").alias("theirs"), "place")
    lower = F.col("theirs").isNull() | (F.round("own", 9) > F.round("theirs", 9))
    below = pick.join(other, "paper_id").where((F.col("picked") != F.col("peer")) & lower)
    n = below.groupBy("paper_id", "slot").agg(F.count("*").alias("outranked"))
    first = below.withColumn("n", F.row_number().over(Window.partitionBy("paper_id", "slot").orderBy("place"))).where(F.col("n") <= most)
    named = first.groupBy("paper_id", "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "peer"))), lambda x: x["peer"]).alias("peers"))
    none = F.array().cast(f"array<{dict(ranked.dtypes)['reviewer_id']}>")
    out = pick.select("paper_id", "slot", F.col("picked").alias("reviewer_id"))
    out = _on_paper(_on_paper(out, n, ["slot"], "left"), named, ["slot"], "left")
    return out.withColumns({"outranked": F.coalesce("outranked", F.lit(0).cast("long")), "peers": F.coalesce("peers", none)})


def weakness(role: Column, sim: Column, authority: Column, kg: Column, citations: Column, avg_authority: Column) -> Column:
    """The first weakness that applies to a pick in its role, or what it stands for."""
    thin = F.coalesce(kg, F.lit(0.0)) < 0.15
    expert = F.when(sim < 0.40, "Low topic similarity").when(authority < F.greatest(F.lit(0.45), avg_authority * 0.80), "Lower academic authority for expert role").otherwise("Strong authority profile with sufficient topic alignment")
    moderate = F.when(sim.between(0.30, 0.50), "Moderate alignment").when((sim < 0.30) & thin, "Limited topic alignment").when(authority < 0.25, "Lower academic authority").otherwise("Balanced topic alignment with sufficient authority")
    other = F.when((sim < 0.25) & thin, "Exploratory coverage").when(F.coalesce(citations, F.lit(0)) < 20, "Exploratory coverage with limited citation evidence").otherwise("Relevant topical exposure with acceptable reliability evidence")
    return F.when(role == "expert", expert).when(role == "moderate", moderate).otherwise(other)


def _on_paper(a: DataFrame, b: DataFrame, also: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on the paper and ``also``; only the paper is a key of the join, so rows that lie by the paper stay where they are."""
    names = {c: f"__{c}" for c in ["paper_id", *also]}
    b = b.withColumnsRenamed(names)
    same = F.col("paper_id") == F.col("__paper_id")
    for c in also:
        same = same & F.array_contains(F.array(F.col(c)), F.col(names[c]))
    return a.join(b, same, how).drop(*names.values())


def assign_panels(ranked: DataFrame, s: Panel = Panel()) -> DataFrame:  # noqa: B008
    """The panels of ranked candidates with ordered scores, peers, percentiles and weaknesses.

    ``ranked`` holds what ``select_panels`` takes, and kg and citations. It and the panels are
    tables in buckets by the paper, and all joins are on the paper, so nothing is shuffled from there on.
    """
    many = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = bucketed(ranked.repartition(many, "paper_id"), "paper_id")
    panels = bucketed(select_panels(ranked, s), "paper_id")
    about = places(ranked).select("paper_id", "reviewer_id", "percentile", "kg", "citations")
    out = _on_paper(panels, ordered_scores(panels, s.step), ["slot", "reviewer_id"])
    out = _on_paper(_on_paper(out, about, ["reviewer_id"], "left"), peers(panels, ranked), ["slot", "reviewer_id"]).join(context(ranked), "paper_id")
    return out.withColumn("weakness", weakness(F.col("role"), F.col("sim"), F.col("authority"), F.col("kg"), F.col("citations"), F.col("avg_authority")))
