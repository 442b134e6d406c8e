"""Methods compared on the same candidates: rescoring modes, baselines, cut metrics, significance and a verdict.

A ranking is ``(mode, paper_id, reviewer_id, score, rank)``. All modes and all papers are
ranked in one window pass; nothing loops over papers or modes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from .evaluate import t_p_value

#: The rescoring modes, each by its weights of the named signals.
ABLATIONS = {
    "semantic_only": {"semantic": 1.0},
    "semantic_authority": {"semantic": 0.70, "authority": 0.30},
    "semantic_kg": {"semantic": 0.50, "kg": 0.50},
    "semantic_llm": {"semantic": 0.50, "llm": 0.50},
    "semantic_kg_llm": {"semantic": 0.34, "kg": 0.33, "llm": 0.33},
    "semantic_kg_authority": {"semantic": 0.75, "kg": 0.20, "authority": 0.05},
    "coi_filtering": {"semantic": 1.0},
}
#: The signals of the mode of reciprocal ranks, and the share of the second model's score.
FUSED = ("semantic", "authority", "kg", "final")
CROSS = 0.7


def _weighted(weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * F.coalesce(F.col(s), F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))


def ablations(rows: DataFrame, coi: DataFrame, depth: int = 100, tau: float = 0.5) -> DataFrame:
    """the nine modes over ``rows(paper_id, reviewer_id, semantic, authority, kg, llm, final, cross)``, the first ``depth`` of each.

    A null signal counts 0. Only the mode ``coi_filtering`` loses pairs of ``coi(paper_id,
    reviewer_id, coi_score, flagged)``. ``full`` mixes a positive ``cross`` in; without one
    it equals ``semantic_kg_llm``. ``rrf_fusion`` is the normalised sum of reciprocal ranks.
    """
    bad = F.coalesce("flagged", F.lit(False)) | (F.coalesce("coi_score", F.lit(0.0)) >= tau)
    held = coi.where(bad).select("paper_id", "reviewer_id").distinct().withColumn("held", F.lit(True))
    ranks = {f"at_{s}": S.rank_by(F.coalesce(F.col(s), F.lit(0.0)), F.col("reviewer_id"), by=["paper_id"]) for s in FUSED}
    rows = rows.withColumns(ranks).join(held, ["paper_id", "reviewer_id"], "left")
    base = _weighted(ABLATIONS["semantic_kg_llm"])
    scores = {m: _weighted(w) for m, w in ABLATIONS.items()}
    scores["coi_filtering"] = F.when(F.col("held").isNull(), scores["coi_filtering"])
    scores["rrf_fusion"] = S.rrf([F.col(f"at_{s}") for s in FUSED])
    scores["full"] = F.when(F.col("cross") > 0, (1 - CROSS) * base + CROSS * F.col("cross")).otherwise(base)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), x.alias("score")) for m, x in scores.items()]))
    rows = rows.select("paper_id", "reviewer_id", each.alias("x")).select("x.mode", "paper_id", "reviewer_id", "x.score").where("score is not null")
    return ranked(rows, depth)


def ranked(rows: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` of each mode and paper; ties by reviewer."""
    rank = S.rank_by(F.col("score"), F.col("reviewer_id"), by=["mode", "paper_id"])
    return rows.withColumn("rank", rank).where(F.col("rank") <= depth)


def listwise_bm25(pairs: DataFrame, papers: DataFrame, reviewers: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of every candidate pair, with frequencies and lengths over the paper's own candidates.

    ``papers`` and ``reviewers`` are term counts ``(id, term, tf)``. Pairs meet the paper's
    terms first and the reviewer's by (reviewer, term), so no row holds a whole text. A
    pair without a shared term scores 0; a reviewer without text has the length 0.
    """
    size = reviewers.groupBy(F.col("id").alias("reviewer_id")).agg(F.sum("tf").alias("len"))
    sized = pairs.select("paper_id", "reviewer_id").distinct().join(size, "reviewer_id", "left").na.fill(0, ["len"])
    of_paper = Window.partitionBy("paper_id")
    sized = sized.withColumns({"n": F.count("*").over(of_paper), "mean": F.avg("len").over(of_paper)})
    asked = sized.join(papers.select(F.col("id").alias("paper_id"), "term", F.col("tf").alias("qf")), "paper_id")
    met = asked.join(reviewers.withColumnRenamed("id", "reviewer_id"), ["reviewer_id", "term"])
    met = met.withColumn("df", F.count("*").over(Window.partitionBy("paper_id", "term")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - b + b * F.col("len") / F.greatest(F.col("mean"), F.lit(1e-9))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length) * F.col("qf")
    score = met.groupBy("paper_id", "reviewer_id").agg(F.sum(part).alias("score"))
    return sized.select("paper_id", "reviewer_id").join(score, ["paper_id", "reviewer_id"], "left").na.fill(0.0, ["score"])


def baselines(rows: DataFrame, lexical: DataFrame, seed: int = 42, depth: int = 3) -> DataFrame:
    """the first ``depth`` of a paper's candidates by similarity, words, chance, and h-index with citations.

    ``rows``: paper_id, reviewer_id, semantic, h, citations; ``lexical``: (paper_id,
    reviewer_id, score). Chance is the order of a hash of the seed and both ids, the same on every run.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("paper_id").cast("string"), F.col("reviewer_id").cast("string")))
    of_paper = Window.partitionBy("paper_id")
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 9).desc()
    orders = {"semantic": [zero("semantic")], "bm25": [zero("lexical")], "random": [draw], "authority": [zero("h"), zero("citations")]}
    rows = rows.join(lexical.withColumnRenamed("score", "lexical"), ["paper_id", "reviewer_id"], "left")
    places = {m: F.row_number().over(of_paper.orderBy(*o, "reviewer_id")) for m, o in orders.items()}
    rows = rows.select("paper_id", "reviewer_id", *[p.alias(m) for m, p in places.items()])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("rank")) for m in orders]))
    return rows.select("paper_id", "reviewer_id", each.alias("x")).select("x.mode", "paper_id", "reviewer_id", "x.rank").where(F.col("rank") <= depth)


def list_quality(rankings: DataFrame, truth: DataFrame, k: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """R16 for each mode and paper: precision by the list's own size, recall, reciprocal rank and NDCG of the first ``k``; all null without truth.

    With ``sizes(paper_id, n_truth)`` the truth needs no pairs but those that are ranked.
    """
    marks = truth.select("paper_id", "reviewer_id").distinct().withColumn("hit", F.lit(1))
    known = marks.groupBy("paper_id").agg(F.count("*").alias("m")) if sizes is None else sizes.withColumnRenamed("n_truth", "m")
    rows = rankings.where(F.col("rank") <= k).join(marks, ["paper_id", "reviewer_id"], "left")
    hit = F.col("hit").isNotNull()
    each = rows.groupBy("mode", "paper_id").agg(
        F.count("*").alias("n"),
        F.count("hit").alias("hits"),
        F.coalesce(F.max(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    each = each.join(known, "paper_id", "left")
    best = F.sequence(F.lit(1), F.least("m", "n").cast("int"))
    ideal = F.aggregate(best, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    has = F.col("m").isNotNull()
    return each.select(
        "mode", "paper_id", has.alias("has_truth"), F.when(has, F.col("hits") / F.col("n")).alias("precision"),
        F.when(has, F.col("hits") / F.col("m")).alias("recall"), F.when(has, F.col("rr")).alias("mrr"), F.when(has, F.col("dcg") / ideal).alias("ndcg"),
    )


def cut_metrics(marked: DataFrame, cuts: list[int] = (5, 10), depth: int = 100) -> DataFrame:
    """By mode the mean reciprocal rank that is 0 beyond each cut, and the share of papers with a hit in the first ``depth``.

    ``marked`` is a ranking with ``hit`` 0/1, as ``evaluate.hits`` gives it: papers with truth only.
    """
    first = marked.groupBy("mode", "paper_id").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    cut = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)), 6).alias(f"mrr_{k}")
    found = F.round(F.avg(F.coalesce(F.col("first") <= depth, F.lit(False)).cast("double")), 6).alias(f"recall_{depth}")
    return first.groupBy("mode").agg(F.count("*").alias("n_papers"), *[cut(k) for k in cuts], found)


def rerank_gate(rankings: DataFrame, row: int = 5, margin: float = 0.035) -> DataFrame:
    """whether a mode's order of a paper is open: fewer than ``row`` rows, or the first is less than ``margin`` above that row."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    each = rankings.groupBy("mode", "paper_id").agg(F.count("*").alias("n"), (at(1) - at(row)).alias("margin"))
    return each.select("mode", "paper_id", "margin", ((F.col("n") < row) | (F.col("margin") < margin)).alias("open"))


def significance(scores: DataFrame, base: str, value: str = "ndcg") -> DataFrame:
    """The paired t-test of mode ``base`` against each other mode over the papers both rank.

    Differences that do not vary, and single papers, give t = 0 and p = 1.
    """
    a = scores.where(F.col("mode") == base).select("paper_id", F.col(value).alias("a"))
    b = scores.where(F.col("mode") != base).select("mode", "paper_id", F.col(value).alias("b"))
    d = F.col("a") - F.col("b")
    each = b.join(a, "paper_id").where("a is not null and b is not null").groupBy("mode").agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd")
    )
    t = F.when(F.col("sd") < 1e-12, 0.0).otherwise(F.col("mean_difference") / (F.col("sd") / F.sqrt("n")))
    p_value = F.udf(t_p_value, "double", useArrow=False)  # a row a mode
    flat = F.col("sd") < 1e-12
    return each.withColumn("t", t).select("mode", "n", "mean_difference", "t", F.when(flat, 1.0).otherwise(p_value("t", F.col("n").cast("int") - 1)).alias("p_value"))


def verdict(means: DataFrame, tests: DataFrame, proposed: str, embedding: str, lexical: str, level: float = 0.05) -> DataFrame:
    """One row that says how the proposed mode stands to the two others, from ``mean_metrics`` and ``significance`` rows.

    Against the embedding a p-value at or above the level says "competitive", whatever the
    difference. A missing mode counts 0 in the lexical comparison and gives null deltas.
    """
    m = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    cols = [m(mode, c).alias(f"{n}_{c}") for n, mode in (("own", proposed), ("emb", embedding), ("lex", lexical)) for c in ("ndcg", "mrr", "map")]
    one = means.agg(*cols)
    p = tests.agg(m(embedding, "p_value").alias("p_embedding"), m(lexical, "p_value").alias("p_lexical"))
    rows = one.join(F.broadcast(p))  # one row each
    delta = {c: S.safe_delta(F.col(f"own_{c}"), F.col(f"emb_{c}")) for c in ("ndcg", "mrr", "map")}
    ranking = (
        F.when(F.col("p_embedding") >= level, "competitive_not_significantly_better_than_embedding")
        .when(delta["ndcg"] > 0, "improved_over_embedding").otherwise("does_not_outperform_embedding")
    )
    above = F.coalesce("own_ndcg", F.lit(0.0)) > F.coalesce("lex_ndcg", F.lit(0.0))
    words = (
        F.when(F.col("p_lexical") < level, "significantly_better_than_tfidf")
        .when(above, "better_than_tfidf_but_not_statistically_confirmed").otherwise("not_better_than_tfidf")
    )
    percent = S.percent_delta(F.col("own_ndcg"), F.col("emb_ndcg"))
    return rows.select(
        ranking.alias("ranking_status"), words.alias("tfidf_status"), *[F.round(x, 6).alias(f"{c}_delta") for c, x in delta.items()],
        F.round(percent, 4).alias("ndcg_percent"), F.round("p_embedding", 6).alias("p_value"),
    )


def hard_cases(rows: DataFrame, score: str, label: str, high: float = 0.7) -> DataFrame:
    """Relevant pairs that score nothing, and others above ``high``; null scores count 0."""
    x, hit = F.coalesce(F.col(score), F.lit(0.0)), F.coalesce(F.col(label), F.lit(0)) == 1
    kind = F.when(hit & (x <= 1e-12), "false_negative").when(~hit & (x > high), "high_false_positive")
    return rows.select("paper_id", "reviewer_id", kind.alias("kind"), x.alias("score")).where("kind is not null")
