"""The registered queries of the engine over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as T
from ..llm.common import written
from ..operators import evaluate as E
from ..operators import knowledge as K
from ..operators import learned as L
from ..operators import ranking as R
from ..operators import scoring as G
from ..operators import wordsearch as B
from ..params import GRID, MODES
from ..sources import tables as X
from ..streaming import workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- every 50th embedding is a paper (in ranking_quality_by_k each one), all are candidates; relevant is the same label

PAPERS = "vec_id % 50 = 0"


#: Papers that are ranked at a time where all embeddings are papers.
AT_ONCE = 65_536


def _ranked(spark, d, k=100, papers=PAPERS, block=None):
    e = table(spark, d, "embeddings")
    q = e.where(papers).select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("v"))
    return R.vector_top_k(q, e.select(F.col("vec_id").alias("reviewer_id"), F.col("embedding").alias("v")), k, block).persist()  # k rows a paper, read several times


def _truth(spark, d, rows):
    """Which pairs of ``rows`` have one label. The other pairs of a label, which grow with the square of the table, are never made: ``_truth_sizes`` counts them."""
    e = table(spark, d, "embeddings")
    pairs = rows.select("paper_id", "reviewer_id").distinct().where("paper_id <> reviewer_id")
    return pairs.join(e.select(F.col("vec_id").alias("paper_id"), "label"), "paper_id").join(e.select(F.col("vec_id").alias("reviewer_id"), "label"), ["reviewer_id", "label"]).select("paper_id", "reviewer_id")


def _truth_sizes(spark, d, papers=PAPERS):
    """``(paper_id, n_truth)`` of the papers whose label others have too: rows of the label without the paper's own."""
    e = table(spark, d, "embeddings")
    size = e.groupBy("label").agg(F.count("*").alias("n"))
    own = e.where(papers).groupBy(F.col("vec_id").alias("paper_id"), "label").agg(F.count("*").alias("c"))
    return own.join(size, "label").groupBy("paper_id").agg(F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("n_truth")).where("n_truth > 0")


def _hits(spark, d, rows, papers=PAPERS):
    return E.hits(rows, _truth(spark, d, rows), _truth_sizes(spark, d, papers))


def _scores(spark, d, k):
    return E.per_paper(_hits(spark, d, _ranked(spark, d)), k)


RANKED = """WITH s AS (SELECT a.vec_id paper_id, b.vec_id reviewer_id, a.label la, b.label lb, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) score
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, reviewer_id) rank FROM s QUALIFY rank <= 100),
t AS (SELECT a.vec_id paper_id, count(*) n_truth FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1),
h AS (SELECT r.*, n_truth, CASE WHEN la = lb THEN 1 ELSE 0 END hit, sum(CASE WHEN la = lb THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY rank) seen FROM r JOIN t USING (paper_id)),
m(k) AS (VALUES (3), (5), (10)),
p AS (SELECT k, paper_id, n_truth, coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rank END), 0) rr, sum(CASE WHEN hit = 1 THEN seen::DOUBLE / rank ELSE 0 END) / n_truth ap,
 sum(CASE WHEN rank <= k THEN hit ELSE 0 END) top, sum(CASE WHEN rank <= k AND hit = 1 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(range(1, least(n_truth, k) + 1), lambda x: 1 / log2(x + 1.0::DOUBLE))) ndcg,
 sum(CASE WHEN rank <= k AND hit = 1 THEN seen::DOUBLE / rank ELSE 0 END) / least(n_truth, k) ap_k FROM h, m GROUP BY k, paper_id, n_truth)
"""
MEANS = "count(*) n_papers, round(avg(top::DOUBLE / k), 6) AS \"precision\", round(avg(top::DOUBLE / n_truth), 6) recall, round(avg(rr), 6) mrr, round(avg(ap), 6) map, round(avg(ndcg), 6) ndcg"


@query(RANKED + "SELECT paper_id, reviewer_id, round(score, 6) score, rank FROM r WHERE rank <= 10")
def vector_topk(spark, d):
    """J02, M02, F05."""
    return _ranked(spark, d, 10).select("paper_id", "reviewer_id", F.round("score", 6).alias("score"), "rank")


@query(RANKED + f"SELECT {MEANS} FROM p WHERE k = 3")
def ranking_quality(spark, d):
    """R01-R05, J10, J11."""
    return E.mean_metrics(_scores(spark, d, 3), [])


@query(RANKED.replace(" WHERE a.vec_id % 50 = 0", "") + f"SELECT k, {MEANS} FROM p GROUP BY k")
def ranking_quality_by_k(spark, d):
    """R04-R07 at three depths, from one ranking of all items by every embedding.

    Papers are ranked and scored ``AT_ONCE`` at a time, which bounds what lies on the disks; the multiplications are those of all pairs.
    """
    n = table(spark, d, "embeddings").count()
    parts = max(1, -(-n // AT_ONCE))
    out = None
    for i in range(parts):
        papers = F.col("vec_id").isNotNull() & (F.pmod(F.hash("vec_id"), F.lit(parts)) == i)
        ranked = _ranked(spark, d, papers=papers, block=max(R.QUERY_BLOCK, min(n, AT_ONCE) // 8))
        rows = _hits(spark, d, ranked, papers)
        each = None
        for k in (3, 5, 10):
            part = E.per_paper(rows, k).withColumn("k", F.lit(k))
            each = part if each is None else each.unionByName(part)
        if parts > 1:
            each = written(each)
            ranked.unpersist(True)
        out = each if out is None else out.unionByName(each)
    return E.mean_metrics(out, ["k"])


@query(RANKED + "SELECT count(*) n_hit, round(avg(ap_k), 6) map_conditional FROM p WHERE k = 3 AND top > 0")
def map_conditional(spark, d):
    """R08."""
    return E.conditional_map(_scores(spark, d, 3), [])


@query(RANKED + "SELECT round(avg(CASE WHEN top > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) hit_rate FROM p WHERE k = 10")
def hit_rate_at_k(spark, d):
    """R09."""
    return E.hit_rate(_scores(spark, d, 10), [])


@query(RANKED + "SELECT round(count(DISTINCT reviewer_id)::DOUBLE / (SELECT count(*) FROM embeddings), 6) coverage, round(count(DISTINCT reviewer_id)::DOUBLE / count(*), 6) diversity FROM r WHERE rank <= 10")
def coverage_at_k(spark, d):
    """R10-R12."""
    return E.coverage(_ranked(spark, d), F.lit(table(spark, d, "embeddings").count()), 10)


@query(RANKED + """, w AS (SELECT *, min(score) OVER x lo, max(score) OVER x hi, avg(score) OVER x mu, stddev_pop(score) OVER x sd FROM r WINDOW x AS (PARTITION BY paper_id))
SELECT paper_id, reviewer_id, round(CASE WHEN hi - lo <= 1e-8 THEN 0.5 ELSE (score - lo) / (hi - lo + 1e-8) END, 6) mm_half, round(CASE WHEN hi - lo <= 1e-8 THEN 0 ELSE (score - lo) / (hi - lo) END, 6) mm_zero,
 round(CASE WHEN sd <= 1e-9 THEN 0.5 ELSE 1 / (1 + exp(-least(greatest((score - mu) / sd, -30), 30))) END, 6) z FROM w""")
def normalisations(spark, d):
    """M12, M14-M18."""
    w = Window.partitionBy("paper_id")
    s = F.col("score")
    return _ranked(spark, d).select("paper_id", "reviewer_id", F.round(S.minmax(s, w, 0.5, 1e-8), 6).alias("mm_half"), F.round(S.minmax(s, w, 0.0), 6).alias("mm_zero"), F.round(S.standardise(s, w), 6).alias("z"))


def _signals(spark, d):
    """Three signals of each ranked pair: cosine, and two from the ids."""
    r = _ranked(spark, d).select("paper_id", "reviewer_id", F.col("score").alias("semantic"))
    return r.withColumns({"kg": F.pmod(F.col("paper_id") * 7 + F.col("reviewer_id") * 13, F.lit(101)) / 100.0, "profile": F.pmod(F.col("paper_id") * 3 + F.col("reviewer_id") * 5, F.lit(89)) / 88.0}).withColumn("base", S.clamp(F.col("semantic")))


SIGNALS = RANKED + ", g AS (SELECT paper_id, reviewer_id, score semantic, ((paper_id * 7 + reviewer_id * 13) % 101) / 100.0::DOUBLE kg, ((paper_id * 3 + reviewer_id * 5) % 89) / 88.0::DOUBLE profile, least(greatest(score, 0), 1) base FROM r)\n"


@query(SIGNALS + """, k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(semantic, 9) DESC, reviewer_id) r1, row_number() OVER (PARTITION BY paper_id ORDER BY round(kg, 9) DESC, reviewer_id) r2, row_number() OVER (PARTITION BY paper_id ORDER BY round(profile, 9) DESC, reviewer_id) r3 FROM g)
SELECT paper_id, reviewer_id, round((1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) + 1.0::DOUBLE / (60 + r3)) / (3.0::DOUBLE / 61), 6) rrf, round(0.7 * base + 0.3 * (1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) + 1.0::DOUBLE / (60 + r3)) / (3.0::DOUBLE / 61), 6) fused FROM k""")
def rrf_fusion(spark, d):
    """F05-F07."""
    return R.rrf_fusion(_signals(spark, d), ["semantic", "kg", "profile"], 0.3).select("paper_id", "reviewer_id", F.round("rrf", 6).alias("rrf"), F.round("fused", 6).alias("fused"))


_MODES_SQL = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for m, (a, b, c) in MODES.items())


@query(SIGNALS + f", w(mode, a, b, c) AS (VALUES {_MODES_SQL}) SELECT paper_id, reviewer_id, mode, round(least(greatest(a * semantic + b * kg + c * profile, 0), 1), 6) score FROM g, w")
def fusion_modes(spark, d):
    """F08-F10, F17, F27."""
    return R.by_mode(_signals(spark, d), MODES, ["semantic", "kg", "profile"]).withColumn("score", F.round("score", 6))


_GRID_SQL = ", ".join(f"('{i}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(GRID))


@query(SIGNALS + f""", w(mode, a, b, c) AS (VALUES {_GRID_SQL}), x AS (SELECT mode, paper_id, reviewer_id, least(greatest(a * semantic + b * kg + c * profile, 0), 1) sc FROM g, w),
y AS (SELECT *, row_number() OVER (PARTITION BY mode, paper_id ORDER BY round(sc, 9) DESC, reviewer_id) rk FROM x),
z AS (SELECT mode, y.paper_id, y.rk, CASE WHEN ea.label = eb.label THEN 1 ELSE 0 END hit, n_truth FROM y JOIN embeddings ea ON ea.vec_id = y.paper_id JOIN embeddings eb ON eb.vec_id = y.reviewer_id JOIN t ON t.paper_id = y.paper_id),
u AS (SELECT mode, paper_id, coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rk END), 0) rr, sum(CASE WHEN rk <= 3 THEN hit ELSE 0 END) top, n_truth FROM z GROUP BY mode, paper_id, n_truth)
SELECT mode, round(avg(rr), 6) mrr, round(avg(top / 3.0::DOUBLE), 6) AS "precision" FROM u GROUP BY mode""")
def fusion_weight_grid(spark, d):
    """every weight triple from one pass over the signals."""
    rows = R.by_mode(_signals(spark, d), {str(i): w for i, w in enumerate(GRID)}, ["semantic", "kg", "profile"])
    rows = rows.withColumn("rank", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["mode", "paper_id"]))
    return E.mean_metrics(E.per_paper(_hits(spark, d, rows), 3, ["mode", "paper_id"]), ["mode"]).select("mode", "mrr", "precision")


@query(SIGNALS + """, q AS (SELECT *, 0.4 * greatest(semantic, 0) a, 0.35 * kg b, 0.25 * profile c FROM g)
SELECT paper_id, reviewer_id, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 0 END, 6) share_semantic, round(CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 0 END, 6) share_kg,
 CASE WHEN a >= b AND a >= c THEN 'semantic' WHEN b >= c THEN 'kg' ELSE 'profile' END dominant FROM q""")
def score_contributions(spark, d):
    """F11."""
    rows = _signals(spark, d).withColumn("semantic", F.greatest("semantic", F.lit(0.0)))
    return R.contributions(rows, {"semantic": 0.4, "kg": 0.35, "profile": 0.25}).select("paper_id", "reviewer_id", F.round("share_semantic", 6).alias("share_semantic"), F.round("share_kg", 6).alias("share_kg"), "dominant")


@query(SIGNALS + """SELECT paper_id, reviewer_id, round(0.6 * semantic + 0.3 * kg + 0.1 * profile, 6) weighted, round(least(kg, semantic + 0.25) * profile, 6) kg_effective,
 round(CASE WHEN semantic < 0.4 THEN 0.75 * semantic ELSE 0.6 * semantic + 0.2 * profile + 0.2 * kg END, 6) relevance, CASE WHEN (CASE WHEN semantic < 0.4 THEN 0.75 * semantic ELSE 0.6 * semantic + 0.2 * profile + 0.2 * kg END) < 0.40 THEN 'low'
 WHEN (CASE WHEN semantic < 0.4 THEN 0.75 * semantic ELSE 0.6 * semantic + 0.2 * profile + 0.2 * kg END) < 0.65 THEN 'medium' ELSE 'high' END label FROM g""")
def weighted_scores(spark, d):
    """F01, F04, F09, A24."""
    s, k, p = F.col("semantic"), F.col("kg"), F.col("profile")
    rel = S.relevance(s, p, k)
    return _signals(spark, d).select("paper_id", "reviewer_id", F.round(0.6 * s + 0.3 * k + 0.1 * p, 6).alias("weighted"), F.round(S.graph_effective(k, s, p), 6).alias("kg_effective"), F.round(rel, 6).alias("relevance"), S.relevance_label(rel).alias("label"))


@query(RANKED + """, v AS (SELECT label, i, avg(embedding[i]::DOUBLE) x FROM embeddings, range(1, 65) q(i) GROUP BY label, i)
SELECT label, round(sqrt(sum(x * x)), 6) norm, round(max(x) / sqrt(sum(x * x)), 6) top FROM v GROUP BY label""")
def mean_pooled_profile(spark, d):
    """M04."""
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")))
    return v.groupBy("label").agg(F.round(norm, 6).alias("norm"), F.round(F.max("x") / norm, 6).alias("top"))


# ---- assignments: lineitem (paper is the order, reviewer the supplier)

def _assigned(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("reviewer_id"))


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("reviewer_id"), F.col("s_nationkey").alias("nation"))


LOADS = "WITH l AS (SELECT s_suppkey reviewer_id, count(l_suppkey) load FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)\n"


@query(LOADS + """, o AS (SELECT load::DOUBLE x, row_number() OVER (ORDER BY load, reviewer_id) i, count(*) OVER () n FROM l)
SELECT max(n) n, sum(x)::BIGINT total, min(x)::BIGINT min_load, max(x)::BIGINT max_load, round(avg(x), 6) mean_load, round(stddev_pop(x), 6) std_load, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) gini, round(sum(x) * sum(x) / (max(n) * sum(x * x)), 6) jain FROM o""")
def gini_jain_load(spark, d):
    """W01-W03, W08, W10."""
    return E.gini_jain(E.loads(_suppliers(spark, d), _assigned(spark, d)))


@query(LOADS + "SELECT count(*) n, sum(CASE WHEN load >= 600 THEN 1 ELSE 0 END)::BIGINT overloaded, round(avg(CASE WHEN load >= 600 THEN 1.0::DOUBLE ELSE 0 END), 6) rate FROM l")
def overload_rate(spark, d):
    """W04."""
    return E.overload(E.loads(_suppliers(spark, d), _assigned(spark, d)), 600)


@query(LOADS + """, s AS (SELECT avg(load) m, stddev_pop(load) sd, max(load) mx FROM l) SELECT reviewer_id, load, round(load::DOUBLE / mx, 6) share, CASE WHEN load = 0 THEN 'idle' WHEN load <= m THEN 'light' WHEN load <= m + greatest(sd, 1) THEN 'moderate' ELSE 'heavy' END band,
 CASE WHEN load <= 0 THEN 'Unused' WHEN load >= mx THEN 'At Capacity' WHEN load * 100.0::DOUBLE / mx < 40 THEN 'Low' WHEN load * 100.0::DOUBLE / mx <= 70 THEN 'Moderate' WHEN load * 100.0::DOUBLE / mx <= 90 THEN 'High' ELSE 'Near Capacity' END label FROM l, s""")
def workload_registry(spark, d):
    """W13-W15."""
    l = E.loads(_suppliers(spark, d), _assigned(spark, d))
    s = l.agg(F.avg("load").alias("m"), F.stddev_pop("load").alias("sd"), F.max("load").alias("mx"))
    share = F.col("load") / F.col("mx")
    return l.join(F.broadcast(s)).select("reviewer_id", "load", F.round(share, 6).alias("share"), E.workload_band(F.col("load"), F.col("m"), F.col("sd")).alias("band"), E.utilisation_label(F.col("load"), F.col("mx")).alias("label"))


def _coi(spark, d):
    """A conflict where the customer and the supplier are of one nation."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("paper_id"), F.col("c_nationkey").alias("nation"))
    pairs = _assigned(spark, d).distinct().join(o, "paper_id").join(_suppliers(spark, d).withColumnRenamed("nation", "home"), "reviewer_id")
    score, flag = R.coi_status(F.lit(0.0), F.lit(False), F.col("nation") == F.col("home"))
    return pairs.select("paper_id", "reviewer_id", score.alias("coi_score"), flag.alias("flagged")).where("flagged")


COI = "WITH c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey)\n"


@query(COI + "SELECT count(*) total, count(c.l_orderkey) violations, round(count(c.l_orderkey)::DOUBLE / count(*), 6) rate FROM lineitem l LEFT JOIN c ON l.l_orderkey = c.l_orderkey AND l.l_suppkey = c.l_suppkey")
def coi_violation_rate(spark, d):
    """W05, A06, J07."""
    return E.coi_violations(_assigned(spark, d), _coi(spark, d))


@query(COI + "SELECT l_suppkey reviewer_id, count(*) n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = l.l_orderkey AND c.l_suppkey = l.l_suppkey) GROUP BY 1")
def coi_antijoin(spark, d):
    """J08."""
    return R.without_conflicts(_assigned(spark, d), _coi(spark, d)).groupBy("reviewer_id").agg(F.count("*").alias("n"))


def _people(spark, d):
    """h: how many parts a supplier has sent as often as that, by counts; citations: its quantity."""
    l = table(spark, d, "lineitem")
    return l.groupBy(F.col("l_suppkey").alias("reviewer_id")).agg((F.count("*") % 40).cast("double").alias("h"), F.sum("l_quantity").alias("citations"))


PEOPLE = """WITH p AS (SELECT l_suppkey reviewer_id, (count(*) % 40)::DOUBLE h, sum(l_quantity) citations FROM lineitem GROUP BY 1),
s AS (SELECT min(h) h0, max(h) h1, quantile_cont(h, 0.25) p25, quantile_cont(h, 0.75) p75, min(citations) c0, max(citations) c1 FROM p),
a AS (SELECT reviewer_id, h, least(0.8, 0.7 * CASE WHEN h1 > h0 THEN (h - h0) / (h1 - h0) ELSE 0 END + 0.3 * CASE WHEN c1 > c0 THEN (ln(1 + citations) - ln(1 + c0)) / (ln(1 + c1) - ln(1 + c0)) ELSE 0 END) authority, CASE WHEN h >= p75 THEN 'expert' WHEN h <= p25 THEN 'fresher' ELSE 'moderate' END AS role FROM p, s),
b AS (SELECT *, CASE WHEN role = 'fresher' THEN 6 WHEN role = 'moderate' THEN 10 WHEN authority >= 0.65 THEN 15 ELSE 12 END capacity FROM a)
"""


@query(PEOPLE + "SELECT reviewer_id, round(authority, 6) authority, role, capacity FROM b")
def authority_score(spark, d):
    """A01-A05."""
    return R.authority(_people(spark, d)).select("reviewer_id", F.round("authority", 6).alias("authority"), "role", "capacity")


@query(PEOPLE + ", n AS (SELECT role tier, count(*) n FROM b GROUP BY 1) SELECT tier, coalesce(n, 0) n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT sum(n) FROM n), 6) AS \"percent\" FROM (VALUES ('expert'), ('moderate'), ('fresher'), ('unknown')) x(tier) LEFT JOIN n USING (tier)")
def tier_distribution(spark, d):
    """W06."""
    return E.tiers(R.authority(_people(spark, d)).select(F.col("role").alias("tier")), ["expert", "moderate", "fresher", "unknown"])


@query(PEOPLE + "SELECT reviewer_id, capacity, reviewer_id % 16 load, CASE WHEN reviewer_id % 16 >= capacity THEN 'at_capacity' WHEN (reviewer_id % 16)::DOUBLE / capacity >= 0.9 THEN 'near_capacity' ELSE 'available' END status FROM b")
def capacity_status(spark, d):
    """A05, W16."""
    return R.authority(_people(spark, d)).select("reviewer_id", "capacity", (F.col("reviewer_id") % 16).alias("load"), R.capacity_status(F.col("reviewer_id") % 16, F.col("capacity")).alias("status"))


@query("SELECT count(*) n_panels, round(avg((u - 1)::DOUBLE / (n - 1)), 6) panel_diversity FROM (SELECT l_orderkey, count(*) n, count(DISTINCT l_suppkey) u FROM lineitem GROUP BY 1) WHERE n > 1")
def panel_diversity(spark, d):
    """R13."""
    a = _assigned(spark, d)
    n = a.groupBy("paper_id").count().where("count > 1").agg(F.count("*").alias("n_panels"))
    return n.join(E.panel_diversity(a))


# ---- labels

@query("SELECT count_if(quality = 1 AND toxic = 1) tp, count_if(quality = 0 AND toxic = 1) fp, count_if(quality = 0 AND toxic = 0) tn, count_if(quality = 1 AND toxic = 0) fn, round(tp::DOUBLE / (tp + fp), 6) AS \"precision\", round(tp::DOUBLE / (tp + fn), 6) recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 6) f1 FROM labels")
def conflict_confusion(spark, d):
    """W11."""
    return E.confusion(table(spark, d, "labels"), "quality", "toxic")


LABELLED = "WITH x AS (SELECT l.toxic, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE mid FROM x)\n"


@query(LABELLED + "SELECT round((sum(CASE WHEN quality = 1 THEN mid ELSE 0 END) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / (sum(quality)::DOUBLE * sum(1 - quality)), 6) auc, round(corr(quality::DOUBLE, n_chars::DOUBLE), 6) point_biserial FROM r")
def auc_point_biserial(spark, d):
    """D01, D02."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", "n_chars")
    return E.roc_auc(rows, "quality", "n_chars").join(E.point_biserial(rows, "quality", "n_chars"))


@query(LABELLED + "SELECT quality, count(*) n, round(avg(n_chars), 6) mean, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) median, round(quantile_cont(n_chars::DOUBLE, 0.75), 6) p75, round(quantile_cont(n_chars::DOUBLE, 0.9), 6) p90, round(avg(CASE WHEN n_chars = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) zero_rate FROM x GROUP BY quality")
def signal_summary(spark, d):
    """D03, M19."""
    return E.summary(table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id"), "quality", "n_chars")


@query(SIGNALS + "SELECT count(*) n, round(avg(semantic - kg), 6) mean_difference, round(avg(semantic - kg) / (stddev_samp(semantic - kg) / sqrt(count(*))), 6) t FROM g")
def paired_t_statistic(spark, d):
    """D05."""
    return E.paired_t(_signals(spark, d), "semantic", "kg")


# ---- texts: benchmark items are papers, documents are candidates

def _tokens(spark, d, name, key, pattern="[a-z0-9]{4,}"):
    return table(spark, d, name).select(F.col(key).alias("id"), T.tokens(F.col("text"), pattern).alias("tokens"))


TOKENS = """WITH p AS (SELECT item_id paper_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) t FROM benchmark), r AS (SELECT doc_id reviewer_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) t FROM documents),
pe AS (SELECT paper_id, len(t) n, unnest(t) w FROM p), re AS (SELECT reviewer_id, len(t) n, unnest(t) w FROM r), b AS (SELECT paper_id, reviewer_id, pe.n np, re.n nr, count(*) both_ FROM pe JOIN re USING (w) GROUP BY ALL),
j AS (SELECT paper_id, reviewer_id, both_::DOUBLE / (np + nr - both_) score FROM b)
"""


@query(TOKENS + "SELECT paper_id, reviewer_id, round(score, 6) score, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, reviewer_id) rank FROM j QUALIFY rank <= 10")
def lexical_topk(spark, d):
    """T13, T42, M05, J03."""
    p = _tokens(spark, d, "benchmark", "item_id").withColumnRenamed("id", "paper_id")
    r = _tokens(spark, d, "documents", "doc_id").withColumnRenamed("id", "reviewer_id")
    j = R.lexical_pairs(p, r)
    return j.withColumn("rank", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["paper_id"])).where("rank <= 10").withColumn("score", F.round("score", 6))


COUNTS = """WITH c AS (SELECT doc_id id, w term, count(*) tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w FROM documents) GROUP BY ALL), q AS (SELECT item_id id, w term, count(*) qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM c GROUP BY 1), z AS (SELECT id, sum(tf) len FROM c GROUP BY 1), n AS (SELECT count(*) n, avg(len) av FROM z)
"""


def _plain(spark, d, name, key):
    return table(spark, d, name).select(F.col(key).alias("id"), "text")


@query(COUNTS + """, s AS (SELECT q.id paper_id, c.id reviewer_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av)) * qtf) score FROM q JOIN c USING (term) JOIN df USING (term) JOIN z ON z.id = c.id, n GROUP BY 1, 2)
SELECT paper_id, reviewer_id, round(score, 4) score, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, reviewer_id) rank FROM s QUALIFY rank <= 5""")
def bm25_topk(spark, d):
    """M22, F22."""
    return B.bm25_top_k(_plain(spark, d, "documents", "doc_id"), _plain(spark, d, "benchmark", "item_id"), "[a-z0-9]+", 5).withColumn("score", F.round("score", 4))


@query("""WITH c AS (SELECT id, w term, count(*) tf FROM (SELECT 'b' || item_id id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) w FROM benchmark UNION ALL SELECT 'd' || doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) FROM documents) GROUP BY ALL),
n AS (SELECT count(DISTINCT id) n FROM c), df AS (SELECT term, count(*) df FROM c GROUP BY 1), w AS (SELECT id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) w FROM c JOIN df USING (term), n), m AS (SELECT id, sqrt(sum(w * w)) m FROM w GROUP BY 1), u AS (SELECT id, term, w / m w FROM w JOIN m USING (id)),
s AS (SELECT a.id paper_id, b.id reviewer_id, sum(a.w * b.w) score FROM u a JOIN u b USING (term) WHERE a.id[1] = 'b' AND b.id[1] = 'd' GROUP BY 1, 2)
SELECT paper_id, reviewer_id, round(score, 5) score, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, reviewer_id) rank FROM s QUALIFY rank <= 5""")
def tfidf_topk(spark, d):
    """M20, M21."""
    return B.tfidf_top_k(_plain(spark, d, "documents", "doc_id"), _plain(spark, d, "benchmark", "item_id"), "[a-z0-9]{4,}", 5, ("b", "d")).withColumn("score", F.round("score", 5))


VOCABULARY = ["the", "this", "pathetic", "license", "apache license", "general public license", "der die", "worthless"]
_VOC_SQL = ", ".join(f"('{v}')" for v in VOCABULARY)
TOPICS = f"WITH d AS (SELECT doc_id id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' t FROM documents), v(topic) AS (VALUES {_VOC_SQL}), o AS (SELECT id, topic FROM d, v WHERE contains(t, ' ' || topic || ' '))\n"


def _topics(spark, d):
    return K.topics(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), VOCABULARY)


@query(TOPICS + "SELECT topic, count(*) n FROM o GROUP BY 1")
def topic_dictionary(spark, d):
    """G01, G02, G32, G20."""
    return _topics(spark, d).groupBy("topic").agg(F.count("*").alias("n"))


_SHARES = "SELECT id, topic, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY id) w FROM"


@query(f"""WITH t AS (SELECT 'b' kind, item_id::VARCHAR id, text FROM benchmark UNION ALL SELECT 'd', source, text FROM documents), v(topic) AS (VALUES {_VOC_SQL}),
o AS (SELECT kind, id, topic FROM (SELECT kind, id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' t FROM t), v WHERE contains(t, ' ' || topic || ' ')),
a AS ({_SHARES} o WHERE kind = 'b' GROUP BY id, topic), b AS ({_SHARES} o WHERE kind = 'd' GROUP BY id, topic)
SELECT a.id::BIGINT paper_id, b.id reviewer_id, round(sum(least(a.w, b.w)), 6) score FROM a JOIN b USING (topic) GROUP BY 1, 2""")
def topic_intersection(spark, d):
    """Every benchmark item against every source by the shares of all topics."""
    papers = K.topics(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), VOCABULARY)
    sources = K.topics(table(spark, d, "documents").select(F.col("source").alias("id"), "text"), VOCABULARY)
    return K.topic_intersection(K.topic_weights(papers), K.topic_weights(sources)).withColumn("score", F.round("score", 6))


@query("""WITH w AS (SELECT doc_id id, generate_subscripts(ws, 1) - 1 pos, unnest(ws) w FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) > 3 AND NOT list_contains(['a','an','and','are','as','at','be','by','for','from','has','in','is','it','of','on','or','that','the','this','to','was','were','with'], x)) ws FROM documents)),
m AS (SELECT id, pos, CASE WHEN w = 'llms' THEN 'llm' WHEN w = 'nets' THEN 'network' WHEN w = 'gnn' THEN 'graph' WHEN w = 'transformers' THEN 'transformer' ELSE w END w FROM w),
s AS (SELECT id, pos, CASE WHEN len(w) > 5 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN len(w) > 5 AND w LIKE '%ed' THEN w[:-3] ELSE w END term FROM m),
g AS (SELECT id, term, count(*) n, min(pos) f FROM s WHERE len(term) > 3 AND NOT list_contains(['paper','method','approach','result','results','based','using','study','system','model','data'], term) GROUP BY 1, 2)
SELECT id, term, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, f, term) rank FROM g QUALIFY rank <= 5""")
def keyphrases(spark, d):
    """Single words; key_terms has pairs, phrases and stop words tested after normalising only."""
    return K.keyphrases(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 5).select("id", "term", "n", "rank")


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) heading, len(html) n_chars FROM pages")
def html_metadata(spark, d):
    """S09."""
    return X.html_metadata(table(spark, d, "pages"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') slug, 'pub_' || substr(sha1(source || ':' || doc_id), 1, 12) pub_key, len(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) n_tokens FROM documents""")
def text_keys(spark, d):
    """T21, T23, T24, T42."""
    n = F.size(T.tokens(F.col("text"), "[a-z0-9]{4,}", distinct=False))
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("source")).alias("slug"), T.publication_key(F.col("source"), F.col("doc_id").cast("string")).alias("pub_key"), n.alias("n_tokens"))


# ---- graph: parts, suppliers, nations

def _edges(spark, d):
    l = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("supplies").alias("type"), F.lit(1.0).alias("weight"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("located").alias("type"), F.lit(0.5).alias("weight"))
    b = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("b"), "p_brand").alias("dst"), F.lit("brand").alias("type"), F.lit(0.8).alias("weight"))
    return K.edges([l, s, b])


EDGES = """WITH e0 AS (SELECT 'p' || l_partkey a, 's' || l_suppkey b, 'supplies' ty, 1.0::DOUBLE w FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located', 0.5 FROM supplier UNION ALL SELECT 'p' || p_partkey, 'b' || p_brand, 'brand', 0.8 FROM part),
e AS (SELECT least(a, b) src, greatest(a, b) dst, max(w) weight, array_to_string(list_sort(list_distinct(list(ty))), ',') types FROM e0 GROUP BY 1, 2), n AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)
"""


@query(EDGES + "SELECT types, count(*) n, round(sum(weight), 6) weight FROM e GROUP BY 1")
def graph_edges(spark, d):
    """G10-G12, G20."""
    return _edges(spark, d).groupBy("types").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(EDGES + """, q AS (SELECT 'n' || n_nationkey paper_id, 'n' || (n_nationkey + 1) reviewer_id FROM nation WHERE n_nationkey < 24), di AS (SELECT paper_id, reviewer_id, count(*) direct FROM q JOIN n x ON x.src = paper_id JOIN n y ON y.src = reviewer_id AND y.dst = x.dst GROUP BY 1, 2),
br AS (SELECT paper_id, reviewer_id, count(DISTINCT x.dst) bridge FROM q JOIN n x ON x.src = paper_id JOIN n m ON m.src = x.dst JOIN n y ON y.src = m.dst AND y.dst = reviewer_id GROUP BY 1, 2), dg AS (SELECT src, count(*) deg FROM n GROUP BY 1)
SELECT paper_id, reviewer_id, coalesce(direct, 0) direct, coalesce(bridge, 0) bridge, round(least(1.0::DOUBLE, (coalesce(direct, 0) + 0.35 * coalesce(bridge, 0)) / greatest(3, coalesce(deg, 0))), 6) score FROM q LEFT JOIN di USING (paper_id, reviewer_id) LEFT JOIN br USING (paper_id, reviewer_id) LEFT JOIN dg ON dg.src = paper_id""")
def graph_overlap(spark, d):
    """G13."""
    q = table(spark, d, "nation").where("n_nationkey < 24").select(F.concat(F.lit("n"), "n_nationkey").alias("paper_id"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("reviewer_id"))
    return K.overlap_score(q, _edges(spark, d)).select("paper_id", "reviewer_id", "direct", "bridge", F.round("score", 6).alias("score"))


# ---- panels, assignment, learned ranker, live workload

def _candidates(spark, d):
    roles = F.when(F.col("reviewer_id") % 3 == 0, "expert").when(F.col("reviewer_id") % 3 == 1, "moderate").otherwise("fresher")
    terms = F.array(F.concat(F.lit("a"), F.col("reviewer_id") % 7), F.concat(F.lit("b"), F.col("reviewer_id") % 5))
    return _signals(spark, d).select("paper_id", "reviewer_id", roles.alias("role"), F.col("semantic").alias("sim"), F.col("profile").alias("authority"), terms.alias("terms"))


_J = "(CASE WHEN (x.reviewer_id % 7 = {o}.reviewer_id % 7) AND (x.reviewer_id % 5 = {o}.reviewer_id % 5) THEN 1.0::DOUBLE WHEN (x.reviewer_id % 7 = {o}.reviewer_id % 7) OR (x.reviewer_id % 5 = {o}.reviewer_id % 5) THEN 1.0::DOUBLE / 3 ELSE 0 END)"


@query(SIGNALS + f""", a AS (SELECT paper_id, reviewer_id, profile v FROM g WHERE reviewer_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY round(profile, 9) DESC, round(semantic, 9) DESC, reviewer_id) = 1),
b AS (SELECT x.paper_id, x.reviewer_id, x.semantic, CASE WHEN a.reviewer_id IS NULL THEN 0.64 * (0.68 * semantic + 0.32 * profile) + 0.28 ELSE 0.64 * (0.68 * semantic + 0.32 * profile) + 0.28 * ((x.reviewer_id % 7 <> a.reviewer_id % 7)::INT + (x.reviewer_id % 5 <> a.reviewer_id % 5)::INT) / 2.0::DOUBLE - 0.12 * {_J.format(o='a')} END vb FROM g x LEFT JOIN a USING (paper_id) WHERE x.reviewer_id % 3 = 1
 QUALIFY row_number() OVER (PARTITION BY x.paper_id ORDER BY round(vb, 9) DESC, round(x.semantic, 9) DESC, x.reviewer_id) = 1),
c AS (SELECT x.paper_id, x.reviewer_id, 0.64 * (0.70 * x.semantic + 0.30 * profile) - 0.36 * greatest({_J.format(o='a')}, {_J.format(o='b')}) + 0.22 * ((x.reviewer_id % 7 NOT IN (a.reviewer_id % 7, b.reviewer_id % 7))::INT + (x.reviewer_id % 5 NOT IN (a.reviewer_id % 5, b.reviewer_id % 5))::INT) / 2.0::DOUBLE vc FROM g x JOIN a USING (paper_id) JOIN b USING (paper_id) WHERE x.reviewer_id % 3 = 2
 QUALIFY row_number() OVER (PARTITION BY x.paper_id ORDER BY round(vc, 9) DESC, round(x.semantic, 9) DESC, x.reviewer_id) = 1)
SELECT paper_id, 1 slot, reviewer_id, round(v, 6) AS "value" FROM a UNION ALL SELECT paper_id, 2, reviewer_id, round(vb, 6) FROM b UNION ALL SELECT paper_id, 3, reviewer_id, round(vc, 6) FROM c""")
def panel_role_balanced(spark, d):
    """P02-P04, P06, P07 without eligibility and pools; panel_selection has them."""
    return R.role_panel(_candidates(spark, d)).select("paper_id", "slot", "reviewer_id", F.round("value", 6).alias("value"))


@query()
def assign_greedy_capacity(spark, d):
    """The order of the papers is the meaning; tested against a plain fold."""
    caps = table(spark, d, "embeddings").select(F.col("vec_id").alias("reviewer_id"), (F.col("vec_id") % 3 + 1).alias("capacity"))
    return R.greedy_assignment(_ranked(spark, d).select("paper_id", "reviewer_id", "score"), caps)


@query()
def learned_ranker_oof(spark, d):
    """Three signals."""
    rows = _signals(spark, d)
    rows = rows.join(_truth(spark, d, rows).withColumn("label", F.lit(1)), ["paper_id", "reviewer_id"], "left").na.fill(0, ["label"])
    signals = ["semantic", "kg", "profile"]
    out = L.out_of_fold(L.dataset(rows, signals), [*signals, *[f"rr_{s}" for s in signals]], iterations=5)
    return out.select("paper_id", "reviewer_id", "label", "fold", F.round("prediction_score", 6).alias("score"))


@query("WITH u AS (SELECT event_id % 1000 paper_id, user_id reviewer_id, ts FROM events), l AS (SELECT paper_id, max(ts) ts FROM u GROUP BY 1) SELECT reviewer_id, count(*) load FROM (SELECT DISTINCT u.* FROM u JOIN l USING (paper_id, ts)) GROUP BY 1")
def live_workload(spark, d):
    """The state that the stream of updates comes to."""
    rows = table(spark, d, "events").select((F.col("event_id") % 1000).alias("paper_id"), F.col("user_id").alias("reviewer_id"), "ts")
    return workload.counts(workload.latest(rows))


@query("""WITH t AS (SELECT conv_id, turn, trim(text) x FROM conversations), v AS (SELECT conv_id, turn, coalesce(CASE WHEN regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(x AS DOUBLE) END, TRY_CAST(nullif(regexp_extract(x, '\\b0?\\.[0-9]+|\\b1\\.0\\b|\\b0\\b|\\b1\\b'), '') AS DOUBLE)) s FROM t)
SELECT conv_id, turn, CASE WHEN s IS NOT NULL THEN least(greatest(s, 0.0), 1.0)::DOUBLE END score FROM v""")
def parsed_scores(spark, d):
    """T30."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.parse_score(F.col("text")).alias("score"))


# ---- further signals, panels and reports

@query(TOKENS + "SELECT paper_id, reviewer_id, round(score, 6) score FROM j")
def token_jaccard_pairs(spark, d):
    """Every pair that shares a token."""
    p = _tokens(spark, d, "benchmark", "item_id").withColumnRenamed("id", "paper_id")
    r = _tokens(spark, d, "documents", "doc_id").withColumnRenamed("id", "reviewer_id")
    return R.lexical_pairs(p, r).withColumn("score", F.round("score", 6))


@query(TOPICS + """, c AS (SELECT id, topic, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) w FROM o), x AS (SELECT DISTINCT doc_id id, lang topic, 0.3::DOUBLE w FROM documents WHERE lang IS NOT NULL),
u AS (SELECT id, topic, sum(w) w FROM (SELECT * FROM c UNION ALL SELECT * FROM x) GROUP BY 1, 2) SELECT id, topic, round(w / sum(w) OVER (PARTITION BY id), 6) weight FROM u""")
def topic_weights(spark, d):
    """Shares of the dictionary's topics, and the language as an extra topic."""
    extra = table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"))
    return K.topic_weights(_topics(spark, d), extra).select("id", "topic", F.round("w", 6).alias("weight"))


@query(EDGES + """, q AS (SELECT 'n' || n_nationkey paper_id, 'n' || (n_nationkey + 1) reviewer_id FROM nation WHERE n_nationkey < 24),
di AS (SELECT paper_id, reviewer_id, 2 * count(*) k FROM q JOIN n x ON x.src = paper_id JOIN n y ON y.src = reviewer_id AND y.dst = x.dst GROUP BY 1, 2),
ed AS (SELECT paper_id, reviewer_id, 2 * count(*) k FROM q JOIN n ON src = paper_id AND dst = reviewer_id GROUP BY 1, 2),
th AS (SELECT paper_id, reviewer_id, count(*) k FROM q JOIN n x ON x.src = paper_id JOIN n m ON m.src = x.dst JOIN n y ON y.src = m.dst AND y.dst = reviewer_id WHERE m.dst <> paper_id AND x.dst <> reviewer_id GROUP BY 1, 2),
al AS (SELECT paper_id, reviewer_id, least(100, sum(k)) paths FROM (SELECT * FROM di UNION ALL SELECT * FROM ed UNION ALL SELECT * FROM th) GROUP BY 1, 2)
SELECT paper_id, reviewer_id, coalesce(paths, 0)::BIGINT paths, round(least(1.0::DOUBLE, ln(1 + coalesce(paths, 0)) / 5), 6) path_confidence FROM q LEFT JOIN al USING (paper_id, reviewer_id)""")
def path_confidence(spark, d):
    """nations' paths through suppliers and parts."""
    q = table(spark, d, "nation").where("n_nationkey < 24").select(F.concat(F.lit("n"), "n_nationkey").alias("paper_id"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("reviewer_id"))
    return K.path_counts(q, _edges(spark, d)).withColumn("path_confidence", F.round(K.path_confidence(F.col("paths")), 6))


@query(EDGES + """, i AS (SELECT 'n' || n_nationkey id FROM nation), f AS (SELECT id, id term, 1.0::DOUBLE w FROM i UNION ALL SELECT id, dst, 1.0 FROM i JOIN n ON src = id UNION ALL SELECT id, y.dst, 0.5 FROM i JOIN n x ON x.src = id JOIN n y ON y.src = x.dst),
g AS (SELECT id, term, max(w) w FROM f GROUP BY 1, 2), h AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) w FROM g)
SELECT a.id paper_id, b.id reviewer_id, round(sum(a.w * b.w), 6) score FROM h a JOIN h b USING (term) WHERE a.id < b.id GROUP BY 1, 2""")
def graph_feature_cosine(spark, d):
    """Cosine of nations by what lies within two steps."""
    w = K.feature_weights(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")), _edges(spark, d))
    return K.sparse_cosine(w, w).where("paper_id < reviewer_id").withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT source reviewer_id, doc_id, n_chars, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) t, row_number() OVER (PARTITION BY source ORDER BY doc_id) nth FROM documents),
r AS (SELECT *, greatest(ln(1 + n_chars), 1.0::DOUBLE) w FROM s WHERE nth <= 20 AND len(t) > 0), z AS (SELECT reviewer_id, sum(w) total FROM r GROUP BY 1),
p AS (SELECT item_id paper_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) t FROM benchmark), pe AS (SELECT paper_id, len(t) np, unnest(t) x FROM p), re AS (SELECT reviewer_id, doc_id, w, len(t) nr, unnest(t) x FROM r),
b AS (SELECT paper_id, reviewer_id, doc_id, w, np, nr, count(*) b FROM pe JOIN re USING (x) GROUP BY ALL)
SELECT paper_id, reviewer_id, round(sum(b::DOUBLE / (np + nr - b) * w) / any_value(total), 6) score FROM b JOIN z USING (reviewer_id) GROUP BY 1, 2""")
def citation_weighted_similarity(spark, d):
    """Sources as reviewers, their texts as publications, lengths as citations."""
    p = _tokens(spark, d, "benchmark", "item_id").withColumnRenamed("id", "paper_id")
    pubs = table(spark, d, "documents").select(F.col("source").alias("reviewer_id"), F.col("doc_id").alias("pub_id"), T.tokens(F.col("text"), "[a-z0-9]{4,}").alias("tokens"), F.col("n_chars").alias("citations"))
    return K.citation_weighted(p, pubs).withColumn("score", F.round("score", 6))


@query(RANKED + """SELECT r.paper_id, r.reviewer_id, rank, round(score, 6) score, 'topic ' || ea.label title, 'group ' || eb.label AS "name", ea.label = eb.label in_truth
FROM r JOIN embeddings ea ON ea.vec_id = r.paper_id JOIN embeddings eb ON eb.vec_id = r.reviewer_id WHERE rank <= 3""")
def results_table(spark, d):
    """The top three of each paper with titles, names and the truth."""
    e = table(spark, d, "embeddings")
    titles = e.select(F.col("vec_id").alias("paper_id"), F.concat(F.lit("topic "), "label").alias("title"))
    names = e.select(F.col("vec_id").alias("reviewer_id"), F.concat(F.lit("group "), "label").alias("name"))
    rows = _ranked(spark, d)
    return X.results_table(rows, titles, names, _truth(spark, d, rows), 3).select("paper_id", "reviewer_id", "rank", F.round("score", 6).alias("score"), "title", "name", "in_truth")


def _conflicts(rows):
    """Every eleventh sum of ids stands for a conflict."""
    return rows.where(F.pmod(F.col("paper_id") + F.col("reviewer_id"), F.lit(11)) == 0).select("paper_id", "reviewer_id", F.lit(0.75).alias("coi_score"), F.lit(False).alias("flagged"))


@query(SIGNALS + """, f AS (SELECT *, min(semantic) OVER p lo, max(semantic) OVER p hi FROM g WINDOW p AS (PARTITION BY paper_id))
SELECT paper_id, reviewer_id, round(0.85 * CASE WHEN hi - lo <= 1e-8 THEN 0 ELSE (semantic - lo) / (hi - lo) END + 0.05 * kg + 0.10 * (((paper_id % 10) / 10.0::DOUBLE + 0.5 + profile) / 3), 6) score FROM f WHERE (paper_id + reviewer_id) % 11 <> 0""")
def fusion_quality_coi(spark, d):
    """The fusion score of every ranked pair without a conflict."""
    rows = _signals(spark, d)
    named = rows.select("paper_id", "reviewer_id", F.col("semantic").alias("sim"), "kg", ((F.col("paper_id") % 10) / 10.0).alias("quality"), F.lit(None).cast("double").alias("acceptance"), F.col("profile").alias("reliability"))
    return G.fusion_scores(named, _conflicts(rows))


@query(SIGNALS + """, hd AS (SELECT *, CASE WHEN kg < 0.03 THEN kg * 0.2 ELSE kg END k FROM g WHERE true QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY round(semantic, 9) DESC, reviewer_id) <= 20),
f AS (SELECT *, min(semantic) OVER p l1, max(semantic) OVER p h1, min(k) OVER p l2, max(k) OVER p h2, min(profile) OVER p l3, max(profile) OVER p h3 FROM hd WHERE (paper_id + reviewer_id) % 11 <> 0 WINDOW p AS (PARTITION BY paper_id)),
sq AS (SELECT *, (0.85 * CASE WHEN h1 - l1 <= 1e-8 THEN 0 ELSE (semantic - l1) / (h1 - l1 + 1e-8) END + 0.02 * CASE WHEN h2 - l2 <= 1e-8 THEN 0 ELSE (k - l2) / (h2 - l2 + 1e-8) END + 0.08 * CASE WHEN h3 - l3 <= 1e-8 THEN 0 ELSE (profile - l3) / (h3 - l3 + 1e-8) END) * CASE WHEN semantic < 0.3 THEN 0.5 ELSE 1 END sc FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(sc, 9) DESC, reviewer_id) n FROM sq), e AS (SELECT *, sc + CASE WHEN n <= 10 THEN 0.08::DOUBLE / n ELSE 0 END x FROM b)
SELECT paper_id, reviewer_id, round(x, 6) score, row_number() OVER (PARTITION BY paper_id ORDER BY round(x, 9) DESC, reviewer_id) rank FROM e""")
def hybrid_scores(spark, d):
    """F03."""
    rows = _signals(spark, d)
    named = rows.select("paper_id", "reviewer_id", F.col("semantic").alias("sim"), "kg", F.col("profile").alias("key"))
    return G.hybrid_scores(named, _conflicts(rows)).withColumn("score", F.round("score", 6))


@query(SIGNALS + "SELECT paper_id, reviewer_id, round(0.7 * semantic + 0.2 * kg + 0.1 * profile + CASE WHEN profile > 0.15 THEN 0.05 ELSE 0 END, 6) score FROM g")
def single_paper_scores(spark, d):
    """F04."""
    return G.single_paper_scores(_signals(spark, d).withColumnsRenamed({"semantic": "sim", "profile": "key"}))


#: Weights of the registered full ranking: parameters of this query, not published values.
FULL = G.Ranking(weights={"similarity": 0.40, "authority": 0.20, "kg": 0.15, "profile": 0.15, "workload": 0.10}, rrf_weight=0.3)


@query(SIGNALS + """, x AS (SELECT *, ((paper_id * 11 + reviewer_id * 17) % 97) / 96.0::DOUBLE llm, ((paper_id + reviewer_id) % 10) / 10.0::DOUBLE conf, (paper_id + reviewer_id) % 11 = 0 flagged,
 row_number() OVER (PARTITION BY paper_id ORDER BY round(semantic, 9) DESC, reviewer_id) sr, min(semantic) OVER (PARTITION BY paper_id) lo, max(semantic) OVER (PARTITION BY paper_id) hi FROM g),
n AS (SELECT *, CASE WHEN hi - lo <= 1e-8 THEN 0.5::DOUBLE ELSE (semantic - lo) / (hi - lo + 1e-8) END sim, CASE WHEN sr <= 12 THEN kg ELSE 0 END k, CASE WHEN sr <= 20 THEN llm ELSE 0 END l FROM x),
s0 AS (SELECT *, least(greatest(0.40 * sim + 0.20 * profile + 0.15 * least(k, sim + 0.25) * conf + 0.15 * l + 0.10, 0), 1) z0 FROM n),
s1 AS (SELECT *, z0 * CASE WHEN sim < 0.40 THEN 0.75 ELSE 1 END * CASE WHEN reviewer_id % 40 <= 2 THEN 0.68 ELSE 1 END z1 FROM s0),
s2 AS (SELECT *, least(greatest(CASE reviewer_id % 3 WHEN 0 THEN z1 + 0.05 WHEN 2 THEN greatest(z1, 0.58 * sim) ELSE z1 END, 0), 1) z FROM s1),
f AS (SELECT *, (1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY paper_id ORDER BY round(sim, 9) DESC, reviewer_id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY paper_id ORDER BY round(profile, 9) DESC, reviewer_id))
 + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY paper_id ORDER BY round(k * conf, 9) DESC, reviewer_id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY paper_id ORDER BY round(CASE WHEN flagged THEN -1 ELSE z END, 9) DESC, reviewer_id))) / (4.0::DOUBLE / 61) rrf FROM s2),
u AS (SELECT *, CASE WHEN NOT flagged THEN 0.7 * z + 0.3 * rrf END sc FROM f)
SELECT paper_id, reviewer_id, CASE reviewer_id % 3 WHEN 0 THEN 'expert' WHEN 1 THEN 'moderate' ELSE 'fresher' END AS role, round(sc, 6) score, row_number() OVER (PARTITION BY paper_id ORDER BY round(sc, 9) DESC NULLS LAST, reviewer_id) rank,
 (sim < 0.40)::INT + (sim < 0.50)::INT + (z < 0.25)::INT + flagged::INT n_reasons FROM u""")
def ranked_reviewers(spark, d):
    """The full ranking of every paper's candidates."""
    p, r = F.col("paper_id"), F.col("reviewer_id")
    role = F.when(r % 3 == 0, "expert").when(r % 3 == 1, "moderate").otherwise("fresher")
    rows = _signals(spark, d).select("paper_id", "reviewer_id", F.col("semantic").alias("similarity"), "kg", (F.pmod(p + r, F.lit(10)) / 10.0).alias("kg_confidence"), F.col("profile").alias("authority"), (F.pmod(p * 11 + r * 17, F.lit(97)) / 96.0).alias("profile"), role.alias("role"), (r % 40).alias("h"), (F.pmod(p + r, F.lit(11)) == 0).alias("flagged"))
    return G.rank_reviewers(rows, FULL).select("paper_id", "reviewer_id", "role", F.round("score", 6).alias("score"), "rank", F.size("reasons").alias("n_reasons"))


@query(SIGNALS + """, x AS (SELECT *, reviewer_id % 40 h, CASE reviewer_id % 3 WHEN 0 THEN 'expert' WHEN 1 THEN 'moderate' ELSE 'fresher' END AS role FROM g), a AS (SELECT *, CASE WHEN semantic < 0.4 THEN base * 0.75 ELSE base END s1 FROM x),
b AS (SELECT *, CASE WHEN h <= 2 THEN s1 * 0.68 ELSE s1 END s2 FROM a), c AS (SELECT *, CASE WHEN role = 'fresher' THEN greatest(s2, 0.58 * semantic) ELSE s2 END s3 FROM b)
SELECT paper_id, reviewer_id, role, round(least(greatest(CASE WHEN role = 'expert' THEN s3 + 0.05 ELSE s3 END, 0), 1), 6) score FROM c""")
def score_policy(spark, d):
    """penalties and bonuses in their order."""
    role = F.when(F.col("reviewer_id") % 3 == 0, "expert").when(F.col("reviewer_id") % 3 == 1, "moderate").otherwise("fresher")
    rows = _signals(spark, d).withColumn("role", role)
    return rows.select("paper_id", "reviewer_id", "role", F.round(S.policy(F.col("base"), F.col("semantic"), F.col("reviewer_id") % 40, F.col("role")), 6).alias("score"))


@query(SIGNALS + """, x AS (SELECT paper_id, reviewer_id, reviewer_id % 3 r, reviewer_id % 7 a, reviewer_id % 5 b, row_number() OVER (PARTITION BY paper_id, reviewer_id % 3 ORDER BY round(base, 9) DESC, reviewer_id) n FROM g), best AS (SELECT * FROM x WHERE n = 1),
w AS (SELECT i.paper_id, avg(1 - CASE (i.a = j.a)::INT + (i.b = j.b)::INT WHEN 2 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE / 3 ELSE 0 END) dissimilarity FROM best i JOIN best j ON i.paper_id = j.paper_id AND i.r < j.r GROUP BY 1),
tok AS (SELECT paper_id, tk, count(*) n FROM (SELECT paper_id, 'a' || a tk FROM best UNION ALL SELECT paper_id, 'b' || b FROM best) GROUP BY 1, 2), sh AS (SELECT paper_id, n::DOUBLE / sum(n) OVER (PARTITION BY paper_id) q FROM tok), e AS (SELECT paper_id, -sum(q * log2(q)) / log2(greatest(2, count(*))::DOUBLE) entropy FROM sh GROUP BY 1)
SELECT paper_id, round(dissimilarity, 6) dissimilarity, round(entropy, 6) entropy FROM (SELECT DISTINCT paper_id FROM best) LEFT JOIN w USING (paper_id) LEFT JOIN e USING (paper_id)""")
def panel_pairwise_diversity(spark, d):
    """Over the best candidate of each role."""
    best = S.rank_by(F.col("base"), F.col("reviewer_id"), by=["paper_id", "slot"])
    rows = _signals(spark, d).withColumn("slot", F.col("reviewer_id") % 3).withColumn("n", best).where("n = 1")
    terms = F.array(F.concat(F.lit("a"), F.col("reviewer_id") % 7), F.concat(F.lit("b"), F.col("reviewer_id") % 5))
    return E.pairwise_diversity(rows.select("paper_id", "slot", terms.alias("tokens"))).select("paper_id", F.round("dissimilarity", 6).alias("dissimilarity"), F.round("entropy", 6).alias("entropy"))


@query(PEOPLE + "SELECT reviewer_id, round(authority * greatest(0, 1 - (reviewer_id % 16)::DOUBLE / capacity), 6) score FROM b")
def availability_penalty(spark, d):
    """scores lowered by the share of the capacity that is used."""
    p = R.authority(_people(spark, d))
    return p.select("reviewer_id", F.round(S.available(F.col("authority"), F.col("reviewer_id") % 16, F.col("capacity")), 6).alias("score"))
