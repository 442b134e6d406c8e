"""Reports: lines of orders are assignments, returned lines the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import evaluate as E
from ..operators import ranking as R
from ..operators import reports as P
from ..params import GRID
from .catalog import _GRID_SQL, COI, PEOPLE, SIGNALS, _assigned, _coi, _hits, _people, _signals, _suppliers, query, table


def _returned(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("reviewer_id"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey p, l_suppkey r FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT p, count(*) m FROM t GROUP BY 1), a AS (SELECT l_orderkey p, count(*) n FROM lineitem GROUP BY 1),
h AS (SELECT p, count(*) k FROM (SELECT DISTINCT l_orderkey p, l_suppkey r FROM lineitem) JOIN t USING (p, r) GROUP BY 1)
SELECT count(*) n_papers, round(avg(coalesce(k, 0)::DOUBLE / n), 6) AS "precision", round(avg(coalesce(k, 0)::DOUBLE / m), 6) recall, round((SELECT count(DISTINCT l_suppkey)::DOUBLE FROM lineitem) / (SELECT count(*) FROM supplier), 6) coverage,
 round((SELECT count(DISTINCT l_suppkey)::DOUBLE / count(*) FROM lineitem), 6) diversity FROM a JOIN m USING (p) LEFT JOIN h USING (p)""")
def assignment_quality(spark, d):
    """R15."""
    out = P.assignment_quality(_assigned(spark, d), _returned(spark, d), table(spark, d, "supplier").count())
    return out.select("n_papers", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "coverage", "diversity")])


@query("""WITH b AS (SELECT l_orderkey p, l_suppkey r, min(l_linenumber) s, max(l_discount) g, max(l_quantity) / 50 q, max(l_tax) a FROM lineitem GROUP BY 1, 2), t AS (SELECT DISTINCT l_orderkey p, l_suppkey r FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25),
m AS (SELECT p, count(*) m FROM t GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s, r) i FROM b), h AS (SELECT o.*, t.r IS NOT NULL AND i <= 3 hit FROM o LEFT JOIN t ON t.p = o.p AND t.r = o.r),
e AS (SELECT p, count(*) n, count_if(hit) k, min(CASE WHEN hit THEN i END) f, sum(CASE WHEN hit THEN 1 / log2(i + 1.0::DOUBLE) ELSE 0 END) dcg, avg(q) q, avg(g) g, greatest(0, 1 - stddev_pop(a)) a FROM h GROUP BY 1)
SELECT p paper_id, round(CASE WHEN m IS NOT NULL THEN k::DOUBLE / least(n, 3) END, 6) AS "precision", round(k::DOUBLE / m, 6) recall, round(CASE WHEN m IS NOT NULL THEN coalesce(1.0::DOUBLE / f, 0) END, 6) mrr,
 round(CASE WHEN m IS NOT NULL THEN dcg / list_sum(list_transform(range(1, least(m, n, 3) + 1), lambda x: 1 / log2(x + 1.0::DOUBLE))) END, 6) ndcg, round(q, 6) mean_relevance, round(g, 6) topic_coverage, round(a, 6) authority_balance FROM e LEFT JOIN m USING (p)""")
def panel_quality(spark, d):
    """Every order's first three suppliers against those of large returned lines."""
    l = table(spark, d, "lineitem")
    panels = l.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("reviewer_id")).agg(F.min("l_linenumber").alias("slot"), F.max("l_discount").alias("gain"), (F.max("l_quantity") / 50).alias("relevance"), F.max("l_tax").alias("authority"))
    truth = l.where("l_returnflag = 'R' and l_quantity > 25").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("reviewer_id"))
    out = P.panel_quality(panels, truth)
    return out.select("paper_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(COI + "SELECT l.l_suppkey reviewer_id, count(*) n, count(DISTINCT l.l_orderkey) papers FROM lineitem l JOIN c ON l.l_orderkey = c.l_orderkey AND l.l_suppkey = c.l_suppkey GROUP BY 1")
def coi_violations_by_reviewer(spark, d):
    """The list of violating assignments, counted by reviewer."""
    return P.violations(_assigned(spark, d), _coi(spark, d)).groupBy("reviewer_id").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


@query(PEOPLE + """, l AS (SELECT s_suppkey reviewer_id, count(l_suppkey) load FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), o AS (SELECT load::DOUBLE x, row_number() OVER (ORDER BY load, reviewer_id) i, count(*) OVER () n FROM l),
c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey),
v AS (SELECT count(c.l_orderkey) violations, avg(CASE WHEN c.l_orderkey IS NULL THEN 0.0::DOUBLE ELSE 1 END) vr, avg(CASE WHEN role = 'expert' THEN 100.0::DOUBLE ELSE 0 END) e, avg(CASE WHEN role = 'moderate' THEN 100.0::DOUBLE ELSE 0 END) m, avg(CASE WHEN role = 'fresher' THEN 100.0::DOUBLE ELSE 0 END) f
 FROM lineitem l LEFT JOIN c ON l.l_orderkey = c.l_orderkey AND l.l_suppkey = c.l_suppkey JOIN b ON b.reviewer_id = l.l_suppkey)
SELECT max(n) n, sum(x)::BIGINT total, min(x)::BIGINT min_load, max(x)::BIGINT max_load, round(avg(x), 6) mean_load, round(stddev_pop(x), 6) std_load, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) gini, round(sum(x) * sum(x) / (max(n) * sum(x * x)), 6) jain,
 quantile_cont(x, 0.5) median_load, count_if(x >= 600)::BIGINT overloaded, round(avg(CASE WHEN x >= 600 THEN 1.0::DOUBLE ELSE 0 END), 6) overload_rate, any_value(violations) violations, round(any_value(vr), 6) violation_rate,
 round(any_value(e), 6) expert_percent, round(any_value(m), 6) moderate_percent, round(any_value(f), 6) fresher_percent FROM o, v""")
def fairness_report(spark, d):
    """Loads, overload, conflicts and tiers in one row."""
    tier = R.authority(_people(spark, d)).select("reviewer_id", F.col("role").alias("tier"))
    return P.fairness(_suppliers(spark, d), _assigned(spark, d), _coi(spark, d), tier, ["expert", "moderate", "fresher"], 600)


@query("SELECT round(sum(x) * sum(x) / (count(*) * sum(x * x)), 6) load_balance FROM (SELECT count(*)::DOUBLE x FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey)")
def load_balance(spark, d):
    """Over suppliers with a returned line only."""
    return P.load_balance(_returned(spark, d)).select(F.round("load_balance", 6).alias("load_balance"))


@query(SIGNALS + f""", gw(mode, a, b, c) AS (VALUES {_GRID_SQL}), gx AS (SELECT mode, paper_id, reviewer_id, least(greatest(a * semantic + b * kg + c * profile, 0), 1) sc FROM g, gw),
gy AS (SELECT *, row_number() OVER (PARTITION BY mode, paper_id ORDER BY round(sc, 9) DESC, reviewer_id) rk FROM gx),
gz AS (SELECT mode, gy.paper_id, gy.rk, CASE WHEN ea.label = eb.label THEN 1 ELSE 0 END hit, n_truth FROM gy JOIN embeddings ea ON ea.vec_id = gy.paper_id JOIN embeddings eb ON eb.vec_id = gy.reviewer_id JOIN t ON t.paper_id = gy.paper_id),
gs AS (SELECT *, sum(hit) OVER (PARTITION BY mode, paper_id ORDER BY rk) seen FROM gz),
gu AS (SELECT mode, paper_id, n_truth, coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rk END), 0) rr, sum(CASE WHEN hit = 1 THEN seen::DOUBLE / rk ELSE 0 END) / n_truth ap, sum(CASE WHEN rk <= 3 THEN hit ELSE 0 END) top,
 sum(CASE WHEN rk <= 3 AND hit = 1 THEN 1 / log2(rk + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(range(1, least(n_truth, 3) + 1), lambda x: 1 / log2(x + 1.0::DOUBLE))) ndcg FROM gs GROUP BY mode, paper_id, n_truth)
SELECT mode, count(*) n_papers, round(avg(top / 3.0::DOUBLE), 6) AS "precision", round(avg(top::DOUBLE / n_truth), 6) recall, round(avg(rr), 6) mrr, round(avg(ap), 6) map, round(avg(ndcg), 6) ndcg FROM gu GROUP BY mode
 QUALIFY row_number() OVER (ORDER BY round(avg(ndcg), 6) DESC, round(avg(ap), 6) DESC, round(avg(rr), 6) DESC, mode) = 1""")
def fusion_best_weights(spark, d):
    """the best of the weight triples by NDCG, MAP and MRR."""
    rows = R.by_mode(_signals(spark, d), {str(i): w for i, w in enumerate(GRID)}, ["semantic", "kg", "profile"])
    rows = rows.withColumn("rank", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["mode", "paper_id"]))
    return P.best_weights(E.per_paper(_hits(spark, d, rows), 3, ["mode", "paper_id"]))


@query(SIGNALS + """SELECT paper_id, reviewer_id, round(least(1, greatest(0, CASE WHEN reviewer_id % 3 = 0 THEN 0.5 * semantic + 0.1 * kg + 0.4 * profile WHEN reviewer_id % 3 = 1 THEN 0.6 * semantic + 0.2 * kg + 0.2 * profile ELSE 0.6 * semantic + 0.1 * kg + 0.3 * profile END)), 6) score, 0.1::DOUBLE base_kg FROM g""")
def role_weighted(spark, d):
    """the full mode's weights by role; a role without its own takes the mode's."""
    role = F.when(F.col("reviewer_id") % 3 == 0, "expert").when(F.col("reviewer_id") % 3 == 1, "moderate").otherwise("other")
    out = P.by_role(_signals(spark, d).withColumn("role", role), {"semantic": 0.6, "kg": 0.1, "profile": 0.3}, {"expert": {"semantic": 0.5, "profile": 0.4}, "moderate": {"kg": 0.2, "profile": 0.2}})
    return out.select("paper_id", "reviewer_id", F.round("score", 6).alias("score"), "base_kg")
