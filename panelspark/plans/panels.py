"""Panels: orders are papers, their suppliers candidates, and a supplier's standing its authority.

An order has one to seven suppliers, so there are papers without an expert, without an
eligible candidate, and with open slots.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels as P
from ..operators import ranking as R
from .catalog import PEOPLE, _coi, _people, query, table


def _candidates(spark, d):
    """Similarity is the largest quantity's share of 50, graph evidence the discount; a supplier of the customer's nation is in conflict."""
    people = R.authority(_people(spark, d)).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("reviewer_id"), "s_nationkey"), "reviewer_id")
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("reviewer_id"))
    rows = l.agg((F.max("l_quantity") / 50).alias("sim"), F.max("l_discount").alias("kg"), F.count("*").alias("citations")).join(people, "reviewer_id")
    rows = rows.join(_coi(spark, d).select("paper_id", "reviewer_id", "flagged"), ["paper_id", "reviewer_id"], "left")
    part = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    terms = F.array(part("n", F.col("s_nationkey")), part("k", F.col("reviewer_id") % 4))
    score = F.when(F.col("flagged").isNull(), F.least(F.lit(1.0), 0.55 * F.col("sim") + 0.25 * F.col("authority") + F.col("kg")))
    covers = F.concat(terms, F.array(part("q", (F.col("paper_id") + F.col("reviewer_id")) % 3)))
    return rows.select("paper_id", "reviewer_id", "sim", "authority", "role", "kg", "citations", (F.col("sim") < 0.40).alias("failed"), score.alias("score"), terms.alias("terms"), covers.alias("covers"))


_JACCARD = "len(list_intersect({0}.terms, {1}.terms))::DOUBLE / greatest(1, len(list_distinct(list_concat({0}.terms, {1}.terms))))"
_ROUNDS = "round(authority, 9) DESC"
CHOSEN = PEOPLE + f""", x AS (SELECT l_orderkey paper_id, l_suppkey reviewer_id, max(l_quantity) / 50 sim, max(l_discount) kg, count(*) citations FROM lineitem GROUP BY 1, 2),
cf AS (SELECT DISTINCT l_orderkey paper_id, l_suppkey reviewer_id, true flagged FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey),
r AS (SELECT x.*, authority, role, sim < 0.40 failed, CASE WHEN flagged IS NULL THEN least(1.0, 0.55::DOUBLE * sim + 0.25::DOUBLE * authority + kg) END score,
 ['n' || s_nationkey, 'k' || (x.reviewer_id % 4)] terms, ['n' || s_nationkey, 'k' || (x.reviewer_id % 4), 'q' || ((x.paper_id + x.reviewer_id) % 3)] covers
 FROM x JOIN b USING (reviewer_id) JOIN supplier ON s_suppkey = x.reviewer_id LEFT JOIN cf USING (paper_id, reviewer_id)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ok DESC, round(sim, 9) DESC, reviewer_id) at_
 FROM (SELECT *, coalesce(score IS NOT NULL AND NOT failed AND sim >= 0.50 AND score >= 0.25, false) ok FROM r)),
c3 AS (SELECT *, quantile_cont(CASE WHEN ok THEN sim END, 0.5) OVER w sim_mid, quantile_cont(CASE WHEN ok THEN authority END, 0.5) OVER w auth_mid FROM c2 WINDOW w AS (PARTITION BY paper_id)),
e0 AS (SELECT *, CASE WHEN at_ <= 18 AND sim >= greatest(0.55, sim_mid) THEN 1 WHEN at_ <= 18 AND sim >= 0.55 THEN 2 WHEN at_ <= 3 THEN 3 END lvl FROM c3 WHERE ok),
e1 AS (SELECT *, min(lvl) OVER (PARTITION BY paper_id) ml FROM e0),
k1 AS (SELECT * FROM e1 WHERE lvl = ml QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY role = 'expert' DESC, {_ROUNDS}, round(sim, 9) DESC, at_) = 1),
m0 AS (SELECT c3.*, {_JACCARD.format('c3', 'k1')} ja, list_filter(c3.covers, lambda y: NOT list_contains(k1.covers, y)) new_, k1.covers ca,
 CASE WHEN c3.at_ - (c3.at_ > k1.at_)::INT <= 18 AND c3.sim >= c3.sim_mid AND (c3.role = 'moderate' OR c3.authority >= greatest(0.25, c3.auth_mid)) THEN 1
 WHEN c3.role IN ('moderate', 'expert') OR c3.authority >= greatest(0.25, c3.auth_mid) THEN 2 ELSE 3 END lvl FROM c3 JOIN k1 USING (paper_id) WHERE c3.ok AND c3.at_ <> k1.at_),
k2 AS (SELECT *, 0.64 * (0.68 * sim + 0.32 * authority) + 0.28 * len(new_) / 3.0::DOUBLE - 0.12 * ja marginal FROM m0
 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY lvl, round(marginal, 9) DESC, round(sim, 9) DESC, at_) = 1),
f0 AS (SELECT m0.* EXCLUDE (lvl), k2.at_ ab, greatest(m0.ja, {_JACCARD.format('m0', 'k2')}) penalty, len(list_filter(m0.new_, lambda y: NOT list_contains(k2.covers, y))) / 3.0::DOUBLE gain,
 CASE WHEN m0.at_ <> k2.at_ AND (m0.role = 'fresher' OR m0.authority <= m0.auth_mid) AND m0.sim >= greatest(0.45, m0.sim_mid * 0.75) AND m0.authority >= 0.30 THEN 1
 WHEN m0.sim >= 0.45 AND m0.authority >= 0.30 THEN 2 END lvl FROM m0 JOIN k2 USING (paper_id)),
f1 AS (SELECT *, lvl = min(lvl) OVER (PARTITION BY paper_id) pool, 0.64 * (0.70 * sim + 0.30 * authority) - 0.36 * penalty + 0.22 * gain mmr FROM f0),
k3 AS (SELECT * FROM f1 WHERE pool AND at_ <> ab QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY round(mmr, 9) DESC, at_) = 1),
z AS (SELECT c3.*, k1.role = 'expert' AS anchored, greatest(0.55, c3.sim_mid) floor_, k2.lvl l2, f1.penalty, CASE WHEN c3.at_ = k1.at_ THEN 1 WHEN c3.at_ = k2.at_ THEN 2 WHEN c3.at_ = k3.at_ THEN 3 END pick,
 CASE WHEN f1.pool THEN greatest(0.0, least(1.0, c3.score - 0.30 * f1.penalty)) ELSE c3.score END final
 FROM c3 JOIN k1 USING (paper_id) LEFT JOIN k2 USING (paper_id) LEFT JOIN k3 USING (paper_id) LEFT JOIN f1 ON f1.paper_id = c3.paper_id AND f1.at_ = c3.at_ AND c3.ok),
v AS (SELECT *, CASE WHEN pick IS NOT NULL THEN 0 WHEN ok THEN 1 WHEN score IS NOT NULL THEN 2 END tier, row_number() OVER (PARTITION BY paper_id ORDER BY tier NULLS LAST, pick,
 CASE WHEN ok THEN -at_::DOUBLE ELSE round(sim, 9) END DESC, round(final, 9) DESC, {_ROUNDS}, reviewer_id) slot FROM z),
k AS (SELECT paper_id, slot, reviewer_id, CASE pick WHEN 1 THEN 'expert' WHEN 2 THEN 'moderate' WHEN 3 THEN 'fresher' ELSE role END role, sim, authority, kg, citations, final,
 tier = 2 OR (tier = 1 AND slot > 2 AND authority < 0.30) weak,
 CASE WHEN pick = 1 THEN anchored AND sim >= floor_ WHEN pick = 2 THEN l2 = 1 WHEN pick = 3 THEN 1 - penalty >= 0.20 WHEN weak THEN false END satisfied,
 CASE WHEN pick = 1 THEN CASE WHEN satisfied THEN '{P.HELD["expert"]}' ELSE '{P.BEST["expert"]}' END WHEN pick = 2 THEN CASE WHEN satisfied THEN '{P.HELD["moderate"]}' ELSE '{P.BEST["moderate"]}' END
 WHEN pick = 3 THEN CASE WHEN satisfied THEN '{P.HELD["fresher"]}' ELSE '{P.BEST["fresher"]}' END WHEN weak THEN '{P.COMPLETED}' END label FROM v WHERE tier IS NOT NULL AND slot <= 3)
"""


@query(CHOSEN + "SELECT paper_id, slot, reviewer_id, role, round(final, 6) score, satisfied, label FROM k")
def panel_selection(spark, d):
    """Eligibility, pools, picks, completion and fallback for every order."""
    out = P.select_panels(_candidates(spark, d))
    return out.select("paper_id", "slot", "reviewer_id", "role", F.round("score", 6).alias("score"), "satisfied", "label")


ASSIGNED = CHOSEN + """, pv AS (SELECT paper_id, max(CASE WHEN slot = 1 THEN final END) g1, max(CASE WHEN slot = 2 THEN final END) g2, max(CASE WHEN slot = 3 THEN final END) g3 FROM k GROUP BY 1),
p2 AS (SELECT *, CASE WHEN g2 >= g1 THEN greatest(0, g1 - 0.03) ELSE g2 END h2 FROM pv), p3 AS (SELECT *, CASE WHEN g3 >= h2 THEN greatest(0, h2 - 0.03) ELSE g3 END h3 FROM p2),
pl AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC NULLS LAST, reviewer_id) place, count(score) OVER (PARTITION BY paper_id) n FROM r),
lo AS (SELECT k.paper_id, k.slot, pl.reviewer_id peer, row_number() OVER (PARTITION BY k.paper_id, k.slot ORDER BY place) i FROM k JOIN pl ON pl.paper_id = k.paper_id AND pl.reviewer_id <> k.reviewer_id
 WHERE pl.score IS NULL OR round(k.final, 9) > round(pl.score, 9)),
lw AS (SELECT paper_id, slot, count(*) outranked, max(CASE WHEN i = 1 THEN peer END) first_peer, max(CASE WHEN i = 2 THEN peer END) second_peer FROM lo GROUP BY 1, 2),
cx AS (SELECT paper_id, avg(CASE WHEN score IS NOT NULL THEN authority END) avg_authority, max(CASE WHEN score IS NOT NULL THEN sim END) top_similarity FROM r GROUP BY 1)
"""


@query(ASSIGNED + """SELECT k.paper_id, slot, k.reviewer_id, k.role, round(CASE slot WHEN 1 THEN g1 WHEN 2 THEN h2 ELSE h3 END, 6) assigned, round(pl.place::DOUBLE / n, 6) percentile, coalesce(outranked, 0) outranked, first_peer, second_peer,
 round(avg_authority, 6) avg_authority, round(top_similarity, 6) top_similarity, CASE k.role WHEN 'expert' THEN CASE WHEN k.sim < 0.40 THEN 'Low topic similarity' WHEN k.authority < greatest(0.45, avg_authority * 0.80) THEN 'Lower academic authority for expert role'
 ELSE 'Strong authority profile with sufficient topic alignment' END WHEN 'moderate' THEN CASE WHEN k.sim BETWEEN 0.30 AND 0.50 THEN 'Moderate alignment' WHEN k.sim < 0.30 AND k.kg < 0.15 THEN 'Limited topic alignment'
 WHEN k.authority < 0.25 THEN 'Lower academic authority' ELSE 'Balanced topic alignment with sufficient authority' END ELSE CASE WHEN k.sim < 0.25 AND k.kg < 0.15 THEN 'Exploratory coverage'
 WHEN k.citations < 20 THEN 'Exploratory coverage with limited citation evidence' ELSE 'Relevant topical exposure with acceptable reliability evidence' END END weakness
 FROM k JOIN p3 USING (paper_id) JOIN pl ON pl.paper_id = k.paper_id AND pl.reviewer_id = k.reviewer_id LEFT JOIN lw USING (paper_id, slot) JOIN cx ON cx.paper_id = k.paper_id""")
def panel_assignments(spark, d):
    """Ordered scores, percentiles, outranked peers and weaknesses of every panel."""
    out = P.assign_panels(_candidates(spark, d))
    six = lambda c: F.round(c, 6).alias(c)
    peer = lambda i: F.get("peers", F.lit(i))
    return out.select("paper_id", "slot", "reviewer_id", "role", six("assigned"), six("percentile"), "outranked", peer(0).alias("first_peer"), peer(1).alias("second_peer"), six("avg_authority"), six("top_similarity"), "weakness")
