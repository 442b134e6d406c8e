"""Profiles: benchmark items are papers, sources reviewers whose text is that of their five largest documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import vocabulary as V
from ..operators import keyterms as K
from ..operators import profiles as P
from ..operators import ranking as R
from .catalog import query, table
from .terms import _DROPPED, _SUFFIX, _SYNONYM, TERMS, _concepts, _quoted, _texts

CANDIDATES = 5


def _reviewer_texts(spark, d, most=5):
    """Each source's largest documents in one text."""
    docs = table(spark, d, "documents").where("source is not null").select("source", "doc_id", "n_chars", "text")
    first = docs.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where(F.col("k") <= most)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])  # five at most
    return first.groupBy(F.col("source").alias("id")).agg(F.array_join(texts, " ").alias("text"))


def _profiles(spark, d):
    concepts = _concepts(spark, d)
    papers = K.topic_terms(_texts(spark, d, "benchmark", "item_id"), concepts, 12)
    reviewers = K.topic_terms(_reviewer_texts(spark, d), concepts, 14)
    return P.profiles(papers, P.PAPER_FIELDS, V.PAPER_METHODS, 5), P.profiles(reviewers, P.REVIEWER_FIELDS, V.REVIEWER_METHODS, 6)


def _candidates(spark, d):
    """The five sources that share most of an item's tokens."""
    p = _texts(spark, d, "benchmark", "item_id").select(F.col("id").alias("paper_id"), P.lexical_tokens(F.col("text")).alias("tokens"))
    r = _reviewer_texts(spark, d).select(F.col("id").alias("reviewer_id"), P.lexical_tokens(F.col("text")).alias("tokens"))
    pairs = R.lexical_pairs(p, r)
    return p, r, pairs.withColumn("n", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["paper_id"])).where(F.col("n") <= CANDIDATES)


_TX = "tx AS (SELECT 'd' kind, doc_id id_, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)"
_RV = """rvt AS (SELECT source, string_agg(text, ' ' ORDER BY n_chars DESC, doc_id) text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) k
 FROM documents WHERE source IS NOT NULL) WHERE k <= 5 GROUP BY 1), tx AS (SELECT 'r' kind, source id_, text FROM rvt UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark)"""
assert _TX in TERMS


def _values(fields: dict) -> str:
    return ", ".join(f"('{f}', {n})" for f, n in fields.items())


def _profile_sql(name: str, kind: str, fields: dict, methods: list[str], limit: int, most: int) -> str:
    return f"""{name}0 AS (SELECT id[2:] id, term, row_number() OVER (PARTITION BY id ORDER BY at_, term) place FROM e2 WHERE id[1] = '{kind}' QUALIFY place <= {limit}),
{name} AS (SELECT id, field, term, place FROM {name}0, (VALUES {_values(fields)}) x(field, n) WHERE place <= n UNION ALL
 SELECT id, 'methods', term, place FROM (SELECT * FROM {name}0 WHERE regexp_matches(term, '{"|".join(methods)}') QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= {most}))"""


_ALIAS = "CASE x " + " ".join(f"WHEN '{a}' THEN [{_quoted(ws)}]" for a, ws in V.ACRONYMS.items()) + " ELSE [] END"
_STEM = "CASE WHEN length(x) > 5 AND x LIKE '%ies' THEN [x[:-4] || 'y'] WHEN length(x) > 5 AND x LIKE '%es' THEN [x[:-3]] WHEN length(x) > 4 AND x LIKE '%s' THEN [x[:-2]] ELSE [] END"
_TOKENS = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\-]{{2,}}'), lambda x: length(x) > 3 AND NOT list_contains([" + _quoted(V.LEXICAL_STOP) + "], x)))"
PROFILED = TERMS.replace(_TX, _RV) + f""", {_profile_sql('pf', 'b', P.PAPER_FIELDS, V.PAPER_METHODS, 12, 5)},
{_profile_sql('rf', 'r', P.REVIEWER_FIELDS, V.REVIEWER_METHODS, 14, 6)},
n0 AS (SELECT DISTINCT term, lower(term) w FROM (SELECT term FROM pf UNION ALL SELECT term FROM rf)), n1 AS (SELECT term, {_SYNONYM} w FROM n0),
nf AS (SELECT term, trim(regexp_replace({_SUFFIX}, '[^a-z0-9\\s]', '', 'g')) t FROM n1),
pt AS (SELECT id::BIGINT paper_id, field, t FROM pf JOIN nf USING (term) WHERE t <> ''), rt AS (SELECT id reviewer_id, field, t FROM rf JOIN nf USING (term) WHERE t <> ''),
xt AS (SELECT t, list_distinct(list_concat(k, list_concat(flatten(list_transform(k, lambda x: {_ALIAS})), flatten(list_transform(k, lambda x: {_STEM}))))) k
 FROM (SELECT DISTINCT t, {_TOKENS.format('t')} k FROM (SELECT t FROM pt UNION ALL SELECT t FROM rt))),
tp AS (SELECT item_id paper_id, {_TOKENS.format('text')} k FROM benchmark), tr AS (SELECT source reviewer_id, {_TOKENS.format('text')} k FROM rvt),
pr AS (SELECT paper_id, reviewer_id, tp.k a, tr.k b FROM tp, tr WHERE len(list_intersect(tp.k, tr.k)) > 0
 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY round(len(list_intersect(tp.k, tr.k))::DOUBLE / len(list_distinct(list_concat(tp.k, tr.k))), 9) DESC, reviewer_id) <= {CANDIDATES})
"""


def _component_sql(c: str, own: list[str], theirs: list[str], floor: int) -> str:
    short = "CASE WHEN length(p) <= length(r) THEN p ELSE r END"
    n = f"greatest({floor}, least(10, n))"
    tokens = lambda side: f"(SELECT list_distinct(flatten(list(k))) FROM {c}{side} JOIN xt USING (t) WHERE {{}} = {{}})"
    return f""", {c}p AS (SELECT DISTINCT paper_id, t FROM pt WHERE field IN ({_quoted(own)})), {c}r AS (SELECT DISTINCT reviewer_id, t FROM rt WHERE field IN ({_quoted(theirs)})),
{c}pn AS (SELECT paper_id, count(*) n, list_distinct(flatten(list(k))) k FROM {c}p JOIN xt USING (t) GROUP BY 1), {c}rn AS (SELECT reviewer_id, list_distinct(flatten(list(k))) k FROM {c}r JOIN xt USING (t) GROUP BY 1),
{c}m AS (SELECT pr.paper_id, pr.reviewer_id, p.t p, r.t r, contains(p.t, r.t) OR contains(r.t, p.t) AS within, len(list_intersect(a.k, b.k)) both_,
 CASE WHEN p.t = r.t THEN 1.0::DOUBLE WHEN within THEN 0.85 WHEN both_ = 0 THEN 0 ELSE greatest(both_::DOUBLE / len(list_distinct(list_concat(a.k, b.k))), 0.75::DOUBLE * both_ / least(len(a.k), len(b.k))) END s
 FROM pr JOIN {c}p p ON p.paper_id = pr.paper_id JOIN {c}r r ON r.reviewer_id = pr.reviewer_id JOIN xt a ON a.t = p.t JOIN xt b ON b.t = r.t),
{c}b AS (SELECT paper_id, reviewer_id, p, r, s FROM {c}m QUALIFY row_number() OVER (PARTITION BY paper_id, reviewer_id, p ORDER BY s DESC, r) = 1),
{c}e AS (SELECT paper_id, reviewer_id, list_sort(list(DISTINCT {short})) x FROM {c}m WHERE within GROUP BY 1, 2),
{c}s AS (SELECT paper_id, reviewer_id, list_sort(list(s), 'DESC') l, list_sort(list(DISTINCT CASE WHEN round(s, 9) >= 0.35 THEN {short} END)) x FROM {c}b GROUP BY 1, 2),
{c} AS (SELECT pr.paper_id, pr.reviewer_id, CASE WHEN n IS NULL OR y.reviewer_id IS NULL THEN 0 ELSE least(1.0, greatest(len(coalesce(e.x, []))::DOUBLE / {n}, list_sum(l[1:{n}]) / {n},
 CASE WHEN least(len(z.k), len(y.k)) > 0 THEN 0.65::DOUBLE * len(list_intersect(z.k, y.k)) / least(len(z.k), len(y.k)) ELSE 0 END,
 CASE WHEN least(len(z.k), len(y.k)) > 0 THEN 0.35::DOUBLE * len(list_intersect(z.k, y.k)) / len(list_distinct(list_concat(z.k, y.k))) ELSE 0 END, 0.03)) END v,
 list_sort(list_distinct(list_concat(coalesce(e.x, [])[1:8], list_filter(coalesce(s.x, []), lambda q: q IS NOT NULL)[1:8])))[1:8] x
 FROM pr LEFT JOIN {c}pn z ON z.paper_id = pr.paper_id LEFT JOIN {c}rn y ON y.reviewer_id = pr.reviewer_id LEFT JOIN {c}e e ON e.paper_id = pr.paper_id AND e.reviewer_id = pr.reviewer_id
 LEFT JOIN {c}s s ON s.paper_id = pr.paper_id AND s.reviewer_id = pr.reviewer_id)
"""


@query(PROFILED + "".join(_component_sql(f"k{i}", own, theirs, floor) for i, (own, theirs, floor, _) in enumerate(P.COMPONENTS.values())) + """, al AS (SELECT paper_id, reviewer_id, k0.v d, k2.v p, k3.v t,
 CASE WHEN paper_id IN (SELECT paper_id FROM k1p) AND reviewer_id IN (SELECT reviewer_id FROM k1r) THEN k1.v ELSE least(CASE WHEN k1.v > 0 THEN k1.v ELSE k3.v END, k3.v) END m,
 list_sort(list_distinct(list_concat(list_concat(k0.x, k1.x), list_concat(k2.x, k3.x))))[1:10] x FROM k0 JOIN k1 USING (paper_id, reviewer_id) JOIN k2 USING (paper_id, reviewer_id) JOIN k3 USING (paper_id, reviewer_id))
SELECT paper_id, reviewer_id, round(d, 6) "domain", round(m, 6) methods, round(p, 6) publication, round(t, 6) topic, len(x) n_terms,
 round(least(1.0, (0.30 * d + 0.30 * m + 0.20 * p + 0.20 * t) * (0.85 + 0.15 * greatest(0.35, least(0.95, 0.45 + 0.07 * len(x))))), 6) score FROM al""")
def profile_suitability(spark, d):
    """How well the profiles of an item and its candidate sources match, by component."""
    papers, reviewers = (x.persist() for x in _profiles(spark, d))  # used by every component
    pairs = _candidates(spark, d)[2].select("paper_id", "reviewer_id").persist()
    out = P.suitability(pairs, papers, reviewers)
    return out.select("paper_id", "reviewer_id", *[F.round(c, 6).alias(c) for c in P.COMPONENTS], F.size("terms").alias("n_terms"), F.round("score", 6).alias("score"))


_SECTIONS = {"Expertise": ["expertise_domains", "expertise", "research_strengths", "review_strengths"], "Methods": ["methods"], "Publication Focus": ["publication_focus", "topics", "keywords"]}


@query(PROFILED + """, l AS (SELECT reviewer_id, s, t, min(o * 100 + place) o FROM (SELECT rf.id reviewer_id, s, o, place, t FROM rf JOIN nf USING (term)
 JOIN (VALUES ('expertise_domains', 1, 1), ('research_strengths', 1, 3), ('review_strengths', 1, 4), ('methods', 2, 1), ('publication_focus', 3, 1)) v(field, s, o) USING (field) WHERE t <> '') GROUP BY 1, 2, 3),
g AS (SELECT reviewer_id, s, CASE s WHEN 1 THEN 'Expertise: ' WHEN 2 THEN 'Methods: ' ELSE 'Publication Focus: ' END || string_agg(t, '; ' ORDER BY o) line FROM l GROUP BY 1, 2)
SELECT reviewer_id, string_agg(line, chr(10) ORDER BY s) text FROM g GROUP BY 1""")
def profile_documents(spark, d):
    """The text of each source's profile."""
    return P.documents(_profiles(spark, d)[1], _SECTIONS).withColumnRenamed("id", "reviewer_id")


@query(PROFILED + """, ka AS (SELECT id[2:]::BIGINT paper_id, list(term) k FROM ks WHERE id[1] = 'b' GROUP BY 1), kb AS (SELECT id[2:] reviewer_id, list(term) k FROM ks WHERE id[1] = 'r' GROUP BY 1)
SELECT paper_id, reviewer_id, round(0.45 * len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) + 0.55 * coalesce(len(list_intersect(ka.k, kb.k))::DOUBLE / len(list_distinct(list_concat(ka.k, kb.k))), 0), 6) score
 FROM pr LEFT JOIN ka USING (paper_id) LEFT JOIN kb USING (reviewer_id)""")
def blended_lexical(spark, d):
    """The tokens' and the keywords' overlap of each item with its candidate sources."""
    p, r, pairs = _candidates(spark, d)
    concepts = _concepts(spark, d)
    each = lambda rows, key: rows.select(key, F.explode("tokens").alias("t"))
    words = lambda rows, key: K.keyword_sets(rows, concepts).select(F.col("id").alias(key), F.col("term").alias("t"))
    keywords = words(_texts(spark, d, "benchmark", "item_id"), "paper_id"), words(_reviewer_texts(spark, d), "reviewer_id")
    return P.blended_overlap(pairs, (each(p, "paper_id"), each(r, "reviewer_id")), keywords).withColumn("score", F.round("score", 6))
