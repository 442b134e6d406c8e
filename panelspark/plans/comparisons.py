"""Methods compared: every 50th embedding is a paper, its hundred nearest are candidates, and their texts are the documents of the same ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import comparison as C
from ..operators import evaluate as E
from ..operators import keyterms as K
from ..operators import knowledge as G
from ..operators import learned as L
from ..operators import ranking as R
from ..operators import textoverlap as O
from .catalog import SIGNALS, _conflicts, _hits, _signals, _truth, _truth_sizes, query, table
from .terms import TERMS, _concepts, _quoted, _texts


def _candidates(spark, d):
    """The signals of every candidate; papers whose id divides by 100 have no second model."""
    rows = _signals(spark, d)
    p, r = F.col("paper_id"), F.col("reviewer_id")
    cross = F.when(p % 100 > 0, (F.pmod(p * 5 + r * 3, F.lit(7)) - 1) / 6.0)
    final = 0.6 * F.col("semantic") + 0.3 * F.col("kg") + 0.1 * F.col("profile")
    return rows.withColumns({"authority": F.pmod(r * 11, F.lit(97)) / 96.0, "llm": F.col("profile"), "final": final, "cross": cross})


def _ablations(spark, d):
    rows = _candidates(spark, d)
    return C.ablations(rows, _conflicts(rows))


def _place(column):
    return f"row_number() OVER (PARTITION BY paper_id ORDER BY round({column}, 9) DESC, reviewer_id)"


_MIXED = "0.34 * semantic + 0.33 * kg + 0.33 * profile"
_MODES = {
    "semantic_only": "semantic", "semantic_authority": "0.7 * semantic + 0.3 * au", "semantic_kg": "0.5 * semantic + 0.5 * kg", "semantic_llm": "0.5 * semantic + 0.5 * profile", "semantic_kg_llm": _MIXED,
    "semantic_kg_authority": "0.75 * semantic + 0.2 * kg + 0.05 * au", "coi_filtering": "CASE WHEN NOT held THEN semantic END",
    "rrf_fusion": "(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) + 1.0::DOUBLE / (60 + r3) + 1.0::DOUBLE / (60 + r4)) / (4.0::DOUBLE / 61)",
    "full": f"CASE WHEN cr > 0 THEN 0.3 * ({_MIXED}) + 0.7 * cr ELSE {_MIXED} END",
}
ABLATIONS = SIGNALS + f""", ab AS (SELECT *, (reviewer_id * 11 % 97) / 96.0::DOUBLE au, 0.6 * semantic + 0.3 * kg + 0.1 * profile fi, (paper_id + reviewer_id) % 11 = 0 held,
 CASE WHEN paper_id % 100 > 0 THEN ((paper_id * 5 + reviewer_id * 3) % 7 - 1) / 6.0::DOUBLE END cr FROM g),
ak AS (SELECT *, {_place("semantic")} r1, {_place("au")} r2, {_place("kg")} r3, {_place("fi")} r4 FROM ab),
md AS ({" UNION ALL ".join(f"SELECT '{m}' AS mode, paper_id, reviewer_id, ({x})::DOUBLE score FROM ak" for m, x in _MODES.items())}),
ar AS (SELECT *, row_number() OVER (PARTITION BY mode, paper_id ORDER BY round(score, 9) DESC, reviewer_id) rank FROM md WHERE score IS NOT NULL)
"""


def _per_paper(source: str, k: int) -> str:
    """SQL that evaluates the rankings ``source``."""
    return f""", az AS (SELECT x.*, ea.label = eb.label hit, n_truth, sum(CASE WHEN ea.label = eb.label THEN 1 ELSE 0 END) OVER (PARTITION BY mode, paper_id ORDER BY rank) seen
 FROM {source} x JOIN embeddings ea ON ea.vec_id = paper_id JOIN embeddings eb ON eb.vec_id = reviewer_id JOIN t USING (paper_id)),
au AS (SELECT mode, paper_id, n_truth, min(CASE WHEN hit THEN rank END) f, count_if(hit AND rank <= {k}) top, sum(CASE WHEN hit THEN seen::DOUBLE / rank ELSE 0 END) / n_truth ap,
 sum(CASE WHEN hit AND rank <= {k} THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(range(1, least(n_truth, {k}) + 1), lambda x: 1 / log2(x + 1.0::DOUBLE))) ndcg FROM az GROUP BY 1, 2, 3)
"""


@query(ABLATIONS + "SELECT mode, paper_id, reviewer_id, round(score, 6) score, rank FROM ar")
def ablation_rankings(spark, d):
    """every candidate in each of the nine modes."""
    return _ablations(spark, d).withColumn("score", F.round("score", 6))


@query(ABLATIONS + _per_paper("ar", 5) + """SELECT mode, count(*) n_papers, round(avg(top / 5.0::DOUBLE), 6) AS "precision", round(avg(top::DOUBLE / n_truth), 6) recall, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) mrr, round(avg(ap), 6) map, round(avg(ndcg), 6) ndcg,
 round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE / f ELSE 0 END), 6) mrr_5, round(avg(CASE WHEN f <= 10 THEN 1.0::DOUBLE / f ELSE 0 END), 6) mrr_10, round(avg(CASE WHEN f IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) recall_100 FROM au GROUP BY 1""")
def ablation_quality(spark, d):
    """Each mode's metrics, with reciprocal ranks cut at 5 and 10."""
    marked = _hits(spark, d, _ablations(spark, d)).persist()
    return E.mean_metrics(E.per_paper(marked, 5, ["mode", "paper_id"]), ["mode"]).join(C.cut_metrics(marked).drop("n_papers"), "mode")


@query(ABLATIONS + """SELECT mode, paper_id, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 5 THEN score END), 6) margin,
 max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 5 THEN score END) < 0.035 AS open FROM ar GROUP BY 1, 2""")
def rerank_gate(spark, d):
    """which papers' orders are open, by mode."""
    return C.rerank_gate(_ablations(spark, d)).withColumn("margin", F.round("margin", 6))


# ---- baselines and pairs of texts

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_KNOWN = "label % 3 <> 0"
BASELINES = SIGNALS + f""", tk AS (SELECT doc_id id, w term, count(*) tf FROM (SELECT doc_id, unnest({_WORDS}) w FROM documents) GROUP BY ALL), sz AS (SELECT id, sum(tf) len FROM tk GROUP BY 1),
pr AS (SELECT paper_id, reviewer_id, semantic, coalesce(len, 0) len, count(*) OVER (PARTITION BY paper_id) n, avg(coalesce(len, 0)) OVER (PARTITION BY paper_id) av FROM g LEFT JOIN sz ON id = reviewer_id),
mt AS (SELECT pr.*, q.tf qf, c.tf, count(*) OVER (PARTITION BY paper_id, q.term) df FROM pr JOIN tk q ON q.id = paper_id JOIN tk c ON c.id = reviewer_id AND c.term = q.term),
lx AS (SELECT paper_id, reviewer_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(av, 1e-9))) * qf) bm FROM mt GROUP BY 1, 2),
cn AS (SELECT pr.*, coalesce(bm, 0) bm, coalesce(n_chars // 500, 0) h, coalesce(n_chars, 0) ct FROM pr LEFT JOIN lx USING (paper_id, reviewer_id) LEFT JOIN documents ON doc_id = reviewer_id),
bp AS (SELECT paper_id, reviewer_id, {_place("semantic")} semantic, {_place("bm")} bm25, row_number() OVER (PARTITION BY paper_id ORDER BY md5('42:' || paper_id || ':' || reviewer_id), reviewer_id) random,
 row_number() OVER (PARTITION BY paper_id ORDER BY h DESC, ct DESC, reviewer_id) authority FROM cn),
bl AS (SELECT * FROM (UNPIVOT bp ON semantic, bm25, random, authority INTO NAME mode VALUE rank) WHERE rank <= 3)
"""


def _texts_of(spark, d, rows):
    """The texts of the papers and reviewers of ``rows``; others are never cut into words."""
    ids = rows.select(F.col("paper_id").alias("id")).union(rows.select("reviewer_id")).distinct()
    return _texts(spark, d, "documents", "doc_id").join(ids, "id", "left_semi")


def _text_counts(spark, d, rows):
    return G.term_counts(_texts_of(spark, d, rows), T.tokens(F.col("text"), "[a-z0-9]+", distinct=False))


def _baselines(spark, d):
    rows = _signals(spark, d).select("paper_id", "reviewer_id", "semantic")
    counts = _text_counts(spark, d, rows)
    people = table(spark, d, "documents").select(F.col("doc_id").alias("reviewer_id"), F.floor(F.col("n_chars") / 500).cast("double").alias("h"), F.col("n_chars").cast("double").alias("citations"))
    return C.baselines(rows.join(people, "reviewer_id", "left"), C.listwise_bm25(rows, counts, counts))


@query(BASELINES + "SELECT mode, paper_id, reviewer_id, rank FROM bl")
def baseline_panels(spark, d):
    """the first three of each paper by similarity, words, chance and authority."""
    return _baselines(spark, d)


@query(BASELINES + f""", tr AS (SELECT a.vec_id paper_id, count(*) m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.{_KNOWN} AND a.vec_id % 50 = 0 GROUP BY 1),
bh AS (SELECT bl.*, m, ea.label = eb.label AND m IS NOT NULL hit FROM bl JOIN embeddings ea ON ea.vec_id = paper_id JOIN embeddings eb ON eb.vec_id = reviewer_id LEFT JOIN tr USING (paper_id))
SELECT mode, paper_id, m IS NOT NULL has_truth, round(CASE WHEN m > 0 THEN count_if(hit)::DOUBLE / count(*) END, 6) AS "precision", round(CASE WHEN m > 0 THEN count_if(hit)::DOUBLE / m END, 6) recall, round(CASE WHEN m > 0 THEN max(CASE WHEN hit THEN 1.0::DOUBLE / rank ELSE 0 END) END, 6) mrr,
 round(CASE WHEN m > 0 THEN sum(CASE WHEN hit THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(range(1, least(m, count(*)) + 1), lambda x: 1 / log2(x + 1.0::DOUBLE))) END, 6) ndcg FROM bh GROUP BY mode, paper_id, m""")
def baseline_quality(spark, d):
    """The baselines' panels; every third label stands for papers without truth."""
    known = table(spark, d, "embeddings").where(_KNOWN).select(F.col("vec_id").alias("paper_id"))
    rows = _baselines(spark, d)
    out = C.list_quality(rows, _truth(spark, d, rows).join(known, "paper_id", "left_semi"), sizes=_truth_sizes(spark, d).join(known, "paper_id", "left_semi"))
    return out.select("mode", "paper_id", "has_truth", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


_IDF = "1.4054651081081644::DOUBLE"
GRAMS = rf""", gw AS (SELECT doc_id id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_quoted(dict.fromkeys(V.STOPWORDS))}], w)) w FROM documents),
gc AS (SELECT id, term, count(*) tf FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) term FROM gw) GROUP BY ALL),
gp AS (SELECT paper_id, reviewer_id, a.term, a.tf p, b.tf r FROM g JOIN gc a ON a.id = paper_id LEFT JOIN gc b ON b.id = reviewer_id AND b.term = a.term),
gs AS (SELECT id, sum(tf * tf) sq FROM gc GROUP BY 1), gh AS (SELECT paper_id, reviewer_id, sum(p * r) dp, sum(p * p) pp, sum(r * r) rr FROM gp WHERE r IS NOT NULL GROUP BY 1, 2),
gx AS (SELECT g.paper_id, g.reviewer_id, semantic, coalesce(dp / sqrt(({_IDF} * {_IDF} * (a.sq - pp) + pp) * ({_IDF} * {_IDF} * (b.sq - rr) + rr)), 0) cosine FROM g LEFT JOIN gh USING (paper_id, reviewer_id) LEFT JOIN gs a ON a.id = g.paper_id LEFT JOIN gs b ON b.id = g.reviewer_id)
"""


def _pair_tfidf(spark, d):
    rows = _signals(spark, d)
    grams = O.gram_counts(_texts_of(spark, d, rows)).persist()  # read by both sides of the pairs
    return O.pair_tfidf(rows, grams, grams)


@query(SIGNALS + GRAMS + "SELECT paper_id, reviewer_id, round(cosine, 6) tfidf, round(CASE WHEN reviewer_id % 2 = 0 THEN semantic ELSE cosine END, 6) semantic FROM gx")
def pair_tfidf(spark, d):
    """The TF-IDF cosine of each pair's two texts; every second reviewer stands for one without an embedding."""
    cosine, _ = _pair_tfidf(spark, d)
    rows = _signals(spark, d).join(cosine, ["paper_id", "reviewer_id"])
    known = F.when(F.col("reviewer_id") % 2 == 0, F.col("semantic"))
    return rows.select("paper_id", "reviewer_id", F.round("cosine", 6).alias("tfidf"), F.round(O.semantic_overlap(known, F.col("cosine")), 6).alias("semantic"))


@query(SIGNALS + GRAMS + f"""SELECT paper_id, reviewer_id, term, round(p * CASE WHEN r IS NULL THEN {_IDF} ELSE 1 END, 6) weight,
 row_number() OVER (PARTITION BY paper_id, reviewer_id ORDER BY round(p * CASE WHEN r IS NULL THEN {_IDF} ELSE 1 END, 9) DESC, term) place FROM gp QUALIFY place <= 5""")
def pair_terms(spark, d):
    """The five heaviest terms of the paper for each pair."""
    return _pair_tfidf(spark, d)[1].withColumn("weight", F.round("weight", 6))


@query(SIGNALS + r""", lw AS (SELECT doc_id id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: length(w) > 4)) w FROM documents)
SELECT paper_id, reviewer_id, array_to_string(list_sort(list_intersect(a.w, b.w))[1:3], '|') words FROM g JOIN lw a ON a.id = paper_id JOIN lw b ON b.id = reviewer_id""")
def shared_words(spark, d):
    """M26."""
    words = O.long_words(_texts_of(spark, d, _signals(spark, d)))
    side = lambda key, name: words.select(F.col("id").alias(key), F.col("words").alias(name))
    rows = _signals(spark, d).join(side("paper_id", "p"), "paper_id").join(side("reviewer_id", "r"), "reviewer_id")
    return rows.select("paper_id", "reviewer_id", F.array_join(O.shared_words(F.col("p"), F.col("r")), "|").alias("words"))


@query(TERMS + SIGNALS.replace("WITH ", ", ", 1) + GRAMS + r""", kl AS (SELECT id[2:]::BIGINT id, list(term) k FROM ks WHERE id[1] = 'd' GROUP BY 1),
nm AS (SELECT id, k, list_transform(k, lambda x: {'t': x, 'f': string_split(x, ' ')[1], 'n': ' ' || trim(regexp_replace(x, '[^\p{L}\p{N}_]+', ' ', 'g')) || ' '}) z FROM kl),
hc AS (SELECT paper_id, reviewer_id, semantic, cosine, coalesce(len(a.k), 0) n, coalesce(len(list_filter(a.z, lambda x: length(x.t) >= 4 AND len(list_filter(b.z, lambda y: x.t = y.t OR x.f = y.f OR (contains(y.t, x.t) AND contains(y.n, x.n)))) > 0)), 0) h
 FROM gx LEFT JOIN nm a ON a.id = paper_id LEFT JOIN nm b ON b.id = reviewer_id),
sm AS (SELECT *, CASE WHEN reviewer_id % 2 = 0 THEN semantic END far, CASE WHEN reviewer_id % 2 = 0 THEN semantic WHEN reviewer_id % 4 = 1 THEN semantic ELSE cosine END s FROM hc)
SELECT paper_id, reviewer_id, round(CASE WHEN n = 0 THEN 0 WHEN h > 0 THEN h::DOUBLE / n WHEN s > 0.2 THEN s * 0.5 ELSE 0 END, 6) score, round(CASE WHEN n = 0 OR h > 0 THEN 0 ELSE s END, 6) semantic,
 CASE WHEN n = 0 THEN 'none' WHEN h > 0 THEN 'terms' WHEN far IS NOT NULL THEN 'prefetched' ELSE 'semantic' END source FROM sm""")
def topic_chain(spark, d):
    """Terms, else the prefetched similarity (even ids), else the embedding (every fourth id), else the words."""
    cosine, _ = _pair_tfidf(spark, d)
    terms = K.keyword_sets(_texts_of(spark, d, _signals(spark, d)), _concepts(spark, d)).groupBy("id").agg(F.collect_set("term").alias("k")).persist()
    side = lambda key, name: terms.select(F.col("id").alias(key), F.col("k").alias(name))
    rows = _signals(spark, d).select("paper_id", "reviewer_id", "semantic").join(cosine.withColumnRenamed("cosine", "tfidf"), ["paper_id", "reviewer_id"])
    rows = rows.join(side("paper_id", "p"), "paper_id", "left").join(side("reviewer_id", "r"), "reviewer_id", "left")
    even, fourth = F.col("reviewer_id") % 2 == 0, F.col("reviewer_id") % 4 == 1
    hits = F.when(F.col("p").isNotNull() & F.col("r").isNotNull(), F.size(O.matched_terms(F.col("p"), F.col("r"))))
    rows = rows.withColumns({"n_terms": F.when(F.col("p").isNotNull(), F.size("p")), "hits": hits, "prefetched": F.when(even, F.col("semantic")), "cosine": F.when(fourth, F.col("semantic"))})
    return O.topic_chain(rows).withColumns({"score": F.round("score", 6), "semantic": F.round("semantic", 6)})


# ---- tests and the verdict

METHODS = ABLATIONS + GRAMS + """, wr AS (SELECT mode, paper_id, reviewer_id, rank FROM ar WHERE mode IN ('full', 'semantic_only') UNION ALL
 SELECT 'tfidf', paper_id, reviewer_id, row_number() OVER (PARTITION BY paper_id ORDER BY round(cosine, 9) DESC, reviewer_id) FROM gx)
"""
_STEPS = 4000
TESTS = _per_paper("wr", 5) + f""", df AS (SELECT b.mode, count(*) n, avg(a.ndcg - b.ndcg) md, coalesce(stddev_samp(a.ndcg - b.ndcg), 0) sd FROM au a JOIN au b USING (paper_id) WHERE a.mode = 'full' AND b.mode <> 'full' GROUP BY 1),
tv AS (SELECT mode, n, md, sd, CASE WHEN sd < 1e-12 THEN 0 ELSE md / (sd / sqrt(n)) END tt, (n - 1)::DOUBLE v FROM df),
ig AS (SELECT mode, sum((CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs(tt) * i / {_STEPS}, 2) / v, -(v + 1) / 2)) * abs(any_value(tt)) / {_STEPS} / 3 a FROM tv, range(0, {_STEPS} + 1) q(i) WHERE sd >= 1e-12 GROUP BY mode, tt),
sg AS (SELECT mode, n, md, tt, CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE 1 - 2 * a * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) END p FROM tv LEFT JOIN ig USING (mode))
"""


def _compared(spark, d):
    cosine, _ = _pair_tfidf(spark, d)
    words = C.ranked(cosine.select(F.lit("tfidf").alias("mode"), "paper_id", "reviewer_id", F.col("cosine").alias("score")), 100)
    rows = _ablations(spark, d).where(F.col("mode").isin("full", "semantic_only")).unionByName(words)
    return E.per_paper(_hits(spark, d, rows), 5, ["mode", "paper_id"]).persist()


@query(METHODS + TESTS + "SELECT mode, n, round(md, 6) mean_difference, round(tt, 5) t, round(p, 5) p_value FROM sg")
def method_significance(spark, d):
    """The full mode against the embedding and the words, by a paired t-test over common papers; the SQL integrates the density."""
    out = C.significance(_compared(spark, d), "full")
    return out.select("mode", "n", F.round("mean_difference", 6).alias("mean_difference"), F.round("t", 5).alias("t"), F.round("p_value", 5).alias("p_value"))


@query(METHODS + TESTS + """, me AS (SELECT mode, round(avg(ndcg), 6) ndcg, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) mrr, round(avg(ap), 6) map FROM au GROUP BY 1)
SELECT CASE WHEN s.p >= 0.05 THEN 'competitive_not_significantly_better_than_embedding' WHEN f.ndcg - e.ndcg > 0 THEN 'improved_over_embedding' ELSE 'does_not_outperform_embedding' END ranking_status,
 CASE WHEN w.p < 0.05 THEN 'significantly_better_than_tfidf' WHEN f.ndcg > l.ndcg THEN 'better_than_tfidf_but_not_statistically_confirmed' ELSE 'not_better_than_tfidf' END tfidf_status,
 round(f.ndcg - e.ndcg, 6) ndcg_delta, round(f.mrr - e.mrr, 6) mrr_delta, round(f.map - e.map, 6) map_delta, round((f.ndcg - e.ndcg) / abs(e.ndcg) * 100, 4) ndcg_percent, round(s.p, 6) p_value
FROM me f, me e, me l, sg s, sg w WHERE f.mode = 'full' AND e.mode = 'semantic_only' AND l.mode = 'tfidf' AND s.mode = 'semantic_only' AND w.mode = 'tfidf'""")
def system_verdict(spark, d):
    """How the full mode stands to the embedding and to the words."""
    scores = _compared(spark, d)
    return C.verdict(E.mean_metrics(scores, ["mode"]), C.significance(scores, "full"), "full", "semantic_only", "tfidf")


@query(SIGNALS + """, lb AS (SELECT g.*, ea.label = eb.label AND ea.vec_id <> eb.vec_id rel FROM g JOIN embeddings ea ON ea.vec_id = paper_id JOIN embeddings eb ON eb.vec_id = reviewer_id)
SELECT paper_id, reviewer_id, CASE WHEN rel THEN 'false_negative' ELSE 'high_false_positive' END kind, round(profile, 6) score FROM lb WHERE (rel AND profile <= 1e-12) OR (NOT rel AND profile > 0.7)""")
def hard_cases(spark, d):
    """Relevant candidates that the profile gives nothing, and others it rates above 0.7."""
    rows = _signals(spark, d)
    rows = rows.join(_truth(spark, d, rows).withColumn("label", F.lit(1)), ["paper_id", "reviewer_id"], "left")
    return C.hard_cases(rows, "profile", "label").withColumn("score", F.round("score", 6))


@query()
def penalised_assignment(spark, d):
    """Panels of all papers in order, by scores that fall with the load; the order is the meaning, so a test compares it with a plain fold."""
    rows = _candidates(spark, d)
    part = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    terms = F.array(part("a", F.col("reviewer_id") % 5), part("b", F.col("reviewer_id") % 3), part("c", F.col("reviewer_id") % 2))
    caps = table(spark, d, "embeddings").select(F.col("vec_id").alias("reviewer_id"), (F.col("vec_id") % 3 + 1).alias("capacity"))
    out = R.penalised_assignment(rows.select("paper_id", "reviewer_id", F.col("final").alias("score"), terms.alias("terms")), caps)
    return out.withColumn("value", F.round("value", 6))


# ---- the learned ranker on seven features


def _features(spark, d):
    p, r = F.col("paper_id"), F.col("reviewer_id")
    rows = _candidates(spark, d).withColumns({"kg_confidence": F.pmod(p + r * 17, F.lit(83)) / 82.0, "keyword": F.pmod(p * 2 + r, F.lit(71)) / 70.0})
    named = rows.select("paper_id", "reviewer_id", "semantic", (F.least("kg", F.col("semantic") + 0.25) * F.col("kg_confidence")).alias("kg_effective"), "kg", "kg_confidence", "keyword", "authority", F.col("final").alias("hybrid"))
    labels = _truth(spark, d, rows).withColumn("label", F.lit(1))
    return L.features(named.join(labels, ["paper_id", "reviewer_id"], "left").na.fill(0, ["label"]))


@query(ABLATIONS + f""", ft AS (SELECT paper_id, reviewer_id, semantic, kg, ((paper_id + reviewer_id * 17) % 83) / 82.0::DOUBLE kc, ((paper_id * 2 + reviewer_id) % 71) / 70.0::DOUBLE kw FROM ab),
fe AS (SELECT *, least(kg, semantic + 0.25) * kc ke FROM ft), fr AS (SELECT fe.*, {_place("semantic")} r1, {_place("ke")} r2, (ea.label = eb.label)::INT label FROM fe JOIN embeddings ea ON ea.vec_id = paper_id JOIN embeddings eb ON eb.vec_id = reviewer_id),
fs AS (SELECT least(50.0::DOUBLE, greatest(1, count_if(label = 0))::DOUBLE / greatest(1, count_if(label = 1))) w FROM fr)
SELECT paper_id, reviewer_id, label, round(semantic, 6) semantic, round(ke, 6) kg_effective, round(kg, 6) kg, round(kc, 6) kg_confidence, round(kw, 6) keyword, round(1.0::DOUBLE / r1, 6) rr_semantic, round(1.0::DOUBLE / r2, 6) rr_kg,
 round(CASE WHEN label = 1 THEN w WHEN r1 <= 30 THEN 2.0 ELSE 1.0 END, 6) weight FROM fr, fs""")
def learned_features(spark, d):
    """The seven features of every candidate, and its weight with hard negatives."""
    rows = L.weighted(_features(spark, d), hard=30)
    return rows.select("paper_id", "reviewer_id", "label", *[F.round(c, 6).alias(c) for c in [*L.FEATURES, "weight"]])


@query(ABLATIONS + "SELECT g.paper_id, count(*) n, count_if(ea.label = eb.label)::BIGINT n_relevant FROM g JOIN embeddings ea ON ea.vec_id = g.paper_id JOIN embeddings eb ON eb.vec_id = g.reviewer_id GROUP BY 1")
def learned_group_sizes(spark, d):
    """L08."""
    return L.group_sizes(_features(spark, d))


@query()
def learned_rankings(spark, d):
    """Each paper's candidates in the order of a model that has not seen it."""
    out = L.rankings(L.out_of_fold(L.folded(_features(spark, d)), L.FEATURES, iterations=5, hard=30))
    return out.select("paper_id", "reviewer_id", "label", "fold", F.round("score", 6).alias("score"), "rank")


@query()
def feature_importance(spark, d):
    """The shares of the seven features and of their groups."""
    return L.importance(L.weighted(_features(spark, d)), L.FEATURES, L.GROUPS)
