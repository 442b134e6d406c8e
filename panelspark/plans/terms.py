"""Key terms, concepts and term matching over the texts: documents are publications, sources reviewers, benchmark items papers.

The vocabulary is a table: the fixed concept map, and for every benchmark item its first two
words and its longest word, which its passages in the documents hold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import keyterms as K
from .catalog import query, table


def _texts(spark, d, name, key):
    return table(spark, d, name).select(F.col(key).alias("id"), "text")


def _concepts(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    b = table(spark, d, "benchmark").select("item_id", words.alias("w"))
    longest = F.element_at(F.sort_array(F.transform("w", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
    name = lambda kind: F.concat(F.lit(kind), F.col("item_id").cast("string")).alias("concept")
    opening = b.select(F.array_join(F.slice("w", 1, 2), " ").alias("key"), name("opening "))
    return K.concept_table(spark).unionByName(opening).unionByName(b.select(longest.alias("key"), name("topic "))).where("key is not null")


def _quoted(values):
    return ", ".join("'" + v + "'" for v in values)


_SYNONYM = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.SYNONYMS.items()) + " ELSE w END"
_SUFFIX = "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 5 AND w LIKE '%ed' THEN w[:-3] ELSE w END"
_FIXED = ", ".join(f"('{k}', '{c}')" for k, cs in V.CONCEPTS.items() for c in cs)
_DROPPED = _quoted(dict.fromkeys([*V.STOPWORDS, *V.GENERIC]))
_MARKED = r"' ' || regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_ ]+| {{2,}}', ' # ', 'g') || ' '"


def _forms(source: str, into: str) -> str:
    """SQL that enriches ``source(id, term, rank)`` by the table ``cm``."""
    return f"""{into} AS (SELECT id, term, min(added * 1000 + rank) at_ FROM (SELECT id, term, rank, 0 added FROM {source} UNION ALL
 SELECT id, concept, rank, 1 FROM {source}, cm WHERE key = lower(term) OR (lower(term) LIKE '%s' AND key = lower(term)[:-2]) OR (lower(term) LIKE '%ing' AND key = lower(term)[:-4])
 OR (lower(term) LIKE '%ies' AND length(term) > 4 AND key = lower(term)[:-4] || 'y')) GROUP BY ALL)"""


TERMS = rf"""WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') w FROM benchmark),
cm(key, concept) AS (SELECT * FROM (VALUES {_FIXED}) UNION ALL SELECT array_to_string(w[1:2], ' '), 'opening ' || item_id FROM bw WHERE len(w) > 0
 UNION ALL SELECT list_sort(list_transform(w, lambda x: {{'n': -length(x), 'x': x}}))[1].x, 'topic ' || item_id FROM bw WHERE len(w) > 0),
tx AS (SELECT 'd' kind, doc_id id_, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
dt AS (SELECT kind || id_ id, coalesce(text, '') t FROM tx),
sp AS (SELECT id, string_split_regex(regexp_replace(lower(t), '[^a-z0-9\s]', ' ', 'g'), '\s+') ws FROM dt),
sy AS (SELECT id, list_transform(ws, lambda w: {_SYNONYM}) ws FROM sp),
kw AS (SELECT id, list_filter(list_transform(ws, lambda w: {_SUFFIX}), lambda w: length(w) > 3 AND NOT list_contains([{_DROPPED}], w)) w FROM sy),
pk AS (SELECT DISTINCT key, {_MARKED.format('key')} m FROM cm WHERE contains(key, ' ')),
ev AS (SELECT id, unnest(w) term, generate_subscripts(w, 1) - 1 pos FROM kw
 UNION ALL SELECT id, CASE WHEN length(w[i]) > 4 AND length(w[i + 1]) > 4 THEN w[i] || ' ' || w[i + 1] END, 1000000000 + i - 1 FROM (SELECT id, w, unnest(range(1, len(w))) i FROM kw)
 UNION ALL SELECT id, key, 2000000000 FROM (SELECT id, {_MARKED.format('t')} m FROM dt) x JOIN pk ON contains(x.m, pk.m)),
kt AS (SELECT id, term, count(*) n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos), term) rank FROM ev WHERE term IS NOT NULL GROUP BY id, term QUALIFY rank <= 10),
{_forms('kt', 'e1')},
c1 AS (SELECT id, term, at_ rank FROM e1 WHERE length(term) > 4 AND term NOT IN ({_DROPPED})),
ks AS (SELECT DISTINCT id, lower(term) term FROM c1),
{_forms('c1', 'e2')},
tt AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY at_, term) place FROM e2 QUALIFY place <= 8)
"""


@query(TERMS + "SELECT id[2:]::BIGINT doc_id, term, n, rank FROM kt WHERE id[1] = 'd'")
def key_terms(spark, d):
    """Words, adjacent pairs and phrases of the vocabulary, the ten most frequent of each document."""
    keys = _concepts(spark, d).select("key").distinct()
    return K.key_terms(_texts(spark, d, "documents", "doc_id"), keys).withColumnRenamed("id", "doc_id")


@query(TERMS + "SELECT id[2:]::BIGINT doc_id, term FROM ks WHERE id[1] = 'd'")
def keyword_sets(spark, d):
    """The cleaned key terms of each document with the concepts that the vocabulary adds."""
    return K.keyword_sets(_texts(spark, d, "documents", "doc_id"), _concepts(spark, d)).withColumnRenamed("id", "doc_id")


@query(TERMS + "SELECT id[2:]::BIGINT doc_id, term, place FROM tt WHERE id[1] = 'd'")
def topic_terms(spark, d):
    """The first eight topic terms of each document."""
    return K.topic_terms(_texts(spark, d, "documents", "doc_id"), _concepts(spark, d)).withColumnRenamed("id", "doc_id")


def _sides(spark, d):
    """Papers' and reviewers' keyword sets, kept for the joins that read them several times."""
    concepts = _concepts(spark, d)
    papers = K.keyword_sets(_texts(spark, d, "benchmark", "item_id"), concepts).withColumnRenamed("id", "paper_id").persist()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("reviewer_id"))
    terms = K.keyword_sets(_texts(spark, d, "documents", "doc_id"), concepts)
    return papers, docs.join(terms, "id").select("reviewer_id", "term").where("reviewer_id is not null").distinct().persist()


MATCHED = TERMS + f""", rv AS (SELECT DISTINCT source reviewer_id, term FROM ks JOIN documents ON 'd' || doc_id = id WHERE source IS NOT NULL),
pp AS (SELECT id[2:]::BIGINT paper_id, term FROM ks WHERE id[1] = 'b'),
s0 AS (SELECT item_id paper_id, lower(string_split(text, '.')[1]) w FROM benchmark), s1 AS (SELECT paper_id, {_SYNONYM} w FROM s0),
rf AS (SELECT DISTINCT paper_id, trim(regexp_replace({_SUFFIX}, '[^a-z0-9\\s]', '', 'g')) term FROM s1),
pr AS (SELECT * FROM pp UNION SELECT * FROM rf WHERE term <> ''),
di AS (SELECT DISTINCT term r FROM rv)
"""


@query(MATCHED + """, mt AS (SELECT DISTINCT p.term p, r FROM (SELECT DISTINCT term FROM pr) p JOIN di ON contains(p.term, r) OR contains(r, p.term)),
cs AS (SELECT paper_id, reviewer_id, count(DISTINCT p) n FROM pr JOIN mt ON mt.p = pr.term JOIN rv ON rv.term = mt.r GROUP BY 1, 2),
ss AS (SELECT paper_id, reviewer_id, count(DISTINCT p) n FROM pp JOIN mt ON mt.p = pp.term JOIN rv ON rv.term = mt.r GROUP BY 1, 2)
SELECT cs.paper_id, cs.reviewer_id, cs.n hits, round(least(1.0, cs.n::DOUBLE / greatest(3, least(10, (SELECT count(*) FROM pr WHERE pr.paper_id = cs.paper_id)))), 6) citation,
 round(least(0.75, coalesce(ss.n, 0)::DOUBLE / greatest(3, least(12, (SELECT count(*) FROM pp WHERE pp.paper_id = cs.paper_id)))), 6) sparse FROM cs LEFT JOIN ss USING (paper_id, reviewer_id)""")
def citation_overlap(spark, d):
    """Items against sources by terms and reference titles that contain each other, and the sparse proxy."""
    papers, reviewers = _sides(spark, d)
    first = F.array(F.element_at(F.split("text", r"\."), 1))
    titles = K.reference_keys(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), first.alias("titles"))).withColumnRenamed("id", "paper_id")
    cited = K.containment_scores(papers.unionByName(titles).distinct(), reviewers)
    sparse = K.containment_scores(papers, reviewers, most=12, cap=0.75).select("paper_id", "reviewer_id", F.col("score").alias("sparse"))
    out = cited.join(sparse, ["paper_id", "reviewer_id"], "left")
    return out.select("paper_id", "reviewer_id", "hits", F.round("score", 6).alias("citation"), F.round(F.coalesce("sparse", F.lit(0.0)), 6).alias("sparse"))


@query(MATCHED + r"""SELECT paper_id, reviewer_id, count(DISTINCT pp.term) hits FROM pp JOIN rv ON pp.term = rv.term OR string_split(pp.term, ' ')[1] = string_split(rv.term, ' ')[1]
 OR (contains(rv.term, pp.term) AND contains(' ' || trim(regexp_replace(rv.term, '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(pp.term, '[^\p{L}\p{N}_]+', ' ', 'g')) || ' '))
 WHERE length(pp.term) >= 4 GROUP BY 1, 2""")
def term_overlap(spark, d):
    """How many of an item's terms a source's terms match by whole words or by the first word."""
    return K.topic_overlap(*_sides(spark, d))
