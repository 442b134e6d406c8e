"""Reviewers' texts and retrieval: sources with their twenty largest documents as publications; every 50th embedding as a paper."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..operators import keyterms as K
from ..operators import profiles as P
from ..operators import reviewers as W
from .catalog import PAPERS, query, table
from .profiles import _TOKENS, _TX
from .terms import TERMS, _concepts, _texts

_LINE = "string_split(text, chr(10))[1]"


def _reviewers(spark, d):
    """The title is the first line, citations are characters, the venue is the language."""
    docs = table(spark, d, "documents").where("source is not null")
    first = docs.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where(F.col("k") <= 20)
    text = F.coalesce("text", F.lit(""))
    work = F.struct("k", F.split(text, "\n")[0].alias("title"), text.alias("abstract"), F.col("n_chars").alias("citations"), F.col("k").alias("rank"), F.col("lang").alias("venue"))
    rows = first.groupBy(F.col("source").alias("reviewer_id")).agg(F.sort_array(F.collect_list(work)).alias("publications"))  # twenty at most
    none = F.array().cast("array<string>")
    return rows.select("reviewer_id", F.col("reviewer_id").alias("area"), F.lit(None).cast("string").alias("interests"), F.array("reviewer_id").alias("keywords"), none.alias("venues"), "publications")


_SHELF = f"""bk AS (SELECT source, doc_id, coalesce(text, '') text, lang, trim(coalesce({_LINE}, '')) title, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) k FROM documents WHERE source IS NOT NULL QUALIFY k <= 20),
wk AS (SELECT *, trim(CASE WHEN title = '' THEN trim(text) WHEN trim(text) = '' THEN title ELSE title || ' ' || trim(text) END) w FROM bk),
rvt AS (SELECT source, string_agg(w, ' ' ORDER BY k) text FROM wk WHERE k <= 5 GROUP BY 1), tx AS (SELECT 'r' kind, source id_, text FROM rvt)"""
REVIEWERS = TERMS.replace(_TX, _SHELF) + """, kx AS (SELECT id[2:] reviewer_id, list(term ORDER BY rank, term) ts FROM c1 WHERE lower(term) <> lower(id[2:]) GROUP BY 1),
vn AS (SELECT source reviewer_id, list(lang ORDER BY k) vs FROM (SELECT source, lang, min(k) k FROM bk WHERE lang IS NOT NULL AND trim(lang) <> '' GROUP BY 1, 2) GROUP BY 1),
rx AS (SELECT s.source reviewer_id, list_concat([s.source], coalesce(ts, []))[1:20] kws, array_to_string(coalesce(vs, [])[1:5], ' ') ven FROM (SELECT DISTINCT source FROM bk) s LEFT JOIN kx ON kx.reviewer_id = s.source LEFT JOIN vn ON vn.reviewer_id = s.source),
bs AS (SELECT reviewer_id, kws, reviewer_id || ' ' || array_to_string(kws, ' ') || CASE WHEN ven = '' THEN '' ELSE ' ' || ven END base FROM rx),
ch AS (SELECT reviewer_id, 0 k, base chunk FROM bs UNION ALL SELECT source, k, w FROM wk WHERE k <= 12 AND w <> '')
"""


@query(REVIEWERS + "SELECT bs.reviewer_id, len(kws) n_keywords, array_to_string(kws, '|') keywords, length(base || coalesce(' ' || t, '')) n_chars, md5(base || coalesce(' ' || t, '')) text_md5 FROM bs LEFT JOIN (SELECT source, trim(string_agg(w, ' ' ORDER BY k)) t FROM wk WHERE k <= 12 GROUP BY 1) x ON x.source = bs.reviewer_id")
def reviewer_texts(spark, d):
    """Each source's keywords, topped up from its publications, and its whole text."""
    rows = W.with_keywords(_reviewers(spark, d), _concepts(spark, d))
    text = W.reviewer_text()
    return rows.select("reviewer_id", F.size("keywords").alias("n_keywords"), F.array_join("keywords", "|").alias("keywords"), F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


@query(REVIEWERS + "SELECT reviewer_id, row_number() OVER (PARTITION BY reviewer_id ORDER BY k) - 1 pos, length(chunk) n_chars, md5(chunk) chunk_md5 FROM ch")
def reviewer_chunks(spark, d):
    """The chunks of each source's profile with their places."""
    rows = W.with_keywords(_reviewers(spark, d), _concepts(spark, d))
    return W.reviewer_chunks(rows).select("reviewer_id", "pos", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(f"""WITH bk AS (SELECT source, coalesce(text, '') text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) k FROM documents WHERE source IS NOT NULL QUALIFY k <= 10),
t AS (SELECT source, source || ' ' || source || ' ' || string_agg({_LINE} || ' ' || text[1:500], ' ' ORDER BY k) x FROM bk GROUP BY 1),
w AS (SELECT source, unnest(list_distinct(string_split_regex(lower(x), '[^\\p{{L}}\\p{{N}}]+'))) w FROM t)
SELECT source reviewer_id, count(*) n_tokens, md5(string_agg(w, ' ' ORDER BY w)) tokens_md5 FROM w WHERE length(w) > 3 GROUP BY 1""")
def reviewer_tokens(spark, d):
    """The words of each source's profile."""
    rows = _reviewers(spark, d).select("reviewer_id", W.profile_tokens().alias("t"))
    return rows.select("reviewer_id", F.size("t").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5")).where("n_tokens > 0")


RETRIEVED = 20


@query(TERMS + f""", kk AS (SELECT id[2:]::BIGINT id, list(term) k FROM ks WHERE id[1] = 'd' GROUP BY 1), rr AS (SELECT vec_id id, embedding::DOUBLE[] v, {_TOKENS.format("coalesce(text, '')")} t, coalesce(k, []) k FROM embeddings JOIN documents ON doc_id = vec_id LEFT JOIN kk ON id = vec_id),
sc AS (SELECT a.id p, b.id r, list_cosine_similarity(a.v, b.v) c, list_dot_product(a.v, b.v) dp, 0.45 * coalesce(len(list_intersect(a.t, b.t))::DOUBLE / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0)
 + 0.55 * coalesce(len(list_intersect(a.k, b.k))::DOUBLE / nullif(len(list_distinct(list_concat(a.k, b.k))), 0), 0) l FROM rr a JOIN rr b ON a.id <> b.id WHERE a.id % 50 = 0),
po AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(dp, 9) DESC, r) i, row_number() OVER (PARTITION BY p ORDER BY round(l, 9) DESC, r) j FROM sc QUALIFY i <= 150 OR (j <= 75 AND l > 0)),
fu AS (SELECT p, r, c, l, 0.82 * c + 0.18 * l s FROM po)
SELECT p paper_id, r reviewer_id, round(c, 6) cosine, round(l, 6) lexical, round(s, 6) score, row_number() OVER (PARTITION BY p ORDER BY round(s, 9) DESC, r) rank FROM fu QUALIFY rank <= {RETRIEVED}""")
def candidate_retrieval(spark, d):
    """The twenty best documents for every 50th one by vectors and words."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    docs = _texts(spark, d, "documents", "doc_id").join(vectors.select(F.col("vec_id").alias("id")), "id", "left_semi")  # no other text is cut into words
    number = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    words = K.keyword_sets(docs, _concepts(spark, d)).groupBy("id").agg(number(F.collect_set("term")).alias("keywords"))  # a text's terms
    rows = vectors.join(docs, F.col("id") == F.col("vec_id")).join(words, "id", "left")
    rows = rows.select("vec_id", "v", number(P.lexical_tokens(F.col("text"), V.LEXICAL_STOP)).alias("tokens"), F.coalesce("keywords", F.array().cast("array<bigint>")).alias("keywords")).persist()
    out = W.retrieve(rows.where(PAPERS).withColumnRenamed("vec_id", "paper_id"), rows.withColumnRenamed("vec_id", "reviewer_id"), RETRIEVED)
    return out.select("paper_id", "reviewer_id", *[F.round(c, 6).alias(c) for c in ("cosine", "lexical", "score")], "rank")
