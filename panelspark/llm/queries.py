"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, fertility, html, impacts, lines, minhash, packing, passages, phrases, pieces, pii, spotsigs, toxicity
from .common import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.cut(table(spark, sf_dir, "documents")).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.search(impacts.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def _over(operator: Callable[[DataFrame], DataFrame], name: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _op1,
    "op2_line_dedup": _over(lines.report),
    "op3_fingerprints": _over(spotsigs.fingerprints),
    "op4_packing": _over(packing.pack),
    "op5_near_dedup": _over(minhash.classes),
    "op6_quality_rules": _over(fertility.rules),
    "op7_html_extraction": _over(html.extract, "pages"),
    "op8_substring_dedup": _op8,
    "op9_pii": _over(pii.report),
    "op10_pieces": _over(pieces.round_trip),
    "op11_collocations": _over(phrases.collocations),
    "op12_lexical_search": _op12,
    "op13_near_vectors": _over(caps.near_vectors, "embeddings"),
}

#: The first ten aren't expressible in SQL as a whole; tests/llm holds their brute-force versions.
ORACLES: dict[str, str] = {
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase FROM w, range(1, 4) q(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') ws, f a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, c.k, phrase, ws, a, j, array_to_string(ws[:j], ' ') first_, array_to_string(ws[j + 1:], ' ') rest FROM c, range(1, 3) q(j) WHERE j < c.k),
s AS (SELECT cut.*, x.f l, y.f r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT score FROM cut
 JOIN f x ON x.lang = cut.lang AND x.phrase = first_ AND x.k = j JOIN f y ON y.lang = cut.lang AND y.phrase = rest AND y.k = cut.k - j),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, part, max(a) a FROM (SELECT lang, a, array_to_string(ws[:2], ' ') part FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(ws[2:], ' ') FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT m.* FROM m LEFT JOIN o ON o.lang = m.lang AND o.part = m.phrase AND m.k = 2 WHERE o.a IS NULL OR 100 * o.a < 50 * m.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () row_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts FROM documents),
s AS (SELECT count(*) n_docs, sum(len(ts))::BIGINT total FROM d WHERE len(ts) > 0),
p AS (SELECT row_, term, count(*) tf FROM (SELECT row_, unnest(ts) term FROM d) GROUP BY ALL),
q AS (SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) term FROM (SELECT row_number() OVER () item, * FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM p, s GROUP BY term, n_docs),
x AS (SELECT item, item_id, row_, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * n_docs) // total))))::BIGINT score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (row_), s GROUP BY item, item_id, row_, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INTEGER rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10""",
    "op13_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept FROM (SELECT a vec_id, min(b) component_id FROM c GROUP BY 1) LEFT JOIN (SELECT a vec_id, count(*) n FROM l GROUP BY 1) USING (vec_id)""",
}
