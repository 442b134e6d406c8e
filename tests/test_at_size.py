"""What must not grow with the square of a table: vector search and truth make no row of a pair that isn't ranked."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions import scores as S
from panelspark.operators import ranking as R
from panelspark.plans import catalog as C


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _odd(i, rnd):
    """Null, short, empty and endless vectors, a null inside, and copies, among others."""
    for n, v in {19: None, 17: [1.0, 1.0], 13: [0.5, None, 1.0, 2.0], 23: [], 29: [math.nan, 1.0, 0.0, 0.0], 31: [math.inf, 1.0, 1.0, 1.0], 3: [1.0, 2.0, 0.5, 0.25]}.items():
        if i % n == 0:
            return v
    return [rnd.choice([0.0, 1.0, -1.5, rnd.random()]) for _ in range(4)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vector_top_k_in_blocks_equals_all_pairs(spark, monkeypatch, kind):
    for name, size in (("QUERY_BLOCK", 7), ("ITEM_BLOCK", 40), ("SLICE", 3)):
        monkeypatch.setattr(R, name, size)
    rnd = random.Random(3)
    rows = [(None if i % 37 == 0 else i if kind == "long" else f"x{i}", _odd(i, rnd)) for i in range(200)]
    items = spark.createDataFrame(rows, f"reviewer_id {kind}, v array<double>")
    queries = items.withColumnRenamed("reviewer_id", "paper_id").where("paper_id is not null").limit(60)
    pairs = items.join(queries.withColumnRenamed("v", "qv")).where("paper_id <> reviewer_id").select("paper_id", "reviewer_id", S.dot(F.col("qv"), F.col("v")).alias("score"))
    ranked = pairs.withColumn("rank", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["paper_id"])).toPandas()
    for k in (1, 60):
        found = R.vector_top_k(queries, items, k)
        assert " Join" not in _plan(found)
        assert sorted(map(repr, found.toPandas().itertuples(index=False, name=None))) == sorted(map(repr, ranked[ranked["rank"] <= k].itertuples(index=False, name=None)))
    assert R.vector_top_k(queries, items.limit(0), 3).count() == R.vector_top_k(queries.limit(0), items, 3).count() == 0


def test_values_are_rounded_as_spark_rounds(spark):
    values = [0.1234567885, -0.1234567885, 0.12345678949999999, 2.5e-10, 5e-10, -5e-10, 1.0000000005, 12345678.123456789, 3e20, 0.0, 1.5e-9]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 9)).collect()]
    import numpy as np

    assert [float(f"{y}") / 1e9 for y in R._nine(np.array(values))] == pytest.approx(want, rel=1e-15, abs=0)


def test_truth_makes_ranked_pairs_only_and_counts_the_rest(spark, tmp_path):
    rows = [(i, [1.0, float(i)], None if i == 50 else 7 if i == 100 else i % 3) for i in range(160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ranking = spark.createDataFrame([(0, 3, 1), (0, 4, 2), (150, 0, 1), (100, 1, 1), (50, 2, 1)], "paper_id long, reviewer_id long, rank int")
    d = str(tmp_path)
    got = {(r.paper_id, r.reviewer_id): (r.hit, r.n_truth) for r in C._hits(spark, d, ranking).collect()}
    labels = [r[2] for r in rows]
    size = labels.count(0) - 1
    assert got == {(0, 3): (1, size), (0, 4): (0, size), (150, 0): (1, size)}  # 50 has no label, 100 is alone with its own
    assert C._truth(spark, d, ranking).count() == 2


def test_only_candidates_texts_are_cut_into_words(spark, tmp_path):
    from panelspark.plans import comparisons as P

    spark.createDataFrame([(i, f"word{i}") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.createDataFrame([(0, 3), (0, 4), (50, 3)], "paper_id long, reviewer_id long")
    assert {r.id for r in P._text_counts(spark, str(tmp_path), rows).collect()} == {0, 3, 4}


@pytest.mark.parametrize("block, side", [(4096, 49152), (7, 20)])
def test_similar_texts_equal_all_pairs_and_make_no_row_of_a_pair(spark, monkeypatch, block, side):
    import re
    from collections import Counter

    from panelspark.operators import similar as N

    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "SIDE", side)
    monkeypatch.setattr(N, "CELLS", 150)
    monkeypatch.setattr(N, "SUMMED", 40)
    rnd = random.Random(5)
    base = [[f"word{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 14))] for _ in range(30)]
    rows = [(i, " ".join([*(w for w in base[i % 30] if rnd.random() < 0.95), rnd.choice(["", "Template words", f"own{i}x"])])) for i in range(110)]
    rows += [(200, None), (201, ""), (202, "a b"), (3, "more words here"), (3, None), (None, "word1 Template"), (None, "word2 template")]
    found = {}
    for i, text in rows:
        found.setdefault(i, Counter()).update(re.findall("[a-z0-9]{4,}", (text or "").lower()))
    found = {i: c for i, c in found.items() if c}
    n, df = len([i for i in found if i is not None]), Counter(w for c in found.values() for w in c)
    unit = {}
    for i, c in found.items():
        w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[i] = {t: x / norm for t, x in w.items()}
    want = {}
    for a in unit:
        for b in unit:
            if a is not None and b is not None and a < b:
                score = sum(x * unit[b].get(t, 0.0) for t, x in unit[a].items())
                if round(score, 9) >= 0.8:
                    want[a, b] = pytest.approx(score, abs=1e-9)
    got = N.similar_texts(spark.createDataFrame(rows, "id long, text string").repartition(3), "[a-z0-9]{4,}", 0.8)
    assert len(want) > 60 and {(r.a, r.b): r.score for r in got.collect()} == want
    assert "Join" not in _plan(got).split("FlatMapGroupsInArrow")[0]
    assert N.similar_texts(spark.createDataFrame([], "id long, text string"), "[a-z0-9]{4,}", 0.8).count() == 0


def test_lexical_top_k_in_blocks_equals_all_pairs(spark, monkeypatch):
    for name, size in (("QUERY_BLOCK", 7), ("ITEM_BLOCK", 40)):
        monkeypatch.setattr(R, name, size)
    rnd = random.Random(9)
    some = lambda n: rnd.sample(range(-9, 9), rnd.randrange(n))
    rows = [(i, some(9), None if i % 17 == 0 else some(4)) for i in range(120)] + [(None, [1, 2], [1]), (500, [], [])]
    items = spark.createDataFrame(rows, "reviewer_id long, tokens array<long>, keywords array<long>")
    queries = items.withColumnRenamed("reviewer_id", "paper_id").where("paper_id % 5 = 0")
    part = lambda a, b: len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
    wanted = {(p, r) for p in range(0, 120, 5) for r in rnd.sample(range(120), 6) if p != r} | {(500, 1)}
    want = {}
    for p, t, w in rows:
        if p is not None and p % 5 == 0:
            scores = {r: 0.45 * part(t, u) + 0.55 * part(w or (), x or ()) for r, u, x in rows if r is not None and r != p}
            best = sorted((r for r in scores if scores[r] > 0), key=lambda r: (-round(scores[r], 9), r))[:10]
            for r in scores:
                if r in best or (p, r) in wanted:
                    want[p, r] = (pytest.approx(scores[r]), best.index(r) + 1 if r in best else None, (p, r) in wanted)
    found = R.lexical_top_k(queries, items, 10, spark.createDataFrame(sorted(wanted), "paper_id long, reviewer_id long"))
    assert {(r.paper_id, r.reviewer_id): (r.lexical, r.n, r.wanted) for r in found.collect()} == want
    assert "explode(tokens" not in _plan(found) and "explode(keywords" not in _plan(found)


def test_pair_tfidf_makes_no_row_of_a_pairs_term(spark):
    from panelspark.operators import textoverlap as O

    docs = spark.createDataFrame([(i, f"graph model word{i % 3} graph other{i}") for i in range(6)] + [(6, None)], "id long, text string")
    grams = O.gram_counts(docs).persist()
    pairs = spark.createDataFrame([(p, r) for p in range(7) for r in range(8) if p != r], "paper_id long, reviewer_id long")
    cosine, best = O.pair_tfidf(pairs, grams, grams)
    joins = [line for line in _plan(cosine).splitlines() if " Join" in line]
    assert not any("term" in line for line in joins)
    rows = {(r.paper_id, r.reviewer_id): r.cosine for r in cosine.collect()}
    assert len(rows) == 49 and rows[0, 3] > rows[0, 1] > 0 == rows[6, 0] == rows[0, 6] == rows[0, 7]
    assert {r.paper_id for r in best.collect()} == set(range(6))


@pytest.mark.parametrize("at_once", [65_536, 60])
def test_ranking_quality_by_k_takes_every_embedding_as_a_paper(spark, tmp_path, monkeypatch, at_once):
    import duckdb

    monkeypatch.setattr(C, "AT_ONCE", at_once)
    rnd = random.Random(11)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], i % 7) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in duck.execute(C.SQL["ranking_quality_by_k"]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in C.QUERIES["ranking_quality_by_k"](spark, str(tmp_path)).collect()}
    assert {r[0] for r in got.values()} == {200} and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_bm25_and_tfidf_in_blocks_equal_the_plain_joins_and_make_no_row_of_a_word(spark, monkeypatch):
    from panelspark.functions import text as T
    from panelspark.operators import knowledge as K
    from panelspark.operators import wordsearch as B

    monkeypatch.setattr(B, "QUERIES", 7)
    monkeypatch.setattr(B, "CELLS", 60)
    rnd = random.Random(6)
    some = lambda n: " ".join(f"Word{int(rnd.random() ** 3 * 40)}" for _ in range(rnd.randrange(n)))
    docs = spark.createDataFrame([(None if i % 31 == 0 else i % 100, None if i % 29 == 0 else some(20)) for i in range(120)] + [(i, "word1 Word2 same") for i in range(100, 112)], "id long, text string").repartition(3)
    queries = spark.createDataFrame([(None if i == 5 else i, some(9)) for i in range(17)] + [(3, "word7 same"), (40, "same"), (41, "")], "id long, text string")
    rows = lambda df: sorted((r.paper_id or -1, r["rank"], r.reviewer_id, round(r.score, 9)) for r in df.collect())
    best = lambda s: s.withColumn("rank", S.rank_by(F.col("score"), F.col("reviewer_id"), by=["paper_id"])).where("rank <= 4")
    words = T.tokens(F.col("text"), "[a-z0-9]+", distinct=False)
    got, want = B.bm25_top_k(docs, queries, "[a-z0-9]+", 4), rows(best(K.bm25(K.term_counts(docs, words), K.term_counts(queries, words))))
    assert len(want) > 50 and rows(got) == want and "Join" not in _plan(got)
    docs, queries = docs.where("id is not null"), queries.where("id is not null")  # the plain form counts those without an id as one more, the SQL doesn't
    named = lambda df, letter: df.select(F.concat(F.lit(letter), "id").alias("id"), "text")
    w = K.tfidf(K.term_counts(named(docs, "d").unionByName(named(queries, "b")), words))
    plain = best(K.sparse_cosine(w.where(F.col("id").startswith("b")), w.where(F.col("id").startswith("d"))))
    text = lambda df: sorted((r.paper_id, r["rank"], r.reviewer_id, round(r.score, 9)) for r in df.collect())
    found = B.tfidf_top_k(docs, queries, "[a-z0-9]+", 4, ("b", "d"))
    assert text(found) == text(plain) and "Join" not in _plan(found)
    assert B.bm25_top_k(docs.limit(0), queries, "a", 3).count() == B.tfidf_top_k(docs, queries.limit(0), "a", 3, ("b", "d")).count() == 0


def test_similar_texts_of_many_sides_meet_in_rounds(spark, monkeypatch):
    from panelspark.operators import similar as N

    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "SIDE", 5)
    docs = spark.createDataFrame([(i, f"words alike{i % 9} here{i % 9}") for i in range(60)], "id long, text string")
    some, whole = N.similar_texts(docs, "[a-z0-9]{4,}", 0.8), None
    assert "FlatMapGroupsInArrow" not in _plan(some)  # the rounds are tables
    monkeypatch.setattr(N, "SIDES", 100)
    whole = N.similar_texts(docs, "[a-z0-9]{4,}", 0.8)
    assert "FlatMapGroupsInArrow" in _plan(whole) and sorted(map(tuple, some.select("a", "b").collect())) == sorted(map(tuple, whole.select("a", "b").collect()))
    assert some.count() > 100


def test_panels_are_assigned_without_a_shuffle_after_the_rows_lie_by_paper(spark):
    from panelspark.operators import panels as P

    rnd = random.Random(8)
    rows = [(p, r, rnd.random(), rnd.random(), rnd.choice(["expert", "moderate", "fresher"]), rnd.random(), rnd.randrange(40), rnd.random() < 0.1, rnd.choice([None, rnd.random()]), [f"n{r % 3}"], [f"n{r % 3}", f"q{p % 2}"]) for p in range(12) for r in range(9)]
    ranked = spark.createDataFrame(rows, "paper_id long, reviewer_id long, sim double, authority double, role string, kg double, citations long, failed boolean, score double, terms array<string>, covers array<string>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.assign_panels(ranked)
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.paper_id, r.slot): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    picks = {(r.paper_id, r.slot): r for r in P.select_panels(ranked).collect()}
    assert got.keys() == picks.keys() and all(got[k].reviewer_id == picks[k].reviewer_id and got[k].role == picks[k].role for k in got) and len(got) > 20
