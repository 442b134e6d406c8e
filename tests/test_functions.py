"""Literal fixtures of the formulas and their edge cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions import scores as S
from panelspark.functions import text as T
from panelspark.operators import evaluate as E
from panelspark.operators import knowledge as K
from panelspark.operators import ranking as R
from panelspark.operators import scoring as G
from panelspark.sources import tables as X
from panelspark.streaming import workload


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def load(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "reviewer_id int, load int")


def test_gini_jain(spark):
    r = E.gini_jain(load(spark, [2, 2, 2, 1, 1, 1])).first()
    assert (r.gini, r.jain, r.mean_load, r.std_load) == (0.166667, 0.9, 1.5, 0.5)
    assert E.gini_jain(load(spark, [0, 0])).first().gini == 0 and E.overload(load(spark, [1] * 6)).first().overloaded == 0


def test_ranking_fixture(spark):
    ranking = spark.createDataFrame([("p", r, i) for i, r in enumerate("abcd", 1)] + [("q", "a", 1)], "paper_id string, reviewer_id string, rank int")
    truth = spark.createDataFrame([("p", r) for r in "bdx"], "paper_id string, reviewer_id string")
    r = E.per_paper(E.hits(ranking, truth), 3).first()
    assert (r.rr, round(r.ap, 6), round(r.p, 6), round(r.r, 6), round(r.ndcg, 6), round(r.ap_k, 6)) == (0.5, 0.333333, 0.333333, 0.333333, 0.296082, 0.166667)


@pytest.mark.parametrize("text,want", [("0.76", 0.76), ("Score: 0.81.", 0.81), ("1.7", 1.0), ("-3", 0.0), (".5", 0.5), ("1 of 2", 1.0), ("Score is 0.9 or 0.2", 0.9), ("none", None), ("7/10", None), ("95%", None), ("nan", None), ("got 1.5", 1.0), ("0%", 0.0), ("1/2", 1.0), ("1e-1", 0.1), ("Result .42", None)])
def test_parse_score(spark, text, want):
    assert one(spark, T.parse_score(F.lit(text))) == want


def test_minmax_rules(spark):
    w = Window.partitionBy(F.lit(1))
    rows = spark.createDataFrame([(0.85,), (0.78,), (0.60,)], "x double")
    got = [r[0] for r in rows.select(S.minmax(F.col("x"), w, 0.5, 1e-8)).collect()]
    assert got == pytest.approx([0.99999996, 0.71999997, 0.0])
    flat = spark.createDataFrame([(3.0,)] * 3, "x double")
    assert [r[0] for r in flat.select(S.minmax(F.col("x"), w, 0.5)).collect()] == [0.5] * 3
    assert [r[0] for r in flat.select(S.minmax(F.col("x"), w, 0.0)).collect()] == [0.0] * 3
    z = spark.createDataFrame([(0.9,), (0.9,), (0.4,), (0.1,)], "x double").select(S.standardise(F.col("x"), w)).collect()
    assert [r[0] for r in z] == pytest.approx([0.721247, 0.721247, 0.374750, 0.199501], abs=1e-6)


def test_rrf(spark):
    assert one(spark, S.rrf([F.lit(1), F.lit(2)])) == pytest.approx(0.991935, abs=1e-6)
    assert one(spark, S.rrf([F.lit(None).cast("int")])) == 0


def test_auc_and_correlation(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, score double")
    assert E.roc_auc(rows, "label", "score").first()[0] == 0.625
    assert E.roc_auc(rows.where("label = 1"), "label", "score").first()[0] is None
    assert E.point_biserial(rows, "label", "score").first()[0] == pytest.approx(0.219382, abs=1e-6)
    assert E.t_p_value(2.0, 10) == pytest.approx(0.073388, abs=1e-5) and E.t_p_value(0.0, 5) == 1.0


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([(1, "graph query graph"), (2, "query plan")], "id int, text string")
    query = spark.createDataFrame([(9, "graph")], "id int, text string")
    count = lambda d: K.term_counts(d, T.tokens(F.col("text"), "[a-z0-9]+", distinct=False))
    r = K.bm25(count(docs), count(query)).collect()
    assert len(r) == 1 and r[0].score == pytest.approx(0.930399, abs=1e-6)


def test_graph_and_topics(spark):
    e = spark.createDataFrame([("p", "t1"), ("p", "t2"), ("p", "t3"), ("p", "a1"), ("r", "t1"), ("r", "pub"), ("pub", "t2"), ("pub", "v")], "src string, dst string")
    r = K.overlap_score(spark.createDataFrame([("p", "r")], "paper_id string, reviewer_id string"), e).first()
    assert (r.direct, r.bridge, round(r.score, 4), r.confidence) == (1, 1, 0.3375, 0.25)
    assert one(spark, K.path_confidence(F.lit(3))) == pytest.approx(0.277259, abs=1e-6)
    a = spark.createDataFrame([(1, "a"), (1, "b")], "id int, topic string")
    b = spark.createDataFrame([(1, "b"), (1, "c")], "id int, topic string")
    w = {r.topic: r.w for r in K.topic_weights(a, b).collect()}
    assert w == pytest.approx({"a": 0.3125, "b": 0.5, "c": 0.1875})


def test_authority_fixture(spark):
    people = spark.createDataFrame([("A", 9.0, 383.0), ("B", 6.0, 200.0), ("C", 2.0, 50.0)], "reviewer_id string, h double, citations double")
    r = {x.reviewer_id: x for x in R.authority(people).collect()}
    assert [round(r[k].authority, 6) for k in "ABC"] == [0.8, 0.603804, 0.0] and [r[k].role for k in "ABC"] == ["expert", "moderate", "fresher"]


def test_conflicts(spark):
    score, flag = R.coi_status(F.lit(None).cast("double"), F.lit(False), F.lit(True))
    assert one(spark, score) == 0.75 and one(spark, flag)
    assert one(spark, R.blend_coi(F.lit(True), F.lit(0.95), F.lit(0.0))) == 1.0


def test_texts(spark):
    assert one(spark, T.term_list(T.words_array(["a", "b", "c"]))) == "a, b, and c"
    assert one(spark, T.normal_word(F.lit("Studies"))) == "study" and one(spark, T.normal_word(F.lit("parsed"))) == "pars"
    assert one(spark, T.clean(F.lit("Naïve, co-op 12!"), True)) == "naïve co op"
    assert one(spark, T.simple_keyphrases(F.lit("graph query plan"), 3)) == ["graph query plan", "graph query", "query plan"]
    assert one(spark, T.split_list(F.lit("A, b;a\nc"), 5)) == ["a", "b", "c"]
    assert one(spark, T.ordered_distinct(T.words_array(["X", "x", "y"]))) == ["X", "y"]


def test_greedy_equals_a_fold(spark):
    rows = [(p, r, 1.0 / (1 + (p * 7 + r * 5) % 11)) for p in range(30) for r in range(12)]
    caps = {r: r % 3 + 4 for r in range(12)}
    got = R.greedy_assignment(spark.createDataFrame(rows, "paper_id long, reviewer_id long, score double"), spark.createDataFrame(list(caps.items()), "reviewer_id long, capacity long")).collect()
    use, want = dict.fromkeys(caps, 0), []
    for p in range(30):
        best = sorted((-s * (1 - use[r] / caps[r]), r) for q, r, s in rows if q == p and use[r] < caps[r])[:3]
        for slot, (_, r) in enumerate(best, 1):
            use[r] += 1
            want.append((p, slot, r))
    assert sorted((x.paper_id, x.slot, x.reviewer_id) for x in got) == sorted(want)


def test_auction_respects_capacity(spark):
    rows = [(p, r, 1.0 / (1 + (p * 7 + r * 5) % 11)) for p in range(10) for r in range(12)]
    caps = spark.createDataFrame([(r, 3) for r in range(12)], "reviewer_id long, capacity long")
    got = R.auction(spark.createDataFrame(rows, "paper_id long, reviewer_id long, score double"), caps).toPandas()
    assert got.groupby("reviewer_id").size().max() <= 3 and (got.groupby("paper_id").size() == 3).all() and not got.duplicated(["paper_id", "reviewer_id"]).any()


def test_sources(spark, tmp_path):
    (tmp_path / "ground_truth.json").write_text('[{"paper_id": "p", "assigned_reviewers": ["a", "b"]}, {"paper_id": "q", "assigned_reviewers": []}]')
    c = X.catalog(spark, str(tmp_path))
    assert X.truth(c["ground_truth"]).count() == 2 and X.truth(c["ground_truth"], True).count() == 3 and c["coi"].count() == 0
    raw = spark.createDataFrame([("p", [("a", 0.5), ("b", 0.2)])], "paper_id string, ranked array<struct<reviewer_id:string,score:double>>")
    assert [(r.reviewer_id, r.rank) for r in X.rankings(raw, "m").collect()] == [("a", 1), ("b", 2)]
    rows = spark.range(5)
    assert X.signature(rows) == X.signature(rows.orderBy(F.desc("id"))) != X.signature(spark.range(6))
    assert X.markdown(rows.limit(1)).startswith("| id |")
    cache = spark.createDataFrame([("a", 1)], "key string, v int")
    assert X.extend_cache(cache, spark.createDataFrame([("a",), ("b",)], "key string"), lambda d: d.withColumn("v", F.lit(2))).count() == 2


def test_live_workload_stream(spark, tmp_path):
    for i, part in enumerate([[(1, 10, 1), (1, 11, 1), (2, 10, 1)], [(1, 12, 2)]]):
        spark.createDataFrame(part, "paper_id long, reviewer_id long, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("paper_id long, reviewer_id long, ts long").parquet(str(tmp_path / "in"))
        workload.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.reviewer_id: r.load for r in workload.counts(workload.read(spark, str(tmp_path / "out"))).collect()}
    assert got == {10: 1, 12: 1}


def test_bridges_and_paths_by_hand(spark):
    """Two topics of the paper are known through one publication: two bridges, two paths of three steps."""
    e = spark.createDataFrame([("p", "t1"), ("p", "t2"), ("r", "pub"), ("pub", "t1"), ("pub", "t2"), ("p", "q"), ("r", "q")], "src string, dst string")
    pairs = spark.createDataFrame([("p", "r"), ("t1", "t2"), ("p", "lost")], "paper_id string, reviewer_id string")
    r = {(x.paper_id, x.reviewer_id): x for x in K.overlap_score(pairs, e).collect()}
    assert (r["p", "r"].direct, r["p", "r"].bridge) == (1, 2) and round(r["p", "r"].score, 6) == round(1.7 / 3, 6)
    n = {(x.paper_id, x.reviewer_id): x.paths for x in K.path_counts(pairs, e).collect()}
    # the shared neighbour counts twice, as one and as a path; t1 and t2 share p and pub
    assert n == {("p", "r"): 4, ("t1", "t2"): 4, ("p", "lost"): 0}


def test_utilisation_bands(spark):
    loads = [0, 39, 40, 70, 71, 90, 91, 99, 100, 120]
    got = spark.createDataFrame([(x,) for x in loads], "load int").select(E.utilisation_label(F.col("load"), F.lit(100)).alias("x")).collect()
    assert [r.x for r in got] == ["Unused", "Low", "Moderate", "Moderate", "High", "High", "Near Capacity", "Near Capacity", "At Capacity", "At Capacity"]


def test_a_known_flag_is_kept(spark):
    score, flag = R.coi_status(F.lit(0.2), F.lit(False), F.lit(False), flagged=F.lit(True))
    assert one(spark, score) == 0.75 and one(spark, flag)


def test_full_ranking_by_hand(spark):
    rows = [("p", "a", 0.9, 0.2, 1.0, 0.5, 0.4, "expert", 9, False, 0, 6), ("p", "b", 0.5, 1.0, 1.0, 0.0, 0.1, "fresher", 1, False, 6, 6), ("p", "c", 0.7, 0.9, 0.5, 1.0, 0.2, "moderate", 5, True, 0, 6), ("p", "d", 0.7, 0.9, 0.5, 1.0, 0.2, "moderate", 5, False, 3, 6)]
    frame = spark.createDataFrame(rows, "paper_id string, reviewer_id string, similarity double, kg double, kg_confidence double, profile double, authority double, role string, h int, flagged boolean, load int, capacity int")
    got = {r.reviewer_id: r for r in G.rank_reviewers(frame, G.Ranking(weights={"similarity": 0.5, "authority": 0.2, "kg": 0.2, "profile": 0.1})).collect()}
    # a: .5 + .08 + .04 + .05, and .05 for an expert; d: .25 + .04 + .2 * min(.9, .75) * .5 + .1, half of it free
    assert got["a"].score == pytest.approx(0.72, abs=1e-6) and got["d"].score == pytest.approx(0.465 / 2, abs=1e-6)
    assert got["b"].score is None and got["c"].score is None and [got[k].rank for k in "adbc"] == [1, 2, 3, 4]
    assert "conflict of interest" in got["c"].reasons and got["a"].reasons == []
    plain = {r.reviewer_id: r.score for r in G.rank_reviewers(frame.drop("load", "capacity"), G.Ranking(mode="semantic")).collect()}
    assert plain["b"] == pytest.approx(0.0, abs=1e-6) and plain["d"] == pytest.approx(0.5, abs=1e-6)
