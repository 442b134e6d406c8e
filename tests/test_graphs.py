"""Walks, exact cosine pairs, the candidate graph, the cascade, ranks and nested histories on small cases."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest

from panelspark.operators import cascade as C
from panelspark.operators import graphs as G
from panelspark.operators import ranks
from panelspark.sources import history as H


def test_walks_follow_edges_by_weight(spark):
    links = [("hub", f"n{i}", 1.0 + (i == 0) * 29) for i in range(30)] + [("n1", "n2", 2.0)]
    edges = spark.createDataFrame(links, "src string, dst string, weight double")
    walks = G.random_walks(edges, 200, 3).collect()
    at = {(r.start, r.walk, r.step): r.node for r in walks}
    assert len(at) == 31 * 200 * 4
    near = {frozenset(x[:2]) for x in links}
    assert all(frozenset((at[s, w, k - 1], n)) in near for (s, w, k), n in at.items() if k)
    first = Counter(n for (s, _, k), n in at.items() if s == "hub" and k == 1)
    assert 0.4 < first["n0"] / 200 < 0.6  # 30 of 59
    again = G.random_walks(edges, 200, 3).where("start = 'n1'").collect()
    assert all(at[r.start, r.walk, r.step] == r.node for r in again)


def test_a_hubs_edges_have_two_rows_each_at_most_on_average(spark):
    edges = spark.createDataFrame([("hub", f"n{i}", 1.0 / (1 + i % 7)) for i in range(300)], "src string, dst string, weight double")
    assert G.step_table(edges).where("node = 'hub'").count() <= 2 * 300 + 2


def test_walk_features_are_unit_vectors_of_visited_nodes(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    got = G.walk_features(G.random_walks(edges, 20, 4)).collect()
    norm = Counter()
    for r in got:
        norm[r.id] += r.w**2
    assert all(abs(v - 1) < 1e-9 for v in norm.values())
    assert not [r for r in got if {r.id, r.term} & {"a", "b", "c"} and {r.id, r.term} & {"x", "y"}]


def test_cosine_pairs_equal_all_pairs_and_template_words_are_not_joined(spark):
    rng = random.Random(2)
    vectors = {}
    for i in range(120):
        w = {f"frame{k}": 1.0 for k in range(4)} | {f"own{rng.randrange(400)}": 1.0 + rng.random() for _ in range(6)}
        vectors[i] = dict(vectors[i - 1], **{f"own{i}": 0.3}) if i % 5 == 4 else w
    unit = {i: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for i, v in vectors.items()}
    rows = spark.createDataFrame([(i, t, x) for i, v in unit.items() for t, x in v.items()], "id long, term string, w double")
    want = {(a, b) for a in unit for b in unit if a < b and sum(x * unit[b].get(t, 0) for t, x in unit[a].items()) >= 0.8}
    assert want and {(r.a, r.b) for r in G.cosine_pairs(rows).collect()} == want
    plan = G.cosine_pairs(rows)
    assert plan.count() < 60  # the frame is common to all 7140 pairs


def test_candidate_graph_gates_topics_and_names_edges_by_the_last_relation(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = {
        "candidates": frame([(1, 7), (1, 8), (2, 7)], "paper_id long, reviewer_id long"),
        "papers": frame([(1, "Graphs"), (1, "far away"), (2, "no vector")], "paper_id long, topic string"),
        "reviewers": frame([(7, "Graphs"), (7, "far away"), (8, "parsed")], "reviewer_id long, topic string"),
        "works": frame([(8, "parsed")], "reviewer_id long, topic string"),
        "venues": frame([(7, "A&B")], "reviewer_id long, venue string"),
        "publications": frame([(7, "first", "V"), (8, "second", None)], "reviewer_id long, pub string, venue string"),
        "publication_topics": frame([("first", "graphs")], "pub string, topic string"),
        "vectors": frame([("p_1", [1.0, 0.0]), ("r_7", [1.0, 0.0]), ("t_graphs", [0.9, 0.1]), ("t_far_away", [0.0, 1.0]), ("pub_first", [1.0, 0.1])], "node string, v array<double>"),
        "similar": frame([("first", "second", 0.9)], "a string, b string, weight double"),
    }
    got = {(r.paper_id, r.src, r.dst, r.type) for r in G.candidate_graph(**args).collect()}
    seven = {("r_7", "t_graphs", "has_topic"), ("r_7", "v_ab", "publishes_in"), ("r_7", "pub_first", "authored"), ("pub_first", "v_v", "published_in"), ("pub_first", "t_graphs", "has_topic")}
    eight = {("r_8", "t_pars", "works_on"), ("r_8", "pub_second", "authored")}
    one = {("p_1", "t_graphs", "has_topic"), ("p_1", "pub_first", "similar_paper"), ("pub_first", "pub_second", "similar_paper")}
    assert got == {(1, *x) for x in seven | eight | one} | {(2, *x) for x in seven | {("p_2", "t_no_vector", "has_topic")}}


def test_the_cascade_takes_each_branch(spark):
    values = {1: [(0.2, 0, 9, 9), (0.6, 0, 9, 9)], 2: [(0, 0.3, 9, 9), (0, 0.3, 9, 9)], 3: [(0, 0, 0.1, 0.9), (0, 0, 0.5, 0)], 4: [(0, 0, 0, 0.9), (0, 0, 0, 0.9)], 5: [(0, 0, 0, 0), (0, 0, 0, 0)]}
    rows = [(p, i, i + 1, float(s), 0.1, float(w), 0.2, float(c), float(t)) for p, xs in values.items() for i, (s, w, c, t) in enumerate(xs)]
    df = spark.createDataFrame(rows, "paper_id int, reviewer_id int, place int, stored double, stored_confidence double, walked double, walked_confidence double, citation double, sparse double")
    got = {(r.paper_id, r.reviewer_id): (r.source, r.kind, round(r.kg, 6), round(r.confidence, 6)) for r in C.normalised(C.graph_scores(df)).collect()}
    assert [got[1, 0], got[1, 1]] == [("stored", "graph", 0.0, 0.1), ("stored", "graph", 1.0, 0.1)]
    assert got[2, 0] == ("walked", "graph", 0.5, 0.2)
    assert [got[3, 0], got[3, 1]] == [("walked", "citation", 0.0, 0.2), ("walked", "citation", 0.5, 0.3)]
    assert got[4, 1] == ("walked", "sparse", 0.425, 0.285) and got[5, 0] == ("walked", "none", 0.0, 0.2)
    assert C.graph_scores(df, top=1).count() == 5
    assert {r.raw for r in C.graph_scores(df, walks=False).where("paper_id = 2").collect()} == {0.0}


def plain_ranks(values):
    order = sorted(values)
    return {v: order.index(v) + (order.count(v) + 1) / 2 for v in values}


def test_ranks_and_the_signed_rank_test_equal_plain_ones(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(12) / 4, rng.randrange(9) / 4) for _ in range(200)] + [(None, 1.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    d = [round(a - b, 9) for a, b in pairs if a is not None]
    mid = plain_ranks([abs(x) for x in d])
    got = ranks.below(df, "a", 5).collect()
    want = Counter(a for a, _ in pairs if a is not None)
    assert {r.value: (r.n, r.below) for r in got} == {v: (n, sum(m for u, m in want.items() if u < v)) for v, n in want.items()}
    r = ranks.signed_rank(df, "a", "b").first()
    half = sum(mid[0.0] for x in d if x == 0) / 2
    plus, minus = sum(mid[x] for x in d if x > 0) + half, sum(mid[-x] for x in d if x < 0) + half
    n = len(d)
    var = (n * (n + 1) * (2 * n + 1) - sum(c**3 - c for c in Counter(map(abs, d)).values()) / 2) / 24
    assert (r.n, r.zeros, r.w_plus, r.w_minus) == (n, d.count(0.0), plus, minus)
    assert abs(r.z - (min(plus, minus) - n * (n + 1) / 4) / math.sqrt(var)) < 1e-9 and abs(r.p_value - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-12
    assert ranks.signed_rank(df, "a", "b", split_zeros=False).first().n == n - d.count(0.0)
    assert ranks.signed_rank(df.limit(0), "a", "b").first().p_value is None


def test_auc_by_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(30) / 10) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, s double")
    assert abs(ranks.ranged_auc(df, "y", "s").first().auc - want) < 1e-9
    assert ranks.ranged_auc(df.where("y = 1"), "y", "s").first().auc is None


PAYLOADS = {
    "full": ({"full": [{"reviewer_id": 3}, {"reviewer_id": "a"}, 4, "", None, {"name": "x"}], "other": [9]}, ["3", "a", "4"]),
    "one": ({"reviewer_id": "b", "other": [9]}, ["b"]),
    "nested": ({"lead": {"reviewer_id": 5}, "rest": {"x": {"y": [6, {"reviewer_id": 0}, 0, False]}}, "name": "c", "zero": 0, "text zero": "0"}, ["5", "6", "c", "0"]),
    "list": ([7, {"reviewer_id": 8}, [9], {"full": [1]}], ["7", "8"]),
    "full text": ({"full": "no list", "reviewer_id": None}, ["no list"]),
    "scalar": (12, []),
}


def test_histories_of_any_nesting(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in PAYLOADS.items()] + [("broken", "{"), ("null", None)]
    got = {}
    for r in H.reviewer_ids(spark.createDataFrame(rows, "paper_id string, payload string")).collect():
        got.setdefault(r.paper_id, []).append(r.reviewer_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(ids) for k, (_, ids) in PAYLOADS.items() if ids}


def test_payloads_nested_too_deeply_are_an_error(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":1}}}}')], "paper_id long, payload string")
    with pytest.raises(ValueError):
        H.reviewer_ids(rows, depth=2)


def test_workload_by_precedence(spark):
    ids = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "paper_id string, reviewer_id string")
    saved = spark.createDataFrame([("a", 50), ("z", 9)], "reviewer_id string, load int")
    live = spark.createDataFrame([("2", "c"), ("3", "a"), ("3", None)], "paper_id string, reviewer_id string")
    load = lambda rows: {r.reviewer_id: r.load for r in rows.collect()}
    assert load(H.merged_workload(ids, saved, live)) == {"a": 3, "b": 1}
    assert load(H.merged_workload(ids.limit(0), saved, live)) == {"a": 51, "z": 9, "c": 1}


def test_a_class_of_publications_is_paired_within_papers_only(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    none = frame([], "reviewer_id long, topic string")
    args = {
        "candidates": frame([(1, 7), (1, 8), (2, 8), (3, 9)], "paper_id long, reviewer_id long"), "papers": frame([], "paper_id long, topic string"), "reviewers": none, "works": none,
        "venues": frame([], "reviewer_id long, venue string"), "publications": frame([(7, 2, None), (7, 10, None), (8, 10, None), (8, 5, None), (9, 4, None)], "reviewer_id long, pub long, venue string"),
        "publication_topics": frame([], "pub long, topic string"), "vectors": frame([("p_3", [1.0, 0.0]), ("pub_4", [1.0, 0.1])], "node string, v array<double>"),
    }
    classes = frame([(2, "x"), (10, "x"), (4, "x"), (5, "y")], "pub long, class string")
    pairs = frame([(2, 10, 1.0), (2, 4, 1.0), (4, 10, 1.0)], "a long, b long, weight double")
    got = [sorted(map(tuple, G.candidate_graph(**args, **how).where("type = 'similar_paper'").collect())) for how in ({"classes": classes}, {"similar": pairs})]
    assert got[0] == got[1] and [r[:3] for r in got[0]] == [(1, "pub_2", "pub_10"), (3, "p_3", "pub_4")]


def test_walks_take_each_step_once_and_find_the_way_of_the_step_table(spark, monkeypatch):
    for name, size in (("RUN", 4), ("HUB", 20)):
        monkeypatch.setattr(G, name, size)
    edges = spark.createDataFrame([("hub", f"n{i}", 1.0 + i % 3) for i in range(60)] + [(f"n{i}", f"n{i + 1}", 0.5) for i in range(50)], "src string, dst string, weight double")
    walks = G.random_walks(edges, 3, 4)
    assert walks._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4  # one a step, whatever is read of it
    at = {(r.start, r.walk, r.step): r.node for r in walks.collect()}
    assert len(at) == 61 * 3 * 5
    ways = {}
    for r in G.step_table(edges).collect():
        ways.setdefault(r.node, {})[r.dst] = (r.lo, r.hi, r.total)
    assert all(max(hi for _, hi, _ in w.values()) == pytest.approx(next(iter(w.values()))[2]) for w in ways.values())
    for (start, walk, step), node in at.items():
        if step:
            lo, hi, total = ways[at[start, walk, step - 1]][node]
            x = int(hashlib.md5(f"{start}:{walk}:{step}".encode()).hexdigest()[:12], 16) / (1 << 48) * total
            assert lo <= x < hi


def test_candidate_graph_equals_sql_where_embeddings_are_near_copies_or_missing(spark, sf_dir, tmp_path):
    import duckdb
    import numpy as np
    from panelspark.plans.catalog import QUERIES, SQL

    rows = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rnd = np.random.default_rng(1)
    near = {i: rows[i - i % 8] if i % 8 == 0 else [float(x) for x in np.array(rows[i - i % 8]) + rnd.normal(0, 0.01, 64)] for i in rows}
    near = [(i + (i % 11 == 5) * 10_000, v) for i, v in near.items()]
    spark.createDataFrame(near, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["candidate_graph"](spark, str(tmp_path)).collect()))
    assert got == sorted(duck.execute(SQL["candidate_graph"]).fetchall()) and any(r[1] == "similar_paper" for r in got)
