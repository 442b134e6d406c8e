"""Rescoring modes, baselines, pair texts, the verdict and the learned ranker's features on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import comparison as C
from panelspark.operators import learned as L
from panelspark.operators import textoverlap as O

SIGNALS = "paper_id long, reviewer_id long, semantic double, authority double, kg double, llm double, final double, cross double"
COI = "paper_id long, reviewer_id long, coi_score double, flagged boolean"


def _modes(spark, rows, coi=()):
    out = C.ablations(spark.createDataFrame(list(rows), SIGNALS), spark.createDataFrame(list(coi), COI)).collect()
    return {(r.mode, r.paper_id, r.reviewer_id): (round(r.score, 9), r["rank"]) for r in out}


def test_modes_by_hand(spark):
    rows = [(1, 1, 0.9, 0.1, 0.2, 0.5, 0.7, 0.0), (1, 2, 0.5, 1.0, 0.6, None, 0.2, 0.8), (1, 3, 0.5, 0.0, 0.0, 0.0, 0.2, None)]
    got = _modes(spark, rows, [(1, 1, 0.5, False), (1, 1, None, True), (1, 2, 0.49, None), (2, 3, 1.0, True)])
    assert got["semantic_authority", 1, 2] == (round(0.7 * 0.5 + 0.3, 9), 2)
    assert got["semantic_kg_llm", 1, 2] == (round(0.34 * 0.5 + 0.33 * 0.6, 9), 2)
    assert got["full", 1, 2] == (round(0.3 * (0.34 * 0.5 + 0.33 * 0.6) + 0.7 * 0.8, 9), 1)
    assert got["full", 1, 1][0] == got["semantic_kg_llm", 1, 1][0] and got["full", 1, 3][0] == round(0.34 * 0.5, 9)
    assert ("coi_filtering", 1, 1) not in got and got["coi_filtering", 1, 2] == (0.5, 1) and got["coi_filtering", 1, 3] == (0.5, 2)
    # the ranks of reviewer 2: semantic 2 (tie by id), authority 1, graph 1, final 2 (tie by id)
    assert got["rrf_fusion", 1, 2][0] == pytest.approx((2 / 62 + 2 / 61) / (4 / 61), abs=1e-9)
    assert len({m for m, _, _ in got}) == 9 and len(got) == 26


def test_modes_of_no_rows(spark):
    assert _modes(spark, []) == {}


def test_listwise_bm25_equals_a_plain_version(spark):
    draw = random.Random(3)
    docs = {i: [draw.choice("abcdefgh") for _ in range(draw.randrange(0, 30))] for i in range(12)}
    counts = [(i, t, w.count(t)) for i, w in docs.items() for t in sorted(set(w))]
    pairs = [(p, r) for p in (0, 1, 2) for r in range(12) if r != p and (r + p) % 4] + [(0, 99), (0, 3)]
    table = spark.createDataFrame(counts, "id long, term string, tf long")
    got = C.listwise_bm25(spark.createDataFrame(pairs, "paper_id long, reviewer_id long"), table, table)
    got = {(r.paper_id, r.reviewer_id): r.score for r in got.collect()}
    assert set(got) == set(pairs)
    for p in (0, 1, 2):
        mine = sorted({r for q, r in pairs if q == p})
        mean = sum(len(docs.get(r, [])) for r in mine) / len(mine)
        for r in mine:
            want = 0.0
            for t in set(docs[p]):
                tf, df = docs.get(r, []).count(t), sum(t in docs.get(x, []) for x in mine)
                length = 0.25 + 0.75 * len(docs.get(r, [])) / mean
                want += math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * length) * docs[p].count(t)
            assert got[p, r] == pytest.approx(want, abs=1e-9)


def test_baselines_ties_nulls_and_chance(spark):
    rows = spark.createDataFrame([(1, r, None if r == 4 else 0.5, 3.0 if r in (2, 5) else None, float(r)) for r in range(1, 7)], "paper_id long, reviewer_id long, semantic double, h double, citations double")
    lexical = spark.createDataFrame([(1, 6, 2.0), (1, 5, 1.0)], "paper_id long, reviewer_id long, score double")
    run = lambda seed: [(r.mode, r.reviewer_id) for r in C.baselines(rows, lexical, seed).orderBy("mode", "rank").collect()]
    got = {m: [r for n, r in run(42) if n == m] for m in ("semantic", "bm25", "random", "authority")}
    assert got["semantic"] == [1, 2, 3] and got["bm25"] == [6, 5, 1] and got["authority"] == [5, 2, 6]
    assert run(42) == run(42) and any(run(42) != run(s) for s in range(5)) and len(got["random"]) == 3


def test_list_quality_without_truth_is_null(spark):
    lists = spark.createDataFrame([("m", 1, 7, 1), ("m", 1, 8, 2), ("m", 2, 7, 1), ("m", 3, 9, 1)], "mode string, paper_id long, reviewer_id long, rank int")
    truth = spark.createDataFrame([(1, 8), (1, 8), (1, 5), (3, 1)], "paper_id long, reviewer_id long")
    got = {r.paper_id: r for r in C.list_quality(lists, truth).collect()}
    assert (got[1].precision, got[1].recall, got[1].mrr) == (0.5, 0.5, 0.5)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert not got[2].has_truth and got[2].precision is None and got[2].ndcg is None and got[3].mrr == 0.0


def test_cut_metrics_and_gate(spark):
    rows = [("m", 1, 1, 0.9, 1, 0), ("m", 1, 2, 0.8, 6, 1), ("m", 2, 1, 0.9, 2, 1), ("m", 3, 1, 0.5, 1, 0)]
    marked = spark.createDataFrame(rows, "mode string, paper_id long, reviewer_id long, score double, rank int, hit int")
    got = C.cut_metrics(marked).first()
    assert (got.n_papers, got.mrr_5, got.mrr_10, got.recall_100) == (3, round(0.5 / 3, 6), round((0.5 + 1 / 6) / 3, 6), round(2 / 3, 6))
    long = spark.createDataFrame([("m", p, i, 0.9 - i * step, i) for p, step in ((1, 0.01), (2, 0.001)) for i in range(1, 6)] + [("m", 3, 1, 0.9, 1)], "mode string, paper_id long, reviewer_id long, score double, rank int")
    assert {r.paper_id: r.open for r in C.rerank_gate(long).collect()} == {1: False, 2: True, 3: True}


@pytest.mark.parametrize(("own", "emb", "p", "says"), [(0.5, 0.4, 0.2, "competitive"), (0.5, 0.4, 0.01, "improved"), (0.3, 0.4, 0.01, "does_not"), (0.5, 0.4, None, "improved")])
def test_verdict_branches(spark, own, emb, p, says):
    means = spark.createDataFrame([("full", own, 0.1, 0.2), ("e", emb, 0.1, 0.1)], "mode string, ndcg double, mrr double, map double")
    tests = spark.createDataFrame([("e", p)], "mode string, p_value double")
    got = C.verdict(means, tests, "full", "e", "absent").first()
    assert got.ranking_status.startswith(says) and got.tfidf_status == "better_than_tfidf_but_not_statistically_confirmed" and got.ndcg_delta == pytest.approx(own - emb)


def test_significance_of_equal_and_single_papers(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.7), ("b", 1, 0.5), ("b", 2, 0.7), ("c", 2, 0.1), ("c", 9, 0.3), ("d", 1, None)]
    got = {r.mode: r for r in C.significance(spark.createDataFrame(rows, "mode string, paper_id long, ndcg double"), "a").collect()}
    assert (got["b"].n, got["b"].t, got["b"].p_value) == (2, 0.0, 1.0) and (got["c"].n, got["c"].p_value) == (1, 1.0) and "d" not in got


def test_hard_cases(spark):
    rows = spark.createDataFrame([(1, 1, None, 1), (1, 2, 0.9, None), (1, 3, 0.7, 0), (1, 4, 0.1, 1), (1, 5, 0.9, 1)], "paper_id long, reviewer_id long, s double, label int")
    assert {(r.reviewer_id, r.kind) for r in C.hard_cases(rows, "s", "label").collect()} == {(1, "false_negative"), (2, "high_false_positive")}


def test_pair_tfidf_equals_a_fit_on_two_texts(spark):
    draw = random.Random(5)
    texts = {i: " ".join(draw.choice(["aa", "bb", "the", "cc", "dd", "Ee", "x"]) for _ in range(draw.randrange(0, 14))) for i in range(8)}
    texts[7] = None
    grams = O.gram_counts(spark.createDataFrame(list(texts.items()), "id long, text string"), ["the"])
    pairs = [(p, r) for p in range(8) for r in range(8) if p != r] + [(0, 1)]
    cosine, best = O.pair_tfidf(spark.createDataFrame(pairs, "paper_id long, reviewer_id long"), grams, grams)
    got = {(r.paper_id, r.reviewer_id): r.cosine for r in cosine.collect()}
    terms = {}
    for r in best.orderBy("place").collect():
        terms.setdefault((r.paper_id, r.reviewer_id), []).append(r.term)

    def counts(text):
        words = [w for w in (text or "").lower().split() if len(w) > 1 and w != "the"]
        all_ = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return {t: all_.count(t) for t in set(all_)}

    assert set(got) == set(pairs)
    for p, r in set(pairs):
        a, b = counts(texts[p]), counts(texts[r])
        idf = lambda t: math.log(3 / (1 + (t in a) + (t in b))) + 1
        wa, wb = ({t: n * idf(t) for t, n in x.items()} for x in (a, b))
        norm = math.sqrt(sum(v * v for v in wa.values()) * sum(v * v for v in wb.values()))
        assert got[p, r] == pytest.approx(sum(wa[t] * wb.get(t, 0) for t in wa) / norm if norm else 0, abs=1e-9)
        assert terms.get((p, r), []) == sorted(wa, key=lambda t: (-round(wa[t], 9), t))[:5]


def test_terms_share_no_word(spark):
    rows = [(1, 1, t, 1.0, i) for i, t in enumerate(["graph", "neural graph", "parsing", "text", "deep text"], 1)]
    got = O.distinct_terms(spark.createDataFrame(rows, "paper_id long, reviewer_id long, term string, weight double, place int")).first()
    assert got.terms == ["neural graph", "deep text", "parsing"]


def test_topic_chain_branches(spark):
    rows = [(1, 0, 5, 0.9, None, None), (2, 4, 1, 0.9, None, None), (3, 4, 0, 0.6, None, None), (4, 4, None, None, 0.1, 0.9), (5, 4, 0, None, None, 0.4), (6, None, None, None, None, None)]
    table = spark.createDataFrame([(1, *r) for r in rows], "paper_id long, reviewer_id long, n_terms int, hits int, prefetched double, cosine double, tfidf double")
    got = {r.reviewer_id: (r.score, r.semantic, r.source) for r in O.topic_chain(table).collect()}
    assert got == {1: (0.0, 0.0, "none"), 2: (0.25, 0.0, "terms"), 3: (0.3, 0.6, "prefetched"), 4: (0.0, 0.1, "semantic"), 5: (0.2, 0.4, "semantic"), 6: (0.0, 0.0, "none")}


def test_matched_terms(spark):
    p, r = ["graph", "gra", "neural nets", "deep text", "art"], ["my graph theory", "neural methods", "gra", "deeper text", "party"]
    got = spark.createDataFrame([(p, r)], "p array<string>, r array<string>").select(O.matched_terms(F.col("p"), F.col("r")).alias("x")).first().x
    assert got == ["graph", "neural nets"]


def test_weights_features_and_groups(spark):
    schema = "paper_id long, reviewer_id long, semantic double, kg_effective double, kg double, kg_confidence double, keyword double, authority double, hybrid double, label int"
    rows = [(p, r, r / 10, None if r == 1 else 0.1 * r, 0.1, 0.2, 0.3, 0.1, 0.2, int(r == 3)) for p in (1, 2) for r in range(1, 7)]
    made = L.features(spark.createDataFrame(rows, schema))
    got = {(r.paper_id, r.reviewer_id): r for r in L.weighted(made, hard=2).collect()}
    assert got[1, 6].rr_semantic == 1.0 and got[1, 3].rr_semantic == 0.25 and got[1, 1].kg_effective == 0.0 and got[1, 1].rr_kg == pytest.approx(1 / 6)
    assert got[1, 3].weight == 5.0 and got[1, 6].weight == got[2, 5].weight == 2.0 and got[1, 4].weight == got[1, 1].weight == 1.0
    assert {(r.paper_id, r.n, r.n_relevant) for r in L.group_sizes(made).collect()} == {(1, 6, 1), (2, 6, 1)}


def test_importance_names_the_telling_feature(spark):
    draw = random.Random(9)
    rows = [(i, draw.random(), draw.random()) for i in range(200)]
    table = spark.createDataFrame([(i, a, b, int(a > 0.7)) for i, a, b in rows], "paper_id long, semantic double, keyword double, label int")
    got = {(r.kind, r.name): r for r in L.importance(table, ["semantic", "keyword"], L.GROUPS).collect()}
    assert got["feature", "semantic"].share > 0.9 and got["feature", "semantic"].direction == "positive"
    assert sum(r.share for (k, _), r in got.items() if k == "group") == pytest.approx(1.0)
    flat = L.importance(table.withColumn("label", F.lit(0)), ["semantic", "keyword"], L.GROUPS).collect()
    assert all(r.share == 0.0 for r in flat)


def test_penalised_assignment_equals_a_plain_fold(spark):
    from panelspark.operators import ranking as R

    draw = random.Random(11)
    terms = {r: draw.sample("abcdef", draw.randrange(0, 5)) for r in range(14)}
    capacity = {r: draw.randrange(0, 5) for r in range(14)}
    rows = [(p, r, round(draw.random(), 2) if draw.random() > 0.05 else None) for p in range(40) for r in draw.sample(range(14), draw.randrange(1, 9))]
    table = spark.createDataFrame([(p, r, s, terms[r] or None) for p, r, s in rows], "paper_id long, reviewer_id long, score double, terms array<string>")
    caps = spark.createDataFrame(list(capacity.items()), "reviewer_id long, capacity long")
    got = {}
    for x in R.penalised_assignment(table.repartition(5), caps, redundancy=0.6).orderBy("paper_id", "slot").collect():
        got.setdefault(x.paper_id, []).append((x.reviewer_id, round(x.value, 9), x.load))

    load, want, passed, full = dict.fromkeys(range(14), 0), {}, 0, 0
    for p in range(40):
        mine = sorted([(-s, r) for q, r, s in rows if q == p and s is not None and capacity[r] > 0])
        if not mine:
            continue
        free = [(-s - 0.02 * load[r] * (1 + load[r] / capacity[r]), r) for s, r in mine if load[r] < capacity[r]]
        full += not free
        order = sorted(free or [(-s, r) for s, r in mine[:3]], key=lambda x: (-round(x[0], 9), x[1]))
        kept = []
        for s, r in order:
            like = [len(set(terms[r]) & set(terms[k])) / max(1, min(len(terms[r]), len(terms[k]))) for _, k in kept]
            if max(like, default=0) < 0.6 and len(kept) < 3:
                kept.append((s, r))
        passed += len(kept) == 3 and kept != order[:3]
        panel = kept if len(kept) == 3 else order[:3]
        for _, r in panel:
            load[r] += 1
        want[p] = [(r, round(s, 9), load[r]) for s, r in panel]
    assert got == want and passed and full
