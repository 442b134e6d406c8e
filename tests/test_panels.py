"""Panels whose pools are empty in turn, scores that fall, and peers."""

from panelspark.operators import panels as P

SCHEMA = "paper_id long, reviewer_id long, sim double, authority double, score double, role string, failed boolean, terms array<string>, covers array<string>, kg double, citations long"


def rows(spark, *values):
    return spark.createDataFrame([(p, r, s, a, f, role, False, t, t, 0.1, 5) for p, r, s, a, f, role, t in values], SCHEMA)


def panel(spark, *values):
    return {r.slot: r for r in P.select_panels(rows(spark, *values)).collect()}


def test_a_paper_without_an_eligible_candidate_has_no_panel(spark):
    got = P.select_panels(rows(spark, (1, 1, 0.49, 0.9, 0.9, "expert", ["a"]), (1, 2, 0.9, 0.9, 0.24, "expert", ["a"]), (1, 3, 0.9, 0.9, None, "expert", ["a"]), (2, 4, 0.9, 0.5, 0.9, "expert", ["a"]))).collect()
    assert [(r.paper_id, r.reviewer_id) for r in got] == [(2, 4)]


def test_without_an_expert_the_most_authoritative_of_the_similar_leads(spark):
    got = panel(spark, (1, 1, 0.9, 0.4, 0.8, "moderate", ["a"]), (1, 2, 0.8, 0.6, 0.7, "moderate", ["b"]), (1, 3, 0.6, 0.9, 0.6, "moderate", ["c"]))
    # the median similarity is 0.8: the third is no anchor, whatever its authority
    assert (got[1].reviewer_id, got[1].role, got[1].satisfied, got[1].label) == (2, "expert", False, P.BEST["expert"])
    assert {got[2].reviewer_id, got[3].reviewer_id} == {1, 3}


def test_an_expert_below_the_median_is_no_anchor(spark):
    got = panel(spark, (1, 1, 0.95, 0.5, 0.9, "moderate", ["a"]), (1, 2, 0.9, 0.3, 0.9, "fresher", ["b"]), (1, 3, 0.52, 0.9, 0.6, "expert", ["c"]))
    assert got[1].reviewer_id == 1 and not got[1].satisfied


def test_open_slots_go_to_anyone_with_a_score(spark):
    got = panel(spark, (1, 1, 0.9, 0.7, 0.8, "expert", ["a"]), (1, 2, 0.3, 0.2, 0.4, "fresher", ["b"]), (1, 3, 0.4, 0.2, 0.1, "fresher", ["c"]), (1, 4, 0.45, 0.9, None, "expert", ["d"]))
    assert [got[i].reviewer_id for i in (1, 2, 3)] == [1, 3, 2]
    assert got[1].label == P.HELD["expert"] and got[2].label == got[3].label == P.COMPLETED and got[2].satisfied is False


def test_the_last_slot_pays_for_what_it_repeats(spark):
    got = panel(spark, (1, 1, 0.9, 0.7, 0.8, "expert", ["a", "b"]), (1, 2, 0.8, 0.6, 0.7, "moderate", ["c"]), (1, 3, 0.7, 0.35, 0.6, "fresher", ["a", "b"]))
    assert got[3].reviewer_id == 3 and abs(got[3].score - 0.30) < 1e-9 and got[3].satisfied is False


def test_scores_fall_from_slot_to_slot(spark):
    slots = [(1, 1, 10, 0.5), (1, 2, 11, 0.7), (1, 3, 12, 0.1), (2, 1, 10, None), (2, 2, 11, 0.4)]
    got = {(r.paper_id, r.slot): round(r.assigned, 9) for r in P.ordered_scores(spark.createDataFrame(slots, "paper_id long, slot int, reviewer_id long, score double")).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 0.47, (1, 3): 0.1, (2, 1): 0.0, (2, 2): 0.0}


def test_peers_name_two_of_those_outranked(spark):
    ranked = rows(spark, *[(1, i, 0.9 - i / 100, 0.5, s, "moderate", ["t"]) for i, s in enumerate([0.9, 0.8, 0.8, 0.7, None])])
    picks = spark.createDataFrame([(1, 1, 0, 0.9), (1, 2, 1, 0.8), (1, 3, 3, 0.7)], "paper_id long, slot int, reviewer_id long, score double")
    got = {r.slot: (r.outranked, r.peers) for r in P.peers(picks, ranked).collect()}
    assert got == {1: (4, [1, 2]), 2: (2, [3, 4]), 3: (1, [4])}
    places = {r.reviewer_id: (r.final_rank, r.percentile) for r in P.places(ranked).collect()}
    assert places[0] == (1, 0.25) and places[4] == (None, None)


def test_no_candidates(spark):
    assert P.assign_panels(rows(spark, (1, 1, 0.1, 0.1, 0.1, "expert", ["a"])).limit(0)).count() == 0
