"""What the registered queries must not leave out: papers beyond the first ids, frequent topics."""

from panelspark.plans.catalog import QUERIES


def test_topic_links_keep_every_item_and_the_most_frequent_topic(spark, tmp_path):
    spark.createDataFrame([(3, "the license"), (70, "the end"), (71, "nothing here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(0, "the first", "x"), (1, "the license", "x"), (500, "worthless", "x"), (501, "license", "y")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.paper_id, r.reviewer_id): r.score for r in QUERIES["topic_intersection"](spark, str(tmp_path)).collect()}
    # x: the 2, license 1, worthless 1 of 4; y: license alone
    assert got == {(3, "x"): 0.75, (3, "y"): 0.5, (70, "x"): 0.5}


def test_papers_are_every_50th_row_of_the_table(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0 + i % 3], i % 4) for i in range(230)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["vector_topk"](spark, str(tmp_path)).collect()
    assert {r.paper_id for r in got} == {0, 50, 100, 150, 200} and len(got) == 50
    assert QUERIES["ranking_quality"](spark, str(tmp_path)).first().n_papers == 5
