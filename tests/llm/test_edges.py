"""Nulls, empty texts and tables, repeated rows, long texts and clashing columns, for each operator and stage."""

import pytest

from panelspark.llm import fertility, html, lines, minhash, packing, passages, pieces, pii, spotsigs, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, comp int, score string, n int, term string, line string"
LONG = "alpha beta gamma delta " * 6000
ROWS = [
    (1, "one line of words that is long enough to count\nshort", "en", "s", 5, 1, "k", 1, "x", 1, "t", "l"),
    (1, "one line of words that is long enough to count\nshort", "en", "s", 5, 1, "k", 1, "x", 1, "t", "l"),
    (2, "one line of words that is long enough to count\nshort", None, None, None, None, None, None, None, None, None, None),
    (3, None, "en", "s", None, 1, None, 1, None, None, None, None),
    (4, "", "en", "s", 0, 1, None, 1, None, None, None, None),
    (5, " \n\n ", "xx", "s", 0, 1, None, 1, None, None, None, None),
    (None, "a text without an identifier stands here by itself", "en", None, 0, 1, None, 1, None, None, None, None),
    (7, LONG, "en", "s", 0, 1, None, 1, None, None, None, None),
    (8, "x" * 30000, "en", "s", 0, 1, None, 1, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 0, 1), (7, 0, 0), (2, None, None), (None, 1, 1), (1, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


def over(operator):
    return lambda docs, labels: operator(docs)


ROWWISE = {
    "toxicity": toxicity.toxicity,
    "lines": over(lines.report),
    "spotsigs": over(spotsigs.fingerprints),
    "minhash": over(minhash.classes),
    "fertility": over(fertility.rules),
    "passages": over(passages.cut),
    "pii": over(pii.report),
    "pieces": over(pieces.round_trip),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_a_row_for_each_row(name, odd, none, labels):
    got = ROWWISE[name](odd, labels).toPandas()
    assert len(got) == len(ROWS) and got.doc_id.isna().sum() == 1
    assert ROWWISE[name](none, labels).count() == 0


def test_empty_labels(odd, labels):
    got = toxicity.toxicity(odd, labels.limit(0)).toPandas()
    assert (got.score < 0.01).all() and (got.predicted == 0).all()


@pytest.mark.parametrize("stage", [toxicity.reject, over(lines.cleaned), over(minhash.one_of_each), over(pii.sanitised)])
def test_stages_keep_columns(stage, odd, none, labels):
    got = stage(odd, labels)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert 0 < got.count() <= len(ROWS)
    assert stage(none, labels).count() == 0


def test_one_of_each_class(odd):
    got = minhash.one_of_each(odd).toPandas()
    assert sorted(got.doc_id.dropna()) == [1, 3, 7, 8] and got.doc_id.isna().sum() == 1


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd).toPandas()
    assert got.n_words.sum() == 3 * 11 + 9 + 24000 + 1 and got.doc_id.isna().sum() == 1
    assert packing.pack(none).count() == 0


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>" * 5000), (3, "u", "plain text of a page")], "page_id long, url string, html string")
    got = html.extract(pages).toPandas()
    assert len(got) == 4 and (got.n_chars[:3] == 0).all()
    assert html.extract(pages.limit(0)).count() == 0


def test_spot_classes_of_odd_rows(odd, none):
    assert spotsigs.near_classes(odd).count() == len(ROWS)
    assert spotsigs.near_classes(none).count() == 0
