"""Phrases, ranked search and vector links against plain versions, on given and planted rows, and their odd cases."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelspark.llm import caps, impacts, phrases
from panelspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want) > 0
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


# ---- phrases


def plain_phrases(rows, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < 10:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= 10 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


ODD_TEXTS = [("en", "Big Data, big data\tbig  data"), ("en", None), (None, "no lang here " * 12), ("", "empty lang " * 11), ("en", ""), ("de", "Über über ÜBER über " * 9), ("en", "a b. a b! a b\nc " * 8), ("en", "x y z " * 12), ("fr", "\x1cone two\x0bthree two " * 12)]


def test_phrases_equal_plain_counts(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "DELTA", "eps.", "zeta,", "eta", "été"]
    rows = [("en" if i % 3 else "de", " ".join(rng.choices(words, [9, 7, 5, 3, 2, 2, 1, 4], k=rng.randrange(60)))) for i in range(60)] + ODD_TEXTS * 2
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, block int, word string")
    for top in (2000, 3):
        got = sorted(tuple(r) for r in phrases.collocations(df.repartition(7), top).collect())
        assert got == plain_phrases(rows, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_small_blocks_give_the_same_phrases(spark, monkeypatch):
    rows = [("en", f"the quick fox {i % 3} sees the quick dog") for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "BLOCK", 20)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == plain_phrases(rows, 2000)


def test_products_beyond_64_bits_are_exact(spark):
    # 10^15 occurrences: a * a * 10^6 has 36 digits
    row = spark.createDataFrame([(10**15 - 1, 10**15 - 1, 10**15 - 2)], "f long, l long, r long")
    got = row.selectExpr("(cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) s").first().s
    assert got == 1000000 * (10**15 - 1) ** 2 // ((10**15 - 1) * (10**15 - 2))


# ---- ranked search


def plain_search(docs, items, k=10):
    term = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    held = [(i, Counter(term(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(term(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def some_docs(rng, n):
    words = ["alpha", "Beta", "gamma-ray", "naïve", "x1", "über", "ÜBER", "rare", "!?"]
    docs = [(i // 2 if i % 7 else None, " ".join(rng.choices(words, [9, 8, 7, 3, 5, 2, 2, 1, 3], k=rng.randrange(12)))) for i in range(n)]
    return docs + [(900, None), (901, ""), (902, "..."), (903, "alpha " * 3000)]


@pytest.mark.parametrize("block", [4096, 50])
def test_search_equals_plain_scores(block, spark, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK", block)
    monkeypatch.setattr(impacts, "GROUP", 3)
    rng = random.Random(6)
    docs = some_docs(rng, 200)
    items = [(i, t) for i, (_, t) in enumerate(some_docs(rng, 8))] + [(5, "rare"), (5, "rare"), (None, "naïve x1"), (6, "unseen words"), (7, None)]
    df = spark.createDataFrame([(i, t, 1, "k", 0.0) for i, t in docs], "doc_id long, text string, block int, term string, score double").repartition(3)
    got = impacts.search(impacts.index(df), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_search(docs, items))


def test_search_over_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert impacts.search(impacts.index(docs.limit(0)), items).count() == 0
    assert impacts.search(impacts.index(docs), items.limit(0)).count() == 0
    assert impacts.search(impacts.index(docs), items).count() == 1


def test_bit_slices_add_and_rank():
    rng = np.random.default_rng(7)
    words, depth = 3, 20
    values = [rng.integers(0, 1 << depth, 192) * (rng.random(192) < 0.5) for _ in range(5)]
    maps = np.stack([impacts.slices(v[np.flatnonzero(v)], np.flatnonzero(v), depth, words) for v in values])
    which = [np.array([0, 1, 2, 3, 4]), np.array([1, 3]), np.array([2])]
    for q, (at, score) in enumerate(impacts.best(impacts.summed(maps, which), 10)):
        want = sum(values[i] for i in which[q])
        order = sorted(np.flatnonzero(want), key=lambda p: (-want[p], p))[:10]
        assert sorted(at) == sorted(order) and [want[p] for p in at] == list(score)


# ---- vector links


def plain_links(rows):
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for k, _, x in good:
        for j, _, y in good:
            if k < j and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / math.sqrt((x1 @ x1) * (y1 @ y1)) >= 0.95:
                    links[k].add(j)
                    links[j].add(k)
    out, comp = [], {}
    for k in range(len(rows)):
        if k not in comp:
            todo, seen = [k], {k}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                comp[j] = min(ids, default=None)
        out.append((rows[k][0], len(links[k]), comp[k], rows[k][0] == comp[k]))
    return Counter(out)


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    v = v / np.linalg.norm(v)
    z -= (z @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


ODD_VECTORS = [(50, None), (51, []), (52, [0.0, 0.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (56, [1.0, 2.0]), (56, [2.0, 4.0]), (None, [1.0, 2.01]), (None, [5.0, -9.0]), (57, [1e300, 2e300]), (58, [1e-300, 2e-300]), (59, [-3.0]), (60, [-4.0]), (61, [3.0])]


def test_odd_vectors(spark):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in ODD_VECTORS], "vec_id long, embedding array<double>, key int, comp int")
    assert Counter(tuple(r) for r in caps.near_vectors(df).collect()) == plain_links(ODD_VECTORS)
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_crowds_and_chains_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(caps, "TILE", 32)
    monkeypatch.setattr(caps, "TARGET", 24)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(i, near(rng, centre, c)) for i, c in enumerate([*np.linspace(0.955, 0.9999, 150), *[1.0] * 40])]
    for _ in range(25):  # chains of links
        v = rng.standard_normal(16)
        for _ in range(6):
            rows.append((len(rows), v))
            v = near(rng, v, 0.97)
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = plain_links(rows), Counter(tuple(r) for r in caps.near_vectors(df).collect())
    total = lambda c: sum(r[1] * k for r, k in c.items())
    assert all(g[1] <= w[1] for g, w in zip(sorted(got.elements()), sorted(want.elements()), strict=True))
    assert total(got) >= 0.97 * total(want)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 64))
    rows = [(i, v) for i, v in enumerate(base)] + [(2000 + i, near(rng, base[i], 0.9501)) for i in range(500)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in caps.near_vectors(df).collect()}
    found = sum(got[2000 + i].component_id == i for i in range(500))
    assert found >= 0.95 * 500 and max(r.n_links for r in got.values()) == 1
