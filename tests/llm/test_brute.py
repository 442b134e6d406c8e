"""Each operator against a plain version in Python, on the smallest tables and on planted rows."""

import hashlib
import random
import re
from collections import Counter

import pandas as pd
import pytest

from panelspark.llm import fertility, html, lines, minhash, packing, passages, pieces, pii, spotsigs, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return docs.toPandas().sort_values("doc_id").set_index("doc_id")["text"]


def classes_of(sets: dict, threshold: float) -> dict:
    """Least member of the component of each key, by comparing all pairs."""
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if (both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold) or sets[a] == sets[b]:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def word_set(text: str, k: int = 5) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def word_bag(text: str, k: int = 5) -> frozenset:
    """The shingles with the number of each occurrence: their Jaccard similarity is the weighted one."""
    w = text.lower().split()
    seen = Counter()
    out = set()
    for i in range(max(1, len(w) - k + 1) if w else 0):
        g = tuple(w[i : i + k])
        out.add((g, seen[g]))
        seen[g] += 1
    return frozenset(out)


def edited(text: str, rate: float, rng: random.Random) -> str:
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split(" "))


def family(texts, rng, rates, size=6):
    """Rows of near copies of a few texts, with fresh ids."""
    base = [t for t in texts if 150 < len(t.split()) < 600][:4]
    rows = [(10_000 + i, edited(t, rates[i % len(rates)], rng)) for i, t in enumerate(base * size)]
    return rows


def test_near_classes_equal_all_pairs(spark, texts):
    rows = [*texts.items(), *family(texts, random.Random(3), [0.0, 0.005, 0.01, 0.02, 0.03])]
    want = classes_of({i: word_bag(t) for i, t in rows}, 0.8)
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == want
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(kept.doc_id) == sorted(set(want.values()))


def test_large_mixed_group_is_resolved(spark, texts):
    rng = random.Random(5)
    base = next(t for t in texts if 150 < len(t.split()) < 300)
    rows = [(i, edited(base, rng.choice([0.0, 0.01, 0.02, 0.04, 0.06]), rng)) for i in range(150)]
    want = classes_of({i: word_bag(t) for i, t in rows}, 0.8)
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == want


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    from panelspark.llm.hashing import darts, mix

    el = mix(np.arange(300, dtype=np.uint64))
    a, b = np.r_[0:200], np.r_[100:300]
    wa, wb = np.full(200, 1.5), np.where(b < 200, 0.5, 2.0)
    sig = darts(np.concatenate([el[a], el[b]]), np.concatenate([wa, wb]), np.repeat([0, 1], 200), 2, 2000)
    low = sum(min(1.5, 0.5) for x in b if x < 200)
    want = low / (wa.sum() + wb.sum() - low)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_line_removals_equal_all_pairs(spark, texts):
    rng = random.Random(7)
    rows = [*texts.items()][:120]
    some = [x for _, t in rows for x in t.split("\n") if len(x.split()) > 25][:6]
    rows += [(10_000 + i, "Own beginning of a text.\n" + edited(some[i % 6], 0.02, rng)) for i in range(30)]
    all_lines = [(d, k, x.strip(" ").lower()) for d, t in rows for k, x in enumerate(t.split("\n"))]
    distinct = sorted({x for *_, x in all_lines if x})
    sets = {x: frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in distinct}
    comp = classes_of(sets, 0.8)
    first, want = {}, set()
    for d, k, x in sorted(all_lines):
        if x in comp and first.setdefault(comp[x], (d, k)) != (d, k):
            want.add((d, k))
    got = lines.removals(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    have = {(d, k) for d, ks in zip(got.doc_id, got.removed, strict=True) for k in ks}
    assert have <= want and len(want - have) <= 0.01 * len(want) + 1
    report = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    for d, t in rows:
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in have)
        assert report.kept_sha256[d] == hashlib.sha256(text.encode()).hexdigest()
        assert report.n_lines[d] == t.count("\n") + 1


def test_fingerprints_follow_the_contract(spark, texts):
    got = spotsigs.fingerprints(spark.createDataFrame([*texts.items()], "doc_id long, text string")).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    ids = list(texts.index)
    for i, d in enumerate(ids):
        a, b = texts[d], texts[ids[(i + 1) % len(ids)]]
        k = len(a) // 4
        e = a[: len(a) - k] + b[:k]
        sa, se, sb = map(spotsigs.signatures, (a, e, b))
        r = got.loc[d]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == spotsigs.fingerprint(sa) and r.edited_fingerprint == spotsigs.fingerprint(se)
        assert r.near_edited == pytest.approx(spotsigs.jaccard(sa, se)) and r.near_next == pytest.approx(spotsigs.jaccard(sa, sb))
    assert got.near_edited.mean() > 0.4 and got.near_next.mean() < 0.05


def test_spot_classes_equal_all_pairs(spark, texts):
    rows = [*texts.items(), *family(texts, random.Random(3), [0.0, 0.01, 0.02])]
    want = classes_of({i: frozenset(spotsigs.signatures(t)) for i, t in rows}, 0.8)
    got = spotsigs.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == want


def test_best_fit_finds_the_tightest_compatible_bin():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(0, 60) for _ in range(400)), reverse=True)
    src, clu = [rng.randrange(-1, 6) for _ in sizes], [rng.randrange(-1, 40) for _ in sizes]
    bins: list[dict] = []
    want = []
    for s, a, c in zip(sizes, src, clu, strict=True):
        fit = [(b["room"], b["since"], i) for i, b in enumerate(bins) if b["room"] >= s and (c < 0 or c not in b["clu"]) and (a < 0 or b["src"][a] < 2)]
        i = min(fit)[2] if fit else len(bins)
        if not fit:
            bins.append({"room": 100, "src": Counter(), "clu": set(), "since": 0})
        b = bins[i]
        b["room"], b["since"] = b["room"] - s, len(want)
        b["src"][a] += 1
        b["clu"].add(c)
        want.append(i)
    assert packing.best_fit(sizes, src, clu, 100, 2) == want


def test_packing_keeps_every_word(spark, docs, texts):
    got = packing.pack(docs, capacity=512).toPandas()
    assert got.groupby("doc_id").n_words.sum().to_dict() == {d: len(t.split()) for d, t in texts.items()}
    assert got.groupby("bin_id").n_words.sum().max() <= 512
    source = docs.toPandas().set_index("doc_id").source
    assert got.assign(s=got.doc_id.map(source)).groupby(["bin_id", "s"]).size().max() <= packing.PER_SOURCE
    same = got.assign(t=got.doc_id.map(texts)).query("n_words > 0").groupby(["bin_id", "t"]).size()
    assert same.max() == 1
    for _, b in got.groupby("bin_id"):
        b = b.sort_values("slot")
        assert (b.offset == b.n_words.cumsum() - b.n_words).all()


def test_base_quality_counts(spark, docs, texts):
    got = fertility.rules(docs).toPandas().set_index("doc_id")
    for d, t in texts.items():
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", t)
        seen, dup = [], 0
        for x in t.split("\n"):
            dup += x in seen and bool(x.strip(" \t\n\x0b\x0c\r"))
            seen.append(x)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        r = got.loc[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got.kept[~got.base_failed].mean() > 0.8


def test_pages_give_their_articles(spark):
    import html as std

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html.extract(pages).toPandas().set_index("page_id")
    for p in pages.toPandas().itertuples():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        parts = [" ".join(std.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article)>", inner)]
        assert got.text[p.page_id] == "\n".join(x for x in parts if x)
        assert got.n_chars[p.page_id] == len(got.text[p.page_id])


def test_html_oddities():
    tree = html.train(html.LABELLED)
    page = '<!-- <p>no</p> --><nav>Home</nav><article><p title="a>b">One &amp; two&#8212;three<script>if (a<b) "<p>x</p>"</script> four</p><form><p>Your name please</p></form><div class="comments"><p>Nice article, I liked it very much indeed</p></div><p>Last &copy one<aside>Read also this</aside></article><p'
    assert html.main_text(page, tree) == "One & two—three four\nLast © one"
    assert html.main_text(None, tree) == html.main_text("", tree) == html.main_text("<p", tree) == ""


def test_shared_passages_are_found(spark, texts):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(52)]
    rows = [(i, " ".join(word() for _ in range(100 + i)) + " " + " ".join(passage) + ("\n" if i % 2 else " ") + " ".join(word() for _ in range(60))) for i in range(12)]
    rows += [(100 + i, " ".join(word() for _ in range(200))) for i in range(10)]
    got = passages.cut(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.n_removed_words[0] == 0 and (got.n_removed_words[range(1, 12)] == 52).all() and (got.n_removed_words[range(100, 110)] == 0).all()
    assert (got.n_clusters[range(12)] > 0).all()
    for d, t in rows:
        spans = [tuple(map(int, s.split(":"))) for s in got.spans[d].split(",") if s]
        assert all(set(t[a:z].split()) <= set(passage) for a, z in spans)
        for a, z in reversed(spans):
            t = t[:a] + t[z:]
        assert t == got.text[d]


def test_near_paragraphs_are_found(spark, texts):
    rng = random.Random(4)
    paragraph = next(x for t in texts for x in t.split("\n") if len(x.split()) > 60)
    rows = [(i, f"a{i} b{i} c{i}\n" + edited(paragraph, 0.01, rng)) for i in range(8)]
    sets = {i: word_set(t.split("\n")[1]) for i, t in rows}
    want = classes_of(sets, 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.near_paragraphs(passages.paragraphs(docs), docs, 0.8).toPandas()
    assert set(got[got.lost].doc_id) == {i for i, c in want.items() if c != i} and (got["first"] == 3).all()


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t: str) -> list:
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base(spark, texts):
    extra = {900: "é a.b@c.d.e@f.g +49 (0) 30-1234567, 300.1.1.1 001.002.3.255 1.2.3.4.5 4111 1111 1111 1111 4111-1111-1111-1112 \U0001f600 x@y.z", 901: "", 902: "1" * 9000, 903: "a." * 6000 + "@b" + ".c" * 6000, 904: "1.1.1." * 3000}
    rows = [*texts.items(), *extra.items()]
    got = pii.report(spark.createDataFrame([*rows, (905, None)], "doc_id long, text string")).toPandas().set_index("doc_id")
    for d, t in [*rows, (905, "")]:
        want = base_spans(t)
        r = got.loc[d]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), d
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]
        assert r.spans.split(",")[: len(want)] == (want or r.spans.split(",")[:0])


def test_disclosing_terms_are_sanitised(spark):
    rows = [(i, f"Ask Zebulon about item{chr(97 + i)} at zeb@mail.org now\nplain words again here") for i in range(5)]
    rows += [(10 + i, f"plain words again {chr(97 + i) * 6} here\nAsk about more {chr(97 + i) * 5} things now") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = pii.terms(docs).toPandas()
    assert set(told.term) == {"zebulon"} and told.removed.all()
    text = pii.sanitised(docs).toPandas().set_index("doc_id").text
    assert text[0] == "Ask  about itema at [EMAIL] now\nplain words again here" and text[10] == rows[5][1]
    got = pii.report(docs).toPandas().set_index("doc_id")
    assert got.spans[0] == "email:27:39,term:4:11" and got.n_term[0] == 1 and got.n_term[12] == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.MODEL)


def test_pieces_are_the_best_path(vocabulary, texts):
    names = {vocabulary.names[i]: s for i, s in zip(vocabulary.ids, vocabulary.scores, strict=True)}
    for word in {w for t in texts.head(8) for w in t.split()} | {"ab漢x", "ñandú"}:
        w = pieces.SPACE + word
        best = [0.0] + [float("-inf")] * len(w)
        for z in range(1, len(w) + 1):
            best[z] = max([best[z - 1] + pieces.UNKNOWN, *(best[a] + names[w[a:z]] for a in range(max(0, z - 16), z) if w[a:z] in names)])
        ids = vocabulary.cut([w])[0]
        total = sum(names[vocabulary.names[i]] for i in ids if i not in vocabulary.byte)
        covered = sum(len(vocabulary.names[i]) for i in ids if i not in vocabulary.byte)
        assert total + pieces.UNKNOWN * (len(w) - covered) == pytest.approx(best[-1])


def test_pieces_round_trip(spark, vocabulary, texts):
    odd = [None, "", " ", "  two  spaces ", "line\n\ttab", "漢字かな 😀 ▁x", "\x00\x01", "a" * 5000, "x" + " " * 40]
    rows = [*texts.items(), *((1000 + i, t) for i, t in enumerate(odd))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.round_trip(frame).toPandas()
    assert got.same.all() and len(got) == len(rows)
    back = pieces.decode(pieces.encode(frame)).toPandas().set_index("doc_id").text
    assert all(back[d] == (t or "") for d, t in rows)


def test_machine_learns_pairs():
    rng = random.Random(0)
    bags, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(rng.choice(["red", "blue", "green", "tall", "small"]) for _ in range(12)) + (" insulting" if a else "") + (" grouping" if b else "")
        bags.append(toxicity.bag(text, {}))
        y.append(float(a and b) if rng.random() > 0.02 else float(rng.random() < 0.5))
    import numpy as np

    machine = toxicity.fit(toxicity.packed(bags), np.array(y))
    only, pair = machine.score([toxicity.bag(t, {}) for t in ("red blue tall small green red blue tall small green red tall insulting", "red blue tall small green red blue tall small green red tall insulting grouping")])
    assert only < 0.2 < 0.8 < pair
    assert np.abs(machine.vectors).max() > 0.1


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.9 and hit / (got.toxic == 1).sum() > 0.75


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    rows = docs
    left = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns and rows.dtypes == docs.dtypes, name
        rows = spark.createDataFrame(rows.toPandas(), docs.schema)
        left.append(rows.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0.7 * left[0]
    got = cp.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(rows.toPandas().doc_id)
    assert pd.Series(got.n_words).sum() > 0
