"""What the operators must not leave out: links in large mixed buckets, rows that share an id, whole passages, near lines."""

import math
import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelspark.llm import common, html, lines, minhash, passages, pieces, pii


def components_of(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in nodes}


def near_lines(rng, n, make):
    """Pairs of lines whose 5-character shingles have a similarity of 0.8 to 0.9."""
    out = []
    while len(out) < n:
        a, b = make(rng)
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            out.append((a, b))
    return out


def word(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def natural(rng):
    w = [word(rng, rng.randrange(3, 9)) for _ in range(14)]
    return " ".join(w), " ".join(w[:6] + [word(rng, len(w[6]))] + w[7:])


def long_words(rng):
    w = [word(rng, 18) for _ in range(4)]
    return " ".join(w), " ".join([w[0], w[1][:9] + "é" + w[1][10:], *w[2:]])


def unspaced(rng):
    a, k = word(rng, 80), rng.randrange(80)
    return a, a[:k] + "9" + a[k + 1 :]


def test_near_lines_of_any_form_are_found(spark):
    kinds = [near_lines(random.Random(11), 150, make) for make in (natural, long_words, unspaced)]
    rows = [(2 * (150 * k + i) + j, x) for k, pairs in enumerate(kinds) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    got = lines.removals(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    lost = set(got.doc_id)
    assert lost <= {2 * i + 1 for i in range(450)}
    assert all(sum(2 * (150 * k + i) + 1 in lost for i in range(150)) >= 147 for k in range(3))


def test_a_chain_in_one_bucket_is_linked_whole(spark):
    """Each set is like the next one only, so no link is spare; the bucket is a large one."""
    sets = spark.createDataFrame([(i, list(range(i, i + 9))) for i in range(24)], "id long, grams array<long>")
    got = common.linked(sets.select(F.lit(1).cast("long").alias("key"), "id"), lambda ids: sets.join(ids, "id", "left_semi"), 0.8, 8).collect()
    assert len(got) == 24 and {r.comp for r in got} == {0}


@pytest.mark.parametrize("small", [4])
def test_one_mixed_bucket_equals_all_pairs(spark, small):
    rng = random.Random(9)
    base = [[rng.randrange(10**9) for _ in range(rng.randrange(20, 60))] for _ in range(12)]
    sets = {}
    for i in range(240):
        s = rng.choice(base)
        k = rng.choice([0, 1, 2, 4, 8])
        sets[i] = frozenset(rng.sample(s, len(s) - k) + [rng.randrange(10**9) for _ in range(k)])
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = components_of(sets, links)
    frame = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, grams array<long>")
    got = common.linked(frame.select(F.lit(1).cast("long").alias("key"), "id"), lambda ids: frame.join(ids, "id", "left_semi"), 0.8, small).collect()
    assert {**{n: n for n in sets}, **{r.node: r.comp for r in got}} == want


def test_rows_without_an_id_or_with_a_shared_one_stay_apart(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(5, text(0)), (5, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (7, text(0)), (8, text(4) + " more"), (9, text(4) + " other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in minhash.one_of_each(frame).collect()]
    assert len(got) == 5 and set(got) == {(5, text(0)), (5, text(1)), (None, text(2)), (None, text(3)), (8, text(4) + " more")}
    both = spark.createDataFrame([(None, "first line here\nsecond line here"), (None, "something else\nfirst line here\nthird")], "doc_id long, text string")
    assert sorted(x for r in lines.cleaned(both).collect() for x in r.text.split("\n")) == ["first line here", "second line here", "something else", "third"]


def test_sizes_and_parities_rule_out_no_alike_pair(spark):
    rng = random.Random(11)
    texts = []
    for size in (3, 30, 200, 900, 3000):
        base = [rng.choice("abcdefgh ") for _ in range(size)]
        for edits in (0, 1, size // 60, size // 40, size // 20, size):
            line = list(base)
            for _ in range(edits):
                line[rng.randrange(size)] = rng.choice("abcdefgh ")
            texts.append("".join(line))
    texts = [t for t in sorted(set(texts)) if t]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    bounds = lines.signed(spark.createDataFrame(list(enumerate(texts)), "id long, line string")).select("id", "n", "odd").persist()
    assert dict(bounds.select("id", "n").collect()) == {i: len(s) for i, s in enumerate(sets)}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    kept = {tuple(r) for r in common.possible(spark.createDataFrame(pairs, "a long, b long"), bounds, 0.8).collect()}
    alike = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike and alike <= kept and len(kept) < len(pairs) / 2


def test_signatures_are_made_where_the_lines_lie(spark):
    """No shuffle between the lines, dealt by id, and their signatures; what only the linking needed leaves the disks."""
    docs = spark.createDataFrame([(i, f"line {i % 7} of a text\nanother line {i}") for i in range(40)], "doc_id long, text string")
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    assert lines.removals(docs).count()
    names = [spark.read.parquet(str(p)).columns for p in set(folder.glob("table-*")) - before]
    assert names and not any({"line", "keys"} & set(c) for c in names)
    rows = lines.lines(docs).groupBy("id").agg(F.min("line").alias("line"))
    signed = lines.signed(common.bucketed(rows, "id"))
    assert "Exchange" not in signed._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert {tuple(r) for r in signed.select("id", "n").collect()} == {tuple(r) for r in lines.signed(rows).select("id", "n").collect()}


@pytest.mark.parametrize("throughout", [4, 1024])
def test_a_mixed_bucket_with_bounds_equals_all_pairs(spark, monkeypatch, throughout):
    """Both ways of comparing a mixed bucket, in a list of two frames of keys, one of them with each member alone."""
    monkeypatch.setattr(common, "THROUGHOUT", throughout)
    monkeypatch.setattr(common, "SMALL", 4)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(8)]
    texts = set()
    for _ in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.choice([1, 2, 3, 6])):
            t[rng.randrange(90)] = rng.choice("xyz")
        texts.add("".join(t))
    texts = sorted(texts)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = components_of(range(len(texts)), [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    keys = [frame.select(F.lit(1).cast("long").alias("key"), "id"), frame.select((F.col("id") + 2).alias("key"), "id")]
    got = common.linked(keys, lambda ids: frame.join(ids, "id", "left_semi").select("id", F.col("line").alias("grams")), 0.8, 4, lambda line: F.array_distinct(lines.shingles(line)), lines.signed(frame).select("id", "n", "odd")).collect()
    assert {**{i: i for i in want}, **{r.node: r.comp for r in got}} == want and len(set(want.values())) > 8


def test_a_filter_of_many_members_still_tells_others_apart(spark):
    size = common.filter_bits(1_000_000)
    bits = common.member_bits(spark.range(1_000_000), "id", size)
    passed = spark.range(1_100_000).where(common.may_contain(bits, F.col("id"), size)).agg(F.count("*"), F.count(F.when(F.col("id") < 1_000_000, 1))).first()
    assert passed[1] == 1_000_000 and passed[0] - passed[1] < 7_000
    assert common.filter_bits(0) == common.FILTER_BITS and common.filter_bits(10**9) == common.MOST_BITS


def test_short_lines_take_part(spark):
    frame = spark.createDataFrame([(1, "yes\nno"), (2, "Yes \nmaybe"), (3, "abcd\nabce")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in lines.removals(frame).collect()} == {2: [0]}


def test_shared_passages_are_cut_to_their_ends(spark):
    """Passages of 37 to 90 words anywhere in texts: what goes is the passage, whole; 24 words aren't one."""
    rng = random.Random(3)
    rows, want = [], {}
    for p, size in enumerate([37, 45, 51, 60, 90, 24]):
        passage = [word(rng, 6) for _ in range(size)]
        for i in range(4):
            before, after = ([word(rng, 7) for _ in range(rng.randrange(0, 80))] for _ in range(2))
            doc = 10 * p + i
            rows.append((doc, " ".join(before + passage + after)))
            want[doc] = size if i and size >= 37 else 0
    got = passages.cut(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.n_removed_words.to_dict() == want
    assert all((got.n_clusters[d] > 0) == (d < 50) for d in want)


def test_equal_lines_of_30_words_and_passages_with_a_changed_word_are_found(spark):
    """60 cases each: lines of 30 words as paragraphs of their own, and passages of 80 words inside longer lines of which one word differs."""
    rng = random.Random(5)
    rows, some = [], lambda n, k: " ".join(word(rng, k) for _ in range(n))
    for p in range(60):
        line, passage = some(30, 6), [word(rng, 6) for _ in range(80)]
        changed = list(passage)
        changed[rng.randrange(80)] = word(rng, 9)
        rows += [(10 * p, f"{some(25, 7)}\n{line}"), (10 * p + 1, f"{line}\n{some(12, 7)}"), (10 * p + 2, f"{some(30, 7)} {' '.join(passage)} {some(20, 7)}"), (10 * p + 3, f"{some(10, 7)} {' '.join(changed)} {some(40, 7)}")]
    got = passages.cut(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").n_removed_words
    assert (got[[10 * p + 1 for p in range(60)]] == 30).all() and (got[[10 * p for p in range(60)]] == 0).all()
    near = got[[10 * p + 3 for p in range(60)]]
    assert (near >= 40).all() and near.mean() > 55 and (near <= 79).all()


def test_repeats_of_rows_without_an_id_are_cut_apart(spark):
    rng = random.Random(4)
    passage = " ".join(word(rng, 6) for _ in range(60))
    own = [" ".join(word(rng, 7) for _ in range(40)) for _ in range(2)]
    rows = [(None, passage + " " + own[0]), (None, own[1] + " " + passage), (None, "three short text"), (1, passage)]
    got = passages.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text.strip() for r in got) == sorted([passage, *own, "three short text"])


def test_disclosure_counts_different_segments(spark):
    rows = [(i, f"Ask Zebulon about item{chr(97 + i)} at zeb@mail.org now\nplain words again here") for i in range(5)]
    rows += [(10 + i, f"Zebulon {chr(97 + i) * 6} {chr(97 + i) * 4} here\nAsk about more {chr(97 + i) * 5} things now") for i in range(20)]
    told = {r.term for r in pii.terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    more = rows + [(100 + i, "one unrelated line") for i in range(3000)]
    assert "zebulon" not in told
    assert {r.term for r in pii.terms(spark.createDataFrame(more, "doc_id long, text string")).collect()} == told


def test_values_met_once_count_by_their_group(spark):
    rows = [(i, f"Write to Quillfeather {chr(97 + i) * 5} at {chr(97 + i) * 3}@quill.example.org") for i in range(6)]
    rows += [(10 + i, f"nothing {chr(97 + i % 26) * 6} {chr(97 + i // 26) * 7} stands here") for i in range(300)]
    assert "quillfeather" in {r.term for r in pii.terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


LONG = "word " * 60
PAGES = {
    "head left open": (f"<html><head><title>x</title><meta a=b><div><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></div>", 122),
    "names that only look like boilerplate": (f"<body><div class='content no-sidebar'><div id='page-head-wrap'><p>{LONG}</p><p>{LONG}</p></div></div>", 120),
    "section of an article": (f"<body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><section class='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>", 123),
    "graphics left open": (f"<body><article><h1>Title</h1><p>{LONG}</p><svg><path><p>{LONG}</p></article>", 121),
    "selection left open": (f"<body><div><select><option>a<option>b</div><p>{LONG}</p><p>{LONG}</p>", 120),
    "article inside a named box": (f"<body><div class='sidebar'><p>{LONG}</p></div><div class='menu'><article><p>{LONG}</p><p>{LONG}</p></article></div>", 120),
    "comments without an article element": (f"<body><div class='main'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p><p>{LONG}</p></div>", 121),
    "one paragraph alone": (f"<p>{LONG}</p>", 60),
}


@pytest.mark.parametrize("name", PAGES)
def test_articles_of_odd_pages_stay_whole(name):
    page, n = PAGES[name]
    assert len(html.main_text(page, html.train(html.LABELLED)).split()) == n


def test_pieces_keep_their_own_space_sign(spark):
    rows = [(1, "a▁b"), (2, "▁"), (3, " ▁ x"), (4, "▁▁ ▁")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame)).collect()} == dict(rows)


def test_a_shared_prefix_or_two_chance_meetings_disclose_nothing(spark):
    draw = random.Random(8)
    words = [f"{draw.choice('bdfgklmnprst')}{''.join(draw.choice('aeioubdgklmnrst') for _ in range(draw.randrange(4, 8)))}" for _ in range(400)] + ["wrote", "from", "once", "heute", "unser", "wegen"]
    plain = lambda i: " ".join(draw.choice(words) for _ in range(9)) + f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
    rows = [(i, plain(i)) for i in range(2000)]
    rows += [(3000, "Ruf +49 30 5551234 wegen fruchtsaft an"), (3001, "Unser fruchtsaft, Tel. +49 30 8884321 heute")]
    rows += [(3100 + i, f"{plain(i)} {chr(97 + i % 26) * 3}@post.example.org {chr(97 + i // 26)}") for i in range(200)]
    rows += [(3400 + i, f"gooseberry {plain(i)} {chr(97 + i) * 4}@post.example.org") for i in range(2)]
    rows += [(3500 + i, f"Hollingworth {plain(i)} wrote from hw@far.example.net {chr(97 + i) * 4}") for i in range(5)]
    rows += [(3600, "Marchbanks once wrote from mb@once.example.net")]
    told = {r.term for r in pii.terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert told == {"hollingworth"}


def test_the_chance_bound_holds_the_poisson_tail(spark):
    cases = [(k, nt, ne) for k in (2, 3, 5, 20, 30) for nt in (k, k + 3, 40) for ne in (k, 50, 400)]
    frame = spark.createDataFrame(cases, "k long, nt long, ne long")
    from pyspark.sql import functions as F

    got = frame.select("*", pii.by_chance(F.col("k"), F.col("nt"), F.col("ne"), F.lit(1000.0), F.lit(1.0)).alias("b")).collect()
    for r in got:
        mean = (r.nt - 1) * r.ne / 1000
        below = sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(r.k - 1))
        tail = max(0.0, 1 - below)
        assert r.b >= tail - 1e-12, r
        if r.k < 20 and r.k - 1 > 2 * mean and tail > 1e-9:
            assert r.b <= 2.5 * tail, r


def test_line_signatures_leave_the_disks_before_lines_are_compared(spark, monkeypatch):
    made, there = [], []
    real, found = lines.bucketed, common.components

    def bucketed(df, by):
        made.append(real(df, by))
        return made[-1]

    def components(edges):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders[1])
        there.append(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))
        return found(edges)

    folders = []
    monkeypatch.setattr(lines, "bucketed", lambda df, by: (out := bucketed(df, by), folders.append(out.inputFiles()[0].rsplit("/", 1)[0]))[0])
    monkeypatch.setattr(common, "components", components)
    rows = [(i, f"a line that is much alike the others of this text {i % 3}\nown words of the text number {i} alone") for i in range(9)]
    got = lines.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(folders) == 2 and there and not any(there)
    assert {r.doc_id for r in got} >= set(range(1, 9))
