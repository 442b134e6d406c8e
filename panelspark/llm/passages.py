"""Substring deduplication by paragraph MinHash banding.

Two kinds of paragraphs stand for a text. Natural ones are its lines of ``NATURAL`` words or
more: sets of five-word shingles whose MinHash signatures in 10 bands of 3 meet pairs of
similarity 0.8 with a chance of 0.9992; pairs that collide are verified by exact Jaccard
similarity (``common.linked``) and removals are clustered by connected components. Sliding
ones are runs of ``RUN`` words chosen by winnowing (the least hash of every ``EVERY``
successive runs), so that any passage of ``RUN + EVERY - 1`` = 37 words which two texts
share has a run in common, wherever its lines begin and end. They meet by equality,
which is a similarity of 1: two independent hashes of the run's words must agree. A
passage found so is then followed word by word to where the two texts part.

Each cluster keeps its first occurrence by (doc_id, text, position), null ids last; the
words of all others are removed. A cluster has members in two rows at least: what one
text repeats within itself is the business of line deduplication.

Nulls: a null text has no paragraphs. A row is known by its doc_id and its text; rows
equal in both count as one. Empty tables stay empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import linked, may_contain, member_bits, written
from .hashing import Grams, Words, bands, minima, mix
from .minhash import digest, lists, row_hash

NATURAL = 20
RUN = 25
#: Of so many successive runs one is chosen; a shared passage goes on for fewer words on either side of its runs.
EVERY = 13
THRESHOLD = 0.8
ROWS, BANDS = 3, 10
WORD = re.compile(r"\S+")


def natural(lines: list[list[str]]) -> list[tuple[int, int]]:
    """First and end word of each line of NATURAL words or more."""
    out, at = [], 0
    for line in lines:
        if len(line) >= NATURAL:
            out.append((at, at + len(line)))
        at += len(line)
    return out


def natural_sets(text: str, words: Words, grams: Grams) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The hashes of the text's words, and each natural paragraph with its set of shingles, ascending."""
    lines = [line.split() for line in text.lower().split("\n")]
    h = words([w for line in lines for w in line])
    fives = grams(h, 5)
    return h, [(a, z, np.unique(fives[a : z - 4])) for a, z in natural(lines)]


def sliding(words: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and two hashes of the winnowed runs; a text of fewer words than a run has none."""
    h = grams(words, RUN)
    if not len(h):
        return np.zeros(0, np.int64), h, np.zeros(0, np.int32)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(1)))])
        check = ((sums[RUN:] - sums[:-RUN]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = mix(h)
    if len(h) <= EVERY:
        at = np.array([order.argmin()])
    else:
        low = np.lib.stride_tricks.sliding_window_view(order, EVERY).argmin(1)
        at = np.unique(low + np.arange(len(low)))
    return at, h[at], check[at]


def _small(values: list[np.ndarray], kind: np.dtype, to: pa.DataType) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind), to))


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each text: its sliding paragraphs ``ids, checks, starts`` and natural ones ``names, first, end, keys`` (``BANDS`` keys each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Words(), Grams()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                ids, checks, starts, names, first, end, sets = [], [], [], [], [], [], []
                for text in part.column(2).to_pylist():
                    h, found = natural_sets(text or "", words, grams)
                    at, x, c = sliding(h, grams)
                    ids.append(x), checks.append(c), starts.append(at)
                    names.append(np.array([digest(s) for *_, s in found], np.int64))
                    first.append(np.array([a for a, *_ in found], np.int64))
                    end.append(np.array([z for _, z, _ in found], np.int64))
                    sets += [s for *_, s in found]
                keys = bands(minima(sets, ROWS * BANDS), ROWS) if sets else np.zeros((0, BANDS), np.int64)
                at = np.cumsum([0, *map(len, names)])
                cols = [part.column(0), part.column(1), lists(ids), _small(checks, np.int32, pa.int32()), _small(starts, np.int32, pa.int32()), lists(names), _small(first, np.int32, pa.int32()), _small(end, np.int32, pa.int32()), lists([keys[a:z].reshape(-1) for a, z in zip(at[:-1], at[1:], strict=True)])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "ids", "checks", "starts", "names", "first", "end", "keys"])

    schema = "doc_id long, h long, ids array<long>, checks array<int>, starts array<int>, names array<long>, first array<int>, end array<int>, keys array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("h"), "text").mapInArrow(run, schema)


def paragraph_sets(docs: DataFrame) -> DataFrame:
    """``(id, grams)`` of the natural paragraphs ``ids`` of each row ``(ids array<long>, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Words(), Grams()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                ids, sets = [], []
                for want, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    want = set(want)
                    for _, _, s in natural_sets(text or "", words, grams)[1]:
                        if (name := digest(s)) in want:
                            ids.append(name)
                            sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(sets)], ["id", "grams"])

    return docs.mapInArrow(run, "id long, grams array<long>")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"), F.col("first").alias("first"))


def _rows_of(docs: DataFrame, want: DataFrame, *cols: str) -> DataFrame:
    """The texts of the rows ``want(d, t, ...)`` beside its columns ``cols``; rows equal in id and text count once."""
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("h"), "text").where(may_contain(member_bits(want, "t"), F.col("h")))
    found = here.join(want, (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return found.groupBy("doc_id", "h").agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in cols]).select(*cols, "text")


def _apart(hits: DataFrame, name: str) -> DataFrame:
    """``hits(doc_id, h, name, first, ...)`` of clusters with members in two rows, with ``lost``: false for the place that stays."""
    row = F.xxhash64("doc_id", "h")
    named = hits.groupBy(name).agg(F.min(_place()).alias("p"), F.min(row).alias("lo"), F.max(row).alias("hi")).where("lo <> hi")
    named = written(named.select(name, "p"))
    inside = hits.join(named.select(name), name)
    # joined by place, not by cluster: a cluster may hold a third of all rows
    stays = named.select(F.col(name).alias("c"), F.col("p.doc_id").alias("d"), F.col("p.h").alias("t"), F.col("p.first").alias("f"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")) & (F.col("first") == F.col("f")) & (F.col(name) == F.col("c"))
    return written(inside.join(stays, same, "left").select(*hits.columns, F.col("c").isNull().alias("lost")))


def near_paragraphs(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """``(doc_id, h, comp, first, end, lost)`` of the natural paragraphs whose cluster has members in other rows."""
    each = rows.where(F.size("names") > 0).select("doc_id", "h", F.explode(F.arrays_zip("names", "first", "end", F.sequence(F.lit(0), F.size("names") - 1).alias("nth"))).alias("x"), "keys")
    each = written(each.select("doc_id", "h", F.col("x.names").alias("id"), F.col("x.first").alias("first"), F.col("x.end").alias("end"), F.slice("keys", F.col("x.nth") * BANDS + 1, F.lit(BANDS)).alias("keys")))
    reps = each.groupBy("id").agg(F.min(_place()).alias("p"), F.first("keys").alias("keys"))
    reps = written(reps.select("id", F.col("p.doc_id").alias("d"), F.col("p.h").alias("t"), "keys"))

    def sets(ids: DataFrame) -> DataFrame:
        want = written(reps.join(ids, "id", "left_semi").groupBy("d", "t").agg(F.collect_list("id").alias("ids")))
        return paragraph_sets(_rows_of(docs, want, "ids")).dropDuplicates(["id"])

    comp = linked(reps.select(F.explode("keys").alias("key"), "id"), sets, threshold).withColumnRenamed("node", "id")
    spots = each.drop("keys").join(comp, "id", "left").select("doc_id", "h", F.coalesce("comp", "id").alias("comp"), "first", "end").distinct()
    return _apart(spots, "comp")


def shared_runs(rows: DataFrame) -> DataFrame:
    """``(doc_id, h, id, check, first, lost)`` of the sliding paragraphs that occur in other rows too."""
    each = rows.select("doc_id", "h", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("checks").alias("check"), F.col("starts").alias("first"))).alias("x"))
    each = each.select("doc_id", "h", F.xxhash64("x.id", "x.check").alias("id"), "x.first")
    again = written(rows.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("checks").alias("check"))).alias("x")).select(F.xxhash64("x.id", "x.check").alias("id")).groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"))
    return _apart(written(each.join(again, "id")).select("doc_id", "h", "id", "first").distinct(), "id")


def contexts(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """``(id, before, after)`` for ``spots(doc_id, h, id, first)``: hashes of the EVERY words that end where a run begins, nearest first, and of those that follow it."""
    want = written(spots.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("t")).agg(F.collect_list(F.struct("id", "first")).alias("spots")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                ids, before, after = [], [], []
                for spots, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h = words((text or "").lower().split())
                    for s in spots:
                        at, end = s["first"], s["first"] + RUN
                        ids.append(s["id"])
                        before.append(h[max(0, at - EVERY) : at][::-1])
                        after.append(h[end : end + EVERY])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(before), lists(after)], ["id", "before", "after"])

    return _rows_of(docs, want, "spots").mapInArrow(run, "id long, before array<long>, after array<long>")


def followed(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``(doc_id, h, first, end, before, after)`` of the lost runs; where they begin or end a stretch, with what surrounds the place that stays."""
    by = Window.partitionBy("doc_id", "h").orderBy("first")  # the runs of one text
    lost = runs.where("lost").select("doc_id", "h", "id", "first", F.lag("first").over(by).alias("p"), F.lead("first").over(by).alias("q"))
    lost = lost.select("doc_id", "h", "id", "first", F.expr(f"p is null or first > p + {RUN}").alias("head"), F.expr(f"q is null or q > first + {RUN}").alias("tail"))
    lost = written(lost)
    edge = lost.where("head or tail")
    stays = runs.where("not lost").join(edge.select("id").distinct(), "id").select("doc_id", "h", "id", "first")
    around = contexts(docs, stays)
    some = edge.join(around, "id", "left").select("doc_id", "h", "first", F.when(F.col("head"), F.col("before")).alias("before"), F.when(F.col("tail"), F.col("after")).alias("after"))
    rest = lost.where("not (head or tail)").select("doc_id", "h", "first", F.lit(None).cast("array<long>").alias("before"), F.lit(None).cast("array<long>").alias("after"))
    return some.unionByName(rest).select("doc_id", "h", "first", (F.col("first") + RUN).alias("end"), "before", "after")


def repeats(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, h, clusters)`` of every row with a shared paragraph, and ``(doc_id, h, first, end, before, after)`` of what rows lose."""
    rows = written(paragraphs(docs))
    near, runs = near_paragraphs(rows, docs, threshold), shared_runs(rows)
    clusters = near.select("doc_id", "h", F.col("comp").alias("c")).unionByName(runs.select("doc_id", "h", F.col("id").alias("c")))
    clusters = clusters.groupBy("doc_id", "h").agg(F.countDistinct("c").alias("clusters"))
    none = F.lit(None).cast("array<long>")
    lost = near.where("lost").select("doc_id", "h", "first", "end", none.alias("before"), none.alias("after")).unionByName(followed(docs, runs))
    return clusters, lost


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union, ascending."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def same(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the first on agree."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def cut(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, n_clusters, n_removed_words, spans, text)``: each text without what earlier ones hold.

    ``spans`` lists ``start:end`` in code points of the text before the cut; ``n_clusters``
    counts the clusters, with members in other rows, of the text's paragraphs.
    """
    clusters, lost = repeats(docs, threshold)
    lost = lost.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "end", "before", "after")).alias("lost"))
    found = clusters.join(lost.withColumnsRenamed({"doc_id": "d", "h": "t"}), (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    found = written(found.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "clusters", "lost"))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("h"), "text")
    may = may_contain(member_bits(found, "t"), F.col("h"))
    calm = mine.where(~may).select("doc_id", "text", F.lit(0).cast("long").alias("clusters"), F.lit(None).cast(found.schema["lost"].dataType).alias("lost"))
    touched = mine.where(may).join(found, (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "clusters", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out = []
                for doc, text, clusters, lost in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    text = text or ""
                    if not lost:
                        out.append((doc, len(text.split()), clusters or 0, 0, "", text))
                        continue
                    at = [m.span() for m in WORD.finditer(text)]
                    edges = any(x["before"] or x["after"] for x in lost)
                    h = words(text.lower().split()).view(np.int64) if edges else np.zeros(0, np.int64)
                    spans = []
                    for x in lost:
                        a, z = x["first"], x["end"]
                        more = same(h[max(0, a - EVERY) : a][::-1], np.array(x["before"], np.int64)) if x["before"] else 0
                        spans.append((a - more, z + (same(h[z : z + EVERY], np.array(x["after"], np.int64)) if x["after"] else 0)))
                    gone = merge(spans)
                    spans = [(at[a][0], at[z - 1][1]) for a, z in gone]
                    keep, here = [], 0
                    for a, z in spans:
                        keep.append(text[here:a])
                        here = z
                    out.append((doc, len(at), clusters, sum(z - a for a, z in gone), ",".join(f"{a}:{z}" for a, z in spans), "".join(keep) + text[here:]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_words", "n_clusters", "n_removed_words", "spans", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return calm.unionByName(touched).mapInArrow(run, "doc_id long, n_words long, n_clusters long, n_removed_words long, spans string, text string")
