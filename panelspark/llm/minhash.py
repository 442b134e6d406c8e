"""Near-duplicate documents by DartMinHash and banded joining.

Texts are weighted sets of five-word shingles (lower-cased, split at white space); a
shingle weighs as often as it occurs. Signatures come from ``hashing.darts``; 16 bands of
4 coordinates meet sets of weighted similarity 0.8 with a chance of 0.9998. Equal sets
collapse first, so copies cost no pairs; ``common.linked`` verifies the exact weighted
Jaccard similarity of the rest (the n-th occurrence of a shingle is an element of its own,
which makes it a plain one), and components give the classes.

Nulls: a null text counts as empty; texts without words are copies of one another.
Texts under five words are one shingle. Rows may repeat: each gets its class. A row is
known by its doc_id and its text, so rows that share a doc_id, or have none, stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import linked, may_contain, member_bits, written
from .hashing import BASE, Grams, Words, bands, darts, mix

THRESHOLD = 0.8
ROWS, BANDS = 4, 16
SHINGLE = 5
EMPTY = 0


def digest(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else EMPTY


def weighted(words: np.ndarray, grams: Grams, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The k-word shingles, ascending, and how often each occurs; a shorter text is one shingle, an empty one has none."""
    return np.unique(grams(words, min(k, len(words))), return_counts=True) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def occurrences(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A plain set for a weighted one: the shingles, and a new element for every further occurrence; ascending."""
    if not len(counts) or counts.max() == 1:
        return shingles
    again = np.repeat(shingles, counts - 1)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(counts - 1) - (counts - 1), counts - 1) + 1
    with np.errstate(over="ignore"):
        return np.unique(np.concatenate([shingles, mix(again + nth.astype(np.uint64) * BASE)]))


def _sets(texts: list[str | None], words: Words, grams: Grams) -> list[tuple[np.ndarray, np.ndarray]]:
    return [weighted(words((t or "").lower().split()), grams) for t in texts]


def lists(values: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *[np.asarray(v).view(np.int64) for v in values]])))


def row_hash(text: Column) -> Column:
    """What tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, id, n, keys)``: each text's set by name, its size and its band keys; h is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Words(), Grams()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                sets = _sets(part.column(2).to_pylist(), words, grams)
                el, w = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint64, np.int64), zip(*sets, strict=True), strict=True))
                own = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
                keys = bands(darts(el, w.astype(np.float64), own, len(sets), ROWS * BANDS), ROWS)
                names = [digest(occurrences(*s)) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.int64()), pa.array([int(c.sum()) for _, c in sets], pa.int32()), lists(list(keys))], ["doc_id", "h", "id", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("h"), "text").mapInArrow(run, "doc_id long, h long, id long, n int, keys array<long>")


def text_sets(docs: DataFrame) -> DataFrame:
    """``(id, grams)`` for rows ``(want, text)``: the elements of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Words(), Grams()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), lists([occurrences(*s) for s in _sets(part.column(1).to_pylist(), words, grams)])], ["id", "grams"])

    return docs.mapInArrow(run, "id long, grams array<long>")


def _first() -> Column:
    """Of rows, the one with the least doc_id, then text; null ids come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h")))


def _classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``rows(doc_id, h, id, n)`` of every row, and ``(id, comp, copy, first)``: each set's class, the first rows of the set and of the class."""
    rows = written(sketch(docs))
    reps = written(rows.groupBy("id").agg(_first().alias("copy"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    buckets = reps.where("n > 0").select(F.explode("keys").alias("key"), "id")

    def sets(ids: DataFrame) -> DataFrame:
        want = written(reps.join(ids, "id", "left_semi").select(F.col("id").alias("want"), F.col("copy.doc_id").alias("d"), F.col("copy.h").alias("hh")))
        here = docs.select("doc_id", row_hash(F.col("text")).alias("h"), "text").where(may_contain(member_bits(want, "hh"), F.col("h")))
        found = here.join(want, (F.col("h") == F.col("hh")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("want", "text")
        return text_sets(found).dropDuplicates(["id"])

    comp = reps.select("id", "copy").join(linked(buckets, sets, threshold).withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    first = comp.groupBy("comp").agg(F.min("copy").alias("first"))
    return rows.select("doc_id", "h", "id", "n"), written(comp.join(first, "comp").select("id", "comp", "copy", "first"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, copy_of, n_shingles, class_name)`` of every row.

    class_id is the least doc_id of its near-duplicate class, copy_of of the rows with an
    equal set; class_name also tells apart classes whose rows have no doc_id.
    """
    rows, named = _classed(docs, threshold)
    named = named.select("id", F.col("first.doc_id").alias("class_id"), F.col("copy.doc_id").alias("copy_of"), F.col("comp").alias("class_name"))
    return rows.join(named, "id").select("doc_id", "class_id", "copy_of", F.col("n").alias("n_shingles"), "class_name")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id, then text; of equal rows of these, any.

    Rows that the membership bits show to be neither lost nor repeated pass by without a shuffle.
    """
    rows, named = _classed(docs, threshold)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    rows = rows.join(named.select("id", "first"), "id").groupBy("doc_id", "h").agg(F.count("*").alias("k"), F.max(same).alias("stays"))
    touched = written(rows.where("k > 1 or not stays").select(F.col("doc_id").alias("__d"), F.col("h").alias("__k"), F.col("stays").alias("__stays")))
    mine = docs.withColumn("__h", row_hash(F.col("text")))
    may = may_contain(member_bits(touched, "__k"), F.col("__h"))
    calm = mine.where(~may).select(*docs.columns)
    left = mine.where(may).join(touched, (F.col("__h") == F.col("__k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left")
    alone = left.where("__stays is null").select(*docs.columns)
    once = left.where("__stays").groupBy("__d", "__k").agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return calm.unionByName(alone).unionByName(once)
