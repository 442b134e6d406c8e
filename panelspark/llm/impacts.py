"""Ranked lexical search by a bit-sliced impact index.

``index`` turns every document into postings: tasks cut the rows they read into blocks of
``BLOCK`` documents, without a shuffle of texts, and write for each block a row with its
documents' ids and lengths, and a row for each term with the places and counts of its
occurrences. ``search`` takes from it the terms that the queries hold, weighs them by their
document frequencies, and deals (block, group of queries) to tasks. There every term's
impacts, exact integers, become bitmaps: one for each bit of the impact, a bit for each
document of the block. A query's scores are the sums of its terms' bitmaps, added slice by
slice with carries, for all queries of the group at once; its best k documents are found by
descending from the most significant slice of the sum: documents that have the bit go
ahead of those that don't, until k are left. The k best of each block meet in a window of k
rows a block. No scores of other documents are ever formed, and no task holds more than a
block and ``GROUP`` queries, on average.

A term is held by as many rows as there are blocks, so frequent terms are no hot keys. Null
texts, and texts without a term, have no terms and get no rows; a query without terms gets
none either. Repeated rows are documents of their own; equal scores go by doc_id, null ids
last. Query rows that repeat are answered each. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLOCK = 4096
#: A block ends early if its documents hold so many terms: memory stays bounded where texts are long.
TERMS = 4_000_000
GROUP = 128
#: Fixed values of the score: see ``impact``.
SCALE, FLAT, SLOPE = 1_000_000_000, 10, 90
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Maps every byte that is no part of a term to a space and A-Z to a-z; bytes of other scripts stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: letters, digits and whatever isn't ASCII; only A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of ``data`` that end at ``ends``, as one binary array."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


class _Block:
    """The documents of a block, and their terms by number of first occurrence."""

    def __init__(self):
        self.ids, self.sizes, self.codes = [], [], []
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms(text)
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.codes.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
        self.held += len(found)

    def rows(self, name: str) -> pa.RecordBatch:
        # places in order of doc_id, null ids last
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.concatenate([c * BLOCK + p for c, p in zip(self.codes, place, strict=True)])
        pairs, times = np.unique(pairs, return_counts=True)
        code, where = pairs // BLOCK, (pairs % BLOCK).astype(np.uint16)
        ends = np.searchsorted(code, np.arange(len(self.number)), side="right")
        n = len(self.number)
        columns = {
            "block": pa.array([name] * (n + 1)),
            "term": pa.array([None, *[t.decode() for t in self.number]], pa.string()),
            "places": pa.concat_arrays([pa.nulls(1, pa.binary()), _binary(where, ends)]),
            "times": pa.concat_arrays([pa.nulls(1, pa.binary()), _binary(times.astype(np.int32), ends)]),
            "ids": pa.concat_arrays([pa.array([[self.ids[i] for i in order if self.ids[i] is not None]], pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]),
            "sizes": pa.concat_arrays([pa.array([[self.sizes[i] for i in order]], pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]),
        }
        return pa.RecordBatch.from_pydict(columns)


def index(docs: DataFrame) -> DataFrame:
    """Postings of all documents as a table: ``(block, term, places, times, ids, sizes)``.

    A row without a term names the block's documents, those without an id last and left
    out, and the numbers of terms of all; other rows hold a term's places in the block (16
    bits each) and its counts there (32 bits each).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, block = TaskContext.get().partitionId(), count(), _Block()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                block.add(doc_id.as_py(), text.as_py())
                if len(block.ids) == BLOCK or block.held >= TERMS:
                    yield block.rows(f"{task}-{next(nth)}")
                    block = _Block()
        if block.ids:
            yield block.rows(f"{task}-{next(nth)}")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(cut, "block string, term string, places binary, times binary, ids array<long>, sizes array<long>"))


def impact(times: np.ndarray, sizes: np.ndarray, rows: int, total: int, weight: int) -> np.ndarray:
    """A term's share of the scores of documents of these sizes that hold it so many times."""
    times = times.astype(np.int64)
    return weight * ((SCALE * times) // (1000 * times + 8 * (FLAT + (SLOPE * sizes * rows) // total)))


def slices(values: np.ndarray, places: np.ndarray, depth: int, words: int) -> np.ndarray:
    """``(depth, words)`` bitmaps of the bits of values at ascending places."""
    bits = (values[:, None].astype(np.uint64) >> np.arange(depth, dtype=np.uint64)) & np.uint64(1)
    bits <<= (places & 63).astype(np.uint64)[:, None]
    word = places >> 6
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros((depth, words), np.uint64)
    out[:, word[starts]] = np.bitwise_or.reduceat(bits, starts, axis=0).T
    return out


def summed(maps: np.ndarray, which: list[np.ndarray]) -> np.ndarray:
    """``(depth, queries, words)``: for each query the sums of its terms' ``maps[term, bit]``, by bitwise carries. Queries go from most terms to fewest."""
    depth, words = maps.shape[1:]
    most = len(which[0])
    out = np.zeros((depth + most.bit_length(), len(which), words), np.uint64)
    for nth in range(most):
        own = np.array([w[nth] for w in which if len(w) > nth])
        acc = out[:, : len(own)]
        carry = np.zeros((len(own), words), np.uint64)
        for bit in range(len(acc)):
            if bit < depth:
                a, b = acc[bit].copy(), maps[own, bit]
                x = a ^ b
                acc[bit] = x ^ carry
                carry = (a & b) | (carry & x)
            else:
                a = acc[bit].copy()
                acc[bit] = a ^ carry
                carry &= a
                if not carry.any():
                    break
    return out


def best(sums: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its k largest sums above 0 and those sums; of equal ones the first places."""
    depth, queries, words = sums.shape
    ahead, level = np.zeros((queries, words), np.uint64), np.full((queries, words), ~np.uint64(0))
    any_bit = np.bitwise_or.reduce(sums, axis=0)
    level &= any_bit
    for bit in range(depth - 1, -1, -1):
        more = ahead | (level & sums[bit])
        n = np.bitwise_count(more).sum(axis=1)[:, None]
        # too many: only those with the bit stay in question; else they are all ahead of the rest
        ahead = np.where(n > k, ahead, more)
        level = np.where(n > k, level & sums[bit], level & ~sums[bit])
    out = []
    for q in range(queries):
        sure, tied = (np.flatnonzero(np.unpackbits(x[q].view(np.uint8), bitorder="little")) for x in (ahead, level))
        got = np.concatenate([sure, tied[: k - len(sure)]])
        bits = (sums[:, q, got >> 6] >> (got & 63).astype(np.uint64)) & np.uint64(1)
        out.append((got, (bits << np.arange(depth, dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)))
    return out


def search(postings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of the index for each row of ``queries(item_id, text)``."""
    head = postings.where("term is null").select("block", "ids", "sizes")
    n = head.agg(F.sum(F.size(F.filter("sizes", lambda x: x > 0))).cast("long"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    rows, total = int(n[0] or 0), int(n[1] or 0)
    held = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0)))
    asked = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col("item_id"), held.alias("terms")))
    groups = max(1, -(-asked.count() // GROUP))
    each = asked.select("query", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("part"), F.explode("terms").alias("term"))
    wanted = each.groupBy("term", "part").agg(F.collect_list("query").alias("queries"))
    hits = written(postings.select("block", "term", "places", "times").join(each.select("term").distinct(), "term"))
    df = hits.groupBy("term").agg(F.sum(F.length("places") / 2).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(rows) + 2) / (2 * F.col("df") + 1))).cast("long")
    found = hits.join(wanted.join(df.select("term", weight.alias("weight")), "term"), "term").where("weight > 0")
    found = found.select("block", "part", "weight", "places", "times", "queries")
    block = head.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "ids", "sizes")

    def rank(key, heads: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "doc_id": [], "score": []}).astype({"query": "int64", "doc_id": "Int64", "score": "int64"})
        if not len(found):
            return none
        ids, sizes = heads["ids"][0], np.asarray(heads["sizes"][0], np.int64)
        words = -(-len(sizes) // 64)
        by: dict[int, list[int]] = defaultdict(list)
        shares = []
        for nth, (weight, places, times, own) in enumerate(zip(found["weight"], found["places"], found["times"], found["queries"], strict=True)):
            at = np.frombuffer(places, np.uint16).astype(np.int64)
            shares.append((impact(np.frombuffer(times, np.int32), sizes[at], rows, total, weight), at))
            for q in own:
                by[q].append(nth)
        depth = max(int(v.max()).bit_length() for v, _ in shares)
        maps = np.stack([slices(v, at, depth, words) for v, at in shares])
        order = sorted(by, key=lambda q: -len(by[q]))
        got = best(summed(maps, [np.array(by[q]) for q in order]), k)
        parts = [pd.DataFrame({"query": q, "doc_id": pd.array([ids[p] if p < len(ids) else None for p in at], "Int64"), "score": score}) for q, (at, score) in zip(order, got, strict=True) if len(at)]
        return pd.concat(parts) if parts else none

    top = block.groupBy("block", "part").cogroup(found.groupBy("block", "part")).applyInPandas(rank, "query long, doc_id long, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
