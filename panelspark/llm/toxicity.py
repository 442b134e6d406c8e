"""Toxicity by a factorization machine over hashed terms.

A document is the bag of its lower-cased words and of the heads of its longer words,
hashed into buckets. The machine scores ``w0 + w.x + sum_{i<j} <v_i, v_j> x_i x_j``, so
it also learns pairs of terms that matter only together. It is fitted by AdaGrad on a
bounded sample of labelled rows (``SAMPLE`` rows in hash order) on the driver; what the
executors get is the weights of ``TELLING + FREQUENT`` buckets at most.

Nulls: a null text counts as empty and gets the score of the bias; a null ``doc_id`` is
never learnt from. Repeated label rows of a document count once, toxic if any says so;
of rows that share a doc_id the first by text is learnt from. Empty documents give an
empty result. Without any label of one of the classes, every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows learnt from at most: the fit's bound, in hash order of doc_id.
SAMPLE = 12_000
BUCKETS = 1 << 20
#: Different terms learnt from at most in one sampled row, the first ones: with SAMPLE, the bound of what the driver gets.
TERMS = 4_000
#: Buckets that the machine keeps: those whose presence tells most about the label, and the most frequent ones,
#: whose presence may tell nothing by itself but something in a pair.
TELLING, FREQUENT = 1 << 12, 1 << 8
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bag(text: str | None, seen: dict[str, tuple[int, ...]]) -> dict[int, int]:
    """Counts by bucket. ``seen`` keeps the buckets of words met before; it is emptied when large."""
    if len(seen) > 100_000:
        seen.clear()
    out: dict[int, int] = {}
    counts: dict[str, int] = {}
    for w in WORD.findall((text or "").lower()):
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        at = seen.get(w)
        if at is None:
            terms = [w] + ([f"{w[:6]}-"] if len(w) > 6 else []) + ([f"{w[:5]}-"] if len(w) > 5 else [])
            at = seen[w] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in terms)
        for b in at:
            out[b] = out.get(b, 0) + n
    return out


class Machine:
    """The fitted machine: bias, and by kept bucket a weight and a vector."""

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors
        self.at = {int(b): i for i, b in enumerate(buckets)}

    def rows(self, bags: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bags as rows: places of the first entries, columns, values."""
        cols, values, starts = [], [], [0]
        for b in bags:
            for k, n in b.items():
                if (i := self.at.get(k)) is not None:
                    cols.append(i)
                    values.append(n)
            starts.append(len(cols))
        return np.array(starts), np.array(cols, dtype=np.int64), np.log1p(np.array(values, dtype=np.float64))

    def margin(self, starts: np.ndarray, cols: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's score before the sigmoid, and its sums of vectors."""
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        n = len(starts) - 1
        xv = x[:, None] * self.vectors[cols]
        sums = np.stack([np.bincount(row, xv[:, f], n) for f in range(xv.shape[1])], 1)
        square = np.bincount(row, (xv * xv).sum(1), n)
        return self.bias + np.bincount(row, x * self.weights[cols], n) + ((sums * sums).sum(1) - square) / 2, sums

    def score(self, bags: list[dict[int, int]]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(bags))[0], -35, 35)))


def packed(bags: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags as arrays: places of the first entries, buckets, counts."""
    size = [len(b) for b in bags]
    flat = lambda values: np.fromiter((x for b in bags for x in values(b)), np.int32, sum(size))
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), flat(dict.keys), flat(dict.values)


def choose(starts: np.ndarray, ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The buckets whose presence shifts the share of the label most, in standard errors, and the most frequent others; ties by bucket."""
    lab = np.repeat(y.astype(np.float32), np.diff(starts))
    df, pos = np.bincount(ids, minlength=BUCKETS), np.bincount(ids, lab, BUCKETS)
    keys = np.flatnonzero(df >= 3)
    df, pos, p = df[keys], pos[keys], y.mean()
    z = np.abs(pos - df * p) / np.sqrt(df * p * (1 - p) * np.maximum(1 - df / len(y), 1e-3) + 0.5)
    order = np.lexsort((keys, -z))
    rest = order[TELLING:]
    return np.sort(keys[np.concatenate([order[:TELLING], rest[np.lexsort((keys[rest], -df[rest]))[:FREQUENT]]])])


def fit(bags: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, factors: int = 6, epochs: int = 20, rate: float = 0.15, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Machine:
    """The machine fitted to ``packed`` bags with labels ``y`` of 0 and 1, by AdaGrad in small batches; the same on every run."""
    if not len(y) or y.min() == y.max():
        return Machine(-35.0, np.zeros(0), np.zeros(0), np.zeros((0, factors)))
    rng = np.random.default_rng(seed)
    starts, ids, counts = bags
    kept = choose(starts, ids, y)
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), kept, np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), factors)))
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    use = place[ids] >= 0
    cols, x = place[ids[use]], np.log1p(counts[use].astype(np.float32))
    starts = np.concatenate([[0], np.cumsum(use)])[starts]
    gw, gv, gb = np.full(len(kept), 1e-2), np.full((len(kept), factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            size = starts[take + 1] - starts[take]
            inner = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in take])
            c, v = cols[inner], x[inner].astype(np.float64)
            st = np.concatenate([[0], np.cumsum(size)])
            margin, sums = m.margin(st, c, v)
            err = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y[take]) / len(take)
            row = np.repeat(np.arange(len(take)), size)
            e = err[row] * v
            dw = np.bincount(c, e, len(kept)) + decay * m.weights / 10
            pair = e[:, None] * (sums[row] - v[:, None] * m.vectors[c])
            dv = np.stack([np.bincount(c, pair[:, f], len(kept)) for f in range(factors)], 1) + decay * m.vectors
            gw += dw * dw
            gv += dv * dv
            gb += err.sum() ** 2
            m.weights -= rate * dw / np.sqrt(gw)
            m.vectors -= rate / 2 * dv / np.sqrt(gv)
            m.bias -= rate * err.sum() / np.sqrt(gb)
    return m


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine learnt from the labelled rows of ``docs`` that are not held out, ``sample`` at most."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers: the bound of what is sent to all executors
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                got = [list(bag(t, seen).items())[:TERMS] for t in part.column(1).to_pylist()]
                ids = [np.array([k for k, _ in x], "<i4").tobytes() for x in got]
                counts = [np.minimum([n for _, n in x], 255).astype(np.uint8).tobytes() for x in got]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "buckets", "counts"])

    got = rows.mapInArrow(bags, "doc_id string, toxic int, buckets binary, counts binary").orderBy("doc_id").toArrow()
    size = pa.compute.binary_length(got.column("counts")).to_numpy().astype(np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    ids, counts = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.uint8)
    for i, (a, b) in enumerate(zip(got.column("buckets"), got.column("counts"), strict=True)):
        ids[starts[i] : starts[i + 1]] = np.frombuffer(a.as_buffer(), "<i4")
        counts[starts[i] : starts[i + 1]] = np.frombuffer(b.as_buffer(), np.uint8)
    toxic = got.column("toxic").to_numpy().astype(np.float64)
    del got
    return fit((starts, ids, counts), toxic)


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the likelihood, 0 to 1, that its label is 1."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                got = machine.score([bag(t, seen) for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], schema=pa.schema([*part.schema, pa.field(out, pa.float64())]))

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    got = score(docs.select("doc_id", "text"), learn(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score THRESHOLD or more."""
    return score(docs, learn(docs, labels), out="__score").where(F.col("__score") < THRESHOLD).select(*docs.columns)
