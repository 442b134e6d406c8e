"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Every common word (anchor) starts a chain of the next ``CHAIN`` content words; the set
of hashed chains is the fingerprint, written as fixed-width hex in ascending order. A
text without any chain chains from every word instead (and a text of fewer words than
a chain hashes its words as they are), so that only a text without words has the empty
fingerprint. Two empty fingerprints are alike (1), an empty and a
filled one are not (0).

``near_classes`` partitions fingerprints by set length, so that only lengths that can
reach the threshold meet, and prunes the Jaccard comparison by the same bound.

Nulls: a null text is empty; null ids come first and follow one another by text. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import linked, prefixes, written

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "als auf aus das dem den der des die ein eine er es im in ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "al con de del el en es la las lo los no para por que se su un una y".split()
)
CHAIN = 2
WORD = re.compile(r"\w+")


def _h(words: tuple[str, ...]) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(words).encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


def signatures(text: str | None) -> set[int]:
    """The set of hashed chains of ``text``."""
    words = WORD.findall((text or "").lower())
    content = [w not in ANCHORS for w in words]
    out, ahead = set(), []
    for i in range(len(words) - 1, -1, -1):  # from the end: `ahead` holds the next content words, nearest first
        if content[i]:
            ahead = [words[i], *ahead[: CHAIN - 1]]
        elif len(ahead) == CHAIN:
            out.add((words[i], *ahead))
    if not out:
        n = min(CHAIN + 1, len(words))
        out = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        if not out and text and text.strip():
            out = {(" ".join(text.split()),)}
    return {_h(x) for x in out}


def fingerprint(sigs: set[int]) -> str:
    return "".join(f"{x:012x}" for x in sorted(sigs))


def jaccard(a: set[int], b: set[int], least: float = 0.0) -> float:
    """Their Jaccard similarity; 0 without comparing where their sizes rule out ``least``."""
    if not a or not b:
        return float(not a and not b)
    lo, hi = sorted((len(a), len(b)))
    if lo < least * hi:
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def blocks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt into runs of ascending ids, each with the first rows of the next run.

    Boundaries come from quantiles of the ids, so no task orders all of them. Adds
    ``part`` and ``extra`` (true for the row that belongs to the run after it).
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = sorted({float(x) for x in ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    part = F.lit(0)
    if cuts:
        edges = F.array(*map(F.lit, cuts))
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda x: x < F.col("doc_id"))))
    # one row a run, `shuffle.partitions` at most: where the run after each begins
    firsts = sorted((r["part"], r["low"]) for r in ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("low")).collect())
    dealt = docs.withColumn("part", part).withColumn("extra", F.lit(False))
    if not firsts:
        return dealt
    pairs = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))] if len(firsts) > 1 else []
    if pairs:  # the first run's first row goes to the last run too: after the last document comes the first
        to = spark.createDataFrame(pairs, "low long, part int")
        heads = docs.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("low"))).select(*docs.columns, "part", F.lit(True).alias("extra"))
        dealt = dealt.select(*docs.columns, F.col("part").cast("int"), "extra").unionByName(heads)
    return dealt.select(*docs.columns, F.col("part").cast("int").alias("part"), "extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see the query's contract.

    Rows come in ascending ``doc_id`` (nulls first), then text; a repeated id keeps a row
    for each of its rows, and a lone document follows itself.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.repartitionById(n, "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in b.slice(k, 64).columns), strict=True)

        out: list[tuple] = []
        first = held = None  # the run's first row; the row that waits for the one after it

        def close(row: tuple, nxt: tuple) -> tuple:
            doc, text, sigs = row
            k = len(text) // 4
            edited = text[: len(text) - k] + nxt[1][:k]
            es = signatures(edited)
            return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(sigs), fingerprint(es), jaccard(sigs, es), jaccard(sigs, nxt[2])

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        at = None
        for doc, text, part, extra in each():
            if part != at:
                if held is not None:
                    out.append(close(held, first))
                at, first, held = part, None, None
            if extra and held is None:
                continue  # its run's rows are closed already
            row = (doc, text, signatures(text))
            if held is not None:
                out.append(close(held, row))
            first = first or row
            held = None if extra else row
            if len(out) >= 256:
                yield batch()
                out = []
        if held is not None:
            out.append(close(held, first))
        if out:
            yield batch()

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, class_id)``: classes of documents whose fingerprints are alike by ``threshold`` or more.

    Fingerprints are dealt into length classes whose bounds grow by 1/threshold: a set
    meets its own class and the next only, and there only on the rarest signatures of
    its prefix; the length bound prunes before sets are compared (``common.linked``).
    Equal fingerprints collapse first. class_id is the least doc_id of the class.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(signatures(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sets, "doc_id long, sigs array<long>").withColumn("id", F.xxhash64("sigs")))
    reps = rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("sigs").alias("grams"))
    reps = written(reps)
    near = prefixes(reps.where(F.size("grams") > 0).select("id", "grams"), threshold)
    size = F.floor(F.log("n") / float(-np.log(threshold)))
    keys = near.select("id", "g", F.explode(F.array(size, size + 1)).alias("size")).select(F.xxhash64("g", "size").alias("key"), "id")
    comp = linked(written(keys.distinct()), lambda ids: reps.join(ids, "id", "left_semi").select("id", "grams"), threshold)
    comp = reps.select("id", "doc_id").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = comp.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return rows.select("doc_id", "id").join(comp.select("id", "comp"), "id").join(least, "comp").select("doc_id", "class_id")
