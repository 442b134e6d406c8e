"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents longer than the capacity are cut into pieces; only a document's last piece can
be shorter. Pieces are dealt into blocks by hash, and each block is packed on its own:
longest first, into the open bin with the least room that still fits (successor search
over the residuals that occur). A bin carries a bitmap of its duplicate clusters and
``PER_SOURCE`` bitmaps of its sources; where they forbid a piece the search goes on to the
next bin and the next larger residual, until the tightest compatible bin is found or a
new one is opened. A block has about ``BLOCK`` pieces however large the input, so work and
memory of a task are bounded; a hot source or cluster spreads evenly over the blocks.

Nulls: a null text has length 0 and is packed like an empty one; null sources and clusters
never conflict. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
PER_SOURCE = 2
BLOCK = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece, given longest first. Sources and clusters are numbers, -1 for none."""
    wide = max(sources, default=-1) + 1
    at: dict[int, dict[int, None]] = {}  # bins by residual, oldest first
    levels = 0  # bitmap of the residuals that occur
    room, source_bits, cluster_bits, out = [], [], [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        cbit = 1 << c if c >= 0 else 0
        full = 1 << ((per_source - 1) * wide + s) if s >= 0 else 0
        found = -1
        left = levels >> size << size
        while left and found < 0:
            r = (left & -left).bit_length() - 1
            found = next((b for b in at[r] if not (cluster_bits[b] & cbit or source_bits[b] & full)), -1)
            left &= left - 1
        if found < 0:
            found = len(room)
            room.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
        else:
            del at[room[found]][found]
            if not at[room[found]]:
                levels &= ~(1 << room[found])
        room[found] -= size
        at.setdefault(room[found], {})[found] = None
        levels |= 1 << room[found]
        cluster_bits[found] |= cbit
        if s >= 0:
            layer = next(k for k in range(per_source) if not source_bits[found] >> (k * wide + s) & 1)
            source_bits[found] |= 1 << (layer * wide + s)
        out.append(found)
    return out


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, n_words, source, cluster)``: the pieces of every document, in words. Equal texts share a cluster."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    n = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(words).alias("cluster"), n.cast("int").alias("total"))
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * capacity
    size = F.least(F.col("total") - start, F.lit(capacity))
    return rows.select("doc_id", "piece", start.alias("start"), size.alias("n_words"), "source", F.when(F.col("total") > 0, F.col("cluster")).alias("cluster"))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, block: int = BLOCK) -> DataFrame:
    """``(bin_id, slot, offset, doc_id, piece, start, n_words)``: the place of every piece; offset counts words in the bin."""
    rows = pieces(docs, capacity)
    count = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(count)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
        source, cluster = pd.factorize(pdf["source"])[0], pd.factorize(pdf["cluster"])[0]
        again = pd.Series(cluster).map(pd.Series(cluster).value_counts()).to_numpy() > 1
        cluster = pd.factorize(pd.Series(cluster).where(again & (cluster >= 0)))[0]  # what occurs once needs no bit
        # pieces of one document share a cluster but may share a bin no more than its copies may
        bins = best_fit(pdf["n_words"].tolist(), source.tolist(), cluster.tolist(), capacity, per_source)
        out = pdf.assign(bin=bins)
        slot = out.groupby("bin").cumcount()
        offset = out.groupby("bin")["n_words"].cumsum() - out["n_words"]
        return pd.DataFrame({"bin_id": out["block"].astype("int64") * (1 << 32) + out["bin"], "slot": slot.astype("int32"), "offset": offset.astype("int32"), "doc_id": out["doc_id"], "piece": out["piece"], "start": out["start"], "n_words": out["n_words"]})

    return dealt.groupBy("block").applyInPandas(run, "bin_id long, slot int, offset int, doc_id long, piece int, start int, n_words int")
