"""How a candidate's text overlaps a paper's: TF-IDF fitted on the two texts alone, shared words, and the chain of fallbacks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import vocabulary as V

#: The idf of a term that one text of two holds; a shared term has 1.
ALONE = math.log(3 / 2) + 1


def gram_counts(docs: DataFrame, stop: list[str] = V.STOPWORDS) -> DataFrame:
    """``(id, term, tf)``: words of two characters or more that aren't stop words, and adjacent pairs of what is left; a null text has none."""
    words = T.tokens(F.col("text"), r"[\p{L}\p{N}_]{2,}", stop, distinct=False)
    grams = F.concat(F.col("w"), T.ngrams(F.col("w"), 2))
    rows = docs.select("id", words.alias("w")).select("id", F.explode(grams).alias("term"))
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def pair_tfidf(pairs: DataFrame, papers: DataFrame, reviewers: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(paper_id, reviewer_id, cosine)`` of every pair, and ``(paper_id, reviewer_id, term, weight, place)``, the paper's ``top`` terms.

    A fit on two texts gives a shared term the weight tf and any other tf times ``ALONE``, so
    both norms follow from a text's own sum of squares and the shared terms: no vocabulary
    is fitted. A reviewer's terms travel to each of its papers as one row of 64-bit hashes,
    and a paper's pairs are compared in one group: no term of a pair is a row. Pairs without
    a shared term have the cosine 0. Ties of terms go by name.
    """
    pairs = pairs.select("paper_id", "reviewer_id").distinct()
    number = F.transform("x", lambda x: F.xxhash64(x["term"])).alias("h")
    gathered = lambda counts: counts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("x")).select("id", number, F.transform("x", lambda x: x["tf"]).alias("tf"), "x")
    asked = pairs.join(gathered(reviewers).select(F.col("id").alias("reviewer_id"), F.col("h").alias("h"), F.col("tf").alias("tf")), "reviewer_id", "left")
    own = gathered(papers).select(F.col("id").alias("paper"), "h", "tf", F.transform("x", lambda x: x["term"]).alias("terms"))
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("paper_id", "reviewer_id")]
    kind = f"paper_id {kinds[0]}, reviewer_id {kinds[1]}, cosine double, best array<struct<term:string,weight:double,place:int>>"
    both = asked.groupBy("paper_id").cogroup(own.groupBy("paper")).applyInArrow(lambda a, b: _met(a, b, top), kind).persist()  # a row a pair
    best = both.select("paper_id", "reviewer_id", F.inline("best"))
    return both.select("paper_id", "reviewer_id", "cosine"), best


def _met(asked: pa.Table, own: pa.Table, top: int) -> pa.Table:
    """A paper's pairs: their cosines and best terms. The paper's terms are in order, so equal weights go by name."""
    n = asked.num_rows
    cosine, best = np.zeros(n), [[] for _ in range(n)]
    if n and own.num_rows:
        terms = own["terms"][0].as_py()
        h, p = (np.array(own[c][0].as_py(), np.int64) for c in ("h", "tf"))
        order = np.argsort(h)
        for i, (theirs, tf) in enumerate(zip(asked["h"], asked["tf"], strict=True)):
            r = np.zeros(len(h), np.int64)
            square = 0
            if theirs.is_valid:
                hr, tr = theirs.values.to_numpy(), tf.values.to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(h[order], hr), len(h) - 1)
                there = h[order][at] == hr
                r[order[at[there]]] = tr[there]
                square = int((tr * tr).sum())
            weight = p * np.where(r > 0, 1.0, ALONE)
            first = np.argsort(-np.round(weight, 9), kind="stable")[:top]
            best[i] = [{"term": terms[j], "weight": float(weight[j]), "place": k + 1} for k, j in enumerate(first)]
            if r.any():
                shared = r > 0
                norm = lambda sq, x: math.sqrt(ALONE * ALONE * sq - (ALONE * ALONE - 1) * int((x[shared] ** 2).sum()))
                cosine[i] = int((p * r).sum()) / (norm(int((p * p).sum()), p) * norm(square, r))
    kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64()), ("place", pa.int32())]))
    return pa.table([asked["paper_id"], asked["reviewer_id"], pa.array(cosine), pa.array(best, kind)], ["paper_id", "reviewer_id", "cosine", "best"])


def long_words(docs: DataFrame, longer: int = 4) -> DataFrame:
    """``(id, words)``: the distinct lower-case words between white space that have more than so many characters."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.length(w) > longer)
    return docs.select("id", F.array_distinct(words).alias("words"))


def shared_words(p: Column, r: Column, most: int = 3) -> Column:
    """The first words by name that both arrays hold."""
    return F.slice(F.array_sort(F.array_intersect(p, r)), 1, most)


def semantic_overlap(embedding: Column, tfidf: Column) -> Column:
    """The cosine of the embeddings, else of the words, else 0."""
    return F.coalesce(embedding, tfidf, F.lit(0.0))


def distinct_terms(best: DataFrame, most: int = 3) -> DataFrame:
    """M27's terms: ``(paper_id, reviewer_id, terms)`` of M20's best ones, longest first, each only if it shares no word with one taken before; ``most`` of them.

    At most ``top`` terms a pair are folded, in the order of words downwards, characters downwards, name.
    """
    key = F.struct((-F.size(F.split("term", " "))).alias("words"), (-F.length("term")).alias("chars"), F.col("term"))
    lists = best.groupBy("paper_id", "reviewer_id").agg(F.sort_array(F.collect_list(key)).alias("x"))  # top terms of a pair
    none = F.array().cast("array<string>")
    clash = lambda taken, t: F.exists(taken, lambda u: F.arrays_overlap(F.split(u, " "), F.split(t, " ")))
    kept = F.aggregate(lists["x"], none, lambda taken, t: F.when(clash(taken, t["term"]), taken).otherwise(F.concat(taken, F.array(t["term"]))))
    return lists.select("paper_id", "reviewer_id", F.slice(kept, 1, most).alias("terms"))


def matched_terms(p: Column, r: Column) -> Column:
    """M25 for a candidate pair's two arrays of key terms (some twenty each): the paper's terms of four characters or more that equal one of the reviewer's, stand in it as whole words, or open with the same word."""
    plain = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))
    opening = lambda x: F.element_at(F.split(x, " "), 1)
    alike = lambda a, b: (a == b) | (opening(a) == opening(b)) | (F.contains(b, a) & F.contains(plain(b), plain(a)))
    return F.filter(p, lambda a: (F.length(a) >= 4) & F.exists(r, lambda b: alike(a, b)))


def topic_chain(rows: DataFrame, floor: float = 0.2) -> DataFrame:
    """``(paper_id, reviewer_id, score, semantic, source)`` from the candidate pairs with n_terms, hits, prefetched, cosine and tfidf.

    The share of the paper's key terms that match; without a match half the prefetched
    similarity, or else half the semantic overlap, if above ``floor``. A paper without key terms gives 0.
    """
    n, hits = F.coalesce("n_terms", F.lit(0)), F.coalesce("hits", F.lit(0))
    far = F.col("prefetched").isNotNull()
    semantic = F.when(far, F.col("prefetched")).otherwise(semantic_overlap(F.col("cosine"), F.col("tfidf")))
    source = F.when(n == 0, "none").when(hits > 0, "terms").when(far, "prefetched").otherwise("semantic")
    score = F.when(source == "none", 0.0).when(source == "terms", hits / n).when(semantic > floor, semantic * 0.5).otherwise(0.0)
    shown = F.when(source.isin("none", "terms"), 0.0).otherwise(semantic)
    return rows.select("paper_id", "reviewer_id", score.alias("score"), shown.alias("semantic"), source.alias("source"))
