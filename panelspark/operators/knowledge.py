"""Lexical models, topics and the typed graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .keyterms import normal_forms


def term_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(id, term, tf)`` of ``docs(id, ...)``."""
    return docs.select("id", F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Scores of term counts ``(id, term, tf)`` against query counts, by a join on the term."""
    size = docs.groupBy("id").agg(F.sum("tf").alias("len"))
    stats = size.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = docs.groupBy("term").agg(F.count("*").alias("df"))
    q = queries.select(F.col("id").alias("paper_id"), "term", F.col("tf").alias("qtf"))
    rows = docs.join(q, "term").join(df, "term").join(size, "id").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg"))) * F.col("qtf")
    return rows.groupBy("paper_id", F.col("id").alias("reviewer_id")).agg(F.sum(part).alias("score"))


def tfidf(counts: DataFrame) -> DataFrame:
    """Unit-length TF-IDF weights ``(id, term, w)``, idf = ln((1 + n) / (1 + df)) + 1."""
    n = counts.select("id").distinct().agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    rows = counts.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def sparse_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """The inner product of two weight tables, by a join on the term."""
    x, y = a.select(F.col("id").alias("paper_id"), "term", F.col("w").alias("x")), b.select(F.col("id").alias("reviewer_id"), "term", F.col("w").alias("y"))
    return x.join(y, "term").groupBy("paper_id", "reviewer_id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def keyphrases(docs: DataFrame, k: int) -> DataFrame:
    """The k most frequent clean words of ``docs(id, text)``; ties by first place, then the word."""
    words = docs.select("id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("pos", "w"))
    words = words.where((F.length("w") > 3) & ~F.col("w").isin(*T.STOPWORDS))
    # counted as they stand first: a word is normalised once a document
    once = words.groupBy("id", "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    clean = once.select("id", "n", "first", F.element_at(normal_forms(F.array("w"), T.SYNONYMS), 1).alias("term")).where((F.length("term") > 3) & ~F.col("term").isin(*T.GENERIC))
    top = clean.groupBy("id", "term").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first", "term"))
    return top.withColumn("rank", order).where(F.col("rank") <= k)


def topics(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The vocabulary's terms that stand as whole words in ``docs(id, text)``: what its n-grams share with the vocabulary."""
    longest = max(len(v.split()) for v in vocabulary)
    words = T.tokens(F.col("text"), "[a-z0-9]+", distinct=False)
    grams = F.flatten(F.array(*[T.ngrams(F.col("w"), n) for n in range(1, longest + 1)]))
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)), grams)  # a text's topics at most leave the row
    return docs.select("id", words.alias("w")).select("id", F.explode(found).alias("topic"))


def topic_weights(labels: DataFrame, extra: DataFrame | None = None, weight: float = 0.3) -> DataFrame:
    """Counts as shares, plus ``weight`` for each extra topic, scaled to sum 1."""
    total = F.sum("n").over(Window.partitionBy("id"))
    rows = labels.groupBy("id", "topic").agg(F.count("*").alias("n")).select("id", "topic", (F.col("n") / total).alias("w"))
    if extra is not None:
        rows = rows.unionByName(extra.select("id", "topic").distinct().withColumn("w", F.lit(weight)))
        rows = rows.groupBy("id", "topic").agg(F.sum("w").alias("w"))
        rows = rows.select("id", "topic", (F.col("w") / F.sum("w").over(Window.partitionBy("id"))).alias("w"))
    return rows


def topic_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The histogram intersection of the pairs that share a topic."""
    x, y = a.select(F.col("id").alias("paper_id"), "topic", F.col("w").alias("x")), b.select(F.col("id").alias("reviewer_id"), "topic", F.col("w").alias("y"))
    return x.join(y, "topic").groupBy("paper_id", "reviewer_id").agg(F.sum(F.least("x", "y")).alias("score"))


def edges(parts: list[DataFrame]) -> DataFrame:
    """Undirected typed edges ``(src, dst, type, weight)`` merged: the largest weight, the sorted types."""
    rows = None
    for p in parts:
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def overlap_score(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """Shared neighbours, and the paper's neighbours that a neighbour of the reviewer knows, from edge self-joins."""
    n = both_ways(e)
    deg = n.groupBy("src").agg(F.count("*").alias("deg"))
    p = pairs.select("paper_id", "reviewer_id").join(n.select(F.col("src").alias("paper_id"), F.col("dst").alias("x")), "paper_id")
    r = n.select(F.col("src").alias("reviewer_id"), F.col("dst").alias("y"))
    direct = p.join(r.withColumnRenamed("y", "x"), ["reviewer_id", "x"]).groupBy("paper_id", "reviewer_id").agg(F.count("*").alias("direct"))
    step = n.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    bridge = p.join(step, "x").join(r, ["reviewer_id", "y"]).groupBy("paper_id", "reviewer_id").agg(F.countDistinct("x").alias("bridge"))
    rows = pairs.select("paper_id", "reviewer_id").join(direct, ["paper_id", "reviewer_id"], "left").join(bridge, ["paper_id", "reviewer_id"], "left").na.fill(0, ["direct", "bridge"])
    rows = rows.join(deg.withColumnRenamed("src", "paper_id"), "paper_id", "left").na.fill(0, ["deg"])
    score = F.least(F.lit(1.0), (F.col("direct") + 0.35 * F.col("bridge")) / F.greatest(F.lit(3), F.col("deg")))
    return rows.select("paper_id", "reviewer_id", "direct", "bridge", score.alias("score"), F.least(F.lit(1.0), (F.col("direct") + F.col("bridge")) / 8).alias("confidence"))


def path_counts(pairs: DataFrame, e: DataFrame, limit: int = 100) -> DataFrame:
    """An edge and each common neighbour count, and so does every simple path of up to three steps, ``limit`` in all."""
    n = both_ways(e).distinct()
    p = pairs.select("paper_id", "reviewer_id")
    edge = p.join(n.select(F.col("src").alias("paper_id"), F.col("dst").alias("reviewer_id")), ["paper_id", "reviewer_id"]).withColumn("k", F.lit(2))
    first = p.join(n.select(F.col("src").alias("paper_id"), F.col("dst").alias("x")), "paper_id").where("x <> reviewer_id")
    last = n.select(F.col("src").alias("reviewer_id"), F.col("dst").alias("y"))
    two = first.join(last.withColumnRenamed("y", "x"), ["reviewer_id", "x"]).select("paper_id", "reviewer_id", F.lit(2).alias("k"))
    three = first.join(n.select(F.col("src").alias("x"), F.col("dst").alias("y")), "x").where("y <> paper_id").join(last, ["reviewer_id", "y"]).select("paper_id", "reviewer_id", F.lit(1).alias("k"))
    total = edge.unionByName(two).unionByName(three).groupBy("paper_id", "reviewer_id").agg(F.sum("k").alias("paths"))
    return p.join(total, ["paper_id", "reviewer_id"], "left").select("paper_id", "reviewer_id", F.least(F.coalesce("paths", F.lit(0)), F.lit(limit)).cast("long").alias("paths"))


def path_confidence(paths: Column) -> Column:
    """G16."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(paths) / 5))


def feature_weights(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Unit-length features ``(id, term, w)`` of ``nodes(id)``: the node and its neighbours weigh 1, nodes two steps away 0.5."""
    n = both_ways(e).distinct()
    near = nodes.join(n.withColumnRenamed("src", "id"), "id").withColumnRenamed("dst", "x")
    far = near.join(n.select(F.col("src").alias("x"), "dst"), "x").select("id", F.col("dst").alias("term")).distinct().withColumn("w", F.lit(0.5))
    rows = nodes.select("id", F.col("id").alias("term"), F.lit(1.0).alias("w")).unionByName(near.select("id", F.col("x").alias("term"), F.lit(1.0).alias("w"))).unionByName(far)
    rows = rows.groupBy("id", "term").agg(F.max("w").alias("w"))
    return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


def citation_weighted(papers: DataFrame, publications: DataFrame, most: int = 20) -> DataFrame:
    """The mean of Jaccard over a reviewer's first ``most`` publications ``(reviewer_id, pub_id, tokens, citations)``, weighted by log citations."""
    w = F.greatest(F.log1p("citations"), F.lit(1.0))
    nth = F.row_number().over(Window.partitionBy("reviewer_id").orderBy("pub_id"))
    pubs = publications.withColumn("nth", nth).where((F.col("nth") <= most) & (F.size("tokens") > 0)).withColumn("w", w)
    total = pubs.groupBy("reviewer_id").agg(F.sum("w").alias("total"))
    p = papers.select("paper_id", F.size("tokens").alias("np"), F.explode("tokens").alias("t"))
    r = pubs.select("reviewer_id", "pub_id", "w", F.size("tokens").alias("nr"), F.explode("tokens").alias("t"))
    both = p.join(r, "t").groupBy("paper_id", "reviewer_id", "pub_id", "w", "np", "nr").agg(F.count("*").alias("b"))
    j = F.col("b") / (F.col("np") + F.col("nr") - F.col("b"))
    return both.groupBy("paper_id", "reviewer_id").agg(F.sum(j * F.col("w")).alias("s")).join(total, "reviewer_id").select("paper_id", "reviewer_id", (F.col("s") / F.col("total")).alias("score"))
