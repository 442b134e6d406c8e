"""Profiles made from key terms, and how well two profiles match.

A profile is a table ``(id, field, term)``. Terms are matched once over the distinct terms
of both sides: by containment and by shared tokens, never as all pairs; what matches joins
back to the profiles of the candidate pairs. A pair's best matches are partial aggregates,
and what is gathered for a pair is bounded by the paper's own terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .keyterms import contained, normal_forms

#: The fields and how many of the first terms each takes.
PAPER_FIELDS = {"research_domain": 1, "main_topics": 6, "required_expertise": 8, "research_area": 6}
REVIEWER_FIELDS = {"expertise_domains": 7, "review_strengths": 6, "research_strengths": 7, "publication_focus": 8}
#: What the components compare, their least denominators and their weights.
COMPONENTS = {
    "domain": (["research_domain", "domain", "research_area", "main_topics"], ["expertise_domains", "review_strengths", "research_strengths", "publication_focus"], 3, 0.30),
    "methods": (["methods"], ["methods"], 2, 0.30),
    "publication": (["required_expertise", "main_topics"], ["expertise_domains", "review_strengths", "research_strengths"], 3, 0.20),
    "topic": (["main_topics", "research_domain", "research_area"], ["expertise_domains", "review_strengths", "research_strengths", "publication_focus"], 3, 0.20),
}


def profiles(terms: DataFrame, fields: dict[str, int], methods: list[str], most: int) -> DataFrame:
    """``(id, field, term, place)`` from ``topic_terms`` rows: the first terms of each field, and the first ``most`` that name a method."""
    sized = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("n")) for f, n in fields.items()])).alias("x")
    rows = terms.select("id", "term", "place", sized).where(F.col("place") <= F.col("x.n")).select("id", "x.field", "term", "place")
    named = terms.where(F.rlike(F.col("term"), F.lit("|".join(methods))))
    first = named.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "term"))), 1, most).alias("x"))  # a text's topic terms at most
    return rows.unionByName(first.select("id", F.lit("methods").alias("field"), F.inline("x")).select("id", "field", "term", "place"))


def seniority(h: Column) -> Column:
    """A15."""
    return F.when(h >= 8, "senior").when(h >= 4, "mid-level").otherwise("junior")


def documents(rows: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """``(id, text)``, a line for each section with its first-seen distinct terms; ``rows`` hold their place in the field."""
    order = {f: (i, j) for i, fs in enumerate(sections.values()) for j, f in enumerate(fs)}
    names = list(sections)
    at = F.create_map(*[F.lit(x) for f, (i, j) in order.items() for x in (f, i * 100 + j)])
    part = rows.withColumn("at", F.element_at(at, F.col("field"))).where("at is not null").withColumn("term", F.trim(F.element_at(normal_forms(F.array("term")), 1))).where("term <> ''")
    line = part.groupBy("id", F.floor(F.col("at") / 100).cast("int").alias("s")).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "place", "term"))), lambda x: x["term"])).alias("ts"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("s") + 1)
    text = line.select("id", F.struct("s", F.concat(label, F.lit(": "), F.array_join("ts", "; ")).alias("line")).alias("x"))
    return text.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def lexical_tokens(text: Column, stop: list[str] = V.LEXICAL_STOP) -> Column:
    """The distinct tokens of four characters or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(stop)))


def expanded(tokens: Column, acronyms: dict[str, list[str]] | None = None) -> Column:
    """Tokens with the words of acronyms and light stems, each once."""
    table = V.ACRONYMS if acronyms is None else acronyms
    named = F.create_map(*[x for a, ws in table.items() for x in (F.lit(a), F.array(*map(F.lit, ws)))])
    none = F.array().cast("array<string>")
    words = F.flatten(F.transform(tokens, lambda w: F.coalesce(F.element_at(named, w), none)))
    cut = lambda w, n: w.substr(F.lit(1), F.length(w) - n)
    long = lambda w, end, n: w.endswith(end) & (F.length(w) > n)
    stem = lambda w: F.when(long(w, "ies", 5), F.concat(cut(w, 3), F.lit("y"))).when(long(w, "es", 5), cut(w, 2)).when(long(w, "s", 4), cut(w, 1))
    return F.array_distinct(F.concat(tokens, words, F.array_compact(F.transform(tokens, stem))))


def term_tokens(terms: DataFrame) -> DataFrame:
    """``(term, tokens)`` of distinct terms."""
    return terms.select("term").distinct().select("term", expanded(lexical_tokens(F.col("term"))).alias("tokens"))


def term_matches(papers: DataFrame, reviewers: DataFrame) -> DataFrame:
    """``(p, r, like, within)`` of the distinct terms that are alike at all: 1 if equal, 0.85 if one contains the other, else by shared expanded tokens."""
    p, r = papers.select(F.col("term").alias("p")).distinct(), reviewers.select(F.col("term").alias("r")).distinct()
    held = contained(p, r).withColumn("like", F.when(F.col("p") == F.col("r"), 1.0).otherwise(0.85))
    left, right = term_tokens(papers).withColumnsRenamed({"term": "p", "tokens": "tp"}), term_tokens(reviewers).withColumnsRenamed({"term": "r", "tokens": "tr"})
    met = left.select("p", F.size("tp").alias("np"), F.explode("tp").alias("t")).join(right.select("r", F.size("tr").alias("nr"), F.explode("tr").alias("t")), "t")
    shared = met.groupBy("p", "r", "np", "nr").agg(F.count("*").alias("k"))
    like = F.greatest(F.col("k") / (F.col("np") + F.col("nr") - F.col("k")), 0.75 * F.col("k") / F.least("np", "nr"))
    soft = shared.select("p", "r", like.alias("like")).join(held.select("p", "r"), ["p", "r"], "left_anti")
    return held.select("p", "r", "like", F.lit(True).alias("within")).unionByName(soft.select("p", "r", "like", F.lit(False).alias("within")))


def components(pairs: DataFrame, papers: DataFrame, reviewers: DataFrame, floors: dict[str, int]) -> DataFrame:
    """``(kind, paper_id, reviewer_id, score, evidence)`` for candidate pairs and each kind of ``floors``: the largest of five measures over ``papers(kind, paper_id, term)`` and ``reviewers(kind, reviewer_id, term)``.

    Containment: distinct contained terms over the paper's terms (ten count, the kind's floor
    at least). Soft: the mean of as many best matches of the paper's terms. Tokens: 0.65 of
    their coverage and 0.35 of their Jaccard similarity. And 0.03 where both sides have
    terms. A side without terms gives 0. ``evidence``: eight terms at most, by name. All
    kinds go through one plan, in which a pair's rows meet once.
    """
    key = ["kind", "paper_id", "reviewer_id"]
    none = F.array().cast("array<string>")
    shorter = F.when(F.length("p") <= F.length("r"), F.col("p")).otherwise(F.col("r"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("floor")) for k, n in floors.items()]))
    pair = pairs.select("paper_id", "reviewer_id", kinds.alias("x")).select("paper_id", "reviewer_id", "x.*")

    def side(rows: DataFrame, own: str, prefix: str) -> DataFrame:
        """The number of terms and the expanded tokens of each kind and id."""
        each = rows.select("kind", own, "term", F.explode_outer(expanded(lexical_tokens(F.col("term")))).alias("t"))
        return each.groupBy("kind", own).agg(F.count_distinct("term").alias(f"{prefix}_n"), F.collect_set("t").alias(f"{prefix}_tokens"))

    both = pair.join(side(papers, "paper_id", "p"), ["kind", "paper_id"]).join(side(reviewers, "reviewer_id", "r"), ["kind", "reviewer_id"])
    met = pair.select(*key).join(papers.withColumnRenamed("term", "p"), ["kind", "paper_id"]).join(term_matches(papers, reviewers), "p").join(reviewers.withColumnRenamed("term", "r"), ["kind", "reviewer_id", "r"])
    best = met.groupBy(*key, "p").agg(F.min(F.struct((-F.col("like")).alias("worse"), "r")).alias("x"), F.collect_set(F.when(F.col("within"), shorter)).alias("exact"))
    best = best.select(*key, "p", "exact", (-F.col("x.worse")).alias("like"), F.col("x.r").alias("r"))
    best = best.withColumn("soft", F.when(F.round("like", 9) >= 0.35, shorter))
    per = best.groupBy(*key).agg(F.sort_array(F.collect_list("like"), asc=False).alias("likes"), F.array_distinct(F.flatten(F.collect_list("exact"))).alias("exact"), F.collect_set("soft").alias("soft"))
    out = both.join(per, key, "left").withColumns({"exact": F.coalesce("exact", none), "soft": F.coalesce("soft", none), "k": F.size(F.array_intersect("p_tokens", "r_tokens"))})
    parts = F.greatest("floor", F.least(F.col("p_n"), F.lit(10))).cast("int")
    mean = F.aggregate(F.slice(F.coalesce("likes", F.array().cast("array<double>")), F.lit(1), parts), F.lit(0.0), lambda s, x: s + x) / parts
    np, nr = F.size("p_tokens"), F.size("r_tokens")
    cover = F.col("k") / F.greatest(F.least(np, nr), F.lit(1))
    alike = F.col("k") / F.greatest(np + nr - F.col("k"), F.lit(1))
    score = F.least(F.lit(1.0), F.greatest(F.size("exact") / parts, mean, 0.65 * cover, 0.35 * alike, F.lit(0.03)))
    eight = lambda c: F.slice(F.array_sort(c), 1, 8)
    found = out.select(*key, score.alias("score"), eight(F.array_union(eight("exact"), eight("soft"))).alias("evidence"))
    rest = pair.select(*key).join(found, key, "left")
    return rest.select(*key, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("evidence", none).alias("evidence"))


def by_component(rows: DataFrame, side: int, key: str) -> DataFrame:
    """A profile's terms once for each component that reads their field."""
    uses = F.create_map(*[x for f in sorted({f for c in COMPONENTS.values() for f in c[side]}) for x in (F.lit(f), F.array(*[F.lit(k) for k, c in COMPONENTS.items() if f in c[side]]))])
    form = F.trim(F.element_at(normal_forms(F.array("term")), 1))
    return rows.select(F.explode(F.element_at(uses, F.col("field"))).alias("kind"), F.col("id").alias(key), form.alias("term")).where("term <> ''").distinct()


def suitability(pairs: DataFrame, papers: DataFrame, reviewers: DataFrame, bonus: float = 0.0, cosine: Column | None = None) -> DataFrame:
    """The four components of distinct candidate pairs of profiles ``(id, field, term)``, their weighted sum scaled by a confidence that grows with the evidence, or ``cosine`` of the profiles' embeddings where it isn't null.

    Where a side names no methods, that component is no larger than the topics' one.
    """
    p, r = by_component(papers, 0, "paper_id"), by_component(reviewers, 1, "reviewer_id")
    each = components(pairs, p, r, {k: floor for k, (_, _, floor, _) in COMPONENTS.items()})
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k)
    terms = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), 1, 10)
    out = each.groupBy("paper_id", "reviewer_id").agg(*map(of, COMPONENTS), terms.alias("terms"))
    has = lambda rows, key: rows.where("kind = 'methods'").select(key).distinct().withColumn(f"{key}_has", F.lit(True))
    out = out.join(has(p, "paper_id"), "paper_id", "left").join(has(r, "reviewer_id"), "reviewer_id", "left")
    named = F.col("paper_id_has").isNotNull() & F.col("reviewer_id_has").isNotNull()
    methods = F.when(named, F.col("methods")).otherwise(F.least(F.when(F.col("methods") > 0, F.col("methods")).otherwise(F.col("topic")), F.col("topic")))
    confidence = F.greatest(F.lit(0.35), F.least(F.lit(0.95), 0.45 + 0.07 * F.size("terms") + bonus))
    out = out.withColumn("methods", methods).withColumn("confidence", confidence)
    total = sum((F.lit(w) * F.col(c) for c, (_, _, _, w) in COMPONENTS.items()), F.lit(0.0)) * (0.85 + 0.15 * F.col("confidence"))
    overlap = F.least(F.lit(1.0), total)
    return out.select("paper_id", "reviewer_id", *COMPONENTS, "confidence", "terms", overlap.alias("overlap"), (overlap if cosine is None else F.coalesce(cosine, overlap)).alias("score"))


def blended_overlap(pairs: DataFrame, tokens: tuple[DataFrame, DataFrame], keywords: tuple[DataFrame, DataFrame]) -> DataFrame:
    """0.45 of the tokens' and 0.55 of the keywords' Jaccard similarity for candidate pairs; a side without any gives 0.

    Each side is ``(paper_id, t)`` and ``(reviewer_id, t)``, without repeats.
    """
    out = pairs.select("paper_id", "reviewer_id").distinct()
    for name, (p, r) in {"by_tokens": tokens, "by_keywords": keywords}.items():
        both = out.select("paper_id", "reviewer_id").join(p, "paper_id").join(r, ["reviewer_id", "t"]).groupBy("paper_id", "reviewer_id").agg(F.count("*").alias("k"))
        n, m = p.groupBy("paper_id").agg(F.count("*").alias("n")), r.groupBy("reviewer_id").agg(F.count("*").alias("m"))
        part = both.join(n, "paper_id").join(m, "reviewer_id").select("paper_id", "reviewer_id", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias(name))
        out = out.join(part, ["paper_id", "reviewer_id"], "left")
    share = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumn("score", 0.45 * share("by_tokens") + 0.55 * share("by_keywords")).select("paper_id", "reviewer_id", "score")
