"""Text construction and tokenisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Small default vocabularies; every function takes its own instead.
STOPWORDS = "a an and are as at be by for from has in is it of on or that the this to was were with".split()
GENERIC = "paper method approach result results based using study system model data".split()
SYNONYMS = {"llms": "llm", "nets": "network", "gnn": "graph", "transformers": "transformer"}
ACRONYMS = {"llm": ["large", "language", "model"], "nlp": ["natural", "language", "processing"], "kg": ["knowledge", "graph"], "ir": ["information", "retrieval"]}
CONCEPTS = {"graph": ["network analysis"], "query": ["databases"], "language": ["natural language processing"], "transformer": ["deep learning"]}


def words_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def to_text(values: Column) -> Column:
    """The non-empty values joined by spaces."""
    return F.concat_ws(" ", F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x != ""))


def paper_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """T02, T38, T41."""
    return F.concat_ws(" ", title, abstract, to_text(keywords))


def weighted_title(title: Column, abstract: Column, times: int = 3) -> Column:
    """The title repeated, then the abstract."""
    return F.concat_ws(" ", *[title] * times, abstract)


def top_publications(pubs: Column, limit: int) -> Column:
    """Publications by citations downwards, then rank, then place."""
    keyed = F.transform(pubs, lambda p, i: F.struct((-F.coalesce(p["citations"], F.lit(0))).alias("c"), F.coalesce(p["rank"], F.lit(10**9)).alias("r"), i.alias("i"), p.alias("p")))
    return F.transform(F.slice(F.sort_array(keyed), 1, limit), lambda x: x["p"])


def ordered_distinct(values: Column) -> Column:
    """First-seen distinct values, compared without case."""
    low = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def split_list(text: Column, limit: int, pattern: str = "[,;\n]") -> Column:
    """A delimited string as an ordered distinct list, lower-cased."""
    parts = F.filter(F.transform(F.split(text, pattern), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.slice(F.array_distinct(parts), 1, limit)


def clean(text: Column, digits: bool = False) -> Column:
    """T09; with ``digits`` T10: letters, digits and underscores only, lower case, spaces squeezed."""
    out = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)\d+", ""), r"(?U)\s+", " ")) if digits else out


def preprocess(text: Column, stop: list[str] = STOPWORDS) -> Column:
    """T11, T40."""
    kept = F.filter(F.split(clean(text, True), " "), lambda w: ~F.array_contains(words_array(stop), w) & (F.length(w) > 2))
    return F.array_join(kept, " ")


def tokens(text: Column, pattern: str, stop: list[str] = (), longer: int = 0, distinct: bool = True) -> Column:
    """Matches of a pattern in lower case, without stop words, longer than ``longer``."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1)), lambda w: F.length(w) > longer)
    if stop:
        found = F.filter(found, lambda w: ~F.array_contains(words_array(list(stop)), w))
    return F.array_distinct(found) if distinct else found


def lexical_tokens(text: Column, stop: list[str] = STOPWORDS) -> Column:
    """T13."""
    return tokens(text, r"[a-z0-9][a-z0-9\-]{2,}", stop, 3)


def normal_word(word: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Synonyms, then ies to y or a stripped ed, then ASCII letters and digits only."""
    word = F.lower(word)
    for a, b in (SYNONYMS if synonyms is None else synonyms).items():
        word = F.when(word == a, F.lit(b)).otherwise(word)
    long = F.length(word) > 5
    word = F.when(long & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(long & word.endswith("ed"), F.regexp_replace(word, "ed$", "")).otherwise(word)
    return F.regexp_replace(word, r"[^a-z0-9\s]", "")


def clean_keywords(values: Column, stop: list[str] = STOPWORDS, generic: list[str] = GENERIC) -> Column:
    """T16."""
    return F.filter(values, lambda w: (F.length(w) > 4) & ~F.array_contains(words_array([*stop, *generic]), w))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words."""
    size = F.size(words) - n + 1
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def simple_keyphrases(text: Column, limit: int, stop: list[str] = STOPWORDS) -> Column:
    """3-grams, then 2-grams, then words, first-seen distinct."""
    words = tokens(text, r"[a-z][a-z0-9]{3,}", stop, 0, distinct=False)
    return F.slice(F.array_distinct(F.concat(ngrams(words, 3), ngrams(words, 2), words)), 1, limit)


def slug(text: Column, limit: int = 96) -> Column:
    """T23, T25 with spaces."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, limit)


def publication_key(reviewer: Column, title: Column) -> Column:
    """T24."""
    return F.concat(F.lit("pub_"), F.substring(F.sha1(F.concat_ws(":", reviewer, title)), 1, 12))


def normal_name(name: Column) -> Column:
    """T25."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def expanded_tokens(words: Column, acronyms: dict[str, list[str]] | None = None) -> Column:
    """Acronyms with their words, and light plural stems."""
    table = ACRONYMS if acronyms is None else acronyms
    out = F.transform(words, lambda w: F.array(w))
    for a, more in table.items():
        out = F.transform(out, lambda x, a=a, more=more: F.when(F.element_at(x, 1) == a, F.array(F.lit(a), *map(F.lit, more))).otherwise(x))
    stems = F.transform(F.flatten(out), lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.array(w, w.substr(F.lit(1), F.length(w) - 1))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(stems))


def json_object(text: Column, schema: str) -> Column:
    """From the first brace to the last, parsed, or null."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def parse_score(text: Column) -> Column:
    """The number the text is, or else the first fraction, 0 or 1 it holds, clamped to 0..1; null if none (and for nan)."""
    plain = F.when(F.rlike(F.trim(text), F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), F.trim(text))
    inside = F.nullif(F.regexp_extract(text, r"\b0?\.[0-9]+|\b1\.0\b|\b0\b|\b1\b", 0), F.lit(""))
    value = F.coalesce(plain.try_cast("double"), inside.try_cast("double"))
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def term_list(values: Column) -> Column:
    """A, b, and c."""
    n = F.size(values)
    return F.when(n == 0, "").when(n == 1, F.element_at(values, 1)).when(n == 2, F.array_join(values, " and ")).otherwise(F.concat(F.array_join(F.slice(values, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(values, -1)))


def squeeze_blanks(text: Column) -> Column:
    """Line ends unified, blanks collapsed, two line ends at most."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))
