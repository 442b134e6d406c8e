"""Personal data: base patterns and information-theoretic sanitisation, with DataFrame functions only.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers; their
distinct values are the protected entities, and so are the groups they belong to (an
e-mail address's domain, the first three parts of an address, a card or phone number
without its last three digits): most values occur once, their groups don't. A
term (a word of ``TERM_LENGTH`` letters or more) discloses an entity by the share of the
entity's information that it gives away: ``PMI(term, entity) / IC(entity)``, with
``PMI = log(n(t,e) N / (n(t) n(e)))`` and ``IC = log(N / n(e))`` over the different
segments of the whole corpus. A segment is a line, or each ``SEGMENT`` words of a longer
one, so that what meets in one is bounded. Words inside base patterns count nowhere.

A term whose share reaches ``GENERALISE`` is told of only if chance is ruled out. Its
first meeting with the entity is what made the pair a candidate; the further ones are
held against a Poisson law of mean ``(n(t) - 1) n(e) / N``. Over all pairs that meet at
all, less than ``CHANCE`` pairs may be expected to do so as often. One meeting (less than
``SUPPORT``) has no further one and never passes. Such a term is a span of kind ``term``,
wherever it occurs: it is generalised to ``[TERM]`` or, from ``REMOVE`` on, removed. Base
spans become ``[KIND]``.

Offsets are code points, ends exclusive. Matches that fail a check (part over 255, Luhn,
number of digits) are dropped. Nulls: a null text counts as empty. Rows may repeat: equal segments count once. An empty
table has no terms and gives no rows. Ties don't arise: every term is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written, may_contain, member_bits

# The kinds in their order; possessive, which matches the same and cannot run out of stack.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a match of the kind: cheap to look for.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
TERM_LENGTH, SUPPORT, GENERALISE, REMOVE, CHANCE = 4, 2, 0.8, 0.95, 0.05
SEGMENT = 64
SEGMENTS = r"(?:\S++[^\S\n]*+){1,%d}+" % SEGMENT
TERM = r"\p{L}{%d,}+" % TERM_LENGTH
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    each = F.filter(F.split(F.reverse(_digits(hit)), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _fits(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.substring(F.ltrim(p, F.lit("0")), 1, 3), F.lit("999")), F.lit(0)) <= 255)
        return F.forall(F.split(hit, r"\."), part)
    n = F.length(_digits(hit))
    if kind == "card":
        return n.between(16, 19) & _luhn(hit)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _places(text: Column, pattern: Column, kind: int, fits) -> Column:
    """Spans of the matches of ``pattern`` that fit: the pieces between them give the offsets."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,hit:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        z = a + F.length(x["hit"])
        return F.struct(z.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), z.alias("end"), x["hit"].alias("hit")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.filter(F.aggregate(pairs, start, step)["out"], lambda x: fits(x["hit"]))


def base_spans(text: Column) -> Column:
    """Array of ``(kind, start, end, hit)`` of all base matches, by kind then start. Texts without digits and @ cost one look."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,hit:string>>")
    each = [F.when(F.rlike(text, F.lit(NEEDS[k])), _places(text, F.lit(p), i, lambda h, k=k: _fits(k, h))).otherwise(none) for i, (k, p) in enumerate(PATTERNS.items())]
    return F.when(F.rlike(text, F.lit(r"[0-9@]")), F.concat(*each)).otherwise(none)


def _group(kind: Column, hit: Column) -> Column:
    """What an entity has in common with others of its kind."""
    digits = _digits(hit)
    block = F.substring(digits, F.lit(1), F.length(digits) - 3)
    return F.when(kind == 0, F.lower(F.substring_index(hit, "@", -1))).when(kind == 1, F.substring_index(hit, ".", 3)).otherwise(block)


def by_chance(meetings: Column, nt: Column, ne: Column, total: Column, pairs: Column) -> Column:
    """A bound on the expected number of pairs that meet so often by chance: ``pairs`` times the Poisson tail of the meetings after the first.

    The tail is at most its first term over ``1 - mean / meetings``; 1 or more where they don't pass the mean.
    """
    k, mean = (meetings - 1).cast("double"), (nt - 1) * ne / total
    # below 20 the factorial itself, above it less than that
    log_factorial = F.coalesce(F.log(F.factorial((meetings - 1).cast("int"))), k * F.log(k) - k)
    first = F.exp(F.log(pairs) + k * F.log(mean) - mean - log_factorial)
    return F.when(mean <= 0, F.lit(0.0)).when(k <= mean, pairs).otherwise(first / (1 - mean / (k + 1)))


def _unmasked(line: Column) -> Column:
    """A segment without what looks like a base pattern."""
    masked = line
    for p in PATTERNS.values():
        masked = F.regexp_replace(masked, F.lit(p), F.lit(" "))
    return F.when(F.rlike(line, F.lit(r"[0-9@]")), masked).otherwise(line)


def terms(docs: DataFrame) -> DataFrame:
    """``(term, removed boolean)``: the terms of the corpus that disclose an entity, and whether they go altogether."""
    line = docs.select(F.explode(F.regexp_extract_all("text", F.lit(SEGMENTS), F.lit(0))).alias("line"))
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(TERM), F.lit(0)), F.lower))
    text = _unmasked(F.col("line"))
    found = line.where(F.rlike("line", F.lit(r"[0-9@]"))).withColumn("spans", base_spans(F.col("line"))).where(F.size("spans") > 0)
    seen = found.select(F.xxhash64("line").alias("line"), words(text).alias("terms"), F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.array(F.xxhash64(x["kind"], x["hit"]), F.xxhash64(x["kind"] - 10, _group(x["kind"], x["hit"]))))))).alias("entity"))
    seen = written(seen.distinct())
    total = F.lit(float(max(line.select(F.xxhash64("line").alias("line")).distinct().count(), 2)))
    meetings = seen.select("entity", F.explode("terms").alias("term"))
    pairs = meetings.agg(F.approx_count_distinct(F.xxhash64("entity", "term"), 0.02)).first()[0]  # one number
    both = meetings.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    entity = seen.groupBy("entity").agg(F.count("*").alias("ne"))
    # exact bound: a term in more lines than this cannot reach the threshold, and those beside entities are known
    most = F.col("both") * F.pow(total / F.col("ne"), F.lit(1 - GENERALISE)) + 1
    known = seen.select("line", "terms").distinct().select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("known"))
    both = written(both.join(entity, "entity").join(known, "term").where(F.col("known") <= most).select("term", "both", "ne"))
    none = docs.sparkSession.createDataFrame([], "term string, removed boolean")
    if both.isEmpty():
        return none
    names = written(both.select("term").distinct())
    bits = member_bits(names, "term")
    met = line.select(F.xxhash64("line").alias("line"), F.explode(words(text)).alias("term")).where(may_contain(bits, F.col("term"))).join(names, "term").distinct()
    nt = met.groupBy("term").agg(F.count("*").alias("nt"))
    share = F.log(F.col("both") * total / (F.col("nt") * F.col("ne"))) / F.greatest(F.log(total / F.col("ne")), F.lit(1e-9))
    rare = by_chance(F.col("both"), F.col("nt"), F.col("ne"), total, F.lit(float(max(pairs, 1)))) < CHANCE
    told = both.join(nt, "term").where(rare).groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE)
    return written(told.select("term", (F.col("share") >= REMOVE).alias("removed")))


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__base`` (base spans) and ``__terms`` (term spans; kind 4 is generalised, 5 removed)."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,hit:string>>")
    text = F.coalesce("text", F.lit(""))
    told = terms(docs)
    if told.isEmpty():
        return docs.withColumns({"__base": base_spans(text), "__terms": none})
    bits = member_bits(told, "term")
    # the terms told of in each text; a document without any passes by without a shuffle
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    mine = docs.select(F.xxhash64("text").alias("__key"), F.explode(words).alias("term")).where(may_contain(bits, F.col("term")))
    mine = written(mine.distinct().join(told, "term").groupBy("__key").agg(F.collect_list(F.struct("term", "removed")).alias("__told")))
    here = F.coalesce(may_contain(member_bits(mine, "__key"), F.xxhash64("text")), F.lit(False))
    calm = docs.where(~here).withColumn("__told", F.lit(None).cast("array<struct<term:string,removed:boolean>>"))
    touched = docs.where(here).withColumn("__key", F.xxhash64("text")).join(mine, "__key", "left").drop("__key")
    gone = F.transform(F.filter("__told", lambda x: x["removed"]), lambda x: x["term"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("__told", lambda x: x["term"]), "|"), F.lit(r")(?!\p{L})"))
    found = _places(text, pattern, 4, lambda h: F.lit(True))
    apart = F.filter(found, lambda x: ~F.exists("__base", lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])))
    marked = F.transform(apart, lambda x: F.struct(F.when(F.array_contains(gone, F.lower(x["hit"])), 5).otherwise(4).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))
    both = calm.unionByName(touched).withColumn("__base", base_spans(text))
    return both.withColumn("__terms", F.when(F.col("__told").isNotNull(), marked).otherwise(none)).drop("__told")


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, [*PATTERNS, "term", "term"]))
    return F.array_join(F.transform(found, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term)`` of every document."""
    got = spans(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("__base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{list(PATTERNS)[i]}")
    return got.select("doc_id", *map(count, range(len(PATTERNS))), F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.concat("__base", "__terms")).alias("spans"), F.size("__terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its label, removed terms by nothing, and ``n_chars`` to match."""
    got = spans(docs)
    order = F.array_sort(F.transform(F.concat("__base", "__terms"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in [*PATTERNS, "term"]], F.lit(""))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["end"]
        new = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.element_at(labels, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, first, step)
    text = F.when(F.size(F.concat("__base", "__terms")) > 0, F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    got = got.withColumn("text", text)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.size(F.concat("__base", "__terms")) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)
