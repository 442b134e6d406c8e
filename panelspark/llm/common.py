"""Helpers that the text operators share: tables between steps, membership bits, components, linking of similar members."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the fixed-size membership filter (512 KB); beyond what it can tell apart it only passes more rows.
FILTER_BITS = 1 << 22
#: Most bits of a filter that is sized by what it holds (4 MB).
MOST_BITS = 1 << 25
#: Members up to which a mixed bucket is compared throughout; the members of larger ones meet by their rarest elements.
SMALL = 16
#: The same where sizes and parities travel with the members: a pair they rule out costs some bit counts, a member's rarest elements are some hundred rows.
THROUGHOUT = 1024
#: Counters of how often elements occur, a byte each: they only order the elements, so collisions cost speed and no link.
SLOTS = 1 << 14
#: 64-bit words of parities that rule out most pairs of unlike sets before the sets are fetched.
PARITIES = 8
#: Which centre a bucket has depends on its key: a large group is held against as many different members.
SEEDS = (0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="panelspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (top or _own_folder()).rstrip("/")


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it ends the lineage and survives lost executors.

    What the write has shuffled is garbage then; it leaves the disks when the driver's collector finds it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """``written``, as a table in buckets of the hash of ``by``: what groups or joins by it reads them without a shuffle.

    ``df`` should come from a grouping by ``by``, which leaves a bucket in one file.
    """
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name.replace('_', '-')}"
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").options(path=path, compression="zstd").bucketBy(many, by).saveAsTable(name)
    spark.sparkContext._jvm.System.gc()
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Deletes the table of a ``written`` or ``bucketed`` frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            spark.sql(f"drop table if exists {folder.rsplit('/', 1)[-1].replace('-', '_')}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bit(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def filter_bits(members: int) -> int:
    """Bits for a filter of so many members: a power of 2 that lets a sixteenth of the others pass at most, up to ``MOST_BITS``."""
    return min(MOST_BITS, max(FILTER_BITS, 1 << (16 * members - 1).bit_length()))


def member_bits(ids: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """One row with an ``array<int>`` of ``bits`` bits, set for each value of ``ids[name]``."""
    words = bits // 32
    bit = _bit(F.col(name), bits)
    full = ids.select(F.shiftright(bit, 5).alias("w"), F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(31).cast("int")).alias("b"))
    full = full.groupBy("w").agg(F.bit_or("b").alias("b"))
    dense = ids.sparkSession.range(words).withColumnRenamed("id", "w").join(full, "w", "left").select("w", F.coalesce("b", F.lit(0)).alias("b"))
    packed = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))
    return written(packed)


def may_contain(table: DataFrame, value: Column, bits: int = FILTER_BITS) -> Column:
    """True for every value in the set of ``member_bits``, which had the same ``bits``, and for few others; null values give null."""
    bit = _bit(value, bits)
    return F.getbit(F.element_at(table.scalar(), (F.shiftright(bit, 5) + 1).cast("int")), bit.bitwiseAND(31).cast("int")) == 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src long, dst long)``: ``(node, comp)`` with comp the least node.

    Alternating large-star and small-star rounds (distributed union-find with path
    compression): every node is re-pointed to the least node near it until the edges
    are stars. A hub's edges are only joined, never gathered, so no task holds a group.
    Nodes without an edge have no row; an empty input gives an empty result.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        sym = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = sym.groupBy("src").agg(F.min(F.least("src", "dst")).alias("low"))
        near = sym.join(low, "src")
        if large:
            out = near.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            out = near.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
        return out.where("src <> dst").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    was = state(now)
    while was[0]:
        now = written(star(star(now, True), False))
        got = state(now)
        if got == was:
            break
        was = got
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("comp")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("comp")).unionByName(roots)


def alike(pairs: DataFrame, sets: DataFrame, threshold: float, as_set: Callable[[Column], Column] = lambda grams: grams) -> DataFrame:
    """The pairs ``(a, b)`` whose ``sets(id, grams)`` have a Jaccard similarity of ``threshold`` or more.

    ``as_set`` makes an array of distinct elements of grams. The sets of ``a`` travel with
    the pairs, so ``a`` should be the side that occurs in many, and grams short.
    """
    left, right = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))

    def enough(p: Column) -> Column:
        na, nb = F.size(p["x"]), F.size(p["y"])
        fit = F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9  # the sizes alone rule many out
        return F.when(fit, F.size(F.array_intersect(p["x"], p["y"])) * (1 + threshold) >= (na + nb) * threshold - 1e-9).otherwise(False)

    # a lambda over one struct: the sets are made once for a pair
    both = F.array(F.struct(as_set(F.col("ga")).alias("x"), as_set(F.col("gb")).alias("y")))
    return pairs.join(left, "a").join(right, "b").where(F.exists(both, enough)).select("a", "b")


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows(id, ..., grams)`` with ``n`` and a row for each ``g`` of a set's rarest elements: two sets of similarity ``threshold`` or more share one.

    Rarity comes from ``SLOTS`` counters over a sixteenth of the sets: any one order of the
    elements misses no pair, and what is frequent shows in the sample too. The driver gets
    the counters, whose number is fixed, and sends them on as a byte each.
    """
    slot = lambda g: F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int")
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).select(F.explode("grams").alias("g"))
    level = bytearray(SLOTS)
    for s, k in some.groupBy(slot(F.col("g")).alias("s")).agg(F.count("*").alias("k")).collect():
        level[s] = min(255, k if k < 128 else 120 + k.bit_length())
    n = F.size("grams")
    order = F.sort_array(F.transform("grams", lambda g: F.struct(F.substring(F.lit(bytes(level)), slot(g) + 1, F.lit(1)).alias("k"), F.xxhash64(g).alias("h"), g.alias("g"))))
    first = F.slice(order, F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    each = rows.withColumns({"n": n, "first": F.transform(first, lambda x, i: F.struct(x["g"].alias("g"), i.alias("at")))})
    # a plain explode has the optimizer test the array's size below the join too, and so make every set twice
    return each.select(*[c for c in rows.columns if c != "grams"], "n", F.explode_outer("first").alias("x")).where("x is not null").select("*", "x.g", "x.at").drop("x")


def parities(grams: Column) -> Column:
    """``PARITIES`` longs whose bits tell whether an odd number of elements fall on them: two sets differ by as many elements as bits, at least."""
    bit = lambda g: F.pmod(F.xxhash64(g, F.lit(1)), F.lit(64 * PARITIES)).cast("int")
    none = F.lit(0).cast("long")

    def word(w: int) -> Column:
        mask = lambda g: F.when(F.shiftright(bit(g), 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), bit(g).bitwiseAND(63))).otherwise(none)
        return F.aggregate(grams, none, lambda acc, g: acc.bitwiseXOR(mask(g))).alias(f"p{w}")

    return F.struct(*map(word, range(PARITIES)))


def differing(odd: Column, odd2: Column, names: list[str]) -> Column:
    """How many elements two sets with these parities, structs of the longs ``names``, differ by, at least."""
    return sum((F.bit_count(odd[p].bitwiseXOR(odd2[p])) for p in names), F.lit(0))


def fitting(n: str, odd: str, n2: str, odd2: str, names: list[str], threshold: float) -> Column:
    """Whether two sets of these sizes and parities, structs of the longs ``names``, may have a similarity of ``threshold`` or more."""
    size = F.col(n) + F.col(n2)
    unlike = differing(F.col(odd), F.col(odd2), names)
    return (F.least(n, n2) >= F.greatest(n, n2) * threshold - 1e-9) & (size - unlike >= size * (2 * threshold / (1 + threshold)) - 1e-9)


def possible(pairs: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b, ...)`` that ``bounds(id, n, odd)``, sizes and parities of the sets, don't rule out: all alike by ``threshold`` or more, and few others."""
    left = bounds.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    right = bounds.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    fit = fitting("na", "oa", "nb", "ob", bounds.schema["odd"].dataType.names, threshold)
    return pairs.join(left, "a").join(right, "b").where(fit).select(*pairs.columns)


def linked(buckets: DataFrame | list[DataFrame], sets_of: Callable[[DataFrame], DataFrame], threshold: float, small: int = SMALL, as_set: Callable[[Column], Column] = lambda grams: grams, bounds: DataFrame | None = None, spent: DataFrame | None = None) -> DataFrame:
    """Components ``(node, comp)`` of the links of similarity ``threshold`` or more among members of one bucket; unlinked ids may have no row.

    ``buckets(key, id)``: 64-bit names of different sets, each once in a bucket; a list of
    frames without common keys is grouped one by one, so that only one's rows are on the
    disks. ``sets_of`` takes a frame of ids and returns ``(id, grams)`` with their sets, or with
    something shorter of which ``as_set`` makes them. ``bounds(id, n, odd)``, where given, holds the
    sets' sizes and ``parities``: they rule out most unlike pairs before sets are fetched.
    ``spent``, the table that ``buckets`` and ``bounds`` come from, is deleted as soon as what
    they say of the members is a table of its own; ``bounds`` should lie in buckets by id then.

    Every member is compared with the centre of its bucket, so the pairs grow with the
    members and not with their square; four kinds of keys take different centres. What is
    linked forms components, and only links between components can matter from there on.
    Buckets that hold several are compared throughout if they are small, between
    components only. The members of larger ones meet by the rarest elements of their sets,
    which no pair of the threshold escapes, again between components only: where a component
    makes up most of those who share an element, its members aren't paired with each other.
    No link inside a bucket is missed, whatever its size.
    """

    def members(part: DataFrame) -> DataFrame:
        seed = F.element_at(F.array(*map(F.lit, SEEDS)), (F.pmod(F.col("key"), F.lit(len(SEEDS))) + 1).cast("int"))
        ends = part.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("low"), F.min(F.col("id").bitwiseXOR(seed)).alias("c")).where("m > 1")
        ends = ends.select("key", "m", F.when(F.col("m") <= 3, F.col("low")).otherwise(F.col("c").bitwiseXOR(seed)).alias("c"))
        return written(part.join(ends, "key"))

    member = reduce(DataFrame.unionByName, map(members, buckets if isinstance(buckets, list) else [buckets]))
    ids = member.select("id").distinct()
    pairs = member.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    if bounds is None:
        sets = written(sets_of(ids))
    else:
        # in buckets again: the pairs travel to the bounds, not the bounds to the pairs
        bounds = bucketed(bounds.join(ids, "id", "left_semi"), "id")
        if spent is not None:
            discard(spent)
        pairs, small = written(possible(pairs, bounds, threshold)), max(small, THROUGHOUT)

    def links(of: DataFrame) -> DataFrame:
        own = sets if bounds is None else written(sets_of(of.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        return alike(of, own, threshold, as_set)

    first = components(links(pairs).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    named = member.where("m > 2").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = written(named.join(several, "key"))
    few = mixed.where((F.col("m") <= small) & (F.col("id") != F.col("c"))).select("key", "id", "comp")
    meet = F.expr("id < to and comp <> far")
    if bounds is not None:
        few = few.join(bounds, "id")
        meet = meet & fitting("n", "odd", "n2", "odd2", bounds.schema["odd"].dataType.names, threshold)
    other = few.select("key", F.col("id").alias("to"), F.col("comp").alias("far"), *[F.col(c).alias(f"{c}2") for c in few.columns[3:]])
    cross = few.join(other, "key").where(meet).select(F.col("id").alias("a"), F.col("to").alias("b"), F.col("comp").alias("src"), F.col("far").alias("dst"))
    many = mixed.where(F.col("m") > small).select("id", "comp").distinct()
    if not many.isEmpty():
        whole = (sets if bounds is None else sets_of(many.select("id"))).join(many, "id").withColumn("grams", as_set(F.col("grams")))
        near = prefixes(whole.withColumn("odd", parities(F.col("grams"))), threshold) if bounds is None else prefixes(whole, threshold).join(bounds.select("id", "odd"), "id")
        near = written(near)
        per = near.groupBy("g", "comp").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
        near = near.join(per.where("comps > 1").select("g", F.col("top.comp").alias("top")), "g")
        there = near.select("g", F.col("id").alias("to"), F.col("n").alias("m"), F.col("at").alias("at2"), F.col("odd").alias("odd2"), F.col("comp").alias("far"), (F.col("comp") == F.col("top")).alias("main"))
        # what two sets must share; what follows a shared element, and the parities, bound it
        least = (F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-9
        unlike = differing(F.col("odd"), F.col("odd2"), near.schema["odd"].dataType.names)
        fit = (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at2")) >= least) & (F.col("n") + F.col("m") - unlike >= 2 * least)
        meet = near.where("comp <> top").join(there, "g").where(F.expr("comp <> far and (main or id < to)") & fit)
        cross = cross.unionByName(meet.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"), F.when(F.col("id") < F.col("to"), F.col("comp")).otherwise(F.col("far")).alias("src"), F.when(F.col("id") < F.col("to"), F.col("far")).otherwise(F.col("comp")).alias("dst")))
    cross = written(cross.distinct() if bounds is None else possible(cross.distinct(), bounds, threshold))
    more = links(cross.select("a", "b"))
    second = components(cross.join(more, ["a", "b"]).select("src", "dst"))
    nodes = first.unionByName(second.join(first, "node", "left_anti").select("node", F.col("node").alias("comp")))
    last = second.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return written(nodes.join(last, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
