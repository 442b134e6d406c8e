"""Readers, adapters and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SCHEMAS = {
    "manuscripts": "paper_id string, title string, abstract string, keywords array<string>, authors array<string>, affiliation string, conference string, references array<string>",
    "reviewers": "reviewer_id string, name string, areas array<string>, interests array<string>, keywords array<string>, venues array<string>, affiliation string, h_index int, h_index_proxy int, citations long, total_citations long, publications array<struct<title:string,abstract:string,keywords:array<string>,citations:long,rank:int,venue:string,authors:array<string>>>",
    "ground_truth": "paper_id string, assigned_reviewers array<string>",
    "coi": "paper_id string, reviewer_id string, coi_score double, flagged boolean, name_overlap boolean",
    "labels": "paper_id string, label int",
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, kind: str, required: bool = False) -> DataFrame:
    """A JSON relation by its schema; a missing optional one is empty."""
    if not required and not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[kind])
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", True).json(path)


def catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All relations of a folder."""
    return {k: read_json(spark, f"{folder}/{k}.json", k) for k in SCHEMAS}


def truth(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row for each (paper, reviewer); papers without reviewers go, or stay with a null."""
    one = F.explode_outer if keep_empty else F.explode
    return raw.where("paper_id is not null").select("paper_id", one("assigned_reviewers").alias("reviewer_id")).distinct()


def rankings(raw: DataFrame, method: str) -> DataFrame:
    """``(paper_id, ranked)`` with ids, pairs or structs as a long table."""
    kind = raw.schema["ranked"].dataType.elementType
    rows = raw.select("paper_id", F.posexplode("ranked").alias("pos", "r"))
    if isinstance(kind, T.StructType):
        rid, score = F.col("r.reviewer_id"), F.col("r.score")
    elif isinstance(kind, T.ArrayType):
        rid, score = F.col("r")[0], F.col("r")[1].try_cast("double")
    else:
        rid, score = F.col("r"), F.lit(None).cast("double")
    return rows.select(F.lit(method).alias("method"), F.col("paper_id").cast("string"), rid.cast("string").alias("reviewer_id"), score.alias("score"), (F.col("pos") + 1).alias("rank"))


def first_value(*columns: Column, falsy: bool = False) -> Column:
    """The alias chain of a numeric field; ``falsy`` also passes over 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) if falsy else c for c in columns])


def html_metadata(pages: DataFrame) -> DataFrame:
    """S09 over pages: title and first heading."""
    pick = lambda p: F.trim(F.regexp_extract("html", p, 1))
    return pages.select("page_id", pick("<title>([^<]*)</title>").alias("title"), pick("<h1>([^<]*)</h1>").alias("heading"), F.length("html").alias("n_chars"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """S11, S12."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """S13."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report of at most ``most`` rows, as a table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.5f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def signature(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order."""
    h = F.xxhash64(F.to_json(F.struct(*df.columns)))
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).select(F.sha2(F.concat_ws("|", "n", "s", "x"), 256)).first()
    return r[0]


def extend_cache(cache: DataFrame, wanted: DataFrame, make, key: str = "key") -> DataFrame:
    """The cached rows of ``wanted`` and, made now, those that the cache lacks."""
    lacking = wanted.join(cache.select(key), key, "left_anti")
    return cache.join(wanted.select(key), key, "left_semi").unionByName(make(lacking))


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def results_table(ranking: DataFrame, titles: DataFrame, names: DataFrame, truth_: DataFrame, k: int) -> DataFrame:
    """The top k of each paper with titles, names and whether the truth holds the pair."""
    marks = truth_.select("paper_id", "reviewer_id").distinct().withColumn("t", F.lit(True))
    rows = ranking.where(F.col("rank") <= k).join(titles, "paper_id", "left").join(names, "reviewer_id", "left").join(marks, ["paper_id", "reviewer_id"], "left")
    return rows.withColumn("in_truth", F.coalesce("t", F.lit(False))).drop("t")
