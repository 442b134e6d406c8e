"""Assignment histories of unknown nesting, and the workload that several records of it come to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kind(v: str) -> str:
    return f"split_part(schema_of_variant({v}), '<', 1)"


def _named(v: str, path: str) -> str:
    """The text of a scalar, or null where it is missing, empty, zero or false; a text 0 is an id."""
    text, kind = f"try_variant_get({v}, '{path}', 'string')", _kind(f"try_variant_get({v}, '{path}', 'variant')")
    none = f"{text} = '' OR ({kind} = 'BOOLEAN' AND {text} = 'false') OR ({kind} <> 'STRING' AND try_cast({text} AS double) = 0)"
    return f"CASE WHEN {none} THEN NULL ELSE {text} END"


def reviewer_ids(history: DataFrame, depth: int = 16) -> DataFrame:
    """``(paper_id, reviewer_id string)`` from ``history(paper_id, payload)``, JSON text of any nesting, as often as they occur.

    An object with a list ``full`` stands for that list; one with a ``reviewer_id`` for that;
    of others every value counts: lists and objects in turn, anything else as an id. Of a
    list, objects count by their ``reviewer_id`` and other values as ids. Missing, empty, zero
    and false ids count nothing; what isn't JSON has none. Each level of nesting is one pass
    over the rows that are left; payloads nested deeper than ``depth`` are an error.
    """
    rows = history.select("paper_id", F.try_parse_json("payload").alias("v")).where("v is not null")
    out = None
    for _ in range(depth):
        kind = rows.withColumn("kind", F.expr(_kind("v")))
        full = F.expr("try_variant_get(v, '$.full', 'variant')")
        whole = kind.where("kind = 'OBJECT'").withColumn("full", full).withColumn("listed", F.coalesce(F.expr(f"{_kind('full')} = 'ARRAY'"), F.lit(False)))
        whole = whole.withColumn("id", F.when(~F.col("listed"), F.expr(_named("v", "$.reviewer_id"))))
        found = whole.where("id is not null").select("paper_id", "id")
        items = _exploded(kind.where("kind = 'ARRAY'").select("paper_id", "v"))
        values = _exploded(whole.where("not listed and id is null").select("paper_id", "v"))
        own = items.select("paper_id", F.expr(f"CASE WHEN {_kind('v')} = 'OBJECT' THEN {_named('v', '$.reviewer_id')} WHEN {_kind('v')} <> 'ARRAY' THEN {_named('v', '$')} END").alias("id"))
        plain = values.select("paper_id", F.expr(f"CASE WHEN {_kind('v')} NOT IN ('OBJECT', 'ARRAY') THEN {_named('v', '$')} END").alias("id"))
        found = found.unionByName(own.where("id is not null")).unionByName(plain.where("id is not null"))
        out = found if out is None else out.unionByName(found)
        rows = whole.where("listed").select("paper_id", F.col("full").alias("v")).unionByName(values.where(F.expr(f"{_kind('v')} IN ('OBJECT', 'ARRAY')")))
        rows = rows.persist()
        if rows.isEmpty():
            break
    else:
        raise ValueError(f"payloads are nested deeper than {depth}")
    return out.select("paper_id", F.col("id").alias("reviewer_id"))


def _exploded(rows: DataFrame) -> DataFrame:
    """A row for each element or value of the variants ``v``."""
    name = f"history_{id(rows)}"
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.sql(f"SELECT paper_id, x.value AS v FROM {name}, LATERAL variant_explode(v) AS x")


def history_counts(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often each reviewer occurs, and the papers that have any."""
    return ids.groupBy("reviewer_id").agg(F.count("*").alias("load")), ids.select("paper_id").distinct()


def merged_workload(history: DataFrame, saved: DataFrame, live: DataFrame) -> DataFrame:
    """``(reviewer_id, load)``: the history's counts, or the ``saved(reviewer_id, load)`` ones where there is no history, and the ``live(paper_id, reviewer_id)`` ones of papers that the history lacks.

    Whether there is a history is one row that joins, not a decision of the driver.
    """
    counts, papers = history_counts(history)
    any_history = counts.agg((F.count("*") > 0).alias("known"))
    old = saved.join(F.broadcast(any_history)).where("not known").select(F.col("reviewer_id").cast("string").alias("reviewer_id"), F.coalesce("load", F.lit(0)).cast("long").alias("load"))
    new = live.select(F.col("paper_id").cast("string").alias("paper_id"), F.col("reviewer_id").cast("string").alias("reviewer_id")).where("reviewer_id is not null")
    new = new.join(papers.select(F.col("paper_id").cast("string").alias("paper_id")), "paper_id", "left_anti").groupBy("reviewer_id").agg(F.count("*").alias("load"))
    rows = counts.unionByName(old).unionByName(new)
    return rows.groupBy("reviewer_id").agg(F.sum("load").alias("load"))
