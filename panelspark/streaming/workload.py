"""Live workload as a stream (X01, X02): the latest panel of each paper counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame) -> DataFrame:
    """The rows of the latest update of each paper ``(paper_id, reviewer_id, ts)``; repeats of an update change nothing."""
    last = rows.groupBy("paper_id").agg(F.max("ts").alias("ts"))
    return rows.join(last, ["paper_id", "ts"]).select("paper_id", "reviewer_id", "ts").distinct()


def counts(state: DataFrame) -> DataFrame:
    """X02."""
    return state.groupBy("reviewer_id").agg(F.count("*").alias("load"))


def start(updates: DataFrame, path: str, checkpoint: str):
    """A query that upserts panels into ``path``, one version a batch, so a repeated batch rewrites the same rows.

    State is read from the version before; a batch that is run again after a failure reads
    the same one. ``read`` gives the newest version.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = batch.select("paper_id", "reviewer_id", "ts")
        if n > 0:
            now = now.unionByName(spark.read.parquet(f"{path}/v={n - 1}"))
        latest(now).write.mode("overwrite").parquet(f"{path}/v={n}")

    return updates.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark, path: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.where(F.col("v") == rows.agg(F.max("v")).first()[0]).drop("v")
