"""Tumbling counts over a stream of served queries.

Rows whose time can't be read can't take part in a watermark; they go to a side stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schema


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schema.TRAIL).json(folder)


def timed(trail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a time, rows without)."""
    stamped = trail.withColumn("time", F.try_to_timestamp("at"))
    return stamped.where("time IS NOT NULL"), stamped.where("time IS NULL").drop("time")


def page_counts(trail: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window, page_id, retrieved, cited; a query repeated in a session at one time counts once."""
    once = trail.withWatermark("time", late).dropDuplicatesWithinWatermark(["session", "query", "time"])
    seen = F.concat(F.transform("retrieved", lambda i: F.struct(i.alias("id"), F.lit(1).alias("r"), F.lit(0).alias("c"))), F.transform("cited", lambda i: F.struct(i.alias("id"), F.lit(0).alias("r"), F.lit(1).alias("c"))))
    each = once.select("time", F.explode(seen).alias("s"))
    return each.groupBy(F.window("time", window), F.col("s.id").alias("page_id")).agg(F.sum("s.r").alias("retrieved"), F.sum("s.c").alias("cited"))
