"""Intermediate tables: written once, read often, on storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else a folder in the warehouse; never a machine's own temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return path.rstrip("/")


def stored(df: DataFrame, name: str, count: Column | None = None) -> DataFrame:
    """``df`` written and read back, which cuts its lineage. ``counted`` is the number of rows (for which ``count`` holds)."""
    path, seen = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count_if(F.lit(True) if count is None else count).alias("n")).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.counted = seen.get["n"]
    return back
