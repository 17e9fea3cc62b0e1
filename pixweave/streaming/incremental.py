"""Pages that arrive as a stream: extraction keeps no state, so the same plan runs on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def write_candidates(pages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the candidates of every page to Parquet files, each page once."""
    return extract.candidates(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
