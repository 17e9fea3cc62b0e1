"""Files on any storage that Spark reads, and files of a run: digests, names on disk, and a sink that leaves no halves."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``, a folder, file or pattern."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select("path", "length", F.sha2("content", 256).alias("sha256"))


def names_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """(filename) of the files in a folder that may not be there yet; contents aren't read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "filename string")
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"))


def saved(files: DataFrame, folder: str) -> DataFrame:
    """(filename, bytes, error) of ``files`` (filename, body) written into a folder that all executors share.

    A file is written under a temporary name and then renamed, so that its own name only ever holds all of it. What
    fails is reported with its error, and its temporary file is removed; other files aren't affected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *_save(folder, name, body)) for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], ["filename", "bytes", "error"])

    return files.select("filename", "body").mapInArrow(run, "filename string, bytes long, error string")


def _save(folder: str, name: str, body: bytes) -> tuple[int | None, str | None]:
    temporary = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.tmp")
    try:
        os.makedirs(folder, exist_ok=True)
        with open(temporary, "wb") as f:
            f.write(body)
        os.replace(temporary, os.path.join(folder, name))
    except OSError as e:
        if os.path.exists(temporary):
            os.remove(temporary)
        return None, str(e)
    return len(body), None
