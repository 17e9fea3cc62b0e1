"""Shared helpers: the cluster's scratch folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows have been counted and found to be at most this many.
BROADCAST_ROWS = 20_000
#: Rows with texts that a Python worker gets at a time: thousands of long texts don't fit beside each other.
BATCH = 1000
#: Seconds from one time that the driver's JVM gives memory back to the next, at least.
TRIM_S = 5.0

_written: dict[str, None] = {}
_own: list[str] = []
_trimmed: list[float] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a folder of our own only where it is unset.

    A folder of our own is on this machine, which only a local session can share with its tasks: elsewhere it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="pixweave-"))
        path = _own[0]
    return path.rstrip("/")


def written(df: DataFrame, name: str, count: Column | None = None, per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and outlives lost executors.

    The result's ``counted`` is the number of rows (or of those for which ``count`` is true), taken by the same job.
    No file gets more than ``per_file`` rows, if that is above 0.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count_if(F.lit(True) if count is None else count).alias("n")).write
    (writer.option("maxRecordsPerFile", per_file) if per_file > 0 else writer).parquet(path)
    _written[path] = None
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch, back.counted = path, seen.get["n"]
    if not _trimmed or time.monotonic() - _trimmed[-1] > TRIM_S:
        trimmed(spark)
    return back


def trimmed(spark: SparkSession) -> str | None:
    """Have the driver's JVM give freed native memory back to the system; its answer, or None from a JVM that can't.

    What compiles, loads and compresses beside the heap allocates from pools that keep what was freed once. In a driver
    that plans thousands of stages they grow from one to the next.
    """
    jvm = spark._jvm
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(beans, args)
    except Py4JError:
        return None
    finally:
        _trimmed[:] = [time.monotonic()]


def collected(spark: SparkSession) -> None:
    """Have executors collect their garbage, after which their heaps shrink to what is in use.

    A heap that has grown to its limit in one stage stays there, while the Python workers of the next need memory beside
    it. A task for each core asks for it, so that every executor is reached that has its cores free.
    """
    n = max(spark.sparkContext.defaultParallelism, 1)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def freed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for table_ in tables:
        path = getattr(table_, "scratch", None)
        if path in _written:
            del _written[path]
            _delete(table_.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this driver that is left. Call it once the results have been stored."""
    while _written:
        _delete(spark, _written.popitem()[0])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).collect()) <= limit else df


#: Words of 64 bits in the bitmap of ``likely``: 1 MB, whatever the size of the data.
BITMAP = 1 << 17


def likely(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows of ``df`` whose hash ``key`` may be among the hashes ``wanted_key`` of ``wanted``, with few others.

    A filter before a join of long rows with few short ones: a bitmap of fixed size with a bit for each hash, sent to
    all tasks. As ``wanted`` outgrows it more rows pass, and the join after it sees to what is right.
    """
    word, bit = (lambda h: F.pmod(F.shiftright(h, 6), F.lit(BITMAP))), (lambda h: h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    bits = wanted.select(wanted_key.alias("h")).select(word(F.col("h")).alias("_word"), bit(F.col("h")).alias("at"))
    bits = bits.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("_bits"))
    x = df.withColumn("_hash", key).withColumn("_word", word(F.col("_hash"))).join(F.broadcast(bits), "_word")
    return x.filter(F.getbit("_bits", bit(F.col("_hash"))) == 1).drop("_hash", "_word", "_bits")


def in_small_batches(operator):
    """While ``operator`` (whose first argument is a DataFrame) runs, Python workers get at most BATCH rows at a time.

    For operators that run their jobs before they return; the session's own setting holds again afterwards.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options):
        conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        held = conf.get(name)
        if not 0 < int(held) <= BATCH:
            conf.set(name, str(BATCH))
        try:
            return operator(docs, *args, **options)
        finally:
            conf.set(name, held)

    return run


def tidied(batches: Iterator) -> Iterator:
    """What a Python worker yields; at its end the memory that it has freed goes back to the system.

    Workers are kept for the tasks of later operators, and their allocators keep what was freed once.
    """
    yield from batches
    given_back()


def given_back() -> None:
    """Memory that this Python process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded(df: DataFrame, name: str) -> DataFrame:
    """``df``, which holds a map of texts through Python, ``written`` in small batches: for executors with little memory."""
    return in_small_batches(written)(df, name)


def fresh(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``docs`` has."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batches, which Spark bounds in bytes (64 MB unless set), in smaller parts: few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
