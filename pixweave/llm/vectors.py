"""What the two vector searches share: valid rows, equal vectors folded into one, and answers dealt back to query rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid(df: DataFrame, vec: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(id, v): rows with an id and a vector of finite numbers. A vector shorter than the longest counts as padded with zeros."""
    inf = float("inf")
    good = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return df.filter(F.col(id_).isNotNull()).filter(F.coalesce(good, F.lit(False))).select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))


def shape(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, dimensions of the longest vector and the largest magnitude of a component."""
    big = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0.0))
    n, dims, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(big)).first()
    return n, dims or 1, top or 0.0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    ends = np.diff(column.offsets.to_numpy())
    at = np.arange(dims)[None, :] < ends[:, None]
    out[at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def folded(rows: DataFrame, dims: int, keep: int, dtype: str, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(vec binary, ids): a row per distinct vector with its ``keep`` smallest ids.

    Equal vectors tie, and ties go to smaller ids, so no other id of a vector can be among the best ``keep``. Each
    Arrow batch folds its own equal vectors first, so a vector held by a third of all rows arrives as a few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = packed_rows(batch.column(1), dims, dtype, change)
            groups: dict[bytes, list[int]] = {}
            for key, i in zip(packed, batch.column(0).to_pylist(), strict=True):
                groups.setdefault(key, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.binary()), pa.array([sorted(x)[:keep] for x in groups.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    local = rows.mapInArrow(run, "vec binary, ids array<long>")
    return local.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def packed_rows(column: pa.Array, dims: int, dtype: str, change) -> list[bytes]:
    m = matrix(column, dims)
    m = np.ascontiguousarray((change(m) if change else m).astype(dtype))
    return [r.tobytes() for r in m]


def packed(rows: DataFrame, dims: int, dtype: str, change=None) -> DataFrame:
    """(id, vec binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed_rows(batch.column(1), dims, dtype, change), pa.binary())], ["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary")


def key(vec: str = "vec") -> Column:
    return F.unhex(F.md5(vec))


def _falling(score: Column, kind: T.DataType) -> Column:
    """A number that falls as the score rises, and gives the score back if it is taken again; whole numbers don't overflow."""
    return F.bitwise_not(score) if isinstance(kind, T.LongType) else -score


def merged(found: DataFrame, keep: int) -> DataFrame:
    """(key, best): of rows (key, score, ids) the ``keep`` best (score, id), best first, smaller ids first among ties."""
    best = F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(_falling(F.col("score"), found.schema["score"].dataType).alias("minus"), i.alias("id"))))))
    return found.groupBy("key").agg(F.slice(best, 1, keep).alias("best"))


def answers(queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from query rows (id, key): the row's own id is left out once, then the first ``k``."""
    x = queries.join(best, "key").withColumn("own", F.array_position(F.transform("best", lambda b: b["id"]), F.col("id")))
    others = F.filter("best", lambda b, i: i + 1 != F.col("own"))
    x = x.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
    score = _falling(F.col("b.minus"), x.schema["b"].dataType["minus"].dataType)
    return x.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), score.alias("score"))
