"""Exact top-k by inner product: columnar branch-and-bound.

Candidates lie in vertical blocks, a row per dimension. Scores grow by blocks of dimensions. After each block a
candidate stays only if its score so far plus the most that its remaining dimensions can add (the product of both
sides' remaining lengths, by Cauchy and Schwarz) reaches the query's k-th best score; the rest is compacted away.
Queries go round in bounded chunks; a chunk is a broadcast of a fixed number of rows and each candidate is read once
for it. Every task reports its best per query, which a last aggregation merges.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; a
shorter vector counts as padded with zeros; equal vectors are folded and dealt out again, so that ties go to smaller
ids; repeated ids are rows of their own; with fewer than k candidates all are returned; an empty table gives an empty
result; extra columns are ignored. Components are clipped to 64 bits after quantisation, and scores that don't fit
64 bits are the nearest number that does, after an exact sum; such scores tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import written

#: Distinct query vectors of one round; with 64 dimensions this is at most 16 MB.
CHUNK = 32_768
#: Candidates that a task has at least before more tasks are made than there are cores.
PER_TASK = 262_144
#: Dimensions added between two looks at the bound, and queries in one matrix product.
STEP, BATCH = 16, 64
FEW = 512


def quantised(m: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(256.0 * m), -(2.0**63), 2.0**63 - 1024)


class Search:
    """The best ``keep`` candidate vectors of each query among all blocks seen so far."""

    def __init__(self, queries: np.ndarray, keep: int, exact: bool):
        self.q, self.whole, self.keep, self.exact = queries.astype(np.float64), queries, keep, exact
        n, self.d = queries.shape
        self.cuts = list(range(STEP, self.d, STEP))
        self.rest = [np.sqrt((self.q[:, c:] ** 2).sum(1)) for c in self.cuts]
        self.scores = [np.empty(0, np.int64) for _ in range(n)]
        self.ids: list[list[list[int]]] = [[] for _ in range(n)]
        self.bar = np.full(n, -np.inf)

    def add(self, block: np.ndarray, ids: list[list[int]]) -> None:
        for a, b in ((0, FEW), (FEW, len(block))) if len(block) > FEW and not np.isfinite(self.bar).all() else ((0, len(block)),):
            if a < b:
                self._add(block[a:b], ids[a:b])

    def _add(self, block: np.ndarray, ids: list[list[int]]) -> None:
        x = np.ascontiguousarray(block.T.astype(np.float64))
        rest = [np.sqrt((x[c:] ** 2).sum(0)) for c in self.cuts]
        slack = 1 + 1e-9
        first = self.cuts[0] if self.cuts else self.d
        for at in range(0, len(self.q), BATCH):
            part = slice(at, at + BATCH)
            score = self.q[part, :first] @ x[:first]
            if self.cuts:
                alive = score + np.outer(self.rest[0][part] * slack, rest[0]) + 1e-6 >= self.bar[part, None]
            else:
                alive = np.ones(score.shape, bool)
            for j in range(len(score)):
                i, live = at + j, np.flatnonzero(alive[j])
                s, low = score[j, live], first
                for n, cut in enumerate([*self.cuts[1:], self.d] if self.cuts else [], 1):
                    if not len(live):
                        break
                    s = s + self.q[i, low:cut] @ x[low:cut, live]
                    low = cut
                    bound = s + self.rest[n][i] * slack * rest[n][live] + 1e-6 if cut < self.d else s + (0 if self.exact else np.abs(s) * 1e-9 + 1)
                    stay = bound >= self.bar[i]
                    live, s = live[stay], s[stay]
                if len(live):
                    self._keep(i, block[live], s, [ids[k] for k in live.tolist()])

    def _keep(self, i: int, block: np.ndarray, score: np.ndarray, ids: list[list[int]]) -> None:
        if self.exact:
            score = score.astype(np.int64)
        else:
            own = self.whole[i].tolist()
            score = np.array([min(max(sum(a * b for a, b in zip(own, row, strict=True)), -(1 << 63)), (1 << 63) - 1) for row in block.tolist()], np.int64)
        score = np.concatenate([self.scores[i], score])
        ids = self.ids[i] + ids
        order = np.lexsort(([x[0] for x in ids], ~score))[: self.keep]
        self.scores[i], self.ids[i] = score[order], [ids[k] for k in order.tolist()]
        if len(order) == self.keep:
            worst = int(score[order[-1]])
            self.bar[i] = worst if worst > -(1 << 63) else -np.inf  # at the least number lower sums tie


def top_k(df: DataFrame, k: int = 5, every: int = 50, vec: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the ``k`` largest integer inner products."""
    spark = df.sparkSession
    rows = vectors.valid(df, vec, id_)
    n, dims, top = vectors.shape(rows)
    widest = 256 * top + 1
    exact, dtype = widest * widest * max(dims, 1) < 2.0**53, "<i4" if widest < 2.0**31 else "<i8"
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // PER_TASK))
    all_ = written(vectors.folded(rows, dims, k + 1, dtype, quantised).repartition(tasks), "topk-vectors")
    asked = written(vectors.packed(rows.filter(F.col("id") % every == 0), dims, dtype, quantised).withColumn("key", vectors.key()), "topk-queries")
    distinct = written(asked.groupBy("key").agg(F.first("vec").alias("vec")), "topk-distinct")
    chunks = -(-distinct.count() // CHUNK)
    found = []
    for c in range(chunks):
        part = distinct.filter(F.pmod(F.xxhash64("key"), F.lit(chunks)) == c).select("vec").toArrow().column(0).to_pylist()
        sent = spark.sparkContext.broadcast((part, dims))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, d = sent.value
            search = Search(np.frombuffer(b"".join(queries), dtype).reshape(-1, d), k + 1, exact) if queries else None
            for batch in batches if search else ():
                if batch.num_rows:
                    search.add(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype).reshape(-1, d), batch.column(1).to_pylist())
            for i in range(0, len(queries), 4096):
                keys = [hashlib.md5(q).digest() for q in queries[i : i + 4096]]
                lines = [(key, int(s), ids) for j, key in enumerate(keys, i) for s, ids in zip(search.scores[j], search.ids[j], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in lines], pa.binary()), pa.array([x[1] for x in lines], pa.int64()), pa.array([x[2] for x in lines], pa.list_(pa.int64()))], ["key", "score", "ids"])

        found.append(all_.mapInArrow(run, "key binary, score long, ids array<long>"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if chunks > 1:
        found = [written(x, "topk-found") for x in found]
    return vectors.answers(asked.select("id", "key"), vectors.merged(reduce(DataFrame.unionByName, found), k + 1), k)
