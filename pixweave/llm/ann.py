"""Approximate nearest neighbours by inner product: balanced posting lists with an in-memory graph over centroids.

The largest inner product becomes the least distance once every vector gets one more component that brings it to the
largest length (queries get 0). Centroids are fitted on a bounded sample by k-means with a penalty on full clusters.
Every vector goes to its nearest list and, if it lies near a boundary, to more lists whose centroids are almost as
near and lie in other directions. A query walks the graph of centroids from a fixed entry, nearest first, and takes
the lists whose centroid is at most ``ratio`` times as far as the nearest one, and on until they hold k vectors
besides its own. The ratio is calibrated on the sample, against brute force, for the recall that is asked for. Every
row is indexed.

Lists that lie near each other form a shard of about SHARD_ROWS vectors, so there are as many shards as the data
needs, and a query goes to the shards of its lists only, with the numbers of these lists. A shard that has come out
too large is cut into blocks, as are its queries; a task's memory has a bound, and it answers each of its queries once,
from all the lists that it holds. Vectors are scaled by a power of two, which changes no order and no tie, so that
squares of very large or small components don't leave the range of numbers.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id;
a shorter vector counts as padded with zeros; equal vectors are folded and dealt out again, ties go to smaller ids;
repeated ids are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors
from .common import written

#: Vectors that the lists are fitted on, at most, and lists at most: what is broadcast doesn't grow with the data.
SAMPLE, LISTS = 16_384, 4096
#: Vectors per list and per shard aimed at; vectors and queries that meet in one task, at most.
LIST_ROWS, SHARD_ROWS, BLOCK, ASKED = 256, 8192, 65_536, 4096
#: Replicas of a boundary vector at most, and how much farther than the nearest their centroids may be.
REPLICAS, BOUNDARY = 4, 1.1
DEGREE, BEAM = 16, 16
RECALL = 0.97


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0))


@dataclass
class Lists:
    """Centroids with their graph; ``longest`` is the length that vectors are brought to."""

    centroids: np.ndarray
    graph: list[np.ndarray]
    entry: int
    longest: float
    ratio: float = 1.0
    sizes: np.ndarray | None = None  # vectors in each list
    shard: np.ndarray | None = None  # of each list

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]], 1)

    def place(self, x: np.ndarray) -> list[list[int]]:
        """The lists that hold each vector: the nearest, and near ones in other directions."""
        out: list[list[int]] = []
        for at in range(0, len(x), 1024):
            part = self.lifted(x[at : at + 1024])
            d = distances(part, self.centroids)
            near = np.argsort(d, 1, kind="stable")[:, : 2 * REPLICAS]
            far = np.take_along_axis(d, near, 1)
            for lists, dist in zip(near.tolist(), far.tolist(), strict=True):
                mine = lists[:1]
                for j, dj in zip(lists[1:], dist[1:], strict=True):
                    if dj > BOUNDARY * dist[0] or len(mine) == REPLICAS:
                        break
                    if np.min(np.linalg.norm(self.centroids[mine] - self.centroids[j], axis=1)) >= dj:
                        mine.append(j)
                out.append(mine)
        return out

    def choose(self, q: np.ndarray, enough: int = 0) -> list[int]:
        """Lists for a query: best-first search of the graph, for as long as centroids within the ratio turn up, and then
        until the lists hold ``enough`` vectors (one in several lists counts once at least)."""
        c, seen = self.centroids, np.zeros(len(self.centroids), bool)
        q = np.append(q, 0.0)
        seen[self.entry] = True
        d = float(np.linalg.norm(c[self.entry] - q))
        heap, found, best = [(d, self.entry)], [], []
        while heap:
            d, j = heapq.heappop(heap)
            found.append((d, j))
            best = sorted([*best, d])[:BEAM]
            if len(best) == BEAM and d > max(best[-1], self.ratio * best[0]) and self._held(found) >= enough * REPLICAS:
                break
            new = self.graph[j][~seen[self.graph[j]]]
            seen[new] = True
            for x in zip(np.linalg.norm(c[new] - q, axis=1).tolist(), new.tolist(), strict=True):
                heapq.heappush(heap, x)
        found.sort()
        lists = [j for d, j in found if d <= self.ratio * best[0] + 1e-12]
        while self._held(found[: len(lists)]) < enough * REPLICAS and len(lists) < len(found):
            lists.append(found[len(lists)][1])
        return lists

    def _held(self, found: list[tuple[float, int]]) -> int:
        return int(self.sizes[[j for _, j in found]].sum()) if self.sizes is not None and found else 0


def grouped(points: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """A group number for each point: halved across the direction in which they spread most, by weight, again and again."""
    out = np.zeros(len(points), np.int64)
    todo, first = [(np.arange(len(points)), parts)], 0
    while todo:
        own, n = todo.pop()
        if n <= 1 or len(own) <= 1:
            out[own] = first
            first += 1
            continue
        x = points[own] - points[own].mean(0)
        by = own[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        left = n // 2
        cut = int(np.searchsorted(np.cumsum(weights[by]), weights[by].sum() * left / n))
        cut = min(max(cut, 1), len(by) - 1)
        todo += [(by[cut:], n - left), (by[:cut], left)]
    return out


def linked(c: np.ndarray) -> list[np.ndarray]:
    """The graph: each centroid's neighbours. Links to the DEGREE nearest ones go both ways, so that a centroid far from
    all others, which is nobody's nearest, is reached from those that it is nearest to; a ring keeps all in one piece."""
    n = len(c)
    near = [np.argsort(distances(c[at : at + 512], c), 1, kind="stable")[:, 1 : DEGREE + 1] for at in range(0, n, 512)]
    forward = np.concatenate(near) if n > 1 else np.zeros((1, 0), np.int64)
    ring = (np.arange(n) + 1) % n
    a = np.concatenate([np.repeat(np.arange(n), forward.shape[1]), np.arange(n)])
    b = np.concatenate([forward.ravel(), ring])
    pairs = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])], 1), axis=0)
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))


def fit(sample: np.ndarray, longest: float, n: int, k: int, recall: float = RECALL, seed: int = 7) -> Lists:
    """Lists for ``n`` vectors from a sample of them."""
    out = Lists(np.zeros((1, sample.shape[1] + 1)), [np.zeros(0, np.int64)], 0, longest)
    x = out.lifted(sample)
    rng = np.random.default_rng(seed)
    lists = max(1, min(LISTS, -(-n // LIST_ROWS), len(x) // 2 or 1))
    c = x[rng.choice(len(x), lists, replace=False)]
    load = np.zeros(lists)
    for _ in range(12):
        mine = np.empty(len(x), np.int64)
        fair = len(x) / lists
        for at in range(0, len(x), 1024):
            d = distances(x[at : at + 1024], c) ** 2
            mine[at : at + 1024] = np.argmin(d + 0.1 * d.mean() * np.maximum(load / fair - 1, 0)[None, :], 1)
        load = np.bincount(mine, minlength=lists).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, mine, x)
        c = np.where(load[:, None] > 0, sums / np.maximum(load, 1)[:, None], x[rng.choice(len(x), lists)])
    out.centroids = c
    out.graph = linked(c)
    out.entry = int(np.argmin(distances(c.mean(0)[None, :], c)[0]))
    asked = rng.choice(len(x), min(len(x), 256), replace=False)
    held = out.place(sample)
    needed = []
    for i in asked.tolist():
        s = sample @ sample[i]
        s[i] = -np.inf
        top = np.argpartition(-s, min(k, len(s) - 1))[:k]
        d = np.linalg.norm(c - np.append(sample[i], 0.0), axis=1)
        needed += [d[held[j]].min() / max(d.min(), 1e-12) for j in top.tolist() if j != i]
    out.ratio = float(np.quantile(needed, recall)) + 1e-9 if needed else 1.0
    return out


def search(df: DataFrame, k: int = 20, every: int = 20, vec: str = "embedding", id_: str = "vec_id", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, ``k`` near vectors by inner product."""
    spark = df.sparkSession
    single = isinstance(df.schema[vec].dataType.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"
    rows = vectors.valid(df, vec, id_).filter(F.exists("v", lambda x: x != 0))
    _, dims, largest = vectors.shape(rows)
    power = math.frexp(largest)[1] if largest else 0
    all_ = written(vectors.folded(rows, dims, k + 1, dtype), "ann-vectors")
    asked = written(vectors.packed(rows.filter(F.col("id") % every == 0), dims, dtype).withColumn("key", vectors.key()), "ann-queries")
    sample = all_.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow().column(0).to_pylist()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plain = lambda packed: np.frombuffer(b"".join(packed), dtype).reshape(-1, dims).astype(np.float64)
    read = lambda packed: np.ldexp(plain(packed), -power)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((read(b.column(0).to_pylist()) ** 2).sum(1)).max())])], ["longest"])

    longest = all_.select("vec").mapInArrow(lengths, "longest double").agg(F.max("longest")).first()[0]
    lists = fit(read(sample), longest, all_.counted, k, recall)
    placer = spark.sparkContext.broadcast(lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = placer.value.place(read(b.column(0).to_pylist())) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32()))], ["vec", "ids", "lists"])

    posted = written(all_.mapInArrow(place, "vec binary, ids array<long>, lists array<int>").withColumn("list", F.explode("lists")).drop("lists"), "ann-lists")
    sizes = np.zeros(len(lists.centroids), np.int64)
    for r in posted.groupBy("list").count().collect():  # at most LISTS rows
        sizes[r["list"]] = r["count"]
    lists.sizes, lists.shard = sizes, grouped(lists.centroids, sizes, -(-int(sizes.sum()) // SHARD_ROWS))
    chooser = spark.sparkContext.broadcast(lists)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, packed, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, q in enumerate(read(packed) if packed else ()):
                by_shard: dict[int, list[int]] = {}
                for j in chooser.value.choose(q, k + 1):
                    by_shard.setdefault(int(chooser.value.shard[j]), []).append(j)
                out += [(keys[i], packed[i], s, found) for s, found in by_shard.items()]
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["key", "vec", "shard", "lists"])

    posted = posted.withColumn("shard", F.element_at(F.array(*map(F.lit, lists.shard.tolist())), F.col("list") + 1).cast("int"))
    distinct = asked.groupBy("key").agg(F.first("vec").alias("vec"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-asked.counted // ASKED))
    chosen = written(distinct.repartition(tasks).mapInArrow(choose, "key binary, vec binary, shard int, lists array<int>"), "ann-chosen")
    # A row per shard: into how many blocks its vectors and its queries are cut.
    blocks = posted.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks.join(F.broadcast(chosen.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("rounds"))), "shard"))
    deal = lambda n, of: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    left = chosen.join(blocks, "shard").select("shard", deal("rounds", "key").alias("round"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "vec", "lists")
    right = posted.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), deal("blocks", "vec").alias("block"), "vec", "ids", "list")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            b = b.sort_by("list")
            at, packed, ids = b["list"].to_numpy(), b["vec"].to_pylist(), b["ids"].to_pylist()
            q, x, first = read(a["vec"].to_pylist()), read(packed), np.array([i[0] for i in ids])
            number: dict[bytes, int] = {}
            same = np.array([number.setdefault(v, i) for i, v in enumerate(packed)])  # replicas of one vector
            starts, ends = np.searchsorted(at, np.arange(at[-1] + 1)), np.searchsorted(at, np.arange(at[-1] + 1), "right")
            for key, one, mine in zip(a["key"].to_pylist(), q, a["lists"].to_pylist(), strict=True):
                spans = [(starts[j], ends[j]) for j in sorted(mine) if j < len(starts) and ends[j] > starts[j]]
                if not spans:
                    continue
                rows = np.concatenate([np.arange(s, e) for s, e in spans])
                s = (x @ one)[rows] if 4 * len(rows) > len(x) else x[rows] @ one
                few = min((k + 1) * REPLICAS, len(rows))
                bar = np.partition(s, len(s) - few)[len(s) - few]
                top = np.unique(same[rows[s >= bar - 1e-9 * abs(bar)]])
                s = (x[top] * one).sum(1)  # the same sum wherever the vector lies
                best = np.lexsort((first[top], -s))[: k + 1]
                out[0].extend([key] * len(best))
                out[1].extend(np.ldexp(s[best], 2 * power).tolist())
                out[2].extend(ids[j] for j in top[best].tolist())
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], ["key", "score", "ids"])

    by = ["shard", "round", "block"]
    found = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(score, "key binary, score double, ids array<long>")
    return vectors.answers(asked.select("id", "key"), vectors.merged(found.dropDuplicates(), k + 1), k)
