"""Near-duplicate documents: banded MinHash, odd sketches, links confirmed on full shingle sets, connected components.

1. Every text becomes its set of hashed word shingles, MinHash samples, band keys over the first of them and an odd
   sketch of all: each sample flips one bit of a bitmap, so that the population count of two bitmaps' XOR estimates how
   many samples differ. Equal sets are folded into one node, so exact copies cost nothing further.
2. In every band bucket each node is paired with one leader, the bucket's smallest node. Sketches drop the pairs that
   are far off; each node's best pair is confirmed on full sets. Components follow.
3. Components that share a bucket (by its leader) form a cluster, so nodes that share any bucket lie in one cluster.
   In a cluster of several components each node outside the largest one meets all others by sketch, a block of them at
   a time; only nodes that a sketch finds near go on to be compared on full sets, in the same blocks, and a block
   reports no more links than join something. So no bucket has a cap and no group emits its pairs. The sketches
   compared are quadratic in the nodes of a cluster that are not joined (some 20 ns a pair), rows and sets are not.

What can be missed: a pair at similarity 0.8 shares no band with chance (1 - 0.8 ** 4) ** 24, 3 in a million; its
sketches lie beyond the bar with chance 3 in ten million (five standard deviations). Both fall steeply above 0.8, and
a component loses a node only if all of its links are missed. What is kept together has been confirmed on full sets.

Edge cases: null and empty texts, and texts without words, have the empty set and are linked with nothing; a text with
fewer words than a shingle has is one shingle; texts of any length are read whole; repeated rows are copies of each
other; null ids are linked like others but name a component only if it has no other id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, in_small_batches, likely, sliced, small, tidied, written

BANDS, ROWS = 24, 4
#: MinHash samples, the first BANDS * ROWS of which make band keys, and the bits of a sketch of all.
SAMPLES, BITS = 256, 1024
#: Text that is hashed at a time, and nodes of a cluster that meet in one task.
CHUNK_BYTES, BLOCK = 1 << 20, 256
#: Standard deviations by which the sketch bar lies above what a pair shows on average.
DEVIATIONS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chained(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _mixed(key * np.uint64(0xA24BAED4963EE407) + x)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        ones = np.ones(max(n, CHUNK_BYTES), np.uint64)
        ones[1:] = _BASE
        up = np.multiply.accumulate(ones)
        ones[1:] = _INVERSE
        _powers[:] = [up, np.multiply.accumulate(ones)]
    return _powers[0][:n], _powers[1][:n]


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Every text's sorted distinct shingle hashes; texts are lower-cased over A-Z and cut at ASCII white space."""
    buffer = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    if len(start) > len(end):
        start = start[: len(end)]
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[end] - sums[start]) * down[start] if len(start) else np.zeros(0, np.uint64)
    h = _mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, ends)
    first = np.concatenate([[0], last[:-1]])
    s = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for i in range(words):
        s = _chained(s, h[i : i + len(s)]) if len(s) else s
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:  # fewer words than a shingle has: all of them are one, never equal to a longer one
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = _chained(one, x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of 32 bits, a row per non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, hashed = np.empty((SAMPLES, len(sets)), np.uint32), np.empty_like(flat)
    for i, (x, m) in enumerate(zip(_XOR, _MUL, strict=True)):
        np.bitwise_xor(flat, x, out=hashed)
        np.multiply(hashed, m, out=hashed)
        np.minimum.reduceat(hashed, at, out=out[i])
    return out.T


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :], (len(sample), BANDS))
    for r in range(ROWS):
        key = _chained(key, sample[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
    return key.view(np.int64)


def odd_sketches(sample: np.ndarray) -> list[bytes]:
    """Bitmaps in which every sample flips the bit that it hashes to."""
    bit = (_mixed(sample.astype(np.uint64) + np.arange(sample.shape[1], dtype=np.uint64)[None, :] * _BASE) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(len(sample))[:, None] * BITS).ravel(), minlength=len(sample) * BITS).reshape(-1, BITS)
    return [r.tobytes() for r in np.packbits((flips & 1).astype(np.uint8), axis=1)]


def bar(similarity: float) -> int:
    """The largest XOR count of a pair at ``similarity``: its mean and ``DEVIATIONS`` standard deviations.

    The number of differing samples is binomial; each makes two flips, and m flips leave Z of the bits odd, where
    E[Z] = BITS/2 * (1 - q**m) and Var[Z] = BITS/4 * (1 - r**m) + BITS*(BITS-1)/4 * (r**m - q**(2*m)), up to terms that
    vanish, with q = 1 - 2/BITS and r = 1 - 4/BITS. Both variances together make one deviation.
    """
    differ = SAMPLES * (1 - similarity)
    m, q, r = 2 * differ, 1 - 2 / BITS, 1 - 4 / BITS
    mean = BITS / 2 * (1 - q**m)
    of_flips = BITS / 4 * (1 - q ** (2 * m)) + BITS * (BITS - 1) / 4 * (r**m - q ** (2 * m))
    slope = -BITS * math.log(q) * q**m
    return math.ceil(mean + DEVIATIONS * math.sqrt(max(of_flips, 0) + slope**2 * differ * similarity))


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tk, n, node, bands, sketch); node is a digest of the shingle set, null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for a, b in chunks(texts):
                sets = shingles(texts[a:b], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                node, bands, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    sample = samples([sets[i] for i in full])
                    for i, k, s in zip(full, band_keys(sample).tolist(), odd_sketches(sample), strict=True):
                        node[i], bands[i], sketch[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), k, s
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tk", "n", "node", "bands", "sketch"])
            pa.default_memory_pool().release_unused()
        _powers.clear()  # the worker goes on to other tasks

    kind = docs.schema["doc_id"].dataType.simpleString()
    x = docs.select("doc_id", text_key().alias("tk"), F.col("text").cast("binary").alias("text"))
    return x.mapInArrow(lambda batches: tidied(run(batches)), f"doc_id {kind}, tk binary, n long, node binary, bands array<long>, sketch binary")


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def _full(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, full): the shingle sets of the ``wanted`` nodes, read again from their representatives' texts."""
    rep = written(nodes.join(wanted, "node", "left_semi").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.tk").alias("key")), "near-wanted")
    x = docs.select("doc_id", text_key().alias("tk"), F.col("text").cast("binary").alias("text"))
    x = likely(x, F.xxhash64("doc_id", "tk"), rep, F.xxhash64("id", "key"))
    texts = x.join(rep, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("key"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = batch.column(1).to_pylist()
            for a, b in chunks(found):
                full = [s.tobytes() for s in shingles(found[a:b], words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(full, pa.binary())], ["node", "full"])
        _powers.clear()

    full = written(texts.mapInArrow(run, "node binary, full binary").dropDuplicates(["node"]), "near-sets")
    freed(rep)
    return full


def alike(p: np.ndarray, q: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets reach the similarity, as a fraction of whole numbers."""
    small_, large = (p, q) if len(p) <= len(q) else (q, p)
    at = np.searchsorted(large, small_)
    both = int((large[np.minimum(at, len(large) - 1)] == small_).sum())
    return similarity[1] * both >= similarity[0] * (len(p) + len(q) - both)


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose full sets reach the similarity."""
    full = _full(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes, words)

    def column(left: pa.Array, right: pa.Array) -> pa.Array:
        read = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        return pa.array([alike(read(x), read(y), similarity) for x, y in zip(left, right, strict=True)], pa.bool_())

    x = pairs.select("a", "b").join(full.select(F.col("node").alias("a"), F.col("full").alias("fa")), "a")
    x = x.join(full.select(F.col("node").alias("b"), F.col("full").alias("fb")), "b")
    links = written(x.withColumn("ok", F.arrow_udf(column, "boolean")("fa", "fb")).filter("ok").select("a", "b"), "near-links")
    freed(full)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link (a, b) but the smallest of its component, which is ``comp``.

    Each node hooks to its least smaller neighbour, pointers are doubled until they reach a root, and links are
    contracted to the roots' links. Every round at least the greater end of each link disappears, and the links of a
    round are distinct ones between roots, so the work falls from round to round.
    """
    def ordered(x: DataFrame) -> DataFrame:
        return written(x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "near-edges")

    edges, labels = ordered(links), None
    while edges.counted:
        up = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")), "near-up")
        moved = True
        while moved:
            there = up.select(F.col("node").alias("at"), F.col("comp").alias("next"))
            jumped = up.join(there, F.col("comp") == F.col("at"), "left").select("node", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved"))
            jumped = written(jumped, "near-up", F.col("moved"))
            moved = jumped.counted > 0
            freed(up)
            up = jumped
        there = up.select(F.col("node").alias("at"), F.col("comp").alias("root"))
        new = up.select("node", "comp")
        if labels is not None:
            new = labels.join(there, F.col("comp") == F.col("at"), "left").select("node", F.coalesce("root", "comp").alias("comp")).unionByName(new)
        new, x = written(new, "near-labels"), edges
        for end in ("a", "b"):
            x = x.join(there, F.col(end) == F.col("at"), "left").withColumn(end, F.coalesce("root", end)).drop("at", "root")
        x = ordered(x)
        freed(edges, up, *([] if labels is None else [labels]))
        edges, labels = x, new
    return labels if labels is not None else links.sparkSession.createDataFrame([], "node binary, comp binary")


def _placed(rows: DataFrame, comp: DataFrame, node: str = "node", into: str = "comp") -> DataFrame:
    """``rows`` with the component of a column's nodes."""
    x = rows.join(comp.select(F.col("node").alias("_at"), F.col("comp").alias("_comp")), F.col(node) == F.col("_at"), "left")
    return x.withColumn(into, F.coalesce("_comp", node)).drop("_at", "_comp")


def _apart(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bits in which two sketches differ."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in (a, b))
    return pa.array(np.bitwise_count(x ^ y).sum(1), pa.int32())


def _best(pairs: DataFrame, nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): of each node's pairs that sizes and sketches allow, the nearest."""
    num, den = similarity
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    x = x.select("a", "b", F.arrow_udf(_apart, "int")("s_a", "s_b").alias("apart")).filter(F.col("apart") <= bar(num / den))
    return x.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", "m.b")


def linked(docs: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(node, comp) of all nodes that links join to a smaller one."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    buckets = written(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1").drop("size"), "near-buckets")
    pairs = written(rows.join(buckets, "key").filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "near-pairs")
    best = written(_best(pairs, nodes, similarity), "near-best")
    links = _confirmed(best, docs, nodes, words, similarity)
    comp = components(links)
    across = _placed(_placed(pairs, comp, "a", "a"), comp, "b", "b").filter("a != b").select("a", "b")
    clusters = components(across)
    freed(buckets, pairs, best)
    more = written(_within(clusters, comp, docs, nodes, words, similarity), "near-more")
    if more.counted:
        comp = components(links.unionByName(more))
    freed(links, more)
    return comp


def _within(clusters: DataFrame, comp: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links between components of one cluster, as many as it takes to join all that the full sets join."""
    (num, den), high = similarity, bar(similarity[0] / similarity[1])
    roots = clusters.select(F.col("comp").alias("root")).distinct()
    named = written(clusters.withColumnRenamed("comp", "cluster").unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("cluster"))), "near-clusters")
    placed = _placed(nodes.select("node", "n", "sketch"), comp)
    placed = written(placed.join(named.select(F.col("node").alias("comp"), "cluster"), "comp"), "near-open")
    per = placed.groupBy("cluster", "comp").agg(F.count("*").alias("c")).groupBy("cluster")
    per = per.agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("size"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    per = written(per.filter("size > 2").select("cluster", F.col("m.comp").alias("major"), parts(F.col("size")).alias("blocks"), F.greatest(parts(F.col("size") - F.col("m.c")), F.lit(1)).alias("rounds")), "near-shapes")
    x = placed.join(per, "cluster")
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cluster", "block", "round", "few", "node", "comp", "n", "sketch"]
    few = x.filter("comp != major").withColumn("block", each("blocks")).withColumn("round", dealt("rounds")).withColumn("few", F.lit(True))
    all_ = x.withColumn("round", each("rounds")).withColumn("block", dealt("blocks")).withColumn("few", F.lit(False))
    by = ["cluster", "block", "round"]

    def near(table: pa.Table) -> pa.Table:
        """Of the rows of a block those that have a near one on the other side, in another component."""
        few, size, word = table["few"].to_numpy(zero_copy_only=False), table["n"].to_numpy(), b"".join(table["sketch"].to_pylist())
        comp, sketch = np.unique(np.array(table["comp"].to_pylist(), object), return_inverse=True)[1], np.frombuffer(word, np.uint64).reshape(len(few), -1)
        rest, hit = np.flatnonzero(~few), np.zeros(len(few), bool)
        for i in np.flatnonzero(few).tolist():
            fit = (comp[rest] != comp[i]) & (np.minimum(size[rest], size[i]) * den >= np.maximum(size[rest], size[i]) * num)
            left = rest[fit]
            found = left[np.bitwise_count(sketch[left] ^ sketch[i]).sum(1) <= high]
            hit[found] = True
            hit[i] = len(found) > 0
        return table.filter(pa.array(hit))

    found = few.select(columns).unionByName(all_.select(columns)).groupBy(by).applyInArrow(near, "cluster binary, block int, round int, few boolean, node binary, comp binary, n long, sketch binary")
    found = written(found, "near-found")
    freed(named, placed, per)
    if not found.counted:
        return found.select(F.col("node").alias("a"), F.col("node").alias("b"))
    full = _full(found.select("node").distinct(), docs, nodes, words)
    return found.join(full, "node").groupBy(by).applyInArrow(lambda t: _joining(t, high, num, den), "a binary, b binary")


def _joining(table: pa.Table, high: int, num: int, den: int) -> pa.Table:
    """The links of a block's few to its others; those that join nothing that isn't joined already are passed over."""
    table = table.sort_by("node")
    flags = table["few"]
    a, ca, sa, fa, b, cb, sb, fb = (t[c].to_pylist() for t in (table.filter(flags), table.filter(pa.compute.invert(flags))) for c in ("node", "comp", "sketch", "full"))
    out: tuple[list, list] = ([], [])
    if a and b:
        read = lambda x: np.frombuffer(x, np.uint64)
        sketches, sizes = read(b"".join(sb)).reshape(len(b), -1), np.array([len(f) // 8 for f in fb])
        flat = np.concatenate([read(f) for f in fb])
        order = np.argsort(flat, kind="stable")
        flat, member = flat[order], np.repeat(np.arange(len(fb)), sizes)[order]  # which sets hold a shingle
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while x in up:
                x = up[x]
            return x

        for node, c, s, f in zip(a, ca, sa, fa, strict=True):
            apart = np.bitwise_count(sketches ^ read(s)[None, :]).sum(1)
            own = read(f)
            first, last = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            count = last - first
            held = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(member[held], minlength=len(b))  # the full sets' intersections, all at once
            linked_ = np.flatnonzero((apart <= high) & (den * both >= num * (len(own) + sizes - both)))
            for j in linked_[np.argsort(apart[linked_], kind="stable")].tolist():
                mine, theirs = root(c), root(cb[j])
                if mine != theirs:
                    up[max(mine, theirs)] = min(mine, theirs)
                    out[0].append(node)
                    out[1].append(b[j])
    return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])


def _first() -> Column:
    """The row that stands for others: the smallest id that isn't null, then the smallest text digest."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tk")


@in_small_batches
def grouped(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, tk, n_shingles, node, best): ``tk`` is the text's digest, ``node`` its set's, ``best`` the first row of
    its component as struct<last, doc_id, tk>; node and best are null for the empty set."""
    described = written(_described(docs, words), "near-described")
    per_set = (F.min(_first()).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(described.filter("node is not null").groupBy("node").agg(*per_set), "near-nodes")
    comp = linked(docs, nodes, words, similarity)
    placed = written(_placed(nodes.select("node", "rep"), comp), "near-comp")
    best = written(placed.groupBy("comp").agg(F.min("rep").alias("best")), "near-best")
    per_node = written(placed.join(best, "comp").select("node", "best"), "near-names")
    freed(nodes, comp, placed, best)
    return described.select("doc_id", "tk", F.col("n").alias("n_shingles"), "node").join(per_node, "node", "left")


def digest(docs: DataFrame, words: int = 4) -> DataFrame:
    """The contract's columns: doc_id, n_shingles, component_id, kept."""
    x = grouped(docs.select("doc_id", "text"), words)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return x.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dropped(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one document of every group: the one with the smallest id; empty texts all stay.

    Of rows that repeat both the id and the text of the one that stays, one is kept.
    """
    found = grouped(docs.select("doc_id", "text"), words).filter("node is not null")
    found = written(found.withColumn("stays", (F.col("best.tk") == F.col("tk")) & F.col("best.doc_id").eqNullSafe(F.col("doc_id"))), "near-groups")
    pair = (F.col("doc_id").alias("id"), F.col("tk").alias("key"))
    gone = small(written(found.filter("not stays").select(*pair).distinct(), "near-gone"), 100_000)
    again = written(found.filter("stays").groupBy("doc_id", "tk").count().filter("count > 1").select(*pair), "near-again")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("key"))
    rows = docs.select(text_key().alias("tk"), F.struct(*docs.columns).alias("row")).join(gone, same, "left_anti")
    if again.counted:
        first = rows.join(small(again), same, "left_semi").groupBy("row.doc_id", "tk").agg(F.first("row").alias("row"))
        rows = rows.join(small(again), same, "left_anti").select("row").unionByName(first.select("row"))
    return rows.select("row.*")
