"""Removal of repeated byte strings with sharded suffix arrays.

Every window of ``length`` bytes picks one anchor among its inner strings of 64 bytes, the one with the least hash.
Windows of equal bytes pick the same anchor at the same place, so equal windows meet under their anchor's hash. The
run of windows of a document that pick one anchor is a segment. Segments whose anchor occurs once in the corpus hold
nothing repeated. Equal segments are folded into one that is counted; if it occurs twice it repeats as a whole. The
bytes of the distinct segments under a repeated anchor go to shards; each shard is one text whose suffix array, by
induced sorting, and permuted common prefixes tell which windows start with ``length`` bytes that also start elsewhere.

An anchor with very many different segments (a sentence that is everywhere) doesn't go to a shard as a whole: its
segments are cut into runs of a few windows, which are dealt out by the hash of the bytes that a run's windows share;
only runs with a partner go on. Where very many runs meet even so (the inside of that sentence), they are cut into
single windows; equal windows are folded like equal segments. So no shard holds more than MANY strings that belong
together, and nothing is capped.

The common prefixes also show shorter repeats, from ``short`` bytes on. They are reported beside the removals, and not
removed. Repeats of ``length`` bytes are all found; of shorter ones those that lie around an anchor that both texts
picked, which the more texts share a passage the surer happens. Under a crowded anchor these are counted as strings of
``short`` bytes at every SHORT_RUN-th distance from the anchor. A text between the two lengths is one segment.

Edge cases: null counts as empty; texts shorter than ``length`` keep all; matches never cross documents; texts of any
length are read whole, in overlapping pieces; repeated rows repeat each other; null ids are treated like others; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, in_small_batches, likely, sliced, written
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 400
#: Shorter repeats that are reported, and the steps at which they are looked up under a crowded anchor.
SHORT, SHORT_RUN = 256, 32
#: Bytes of an anchor, and bytes of a document read at a time.
ANCHOR, PIECE = 64, 1 << 22
#: Bytes in a shard aimed at; distinct segments of an anchor beyond which they are cut into runs of so many windows.
SHARD, MANY, RUN = 1 << 20, 512, 8
#: Shards that one task sorts, one after the other.
PER_TASK = 8

_TABLE = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on, by doubling."""
    h, k = _TABLE[raw], 1
    while k < ANCHOR:
        h = h[:-k] * np.uint64(pow(_FACTOR, k, 1 << 64)) + h[k:]
        k *= 2
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def segments(text: bytes, length: int = LENGTH, short: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, anchor's place, first window, windows): all windows of the text, by the anchor that they pick.

    A text shorter than a window, of at least ``short`` bytes, is one segment without windows.
    """
    if short and short <= len(text) < length:
        h = _hashes(np.frombuffer(text, np.uint8))
        least = int(np.argmin(h & ~_PLACE))
        yield int(h.view(np.int64)[least]), least, 0, 0
    for piece in range(0, max(len(text) - length + 1, 0), PIECE):
        raw = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - piece), piece)
        h = _hashes(raw)
        m, k, width = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - ANCHOR + 1
        while 2 * k <= width:  # the least of each window; its place is in the low bits
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if k < width:
            m = np.minimum(m[: len(m) - (width - k)], m[width - k :])
        at = (m & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        count = np.diff(np.append(first, len(at)))
        own = at[first]
        yield from zip(h[own].view(np.int64).tolist(), (own + piece).tolist(), (first + piece).tolist(), count.tolist(), strict=True)


def row_key() -> Column:
    return F.xxhash64("text")


def _occurrences(docs: DataFrame, length: int, short: int) -> DataFrame:
    """(anchor, seg, doc_id, dk, start, windows, back): a row per segment; ``back`` is from the first window to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "seg", "at", "start", "windows", "back"]
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in names]

            def flush(batch=batch):
                at = pa.array(rows[2], pa.int64())
                out = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), batch.column(0).take(at), batch.column(1).take(at), *(pa.array(r, pa.int32()) for r in rows[3:])]
                for r in rows:
                    r.clear()
                return pa.RecordBatch.from_arrays(out, ["anchor", "seg", "doc_id", "dk", "start", "windows", "back"])

            for i, text in enumerate(batch.column(2).to_pylist()):
                for anchor, place, first, count in segments(text or b"", length, short):
                    seg = xxhash.xxh3_128_digest(text[first : first + count + length - 1], seed=place - first)
                    for r, x in zip(rows, (anchor, seg, i, first, count, place - first), strict=True):
                        r.append(x)
                if len(rows[0]) > 50_000:
                    yield flush()
            if rows[0]:
                yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    x = docs.select("doc_id", row_key().alias("dk"), F.col("text").cast("binary").alias("text"))
    return x.mapInArrow(run, f"anchor long, seg binary, doc_id {kind}, dk long, start int, windows int, back int")


def _same(a: str = "doc_id", b: str = "id") -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col("dk") == F.col("key"))


def _runs(text: bytes, anchor: int, first: int, windows: int, length: int, run: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, first byte, bytes): windows of ``length`` bytes by their distance to the anchor, ``run`` of them at a time.

    The key is a hash of the bytes that all windows of a run share, so equal windows of two texts meet under one key.
    """
    high = anchor - first
    while high > anchor - first - windows:
        step = high // run
        low = max(step * run, anchor - first - windows + 1)
        core = text[anchor - step * run : anchor - step * run - run + 1 + length]
        yield xxhash.xxh3_64_intdigest(core, seed=step * length) - (1 << 63), anchor - high, text[anchor - high : anchor - low + length]
        high = low - 1


def _cut(docs: DataFrame, wanted: DataFrame, length: int, short: int) -> DataFrame:
    """(shard_key, anchor, seg, offset, content): the wanted segments' bytes, those of crowded anchors cut into runs; without content strings of ``short`` bytes."""
    lists = wanted.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("anchor", "seg", "start", "windows", "back", "many")).alias("list"))
    lists = lists.select(F.col("doc_id").alias("id"), F.col("dk").alias("key"), "list")
    x = docs.select("doc_id", row_key().alias("dk"), F.col("text").cast("binary").alias("text"))
    x = likely(x, F.xxhash64("doc_id", "dk"), wanted, F.xxhash64("doc_id", "dk")).join(lists, _same()).select("text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("shard_key", pa.int64()), ("anchor", pa.int64()), ("seg", pa.binary()), ("offset", pa.int32()), ("content", pa.binary()))
        rows: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])
            rows.clear()
            return out

        for batch in sliced(batches):
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in found:
                    first, count, anchor = s["start"], s["windows"], s["start"] + s["back"]
                    if not s["many"]:
                        rows.append((s["anchor"], s["anchor"], s["seg"], 0, text[first : first + count + length - 1]))
                    else:
                        rows += [(key, s["anchor"], s["seg"], a - first, content) for key, a, content in _runs(text, anchor, first, count, length, RUN)]
                        for a in range(anchor, max(-1, anchor + ANCHOR - short - 1), -SHORT_RUN):
                            if a + short <= len(text):
                                rows.append((xxhash.xxh3_64_intdigest(text[a : a + short], seed=anchor - a + 1) - (1 << 63), s["anchor"], s["seg"], a - first, None))
                    if len(rows) > 20_000:
                        yield flush()
            if rows:
                yield flush()

    return x.mapInArrow(run, "shard_key long, anchor long, seg binary, offset int, content binary")


def repeated(contents: list[bytes], *lengths: int) -> list[list[np.ndarray]]:
    """For every length, and every content, the places where so many bytes start that also start elsewhere among the contents."""
    size = np.array([len(c) + 1 for c in contents])
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    end = np.cumsum(size) - 1
    t = raw.astype(np.int64) + 2
    t[end] = 1
    left = np.repeat(end, size) - np.arange(len(t))
    sa = suffix_array(t)
    prefix = permuted_prefixes(t, sa, left)
    out = []
    for length in lengths or (LENGTH,):
        hit = prefix >= length
        both = np.zeros(len(t), bool)
        both[sa[:-1]] = hit[sa[1:]]  # the suffix before one that shares ``length`` bytes with it
        hit = (hit | both) & (left >= length)
        out.append([np.flatnonzero(hit[e - s + 1 : e]) for s, e in zip(size.tolist(), end.tolist(), strict=True)])
    return out


def _shards(cut: DataFrame, shards: int, length: int, short: int) -> DataFrame:
    """(anchor, seg, first, last): bytes of segments, counted from the segment's first window, at which ``length`` bytes
    start that repeat in their shard; and (.., removed = false) the same for ``short`` bytes."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        keys, order = table["shard_key"].to_numpy(), np.argsort(table["shard_key"].to_numpy(), kind="stable")
        content, anchor, seg, offset = (table[c].to_pylist() for c in ("content", "anchor", "seg", "offset"))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, int)
        part: list[int] = []

        def sort_part():
            for n, hits in zip((length, short), repeated([content[i] for i in part], length, short) if part else [], strict=False):
                for i, places in zip(part, hits, strict=True):
                    if len(places):
                        breaks = np.flatnonzero(np.diff(places) > 1)
                        for a, b in zip(places[np.concatenate([[0], breaks + 1])].tolist(), places[np.append(breaks, len(places) - 1)].tolist(), strict=True):
                            out.append((anchor[i], seg[i], offset[i] + a, offset[i] + b, n == length))
            part.clear()

        room = 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:  # alone, nothing repeats
                part.extend(order[a:b].tolist())
                room += sum(len(content[i]) for i in order[a:b].tolist())
            if room > SHARD:
                sort_part()
                room = 0
        sort_part()
        kinds = (("anchor", pa.int64()), ("seg", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("removed", pa.bool_()))
        return pa.table([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    x = cut.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)))
    # Sorting takes time by the MB, so tasks are made by shards and not by what shuffled bytes would have them be.
    return x.repartition(-(-shards // PER_TASK), "shard").groupBy("shard").applyInArrow(run, "anchor long, seg binary, first int, last int, removed boolean")


def _windows(runs: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, offset): the windows of ``runs`` that have an equal one."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("content") - length))
    x = runs.select("anchor", "seg", "offset", "content", at.alias("i")).select("anchor", "seg", (F.col("offset") + F.col("i")).alias("offset"), F.md5(F.substring("content", F.col("i") + 1, F.lit(length))).alias("digest"))
    x = written(x, "suffix-windows")
    twice = written(x.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "suffix-twice")
    return x.join(twice, "digest", "left_semi")


@in_small_batches
def spans(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """(doc_id, dk, spans): per document with repeated bytes the runs (first, last, removed) of places where repeats start.

    Tables of keys to join on are written before: the joins' sides come straight from exchanges, which Spark can split
    where a key is crowded.
    """
    every = written(_occurrences(docs, length, short), "suffix-all")
    anchors = written(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "suffix-anchors")
    rows = written(every.join(anchors, "anchor", "left_semi"), "suffix-rows")
    freed(every, anchors)
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "dk", "start", "windows", "back")).alias("rep")
    segs = written(rows.groupBy("anchor", "seg").agg(F.count("*").alias("n"), rep), "suffix-segments")
    crowd = written(segs.groupBy("anchor").agg(F.count("*").alias("distinct")).filter("distinct > 1"), "suffix-crowds")
    wanted = written(segs.join(crowd, "anchor").select("anchor", "seg", "rep.doc_id", "rep.dk", "rep.start", "rep.windows", "rep.back", (F.col("distinct") > MANY).alias("many")), "suffix-wanted")
    cut = written(_cut(docs, wanted, length, short).dropDuplicates(["anchor", "seg", "offset", "shard_key"]), "suffix-cut")
    freed(crowd, wanted)
    partners = written(cut.groupBy("shard_key").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-partners")
    shards = written(cut.join(partners, "shard_key"), "suffix-shards")
    freed(cut, partners)
    sorted_ = shards.filter(F.col("content").isNotNull() & (F.col("n") <= MANY))
    size = sorted_.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    part = _shards(sorted_.drop("n"), max(1, -(-size // SHARD)), length, short)
    place = lambda c, removed: (c.cast("int").alias("first"), c.cast("int").alias("last"), F.lit(removed).alias("removed"))
    part = part.unionByName(shards.filter("content is null").select("anchor", "seg", *place(F.col("offset"), False)))
    part = written(part.unionByName(_windows(shards.filter(F.col("content").isNotNull() & (F.col("n") > MANY)), length).select("anchor", "seg", *place(F.col("offset"), True))), "suffix-part")
    freed(shards)
    runs = lambda *columns: F.collect_list(F.struct(*columns)).alias("runs")
    whole = segs.filter("n > 1").select("anchor", "seg", F.lit(0).alias("first"), F.when(F.col("rep.windows") > 0, F.col("rep.windows") - 1).otherwise(length - short).alias("last"), (F.col("rep.windows") > 0).alias("removed"))
    once = part.join(segs.filter("n = 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi")
    found = written(whole.unionByName(once).groupBy("anchor", "seg").agg(runs("first", "last", "removed")), "suffix-found")
    moved = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"]).alias("last"), r["removed"].alias("removed")))
    x = rows.join(found, ["anchor", "seg"]).select("doc_id", "dk", F.explode(moved).alias("run"))
    # A document's runs are as many as its bytes at most. Repeated rows have the same ones, folded here.
    x = written(x.distinct().groupBy("doc_id", "dk").agg(F.array_sort(F.collect_list("run")).alias("spans")), "suffix-spans")
    freed(rows, segs, part, found)
    return x


def _kept(text: bytes, runs: list[dict], length: int) -> tuple[bytes, int]:
    """The bytes outside all spans, and the number of maximal spans."""
    out, at, count, end = [], 0, 0, -1
    for r in runs:
        a, b = r["first"], min(r["last"] + length, len(text))
        if a > end:
            out.append(text[at:a])
            count += 1
        end = max(end, b)
        at = end
    out.append(text[at:])
    return b"".join(out), count


def removed(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_repeated): ``kept`` holds the bytes that are left, which may cut a
    character; ``n_repeated`` counts the bytes in repeats of ``length`` bytes and in the shorter ones that were found."""
    found = spans(docs, length, short).select(F.col("doc_id").alias("id"), F.col("dk").alias("key"), "spans")
    x = docs.select("doc_id", row_key().alias("dk"), F.col("text").cast("binary").alias("text"))
    x = x.join(found, _same(), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, runs = text or b"", runs or []
                kept, n = _kept(text, [r for r in runs if r["removed"]], length)
                reach = [{"first": r["first"], "last": r["last"] + (length - short if r["removed"] else 0)} for r in runs]
                rows.append((len(text), len(text) - len(kept), n, kept, len(text) - len(_kept(text, reach, short)[0])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeated"])

    return x.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_repeated long")


def digest(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    x = removed(docs.select("doc_id", "text"), length, short)
    return x.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same, window by window, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
