"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their first 4, 5 and 6 letters, so that inflected forms meet. A bounded sample of
labelled rows gives the vocabulary (all of its terms), the document frequencies and the
examples, all of them. Like examples form a block. The weights of terms that are frequent in a block are held densely,
with each term's largest weight in the block; all others are postings, a term's examples by how often they hold it, so
that a run of them has one count. For a batch of queries the postings are added up, and these sums and the largest weights bound every block; the block of the largest bound is
scored, then those whose bound reaches the k-th best cosine in it, so the neighbours are exact. Neighbours vote with weights that
fall with distance; the vote is calibrated by the examples' own leave-one-out votes. The neighbours are returned as
evidence.

Edge cases: null and empty texts, and texts without a known term, get the sample's rate of toxic documents among texts
without a known term; very long texts are read whole; repeated rows and null ids keep a row each; without labelled
rows every score is 0; an empty table gives an empty result; extra columns are passed through.
"""

from __future__ import annotations

import functools
import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, given_back, in_small_batches, sliced, tidied, written

#: Labelled rows that the model is fitted on, at most: the model's size doesn't grow with the data.
SAMPLE = 12_000
NEIGHBOURS, AT_ONCE = 15, 256
#: Blocks of like examples, the terms that tell them apart, and the share of a block that makes a term frequent in it.
BLOCKS, LIKE, OFTEN = 8, 512, 1 / 8
#: Characters of texts whose words are looked up at a time, at least.
CHARS = 1 << 17
#: What the hashes of words are made with.
BASE = 0x9E3779B97F4A7C15
#: Bytes of the index that travel in a row.
PART = 1 << 22
#: Such rows in a file, which an executor writes and the driver's JVM passes on at a time.
PASSED = 4
BINS = 10
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def term_counts(text: str | None) -> Counter:
    """Words and prefixes of a text with the number of their places."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for term in {word, *(word[:p] for p in PREFIXES)}:
            out[term] += n
    return out


def number(doc_id: str) -> int:
    """An example's id where it is a whole number, else -1."""
    return int(doc_id) if doc_id.removeprefix("-").isdigit() else -1


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of every span, one span after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@functools.cache
def letters() -> np.ndarray:
    """Of each character whether WORD takes it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in WORD.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def summed(text: np.ndarray, starts: np.ndarray, longest: int) -> np.ndarray:
    """Running sums over bytes; the hash of what stands from one of ``starts`` to any place in its word is their difference."""
    powers = np.full(longest + 1, BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    place = np.arange(len(text)) - np.repeat(np.append(0, starts), np.diff(starts, prepend=0, append=len(text)))
    np.minimum(place, longest, out=place)
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[place], out=out[1:])
    return out


def same(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of ``a`` from each place i are those of ``b`` from j. Eight are read at once, so eight more follow the last."""
    eights = [np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (a, b)]
    cover = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out, left, at = np.ones(len(sizes), bool), np.arange(len(sizes)), 0
    while len(left):
        odd = (eights[0][i[left] + at] ^ eights[1][j[left] + at]) & cover[np.minimum(sizes[left] - at, 8)]
        out[left[odd != 0]] = False
        at += 8
        left = left[(odd == 0) & (sizes[left] > at)]
    return out


class Terms:
    """Ascending terms in little memory: their text, where each ends, and their hashes, by which they are found."""

    def __init__(self, joined: str = "") -> None:
        self.text = np.frombuffer((joined + "\n").encode() + bytes(8) if joined else bytes(8), np.uint8)
        self.ends = np.append(0, np.flatnonzero(self.text == ord("\n")) + 1).astype(np.int32)
        hashes = np.empty(len(self.ends) - 1, np.uint64)
        for at in range(0, len(hashes), 1 << 14):
            ends = self.ends[at : at + (1 << 14) + 1].astype(np.int64)
            own = ends - ends[0]
            sums = summed(self.text[ends[0] : ends[-1]], own[:-1], int(np.diff(own).max()))
            hashes[at : at + (1 << 14)] = sums[own[1:] - 1] - sums[own[:-1]]
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.order)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Terms) and np.array_equal(self.text, other.text)

    def __contains__(self, word: str) -> bool:
        return self.places([word])[0] >= 0

    def places(self, words: Sequence[str]) -> np.ndarray:
        """Each word's place, -1 for those that are no terms."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text, starts = np.frombuffer(b"".join(raw) + bytes(8), np.uint8), np.cumsum(sizes) - sizes
        sums = summed(text, starts, int(sizes.max(initial=0)))
        return self.find(text, starts, sizes, sums[starts + sizes] - sums[starts])

    def find(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, given as bytes of a text; other terms of the same hash are passed over."""
        out, at = np.full(len(hashes), -1, np.int64), np.empty(len(hashes), np.int64)
        by = np.argsort(hashes)  # ascending hashes are found near each other
        at[by] = np.searchsorted(self.hashes, hashes[by])
        left = np.flatnonzero(sizes)
        while True:
            left = left[at[left] < len(self)]
            left = left[self.hashes[at[left]] == hashes[left]]
            if not len(left):
                return out
            found = self.order[at[left]]
            begin = self.ends[found].astype(np.int64)
            equal = self.ends[found + 1] - 1 - begin == sizes[left]
            equal[equal] = same(self.text, begin[equal], text, starts[left[equal]], sizes[left[equal]])
            out[left[equal]] = found[equal]
            left = left[~equal]
            at[left] += 1


@dataclass
class Model:
    """Vocabulary, inverted index and calibration."""

    terms: Terms  # ascending
    idf: np.ndarray
    ids: np.ndarray  # as text
    toxic: np.ndarray
    lists: pa.LargeBinaryArray  # of each term: its postings, which are examples' numbers, by count
    kind: np.dtype  # of such a number
    runs: np.ndarray  # of each term and one past the last: its first run, of postings of one count
    sizes: np.ndarray  # of each run
    levels: np.ndarray  # of each run: 1 + log count
    scale: np.ndarray  # of each example: 1 / length
    blocks: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # first example, one past the last; frequent terms; their largest weights; all, term x example
    base: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: (np.arange(BINS) + 0.5) / BINS)
    columns: list[np.ndarray] = field(default_factory=list)
    compact: dict = field(default_factory=dict)  # what ``filled`` makes the model from; how it travels. One that has arrived is without

    def __getstate__(self) -> dict:
        return self.compact | {"base": self.base, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(self.filled(state).__dict__, base=state["base"], curve=state["curve"])

    @classmethod
    def filled(cls, compact: dict) -> Model:
        """The model from counts: a weight is (1 + log count) * idf of its term / length of its example."""
        ids, held, lengths = compact["ids"], compact["held"], compact["lengths"]
        idf = 1 + np.log(len(ids) / np.maximum(held, 1))
        of_term, starts, example = idf.astype(np.float32), compact["starts"].astype(np.int64), compact["example"]

        def weight(counts: np.ndarray, idfs: np.ndarray, examples: np.ndarray) -> np.ndarray:
            table = 1 + np.log(np.maximum(np.arange(int(counts.max(initial=0)) + 1), 1).astype(np.float32))
            return table.astype(np.float32)[counts] * idfs / lengths[examples]

        terms, counts = Terms(compact["terms"]), compact["count"]
        begins = np.append(True, counts[1:] != counts[:-1])[: len(counts)]
        begins[starts[starts < len(counts)]] = True
        first = np.flatnonzero(begins)
        runs, sizes = np.searchsorted(first, starts).astype(np.int32), np.diff(first, append=len(counts)).astype(np.int32)
        levels = (1 + np.log(counts[first].astype(np.float64))).astype(np.float32)
        del begins, first
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * example.itemsize), pa.py_buffer(example)])
        blocks = []
        for first, last, often, row, column, count in compact["blocks"]:
            weights = np.zeros((len(often), last - first), np.float32)
            weights[row, column] = weight(count, of_term[often[row]], column.astype(np.int64) + first)
            blocks.append((first, last, often, weights.max(1), weights))
        return cls(terms, idf, ids, compact["toxic"], lists, example.dtype, runs, sizes, levels, 1 / lengths.astype(np.float64), blocks)

    @classmethod
    def of(cls, ids: np.ndarray, toxic: np.ndarray, terms: list[str], places: np.ndarray, example: np.ndarray, counts: np.ndarray) -> Model:
        """The index of postings: a term's place in ``terms``, the example that holds it, and how often it does.

        The model that is returned can only travel; what arrives is filled in. The postings are sorted where they are,
        and worked on in parts: there are millions of them.
        """
        n, term = len(ids), places
        sizes, held = np.bincount(example, minlength=n), np.bincount(places, minlength=len(terms))
        order = np.lexsort((counts, places))
        for x in (places, example, counts):
            x[:] = x[order]
        del order
        parts = [slice(at, at + (1 << 20)) for at in range(0, len(term), 1 << 20)]
        idf = (1 + np.log(n / np.maximum(held, 1))).astype(np.float32)
        weight, squares = np.empty(len(term), np.float32), np.zeros(n)
        for part in parts:
            weight[part] = (1 + np.log(counts[part].astype(np.float32))) * idf[term[part]]
            squares += np.bincount(example[part], weight[part].astype(np.float64) ** 2, n)
        lengths = np.sqrt(np.maximum(squares, 1e-24)).astype(np.float32)
        for part in parts:
            weight[part] /= lengths[example[part]]
        near = cls._alike(n, term, example, weight, held)
        del weight
        order = np.argsort(near, kind="stable")  # examples of a block get numbers in a row
        number = np.empty(n, np.int32)
        number[order] = np.arange(n)
        for part in parts:
            example[part] = number[example[part]]
        ids, toxic, bare = ids[order], toxic[order], sizes[order] == 0
        cuts = np.searchsorted(near[order], np.arange(BLOCKS + 1)).tolist()
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        blocks, rest = [], np.ones(len(term), bool)
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            inside = np.flatnonzero((example >= first) & (example < last))
            often = np.flatnonzero(np.bincount(term[inside], minlength=len(terms)) >= max(OFTEN * (last - first), 8))
            row = np.full(len(terms), -1, np.int32)
            row[often] = np.arange(len(often))
            dense = inside[row[term[inside]] >= 0]
            del inside
            rest[dense] = False
            if last > first:
                blocks.append((first, last, often, small(row[term[dense]]), small(example[dense] - first), small(counts[dense])))
        starts = np.append(0, np.cumsum(np.bincount(term[rest], minlength=len(terms))))
        compact = {
            "terms": "\n".join(terms), "held": small(held), "lengths": lengths[order], "ids": ids, "toxic": toxic,
            "starts": small(starts), "example": small(example[rest]), "count": small(counts[rest]), "blocks": blocks,
        }
        model = cls(Terms(), held, ids, toxic, None, held.dtype, held, held, held, held, [], compact=compact)
        model.base = (float(toxic[bare].sum()) + 0.01) / (float(bare.sum()) + 1)  # of texts without a term
        return model

    @staticmethod
    def _alike(n: int, term: np.ndarray, example: np.ndarray, weight: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Each example's block, by a few rounds of spherical k-means over the commonest terms. It decides speed, not results."""
        column = np.full(len(held), -1, np.int32)
        column[np.argsort(-held, kind="stable")[:LIKE]] = np.arange(min(LIKE, len(held)))
        x, at = np.zeros((n, LIKE), np.float32), column[term] >= 0
        x[example[at], column[term[at]]] = weight[at]
        middle = x[np.linspace(0, max(n - 1, 0), BLOCKS).astype(int)] if n else x
        near = np.zeros(n, np.int64)
        for _ in range(5 if n else 0):
            near = (x @ middle.T).argmax(1)
            sums = np.stack([x[near == b].sum(0) for b in range(BLOCKS)])
            middle = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        return near

    @property
    def weights(self) -> np.ndarray:
        """The index as a dense array, term x example; only for small models."""
        out = np.zeros((len(self.terms), len(self.ids)), np.float32)
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.runs))  # of each run
        example = self._posted(np.arange(len(self.terms)), int(self.sizes.sum()))
        out[np.repeat(term, self.sizes), example] = np.repeat(self.idf[term] * self.levels, self.sizes) * self.scale[example]
        for first, last, often, _, weights in self.blocks:
            out[often, first:last] += weights
        return out

    def _posted(self, terms: np.ndarray, n: int) -> np.ndarray:
        """The terms' postings, n in all, one list after the other."""
        return np.frombuffer(self.lists.take(pa.array(terms)).buffers()[2], self.kind, n) if n else np.zeros(0, self.kind)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms and their weights, of length 1."""
        return self.vectors([text])[0]

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``vector`` of each text."""
        out, at, n = [], 0, 0
        for i, text in enumerate(texts, 1):
            n += len(text or "")
            if n >= CHARS or i == len(texts):
                out += self._vectors(texts[at:i])
                at, n = i, 0
        return out

    def _vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The words are read as numbers, and no strings are made of them: each stands in two arrays of all texts' bytes and characters."""
        low = [(t or "").lower() for t in texts]
        joined = "\n" + "\n".join(low) + "\n"
        letter = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        first, last = edges[::2], edges[1::2]
        query = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), first, side="right")
        text = np.frombuffer(joined.encode("utf-8", "surrogatepass") + bytes(8), np.uint8)
        begins = np.flatnonzero((text & 0xC0) != 0x80)  # of each character
        starts, size = begins[first], last - first
        sums = summed(text, starts, int((begins[last] - starts).max(initial=0)))
        keys = []
        for p in (None, *PREFIXES):  # the word, and its prefixes if it is longer
            longer = np.flatnonzero(size > (p or 0))
            start, end = starts[longer], begins[last[longer] if p is None else first[longer] + p]
            term = self.terms.find(text, start, end - start, sums[end] - sums[start])
            keys.append((query[longer] * len(self.terms) + term)[term >= 0])
        key = np.sort(np.concatenate(keys))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        query, term = np.divmod(key[at], max(len(self.terms), 1))
        weight = (1 + np.log(np.diff(at, append=len(key)))) * self.idf[term]
        weight /= np.sqrt(np.maximum(np.bincount(query, weight * weight, len(texts)), 1e-24))[query]
        cuts = np.cumsum(np.bincount(query, minlength=len(texts)))[:-1]
        return list(zip(np.split(term, cuts), np.split(weight, cuts), strict=True))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above 0, largest first, ties to the first example."""
        return self.search([(at, w)], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``nearest`` of each query.

        A query's block of the largest bound is scored first; its k-th best cosine is the floor that other blocks'
        bounds have to reach to be scored as well.
        """
        n, count = len(self.ids), len(queries)
        if not self.blocks or not count:
            return [[] for _ in queries]
        if not self.columns:
            for _, _, often, _, _ in self.blocks:
                self.columns.append(np.full(len(self.terms), -1, np.min_scalar_type(-max(len(often), 1))))
                self.columns[-1][often] = np.arange(len(often))
        cosine = np.zeros((count, n), np.float32)
        every, weight = (np.concatenate([q[j] for q in queries]) for j in (0, 1))
        row = np.repeat(np.arange(count), [len(at) for at, _ in queries])
        runs = self.runs[every + 1] - self.runs[every]
        run = spans(self.runs[every], runs)
        sizes, parts = self.sizes[run], np.repeat(weight * self.idf[every], runs) * self.levels[run]
        ends = np.cumsum(np.bincount(row, runs, count).astype(np.int64)).tolist()
        for i, (at, _) in enumerate(queries):
            own = slice(ends[i - 1] if i else 0, ends[i])
            cosine[i] = np.bincount(self._posted(at, int(sizes[own].sum())), np.repeat(parts[own], sizes[own]), n) * self.scale
        del runs, run, sizes, parts
        dense, bound = [], np.empty((count, len(self.blocks)))
        for b, (first, last, often, most, _) in enumerate(self.blocks):
            column = self.columns[b][every]
            has = column >= 0
            dense.append(np.zeros((count, len(often)), np.float32))
            dense[-1][row[has], column[has]] = weight[has]
            bound[:, b] = (cosine[:, first:last].max(1) + dense[-1] @ most) * (1 + 1e-5)
        best, floor = bound.argmax(1), np.zeros(count)
        for b, (first, last, _, _, weights) in enumerate(self.blocks):
            if len(rows := np.flatnonzero(best == b)):
                part = cosine[rows, first:last] + dense[b][rows] @ weights
                cosine[rows, first:last] = part
                if last - first >= k:
                    floor[rows] = np.partition(part, last - first - k, 1)[:, last - first - k]
        for b, (first, last, _, _, weights) in enumerate(self.blocks):
            other = best != b
            open_ = other & (bound[:, b] > 0) & (bound[:, b] >= floor)
            if len(rows := np.flatnonzero(open_)):
                cosine[rows, first:last] += dense[b][rows] @ weights
            cosine[other & ~open_, first:last] = 0
        out = []
        for row_, low in zip(cosine, np.maximum(floor, np.finfo(np.float32).tiny).astype(np.float32), strict=True):
            hit = np.flatnonzero(row_ >= low)
            if len(hit) > 4 * k:  # the floor comes from one block
                hit = hit[row_[hit] >= np.partition(row_[hit], len(hit) - k)[len(hit) - k]]
            out.append(list(zip(row_[hit].tolist(), hit.tolist(), strict=True)))
        return [sorted(x, key=lambda y: (-y[0], y[1]))[:k] for x in out]

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [(1 / (1.05 - min(s, 1.0)), i) for s, i in near]
        return sum(w for w, i in weights if self.toxic[i]) / sum(w for w, _ in weights)

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, (np.arange(BINS) + 0.5) / BINS, self.curve))

    def scores(self, texts: Sequence[str | None] | pa.Array) -> Iterator[tuple[float, list[int], list[float]]]:
        """Each text's score, and the ids and cosines of the examples that it comes from."""
        for i in range(0, len(texts), AT_ONCE):
            part = texts[i : i + AT_ONCE]
            for near in self.search(self.vectors(part.to_pylist() if isinstance(part, pa.Array) else part), NEIGHBOURS):
                yield (self.calibrated(self.vote(near)), [number(self.ids[i]) for _, i in near], [s for s, _ in near]) if near else (self.base, [], [])


def packed(model: Model) -> list:
    """The model as a few pieces of bytes: one with its structure, then its arrays' memory."""
    arrays: list[pickle.PickleBuffer] = []
    head = pickle.dumps(model, 5, buffer_callback=arrays.append)
    return [head, *(x.raw() for x in arrays)]


def unpacked(pieces: list[bytearray]) -> Model:
    """The model of ``packed``, filled in; the pieces aren't needed any more."""
    return pickle.loads(pieces[0], buffers=pieces[1:])


def passed_on(parts: DataFrame) -> list[bytearray]:
    """The pieces of ``packed`` from written rows (i, at, raw), a file at a time: a partition may hold all, and the JVM several copies."""
    held = {}
    name = F.col("_metadata.file_name")
    for r in parts.select(name.alias("name")).distinct().collect():
        held |= {(p.i, p.at): p.raw for p in parts.filter(name == r.name).collect()}
    pieces: list[bytearray] = []
    for key in sorted(held):
        if key[1] == 0:
            pieces.append(bytearray())
        pieces[-1] += held.pop(key)
    return pieces


def received(sent: Broadcast) -> Model:
    """The model that was sent, without the bytes that it came in: idle workers would keep them, and later tasks read them again."""
    model = unpacked(sent.value)
    if getattr(sent, "_path", None):  # with encryption a worker gets the bytes only once
        sent.__dict__.pop("_value", None)
    return model


@dataclass
class Fitted:
    """A broadcast model, and what calibration found."""

    sent: Broadcast
    curve: np.ndarray | None = None
    base: float | None = None

    def model(self) -> Model:
        m = received(self.sent)
        m.curve = m.curve if self.curve is None else self.curve
        m.base = m.base if self.base is None else self.base
        return m

    def release(self) -> None:
        """Take the model from all executors, once what was scored with it has been written."""
        self.sent.destroy()


def curve(votes: DataFrame) -> np.ndarray:
    """For each bin of leave-one-out votes (vote, toxic) the rate of toxic examples, never falling."""
    bin_ = F.least(F.floor(F.col("vote") * BINS), F.lit(BINS - 1)).alias("bin")
    held = {r.bin: (r.n, r.bad) for r in votes.groupBy(bin_).agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("bad")).collect()}
    rates = []
    for b in range(BINS):
        n, bad = held.get(b, (0, 0))
        rates.append((bad + 2 * (b + 0.5) / BINS) / (n + 2))
    return np.maximum.accumulate(np.array(rates))


@in_small_batches
def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted:
    """A model from at most ``sample`` labelled rows that aren't held out; what reaches the driver is bounded by it."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")
    # A row per id, with its least text where texts differ. Texts are shorter than their lists of terms.
    rows = written(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part's terms and their counts, as Arrow writes them, compressed: to Spark a row with bytes."""
        for b in sliced(batches, 250):
            found = [term_counts(t) for t in b.column(2).to_pylist()]
            terms, n = pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
            part = pa.RecordBatch.from_arrays([b.column(0), b.column(1), terms, n], ["doc_id", "toxic", "terms", "n"])
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["raw"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic, sizes, terms, counts = [], [], [], [], []
        for b in batches:
            for raw in b.column(0):
                part = pa.ipc.open_stream(raw.as_buffer()).read_all().combine_chunks().to_batches()[0]
                ids += part["doc_id"].to_pylist()
                toxic += [t == 1 for t in part["toxic"].to_pylist()]
                sizes.append(np.diff(part["terms"].offsets.to_numpy()))
                terms.append(part["terms"].flatten().dictionary_encode())
                n = part["n"].flatten().to_numpy()
                counts.append(n.astype(np.min_scalar_type(int(n.max(initial=0)))))
        coded = pa.chunked_array(terms).unify_dictionaries()
        del terms, part, n, raw, b
        names = coded.chunk(0).dictionary
        order = pa.compute.sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        places, names = np.concatenate([place[c.indices.to_numpy()] for c in coded.chunks]), names.take(pa.array(order)).to_pylist()
        del coded, place, order
        pa.default_memory_pool().release_unused()
        # Examples are numbered by label and id, whatever the order in which they come.
        number = np.empty(len(ids), np.int32)
        number[(by := sorted(range(len(ids)), key=lambda i: (toxic[i], ids[i])))] = np.arange(len(ids), dtype=np.int32)
        example = np.repeat(number, np.concatenate(sizes))
        ids, toxic, counts = np.array([ids[i] for i in by], object), np.array([toxic[i] for i in by], bool), np.concatenate(counts)
        for i, raw in enumerate(packed(Model.of(ids, toxic, names, places, example, counts))):
            for at in range(0, max(len(raw), 1), PART):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([at]), pa.array([bytes(raw[at : at + PART])], pa.binary())], ["i", "at", "raw"])

    # One task makes the index of the bounded sample. The driver passes on its bytes, part by part, without unpacking them.
    pieces: list[bytearray] = []
    if rows.counted:
        terms = written(rows.mapInArrow(lambda b: tidied(counted(b)), "raw binary"), "toxicity-terms")
        parts = written(terms.coalesce(1).mapInArrow(lambda b: tidied(built(b)), "i long, at long, raw binary"), "toxicity-index", per_file=PASSED)
        pieces = passed_on(parts)
        freed(terms, parts)
    if not pieces:
        none = np.zeros(0, np.int64)
        return Fitted(spark.sparkContext.broadcast([bytearray(x) for x in packed(Model.of(none, none == 1, [], none, none, none))]), base=0.0)
    sent = spark.sparkContext.broadcast(pieces)
    del pieces
    given_back()

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(sent)
        for b in batches:
            ids, texts, votes = b.column(0).to_pylist(), b.column(2).to_pylist(), []
            for i in range(0, len(texts), AT_ONCE):
                found = m.search(m.vectors(texts[i : i + AT_ONCE]), NEIGHBOURS + 1)
                for name, near in zip(ids[i : i + AT_ONCE], found, strict=True):
                    near = [x for x in near if m.ids[x[1]] != name][:NEIGHBOURS]
                    votes.append(m.vote(near) if near else None)
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column(1)], ["vote", "toxic"])

    votes = rows.mapInArrow(lambda b: tidied(voted(b)), "vote double, toxic int")
    return Fitted(sent, curve(votes.filter("vote is not null")))


def score(docs: DataFrame, model: Fitted, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column: score, neighbours (ids of the nearest examples) and cosines."""

    @F.arrow_udf("score double, neighbours array<long>, cosines array<double>")
    def scored(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(_scored(model, column))

    return docs.withColumn(into, scored(text))


def _scored(model: Fitted, column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    m = model.model()
    for part in column:
        rows = list(m.scores(part))
        yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["score", "neighbours", "cosines"])


@in_small_batches
def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours): the contract's columns and the evidence."""
    model = fit(docs, labels)
    x = written(score(docs.select("doc_id", "text"), model).select("doc_id", "toxicity"), "toxicity-scores")
    model.release()
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity.neighbours").alias("neighbours"))
