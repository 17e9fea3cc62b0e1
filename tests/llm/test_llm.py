"""Small fixtures against brute force, round trips and contracts, with nulls, empties, repeats, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixweave.llm import ann, chat, common, exact_topk, license_scan, mixing, near_dedup, pii, sentencepiece_codec, suffix_array, suffix_dedup, toxicity
from pixweave.llm.queries import model_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tk string, node string, size long, u string"


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators work with."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", 7, "z") for i, t, s in rows], DOCS).repartition(3)


def words(rnd, n, of="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rnd.choice(of) + rnd.choice(["", ",", "."]) for _ in range(n))


# 1


@pytest.fixture(scope="module")
def codec():
    with open(model_path(), "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def test_codec_agrees_with_the_library(codec):
    rnd = random.Random(1)
    texts = ["", " ", "  a  b", "\n\n", "▁x", "a" * 5000, "naïve Ünïcode 가나다 😀", "<s>x</s>", "\t\r\n\0", *("".join(rnd.choice("ab ▁\n\t é€😀<0x0A>.　가") for _ in range(rnd.randint(0, 40))) for _ in range(500))]
    for text in texts:
        want = codec.sp.encode(text, add_bos=True, add_eos=True)
        ids, begins, ends = codec.encode(text)
        assert ids.tolist() == want and codec.decode(ids) == codec.sp.decode(want)
        assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins <= ends).all() and (begins[1:] == ends[:-1]).all()


def test_spans_spell_the_pieces(codec):
    text = "Grüße, world  twice 😀"
    ids, begins, ends = codec.encode(text)
    raw = text.encode()
    for i, b, e in zip(ids.tolist()[1:-1], begins[1:-1], ends[1:-1], strict=True):
        assert codec.piece[i].lstrip(b" ") == raw[b:e].lstrip(b" ")


def test_pieces_that_dont_spell_the_text(codec, monkeypatch):
    """Where lengths of pieces don't add up, ids and places are the library's."""
    text = "Grüße, world 😀 twice"
    want = codec.encode(text)
    monkeypatch.setattr(codec, "length", codec.length + 1)
    ids, begins, ends = codec.encode(text)
    assert ids.tolist() == want[0].tolist() and ends.tolist() == want[2].tolist() and begins.tolist()[2:] == want[1].tolist()[2:]


def test_character_map():
    """A map that turns ﬁ into fi and A into a: a trie of these two rules, laid out by hand."""
    import struct

    rules = {"ﬁ".encode(): b"fi", b"A": b"a"}
    units, texts = {0: 1 << 10}, b""
    base = 1 << 10
    nodes, free = {b"": (0, 1 << 10)}, 2
    for key, value in rules.items():
        for n in range(1, len(key) + 1):
            if key[:n] not in nodes:
                at = nodes[key[:n - 1]][1] ^ key[n - 1]
                nodes[key[:n]] = (at, (free := free + 1) << 10)
                units[at] = key[n - 1] | (at ^ nodes[key[:n]][1]) << 10
        at, child = nodes[key]
        units[at] |= 1 << 8
        units[child] = 1 << 31 | len(texts)
        texts += value + b"\0"
    del base
    table = [units.get(i, 0) for i in range(max(units) + 1)]
    table[0] = (nodes[b""][1]) << 10
    blob = struct.pack("<I", 4 * len(table)) + struct.pack(f"<{len(table)}I", *table) + texts
    normalize = sentencepiece_codec.Normalizer(blob, dummy_prefix=False, escape=False)
    out, align = normalize("xﬁAb".encode())
    assert out == b"xfiab" and align.tolist() == [0, 1, 1, 4, 5, 6]
    squeezed, align = sentencepiece_codec.Normalizer(b"", squeeze=True)(b"  a  b ")
    assert squeezed.decode() == "▁a▁b" and align.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]


def test_codec_tables(spark):
    df = docs(spark, [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "hello", "a")])
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in sentencepiece_codec.digest(df, model_path()).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert [g[:2] for g in got][1:] == [(1, 2), (2, 2), (2, 2)] and got[1][2] == empty
    assert sentencepiece_codec.decoded(df, model_path()).filter("text = 'hello'").count() == 1
    assert sentencepiece_codec.digest(df.limit(0), model_path()).count() == 0
    assert sentencepiece_codec.encode(df, model_path()).filter("size(ids) = size(begins)").count() == 4


# 2


def brute_license(text):
    low = (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
    found = re.findall(license_scan.WORD, low)
    numbered = "".join(f" {w}#{i}" for i, w in enumerate(found))
    places = lambda rx: [(int(re.search("#([0-9]+)", m.group()).group(1)), int(m.group().rpartition("#")[2])) for m in re.finditer(rx, numbered)]
    base = [(i, label) for phrase, label in license_scan.BASE for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    hits = [(o, label, p, a, z) for o, label, key, p, rx in license_scan.RULES if key in low for a, z in places(rx)] if re.search(license_scan.GATE, low) else []
    hidden = lambda d, e: e[3] <= d[3] and e[4] >= d[4] and (e[2] > d[2] or e[2] == d[2] and (e[4] - e[3] > d[4] - d[3] or e[3:] == d[3:] and e[0] < d[0]))
    kept = [d for d in hits if not any(hidden(d, e) for e in hits)]
    labels = lambda xs: ",".join(sorted(set(xs)))
    starts = [i for i, _ in base]
    return len(found), len(base), min(starts, default=None), max(starts, default=None), labels(x for _, x in base), labels([x for _, x in base] + [d[1] for d in kept])


def test_license(spark):
    assert len(license_scan.RULES) > 200
    texts = [
        None, "", "...", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3 or (at your option) any later version. GNU  general\npublic license",
        "CC BY-NC 4.0 and cc-by 4.0, CC\nBY", "Released under the MIT License. The MIT license", "BSD 3-Clause License; 2 clause bsd", "SPDX-License-Identifier: GPL-2.0-only", "Mozilla Public License 2.0 é mit licenseé",
        "public domain. All rights reserved. LGPL v2.1 lgplv3", "x " * 4000 + "apache license " * 50,
    ]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.digest(license_scan.scan(df)).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert "apache-2.0" in got[3][5] and "apache" in got[3][5] and "cc-by-nc-4.0" in got[5][5]
    assert license_scan.digest(license_scan.scan(df.limit(0))).count() == 0


def test_license_of_many_detections(spark):
    """Thousands of detections in one text, and random mixes of phrases that contain each other, against brute force."""
    rnd = random.Random(2)
    pieces = ["gnu general public license", "version 2", "or any later version", "mit license", "the", "apache license version 2 0", "cc by nc 4 0", "license", "lgpl 2 1", "gpl 2 0 only", "bsd 3 clause license", "www apache org licenses license 2 0"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.digest(license_scan.scan(df)).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    many = license_scan.digest(license_scan.scan(docs(spark, [(0, "mit license gpl 2 0 only " * 8000, "s")]))).first()
    assert many.n_detections == 16000 and many.labels == "gpl-2.0-only,mit"


# 3


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\n\nThanks a lot"), (1, 1, "assistant", "On Monday, Bob wrote:\n> how do I   sort a LIST?\nUse sorted, it is stable."),
        (1, 2, "user", "> > How do I sort a list?\n> Use sorted, it is stable.\nGreat"), (1, 3, "user", "> never said this\nHm"), (1, 4, "user", "> Thanks a lot\n> Great\nok"),
        (2, 0, "user", "> How do I sort a list?\nelsewhere"), (2, 1, "user", None), (None, 0, "user", "> x y z\nx"), (1, 4, "user", "> Thanks a lot\n> Great\nok"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, unit int")
    got = {(r.conv_id, r.turn): (r.text, r.reply_to, r.thread_root, r.reply_depth, r.n_quotes, r.quote_depth) for r in chat.conversations(df).collect()}
    assert got[1, 1] == ("Use sorted, it is stable.", 0, 0, 1, 1, 1)
    assert got[1, 2] == ("Great", 1, 0, 2, 2, 2)
    assert got[1, 3] == ("Hm", None, 3, 0, 1, 1)
    assert got[1, 4][:4] == ("ok", 0, 0, 1)  # "Great" alone is too short a line to be looked up
    assert got[2, 0] == ("elsewhere", None, 0, 0, 1, 1) and got[2, 1][0] == "" and got[None, 0][0] == "x"
    assert chat.conversations(df).count() == 9 and chat.conversations(df.limit(0)).count() == 0


def test_reply_order(spark, monkeypatch):
    """Branching threads, a message with many replies, and long messages: positions are those of a depth-first walk."""
    monkeypatch.setattr(chat, "SPAN", 4)
    rnd = random.Random(13)
    rows, parent = [], {}
    for conv in range(4):
        for turn in range(60):
            up = None if turn == 0 or rnd.random() < 0.1 else 0 if conv == 3 and rnd.random() < 0.7 else rnd.randrange(turn)
            parent[conv, turn] = up
            quote = "" if up is None else f"> unique words of message {conv} {up} here\n"
            rows.append((conv, turn, "user", quote + f"unique words of message {conv} {turn} here" + (" long" * 50_000 if turn == 7 else "")))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    # The long message's line differs from what quotes say of it: those replies link to nothing.
    parent = {k: None if up == 7 else up for k, up in parent.items()}
    want = {}
    for conv in range(4):
        for root in (t for t in range(60) if parent[conv, t] is None):
            todo, n = [root], 0
            while todo:
                t = todo.pop()
                want[conv, t] = (root, n)
                n += 1
                todo += sorted((c for c in range(60) if parent[conv, c] == t), reverse=True)
    got = {(r.conv_id, r.turn): (r.thread_root, r.position) for r in chat.conversations(df).collect()}
    assert got == want


# 4 and 9


def vectors(spark, seed=5, n=600, dims=12, kind="float"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[100:160] = x[3]  # equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(n, None), (n + 1, [1.0, None]), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] + [0.0] * (dims - 1)), (n + 4, [0.0] * dims), (None, rows[0][1]), (5, rows[5][1])]
    return rows, spark.createDataFrame([(*r, "k", 1) for r in rows], f"vec_id long, embedding array<{kind}>, key string, ids int").repartition(4)


def good(rows, zero):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))]


def top(rows, every, k, score):
    out = {}
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            s = sorted(((-score(v, w), j) for c, (j, w) in enumerate(rows) if c != q))[:k]
            out.setdefault(i, []).append([(j, -x) for x, j in s])
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e11, 1e30])
def test_exact_topk(spark, scale):
    rows, df = vectors(spark, kind="double")
    rows = [(i, v and [c and c * scale for c in v]) for i, v in rows]
    df = df.withColumn("embedding", F.transform("embedding", lambda c: c * scale))
    whole = [(i, [min(max(math.floor(256 * c), -(2**63)), 2**63 - 1024) for c in v]) for i, v in good(rows, True)]
    want = top(whole, 50, 5, lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1))
    got = collections.defaultdict(list)
    for r in sorted(exact_topk.top_k(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {i: x[0] for i, x in want.items()}
    assert exact_topk.top_k(df.limit(0)).count() == 0
    few = exact_topk.top_k(df.filter("vec_id in (0, 7, 9)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


@pytest.mark.parametrize(("kind", "scale"), [("float", 1.0), ("double", 1.0), ("double", 1e150), ("double", 1e-150)])
def test_ann(spark, monkeypatch, kind, scale):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    rows, df = vectors(spark, n=1500, dims=8, kind=kind)
    rows = [(i, v and [c and c * scale for c in v]) for i, v in rows]
    df = df.withColumn("embedding", F.transform("embedding", lambda c: (c * scale).cast(kind)))
    number = np.float32 if kind == "float" else float
    want = top(good(rows, False), 20, 20, lambda a, b: float(np.dot(np.array(a, number).astype(float), np.array(b, number).astype(float))))
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want) / (20 * len(want))
    assert hits >= 0.9
    q = 20
    assert all(abs(s - dict(want[q][0]).get(i, s)) <= 1e-6 * scale * scale for i, s in got[q])
    few = ann.search(df.filter("vec_id in (0, 7, 9, 11)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2), (0, 3)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.filter("vec_id = 0")).count() == 0


def test_ann_finds_a_group_apart():
    """Tight groups far from everything else, as near-duplicates are: their lists are found from any entry."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for g in range(10):
        x[600 * g : 600 * g + 60] = x[600 * g] + 0.01 * rng.normal(size=(60, 64))
    lists = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), len(x), 20)
    placed = lists.place(x)
    for g in range(10):
        chosen = set(lists.choose(x[600 * g + 3]))
        assert sum(bool(chosen & set(placed[600 * g + i])) for i in range(60)) >= 55


def test_ann_fills_up_from_further_lists():
    """A query on a centroid of its own still gets lists with enough vectors."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 6)), np.full((1, 6), 50.0)])
    lists = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), len(x) * 8, 20)
    placed = lists.place(x)
    lists.sizes = np.bincount([j for p in placed for j in p], minlength=len(lists.centroids))
    for q in (x[400], x[0], x[7]):
        chosen = set(lists.choose(q, 21))
        assert sum(bool(chosen & set(p)) for p in placed) >= 21
    near = ann.grouped(x, np.ones(len(x)), 5)
    assert len(set(near.tolist())) == 5 and np.bincount(near).max() <= 2 * len(x) / 5


# 5


def test_suffix_array():
    rnd = random.Random(0)
    for _ in range(300):
        x = [rnd.randint(1, rnd.choice([1, 2, 3, 200])) for _ in range(rnd.randint(1, 50))]
        x = x[:5] * rnd.randint(1, 10) if rnd.random() < 0.3 else x
        sa = suffix_array.suffix_array(np.array(x))
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        prefix = suffix_array.permuted_prefixes(np.array(x), sa, np.arange(len(x), 0, -1))
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            n = 0
            while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
                n += 1
            assert prefix[a] == n


@pytest.mark.parametrize("many", [512, 5])
def test_suffix_dedup(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rnd = random.Random(3)
    make = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    base, common, hot = [make(1500) for _ in range(4)], make(380), make(450)
    texts = []
    for i in range(30):
        a = rnd.randint(0, 700)
        texts.append(make(rnd.randint(0, 500)) + rnd.choice(base)[a : rnd.randint(a, 1500)] + make(9) + common + make(rnd.randint(0, 300)) + (hot + make(50) if i % 3 == 0 else ""))
    texts += [None, "", make(399), "x" * 1000, "x" * 401, "ab" * 700, texts[0], texts[0], base[0], base[0] + "z"]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(df).collect())
    assert got == [(i, *x) for i, x in enumerate(suffix_dedup.brute_force([(t or "").encode() for t in texts]))]
    assert suffix_dedup.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("many", [512, 5])
def test_shorter_repeats_are_reported(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rnd = random.Random(12)
    make = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    shared = make(300)
    rows = [(i, make(rnd.randint(150, 900)) + (shared if i % 2 else make(300)) + make(rnd.randint(0, 900)), "s") for i in range(60)]
    got = {r.doc_id: r for r in suffix_dedup.digest(docs(spark, rows)).collect()}
    assert all(r.n_removed == 0 and (i % 2 or not r.n_repeated) for i, r in got.items())
    more = {r.n_repeated - len(shared.encode()) for r in got.values() if r.n_repeated}
    assert more <= set(range(6)) if many > 60 else more <= set(range(suffix_dedup.SHORT - len(shared.encode()), 6))  # a next byte may agree by chance
    assert sum(r.n_repeated > 0 for r in got.values()) >= 26


def test_pieces_of_long_texts(monkeypatch):
    text = bytes(random.Random(4).choice(b"abc") for _ in range(5000))
    whole = [(h, p, f + k) for h, p, f, n in suffix_dedup.segments(text) for k in range(n)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert [(h, p, f + k) for h, p, f, n in suffix_dedup.segments(text) for k in range(n)] == whole


# 6


def toxic_corpus(n=400):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        bad = rnd.random() < 0.3
        t = words(rnd, rnd.randint(20, 60)) + (" " + " ".join(rnd.sample(["idiotic", "idiots", "scummy", "trashy", "moronic"], 3)) if bad else "")
        rows.append((i, t, int(bad)))
    return rows


def test_executors_collect_before_the_python_stages(spark, monkeypatch):
    """Collecting reaches the JVM of the tasks, and each stage that runs Python asks for it before it does anything else."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory
    count = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Concurrent" not in b.getName())
    before = count()
    common.collected(spark)
    assert count() > before

    def asked(_):
        raise InterruptedError

    monkeypatch.setattr(corpus_pipeline, "collected", asked)
    for name, stage in corpus_pipeline.STAGES:
        if name != "mixing":
            with pytest.raises(InterruptedError):
                stage(spark, None, "")


def test_index_passes_the_driver_in_turns(spark, monkeypatch):
    """Pieces are whole, empty ones too, and only a few of their parts are collected at a time, though one partition has all."""
    rnd = random.Random(6)
    want = [rnd.randbytes(n) for n in (950, 0, 100, 2500)]
    rows = [(i, at, x[at : at + 100]) for i, x in enumerate(want) for at in range(0, max(len(x), 1), 100)]
    rnd.shuffle(rows)
    parts = spark.createDataFrame([(i, at, bytearray(x)) for i, at, x in rows], "i long, at long, raw binary").coalesce(1)
    parts = common.written(parts, "parts", per_file=3)
    sizes, collect = [], type(parts).collect

    def seen(df):
        out = collect(df)
        sizes.append(sum(len(r.raw) for r in out if "raw" in df.columns))
        return out

    monkeypatch.setattr(type(parts), "collect", seen)
    assert toxicity.passed_on(parts) == want
    assert max(sizes) <= 300 and sum(sizes) == sum(map(len, want))


def test_toxicity(spark):
    rows = toxic_corpus()
    df = docs(spark, [(i, t, "s") for i, t, _ in rows] + [(9001, None, "s"), (9002, "", "s"), (None, "scummy idiots", "s")])
    labels = spark.createDataFrame([(i, 1, y, "q") for i, _, y in rows] + [(None, 1, 1, "q"), (3, None, None, "q")], "doc_id long, quality int, toxic int, term string")
    got = {r.doc_id: r for r in toxicity.digest(df, labels).collect()}
    tested = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in tested) and np.mean([got[i].predicted == y for i, y in tested]) >= 0.97
    assert got[9001].score == got[9002].score < 0.5 and got[None].predicted == 1 and not got[None].held_out
    assert toxicity.digest(df.limit(0), labels).count() == 0
    assert toxicity.digest(df, labels.limit(0)).agg(F.max("score")).first()[0] == 0


def test_block_max_search_is_exact(spark):
    rows = toxic_corpus()
    model = toxicity.fit(docs(spark, [(i, t, "s") for i, t, _ in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")).model()
    flat = model.weights.reshape(len(model.terms), -1)
    for _, t, _ in rows[:60]:
        at, w = model.vector(t)
        s = w @ flat[at] if len(at) else np.zeros(flat.shape[1])
        want = sorted(((-x, i) for i, x in enumerate(s.tolist()) if x > 0))[:15]
        assert np.allclose([x for x, _ in model.nearest(at, w, 15)], [-x for x, _ in want])


def test_neighbours_by_all_terms(spark):
    rows = toxic_corpus()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, [(i, t, "s") for i, t, _ in rows]), labels).model()
    train = [(i, toxicity.term_counts(t)) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]
    held = collections.Counter(t for _, c in train for t in c)
    assert sorted(map(int, model.ids)) == [i for i, _ in train] and len(model.terms) == len(held)

    def vector(counts):
        w = {t: (1 + math.log(n)) * (1 + math.log(len(train) / held[t])) for t, n in counts.items() if t in held}
        return {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}

    examples = {i: vector(c) for i, c in train}
    tested = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0][:30]
    truth = {i: y for i, _, y in rows}

    def vote(q, left_out=None):
        exact = {i: sum(x * e.get(t, 0.0) for t, x in q.items()) for i, e in examples.items()}
        near = sorted(((-s, i) for i, s in exact.items() if i != left_out and s > 0))[:15]
        weights = [(1 / (1.05 + s), truth[i]) for s, i in near]
        return exact, sum(w for w, y in weights if y) / sum(w for w, _ in weights)

    bins = [[] for _ in range(10)]
    for i, e in examples.items():
        v = vote(e, i)[1]
        bins[min(int(v * 10), 9)].append(truth[i])
    curve = np.maximum.accumulate([(sum(b) + 2 * (i + 0.5) / 10) / (len(b) + 2) for i, b in enumerate(bins)])
    for text, (score, ids, cosines) in zip(tested, model.scores(tested), strict=True):
        exact, v = vote(vector(toxicity.term_counts(text)))
        assert np.allclose(cosines, sorted(exact.values(), reverse=True)[:15], atol=1e-5) and np.allclose(cosines, [exact[i] for i in ids], atol=1e-5)
        assert abs(score - np.interp(v, (np.arange(10) + 0.5) / 10, curve)) < 0.02


def test_a_repeated_id_is_one_example(spark):
    """Whatever the order of the rows, the least of its texts stands for it."""
    rows = toxic_corpus(60) + [(1, "zebra text", 0), (1, "aardvark text", 0)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    a, b = (toxicity.fit(docs(spark, [(i, t, "s") for i, t, _ in r]), labels).model() for r in (rows, rows[::-1]))
    assert a.terms == b.terms and (a.ids == b.ids).all() and len(set(a.ids)) == len(a.ids)
    assert "aardvark" in a.terms and "zebra" not in a.terms


class Sent:
    """A broadcast as a worker has it: read from a file, and kept once it has been read."""

    def __init__(self, value):
        self._path, self.stored = "file", value

    @property
    def value(self):
        if not hasattr(self, "_value"):
            self._value = [bytearray(x) for x in self.stored]
        return self._value


def test_a_worker_keeps_no_bytes_of_the_model():
    counts = [toxicity.term_counts(t) for _, t, _ in toxic_corpus(60)]
    terms = sorted(set().union(*counts))
    places = np.array([terms.index(t) for c in counts for t in c], np.int32)
    example = np.repeat(np.arange(60, dtype=np.int32), [len(c) for c in counts])
    ids, toxic = np.array([*map(str, range(60))], object), np.arange(60) % 3 == 0
    sent = Sent(toxicity.packed(toxicity.Model.of(ids, toxic, terms, places, example, np.array([n for c in counts for n in c.values()], np.uint8))))
    first, again = (toxicity.Fitted(sent).model() for _ in range(2))
    assert not hasattr(sent, "_value") and not first.compact
    assert (first.weights == again.weights).all() and len(first.terms) == len(terms)


def test_terms_are_found_whatever_their_hashes(monkeypatch):
    found = ["a", "ab", "b", "ü", "zz"]
    for hashed in (hash, len, lambda w: 0):
        monkeypatch.setattr(toxicity, "hash", hashed, raising=False)
        terms = toxicity.Terms("\n".join(found))
        assert terms.places(["b", "", "zz", "zy", "ü", "abc", "a", "\udc80"]).tolist() == [2, -1, 4, -1, 3, -1, 0, -1]
        assert toxicity.Terms("").places(["a"]).tolist() == [-1] and "ab" in terms and "ba" not in terms


def test_terms_are_told_apart_by_their_letters(monkeypatch):
    """Bases that give many terms one hash, so that others have to be passed over."""
    found = ["a", "ab", "abcdefgh", "abcdefghijklmnopqr", "abcdefghijklmnopqs", "ba", "bä", "ß" * 9, "𝔸b"]
    for base in (0, 1, toxicity.BASE):
        monkeypatch.setattr(toxicity, "BASE", base)
        terms = toxicity.Terms("\n".join(found))
        assert terms.places(found).tolist() == [*range(len(found))]
        assert terms.places(["", "b", "abcdefghijklmnopqt", "abcdefg", "äb", "ß" * 8]).tolist() == [-1] * 6


def test_words_are_read_without_strings_of_them(monkeypatch):
    """A text's vector comes from its characters as numbers, and is the one that words and prefixes give."""
    texts = ["", None, "Straße_straße straßen 12x y²z ⅷ", "İstanbul İSTANBULS ＡＢＣＤＥ", "𝔸𝔹𝔻𝔼𝔽𝔾 a\u0301b\n\ncafé caféterias", "x" * 300 + " " + "x" * 299, "日本語日本語 idiots idiotic" * 50, "under\u2028line 7"]
    counts = [toxicity.term_counts(t) for t in texts]
    terms = sorted(set().union(*counts) - {"café", "idiots"}, key=str.encode)
    held = [[t for t in c if t in terms] for c in counts]
    places, example = np.array([terms.index(t) for h in held for t in h], np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in held])
    n = np.array([c[t] for c, h in zip(counts, held, strict=True) for t in h], np.uint8)
    model = toxicity.unpacked([bytearray(x) for x in toxicity.packed(toxicity.Model.of(np.array([*map(str, range(len(texts)))], object), np.arange(len(texts)) > 3, terms, places, example, n))])
    monkeypatch.setattr(toxicity, "CHARS", 40)
    toxicity.letters()
    monkeypatch.setattr(toxicity, "WORD", None)
    for (at, w), c in zip(model.vectors(texts), counts, strict=True):
        want = {terms.index(t): (1 + math.log(k)) * model.idf[terms.index(t)] for t, k in c.items() if t in terms}
        size = math.sqrt(sum(x * x for x in want.values()))
        assert at.tolist() == sorted(want) and np.allclose(w, [want[i] / size for i in at.tolist()])
    near = [model.nearest(at, w, 3) for at, w in model.vectors(texts)]
    number = {name: i for i, name in enumerate(model.ids.tolist())}
    assert all(x[0][1] == number[str(i)] and abs(x[0][0] - 1) < 1e-5 for i, x in enumerate(near) if x) and sum(map(bool, near)) == len(texts) - 2


# 7


def test_mixing(spark):
    rnd = random.Random(7)
    rows = [(i, words(rnd, rnd.choice([1, 5, 40, 300])), rnd.choice(["a", "b", "b", "b", "c", None])) for i in range(600)] + [(601, None, "a"), (602, "", "z"), (None, "x y", "a"), (1, rows_text := "dup dup", "a"), (1, rows_text, "a")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total, sizes = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.copies * r.size <= r.taken
        total[r.source] += r.taken
        sizes[r.source] += r.size
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        budget -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    seen = {r.source: (r.target, r.source_size) for r in got}
    for s in names:
        assert seen[s][1] == sizes[s] and abs(seen[s][0] - target[s]) < 1e-6 * max(1, target[s]) and abs(total[s] - target[s]) <= 2
    for s in names:  # the rates: one tilt per source, and together the target
        own = [r for r in got if r.source == s and r.size]
        mean = sizes[s] / sum(r.source == s for r in got)
        if own:
            assert abs(sum(r.rate * r.size for r in own) - target[s]) < 1e-6 * max(1, target[s])
            tilts = [math.log(r.rate) * (r.size + mean) / r.size for r in own if r.rate < 2]
            assert not tilts or max(tilts) - min(tilts) < 1e-6
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    copies = mixing.mixed(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)


# 8


def test_permutations():
    for size in (2, 10, 1000):
        assert sorted(map(pii.Permutation(b"k", "n", size, 0), range(size))) == list(range(size))


def test_surrogates_keep_types():
    make = pii.Surrogates(b"key")
    text = "Mrs Anna Müller (anna.m@mail.example.org, ANNA.M@mail.example.org), +1 (334) 555-3192, 334-555-3192, 4111 1111 1111 1111, 10.1.2.3, password=abc123def, 123-45-6789"
    new, spans = pii.replaced(text, make, {})
    kinds = [k for _, _, k in spans]
    assert kinds == ["given-f-latin", "surname-latin", "email", "email", "phone", "phone", "card", "ip", "secret", "ssn"]
    parts = [new[a:b] for a, b, _ in spans]
    assert parts[2].lower() == parts[3].lower() and parts[4].endswith(parts[5].replace("-", ") ", 1)) and parts[0].lower() in pii.GIVEN["f", "latin"]
    card = parts[6].replace(" ", "")
    assert int(card[-1]) == pii.luhn(card[:-1]) and parts[7].startswith("10.") and re.fullmatch("[a-f0-9]{9}", parts[8])
    for piece in ("Müller", "anna.m@", "555-3192", "4111 1111", "10.1.2.3", "abc123def", "123-45-6789"):
        assert piece not in new
    assert pii.replaced("Version 1.2.3 of 2024-01-02, 12345", make, {}) == ("Version 1.2.3 of 2024-01-02, 12345", [])


def test_pii(spark):
    phones = [f"+1 (2{i:02d}) 555-{i:04d}" for i in range(60)]
    short = [f"{c}@x.org" for c in "abcdefghijklm"]  # so short a form that surrogates meet originals
    rows = [(i, f"call {p} or {short[i % 13]} now", "s") for i, p in enumerate(phones)] + [(900, None, "s"), (901, "", "s"), (902, f"again {phones[0]}", "s"), (None, f"and {phones[0]}", "s")]
    df = docs(spark, rows)
    out = {r.doc_id: r for r in pii.digest(df).collect()}
    assert out[900].text is None and out[901].text == "" and out[902].text.removeprefix("again ") == out[None].text.removeprefix("and ") and out[902].n_entities == 1
    made = {}
    for i, p in enumerate(phones):
        t = out[i].text
        made[p] = t[out[i].starts[0] : out[i].ends[0]]
        mail = t[out[i].starts[1] : out[i].ends[1]]
        assert mail not in short and made.setdefault(short[i % 13], mail) == mail and p not in t
    assert len(set(made.values())) == len(made)
    assert pii.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "names"), [
    ("Alice met Bob Miller and Priya Raman. Contact Yusuf Demir.", ["Bob", "Miller", "Priya", "Raman", "Yusuf", "Demir"]),
    ("Dear Zoë Quix, as Quix said. Mit Jörg Weiß und Änne Öz. Rencontré Chloé Dubois.", ["Zoë", "Quix", "Quix", "Jörg", "Weiß", "Änne", "Öz", "Chloé", "Dubois"]),
    ("от Пелагея Чернова и Фома Гордеев", ["Пелагея", "Чернова", "Фома", "Гордеев"]),
    ("From General Public License. Under the GNU General Public License by Apache License and The The The. In May With June July.", []),
])
def test_names_in_context(text, names):
    assert [text[a:b] for a, b, k, _ in pii.detect(text) if k.startswith(("given", "surname"))] == names


def test_surrogates_by_brute_force(spark):
    """Every entity of every text: one surrogate per canonical form, no two alike, none somebody's original, forms kept."""
    rnd = random.Random(21)
    texts = []
    for i in range(150):
        phone = f"+1 (2{rnd.randint(10, 99)}) 555-{rnd.randint(0, 30):04d}"
        texts.append(rnd.choice([
            f"mail {rnd.choice('abcdefgh')}{rnd.choice('xyz')}@corp.example and {phone}", f"met Ab{rnd.choice('aeiou')} Le{rnd.choice('mnrst')}o, then Ab{rnd.choice('aeiou')}",
            f"host 10.0.0.{rnd.randint(0, 9)} mac 00:1B:44:11:3A:{rnd.randint(0, 255):02X}", f"ssn 123-45-{rnd.randint(0, 40):04d} card 4111 1111 1111 {rnd.randint(1000, 1040)}",
            f"iban DE{rnd.randint(10, 12)} 3704 0044 0532 0130 00, password={rnd.choice('qwerty')}12345",
        ]))
    texts.append("x" * 200_000 + " met Ivo Brand. " + "y" * 200_000)
    out = {r.doc_id: r for r in pii.digest(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    made, originals = {}, collections.defaultdict(set)
    for i, t in enumerate(texts):
        entities, r = pii.detect(t), out[i]
        assert len(entities) == r.n_entities == len(r.starts) and [k for _, _, k, _ in entities] == r.kinds
        rest, at = [], 0
        for a, b in zip(r.starts, r.ends, strict=True):
            rest.append(r.text[at:a])
            at = b
        old, end = [], 0
        for (a, b, kind, value), x, y in zip(entities, r.starts, r.ends, strict=True):
            old.append(t[end:a])
            end = b
            new = pii.canonical(kind.partition("-")[0], r.text[x:y]) if not kind.startswith(("given", "surname")) else r.text[x:y].lower()
            family = kind.partition("-")[0]
            originals[family].add(value)
            assert made.setdefault((family, value), new) == new and new != value
            if family in ("phone", "card", "ssn", "iban", "mac"):
                assert re.sub("[0-9]", "0", r.text[x:y]).upper() == re.sub("[0-9]", "0", t[a:b]).upper() or family in ("iban", "mac")
        assert rest == old and r.text[at:] == t[end:]
    for family, values in originals.items():
        own = [new for (f, _), new in made.items() if f == family]
        assert len(set(own)) == len(own) == len(values) and not values & set(own)


def test_a_full_kind_keeps_distinct_surrogates(spark, monkeypatch):
    """All addresses of a network are originals: surrogates can't avoid them, but stay distinct."""
    monkeypatch.setattr(pii, "TRIES", 2)
    values = [f"169.254.{i // 256}.{i % 256}" for i in range(1 << 16)]
    odd, full = pii.tweaks(spark.createDataFrame([("ip", v) for v in values] + [("email", "ann@x.org")], "kind string, value string"), b"key")
    assert full == ["ip"] and odd.filter("kind = 'ip'").count() == 0
    make = pii.Surrogates(b"key", full)
    assert sorted(make("ip", v, 0) for v in values[:3000]) != sorted(values[:3000]) and len({make("ip", v, 5) for v in values}) == len(values)


def test_no_key_keeps_a_listed_name():
    for key in (b"key", b"other", b"third"):
        make = pii.Surrogates(key)
        for where, names in pii.GIVEN.items():
            for tweak in range(pii.WIDEN):
                made = [make(f"given-{where[0]}-{where[1]}", n, tweak) for n in names]
                assert sorted(made) == sorted(names) and all(a != b for a, b in zip(names, made, strict=True))


def test_listed_names_collide_with_nobody(spark):
    few, all_of = pii.GIVEN["m", "latin"][:4], pii.GIVEN["m", "cyrillic"]  # a list with names to spare, and one without
    unlisted = ["Xaver", "Juri", "Sepp", "Bo", "Ansgar"]
    rows = [(f"Mr {n.capitalize()} Smith", n) for n in few] + [(f"г-н {n.capitalize()} Кто", n) for n in all_of] + [(f"Mr {n} Smith", n.lower()) for n in unlisted]
    rows += [("Ms Paul Smith", "paul"), ("Dr Paul Smith", "paul")]
    out = {r.doc_id: r for r in pii.digest(docs(spark, [(i, t, "s") for i, (t, _) in enumerate(rows)])).collect()}
    made = {}
    for i, (_, n) in enumerate(rows):
        new = out[i].text[out[i].starts[0] : out[i].ends[0]].lower()
        assert out[i].kinds[0].startswith("given") and made.setdefault(n, new) == new
    originals = {n for _, n in rows}
    assert len(set(made.values())) == len(made) and not originals & set(made.values())
    assert all(made[n] in pii.GIVEN["m", "latin"] for n in few)


# 10


def components_by_force(texts, n, num=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return [len(s) for s in sets], comp


def near_texts():
    rnd = random.Random(10)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 200))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, len(base) // 15)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[0].upper(), None, "", " \t", "one two", "One  TWO", "one two three", "é ê ü ö ä"]


def test_near_dedup(spark):
    texts = near_texts()
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    n, comp = components_by_force(texts, 4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.digest(df).collect())
    assert got == [(i, n[i], comp[i], comp[i] == i) for i in range(len(texts))]
    assert near_dedup.digest(df.limit(0)).count() == 0


def test_dropped_keeps_one_of_each_group(spark):
    texts = near_texts()
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[0], "s"), (None, "only here and nowhere else at all", "s"), (None, "only here and nowhere else at all", "s")]
    _, comp = components_by_force(texts, 5)
    empty = {i for i, t in enumerate(texts) if not (t or "").strip()}
    kept = [r.doc_id for r in near_dedup.dropped(docs(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for i, c in enumerate(comp) if i not in empty} | empty)
    assert kept.count(None) == 1


def test_families_that_share_a_template(spark, monkeypatch):
    """Clusters of many components are compared in blocks; nothing that is linked gets lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for share in (0.4, 0.6, 0.75):
        template = [rnd.choice(vocabulary) for _ in range(int(200 * share))]
        for _ in range(80):
            own = [rnd.choice(vocabulary) for _ in range(200 - len(template))]
            texts.append(" ".join(template + own))
            if rnd.random() < 0.3:
                own[rnd.randrange(len(own))] = "x"
                texts.append(" ".join(template + own))
    long = " ".join(rnd.choice(vocabulary) for _ in range(300_000))
    texts += [long, long + " end", long[: len(long) // 2]]
    n, comp = components_by_force(texts, 4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.digest(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect())
    assert got == [(i, n[i], comp[i]) for i in range(len(texts))]


def test_components_of_chains_and_stars(spark):
    name = lambda i: b"%05d" % i
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 160)] + [(300, 300), (401, 400), (400, 402), (402, 401)]
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in links], "a binary, b binary")
    got = {bytes(r.node): bytes(r.comp) for r in near_dedup.components(df).collect()}
    assert got == {name(i): name(0) for i in range(1, 61)} | {name(i): name(100) for i in [*range(101, 160), 200]} | {name(401): name(400), name(402): name(400)}
    assert near_dedup.components(df.limit(0)).count() == 0


def test_sketches_estimate_differences():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 1 << 62, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:360], rnd.integers(0, 1 << 62, 40, dtype=np.uint64)]))
    x, y = (np.frombuffer(s, np.uint8) for s in near_dedup.odd_sketches(near_dedup.samples([a, b])))
    assert np.bitwise_count(x ^ y).sum() <= near_dedup.bar(0.8) < near_dedup.bar(0.7)
    apart = []
    for _ in range(300):  # pairs at similarity 0.8: the mean and the spread that the bar is made of
        both, p, q = (rnd.integers(0, 1 << 62, k, dtype=np.uint64) for k in (400, 50, 50))
        x, y = (np.frombuffer(z, np.uint8) for z in near_dedup.odd_sketches(near_dedup.samples([np.concatenate([both, p]), np.concatenate([both, q])])))
        apart.append(int(np.bitwise_count(x ^ y).sum()))
    mean, high = float(np.mean(apart)), near_dedup.bar(0.8)
    assert max(apart) <= high and 3.5 < (high - mean) / np.std(apart) < 6.5


# The pipeline


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = toxic_corpus(300)
    rnd = random.Random(8)
    extra = [(1000 + i, words(rnd, 80) + f" mail user{i}x@mail.example.org", 0) for i in range(5)]
    extra += [(1100 + i, extra[i][1], 0) for i in range(5)]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, truth = spark.read.parquet(str(tmp_path / "documents.parquet")), {i: y for i, _, y in rows + extra}
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["toxicity", "near_dedup", "pii", "mixing", "sentencepiece"]
    kept = stage["toxicity"](spark, at, str(tmp_path))
    assert kept.columns == at.columns
    left = {r.doc_id for r in kept.collect()}
    assert sum(truth[i] for i in left) <= 2 and len([i for i in truth if not truth[i] and i not in left]) <= 2
    kept = stage["near_dedup"](spark, kept, str(tmp_path))
    assert {1000 + i for i in range(5)} <= {r.doc_id for r in kept.collect()} and not {1100 + i for i in range(5)} & {r.doc_id for r in kept.collect()}
    kept = stage["pii"](spark, kept, str(tmp_path))
    assert kept.columns == at.columns and kept.filter("text like '%x@mail%'").filter("text rlike 'user[0-4]x@'").count() == 0 and kept.filter("n_chars <> length(text)").count() == 0
    kept = stage["mixing"](spark, kept, str(tmp_path))
    assert kept.columns == at.columns and kept.count() > 0
    last = stage["sentencepiece"](spark, kept, str(tmp_path))
    assert last.count() == kept.count() and last.filter("size(ids) <> n_tokens").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == last.count()


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, _tk string, _row string, comp string, size long"


def piped(spark, tmp_path, rows, labels):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, t, "en", s, 0, "a", "b", "c", 7) for i, t, s in rows], PIPELINE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        x = stage(spark, docs_, str(tmp_path))
        x.write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        out.append(docs_)
    return out


def test_pipeline_of_nothing(spark, tmp_path):
    out = piped(spark, tmp_path, [], [])
    assert [x.count() for x in out] == [0] * 5 and all(x.columns == [c.split()[0] for c in PIPELINE.split(", ")] for x in out[:4])
    assert out[4].columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in all columns, empty and very long texts, repeated rows, columns that clash with the operators' own."""
    rnd = random.Random(3)
    long = " ".join(rnd.choice("north south east west") + str(rnd.randint(0, 10**6)) for _ in range(60_000))
    rows = [(None, None, None), (None, "", "s"), (1, None, "s"), (2, "", None), (3, long, "s"), (4, long, "s"), (5, "met Ann Lee, mail ann@x.org", "s"), (5, "met Ann Lee, mail ann@x.org", "s"), (6, " ", "s"), (None, "lone words of nobody", "s")]
    out = piped(spark, tmp_path, rows, [(1, None, None), (None, 1, 1)])
    toxic, near, pii_, mix, ids = out
    assert toxic.count() == len(rows)
    kept = [(r.doc_id, (r.text or "")[:5]) for r in near.collect()]
    assert sorted(kept, key=str) == sorted([(None, ""), (None, ""), (1, ""), (2, ""), (6, " "), (3, long[:5]), (5, "met A"), (None, "lone ")], key=str)
    assert not [r for r in pii_.collect() if r.text and ("ann@" in r.text or "Ann Lee" in r.text)] and pii_.count() == near.count()
    assert {r.doc_id for r in mix.filter("length(trim(text)) > 0").collect()} >= {3} and ids.count() == mix.count()
    assert ids.filter("doc_id = 3").first().n_tokens > 60_000


def test_written_has_the_driver_give_freed_memory_back(spark, monkeypatch):
    """Native memory that the driver's JVM has freed doesn't stay in its pools."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def used():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024

    common.freed(common.written(spark.range(10), "first"))
    held = [spark._jvm.java.util.zip.Deflater() for _ in range(2000)]
    for x in held[:-1]:  # the last one keeps the others' place from shrinking by itself
        x.end()
    monkeypatch.setattr(common, "_trimmed", [], raising=False)
    before = used()
    common.freed(common.written(spark.range(10), "second"))
    assert before - used() > 50
    held[-1].end()
