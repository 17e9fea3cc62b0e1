"""Personal data replaced by surrogates: keyed, of the same type and format, distinct for distinct originals.

An entity's canonical form (digits of a phone, lower-case address, name word by word) is ranked among all strings of
its template and moved by a keyed permutation of that set, a Feistel network with cycle walking. So equal entities get
equal surrogates in all documents and spellings, different ones get different surrogates, and no table is needed:
letters stay letters of their script, digits digits, vowels of names vowels, listed given names become other listed
names of the same gender, card numbers keep their kind of check digit, public addresses stay public.

Names are found by titles, by listed given names, by words that names follow (met, from, Dear, signed, ...), in chains
(A B and C D), and where a word of a name that was found in a text stands there again. Words are of any script with
capitals; a few capitalised words that are no names (License, Street, months, ...) rule a phrase out.

What a permutation can't promise is that a surrogate isn't somebody else's original, or that two templates never
meet. A distributed check joins all distinct surrogates with all distinct originals; who collides moves on with
another tweak, until nobody does; only those that moved are looked at again. Short names, addresses and secrets whose
format is used up become longer. Kinds of a fixed form (phones, cards, addresses of machines, ...) can't: where one
is so full that TRIES tweaks don't settle it, all its entities take one permutation, so that surrogates stay distinct
and coreferent while some are other people's originals. Listed names are checked like all others; where too many
names of a list are originals, they become unlisted ones of the same letters' kinds. Only the exceptions are joined
back to their documents, a tiny part; listed ones, few by the lists' size, go to all.

Edge cases: a null text stays null, an empty one empty, both without entities; texts of any length are read whole;
repeated rows get the same text; null ids keep their rows; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, in_small_batches, small, tidied, written

#: Tweaks that are tried before a template of letters is made longer, and tries in all; the tweak of kinds that are full.
WIDEN, TRIES, FULL = 6, 60, -1
#: Entities per task when surrogates are made.
PER_TASK = 20_000
#: The session setting that holds the secret (in hex) which permutations depend on.
SETTING = "spark.pixweave.pii.key"

GIVEN = {
    ("f", "latin"): "anna maria julia laura sofia emma clara elena lucia marta alice sarah emily olivia grace hannah claire camille ingrid carmen".split(),
    ("m", "latin"): "john james peter paul mark david michael thomas daniel robert lukas felix hans carlos diego pierre louis henri martin simon".split(),
    ("f", "cyrillic"): "анна мария елена ольга ирина наталья татьяна светлана юлия екатерина".split(),
    ("m", "cyrillic"): "иван пётр сергей алексей дмитрий андрей михаил николай павел владимир".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madam Madame Mme Frau Señora Sra Doña г-жа Госпожа".split(),
    "m": "Mr Mister Sir Monsieur Herr Señor Sr Don г-н Господин".split(),
    "": "Dr Prof Professor Doctor Доктор".split(),
}
_LISTED = {name: where for where, names in GIVEN.items() for name in names}
_ALPHABETS = {
    "digit": "0123456789", "hex": "abcdef", "latin": "abcdefghijklmnopqrstuvwxyz", "latin-vowel": "aeiouy", "latin-consonant": "bcdfghjklmnpqrstvwxz",
    "accent-vowel": "àáâäãåèéêëìíîïòóôöõùúûüýæø", "accent-consonant": "çñßšžčćđðłńřťýþ".replace("ý", ""), "cyrillic-vowel": "аеёиоуыэюя", "cyrillic-consonant": "бвгджзйклмнпрстфхцчшщъь",
    "greek-vowel": "αεηιουωάέήίόύώ", "greek-consonant": "βγδζθκλμνξπρστφχψς",
}
_CLASS = {c: k for k in ("latin-vowel", "latin-consonant", "accent-vowel", "accent-consonant", "cyrillic-vowel", "cyrillic-consonant", "greek-vowel", "greek-consonant", "digit") for c in _ALPHABETS[k]}

_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
#: What names follow, as whole words: in English, German, French, Spanish and Russian.
CUES = (
    "met meet meets with from dear contact contacted call called ask asked by signed sincerely regards named author mentor and told thanked emailed "
    "mit von an und liebe lieber getroffen traf gezeichnet avec chère cher rencontré par et con estimado estimada querido querida por y для от уважаемый уважаемая и"
).split()
#: Capitalised words that make a phrase no name.
NOT_NAMES = frozenset(
    "general public license licence version apache creative commons gnu mit bsd mozilla foundation software street avenue road city university college institute company inc ltd "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "north south east west new united states kingdom republic the a an this that these those of in on for to at is are was privacy policy terms service contact home about".split()
)
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][a-zß-öø-ÿа-яёα-ωά-ώš-žčćđłńřť]+"
#: In this order; an entity starts where no earlier one covers the text.
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("secret", re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b\s*[=:]\s*[\"']?([A-Za-z0-9+/_\-]{6,}=*)")),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})\b")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("mac", re.compile(r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])")),
    ("name", re.compile(rf"\b(?:{_TITLE})\b\.?\s+({_CAPITAL}(?:[ -]{_CAPITAL}){{0,2}})")),
    ("name", re.compile(r"\b((?:" + "|".join(n.capitalize() for n in _LISTED) + rf")(?: {_CAPITAL}){{1,2}})")),
    ("name", re.compile(rf"(?<![^\W\d_])(?i:{'|'.join(CUES)}),?\s+({_CAPITAL}(?: {_CAPITAL}){{1,2}})(?![^\W\d_])")),
)
_CUED = PATTERNS[-1][1]
_PAIR = re.compile(rf"(?<![^\W\d_]){_CAPITAL} {_CAPITAL}")
_WORD = re.compile(rf"(?<![^\W\d_]){_CAPITAL}(?![^\W\d_])")
#: Where patterns of digits can lie, and what a text must hold for the others to be tried.
_DIGITS = re.compile(r"[+(0-9][0-9 ().+-]{5,}[0-9]")
_NUMERIC = ("ip", "card", "ssn", "phone")
_SECRETS = ("pass", "pwd", "secret", "token", "key", "auth")
_PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")
_IBAN = re.compile("[A-Z]{2}[0-9]{2}")
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def luhn(digits: str) -> int:
    """The digit that makes ``digits`` with it valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


class Permutation:
    """A keyed permutation of 0 .. size-1: an unbalanced additive Feistel network; results out of range walk on."""

    ROUNDS = 6

    def __init__(self, key: bytes, name: str, size: int, tweak: int):
        self.size, self.seed = size, hashlib.blake2b(f"{name}|{size}|{tweak}".encode(), key=key[:64], digest_size=32).digest()
        self.a = 1 << -(-max(size - 1, 1).bit_length() // 2)
        self.b = -(-size // self.a)

    def _f(self, i: int, x: int, below: int) -> int:
        wide = below.bit_length() // 8 + 9
        raw, n = b"", 0
        while len(raw) < wide:
            raw += hashlib.blake2b(f"{i}|{n}|{x}".encode(), key=self.seed).digest()
            n += 1
        return int.from_bytes(raw[:wide], "big") % below

    def __call__(self, x: int) -> int:
        while True:
            left, right = x % self.a, x // self.a
            for i in range(self.ROUNDS):
                left = (left + self._f(2 * i, right, self.a)) % self.a
                right = (right + self._f(2 * i + 1, left, self.b)) % self.b
            x = right * self.a + left
            if x < self.size:
                return x


def family(kind: str) -> str:
    """Given names of all genders and scripts are one family of surrogates, and so on."""
    return kind.partition("-")[0]


class Surrogates:
    """Surrogates of canonical entities under one key."""

    def __init__(self, key: bytes, full: Iterable[str] = ()):
        self.key, self.made, self.known, self.full = key, {}, {}, frozenset(full)

    def _move(self, name: str, x: int, size: int, tweak: int) -> int:
        if size < 2:
            return x
        if (p := self.made.get((name, size, tweak))) is None:
            if len(self.made) > 50_000:
                self.made.clear()
            p = self.made[name, size, tweak] = Permutation(self.key, name, size, tweak)
        return p(x)

    def _string(self, name: str, text: str, kinds: list[str | None], tweak: int) -> str:
        """``text`` moved among all strings with these kinds of characters; None keeps a character."""
        rank, size = 0, 1
        for c, k in zip(text, kinds, strict=True):
            if k:
                rank, size = rank * len(_ALPHABETS[k]) + _ALPHABETS[k].index(c), size * len(_ALPHABETS[k])
        template = "".join(k[0] if k else c for c, k in zip(text, kinds, strict=True))
        rank, out = self._move(f"{name}|{template}", rank, size, tweak), []
        for c, k in zip(reversed(text), reversed(kinds), strict=True):
            if k:
                rank, i = divmod(rank, len(_ALPHABETS[k]))
                c = _ALPHABETS[k][i]
            out.append(c)
        return "".join(reversed(out))

    def __call__(self, kind: str, value: str, tweak: int = 0) -> str:
        if family(kind) in self.full:
            tweak = FULL
        known = self.known.get((kind, value, tweak))
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[kind, value, tweak] = self._made(kind, value, tweak)
        return known

    def _made(self, kind: str, value: str, tweak: int) -> str:
        longer = max(tweak, 0) // WIDEN  # a template that has no room left gives way to a longer one
        if kind == "email":
            local, _, domain = value.rpartition("@")
            local += local[0] * longer
            kinds = ["digit" if c in "0123456789" else "latin" if c in _ALPHABETS["latin"] else None for c in local]
            return self._string(f"email@{domain}", local, kinds, tweak) + "@" + domain
        if kind == "card":
            check = (int(value[-1]) - luhn(value[:-1])) % 10
            body = value[0] + self._string(f"card{value[0]}{check}", value[1:-1], ["digit"] * (len(value) - 2), tweak)
            return body + str((luhn(body) + check) % 10)
        if kind == "ip":
            return self._ip(value, tweak)
        if kind == "phone":
            keep = 1 if value[0] == "1" else 2
            return value[:keep] + self._string(f"phone{value[:keep]}", value[keep:], ["digit"] * (len(value) - keep), tweak)
        if kind.startswith("given") and (where := _LISTED.get(value)):
            names = GIVEN[where]
            if not longer:
                return self._other(f"given{where}", names, value, tweak)
            value += value[0] * (longer - 1)
            return self._string(f"given{where}", value, [_CLASS.get(c) for c in value], tweak)
        if kind.startswith(("given", "surname")):
            value += value[0] * longer
            return self._string(kind, value, [_CLASS.get(c) for c in value], tweak)
        value += "0" * longer if kind == "secret" else ""
        hexes = kind == "mac" or kind == "secret" and not re.search("[g-zG-Z]", value)
        kinds, low = [], value.lower()
        for i, c in enumerate(low):
            keep = kind == "iban" and i < 2
            kinds.append(None if keep else "digit" if c in "0123456789" else ("hex" if hexes else "latin") if c in _ALPHABETS["latin"] else None)
        case = "".join("A" if c.isupper() else "a" for c in value)
        out = self._string(f"{kind}{case}", low, kinds, tweak)
        return "".join(c.upper() if m == "A" else c for c, m in zip(out, case, strict=True))

    def _other(self, name: str, names: list[str], value: str, tweak: int) -> str:
        """The next name on a keyed cycle through all of the list: never the name itself."""
        if (following := self.made.get((name, tweak))) is None:
            cycle = sorted(names, key=lambda n: self._move(name, names.index(n), len(names), tweak))
            following = self.made[name, tweak] = dict(zip(cycle, cycle[1:] + cycle[:1], strict=True))
        return following[value]

    def _ip(self, value: str, tweak: int) -> str:
        ip = ipaddress.IPv4Address(value)
        for net in map(ipaddress.IPv4Network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/3", "0.0.0.0/8")):
            if ip in net:
                first = int(net.network_address)
                return str(ipaddress.IPv4Address(first + self._move(f"ip{net}", int(ip) - first, net.num_addresses, tweak)))
        x = int(ip)
        while True:  # walks on until the address is public again
            x = self._move("ip", x, 1 << 32, tweak)
            if not any(a <= x <= b for a, b in _SPECIAL):
                return str(ipaddress.IPv4Address(x))


_SPECIAL = [(int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.IPv4Network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/3", "0.0.0.0/8"))]


def _script(word: str) -> str:
    return next((_CLASS[c].split("-")[0].replace("accent", "latin") for c in word.lower() if c in _CLASS), "latin")


def canonical(kind: str, value: str) -> str:
    if kind in ("card", "ssn"):
        return re.sub("[^0-9]", "", value)
    if kind == "phone":
        digits = re.sub("[^0-9]", "", value)
        return digits if value.startswith("+") or len(digits) != 10 else "1" + digits
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "iban":
        return value.replace(" ", "")
    return value if kind == "secret" else value.lower()


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), in order and without overlaps. Names come word by word, as given or surname."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    runs = [m.span() for m in _DIGITS.finditer(text)]
    low = text.lower() if "=" in text or ":" in text else ""
    tried = {
        "email": "@" in text, "iban": bool(runs) and _IBAN.search(text) is not None, "mac": text.count(":") > 4 or text.count("-") > 4,
        "secret": any(s in low for s in _SECRETS) or any(s in text for s in _PREFIXES),
        "name": any(t in text for t in _GENDER) or any(n in text for n in _CAPITALS) or _PAIR.search(text) is not None,
    }
    people: dict[str, str] = {}  # words of names, and their kinds
    for kind, pattern in PATTERNS:
        where = runs if kind in _NUMERIC else [(0, len(text))] if tried[kind] else []
        for m in (m for x, y in where for m in pattern.finditer(text, x, y)):
            a, b = m.span(1 if pattern.groups else 0)
            if any(a < y and x < b for x, y in taken):
                continue
            if kind == "phone" and not 7 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                continue
            taken.append((a, b))
            if kind != "name":
                found.append((a, b, kind, canonical(kind, text[a:b])))
                continue
            words = [(a + w.start(), a + w.end(), w[0]) for w in re.finditer(r"[^\s-]+", text[a:b])]
            if pattern is _CUED and (len({w for _, _, w in words}) < len(words) or any(w.lower() in NOT_NAMES for _, _, w in words)):
                taken.pop()
                continue
            title = text[m.start() : a].strip(" .\n\t")
            for i, (x, y, w) in enumerate(words):
                script = _script(w)
                gender = _GENDER.get(title) or _LISTED.get(w.lower(), ("", ""))[0]
                given = w.lower() in _LISTED or i < len(words) - 1
                found.append((x, y, f"given-{gender}-{script}" if given else f"surname-{script}", w.lower()))
                people.setdefault(w, found[-1][2])
    if people:  # the same words elsewhere in the text mean the same people
        starts = {x for x, _ in taken}
        inside = lambda x: any(p <= x < q for p, q in taken)
        found += [(m.start(), m.end(), people[m[0]], m[0].lower()) for m in _WORD.finditer(text) if m[0] in people and m.start() not in starts and not inside(m.start())]
    return sorted(found)


_CAPITALS = [n.capitalize() for n in _LISTED]


def _shaped(kind: str, original: str, surrogate: str) -> str:
    """The surrogate of a canonical form, in the original's spelling."""
    if kind in ("card", "ssn", "phone", "iban"):
        room = sum(c.isalnum() for c in original)
        left = iter(surrogate[len(surrogate) - room :])
        return "".join(next(left) if c.isalnum() else c for c in original)
    if kind == "ip" or kind == "secret":
        return surrogate
    if len(original) == len(surrogate):
        return "".join(s.upper() if o.isupper() else s for o, s in zip(original, surrogate, strict=True))
    return surrogate.capitalize() if original[:1].isupper() else surrogate


def replaced(text: str | None, make: Surrogates, tweaks: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities as (start, end, kind) in the new text."""
    found = detect(text)
    if not found:
        return text, []
    out, at, size, spans = [], 0, 0, []
    for a, b, kind, value in found:
        new = _shaped(kind, text[a:b], make(kind, value, tweaks.get((kind, value), 0)))
        out += [text[at:a], new]
        size += a - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), spans


def _entities(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, v) for i, t in enumerate(batch.column(2).to_pylist()) for k, v in {(k, v) for _, _, k, v in detect(t)}]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "dk", "kind", "value"])

    return docs.select("doc_id", F.xxhash64("text").alias("dk"), "text").mapInArrow(lambda batches: tidied(run(batches)), f"doc_id {kind}, dk long, kind string, value string")


def _listed(names: Iterable[str] = tuple(_LISTED)) -> Column:
    return F.col("kind").startswith("given") & F.col("value").isin(list(names))


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting holds; without one a random key, which this driver keeps to its end.

    Whoever has the key can turn surrogates back, so none is part of the code. Set it to get the same ones in every run.
    """
    held = spark.conf.get(SETTING, None)
    if held:
        return bytes.fromhex(held)
    if not _random:
        _random.append(secrets.token_bytes(32))
    return _random[0]


_random: list[bytes] = []


def tweaks(entities: DataFrame, key: bytes) -> tuple[DataFrame, list[str]]:
    """(kind, value, tweak): the entities whose first surrogate collides, with the tweak under which none does; and the
    families that are too full for that."""
    spark, made = entities.sparkSession, Surrogates(key)

    def surrogate(kinds: pa.Array, values: pa.Array, tweak: pa.Array) -> pa.Array:
        return pa.array([made(*x) for x in zip(kinds.to_pylist(), values.to_pylist(), tweak.to_pylist(), strict=True)], pa.string())

    make = F.arrow_udf(surrogate, "string")
    found = written(entities.select("kind", "value").distinct(), "pii-distinct")
    tasks = max(spark.sparkContext.defaultParallelism, -(-found.counted // PER_TASK))
    taken = {r.value for r in found.filter(_listed()).select("value").distinct().collect()}
    full_lists = [n for names in GIVEN.values() if 2 * len(taken & set(names)) > len(names) for n in names]  # fewer names to spare than needed
    family_ = F.split_part("kind", F.lit("-"), F.lit(1))
    todo = found.withColumn("tweak", F.when(_listed(full_lists), WIDEN).otherwise(0)).withColumn("family", family_)
    originals = written(todo.select(F.col("family").alias("f"), F.col("value").alias("v")).distinct(), "pii-originals")
    settled, full = None, []  # (kind, value, tweak, family, surrogate)
    for attempt in range(TRIES + 1):
        x = written(todo.repartition(tasks, "kind", "value").withColumn("surrogate", make("kind", "value", "tweak")), "pii-surrogates")
        theirs = x.join(originals, (F.col("family") == F.col("f")) & (F.col("surrogate") == F.col("v")), "left_semi").select("kind", "value")
        every = x if settled is None else x.unionByName(settled)
        meeting = x.select("family", "surrogate").distinct()
        first = every.join(meeting, ["family", "surrogate"], "left_semi").groupBy("family", "surrogate").agg(F.min(F.struct("tweak", "kind", "value")).alias("m"), F.count("*").alias("n")).filter("n > 1")
        first = written(first, "pii-meeting")
        same = _listed() & (F.col("value") == F.col("m.value"))  # a listed name is one name, whatever title it comes with
        twice = every.join(first, ["family", "surrogate"]).filter((F.struct("tweak", "kind", "value") != F.col("m")) & ~same).select("kind", "value")
        moved = written(theirs.unionByName(twice).distinct(), "pii-moved")
        rest = every.join(moved, ["kind", "value"], "left_anti")
        if not moved.counted or attempt == TRIES:
            full = [r.family for r in moved.select(family_.alias("family")).distinct().collect()]
            return rest.filter((F.col("tweak") > 0) & ~F.col("family").isin(full)).select("kind", "value", "tweak"), full
        again = written(every.join(moved, ["kind", "value"], "left_semi").select("kind", "value", (F.col("tweak") + 1).alias("tweak"), "family"), "pii-again")
        settled_ = written(rest, "pii-settled")
        freed(x, first, moved, *([] if settled is None else [settled]), *([todo] if attempt else []))
        settled, todo = settled_, again
    raise AssertionError


@in_small_batches
def surrogate_texts(docs: DataFrame, key: bytes | None = None, into: str = "pii") -> DataFrame:
    """``docs`` with a struct column: text (the new one), kinds, starts and ends (of the entities in the new text).

    Without a ``key`` the session's is taken.
    """
    key = key or session_key(docs.sparkSession)
    entities = written(_entities(docs.select("doc_id", "text")), "pii-found")
    odd, full = tweaks(entities, key)
    odd = written(odd, "pii-odd")
    everywhere = {(r.kind, r.value): r.tweak for r in odd.filter(_listed()).collect()}  # many documents hold them
    per = entities.join(small(odd.filter(~_listed())), ["kind", "value"]).groupBy("doc_id", "dk").agg(F.collect_set(F.struct("kind", "value", "tweak")).alias("odd"))
    per = written(per.select(F.col("doc_id").alias("id"), F.col("dk").alias("key"), "odd"), "pii-exceptions")
    held = docs.select(F.xxhash64("text").alias("dk"), F.struct(*docs.columns).alias("row"))
    x = held.join(small(per), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("dk") == F.col("key")), "left")

    def run(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        make = Surrogates(key, full)
        for text, exceptions in texts:
            rows = [replaced(t, make, everywhere | {(o["kind"], o["value"]): o["tweak"] for o in odd or ()}) for t, odd in zip(text.to_pylist(), exceptions.to_pylist(), strict=True)]
            ints = pa.list_(pa.int32())
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([[s[2] for s in r[1]] for r in rows], pa.list_(pa.string())), pa.array([[s[0] for s in r[1]] for r in rows], ints), pa.array([[s[1] for s in r[1]] for r in rows], ints)], ["text", "kinds", "starts", "ends"])

    def tidy(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return tidied(run(texts))

    tidy.__annotations__ = {"texts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(tidy, "text string, kinds array<string>, starts array<int>, ends array<int>")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != into]
    return x.select(*kept, made("row.text", "odd").alias(into))


def digest(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """(doc_id, text, n_entities, kinds, starts, ends): texts with surrogates and where these are."""
    x = surrogate_texts(docs.select("doc_id", "text"), key)
    return x.select("doc_id", F.col("pii.text").alias("text"), F.size("pii.kinds").cast("long").alias("n_entities"), "pii.kinds", "pii.starts", "pii.ends")
