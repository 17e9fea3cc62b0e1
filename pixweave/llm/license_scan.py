"""License scans: ordered signature rules behind a keyword prefilter.

A text is read as its words, numbered from 0. Every rule is a regular expression over words. Only documents that hold
one of a few keywords reach the rules, and of these only the rules whose own keyword the document holds. Every match
is a detection with the interval of its words. A detection inside the interval of another one is dropped if the other
has a higher priority, or the same priority and a longer interval or an earlier rule. Base phrases are looked up in
the same way but are never dropped.

Only DataFrame functions are used; no shuffle. Edge cases: a null or empty text, or one without words, has no words, no
labels and score 0; very long texts are read whole; repeated rows and null ids keep a row each; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# A line per signature: label | keyword | priority | words. In words, "a|b" are alternatives, "[a]" may be missing,
# "*3" stands for at most three words of any kind. "{v}" makes a rule for every version listed after the words.
SIGNATURES = r"""
gpl-{v}.0-only | gpl | 80 | gpl {v} 0 only : 1 2 3
gpl-{v}.0-or-later | gpl | 81 | gpl {v} 0 or later : 1 2 3
gpl-{v}.0-only | gpl | 70 | gpl|gplv{v} [v{v}|version] {v} [0] : 1 2 3
gpl-{v}.0-only | gplv | 71 | gplv{v} : 1 2 3
gpl-{v}.0-or-later | gplv | 72 | gplv{v} or later : 1 2 3
gpl-{v}.0-only | general | 75 | gnu general public license [as] [published] [by] [the] [free] [software] [foundation] [either] version|v {v} [0] : 1 2 3
gpl-{v}.0-only | general | 75 | gnu general public license v{v} : 1 2 3
gpl-{v}.0-or-later | general | 85 | gnu general public license *10 version {v} [0] [of] [the] [license] or [at] [your] [option] any later version : 1 2 3
gpl-{v}.0-only | general | 60 | general public license [version|v] {v} [0] : 1 2 3
gpl-unversioned | general | 20 | general public license
gpl-unversioned | gnu | 15 | gnu gpl
gpl-classpath | classpath | 88 | gpl *4 with classpath exception
gpl-classpath | classpath | 60 | classpath exception
gpl-bison | bison | 60 | bison exception
gpl-autoconf | autoconf | 60 | autoconf *2 exception
gpl-gcc-runtime | runtime | 60 | gcc runtime library exception
lgpl-{v} | lgpl | 82 | lgpl [v|version] {v} 0|1 : 2 3
lgpl-{v} | lgplv | 82 | lgplv{v} [1] : 2 3
lgpl-2.1-only | lesser | 84 | gnu lesser general public license [version|v] 2 1
lgpl-2.1-or-later | lesser | 90 | gnu lesser general public license *10 version 2 1 [of] [the] [license] or *3 any later version
lgpl-{v}.0-only | lesser | 83 | gnu lesser general public license [version|v] {v} [0] : 2 3
lgpl-{v}.0-or-later | lesser | 89 | gnu lesser general public license *10 version {v} [0] [of] [the] [license] or *3 any later version : 2 3
lgpl-2.0-only | library | 83 | gnu library general public license [version|v] [2] [0]
lgpl-unversioned | lesser | 40 | lesser general public license
lgpl-unversioned | lgpl | 30 | lgpl
agpl-{v}.0-only | agpl | 82 | agpl [v|version] {v} [0] : 1 3
agpl-{v}.0-only | agplv | 82 | agplv{v} : 1 3
agpl-{v}.0-only | affero | 84 | [gnu] affero general public license [version|v] {v} [0] : 1 3
agpl-{v}.0-or-later | affero | 90 | [gnu] affero general public license *10 version {v} [0] [of] [the] [license] or *3 any later version : 1 3
agpl-unversioned | affero | 40 | affero general public license
agpl-unversioned | agpl | 30 | agpl
gfdl-{v} | documentation | 84 | gnu free documentation license version|v 1 {v} : 1 2 3
gfdl-{v} | gfdl | 82 | gfdl [version|v] 1 {v} : 1 2 3
gfdl-unversioned | documentation | 45 | gnu free documentation license
apache-{v}.0 | apache | 80 | apache license [version|v] {v} [0] : 1 2
apache-1.1 | apache | 86 | apache [software] license [version|v] 1 1
apache-{v}.0 | apache | 80 | apache software license [version|v] {v} [0] : 1 2
apache-2.0 | apache | 70 | apache 2 [0]
apache-2.0 | apache | 75 | apache 2 [0] license
apache-2.0 | asl | 70 | asl 2 0
apache-2.0 | apache | 90 | licenses licence|license-2 0
apache-2.0 | apache | 88 | www apache org licenses license 2 0
apache-unversioned | apache | 30 | apache license
apache-unversioned | apache | 30 | apache software license
apache-llvm | llvm | 92 | apache *6 with llvm exceptions
mit | mit | 60 | mit license
mit | mit | 62 | the mit license [mit]
mit | mit | 55 | mit licensed
mit | mit | 55 | licensed under [the] mit
mit | permission | 85 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | mit | 75 | mit no attribution [license]
mit-0 | mit | 75 | mit 0 [license]
mit-modern | permission | 70 | permission is hereby granted without written agreement and without license or royalty fees
x11 | x11 | 60 | x11 license
x11 | x11 | 60 | mit x11 [license]
expat | expat | 60 | expat license
bsd-{v}-clause | bsd | 80 | bsd {v} clause [license] : 0 1 2 3 4
bsd-{v}-clause | bsd | 80 | {v} clause bsd [license] : 0 1 2 3 4
bsd-2-clause | bsd | 75 | simplified|freebsd bsd license
bsd-3-clause | bsd | 75 | new|modified|revised bsd license
bsd-4-clause | bsd | 75 | original|old bsd license
bsd-2-clause | freebsd | 65 | freebsd license
bsd-2-clause | two | 75 | two clause bsd [license]
bsd-3-clause | three | 75 | three clause bsd [license]
bsd-2-clause-patent | bsd | 88 | bsd 2 clause plus patent [license]
bsd-3-clause-clear | bsd | 88 | bsd 3 clause clear [license]
bsd-unversioned | bsd | 40 | bsd license
bsd-unversioned | bsd | 40 | bsd style license
bsd-unversioned | redistribution | 70 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | 72 | neither the name of *12 may be used to endorse or promote products
mpl-{v} | mozilla | 82 | mozilla public license [version|v] {v} : 1 2
mpl-2.0 | mozilla | 84 | mozilla public license [version|v] 2 0
mpl-1.1 | mozilla | 84 | mozilla public license [version|v] 1 1
mpl-1.0 | mozilla | 84 | mozilla public license [version|v] 1 0
mpl-2.0 | mpl | 78 | mpl [v|version] 2 0
mpl-1.1 | mpl | 78 | mpl [v|version] 1 1
mpl-unversioned | mozilla | 40 | mozilla public license
epl-{v}.0 | eclipse | 82 | eclipse public license [version|v] {v} [0] : 1 2
epl-{v}.0 | epl | 78 | epl [v|version] {v} 0 : 1 2
epl-unversioned | eclipse | 40 | eclipse public license
edl-1.0 | eclipse | 82 | eclipse distribution license [version|v] [1] [0]
cddl-1.{v} | cddl | 80 | cddl [version|v] 1 {v} : 0 1
cddl-1.{v} | common | 84 | common development and distribution license [cddl] [version|v] 1 {v} : 0 1
cddl-unversioned | common | 45 | common development and distribution license
cpl-1.0 | common | 70 | common public license [version|v] [1] [0]
cpal-1.0 | common | 70 | common public attribution license [version|v] [1] [0]
eupl-1.{v} | eupl | 80 | eupl [version|v] 1 {v} : 0 1 2
eupl-1.{v} | european | 82 | european union public licence|license [eupl] [version|v] 1 {v} : 0 1 2
eupl-unversioned | european | 45 | european union public licence|license
isc | isc | 70 | isc license
isc | permission | 68 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | bsd | 82 | zero clause bsd [license]
0bsd | 0bsd | 82 | 0bsd
zlib | zlib | 70 | zlib license
zlib | zlib | 72 | zlib libpng license
libpng | libpng | 60 | libpng license
bsl-1.0 | boost | 80 | boost software license [version|v] [1] [0]
busl-1.1 | business | 80 | business source license [version|v] [1] [1]
sspl-1.0 | server | 80 | server side public license [version|v] [1]
elastic-{v}.0 | elastic | 80 | elastic license [version|v] {v} [0] : 1 2
unlicense | unlicense | 70 | the unlicense
unlicense | unencumbered | 75 | free and unencumbered software released into the public domain
wtfpl | wtfpl | 70 | wtfpl
wtfpl | fuck | 75 | do what the fuck you want to public license [version|v] [2]
cc0-1.0 | cc0 | 80 | cc0 [1] [0] [universal]
cc0-1.0 | commons | 82 | creative commons zero [version|v] [1] [0]
cc-by-{v}.0 | cc | 80 | cc by {v} 0 [international|unported|generic] : 1 2 3 4
cc-by-sa-{v}.0 | cc | 84 | cc by sa {v} 0 [international|unported|generic] : 1 2 3 4
cc-by-nc-{v}.0 | cc | 84 | cc by nc {v} 0 [international|unported|generic] : 1 2 3 4
cc-by-nd-{v}.0 | cc | 84 | cc by nd {v} 0 [international|unported|generic] : 1 2 3 4
cc-by-nc-sa-{v}.0 | cc | 88 | cc by nc sa {v} 0 [international|unported|generic] : 1 2 3 4
cc-by-nc-nd-{v}.0 | cc | 88 | cc by nc nd {v} 0 [international|unported|generic] : 1 2 3 4
cc-by-2.5 | cc | 81 | cc by 2 5
cc-by-sa-2.5 | cc | 85 | cc by sa 2 5
cc-by-sa-unversioned | cc | 50 | cc by sa
cc-by-nc-unversioned | cc | 50 | cc by nc
cc-by-nd-unversioned | cc | 50 | cc by nd
cc-by-nc-sa-unversioned | cc | 55 | cc by nc sa
cc-by-nc-nd-unversioned | cc | 55 | cc by nc nd
cc-by-unversioned | cc | 45 | cc by
cc-by-{v}.0 | commons | 82 | creative commons attribution [license] [version|v] {v} 0 [international|unported|generic] : 1 2 3 4
cc-by-sa-{v}.0 | commons | 86 | creative commons attribution sharealike|share [alike] [license] [version|v] {v} 0 : 1 2 3 4
cc-by-nc-{v}.0 | commons | 86 | creative commons attribution noncommercial|non [commercial] [license] [version|v] {v} 0 : 1 2 3 4
cc-by-nd-{v}.0 | commons | 86 | creative commons attribution noderivatives|noderivs|no [derivatives|derivs] [license] [version|v] {v} 0 : 1 2 3 4
cc-by-nc-sa-{v}.0 | commons | 90 | creative commons attribution noncommercial|non [commercial] sharealike|share [alike] [license] [version|v] {v} 0 : 1 2 3 4
cc-by-nc-nd-{v}.0 | commons | 90 | creative commons attribution noncommercial|non [commercial] noderivatives|noderivs|no [derivatives|derivs] [license] [version|v] {v} 0 : 1 2 3 4
cc-by-unversioned | commons | 50 | creative commons attribution [license]
cc-unspecified | commons | 25 | creative commons [license]
cc-by-{v}.0 | creativecommons | 84 | creativecommons org licenses by {v} 0 : 1 2 3 4
cc-by-sa-{v}.0 | creativecommons | 88 | creativecommons org licenses by sa {v} 0 : 1 2 3 4
cc-by-nc-{v}.0 | creativecommons | 88 | creativecommons org licenses by nc {v} 0 : 1 2 3 4
cc0-1.0 | creativecommons | 88 | creativecommons org publicdomain zero 1 0
artistic-{v}.0 | artistic | 80 | artistic license [version|v] {v} [0] : 1 2
artistic-unversioned | artistic | 40 | artistic license
perl | perl | 60 | same terms as perl [itself]
python-2.0 | python | 70 | python license [version|v] [2] [0]
psf-2.0 | python | 72 | python software foundation license [version|v] [2]
php-3.{v} | php | 75 | php license [version|v] 3 {v} : 0 1
ruby | ruby | 60 | ruby license
openssl | openssl | 70 | openssl license
ofl-1.{v} | sil | 82 | sil open font license [version|v] 1 {v} : 0 1
ofl-unversioned | font | 50 | open font license
odbl-1.0 | odbl | 75 | odbl [v|version] [1] [0]
odbl-1.0 | database | 80 | open database license [odbl] [v|version] [1] [0]
odc-by-1.0 | odc | 75 | odc by [v|version] [1] [0]
pddl-1.0 | pddl | 75 | pddl [1] [0]
ms-pl | microsoft | 75 | microsoft public license
ms-rl | microsoft | 75 | microsoft reciprocal license
ncsa | ncsa | 70 | university of illinois ncsa open source license
postgresql | postgresql | 70 | postgresql license
upl-1.0 | universal | 75 | universal permissive license [version|v] [1] [0]
afl-{v}.0 | academic | 75 | academic free license [version|v] {v} [0] : 1 2 3
osl-{v}.0 | open | 75 | open software license [version|v] {v} [0] : 1 2 3
ecl-{v}.0 | educational | 75 | educational community license [version|v] {v} [0] : 1 2
cecill-{v} | cecill | 75 | cecill [version|v] {v} [0] : 1 2
cecill-b | cecill | 76 | cecill b
cecill-c | cecill | 76 | cecill c
mulan-psl-{v}.0 | mulan | 75 | mulan psl|permissive [software] [license] [v{v}|version] [{v}] : 1 2
blueoak-1.0.0 | blue | 75 | blue oak model license [1] [0] [0]
vim | vim | 60 | vim license
curl | curl | 60 | curl license
json | json | 60 | json license
public-domain | public | 30 | public domain
proprietary | reserved | 25 | all rights reserved
proprietary | proprietary | 30 | proprietary license
proprietary | confidential | 40 | proprietary and confidential
spdx-tag | spdx | 35 | spdx license identifier
license-text | license | 5 | licensed under
license-text | licence | 5 | licenced under
"""


def _pattern(words: str) -> str:
    """The words as a regular expression over " word#number" items; both Java's and RE2's engines read it."""
    out = []
    for w in words.split():
        if w[0] == "*":
            out.append(r"(?: [^ #]+#[0-9]+){0,%s}" % w[1:])
        else:
            core = r" (?:%s)#[0-9]+" % re.sub(r"[\[\]]", "", w).replace("-", r"#[0-9]+ ")
            out.append(f"(?:{core})?" if w[0] == "[" else core)
    return "".join(out)


def _compiled() -> list[tuple[int, str, str, int, str]]:
    found = []
    for line in SIGNATURES.strip().splitlines():
        label, key, priority, words = (x.strip() for x in line.split("|", 3))
        words, _, versions = words.partition(" : ")
        for v in versions.split() or [""]:
            found.append((len(found), label.replace("{v}", v), key, int(priority), _pattern(words.replace("{v}", v))))
    return found


#: (order, label, keyword, priority, pattern)
RULES = _compiled()
#: Every rule and base phrase needs one of these somewhere; what lacks them all is not read as words.
GATE = "licen[sc]e|copyright|public|gpl|agpl|gfdl|apache|asl|mit|x11|bsd|mozilla|mpl|eclipse|epl|cddl|eupl|zlib|libpng|unencumbered|wtfpl|cc0|cc[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+by|creative|cecill|mulan|odbl|odc|pddl|reserved|proprietary|spdx|redistribution|endorse|exception|permission|perl"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _place(match: Column) -> tuple[Column, Column]:
    return F.regexp_extract(match, "#([0-9]+)", 1).cast("long"), F.regexp_extract(match, "#([0-9]+)$", 1).cast("long")


def _matches(words: Column, rule: tuple) -> Column:
    """array<struct<rule, label, priority, first, last>>: every match of one rule. Its pattern is a literal, compiled once a task."""
    order, label, _, priority, rx = rule

    def detection(m: Column) -> Column:
        first, last = _place(m)
        return F.struct(F.lit(order).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), first.alias("first"), last.alias("last"))

    return F.transform(F.regexp_extract_all(words, F.lit(rx), F.lit(0)), detection)


def _found(words: Column, low: Column) -> Column:
    """Every match of the rules whose keyword is in ``low``: the rules of a keyword stand behind one look for it."""
    by_key: dict[str, list[tuple]] = {}
    for rule in RULES:
        by_key.setdefault(rule[2], []).append(rule)
    none = F.array().cast("array<struct<rule:int,label:string,priority:int,first:bigint,last:bigint>>")
    return F.flatten(F.array(*(F.when(F.contains(low, F.lit(k)), F.concat(*(_matches(words, r) for r in rules))).otherwise(none) for k, rules in by_key.items())))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` bound to a lambda's variable: Catalyst can't repeat its expression within ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: The priorities of rules, lowest first, and detections that are looked at in one inner loop.
PRIORITIES, AT_ONCE = sorted({p for _, _, _, p, _ in RULES}), 64


def _kept(found: Column) -> Column:
    """The detections that no other one hides, by their places.

    Sorted by first word, then last word, priority and rule (the latter three falling, falling, rising), whatever hides a
    detection stands before it. ``reach`` holds for each priority the last word that detections of it or above have
    reached so far; a detection that one has reached is hidden. The sorted detections are gone through in parts, so
    that the list of those kept isn't copied at each step.
    """
    key = F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("minus_last"), (-d["priority"]).alias("minus_priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    levels = F.array(*map(F.lit, PRIORITIES))

    def step(acc: Column, d: Column) -> Column:
        last, priority = -d["minus_last"], -d["minus_priority"]
        hidden = F.get(acc["reach"], (F.array_position(levels, priority) - 1).cast("int")) >= last
        reach = F.zip_with(levels, acc["reach"], lambda p, r: F.when(p <= priority, F.greatest(r, last)).otherwise(r))
        one = F.array(F.struct(d["rule"].alias("rule"), d["label"].alias("label"), priority.alias("priority"), d["first"].alias("first"), last.alias("last")))
        return F.struct(reach.alias("reach"), F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"))

    kind = "array<struct<rule:int,label:string,priority:int,first:bigint,last:bigint>>"
    start = F.array_repeat(F.lit(-1).cast("long"), len(PRIORITIES))

    def run(parts: Column) -> Column:
        def whole(acc: Column, part: Column) -> Column:
            inner = F.aggregate(part, F.struct(acc["reach"].alias("reach"), F.array().cast(kind).alias("kept")), step)
            return _once(inner, lambda x: F.struct(x["reach"].alias("reach"), F.concat(acc["parts"], F.array(x["kept"])).alias("parts")))

        return F.aggregate(parts, F.struct(start.alias("reach"), F.array().cast(f"array<{kind}>").alias("parts")), whole, lambda acc: F.flatten(acc["parts"]))

    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / AT_ONCE)), lambda i: F.slice(s, (i * AT_ONCE + 1).cast("int"), AT_ONCE))
    return F.when(F.size(found) < 2, found).otherwise(_once(F.array_sort(key), lambda s: _once(cut(s), run)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, base (places of base phrases) and detections (what is left of the rules' matches).

    base: array<struct<label, first>>; detections: array<struct<rule, label, priority, first, last>>, null where the
    text holds no keyword.
    """
    def read(low: Column) -> Column:
        gated = low.rlike(GATE)
        listed = F.transform(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w, i: F.concat(w, F.lit("#"), i.cast("string")))
        return F.struct(
            F.regexp_count(low, F.lit(WORD)).cast("long").alias("n"),
            F.when(gated, F.struct(F.concat(F.lit(" "), F.array_join(listed, " ")).alias("words"), low.alias("low"))).alias("gated"),
        )

    def detect(g: Column) -> Column:
        matches = F.concat(*(_matches(g["words"], (i, label, "", 100, _pattern(phrase))) for i, (phrase, label) in enumerate(BASE)))
        of_base = F.transform(matches, lambda d: F.struct(d["label"].alias("label"), d["first"].alias("first")))
        return F.struct(of_base.alias("base"), _once(_found(g["words"], g["low"]), _kept).alias("detections"))

    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    found = F.when(F.col("_read.gated").isNotNull(), _once(F.col("_read.gated"), detect))
    x = docs.withColumn("_read", _once(low, read)).withColumns({"n_words": F.col("_read.n"), "_found": found})
    return x.withColumns({"base": F.col("_found.base"), "detections": F.col("_found.detections")}).drop("_read", "_found")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns; ``score`` is the highest priority found, of 100 (base phrases count 90)."""
    none = F.array().cast("array<string>")
    labels = lambda c: F.coalesce(F.transform(c, lambda d: d["label"]), none)
    starts = F.transform("base", lambda d: d["first"])
    of_base, of_rules = labels(F.col("base")), labels(F.col("detections"))
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)), F.when(F.size(of_base) > 0, 90).otherwise(0))
    return scanned.select(
        "doc_id", "n_words", F.size(of_base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(of_base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(of_base, of_rules))), ",").alias("labels"),
        F.coalesce(F.size("detections"), F.lit(0)).cast("long").alias("n_detections"),
        (best / 100.0).alias("score"),
    )
