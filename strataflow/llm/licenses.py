"""License detection by ordered signature rules, in SQL functions alone.

A text becomes its words: A-Z lower-cased, one space between and around. A rule is a
pattern over such text with a keyword, a label, a priority and a confidence. Only
texts with some keyword are looked at, and of the rules only those whose keyword the
text has. A detection is an interval of words; one that lies within another of at
least its priority is suppressed if it is the shorter, the lower or (on the same words)
the later one. The four base phrases are rules of their own that are counted whatever
else suppresses them.

Null and empty texts have no words and no detections. There is no limit on the length of a
text or on its detections. An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that must be found, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Families: label prefix, keyword, names as a pattern, versions. Each version gives a rule
# for the name with it, one for "or later", one for "only", and one for its identifier.
_VERSIONED = (
    ("gpl", "gpl", "gnu gpl|gpl|gplv", "1 2 3"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", "1 2 3"),
    ("lgpl", "lgpl", "gnu lgpl|lgpl|lgplv", "2 2.1 3"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "2 2.1 3"),
    ("agpl", "agpl", "gnu agpl|agpl|agplv", "1 3"),
    ("agpl", "general public", "(?:gnu )?affero general public licen[cs]e", "1 3"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", "1.0 1.1 2.0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "1.0 2.0"),
    ("eupl", "european union", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("cddl", "common development", "common development and distribution licen[cs]e", "1.0 1.1"),
    ("osl", "open software", "open software licen[cs]e", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", "academic free licen[cs]e", "1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic licen[cs]e", "1.0 2.0"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("bsl", "boost", "boost software licen[cs]e", "1.0"),
    ("lppl", "latex project", "latex project public licen[cs]e", "1.2 1.3"),
    ("apsl", "apple public", "apple public source licen[cs]e", "1.0 1.1 1.2 2.0"),
    ("cecill", "cecill", "cecill(?: licen[cs]e)?", "1.0 2.0 2.1"),
    ("zpl", "zope", "zope public licen[cs]e", "2.0 2.1"),
    ("ecl", "educational community", "educational community licen[cs]e", "1.0 2.0"),
    ("cpl", "common public", "common public licen[cs]e", "1.0"),
    ("npl", "netscape", "netscape public licen[cs]e", "1.0 1.1"),
    ("odbl", "open database", "open database licen[cs]e", "1.0"),
    ("busl", "business source", "business source licen[cs]e", "1.0 1.1"),
    ("sspl", "server side", "server side public licen[cs]e", "1"),
    ("unicode-dfs", "unicode", "unicode (?:data files and software )?licen[cs]e", "2015 2016"),
)

# Creative Commons terms: label part, words of the short name, words of the long name.
_CREATIVE = (
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
_CREATIVE_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# Single rules: label, keyword, pattern, priority, confidence.
_SINGLE = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 60, 0.99),
    ("mit", "the software is provided", "the software is provided as is without warranty of any kind express or implied", 40, 0.8),
    ("mit", "the mit", "(?:released|licen[cs]ed|distributed|available|published)(?: under)?(?: the terms of)? the mit(?: licen[cs]e)?", 50, 0.95),
    ("mit", "under mit", "(?:released|licen[cs]ed|distributed|available|published) under mit(?: licen[cs]e)?", 50, 0.95),
    ("mit", "mit", "licen[cs]e mit", 30, 0.8),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?", 60, 0.95),
    ("x11", "x11", "x11 licen[cs]e", 30, 0.9),
    ("expat", "expat", "expat licen[cs]e", 30, 0.9),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee", 60, 0.97),
    ("isc", "isc", "isc licen[cs]e", 30, 0.9),
    ("bsd", "bsd", "bsd licen[cs]e", 20, 0.8),
    ("bsd", "bsd", "(?:new|modified|simplified|revised|original) bsd(?: licen[cs]e)?", 30, 0.85),
    ("bsd-1-clause", "bsd", "bsd 1 clause(?: licen[cs]e)?", 40, 0.95),
    ("bsd-2-clause", "bsd", "(?:bsd 2|2|two) clause(?: bsd)?(?: licen[cs]e)?", 40, 0.95),
    ("bsd-3-clause", "bsd", "(?:bsd 3|3|three) clause(?: bsd)?(?: licen[cs]e)?", 40, 0.95),
    ("bsd-4-clause", "bsd", "(?:bsd 4|4|four) clause(?: bsd)?(?: licen[cs]e)?", 40, 0.95),
    ("0bsd", "0bsd", "0bsd", 40, 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 50, 0.95),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software", 50, 0.9),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software", 55, 0.95),
    ("apache-2.0", "apache", "licen[cs]ed under the apache licen[cs]e version 2 0(?: the licen[cs]e)?", 70, 0.99),
    ("apache-2.0", "you may not use this file", "you may not use this file except in compliance with the licen[cs]e", 40, 0.85),
    ("apache", "apache", "apache software foundation", 10, 0.4),
    ("gpl", "free software", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 70, 0.98),
    ("lgpl", "free software", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 70, 0.98),
    ("agpl", "free software", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 70, 0.98),
    ("gpl", "general public", "(?:this work is )?licen[cs]ed under the gnu general public licen[cs]e", 45, 0.95),
    ("gpl", "gpl", "(?:licen[cs]ed|released|distributed) under(?: the)? (?:gnu )?gpl", 40, 0.9),
    ("lgpl", "general public", "gnu (?:lesser|library) general public licen[cs]e", 35, 0.9),
    ("agpl", "general public", "gnu affero general public licen[cs]e", 35, 0.9),
    ("gpl-exception", "classpath", "classpath exception", 30, 0.8),
    ("gpl-exception", "linking exception", "linking exception", 30, 0.6),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 70, 0.99),
    ("mpl", "mozilla", "mozilla public licen[cs]e", 20, 0.85),
    ("epl", "eclipse", "eclipse public licen[cs]e", 20, 0.85),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 60, 0.97),
    ("cddl", "common development", "common development and distribution licen[cs]e", 20, 0.85),
    ("eupl", "european union", "european union public licen[cs]e", 20, 0.85),
    ("unlicense", "unlicense", "(?:the )?unlicense", 30, 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 60, 0.99),
    ("public-domain", "public domain", "(?:released|dedicated|placed|is)(?: in| into| to)? the public domain", 30, 0.8),
    ("public-domain", "public domain", "public domain", 10, 0.5),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 40, 0.95),
    ("cc0-1.0", "creative commons", "creative commons zero(?: v?1 0)?(?: universal)?", 45, 0.95),
    ("cc0-1.0", "no copyright", "the person who associated a work with this deed has dedicated the work to the public domain", 60, 0.97),
    ("cc", "creative commons", "creative commons(?: licen[cs]e)?", 10, 0.6),
    ("wtfpl", "wtfpl", "wtfpl", 30, 0.95),
    ("wtfpl", "what the fuck", "do what the fuck you want to public licen[cs]e", 60, 0.99),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", 30, 0.9),
    ("zlib", "altered source", "altered source versions must be plainly marked as such", 50, 0.95),
    ("libpng", "libpng", "libpng licen[cs]e", 30, 0.9),
    ("bsl-1.0", "boost", "boost software licen[cs]e", 20, 0.9),
    ("psf", "python software", "python software foundation licen[cs]e", 30, 0.95),
    ("php", "php", "php licen[cs]e", 30, 0.9),
    ("ruby", "ruby", "ruby(?: s)? licen[cs]e", 30, 0.85),
    ("perl", "perl", "same terms as perl itself", 40, 0.95),
    ("artistic", "artistic", "artistic licen[cs]e", 20, 0.85),
    ("vim", "vim", "vim licen[cs]e", 30, 0.9),
    ("openssl", "openssl", "openssl licen[cs]e", 30, 0.9),
    ("ssleay", "ssleay", "(?:original )?ssleay licen[cs]e", 30, 0.9),
    ("postgresql", "postgresql", "postgresql licen[cs]e", 30, 0.95),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", 30, 0.95),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", 30, 0.95),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", 30, 0.95),
    ("qpl", "q public", "q public licen[cs]e", 30, 0.95),
    ("ipl", "ibm public", "ibm public licen[cs]e", 30, 0.95),
    ("sissl", "industry standards", "sun industry standards source licen[cs]e", 30, 0.95),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", 30, 0.95),
    ("watcom", "watcom", "sybase open watcom public licen[cs]e", 30, 0.95),
    ("beerware", "beer", "beer ?ware licen[cs]e", 30, 0.9),
    ("json", "for good", "the software shall be used for good not evil", 60, 0.99),
    ("upl", "universal permissive", "universal permissive licen[cs]e", 30, 0.95),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", 20, 0.85),
    ("lppl", "latex project", "latex project public licen[cs]e", 20, 0.85),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", 20, 0.9),
    ("odbl", "open data commons", "open data commons open database licen[cs]e", 40, 0.95),
    ("odc-by", "open data commons", "open data commons attribution licen[cs]e", 40, 0.95),
    ("pddl", "public domain dedication", "(?:open data commons )?public domain dedication(?: and)? licen[cs]e", 40, 0.95),
    ("elastic-2.0", "elastic", "elastic licen[cs]e(?: 2 0)?", 30, 0.9),
    ("commons-clause", "commons clause", "commons clause", 30, 0.8),
    ("polyform", "polyform", "polyform (?:non ?commercial|small business|strict|shield) licen[cs]e", 30, 0.95),
    ("proprietary", "rights reserved", "all rights reserved", 10, 0.5),
    ("proprietary", "proprietary", "proprietary(?: and)?(?: confidential)?(?: licen[cs]e)?", 10, 0.5),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction)(?: or distribution)?(?: of this (?:file|work|software))?", 30, 0.8),
    ("eula", "end user", "end user licen[cs]e agreement", 30, 0.85),
    ("commercial", "commercial", "commercial licen[cs]e", 20, 0.7),
    ("free-unspecified", "licen", "(?:released|licen[cs]ed|distributed) under (?:a|an) (?:free|open source|permissive) licen[cs]e", 15, 0.5),
    ("see-license", "licen", "see(?: the)? licen[cs]e(?: file| txt| md)?(?: for details)?", 10, 0.3),
)


def _spoken(version: str) -> str:
    """A version as words; a closing zero may be left out."""
    major, _, minor = version.partition(".")
    return major if not minor else f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(pattern, keyword, label, priority, confidence, whether base) of every rule, in order."""
    out = [(phrase, phrase, label, 5, 0.9, True) for phrase, label in BASE]
    out += [(pattern, key, label, priority, sure, False) for label, key, pattern, priority, sure in _SINGLE]
    for label, key, names, versions in _VERSIONED:
        for v in versions.split():
            spoken, to = _spoken(v), "(?: licen[cs]e)?(?: version| v| ver)? ?v?"
            out += [
                (f"(?:the )?(?:{names}){to}{spoken}", key, f"{label}-{v}", 50, 0.95, False),
                (f"(?:the )?(?:{names}){to}{spoken}(?: of the licen[cs]e)?(?: or| and)?(?: at your option)?(?: any)? later(?: version)?", key, f"{label}-{v}-or-later", 65, 0.97, False),
                (f"(?:the )?(?:{names}){to}{spoken} only", key, f"{label}-{v}-only", 65, 0.97, False),
                (f"spdx licen[cs]e identifier {label.replace('-', ' ')} {v.replace('.', ' ')}(?: 0)?(?: only| or later)?", "spdx", f"{label}-{v}", 80, 1.0, False),
            ]
    for label, short, long in _CREATIVE:
        out.append((f"(?:licen[cs]ed under )?(?:a )?creative commons {long}(?: licen[cs]e)?", "creative commons", f"cc-{label}", 40, 0.9, False))
        out.append((f"(?:licen[cs]ed under )?cc {short}", "cc by", f"cc-{label}", 30 + short.count(" "), 0.85, False))
        for v in _CREATIVE_VERSIONS.split():
            out += [
                (f"(?:licen[cs]ed under )?cc {short} {_spoken(v)}(?: (?:international|unported|licen[cs]e))*", "cc by", f"cc-{label}-{v}", 60, 0.97, False),
                (f"creative commons {long} {_spoken(v)}(?: (?:international|unported|public|licen[cs]e))*", "creative commons", f"cc-{label}-{v}", 60, 0.98, False),
                (f"creativecommons org licen[cs]es {short} {v.replace('.', ' ')}", "creativecommons", f"cc-{label}-{v}", 70, 1.0, False),
                (f"spdx licen[cs]e identifier cc {short} {v.replace('.', ' ')}", "spdx", f"cc-{label}-{v}", 80, 1.0, False),
            ]
    for name in ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "postgresql", "ncsa", "x11"):
        out.append((f"spdx licen[cs]e identifier {name}", "spdx", name, 80, 1.0, False))
    for n in (1, 2, 3, 4):
        out.append((f"spdx licen[cs]e identifier bsd {n} clause", "spdx", f"bsd-{n}-clause", 80, 1.0, False))
    return out


_INNERMOST = re.compile(r"\(\?:([^()]*)\)([?*]?)")


def _needs_license(pattern: str) -> bool:
    """Whether whatever matches has a word that begins with licen."""

    def group(m: re.Match) -> str:
        every = not m[2] and all(_has_license(alternative) for alternative in m[1].split("|"))
        return " licen" if every else " _ "

    while "(?:" in pattern:
        pattern = _INNERMOST.sub(group, pattern)
    return _has_license(pattern)


def _has_license(plain: str) -> bool:
    return re.search(r"(?:^| )licen", plain) is not None


def _anchors() -> list[str]:
    """Few beginnings of words such that whatever a rule matches has one of them.

    Most patterns need the word license; the others are found by their keyword.
    """
    needed = {"licen"} | {keyword for pattern, keyword, *_ in rules() if not _needs_license(pattern)}
    return sorted(a for a in needed if not any(a != b and a.startswith(b) for b in needed))


def _gate() -> str:
    """The anchors as one pattern, by first letter: a text without any is passed over in one reading."""
    by_letter: dict[str, list[str]] = {}
    for a in _anchors():
        by_letter.setdefault(a[0], []).append(a[1:])
    return " (?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items()) + ")"


def _rule_table() -> Column:
    """The rules by keyword, as one constant array; its size is that of the tables above."""
    by_keyword: dict[str, list[Column]] = {}
    for number, (pattern, keyword, label, priority, sure, base) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append(
            F.struct(
                F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"),
                F.lit(label).alias("label"),
                F.lit(priority).alias("priority"),
                F.lit(float(sure)).alias("sure"),
                F.lit(base).alias("base"),
                F.lit(number).alias("number"),
            )
        )
    groups = [F.struct(F.lit(" " + k).alias("keyword"), F.array(*of).alias("rules")) for k, of in by_keyword.items()]
    return F.array(*groups)


_DETECTION = "struct<start:bigint,stop:bigint,label:string,priority:int,sure:double,base:boolean,number:int>"


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _hits(words: Column, rule: Column) -> Column:
    """All detections of one rule: the words between and in the matches are counted up."""
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    between = F.split(words, rule["pattern"])
    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.array().cast(f"array<{_DETECTION}>").alias("out"))

    def step(so_far: Column, pair: Column) -> Column:
        first = so_far["at"] + _spaces(pair["between"])
        last = first + _spaces(pair["found"])
        one = F.struct(
            first.alias("start"),
            last.alias("stop"),
            rule["label"].alias("label"),
            rule["priority"].alias("priority"),
            rule["sure"].alias("sure"),
            rule["base"].alias("base"),
            rule["number"].alias("number"),
        ).cast(_DETECTION)
        return F.struct(last.alias("at"), F.concat(so_far["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(b.alias("between"), f.alias("found"))
    )
    return F.aggregate(pairs, start, step, lambda done: done["out"])


def _survives(all_found: Column, d: Column) -> Column:
    within = lambda e: (e["start"] <= d["start"]) & (e["stop"] >= d["stop"])
    longer = lambda e: e["stop"] - e["start"] > d["stop"] - d["start"]
    stronger = lambda e: (
        longer(e) | (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["number"] < d["number"]))
    )
    return ~F.exists(all_found, lambda e: within(e) & (e["priority"] >= d["priority"]) & stronger(e))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, found`` and ``kept``: all detections, and those not suppressed."""
    table = _rule_table()
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    words = docs.select("doc_id", F.concat(F.lit(" "), plain, F.lit(" ")).alias("words"))
    counted = words.select(
        "doc_id", "words", F.when(F.length("words") <= 2, F.lit(0).cast("bigint")).otherwise(_spaces(F.col("words")) - 1).alias("n_words")
    )
    able = F.flatten(F.transform(F.filter(table, lambda g: F.contains(F.col("words"), g["keyword"])), lambda g: g["rules"]))
    every = F.flatten(F.transform(able, lambda r: _hits(F.col("words"), r)))
    found = F.when(F.col("words").rlike(_gate()), every).otherwise(F.array().cast(f"array<{_DETECTION}>"))
    return counted.select("doc_id", "n_words", found.alias("found")).withColumn(
        "kept", F.filter("found", lambda d: _survives(F.col("found"), d))
    )


def scan(docs: DataFrame) -> DataFrame:
    """Labels, counts and places per document."""
    base = F.filter("found", lambda d: d["base"])
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    return (
        detect(docs)
        .withColumn("places", base)
        .select(
            "doc_id",
            "n_words",
            F.size("places").cast("bigint").alias("n_base"),
            F.array_min(F.transform("places", lambda d: d["start"])).alias("first_word"),
            F.array_max(F.transform("places", lambda d: d["start"])).alias("last_word"),
            names("places").alias("base_labels"),
            names(F.concat("places", "kept")).alias("labels"),
            F.coalesce(F.array_max(F.transform("kept", lambda d: d["sure"])), F.lit(0.0)).alias("score"),
        )
    )
