"""License scans by ordered signature rules, in Spark's own functions only.

A text is brought to words in lower case with one space between them. A keyword test
decides which rules may match at all; only their regular expressions run, over the words
with their numbers written behind them, so that a match itself says where it stands.
Every match is an interval of words; one that lies within another of the same or a
higher priority is suppressed (a longer signature says more than the name inside it),
and of two equal intervals the rule that comes first stays. The intervals are sorted and
swept once, so a text takes a time in proportion to its length.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Phrases that count as places, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: label, keyword, regular expression of its name, and of its short identifier (over normalised words).
LICENSES = (
    ("agpl-1.0", "affero general public license", r"affero general public license(?: version| v)? 1(?: 0)?", r"agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", "affero general public license", r"(?:gnu )?affero general public license(?:(?: version| v)? ?3(?: 0)?)?", r"agpl(?: v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "general public license", r"gnu general public license(?: version| v) ?1(?: 0)?", r"gpl(?: v)? ?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "general public license", r"(?:gnu )?general public license(?: version| v) ?2(?: 0)?", r"gpl(?: v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "general public license", r"(?:gnu )?general public license(?: version| v) ?3(?: 0)?", r"gpl(?: v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl", "general public license", r"gnu general public license", r"gnu gpl"),
    ("lgpl-2.0", "general public license", r"(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?", r"lgpl(?: v)? ?2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "general public license", r"(?:gnu )?lesser general public license(?: version| v)? 2 1", r"lgpl(?: v)? ?2 1(?: only| or later)?"),
    ("lgpl-3.0", "general public license", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?", r"lgpl(?: v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "general public license", r"(?:gnu )?lesser general public license", r"gnu lgpl"),
    ("gfdl-1.3", "free documentation license", r"(?:gnu )?free documentation license(?: version| v)? 1 3", r"gfdl 1 3(?: only| or later)?"),
    ("gfdl", "free documentation license", r"(?:gnu )?free documentation license", r"gnu fdl"),
    ("apache-1.1", "licen", r"apache (?:software )?license(?: version| v)? 1 1", r"apache 1 1"),
    ("apache-2.0", "licen", r"apache (?:software )?license(?: version| v)? ?2(?: 0)?", r"apache 2 0"),
    ("apache", "licen", r"apache (?:software )?license", r"apache license"),
    ("mit", "licen", r"mit(?: x11| expat)? licen[cs]e", r"mit(?: x11)?"),
    ("mit-0", "no attribution", r"mit no attribution(?: license)?", r"mit 0"),
    ("x11", "licen", r"x11 licen[cs]e", r"x11"),
    ("isc", "licen", r"isc licen[cs]e", r"isc"),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|revised|modified) bsd licen[cs]e", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd licen[cs]e", r"bsd style licen[cs]e"),
    ("0bsd", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?", r"0bsd"),
    ("mpl-1.0", "mozilla public license", r"mozilla public license(?: version| v)? 1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla public license", r"mozilla public license(?: version| v)? 1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla public license", r"mozilla public license(?:(?: version| v)? ?2(?: 0)?)?", r"mpl(?: v)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse public license", r"eclipse public license(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse public license", r"eclipse public license(?:(?: version| v)? ?2(?: 0)?)?", r"epl 2 0"),
    ("edl-1.0", "eclipse distribution license", r"eclipse distribution license(?:(?: version| v)? ?1(?: 0)?)?", r"edl 1 0"),
    ("cddl-1.0", "common development and distribution license", r"common development and distribution license(?:(?: version| v)? ?1(?: 0)?)?", r"cddl 1 0"),
    ("cddl-1.1", "common development and distribution license", r"common development and distribution license(?: version| v)? 1 1", r"cddl 1 1"),
    ("cpl-1.0", "common public license", r"common public license(?:(?: version| v)? ?1(?: 0)?)?", r"cpl 1 0"),
    ("ipl-1.0", "ibm public license", r"ibm public license(?:(?: version| v)? ?1(?: 0)?)?", r"ipl 1 0"),
    ("artistic-1.0", "artistic license", r"artistic license(?: version| v)? ?1(?: 0)?", r"artistic 1 0"),
    ("artistic-2.0", "artistic license", r"artistic license(?:(?: version| v)? ?2(?: 0)?)?", r"artistic 2 0"),
    ("boost-1.0", "boost software license", r"boost software license(?:(?: version| v)? ?1(?: 0)?)?", r"bsl 1 0"),
    ("busl-1.1", "business source license", r"business source license(?:(?: version| v)? 1 1)?", r"busl 1 1"),
    ("zlib", "licen", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("libpng", "licen", r"libpng licen[cs]e", r"libpng 2 0"),
    ("unlicense", "licen", r"the unlicense|unlicense license", r"unlicense"),
    ("wtfpl", "what the fuck you want to public license", r"do what the fuck you want to public license", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", r"creative commons public domain dedication"),
    ("cc-by", "creative commons", r"creative commons attribution(?: licen[cs]e)?", r"creative commons by"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: licen[cs]e)?", r"creative commons by sa"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: licen[cs]e)?", r"creative commons by nc"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative|ativ)e?s?(?: licen[cs]e)?", r"creative commons by nd"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", r"creative commons by nc sa"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?derivatives?(?: licen[cs]e)?", r"creative commons by nc nd"),
    ("cc-by-2.0", "cc by", r"cc by 2 0", r"cc by 2 0 [a-z]{2}"),
    ("cc-by-2.5", "cc by", r"cc by 2 5", r"cc by 2 5 [a-z]{2}"),
    ("cc-by-3.0", "cc by", r"cc by 3 0", r"cc by 3 0 [a-z]{2}"),
    ("cc-by-4.0", "cc by", r"cc by 4 0", r"cc by 4 0 international"),
    ("cc-by-sa-3.0", "cc by", r"cc by sa 3 0", r"cc by sa 3 0 [a-z]{2}"),
    ("cc-by-sa-4.0", "cc by", r"cc by sa 4 0", r"cc by sa 4 0 international"),
    ("cc-by-nc-3.0", "cc by", r"cc by nc 3 0", r"cc by nc 3 0 [a-z]{2}"),
    ("cc-by-nc-4.0", "cc by", r"cc by nc 4 0", r"cc by nc 4 0 international"),
    ("cc-by-nd-4.0", "cc by", r"cc by nd 4 0", r"cc by nd 4 0 international"),
    ("cc-by-nc-sa-4.0", "cc by", r"cc by nc sa 4 0", r"cc by nc sa 4 0 international"),
    ("cc-by-nc-nd-4.0", "cc by", r"cc by nc nd 4 0", r"cc by nc nd 4 0 international"),
    ("ofl-1.1", "open font license", r"(?:sil )?open font license(?:(?: version| v)? 1 1)?", r"ofl 1 1"),
    ("odbl-1.0", "open database license", r"open database license(?:(?: version| v)? ?1(?: 0)?)?", r"odbl(?: 1 0)?"),
    ("odc-by-1.0", "open data commons attribution license", r"open data commons attribution license(?:(?: version| v)? ?1(?: 0)?)?", r"odc by(?: 1 0)?"),
    ("pddl-1.0", "public domain dedication and licen", r"public domain dedication and licen[cs]e", r"pddl(?: 1 0)?"),
    ("ogl-uk-3.0", "open government licen", r"open government licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?", r"ogl uk 3 0"),
    ("etalab-2.0", "licen", r"etalab(?: open)? licen[cs]e", r"etalab 2 0"),
    ("eupl-1.1", "european union public licen", r"european union public licen[cs]e(?: version| v)? 1 1", r"eupl 1 1"),
    ("eupl-1.2", "european union public licen", r"european union public licen[cs]e(?:(?: version| v)? 1 2)?", r"eupl 1 2"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: license(?: agreement)?)?", r"cecill 2 1"),
    ("ms-pl", "microsoft public license", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license", r"ms rl"),
    ("python-2.0", "python software foundation license", r"python software foundation license(?:(?: version| v)? ?2(?: 0)?)?", r"psf 2 0"),
    ("ruby", "licen", r"ruby licen[cs]e", r"ruby"),
    ("php-3.01", "licen", r"php licen[cs]e(?:(?: version| v)? 3 01)?", r"php 3 01"),
    ("openssl", "licen", r"openssl licen[cs]e", r"openssl"),
    ("postgresql", "licen", r"postgresql licen[cs]e", r"postgresql"),
    ("ncsa", "licen", r"(?:university of illinois )?ncsa open source licen[cs]e", r"ncsa"),
    ("afl-3.0", "academic free license", r"academic free license(?:(?: version| v)? ?3(?: 0)?)?", r"afl 3 0"),
    ("osl-3.0", "open software license", r"open software license(?:(?: version| v)? ?3(?: 0)?)?", r"osl 3 0"),
    ("ecl-2.0", "educational community license", r"educational community license(?:(?: version| v)? ?2(?: 0)?)?", r"ecl 2 0"),
    ("mulan-psl-2.0", "mulan permissive software license", r"mulan permissive software license(?:(?: version| v)? ?2)?", r"mulanpsl 2 0"),
    ("upl-1.0", "universal permissive license", r"universal permissive license(?:(?: version| v)? ?1(?: 0)?)?", r"upl 1 0"),
    ("sspl-1.0", "server side public license", r"server side public license(?:(?: version| v)? ?1)?", r"sspl 1 0"),
    ("elastic-2.0", "elastic license", r"elastic license(?:(?: version| v)? ?2(?: 0)?)?", r"elastic 2 0"),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?", r"commons clause restriction"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", r"public domain mark"),
    ("proprietary", "all rights reserved", r"all rights reserved", r"proprietary and confidential"),
)

#: Short names that are detections by themselves, and their labels.
ALONE = (
    (r"gpl(?: v)? ?2(?: 0)?", "gpl-2.0"),
    (r"gpl(?: v)? ?3(?: 0)?", "gpl-3.0"),
    (r"lgpl(?: v)? ?2 1", "lgpl-2.1"),
    (r"lgpl(?: v)? ?3(?: 0)?", "lgpl-3.0"),
    (r"agpl(?: v)? ?3(?: 0)?", "agpl-3.0"),
    (r"wtfpl", "wtfpl"),
    (r"cc by sa", "cc-by-sa"),
    (r"cc by nc", "cc-by-nc"),
    (r"cc by nd", "cc-by-nd"),
    (r"cc by", "cc-by"),
)

#: label, keyword, a passage of the licence's own text.
PASSAGES = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of [a-z0-9]+(?: [a-z0-9]+){0,14} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-3.0", "either version", r"either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "either version", r"either version 2 of the license or at your option any later version"),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "as is basis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost-1.0", "free of charge", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("wtfpl", "you just do", r"you just do what the fuck you want to"),
    ("cc0-1.0", "waived all", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", "share copy", r"you are free to share copy and redistribute the material in any medium or format"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
)

_VERB = r"(?:licen[cs]ed|released|distributed|available|provided|published|offered|covered|made available)"
_NOTICE = _VERB + r" (?:under|by|with)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)?(?: an?)? "

_SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[str, int, float, str, str], ...]:
    """(label, priority, strength, keyword, regular expression over numbered words) in order.

    Each name of `LICENSES` makes two rules, by itself and behind a notice. Notices outrank identifiers, those outrank licence texts, and these bare names."""
    out = []
    for label, keyword, name, short in LICENSES:
        out.append((label, 4, 0.95, keyword, _NOTICE + f"(?:{name})"))
    for label, _, _, short in LICENSES:
        out.append((label, 3, 0.9, "licen", f"(?:spdx license identifier (?:{short})|licen[cs]ed? (?:under |as )?(?:the )?(?:{short})|(?:{short}) licen[cs]ed?)"))
    for short, label in ALONE:
        out.append((label, 1, 0.6, short.split("(")[0], f"(?:{short})"))
    out += [(label, 2, 0.9, keyword, passage) for label, keyword, passage in PASSAGES]
    out += [(label, 1, 0.7, keyword, f"(?:{name})") for label, keyword, name, _ in LICENSES]
    return tuple((lab, p, s, k, f" (?:{_over_numbers(r)}){_NUMBER}(?= )") for lab, p, s, k, r in out)


#: What stands behind a word: a sign that no word has, and the word's number.
_NUMBER = "#[0-9]+"


def _over_numbers(rule: str) -> str:
    """A rule over words as one over numbered words."""
    return re.sub(r" (\??)", lambda m: f"(?:{_NUMBER} )?" if m[1] else f"{_NUMBER} ", rule)


def numbered(norm: F.Column) -> F.Column:
    """The words of a normalised text with their numbers, from 0, behind them."""
    words = F.split(F.trim(norm), " ")
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))), " "), F.lit(" "))


def _spaces(c: F.Column) -> F.Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _rule_table() -> F.Column:
    return F.array(*[
        F.struct(F.lit(lab).alias("label"), F.lit(p).alias("priority"), F.lit(s).alias("strength"), F.lit(k).alias("keyword"), F.lit(r).alias("pattern"))
        for lab, p, s, k, r in rules()
    ])


#: A detection: first and last word (the last negated, so that the longer of two comes first),
#: the rule's negated priority and place, its label and strength.
_DETECTION = "struct<begin:int,end:int,priority:int,order:int,label:string,strength:double>"
#: Detections that are swept before they join the rest.
SWEPT = 256


def _detections(norm: F.Column, with_numbers: F.Column) -> F.Column:
    """All matches, sorted."""
    placed = F.transform(_rule_table(), lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    gated = F.filter(placed, lambda x: F.contains(norm, x["r"]["keyword"]))

    def spans(x):
        def span(m):
            begin, end = (F.regexp_extract(m, p, 1).cast("int") for p in (r"#([0-9]+)", r"#([0-9]+)$"))
            return F.struct(
                begin.alias("begin"), (-end).alias("end"), (-x["r"]["priority"]).alias("priority"), x["i"].alias("order"),
                x["r"]["label"].alias("label"), x["r"]["strength"].alias("strength"),
            )

        return F.transform(F.regexp_extract_all(with_numbers, x["r"]["pattern"], F.lit(0)), span)

    return F.array_sort(F.flatten(F.transform(gated, spans)))


def _suppressed(found: F.Column) -> F.Column:
    """Sorted detections without those that lie within another of the same or a higher priority.

    What contains a detection comes before it, so the largest end so far of each priority
    tells. Kept ones are gathered a part at a time, as each addition copies the array."""
    priorities = sorted({p for _, p, *_ in rules()})
    ends = "struct<" + ",".join(f"e{p}:int" for p in priorities) + ">"

    def step(held, d):
        beaten = F.lit(False)
        for p in priorities:
            beaten = beaten | ((-d["priority"] <= p) & (held["ends"][f"e{p}"] >= -d["end"]))
        now = [F.when((-d["priority"] == p) & (-d["end"] > held["ends"][f"e{p}"]), -d["end"]).otherwise(held["ends"][f"e{p}"]).alias(f"e{p}") for p in priorities]
        return F.struct(F.struct(*now).cast(ends).alias("ends"), F.when(beaten, held["kept"]).otherwise(F.concat(held["kept"], F.array(d))).alias("kept"))

    def part(held, one):
        none = F.array().cast(f"array<{_DETECTION}>")
        swept = F.aggregate(one, F.struct(held["ends"].alias("ends"), none.alias("kept")), step)
        joined = F.transform(F.array(swept), lambda x: F.struct(x["ends"].alias("ends"), F.concat(held["kept"], F.array(x["kept"])).alias("kept")))
        return F.element_at(joined, 1)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / SWEPT).cast("int")), lambda k: F.slice(found, k * SWEPT + 1, SWEPT))
    start = F.struct(F.struct(*[F.lit(-1).alias(f"e{p}") for p in priorities]).cast(ends).alias("ends"), F.array().cast(f"array<array<{_DETECTION}>>").alias("kept"))
    return F.when(F.size(found) < 2, found).otherwise(F.flatten(F.aggregate(parts, start, part)["kept"]))


def gate() -> list[str]:
    """Keywords such that every rule's keyword and every base phrase contains one of them."""
    words = {k for _, _, _, k, _ in rules()} | {p for p, _ in BASE}
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def _gated(norm: F.Column) -> F.Column:
    test = F.lit(False)
    for word in gate():
        test = test | F.contains(norm, F.lit(word))
    return test


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    One row per row of `docs`; a null text counts as empty; no words give zeros, nulls and
    empty labels. detections are the matches that were not suppressed, as label, rule
    priority, first word and number of words. score is the chance that one of them is a
    licence: 1 - prod(1 - strength), a base phrase alone counting 0.5. Repeated rows
    stay; other columns are not read; an empty table gives an empty result. Narrow, no
    Python; a text without a keyword costs its normalisation and the keyword test, and a
    very long one is scanned whole.
    """
    norm = F.col("norm")
    words = docs.select("doc_id", normalised_text().alias("norm"))
    out = words.select("doc_id", "norm", (F.greatest(_spaces(norm), F.lit(1)) - 1).cast("long").alias("n_words"), _gated(norm).alias("gated"))
    places, first, last, labels = [], [], [], []
    for phrase, label in BASE:
        pattern, size = f" {phrase}(?= )", phrase.count(" ") + 1
        has = F.col("gated") & F.contains(norm, F.lit(f" {phrase} "))
        parts = F.split(norm, pattern, -1)
        places.append(F.when(has, F.size(parts) - 1).otherwise(0))
        first.append(F.when(has, _spaces(F.element_at(parts, 1))))
        last.append(F.when(has, F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - size))
        labels.append(F.when(has, F.lit(label)))
    total = places[0]
    for p in places[1:]:
        total = total + p
    once = F.element_at(F.transform(F.array(numbered(norm)), lambda t: _detections(norm, t)), 1)  # numbered once, not for each rule
    found = F.when(F.col("gated"), once).otherwise(F.array().cast(f"array<{_DETECTION}>"))
    out = out.select(
        "doc_id", "n_words", total.cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"), found.alias("found"),
    ).withColumn("kept", _suppressed(F.col("found")))
    miss = F.aggregate(F.col("kept"), F.lit(1.0), lambda a, d: a * (1 - d["strength"]))
    miss = F.when((F.size("kept") == 0) & (F.size("base") > 0), F.lit(0.5)).otherwise(miss)
    both = F.concat(F.col("base"), F.transform("kept", lambda d: d["label"]))
    seen = F.transform(
        "kept",
        lambda d: F.struct(d["label"].alias("label"), (-d["priority"]).alias("priority"), d["begin"].alias("word"), (1 - d["end"] - d["begin"]).alias("n_words")),
    )
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
        (1 - miss).alias("score"), seen.alias("detections"),
    )


def normalised_text() -> F.Column:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    plain = F.translate(text_or_empty(), _SEPARATORS + upper, " " * len(_SEPARATORS) + lower)
    one = F.trim(F.regexp_replace(plain, " {2,}", " "))
    return F.when(one == "", F.lit("")).otherwise(F.concat(F.lit(" "), one, F.lit(" ")))
