"""License scans: ordered signature rules behind a keyword prefilter, overlaps settled by containment.

A text becomes its canonical form: words (runs of ASCII digits, letters in lower case, and any other
non-ASCII characters), each between its own two blanks, so that a rule's expression is anchored at word
boundaries without look-around. A rule is tried only on texts that hold one of the few anchor strings
and then the rule's own keyword. A detection that lies inside another one is dropped if the other's
rule has a higher priority, or an equal priority and a longer interval or an earlier place in the rules;
base rules are never dropped. All of it is built-in expressions over one row; there is no shuffle.

Defined cases: a null text is empty: no words, no detections, score 0; texts of any length are read whole, in time about
linear; repeated rows are scanned each; an empty table gives an empty result; other columns pass through unless named
like a result, which replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: all of ASCII but digits and lower-case letters (texts are lower-cased first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    label: str
    keyword: str  # a substring of every match, in canonical form
    pattern: str  # over the canonical form
    priority: int
    confidence: float
    base: bool


#: Phrase and label; the base of the operator's contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label: (SPDX words, names as word expressions). A name's word may be an expression; a trailing ? makes it optional.
#: Each family gives the rules "spdx tag", "grant" and "mention", below.
FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": ("mit", ("mit licen[cs]e", "mit x11 licen[cs]e", "expat licen[cs]e")),
    "mit-0": ("mit 0", ("mit no attribution licen[cs]e?",)),
    "apache-1.1": ("apache 1 1", ("apache (?:software )?licen[cs]e (?:version|v)? v?1 1",)),
    "apache-2": ("apache 2 0", ("apache (?:software )?licen[cs]e (?:version|v)? v?2 0?", "apache v?2 0? licen[cs]e")),
    "bsd-2-clause": ("bsd 2 clause", ("bsd 2 clause licen[cs]e?", "(?:2|two) clause bsd licen[cs]e?", "simplified bsd licen[cs]e", "freebsd licen[cs]e")),
    "bsd-3-clause": ("bsd 3 clause", ("bsd 3 clause licen[cs]e?", "(?:3|three) clause bsd licen[cs]e?", "new bsd licen[cs]e", "modified bsd licen[cs]e")),
    "bsd-4-clause": ("bsd 4 clause", ("bsd 4 clause licen[cs]e?", "(?:4|four) clause bsd licen[cs]e?", "original bsd licen[cs]e")),
    "bsd": ("0bsd", ("bsd style licen[cs]e", "bsd licen[cs]e", "zero clause bsd licen[cs]e?")),
    "isc": ("isc", ("isc licen[cs]e", "internet systems consortium licen[cs]e")),
    "zlib": ("zlib", ("zlib licen[cs]e", "zlib libpng licen[cs]e")),
    "gpl": ("gpl", ("gnu general public licen[cs]e", "gnu gpl")),
    "gpl-1": ("gpl 1 0(?: only| or later)?", ("gnu general public licen[cs]e version v?1", "gnu gpl (?:version|v)? v?1", "gplv1")),
    "gpl-2": ("gpl 2 0(?: only| or later)?", ("gnu general public licen[cs]e version v?2", "gnu gpl (?:version|v)? v?2", "gplv2")),
    "gpl-3": ("gpl 3 0(?: only| or later)?", ("gnu general public licen[cs]e version v?3", "gnu gpl (?:version|v)? v?3", "gplv3")),
    "lgpl": ("lgpl", ("gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl")),
    "lgpl-2": ("lgpl 2 0(?: only| or later)?", ("gnu (?:lesser|library) general public licen[cs]e version v?2", "lgplv2")),
    "lgpl-2.1": ("lgpl 2 1(?: only| or later)?", ("gnu (?:lesser|library) general public licen[cs]e version v?2 1", "lgplv2 1")),
    "lgpl-3": ("lgpl 3 0(?: only| or later)?", ("gnu lesser general public licen[cs]e version v?3", "lgplv3")),
    "agpl": ("agpl", ("gnu affero general public licen[cs]e", "affero general public licen[cs]e", "gnu agpl")),
    "agpl-3": ("agpl 3 0(?: only| or later)?", ("gnu affero general public licen[cs]e version v?3", "agplv3")),
    "gfdl": ("gfdl 1 [0-9]", ("gnu free documentation licen[cs]e",)),
    "mpl-1.1": ("mpl 1 1", ("mozilla public licen[cs]e (?:version|v)? v?1 1",)),
    "mpl-2": ("mpl 2 0", ("mozilla public licen[cs]e (?:version|v)? v?2 0?",)),
    "epl-1": ("epl 1 0", ("eclipse public licen[cs]e (?:version|v)? v?1 0",)),
    "epl-2": ("epl 2 0", ("eclipse public licen[cs]e (?:version|v)? v?2 0",)),
    "cddl": ("cddl 1 [01]", ("common development and distribution licen[cs]e",)),
    "cpl-1": ("cpl 1 0", ("common public licen[cs]e (?:version|v)? v?1?",)),
    "eupl": ("eupl 1 [012]", ("european union public licen[cs]e",)),
    "artistic-1": ("artistic 1 0", ("artistic licen[cs]e (?:version|v)? v?1 0",)),
    "artistic-2": ("artistic 2 0", ("artistic licen[cs]e (?:version|v)? v?2 0",)),
    "unlicense": ("unlicense", ("the unlicense",)),
    "wtfpl": ("wtfpl", ("do what the fuck you want to public licen[cs]e",)),
    "cc0": ("cc0 1 0", ("cc0", "creative commons zero")),
    "cc-by": ("cc by [1-4] [05]", ("cc by", "creative commons attribution")),
    "cc-by-sa": ("cc by sa [1-4] [05]", ("cc by sa", "creative commons attribution share ?alike")),
    "cc-by-nd": ("cc by nd [1-4] [05]", ("cc by nd", "creative commons attribution no ?deriv(?:s|atives|ative works)")),
    "cc-by-nc": ("cc by nc [1-4] [05]", ("cc by nc", "creative commons attribution non ?commercial")),
    "cc-by-nc-sa": ("cc by nc sa [1-4] [05]", ("cc by nc sa", "creative commons attribution non ?commercial share ?alike")),
    "cc-by-nc-nd": ("cc by nc nd [1-4] [05]", ("cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)")),
    "public-domain": ("public domain", ("public domain",)),
    "odbl-1": ("odbl 1 0", ("open database licen[cs]e",)),
    "odc-by": ("odc by 1 0", ("open data commons attribution licen[cs]e",)),
    "pddl": ("pddl 1 0", ("open data commons public domain dedication and? licen[cs]e?",)),
    "boost-1": ("bsl 1 0", ("boost software licen[cs]e",)),
    "busl-1.1": ("busl 1 1", ("business source licen[cs]e",)),
    "sspl-1": ("sspl 1 0", ("server side public licen[cs]e",)),
    "elastic-2": ("elastic 2 0", ("elastic licen[cs]e 2?",)),
    "psf-2": ("psf 2 0", ("python software foundation licen[cs]e",)),
    "php-3": ("php 3 0?1?", ("php licen[cs]e (?:version|v)? v?3",)),
    "ruby": ("ruby", ("ruby licen[cs]e",)),
    "postgresql": ("postgresql", ("postgresql licen[cs]e",)),
    "openssl": ("openssl", ("openssl licen[cs]e",)),
    "ofl-1.1": ("ofl 1 1", ("sil open font licen[cs]e",)),
    "ncsa": ("ncsa", ("university of illinois open source licen[cs]e", "ncsa open source licen[cs]e")),
    "ms-pl": ("ms pl", ("microsoft public licen[cs]e",)),
    "ms-rl": ("ms rl", ("microsoft reciprocal licen[cs]e",)),
    "osl-3": ("osl 3 0", ("open software licen[cs]e (?:version|v)? v?3 0",)),
    "afl-3": ("afl 3 0", ("academic free licen[cs]e (?:version|v)? v?3 0",)),
    "upl-1": ("upl 1 0", ("universal permissive licen[cs]e",)),
    "json": ("json", ("json licen[cs]e",)),
    "vim": ("vim", ("vim licen[cs]e",)),
    "beerware": ("beerware", ("beer ?ware licen[cs]e",)),
    "openrail": ("openrail", ("open ?rail m? licen[cs]e", "responsible ai licen[cs]e")),
    "llama": ("llama 2", ("llama [23] community licen[cs]e",)),
}
#: Wordings of grants: before the name of a license.
GRANTS = ("(?:licen[cs]ed|released|distributed|available|published|provided) under the? terms? of? the?", "under the terms of the?", "subject to the terms of the?", "(?:covered|governed) by the?")
#: Sentences of license texts, headers and addresses, in words of their own: label, expression, priority. Fixed values.
#: The keyword of each is its longest plain word.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 60),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 58),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 55),
    ("mit", "opensource org licenses mit", 80),
    ("mit-0", "opensource org licenses mit 0", 82),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 60),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", 58),
    ("isc", "opensource org licenses isc", 80),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 50),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions", 50),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 50),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", 80),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software", 66),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", 80),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 68),
    ("apache-2", "you may not use this file except in compliance with the licen[cs]e", 62),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 62),
    ("apache-2", "apache org licenses licen[cs]e 2 0", 80),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 60),
    ("apache-2", "opensource org licenses apache 2 0", 80),
    ("gpl", "as published by the free software foundation either version", 40),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e", 45),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 45),
    ("gpl", "strong copyleft", 5),
    ("gpl-2", "either version 2 of the licen[cs]e or at your option any later version", 64),
    ("gpl-2", "gnu org licenses old licenses gpl 2 0", 80),
    ("gpl-3", "either version 3 of the licen[cs]e or at your option any later version", 64),
    ("gpl-3", "gnu org licenses gpl 3 0", 80),
    ("lgpl", "this library is free software you can redistribute it and or modify it", 50),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", 52),
    ("lgpl-2.1", "either version 2 1 of the licen[cs]e or at your option any later version", 66),
    ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1", 80),
    ("lgpl-3", "gnu org licenses lgpl 3 0", 80),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e", 54),
    ("agpl-3", "gnu org licenses agpl 3 0", 80),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 66),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e", 62),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 68),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", 66),
    ("mpl-2", "mozilla org mpl 2 0", 80),
    ("epl-1", "eclipse org legal epl v10", 80),
    ("epl-2", "eclipse org legal epl 2 0", 80),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2 0", 68),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 66),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 60),
    ("zlib", "the origin of this software must not be misrepresented", 60),
    ("zlib", "altered source versions must be plainly marked as such", 60),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 66),
    ("boost-1", "boost org license 1 0", 80),
    ("unlicense", "free and unencumbered software released into the public domain", 70),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 66),
    ("wtfpl", "do what the fuck you want to", 70),
    ("ofl-1.1", "this font software is licensed under the sil open font licen[cs]e", 66),
    ("ofl-1.1", "scripts sil org ofl", 80),
    ("ncsa", "neither the names of the university of illinois nor the names of its contributors", 66),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", 60),
    ("openssl", "this product includes software developed by the openssl project", 62),
    ("php-3", "this product includes php software freely available from", 62),
    ("vim", "the vim licen[cs]e applies to all files", 60),
    ("json", "the software shall be used for good not evil", 66),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 66),
    ("artistic-2", "perlfoundation org artistic licen[cs]e 2 0", 80),
    ("eupl", "licensed under the eupl", 60),
    ("cc0", "creativecommons org publicdomain zero 1 0", 80),
    ("cc0", "has waived all copyright and related or neighbou?ring rights", 62),
    ("cc-by", "creativecommons org licenses by [1-4] [05]", 80),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]", 82),
    ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]", 82),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]", 82),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]", 84),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]", 84),
    ("public-domain", "dedicated to the public domain", 55),
    ("public-domain", "placed in the public domain", 55),
    ("odbl-1", "opendatacommons org licenses odbl", 80),
    ("odc-by", "opendatacommons org licenses by", 80),
    ("pddl", "opendatacommons org licenses pddl", 80),
    ("llama", "use of the llama materials", 40),
    ("openrail", "use based restrictions as referenced in paragraph 5", 50),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", 30),
    ("research-only", "for (?:academic )?research (?:use|purposes) only", 30),
    ("evaluation-only", "for evaluation purposes only", 25),
    ("all-rights-reserved", "all rights reserved", 10),
    ("all-rights-reserved", "tous droits r[eé]serv[eé]s", 10),
    ("all-rights-reserved", "alle rechte vorbehalten", 10),
    ("all-rights-reserved", "todos los derechos reservados", 10),
    ("proprietary", "proprietary and confidential", 20),
    ("proprietary", "confidential and proprietary", 20),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|software) via any medium is strictly prohibited", 30),
    ("proprietary", "no part of this (?:publication|document|work) may be reproduced", 25),
)
#: Every rule's match holds one of these; texts without any are not looked at again.
ANCHORS = (
    " licen", "mit  no  attribution", " unlicense ", " spdx ", " cc ", " cc0 ", " gnu ", "gplv", " bsd ", "public  domain", "creative  commons", " permission  ", " redistribution", " unencumbered  ",
    "what  the  fuck", "rights  reserved", " copyleft ", " creativecommons  org ", " warrant", " names  of  its  contributors ", " advertising  materials ", " product  includes ", "free  software", " mpl ", " epl ",
    " damages  arising ", " misrepresented ", "  plainly  marked ", "  sell  or  distribute ", " scripts  sil  org ", "  good  not  evil ", "  beer  in  return ", " eupl ", " neighbo", " llama ", " restrictions  as ", "  purposes  only ",
    "  use  only ", " droits ", " vorbehalten ", " derechos ", " proprietary ", " prohibited ", " reproduced ",
)


def canonical_pattern(words: str) -> str:
    """A phrase of word expressions -> an expression over the canonical form."""
    out = ""
    depth_free = []
    for w in words.split(" "):  # blanks inside brackets belong to one alternative: join them again
        if depth_free and depth_free[-1].count("(") > depth_free[-1].count(")"):
            depth_free[-1] += "  " + w
        else:
            depth_free.append(w)
    i = 0
    while i < len(depth_free):
        w = depth_free[i]
        if i + 1 < len(depth_free) and depth_free[i + 1].startswith("?"):  # "share ?alike": one word or two
            out += f" {w}(?:  )?{depth_free[i + 1][1:]} "
            i += 1
        elif w.endswith(" )"):
            out += f" {w} "
        elif re_optional(w):
            out += f"(?: {w[:-1]} )?"
        else:
            out += f" {w} "
        i += 1
    return out


def re_optional(word: str) -> bool:
    return word.endswith("?") and not word.endswith((")?", "0?1?")) or re.fullmatch(r"\(\?:[^()]*\)\?", word) is not None


def keyword_of(words: str) -> str:
    """The longest plain word of a phrase, between blanks: part of every match. A word that the next one may be joined to
    ("share ?alike") has no blank after it."""
    all_ = words.split(" ")
    plain = [f" {w}" if after.startswith("?") else f" {w} " for w, after in zip(all_, [*all_[1:], ""], strict=True) if w.isalnum() and w.isascii()]
    return max(plain, key=len, default=" ")


def rules() -> list[Rule]:
    """All rules in order: the base, then tags, grants and mentions of each family, then notices."""
    out = [Rule(label, canonical_pattern(p), canonical_pattern(p), 100, 0.9, True) for p, label in BASE]
    for label, (tag, names) in FAMILIES.items():
        spdx = f"spdx license identifier {tag}"
        out.append(Rule(label, " spdx ", canonical_pattern(spdx), 95, 1.0, False))
        for name in names:
            more = 2 * len(name.split(" "))  # a more precise name stands above one that it contains
            out += [Rule(label, keyword_of(name), canonical_pattern(f"{g} {name}"), 60 + more, 0.95, False) for g in GRANTS[:1]]
            out.append(Rule(label, keyword_of(name), canonical_pattern(name), 30 + more, 0.7, False))
        out.append(Rule(label, keyword_of(names[0]), "(?:" + "|".join(canonical_pattern(g) for g in GRANTS[1:]) + ")" + canonical_pattern(names[0]), 62 + 2 * len(names[0].split(" ")), 0.9, False))
    out += [Rule(label, keyword_of(p), canonical_pattern(p), pr, 0.8 if pr >= 50 else 0.3, False) for label, p, pr in NOTICES]
    return out


#: Sorts by place, the longer first, then the one that outranks: less, rank are the negatives of stop and priority.
DETECTIONS = "array<struct<start:int,less:int,rank:int,ord:int,confidence:double,base:boolean,label:string>>"
#: Elements that running() handles at a time; distances that settled() tries as bounds.
CHUNK, REACH = 256, (16, 64, 256, 1024)


def canonical(text: Column) -> Column:
    """lower() maps no character to or from an ASCII separator, and of the letters a-z only the Kelvin sign's and
    the dotted I's images hold one; neither occurs in a base phrase's word (k; i with a combining dot after it)."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, "  ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def detections(s: Column, which: list[Rule]) -> Column:
    """Canonical text -> all detections of the rules whose keyword it holds, by rule; start and stop in words."""
    table = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base"), F.lit(r.label).alias("label")) for i, r in enumerate(which)))
    words = lambda x: F.floor((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("int")

    def places(r: Column) -> Column:
        gaps, hits = F.split(s, r["pattern"], -1), F.regexp_extract_all(s, r["pattern"], F.lit(0))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(words(g).alias("gap"), words(h).alias("long")))
        one = lambda at, x: F.struct((at + x["gap"]).alias("start"), (-at - x["gap"] - x["long"]).alias("less"), (-r["priority"]).alias("rank"), r["ord"], r["confidence"], r["base"], r["label"])
        return let(steps, lambda x: running(x, one))

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(s, r["keyword"])), places))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once, however often body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column, one: Callable[[Column, Column], Column]) -> Column:
    """one(words before the step, step) for each step (gap, long), in time about linear in their number: totals of
    chunks first, then each chunk from where it starts."""
    none = F.array().cast("array<int>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))
    total = lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["long"])
    add = lambda a, p: F.struct((a["at"] + total(p)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
    starts = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("at"), none.alias("all")), add, lambda a: a["all"])
    empty = F.array().cast(DETECTIONS)
    step = lambda a, x: F.struct((a["at"] + x["gap"] + x["long"]).alias("at"), F.concat(a["found"], F.array(one(a["at"], x))).alias("found"))
    within = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), empty.alias("found")), step, lambda a: a["found"])
    return F.when(F.size(steps) > 0, let(parts, lambda ps: F.flatten(F.zip_with(ps, starts(ps), within)))).otherwise(empty)


def settled(found: Column, longest: int) -> Column:
    """The detections that no other one contains and outranks. found is sorted, so one that does comes before; and as none
    is longer than longest words, it is at most as many places back as there are detections within that reach."""
    n = F.size(found)
    near = lambda k: F.forall(F.sequence(F.lit(k), n - 1), lambda i: F.get(found, i)["start"] - F.get(found, i - k)["start"] >= longest)
    reach = n
    for k in reversed(REACH):
        reach = F.when((n <= k) | near(k), F.lit(k)).otherwise(reach)

    def outranked(d: Column, e: Column) -> Column:
        return (e["start"] <= d["start"]) & (e["less"] <= d["less"]) & ((e["rank"] < d["rank"]) | ((e["rank"] == d["rank"]) & ((e["start"] < d["start"]) | (e["less"] < d["less"]) | (e["ord"] < d["ord"]))))

    back = lambda i, k: F.slice(found, F.greatest(i + 1 - k, F.lit(1)), F.least(i, k))
    return let(reach, lambda k: F.filter(found, lambda d, i: d["base"] | ~F.exists(back(i, k), lambda e: outranked(d, e))))


def scan(docs: DataFrame, text: str = "text", which: list[Rule] | None = None) -> DataFrame:
    """docs -> their columns and n_words, detections (those kept, by place), n_base, base_labels, labels, score."""
    s = F.col("__canonical")
    held = F.lit(False)
    for a in ANCHORS:
        held = held | F.contains(s, F.lit(a))
    df = docs.withColumn("__canonical", canonical(F.col(text)))
    n = F.when(s == "  ", 0).otherwise(F.octet_length(s) - F.octet_length(F.replace(s, F.lit("  "), F.lit(" "))) + 1)
    rules_ = which or rules()
    longest = max(r.pattern.count(" ") for r in rules_) // 2  # a pattern has no unbounded repetition
    df = df.withColumn("n_words", n.cast("long")).withColumn("__all", F.when(held, detections(s, rules_)).otherwise(F.array().cast(DETECTIONS)))
    df = df.withColumn("__all", F.array_sort("__all")).withColumn("__all", settled(F.col("__all"), longest))
    df = df.withColumn("detections", F.transform("__all", lambda d: F.struct(d["start"].alias("start"), (-d["less"]).alias("stop"), d["label"], d["confidence"], d["base"]))).drop("__canonical", "__all")
    base = F.filter("detections", lambda d: d["base"])
    names = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    df = df.withColumn("__base", base)
    return (
        df.withColumn("n_base", F.size("__base").cast("long"))
        .withColumn("first_word", F.array_min(F.transform("__base", lambda d: d["start"])).cast("long"))
        .withColumn("last_word", F.array_max(F.transform("__base", lambda d: d["start"])).cast("long"))
        .withColumn("base_labels", names(F.col("__base")))
        .withColumn("labels", names(F.col("detections")))
        .withColumn("score", F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)))
        .drop("__base")
    )
