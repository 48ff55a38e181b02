"""License scans with ordered signature rules.

A text is lower-cased (A-Z) and read as words of digits, letters and characters outside
ASCII, one space apart.  A rule has a label, a priority, a keyword that any match must
contain, and a pattern over that word sequence.  Texts without any keyword are never
joined or matched, and a rule runs only where its keyword occurs.  Detections are ordered
by priority, then length; one whose words lie within those of an earlier detection is
suppressed, so "gnu lesser general public license version 2 1" is one LGPL detection and
not also a GPL one.  Base phrases are reported apart and are never suppressed.

Edge cases: a null text is empty; an empty text has no words and no labels (empty
strings) and score 0; repeated rows give equal results; other columns are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import MARKS, split_words, table, text_slices
from albumflow.llm.shared import arrow_schema

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Priorities: a license's own grant text or SPDX tag, its full name with a version, its
# name, and loose mentions.
TEXT, VERSIONED, NAMED, LOOSE = 90, 80, 60, 30


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern[str]


_V = r"(?: version| v| ver)?(?: )?v?"
_LIC = r"licen[cs]es?"

# Families with versions: label, name pattern, keyword, versions.
FAMILIES = [
    ("gpl", rf"(?:gnu )?general public {_LIC}", "general public", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("gpl", r"gpl", "gpl", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("lgpl", rf"(?:gnu )?(?:lesser|library) general public {_LIC}", "general public", ["2 0", "2 1", "3 0", "2", "3"]),
    ("lgpl", r"lgpl", "lgpl", ["2 0", "2 1", "3 0", "2", "3"]),
    ("agpl", rf"(?:gnu )?affero general public {_LIC}", "affero", ["1 0", "3 0", "1", "3"]),
    ("agpl", r"agpl", "agpl", ["1 0", "3 0", "1", "3"]),
    ("gfdl", rf"(?:gnu )?free documentation {_LIC}", "free documentation", ["1 1", "1 2", "1 3"]),
    ("apache", rf"apache(?: software)? {_LIC}", "apache", ["1 0", "1 1", "2 0", "2"]),
    ("apache", r"apache", "apache", ["1 0", "1 1", "2 0"]),
    ("mpl", rf"mozilla public {_LIC}", "mozilla", ["1 0", "1 1", "2 0"]),
    ("mpl", r"mpl", "mpl", ["1 0", "1 1", "2 0"]),
    ("epl", rf"eclipse public {_LIC}", "eclipse", ["1 0", "2 0"]),
    ("epl", r"epl", "epl", ["1 0", "2 0"]),
    ("cddl", rf"common development and distribution {_LIC}", "common development", ["1 0", "1 1"]),
    ("cddl", r"cddl", "cddl", ["1 0", "1 1"]),
    ("cpl", rf"common public {_LIC}", "common public", ["1 0"]),
    ("artistic", rf"artistic {_LIC}", "artistic", ["1 0", "2 0"]),
    ("afl", rf"academic free {_LIC}", "academic free", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("osl", rf"open software {_LIC}", "open software", ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("eupl", rf"european union public {_LIC}", "european union", ["1 0", "1 1", "1 2"]),
    ("eupl", r"eupl", "eupl", ["1 0", "1 1", "1 2"]),
    ("ofl", rf"(?:sil )?open font {_LIC}", "open font", ["1 0", "1 1"]),
    ("php", rf"php {_LIC}", "php", ["3 0", "3 01"]),
    ("zpl", rf"zope public {_LIC}", "zope", ["1 1", "2 0", "2 1"]),
    ("lppl", rf"latex project public {_LIC}", "latex", ["1 0", "1 1", "1 2", "1 3", "1 3c"]),
    ("bsl", rf"boost software {_LIC}", "boost", ["1 0"]),
    ("busl", rf"business source {_LIC}", "business source", ["1 0", "1 1"]),
    ("sspl", rf"server side public {_LIC}", "server side", ["1"]),
    ("elastic", rf"elastic {_LIC}", "elastic", ["1 0", "2 0"]),
    ("psf", rf"(?:python software foundation|psf) {_LIC}", "python software", ["2", "2 0"]),
    ("apsl", rf"apple public source {_LIC}", "apple", ["1 0", "1 1", "1 2", "2 0"]),
    ("npl", rf"netscape public {_LIC}", "netscape", ["1 0", "1 1"]),
    ("qpl", rf"q public {_LIC}", "q public", ["1 0"]),
    ("rpl", rf"reciprocal public {_LIC}", "reciprocal", ["1 1", "1 5"]),
    ("spl", rf"sun public {_LIC}", "sun public", ["1 0"]),
    ("ipl", rf"ibm public {_LIC}", "ibm public", ["1 0"]),
    ("upl", rf"universal permissive {_LIC}", "universal permissive", ["1 0"]),
    ("mulan", rf"mulan (?:permissive software|psl) ?(?:{_LIC})?", "mulan", ["1", "2"]),
    ("cecill", rf"cecill(?: free software)?(?: {_LIC}(?: agreement)?)?", "cecill", ["1 0", "1 1", "2 0", "2 1"]),
    ("odc-by", rf"open data commons attribution {_LIC}", "open data commons", ["1 0"]),
    ("odbl", rf"open (?:data commons open )?database {_LIC}", "database", ["1 0"]),
    ("cpal", rf"common public attribution {_LIC}", "common public attribution", ["1 0"]),
    ("watcom", rf"sybase open watcom public {_LIC}", "watcom", ["1 0"]),
    ("oclc", rf"oclc research public {_LIC}", "oclc", ["2 0"]),
    ("ecl", rf"educational community {_LIC}", "educational community", ["1 0", "2 0"]),
    ("efl", rf"eiffel forum {_LIC}", "eiffel", ["1", "2"]),
    ("lpl", rf"lucent public {_LIC}", "lucent", ["1 0", "1 02"]),
    ("nasa", rf"nasa open source agreement", "nasa", ["1 3"]),
    ("cern-ohl", rf"cern open hardware {_LIC}", "cern", ["1 1", "1 2", "2"]),
    ("openldap", rf"openldap public {_LIC}", "openldap", ["2 7", "2 8"]),
    ("parity", rf"parity public {_LIC}", "parity", ["6 0", "7 0"]),
    ("hippocratic", rf"hippocratic {_LIC}", "hippocratic", ["1 1", "2 1", "3 0"]),
    ("prosperity", rf"prosperity public {_LIC}", "prosperity", ["3 0"]),
    ("rail", rf"responsible ai {_LIC}", "responsible ai", ["1 0"]),
    ("llama", rf"llama \d(?: \d)? community {_LIC}(?: agreement)?", "community", ["1"]),
]

CREATIVE_COMMONS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CREATIVE_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
CREATIVE_NAMES = {
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
    "by nc": "attribution non ?commercial",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s?",
    "by": "attribution",
}

# Single licenses: label, priority, keyword, pattern.
SINGLE = [
    ("mit", TEXT, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-0", NAMED, "mit no attribution", rf"mit no attribution(?: {_LIC})?"),
    ("mit", NAMED, "mit", rf"(?:the )?mit {_LIC}"),
    ("mit", NAMED, "mit", r"mit licen[cs]ed"),
    ("mit", LOOSE, "mit", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit"),
    ("x11", NAMED, "x11", rf"(?:mit )?x11 {_LIC}"),
    ("expat", NAMED, "expat", rf"expat {_LIC}"),
    ("bsd", TEXT, "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", VERSIONED, "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd licen[cs]e)"),
    ("bsd-3-clause", VERSIONED, "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-3-clause", TEXT, "neither the name", r"neither the name of \w+(?: \w+){0,12} nor the names of (?:its|their) contributors may be used to endorse"),
    ("bsd-4-clause", VERSIONED, "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)"),
    ("bsd-4-clause", TEXT, "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("0bsd", VERSIONED, "bsd", r"(?:0bsd|zero clause bsd|bsd (?:0|zero) clause)"),
    ("bsd-protection", NAMED, "bsd protection", rf"bsd protection {_LIC}"),
    ("bsd", NAMED, "bsd", rf"bsd(?: style)? {_LIC}"),
    ("isc", TEXT, "permission to use copy modify", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", NAMED, "isc", rf"isc {_LIC}"),
    ("apache-2.0", TEXT, "apache", rf"licensed under the apache {_LIC} version 2 0(?: the {_LIC})?"),
    ("apache", NAMED, "apache", rf"(?:the )?apache(?: software)? {_LIC}"),
    ("apache", LOOSE, "apache", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache"),
    ("gpl", TEXT, "free software", r"this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", TEXT, "free software", r"this (?:library|program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", TEXT, "free software", r"this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", NAMED, "general public", rf"(?:gnu )?general public {_LIC}"),
    ("gpl", NAMED, "gpl", r"gnu gpl"),
    ("gpl", LOOSE, "gpl", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("lgpl", NAMED, "general public", rf"(?:gnu )?(?:lesser|library) general public {_LIC}"),
    ("agpl", NAMED, "affero", rf"(?:gnu )?affero general public {_LIC}"),
    ("gpl-classpath", TEXT, "exception", r"classpath exception|special exception the copyright holders of this library give you permission to link"),
    ("gpl-gcc-exception", NAMED, "exception", r"gcc runtime library exception"),
    ("llvm-exception", NAMED, "exception", r"llvm exceptions?"),
    ("mpl", NAMED, "mozilla", rf"mozilla public {_LIC}"),
    ("mpl", TEXT, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl", NAMED, "eclipse", rf"eclipse public {_LIC}"),
    ("cc0", NAMED, "cc0", rf"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", TEXT, "public domain dedication", r"creative commons(?: zero| cc0)?(?: \w+){0,4} public domain dedication"),
    ("cc", LOOSE, "creative commons", r"creative commons(?: \w+){0,3} licen[cs]e"),
    ("unlicense", TEXT, "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", NAMED, "unlicense", r"(?:the )?unlicense"),
    ("public-domain", NAMED, "public domain", r"(?:dedicated to|released (?:in)?to|placed in(?:to)?|in) the public domain"),
    ("wtfpl", NAMED, "wtfpl", r"wtfpl"),
    ("wtfpl", TEXT, "you want to public", rf"do what the \w+ you want to public {_LIC}"),
    ("beerware", NAMED, "beer", rf"beer ?ware(?: {_LIC})?"),
    ("zlib", TEXT, "implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", NAMED, "zlib", rf"zlib(?: libpng)? {_LIC}"),
    ("libpng", NAMED, "libpng", rf"libpng {_LIC}"),
    ("ncsa", NAMED, "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {_LIC}"),
    ("postgresql", NAMED, "postgresql", rf"postgresql {_LIC}"),
    ("python", NAMED, "python", rf"python {_LIC}"),
    ("ruby", NAMED, "ruby", rf"ruby {_LIC}"),
    ("perl", TEXT, "perl", r"same terms as perl(?: \d)?(?: itself)?"),
    ("vim", NAMED, "vim", rf"vim {_LIC}"),
    ("curl", NAMED, "curl", rf"curl {_LIC}"),
    ("openssl", NAMED, "openssl", rf"openssl {_LIC}"),
    ("ssleay", NAMED, "ssleay", rf"ssleay {_LIC}"),
    ("json", TEXT, "for good not evil", r"the software shall be used for good not evil"),
    ("fair", NAMED, "fair", rf"fair {_LIC}"),
    ("hpnd", NAMED, "historical permission", rf"historical permission notice and disclaimer"),
    ("icu", NAMED, "icu", rf"icu {_LIC}"),
    ("unicode", NAMED, "unicode", rf"unicode(?: dfs 201[56])? {_LIC}(?: agreement)?"),
    ("ntp", NAMED, "ntp", rf"ntp {_LIC}"),
    ("tcl", NAMED, "tcl", rf"tcl(?: tk)? {_LIC}"),
    ("w3c", NAMED, "w3c", rf"w3c(?: software)?(?: notice and)? {_LIC}"),
    ("sleepycat", NAMED, "sleepycat", rf"sleepycat {_LIC}"),
    ("intel", NAMED, "intel", rf"intel open source {_LIC}"),
    ("nokia", NAMED, "nokia", rf"nokia open source {_LIC}"),
    ("ms-pl", NAMED, "microsoft", rf"microsoft public {_LIC}"),
    ("ms-rl", NAMED, "microsoft", rf"microsoft reciprocal {_LIC}"),
    ("commons-clause", NAMED, "commons clause", r"commons clause(?: license condition)?"),
    ("polyform-noncommercial", NAMED, "polyform", r"polyform non ?commercial"),
    ("polyform-small-business", NAMED, "polyform", r"polyform small business"),
    ("polyform-shield", NAMED, "polyform", r"polyform shield"),
    ("polyform-strict", NAMED, "polyform", r"polyform strict"),
    ("pddl", NAMED, "public domain dedication", rf"(?:open data commons )?public domain dedication and {_LIC}"),
    ("ogl", NAMED, "open government", rf"open government {_LIC}(?: v?[123](?: 0)?)?"),
    ("nlod", NAMED, "open government data", rf"norwegian {_LIC} for open government data"),
    ("etalab", NAMED, "etalab", r"(?:licence ouverte|open licence) etalab|etalab (?:2 0|open licence)"),
    ("dl-de", NAMED, "datenlizenz", r"datenlizenz deutschland(?: namensnennung| zero)?"),
    ("free-art", NAMED, "free art", rf"free art {_LIC}"),
    ("free-art", NAMED, "art libre", r"licence art libre"),
    ("design-science", NAMED, "design science", rf"design science {_LIC}"),
    ("gust", NAMED, "gust font", rf"gust font {_LIC}"),
    ("bitstream-vera", NAMED, "bitstream vera", r"bitstream vera(?: fonts)? copyright"),
    ("bigscience-rail", NAMED, "bigscience", r"bigscience (?:open )?rail(?: m)?"),
    ("openrail", NAMED, "openrail", r"(?:creative ml )?openrail(?: m)?"),
    ("gemma", NAMED, "gemma", r"gemma terms of use"),
    ("proprietary", LOOSE, "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("all-rights-reserved", LOOSE, "rights reserved", r"all rights reserved"),
    ("copyright", LOOSE, "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("warranty-disclaimer", LOOSE, "warrant", r"(?:provided|distributed) (?:on an )?as is (?:basis )?without (?:any )?warrant(?:y|ies)"),
    ("spdx", LOOSE, "spdx", r"spdx license identifier"),
]

# SPDX tags: the name after "spdx license identifier", as words.
SPDX = ["mit", "isc", "zlib", "unlicense", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "mpl 2 0", "epl 2 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "bsl 1 0", "artistic 2 0", "ofl 1 1", "0bsd", "wtfpl", "ncsa", "postgresql", "upl 1 0"]


def _dashed(name: str, version: str = "") -> str:
    number = version.replace(" ", ".")
    return "-".join(x for x in (name.replace(" ", "-"), number if "." in number or not number else f"{number}.0") if x)


def build_rules() -> list[Rule]:
    """All rules: the single ones, and those that families and versions span."""
    rows = list(SINGLE)
    for label, name, keyword, versions in FAMILIES:
        for v in versions:
            number = rf"{name}{_V} ?{v}(?! \d)"
            rows.append((_dashed(label, v), VERSIONED, keyword, number))
            if label in ("gpl", "lgpl", "agpl"):
                rows.append((_dashed(label, v) + "-or-later", VERSIONED + 2, keyword, rf"{number}(?: of the license)? (?:or (?:at your option )?(?:any )?later|plus)"))
                rows.append((_dashed(label, v) + "-only", VERSIONED + 1, keyword, rf"{number} only"))
    for kind in CREATIVE_COMMONS:
        short, long = f"cc {kind}", CREATIVE_NAMES[kind]
        rows.append((_dashed(short), NAMED, short, rf"{short}(?! (?:sa|nc|nd))"))
        for v in CREATIVE_VERSIONS:
            rows.append((_dashed(short, v), VERSIONED, short, rf"{short} {v}"))
            rows.append((_dashed(short, v), VERSIONED, "creative commons", rf"creative commons {long} {v}"))
    for name in SPDX:
        label = re.sub(r"(\d+) (\d+)$", r"\1.\2", name).replace(" ", "-")
        rows.append((label, TEXT + 5, "spdx", rf"spdx license identifier {name}(?! \d)"))
    return [Rule(label, priority, keyword, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")) for label, priority, keyword, pattern in rows]


RULES = build_rules()
_BASE = [(re.compile(rf"(?<![^ ]){phrase}(?![^ ])"), label) for phrase, label in BASE.items()]
#: One word of every rule's keyword and base phrase; a text without any is not looked at.
_GATES = sorted({max(r.keyword.split(), key=len).encode() for r in RULES} | {b"license"})


class Detection(NamedTuple):
    start: int  # words, half open
    end: int
    priority: int
    label: str


class _Words:
    """Number of the word that begins at a place of a text whose words are one space apart."""

    def __init__(self, text: str):
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
        self._starts = np.append(0, blanks + 1)

    def __call__(self, places: list[int]) -> list[int]:
        return np.searchsorted(self._starts, places, side="right").tolist()


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections that lie in none of higher rank: by priority, then length, then place and label.

    A tree over starts holds the farthest end of what is kept, so that each detection asks once whether
    any that begins no later ends no earlier.
    """
    starts = sorted({d.start for d in found})
    slot = {s: i + 1 for i, s in enumerate(starts)}
    farthest = [-1] * (len(starts) + 1)
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        at, end = slot[d.start], -1
        while at > 0:
            end = max(end, farthest[at])
            at &= at - 1
        if end >= d.end:
            continue
        kept.append(d)
        at = slot[d.start]
        while at < len(farthest):
            farthest[at] = max(farthest[at], d.end)
            at += at & -at
    return sorted(kept)


def detect(text: str, rules: list[Rule] = RULES) -> list[Detection]:
    """Detections in a word sequence, after priority and containment suppression."""
    hits = [(m.start(), m.group().count(" ") + 1, rule) for rule in rules if rule.keyword in text for m in rule.pattern.finditer(text)]
    if not hits:
        return []
    words = _Words(text)([at for at, *_ in hits])
    return suppress([Detection(word - 1, word - 1 + size, rule.priority, rule.label) for word, (_, size, rule) in zip(words, hits, strict=True)])


def base_places(text: str) -> list[tuple[int, str]]:
    """First word and label of every base phrase."""
    hits = [(m.start(), label) for pattern, label in _BASE for m in pattern.finditer(text)]
    words = _Words(text)([at for at, _ in hits]) if hits else []
    return sorted((word - 1, label) for word, (_, label) in zip(words, hits, strict=True))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    ddl = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string,"
        " score double, detections array<struct<start:int,end:int,priority:int,label:string>>"
    )
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for texts in text_slices(pc.ascii_lower(pc.fill_null(batch.column(1), ""))):
                words = split_words(texts, MARKS)
                out = []
                data = texts.data.tobytes()
                for i in range(texts.count):
                    raw = data[texts.bounds[i] : texts.bounds[i + 1]]
                    base, found = [], []
                    if any(g in raw for g in _GATES):
                        own = range(words.bounds[i], words.bounds[i + 1])
                        text = b" ".join([data[words.start[k] : words.end[k]] for k in own]).decode()
                        base, found = base_places(text), detect(text)
                    labels = sorted({label for _, label in base})
                    every = sorted({*labels, *(d.label for d in found)})
                    miss = np.prod([1 - d.priority / 100 for d in found] + [0.4] * len(base))
                    at = [k for k, _ in base]
                    detections = [d._asdict() for d in found]
                    out.append((len(base), min(at, default=None), max(at, default=None), ",".join(labels), ",".join(every), float(1 - miss), detections))
                part = slice(texts.first, texts.first + texts.count)
                yield table(schema, batch.column(0)[part], np.diff(words.bounds), *zip(*out, strict=True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
