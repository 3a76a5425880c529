"""License scans: ordered signature rules over whole texts.

Each rule is a regular expression with a keyword, one word that every match
contains and that must occur before the expression is tried, a label, a priority and a confidence.  Of overlapping
detections, one that lies within another of better (or equal) priority goes.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import byte_chunks, text_bytes, word_starts
from .common import table

_SEP = rb"[^a-z0-9\x80-\xff]+"
_GAP = rb"[^a-z0-9\x80-\xff]*"
_HEAD, _TAIL = rb"(?<![a-z0-9\x80-\xff])", rb"(?![a-z0-9\x80-\xff])"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: bytes
    pattern: str


def compiled(rule: Rule) -> re.Pattern[bytes]:
    """A space stands for what may separate words, ``~`` for an optional separator."""
    body = rule.pattern.encode().replace(b" ", _SEP).replace(b"~", _GAP)
    return re.compile(_HEAD + b"(?:" + body + b")" + _TAIL, re.DOTALL)


#: The contract's phrases, as words.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, keyword, name (a pattern), versions.
_NAMES = [
    ("gpl", b"gnu", "gnu~(?:gpl|general public licen[cs]e)", ["1", "2", "3"]),
    ("gpl", b"gpl", "gpl", ["1", "2", "3"]),
    ("lgpl", b"lesser", "(?:gnu )?lesser general public licen[cs]e", ["2.1", "3"]),
    ("lgpl", b"library", "(?:gnu )?library general public licen[cs]e", ["2"]),
    ("lgpl", b"lgpl", "lgpl", ["2", "2.1", "3"]),
    ("agpl", b"affero", "(?:gnu )?affero general public licen[cs]e", ["1", "3"]),
    ("agpl", b"agpl", "agpl", ["1", "3"]),
    ("gfdl", b"documentation", "(?:gnu )?free documentation licen[cs]e", ["1.1", "1.2", "1.3"]),
    ("apache", b"apache", "apache(?: software)?(?: licen[cs]e)", ["1.0", "1.1", "2.0"]),
    ("mit", b"mit", "mit licen[cs]e", []),
    ("mit", b"expat", "expat licen[cs]e", []),
    ("x11", b"x11", "x11 licen[cs]e", []),
    ("bsd", b"bsd", "bsd licen[cs]e", []),
    ("bsd-2-clause", b"bsd", "(?:simplified bsd|bsd~2~clause|2~clause bsd|two clause bsd|freebsd)(?: licen[cs]e)", []),
    ("bsd-3-clause", b"bsd", "(?:new bsd|modified bsd|revised bsd|bsd~3~clause|3~clause bsd|three clause bsd)(?: licen[cs]e)", []),
    ("bsd-4-clause", b"bsd", "(?:original bsd|bsd~4~clause|4~clause bsd|four clause bsd)(?: licen[cs]e)", []),
    ("0bsd", b"bsd", "(?:zero clause bsd|0bsd|bsd~zero~clause)(?: licen[cs]e)", []),
    ("isc", b"isc", "isc licen[cs]e", []),
    ("mpl", b"mozilla", "mozilla public licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("mpl", b"mpl", "mpl", ["1.0", "1.1", "2.0"]),
    ("epl", b"eclipse", "eclipse public licen[cs]e", ["1.0", "2.0"]),
    ("edl", b"eclipse", "eclipse distribution licen[cs]e", ["1.0"]),
    ("cddl", b"development", "common development and distribution licen[cs]e", ["1.0", "1.1"]),
    ("cddl", b"cddl", "cddl", ["1.0", "1.1"]),
    ("cpl", b"common", "common public licen[cs]e", ["1.0"]),
    ("ipl", b"ibm", "ibm public licen[cs]e", ["1.0"]),
    ("eupl", b"european", "european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
    ("eupl", b"eupl", "eupl", ["1.1", "1.2"]),
    ("cecill", b"cecill", "cecill", ["1.0", "2.0", "2.1"]),
    ("cecill-b", b"cecill", "cecill b", []),
    ("cecill-c", b"cecill", "cecill c", []),
    ("artistic", b"artistic", "artistic licen[cs]e", ["1.0", "2.0"]),
    ("perl", b"perl", "same terms as perl itself", []),
    ("psf", b"python", "python software foundation licen[cs]e", ["2"]),
    ("ruby", b"ruby", "ruby licen[cs]e", []),
    ("php", b"php", "php licen[cs]e", ["3.0", "3.01"]),
    ("zlib", b"zlib", "zlib licen[cs]e", []),
    ("libpng", b"libpng", "libpng licen[cs]e", ["2.0"]),
    ("boost", b"boost", "boost software licen[cs]e", ["1.0"]),
    ("wtfpl", b"wtfpl", "wtfpl", ["1", "2"]),
    ("unlicense", b"unlicense", "(?:the )?unlicense", []),
    ("openssl", b"openssl", "openssl licen[cs]e", []),
    ("openldap", b"openldap", "openldap public licen[cs]e", ["2.8"]),
    ("postgresql", b"postgresql", "postgresql licen[cs]e", []),
    ("ms-pl", b"microsoft", "microsoft public licen[cs]e", []),
    ("ms-rl", b"microsoft", "microsoft reciprocal licen[cs]e", []),
    ("osl", b"open", "open software licen[cs]e", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", b"academic", "academic free licen[cs]e", ["1.2", "2.0", "2.1", "3.0"]),
    ("ofl", b"font", "(?:sil )?open font licen[cs]e", ["1.0", "1.1"]),
    ("odbl", b"database", "open database licen[cs]e", ["1.0"]),
    ("odc-by", b"commons", "open data commons attribution licen[cs]e", ["1.0"]),
    ("pddl", b"dedication", "public domain dedication and licen[cs]e", ["1.0"]),
    ("cdla", b"community", "community data licen[cs]e agreement", ["1.0", "2.0"]),
    ("upl", b"permissive", "universal permissive licen[cs]e", ["1.0"]),
    ("ncsa", b"ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", []),
    ("w3c", b"w3c", "w3c software(?: notice and)? licen[cs]e", []),
    ("vim", b"vim", "vim licen[cs]e", []),
    ("qpl", b"public", "q public licen[cs]e", ["1.0"]),
    ("sleepycat", b"sleepycat", "sleepycat licen[cs]e", []),
    ("bsl", b"business", "business source licen[cs]e", ["1.0", "1.1"]),
    ("sspl", b"server", "server side public licen[cs]e", ["1"]),
    ("elastic", b"elastic", "elastic licen[cs]e", ["1.0", "2.0"]),
    ("commons-clause", b"clause", "commons clause(?: licen[cs]e condition)?", ["1.0"]),
    ("openrail", b"rail", "(?:creativeml )?open~rail(?:~m)?", []),
    ("json", b"json", "json licen[cs]e", []),
    ("beerware", b"beer", "beer~ware(?: licen[cs]e)?", []),
    ("mulan", b"mulan", "mulan (?:psl|permissive software licen[cs]e)", ["1", "2"]),
    ("blueoak", b"oak", "blue oak model licen[cs]e", ["1.0.0"]),
    ("hpnd", b"historical", "historical permission notice and disclaimer", []),
    ("ogl", b"government", "open government licen[cs]e", ["1.0", "2.0", "3.0"]),
]
#: Creative Commons: label, how its elements are written.
_CC = [
    ("cc-by-nc-nd", "(?:by nc nd|attribution non~commercial no~deriv(?:ative)?s?)"),
    ("cc-by-nc-sa", "(?:by nc sa|attribution non~commercial share~alike)"),
    ("cc-by-nc", "(?:by nc|attribution non~commercial)"),
    ("cc-by-nd", "(?:by nd|attribution no~deriv(?:ative)?s?)"),
    ("cc-by-sa", "(?:by sa|attribution share~alike)"),
    ("cc-by", "(?:by|attribution)"),
]
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Sentences of the licences themselves and of notices: label, keyword, pattern.
_BODIES = [
    ("mit", b"hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", b"permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", b"redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", b"endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", b"advertising", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", b"redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", b"redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"),
    ("apache", b"apache", "licensed under the apache licen[cs]e version 2~0"),
    ("apache", b"compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("mpl", b"mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", b"liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", b"unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", b"fuck", "do what the fuck you want to public licen[cs]e"),
    ("boost", b"boost", "distributed under the boost software licen[cs]e"),
    ("public-domain", b"domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", b"domain", "this (?:work|text|document|file) is in the public domain"),
    ("all-rights-reserved", b"reserved", "all rights reserved"),
    ("proprietary", b"proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", b"unauthorized", "unauthorized (?:copying|reproduction|distribution) .{0,60}?is (?:strictly )?prohibited"),
    ("copyright", b"copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("generic", b"licensed", "licensed under(?: the)?"),
]


def _rules() -> list[Rule]:
    """The table: for each name an SPDX tag, a grant, each version, and the bare name, best first."""
    rules = []
    for label, keyword, name in [(x, k, n) for x, k, n, _ in _NAMES] + [(x, b"cc", f"cc~{n}") for x, n in _CC] + [(x, b"creative", f"creative commons {n}") for x, n in _CC]:
        versions = next((v for x, k, n, v in _NAMES if (x, k, n) == (label, keyword, name)), _CC_VERSIONS if label.startswith("cc") else [])
        for v in versions:
            number = v.replace(".", "~").replace("~0", "(?:~0)?")
            rules.append(Rule(f"{label}-{v}", 2, 0.97, keyword, f"{name}(?: v(?:ersion)?| ver)?~{number}(?: or(?: any)? later(?: version)?)?"))
        rules.append(Rule(label, 3, 0.95, keyword, f"(?:licen[cs]ed|released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)? {name}"))
        rules.append(Rule(label, 4, 0.85, keyword, name))
    tags = {x for x, *_ in _NAMES} | {x for x, _ in _CC} | {"cc0"}
    for label in sorted(tags):
        rules.append(Rule(label, 0, 1.0, b"spdx", f"spdx licen[cs]e identifier {label.replace('-', '~')}[0-9a-z.+\\-]*"))
    for label, _ in _CC:
        rules.append(Rule(label, 1, 0.99, b"creativecommons", f"creativecommons org licen[cs]es {label[3:].replace('-', '~')}(?: [0-9.]+)?"))
    rules += [
        Rule("cc0", 1, 0.99, b"creativecommons", "creativecommons org publicdomain zero(?: 1~0)?"),
        Rule("cc0", 2, 0.97, b"cc0", "cc0(?: 1~0)?(?: universal)?"),
        Rule("cc0", 2, 0.97, b"cc", "cc zero"),
        Rule("apache-2.0", 1, 0.99, b"apache", "apache org licen[cs]es licen[cs]e 2~0"),
        Rule("gpl", 1, 0.98, b"gnu", "gnu org (?:licen[cs]es|copyleft)(?: gpl)?"),
        Rule("mit", 1, 0.98, b"opensource", "opensource org licen[cs]es mit(?: license php)?"),
        Rule("bsd", 1, 0.98, b"opensource", "opensource org licen[cs]es bsd(?: [0-9] clause)?"),
        Rule("mpl-2.0", 1, 0.98, b"mozilla", "mozilla org mpl(?: 2~0)?"),
    ]
    rules += [Rule(label, 5 if label in ("generic", "copyright", "all-rights-reserved") else 3, 0.4 if label == "generic" else 0.6 if label in ("copyright", "all-rights-reserved") else 0.95, keyword, pattern) for label, keyword, pattern in _BODIES]
    return sorted(rules, key=lambda r: r.priority)


RULES = _rules()


class Scanner:
    """The rules by keyword, compiled when first needed."""

    def __init__(self, rules: list[Rule] = RULES):
        self.by_keyword: dict[bytes, list[tuple[Rule, list]]] = {}
        for r in rules:
            self.by_keyword.setdefault(r.keyword, []).append((r, []))
        self.base = [(label, phrase.split()[-2 if label == "gpl" else 0].encode(), re.compile(_HEAD + _SEP.join(map(str.encode, phrase.split())) + _TAIL)) for phrase, label in BASE.items()]

    def base_hits(self, low: bytes) -> list[tuple[str, int, int]]:
        return [(label, m.start(), m.end()) for label, keyword, p in self.base if keyword in low for m in p.finditer(low)]

    def detections(self, low: bytes) -> list[tuple[int, int, Rule]]:
        found = []
        for keyword, rules in self.by_keyword.items():
            if keyword not in low:
                continue
            for rule, pattern in rules:
                if not pattern:
                    pattern.append(compiled(rule))
                found += [(m.start(), m.end(), rule) for m in pattern[0].finditer(low)]
        found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label))
        kept: list[tuple[int, int, Rule]] = []
        starts, ends = [], []  # of kept detections that lie in no other, both ascending
        for a, b, rule in found:
            i = bisect.bisect_right(starts, a)
            if i and ends[i - 1] >= b:
                continue
            kept.append((a, b, rule))
            lo, hi = bisect.bisect_left(starts, a), bisect.bisect_right(ends, b)
            starts[lo : max(lo, hi)], ends[lo : max(lo, hi)] = [a], [b]
        return sorted(kept, key=lambda d: d[:2])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, words, places of the base phrases, labels, score, and the detections.

    Null texts are empty and detect nothing.  Detections give byte offsets into
    the text; score is the best confidence of what remains after suppression.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_qg_id"), text_bytes(text_col).alias("_qg_text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out = []
            for _, _, data, offsets in byte_chunks(batch.column(1)):
                starts = word_starts(data, offsets)
                at = np.searchsorted(starts, offsets)
                lowered = data.tobytes().lower()
                for k in range(len(offsets) - 1):
                    low = lowered[offsets[k] : offsets[k + 1]]
                    base = scanner.base_hits(low)
                    found = scanner.detections(low)
                    places = sorted(int(np.searchsorted(starts, offsets[k] + a)) - int(at[k]) for _, a, _ in base)
                    labels = {x for x, _, _ in base}
                    every = labels | {r.label for _, _, r in found}
                    score = max([0.9] * bool(base) + [r.confidence for _, _, r in found], default=0.0)
                    spans = [{"start": a, "end": b, "label": r.label, "priority": r.priority, "confidence": r.confidence} for a, b, r in found]
                    out.append((int(at[k + 1] - at[k]), len(base), places[0] if places else None, places[-1] if places else None, ",".join(sorted(labels)), ",".join(sorted(every)), score, spans))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["_qg_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    schema = f"_qg_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<start:bigint,end:bigint,label:string,priority:int,confidence:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("_qg_id", id_col)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text, with their detections; null detects nothing, repeated rows alike, an empty table gives no rows."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
