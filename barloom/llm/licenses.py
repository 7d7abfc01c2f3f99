"""License scans: ordered signature rules over a text's words, with keyword gates and suppression.

A text is reduced to its words, lower-cased and joined by single spaces, so that a signature is one
regular expression over words whatever the punctuation and line breaks. A rule runs only where its
gate, a few plain strings, stands in the text. Rules are ordered: sentences of license texts first,
then identifiers, grants by name, short forms, bare names. Taken in that order, a detection whose
interval of words lies inside one already kept is suppressed: the GPL in the name of the LGPL, the
BSD of a "3 clause BSD", a name inside the grant that states it.

Base detections (fixed phrases with fixed labels) are reported beside these and never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: What is no word, and A-Z, on UTF-8 bytes: other bytes stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Rule(NamedTuple):
    label: str
    #: How sure a detection is of its label.
    weight: float
    #: All of these stand in a text that the pattern can match.
    gate: tuple[str, ...]
    #: Over words parted by single spaces.
    pattern: str


#: Sentences of license texts and notices.
TEXTS = [
    Rule("mit", 0.97, ("permission is hereby granted",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    Rule("bsl-1.0", 0.97, ("permission is hereby granted",), "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    Rule("ofl-1.1", 0.97, ("permission is hereby granted",), "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    Rule("x11", 0.9, ("shall not be used in advertising",), "except as contained in this notice the name of [^ ]+(?: [^ ]+){0,5} shall not be used in advertising"),
    Rule("isc", 0.97, ("permission to use copy modify",), "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    Rule("hpnd", 0.95, ("permission to use copy modify",), "permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    Rule("bsd-4-clause", 0.97, ("all advertising materials",), "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    Rule("bsd-3-clause", 0.97, ("neither the name",), "neither the names? of [^ ]+(?: [^ ]+){0,12} nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software"),
    Rule("bsd", 0.93, ("redistribution and use in source",), "redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("zlib", 0.95, ("altered source versions",), "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    Rule("apache-2.0", 0.98, ("licensed under the apache license",), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Rule("apache-2.0", 0.85, ("limitations under the license",), "see the license for the specific language governing permissions and limitations under the license"),
    Rule("agpl-3.0-or-later", 0.98, ("affero general public",), "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Rule("lgpl-3.0-or-later", 0.98, ("lesser general public",), "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Rule("lgpl-2.1-or-later", 0.98, ("lesser general public",), "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    Rule("lgpl-2.0-or-later", 0.98, ("library general public",), "gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Rule("gpl-3.0-or-later", 0.98, ("gnu general public",), "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Rule("gpl-2.0-or-later", 0.98, ("gnu general public",), "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Rule("gpl-1.0-or-later", 0.98, ("gnu general public",), "gnu general public license as published by the free software foundation either version 1 or at your option any later version"),
    Rule("gpl-3.0-only", 0.97, ("gnu general public",), "gnu general public license as published by the free software foundation version 3"),
    Rule("gpl-2.0-only", 0.97, ("gnu general public",), "gnu general public license(?: version 2)? as published by the free software foundation(?: version 2)?"),
    Rule("gpl", 0.8, ("received a copy of the gnu",), "you should have received a copy of the gnu general public license along with (?:this|the|[^ ]+)(?: [^ ]+){0,3}"),
    Rule("lgpl", 0.85, ("received a copy of the gnu",), "you should have received a copy of the gnu (?:lesser|library) general public license along with (?:this|the|[^ ]+)(?: [^ ]+){0,3}"),
    Rule("gfdl", 0.96, ("free documentation license",), "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    Rule("mpl-2.0", 0.98, ("this source code form",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Rule("mpl-1.1", 0.97, ("mozilla public license",), "the contents of this file are subject to the mozilla public license version 1 1"),
    Rule("cddl-1.0", 0.95, ("common development and distribution",), "the contents of this file are subject to the terms of the common development and distribution license"),
    Rule("epl-2.0", 0.97, ("eclipse public license",), "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2 0"),
    Rule("epl-1.0", 0.97, ("eclipse public license",), "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?1 0"),
    Rule("unlicense", 0.98, ("free and unencumbered software",), "this is free and unencumbered software released into the public domain"),
    Rule("wtfpl", 0.95, ("do what the f",), "do what the fuck you want to public license"),
    Rule("beerware", 0.95, ("buy me a beer",), "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    Rule("cc0-1.0", 0.95, ("to the extent possible under law",), "to the extent possible under law [^ ]+(?: [^ ]+){0,12} waived all copyright and related or neighboring rights"),
    Rule("ofl-1.1", 0.97, ("this font software is licensed",), "this font software is licensed under the sil open font license version 1 1"),
    Rule("artistic-2.0", 0.9, ("artistic license 2 0",), "you can redistribute it and or modify it under the (?:terms of the )?artistic license 2 0"),
    Rule("artistic-1.0-perl", 0.95, ("same terms as perl",), "(?:free software you can redistribute it and or modify it )?under the same terms as perl itself"),
    Rule("postgresql", 0.9, ("postgresql global development group",), "portions copyright [^ ]+(?: [^ ]+){0,4} postgresql global development group"),
    Rule("openssl", 0.95, ("openssl project",), "this product includes software developed by the openssl project for use in the openssl toolkit"),
    Rule("ijg", 0.95, ("independent jpeg group",), "this software is based in part on the work of the independent jpeg group"),
    Rule("ftl", 0.95, ("freetype project",), "portions of this software are copyright [^ ]+(?: [^ ]+){0,3} the freetype project"),
    Rule("sspl-1.0", 0.97, ("server side public license",), "under the terms of the server side public license version 1 as published by mongodb"),
    Rule("commons-clause", 0.95, ("commons clause",), "commons clause license condition v1 0"),
    Rule("public-domain", 0.8, ("public domain",), "(?:is|are|been|hereby) (?:hereby )?(?:released|dedicated|placed|put|donated) (?:in|into|to) the public domain"),
    Rule("public-domain", 0.6, ("in the public domain",), "(?:this|the) (?:work|file|code|software|text|document|data|image) is in the public domain"),
    Rule("all-rights-reserved", 0.3, ("all rights reserved",), "copyright (?:c )?[^ ]+(?: [^ ]+){0,10} all rights reserved"),
]

#: Names of licenses: label, gate, and the name as words. Versions come before their family.
NAMES = [
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license (?:v(?:ersion )?)?3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public license"),
    ("lgpl-3.0", "lesser general", "gnu lesser general public license (?:v(?:ersion )?)?3(?: 0)?"),
    ("lgpl-2.1", "lesser general", "gnu lesser general public license (?:v(?:ersion )?)?2 1"),
    ("lgpl-2.0", "library general", "gnu library general public license(?: (?:v(?:ersion )?)?2(?: 0)?)?"),
    ("lgpl", "lesser general", "gnu lesser general public license"),
    ("gpl-3.0", "gnu general", "gnu general public license (?:v(?:ersion )?)?3(?: 0)?"),
    ("gpl-2.0", "gnu general", "gnu general public license (?:v(?:ersion )?)?2(?: 0)?"),
    ("gpl-1.0", "gnu general", "gnu general public license (?:v(?:ersion )?)?1(?: 0)?"),
    ("agpl-3.0", "agplv3", "agplv3"),
    ("lgpl-3.0", "lgplv3", "lgplv3"),
    ("gpl-3.0", "gplv3", "(?:gnu )?gplv3"),
    ("gpl-2.0", "gplv2", "(?:gnu )?gplv2"),
    ("gpl", "gnu gpl", "gnu gpl(?: v?[123](?: 0)?)?"),
    ("gpl", "gnu general", "gnu general public license"),
    ("gfdl-1.3", "free documentation", "gnu free documentation license (?:v(?:ersion )?)?1 3"),
    ("gfdl-1.2", "free documentation", "gnu free documentation license (?:v(?:ersion )?)?1 2"),
    ("gfdl", "free documentation", "gnu free documentation license"),
    ("apache-2.0", "apache", "apache (?:software )?licen[cs]e (?:v(?:ersion )?)?2(?: 0)?"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e (?:v(?:ersion )?)?1 1"),
    ("apache-1.0", "apache", "apache (?:software )?licen[cs]e (?:v(?:ersion )?)?1 0"),
    ("apache", "apache", "apache (?:software )?licen[cs]e"),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?"),
    ("mit", "mit licen", "mit licen[cs]e"),
    ("mit", "expat licen", "expat licen[cs]e"),
    ("x11", "x11 licen", "x11 licen[cs]e"),
    ("0bsd", "0bsd", "0bsd(?: license)?"),
    ("0bsd", "zero clause bsd", "zero clause bsd(?: license)?"),
    ("bsd-1-clause", "1 clause", "(?:bsd 1 clause|1 clause bsd)(?: license)?"),
    ("bsd-2-clause", "2 clause", "(?:bsd 2 clause|2 clause bsd)(?: license)?"),
    ("bsd-2-clause", "simplified bsd", "simplified bsd(?: license)?"),
    ("bsd-2-clause", "freebsd licen", "freebsd licen[cs]e"),
    ("bsd-3-clause-clear", "clause clear", "(?:bsd 3 clause clear|clear bsd)(?: license)?"),
    ("bsd-3-clause", "3 clause", "(?:bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd-3-clause", "new bsd", "new bsd license"),
    ("bsd-3-clause", "modified bsd", "modified bsd license"),
    ("bsd-4-clause", "4 clause", "(?:bsd 4 clause|4 clause bsd)(?: license)?"),
    ("bsd", "bsd licen", "bsd licen[cs]e"),
    ("mpl-2.0", "mozilla public", "mozilla public license (?:v(?:ersion)? ?)?2 0"),
    ("mpl-1.1", "mozilla public", "mozilla public license (?:v(?:ersion)? ?)?1 1"),
    ("mpl-1.0", "mozilla public", "mozilla public license (?:v(?:ersion)? ?)?1 0"),
    ("mpl", "mozilla public", "mozilla public license"),
    ("epl-2.0", "eclipse public", "eclipse public license (?:v(?:ersion)? ?)?2 0"),
    ("epl-1.0", "eclipse public", "eclipse public license (?:v(?:ersion)? ?)?1 0"),
    ("epl", "eclipse public", "eclipse public license"),
    ("edl-1.0", "eclipse distribution", "eclipse distribution license(?: v?(?:ersion )?1 0)?"),
    ("cddl-1.1", "common development and", "common development and distribution license(?: cddl)? (?:v(?:ersion)? ?)?1 1"),
    ("cddl-1.0", "common development and", "common development and distribution license(?: cddl)? (?:v(?:ersion)? ?)?1 0"),
    ("cddl", "common development and", "common development and distribution license"),
    ("cpl-1.0", "common public license", "common public license(?: (?:v(?:ersion)? ?)?1 0)?"),
    ("ipl-1.0", "ibm public license", "ibm public license(?: (?:v(?:ersion)? ?)?1 0)?"),
    ("cpal-1.0", "common public attribution", "common public attribution license"),
    ("eupl-1.2", "european union public", "european union public licen[cs]e (?:v(?:ersion)? ?)?1 2"),
    ("eupl-1.1", "european union public", "european union public licen[cs]e (?:v(?:ersion)? ?)?1 1"),
    ("eupl", "european union public", "european union public licen[cs]e"),
    ("artistic-2.0", "artistic license", "artistic license (?:v(?:ersion)? ?)?2 0"),
    ("artistic-1.0", "artistic license", "artistic license (?:v(?:ersion)? ?)?1 0"),
    ("artistic", "artistic license", "artistic license"),
    ("bsl-1.0", "boost software", "boost software license(?: (?:v(?:ersion)? ?)?1 0)?"),
    ("isc", "isc license", "isc license"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng license", "libpng license"),
    ("unlicense", "the unlicense", "the unlicense"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?"),
    ("cc0-1.0", "creative commons zero", "creative commons zero"),
    ("odbl-1.0", "open database license", "open database license(?: v?1 0)?"),
    ("odc-by-1.0", "open data commons", "open data commons attribution license"),
    ("pddl-1.0", "public domain dedication", "public domain dedication and licen[cs]e"),
    ("ofl-1.1", "open font licen", "sil open font licen[cs]e(?: (?:v(?:ersion)? ?)?1 1)?"),
    ("psf-2.0", "python software foundation", "python software foundation license(?: (?:v(?:ersion)? ?)?2)?"),
    ("php-3.01", "php license", "php license(?: (?:v(?:ersion)? ?)?3 01)?"),
    ("ruby", "ruby license", "ruby license"),
    ("openssl", "openssl license", "openssl license"),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license"),
    ("w3c", "w3c software", "w3c software(?: and document)?(?: notice)?(?: and)? license"),
    ("ms-pl", "microsoft public license", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license"),
    ("afl-3.0", "academic free license", "academic free license(?: (?:v(?:ersion)? ?)?3 0)?"),
    ("osl-3.0", "open software license", "open software license(?: (?:v(?:ersion)? ?)?3 0)?"),
    ("ecl-2.0", "educational community", "educational community license(?: (?:v(?:ersion)? ?)?2 0)?"),
    ("upl-1.0", "universal permissive", "universal permissive license(?: (?:v(?:ersion)? ?)?1 0)?"),
    ("zpl-2.1", "zope public license", "zope public license(?: (?:v(?:ersion)? ?)?2 1)?"),
    ("qpl-1.0", "q public license", "q public license(?: (?:v(?:ersion)? ?)?1 0)?"),
    ("lppl-1.3c", "latex project public", "latex project public license(?: (?:v(?:ersion)? ?)?1 3c?)?"),
    ("nasa-1.3", "nasa open source", "nasa open source agreement(?: (?:v(?:ersion)? ?)?1 3)?"),
    ("apsl-2.0", "apple public source", "apple public source license(?: (?:v(?:ersion)? ?)?2 0)?"),
    ("rpl-1.5", "reciprocal public license", "reciprocal public license(?: (?:v(?:ersion)? ?)?1 5)?"),
    ("unicode-3.0", "unicode license", "unicode license v3"),
    ("icu", "icu license", "icu license"),
    ("ftl", "freetype", "freetype (?:project )?license"),
    ("imagemagick", "imagemagick license", "imagemagick license"),
    ("mulanpsl-2.0", "mulan permissive", "mulan permissive software license(?: v2)?"),
    ("sspl-1.0", "server side public", "server side public license"),
    ("busl-1.1", "business source license", "business source license(?: 1 1)?"),
    ("elastic-2.0", "elastic license", "elastic license(?: v?2(?: 0)?)?"),
    ("polyform", "polyform", "polyform (?:noncommercial|perimeter|shield|strict|small business|internal use|free trial) license"),
    ("cecill-2.1", "cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?"),
    ("blueoak-1.0.0", "blue oak model", "blue oak model license"),
    ("beerware", "beer", "beer ?ware license"),
    ("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?"),
    ("json", "json license", "json license"),
    ("commons-clause", "commons clause", "commons clause"),
]

#: Creative Commons terms, most restrictive first: label, short form, long form.
CC_TERMS = [
    ("cc-by-nc-nd", "cc by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
    ("cc-by-nc-sa", "cc by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "cc by nc", "attribution non ?commercial"),
    ("cc-by-nd", "cc by nd", "attribution no ?deriv(?:ative)?s(?: works)?"),
    ("cc-by-sa", "cc by sa", "attribution share ?alike"),
    ("cc-by", "cc by", "attribution"),
]
CC_VERSIONS = ["4.0", "3.0", "2.5", "2.0", "1.0"]

#: Labels that are common words when they follow "license".
PLAIN = {"json", "ruby", "icu", "artistic", "openssl", "commons-clause", "isc", "unlicense"}

GRANT = "(?:licensed|released|distributed|redistributed|published|provided|covered|governed|(?:made )?available) (?:to you )?(?:under|by) (?:(?:the )?terms (?:and conditions )?of )?(?:an? |the )?"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in the order of their priority: hundreds, made from the tables above."""
    names = [(label, gate, name) for label, gate, name in NAMES]
    for label, short, long in CC_TERMS:
        for v in CC_VERSIONS:
            spoken = v.replace(".", " ")
            names.append((f"{label}-{v}", "cc by", f"{short} {spoken}"))
            names.append((f"{label}-{v}", "creative commons", f"creative commons {long}(?: {spoken}| (?:international|unported|generic) {spoken}|(?: [^ ]+)? license (?:version )?{spoken})"))
    for label, short, long in CC_TERMS:
        names.append((label, "cc by", short))
        names.append((label, "creative commons", f"creative commons {long}(?: license)?"))
    spoken = {label: label.replace("-", " ").replace(".", " ") for label, _, _ in names}
    out = list(TEXTS)
    for label, words in spoken.items():
        out.append(Rule(label, 0.99, ("spdx license identifier",), f"spdx license identifier {words}(?: only| or later)?"))
    out += [Rule(label, 0.95, (gate,), f"{GRANT}{name}") for label, gate, name in names]
    for label, words in spoken.items():
        if label not in PLAIN:
            out.append(Rule(label, 0.85, ("licen", words.split()[0]), f"licen[cs]ed? (?:is |under |under the |name |type |the )?{words}"))
    out += [Rule(label, 0.7, (gate,), name) for label, gate, name in names]
    return tuple(out)


@lru_cache(maxsize=1)
def compiled() -> tuple[list[tuple[tuple[bytes, ...], list[tuple[int, Rule, re.Pattern]]]], list[bytes]]:
    """Rules by gate, with their priority, and every string of a gate."""
    by_gate: dict[tuple[bytes, ...], list[tuple[int, Rule, re.Pattern]]] = {}
    for priority, rule in enumerate(rules()):
        by_gate.setdefault(tuple(g.encode() for g in rule.gate), []).append((priority, rule, re.compile(rf" (?:{rule.pattern})(?= )".encode())))
    return list(by_gate.items()), sorted({g for gate in by_gate for g in gate})


class Found(NamedTuple):
    label: str
    #: Words from 0, end exclusive.
    start: int
    end: int
    priority: int
    weight: float


def words_line(text: str | None) -> bytes:
    """The words between single spaces, with one at either end; one space without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ") if text else []
    joined = b" ".join(filter(None, words))
    return b" " + joined + b" " if joined else b" "


def _places(line: bytes, phrase: bytes) -> list[int]:
    """The first word, counted from 0, of each place of the phrase."""
    found, word, last, at = [], 0, 0, line.find(phrase)
    while at >= 0:
        word += line.count(b" ", last, at)
        last = at
        found.append(word)
        at = line.find(phrase, at + 1)
    return found


def detect(line: bytes) -> list[Found]:
    """Every rule's detections, by priority, then place."""
    by_gate, strings = compiled()
    there = {s for s in strings if s in line}
    spaces = None
    found = []
    if there:
        for gate, own in by_gate:
            if all(g in there for g in gate):
                for priority, rule, pattern in own:
                    for m in pattern.finditer(line):
                        if spaces is None:
                            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                        # the match starts at the space before its first word and ends before the one after its last
                        found.append(Found(rule.label, int(np.searchsorted(spaces, m.start())), int(np.searchsorted(spaces, m.end())), priority, rule.weight))
    return sorted(found, key=lambda f: (f.priority, f.start))


def resolve(found: list[Found]) -> list[Found]:
    """Those that lie in no interval kept before them. found: by priority, then place; the intervals of one rule don't meet."""
    kept: list[Found] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, at = np.zeros(0, np.int64), 0
    while at < len(found):
        upto = at
        while upto < len(found) and found[upto].priority == found[at].priority:
            upto += 1
        own = found[at:upto]
        # of the kept intervals that start no later, the one that reaches farthest
        before = np.searchsorted(starts, [f.start for f in own], "right") - 1
        new = [f for f, i in zip(own, before) if i < 0 or reach[i] < f.end]
        kept += new
        starts, ends = np.append(starts, [f.start for f in new]).astype(np.int64), np.append(ends, [f.end for f in new]).astype(np.int64)
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        reach = np.maximum.accumulate(ends) if len(ends) else ends
        at = upto
    return sorted(kept, key=lambda f: (f.start, f.end, f.priority))


def base_places(line: bytes) -> list[tuple[str, int]]:
    """Label and first word of each place of a base phrase, in order."""
    out = []
    for phrase, label in BASE.items():
        out += [(label, word) for word in _places(line, f" {phrase} ".encode())]
    return sorted(out, key=lambda x: (x[1], x[0]))


def score_of(found: list[Found], base: list[tuple[str, int]]) -> float:
    """How sure it is that the text states a license: one minus the chance that all its labels err, each as sure as its surest detection; a base place is as sure as a bare name."""
    sure: dict[str, float] = dict.fromkeys((label for label, _ in base), 0.7)
    for f in found:
        sure[f.label] = max(sure.get(f.label, 0.0), f.weight)
    miss = 1.0
    for label in sorted(sure):
        miss *= 1 - sure[label]
    return round(1 - miss, 9)


_BASE = "base: array<struct<label: string, start: long>>"
_FOUND = "found: array<struct<label: string, start: long, end: long, rule: int, weight: double>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places of base phrases), found (kept detections by place; rule is the priority), score.

    A null text is empty; texts without words have nothing and score 0; very long texts are read whole, every
    pattern is linear in them; detections at equal places stay if they are of different rules and none holds the
    other; null ids, repeated rows and equal texts are rows of their own; an empty table gives no rows; other
    columns are ignored."""
    slim = docs.select("doc_id", "text")
    empty = slim.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.from_json(F.lit(""), f"struct<{_BASE}, {_FOUND}>").alias("x"), F.lit(0.0).alias("score"))
    schema = empty.select("doc_id", "n_words", "x.base", "x.found", "score").schema
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, bases, founds, scores = [], [], [], []
            for text in batch.column("text").to_pylist():
                line = words_line(text)
                base, found = base_places(line), resolve(detect(line))
                n_words.append(line.count(b" ") - 1)
                bases.append([{"label": label, "start": start} for label, start in base])
                founds.append([dict(zip(("label", "start", "end", "rule", "weight"), f)) for f in found])
                scores.append(score_of(found, base))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(bases, base_type), pa.array(founds, found_type), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(run, schema)
