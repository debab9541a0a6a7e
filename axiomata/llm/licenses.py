"""Licence scans by sentence rules.

A text is normalised to lower-case words. A map holds the wording of known
licence sentences, each with its identifier; an automaton over the map finds
every known wording in one pass over the whole text, of overlapping ones the
longest. The sequence of identifiers is then matched against licence rules,
each an ordered list of identifiers, the longest first. Between two sentences
of a rule up to ``GAP`` others may stand, so that annotated texts still match;
identifiers that a rule has used are used up. A sentence may hold several
identifiers, and all of them count.

Names of versions and of licence families are built by rule, so a reference
gives its version where the text has one.

Defined results: a null or empty text has no licence; a reference to a licence
inside a longer sentence counts; repeated notices are found each; ties between
rules of one length go to the one listed first; sentences out of order make no
licence; repeated rows get the same result each; further columns are passed in
``keep``; an empty table gives an empty table. Texts are scanned whole. A
notice reaches from its first known wording to its last; positions are code
points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Other sentences allowed between the sentences of a rule.
GAP = 3
#: Known sentences of licence texts: identifier and wording, punctuation and case aside.
SENTENCES = (
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit-notice", "The above copyright notice and this permission notice"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("boost-notice", "The copyright notices in the Software and this entire statement"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-notice", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("as-is", "software is provided as is"),
    ("as-is", "work is provided as is"),
    ("as-is", "program is provided as is"),
    ("as-is", "library is provided as is"),
    ("as-is", "software is provided by the copyright holders and contributors as is"),
    ("as-is", "software is provided by the author as is"),
    ("liability", "in no event shall"),
    ("bsd-head", "Redistribution and use in source and binary forms"),
    ("bsd-source", "Redistributions of source code must retain"),
    ("bsd-binary", "Redistributions in binary form must reproduce"),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display"),
    ("bsd-endorse", "may be used to endorse or promote products"),
    ("bsd-endorse", "may be used to endorse products"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liability", "In no event will the authors be held liable for any damages"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("zlib-origin", "The origin of this software must not be misrepresented"),
    ("zlib-altered", "Altered source versions must be plainly marked as such"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-head", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("apache-use", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-basis", "distributed under the License is distributed on an AS IS BASIS"),
    ("gpl-free", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl-free", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl-free", "you can redistribute it and/or modify it under the terms of the GNU Library General Public License"),
    ("agpl-free", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("gnu-2-later", "either version 2 of the License, or (at your option) any later version"),
    ("gnu-2.1-later", "either version 2.1 of the License, or (at your option) any later version"),
    ("gnu-3-later", "either version 3 of the License, or (at your option) any later version"),
    ("gnu-2", "version 2 of the License"),
    ("gnu-2.1", "version 2.1 of the License"),
    ("gnu-3", "version 3 of the License"),
    ("gpl-hope", "distributed in the hope that it will be useful"),
    ("gpl-copy", "You should have received a copy of the GNU"),
    ("mpl-subject", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file"),
    ("epl-made", "made available under the terms of the Eclipse Public License"),
    ("unlicense-head", "This is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl-copy", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("wtfpl-do", "You just DO WHAT THE FUCK YOU WANT TO"),
    ("cc0-waive", "To the extent possible under law, the author has waived all copyright"),
    ("ofl-head", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("ofl-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software"),
    ("artistic-copy", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "placed in the public domain"),
    ("public-domain", "in the public domain"),
    ("all-rights", "All rights reserved"),
    ("all-rights", "All right reserved"),
    ("spdx", "SPDX-License-Identifier"),
)
#: Licences by the names that references use: licence, names, versions that may follow.
NAMED = (
    ("AGPL", ("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL"), ("3.0", "3")),
    ("LGPL", ("GNU Lesser General Public License", "GNU Library General Public License", "Lesser General Public License", "GNU LGPL", "LGPL"), ("2.0", "2.1", "3.0", "2", "3")),
    ("GPL", ("GNU General Public License", "GNU GPL", "General Public License", "under the GPL", "under GPL", "License GPL", "GPL License", "GPL licensed"), ("1.0", "2.0", "3.0", "1", "2", "3")),
    ("Apache", ("Apache License", "Apache Software License", "Apache"), ("1.0", "1.1", "2.0", "2")),
    ("MPL", ("Mozilla Public License", "MPL"), ("1.0", "1.1", "2.0", "2")),
    ("EPL", ("Eclipse Public License", "EPL"), ("1.0", "2.0", "1", "2")),
    ("CDDL", ("Common Development and Distribution License", "CDDL"), ("1.0", "1.1")),
    ("Artistic", ("Artistic License",), ("1.0", "2.0")),
    ("OFL", ("SIL Open Font License", "Open Font License", "OFL"), ("1.0", "1.1")),
    ("BUSL", ("Business Source License", "BUSL"), ("1.1",)),
    ("SSPL", ("Server Side Public License", "SSPL"), ("1.0", "1")),
    ("EUPL", ("European Union Public License", "EUPL"), ("1.0", "1.1", "1.2")),
    ("BSL", ("Boost Software License",), ("1.0",)),
    ("CC0", ("Creative Commons Zero", "CC0"), ("1.0",)),
    ("BSD-3-Clause", ("BSD 3-Clause", "3-Clause BSD", "New BSD License", "Modified BSD License", "Revised BSD License"), ()),
    ("BSD-2-Clause", ("BSD 2-Clause", "2-Clause BSD", "Simplified BSD License", "FreeBSD License"), ()),
    ("0BSD", ("0BSD", "BSD Zero Clause", "Zero-Clause BSD"), ()),
    ("BSD", ("BSD License", "BSD style license", "BSD licensed"), ()),
    ("ISC", ("ISC License", "ISC licensed"), ()),
    ("MIT", ("MIT License", "License MIT", "MIT licensed", "Expat License"), ()),
    ("Zlib", ("zlib License", "zlib/libpng License"), ()),
    ("Unlicense", ("the Unlicense",), ()),
    ("WTFPL", ("WTFPL", "Do What The Fuck You Want To Public License"), ()),
)
#: Names that say nothing without a version; a licence of one version that a plain name means.
ONLY_VERSIONED, DEFAULT = frozenset(["Apache", "General Public License", "MPL", "EPL"]), {"CC0": "1.0", "BUSL": "1.1", "SSPL": "1.0", "BSL": "1.0"}
#: Parts of Creative Commons names with their wordings, and versions.
COMMONS = (("NC", ("NonCommercial", "Non Commercial")), ("ND", ("NoDerivatives", "No Derivatives", "NoDerivs", "No Derivs")), ("SA", ("ShareAlike", "Share Alike")))
COMMONS_KINDS, COMMONS_VERSIONS = (("NC", "ND"), ("NC", "SA"), ("NC",), ("SA",), ("ND",), ()), ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Ordered rules: licence and the sentence identifiers that make it; references are rules of one identifier beside these.
RULES = (
    ("MIT", ("ref:MIT", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "as-is")),
    ("BSL-1.0", ("boost-grant", "boost-notice", "as-is", "liability")),
    ("BSL-1.0", ("boost-grant",)),
    ("ISC", ("isc-grant", "isc-notice", "as-is")),
    ("ISC", ("isc-grant", "mit-notice", "as-is")),
    ("0BSD", ("isc-grant", "as-is")),
    ("BSD-4-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-endorse", "as-is", "liability")),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary", "as-is", "liability")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered")),
    ("Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-head", "apache-use")),
    ("Apache-2.0", ("apache-head",)),
    ("Apache-2.0", ("apache-title",)),
    *((f"{name}-{version}{later}", (f"{name.lower()}-free", f"gnu-{version.removesuffix('.0')}{mark}", *rest)) for name, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",))) for version in versions for later, mark in (("-or-later", "-later"), ("", "")) for rest in (("gpl-hope", "gpl-copy"), ())),
    *((name, (f"{name.lower()}-free", *rest)) for name in ("GPL", "LGPL", "AGPL") for rest in (("gpl-hope", "gpl-copy"), ())),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense-head", "unlicense-anyone")),
    ("Unlicense", ("unlicense-head",)),
    ("WTFPL", ("wtfpl-copy", "wtfpl-do")),
    ("WTFPL", ("wtfpl-do",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("OFL-1.1", ("ofl-head", "ofl-grant")),
    ("OFL-1.1", ("ofl-head",)),
    ("Artistic-2.0", ("ref:Artistic-2.0", "artistic-copy")),
    ("EPL-2.0", ("epl-made", "ref:EPL-2.0")),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("all-rights",)),
)
#: The end of a sentence: a mark before white space, or an empty line, or a line's end before a list item.
_END = re.compile(r"[.!?](?=\s|$)|\n\s*\n|\n(?=\s*(?:[*#/\-]|\d+\.|\([a-z0-9]\))\s)|$")
_EXPRESSION = re.compile(r"[\W_]*([\w.+()-]+(?: (?:and|or|with) [\w.+()-]+)*)", re.I)
_WORD = re.compile(rb"[a-z0-9]+")
#: Bytes of words, A-Z as a-z; all others are spaces.
_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normalised(text: str) -> str:
    """Words in lower case with single spaces; one spelling of licence."""
    words = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
    return b" ".join(words).decode().replace("licence", "license")


def versioned(name: str, version: str) -> Iterator[str]:
    """The ways to write a version after a name."""
    joined = (f"{name}v{version}", f"{name}{version}") if " " not in name and name.isupper() else ()
    yield from (f"{name} {mark}{version}" for mark in ("", "v", "v ", "version "))
    yield from joined


def references() -> Iterator[tuple[str, str]]:
    """(licence, wording) of all names with and without versions."""
    full = lambda v: v if "." in v else f"{v}.0"
    for licence, names, versions in NAMED:
        for name in names:
            for version in versions:
                for wording in versioned(name, version):
                    yield f"{licence}-{full(version)}", wording
                    if licence.endswith("GPL"):
                        yield from ((f"{licence}-{full(version)}-or-later", f"{wording} {later}") for later in ("or later", "or any later version", "or (at your option) any later version"))
                        yield f"{licence}-{full(version)}-only", f"{wording} only"
            if licence == "GPL" and name.startswith("GNU"):
                yield from ((f"GPL-{full(v)}", f"GPL{mark}{v}") for v in versions for mark in ("", " ", "v", " v", " version "))
            if name not in ONLY_VERSIONED:
                yield f"{licence}-{DEFAULT[licence]}" if licence in DEFAULT else licence, name
    wordings = dict(COMMONS)
    for kind in COMMONS_KINDS:
        licence = "-".join(("CC", "BY", *kind))
        long = [" ".join(("Attribution", *x)) for x in product(*(wordings[k] for k in kind))]
        names = [" ".join(("CC BY", *kind)), *(f"Creative Commons {x}" for x in long), *(long if kind else ())]
        for name in names:
            yield licence, name
            yield from ((f"{licence}-{v}", f"{name} {v}") for v in COMMONS_VERSIONS)


def known_sentences() -> dict[str, str]:
    """The map from normalised wordings to identifiers; of equal wordings the first counts."""
    out: dict[str, str] = {}
    for known, wording in (*SENTENCES, *((f"ref:{licence}", wording) for licence, wording in references())):
        out.setdefault(normalised(wording), known)
    return out


@lru_cache
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for wording, known in known_sentences().items():
        made.add_word(f" {wording} ", (known, len(wording)))
    made.make_automaton()
    return made


@lru_cache
def rules() -> dict[str, list[tuple[int, str, tuple[str, ...]]]]:
    """(rank, licence, identifiers) of the rules by their first identifier; the longest rule has the least rank."""
    every = [*RULES, *((known[4:], (known,)) for known in dict.fromkeys(known_sentences().values()) if known.startswith("ref:"))]
    out: dict[str, list[tuple[int, str, tuple[str, ...]]]] = {}
    for rank, (licence, rule) in enumerate(sorted(every, key=lambda r: -len(r[1]))):
        out.setdefault(rule[0], []).append((rank, licence, rule))
    return out


def wordings(words: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) in normalised words, of overlapping ones the longest, then the first."""
    found = []
    for end, (known, size) in automaton().iter(f" {words} "):
        found.append((end - size - 1, end - 1, known))
    taken: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []
    reach = -1
    for hit in sorted(found):
        if hit[0] >= reach and run:
            taken += _apart(run)
            run = []
        run.append(hit)
        reach = max(reach, hit[1])
    return taken + _apart(run)


def _apart(run: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of a run of overlapping hits the longest ones that don't overlap, in order."""
    if len(run) < 2:
        return run
    starts: list[int] = []
    kept: list[tuple[int, int, str]] = []
    for hit in sorted(run, key=lambda h: (h[0] - h[1], h[0])):
        k = bisect_left(starts, hit[0])
        if (k == 0 or kept[k - 1][1] <= hit[0]) and (k == len(kept) or hit[1] <= kept[k][0]):
            starts.insert(k, hit[0])
            kept.insert(k, hit)
    return kept


def sentences(text: str) -> list[tuple[int, int, int, str]]:
    """(number of the sentence, start, end, identifier) of the known wordings of a text, in order; an SPDX line names its licence."""
    data = text.encode("utf-8", "surrogatepass")
    lowered = data.translate(_BYTES)
    hits = wordings(b" ".join(lowered.split()).decode().replace("licence", "license"))
    if not hits:
        return []
    spans = [m.span() for m in _WORD.finditer(lowered)]
    offsets, at = [], 0
    for a, b in spans:
        offsets.append(at)
        at += b - a + 1
    if len(data) == len(text):
        point = lambda k: k
    else:
        marks = sorted({k for a, b, _ in hits for k in (spans[bisect_left(offsets, a)][0], spans[bisect_right(offsets, b - 1) - 1][1])})
        points, before, total = {}, 0, 0
        for k in marks:
            total += len(data[before:k].decode("utf-8", "surrogatepass"))
            points[k], before = total, k
        point = points.__getitem__
    ends, begin = [], 0
    for m in _END.finditer(text):
        if begin < m.start() and not text[begin : m.start()].isspace():  # a blank line ends no second sentence
            ends.append(m.start())
        begin = m.end()
    out = []
    for a, b, known in hits:
        start, stop = point(spans[bisect_left(offsets, a)][0]), point(spans[bisect_right(offsets, b - 1) - 1][1])
        number = bisect_left(ends, start + 1)
        if known == "spdx":
            if not (given := _EXPRESSION.match(text, stop)):
                continue
            known, stop = f"spdx:{given[1]}", given.end()
        if not out or out[-1][2] <= start:  # names inside an SPDX expression belong to it
            out.append((number, start, stop, known))
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(licence, start, end) in order of start; positions are code points, the end exclusive."""
    if not text:
        return []
    known = sentences(text)
    if not known:
        return []
    places: dict[str, list[int]] = {}
    for k, (_, _, _, x) in enumerate(known):
        places.setdefault(x, []).append(k)
    used = [False] * len(known)
    found = [(x[5:], known[k][1], known[k][2]) for x, at in places.items() if x.startswith("spdx:") for k in at]
    for _, licence, rule in sorted(r for x in places for r in rules().get(x, ()) if all(y in places for y in r[2])):
        for first in places[rule[0]]:
            if used[first]:
                continue
            chain = [first]
            for wanted in rule[1:]:
                at = places[wanted]
                k = bisect_right(at, chain[-1])
                while k < len(at) and used[at[k]]:
                    k += 1
                if k == len(at) or known[at[k]][0] - known[chain[-1]][0] > GAP + 1:
                    break
                chain.append(at[k])
            else:
                for k in chain:
                    used[k] = True
                found.append((licence, known[chain[0]][1], known[chain[-1]][2]))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def with_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "licenses") -> DataFrame:
    """``keep`` and the licences of each row, an array of (license, start, stop)."""
    item = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    (own,) = free_name(docs, "text")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(item))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = [[{"license": x, "start": a, "stop": b} for x, a, b in scan(t)] for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, kind)], names=[*keep, out])

    return docs.select(*keep, F.col(text).cast("string").alias(own)).mapInArrow(run, schema)
