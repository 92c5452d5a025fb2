"""Licence scans by sentence rules.

Texts are normalised to words and split into sentences; each normalised known sentence that a sentence holds gives
its identifier, and of two at one place the longer does. Line breaks and comment signs are spaces, so wrapped headers are whole;
empty lines end a sentence. The identifiers of a text, in order, are then matched against ordered rules: a rule holds
if its identifiers appear in its order with at most ``MAX_GAP`` foreign sentences between two of them. A longer
rule is preferred; the sentences it used are not used again. A notice that the words before it deny ("not released under ...")
is passed over: any denying word before it in its sentence counts, back to a contrast ("but") or a known sentence.

Notices are read by rule (how it is said, a licence's name, "only" or "or later"); tags of the public list are read as expressions, each
of whose identifiers counts. Versions that may be later ones are licences of their own (``-or-later``), and so are those that may not (``-only``).

Only texts with one of the marker words go through the sentence split; every known sentence holds a marker.
Null texts count as empty and, like all texts without a match and empty tables, give no row. Repeated rows give repeated results, a
null id is returned as it is. Texts of any length are read whole, one at a time. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm.store import small_batches

MAX_GAP = 3

#: Identifiers of known licence sentences, normalised (lower case, words joined by one space).
SENTENCES = {
    "mit-notice": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "available under the mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software",),
    "mit-condition": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is without warranty of any kind",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    "isc-as-is": ("the software is provided as is and the author disclaims all warranties",),
    "isc-notice": ("licensed under the isc license", "released under the isc license"),
    "apache-notice": ("licensed under the apache license version 2 0", "released under the apache license version 2 0"),
    "apache-condition": ("you may not use this file except in compliance with the license",),
    "apache-warranty": ("distributed on an as is basis without warranties or conditions of any kind",),
    "gpl-grant": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",),
    "lgpl-grant": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",),
    "agpl-grant": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",),
    "version-2": ("either version 2 of the license", "version 2 of the license"),
    "version-2-later": ("either version 2 of the license or at your option any later version",),
    "version-2.1": ("either version 2 1 of the license", "version 2 1 of the license"),
    "version-2.1-later": ("either version 2 1 of the license or at your option any later version",),
    "version-3": ("either version 3 of the license", "version 3 of the license"),
    "version-3-later": ("either version 3 of the license or at your option any later version",),
    "gpl2-text": ("gnu general public license version 2 june 1991",),
    "gpl3-text": ("gnu general public license version 3 29 june 2007",),
    "lgpl21-text": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl3-text": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl3-text": ("gnu affero general public license version 3 19 november 2007",),
    "mpl2-text": ("mozilla public license version 2 0 1",),
    "apache-text": ("apache license version 2 0 january 2004",),
    "gnu-warranty": ("without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "bsd-condition": ("redistributions of source code must retain the above copyright notice",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice",),
    "bsd-endorse": ("may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-as-is": ("this software is provided by the copyright holders and contributors as is",),
    "zlib-as-is": ("this software is provided as is without any express or implied warranty",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",),
    "boost-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "cc-by-nc-notice": ("licensed under cc by nc 4 0",),
    "cc-by-notice": ("licensed under cc by 4 0",),
    "cc-by-sa-notice": ("licensed under cc by sa 4 0",),
    "cc0-notice": ("licensed under cc0 1 0", "dedicated to the public domain under cc0"),
    "mpl2-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "epl2-notice": ("made available under the terms of the eclipse public license 2 0", "made available under the terms of the eclipse public license v 2 0"),
}
#: Ordered rules; the first that fits at a sentence is taken, so longer rules come first.
RULES = (
    ("BSD-3-Clause", "full", ("bsd-grant", "bsd-condition", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", "full", ("bsd-grant", "bsd-condition", "bsd-binary", "bsd-as-is")),
    ("MIT", "full", ("mit-grant", "mit-condition", "as-is")),
    ("Apache-2.0", "full", ("apache-notice", "apache-condition", "apache-warranty")),
    ("GPL-2.0-or-later", "full", ("gpl-grant", "version-2-later", "gnu-warranty")),
    ("GPL-2.0-only", "full", ("gpl-grant", "version-2", "gnu-warranty")),
    ("GPL-3.0-or-later", "full", ("gpl-grant", "version-3-later", "gnu-warranty")),
    ("GPL-3.0-only", "full", ("gpl-grant", "version-3", "gnu-warranty")),
    ("LGPL-2.1-or-later", "full", ("lgpl-grant", "version-2.1-later", "gnu-warranty")),
    ("LGPL-2.1-only", "full", ("lgpl-grant", "version-2.1", "gnu-warranty")),
    ("LGPL-3.0-or-later", "full", ("lgpl-grant", "version-3-later", "gnu-warranty")),
    ("LGPL-3.0-only", "full", ("lgpl-grant", "version-3", "gnu-warranty")),
    ("AGPL-3.0-or-later", "full", ("agpl-grant", "version-3-later", "gnu-warranty")),
    ("AGPL-3.0-only", "full", ("agpl-grant", "version-3", "gnu-warranty")),
    ("BSD", "full", ("bsd-grant", "bsd-condition", "as-is")),
    ("ISC", "full", ("isc-grant", "isc-as-is")),
    ("Zlib", "full", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", "full", ("boost-grant", "as-is")),
    ("GPL-2.0-or-later", "grant", ("gpl-grant", "version-2-later")),
    ("GPL-2.0-only", "grant", ("gpl-grant", "version-2")),
    ("GPL-3.0-or-later", "grant", ("gpl-grant", "version-3-later")),
    ("GPL-3.0-only", "grant", ("gpl-grant", "version-3")),
    ("LGPL-2.1-or-later", "grant", ("lgpl-grant", "version-2.1-later")),
    ("LGPL-2.1-only", "grant", ("lgpl-grant", "version-2.1")),
    ("LGPL-3.0-or-later", "grant", ("lgpl-grant", "version-3-later")),
    ("LGPL-3.0-only", "grant", ("lgpl-grant", "version-3")),
    ("AGPL-3.0-or-later", "grant", ("agpl-grant", "version-3-later")),
    ("AGPL-3.0-only", "grant", ("agpl-grant", "version-3")),
    ("BSD", "partial", ("bsd-grant", "bsd-condition")),
    ("MIT", "partial", ("mit-grant", "as-is")),
    ("Apache-2.0", "partial", ("apache-notice", "apache-condition")),
    ("MIT", "notice", ("mit-notice",)),
    ("MIT", "grant", ("mit-grant",)),
    ("ISC", "notice", ("isc-notice",)),
    ("ISC", "grant", ("isc-grant",)),
    ("Apache-2.0", "notice", ("apache-notice",)),
    ("GPL", "grant", ("gpl-grant",)),
    ("LGPL", "grant", ("lgpl-grant",)),
    ("AGPL", "grant", ("agpl-grant",)),
    ("BSD", "grant", ("bsd-grant",)),
    ("Zlib", "grant", ("zlib-grant",)),
    ("BSL-1.0", "grant", ("boost-grant",)),
    ("Unlicense", "notice", ("unlicense",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", "notice", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-notice",)),
    ("CC0-1.0", "notice", ("cc0-notice",)),
    ("MPL-2.0", "notice", ("mpl2-notice",)),
    ("EPL-2.0", "notice", ("epl2-notice",)),
    ("GPL-2.0", "text", ("gpl2-text",)),
    ("GPL-3.0", "text", ("gpl3-text",)),
    ("LGPL-2.1", "text", ("lgpl21-text",)),
    ("LGPL-3.0", "text", ("lgpl3-text",)),
    ("AGPL-3.0", "text", ("agpl3-text",)),
    ("MPL-2.0", "text", ("mpl2-text",)),
    ("Apache-2.0", "text", ("apache-text",)),
)
#: Identifiers of the public list of licences; in a tag, those of the GNU family may end in -only, -or-later or +.
SPDX = ("MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "0BSD", "WTFPL", "Artistic-2.0", "EUPL-1.2", "PostgreSQL", "Python-2.0", "OFL-1.1", "AFL-3.0", "NCSA", "CDDL-1.0", "X11")
#: The GNU family: identifier, short name, full name, versions.
GNU = (("GPL", "gpl", "gnu general public license", ("2", "3")), ("LGPL", "lgpl", "gnu lesser general public license", ("2.1", "3")), ("AGPL", "agpl", "gnu affero general public license", ("3",)))
#: Names of licences in notices, normalised.
NAMES = {
    "mit license": "MIT", "mit licence": "MIT", "isc license": "ISC", "isc licence": "ISC", "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0", "apache 2 0": "Apache-2.0",
    "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mpl 2 0": "MPL-2.0", "eclipse public license 2 0": "EPL-2.0", "eclipse public license version 2 0": "EPL-2.0", "boost software license version 1 0": "BSL-1.0", "zlib license": "Zlib",
    "bsd 2 clause license": "BSD-2-Clause", "2 clause bsd license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "3 clause bsd license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "bsd license": "BSD", "unlicense": "Unlicense",
    "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc0 1 0": "CC0-1.0",
}
#: What says that a later version will do, or that none will.
LATER = {"or later": "-or-later", "or any later version": "-or-later", "or at your option any later version": "-or-later", "only": "-only"}


def _gnu_names() -> dict[str, str]:
    """Names of the GNU family's licences in notices, by rule."""
    out = {}
    for name, short, full, versions in GNU:
        for v in versions:
            licence = f"{name}-{v if '.' in v else v + '.0'}"
            for said in {v.replace(".", " "), f"{v} 0" if "." not in v else v.replace(".", " ")}:
                for form in ("{} version {}", "{} v {}", "{} v{}", "{} {}"):
                    for called in (full, full.removeprefix("gnu "), short, f"gnu {short}"):
                        out[form.format(called, said)] = licence
                for called in (short, f"gnu {short}"):
                    out[f"{called}v{said}"] = licence
    return out


_NAMES = NAMES | _gnu_names()
_LICENCES = sorted({*SPDX, *_NAMES.values(), *(f"{n}{x}" for n in _gnu_names().values() for x in ("-only", "-or-later"))})
#: Each licence by a tag or a notice that names it, behind the written rules.
RULES += tuple((x, "notice", (f"{kind}:{x}",)) for x in _LICENCES for kind in ("tag", "notice"))
MARKERS = ("licen", "gpl", "released under", "distributed under", "available under", "permission is hereby", "redistribut", "as is", "copyright", "public domain", "hereby granted", "without any warranty", "endorse or promote")
#: Words that deny a notice behind them in its sentence, unless "only" follows or a contrast stands between.
DENIALS, CONTRASTS = ("not", "never", "cannot", "longer", "isn", "aren", "wasn", "weren"), ("but", "however", "instead", "rather", "yet", "although", "though")
_MARKED = "(?is)" + "|".join("(?:[^a-z0-9]|\\b(?:rem|dnl)\\b)+".join(m.split()) for m in MARKERS)
#: A sentence ends at an empty line, or at a stop before white space; "2.0" and "v. 2.0" hold no end.
_END = re.compile(r"[.!?]+\s|(?:\r?\n|\r(?!\n))[^\r\n]*[\r\n]")
_ABBREVIATED = re.compile(r"\.[^\S\r\n]*(?:\r?\n|\r)?[^\r\n.!?]*")
_WORD = re.compile(r"(?m:^[ \t]*(?:rem|dnl)(?!\S))|([a-z0-9]+)")
#: A notice: how it is said, the licence's name, and which versions will do.
_NOTICE = re.compile(
    r"(?<!\S)(?:(?:this|the) (?:work|project|software|program|library|file|code) is )?(?:licensed|released|distributed|available|provided|covered|published|offered) (?:under|by)(?: the)?(?: terms of)?(?: the)? ("
    + "|".join(sorted(_NAMES, key=len, reverse=True)) + ")(?: (" + "|".join(sorted(LATER, key=len, reverse=True)) + r"))?(?!\S)"
)
_TAG = re.compile(r"spdx-license-identifier\s*:?[^\S\r\n]*([^\r\n]*)")
_TOKEN = re.compile(r"[a-z0-9.+-]+")
_BY_TAG = {x.lower(): x for x in _LICENCES}
_KNOWN = {s: k for k, all_of in SENTENCES.items() for s in all_of}
_HELD = re.compile(r"(?<!\S)(?:" + "|".join(sorted(_KNOWN, key=len, reverse=True)) + r")(?!\S)")


def lowered(text: str) -> str:
    """Lower case with every code point at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def normalise(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """(words, at, spans): words joined by one space, or by a line break where a sentence ends; where each is in that, and in the text."""
    low = lowered(text)
    spans = [m.span() for m in _WORD.finditer(low) if m.group(1)]
    parts, at, length, before, last = [], [], 0, "", 0
    for lo, hi in spans:
        gap = low[last:lo]
        if parts:
            ends = len(gap) > 1 and _END.search(gap) and not (before == "v" and _ABBREVIATED.fullmatch(gap))
            parts.append("\n" if ends else " ")
            length += 1
        at.append(length)
        before, last = low[lo:hi], hi
        parts.append(before)
        length += hi - lo
    return "".join(parts), at, spans


def denied(said: str, start: int, since: int = 0) -> bool:
    """Whether the words before a place of the normalised text, in its sentence and behind the last known one, deny what follows."""
    before = said[max(since, said.rfind("\n", 0, start) + 1) : start].split()
    contrast = max((i for i, w in enumerate(before) if w in CONTRASTS), default=-1)
    return any(w in DENIALS and before[i + 1 : i + 2] != ["only"] for i, w in enumerate(before) if i > contrast)


def tags(low: str) -> Iterator[tuple[str, int, int]]:
    """(licence, start, end) of each identifier in the expressions of licence tags: ``MIT OR (GPL-2.0-only WITH ...)``; exceptions behind WITH are passed over."""
    for m in _TAG.finditer(low):
        before = ""
        for t in _TOKEN.finditer(low, m.start(1), m.end(1)):
            word = t.group().strip("-.") if t.group() not in _BY_TAG else t.group()
            name = word.removesuffix("+") + ("-or-later" if word.endswith("+") else "")
            if name in _BY_TAG and before != "with":
                yield _BY_TAG[name], t.start(), t.end()
            elif word not in ("or", "and", "with") and before not in ("with", "or", "and", ""):
                break  # the expression is over
            before = word


def identify(text: str) -> list[tuple[int, str, int, int]]:
    """(ordinal of the sentence, identifier, start, end) of the known sentences, notices and tags; spans reach from their first word to their last."""
    said, at, spans = normalise(text)
    met = [(m.start(), -m.end(), _KNOWN[m.group()]) for m in _HELD.finditer(said)]
    for m in _NOTICE.finditer(said):
        licence = _NAMES[m.group(1)] + (LATER[m.group(2)] if m.group(2) else "")
        end = m.end()
        if licence not in _LICENCES:  # "only" behind a licence without versions
            licence, end = _NAMES[m.group(1)], m.end(1)
        met.append((m.start(), -end, f"notice:{licence}"))
    found, last = [], 0
    for start, end, kind in sorted(met, key=lambda x: x[:2]):  # of two that start at one place, or of one inside another, the longer
        if start < last:
            continue
        since, last = last, -end
        if "notice" in kind and denied(said, start, since):
            continue
        found.append((spans[bisect_left(at, start)][0], spans[bisect_left(at, -end) - 1][1], kind, start))
    starts = [lo for lo, _ in spans]
    for licence, lo, hi in tags(lowered(text)):
        found.append((lo, hi, f"tag:{licence}", at[max(0, bisect_left(starts, lo + 1) - 1)]))
    out, i, last = [], 0, 0
    for lo, hi, kind, start in sorted(found):
        i += said.count("\n", last, start)
        last = max(last, start)
        out.append((i, kind, lo, hi))
    return out


def match(found: list[tuple[int, str, int, int]]) -> list[dict]:
    """The rules that a text's identifier sequence meets, in order."""
    out, used = [], set()
    for i in range(len(found)):
        if i in used:
            continue
        for licence, kind, wanted in RULES:
            if found[i][1] != wanted[0]:
                continue
            got = [i]
            for want in wanted[1:]:
                nxt = next((j for j in range(got[-1] + 1, len(found)) if j not in used and found[j][1] == want and found[j][0] - found[got[-1]][0] - 1 <= MAX_GAP), None)
                if nxt is None:
                    break
                got.append(nxt)
            if len(got) == len(wanted):
                used.update(got)
                out.append({"licence": licence, "rule": kind, "sentences": len(got), "start": found[got[0]][2], "end": found[got[-1]][3]})
                break
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(i, match(identify(t))) for i, t in enumerate(batch.column(1).to_pylist())]
        rows = [(i, m) for i, all_of in got for m in all_of]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([i for i, _ in rows]))] + [pa.array([m[k] for _, m in rows], t) for k, t in (("licence", pa.string()), ("rule", pa.string()), ("sentences", pa.int32()), ("start", pa.int64()), ("end", pa.int64()))],
                names=["id", "licence", "rule", "sentences", "start", "end"],
            )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence found: id, licence, rule, number of sentences, span (code points, end exclusive)."""
    kind = docs.schema[id_col].dataType.simpleString()
    marked = small_batches(docs).where(F.col(text_col).rlike(_MARKED)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return marked.mapInArrow(_scan, f"id {kind}, licence string, rule string, sentences int, start long, end long").withColumnRenamed("id", id_col)
