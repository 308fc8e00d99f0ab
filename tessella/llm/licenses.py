"""License scans by conditional compression.

Blocks of lines that speak of licences are looked at through windows little longer than each
template; a window that lacks more of a template's words than may differ can't hold it. In the
others the template's place is found, and what stands there is compressed plainly and with the
template as a raw zstandard dictionary in front. The size reductions rank all templates and
places of a block; in that order they are confirmed or refused by exact wording: every word
that the template has and the place lacks, or the other way round inside it, counts as a
difference, and the words that tell a licence from its relatives must all be there. Of
confirmed ones that overlap, the one that saves most is reported, so a longer text with small
edits goes before its unedited part. No reduction is too small to be looked at. Spans are code
points, end exclusive.

Null text counts as empty text: no licences. Every row gives one row, repeated rows each their
own; other columns are not read, and an empty table gives no rows. All blocks of a text are
looked at, however long it is, and all licences of a block or line.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = _BSD2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""


@dataclass(frozen=True)
class Template:
    """name: of the licence; text: its wording; must: words of which none may be missing or changed."""

    name: str
    text: str
    must: tuple[str, ...] = ()


#: Identifiers as SPDX spells them; fixed values.
_SPDX = ("0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")
_WORD = re.compile(r"[A-Za-z0-9]+")


def _words(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


def read_templates(folder: str) -> tuple[Template, ...]:
    """Whole licence texts from a folder of the driver: each NAME.txt is the template of licence NAME."""
    return tuple(Template(f.stem, f.read_text(encoding="utf-8")) for f in sorted(Path(folder).glob("*.txt")))


def _notices() -> list[Template]:
    out = [
        Template("mit", _MIT, ("sublicense", "sell", "noninfringement")),
        Template("isc", _ISC, ("fee",)),
        Template("bsd-2-clause", _BSD2, ("redistribution", "binary")),
        Template("bsd-3-clause", _BSD3, ("neither", "endorse", "promote")),
        Template("apache-2.0", _APACHE, ("apache", "2", "0")),
        Template("gpl-2.0", _GPL.format("2"), ("general", "public", "2")),
        Template("gpl-3.0", _GPL.format("3"), ("general", "public", "3")),
        Template("unlicense", _UNLICENSE, ("unencumbered", "domain")),
    ]
    lead = ("Licensed under the ", "Released under the ", "Distributed under the ", "This work is licensed under the ", "This project is licensed under the ")
    short = (
        ("mit", "MIT License.", ("mit",)),
        ("apache-2.0", "Apache License, Version 2.0.", ("apache", "2", "0")),
        ("gpl-2.0", "GNU General Public License, version 2.", ("general", "public", "2")),
        ("gpl-3.0", "GNU General Public License, version 3.", ("general", "public", "3")),
        ("lgpl-3.0", "GNU Lesser General Public License, version 3.", ("lesser", "general", "3")),
        ("agpl-3.0", "GNU Affero General Public License, version 3.", ("affero", "general", "3")),
        ("bsd-2-clause", "BSD 2-Clause License.", ("bsd", "2", "clause")),
        ("bsd-3-clause", "BSD 3-Clause License.", ("bsd", "3", "clause")),
        ("mpl-2.0", "Mozilla Public License, version 2.0.", ("mozilla", "2", "0")),
    )
    out += [Template(name, start + rest, must) for name, rest, must in short for start in lead]
    for mark, name in (("GPL", "gpl"), ("LGPL", "lgpl"), ("AGPL", "agpl")):
        for version in ("2", "2.1", "3") if mark == "LGPL" else ("2", "3") if mark == "GPL" else ("3",):
            full = f"{name}-{version}" if "." in version else f"{name}-{version}.0"
            for form in (f"{mark} v{version}", f"{mark}v{version}", f"{mark} {version}", f"{mark} version {version}", f"{mark}-{version}"):
                out += [Template(full, f"{start}{form}", tuple(_words(form))) for start in ("under ", "under the ")]
    for mark in _SPDX:
        out.append(Template(mark.lower(), f"SPDX-License-Identifier: {mark}", tuple(_words(f"spdx identifier {mark}"))))
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("3.0", "4.0"):
            must = ("cc", *kind.lower().split("-"), *version.split("."))
            out += [Template(f"cc-{kind.lower()}-{version}", f"{start} CC {kind} {version}.", must) for start in ("Licensed under", "This work is licensed under")]
    return out


@dataclass(frozen=True)
class Settings:
    """differences: largest share of a template's words that may differ; gap: lines without a sign
    of a licence inside a block; long: words of a template that may run over lines; more: templates
    besides TEMPLATES, such as read_templates() gives."""

    differences: float = 0.10
    gap: int = 6
    long: int = 40
    level: int = 3
    more: tuple[Template, ...] = ()


TEMPLATES = tuple(_notices())
_SIGN = re.compile(r"licen[cs]|copyright|permission|redistribut|warrant|unencumbered|gpl", re.I | re.A)


class Library:
    """Templates with their words, and compressors primed with each."""

    def __init__(self, templates: tuple[Template, ...], level: int) -> None:
        plain = dict(level=level, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.templates = templates
        self.words = [_words(t.text) for t in templates]
        self.counts = [Counter(w) for w in self.words]
        self._plain = zstandard.ZstdCompressor(**plain)
        self._primed = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain) for t in templates]

    def saved(self, text: str, k: int) -> int:
        """Bytes by which template k in front makes the compressed text smaller."""
        data = text.encode()
        return len(self._plain.compress(data)) - len(self._primed[k].compress(data))


@cache
def library(templates: tuple[Template, ...], level: int) -> Library:
    """One for each worker process."""
    return Library(templates, level)


def blocks(text: str, gap: int) -> list[tuple[int, int]]:
    """Code-point spans of runs of lines that show signs of a licence, with at most gap lines between two signs, and gap lines around."""
    if not _SIGN.search(text):
        return []
    lines, starts, at = text.split("\n"), [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    runs: list[list[int]] = []
    for k in [k for k, line in enumerate(lines) if _SIGN.search(line)]:
        if runs and k - runs[-1][1] - 1 <= gap:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    out, end = [], 0
    for k, (first, last) in enumerate(runs):
        first = max(first - gap, end)
        end = min(last + gap + 1, runs[k + 1][0] if k + 1 < len(runs) else len(lines))
        out.append((starts[first], starts[end - 1] + len(lines[end - 1])))
    return out


def differences(block: list[str], template: list[str]) -> tuple[int, set[str], int, int]:
    """Words that differ between a template and the part of the block that matches it, the template's
    words that are missing, and the first and last matching word of the block."""
    same = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    # A stray short match far off is no part of the wording.
    while len(same) > 1 and same[0].size < 3 and same[1].a - same[0].a - same[0].size > 2 * same[0].size:
        same.pop(0)
    while len(same) > 1 and same[-1].size < 3 and same[-1].a - same[-2].a - same[-2].size > 2 * same[-1].size:
        same.pop()
    if not same:
        return len(template), set(template), 0, -1
    kept, last = sum(m.size for m in same), same[-1].a + same[-1].size - 1
    have = {w for m in same for w in block[m.a : m.a + m.size]}
    return max(len(template) - kept, last + 1 - same[0].a - kept), set(template) - have, same[0].a, last


def _windows(words: list[str], counts: Counter, size: int, most: int) -> Iterator[int]:
    """Starts of the windows of size + 2 * most words that hold all but most of a template's size words.
    Any match with at most most differences lies inside one of them."""
    have: Counter = Counter()
    shared = end = at = 0
    for start in range(0, max(1, len(words) - size + most + 1), most + 1):
        for w in words[at:start]:
            if w in counts:
                have[w] -= 1
                shared -= have[w] < counts[w]
        at = start
        for w in words[end : start + size + 2 * most]:
            if w in counts:
                shared += have[w] < counts[w]
                have[w] += 1
        end = max(end, min(len(words), start + size + 2 * most))
        if shared >= size - most:
            yield start


def judge(block: str, s: Settings = Settings(), least: int = 0) -> list[tuple[int, str, int, int]]:
    """(differences, name, start, end) of all confirmed matches in a block, by size reduction, greatest first;
    they may overlap; templates of least words or more."""
    held = library(TEMPLATES + s.more, s.level)
    places = [m.span() for m in _WORD.finditer(block)]
    words = _words(block)
    distinct, located = set(words), []
    for k, (t, want) in enumerate(zip(held.templates, held.words, strict=True)):
        if len(want) < least or not distinct.issuperset(t.must):
            continue
        most = int(s.differences * len(want) + 0.5)
        own = set()
        for at in _windows(words, held.counts[k], len(want), most):
            n, missing, first, last = differences(words[at : at + len(want) + 2 * most], want)
            if last >= first:
                own.add((n > most or bool(missing.intersection(t.must)), n, places[at + first][0], places[at + last][1]))
        # Windows that overlap see one place cut differently: the cut with the fewest differences is that place.
        taken: list[tuple[int, int]] = []
        located += [(k, *place) for place in sorted(own) if _free(taken, *place[2:])]
    ranked = sorted(located, key=lambda x: (-held.saved(block[x[3] : x[4]], x[0]), x[2], -len(held.words[x[0]]), held.templates[x[0]].name, x[3]))
    return [(n, held.templates[k].name, a, b) for k, refused, n, a, b in ranked if not refused]


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Takes (a, b) into the sorted list of spans if it overlaps none of them."""
    k = bisect_left(taken, (a, b))
    free = (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0])
    if free:
        taken.insert(k, (a, b))
    return free


def _take(text: str, start: int, end: int, s: Settings, least: int = 0) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, int]]]:
    """(name, start, end, differences) of the licences in text[start:end], the better of two that
    overlap, and the parts that hold none; parts around a licence are judged again."""
    out, rest, todo = [], [], [(start, end)]
    while todo:
        start, end = todo.pop()
        taken: list[tuple[int, int]] = []
        for n, name, x, y in judge(text[start:end], s, least) if _SIGN.search(text, start, end) else ():
            a, b = start + x, start + y
            if _free(taken, a, b):
                out.append((name, a, b, n))
        if taken:
            todo += [(a, b) for a, b in zip([start] + [y for _, y in taken], [x for x, _ in taken] + [end], strict=True) if a < b]
        else:
            rest.append((start, end))
    return out, rest


def scan(text: str, s: Settings = Settings()) -> list[tuple[str, int, int, int]]:
    """(name, start, end, differences): all long templates of each block of lines, and all of what other lines are left."""
    out = []
    for a, b in blocks(text, s.gap):
        whole, rest = _take(text, a, b, s, s.long)
        out += whole
        for at, last in rest:
            for line in text[at:last].split("\n"):
                out += _take(text, at, at + len(line), s)[0]
                at += len(line) + 1
    return sorted(out, key=lambda f: f[1])


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, found: array of (license, start, end, differences)) for every row of docs(doc_id, text)."""
    schema = "doc_id long, found array<struct<license:string,start:long,end:long,differences:int>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("differences", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("license", "start", "end", "differences"), x, strict=True)) for x in scan(t or "", settings)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, and found as license:start:end:differences joined by commas, in order of place."""
    found = find(common.table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"), f["differences"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), text.alias("found"))
