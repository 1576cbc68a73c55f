"""License scans by conditional compression.

Candidate blocks are runs of lines that use the vocabulary of license notices and hold at least one
strong cue; a cue inside a longer prose line gives the long notice that stands there, or else the words
around it. Each block is compressed
alone and with every template as a raw Zstandard dictionary; templates are ranked by how much they
shrink the block, and the leaders, with all others that could still be confirmed, are confirmed by the exact
words missing from or added to the template. Words that tell licenses apart (names, versions, "only", "later") have to agree
exactly. Of several notices in one block each is confirmed by itself; blank lines and lines that name a holder do not end a block.

A text without a cue is left out by a regular expression in the scan, before any Python.

Defined results: null and empty texts and empty tables give no row; texts are read whole, whatever their length; of
templates that are equally near the better ranked wins; a block that no template confirms is returned with
verdict "unknown"; a repeated document row gives its rows again; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording of public license texts.
_WARRANTY = "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_END = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{stop} either version {v} of the License, or (at your option) any later version."
#: Families with the names of their kinds, and the versions of each.
GNU = [("GPL", "", ("1", "2", "3")), ("LGPL", "Library ", ("2",)), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))]
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}


def _gnu() -> Iterator[tuple[str, str]]:
    for family, kind, versions in GNU:
        for v in versions:
            name = f"{family}-{v if '.' in v else v + '.0'}"
            for said in ("This work is licensed under", "Licensed under"):
                yield f"{name}-only", f"{said} the GNU {kind}General Public License, version {v}."
                yield f"{name}-only", f"{said} the GNU {kind}General Public License, version {v} only."
                yield f"{name}-or-later", f"{said} the GNU {kind}General Public License, version {v} or later."
            for mark, stop in ((":", ","), (";", ";")):
                for thing in ("program", "library") if family == "LGPL" else ("program",):
                    yield f"{name}-or-later", _GNU.format(thing=thing, mark=mark, stop=stop, kind=kind, v=v)


#: Public license notices and texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    *((name, f"{said} under the {name} License.") for name in ("MIT", "ISC") for said in ("Released", "Licensed")),
    ("MIT", f"{_MIT}."),
    ("MIT", f"{_MIT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING {_WARRANTY}"),
    *((f"Apache-{v}", f"{said} under the Apache License, Version {v}.") for v in ("2.0", "1.1", "1.0") for said in ("Licensed", "Released")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_END),
    *_gnu(),
    *((f"BSD-{n}-Clause", f"{said} under the {n}-Clause BSD License.") for n in (2, 3) for said in ("Released", "Licensed")),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"MPL-{v}", f"Licensed under the Mozilla Public License, version {v}.") for v in ("2.0", "1.1", "1.0")),
    *((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {name} {v} {PORTS[v]} License.") for kind, name in CREATIVE.items() for v in PORTS),
    *((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.") for kind in CREATIVE for v in PORTS),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("ISC", f"{_ISC}."),
    ("ISC", _ISC + _ISC_END),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
]
# The tag of each of them.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in TEMPLATES) if name != "proprietary"]

#: Words that tell licenses apart: they, and all version numbers, have to agree exactly.
NAMES = frozenset("mit apache bsd isc gnu gpl lgpl agpl lesser library affero mozilla mpl eclipse epl cddl artistic boost zlib cc cc0 sa nc nd attribution sharealike noncommercial noderivatives noderivs only later neither endorse spdx unported generic".split())
#: Words after a GNU notice or a tag that change what it says, and how far after it they stand.
AFTER, NEAR = frozenset(("only", "later", "or", "and", "with")), 3
#: A text or line without one of these is never a license block.
CUE = r"(?i)licen[sc]e|spdx|copyright|all rights reserved|public domain|redistribut|permission is hereby|permission to use|cc0"
#: Share of a line's words known to the templates, words kept around a cue in a prose line, words of difference allowed.
LINE_SHARE, AROUND, MAX_DIFFERENCE, CONFIRM = 0.7, 16, 0.25, 3
BLOCK_SCHEMA = "doc_id long, block_no int, first_line int, last_line int, license_id string, reduction double, n_missing int, n_added int, missing string, added string, verdict string, block string"
_BLOCK = pa.schema([("doc_id", pa.int64()), ("block_no", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("license_id", pa.string()), ("reduction", pa.float64()), ("n_missing", pa.int32()), ("n_added", pa.int32()), ("missing", pa.string()), ("added", pa.string()), ("verdict", pa.string()), ("block", pa.string())])
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_CUE = re.compile(CUE)
#: A line that names a copyright holder, and blank lines that do not end a notice.
_HOLDER, BLANKS = re.compile(r"(?i)\W*(?:copyright|\(c\)|©)"), 2


def words(text: str) -> list[str]:
    """Lower-case words, in which version numbers stay whole."""
    return _WORD.findall(text.lower())


@cache
def _vocabulary() -> frozenset[str]:
    return frozenset(w for _, t in TEMPLATES for w in words(t))


@cache
def _long() -> list[tuple[list[str], Counter]]:
    """Templates that the words kept around a cue may cut: their words, in order and counted."""
    found = [words(t) for _, t in TEMPLATES]
    return [(w, Counter(w)) for w in found if len(w) > AROUND]


@cache
def _words() -> list[list[str]]:
    return [words(t) for _, t in TEMPLATES]


@cache
def _counted() -> list[Counter]:
    return list(map(Counter, _words()))


@cache
def _compressors() -> list:
    plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_dict_id=False)
    out = [plain]
    for _, text in TEMPLATES:
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_dict_id=False))
    return out


def blocks(text: str) -> list[tuple[int, int, str]]:
    """Candidate blocks (first line, last line, words of the block as text)."""
    out, run = [], []

    def close():
        if run and any(_CUE.search(line) for _, line in run):
            out.append((run[0][0], run[-1][0], " ".join(line for _, line in run)))
        run.clear()

    for n, line in enumerate(text.split("\n")):
        found = words(line)
        known = sum(w in _vocabulary() for w in found)
        if found and (known >= LINE_SHARE * len(found) or len(found) <= AROUND and _HOLDER.match(line)):
            run.append((n, line))
            continue
        if not found and run and n - run[-1][0] <= BLANKS:
            continue  # a notice goes on after a blank line
        close()
        last = floor = 0
        for cue in _CUE.finditer(line):
            if cue.start() < last:
                continue
            notice = long_notice(line, floor, cue.start())
            if notice and notice[0] <= cue.start():
                out.append((n, n, line[slice(*notice)]))
                last = floor = notice[1]
                if cue.start() < last:
                    continue
                notice = None
            # A notice that only begins after the cue has cues of its own.
            end = notice[0] if notice else len(line)
            before, after = line[floor : cue.start()].split(), line[cue.start() : end].split()
            piece = " ".join(before[-AROUND:] + after[:AROUND])
            last = min(end, cue.start() + len(" ".join(after[:AROUND])))
            out.append((n, n, piece))
    close()
    return sorted(out)


def long_notice(line: str, floor: int, at: int) -> tuple[int, int] | None:
    """Where a notice after the form of a long template stands around place ``at`` of a line, not before ``floor``."""
    reach = int((1 + MAX_DIFFERENCE) * max(len(w) for w, _ in _long())) + 1
    before, after = list(_WORD.finditer(line, floor, at)), list(islice(_WORD.finditer(line, at), reach))
    around = before[-reach:] + after
    text = [w.group().lower() for w in around]
    count, best = Counter(text), None
    for template, own in _long():
        allowed = MAX_DIFFERENCE * len(template)
        if len(template) - (own & count).total() > allowed:
            continue
        runs = [r for r in difflib.SequenceMatcher(None, template, text, autojunk=False).get_matching_blocks() if r.size]
        # Words of the prose far from the notice are no part of it.
        gap = lambda x, y: y.b - x.b - x.size - max(0, y.a - x.a - x.size)
        while len(runs) > 1 and gap(runs[0], runs[1]) > runs[0].size:
            runs.pop(0)
        while len(runs) > 1 and gap(runs[-2], runs[-1]) > runs[-1].size:
            runs.pop()
        shared = sum(r.size for r in runs)
        lo, hi = runs[0].b, runs[-1].b + runs[-1].size
        n = max(len(template) - shared, hi - lo - shared)
        if n <= allowed and (best is None or (-shared, n) < best[0]):
            best = (-shared, n), around[lo].start(), around[hi - 1].end()
    return best and best[1:]


def rank(block: str) -> list[tuple[float, int]]:
    """(size reduction, template) of each template, best first; ties go to the earlier template."""
    data = block.lower().encode()
    plain, *conditional = _compressors()
    alone = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / alone, i) for i, c in enumerate(conditional)), key=lambda x: (-x[0], x[1]))


def differences(block: str, template: str) -> tuple[list[str], list[str]]:
    """Template words missing from the block, and block words added between its first and last shared word."""
    return compare(words(block), words(template))[:2]


def compare(b: list[str], a: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of template ``a`` that ``b`` lacks, words it adds between the first and the last shared one, and where these stand."""
    ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    missing = [w for tag, i, j, _, _ in ops if tag in ("delete", "replace") for w in a[i:j]]
    inner = [k for k, op in enumerate(ops) if op[0] == "equal"]
    added = [w for k, (tag, _, _, i, j) in enumerate(ops) if tag in ("insert", "replace") and inner and inner[0] < k < inner[-1] for w in b[i:j]]
    return missing, added, ops[inner[0]][3] if inner else 0, ops[inner[-1]][4] if inner else 0


def telling(word: str) -> bool:
    """Whether a word tells licenses apart: a name, or a number that is no year."""
    return word in NAMES or (any(c.isdigit() for c in word) and not re.fullmatch(r"(?:19|20)\d\d", word))


def conflict(template: list[str], missing: list[str], added: list[str], after: list[str]) -> bool:
    """Whether a difference is in a telling word, or what follows changes the terms."""
    tied = "gnu" in template or "spdx" in template
    return any(map(telling, missing)) or any(map(telling, added)) or tied and not AFTER.isdisjoint(after[:NEAR]) and any(map(telling, after[:NEAR]))


def judge(block: str) -> tuple:
    """(license_id, reduction, missing, added, verdict) of a block."""
    return best_fit(words(block), block)[:5]


def best_fit(found: list[str], block: str) -> tuple:
    """What ``judge`` gives, and the first and the end of the words that the template covers.

    The leaders are compared with the block word for word, and so is each template further down that holds
    words enough of it to be confirmed. A template is confirmed if its telling words agree and few others differ; of the
    confirmed ones that which covers most words wins, then the nearest; without one, the nearest leader is shown.
    """
    best = None
    order = rank(block)
    count = Counter(found)
    for reduction, i in order:
        template = _counted()[i]
        allowed = MAX_DIFFERENCE * template.total()
        # Templates that tie with the last leader are leaders as well.
        if reduction < order[CONFIRM - 1][0] and template.total() - (template & count).total() > allowed:
            continue
        own = _words()[i]
        missing, added, first, end = compare(found, own)
        n = max(len(missing), len(added))  # a changed word counts once
        beyond = n > allowed or conflict(own, missing, added, found[end:])
        key = (beyond, n, 0) if beyond else (beyond, len(missing) - len(own), n)
        if best is None or key < best[0]:
            best = key, i, reduction, missing, added, first, end
    key, i, reduction, missing, added, first, end = best
    n = max(len(missing), len(added))
    verdict = "unknown" if key[0] else "exact" if n == 0 else "variant"
    return TEMPLATES[i][0] if verdict != "unknown" else None, reduction, missing, added, verdict, first, end


def judgements(block: str) -> list[tuple]:
    """What a block says: its best notice, and those confirmed in the words before and after it; (judgement, text) of each."""
    places = list(_WORD.finditer(block.lower()))
    *said, first, end = best_fit([w.group() for w in places], block)
    if said[4] == "unknown":
        return [(tuple(said), block)]
    out = [(tuple(said), block)]
    for text in (block[: places[first].start()], block[places[end - 1].end() :]):
        if len(words(text)) > 2 and _CUE.search(text):
            out += [x for x in judgements(text) if x[0][4] != "unknown"]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each candidate block of each document, with its judgement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                no = 0
                for first, last, block in blocks(text):
                    if block not in memo:
                        if len(memo) > 20_000:
                            memo.clear()
                        memo[block] = judgements(block)
                    for (license_id, reduction, missing, added, verdict), piece in memo[block]:
                        rows.append((doc_id, no, first, last, license_id, reduction, len(missing), len(added), " ".join(missing), " ".join(added), verdict, piece))
                        no += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _BLOCK, strict=True)], schema=_BLOCK)

    source = docs.where(F.col(text_col).rlike(CUE)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, BLOCK_SCHEMA)


def op7_license_compression(spark, sf_dir: str) -> DataFrame:
    """License blocks of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
