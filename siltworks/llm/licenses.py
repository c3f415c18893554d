"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Units are the whole text (licence files), a text's lines, its windows of 2 to WINDOW adjacent lines (wrapped headers,
wherever they stand; lines without a term are passed over) and its longer paragraphs. Document frequencies of all
terms are counted over all texts: the templates' by themselves, the others in SLOTS slots by their hash, so that their table
has a fixed size (terms that meet in a slot weigh as one that all their texts have). A unit whose
template terms alone can't carry the threshold is ruled out by its norm before any cosine is taken, and a window by its
lines: its product with a template is the sum of theirs, its norm at least the root of the sum of their squares.

An SPDX tag names its licence itself: it's read, not compared, and goes before what is compared.

Files without a licence of their own take that of the nearest directory above that declares one: the
directories above each distinct directory are joined with the declaring ones by path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_table, slices, stash, word_hash, words

THRESHOLD = 0.7
#: Slots in which terms are counted that no template has.
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Parts to which a directory's files are dealt.
PARTS = 16
#: Lines of the longest window, and how many lines, products or terms of windows are held at once.
WINDOW, BLOCK_LINES, BLOCK_TERMS = 32, 20_000, 1 << 18
#: Names of files that speak for their directory.
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
_SPDX = re.compile(rb"spdx-license-identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9][a-z0-9.+-]*\)*)*)", re.I)
#: Customary statements of public licences, by SPDX identifier.
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("ISC", "Released under the ISC License."),
    ("Proprietary", "All rights reserved."),
)
#: Titles of licence files and the headers that the licences themselves recommend.
HEADERS = (
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, f"GNU {kind} {version}") for name, kind, version in (
        ("GPL-1.0", "GENERAL PUBLIC LICENSE", "Version 1, February 1989"), ("GPL-2.0", "GENERAL PUBLIC LICENSE", "Version 2, June 1991"), ("GPL-3.0", "GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"),
        ("LGPL-2.0", "LIBRARY GENERAL PUBLIC LICENSE", "Version 2, June 1991"), ("LGPL-2.1", "LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999"), ("LGPL-3.0", "LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"),
        ("AGPL-3.0", "AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"), ("GFDL-1.2", "Free Documentation License", "Version 1.2, November 2002"), ("GFDL-1.3", "Free Documentation License", "Version 1.3, 3 November 2008"))),
    *((name, f"{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this {what}. If not, see http://www.gnu.org/licenses/.") for name, it, what, kind, version in (
        ("GPL-2.0", "This program", "program", "General Public License", "2"), ("GPL-3.0", "This program", "program", "General Public License", "3"), ("AGPL-3.0", "This program", "program", "Affero General Public License", "3"),
        ("LGPL-2.1", "This library", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "This library", "library", "Lesser General Public License", "3"))),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *((f"CC-{code}-4.0", f"Creative Commons {name} 4.0 International Public License") for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"))),
)
#: Identifiers of the texts in license_texts/, one whole licence a file.
FULL_TEXTS = ("Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")


def _full_texts() -> tuple[tuple[str, str], ...]:
    """The whole licences; the AGPL's is the GPL's with the names changed, as the two share all but the preamble and a section."""
    folder = resources.files(__package__) / "license_texts"
    texts = {name: (folder / f"{name}.txt").read_text("utf-8") for name in FULL_TEXTS}
    affero = re.sub(r"(?i)GNU (Affero )?General Public License", "GNU Affero General Public License", texts["GPL-3.0"])
    return (*texts.items(), ("AGPL-3.0", affero))


TEMPLATES = (*STATEMENTS, *HEADERS, *_full_texts())
#: Stands only where nothing else does: licences that grant rights have the sentence as well.
WEAK = "Proprietary"
_OTHER = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0xFF))


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of each run of ASCII letters and digits, and offsets of the rows in them."""
    low = LOWER[data]
    starts, ends, row = words(low, offs, _OTHER)
    return word_hash(low, starts, ends), starts, row


class Terms:
    """The templates' terms, their counts in each template, and the number of a token: of its term, or of its slot after all terms."""

    def __init__(self, templates):
        with np.errstate(over="ignore"):
            tokens = [_tokens(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0] for _, t in templates]
        self.names = [n for n, _ in templates]
        self.keys = np.unique(np.concatenate(tokens))
        self.counts = np.array([np.bincount(np.searchsorted(self.keys, t), minlength=len(self.keys)) for t in tokens], dtype=np.float64)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, at, len(self.keys) + (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64))


def _frequencies(templates):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        terms = Terms(templates)
        size = len(terms.keys) + SLOTS
        total, rows = np.zeros(size, dtype=np.int64), 0
        for batch, data, offs in slices(batches):
            tokens, _, row = _tokens(data, offs)
            term = terms.find(tokens)
            of = np.repeat(np.arange(batch.num_rows), np.diff(row))
            total += np.bincount(np.unique(of * size + term) % size, minlength=size)
            rows += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used)), pa.array(np.append(rows, total[used]))], names=["term", "df"])

    return kernel


def _units(terms: Terms, weight: np.ndarray, vectors: np.ndarray, unit: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, template, cosine) of the best template of each unit that reaches the threshold."""
    v = len(terms.keys)
    pair, tf = np.unique(unit * len(weight) + term, return_counts=True)
    u, t = np.divmod(pair, len(weight))
    x = tf * weight[t]
    known = t < v
    inside = np.bincount(u[known], weights=x[known] ** 2, minlength=n)
    norm = np.bincount(u, weights=x * x, minlength=n)
    may = (inside >= threshold**2 * norm) & (inside > 0)
    which = np.flatnonzero(may)
    if not len(which):
        return which, which, np.zeros(0)
    keep = may[u] & known
    cos = _products((np.cumsum(may) - 1)[u[keep]], t[keep], x[keep], vectors, len(which)) / np.sqrt(norm[which])[:, None]
    best = np.argmax(cos, axis=1)
    score = cos[np.arange(len(which)), best]
    good = score >= threshold
    return which[good], best[good], score[good]


def _products(u: np.ndarray, t: np.ndarray, x: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The product of each of n units with each template, from values x at (unit, term) in the order of units."""
    out = np.zeros((n, len(vectors)))
    columns = np.ascontiguousarray(vectors.T)
    step = max(1, BLOCK_TERMS * 4 // len(vectors))
    for lo in range(0, len(u), step):
        part = u[lo : lo + step]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out[part[first]] += np.add.reduceat(columns[t[lo : lo + step]] * x[lo : lo + step, None], first, axis=0)
    return out


def _blocks(terms: Terms, weight: np.ndarray, vectors: np.ndarray, line: np.ndarray, term: np.ndarray, row_of_line: np.ndarray, done: np.ndarray, threshold: float):
    """(row, template, cosine) of windows of 2 to WINDOW adjacent lines, and of longer paragraphs, that reach the threshold; rows that are done are left out."""
    wanted = ~done[row_of_line[line]]
    line, term = line[wanted], term[wanted]
    number, first = np.unique(line, return_index=True)  # the lines that have terms
    stop = np.append(first[1:], len(line))
    row = row_of_line[number]
    turn = np.append(True, (number[1:] != number[:-1] + 1) | (row[1:] != row[:-1])) if len(number) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(turn)
    end = np.append(begin[1:], len(number))[: len(begin)]
    long = end - begin > WINDOW
    units = [np.stack((begin[long], end[long]), axis=1)]
    v = len(terms.keys)
    for lo in range(0, len(number), BLOCK_LINES):
        hi = min(lo + BLOCK_LINES + WINDOW - 1, len(number))
        of, at = np.repeat(np.arange(hi - lo), (stop - first)[lo:hi]), term[first[lo] : stop[hi - 1]]
        pair, tf = np.unique(of * len(weight) + at, return_counts=True)
        u, t = np.divmod(pair, len(weight))
        x = tf * weight[t]
        square = np.bincount(u, weights=x * x, minlength=hi - lo)
        product = _products(u[t < v], t[t < v], x[t < v], vectors, hi - lo)
        norm = np.append(0, np.cumsum(square))
        near = np.append(0, np.cumsum((product**2).max(axis=1) / square))
        total = np.concatenate((np.zeros((1, len(vectors))), np.cumsum(product, axis=0)))
        for n in range(2, min(WINDOW, hi - lo) + 1):
            i = np.arange(min(BLOCK_LINES, hi - lo - n + 1))
            # the squared cosines of a window's lines add up to the square of its own, at least
            i = i[(near[i + n] - near[i] >= threshold**2 - 1e-6) & (row[lo + i] == row[lo + i + n - 1])]
            reach = (total[i + n] - total[i]).max(axis=1, initial=0.0) if len(i) else np.zeros(0)
            i = i[reach >= (threshold - 1e-6) * np.sqrt(norm[i + n] - norm[i])]
            units.append(np.stack((lo + i, lo + i + n), axis=1))
    units = np.concatenate(units)
    size = stop[units[:, 1] - 1] - first[units[:, 0]] if len(units) else np.zeros(0, dtype=np.int64)
    batch = np.cumsum(size) // BLOCK_TERMS
    for part in np.split(np.arange(len(units)), np.flatnonzero(np.diff(batch)) + 1):
        if not len(part):
            continue
        long_ = size[part]
        of = np.repeat(np.arange(len(part)), long_)
        inside = np.arange(int(long_.sum())) - np.repeat(np.cumsum(long_) - long_, long_)
        at = term[np.repeat(first[units[part, 0]], long_) + inside]
        u, t, s = _units(terms, weight, vectors, of, at, len(part), threshold)
        yield row[units[part[u], 0]], t, s


def _tags(data: np.ndarray, offs: np.ndarray) -> dict[int, str]:
    """Row -> what its first SPDX tag declares; operators are upper-case."""
    raw, out = data.tobytes(), {}
    for m in _SPDX.finditer(raw):
        row = int(np.searchsorted(offs, m.start(), side="right")) - 1
        m = _SPDX.match(raw, m.start(), int(offs[row + 1]))
        if m and row not in out:
            out[row] = " ".join(w.upper() if w.lower() in ("and", "or", "with") else w for w in m[1].decode().rstrip("-").split())
    return out


def _matches(templates, weights, threshold: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        terms, weight = Terms(templates), weights.value
        vectors = terms.counts * weight[: len(terms.keys)]
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        weak = np.array([n == WEAK for n in terms.names])

        def settle(best: np.ndarray, score: np.ndarray, rows: np.ndarray, t: np.ndarray, s: np.ndarray) -> None:
            """Put in the nearest template of each row, of equal ones the first; a weak one only where there's no other."""
            for i, k, x in zip(rows.tolist(), t.tolist(), s.tolist(), strict=True):
                held = best[i]
                if held < 0 or weak[k] < weak[held] or (weak[k] == weak[held] and (x > score[i] + 1e-9 or (k < held and x > score[i] - 1e-9))):
                    best[i], score[i] = k, x

        for batch, data, offs in slices(batches):
            tokens, starts, row = _tokens(data, offs)
            term = terms.find(tokens)
            of = np.repeat(np.arange(batch.num_rows), np.diff(row))
            # lines are counted over all rows; a row starts one, too
            border = np.union1d(np.flatnonzero(data == 10), offs[:-1][offs[:-1] < len(data)])
            line = np.searchsorted(border, starts, side="right")
            best = np.full(batch.num_rows, -1)
            score, whole = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
            row_of_line = np.zeros(len(border) + 1, dtype=np.int64)
            row_of_line[line] = of
            for is_whole, unit, n, to_row in ((True, of, batch.num_rows, np.arange(batch.num_rows)), (False, line, len(border) + 1, row_of_line)):
                u, t, s = _units(terms, weight, vectors, unit, term, n, threshold)
                whole[to_row[u]] |= is_whole
                settle(best, score, to_row[u], t, s)
            tags = _tags(data, offs)
            done = (best >= 0) & ~weak[best] & (score >= 1 - 1e-12)
            done[list(tags)] = True
            wide, wide_score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for rows, t, s in _blocks(terms, weight, vectors, line, term, row_of_line, done, threshold):
                settle(wide, wide_score, rows, t, s)
            nearer = (wide >= 0) & ((best < 0) | (weak[wide] < weak[best]) | ((weak[wide] == weak[best]) & (wide_score > score + 1e-9)))
            best, score = np.where(nearer, wide, best), np.where(nearer, wide_score, score)
            names = [terms.names[b] if b >= 0 else None for b in best.tolist()]
            score = np.where(best >= 0, score, 0.0)
            for i, name in tags.items():
                names[i], score[i] = name, 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(whole)], names=["doc_id", "path", "own_license", "score", "whole"])

    return kernel


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, headers_declare: bool = False) -> DataFrame:
    """files (doc_id, path, text, ...) -> doc_id, path, own_license, score, license, declared_in; one row per input row.

    ``own_license``: what the first SPDX tag says, with score 1; else the identifier of the template that some line, block of
    lines, or the whole text, is nearest to, if the cosine reaches ``threshold`` (of equal ones the first template; a block only where it's nearer than the
    text and all lines; WEAK only if no other does). ``license``: that, or the one that the nearest directory above declares, in
    ``declared_in``. A directory declares the licence of the file right in it that scores highest (of equal ones the
    smallest doc_id) among those whose name says so (LICENSE_NAME) or whose whole text is a licence; with
    ``headers_declare`` among all with a licence. Null or empty texts have none; a null path is in no directory.
    """
    text = files.select("doc_id", "path", "text")
    counted = text.mapInArrow(_frequencies(templates), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most a row for each slot and term of the templates
    df = np.zeros(1 + len(Terms(templates).keys) + SLOTS)  # the first: of all texts
    df[counted["term"].to_numpy() + 1] = counted["df"].to_numpy()
    weights = files.sparkSession.sparkContext.broadcast(1 + np.log((1 + df[0]) / (1 + df[1:])))
    kind = files.schema["doc_id"].dataType.simpleString()
    # written, as three plans read it
    own = stash(text.mapInArrow(_matches(templates, weights, threshold), f"doc_id {kind}, path string, own_license string, score double, whole boolean")).withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), "")))
    speaks = F.lit(True) if headers_declare else F.col("whole") | F.col("path").rlike(LICENSE_NAME)
    declared = own.where(F.col("own_license").isNotNull() & F.col("dir").isNotNull() & speaks).groupBy("dir").agg(F.min_by("own_license", F.struct(-F.round("score", 9), F.col("doc_id"), F.col("own_license"))).alias("dir_license"))
    needy = own.where("own_license is null and dir is not null").select("dir").distinct()
    labels = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda i: F.array_join(F.slice(labels, 1, i), "/"))
    ancestors = needy.select("dir", F.posexplode(above).alias("depth", "up"))
    nearest = ancestors.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("dir_license", "up"), "depth").alias("got"))
    # a directory may hold a third of all files: its rows are dealt to parts, and what it inherits is sent to each
    every = nearest.select("dir", "got", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    needs = F.when(F.col("own_license").isNull(), F.col("dir"))  # the others have nothing to look for
    joined = own.withColumn("own_part", F.pmod(F.xxhash64("doc_id", "path"), F.lit(PARTS)).cast("int")).join(every.withColumnRenamed("dir", "of"), (needs == F.col("of")) & (F.col("own_part") == F.col("part")), "left")
    inherits = F.col("own_license").isNull()
    return joined.select("doc_id", "path", "own_license", "score", F.when(inherits, F.col("got.dir_license")).otherwise(F.col("own_license")).alias("license"), F.when(inherits, F.col("got.up")).alias("declared_in"))
