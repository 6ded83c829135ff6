"""Licence scans by a trained paragraph classifier.

A paragraph (a line with a word) is described by its sparse word n-grams (one to three words).  A
multinomial logistic regression, trained here on varied copies of public licence notices and on the
paragraphs of a bounded, hash-chosen sample of documents (`Scan.rows`, which is all the corpus that
training sees), tells the licence families and `none` apart.  Its probabilities are calibrated by a
temperature fitted on held-out variants; a paragraph that is likely a licence but of no family likely
enough is `unknown`.  A family is confirmed if enough of the paragraph's word pairs lie in one of the
family's notices or enough of a notice lies in the paragraph; what is not confirmed is `unknown` too.

Only paragraphs with a cue word are classified: any word of the notices that is no common word of
English, and at least one of every notice and of every n-gram that is licence enough by itself.
One pass, no shuffle; the model is a few thousand weights, whatever the corpus, and is kept for the
next scan of the same sample.

Defined results: null and empty texts have no paragraphs; very long texts and paragraphs are whole
(about 60 bytes of memory a byte of the longest text); repeated rows give repeated findings; adjacent
paragraphs of one family are one passage; other columns are not read.
"""

from __future__ import annotations

import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm.common import table
from wordtide.llm.textvec import WordTable, cached, chunks

#: Public notices: the sentences by which texts and programs name their licences.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "This project is licensed under the Apache-2.0 license.", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL v2 or later.", "Licensed under the GPL, version 2.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Released under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License.", "SPDX-License-Identifier: EPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "SPDX-License-Identifier: BSL-1.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Content is available under the Creative Commons Attribution License", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "all-rights-reserved": ("All rights reserved.", "Copyright (c) 2020 Example Corporation. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "This document is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Licences of no family above (they teach that there are others), and prose about licences (none).
OTHERS = ("Licensed under the Foo Public License, version 1.", "Released under the Artistic License.", "Licensed under the SIL Open Font License, Version 1.1.", "Distributed under the zlib license.", "This software is subject to the terms of the Example Vendor License Agreement.", "Licensed under the European Union Public Licence.", "Released under the PostgreSQL License.", "Licensed under the Python Software Foundation License.", "Use is subject to license terms.", "Licensed under the Educational Community License.")
PROSE = ("He lost his driving license last summer and had to take the bus.", "The committee discussed the copyright law for two hours.", "A fishing license costs ten dollars at the town hall.", "The museum has released a new version of its map under the old title.", "All of the rights and duties of members are listed in the statute.", "The restaurant was granted a license to sell wine.", "Public domain and general welfare were the topics of the debate.", "The terms of the agreement between the two cities remain open.", "The software was distributed to all schools free of charge.", "This work is for any person who wants to copy old paintings.", "Apache helicopters flew over the free city.", "The students of MIT released their results in common with the foundation.")

#: Words that any text uses: no cues, so most lines need no classifier.
COMMON = frozenset(
    "the of and to in is it be as at so we he by or on do if me my up an go no us am a i that have for not with you this but his from they say her she will one all would there their what out about who "
    "get which when make can like time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well "
    "way even new want because any these give day most are was were has had been may more such each both either under above below without within made see where here must shall should".split()
)

_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_HOLDERS = ("Example Corp", "the authors", "Jane Roe", "A. Nonymous and contributors", "The Project Team", "Universität Beispiel")


@dataclass(frozen=True)
class Scan:
    rows: int = 300  # documents of the corpus whose paragraphs teach what is no licence
    variants: int = 40  # of each notice
    family_p: float = 0.6
    licence_p: float = 0.7
    alike: float = 0.6


@dataclass
class Model:
    families: list[str]
    weights: dict[str, np.ndarray]  # by n-gram; a weight for each family, none, and other licences
    bias: np.ndarray
    temperature: float
    cues: frozenset[bytes]
    scan: Scan
    pairs: dict[str, list[frozenset]] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])] + [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])]


def _pairs(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w,) for w in words)


def _variant(notice: str, rnd: random.Random) -> str:
    w = notice.split()
    kind = rnd.random()
    if kind < 0.5 and len(w) > 6:
        w = [x for x in w if rnd.random() > 0.08]
    if kind > 0.8 and len(w) > 16:
        i = rnd.randrange(len(w) // 2)
        w = w[i : i + max(10, len(w) // 2)]
    t = " ".join(w)
    if rnd.random() < 0.2:
        t = f"Copyright (c) {rnd.randint(1995, 2025)} {rnd.choice(_HOLDERS)}. {t}"
    if rnd.random() < 0.2:
        t = rnd.choice(("# ", "// ", " * ", "Note: ", "> ")) + t
    return t.upper() if rnd.random() < 0.05 else t


_kept: dict[str, Model] = {}


def trained(ordinary: list[str], scan: Scan = Scan()) -> Model:
    """The model of these paragraphs, trained once in a driver."""
    key = xxhash.xxh3_128_hexdigest("\0".join([repr(scan), *ordinary]).encode("utf-8", "surrogatepass"))
    if key not in _kept:
        _kept.clear()
        _kept[key] = train(ordinary, scan)
    return _kept[key]


def train(ordinary: list[str], scan: Scan = Scan(), notices: dict[str, tuple[str, ...]] | None = None) -> Model:
    """A model from the notices and paragraphs of the corpus (licences among them are taken out by their words)."""
    rnd = random.Random(5)
    NOTICES = notices or globals()["NOTICES"]
    families = list(NOTICES)
    none, other = len(families), len(families) + 1
    own = {w for ns in NOTICES.values() for n in ns for w in words_of(n)} | {w for n in OTHERS for w in words_of(n)}
    strong = ("licen", "copyright", "gpl", "apache", "spdx", "redistribut")
    spoken = {w for w in own if any(k in w for k in strong)} | {"rights", "reserved"}
    every = [_pairs(words_of(n)) for ns in (*NOTICES.values(), OTHERS) for n in ns]

    def speaks(p: str) -> bool:
        """A notice, or likely one: it teaches neither what is ordinary nor how often words are."""
        if any(k in p.lower() for k in (*strong, "rights reserved")):
            return True
        mine = _pairs(words_of(p))
        return any(shared >= scan.alike * min(len(mine), len(t)) for t in every if (shared := len(mine & t)))

    plain = [p for p in dict.fromkeys(ordinary) if not speaks(p)]
    cues = {w for w in own if w not in COMMON and len(w) > 2} | spoken
    data: list[tuple[list[str], int]] = []
    for k, f in enumerate(families):
        for n in NOTICES[f]:
            data += [(grams(words_of(_variant(n, rnd))), k) for _ in range(scan.variants)]
    for n in OTHERS:
        data += [(grams(words_of(_variant(n, rnd))), other) for _ in range(scan.variants)]
    for n in PROSE:
        data += [(grams(words_of(_variant(n, rnd))), none) for _ in range(scan.variants)]
    data += [(grams(words_of(p)), none) for p in plain]
    rnd.shuffle(data)
    held, data = data[: len(data) // 5], data[len(data) // 5 :]
    names: dict[str, int] = {}
    counts: dict[str, int] = {}
    for gs, _ in data:
        for g in set(gs):
            counts[g] = counts.get(g, 0) + 1
    for g, c in counts.items():
        if c >= 4:
            names[g] = len(names)

    def rows(part):
        index = [sorted({names[g] for g in gs if g in names}) for gs, _ in part]
        at = np.cumsum([0] + [len(i) for i in index])
        flat = np.array([i for x in index for i in x], np.int64)
        value = np.concatenate([np.full(len(i), len(i) ** -0.5) for i in index if i]) if len(flat) else np.zeros(0)
        row = np.repeat(np.arange(len(part)), np.diff(at))
        return row, flat, value, np.array([y for _, y in part])

    classes = other + 1
    w, b = np.zeros((len(names), classes)), np.zeros(classes)
    row, col, val, y = rows(data)
    order = np.argsort(col, kind="stable")
    first = np.flatnonzero(np.diff(col[order], prepend=-1))

    def logits(row, col, val, n):
        z = np.tile(b, (n, 1))
        start = np.flatnonzero(np.diff(row, prepend=-1))
        if len(row):
            z[row[start]] += np.add.reduceat(w[col] * val[:, None], start, axis=0)
        return z

    def soft(z):
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    gw, gb = np.full(w.shape, 1e-8), np.full(classes, 1e-8)
    target = np.eye(classes)[y]
    for _ in range(200):  # Adagrad on the whole set
        d = (soft(logits(row, col, val, len(y))) - target) / len(y)
        g = np.zeros_like(w)
        g[col[order][first]] = np.add.reduceat(d[row[order]] * val[order][:, None], first, axis=0)
        g += 1e-6 * w
        gw += g * g
        gb += d.sum(axis=0) ** 2
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.5 * d.sum(axis=0) / np.sqrt(gb)
    row, col, val, y = rows(held)
    z = logits(row, col, val, len(y))
    grid = [0.25 * 1.15**i for i in range(24)]
    loss = [-np.log(np.maximum(soft(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    pairs = {f: [_pairs(words_of(n)) for n in NOTICES[f]] for f in families}
    # of every n-gram that by itself makes a licence a word is a cue, however common; so is one of every notice
    alone = soft((w + b) / grid[int(np.argmin(loss))])[:, none]
    for g in [g.split() for g, i in names.items() if 1 - alone[i] >= scan.licence_p] + [words_of(n) for ns in (*NOTICES.values(), OTHERS) for n in ns]:
        if not cues.intersection(g):
            cues.add(min(g, key=lambda x: (x in COMMON, -len(x), x)))
    return Model(families, {g: w[i] for g, i in names.items()}, b, grid[int(np.argmin(loss))], frozenset(c.encode() for c in cues), scan, pairs)


def classify(paragraph: str, m: Model) -> tuple[str, str | None, float, float]:
    """(label, best family, probability, likeness): label is a family, 'unknown' or 'none'."""
    words = words_of(paragraph)
    known = [m.weights[g] for g in set(grams(words)) if g in m.weights]
    if not known:
        return "none", None, 0.0, 0.0
    z = (m.bias + np.sum(known, axis=0) * len(known) ** -0.5) / m.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    n = len(m.families)
    k = int(np.argmax(p[:n]))
    own, best = _pairs(words), 0.0
    for t in m.pairs[m.families[k]]:
        shared = len(own & t)
        best = max(best, shared / max(len(own), 1), shared / len(t) if len(t) > 1 else 0.0)
    if 1 - p[n] < m.scan.licence_p:
        return "none", m.families[k], float(p[k]), best
    if p[k] >= m.scan.family_p and best >= m.scan.alike:
        return m.families[k], m.families[k], float(p[k]), best
    return "unknown", m.families[k], float(p[k]), best


FOUND = "doc_id long, first_line long, last_line long, label string, family string, probability double, likeness double"


def _cues(m: Model) -> WordTable:
    cue = lambda w: any(x.encode() in m.cues for x in words_of(w.decode("utf-8", "replace")))
    return cached(("licences", m.key), lambda: WordTable(lambda ws: (np.array([cue(w) for w in ws], bool), np.ones(len(ws), np.int32))))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        known, told = _cues(m), {}
        for b in batches:
            ids, out = b.column("doc_id"), []
            for c in chunks(b.column("text")):
                u = c.words()
                if not len(u.hash):
                    continue
                flat, start, _, word = known.of(u)
                hits = np.flatnonzero(flat[start][word])
                breaks = np.flatnonzero(c.data == 10)
                begin = np.unique(np.concatenate((c.offsets[:-1], breaks + 1)))
                lines = np.unique(np.searchsorted(begin, u.starts[hits], side="right") - 1)
                first_line = np.searchsorted(begin, c.offsets[:-1])
                end = np.append(begin[1:], len(c.data))
                text = np.searchsorted(c.offsets, begin[lines], side="right") - 1
                for i, t in zip(lines.tolist(), text.tolist()):
                    raw = c.data[begin[i] : end[i]].tobytes()
                    if raw not in told:
                        if len(told) > 50_000:
                            told.clear()
                        told[raw] = classify(raw.decode("utf-8", "replace"), m)
                    label, family, p, like = told[raw]
                    if label == "none":
                        continue
                    doc, line = ids[c.first + t].as_py(), i - int(first_line[t])
                    if out and out[-1][7] == c.first + t and out[-1][3] == label and out[-1][2] == line - 1:
                        out[-1] = (*out[-1][:2], line, *out[-1][3:5], max(out[-1][5], p), max(out[-1][6], like), out[-1][7])
                    else:
                        out.append((doc, line, line, label, family, p, like, c.first + t))
            cols = list(zip(*out))[:7] or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, types)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def scan(spark: SparkSession, docs: DataFrame, settings: Scan = Scan()) -> DataFrame:
    """FOUND: every licence passage of docs (doc_id, text), with the lines it spans (from 0)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = docs.filter("text IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows)
    taught = docs.join(F.broadcast(some.distinct()), "doc_id").select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(settings.rows)
    model = trained([p for r in taught.toLocalIterator() for p in r.text.split("\n") if p.strip()], settings)
    return docs.mapInArrow(_scan(spark.sparkContext.broadcast(model)), FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
