"""Licence scans by a trained paragraph classifier.

A paragraph is a line, or several lines of a block without blank ones that make a wrapped notice. A sparse multinomial logistic regression over its word 1-, 2- and 3-grams tells licence
families and a class of none; it is trained here on the templates below, varied, and on a bounded sample of the
corpus' own lines. Its chances are calibrated by a temperature on held-out rows of families that were seen and
of families that were not, which should be none; a family is predicted only at a chance of `sure` or more: what falls
between is unknown. A prediction counts once one of the family's templates confirms it by the share of its word pairs
that the paragraph has, unless the paragraph denies the licence, or names another version or a word of another family.
A line that states several licences (a tag such as `License: MIT OR Apache-2.0`, or `under either of A or B`) is also
judged as one short statement for each of them, by the same classifier and templates.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

WORD = re.compile(r"[^\W_]+")

# Paragraphs and sentences by which licences announce themselves.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU_COPY = "You should have received a copy of the GNU {}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
UNDER = "This work is licensed under the {}."
RELEASED = "Released under the {}."
SPDX = "SPDX-License-Identifier: {}"
LICENSED = "Licensed under the {}."
CREATIVE = "This work is licensed under a Creative Commons {} 4.0 International License."


def gnu(name: str, short: str, version: str, tags: str) -> tuple[str, ...]:
    texts = (GNU.format(name, version), GNU_COPY.format(name), GNU_WARRANTY.format(name), UNDER.format(f"GNU {name}General Public License, version {version}"), f"Licensed under the {short}.")
    return texts + tuple(SPDX.format(t) for t in tags.split())


TEMPLATES = {
    "AGPL": gnu("Affero ", "AGPL", "3", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        SPDX.format("Apache-2.0"),
    ),
    "Artistic-2.0": ("This is free software; you may redistribute it under the terms of the Artistic License 2.0.", RELEASED.format("Artistic License, version 2.0"), SPDX.format("Artistic-2.0")),
    "BSD": (
        RELEASED.format("BSD License"),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        SPDX.format("BSD-3-Clause"),
        SPDX.format("BSD-2-Clause"),
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "Distributed under the Boost Software License, Version 1.0.", SPDX.format("BSL-1.0")),
    "CC-BY": ("Licensed under CC BY 4.0.", CREATIVE.format("Attribution"), SPDX.format("CC-BY-4.0")),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", CREATIVE.format("Attribution-NonCommercial"), SPDX.format("CC-BY-NC-4.0")),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", CREATIVE.format("Attribution-ShareAlike"), SPDX.format("CC-BY-SA-4.0")),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", SPDX.format("CC0-1.0")),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", RELEASED.format("Eclipse Public License, version 2.0"), SPDX.format("EPL-2.0")),
    "GPL": (
        *gnu("", "GPL", "3", "GPL-2.0 GPL-3.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later"),
        GNU.format("", "2"),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", RELEASED.format("ISC License"), SPDX.format("ISC")),
    "LGPL": (*gnu("Lesser ", "LGPL", "3", "LGPL-2.1 LGPL-3.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later"), GNU.replace("program", "library").format("Lesser ", "2.1")),
    "MIT": (
        RELEASED.format("MIT License"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
        SPDX.format("MIT"),
    ),
    "MPL-2.0": (
        RELEASED.format("Mozilla Public License, version 2.0"),
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        SPDX.format("MPL-2.0"),
    ),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice appear in all copies.", RELEASED.format("PostgreSQL License"), SPDX.format("PostgreSQL")),
    "Python-2.0": ("Licensed to the Python Software Foundation under a Contributor Agreement.", RELEASED.format("Python Software Foundation License, version 2"), SPDX.format("PSF-2.0")),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", SPDX.format("Unlicense")),
    "WTFPL": ("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License.", SPDX.format("WTFPL")),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", RELEASED.format("zlib License"), SPDX.format("Zlib")),
}
# Names by which statements call the families, after LICENSED.
SHORT = {
    "AGPL": ("AGPL v3",),
    "Apache-2.0": ("Apache 2.0", "Apache License"),
    "Artistic-2.0": ("Artistic License",),
    "BSD": ("BSD",),
    "BSL-1.0": ("Boost Software License",),
    "EPL-2.0": ("Eclipse Public License", "EPL 2.0"),
    "GPL": ("GPL", "GPL v2", "GPL v3"),
    "ISC": ("ISC",),
    "LGPL": ("LGPL", "LGPL v3"),
    "MIT": ("MIT",),
    "MPL-2.0": ("Mozilla Public License", "MPL 2.0"),
    "PostgreSQL": ("PostgreSQL License",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "Zlib": ("zlib",),
}
TEMPLATES = {f: (*ts, *(LICENSED.format(x) for x in SHORT.get(f, ()))) for f, ts in TEMPLATES.items()}
# A template that has such words of its family confirms only texts that have one of them too.
NAMES = {
    "AGPL": {"affero", "agpl"},
    "Apache-2.0": {"apache"},
    "Artistic-2.0": {"artistic"},
    "BSD": {"bsd"},
    "BSL-1.0": {"boost", "bsl"},
    "CC-BY": {"cc", "creative"},
    "CC-BY-NC": {"cc", "creative"},
    "CC-BY-SA": {"cc", "creative"},
    "CC0": {"cc0"},
    "EPL-2.0": {"eclipse", "epl"},
    "GPL": {"gnu", "gpl"},
    "ISC": {"isc"},
    "LGPL": {"gnu", "lgpl"},
    "MIT": {"mit"},
    "MPL-2.0": {"mozilla", "mpl"},
    "PostgreSQL": {"postgresql"},
    "Python-2.0": {"psf", "python"},
    "Unlicense": {"unlicense"},
    "WTFPL": {"fuck", "wtfpl"},
    "Zlib": {"zlib"},
}
# Words of licences that repeat a family's paragraphs and add others, within NEAR lines: the family's nameless templates don't count there.
RELATIVES = {"BSD": {"openssl", "ssleay", "php", "apache"}, "MIT": {"boost", "unencumbered", "unlicense"}}
NEAR = 40
# Words of which a family's notices have one in any case, and words that speak for another family.
NEEDS = {"AGPL": {"affero", "agpl"}, "LGPL": {"lesser", "lgpl", "library"}, "CC-BY-NC": {"nc", "noncommercial"}, "CC-BY-SA": {"sa", "sharealike"}, "WTFPL": {"wtfpl", "fuck"}, "Python-2.0": {"python", "psf"}}
BARS = {"GPL": {"lesser", "lgpl", "affero", "agpl", "library"}, "LGPL": {"affero", "agpl"}, "CC-BY": {"nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs"}, "CC-BY-NC": {"sa", "sharealike", "nd", "noderivatives", "noderivs"}, "CC-BY-SA": {"nc", "noncommercial"}}
VERSIONS = {"Apache-2.0": {"2", "2.0"}, "Artistic-2.0": {"2", "2.0"}, "BSL-1.0": {"1", "1.0"}, "EPL-2.0": {"2", "2.0"}, "MPL-2.0": {"2", "2.0"}}
VERBS = frozenset("licensed released distributed covered available governed published made under".split())
NONE = "none"
UNCONFIRMED = 0.3  # the most that the share of a template counts which lacks its name or a part of its identifier


TAG = re.compile(r"(?i)\b(?:spdx(?:-license-identifier)?|licen[sc]es?)[\"']?\s*[:=]\s*(.+)")
UNDER_WHAT = re.compile(r"(?i)\b(?:licen[sc]ed|released|distributed|available|published|covered)\b[^.;:]*?\bunder\s+(.+)")
BETWEEN = re.compile(r"(?i)\s+(?:or|and)\s+|[/|]|,(?!\s*v(?:ersion)?[\s.\d])")
LEAD = re.compile(r"(?i)^(?:(?:either|both|any|one|of|the|a|an|terms|conditions|your|choice|option|at)\s+)+")


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower().replace("gplv", "gpl v"))


def statements(line: str, most_words: int = 6) -> list[list[str]]:
    """For each licence that a line names in a tag or after `under`, short statements of it, to be judged one after the other.

    Names are parted by or, and, slash, bar or comma; one of over `most_words` words is no name. An exception (WITH) is not part
    of it, a closing + stands for -or-later.
    """
    met = TAG.search(line)
    tagged = bool(met)
    met = met or UNDER_WHAT.search(line)
    if not met:
        return []
    rest = re.split(r"[.;:](?:\s|$)", met[1])[0]
    out = []
    for name in BETWEEN.split(re.sub(r"[()\"'<>*#]", " ", rest)):
        name = LEAD.sub("", re.sub(r"(?i)\s+(?:with|at\s+your)\s.*", "", name.strip())).strip()
        name = re.sub(r"\+$", "-or-later", name)
        if 0 < len(words_of(name)) <= most_words:
            plain = re.sub(r"(?i)\s+licen[sc]es?$", "", name)
            out.append(([SPDX.format(name)] if tagged and " " not in name else []) + [LICENSED.format(x) for x in dict.fromkeys((name, plain))])
    return out


def grams(words: list[str]) -> list:
    return [*words, *zip(words, words[1:], strict=False), *zip(words, words[1:], words[2:], strict=False)]


def pairs(words: list[str]) -> set:
    return set(zip(words, words[1:], strict=False))


def excluded(family: str, there: set[str]) -> bool:
    return not there.isdisjoint(BARS.get(family, ())) or (family in NEEDS and there.isdisjoint(NEEDS[family]))


def denied(words: list[str]) -> bool:
    """Whether the text says that it is not licensed so: a negation up to three words before the verb, in no condition."""
    for k, w in enumerate(words):
        if w in ("not", "never", "isn", "wasn", "aren", "previously", "formerly") or w == "longer" and k and words[k - 1] == "no":
            if not VERBS.isdisjoint(words[k + 1 : k + 4]) and "if" not in words[max(0, k - 8) : k]:
                return True
    return False


def versions_of(words: list[str]) -> set[str]:
    """The numbers after the words version and v, such as 2 and 1.1."""
    out = set()
    for k, w in enumerate(words):
        if w in ("version", "v") or w[0] == "v" and w[1:].isdigit():
            digits = [w[1:]] if w[1:].isdigit() else []
            out |= {".".join(digits + [x for x in words[k + 1 : k + 3 - len(digits)] if x.isdigit()])}
    return out - {""}


@dataclass
class Model:
    families: list[str]  # the last is NONE
    number: dict  # gram -> row of weight
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    confirm: dict[str, list[set]]

    def chances(self, words: list[str]) -> np.ndarray:
        rows = {self.number[g] for g in grams(words) if g in self.number}
        z = (self.bias + self.weight[sorted(rows)].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judge(self, paragraph: str, sure: float, share: float) -> tuple[str, float, float] | None:
        """(family, its chance, best template share) or None where the classifier finds none; share below `share` is unconfirmed."""
        return self.judge_words(words_of(paragraph), sure, share)

    def judge_words(self, words: list[str], sure: float, share: float) -> tuple[str, float, float] | None:
        if self.number.keys().isdisjoint(words):  # the bias alone says none
            return None
        p, there = self.chances(words), set(words)
        p = p * [not excluded(f, there) for f in self.families]  # kindred families share most words
        p = p / p.sum()
        best = int(p.argmax())
        if self.families[best] == NONE or p[best] < sure:
            return None
        have = pairs(words)
        return self.families[best], float(p[best]), self.share(self.families[best], words, have)

    def share(self, family: str, words: list[str], have: set) -> float:
        """The best share of a template's word pairs that the text has; 0 if it denies the licence or names another
        version or family. An identifier must be there whole."""
        named = versions_of(words)
        if denied(words) or excluded(family, set(words)):
            return 0.0
        if family in VERSIONS and named and named.isdisjoint(VERSIONS[family]):
            return 0.0
        text = "".join(words)
        has = lambda name: name in words or len(name) > 4 and name in text  # noqa: E731  a long one may be broken by a wrap
        best = 0.0
        for t in self.confirm[family]:
            x, names = len(t & have) / len(t), {w for p in t for w in p if w in NAMES.get(family, ())}
            lacking = bool(names) and not any(map(has, names)) or ("spdx", "license") in t and x < 1
            best = max(best, min(x, UNCONFIRMED) if lacking else x)
        return best

    def stated(self, line: str, sure: float, share: float) -> list[tuple[str, float, float]]:
        """What templates confirm of the statements of a line, once for each family; nothing where it denies them."""
        each = statements(line)
        if not each or denied(words_of(line)):
            return []
        out = {}
        for forms in each:
            judged = (self.judge(x, sure, share) for x in forms)
            got = next((j for j in judged if j and j[2] >= share), None)
            if got:
                out.setdefault(got[0], got)
        return list(out.values())

    def scan(self, text: str, sure: float, share: float, window: int | None = None) -> list[tuple[str, float, float]]:
        """What judge finds in each paragraph of text; further families that a line states follow, one by one.

        Every line is judged whole. It is also judged together with the lines that follow it up to a blank line or a confirmed
        one; a confirmed run that has more word pairs of a template than the line alone counts as one paragraph. Of such a run
        `window` words of each line count, and lines join while the ones before have fewer: two more than the
        longest template has pairs of words, unless given.
        """
        raw = text.split("\n")
        lines = [words_of(x) for x in raw]
        alone = [self.judge_words(w, sure, share) for w in lines]
        templates = [t for ts in self.confirm.values() for t in ts]
        any_pair = set().union(*templates)
        openers = {a for a, _ in any_pair}
        longest = window or max(map(len, templates)) + 2

        def matched(family, have):
            return max(len(t & have) for t in self.confirm[family] if len(t & have) >= share * len(t))

        found, i = [], 0
        while i < len(lines):
            best, end = alone[i], i + 1
            w = lines[i][-longest:]  # a template that begins in this line has no more words before its end
            if w and (w[-1] in openers or not any_pair.isdisjoint(pairs(w))):
                most = matched(best[0], pairs(lines[i])) if best and best[2] >= share else 0
                added = 0
                for j in range(i + 1, len(lines)):
                    if not lines[j] or added >= longest or (alone[j] and alone[j][2] >= share):
                        break
                    w = w + lines[j][:longest]
                    added += len(lines[j])
                    here = pairs(w) & any_pair
                    if max(len(t & here) / len(t) for t in templates) < share:
                        continue
                    got = self.judge_words(w, sure, share)
                    if got and got[2] >= share and matched(got[0], here) > most:
                        best, end, most = got, j + 1, matched(got[0], here)
            if best and best[2] >= share and not RELATIVES.get(best[0], set()).isdisjoint(w for x in lines[max(0, i - NEAR) : end + NEAR] for w in x):
                if NAMES[best[0]].isdisjoint(w for x in lines[i:end] for w in x):
                    best = (*best[:2], min(best[2], UNCONFIRMED))
            more = self.stated(" ".join(raw[i:end]), sure, share)
            if best and best[2] < share and more:
                best = None
            if best:
                found.append(best)
            found += [j for j in more if not best or j[0] != best[0]]
            i = end
        return found


def fit(lines: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, seed: int = 11, copies: int = 60, rounds: int = 300, l2: float = 1e-4) -> Model:
    """Train on varied templates and on `lines` of the corpus that no template resembles."""
    rng = random.Random(seed)
    families = [*sorted(templates), NONE]
    confirm = {f: [pairs(words_of(t)) for t in ts] for f, ts in templates.items()}
    known = [words_of(x) for x in lines]
    plain = [w for w in known if w and not any(len(t & pairs(w)) >= 0.5 * len(t) for ts in confirm.values() for t in ts)]
    filler = [w for ws in plain[:2000] for w in ws] or ["lorem"]
    rows: list[tuple[list[str], int]] = []
    for f, ts in templates.items():
        for t in ts:
            for k in range(copies):
                w = words_of(t)
                if k and len(w) > 4:
                    w = [x for x in w if rng.random() > 0.06]
                if k % 3 == 2:
                    at, n = rng.randrange(len(filler)), rng.randint(1, 25)
                    w = filler[at : at + n] + w if k % 2 else w + filler[at : at + n]
                rows.append((w, families.index(f)))
    vocabulary = [words_of(t) for ts in templates.values() for t in ts]
    for w in plain:
        rows.append((w, len(families) - 1))
        if rng.random() < 0.3:  # words of licences that make no licence
            t = rng.choice(vocabulary)
            rows.append((w[:12] + rng.sample(t, min(len(t), 3)) + w[12:24], len(families) - 1))
    for t in vocabulary:
        rows += [(rng.sample(t, rng.randint(1, max(1, len(t) // 4))), len(families) - 1) for _ in range(12)]
    rng.shuffle(rows)
    number = {g: i for i, g in enumerate(dict.fromkeys(g for t in vocabulary for g in grams(t)))}
    cut = len(rows) // 5
    held, train = rows[:cut], rows[cut:]

    def matrix(part):
        ids = [sorted({number[g] for g in grams(w) if g in number}) for w, _ in part]
        return np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.array([i for x in ids for i in x], dtype=np.int64), np.array([y for _, y in part])

    def logits(part_row, part_word, n, weight, bias):
        return np.stack([np.bincount(part_row, weight[part_word, c], n) for c in range(k)], axis=1) + bias

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    k = len(families)

    def descend(part):
        """Adam on the mean log-loss, the families alike in weight."""
        row, word, y = matrix(part)
        each = (1 / np.maximum(1, np.bincount(y, minlength=k)))[y] / k
        weight, bias = np.zeros((len(number), k)), np.zeros(k)
        m, v = np.zeros((len(number) + 1, k)), np.zeros((len(number) + 1, k))
        for t in range(1, rounds + 1):
            d = (softmax(logits(row, word, len(y), weight, bias)) - np.eye(k)[y]) * each[:, None]
            g = np.vstack([np.stack([np.bincount(word, d[row, c], len(number)) for c in range(k)], axis=1) + l2 * weight / k, d.sum(axis=0)])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            weight, bias = weight - step[:-1], bias - step[-1]
        return weight, bias

    weight, bias = descend(train)
    # what a family looks like to a model that has never seen it: a third of the families is left out in turn and counts as none
    chances, truth = [], []
    for third in range(3):
        unseen = {c for c in range(k - 1) if c % 3 == third}
        w, b = descend([r for r in train if r[1] not in unseen])
        row, word, y = matrix(held)
        chances.append(logits(row, word, len(y), w, b))
        truth.append(np.where(np.isin(y, list(unseen)), k - 1, y))
    z, y = np.concatenate(chances), np.concatenate(truth)
    loss = lambda temp: -np.log(softmax(z / temp)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = min(np.geomspace(0.5, 8, 25), key=loss) if len(y) else 1.0
    return Model(families, number, weight, bias, float(temperature), confirm)


def train(docs: DataFrame, most_lines: int = 4000, most_docs: int = 400, text_col: str = "text", most_chars: int = 20_000) -> Model:
    """Fit against the lines of at most `most_docs` documents, by hash order, and at most `most_lines` of them.

    The documents have fewer than `most_chars` characters each, so that what the driver holds is bounded. Only the fit is;
    scan_licenses reads every text whole.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    some = texts.select("text", F.xxhash64("text", F.lit("sample")).alias("h")).where(F.length("text") < most_chars)
    hashes = some.select("h").distinct().orderBy("h").limit(most_docs)
    rows = some.join(F.broadcast(hashes), "h").select("h", "text").distinct().orderBy("h").collect()
    lines = [x for r in rows for x in r.text.split("\n") if x.strip()]
    random.Random(5).shuffle(lines)
    return fit(lines[:most_lines])


def scan_licenses(docs: DataFrame, model: Model | None = None, sure: float = 0.8, share: float = 0.6, window: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, families, n_licensed, n_unconfirmed, best) for every row of docs.

    families: the confirmed families, sorted and comma-joined; n_licensed: paragraphs with one, once for each of its families; n_unconfirmed:
    paragraphs that the classifier finds but no template confirms; best: the highest chance of a confirmed
    paragraph, else 0. Of families alike in chance the first by name counts. Null and empty texts have none; long ones
    are read whole, a line at a time (window: see Model.scan). Repeated rows and null ids get a row each. An empty table gives an empty result. Other columns are not looked at.
    """
    model = model or train(docs, text_col=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        m = held.value
        for b in bounded(batches, 1):
            out = []
            for text in b.column(1).to_pylist():
                found = m.scan(text or "", sure, share, window)
                good = [j for j in found if j[2] >= share]
                out.append((",".join(sorted({j[0] for j in good})), len(good), len(found) - len(good), round(max((j[1] for j in good), default=0.0), 6)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], kinds[i]) for i in range(4))], names=["doc_id", "families", "n_licensed", "n_unconfirmed", "best"])

    return source.mapInArrow(run, "doc_id long, families string, n_licensed int, n_unconfirmed int, best double")
