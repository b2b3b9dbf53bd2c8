"""Licence paragraphs: templates, near misses and the lines of the given documents."""

import math
import random
import re
import textwrap

import pytest

from ohmweave.llm import licenses
from ohmweave.llm.common import table


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(table(spark, "/root/testdata/sf0.01", "documents"))


def test_every_template_is_found_and_confirmed(model):
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            got = model.judge(t.upper(), 0.8, 0.6)
            assert got, t
            assert got[0] == family
            assert got[2] >= 0.6


@pytest.mark.parametrize("text", ["", "I passed the driving test", "the general public is invited to the work", "software and documentation of the house", "version 3 of the text", "attribution of paintings"])
def test_other_text_is_unknown(model, text):
    got = model.judge(text, 0.8, 0.6)
    assert got is None or got[2] < 0.6


def test_given_documents(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lines = {"GNU General Public": "GPL", "CC BY-NC": "CC-BY-NC", "MIT License": "MIT", "Apache License": "Apache-2.0"}
    want = {r.doc_id: ",".join(sorted({f for k, f in lines.items() if k.lower() in (r.text or "").lower()})) for r in docs.collect()}
    got = {r.doc_id: r.families for r in licenses.scan_licenses(docs, model).collect()}
    assert got == want
    assert sum(map(bool, want.values())) > 5
    assert all(re.fullmatch(r"[A-Z].*|", x) for x in got.values())


def test_edge_rows(spark, model):
    mit = licenses.TEMPLATES["MIT"][0]
    rows = [(1, None), (2, ""), (3, f"text\n{mit}\n{mit}\n{licenses.TEMPLATES['GPL'][0]}"), (4, "word " * 100_000 + "\n" + mit), (4, mit), (None, mit)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, families string, best int")
    got = sorted((r.doc_id or 0, r.families, r.n_licensed) for r in licenses.scan_licenses(df, model).collect())
    assert got == [(0, "MIT", 1), (1, "", 0), (2, "", 0), (3, "GPL,MIT", 3), (4, "MIT", 1), (4, "MIT", 1)]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [30, 50, 72, 80])
def test_wrapped_notices_are_found(spark, model, width):
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if " " in t and "SPDX" not in t]
    rows, want = [], []
    for k, (f, t) in enumerate(notices):
        for j, (first, then) in enumerate((("", ""), (" * ", " * "), ("# ", "# "))):
            rows.append((10 * k + j, "some words before\n\n" + textwrap.fill(t, width, initial_indent=first, subsequent_indent=then) + "\n\nand some after"))
            want.append((10 * k + j, f, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.families, r.n_licensed) for r in licenses.scan_licenses(df, model).collect()) == want


def test_notices_on_neighbouring_lines_stay_apart(model):
    texts = [licenses.TEMPLATES[f][0] for f in ("MIT", "GPL", "CC-BY", "BSD")]
    assert [j[0] for j in model.scan("\n".join(texts), 0.8, 0.6)] == ["MIT", "GPL", "CC-BY", "BSD"]
    assert model.scan("the general public is invited\nto the work of the house\n\nand license of\nthe source", 0.8, 0.6) == []


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("This work is not licensed under the MIT License.", None),
        ("This software is no longer released under the MIT License.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL"),
        ("SPDX-License-Identifier: Foo-1.0", None),
        ("Released under the Foo License.", None),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", None),
        ("All rights reserved. No part of this work may be copied without written permission of the author.", None),
    ],
)
def test_denials_versions_and_kindred_families(model, text, family):
    good = [j for j in model.scan(text, 0.8, 0.6) if j[2] >= 0.6]
    assert [j[0] for j in good] == ([family] if family else [])


def test_precision_and_recall_on_varied_notices(model):
    """Wrapped notices with some words lost, names put in, and prose around; beside as many that no template names."""
    rng = random.Random(12)
    hit = wrong = total = 0
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            if "SPDX" in t:
                continue
            for _ in range(4):
                w = [x for x in t.split() if rng.random() > 0.03 or x.lower() in ("not", "lesser", "affero")]
                w.insert(rng.randrange(len(w)), "ACME")
                text = "Some words before.\n\n" + textwrap.fill(" ".join(w), rng.choice((60, 72, 80)), initial_indent="// ", subsequent_indent="// ") + "\n\nMore words."
                got = {j[0] for j in model.scan(text, 0.8, 0.6) if j[2] >= 0.6}
                total += 1
                hit += family in got
                wrong += bool(got - {family})
    assert hit / total > 0.85
    assert wrong / total < 0.03


def brute_share(template, paragraph):
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (template, paragraph))
    two = lambda w: {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
    return len(two(a) & two(b)) / len(two(a))


def test_template_shares_match_brute_force(model):
    paragraph = "Permission is hereby granted, free of charge, to any person who holds a copy of this software and the files"
    want = max(brute_share(t, paragraph) for t in licenses.TEMPLATES["MIT"] if "SPDX" not in t)
    words = licenses.words_of(paragraph)
    assert abs(model.share("MIT", words, licenses.pairs(words)) - want) < 1e-12


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("Distributed under the terms of the GPL v3", ["GPL"]),
        ("Released under the GPLv2 or later", ["GPL"]),
        ("License: MIT", ["MIT"]),
        ('license = "GPLv3"', ["GPL"]),
        ("SPDX: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
        ("SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) OR BSD-3-Clause", ["BSD", "GPL"]),
        ("Licensed under either Apache 2.0 or MIT at your option.", ["Apache-2.0", "MIT"]),
        ("Licensed under either of the Apache License, Version 2.0 or the MIT license", ["Apache-2.0", "MIT"]),
        ("This project is dual licensed under MIT and LGPL-3.0", ["LGPL", "MIT"]),
        ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", ["MIT"]),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["MIT"]),
        ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["BSD"]),
        ("3. Neither the name of the Foo Institute nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD"]),
        ("This tool was previously released under the MIT License.", []),
        ("It was formerly licensed under either MIT or Apache-2.0", []),
        ("You may not use this file except in compliance with the License. You can obtain a copy of the license at usr/src/SYSTEM.LICENSE or http://www.opensystem.org/os/licensing.", []),
        ("Copyright The OpenSSL Project.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nAll advertising materials must display: for use in the OpenSSL Toolkit", []),
        ("Licensed under the Foo", []),
        ("License: proprietary", []),
        ("License: see the file", []),
        ("available under the new management and licensed under the terms of the trade", []),
    ],
)
def test_statements_expressions_and_relatives(model, text, families):
    """Notices that are no templates."""
    assert sorted({j[0] for j in model.scan(text, 0.8, 0.6) if j[2] >= 0.6}) == families


def test_statements_name_each_licence():
    first = lambda line: [x[0] for x in licenses.statements(line)]
    assert first("License: MIT/BSD") == ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: BSD"]
    assert first("licence = Apache 2.0, see below and elsewhere") == ["Licensed under the Apache 2.0.", "Licensed under the see below.", "SPDX-License-Identifier: elsewhere"]
    assert first("no tag at all") == first("") == first("License:") == []
    assert first("published under aa bb cc dd ee ff gg") == []


def brute_judge(m, words, sure, share):
    """(family, chance, share) with loops and sets of strings, none of the shortcuts."""
    seen = set(words) | set(zip(words, words[1:])) | set(zip(words, words[1:], words[2:]))
    z = [float(b) for b in m.bias]
    hit = False
    for g in seen:
        if g in m.number:
            hit = hit or isinstance(g, str)
            z = [a + float(w) for a, w in zip(z, m.weight[m.number[g]])]
    if not hit:
        return None
    e = [0.0 if licenses.excluded(f, set(words)) else math.exp((x - max(z)) / m.temperature) for f, x in zip(m.families, z)]
    best = max(range(len(e)), key=lambda c: (e[c], -c))
    family, chance = m.families[best], e[best] / sum(e)
    if family == "none" or chance < sure:
        return None
    return family, chance, max(brute_shares(family, words), default=0.0)


def brute_shares(family, words):
    named = licenses.versions_of(words)
    if licenses.denied(words) or family in licenses.VERSIONS and named and not named & licenses.VERSIONS[family]:
        return []
    out = []
    for t in licenses.TEMPLATES[family]:
        w = licenses.words_of(t)
        x = len(set(zip(w, w[1:])) & set(zip(words, words[1:]))) / len(set(zip(w, w[1:])))
        names = set(w) & licenses.NAMES[family]
        lacks = names and not any(n in words or len(n) > 4 and n in "".join(words) for n in names)
        out.append(min(x, 0.3) if lacks or "SPDX" in t and x < 1 else x)
    return out


def brute_scan(m, text, sure, share):
    """Every run of lines judged, however unlike a notice."""
    raw = text.split("\n")
    lines = [licenses.words_of(x) for x in raw]
    alone = [brute_judge(m, w, sure, share) for w in lines]

    def hits(family, words):
        there = [(licenses.words_of(t), t) for t in licenses.TEMPLATES[family]]
        each = [(len(set(zip(w, w[1:])) & set(zip(words, words[1:]))), len(set(zip(w, w[1:])))) for w, _ in there]
        return max(n for n, k in each if n >= share * k)

    found, i = [], 0
    while i < len(lines):
        best, end = alone[i], i + 1
        most = hits(best[0], lines[i]) if best and best[2] >= share else 0
        for j in range(i + 1, len(lines)):
            if not lines[j] or (alone[j] and alone[j][2] >= share):
                break
            words = [w for x in lines[i : j + 1] for w in x]
            got = brute_judge(m, words, sure, share) if lines[i] else None
            if got and got[2] >= share and hits(got[0], words) > most:
                best, end, most = got, j + 1, hits(got[0], words)
        near = {w for x in lines[max(0, i - 40) : end + 40] for w in x}
        mine = {w for x in lines[i:end] for w in x}
        if best and best[2] >= share and near & licenses.RELATIVES.get(best[0], set()) and not mine & licenses.NAMES[best[0]]:
            best = (*best[:2], 0.3)
        more = {}
        run = " ".join(raw[i:end])
        for forms in [] if licenses.denied(licenses.words_of(run)) else licenses.statements(run):
            got = [j for j in (brute_judge(m, licenses.words_of(x), sure, share) for x in forms) if j and j[2] >= share]
            if got:
                more.setdefault(got[0][0], got[0])
        if best and (best[2] >= share or not more):
            found.append(best)
        found += [j for f, j in more.items() if not best or best[2] < share or f != best[0]]
        i = end
    return found


def test_query_matches_brute_force(spark, model):
    rng = random.Random(3)
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [None, "", "License: MIT", "no licence in these words\n\nat all", "was previously released under the MIT License"]
    for k in range(60):
        parts = []
        for t in rng.sample(notices, rng.randint(1, 3)):
            w = [x for x in t.split() if rng.random() > 0.04]
            parts.append(textwrap.fill(" ".join(w), rng.choice((40, 60, 72)), subsequent_indent=rng.choice(("", "# "))))
            parts.append("some words of the document and the work")
        texts.append(("\n\n" if k % 3 else "\n").join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_licensed, r.n_unconfirmed, r.best) for r in licenses.scan_licenses(df, model).collect()}
    for k, t in enumerate(texts):
        found = brute_scan(model, t or "", 0.8, 0.6)
        good = [j for j in found if j[2] >= 0.6]
        want = (",".join(sorted({j[0] for j in good})), len(good), len(found) - len(good))
        assert got[k][:3] == want, t
        assert abs(got[k][3] - max((j[1] for j in good), default=0.0)) < 2e-6
