from __future__ import annotations

import random
import re
from re import _parser

from lariat.llm import licenses

BASE = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def plain(text):
    """n_words, n_base, first_word, last_word, base_labels by definition."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if tuple(words[i : i + len(phrase)]) == phrase]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def plain_detections(text):
    """Every rule on every text, and suppression by all pairs."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = []
    for r in licenses.rules():
        for m in re.finditer(r.pattern, words):
            begin = words[: m.start()].count(" ")
            found.append((begin, begin + m[0].count(" "), r))
    out = []
    for a, b, r in found:
        gone = any(
            s is not r and x <= a and b <= y and s.priority <= r.priority and ((x, y) != (a, b) or (s.priority, s.number) < (r.priority, r.number))
            for x, y, s in found
        )
        out.append((a, b, r.number, r.base or not gone))
    return sorted(out)


TEXTS = [
    None, "", "no words about it", "Released under the MIT License.", "RELEASED UNDER-THE_MIT\n\nlicense", "under the mit license under the MIT license!",
    "Licensed under the Apache License, Version 2.0. Also Apache license version 2 and CC BY-NC 4.0; cc,by;nc", "cc-by-ncé is no base phrase; CC BY-NC-SA 4.0 is",
    "GNU General Public License version 3", "This work is licensed under the GNU General Public License, version 3.", "gpl v2 license, LGPL license, see LICENSE.txt",
    "Copyright (c) 2019 2020 all rights reserved. Subject to the terms of the Mozilla Public License version 2.0", "under the mit", "the mıt lİcense", "mit dem under mit license",
    "x " * 3000 + "under the mit license" + " y" * 3000, "SPDX-License-Identifier: BSD-3-Clause", "spdx license identifier apache 2 0", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Developed by the Apache Software Foundation. Nothing under the sun.", "A study by MIT shows what lies under it", "it is governed by the Apache License 2.0 and bound by an MIT license", "Use is for research purposes only; see COPYING for more.",
    "https://www.apache.org/licenses/LICENSE-2.0.txt", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "neither the name of the University nor the names of its contributors may be used to endorse or promote products",
    "cc0 license; CC0 1.0 universal license", "placed in the public domain", "made available under the terms of the Creative Commons Attribution-NonCommercial license",
]


def test_rules():
    made = licenses.rules()
    assert len(made) > 300 and len({r.number for r in made}) == len(made)
    for r in made:
        assert all(re.search(rf"\b{w}\b", r.pattern) for w in (r.keyword, r.second)), r  # both are in every match
        re.compile(r.pattern)


def test_against_definition(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", "y"), (None, TEXTS[6], "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, labels string, rule string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    places = {}
    for r in licenses.detections(docs).collect():
        places.setdefault(r.id, []).append((r.begin, r.end, r.rule, r.kept))
    for r in got:
        text = TEXTS[6 if r.id is None else r.id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        want = plain_detections(text)
        assert sorted(places.get(r.id, [])) == want, text
        by = {x.number: x for x in licenses.rules()}
        kept = [by[n] for _, _, n, k in want if k]
        assert r.labels == ",".join(sorted({x.label for x in kept})) and r.score == max((x.weight for x in kept), default=0.0)
        assert {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")}
    assert licenses.scan(docs.limit(0)).collect() == []


def example(rnd, tokens):
    """A text that the parsed expression matches."""
    out = ""
    for op, x in tokens:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "IN":
            out += chr(rnd.choice([c for k, v in x for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])]))
        elif name == "MAX_REPEAT":
            out += "".join(example(rnd, x[2]) for _ in range(rnd.randint(x[0], min(x[1], x[0] + 2))))
        elif name == "SUBPATTERN":
            out += example(rnd, x[3])
        elif name == "NOT_LITERAL":
            out += rnd.choice("wxyz")
        elif name == "BRANCH":
            out += example(rnd, rnd.choice(x[1]))
        else:
            assert name == "ASSERT", name
    return out


def test_every_rule_passes_the_gate(spark):
    """Texts that a rule matches, and nothing else in them, get that rule, by the words that it says all its matches have."""
    rnd, rows, by = random.Random(1), [], {r.number: r for r in licenses.rules()}
    for r in licenses.rules():
        for _ in range(12):
            words = example(rnd, _parser.parse(r.pattern)).split()
            assert {r.keyword, r.second} <= {*words}, r
            rows.append((r.number, rnd.choice([" ", "-", ", ", "\n"]).join(w.upper() if rnd.random() < 0.3 else w for w in words)))
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id bigint, number int, text string")
    passed = {r.doc_id for r in docs.where(licenses._gate(docs.text)).collect()}
    assert [x for i, x in enumerate(rows) if i not in passed] == []
    found = {(r.id, r.rule) for r in licenses.detections(docs).collect()}
    assert [(i, by[n].pattern) for i, (n, _) in enumerate(rows) if (i, n) not in found] == []
    text = "This program is covered by the GPL."
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (got.labels, got.score) == ("gpl", 0.8) and plain_detections(text)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
