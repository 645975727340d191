import random
import re

import pytest

from tickerloom.llm.license_signatures import written
from tickerloom.llm.licenses import BASE, branches, rules, scan_licenses

LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in BASE.items():
        want = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check_base(df, texts):
    for r in scan_licenses(df).collect():
        assert tuple(r)[1:6] in {base(t) for t in texts[r["doc_id"]]}


def test_base_matches_brute_force(documents, texts):
    check_base(documents, {k: [v] for k, v in texts.items()})


def test_odd_rows(spark, odd, none):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    check_base(odd, texts)
    assert scan_licenses(odd).count() == odd.count() and scan_licenses(none).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0,other"),
        ("GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("GPL-3.0-or-later", "gpl-3.0-or-later"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0,other"),
        ("CC BY CC BY all rights reserved. All Rights Reserved", "cc-by,reserved"),
        ("Released under the MIT License.", "mit,other"),
        ("BSD 3-Clause license", "bsd-3-clause"),
        ("mit der apache in berlin", ""),
        ("rights all reserved cc. xby", ""),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("creative commons attribution-sharealike 3.0", "cc-by-sa-3.0"),
        ("", ""),
    ],
)
def test_labels(spark, text, labels):
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels and (row["score"] > 0) == bool(labels) and 0 <= row["score"] <= 1


@pytest.mark.parametrize(
    "text",
    [
        "We run PHP version 3 on this host", "Apache version 2 was installed", "the artistic version 2 of the show", "Open software 2.0 event", "apache 2.0 server",
        "a boost software 1.0 build", "common public 1.0", "python 3.0", "version 2 of the general public", "the open font 1.1", "mit der lizenz", "eclipse 2.0", "a license to drive",
    ],
)
def test_products_are_no_licenses(spark, text):
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["labels"], row["score"]) == ("", 0.0)


NOTICES = [
    ('Redistribution and use in source and binary forms, with or without modification', "bsd"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software', "mit"),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.', "gpl,gpl-3.0-or-later"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache-2.0,other"),
    ('SPDX-License-Identifier: Apache-2.0', "apache-2.0,spdx"),
    ('SPDX-License-Identifier: MPL-2.0', "mpl-2.0,spdx"),
    ('This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.', "mpl-2.0"),
    ('The Software shall be used for Good, not Evil.', "json"),
    ('DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE', "wtfpl"),
    ('under version 2.1 of the GNU Lesser General Public License', "gpl,lgpl-2.1"),
    ('LGPLv3', "lgpl-3.0"),
    ('Licence: European Union Public Licence', "eupl"),
    ('Tous droits réservés', "reserved"),
]


@pytest.mark.parametrize(("text", "labels"), NOTICES)
def test_written_signatures(spark, text, labels):
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels


def plain_labels(text):
    """Labels and score by brute force: every rule, no keyword, Python's expressions, every containment."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    norm, starts, at = "", {}, 0
    for i, w in enumerate(words):
        starts[at] = i
        norm += f" {w} "
        at = len(norm)
    starts[at] = len(words)
    found = [(starts[m.start()], starts[m.end()] - 1, r) for r in rules() for m in re.finditer(r.pattern, norm)]
    kept = [
        r for s, e, r in found
        if not any(t <= s and f >= e and q.priority >= r.priority and (f - t > e - s or q.priority > r.priority or q.id < r.id) for t, f, q in found)
    ]
    based = base(text)[4].split(",") if base(text)[4] else []
    return ",".join(sorted({*based, *(r.label for r in kept)})), max([0.5 if based else 0.0, *(r.confidence for r in kept)])


def test_labels_match_brute_force(spark, texts):
    rng = random.Random(6)
    all_words = sorted({w.strip() for r in rules() for w in re.findall(" ([a-z0-9]+) ", r.pattern)})
    made = [" ".join(rng.choice(all_words) for _ in range(60)) for _ in range(60)]
    made += [" ".join(t for t, _ in rng.sample(NOTICES, 3)) for _ in range(20)]
    made += list(texts.values())
    rows = scan_licenses(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r["labels"], r["score"]) == plain_labels(made[r["doc_id"]]), made[r["doc_id"]][:300]


def test_branches():
    words = ["gpl", "general", "gnu", "gplv3", "apache", "a", "ap"]
    tried = re.compile(branches(words) + r"\Z")
    assert all(tried.match(w) for w in words) and not any(tried.match(w) for w in ("", "g", "gp", "apa", "gnus", "gene"))


def test_places(spark):
    text = "x, CC-BY. y cc by; cc (by) all rights reserved z"
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_base"], row["first_word"], row["last_word"]) == (4, 1, 8)


def test_no_python_on_the_main_path(documents):
    plan = scan_licenses(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_are_hundreds_with_keywords():
    assert len(written()) > 200 and len(rules()) > len(written())
    for r in rules():
        assert any(f" {r.keyword} " in p or r.keyword in p for p in (r.pattern,)), r


def test_keywords_are_mandatory_words():
    for r in rules():
        always = re.sub(r"\(\?: [^ ]+ \)(\?|\{0,\d+\})|\(\?:[^)]*\)", " ", r.pattern)
        assert f" {r.keyword} " in always, r


def test_optional_word_left_out(spark):
    row = scan_licenses(spark.createDataFrame([(1, "No part may be reproduced.")], "doc_id long, text string")).first()
    assert (row["labels"], row["score"]) == ("reserved", 0.6)
