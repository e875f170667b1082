import random
import re

import pytest
from rows import clashing, documents

from evalspark.llm import licenses


def prose(rng, n):
    return " ".join(rng.choices("the of this work is and public or general version house river for in to under free stone".split(), k=n))


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(1)
    texts, want = [], {}
    for i in range(150):
        lines = [prose(rng, rng.randrange(1, 40)) for _ in range(4)]
        if i % 3 == 0:
            family = list(licenses.TEMPLATES)[i // 3 % len(licenses.TEMPLATES)]
            at = rng.randrange(5)
            lines.insert(at, rng.choice(["", "// ", "Note: "]) + rng.choice(licenses.TEMPLATES[family]).upper())
            want[i, at] = family
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "MIT", "The license of the river is free.", "word " * 20_000]
    docs = documents(spark, texts)
    return docs, want, licenses.train(docs, sample=2000)


def test_families_are_found_and_clean_lines_left_alone(case):
    docs, want, model = case
    got = {(r["doc_id"], r["paragraph"]): r for r in licenses.scan(clashing(docs), model).collect()}
    assert {k: r["family"] for k, r in got.items() if r["family"] != licenses.UNKNOWN} == want
    assert all(0 <= r["probability"] <= 1 and 0 <= r["similarity"] <= 1 for r in got.values())
    assert all(r["similarity"] >= licenses.CONTAINED for r in got.values() if r["family"] != licenses.UNKNOWN)


def test_model_is_sparse_and_repeats_and_empty_tables(case):
    docs, want, model = case
    assert len(model.weights) < 1000 and "the" not in model.weights and 0.5 <= model.least < 1
    one = licenses.scan(docs.filter("doc_id = 0"), model).collect()
    twice = licenses.scan(docs.filter("doc_id = 0").unionByName(docs.filter("doc_id = 0")), model).collect()
    assert one and sorted(map(tuple, twice)) == sorted([tuple(r) for r in one] * 2)
    assert licenses.scan(docs.limit(0), model).count() == 0
    assert licenses.train(docs.limit(0)).weights


def test_no_python_on_the_executors(case):
    docs, _, model = case
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


#: In no template, text or frame of the module.
OTHER_WORDINGS = {
    "mit": ("Licensed under the MIT License.", "This project is distributed under the MIT license.", "License: MIT", "SPDX-License-Identifier: MIT",
            "You can use this code freely, it is MIT licensed.", "This library is offered under the MIT licence"),
    "bsd": ("Licensed under the BSD License.", "All of it is open source (BSD 3-Clause License)", "Use is governed by a BSD-style license"),
    "gpl-3.0": ("Licensed under the GNU General Public License version 3", "The whole is offered under GPLv3", "Copyright 2020 by us, GNU GPL v3 or newer"),
    "gpl-2.0": ("Our code is offered under the GNU General Public License v2", "SPDX-License-Identifier: GPL-2.0+"),
    "apache-2.0": ("This project is licensed under the terms of the Apache 2.0 license", "Copyright the authors. Apache License, Version 2.0"),
    "lgpl": ("You may link to it under the GNU Lesser General Public License v2.1", "Licence: LGPL-3.0"),
    "mpl-2.0": ("Code contributions fall under the Mozilla Public License 2.0",),
    "cc-by-nc-4.0": ("All photos here: CC BY-NC 4.0", "Except where noted, content on this site is licensed under a CC BY-NC 4.0 license"),
    "cc-by-sa-4.0": ("Text is available under the Creative Commons Attribution-ShareAlike 4.0 License",),
    "cc-by-4.0": ("This article is distributed under the terms of the Creative Commons Attribution 4.0 International License",),
    "public-domain": ("The data are dedicated to the public domain (CC0 1.0)", "Everything in this folder was placed in the public domain by us"),
}
NO_FAMILY = ("Licensed under the Apache License, Version 1.1.", "Licensed under the GNU Affero General Public License version 3", "CC BY-NC-SA 4.0",
             "Released under the GNU General Public License.", "She studied at the MIT and the license was late", "Er kam mit der Lizenz",
             "Licensed under the Eclipse Public License, version 2.0")


def test_other_wordings_and_other_licences(spark, case):
    _, _, model = case
    pairs = [(f, t) for f, all_ in OTHER_WORDINGS.items() for t in all_] + [(licenses.UNKNOWN, t) for t in NO_FAMILY]
    docs = documents(spark, [t for _, t in pairs])
    got = {r["doc_id"]: r["family"] for r in licenses.scan(docs, model).collect()}
    assert {t: got.get(i, licenses.UNKNOWN) for i, (_, t) in enumerate(pairs)} == {t: f for f, t in pairs}


def test_each_wording_has_a_key_of_its_family_alone():
    for family, all_ in licenses._wordings().items():
        for found in all_:
            line = f" {' '.join(found)} "
            held = {f for f, keys in licenses.KEYS.items() for k in keys if sum(f" {p} " in line for p in k) >= licenses.CONTAINED * len(k)}
            assert held == {family}, line


WRAPPED = {
    ("mit", 0): "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
                "in the Software without restriction, including without limitation the rights",
    ("bsd", 2): "# Copyright (c) 2020 the authors.\n#\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
    ("gpl-3.0", 1): " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
                    " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.",
    ("lgpl", 0): "it under the terms of the GNU Lesser\r\nGeneral Public License",
    ("apache-2.0", 1): "some other words\nLicensed under the Apache\nLicense, Version\n2.0",
    ("gpl-2.0", 0): "\n".join("GNU General Public License as published by the Free Software Foundation; either version 2 of the License".split()),
}


def test_wrapped_notices(spark, case):
    _, _, model = case
    apart = ["Licensed under the Apache\n\nLicense, Version 2.0", "the terms of the GNU General\n//\n// Public License, version 3"]
    docs = documents(spark, [*WRAPPED.values(), *apart])
    got = licenses.scan(docs.unionByName(docs.filter("doc_id = 0")), model).collect()
    found = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got if r["family"] != licenses.UNKNOWN)
    assert found == sorted([(i, at, f) for i, (f, at) in enumerate(WRAPPED)] + [(0, 0, "mit")])
    assert len({(r["doc_id"], r["paragraph"]) for r in got if r["doc_id"]}) == sum(r["doc_id"] > 0 for r in got)


def test_lines_without_an_n_gram_are_not_kept(spark, case, monkeypatch):
    _, _, model = case
    gram = next(g for g in sorted(model.weights) if " " in g)
    texts = ["\n".join(w for g in model.weights for w in g.split(" ") if w not in model.weights), f"{gram}\nriver", f"of {gram.replace(' ', '\n')}", gram + "x"]
    kept, own = {}, licenses.materialize
    monkeypatch.setattr(licenses, "materialize", lambda df, name: kept.setdefault(name, own(df, name)))
    licenses.scan(documents(spark, texts), model)
    rows = [(r["id"], r["paragraph"]) for r in kept["licence-lines"].collect()]
    assert (1, 0) in rows and not {(0, 0), (1, 1), (3, 0)} & set(rows) and not any(i == 0 for i, _ in rows)


def test_pattern_finds_what_n_grams_find():
    rng = random.Random(7)
    words = ["a", "ab", "b", "c", "rem"]
    phrases = {" ".join(rng.choices(words[:4], k=rng.randrange(1, 4))) for _ in range(9)}
    for _ in range(300):
        found = rng.choices(words, k=rng.randrange(1, 7))
        text = rng.choice(["", "-"]) + rng.choice([" ", ", ", "\n"]).join(found)
        some = bool(licenses._grams(found) & phrases)
        assert bool(re.search(licenses._pattern(phrases), " " + " ".join(found) + " ")) == some
        assert not some or re.search(licenses._pattern(phrases, licenses.GAP), text)
    assert re.search(licenses._pattern(["a b"], licenses.GAP), "x a\n// rem\nrem b") and not re.search(licenses._pattern([]), "")


def test_training_reads_every_line(spark, monkeypatch):
    """All lines with words, alone and joined with those behind them, are counted, half of them learned from and half held out."""
    written = {}

    def kept(df, name):
        written[name] = materialize(df, name)
        return written[name]

    materialize = licenses.materialize
    monkeypatch.setattr(licenses, "materialize", kept)
    texts = ["the river of general\npublic\nhouse of stone\n\n// free", "free stone", None, ""] * 10
    licenses.train(documents(spark, texts))
    # of the first text four lines alone and two joined, of the second one
    grams = [r["grams"] for r in written["licence-lines"].collect()]
    assert len(grams) == 70 and sum("general public" in g for g in grams) == 10
    assert {r["half"]: r["sum(n)"] for r in written["licence-examples"].groupBy("half").sum("n").collect()}.keys() == {0, 1}
    assert written["licence-examples"].groupBy().sum("n").first()[0] == 70
