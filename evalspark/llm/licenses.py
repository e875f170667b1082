"""Licence paragraphs by a trained classifier, in DataFrame functions and Spark ML only.

``train`` learns a sparse logistic regression over word n-grams. Its examples of a licence family are the family's templates,
whole and with single words left out, and all its names in the usual ways to state a licence (``FRAMES``, with SPDX tags);
its examples of the class ``unknown`` are all lines, alone and joined with the next ones, that name no licence; equal ones are one
example with a weight, and together they weigh no more than those of the families. Features are the n-grams that at most
half of the families have and that are rare in the lines, so all others weigh nothing. The least
probability that a family needs is calibrated on held-out lines, a half of all, as the one that at most ``FALSE_RATE`` of them reach.

``scan`` scores every line of every text, and lines joined with those behind them: a notice may be wrapped over the lines of a paragraph,
which ends at a line without words (comment marks are none). A joined notice is the shortest run of lines with a key of a family that none of its lines
holds alone, and reaches up to ``REACH`` words past its first line; its row stands for that line. A line without any feature has the score of the
intercept, ``unknown``, and gives no row. A family whose probability is too low, or of whose ``KEYS`` none is largely contained in the
line or run, is ``unknown`` too. A key is what tells the family from others, a few phrases with its version where it has one,
so the words around them do not count.

Null and empty texts have no paragraphs. Rows are independent; rows with the same id give their rows each. Without lines the model knows
its templates only. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.functions.text import let
from evalspark.scratch import materialize

#: Short notices of each family.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "You may not use this file except in compliance with the Apache License, Version 2.0."),
    "mit": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "Redistribute and modify it under the terms of the GNU General Public License, either version 3 or any later version."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted.",
            "Released under the BSD License."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0."),
}
#: Names of each family, as they stand in notices.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache Software License, Version 2.0",
                   "Apache-2.0"),
    "mit": ("MIT License", "The MIT License (MIT)", "MIT/X11 License", "Expat License", "MIT"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPLv3", "GPL v3", "GPLv3 license",
                "GNU General Public License version 3 or later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPLv2", "GPL v2", "GPLv2 license",
                "GNU General Public License version 2 or later", "GPL-2.0-only", "GPL-2.0-or-later"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "GNU LGPL",
             "GNU Library General Public License", "LGPLv3", "LGPL v2.1", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL license"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "2-clause BSD license", "modified BSD license",
            "simplified BSD license", "new BSD license", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL v2", "MPL-2.0"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons BY-NC 4.0 license",
                     "Creative Commons Attribution-Non-Commercial 4.0", "creativecommons.org/licenses/by-nc/4.0"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons BY-SA 4.0 license",
                     "Creative Commons Attribution-Share-Alike 4.0", "creativecommons.org/licenses/by-sa/4.0"),
    "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons BY 4.0 license",
                  "creativecommons.org/licenses/by/4.0"),
    "public-domain": ("CC0 1.0", "CC0 1.0 Universal", "CC0 license", "CC0-1.0", "Unlicense", "The Unlicense"),
}
#: Ways to state a licence.
FRAMES = ("Licensed under the {}.", "Released under the {}.", "Distributed under {}.", "This project is licensed under the {}.",
          "This software is made available under the terms of the {}.", "The source code is covered by the {}.", "Published under the {}, see LICENSE.",
          "License: {}", "SPDX-License-Identifier: {}")
#: Longer notices of each family, besides its templates.
TEXTS = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software",),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
             "either version 3 of the GNU Lesser General Public License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one",),
    "public-domain": ("This file has been placed in the public domain.", "The authors have released this work to the public domain.",
                      "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."),
}


def _gpl(n: int) -> tuple[tuple[str, ...], ...]:
    return (("gnu general public license", f"version {n}"), (f"gnu general public license v{n}",), (f"gnu general public license {n}",),
            ("gnu gpl", f"version {n}"), (f"gpl version {n}",), (f"gpl {n}",), (f"gpl v{n}",), (f"gplv{n}",), (f"gpl{n}",))


def _cc(kind: str, *names: str) -> tuple[tuple[str, ...], ...]:
    return (f"cc {kind} 4 0",), (f"commons {kind} 4 0",), (f"licenses {kind} 4 0",), *((f"{n} 4 0",) for n in names)


#: What tells a family from others: keys of phrases of words. ``licence`` is spelt ``license``.
KEYS = {
    "apache-2.0": (("apache license version 2",), ("apache license 2",), ("apache license v2",), ("apache software license version 2",),
                   ("apache 2 0 license",), ("apache 2 license",), ("license apache 2",), ("identifier apache 2",), ("under apache 2",),
                   ("under the apache 2",), ("by the apache 2",), ("terms of the apache 2",)),
    "mit": (("mit license",), ("mit licensed",), ("license mit",), ("licensed mit",), ("identifier mit",), ("under mit",), ("licensed under the mit",),
            ("released under the mit",), ("distributed under the mit",), ("published under the mit",), ("terms of the mit",), ("covered by the mit",), ("mit x11",), ("expat license",),
            ("permission is hereby granted", "free of charge", "any person obtaining a copy", "of this software", "associated documentation files")),
    "gpl-3.0": _gpl(3),
    "gpl-2.0": _gpl(2),
    "lgpl": (("lesser general public license",), ("gnu library general public license",), ("gnu lgpl",), ("lgpl license",), ("license lgpl",),
             ("identifier lgpl",), ("under lgpl",), ("under the lgpl",), ("lgpl 2",), ("lgpl 3",), ("lgpl v2",), ("lgpl v3",), ("lgplv2",), ("lgplv3",),
             ("lgpl version",)),
    "bsd": (("bsd license",), ("bsd licensed",), ("bsd style license",), ("bsd 2 clause",), ("bsd 3 clause",), ("bsd 4 clause",), ("2 clause bsd",),
            ("3 clause bsd",), ("4 clause bsd",), ("two clause bsd",), ("three clause bsd",), ("license bsd",), ("identifier bsd",), ("under bsd",),
            ("licensed under the bsd",), ("released under the bsd",),
            ("redistribution and use in source and binary forms", "with or without modification", "are permitted")),
    "mpl-2.0": (("mozilla public license version 2",), ("mozilla public license v 2",), ("mozilla public license v2",), ("mozilla public license 2",),
                ("mpl 2",), ("mpl v2",), ("mpl version 2",), ("mplv2",)),
    "cc-by-nc-4.0": _cc("by nc", "attribution noncommercial", "attribution non commercial"),
    "cc-by-sa-4.0": _cc("by sa", "attribution sharealike", "attribution share alike"),
    "cc-by-4.0": _cc("by", "commons attribution", "creativecommons attribution"),
    "public-domain": (("released into the public domain",), ("released to the public domain",), ("released this work to the public domain",),
                      ("dedicated to the public domain",), ("dedicated", "copyright", "to the public domain"), ("placed in the public domain",),
                      ("placed into the public domain",), ("cc0 1 0",), ("cc0 license",), ("license cc0",), ("identifier cc0",), ("under cc0",),
                      ("the unlicense",), ("license unlicense",), ("identifier unlicense",), ("under unlicense",)),
}
UNKNOWN = "unknown"
RARE = 0.002  # share of the lines of the class unknown that may have a feature
FALSE_RATE = 0.0005
STEPS = 1_000_000  # of probabilities, in which the least one is calibrated
REACH = 64  # words of a joined notice behind its first line
MARKS = ("rem", "dnl")  # comment marks with letters
GAP = f"[^a-z0-9]++(?:(?:{'|'.join(MARKS)})[^a-z0-9]++)*+"  # between two words of a text, with the comment marks of lines between them
CONTAINED = 0.8  # share of a key's phrases: all of up to four
ORDERS = (1, 2, 3)


def words(text: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), "[^a-z0-9]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    """``words`` of a plain notice, on the driver."""
    return re.findall("[a-z0-9]+", text.lower().replace("licence", "license"))


def _grams(found: list[str], orders: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(found[i:i + n]) for n in orders for i in range(len(found) - n + 1)}


def grams(found: Column, orders: tuple[int, ...] = ORDERS) -> Column:
    """The distinct word n-grams of a list of words."""
    def of_order(words: Column, n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    def of(words: Column) -> Column:
        return F.array_distinct(F.concat(*[of_order(words, n) for n in orders]))

    # bound to a name first, or each n-gram would split the text again
    return let(found, of)


def _pattern(phrases: Iterable[str], gap: str = " ") -> str:
    """A regular expression for any of the phrases as whole words, merged where they begin alike; ``gap`` matches what lies between two words."""
    def tree(rests: set[str]) -> str:
        heads: dict[str, set[str]] = {}
        for rest in sorted(rests - {""}):
            heads.setdefault(rest[0], set()).add(rest[1:])
        parts = [(gap if c == " " else c) + tree(more) for c, more in heads.items()]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + "?" * ("" in rests) if len(parts) > 1 or "" in rests else parts[0]

    found = set(phrases)
    return f"(?<![a-z0-9]){tree(found)}(?![a-z0-9])" if found else "(?!)"


def _text_lines(text_col: str) -> Column:
    """The words of each line, without its comment mark."""
    marked = [F.lit(m) for m in MARKS]
    return F.transform(F.split(F.col(text_col), "\n"), lambda line: let(
        words(line), lambda w: F.when(F.get(w, F.lit(0)).isin(*marked), F.slice(w, F.lit(2), F.size(w))).otherwise(w)))


def _reach(ahead: Column) -> Column:
    """How many of the lines ahead a joined notice reaches."""
    # n is negative behind the last line
    def step(s: Column, w: Column) -> Column:
        go = (s["n"] >= 0) & (s["n"] < REACH) & (F.size(w) > 0)
        return F.struct(F.when(go, s["n"] + F.size(w)).otherwise(-1).alias("n"), F.when(go, s["k"] + 1).otherwise(s["k"]).alias("k"))
    return F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), step)["k"]


def _hits(docs: DataFrame, listed: list[str], id_col: str, text_col: str) -> DataFrame:
    """``id, paragraph, grams`` of every line with words, alone and, where lines follow, joined with those it reaches: the listed n-grams in it.

    N-grams are looked for once in each line, at words that begin one, and once where a line meets the next; those of a joined line are put together from these.
    """
    firsts = sorted({g.split(" ")[0] for g in listed})

    def known(found: Column) -> Column:
        return F.filter(found, lambda g: g.isin(*listed))

    def of_line(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*firsts), i)), lambda i: i.isNotNull())
        # null where the line ends
        gram = lambda i, n: F.concat(*[x for k in range(n) for x in (F.lit(" "), F.get(w, i + k))][1:])
        return F.array_distinct(known(F.flatten(F.transform(at, lambda i: F.array(*[gram(i, n) for n in ORDERS])))))

    def across(lines: Column, w: Column, i: Column) -> Column:
        def of(x: Column) -> Column:
            joined = lambda *names: F.concat_ws(" ", *[x[n] for n in names])
            whole = F.array(F.when(x["c"].isNotNull(), joined("b", "c")), F.when(x["d"].isNotNull(), joined("b", "c", "d")),
                            F.when(x["a"].isNotNull() & x["c"].isNotNull(), joined("a", "b", "c")))
            return F.when(x["b"].isin(*firsts) | x["a"].isin(*firsts), known(whole)).otherwise(F.array().cast("array<string>"))
        return let(F.flatten(F.slice(lines, i + 2, 2)), lambda u: let(F.struct(
            F.try_element_at(w, F.lit(-2)).alias("a"), F.try_element_at(w, F.lit(-1)).alias("b"), F.get(u, F.lit(0)).alias("c"), F.get(u, F.lit(1)).alias("d")), of))

    def of_text(lines: Column) -> Column:
        each = F.transform(lines, lambda w, i: F.struct(
            F.size(w).alias("n"), of_line(w).alias("own"), across(lines, w, i).alias("on"), _reach(F.slice(lines, i + 2, REACH)).alias("k")))

        def of(x: Column) -> Column:
            whole = lambda i, k: F.array_distinct(F.flatten(F.concat(F.slice(x["own"], i + 1, k + 1), F.slice(x["on"], i + 1, k))))
            rows = F.transform(x, lambda y, i: F.struct(i.alias("paragraph"), y["n"].alias("n"), F.array(
                y["own"], F.when(y["k"] > 0, whole(i, y["k"]))).alias("grams")))
            return F.filter(rows, lambda r: r["n"] > 0)
        return let(each, of)

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), let(_text_lines(text_col), of_text).alias("found"))
    # outer explodes: for the others the optimizer adds a filter that evaluates the arrays again
    lines = rows.select("id", F.explode_outer("found").alias("x")).select("id", "x.paragraph", F.explode_outer("x.grams").alias("grams"))
    return lines.filter(F.col("grams").isNotNull())


def _lines(docs: DataFrame, id_col: str, text_col: str, having: str | None = None, starting: Column | None = None) -> DataFrame:
    """``doc, id, paragraph, words, behind`` of lines with words; ``behind`` holds the words of the paragraph's next lines, as many as begin within
    ``REACH`` words. With ``having``, only lines whose words match this pattern, and lines with one of ``starting`` in texts that hold a key."""
    def behind(lines: Column, i: Column) -> Column:
        return F.slice(lines, i + 2, _reach(F.slice(lines, i + 2, REACH)))

    def of(lines: Column, joined: Column) -> Column:
        def wanted(w: Column) -> Column:
            return F.lit(True) if having is None else F.regexp_like(_spaced(w), F.lit(having)) | (joined & F.arrays_overlap(w, starting))
        some = F.filter(F.transform(lines, lambda w, i: F.struct(i.alias("paragraph"), w.alias("words"))), lambda x: (F.size(x["words"]) > 0) & wanted(x["words"]))
        none = F.array().cast("array<array<string>>")
        return F.transform(some, lambda x: F.struct(x["paragraph"], x["words"], F.when(joined, behind(lines, x["paragraph"])).otherwise(none).alias("behind")))

    split = _text_lines(text_col)
    joined = (lambda lines: F.lit(True)) if having is None else lambda lines: _keyed(F.flatten(lines))
    both = let(split, lambda lines: F.struct(lines.alias("lines"), joined(lines).alias("joined")))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"),
                                                            let(both, lambda x: of(x["lines"], x["joined"])).alias("found"))
    # an outer explode: for the other the optimizer adds a filter that evaluates the array again
    return rows.select("doc", "id", F.explode_outer("found").alias("x")).filter(F.col("x").isNotNull()).select("doc", "id", "x.*")


def _rarest(phrase: str, shared: Counter) -> str:
    return min(phrase.split(" "), key=lambda w: (shared[w], -len(w)))


def _phrases() -> list[str]:
    """Phrases of which words that hold a key have one: of each key as many as it must not lack all."""
    return sorted({p for keys in KEYS.values() for k in keys for p in k[:1 + int(len(k) * (1 - CONTAINED) + 1e-9)]})


def _keyed(found: Column) -> Column:
    """Whether words can hold a key."""
    shared = _families_of({f: [set(w) for w in all_] for f, all_ in _wordings().items()})
    phrases = _phrases()
    return let(found, lambda w: F.arrays_overlap(w, _array(sorted({_rarest(p, shared) for p in phrases})))
               & let(_spaced(w), lambda t: reduce(or_, [F.contains(t, F.lit(f"{p} ")) for p in phrases])))


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # by class; the last is unknown
    weights: dict[str, tuple[float, ...]]  # by n-gram, without those that weigh nothing
    intercept: tuple[float, ...]
    least: float


def _wordings() -> dict[str, list[list[str]]]:
    """The words of all notices of each family: a list bounded by the constants above."""
    out = {}
    for family in TEMPLATES:
        framed = [frame.format(name) for frame in FRAMES for name in NAMES[family]]
        out[family] = [_words(t) for t in (*TEMPLATES[family], *TEXTS.get(family, ()), *framed)]
    return out


def _families_of(parts: dict[str, list[set[str]]]) -> Counter:
    """How many families have each part."""
    return Counter(g for sets in parts.values() for g in set().union(*sets))


def _array(values) -> Column:
    """A constant list of n-grams or family names, which hold no quotes."""
    return F.expr("array(" + ",".join(f"'{v}'" for v in values) + ")") if values else F.array().cast("array<string>")


def train(docs: DataFrame, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all lines of ``docs``, or with ``sample`` from those of documents that have about so many lines."""
    spark = docs.sparkSession
    families = (*TEMPLATES, UNKNOWN)
    known = _wordings()
    # a word that only one family has is never left out: without it a notice may be another family's
    shared = _families_of({f: [set(w) for w in all_] for f, all_ in known.items()})
    whole_ones = {f: len(TEMPLATES[f]) + len(TEXTS.get(f, ())) for f in known}
    positive = [(f, w) for f, all_ in known.items() for w in all_]
    positive += [(f, [x for x in w if x != left]) for f, all_ in known.items() for w in all_[:whole_ones[f]] for left in w if shared[left] > 1]
    having = _families_of({f: [_grams(w) for w in all_] for f, all_ in known.items()})
    # what most families have is the frame of a notice and names none
    listed = sorted(g for g, n in having.items() if 2 * n <= len(TEMPLATES))
    if sample is not None:
        whole, total = 1 << 30, max(1, docs.count())
        docs = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(whole)) < min(whole, whole * sample // (4 * total)))
    half = F.pmod(F.xxhash64("id", "paragraph", F.lit(1)), F.lit(2)).alias("half")
    long_ones = F.exists("grams", lambda g: F.size(F.split(g, " ")) == 3)
    # with ``sample`` a quarter of the lines of its documents, as its share of documents takes for granted
    some = F.lit(True) if sample is None else F.pmod(F.xxhash64("id", "paragraph"), F.lit(4)) == 0
    plain = materialize(_hits(docs, listed, id_col, text_col).filter(some & ~long_ones).select(half, "grams"), "licence-lines")
    n = plain.count()
    # bounded by the notices
    counts = {r["g"]: r["count"] for r in plain.select(F.explode("grams").alias("g")).groupBy("g").count().collect()}
    often = {g for g, c in counts.items() if c > RARE * n}
    features = [g for g in listed if g not in often]
    label = {f: float(i) for i, f in enumerate(families)}
    kept = set(features)
    # lines with the same features are one row
    lines = materialize(plain.select("half", F.array_sort(F.filter("grams", lambda g: g.isin(*features))).alias("grams"))
                        .groupBy("half", "grams").agg(F.count("*").alias("n")), "licence-examples")
    positive = Counter((label[f], tuple(sorted(_grams(w) & kept))) for f, w in positive)
    examples = spark.createDataFrame([(f, list(g), float(c)) for (f, g), c in sorted(positive.items())], "label double, grams array<string>, weight double")
    negative = lines.filter("half = 0").select("grams", F.log2(F.col("n") + 1).alias("weight"))
    # the lines grow with the table and the notices don't: without a limit their weight would leave the families none
    total = negative.agg(F.sum("weight")).first()[0] or 0.0
    share = min(1.0, sum(positive.values()) / total) if total else 1.0
    none = spark.createDataFrame([(label[UNKNOWN], [], 1.0)], examples.schema)
    vectors = CountVectorizerModel.from_vocabulary(features, inputCol="grams", outputCol="features", binary=True)
    examples = examples.unionByName(negative.select(F.lit(label[UNKNOWN]).alias("label"), "grams", (F.col("weight") * share).alias("weight"))).unionByName(none)
    # as many parts as the examples fill: each step of the fit is a task for every part
    examples = materialize(examples, "licence-weights").hint("rebalance").sortWithinPartitions("label", "grams")
    fitted = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=40, weightCol="weight").fit(vectors.transform(examples))
    coefficients = fitted.coefficientMatrix.toArray()
    weights = {g: tuple(float(x) for x in coefficients[:, i]) for i, g in enumerate(features) if coefficients[:, i].any()}
    model = Model(families, weights, tuple(float(x) for x in fitted.interceptVector), 0.5)
    # calibration on the other half
    held = lines.filter("half = 1").select(F.monotonically_increasing_id().alias("row"), "n", F.array_intersect("grams", _array(weights)).alias("grams"))
    over = int(FALSE_RATE * (held.agg(F.sum("n")).first()[0] or 0))
    scored = _scores(held, model, "n").filter((F.col("class") < len(families) - 1) & (F.col("probability") >= 0.5))
    least = 0.5
    # from the highest step down, of which there are at most half of ``STEPS``
    for r in scored.groupBy(F.floor(F.col("probability") * STEPS).alias("step")).agg(F.sum("n").alias("n")).orderBy(F.desc("step")).toLocalIterator():
        over -= r["n"]
        if over < 0:
            least = (r["step"] + 1) / STEPS
            break
    return Model(families, weights, model.intercept, max(0.5, least))


def _scores(rows: DataFrame, model: Model, *carried: str) -> DataFrame:
    """``row, class, probability`` and ``carried`` from ``row, grams`` for rows with any n-gram of the model."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(g, list(w)) for g, w in model.weights.items()], "gram string, weights array<double>")
    # the model is bounded by the templates; the rows are not
    each = rows.select("row", *carried, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    size = len(model.families)
    sums = each.groupBy("row").agg(*[F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(size)], *[F.first(c).alias(c) for c in carried])
    z = [F.col(f"s{i}") + model.intercept[i] for i in range(size)]
    top = F.greatest(*z)
    best = F.array_max(F.array(*[F.struct(z[i].alias("z"), F.lit(i).alias("class")) for i in range(size)]))
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    return sums.select("row", *carried, best["class"].alias("class"), (1 / total).alias("probability"))


def _share(line: Column, keys: tuple[tuple[str, ...], ...]) -> Column:
    """The largest share of a key's phrases in words with a space before and behind each."""
    parts = [sum((F.contains(line, F.lit(f" {p} ")).cast("int") for p in key), F.lit(0)) / float(len(key)) for key in keys]
    return F.greatest(*parts, F.lit(0.0), F.lit(0.0))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity`` of every line that has a feature; ``paragraph`` counts lines from 0. A line
    at which a joined notice begins has that notice's row instead of an ``unknown`` one, and where notices of several families begin a row for each."""
    # only lines with an n-gram of the model have a feature, and only texts with a phrase of a key have joined notices; no other line is cut into n-grams
    having = _pattern(model.weights)
    # with the first word of a phrase a joined notice begins
    firsts = _array(sorted({p.split(" ")[0] for keys in KEYS.values() for key in keys for p in key}))
    lowered = F.replace(F.lower(text_col), F.lit("licence"), F.lit("license"))
    some = docs.filter(F.regexp_like(lowered, F.lit(_pattern([*model.weights, *_phrases()], GAP))))
    lines = materialize(_lines(some, id_col, text_col, having, firsts), "licence-lines")

    # for each class, how much of its best key a line holds
    def shares(line: Column) -> Column:
        return let(line, lambda x: F.array(*[_share(x, KEYS.get(f, ())) for f in model.families]))

    alone = lines.filter(F.regexp_like(_spaced(F.col("words")), F.lit(having))).select("doc", "id", "paragraph", "words", F.lit(None).cast("int").alias("wanted"))
    most = _spaced(F.concat("words", F.flatten("behind")))
    reached = lines.filter("size(behind) > 0").withColumn("own", shares(_spaced(F.col("words")))).withColumn("most", shares(most))
    reached = reached.filter(F.exists(F.arrays_zip("own", "most"), lambda x: (x["most"] >= CONTAINED) & (x["own"] < CONTAINED)))
    upto = lambda n: F.flatten(F.slice("behind", F.lit(1), n))
    reached = materialize(reached.drop("own", "most"), "licence-starts")
    runs = reached.select("doc", "id", "paragraph", "words", "behind", F.explode(F.sequence(F.lit(1), F.size("behind"))).alias("k"))
    runs = (runs.withColumn("whole", F.concat("words", upto(F.col("k")))).withColumn("shares", shares(_spaced(F.col("whole"))))
            .withColumn("sooner", shares(_spaced(F.concat("words", upto(F.col("k") - 1))))).withColumn("later", shares(_spaced(upto(F.col("k"))))))
    new = F.filter(F.sequence(F.lit(0), F.lit(len(model.families) - 1)), lambda i: (F.get("shares", i) >= CONTAINED) & (F.get("sooner", i) < CONTAINED)
                   & (F.get("later", i) < CONTAINED))
    runs = runs.select("doc", "id", "paragraph", F.col("whole").alias("words"), F.explode(new).alias("wanted"))
    known = _array(sorted(model.weights))
    found = (alone.unionByName(runs).withColumn("grams", F.array_intersect(grams(F.col("words")), known)).filter("size(grams) > 0")
             .select(F.monotonically_increasing_id().alias("row"), "doc", "id", "paragraph", "grams", "wanted",
                     shares(_spaced(F.col("words"))).alias("shares")))
    found = materialize(found, "licence-paragraphs")
    scored = _scores(found, model, "doc", "id", "paragraph", "wanted", "shares").withColumn("best", F.get(_array(model.families), F.col("class")))
    scored = scored.withColumn("similarity", F.get("shares", F.col("class")))
    sure = (F.col("probability") >= model.least) & (F.col("similarity") >= CONTAINED) & (F.col("best") != UNKNOWN)
    scored = scored.withColumn("family", F.when(sure, F.col("best")).otherwise(UNKNOWN))
    scored = scored.filter(F.col("wanted").isNull() | ((F.col("wanted") == F.col("class")) & (F.col("family") != UNKNOWN)))
    joins = F.count("wanted").over(W.partitionBy("doc", "paragraph"))
    scored = scored.withColumn("joins", joins).filter(F.col("wanted").isNotNull() | (F.col("joins") == 0) | (F.col("family") != UNKNOWN))
    return scored.select(F.col("id").alias(id_col), "paragraph", "family", "probability", "similarity")
