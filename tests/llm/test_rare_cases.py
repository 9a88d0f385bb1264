"""Rare words, notices in short forms, and documents without an id."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import langid, licenses, mixing


def test_expected_pieces_of_improbable_words():
    """Words whose probability no double holds: the same uses as by exact sums of logarithms, all finite."""
    table = langid.pieces(langid.vocabulary_path())
    rng = np.random.default_rng(2)
    probs = np.full((table.size, 2), 1e-7)
    probs[:, 1] = rng.uniform(1e-9, 1e-7, table.size)
    probs[0] = 0
    words, lang = ["q" * 64, "xkcdqz" * 10, "the"], np.array([0, 1, 1])

    def plain(word, g):
        units, n = "▁" + word, len(word) + 1
        piece = lambda a, z: table.find(langid._hash(langid._codes([units[a:z]], z - a)))[0] or (1 if z - a == 1 else 0)
        found = {(a, z): p for a in range(n) for z in range(a + 1, min(n, a + table.longest) + 1) if (p := piece(a, z))}
        ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for z in range(1, n + 1):
            ahead[z] = np.logaddexp.reduce([ahead[a] + math.log(probs[p, g]) for (a, e), p in found.items() if e == z])
        for a in range(n - 1, -1, -1):
            back[a] = np.logaddexp.reduce([math.log(probs[p, g]) + back[e] for (b, e), p in found.items() if b == a])
        out = np.zeros(probs.shape)
        for (a, z), p in found.items():
            out[p, g] += math.exp(ahead[a] + math.log(probs[p, g]) + back[z] - ahead[n])
        return out

    got = langid.expected_pieces(words, lang, np.array([2.0, 1.0, 3.0]), table, probs)
    expected = sum(w * plain(x, g) for x, g, w in zip(words, lang, (2.0, 1.0, 3.0), strict=True))
    assert np.isfinite(got).all() and got == pytest.approx(expected, rel=1e-6, abs=1e-12)


@pytest.mark.parametrize(
    ("notice", "labels"),
    [
        ("SPDX-License-Identifier: MIT", ["mit"]), ("SPDX-License-Identifier: Apache-2.0", ["apache-2.0"]), ("// SPDX-License-Identifier: ISC", ["isc"]), ("This is free software, GPLv3+", ["gpl-3"]),
        ("LGPLv2.1 or later", ["lgpl-2.1"]), ("licensed under the Apache 2.0 license", ["apache-2.0"]), ("Copyright Jo. All rights reserved.", []), ("under the AGPLv3", ["agpl-3"]),
        ("Copyright (c) Jo. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted", ["bsd"]),
    ],
)
def test_common_notices(notice, labels):
    assert sorted({r.label for _, _, r in licenses.Scanner().detections(licenses.canonical(notice)[0])}) == labels


def test_documents_without_an_id_meet_the_target(spark):
    """A thousand of them, told apart by their texts: what is taken comes within a document of the target."""
    rows = [(None, "a", 100, None, f"text {i}") for i in range(1000)] + [(i, "b", 100, None, None) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double, told string")
    got = mixing.mix(table, "told").groupBy("source", "target").agg({"size": "count"}).drop("count(size)")
    taken = {r["source"]: r["taken"] for r in mixing.mix(table, "told").groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("taken")).collect()}
    for r in got.collect():
        assert abs(taken[r["source"]] - r["target"]) <= 100 and r["target"] in (50_000, 100_000)
