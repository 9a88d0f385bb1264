"""Ingredient candidates and their match with the memory, against values worked out by hand and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from docledger.functions import candidates
from docledger.operators import candidates as ops

#: Text: name, code, total, confidence, conflicts, scores of its phrases.
TEXTS = {
    "WHO - STRAWBERRIES Punnet 250g": ("STRAWBERRIES Punnet", None, "250.0 g", 0.8, [], [0.0, 6.556]),
    "10x1kg Tomatoes": ("10x1kg Tomatoes", None, "10.0 kg", 0.8, [], [1.333]),
    "NOR008 Norwegian Salmon Fresh Whole 10.90kg": ("Norwegian Salmon Fresh Whole", "NOR008", None, 0.364, [candidates.NUMERIC], [5.556]),
    "CHE009 Cheese 1kg": ("Cheese", "CHE009", "1.0 kg", 0.95, [], [1.0]),
    "case 24 Bananas": ("case Bananas", None, None, 0.4, [], [3.167]),
    "Salmon fillet - Chicken wings large - Rice": ("Chicken wings large", None, None, 0.4, [candidates.MERGED], [3.222, 5.056, 1.0]),
    "can whole peeled tomatoes": ("whole peeled tomatoes", None, None, 0.4, [], [5.389]),
    "BAG": ("", None, None, 0.0, [], [0.0]),
    "Tea 0 kg": ("Tea", None, None, 0.4, [], [1.0]),
    "": ("", None, None, 0.0, [], []),
    None: ("", None, None, 0.0, [], []),
}


def test_candidates_by_hand(spark):
    given = spark.createDataFrame([(t, i) for i, t in enumerate(TEXTS)], "text string, _d int")  # a column named like one inside
    got = {}
    for r in candidates.candidates(given, "text").collect():
        c = r["candidate"]
        got[r["text"]] = (c["name"], c["code"], c["pack_total"], round(c["confidence"], 3), c["conflicts"], [p["score"] for p in c["phrases"]])
        assert r["_d"] == list(TEXTS).index(r["text"])
    assert {k: v[:3] + (pytest.approx(v[3]),) + v[4:] for k, v in got.items()} == TEXTS
    assert candidates.candidates(given.limit(0), "text").collect() == []


def test_long_text_and_reasons(spark):
    long = "Red beans - " * 3000 + "green peas"
    c = candidates.candidates(spark.createDataFrame([(long,)], "text string"), "text").first()["candidate"]
    assert len(c["phrases"]) == 3001 and c["conflicts"] == [candidates.MERGED] and c["name"] == "green peas"
    assert c["selection_reason"].endswith("longer descriptive phrase, appears after short prefix separator, contains descriptive modifier, only one or two generic-looking tokens")


def memory(spark, rows):
    return spark.createDataFrame(rows, "id long, normalized_key string, status string, aliases array<string>, variants array<struct<code string, description string, name string>>")


def test_match_by_hand(spark):
    known = [
        (1, "salmon fillet", "approved", None, None), (2, "rice basmati", "proposed", [], []),
        (3, "oil", "approved", ["Sunflower  OIL"], [("ZZ111", None, None), (None, "same words", "")]), (4, "salmon fillet", "proposed", ["sunflower oil"], [("ZZ111", "x", "y")]),
    ]
    texts = [
        "Salmon Fillet", "Rice Basmati", "sunflower oil", "ZZ111 Corn flakes", "Rice basmati brown", "Rice basmati  Brown", None, "Purple yam", "Yam",
        "Chicken - Rice paper", "same words", "1 2 3 4 Salmon Fillet", "***",
    ]
    rows = candidates.candidates(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "text")
    found = {r["n"]: tuple(r)[1:] for r in ops.matched(ops.analysed(rows), memory(spark, known), "n").collect()}
    # state, record, type, target, kind, of
    assert found == {
        0: ("matched", 1, None, None, None, None),
        1: ("proposed", None, "attach_supplier_variant", 2, "exact", 1),
        2: ("matched", 3, None, None, None, None),
        3: ("matched", 3, None, None, None, None),
        4: ("proposed", None, "attach_supplier_variant", 2, "likely", 4),
        5: ("duplicate", None, "attach_supplier_variant", 2, "likely", 4),
        6: ("none", None, None, None, None, None),
        7: ("proposed", None, "create_new", None, None, 7),
        8: ("proposed", None, "insufficient_evidence", None, None, 8),
        9: ("proposed", None, "possible_merge", 2, "likely", 9),
        10: ("matched", 3, None, None, None, None),
        11: ("proposed", None, "insufficient_evidence", 1, "exact", 11),
        12: ("none", None, None, None, None, None),
    }
    nothing = {r["state"] for r in ops.matched(ops.analysed(rows), memory(spark, []), "n").collect()}
    assert nothing == {"none", "proposed", "duplicate"}
    assert ops.matched(ops.analysed(rows.limit(0)), memory(spark, known), "n").collect() == []


def test_likely_equals_a_loop(spark):
    rng = random.Random(7)
    some = lambda n: sorted({" ".join(rng.sample("abcdefghij", rng.randint(1, 6))) for _ in range(n)} | {"hot a", "hot b", "hot"})
    wanted, known = some(150), [(k, i) for i, k in enumerate(some(120))]
    expected = {}
    for key in wanted:
        a, best = set(key.split()), (0, None)
        for other, i in known:
            b = set(other.split())
            share = len(a & b) / max(len(a), len(b))
            if share > best[0]:
                best = (share, i)
        if best[0] >= 0.5:
            expected[key] = best[1]
    got = ops.likely(spark.createDataFrame([(k,) for k in wanted], "key string"), spark.createDataFrame(known, "key string, id long"))
    assert {r["key"]: r["target"] for r in got.collect()} == expected
