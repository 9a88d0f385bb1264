"""Ranked lexical search, toxic passages and conversation repair."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from docledger.llm import lexical, repair, toxicity
from docledger.llm.oracles import SQL
from docledger.llm.queries import op11_lexical_search, op12_toxicity, op13_repair

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    """docs: (id, text); items: (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    held = defaultdict(set)
    for i, t in items:
        held[i] |= set(terms(t))
    found = []
    for item, own in held.items():
        scored = []
        for i, c, size in counts:
            m = 100 - 90 + (90 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        found += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(found)


def rows_of(found):
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the CAT sat"), (1, "dog door dog"), (2, None), (3, ""), (None, "lorem, ipsum!"), (4, "tür größe Ä 12"), (5, "nothing-found zzz"), (6, "lorem " * 5000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, doc_id string, score int")


@pytest.mark.parametrize("block_bytes", [32 << 20, 250, 1])
def test_search_against_brute_force(spark, odd, none, items, block_bytes):
    """In one block, in several, and with every item beyond the bound of a broadcast, so that the join takes them."""
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = plain_search(docs, [(r["item_id"], r["text"]) for r in items.collect()], 3)
    assert rows_of(lexical.search(odd, items, 3, block_bytes=block_bytes)) == expected and len(expected) == 7
    assert rows_of(lexical.search(none, items, 3, block_bytes=block_bytes)) == Counter()
    assert rows_of(lexical.search(odd, items.limit(0), 3, block_bytes=block_bytes)) == Counter()


def test_search_query(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert rows_of(op11_lexical_search(spark, SF)) == plain_search(docs, [(r["item_id"], r["text"]) for r in items], 10)


def test_heaps_keep_the_best():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 6, (400, 7)), np.arange(400)[::-1].copy()
    heaps = lexical.Heaps(7, 4)
    for at in range(0, 400, 9):
        heaps.add(scores[at : at + 9], ids[at : at + 9], ids[at : at + 9] % 50 == 0)
        heaps.merge()
    item, score, doc, null = heaps.merge()
    for i in range(7):
        best = sorted((-int(s), int(d) % 50 == 0, int(d)) for s, d in zip(scores[:, i], ids, strict=True) if s > 0)[:4]
        assert [(-int(s), bool(n), int(d)) for j, s, d, n in zip(item, score, doc, null, strict=True) if j == i] == best


def plain_segments(s):
    """Maximal segments by definition: the best one, then those of what lies before and after it."""
    best = max(((sum(s[a:z]), -(z - a), -a, a, z) for a in range(len(s)) for z in range(a + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    total, _, _, a, z = best
    return plain_segments(s[:a]) + [(a, z, total)] + [(a2 + z, z2 + z, t) for a2, z2, t in plain_segments(s[z:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.choice([-7, -3, -1, 2, 5, 11]) + rng.random() / 64 for _ in range(rng.choice([0, 1, 9, 14]))] for _ in range(4)]
        flat = np.array([x for t in texts for x in t])
        got = toxicity.segments(flat, np.array([len(t) for t in texts]))
        for own, t in zip(got, texts, strict=True):
            assert [x[:2] for x in own] == [x[:2] for x in plain_segments(t)]
            assert [x[2] for x in own] == pytest.approx([x[2] for x in plain_segments(t)])


def test_odds_follow_the_stem_and_count_no_document_twice():
    odds = toxicity.log_odds({"b": (40, 40), "ba": (20, 0), "bad": (20, 0), "bad\n": (20, 0), "bo": (20, 40), "box": (1, 0)}, 100, 100)
    assert odds["bad\n"] == odds["bad"] == odds["ba"] > 1.5 and abs(odds["b"]) < 0.3 and odds["bo"] < 0.1
    model = toxicity._with_scores(odds)
    import pyarrow as pa

    said = model.word_scores(pa.array(["bad", "badly", "baz", "xyz"])) + toxicity.DRIFT
    assert said[0] == said[1] == said[2] > 1.5 and said[3] == 0


def test_surprise_grows_with_score_and_shrinks_with_length():
    m = toxicity.Model(lam=1.0, k=0.1)
    assert m.surprise([], 100) == 0 and m.surprise([9.0], 100) > m.surprise([8.0], 100) > m.surprise([8.0], 1000) > 0
    assert m.surprise([9.0, 9.0, 9.0], 100) > m.surprise([9.0], 100)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = op12_toxicity(spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.6 and held[held.toxic == 0].predicted.mean() < 0.03


def test_toxicity_of_odd_rows(spark, odd, none):
    text = "you are awful rotten and awful"
    docs = spark.createDataFrame([(i, text if i % 2 else f"you are kind number {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    more = docs.withColumn("score_", docs["doc_id"])
    got = {r["doc_id"]: r for r in toxicity.scan(more, ["doc_id", "score_"], model).collect()}
    assert all(got[i]["predicted"] == i % 2 and got[i]["score_"] == i for i in got)
    assert "awful rotten" in got[1]["passages"][0]["words"] and not got[2]["passages"]
    seen = toxicity.scan(odd, ["doc_id"], model).collect()
    assert len(seen) == 12 and len({r["score"] for r in seen if r["doc_id"] in (4, 5, 6)}) == 1 and all(0 <= r["score"] < 0.5 for r in seen if r["doc_id"] in (4, 5, 6, 7))
    assert toxicity.scan(none, ["doc_id"], model).collect() == []
    for bad in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.fit(docs, bad) is None
    assert {r["score"] for r in toxicity.scan(odd, ["doc_id"], None).collect()} == {0.0}
    assert toxicity.fit(none.select("doc_id", "text"), labels) is None


def plain_repair(rows):
    """Cheapest edits, least letters, with the whole strings at hand. rows: (initial, fault)."""

    def inserted(best):
        for _ in range(2):
            for q, (cost, way) in list(best.items()):
                best[repair.NEXT[q]] = min(best.get(repair.NEXT[q], (math.inf, "")), (cost + 3, way + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, fault in rows:
        found = defaultdict(lambda: (math.inf, ""))
        for q, (cost, way) in best.items():
            found[q] = min(found[q], (cost + 4, way + "D"))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                late, to = 3 * (fault == repair.TRUNCATED), repair.NEXT[q]
                if q == 0 and initial == "s":
                    found[1] = min(found[1], (cost + late, way + "K"))
                if initial == repair.INITIAL[to]:
                    found[to] = min(found[to], (cost + late, way + "K"))
                found[to] = min(found[to], (cost + late + 3, way + "R"))
        best = inserted(dict(found))
    return min(best[q] for q in (0, 3) if q in best)


def test_repair_against_brute_force():
    rng = random.Random(7)
    for _ in range(3000):
        of = "uuuaaasts"[: rng.randint(1, 9)]
        rows = [(rng.choice(of), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 14))]
        conv, found = repair.Repair(), []
        for i, (initial, fault) in enumerate(rows):
            found += conv.step(initial, fault, (i,))
        cost, rest = conv.finish()
        assert (cost, "".join(n.letter for n in found + rest)) == plain_repair(rows)
        assert [n.row[0] for n in found + rest if n.row] == list(range(len(rows)))


def test_repair_holds_what_is_open_alone():
    """Edits come out while rows go in; a long run of ties stays open, and is decided right."""
    rng, conv, out, most = random.Random(1), repair.Repair(), 0, 0
    for i in range(20_000):
        out += len(conv.step("ua"[i % 2] if rng.random() < 0.9 else "s", rng.choice([0] * 9 + [1, 3]), (i,)))
        most = max(most, i + 1 - out)
    assert most < 200
    tied = [("u", 0)] * 300
    conv = repair.Repair()
    found = [n for i, r in enumerate(tied) for n in conv.step(*r, (i,))]
    cost, rest = conv.finish()
    assert (cost, "".join(n.letter for n in found + rest)) == plain_repair(tied)


def test_repair_of_odd_conversations(spark, tmp_path):
    """Nulls everywhere, ties of turns, repeated rows, long texts, unknown roles: the query's SQL agrees."""
    rng = random.Random(11)
    said = ["Yes.", "No!", "and then", "", " \t", None, "x. " * 20_000, "Ünd?\x0b", ":", "A\nb."]
    rows = [(rng.choice([1, 2, 3, 4, None, 9]), rng.choice([None, 1, 2, 3, 5, 8, -2]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(said)) for _ in range(150)]
    rows += [(100, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(40)] + [(i, 0, "user", "Hi.") for i in range(200, 260)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    answer = con.execute(SQL["op13_repair"])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(list(r)) for r in got.select(*names).collect()) == sorted(repr(list(r)) for r in answer.fetchall())
    gone = [r for r in got.collect() if r["audit"] == ""]
    assert gone and all(r["cost"] == 0 and r["repaired_sha256"].startswith("e3b0c442") for r in gone)


def test_repair_gives_the_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi.", False), (1, 1, "user", "Again.", False), (1, 2, "assistant", "", False), (2, 0, "user", "gone", True)]
    edits = repair.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, dropped boolean"))
    got = sorted(edits.collect(), key=lambda r: (r["conv_id"], r["at"]))
    assert [(r["edit"], r["role"], r["text"]) for r in got if r["conv_id"] == 1] == [("K", "user", "Hi."), ("R", "assistant", "Again."), ("D", "assistant", ""), (None, None, None)]
    assert [tuple(r["summary"]) for r in got if r["summary"]] == [(0, 1, 0, 0, 1, 7), (0, 0, 0, 0, 0, 0)]
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn int, role string, text string, dropped boolean")).collect() == []
