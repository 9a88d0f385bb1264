"""Rows, regions and structure of pages, and fuzzy dedupe, against plain loops and values worked out by hand."""

import random
from collections import Counter

import pytest

from docledger.operators import dedupe, regions, rows

LINES = "page long, line long, y double, height double, text string, has_desc boolean, has_nums boolean, described boolean, values array<double>"


def line(n, y, text="", values=(), page=1, height=16.0):
    return (page, n, float(y), height, text, len(text) > 2, bool(values), text != "", [float(v) for v in values])


def plain_rows(lines):
    """The row of each line, page by page, in one loop."""
    found, now = {}, {}
    for page, n, y, height, _, desc, nums, told, values in sorted(lines, key=lambda r: (r[0], r[2], r[1])):
        row, h = now.get(page), height or 16.0
        rule = None
        if row and y - row["y"] <= max(45.0, h * 1.1):
            if not row["desc"]:
                rule = "no_text_yet"
            elif not row["nums"] and nums:
                rule = "numbers_follow"
            elif not nums:
                rule = "text_follows"
            elif y - row["y"] <= h * 0.75 and not (row["told"] and rows.computes(row["values"])):
                rule = "incomplete"
        if not rule:
            row = now[page] = {"row": n, "desc": False, "nums": False, "told": False, "values": []}
        row.update(y=y, desc=row["desc"] or desc, nums=row["nums"] or nums, told=row["told"] or told, values=row["values"] + values)
        found[page, n] = (row["row"], rule or "opens", row["told"] and rows.computes(row["values"]))
    return found


def test_the_four_rules_by_hand(spark):
    given = [
        line(1, 100, "Rice 10kg", [2, 5, 10]), line(2, 200, "", [1, 2, 3]), line(3, 220, "late name"), line(4, 300, "Oil"), line(5, 320, "", [3, 4, 12]),
        line(6, 400, "Salt", [3, 4, 12]), line(7, 430, "in bags"), line(8, 500, "Flour", [2]), line(9, 510, "", [5, 10]), line(10, 520, "", [9]), line(11, 540, "Tea", [1, 1, 1]),
    ]
    got = {r["line"]: (r["row"], r["rule"]) for r in rows.rebuilt_lines(spark.createDataFrame(given, LINES)).collect()}
    assert got == {
        1: (1, "opens"), 2: (2, "opens"), 3: (2, "no_text_yet"), 4: (4, "opens"), 5: (4, "numbers_follow"), 6: (6, "opens"), 7: (6, "text_follows"),
        8: (8, "opens"), 9: (8, "incomplete"), 10: (10, "opens"), 11: (10, "no_text_yet"),
    }


def random_lines(seed, pages, longest):
    rng, out = random.Random(seed), []
    for page in pages:
        y = 0.0
        for n in range(rng.randint(1, longest)):
            y += rng.choice([5, 11, 12, 13, 20, 40, 45, 46, 90])
            text, values = rng.choice(["", "ab", "rice", "oil"]), rng.choice([[], [2, 3, 6], [2], [3, 6], [7, 7, 1], [-2, 3, 6]])
            out.append(line(n, y, text, values, page, rng.choice([16.0, 16.0, None]) if page else 16.0))
    return [r if r[3] else (*r[:3], 0.0, *r[4:]) for r in out]


def test_rows_against_a_loop(spark):
    given = random_lines(3, range(40), 60)
    got = {(r["page"], r["line"]): (r["row"], r["rule"], r["complete"]) for r in rows.rebuilt_lines(spark.createDataFrame(given, LINES)).collect()}
    assert got == plain_rows(given)
    assert rows.rebuilt_lines(spark.createDataFrame([], LINES)).collect() == []


def test_a_long_page_is_shared_by_tasks(spark):
    given = random_lines(5, [7], 30_000)
    table = spark.createDataFrame(given, LINES).repartition(8)
    cut = rows.segments(table.selectExpr("*", "45.0 as reach", "12.0 as tight").drop("height"))
    sizes = Counter(r["segment"] for r in cut.collect())
    assert len(sizes) > len(given) / 100 and max(sizes.values()) < len(given) / 20
    got = {(r["page"], r["line"]): (r["row"], r["rule"], r["complete"]) for r in rows.rebuilt_lines(table).collect()}
    assert got == plain_rows(given)


def test_recovery_by_hand(spark, monkeypatch):
    schema = "page long, row long, y double, text string, has_desc boolean, has_nums boolean"
    given = [
        (1, 1, 10.0, "rice", True, False), (1, 2, 30.0, "2 5 10", False, True), (1, 3, 90.0, "oil 1 2 2", True, True), (1, 4, 100.0, "?", False, False),
        (2, 1, 10.0, "first part", True, False), (2, 2, 20.0, "second", True, False), (3, 1, 10.0, "5 6", False, True), (3, 2, 25.0, "bank charge", True, False),
        (4, 1, 0.0, "7", False, True), (4, 2, 30.0, "tea", True, False), (5, 1, 0.0, "alone", True, False),
    ]
    expected = {
        (1, 1): ("split_row_merged", 0.85, 2, "rice 2 5 10", None), (1, 2): ("fragment_merge", 0.9, 1, "rice 2 5 10", None), (1, 3): ("none", 1.0, None, "oil 1 2 2", "skip_both_have_descriptions"),
        (1, 4): ("none", 1.0, None, "?", "skip_mixed_content_types"), (2, 1): ("wrapped_description", 0.8, 2, "first part second", None), (2, 2): ("wrapped_description", 0.8, 1, "first part second", None),
        (3, 1): ("none", 1.0, None, "5 6", "skip_footer_or_banking"), (3, 2): ("split_row_merged", 0.85, 1, "5 6 bank charge", None), (4, 1): ("none", 1.0, None, "7", "skip_gap_too_large"),
        (4, 2): ("split_row_merged", 0.85, 1, "7 tea", None), (5, 1): ("none", 1.0, None, "alone", None),
    }
    for block in (4096, 4):
        monkeypatch.setattr(rows, "BLOCK", block)
        got = rows.recovered(spark.createDataFrame(given, schema)).collect()
        assert {(r["page"], r["row"]): (r["source"], r["confidence"], r["with"], r["text"], r["skipped"]) for r in got} == expected


def tidy(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_read_where_they_lie_give_the_same_rows(spark, monkeypatch, small_batches):
    """Whole pages, ranges of pages, and both, for short and long pages; lines without a page are a page; numbers of lines do not follow their places."""
    given = random_lines(11, [None, *range(25)], 40)
    given = [(r[0], (r[1] * 7) % 41, *r[2:]) for r in given]
    lines = spark.createDataFrame(given, LINES).repartition(5)
    ranged = rows.logical_rows(rows.rebuilt_lines(lines))
    assert tidy(rows.page_rows(lines)) == tidy(ranged)
    expected = tidy(rows.recovered(ranged))
    whole = lambda x: rows.recovered_pages(rows.page_rows(x))
    assert tidy(whole(lines)) == expected and len(expected) > 100
    taken = []
    monkeypatch.setattr(rows, "LONG_PAGE", 20)
    sizes = Counter(r[0] for r in given)
    for buckets in (1, 7, 2**16):
        monkeypatch.setattr(rows, "BUCKETS", buckets)
        assert {r["page"] for r in rows.long_pages(lines.select("page"), 1).collect()} == {p for p, n in sizes.items() if n > 20}
    apart = rows.shared(lines, lines.select("page"), whole, lambda x: taken.append(x.select("page").distinct().count()) or rows.recovered(rows.logical_rows(rows.rebuilt_lines(x))))
    assert tidy(apart) == expected and 0 < taken[0] < 26
    assert whole(lines.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["row_recovery", "row_reconstruction"])
def test_printed_lines_are_dealt_by_page_once_and_not_stored(spark, monkeypatch, name):
    written, stored = [], rows.stored
    monkeypatch.setattr(rows, "stored", lambda df, label: written.append(label) or stored(df, label))
    found = getattr(rows, name)(spark, "/root/testdata/sf0.001")
    assert exchanges(found) <= {"l_partkey", "l_orderkey"} and written == ["long-pages"]
    monkeypatch.setattr(rows, "LONG_PAGE", 10)
    apart = getattr(rows, name)(spark, "/root/testdata/sf0.001")
    assert len(written) > 2 and tidy(apart) == tidy(found)


def plain_merge(found, slack):
    out = []
    for r in sorted(found, key=lambda r: (r["start_y"], r["end_y"], r["start_x"], r["confidence"], r["items"])):
        if out and r["start_y"] <= out[-1]["end_y"] + slack:
            o = out[-1]
            o.update(start_x=min(o["start_x"], r["start_x"]), end_x=max(o["end_x"], r["end_x"]), end_y=max(o["end_y"], r["end_y"]), items=o["items"] + r["items"])
            o.update(confidence=(o["confidence"] + r["confidence"]) / 2, parts=o["parts"] + 1)
        else:
            out.append(dict(r, parts=1))
    return out


def test_regions_merge_as_a_loop_does(spark):
    rng = random.Random(2)
    given = [
        {"page": p, "start_x": rng.randint(0, 9) * 1.0, "end_x": rng.randint(9, 20) * 1.0, "start_y": (a := rng.randint(0, 400) * 1.0), "end_y": a + rng.randint(0, 30), "items": rng.randint(0, 9), "confidence": rng.choice([0.7, 0.8, 0.3])}
        for p in range(30)
        for _ in range(rng.randint(1, 25))
    ]
    names = ["page", "start_x", "end_x", "start_y", "end_y", "items", "confidence"]
    table = spark.createDataFrame([tuple(r[c] for c in names) for r in given], "page long, start_x double, end_x double, start_y double, end_y double, items long, confidence double")
    got = regions.merged(table, "page")
    best = {r["page"]: r for r in regions.chosen(got).collect()}
    for p in range(30):
        own = plain_merge([r for r in given if r["page"] == p], 10)
        mine = sorted((r for r in got.collect() if r["page"] == p), key=lambda r: r["start_y"]) if p < 3 else None
        for a, b in zip(mine or [], own, strict=mine is not None):
            assert all(a[c] == pytest.approx(b[c]) for c in (*names[1:], "parts"))
        top = max(own, key=lambda r: (round(r["confidence"], 9), r["items"]))
        assert best[p]["start_y"] == top["start_y"] and best[p]["items"] == top["items"]


ITEMS = "page long, item long, x double, y double, w double, h double, text string"


def test_chains_of_items(spark):
    rng = random.Random(8)
    given = [(p, i, 0.0, float(rng.choice([rng.randint(0, 300), rng.random() * 300])), 1.0, 1.0, "t") for p in range(12) for i in range(rng.randint(1, 40))]
    got = {(r["page"], r["item"]): r["chain"] for r in regions.chains(spark.createDataFrame(given, ITEMS), "page", "y", 15.0).collect()}
    for p in range(12):
        chain, last = -1, None
        for _, i, _, y, *_ in sorted((r for r in given if r[0] == p), key=lambda r: r[3]):
            chain += last is None or y - last > 15.0
            assert got[p, i] == chain
            last = y


def page_items(n, page=1, footer=True):
    out = [(page, i, 20.0 + 100 * i, 40.0, 50.0, 16.0, t) for i, t in enumerate(("Description", "Qty", "Unit Price", "Total"))]
    for k in range(1, n + 1):
        out += [(page, 10 * k + i, x, 40.0 + 22 * k, 40.0, 16.0, t) for i, (x, t) in enumerate(((20.0, f"rice {k}"), (200.0, "2"), (300.0, "5.00"), (400.0, "10.00")))]
    end = 90.0 + 22 * n
    return out + ([(page, 10_000, 20.0, end + 100, 60.0, 16.0, "Terms: 30 days"), (page, 10_001, 300.0, end + 100, 80.0, 16.0, "Total due")] if footer else [])


def test_a_page_and_its_scores_by_hand(spark):
    """Eight lines of four cells below a header: every score is full but three lanes of four; the footer lies below."""
    table = spark.createDataFrame(page_items(8) + [(2, 1, 5.0, 5.0, 1.0, 1.0, "x"), (3, 1, None, 5.0, 1.0, 1.0, "x"), (4, 1, 0.0, 0.0, None, None, None), (4, 2, 9.0, 0.0, None, None, "x")], ITEMS)
    found = {r["page"]: r for r in regions.located(table).collect()}
    assert set(found) == {1, 4}  # pages 2 and 3 have no section of two items
    r = found[1]
    assert (r["start_x"], r["end_x"], r["start_y"], r["end_y"], r["items"], r["parts"], r["headers"], r["footers"]) == (20.0, 440.0, 40.0, 232.0, 36, 9, 1, 2)
    assert r["footer_confidence"] == pytest.approx(0.675)
    d = {r["page"]: r for r in regions.diagnostics(table).collect()}[1]
    assert (d["row_density"], d["spacing"], d["lanes"], d["header_alignment"], d["footer_position"], d["penalty"]) == (1.0, 1.0, 0.75, 1.0, 1.0, 1.0)
    assert (d["products"], d["structured_rows"], d["inside"]) == (8, 9, 36) and d["description_density"] == pytest.approx(0.889)
    calibrated = 8 / 9 * (0.25 + 0.2 + 0.15) + 0.15 + 0.1 * 8 / 9 + 0.1
    assert d["calibrated"] == pytest.approx(calibrated, abs=1e-3) and d["structure"] == pytest.approx(0.6 + 0.15 + 0.1 * 8 / 9 + 0.1, abs=1e-3)
    assert d["confidence"] == pytest.approx(0.32 + 0.255 + 0.135 + 0.1 * calibrated, abs=1e-3)


@pytest.mark.parametrize(("n", "share", "penalty"), [(100, 0.0, 1.0), (101, 0.2, 0.993), (120, 0.4, 0.86), (120, 0.5, 1.0), (130, 0.89, 0.65), (160, 0.95, 1.0)])
def test_oversized_tables_lose(n, share, penalty):
    lines = n // 4
    good = round(share * lines)
    items = []
    for k in range(lines):
        words = "rice" if k < good else "total"
        items += [(20.0, 30.0 * k, 40.0, 16.0, words), (200.0, 30.0 * k, 40.0, 16.0, "2"), (400.0, 30.0 * k, 40.0, 16.0, "5"), (600.0, 30.0 * k, 40.0, 16.0, "10")]
    items += [(20.0, 30.0 * lines + 1000 + 60 * i, 40.0, 16.0, "alone") for i in range(n - len(items))]
    found = regions.diagnose(items, 1e9, [], [])
    assert found["inside"] == n and found["product_share"] == pytest.approx(good / lines)
    if abs(found["product_share"] - share) < 0.02:
        assert found["penalty"] == pytest.approx(penalty, abs=1e-3)


def plain_dedupe(given):
    """given: (doc, pos, raw, qty, vat). The rows that stand, as a list that later rows may replace."""
    out = []
    for doc, pos, raw, qty, vat in sorted(given, key=lambda r: (r[0], r[1])):
        own = {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in raw.lower()).split() if len(w) > 2 and w not in dedupe.IGNORED}
        for o in out:
            smaller = min(len(own), len(o["tokens"]))
            if o["doc"] == doc and o["qty"] == qty and smaller and len(own & o["tokens"]) >= max(2, int(smaller * 0.75)):
                o["rows"] += 1
                if (vat and not o["vat"]) or len(raw) > len(o["raw"]):
                    o.update(pos=pos, raw=raw, vat=vat, tokens=own)
                break
        else:
            same = [o for o in out if o["doc"] == doc and o["qty"] == qty and o["raw"].lower() == raw.lower()]
            if same:
                same[0]["rows"] += 1
            else:
                out.append({"doc": doc, "slot": pos, "pos": pos, "rows": 1, "raw": raw, "qty": qty, "vat": vat, "tokens": own})
    return Counter((o["doc"], o["slot"], o["pos"], o["rows"]) for o in out)


@pytest.mark.parametrize("small", [4096, 1])
def test_fuzzy_dedupe_equals_a_loop(spark, monkeypatch, small):
    """Names of none to six words; folded by equal numbers, and by components of names."""
    monkeypatch.setattr(dedupe, "SMALL_KEY", small)
    rng = random.Random(4)
    words = ["rice", "Basmati", "10kg", "oil", "sun-flower", "and", "fresh", "it", "bag", "large", "x"]
    given = [(rng.randint(1, 3), i, " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice([1.0, 2.0]), rng.choice([0.0, 0.0, 1.5])) for i in range(220)]
    table = spark.createDataFrame([(*r[:3], r[3], None, r[3], r[4] or None) for r in given], "doc long, pos long, raw string, qty double, unit_price double, line_total double, vat double")
    got = Counter((r["doc"], r["slot"], r["pos"], r["rows"]) for r in dedupe.deduped(table).collect())
    assert got == plain_dedupe(given)
    assert dedupe.deduped(table.limit(0)).collect() == []


def test_sections_and_headers_shuffle_items_once(spark):
    rows = [(p, i, 10.0 * i, 30.0 * p, 5.0, 5.0, t) for p in (1, 2) for i, t in enumerate(("Description", "Qty", "Total"))]
    items = spark.createDataFrame(rows, ITEMS).repartition("page")
    found = regions.sections(items)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    heads = regions.header_regions(items, found.select("page", "start_x", "end_x", "start_y", "end_y"))
    assert {(r["page"], r["items"], r["indicators"]) for r in heads.collect()} == {(1, 3, 3), (2, 3, 3)}


def test_regions_are_dealt_by_rows(spark, monkeypatch):
    from docledger.operators import regions

    monkeypatch.setattr(regions, "TASK_ROWS", 10)
    assert [regions.dealt(spark.range(n), "id").rdd.getNumPartitions() for n in (0, 10, 95)] == [1, 1, 10]


def test_rows_compute_with_new_values_only():
    from docledger.operators.rows import computes

    lists = [[2.0, 3.5, 7.0], [2.0], [7.0, 2.0, 3.5], [1.0], [3.0, 3.0], [None, -1.0, 2.0, 4.0], [2.0, 5.0, 11.0], []]
    slow = lambda v: any(abs(round(t - q * p, 2)) <= max(0.05, t * 0.02) for q in v for p in v for t in v)
    for values in lists:
        plain = [v for v in values if v is not None and v > 0]
        assert computes(values) == slow(plain)
        for at in range(len(values)):
            before = [v for v in values[:at] if v is not None and v > 0]
            assert (slow(before) or computes(values, at)) == slow(plain)


def test_fuzzy_dedupe_joins_nothing_to_small_keys(spark):
    given = [(1, i, f"rice basmati {i % 2}", 1.0, None, 1.0, None) for i in range(6)]
    table = spark.createDataFrame(given, "doc long, pos long, raw string, qty double, unit_price double, line_total double, vat double")
    found = dedupe.deduped(table)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0, 6)]


def test_dedupe_words_are_those_that_tell(spark):
    from pyspark.sql import functions as F

    texts = {"The Rice, and-rice a1b it 10kg Withe PLAIN": ["10kg", "a1b", "rice", "withe"], "": [], "and the it": [], None: [], "Café fresh": ["caf"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", dedupe.name_tokens(F.col("t")).alias("w")).collect()} == texts


def test_rows_near_an_item_are_not_searched_from_the_first(monkeypatch):
    """A tall table: each item is compared with the rows near it alone, and each gap's median is taken once."""
    items = [x for k in range(600) for x in ((20.0, 30.0 * k, 40.0, 16.0, "rice"), (200.0, 30.0 * k, 40.0, 16.0, "2"), (400.0, 30.0 * k, 40.0, 16.0, "5"), (600.0, 30.0 * k, 40.0, 16.0, "10"))]
    taken = []
    monkeypatch.setattr(regions, "median", lambda v, plain=regions.median: taken.append(1) or plain(v))
    found = regions.diagnose(items, 1e9, [], [])
    assert (found["products"], found["spacing"], found["lanes"]) == (600, 1.0, 0.75) and len(taken) < 10


def exchanges(df):
    """What the rows of a query are shuffled by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {line.split("Exchange hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line}


@pytest.mark.parametrize("name", ["table_regions", "table_diagnostics"])
def test_printed_items_are_dealt_by_page_once_and_not_stored(spark, monkeypatch, name):
    """Before their parts are joined at most by part, then by page: no step after that moves or stores items."""
    written = []
    monkeypatch.setattr(regions, "stored", lambda df, label: written.append(label) or df, raising=False)
    found = getattr(regions, name)(spark, "/root/testdata/sf0.001")
    assert exchanges(found) <= {"l_partkey", "l_orderkey"} and not written


def test_a_table_that_holds_no_item_keeps_its_page(spark):
    """Widths below zero put the table's end before its items; its page stays, without headers."""
    items = [(1, 1, 10.0, 5.0, -50.0, 1.0, "Description"), (1, 2, 20.0, 6.0, -50.0, 1.0, "Total due"), (1, 3, 30.0, 7.0, -60.0, 1.0, "page 1 of 2"), (None, 4, 1.0, 1.0, 1.0, 1.0, "x")]
    (r,) = regions.located(spark.createDataFrame(items, ITEMS)).collect()
    assert (r["page"], r["start_x"], r["end_x"], r["items"], r["headers"], r["footers"], r["footer_confidence"]) == (1, 10.0, -20.0, 3, 0, 2, pytest.approx(0.675))
    (d,) = regions.diagnostics(spark.createDataFrame(items, ITEMS)).collect()
    assert (d["page"], d["inside"]) == (1, 0)
