"""Lines read from their right end, plain tables, and costing sheets, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from docledger.operators import lines, sheets

TAILS = {
    "0000012345 Tomato paste 6 x 1 L 2 R50.00 15,00 100,00": ("Tomato paste", 12.0, "LTR", 8.33, 15.0, 100.0),
    "Rice long grain bag 3 20 9 0.15 60": ("Rice long grain bag", 3.0, "PKT", 20.0, 0.15, 60.0),
    "Prawns 16/20 kg frozen 2 100 30 200": ("Prawns frozen", 2.0, "KG", 100.0, 30.0, 200.0),
    "Basil fresh pun 4 2.5 0 0": ("Basil fresh pun", 4.0, "PUN", 2.5, 0.0, 10.0),
    "Oil sun flower 4 2.5 1 12": None,  # does not compute
    "Oil sun flower 4 2.5 1": None,  # three numbers
    "Oil 4 2.5 1 10": None,  # five words
    "Oil sun flower 0 2.5 1 0": None,  # no quantity
    "4 5 6 7 8 9": None,  # no name
    "": None,
    None: None,
}


def test_tail_lines_by_hand(spark):
    table = spark.createDataFrame([(t,) for t in TAILS], "text string")
    got = {r["text"]: (r["name"], r["qty"], r["unit"], r["unit_price"], r["vat"], r["line_total"]) for r in lines.tail_lines(table).collect()}
    assert got == {t: v for t, v in TAILS.items() if v}
    coded = [r["text"] for r in lines.stock_lines(table).collect()]
    assert coded == ["0000012345 Tomato paste 6 x 1 L 2 R50.00 15,00 100,00"]


@pytest.mark.parametrize(
    ("values", "roles"),
    [([2.0, 5.0, 10.0], (0, 1, 2)), ([10.0, 2.0, 5.0], (1, 2, 0)), ([2.0, 5.0, 11.0], None), ([2.0, 5.0], None), ([], None), ([None, 2.0, 5.0, 10.0], (1, 2, 3)), ([-2.0, 5.0, -10.0], None), ([1.0, 7.0, 7.0], (0, 1, 2))],
)
def test_best_roles(spark, values, roles):
    r = spark.createDataFrame([(values,)], "v array<double>").select(lines.best_roles(F.col("v")).alias("r")).first()["r"]
    assert (r and (r["q"], r["p"], r["t"])) == roles


def test_plain_rows_by_hand(spark):
    given = [
        (1, 0, "hello there"), (1, 1, ""), (1, 2, "Description | Qty | Unit Price | Total"), (1, 3, "Rice 2 R5.00 R10.00"), (1, 4, "a note"), (1, 5, "Salt 2 R5.00 R11.00"),
        (1, 6, "Total due discount 2 R5 R10"), (1, 7, "Oil 1 R2.00 R2.00"), (2, 0, "Oil 1 R2.00 R2.00"), (2, 1, "Tea 3 R2.00 R6.00"), (3, 0, "nothing here"), (3, 1, None),
    ]
    got = sorted(tuple(r) for r in lines.plain_rows(spark.createDataFrame(given, "page long, idx long, line string")).select("page", "idx", "status", "description", "total").collect())
    assert [r[:3] for r in got] == [
        (1, 0, "before_table"), (1, 1, "empty"), (1, 3, "parsed"), (1, 4, "noise"), (1, 5, "not_enough_line_values"), (1, 6, "payment"),
        (2, 0, "parsed"), (2, 1, "parsed"), (3, 0, "before_table"), (3, 1, "empty"),
    ]
    assert [r[3:] for r in got if r[2] == "parsed"] == [("Rice", 10.0), ("Oil", 2.0), ("Tea", 6.0)]


def strip(*rows, width=5):
    return {r: list(c) + [""] * (width - len(c)) for r, c in rows}


def test_blocks_side_by_side_and_one_below_the_other(spark):
    first = strip((0, ["Hot"]), (1, ["COSTING SHEET"]), (2, ["Salmon bowl"]), (4, ["Ingredients"]), (5, ["Soy sauce", "10", "500"]), (6, ["Rice", "2", "R 20", "R5"]), (7, ["WASTAGE", "1"]), (8, ["Free text"]), (9, ["MENU PRICE", "", "", "x", "R 1,020.50"]))
    below = strip((20, ["COSTING SHEET"]), (21, ["lost"]), (25, ["COSTING SHEET"]), (26, ["salmon BOWL"]), (27, ["Ingredients"]), (28, ["Rice", "1"]), (40, ["COSTING SHEET"]), (41, ["Tuna"]), (42, ["Ingredients"]), (43, ["Fish", "1", "25"]))
    second = strip((1, ["COSTING SHEET"]), (3, ["Garden of Eden"]), (5, ["Ingredients"]), (6, ["Leaf", "-1.5", "30"]))
    third = strip((1, ["COSTING SHEET"]), (2, ["x"]), (14, ["Ingredients"]), (15, ["too far", "1"]))
    empty = [""] * 5
    grid = [(1, r, {**first, **below}.get(r, empty) + second.get(r, empty) + [None] + third.get(r, empty)) for r in range(50)]
    grid += [(2, 0, ["COSTING SHEET", "", "", ""]), (3, 0, ["no blocks"])]
    got = sheets.costing_sheets(spark.createDataFrame(grid, "page long, row long, cells array<string>")).collect()
    # the mark at row 25 stands in the head of the block at 20; the third strip has no ingredients near
    assert sorted((r["title"], r["category"], r["selling_price"], r["row"], r["ingredient"], r["qty"], r["unit"]) for r in got) == [
        ("Garden of Eden", "PLATTERS", 0.0, 6, "Leaf", -1.5, "g"),
        ("Salmon bowl", "HOT", 1020.5, 5, "Soy sauce", 10.0, "ml"),
        ("Salmon bowl", "HOT", 1020.5, 6, "Rice", 2.0, "EACH"),
        ("Tuna", "TUNA", 0.0, 43, "Fish", 1.0, "g"),
        ("lost", "LOST", 0.0, 28, "Rice", 1.0, "g"),
    ]
    assert sheets.costing_sheets(spark.createDataFrame([], "page long, row long, cells array<string>")).collect() == []


def test_tail_lines_compute_each_column_once(spark):
    found = lines.tail_lines(spark.createDataFrame([("Rice 2 x 5 kg 3 R10 1,5 30",)], "text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("reverse(") == 1


def test_numbers_and_triples_in_compiled_code(spark):
    from docledger.functions import text, validate
    from docledger.operators.lines import best_roles, line_numbers

    lines = spark.createDataFrame([("rice 2 R3.50 R7",), ("R 1,234.50 zar -2 3,5",), ("none",), ("1 234 567 89,5.1",), ("",)], "t string")
    read = lines.select(line_numbers(F.col("t")).alias("v"), text.number_count(F.col("t")).alias("n"), *(text.has_numbers(F.col("t"), k).alias(f"k{k}") for k in (1, 2, 3))).collect()
    assert [r["v"] for r in read] == [[2.0, 3.5, 7.0], [1234.5, -2.0, 3.5], [], [1234567.0, 89.5, 1.0], []]
    assert all(r[f"k{k}"] == (r["n"] >= k) for r in read for k in (1, 2, 3))
    cells = spark.createDataFrame([(2.0, 3.5, 7.0), (7.0, 2.0, 3.5), (1.0, 1.0, 1.0), (2.0, None, 7.0), (0.0, 1.0, 1.0), (3.0, 5.0, 15.2), (3.0, 5.0, 16.0)], "a double, b double, c double")
    found = validate.with_triples(cells, [F.col(x) for x in "abc"], "r").select("r", best_roles(F.array("a", "b", "c")).alias("slow")).collect()
    assert [r["r"] for r in found] == [r["slow"] for r in found]
    told = validate.with_triples(cells, [F.col(x) for x in "abc"], "r", True, 1).select("r").collect()
    assert [r["r"] and (r["r"]["q"], r["r"]["p"], r["r"]["t"], round(r["r"]["score"], 2)) for r in told][-3:] == [None, (1, 2, 3, 0.2), (1, 2, 3, 1001.0)]


def test_strips_hold_filled_rows_and_are_joined_to_beginnings_by_no_row(spark):
    grid = [(1, 0, ["\n costing", "", "x", "", "", ""]), (1, 1, [" COSTING\nSHEET ", "a", "", "", "", ""]), (1, 2, ["", "b", "", "", "", ""]), (1, 3, None), (1, 4, ["Rice ", "2"])]
    df = spark.createDataFrame(grid, "page long, row long, cells array<string>")
    assert sorted(tuple(r) for r in sheets.strips(df).collect()) == [(1, 0, 0, "costing", "", "x", "", ""), (1, 0, 1, "COSTING SHEET", "a", "", "", ""), (1, 0, 4, "Rice", "2", "", "", "")]
    assert "FullOuter" not in sheets.costing_sheets(df)._jdf.queryExecution().optimizedPlan().toString()


def test_header_cells_are_named_in_compiled_code(spark):
    from docledger.functions.text import header_key, row_role, with_role

    cells = ["Description", "Item", "Product Details", "qty", "Ship Quantity", "unit", "price of unit", "net unit-price", "Amount (excl)", "Line Total!", "net price", "vat amt", "Tax", "sku",
             "item code", "code of a very long name", "CODE0123456789AB", "quantity code", "amount", "", "word"]
    rows = [" , ".join((cells[i], cells[(i * 5 + k) % len(cells)], cells[(i + 7 * k) % len(cells)])) for i in range(len(cells)) for k in range(1, 9)]
    rows += [r.replace(",", "|") + "| x 1" for r in rows]
    fields = {r["c"]: r["k"] for r in spark.createDataFrame([(c,) for c in cells], "c string").select("c", header_key(F.col("c")).alias("k")).collect()}
    told = with_role(spark.createDataFrame([(r,) for r in rows], "line string"), F.col("line")).withColumn("slow", row_role(F.col("line")))
    named = lambda line: {fields.get(c.strip()) for c in line.replace("|", ",").split(",")} - {None}
    got = told.collect()
    assert all((r["role"] == "header") == (len(named(r["line"])) >= 3) and r["role"] == r["slow"] for r in got)
    assert {r["role"] == "header" for r in got} == {True, False}
    assert "lambda" not in told.drop("slow")._jdf.queryExecution().optimizedPlan().toString()


def test_wired_rows_meet_names_only_where_parsed(spark):
    from docledger.operators import wiring

    plan = wiring.row_wiring(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "(status#" in plan.split("Union")[1] and " = parsed" in plan and "NOT (status" in plan


def test_printed_pages_number_their_lines_once(spark):
    pages = lines.order_pages(lines._ordered_lines(spark, "/root/testdata/sf0.001"))
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1


def plain_blocks(rows):
    """Blocks of one strip, row by row: rows is {row: first cell}."""
    marks = sorted(r for r, v in rows.items() if v == sheets.BLOCK)
    out, start = [], None
    for m in marks:
        title = next((rows[r] for r in range(m + 1, m + sheets.TITLE_ROWS + 1) if rows.get(r, sheets.BLOCK) not in (sheets.BLOCK, sheets.INGREDIENTS)), None)
        own = next((r + 1 for r in range(m + 1, m + sheets.START_ROWS + 1) if rows.get(r) == sheets.INGREDIENTS), None)
        if title is None or own is None or (start is not None and m < start):
            continue
        above = next((rows[r] for r in range(m - 1, m - sheets.CATEGORY_ROWS - 1, -1) if rows.get(r) in ("SUNSET", "hot")), None)
        out.append((m, own, next((x for x in marks if x >= own), None), title, (above or title).upper()))
        start = own
    return out


def test_blocks_against_a_loop(spark):
    import random

    rng = random.Random(6)
    words = [sheets.BLOCK, sheets.BLOCK, sheets.INGREDIENTS, "SUNSET", "hot", "7 up", "7 up"]
    given = {(p, c): {r: rng.choice(words) for r in range(120) if rng.random() < 0.4 + 0.3 * (p % 2)} for p in range(12) for c in (0, 6)}
    strip = spark.createDataFrame([(p, c, r, v, "", "", "", "") for (p, c), rows in given.items() for r, v in rows.items()], "page long, col int, row long, c0 string, c1 string, c2 string, c3 string, c4 string")
    got = {}
    for r in sheets.blocks(strip.repartition(3)).collect():
        got.setdefault((r["page"], r["col"]), []).append((r["mark"], r["start"], r["end"], r["title"], r["category"]))
    expected = {k: [(*b[:4], "7" if b[4] == "7 UP" else b[4]) for b in plain_blocks(rows)] for k, rows in given.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v} and sum(map(len, got.values())) > 50


def test_printed_sheets_are_dealt_by_page_once_and_not_stored(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sheets, "stored", lambda df, label: written.append(label) or df, raising=False)
    plan = sheets.costing_sheet_recipes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = {line.split("Exchange hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line}
    assert keys <= {"l_partkey", "FLOOR((cast(l_orderkey"} and keys and not written
