"""Logical rows of a page from its physical lines: reconstruction, and recovery of split and wrapped rows.

Whether a line continues the row above it depends on what that row holds so far, so a page is read in order. But many lines
open a row whatever stands above: the first of a page, one far below the line before, one with numbers right after a line
that has text and numbers itself. Lines are dealt out by ranges of page and place, such lines cut each range into segments,
and segments, not pages, are the groups that tasks read: a page of any length is shared by many tasks.

That takes several shuffles of all lines, which most pages are not worth. Pages of up to LONG_PAGE lines are dealt by page once
and read where they lie: their lines in order, then their rows in order. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.plans.catalog import register
from docledger.plans.tables import stored, table

#: Height of a line where a page has none; least reach of a row, its reach and its tight distance in heights.
HEIGHT, LEAST_REACH, REACH, TIGHT = 16.0, 45.0, 1.1, 0.75
#: Distance at which text and numbers of two rows are fragments of one; rows of a page that a task looks at together.
FRAGMENT, BLOCK = 20.0, 4096
#: Lines of a page that one task reads whole; buckets of pages in which lines are counted first.
LONG_PAGE, BUCKETS = 200_000, 2**16
# Texts that no fragment is merged with.
CLOSING = (
    r"subtotal|sub\s*total|total\s+(nett|net|incl|excl|due)|amount\s+excl|vat\s*$|tax\s*$|discount|rounding|banking details|terms|conditions|"
    r"signature|signed|received in good order|cash collected|created:|currency|page\s+\d+\s+of\s+\d+|number of items|extra charges|please note|"
    r"bank|banking|branch|account|acc\s*no|swift|iban|payment|tender|deposit|change"
)
_LINE = ("page", "y", "line")


def _cents(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


def computes(values: list[float], new: int = 0) -> bool:
    """Whether one of the positive values times another is a third, within 0.05 or 2 %; a value may serve twice.

    Of these three one at least stands at ``new`` or behind it: those before were looked at already.
    """
    some = [v for v in values if v is not None and v > 0]
    late = [v for v in values[new:] if v is not None and v > 0] if new else some
    if not late:
        return False
    for i, q in enumerate(some):
        for p in some[i:]:  # products are the same both ways
            product = q * p
            far = 0.1 + product * 1e-9  # more than rounding to cents can change
            for t in some if q in late or p in late else late:
                if -far <= t * 1.02 - product and t * 0.98 - product <= far and abs(_cents(t - _cents(product))) <= max(0.05, t * 0.02):
                    return True
    return False


def segments(lines: DataFrame) -> DataFrame:
    """``lines`` with a segment: lines of one segment follow one another, and its first opens a row for certain.

    A range of lines whose first ones open no row for certain continues the last segment before it. One row a range decides
    where that is; no page is brought together.
    """
    ranged = stored(lines.repartitionByRange(*_LINE).withColumn("part", F.spark_partition_id()), "page-lines")
    order = Window.partitionBy("part").orderBy(*_LINE)
    before = F.lag(F.struct("page", "y", "has_desc", "has_nums")).over(order)
    gap = F.col("y") - F.col("_before.y")
    full = F.col("_before.has_desc") & F.col("_before.has_nums")
    opens = ~F.col("page").eqNullSafe(F.col("_before.page")) | (gap > F.col("reach")) | (F.col("has_nums") & full & (gap > F.col("tight")))
    cut = ranged.withColumn("_before", before).withColumn("_opens", F.col("_before").isNotNull() & F.coalesce(opens, F.lit(False)))
    placed = cut.withColumn("_nth", F.sum(F.col("_opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = stored(placed.drop("_before", "_opens"), "page-segments")
    parts = placed.groupBy("part").agg(F.max("_nth").alias("n"))
    last = F.last(F.when(F.col("n") > 0, F.shiftleft(F.col("part").cast("long"), 40) + F.col("n")), ignorenulls=True)
    opened = parts.select("part", last.over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    known = placed.join(F.broadcast(opened), "part")  # one row a range, so no more than there are tasks
    own = F.shiftleft(F.col("part").cast("long"), 40) + F.col("_nth")  # one number, which is dealt, sorted and read with less work
    return known.withColumn("segment", F.when(F.col("_nth") > 0, own).otherwise(F.col("_open"))).drop("_nth", "_open", "part")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = segment = row = None
    y, desc, nums, described, values, sums = 0.0, False, False, False, [], False
    for batch in batches:
        rows, rules, complete = [], [], []
        names = ("segment", "page", "line", "y", "has_desc", "has_nums", "described", "reach", "tight")
        numbers = batch.column("values")
        flat, sizes, start = numbers.flatten().to_pylist(), pc.fill_null(pc.list_value_length(numbers), 0).to_pylist(), 0
        for s, p, line, at, d, n, told, reach, tight, size in zip(*(batch.column(c).to_pylist() for c in names), sizes, strict=True):
            gap, rule = at - y, None
            if row is not None and s == segment and p == page and gap <= reach:
                if not desc:
                    rule = "no_text_yet"
                elif not nums and n:
                    rule = "numbers_follow"
                elif not n:
                    rule = "text_follows"
                elif gap <= tight and not (described and sums):
                    rule = "incomplete"
            if rule is None:
                row, desc, nums, described, values, sums = line, False, False, False, [], False
            segment, page, y, desc, nums, described = s, p, at, desc or d, nums or n, described or told
            if size:
                before = len(values)
                values.extend(flat[start : start + size])
                start += size
                sums = sums or computes(values, before)  # more values never undo it
            rows.append(row)
            rules.append(rule or "opens")
            complete.append(described and sums)
        kept = [batch.column(c) for c in ("page", "line", "y", "text", "has_desc", "has_nums")]
        more = [pa.array(rows, pa.int64()), pa.array(rules, pa.string()), pa.array(complete, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*kept, *more], names=["page", "line", "y", "text", "has_desc", "has_nums", "row", "rule", "complete"])


def _measured(lines: DataFrame) -> DataFrame:
    height = F.when(F.col("height") > 0, F.col("height")).otherwise(HEIGHT)
    measured = lines.withColumns({"reach": F.greatest(F.lit(LEAST_REACH), height * REACH), "tight": height * TIGHT}).drop("height")
    return measured.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_desc", "has_nums", "described")})


def rebuilt_lines(lines: DataFrame) -> DataFrame:
    """Each line with the line that opens its row, the rule by which it joined, and whether the row computes so far.

    lines: page (long, null is a page of its own), line (long, unique in its page), y, height (the page's; null or zero
    counts as HEIGHT), text, has_desc (letters in the description's place), has_nums, described (any text there) and values
    (array of numbers). A line joins the row above it, if within reach of the line before, when that row has no text yet,
    when it brings the numbers that the row lacks, when it has none itself, or when it is tight and the row does not compute.
    """
    dealt = segments(_measured(lines)).repartition("segment").sortWithinPartitions("segment", *_LINE)
    kind = dict(lines.dtypes)["page"]
    schema = f"page {kind}, line long, y double, text string, has_desc boolean, has_nums boolean, row long, rule string, complete boolean"
    return dealt.mapInArrow(_rebuild, schema)


def logical_rows(lines: DataFrame) -> DataFrame:
    """page, row, lines, y (its last line's), text, has_desc, has_nums, complete and the rules by which its lines joined."""
    joined = F.array_sort(F.collect_list(F.struct("y", "line", "text", "rule")))
    rows = lines.groupBy("page", "row").agg(
        F.count("*").alias("lines"), F.max("y").alias("y"), joined.alias("_l"), F.max("has_desc").alias("has_desc"),
        F.max("has_nums").alias("has_nums"), F.max("complete").alias("complete"),
    )
    text = F.array_join(F.filter("_l.text", lambda t: t != ""), " ")
    rules = F.array_join(F.filter("_l.rule", lambda r: r != "opens"), " ")
    return rows.select("page", "row", "lines", "y", text.alias("text"), "has_desc", "has_nums", "complete", rules.alias("rules"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logical rows of lines that come in order: a row's lines follow one another, and the last is its lowest."""
    names = ("page", "row", "lines", "y", "text", "has_desc", "has_nums", "complete", "rules")
    types, row = None, None
    for batch in chain(_rebuild(batches), [None]):
        done = []
        if batch is not None:
            kind = batch.schema.field("page").type
            types = (kind, pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
            columns = (batch.column(c).to_pylist() for c in ("page", "row", "rule", "y", "text", "has_desc", "has_nums", "complete"))
            for page, first, rule, y, text, desc, nums, complete in zip(*columns, strict=True):
                if rule == "opens":
                    if row:
                        done.append(row)
                    row = [page, first, 1, y, [text] if text else [], desc, nums, complete, []]
                    continue
                row[2] += 1
                row[3] = y
                if text:
                    row[4].append(text)
                row[5:8] = row[5] or desc, row[6] or nums, row[7] or complete
                row[8].append(rule)
        elif row:
            done.append(row)
        if done:
            columns = list(zip(*((*r[:4], " ".join(r[4]), *r[5:8], " ".join(r[8])) for r in done), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def page_rows(lines: DataFrame) -> DataFrame:
    """``logical_rows`` of ``rebuilt_lines``, where no page is long: pages are dealt once, and each is read in order where it lies.

    Its rows come out where its lines lay.
    """
    order = Window.partitionBy("page").orderBy("y", "line")  # asks for pages in one place and puts their lines in order
    placed = _measured(lines).withColumn("segment", F.first("line").over(order))
    kind = dict(lines.dtypes)["page"]
    schema = f"page {kind}, row long, lines long, y double, text string, has_desc boolean, has_nums boolean, complete boolean, rules string"
    return placed.mapInArrow(_joined, schema)


def long_pages(pages: DataFrame, each: int) -> DataFrame:
    """The pages of more than LONG_PAGE rows, each of which stands for ``each`` lines.

    Rows are counted by BUCKETS of pages first, and by page only in buckets that hold as many: elsewhere no page is long.
    """
    bucket = F.pmod(F.xxhash64("page"), F.lit(BUCKETS))
    full = pages.groupBy(bucket.alias("_bucket")).agg((F.count("*") * each).alias("_n")).filter(F.col("_n") > LONG_PAGE)
    held = pages.join(F.broadcast(full), bucket == F.col("_bucket"), "left_semi")  # BUCKETS rows at most
    return held.groupBy("page").agg((F.count("*") * each).alias("n")).filter(F.col("n") > LONG_PAGE).select("page")


def shared(
    lines: DataFrame, pages: DataFrame, whole: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame], DataFrame], each: int = 1
) -> DataFrame:
    """``whole`` of the lines of pages of at most LONG_PAGE lines, and ``ranged`` of those of longer ones.

    pages: page, a row for ``each`` lines that it has at most.
    """
    long = stored(long_pages(pages, each).withColumnRenamed("page", "_page"), "long-pages")
    if long.isEmpty():
        return whole(lines)
    is_long = F.col("page").eqNullSafe(F.col("_page"))
    return whole(lines.join(long, is_long, "left_anti")).unionByName(ranged(lines.join(long, is_long, "left_semi")))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their number in the page, from 0: counted in ranges, whose offsets are summed by page."""
    ranged = stored(rows.repartitionByRange("page", "row").withColumn("_part", F.spark_partition_id()), "page-rows")
    sums = ranged.groupBy("page", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("page").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("page").alias("_page"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at"))
    own = F.row_number().over(Window.partitionBy("_part", "page").orderBy("row")) - 1
    met = ranged.withColumn("_own", own).join(offsets, F.col("page").eqNullSafe(F.col("_page")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("no", F.col("_own") + F.col("_at")).drop("_part", "_own", "_page", "_p", "_at")


def recovered(rows: DataFrame) -> DataFrame:
    """Rows after recovery: page, row, source, confidence, with (the neighbour's row), text, has_desc, has_nums, skipped.

    A row with text alone takes the numbers of the first neighbour below, above, two below, two above that has any, else the
    text of the first that has text alone. A row with numbers alone takes the text of the first such neighbour within
    FRAGMENT, unless a closing word stands in either. Otherwise the row stays, and ``skipped`` says why its last neighbour
    did not fit. Neighbours stay as they are. Blocks of a page's rows overlap by two rows on either side.
    """
    block, place = F.floor(F.col("no") / BLOCK), F.col("no") % BLOCK
    blocks = F.array(block, F.when(place < 2, block - 1), F.when(place >= BLOCK - 2, block + 1))
    spread = numbered(rows).withColumn("_home", block).withColumn("_block", F.explode(F.array_compact(blocks)))
    order = Window.partitionBy("page", "_block").orderBy("no")
    seen = F.struct("row", "no", "y", "text", "has_desc", "has_nums")
    near = F.array(F.lead(seen, 1).over(order), F.lag(seen, 1).over(order), F.lead(seen, 2).over(order), F.lag(seen, 2).over(order))
    return _merged(spread.withColumn("_near", F.array_compact(near)).filter("_home = _block"))


def _merged(met: DataFrame) -> DataFrame:
    """Rows after recovery, from rows with a number that tells their order and their neighbours: below, above, two below, two above."""

    def closing(n: Column) -> Column:
        return F.lower(F.concat_ws(" ", "text", n["text"])).rlike(CLOSING)

    far = lambda n: F.abs(n["y"] - F.col("y")) > FRAGMENT
    d, n = F.col("has_desc"), F.col("has_nums")
    with_nums = F.filter("_near", lambda x: x["has_nums"])
    with_text = F.filter("_near", lambda x: x["has_desc"] & ~x["has_nums"])
    fragments = F.filter(with_text, lambda x: ~far(x) & ~closing(x))
    merged = lambda found, source, c: F.struct(F.get(found, F.lit(0)).alias("n"), F.lit(source).alias("source"), F.lit(c).alias("confidence"))
    choice = (
        F.when(d & ~n & (F.size(with_nums) > 0), merged(with_nums, "split_row_merged", 0.85))
        .when(d & ~n & (F.size(with_text) > 0), merged(with_text, "wrapped_description", 0.8))
        .when(n & ~d & (F.size(fragments) > 0), merged(fragments, "fragment_merge", 0.9))
    )
    last = F.try_element_at("_near", F.lit(-1))
    apart = (d & ~n & last["has_nums"] & ~last["has_desc"]) | (n & ~d & last["has_desc"] & ~last["has_nums"])
    reason = (
        F.when(last.isNull(), F.lit(None))
        .when(closing(last), "skip_footer_or_banking")
        .when(d & last["has_desc"], "skip_both_have_descriptions")
        .when(n & last["has_nums"], "skip_both_have_numeric_values")
        .when(apart & far(last), "skip_gap_too_large")
        .when(~apart, "skip_mixed_content_types")
    )
    chosen = met.withColumn("_c", choice)
    other = F.col("_c.n")
    both = F.when(other["no"] < F.col("no"), F.concat_ws(" ", other["text"], "text")).otherwise(F.concat_ws(" ", "text", other["text"]))
    return chosen.select(
        "page",
        "row",
        F.coalesce("_c.source", F.lit("none")).alias("source"),
        F.coalesce("_c.confidence", F.lit(1.0)).alias("confidence"),
        other["row"].alias("with"),
        F.when(other.isNull(), F.col("text")).otherwise(F.trim(both)).alias("text"),
        (d | F.coalesce(other["has_desc"], F.lit(False))).alias("has_desc"),
        (n | F.coalesce(other["has_nums"], F.lit(False))).alias("has_nums"),
        F.when(other.isNull(), reason).alias("skipped"),
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come in order with the neighbours in their page: below, above, two below, two above; two rows are held back."""
    seen = ("row", "no", "y", "text", "has_desc", "has_nums")
    held, at = None, 0  # rows since the last two that went out; the first that has not
    for batch in chain(batches, [None]):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None:
            return
        n = held.num_rows
        end = n if batch is None else max(at, n - 2)
        if end > at:
            page = held.column("page").dictionary_encode(null_encoding="encode").indices.to_numpy()
            i = np.arange(at, end)
            j = i[:, None] + np.array([1, -1, 2, -2])
            found = (j >= 0) & (j < n)
            found &= page[np.where(found, j, 0)] == page[i][:, None]
            met = held.select(seen).take(pa.array(j[found])).to_struct_array()
            near = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found.sum(1))), pa.int32()), met)
            out = held.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([*out.columns, near], names=[*out.schema.names, "_near"])
        keep = max(0, end - 2)
        held, at = held.slice(keep), end - keep


def recovered_pages(rows: DataFrame) -> DataFrame:
    """``recovered`` for rows of which each page lies in one part, as those of ``page_rows`` do: they are put in order there, not dealt again."""
    placed = rows.select("page", "row", F.col("row").alias("no"), "y", "text", "has_desc", "has_nums").sortWithinPartitions("page", "row")
    fields = "row long, no long, y double, text string, has_desc boolean, has_nums boolean"
    kind = dict(rows.dtypes)["page"]
    return _merged(placed.mapInArrow(_neighbours, f"page {kind}, {fields}, _near array<struct<{fields}>>"))


def split_row(has_desc: Column, has_nums: Column) -> Column:
    """A row with text and no numbers is split, or its description wraps."""
    return has_desc & ~has_nums


def printed_lines(spark, sf_dir) -> DataFrame:
    """Orders as printed pages: every item on one, two or tight lines, by the kind of its part; some totals do not compute.

    Names come from the parts; parts of size 7 are charges whose name holds a closing word, and items of size 11 and 12 have
    no name.
    """
    name = F.when(F.col("p_size") == 7, "bank charge").when(F.col("p_size").isin(11, 12), "").otherwise(F.col("p_name"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("name"))
    q, t = F.col("l_quantity"), F.col("l_extendedprice")
    by = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy(by[0]).orderBy(*by[1:])
    lines = table(spark, sf_dir, "lineitem").select(*by, F.coalesce(F.col("l_discount") > 0.08, F.lit(False)).alias("twice"))
    numbered = lines.join(part, "l_partkey").withColumn("nth", F.row_number().over(order))  # what is computed from a line is so after it was dealt
    items = numbered.select(
        "l_orderkey",
        (F.col("nth") * 10).cast("long").alias("k"),
        (F.col("l_partkey") % 6).alias("shape"),
        "name",
        q.alias("q"),
        (F.floor(t / q * 100 + 0.5) / 100).alias("p"),
        F.when(F.col("twice"), t * 2).otherwise(t).alias("t"),
    )

    def line(at: int, down: float, text: Column, values: list[Column]) -> Column:
        numbers = F.array(*values).cast("array<double>")
        return F.struct(F.lit(at).alias("at"), F.lit(down).alias("down"), text.alias("text"), numbers.alias("values"))

    name, none, all_three = F.col("name"), F.lit(""), [F.col("q"), F.col("p"), F.col("t")]
    shapes = (
        F.when(F.col("shape") == 0, F.array(line(0, 0.0, name, all_three)))
        .when(F.col("shape") == 1, F.array(line(0, 0.0, name, []), line(1, 20.0, none, all_three)))
        .when(F.col("shape") == 2, F.array(line(0, 0.0, none, all_three), line(1, 20.0, name, [])))
        .when(F.col("shape") == 3, F.array(line(0, 0.0, name, all_three), line(1, 20.0, F.lit("per case"), [])))
        .when(F.col("shape") == 4, F.array(line(0, 0.0, name, all_three[:1]), line(1, 10.0, none, all_three[1:])))
        .otherwise(F.array(line(0, 0.0, name, all_three), line(1, 10.0, none, all_three[2:])))
    )
    lines = items.select("l_orderkey", "k", F.explode(shapes).alias("s"))
    has_desc = F.col("s.text").rlike("[A-Za-z]{3,}")
    return lines.select(
        F.col("l_orderkey").alias("page"),
        (F.col("k") + F.col("s.at")).alias("line"),
        (F.col("k") * 4.5 + F.col("s.down")).alias("y"),
        F.lit(16.0).alias("height"),
        F.col("s.text").alias("text"),
        has_desc.alias("has_desc"),
        (F.size("s.values") > 0).alias("has_nums"),
        (F.col("s.text") != "").alias("described"),
        F.col("s.values").alias("values"),
    )


def printed_pages(spark, sf_dir) -> DataFrame:
    """The page of each item, which is printed on two lines at most."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"))


_SHAPE = "CASE l_partkey % 6 WHEN 0 THEN [{a}] WHEN 1 THEN [{b}, {c}] WHEN 2 THEN [{d}, {e}] WHEN 3 THEN [{a}, {f}] WHEN 4 THEN [{g}, {h}] ELSE [{a}, {i}] END"


def _line_sql(at: int, down: float, text: str, values: str) -> str:
    return f"{{'at': {at}, 'down': {down}::DOUBLE, 'text': {text}, 'vals': {values}::DOUBLE[]}}"


_SHAPES = _SHAPE.format(
    a=_line_sql(0, 0, "name", "[q, p, t]"), b=_line_sql(0, 0, "name", "[]"), c=_line_sql(1, 20, "''", "[q, p, t]"), d=_line_sql(0, 0, "''", "[q, p, t]"),
    e=_line_sql(1, 20, "name", "[]"), f=_line_sql(1, 20, "'per case'", "[]"), g=_line_sql(0, 0, "name", "[q]"), h=_line_sql(1, 10, "''", "[p, t]"), i=_line_sql(1, 10, "''", "[t]"),
)


def _computes_sql(vals: str) -> str:
    near = "abs(floor((t - floor(q * p * 100 + 0.5) / 100) * 100 + 0.5) / 100) <= greatest(0.05, t * 0.02)"
    return f"len(list_filter({vals}, lambda q: len(list_filter({vals}, lambda p: len(list_filter({vals}, lambda t: {near})) > 0)) > 0)) > 0"


REBUILT_SQL = f"""items AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) * 10 AS k,
    CASE WHEN p_size = 7 THEN 'bank charge' WHEN p_size IN (11, 12) THEN '' ELSE p_name END AS name, l_quantity AS q,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p, CASE WHEN l_discount > 0.08 THEN l_extendedprice * 2 ELSE l_extendedprice END AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
  printed AS (SELECT l_orderkey AS page, k, unnest({_SHAPES}) AS s FROM items),
  placed AS (SELECT page, k + s.at AS line, k * 4.5 + s.down AS y, s.text AS text, regexp_matches(s.text, '[A-Za-z]{{3,}}') AS d, len(s.vals) > 0 AS n, s.text <> '' AS described, s.vals AS vals FROM printed),
  steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, line) AS i, y - lag(y) OVER (PARTITION BY page ORDER BY y, line) AS gap FROM placed),
  walk AS (SELECT page, i, line, y, text, d, n, line AS row, 'opens' AS rule, d AS rd, n AS rn, described AS rs, vals AS rv FROM steps WHERE i = 1 UNION ALL
    SELECT page, i, line, y, text, d, n, CASE WHEN rule = 'opens' THEN line ELSE row END, rule, d OR (rd AND rule <> 'opens'), n OR (rn AND rule <> 'opens'),
      described OR (rs AND rule <> 'opens'), CASE WHEN rule = 'opens' THEN vals ELSE rv || vals END
    FROM (SELECT s.*, w.row, w.rd, w.rn, w.rs, w.rv, CASE WHEN gap > 45 THEN 'opens' WHEN NOT rd THEN 'no_text_yet' WHEN NOT rn AND s.n THEN 'numbers_follow' WHEN NOT s.n THEN 'text_follows'
      WHEN gap <= 12 AND NOT (rs AND {_computes_sql("rv")}) THEN 'incomplete' ELSE 'opens' END AS rule FROM walk w JOIN steps s ON s.page = w.page AND s.i = w.i + 1)),
  logical AS (SELECT page, row, count(*) AS lines, max(y) AS y, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (text <> ''), '') AS text, bool_or(d) AS has_desc, bool_or(n) AS has_nums,
    bool_or(rs AND {_computes_sql("rv")}) AS complete, coalesce(string_agg(rule, ' ' ORDER BY i) FILTER (rule <> 'opens'), '') AS rules FROM walk GROUP BY page, row)"""


@register("row_reconstruction", "G15 G27", f"WITH RECURSIVE {REBUILT_SQL} SELECT *, has_desc AND NOT has_nums AS split FROM logical")
def row_reconstruction(spark, sf_dir):
    """Logical rows of printed orders, with the rules by which their lines joined, and whether a row is split or wraps."""
    rows = shared(printed_lines(spark, sf_dir), printed_pages(spark, sf_dir), page_rows, lambda lines: logical_rows(rebuilt_lines(lines)), each=2)
    return rows.withColumn("split", split_row(F.col("has_desc"), F.col("has_nums")))


_NEAR = "[lead(o, 1) OVER w, lag(o, 1) OVER w, lead(o, 2) OVER w, lag(o, 2) OVER w]"


@register(
    "row_recovery",
    "G16",
    f"""WITH RECURSIVE {REBUILT_SQL},
  ordered AS (SELECT *, {{'row': row, 'y': y, 'text': text, 'd': has_desc, 'n': has_nums}} AS o FROM logical),
  met AS (SELECT *, list_filter({_NEAR}, lambda x: x IS NOT NULL) AS near FROM ordered WINDOW w AS (PARTITION BY page ORDER BY row)),
  found AS (SELECT *, list_filter(near, lambda x: x.n)[1] AS nums, list_filter(near, lambda x: x.d AND NOT x.n)[1] AS texts, near[len(near)] AS z,
    list_filter(near, lambda x: x.d AND NOT x.n AND abs(x.y - y) <= 20 AND NOT regexp_matches(lower(text || ' ' || x.text), '{CLOSING}'))[1] AS fragment FROM met),
  chosen AS (SELECT *, CASE WHEN has_desc AND NOT has_nums THEN coalesce(nums, texts) WHEN has_nums AND NOT has_desc THEN fragment END AS c,
    (has_desc AND NOT has_nums AND z.n AND NOT z.d) OR (has_nums AND NOT has_desc AND z.d AND NOT z.n) AS apart FROM found)
  SELECT page, row, CASE WHEN c IS NULL THEN 'none' WHEN has_nums THEN 'fragment_merge' WHEN c.n THEN 'split_row_merged' ELSE 'wrapped_description' END AS source,
    (CASE WHEN c IS NULL THEN 1.0 WHEN has_nums THEN 0.9 WHEN c.n THEN 0.85 ELSE 0.8 END)::DOUBLE AS confidence, c.row AS with,
    CASE WHEN c IS NULL THEN text WHEN c.row < row THEN trim(c.text || ' ' || text) ELSE trim(text || ' ' || c.text) END AS text,
    has_desc OR coalesce(c.d, false) AS has_desc, has_nums OR coalesce(c.n, false) AS has_nums,
    CASE WHEN c IS NOT NULL OR z IS NULL THEN NULL WHEN regexp_matches(lower(text || ' ' || z.text), '{CLOSING}') THEN 'skip_footer_or_banking' WHEN has_desc AND z.d THEN 'skip_both_have_descriptions'
      WHEN has_nums AND z.n THEN 'skip_both_have_numeric_values' WHEN apart AND abs(z.y - y) > 20 THEN 'skip_gap_too_large' WHEN NOT apart THEN 'skip_mixed_content_types' END AS skipped FROM chosen""",
)
def row_recovery(spark, sf_dir):
    """Rows of printed orders after recovery: what they took from a neighbour, or why they took nothing."""
    whole, ranged = lambda lines: recovered_pages(page_rows(lines)), lambda lines: recovered(logical_rows(rebuilt_lines(lines)))
    return shared(printed_lines(spark, sf_dir), printed_pages(spark, sf_dir), whole, ranged, each=2)
