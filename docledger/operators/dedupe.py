"""Fuzzy dedupe of extracted lines: rows of equal numbers whose names overlap are one, and the better row stands for them.

Rows are compared with those that stand so far, in order, so the result is a fold. But only rows whose names overlap can meet
in it: where many rows have equal numbers, a prefix-filtered set join finds all names that overlap, their components fall
apart, and each component is folded by itself, as a stream in order that holds only the rows that stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.plans.catalog import register
from docledger.plans.tables import stored, table

# Words that do not tell names apart; shortest word that does.
IGNORED, SHORTEST = ("and", "the", "with", "plain", "fresh"), 3
#: Rows of equal numbers that are folded as they are; only where there are more do their names' components fall apart first.
SMALL_KEY = 4096
#: Words that two names share at least, as a count and as hundredths of the smaller name's.
LEAST, SHARE = 2, 75


def name_tokens(raw: Column) -> Column:
    words = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z0-9]+", " ")
    telling = F.regexp_replace(words, rf"\b(?:[a-z0-9]{{1,{SHORTEST - 1}}}|{'|'.join(IGNORED)})\b", "")
    return F.sort_array(F.array_distinct(F.array_remove(F.split(telling, " "), "")))


def needed(size: Column) -> Column:
    """Words that a name of ``size`` words shares with a name of as many or more to overlap it."""
    return F.greatest(F.lit(LEAST), F.floor(size * SHARE / 100)).cast("int")


def overlapping(sets: DataFrame, key: str) -> DataFrame:
    """a, b: ids of sets of one key that share ``needed`` of the smaller one's words; each pair once, in both directions.

    sets: id, key, tokens (two at least). Words are ranked from the rarest in their key; of a smaller set the first
    size - needed + 1 words are looked up among the first such words of larger ones, which every overlapping pair meets in.
    """
    words = sets.select("id", key, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = words.groupBy(key, "token").agg(F.count("*").alias("often"))
    ranked = words.join(often, [key, "token"]).groupBy("id", key, "n").agg(F.array_sort(F.collect_list(F.struct("often", "token")))["token"].alias("order"))
    placed = stored(ranked.select("id", key, "n", F.posexplode("order").alias("at", "token")), "name-words")
    small = placed.filter(F.col("at") <= F.col("n") - needed(F.col("n"))).select(key, "token", F.col("id").alias("a"), F.col("n").alias("na"))
    large = placed.select(key, "token", F.col("id").alias("b"), F.col("n").alias("nb"), "at")
    met = small.join(large, [key, "token"]).filter("na < nb or (na = nb and a < b)").filter(F.col("at") <= F.col("nb") - needed(F.col("na")))
    pairs = met.select("a", "b").distinct()
    of = lambda name: sets.select(F.col("id").alias(name), F.col("tokens").alias(f"t{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    linked = both.filter(F.size(F.array_intersect("ta", "tb")) >= needed(F.least(F.size("ta"), F.size("tb")))).select("a", "b")
    linked = stored(linked, "name-links")
    return linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id that links lead to. Labels spread to neighbours and then to their labels' labels."""
    links = stored(links, "name-edges")
    labels = links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        labels = stored(labels, "name-labels")
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("least"))
        jump = labels.select(F.col("id").alias("least"), F.col("component").alias("jumped"))
        after = stored(least.join(jump, "least", "left").select("id", "old", F.least("least", "jumped").alias("component")), "name-labels")
        labels = after.drop("old")
        if after.filter("component <> old").limit(1).count() == 0:
            return labels


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds each component: slots of the rows that stand, found by their words. Emits slot, position and rows taken in.

    Words that a row shares with each slot are counted as its own are looked up; words are distinct and stand in one text.
    """
    now, doc, slots = None, None, []
    by_word: dict[str, set[int]] = {}
    for batch in batches:
        out: list[tuple] = []
        names = ("key", "component", "doc", "pos", "length", "vat", "words")
        for key, component, own_doc, pos, length, vat, words in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now != (key, component):
                out += [(doc, *s[:3]) for s in slots]
                now, doc, slots, by_word = (key, component), own_doc, [], {}
            own, shared = words.split(" "), {}
            for t in own:
                for i in by_word.get(t, ()):
                    shared[i] = shared.get(i, 0) + 1
            size, hit = len(own), len(slots)
            for i, n in shared.items():
                if i < hit and n >= LEAST and n >= min(size, len(slots[i][5])) * SHARE // 100:
                    hit = i
            if hit == len(slots):
                slots.append([pos, pos, 1, vat, length, own])
            else:
                s = slots[hit]
                s[2] += 1
                if not (vat and not s[3]) and length <= s[4]:
                    continue
                for t in s[5]:
                    by_word[t].discard(hit)
                s[1], s[3], s[4], s[5] = pos, vat, length, own
            for t in own:
                by_word.setdefault(t, set()).add(hit)
        yield _table(out, batch.schema.field("doc").type)
    if slots:
        yield _table([(doc, *s[:3]) for s in slots], batch.schema.field("doc").type)


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]], names=["doc", "slot", "pos", "rows"])


def deduped(rows: DataFrame) -> DataFrame:
    """doc, slot, pos, rows: the rows that stand, the position of the first row in their place, and rows that they stand for.

    rows: doc, pos (long, unique in its document, not null), raw, qty, unit_price, line_total, vat. Rows of a document with
    equal numbers (null equals null) whose names overlap are one: a later row takes the place of the first one standing that
    it overlaps if it has tax where that has none, or a longer text, else it goes. Names of fewer than two telling words
    overlap nothing; of those, rows with equal numbers and texts (but for case) are one, and the first stands.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    key = F.concat_ws("|", F.coalesce(F.col("doc").cast("string"), F.lit("-")), number("qty"), number("unit_price"), number("line_total"))
    text, vat = F.coalesce("raw", F.lit("")), F.coalesce(F.col("vat") != 0, F.lit(False))
    keyed = stored(rows.select("doc", "pos", text.alias("raw"), vat.alias("vat"), key.alias("key"), name_tokens(F.col("raw")).alias("tokens")), "name-rows")
    few = keyed.filter(F.size("tokens") < LEAST).groupBy("key", F.lower("raw")).agg(F.min("pos").alias("slot"), F.count("*").alias("rows"), F.min("doc").alias("doc"))
    told = keyed.filter(F.size("tokens") >= LEAST).withColumn("_id", F.xxhash64("key", "tokens"))
    # counted under hashes: keys that share one are taken for large, and both ways fold alike
    large = stored(told.groupBy(F.xxhash64("key").alias("_k")).count().filter(F.col("count") > SMALL_KEY).select("_k"), "name-keys")
    placed = told.withColumn("component", F.lit(0).cast("long"))
    if not large.isEmpty():
        told, placed = told.withColumn("_k", F.xxhash64("key")), placed.withColumn("_k", F.xxhash64("key"))
        hot = told.join(large, "_k", "left_semi")
        sets = stored(hot.select(F.col("_id").alias("id"), "key", "tokens").distinct(), "name-sets")
        found = components(overlapping(sets, "key")).withColumnRenamed("id", "_id")
        apart = hot.join(found, "_id", "left").withColumn("component", F.coalesce("component", "_id"))
        placed = placed.join(large, "_k", "left_anti").unionByName(apart)
    dealt = placed.repartition("key", "component").sortWithinPartitions("key", "component", "pos")
    told = dealt.select("key", "component", "doc", "pos", F.length("raw").alias("length"), "vat", F.array_join("tokens", " ").alias("words"))
    stand = told.mapInArrow(_standing, f"doc {dict(keyed.dtypes)['doc']}, slot long, pos long, rows long")
    return stand.unionByName(few.select("doc", "slot", F.col("slot").alias("pos"), "rows"))


_NAME = "array_to_string(list_slice(string_split(p_name || ' ' || lower(p_type) || ' ' || p_brand || ' fresh pack number' || (l_linenumber % 4)::VARCHAR || ' and ' || l_returnflag || 'grade', ' '), 1, 1 + l_orderkey % 8), ' ')"
_MEET = f"len(list_intersect(r.tokens, v.tokens)) >= greatest({LEAST}, least(len(r.tokens), len(v.tokens)) * {SHARE} // 100)"


@register(
    "fuzzy_dedupe",
    "U4",
    f"""WITH RECURSIVE named AS (SELECT l_suppkey AS doc, (l_orderkey * 1000000000 + l_partkey * 1000 + l_linenumber * 100 + l_quantity)::BIGINT AS pos, {_NAME} AS raw, l_quantity AS q, l_tax > 0.03 AS vat FROM lineitem JOIN part ON l_partkey = p_partkey),
    once AS (SELECT doc, pos, q, max(raw) AS raw, bool_or(vat) AS vat FROM named GROUP BY doc, pos, q),
    told AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= {SHORTEST} AND NOT list_contains(['and', 'the', 'with', 'plain', 'fresh'], w))) AS tokens FROM once),
    few AS (SELECT doc, min(pos) AS slot, min(pos) AS pos, count(*) AS rows FROM told WHERE len(tokens) < {LEAST} GROUP BY doc, q, lower(raw)),
    steps AS MATERIALIZED (SELECT doc, q, row_number() OVER (PARTITION BY doc, q ORDER BY pos) AS i, {{'slot': pos, 'pos': pos, 'rows': 1::BIGINT, 'raw': raw, 'vat': vat, 'tokens': tokens}} AS v FROM told WHERE len(tokens) >= {LEAST}),
    fold AS (SELECT doc, q, i, [v] AS s FROM steps WHERE i = 1 UNION ALL
      SELECT doc, q, i, CASE WHEN hit = 0 THEN list_append(s, v) ELSE list_transform(s, lambda r, k: CASE WHEN k <> hit THEN r WHEN (v.vat AND NOT r.vat) OR length(v.raw) > length(r.raw)
        THEN {{'slot': r.slot, 'pos': v.pos, 'rows': r.rows + 1, 'raw': v.raw, 'vat': v.vat, 'tokens': v.tokens}} ELSE {{'slot': r.slot, 'pos': r.pos, 'rows': r.rows + 1, 'raw': r.raw, 'vat': r.vat, 'tokens': r.tokens}} END) END
      FROM (SELECT f.doc, f.q, t.i, f.s, t.v, coalesce(list_position(list_transform(f.s, lambda r: {_MEET.replace("v.tokens", "t.v.tokens")}), true), 0) AS hit FROM fold f JOIN steps t ON t.doc = f.doc AND t.q = f.q AND t.i = f.i + 1)),
    ends AS (SELECT doc, unnest(s) AS s FROM fold QUALIFY row_number() OVER (PARTITION BY doc, q ORDER BY i DESC) = 1)
    SELECT doc, s.slot AS slot, s.pos AS pos, s.rows AS rows FROM ends UNION ALL SELECT * FROM few""",
)
def fuzzy_dedupe(spark, sf_dir):
    """Lines of each supplier, their parts' names written with one to eight words; equal quantities are equal numbers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    pos = F.expr("cast(l_orderkey * 1000000000L + l_partkey * 1000L + l_linenumber * 100L + l_quantity as long)")
    words = F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand", F.lit("fresh pack"), F.concat(F.lit("number"), F.col("l_linenumber") % 4), F.lit("and"), F.concat("l_returnflag", F.lit("grade")))
    name = F.call_function("substring_index", words, F.lit(" "), (1 + F.col("l_orderkey") % 8).cast("int"))
    rows = lines.groupBy(F.col("l_suppkey").alias("doc"), pos.alias("pos"), F.col("l_quantity").alias("qty")).agg(F.max(name).alias("raw"), F.max((F.col("l_tax") > 0.03).cast("int")).alias("vat"))
    return deduped(rows.withColumns({"unit_price": F.lit(1.0), "line_total": F.col("qty")}))
