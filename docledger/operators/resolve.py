"""Entity resolution: candidates, comparison, proposals, memory and their review."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.functions import keys
from docledger.plans.catalog import register
from docledger.plans.tables import table


#: Descriptions of purchased goods; the second word of the part's name follows.
DESCRIPTIONS = (
    "Red Peppers 1kg", "Peppers Red", "Granny Smith Apples", "Baby Potatoes 10x1kg", "Tomatoes Each", "Carrots Loose", "Apples Granny Smith",
    "Chicken Breast Fillets 2 kg", "Strawberries Punnet 250g", "Refuse Bags 10 x 20", "Lunch Box (50's)", "Chillies Red Diced", "Tin Tuna",
    "Onions, Brown, Pickled 5 L", "Radishes", "Mangoes",
)
#: Pairs of descriptions to compare.
PAIRS = (
    ("Red Peppers 1kg", "Peppers Red"), ("Red Peppers", "Green Peppers"), ("Red Peppers", "Peppers"), ("Chicken Breast", "Beef Fillet"),
    ("Smoked Salmon", "Salmon Smoked"), ("Basmati Rice", "Rice Jasmine"), ("Sesame", "Sesame Seed"), ("Tofu Silken", "Silken Tofu"), ("Oil", "Xx"),
    ("***Oil***!!", "Oil"), ("Box (50's)", "Box (100's)"), ("Baby Carrots", "Carrots Large"), ("Garlic Whole", "Garlic"), ("", "Oil"),
)


def _pick(values, number):
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


@register(
    "match_keys",
    "F22 F23 F24 F25",
    """SELECT p_partkey, replace(g[1], '{n}', split_part(p_name, ' ', 2)) AS key, g[2] AS packaging FROM (SELECT p_partkey, p_name,
    ([['red pepper {n}',''], ['red pepper {n}',''], ['granny smith apple {n}',''], ['baby potato {n}',''], ['tomato {n}',''], ['carrot loose {n}',''],
      ['granny smith apple {n}',''], ['chicken breast fillets {n}',''], ['strawberry {n}',''], ['refuse bag {n} dim_10x20','dim_10x20'],
      ['lunch box {n} count_50','count_50'], ['chilli red diced {n}',''], ['tuna {n}',''], ['onion brown pickled {n}',''], ['radishes {n}',''], ['mango {n}','']])[p_partkey % 16 + 1] AS g FROM part)""",
)
def match_keys(spark, sf_dir):
    """The SQL holds the keys worked out by hand."""
    d = F.concat(_pick(DESCRIPTIONS, F.col("p_partkey")), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return table(spark, sf_dir, "part").select(
        "p_partkey", keys.match_key(d).alias("key"), F.array_join(keys.packaging_evidence(d), " ").alias("packaging")
    )


@register(
    "modifier_groups",
    "F26 F28",
    """SELECT p_partkey, g[1] AS colour, g[2] AS variety, g[3] AS cut_form, g[4] AS preparation, g[5] AS size_age, g[6] AS packaging_type, g[7] AS core, false AS weak, false AS noisy,
    ([0.85, 0.85, 0.85, 0.85, 0.8, 0.85, 0.85, 0.85, 0.65, 0.85, 0.85, 0.7, 0.65, 0.85, 0.65, 0.65])[p_partkey % 16 + 1]::DOUBLE AS confidence FROM (SELECT p_partkey, ([['red','','','','','','pepper'], ['red','','','','','','pepper'], ['','granny smith','','','','','apple'],
      ['','','','','baby','','potato'], ['','','','','','','tomato'], ['','','loose','','','','carrot'], ['','granny smith','','','','','apple'], ['','','breast fillets','','','','chicken'],
      ['','','','','','',''], ['','','','','','bag refuse','bag'], ['','','','','','box lunch','box'], ['red','','diced','','','',''], ['','','','','','',''],
      ['brown','','','pickled','','','onion'], ['','','','','','',''], ['','','','','','','']])[p_partkey % 16 + 1] AS g FROM part)""",
)
def modifier_groups(spark, sf_dir):
    """Modifiers of each description by group, its product, and doubts about its name. The SQL holds what was worked out by hand."""
    d = _pick(DESCRIPTIONS, F.col("p_partkey"))
    found = table(spark, sf_dir, "part").select("p_partkey", d.alias("d"), keys.match_tokens(d).alias("t"))
    return found.select(
        "p_partkey",
        *(F.array_join(keys.modifiers(F.col("t"), g), " ").alias(g) for g in keys.MODIFIERS),
        F.array_join(keys.core(F.col("t")), " ").alias("core"),
        keys.weak_name(F.col("d")).alias("weak"),
        keys.noisy_name(F.col("d")).alias("noisy"),
        keys.confidence(F.col("d")).alias("confidence"),
    )


@register(
    "token_set_ops",
    "U8 U9 U10 J13",
    """WITH a AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type) || ' ' || p_name[1:5], ' ')) AS b FROM part)
    SELECT p_partkey, len(list_intersect(a, b))::BIGINT AS shared, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x)))::BIGINT AS only_b, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM a""",
)
def token_set_ops(spark, sf_dir):
    a = F.array_distinct(F.split("p_name", " "))
    b = F.array_distinct(F.split(F.concat(F.lower("p_type"), F.lit(" "), F.substring("p_name", 1, 5)), " "))
    sets = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    size = lambda x: F.size(x).cast("long")
    return sets.select(
        "p_partkey",
        size(F.array_intersect("a", "b")).alias("shared"),
        size(F.array_except("a", "b")).alias("only_a"),
        size(F.array_except("b", "a")).alias("only_b"),
        (F.size(F.array_except("a", "b")) == 0).alias("subset"),
    )


@register(
    "pair_compare_scores",
    "J13 M3",
    """SELECT p_partkey, ([0.95, 0.45, 0.62, 0.25, 0.9, 0.9, 0.25, 0.35, 0.25, 0.6, 0.45, 0.45, 0.62, 0.0])[p_partkey % 14 + 1]::DOUBLE AS score FROM part""",
)
def pair_compare_scores(spark, sf_dir):
    """Two descriptions compared by key, product, modifiers and packages. The SQL holds the scores worked out by hand."""
    k = F.col("p_partkey")
    score = keys.compare(_pick([a for a, _ in PAIRS], k), _pick([b for _, b in PAIRS], k))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@register(
    "memory_best_match",
    "J10",
    """WITH c AS (SELECT o_custkey % 16 AS d, o_orderkey FROM orders), r AS (SELECT min(p_partkey) AS id, p_partkey % 16 AS d FROM part GROUP BY 2)
    SELECT c.d, count(*) AS n, min(r.id) AS matched, CASE WHEN min(r.id) IS NOT NULL THEN 0.95::DOUBLE END AS score FROM c LEFT JOIN r
    ON c.d NOT IN (8, 11, 12, 14, 15) AND r.d = CASE WHEN c.d = 1 AND (SELECT id FROM r WHERE d = 0) < (SELECT id FROM r WHERE d = 1) THEN 0 WHEN c.d = 0 AND (SELECT id FROM r WHERE d = 1) < (SELECT id FROM r WHERE d = 0) THEN 1
      WHEN c.d = 6 AND (SELECT id FROM r WHERE d = 2) < (SELECT id FROM r WHERE d = 6) THEN 2 WHEN c.d = 2 AND (SELECT id FROM r WHERE d = 6) < (SELECT id FROM r WHERE d = 2) THEN 6 ELSE c.d END GROUP BY c.d""",
)
def memory_best_match(spark, sf_dir):
    """Candidates against the memory's records of the same product: the best score, of equal ones the record first stored.

    Both sides are reduced to distinct descriptions before they meet, by an equi-join on the product's nouns. Candidates
    without such a noun, or without a record of their product, have no match and stay.
    """
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    candidates = orders.groupBy((F.col("o_custkey") % len(DESCRIPTIONS)).alias("d")).agg(F.count("*").alias("n"))
    candidates = candidates.withColumn("a", _pick(DESCRIPTIONS, F.col("d")))
    records = part.groupBy(_pick(DESCRIPTIONS, F.col("p_partkey")).alias("b")).agg(F.min("p_partkey").alias("id"))
    product = lambda c: F.array_join(keys.core(keys.match_tokens(F.col(c))), " ")
    known = records.withColumn("core", product("b")).filter("core <> ''")
    met = candidates.withColumn("core", product("a")).join(known, "core", "left")
    best = met.withColumn("score", keys.compare(F.col("a"), F.col("b"))).groupBy("d", "n").agg(
        F.max(F.when(F.col("id").isNotNull(), F.struct("score", (-F.col("id")).alias("minus")))).alias("m")
    )
    return best.select("d", "n", (-F.col("m.minus")).alias("matched"), "m.score")


@register(
    "proposal_typing",
    "M4",
    """WITH c AS (SELECT p_partkey, p_name, 0.5 + (p_size % 10) * 0.05::DOUBLE AS confidence, p_partkey % 3 = 0 AS target, p_partkey % 5 = 0 AS evidence, p_partkey % 11 = 0 AS merged, p_partkey % 13 = 0 AS noise, len(string_split(p_name, ' ')) AS tokens FROM part)
    SELECT CASE WHEN merged THEN 'possible_merge' WHEN noise THEN 'insufficient_evidence' WHEN confidence < 0.7 AND target THEN 'possible_merge' WHEN confidence < 0.7 THEN 'insufficient_evidence'
      WHEN target AND evidence THEN 'attach_supplier_variant' WHEN target THEN 'attach_alias' WHEN tokens < 2 THEN 'insufficient_evidence' ELSE 'create_new' END AS type, count(*) AS n FROM c GROUP BY 1""",
)
def proposal_typing(spark, sf_dir):
    """First rule that applies; nothing is approved or merged by itself."""
    k = F.col("p_partkey")
    confidence, target = 0.5 + (F.col("p_size") % 10) * F.lit(0.05), k % 3 == 0
    kind = (
        F.when(k % 11 == 0, "possible_merge")
        .when(k % 13 == 0, "insufficient_evidence")
        .when(confidence < 0.7, F.when(target, "possible_merge").otherwise("insufficient_evidence"))
        .when(target & (k % 5 == 0), "attach_supplier_variant")
        .when(target, "attach_alias")
        .when(F.size(F.split("p_name", " ")) < 2, "insufficient_evidence")
        .otherwise("create_new")
    )
    return table(spark, sf_dir, "part").groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


@register(
    "proposal_dedupe",
    "M5 M13 W11 T4 U3",
    """WITH k AS (SELECT lower(p_name) || '|' || lower(p_brand) AS key, min(p_partkey) AS first_id, count(*) AS seen FROM part GROUP BY 1)
    SELECT key, first_id, seen, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = first_id) THEN 'known' ELSE 'new' END AS state FROM k""",
)
def proposal_dedupe(spark, sf_dir):
    """One proposal a key, the first by id; those whose id is taken are known."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    key = F.concat(F.lower("p_name"), F.lit("|"), F.lower("p_brand"))
    first = part.groupBy(key.alias("key")).agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("seen"))
    taken = supplier.select(F.col("s_suppkey").alias("first_id"), F.lit("known").alias("s"))
    return first.join(taken, "first_id", "left").select("key", "first_id", "seen", F.coalesce("s", F.lit("new")).alias("state"))


@register(
    "state_machine_latest",
    "M6 T1",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'defer' WHEN 'click' THEN 'return' ELSE 'none' END AS a FROM events),
    s(user_id, r, state) AS (SELECT DISTINCT user_id, 0::BIGINT, 'pending' FROM events UNION ALL SELECT s.user_id, e.r, CASE WHEN state = 'pending' AND a = 'approve' THEN 'approved' WHEN state IN ('pending', 'deferred') AND a = 'reject' THEN 'rejected' WHEN state = 'pending' AND a = 'defer' THEN 'deferred' WHEN state = 'deferred' AND a = 'return' THEN 'pending' ELSE state END FROM s JOIN e ON s.user_id = e.user_id AND e.r = s.r + 1)
    SELECT user_id, state FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1""".replace("WITH e", "WITH RECURSIVE e"),
)
def state_machine_latest(spark, sf_dir):
    """State of each proposal after its events in order: invalid transitions change nothing.

    Each hour of a user is one map from the state before to the state after, and the hours' maps follow each other, so no
    task holds all events of a user.
    """
    action = F.create_map(*map(F.lit, ("purchase", "approve", "error", "reject", "signup", "defer", "click", "return")))[F.col("event_type")]
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", action.alias("a"))))["a"].alias("actions")
    )

    def step(state, a):
        pending, deferred = state == "pending", state == "deferred"
        return (
            F.when(pending & (a == "approve"), "approved")
            .when((pending | deferred) & (a == "reject"), "rejected")
            .when(pending & (a == "defer"), "deferred")
            .when(deferred & (a == "return"), "pending")
            .otherwise(state)
        )

    # approved and rejected are final, so the other two states make up the map
    after = [F.aggregate("actions", F.lit(before), step).alias(before) for before in ("pending", "deferred")]
    maps = hours.select("user_id", F.struct("hour", *after).alias("m")).groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("maps"))
    follow = lambda state, m: F.when(state == "pending", m["pending"]).when(state == "deferred", m["deferred"]).otherwise(state)
    return maps.select("user_id", F.aggregate("maps", F.lit("pending"), follow).alias("state"))


@register(
    "memory_variant_merge",
    "M7",
    """SELECT l_partkey, l_suppkey, count(*) AS seen, max(l_quantity) AS best, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_partkey, l_suppkey""",
)
def memory_variant_merge(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.count("*").alias("seen"),
        F.max("l_quantity").alias("best"),
        F.min("l_shipdate").alias("first_seen"),
        F.max("l_shipdate").alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"),
    )


@register(
    "fragment_select",
    "F33",
    r"""WITH f AS (SELECT p_partkey, unnest(string_split_regex(p_name || ' - ' || p_type || ', ' || p_brand, ' - |, ')) AS frag FROM part),
    s AS (SELECT p_partkey, frag, 2 + CASE WHEN contains(frag, ' ') THEN 1.5 ELSE 0 END + CASE WHEN length(frag) >= 8 THEN least(2, length(frag) / 18.0) ELSE 0 END - CASE WHEN regexp_matches(frag, '[0-9]') THEN 2 ELSE 0 END AS score FROM f)
    SELECT p_partkey, frag, floor(score * 1000 + 0.5) / 1000 AS score FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, length(frag) DESC, frag DESC) = 1""",
)
def fragment_select(spark, sf_dir):
    """The best-scored fragment of a description."""
    fragments = F.split(F.concat(F.col("p_name"), F.lit(" - "), F.col("p_type"), F.lit(", "), F.col("p_brand")), " - |, ")

    def scored(x):
        n = F.length(x)
        score = 2 + F.when(x.contains(" "), 1.5).otherwise(0.0) + F.when(n >= 8, F.least(F.lit(2.0), n / 18.0)).otherwise(0.0)
        return F.struct((score - F.when(x.rlike("[0-9]"), 2).otherwise(0)).alias("score"), n.alias("n"), x.alias("frag"))

    best = F.array_max(F.transform(fragments, scored))
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("b")).select(
        "p_partkey", "b.frag", (F.floor(F.col("b.score") * 1000 + 0.5) / 1000).alias("score")
    )


@register(
    "dedupe_first_wins",
    "U2 U3 U6 U7",
    """SELECT md5(text) AS digest, lang, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang""",
)
def dedupe_first_wins(spark, sf_dir):
    """One row for each text and language, the first by id; digests go through the shuffle, not texts."""
    digest = F.md5(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").groupBy(digest.alias("digest"), "lang").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )


@register(
    "row_neighbour_ranks",
    "W7 O2",
    """WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM s)
    SELECT a.user_id, CASE WHEN a.n - coalesce(b.n, 0) < 1 THEN 'unknown' ELSE a.event_type END AS best, a.n AS score, a.n - coalesce(b.n, 0) AS margin FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.k = 2 WHERE a.k = 1""",
)
def row_neighbour_ranks(spark, sf_dir):
    """Best and second-best type of each row and their margin; a tie is unknown."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    ranked = counts.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("n").over(order))
    margin = F.col("n") - F.coalesce("second", F.lit(0))
    return ranked.filter("k = 1").select(
        "user_id", F.when(margin < 1, "unknown").otherwise(F.col("event_type")).alias("best"), F.col("n").alias("score"), margin.alias("margin")
    )
