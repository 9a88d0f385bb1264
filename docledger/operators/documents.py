"""Documents: types, metadata, recipes in free text, JSON details and event metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions.text import bounded
from docledger.operators.windows import TEXT_LINES_SQL, text_lines
from docledger.plans.catalog import register
from docledger.plans.tables import table

# Document types in the order that breaks ties, and the terms that speak for them.
DOCUMENT_TYPES = (
    ("supplier_invoice", ("tax invoice", "invoice number", "invoice date", "unitprice", "unit price", "line total", "vatamt", "net amount", "subtotal", "supplier", "invoice from")),
    ("menu_costing_sheet", ("menu costing", "menu price", "food cost", "cost percentage", "gross profit", "selling price")),
    ("prep_sheet", ("yield in gram", "yield in kg", "portion volume", "cost per portion", "bulk prep", "prep item", "sauce", "batter")),
    ("stock_list", ("stock sheet", "par level", "total stock", "last invoice", "supplier", "unit price")),
    ("recipe", ("costing sheet", "ingredients", "quantity item", "item cost", "menu price", "california", "recipe")),
)


@register(
    "document_type_scores",
    "C4",
    """WITH t AS (SELECT page_id, lower(html || CASE WHEN page_id % 3 = 0 THEN ' tax invoice subtotal supplier' WHEN page_id % 3 = 1 THEN ' yield in kg sauce' ELSE '' END) AS t FROM pages),
    s AS (SELECT page_id, """
    + ", ".join("(" + " + ".join(f"contains(t, '{w}')::INT" for w in terms) + f") AS {kind}" for kind, terms in DOCUMENT_TYPES)
    + " FROM t), b AS (SELECT *, greatest("
    + ", ".join(kind for kind, _ in DOCUMENT_TYPES)
    + ") AS best, "
    + " + ".join(f"({kind} > 0)::INT" for kind, _ in DOCUMENT_TYPES)
    + " AS kinds FROM s) SELECT page_id, CASE WHEN best = 0 THEN 'recipe' "
    + " ".join(f"WHEN {kind} = best THEN '{kind}'" for kind, _ in DOCUMENT_TYPES)
    + " END AS type, best::BIGINT AS score, floor(least(0.95, greatest(0.35, best::DOUBLE / greatest(4, kinds))) * 100 + 0.5) / 100 AS confidence FROM b",
)
def document_type_scores(spark, sf_dir):
    """Type with the most of its terms in the text; the first type on a tie, recipe without any."""
    k = F.col("page_id") % 3
    more = F.when(k == 0, " tax invoice subtotal supplier").when(k == 1, " yield in kg sauce").otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.concat("html", more)).alias("t"))
    scores = [sum((F.col("t").contains(w).cast("int") for w in terms), F.lit(0)) for _, terms in DOCUMENT_TYPES]
    ranked = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("o"), F.lit(kind).alias("kind")) for i, (s, (kind, _)) in enumerate(zip(scores, DOCUMENT_TYPES, strict=True))))
    best = pages.select("page_id", ranked.alias("r")).select(
        "page_id", F.array_max("r").alias("b"), F.size(F.filter("r", lambda x: x["score"] > 0)).alias("kinds")
    )
    confidence = F.least(F.lit(0.95), F.greatest(F.lit(0.35), F.col("b.score") / F.greatest(F.lit(4), F.col("kinds"))))
    return best.select(
        "page_id",
        F.when(F.col("b.score") == 0, "recipe").otherwise(F.col("b.kind")).alias("type"),
        F.col("b.score").cast("long").alias("score"),
        (F.floor(confidence * 100 + 0.5) / 100).alias("confidence"),
    )


_URL = r"^https?://([^/]+)/?(.*)$"
_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"


@register(
    "metadata_regex",
    "F41 A20 S1",
    rf"""SELECT page_id, regexp_extract(url, '{_URL}', 1) AS supplier, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    nullif(regexp_extract(html, '{_DATE}', 0), '') AS date, len(regexp_extract_all(html, '[0-9]+'))::BIGINT AS numbers,
    list_max(list_transform(regexp_extract_all(html, '[0-9]+'), lambda x: x::DOUBLE)) AS largest FROM pages""",
)
def metadata_regex(spark, sf_dir):
    numbers = F.regexp_extract_all("html", F.lit("[0-9]+"), F.lit(0))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", _URL, 1).alias("supplier"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.nullif(F.regexp_extract("html", _DATE, 0), F.lit("")).alias("date"),
        F.regexp_count("html", F.lit("[0-9]+")).cast("long").alias("numbers"),
        F.array_max(F.transform(numbers, lambda x: x.cast("double"))).alias("largest"),
    )


# Suppliers in the order in which they are tried, by pattern over the address and text.
SUPPLIERS = (("first", "host0|site0"), ("shop", "shop|store"), ("numbered", "[0-9]"), ("other", "."))


@register(
    "supplier_detect",
    "F43 J10",
    "SELECT supplier, count(*) AS n FROM (SELECT CASE "
    + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{s}'" for s, p in SUPPLIERS)
    + " END AS supplier FROM pages) GROUP BY supplier",
)
def supplier_detect(spark, sf_dir):
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SUPPLIERS):
        out = F.when(F.lower("url").rlike(pattern), name).otherwise(out)
    return table(spark, sf_dir, "pages").groupBy(out.alias("supplier")).agg(F.count("*").alias("n"))


# Rules of row types - type, weight, terms - and of what speaks against them.
ROW_TYPES = (
    ("product", 3, "product|item|sku|description"), ("product", 2, "kg|ml|pcs|box|pack|bottle|dozen"), ("vat", 8, "vat|tax|gst"),
    ("total", 8, "total|amount due|amount payable"), ("total", -4, "subtotal|sub total"), ("subtotal", 8, "subtotal|sub total"),
    ("payment", 8, "paid|payment|cash|eft"), ("discount", 8, "discount|promo|rebate"), ("delivery", 8, "delivery|shipping|freight"),
    ("credit", 8, "credit"), ("return", 8, "returned|refund"), ("footer", 8, "page|phone|email|website|thank"), ("header", 8, "invoice"),
)
_TYPES = tuple(dict.fromkeys(t for t, _, _ in ROW_TYPES))
#: Cases for the classifier: a rotating head is put before each turn's text.
_HEADS = ("item 2 kg", "vat 15", "total due", "paid cash", "invoice", "delivery", "")


@register(
    "row_type_best",
    "W7",
    "WITH t AS (SELECT conv_id, turn, lower((["
    + ", ".join(f"'{h}'" for h in _HEADS)
    + "])[(conv_id + turn) % 7 + 1] || ' ' || coalesce(text, '')) AS t FROM conversations), s AS (SELECT conv_id, turn, "
    + ", ".join(
        "(" + " + ".join(f"{w} * regexp_matches(t, '{bounded(terms)}')::INT" for k, w, terms in ROW_TYPES if k == t) + f")::DOUBLE AS s{i}"
        for i, t in enumerate(_TYPES)
    )
    + " FROM t), l AS (SELECT *, list_sort(["
    + ", ".join(f"s{i}" for i in range(len(_TYPES)))
    + "], 'DESC') AS r FROM s) SELECT type, count(*) AS n, floor(sum(confidence) * 1000 + 0.5) / 1000 AS confidence FROM (SELECT CASE WHEN r[1] <= 0 OR r[1] - r[2] < 0.5 THEN 'unknown' "
    + " ".join(f"WHEN s{i} = r[1] THEN '{t}'" for i, t in enumerate(_TYPES))
    + " END AS type, CASE WHEN r[1] <= 0 OR r[1] - r[2] < 0.5 THEN 0 ELSE least(1, r[1] / 20 + (r[1] - r[2]) / 10) END AS confidence FROM l) GROUP BY type",
)
def row_type_best(spark, sf_dir):
    """Additive scores of the row types; the best one counts if it is positive and half a point ahead of the second."""
    head = F.get(F.array(*map(F.lit, _HEADS)), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    t = table(spark, sf_dir, "conversations").select(F.lower(F.concat(head, F.lit(" "), F.coalesce("text", F.lit("")))).alias("t"))
    scores = [
        sum((w * F.col("t").rlike(bounded(terms)).cast("int") for k, w, terms in ROW_TYPES if k == kind), F.lit(0)).cast("double")
        for kind in _TYPES
    ]
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (s, k) in enumerate(zip(scores, _TYPES, strict=True))))))
    top = t.select(ranked.alias("r")).select(F.col("r")[0].alias("a"), (F.col("r")[0]["s"] - F.col("r")[1]["s"]).alias("margin"))
    known = (F.col("a.s") > 0) & (F.col("margin") >= 0.5)
    return (
        top.select(
            F.when(known, F.col("a.k")).otherwise("unknown").alias("type"),
            F.when(known, F.least(F.lit(1.0), F.col("a.s") / 20 + F.col("margin") / 10)).otherwise(0.0).alias("c"),
        )
        .groupBy("type")
        .agg(F.count("*").alias("n"), (F.floor(F.sum("c") * 1000 + 0.5) / 1000).alias("confidence"))
    )


@register(
    "recipe_text_structure",
    "X16 B16",
    f"""WITH {TEXT_LINES_SQL}, m AS (SELECT *, min(CASE WHEN length(line) < 60 THEN idx END) OVER (PARTITION BY doc_id) AS i0, max(CASE WHEN length(line) > 300 THEN idx END) OVER (PARTITION BY doc_id) AS m0 FROM text_lines)
    SELECT doc_id, count(CASE WHEN idx > i0 AND (m0 IS NULL OR idx < m0) THEN 1 END) AS ingredients, count(CASE WHEN idx > m0 THEN 1 END) AS method,
    CASE WHEN any_value(i0) IS NOT NULL AND any_value(m0) IS NOT NULL THEN 0.9 WHEN any_value(i0) IS NOT NULL OR any_value(m0) IS NOT NULL THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM m GROUP BY doc_id""",
)
def recipe_text_structure(spark, sf_dir):
    """Sections between two markers: a first short line and a last long one."""
    per_doc = text_lines(spark, sf_dir).groupBy("doc_id").agg(
        F.min(F.when(F.length("line") < 60, F.col("idx"))).alias("i0"),
        F.max(F.when(F.length("line") > 300, F.col("idx"))).alias("m0"),
        F.max("idx").alias("last"),
    )
    i0, m0, last = F.col("i0"), F.col("m0"), F.col("last")
    upto = F.coalesce(m0 - 1, last)
    both, one = i0.isNotNull() & m0.isNotNull(), i0.isNotNull() | m0.isNotNull()
    return per_doc.select(
        "doc_id",
        F.coalesce(F.greatest(upto - i0, F.lit(0)), F.lit(0)).cast("long").alias("ingredients"),
        F.coalesce(last - m0, F.lit(0)).cast("long").alias("method"),
        F.when(both, 0.9).when(one, 0.6).otherwise(0.4).alias("confidence"),
    )


_RECIPE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(kg|g|ml|l|cups?|tbsp|tsp)?(?:\s+|$)(.*)$"


@register(
    "recipe_line_parse",
    "F49 F50 F51 F74",
    rf"""WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || 'g ' || p_name WHEN 1 THEN p_size || ' cups ' || p_name WHEN 2 THEN p_size || ' ' || p_name ELSE p_name END AS line FROM part)
    SELECT p_partkey, regexp_extract(line, '{_RECIPE}', 1) <> '' AS counted, try_cast(nullif(regexp_extract(line, '{_RECIPE}', 1), '') AS DOUBLE) AS quantity, nullif(regexp_extract(line, '{_RECIPE}', 2), '') AS unit,
    CASE WHEN regexp_matches(line, '{_RECIPE}') THEN regexp_extract(line, '{_RECIPE}', 3) ELSE line END AS ingredient FROM l""",
)
def recipe_line_parse(spark, sf_dir):
    """Quantity, unit and ingredient of a line; a unit ends at a space, so ``1 large onion`` has none."""
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat(size, F.lit("g "), name)).when(k == 1, F.concat(size, F.lit(" cups "), name)).when(k == 2, F.concat(size, F.lit(" "), name)).otherwise(name)
    part = lambda i: F.regexp_extract("line", _RECIPE, i)
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line")).select(
        "p_partkey",
        (part(1) != "").alias("counted"),
        F.nullif(part(1), F.lit("")).cast("double").alias("quantity"),
        F.nullif(part(2), F.lit("")).alias("unit"),
        F.when(F.col("line").rlike(_RECIPE), part(3)).otherwise(F.col("line")).alias("ingredient"),
    )


@register(
    "json_details_extract",
    "F65 F70 D19",
    """SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(CASE WHEN (props->>'$.k')::BIGINT > 50 THEN 1 END) AS large FROM events GROUP BY event_type""",
)
def json_details_extract(spark, sf_dir):
    """Details parsed by a schema after fences and text around the object are cut off."""
    noisy = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    salvaged = F.regexp_extract(noisy, r"(?s)(\{.*\})", 1)
    k = F.from_json(salvaged, "k long")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("k") > 50).alias("large")
    )


@register(
    "last_correction_wins",
    "T1 J8",
    """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""",
)
def last_correction_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value")
    )


@register(
    "tumbling_event_metrics",
    "T2 F64",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL""",
)
def tumbling_event_metrics(spark, sf_dir):
    from docledger.streaming.metrics import hourly

    return hourly(table(spark, sf_dir, "events"))


@register(
    "session_event_metrics",
    "T2 T4",
    """WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) = INTERVAL 30 MINUTE, false)::INT AS o FROM events),
    s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_event_metrics(spark, sf_dir):
    from docledger.streaming.metrics import sessions

    return sessions(table(spark, sf_dir, "events"))
