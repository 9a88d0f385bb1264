"""JSON documents and records of the memory as typed rows, with what was wrong in each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.plans.catalog import register
from docledger.plans.tables import spread, table
from docledger.sources import typed

#: Types of documents, the list of each, the name of each, and the number that is summed over its list.
KINDS = {"supplier_invoice": ("lines", "supplier_name", "quantity"), "recipe": ("ingredients", "recipe_name", "quantity"), "stock_list": ("items", "supplier_name", "unit_price")}
_ROW = '"supplier_code":"C{k}","ingredient":"Rice","unit":"kg","unit_price":{p},"line_total":null,"supplier":null,"item_cost":"R 5","description":"Rice {k}","vat":0,"category":"dry","field_confidence":{"quantity":0.5}'
_HEAD = '"document_type":"{t}","confidence":0.75,"notes":null,"supplier_name":"S{k}","invoice_number":"{k}","invoice_date":"2024-01-02","recipe_name":"R{k}","yield":"4","total_cost":null,"cost_per_portion":null,"total_excl_vat":{p},"vat_total":0,"total_incl_vat":{p}'
#: Documents and records that one task reads, about.
TASK_TEXTS = 30_000
#: Documents, {k} is an order's key, {p} its price, {t} a type, {l} the type's list: sound ones, and ones with faults of every kind.
DOCUMENTS = (
    "{" + _HEAD + ',"{l}":[{"quantity":{q},' + _ROW + "}]}",
    "{" + _HEAD + ',"{l}":[{"quantity":"{q}",' + _ROW + '},{"quantity":" 2.5 ",' + _ROW + '},{"quantity":"two","unit_price":true,"vat":[1]}]}',
    "{" + _HEAD + ',"{l}":[7,{"quantity":{q},"unit_price":"1e1","more":1,"extra":{}},null,"x",[{}]]}',
    '{"document_type":null,"confidence":"high","supplier_name":{q},"recipe_name":false,"{l}":{"a":1},"zeta":[],"alpha":null}',
    '{"document_type":"{t}","confidence":"0.5","supplier_name":["x"],"recipe_name":{"x":1},"{l}":[]}',
    "{}", "[1]", "{q}", '"text"', '{"a":', "", None, "null",
)
#: Records of the memory, {k} is a part's key, {n} its name.
RECORDS = (
    '{"ingredient_id":"I{k}","canonical_name":" {n} ","normalized_key":"{n}","aliases":["a","b",3],"supplier_variants":[{"supplier_name":"S","supplier_code":"C{k}","observation_count":{s},"match_confidence":0.5,"first_seen_at":"2024"}],"status":"approved","review_required":false,"notes":"n"}',
    '{"name":"{n}, Fresh!","supplier_variants":[{"observation_count":"{s}","match_confidence":"0.25"},{"observation_count":0,"last_seen_at":"2025"},{"observation_count":"many","match_confidence":[1]},5],"status":"gone"}',
    '{"canonical_name":"","display_name":"{n}","status":"approved","aliases":"x","observed_units":{"a":1},"review_required":"false"}',
    '{"normalized_key":"{n}","status":"merged","review_required":0,"supplier_variants":null,"notes":null}', '{"canonical_name":{s},"review_required":[],"status":null}', "{}", "[]", "nothing", None,
)


def _filled(texts, key: str, marks: dict[str, Column]) -> Column:
    out = F.get(F.array(*map(F.lit, texts)), (F.col(key) % len(texts)).cast("int"))
    return reduce(lambda x, m: F.replace(x, F.lit(f"{{{m[0]}}}"), m[1]), marks.items(), out)


def written(orders: DataFrame) -> DataFrame:
    """o_orderkey, kind, text: a document of each order."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("o_custkey") % len(KINDS)).cast("int"))
    listed = F.create_map(*(F.lit(v) for k, (name, *_) in KINDS.items() for v in (k, name)))[kind]
    marks = {"k": F.col("o_orderkey").cast("string"), "q": (F.col("o_custkey") % 50).cast("string"), "p": F.floor("o_totalprice").cast("string"), "t": kind, "l": listed}
    return orders.select("o_orderkey", kind.alias("kind"), _filled(DOCUMENTS, "o_orderkey", marks).alias("text"))


_quoted = lambda t: "NULL" if t is None else "'" + t.replace("'", "''") + "'"
_TEXTS = lambda texts: "[" + ", ".join(map(_quoted, texts)) + "]"
_JSON = {"string": "'VARCHAR'", "number": "'BIGINT', 'UBIGINT', 'DOUBLE'", "object": "'OBJECT'"}


def _number(x: str, name: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{name}') IN ({_JSON['number']}) THEN json_extract_string({x}, '$.{name}')::DOUBLE WHEN json_type({x}, '$.{name}') = 'VARCHAR' THEN try_cast(trim(json_extract_string({x}, '$.{name}')) AS DOUBLE) END"


def _text(x: str, name: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{name}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({x}, '$.{name}') END"


def _wrong(x: str, wanted: dict, path: str, needed: tuple[str, ...] = ()) -> str:
    parts = []
    for name, kind in wanted.items():
        t = f"json_type({x}, '$.{name}')"
        if isinstance(kind, list):
            inner = _wrong("e", kind[0], f"'{name}[' || (n - 1) || '].'")
            each = f"list_transform(json_extract({x}, '$.{name}[*]'), lambda e, n: CASE WHEN json_type(e) = 'OBJECT' THEN {inner} ELSE ['{name}[' || (n - 1) || ']: mistyped'] END)"
            parts.append(f"CASE WHEN {t} IS NULL THEN ['{name}: missing'] WHEN {t} <> 'ARRAY' THEN ['{name}: mistyped'] ELSE flatten({each}) END")
        else:
            allowed = _JSON[kind] + ("" if name in needed else ", 'NULL'")
            parts.append(f"CASE WHEN {t} IS NULL THEN [{path} || '{name}: missing'] WHEN {t} NOT IN ({allowed}) THEN [{path} || '{name}: mistyped'] ELSE [] END")
    known = ", ".join(f"'{w}'" for w in wanted)
    parts.append(f"list_transform(list_sort(list_filter(json_keys({x}), lambda k: k NOT IN ({known}))), lambda k: {path} || k || ': unexpected')")
    return f"flatten([{', '.join(parts)}])"


def _of_kind(make) -> str:
    return "CASE kind " + " ".join(f"WHEN '{kind}' THEN {make(kind)}" for kind in KINDS) + " END"


_SQL = f"""WITH d AS (SELECT o_orderkey, (['supplier_invoice', 'recipe', 'stock_list'])[o_custkey % 3 + 1] AS kind, (['lines', 'ingredients', 'items'])[o_custkey % 3 + 1] AS l, ({_TEXTS(DOCUMENTS)})[o_orderkey % {len(DOCUMENTS)} + 1] AS t, o_custkey % 50 AS q, floor(o_totalprice)::BIGINT AS p FROM orders),
filled AS (SELECT o_orderkey, kind, replace(replace(replace(replace(replace(t, '{{k}}', o_orderkey::VARCHAR), '{{q}}', q::VARCHAR), '{{p}}', p::VARCHAR), '{{t}}', kind), '{{l}}', l) AS text FROM d),
parsed AS (SELECT *, CASE WHEN json_valid(text) THEN CASE WHEN json_type(text) = 'OBJECT' THEN text::JSON END END AS j FROM filled)
SELECT o_orderkey, kind, {_of_kind(lambda k: _text("j", KINDS[k][1]))} AS name, {_number("j", "confidence")} AS confidence,
{_of_kind(lambda k: f"CASE WHEN j IS NOT NULL THEN CASE WHEN json_type(j, '$.{KINDS[k][0]}') = 'ARRAY' THEN json_array_length(j, '$.{KINDS[k][0]}') ELSE 0 END END")}::BIGINT AS items,
{_of_kind(lambda k: f"CASE WHEN j IS NOT NULL THEN coalesce(list_sum(list_transform(CASE WHEN json_type(j, '$.{KINDS[k][0]}') = 'ARRAY' THEN json_extract(j, '$.{KINDS[k][0]}[*]') END, lambda x: {_number('x', KINDS[k][2])})), 0) END")}::DOUBLE AS total,
CASE WHEN j IS NULL THEN 'corrupt' ELSE array_to_string({_of_kind(lambda k: _wrong("j", typed.fields(k), "''", ("document_type",)))}, ', ') END AS errors FROM parsed"""


@register("typed_documents", "F66 F67", _SQL)
def typed_documents(spark, sf_dir):
    """Documents of three types, each read by its own fields."""
    texts = written(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", TASK_TEXTS))
    out = []
    for kind, (listed, name, number) in KINDS.items():
        d = F.col("document")
        total = F.aggregate(d[listed][number], F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        read = typed.typed(texts.filter(F.col("kind") == kind), "text", kind)
        out.append(read.select(
            "o_orderkey", "kind", d[name].alias("name"), d["confidence"].alias("confidence"), F.when(d.isNotNull(), F.size(d[listed])).cast("long").alias("items"),
            total.alias("total"), F.array_join("errors", ", ").alias("errors"),
        ))
    return reduce(DataFrame.unionByName, out)


_TRUE = lambda x, n: f"coalesce(CASE json_type({x}, '$.{n}') WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN json_extract_string({x}, '$.{n}') = 'true' WHEN 'VARCHAR' THEN json_extract_string({x}, '$.{n}') <> '' WHEN 'ARRAY' THEN json_array_length({x}, '$.{n}') > 0 WHEN 'OBJECT' THEN len(json_keys({x}, '$.{n}')) > 0 ELSE json_extract_string({x}, '$.{n}')::DOUBLE <> 0 END, false)"
_SAID = lambda x, n: f"CASE WHEN {_TRUE(x, n)} THEN {_text(x, n)} END"
_VARIANTS = "CASE WHEN json_type(j, '$.supplier_variants') = 'ARRAY' THEN json_extract(j, '$.supplier_variants[*]') ELSE [] END"
_KNOWN = "(" + ", ".join(f"'{s}'" for s in typed.STATUSES) + ")"


@register(
    "record_reload",
    "F67",
    f"""WITH filled AS (SELECT p_partkey, replace(replace(replace(({_TEXTS(RECORDS)})[p_partkey % {len(RECORDS)} + 1], '{{k}}', p_partkey::VARCHAR), '{{n}}', p_name), '{{s}}', p_size::VARCHAR) AS text FROM part),
    parsed AS (SELECT p_partkey, CASE WHEN json_valid(text) THEN CASE WHEN json_type(text) = 'OBJECT' THEN text::JSON END END AS j FROM filled),
    named AS (SELECT *, CASE WHEN j IS NOT NULL THEN trim(coalesce({", ".join(_SAID("j", n) for n in ("canonical_name", "name", "display_name", "normalized_key"))}, '')) END AS name, coalesce({_text("j", "status")}, '') AS told, {_VARIANTS} AS vs FROM parsed)
    SELECT p_partkey, name, CASE WHEN j IS NOT NULL THEN trim(regexp_replace(lower(coalesce({_SAID("j", "normalized_key")}, name)), '[^a-z0-9]+', ' ', 'g')) END AS key,
    CASE WHEN j IS NULL THEN NULL WHEN told IN {_KNOWN} THEN told ELSE 'proposed' END AS status, CASE WHEN j IS NULL THEN NULL WHEN json_type(j, '$.review_required') IS NULL THEN told <> 'approved' ELSE {_TRUE("j", "review_required")} END AS review,
    CASE WHEN j IS NOT NULL THEN CASE WHEN json_type(j, '$.aliases') = 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.aliases[*]'), lambda x: json_extract_string(x, '$')), ',') ELSE '' END END AS aliases,
    CASE WHEN j IS NOT NULL THEN len(list_filter(vs, lambda x: json_type(x) = 'OBJECT')) END::BIGINT AS variants,
    CASE WHEN j IS NOT NULL THEN coalesce(list_sum(list_transform(list_filter(vs, lambda x: json_type(x) = 'OBJECT'), lambda x: greatest(1, coalesce({_number("x", "observation_count")}, 1))::BIGINT)), 0) END::BIGINT AS seen,
    CASE WHEN j IS NOT NULL THEN array_to_string(list_transform(list_filter(vs, lambda x: json_type(x) = 'OBJECT'), lambda x: coalesce({_SAID("x", "last_seen_at")}, {_SAID("x", "first_seen_at")}, 'now')), ',') END AS last_seen,
    CASE WHEN j IS NULL THEN 'corrupt' ELSE array_to_string(list_concat(list_filter([{", ".join(f"CASE WHEN json_type(j, '$.{n}') <> 'ARRAY' THEN '{n}: mistyped' END" for n in ("aliases", "supplier_variants", "observed_units", "observed_pack_formats"))},
      CASE WHEN json_type(j, '$.status') IS NOT NULL AND told NOT IN {_KNOWN} THEN 'status: unknown' END], lambda x: x IS NOT NULL),
      flatten(list_transform(vs, lambda x, i: list_transform(list_filter([CASE WHEN json_type(x) <> 'OBJECT' THEN ': mistyped' END, {", ".join(f"CASE WHEN json_type(x) = 'OBJECT' AND {_TRUE('x', n)} AND ({_number('x', n)}) IS NULL THEN '.{n}: mistyped' END" for n in ("observation_count", "match_confidence"))}],
        lambda e: e IS NOT NULL), lambda e: 'supplier_variants[' || (i - 1) || ']' || e)))), ', ') END AS errors FROM named""",
)
def record_reload(spark, sf_dir):
    """Records of the memory out of JSON of every age, with defaults."""
    marks = {"k": F.col("p_partkey").cast("string"), "n": F.col("p_name"), "s": F.col("p_size").cast("string")}
    texts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", TASK_TEXTS).select("p_partkey", _filled(RECORDS, "p_partkey", marks).alias("text"))
    r = F.col("record")
    v = r["supplier_variants"]
    return typed.records(texts, "text", F.lit("now")).select(
        "p_partkey", r["canonical_name"].alias("name"), r["normalized_key"].alias("key"), r["status"].alias("status"), r["review_required"].alias("review"),
        F.array_join(r["aliases"], ",").alias("aliases"), F.when(r.isNotNull(), F.size(v)).cast("long").alias("variants"),
        F.aggregate(v["observation_count"], F.lit(0).cast("long"), lambda a, x: a + x).alias("seen"), F.array_join(v["last_seen_at"], ",").alias("last_seen"),
        F.array_join("errors", ", ").alias("errors"),
    )
