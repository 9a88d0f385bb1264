"""JSON documents as typed rows: whatever is corrupt, missing, mistyped or unexpected is told, and nothing is lost in silence.

Texts are parsed once, into a VARIANT; every field is taken from there. No row fails a job.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.keys import _bind

_INGREDIENT = {
    "ingredient": "string", "quantity": "number", "unit": "string", "item_cost": "string", "supplier": "string", "unit_price": "number", "line_total": "number",
    "field_confidence": "object",
}
# Fields of each type of document; lists hold rows of the fields given.
SCHEMAS: dict[str, dict] = {
    "supplier_invoice": {
        "supplier_name": "string", "invoice_number": "string", "invoice_date": "string",
        "lines": [{
            "supplier_code": "string", "ingredient": "string", "description": "string", "quantity": "number", "unit": "string", "unit_price": "number",
            "line_total": "number", "vat": "number", "field_confidence": "object",
        }],
        "total_excl_vat": "number", "vat_total": "number", "total_incl_vat": "number",
    },
    "recipe": {"recipe_name": "string", "ingredients": [_INGREDIENT], "yield": "string", "total_cost": "string", "cost_per_portion": "string"},
    "stock_list": {
        "supplier_name": "string",
        "items": [{"supplier_code": "string", "ingredient": "string", "unit": "string", "unit_price": "number", "category": "string", "field_confidence": "object"}],
    },
    "prep_sheet": {"prep_item_name": "string", "section": "string", "ingredients": [_INGREDIENT], "yield": "string", "total_cost": "string", "cost_per_unit": "string"},
    "menu_costing_sheet": {
        "menu_item_name": "string", "category": "string", "ingredients": [_INGREDIENT], "menu_price": "string", "total_cost": "string", "cost_percentage": "string",
    },
}
# Fields of every type; the type whose fields others have; states of a record.
COMMON, OTHERWISE = {"document_type": "string", "confidence": "number", "notes": "string"}, "recipe"
STATUSES = ("proposed", "approved", "rejected", "merged", "archived")
_NUMBER, _TEXT = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "^STRING"


def fields(kind: str) -> dict:
    """Field to type of a document: string, number, object, or a list that holds the fields of its rows."""
    return COMMON | SCHEMAS.get(kind, SCHEMAS[OTHERWISE])


def template(kind: str) -> str:
    """An empty document of a type, as JSON: nulls, and one row of nulls in its list."""
    rows = lambda t: [dict.fromkeys(t[0])] if isinstance(t, list) else None
    return json.dumps({f: rows(t) for f, t in fields(kind).items()} | {"document_type": kind if kind in SCHEMAS else OTHERWISE})


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is(v: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(pattern), F.lit(False))


def _fields_of(v: Column) -> Column:
    """An object's fields by name, taken out of it in one pass; null for all else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(v: Column) -> Column:
    """Texts as they are, numbers and truth values as JSON writes them; null for all else."""
    return _bind(v, lambda x: F.when(~_is(x, "^(OBJECT|ARRAY|VOID)"), F.try_variant_get(x, "$", "string")))


def number_of(v: Column) -> Column:
    """Numbers, and texts that are numbers; null for all else."""
    return _bind(v, lambda x: F.when(_is(x, _NUMBER), F.try_variant_get(x, "$", "double")).when(_is(x, _TEXT), F.trim(F.try_variant_get(x, "$", "string")).try_cast("double")))


def object_of(v: Column) -> Column:
    return _bind(v, lambda x: F.when(_is(x, "^OBJECT"), F.to_json(x)))


_READ = {"string": (text_of, _TEXT), "number": (number_of, _NUMBER), "object": (object_of, "^OBJECT")}


def _field(got: Column, kind: str, needed: bool) -> Column:
    """value, wrong: what a field holds as its kind, and whether it is missing or mistyped (null for neither)."""
    read, pattern = _READ[kind]

    def told(both: Column) -> Column:
        x, shape = both["x"], both["shape"]
        fits = shape.rlike(pattern)
        is_sound = fits if needed else fits | (shape == "VOID")
        return F.struct(
            # a number in a number's place, the most frequent case, needs no second look at its type
            F.when(fits, F.try_variant_get(x, "$", "double" if kind == "number" else "string")).otherwise(read(x)).alias("value")
            if kind != "object"
            else F.when(fits, F.to_json(x)).alias("value"),
            F.when(x.isNull(), "missing").when(~is_sound, "mistyped").alias("wrong"),
        )

    return _bind(_bind(got, lambda x: F.struct(x.alias("x"), F.schema_of_variant(x).alias("shape"))), told)


def _row(fields_of: Column, wanted: dict, path: Column, needed: tuple[str, ...] = ()) -> Column:
    """value, errors: the struct of an object's fields, and what is wrong with it, in the order of the fields. Each field is read once."""
    step = {}
    for name, kind in wanted.items():
        got = F.try_element_at(fields_of, F.lit(name))
        step[name] = _list(got, kind[0], F.concat(path, F.lit(name))) if isinstance(kind, list) else _field(got, kind, name in needed)

    def put(read: Column) -> Column:
        errors = []
        for name, kind in wanted.items():
            wrong = read[name]["wrong"]
            own = F.when(wrong.isNotNull(), F.array(F.concat(path, F.lit(f"{name}: "), wrong)))
            errors.append(own.otherwise(F.flatten(F.transform(read[name]["items"], lambda b: b["errors"])) if isinstance(kind, list) else F.array().cast("array<string>")))
        more = F.array_sort(F.array_except(F.map_keys(fields_of), F.array(*map(F.lit, wanted))))
        errors.append(F.transform(more, lambda m: F.concat(path, m, F.lit(": unexpected"))))
        value = lambda name, kind: F.transform(read[name]["items"], lambda b: b["value"]) if isinstance(kind, list) else read[name]["value"]
        return F.struct(F.struct(*(value(name, kind).alias(name) for name, kind in wanted.items())).alias("value"), F.concat(*errors).alias("errors"))

    return _bind(F.struct(*(c.alias(name) for name, c in step.items())), put)


def _list(got: Column, wanted: dict, path: Column) -> Column:
    """items, wrong: the rows of a list, and whether it is missing or no list."""

    def told(both: Column) -> Column:
        items = F.coalesce(_items(both["parts"], wanted, path), F.array().cast(_item_type(wanted)))
        return F.struct(items.alias("items"), F.when(both["x"].isNull(), "missing").when(both["parts"].isNull(), "mistyped").alias("wrong"))

    return _bind(_bind(got, lambda x: F.struct(x.alias("x"), _list_of(x).alias("parts"))), told)


def _item(v: Column, wanted: dict, path: Column) -> Column:
    mistyped = F.struct(F.lit(None).alias("value"), F.array(F.concat(path, F.lit(": mistyped"))).alias("errors"))
    return _bind(_fields_of(v), lambda own: F.when(own.isNotNull(), _row(own, wanted, F.concat(path, F.lit(".")))).otherwise(mistyped))


def _items(parts: Column, wanted: dict, path: Column) -> Column:
    return F.transform(parts, lambda x, i: _item(x, wanted, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))


def _item_type(wanted: dict) -> str:
    of = {"string": "string", "number": "double", "object": "string"}
    return "array<struct<value: struct<" + ", ".join(f"`{n}`: {of[k]}" for n, k in wanted.items()) + ">, errors: array<string>>>"


def typed(rows: DataFrame, text: str, kind: str, to: str = "document", errors: str = "errors") -> DataFrame:
    """``rows`` with a struct ``to`` of the fields of a type of document, and what is wrong with them.

    A field that is missing or of another type is told; its value is read where it can be (a number in quotes) and null where
    not. Nulls are allowed but for the document's type. Items of a list keep their places; what is no object is a null there.
    A text that is null, no JSON, no object, or repeats a key is ``corrupt``, and all its fields are null. Fields that the type does
    not know are told as unexpected. Unknown types have the fields of a recipe. One projection, repeated rows stay, and an
    empty table gives an empty one.
    """
    step = rows.select(F.struct("*").alias("_row"), _fields_of(F.try_parse_json(F.col(text))).alias("_v"))
    sound = F.col("_v").isNotNull()
    read = step.withColumn("_read", F.when(sound, _row(F.col("_v"), fields(kind), F.lit(""), ("document_type",))))
    return read.select("_row.*", F.col("_read.value").alias(to), F.when(sound, F.col("_read.errors")).otherwise(F.array(F.lit("corrupt"))).alias(errors))


def _truth(v: Column) -> Column:
    """What counts as true: everything but null, false, zero, and empty texts, lists and objects."""
    kind = F.schema_of_variant(v)
    shown = F.to_json(v)
    return ~(v.isNull() | (kind == "VOID") | shown.isin("false", '""', "[]", "{}") | (F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(1.0)) == 0) & kind.rlike(_NUMBER))


def records(rows: DataFrame, text: str, now: Column, to: str = "record", errors: str = "errors") -> DataFrame:
    """``rows`` with a struct ``to``: a record of the memory out of JSON, with defaults for what is missing or mistyped.

    The name is the first that is not empty of canonical_name, name, display_name and normalized_key; the key is made of it where it is
    missing; an unknown status is ``proposed``; a record is to be reviewed unless approved or told otherwise. A variant's counts are
    one at least, its confidence a number or zero, its times ``now`` where it has none. Values that could not be read are listed; a corrupt text gives a
    null record. Old records without a field are no error.
    """
    step = rows.select(F.struct("*").alias("_row"), F.try_parse_json(F.col(text)).alias("_v"), now.alias("_now"))
    v = F.col("_v")
    # an empty text, zero or false is passed by like a null
    said = lambda at, name: F.when(_truth(_part(at, name)), text_of(_part(at, name)))
    some = lambda at, name: text_of(_part(at, name))
    key = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    items = lambda name: F.coalesce(F.when(_is(_part(v, name), "^ARRAY"), F.try_variant_get(_part(v, name), "$", "array<variant>")), F.array().cast("array<variant>"))
    texts = lambda name: F.array_compact(F.transform(items(name), text_of)).alias(name)

    def variant(x: Column) -> Column:
        first = F.coalesce(said(x, "first_seen_at"), F.col("_now").cast("string"))
        return F.struct(
            *(F.coalesce(said(x, n), F.lit("")).alias(n) if n in ("supplier_name", "supplier_description", "candidate_name") else some(x, n).alias(n) for n in (
                "supplier_name", "supplier_code", "supplier_description", "candidate_name", "purchase_unit", "pack_size_unit",
            )),
            *(number_of(_part(x, n)).alias(n) for n in ("pack_count", "pack_size_value")),
            first.alias("first_seen_at"),
            F.coalesce(said(x, "last_seen_at"), first).alias("last_seen_at"),
            F.greatest(F.lit(1), F.coalesce(number_of(_part(x, "observation_count")), F.lit(1.0))).cast("long").alias("observation_count"),
            F.coalesce(number_of(_part(x, "match_confidence")), F.lit(0.0)).alias("match_confidence"),
        )

    name = F.trim(F.coalesce(*(said(v, n) for n in ("canonical_name", "name", "display_name", "normalized_key")), F.lit("")))
    status = F.when(some(v, "status").isin(*STATUSES), some(v, "status")).otherwise("proposed")
    review = F.when(_part(v, "review_required").isNull(), status != "approved").otherwise(_truth(_part(v, "review_required")))
    record = F.struct(
        F.coalesce(said(v, "ingredient_id"), F.lit("")).alias("ingredient_id"),
        name.alias("canonical_name"),
        key(F.coalesce(said(v, "normalized_key"), name)).alias("normalized_key"),
        texts("aliases"),
        F.transform(F.filter(items("supplier_variants"), lambda x: _is(x, "^OBJECT")), variant).alias("supplier_variants"),
        some(v, "preferred_purchase_unit").alias("preferred_purchase_unit"),
        texts("observed_units"),
        texts("observed_pack_formats"),
        *(F.coalesce(said(v, n), F.col("_now").cast("string")).alias(n) for n in ("created_at", "updated_at")),
        status.alias("status"),
        review.alias("review_required"),
        F.coalesce(some(v, "notes"), F.lit("")).alias("notes"),
    )
    lists = ("aliases", "supplier_variants", "observed_units", "observed_pack_formats")
    wrong = [F.when(_part(v, n).isNotNull() & ~_is(_part(v, n), "^ARRAY"), f"{n}: mistyped") for n in lists]
    wrong.append(F.when(_part(v, "status").isNotNull() & ~F.coalesce(some(v, "status").isin(*STATUSES), F.lit(False)), "status: unknown"))
    unread = lambda x, n: _truth(_part(x, n)) & number_of(_part(x, n)).isNull()
    inside = F.flatten(F.transform(items("supplier_variants"), lambda x, i: F.transform(
        F.array_compact(F.array(
            F.when(~_is(x, "^OBJECT"), ": mistyped"), *(F.when(_is(x, "^OBJECT") & unread(x, n), f".{n}: mistyped") for n in ("observation_count", "match_confidence")),
        )), lambda e: F.concat(F.lit("supplier_variants["), i.cast("string"), F.lit("]"), e),
    )))
    sound = _is(v, "^OBJECT")
    told = F.when(sound, F.concat(F.array_compact(F.array(*wrong)), inside)).otherwise(F.array(F.lit("corrupt")))
    return step.select("_row.*", F.when(sound, record).alias(to), told.alias(errors))
