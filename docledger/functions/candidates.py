"""The ingredient that a description names: its phrases, a score for each by thirteen signals, and how sure the choice is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import keys, names
from docledger.functions.text import clean_cell

# Words of packaging and descriptive words in phrases; units and packages that a chosen phrase sheds.
PACKAGING_WORDS = ("bag", "box", "pack", "packet", "pkt", "case", "carton", "tray", "tin", "can", "roll", "unit", "ea", "each")
DESCRIPTIVE_WORDS = (
    "red", "green", "yellow", "black", "white", "baby", "large", "medium", "small", "loose", "whole", "fresh", "salted", "pitted", "granny",
    "flat", "italian", "heavy", "duty", "hduty", "poly", "vacuum", "refuse",
)
ENDING_UNITS, LEADING_PACKAGES = ("kg", "g", "l", "ml", "ea", "each", "unit"), ("can", "tin", "pack")
# What is told about a phrase.
AFTER_PREFIX = "appears after short prefix separator"
# What is told about a candidate.
NUMERIC, MERGED = "Conflicting numeric patterns detected", "Possible merged product text detected"
NO_PHRASE, CHOSEN = "No fragment scored above zero", "Selected highest-scoring meaningful fragment"

#: A phrase that scores like a product of its own, and phrases at least of a description that may hold two products.
LIKE_A_PRODUCT, MANY_PHRASES = 3.0, 3
#: More numbers than these leave it open which one counts.
CLEAR_NUMBERS = 2

_SEPARATORS = r"\s+-\s+|\s+-|-\s+|(?<=[A-Za-z])-(?=[A-Za-z])|[()\[\],;]"


def _words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0))


def _stripped(x: Column, characters: str) -> Column:
    return F.regexp_replace(x, f"^[{characters}]+|[{characters}]+$", "")


def phrases(x: Column) -> Column:
    """What stands between dashes, brackets, commas and semicolons; none of them empty."""
    parts = F.transform(F.split(x, _SEPARATORS), lambda p: _stripped(clean_cell(p), " .:"))
    return F.filter(parts, lambda p: p != "")


def short_prefix(x: Column) -> Column:
    """One or two words in at most twelve characters."""
    return F.size(_words(x)).between(1, 2) & (F.length(x) <= 12)


def signals(x: Column, after_prefix: Column) -> Column:
    """array<struct<points, reason>>: what speaks for a phrase and against it, in a fixed order."""

    def told(word: Column) -> Column:
        n, size, low = F.size(word), F.length(x), F.transform(word, F.lower)
        single = lambda known: (n == 1) & F.get(low, F.lit(0)).isin(*known)
        long_capitals = F.exists(word, lambda w: (F.upper(w) == w) & (F.length(w) > 5))
        numbers = F.regexp_count(x, F.lit(r"\d+"))
        found = (
            (n >= 1, 2.0, "contains alphabetic product words"),
            (n >= 2, 1.5, "contains multiple meaningful words"),
            (size >= 8, F.least(F.lit(2.0), size / 18.0), "longer descriptive phrase"),
            (after_prefix, 2.0, AFTER_PREFIX),
            (F.exists(low, lambda w: w.isin(*DESCRIPTIVE_WORDS)), 0.5, "contains descriptive modifier"),
            (single(names.PACK_UNITS), -4.0, "isolated unit token"),
            (single(PACKAGING_WORDS), -2.5, "isolated packaging token"),
            ((n <= 2) & (F.upper(x) == x) & (F.lower(x) != x) & (size <= 10), -2.0, "very short all-caps fragment"),
            ((numbers > 0) & (numbers >= n), -2.0, "mostly numeric"),
            (x.rlike(r"^[A-Z]{1,3}\d{2,5}$"), -4.0, "supplier-code shaped"),
            ((n <= 2) & ~long_capitals, -1.0, "only one or two generic-looking tokens"),
            (x.rlike(r"\d+\s*[xX]\s*\d+"), -3.0, "dimension-like fragment"),
            (F.regexp_count(x, F.lit(r"(?U)[^\w\s]")) > F.greatest(F.lit(2), F.floor(size / 3)), -1.0, "punctuation-heavy fragment"),
        )
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        rows = (F.when(c, F.struct(lit(points).alias("points"), F.lit(reason).alias("reason"))) for c, points, reason in found)
        return F.array_compact(F.array(*rows))

    return keys._bind(_words(x), told)


def total(told: Column) -> Column:
    return F.greatest(F.lit(0.0), F.aggregate(told, F.lit(0.0), lambda a, s: a + s["points"]))


def scored(found: Column) -> Column:
    """array<struct<fragment, score, reasons, alone>> of phrases; ``alone`` is the score without regard to the phrase before."""

    def one(x: Column, i: Column) -> Column:
        after = F.coalesce((i > 0) & short_prefix(F.get(found, i - 1)), F.lit(False))
        return keys._bind(
            signals(x, after),
            lambda told: F.struct(
                x.alias("fragment"),
                F.round(total(told), 3).alias("score"),
                F.transform(told, lambda s: s["reason"]).alias("reasons"),
                total(F.filter(told, lambda s: s["reason"] != AFTER_PREFIX)).alias("alone"),
            ),
        )

    return F.transform(found, one)


def best(found: Column) -> Column:
    """The phrase of the highest score, of equal ones the longest, then the first; null where none is above zero."""
    ranked = F.transform(found, lambda s, i: F.struct(s["score"], F.length(s["fragment"]), (-i).alias("minus"), s["fragment"].alias("fragment"), s["reasons"].alias("reasons")))
    top = F.array_max(F.filter(ranked, lambda s: s["score"] > 0))
    return F.when(top.isNotNull(), F.struct(top["fragment"].alias("fragment"), top["reasons"].alias("reasons")))


def tidy(x: Column) -> Column:
    """A phrase without the unit at its end, a lone x, and the package that three and more words begin with."""
    text = F.regexp_replace(x, rf"(?iU)\b(?:{'|'.join(ENDING_UNITS)})\b$", "")
    text = F.regexp_replace(text, r"(?U)\b[xX]\b", "")
    words = F.regexp_extract_all(text, F.lit("[A-Za-z/]+"), F.lit(0))
    packaged = (F.size(words) >= 3) & F.lower(F.get(words, F.lit(0))).isin(*LEADING_PACKAGES)
    text = F.when(packaged, F.regexp_replace(text, rf"(?iU)^\s*(?:{'|'.join(LEADING_PACKAGES)})\b", "")).otherwise(text)
    return _stripped(clean_cell(text), " .:-")


def _shown(x: Column) -> Column:
    """A number as Python writes a float: whole ones end in ``.0`` below 10^16."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def candidates(rows: DataFrame, text: str, to: str = "candidate") -> DataFrame:
    """``rows`` with a struct ``to``: the ingredient that ``text`` names, its code and pack, and how sure that is.

    Fields: source (trimmed), description (normalised), name (empty for none), code, pack_count, pack_size, pack_unit, pack_total, confidence, phrases (with
    score and reasons), selection_reason, reasons and conflicts. A null text counts as an empty one: no name, no phrases, no
    confidence. Confidence adds what was found, and shrinks where name or unit are missing and where numbers are ambiguous; a
    description that may hold two products says so in conflicts. Repeated rows stay. One projection: nothing is shuffled, and
    columns of ``rows`` are passed through whatever they are called.
    """
    c = F.col
    step = rows.select(F.struct("*").alias("_row"), F.trim(F.coalesce(c(text), F.lit(""))).alias("_source"), names.normal_description(c(text)).alias("_d"))
    step = step.withColumns({"_code": names.supplier_code(c("_d")), "_rest": names.without_code(c("_d"))}).withColumn("_pack", names.pack(c("_rest")))
    # a code that stands twice goes twice
    again = F.when(c("_code").isNull(), c("_rest")).otherwise(names.without(c("_rest"), c("_code")))
    step = step.withColumn("_phrases", phrases(names.without_pack(again))).withColumn("_scored", scored(c("_phrases"))).withColumn("_best", best(c("_scored")))
    step = step.withColumn("_name", F.coalesce(tidy(c("_best.fragment")), F.lit("")))
    another = F.exists("_scored", lambda s: (s["fragment"] != c("_name")) & (s["alone"] >= LIKE_A_PRODUCT))
    numeric = F.regexp_count("_d", F.lit(r"\d+(?:\.\d+)?")) > CLEAR_NUMBERS
    merged = another & (F.size("_scored") >= MANY_PHRASES)
    nameless, unitless, packed = c("_name") == "", c("_pack.unit").isNull(), c("_pack.count").isNotNull() & c("_pack.size").isNotNull()
    points = lambda condition, p: F.when(condition, p).otherwise(0.0)
    sure = (
        points(F.length("_d") > 10, 0.2) + points(F.length("_name") > 2, 0.3) + points(c("_code").isNotNull(), 0.15) + points(~unitless, 0.1) + points(packed, 0.2)
    ) * F.when(nameless, 0.7).otherwise(1.0) * F.when(unitless, 0.8).otherwise(1.0) * F.when(numeric, 0.7).otherwise(1.0)
    listed = lambda *told: F.array_compact(F.array(*(F.when(condition, reason) for condition, reason in told)))
    whole = F.struct(
        c("_source").alias("source"),
        c("_d").alias("description"),
        c("_name").alias("name"),
        c("_code").alias("code"),
        c("_pack.count").alias("pack_count"),
        c("_pack.size").alias("pack_size"),
        c("_pack.unit").alias("pack_unit"),
        F.when(packed & ~unitless, F.concat(_shown(c("_pack.count") * c("_pack.size")), F.lit(" "), c("_pack.unit"))).alias("pack_total"),
        sure.alias("confidence"),
        F.transform("_scored", lambda s: F.struct(s["fragment"].alias("fragment"), s["score"].alias("score"), s["reasons"].alias("reasons"))).alias("phrases"),
        F.when(c("_best").isNull(), NO_PHRASE).otherwise(F.concat_ws(": ", F.lit(CHOSEN), F.nullif(F.array_join("_best.reasons", ", "), F.lit("")))).alias("selection_reason"),
        listed(
            (~nameless, "Product-like description detected"), (c("_code").isNotNull(), "Supplier code detected"), (packed, "Pack pattern detected"),
        ).alias("reasons"),
        listed((numeric, NUMERIC), (merged, MERGED)).alias("conflicts"),
    )
    return step.select("_row.*", whole.alias(to))
