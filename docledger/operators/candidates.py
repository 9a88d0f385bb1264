"""Ingredient candidates of descriptions, their analysis, and their match with the memory or a proposal for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import candidates, keys, names
from docledger.functions.candidates import MERGED, NUMERIC
from docledger.plans.catalog import register
from docledger.plans.tables import spread, stored, table

# Products of which two in one text make it one of several; words that make no ingredient by themselves.
PRODUCTS = ("crabstick", "crabsticks", "nori", "chicken", "bacon", "mushroom", "tomato", "tomatoes", "dates", "tofu", "salmon", "rice")
GENERIC = ("premium", "large", "small", "medium", "fresh", "frozen")
# What is told of an analysis and why its confidence is capped.
FOR_MERGED, FOR_NUMBERS = "Ingredient candidate has merged-product warning", "Ingredient candidate has numeric ambiguity"
FOR_WEAK, FOR_NOISE = "Weak candidate name", "OCR-noise-heavy candidate"
AMBIGUOUS, WEAK = "merged-product or OCR ambiguity", "weak candidate name"
#: Confidence of a capped candidate at most, of a sure match at least, of a proposal without doubts at least, in hundredths.
CAP, SURE, DOUBTLESS = 60, 90, 70

#: Descriptions that one task analyses, about.
TASK_TEXTS = 5_000
#: Descriptions; {n} is a part's name, {N} the same in capitals, {t} its type, {s} its size, {b} its brand.
TEXTS = (
    "NOR008 {n} - fresh {t} {s}kg", "{t} - {n}, {b}", "{n} {s} x 250 ml ({s}'s) tin", "WHO - {n} punnet {s}g", "can {n} whole x kg", "BAG",
    "10456 {n} 10456 - {t}; poly [{s} x 20]", "{n}-{t}-{b}-{s}", "  ", "***::--", "QX10{s} {n}s", "{t}", "Rolls {s} soft {n} bags box", "{N}; ABCDEFG; AB",
    "{n} (salmon - rice) merged", "Red Peppers {n}, ; {s} 0 kg", "Lunch Box {n} ({s}'s)", "{n} {t}", "{s}", "AB1234 - large {n} 3 x 1.5 l", "case {n} tin [x] 2.5L each",
)


def _has(signals: Column, *words: str) -> Column:
    """Some signal holds one of the words, in any case."""
    return F.exists(signals, lambda s: F.lower(s).rlike("|".join(words)))


def _in_packaging(x: Column) -> Column:
    return F.lower(x).rlike(f"(?<![a-z])({'|'.join(keys.PACKAGING)})(?![a-z])")


def analysed(rows: DataFrame, candidate: str = "candidate", to: str = "analysis") -> DataFrame:
    """``rows`` with a struct ``to``: key, display_name, confidence (0 to 1), conflicts, cap_reason, packaging.

    The key is that of the candidate's name, and of its whole description too where the name is one of packaging. Where no
    word is left for a key, ``to`` is null. A product, several words raise the confidence; what the candidate warns of, a weak
    name or a noisy one cap it at 0.6.
    """
    c = F.col(candidate)
    text = F.when(_in_packaging(c["name"]), F.concat_ws(" ", c["name"], c["source"])).otherwise(c["name"])
    step = rows.select("*", keys.match_tokens(text).alias("_tokens"))
    merged, numeric = _has(c["conflicts"], "merged"), _has(c["conflicts"], "numeric", "ambigu")
    noisy, weak = keys.noisy_name(c["name"]) | _has(c["conflicts"], "ocr", "noise"), keys.weak_name(c["name"])
    points = 65 + F.when(F.size(keys.core(F.col("_tokens"))) > 0, 15).otherwise(0) + F.when(F.size("_tokens") > 1, 5).otherwise(0)
    reason = F.when(merged | numeric | noisy, AMBIGUOUS).when(weak, WEAK)
    told = ((merged, FOR_MERGED), (numeric, FOR_NUMBERS), (weak, FOR_WEAK), (noisy, FOR_NOISE))
    own = F.array_compact(F.array(*(F.when(condition, reason) for condition, reason in told)))
    conflicts = F.when(reason.isNull(), own).otherwise(F.array_union(own, c["conflicts"]))
    key = F.array_join("_tokens", " ")
    whole = F.struct(
        key.alias("key"),
        keys.display_name(key).alias("display_name"),
        (F.when(reason.isNull(), points).otherwise(F.least(points, F.lit(CAP))) / 100).alias("confidence"),
        conflicts.alias("conflicts"),
        reason.alias("cap_reason"),
        F.filter("_tokens", lambda t: t.isin(*keys.PACKAGING) | t.rlike("^(dim|count)_")).alias("packaging"),
    )
    return step.withColumn(to, F.when(F.size("_tokens") > 0, whole)).drop("_tokens")


def _handles(memory: DataFrame) -> DataFrame:
    """kind, value, record: the first record, by id, that each key, alias, code, description and name leads to."""
    record = F.struct("id", F.col("status").alias("status"), F.col("normalized_key").alias("key")).alias("record")
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    nothing = F.array().cast("array<string>")
    variant = lambda kind: F.transform(F.coalesce(F.col("variants")[kind], nothing), lambda v: of(kind, F.trim(v)))
    found = F.concat(
        F.array(of("key", F.col("normalized_key"))),
        F.transform(F.coalesce("aliases", nothing), lambda a: of("alias", keys.match_key(a))),
        *(variant(k) for k in ("code", "description", "name")),
    )
    told = memory.select(record, F.explode(found).alias("h")).filter("h.value is not null and h.value <> ''")
    return told.groupBy("h.kind", "h.value").agg(F.min("record").alias("record"))


def likely(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """key, target: the record whose key shares most words with a key, relative to the longer one, half of them at least.

    wanted: key; known: key, id; all keys distinct. Of equal shares the smallest id. Words are ranked from those rarest among the known
    keys; keys that share half the longer one's words have one in common among the first size - ceil(size / 2) + 1 words of each, so only these meet.
    """
    words = lambda d, *more: d.select("key", F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("key"), "[^a-z0-9]+", " ")), " ")).alias("words"), *more)
    a, b = words(wanted).filter("words[0] <> ''"), words(known, "id").filter("words[0] <> ''")
    often = b.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))

    def first(d: DataFrame, *more: str) -> DataFrame:
        counted = d.select("key", *more, "words", F.explode("words").alias("word")).join(often, "word", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")))["word"]
        ranked = counted.groupBy("key", *more, "words").agg(order.alias("order"))
        return ranked.withColumn("word", F.explode(F.slice("order", F.lit(1), F.floor(F.size("words") / 2).cast("int") + 1))).drop("order")

    left, right = first(a), first(b, "id").withColumnsRenamed({"key": "other", "words": "theirs"})
    share = F.size(F.array_intersect("words", "theirs")) / F.greatest(F.size("words"), F.size("theirs"))
    best = left.join(right, "word").select("key", share.alias("share"), (-F.col("id")).alias("minus")).filter("share >= 0.5")
    return best.groupBy("key").agg(F.max(F.struct("share", "minus")).alias("m")).select("key", (-F.col("m.minus")).alias("target"))


def matched(rows: DataFrame, memory: DataFrame, id: str) -> DataFrame:
    """A match or a proposal for each analysed candidate: id, state, record, type, target, kind, of.

    rows: ``id`` (unique, not null), candidate, analysis. memory: id (long), normalized_key, status, aliases, variants (code,
    description, name); empty memories match nothing. A candidate meets the record of its key, or else the first that has its
    key as an alias, or its code, description or name as a variant. The match is safe if the record is approved and, where the
    key led to it, the confidence is 0.9 or nothing conflicts: state ``matched``, with ``record``. Other candidates are
    proposed, with a type and the ``target`` that the proposal is about (``kind`` exact or likely): nothing is approved by
    itself. Of candidates that propose alike the first by id is ``proposed``, the others are ``duplicate`` ``of`` it. Without
    a key the state is ``none``. What meets are keys and handles, each aggregated first; descriptions stay where they are.
    """
    c, a = F.col("candidate"), F.col("analysis")
    slim = rows.select(
        F.col(id).alias("_id"), a["key"].alias("key"), a["confidence"].alias("confidence"), a["conflicts"].alias("told"), c["conflicts"].alias("warned"),
        c["code"].alias("code"), c["source"].alias("source"), F.trim(c["name"]).alias("name"),
    )
    # a memory is made from many rows; a filter on its keys must not be worked out for each of these, nor the memory made again
    slim, memory = stored(slim, "candidates"), stored(memory, "memory")
    named, records = slim.filter("key is not null"), _handles(memory)
    pair = lambda kind, value, rank: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"), F.lit(rank).alias("rank"))
    wants = F.array(pair("key", "key", 0), pair("alias", "key", 1), pair("code", "code", 1), pair("description", "source", 1), pair("name", "name", 1))
    met = named.select("_id", F.explode(wants).alias("w")).select("_id", "w.*").filter("value is not null and value <> ''").join(records, ["kind", "value"])
    found = met.groupBy("_id").agg(F.min(F.struct("rank", "record")).alias("f"))
    record = F.col("f.record")
    safe = (record["status"] == "approved") & ((F.col("f.rank") > 0) | (F.col("confidence") >= SURE / 100) | (F.size("told") == 0))
    # the target of a proposal: the record of the key, else the one that shares most words
    known = memory.filter("normalized_key <> ''").groupBy(F.col("normalized_key").alias("key")).agg(F.min("id").alias("id"))
    exact = named.select("key").distinct().join(known.withColumnRenamed("id", "exact"), "key", "left")
    near = likely(exact.filter("exact is null").select("key"), known)
    targets = exact.join(near, "key", "left").select("key", F.coalesce("exact", "target").alias("target"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("target").isNotNull(), "likely").alias("kind"))
    whole = slim.join(found, "_id", "left").join(targets, "key", "left").withColumn("safe", F.coalesce(safe, F.lit(False)))
    told, target = F.array_union(F.coalesce("warned", F.array().cast("array<string>")), F.coalesce("told", F.array().cast("array<string>"))), F.col("target").isNotNull()
    text = F.lower(F.concat_ws(" ", "name", "source", F.array_join(told, " ")))
    several = F.size(F.array_intersect(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), keys._values(PRODUCTS))) >= 2
    supplied = F.greatest(F.col("code").isNotNull(), F.col("source") != "")
    parts = F.split(F.trim(F.regexp_replace("key", "[^a-z0-9]+", " ")), " ")
    plausible = (F.size(parts) > 1) & F.exists(parts, lambda t: ~t.rlike("^[0-9]+$")) & F.exists(parts, lambda t: ~t.isin(*GENERIC))
    kind = (
        F.when(text.contains("merged") | several, "possible_merge")
        .when(F.lower(F.array_join(told, " ")).rlike("ocr|numeric ambiguity"), "insufficient_evidence")
        .when(F.col("confidence") < DOUBTLESS / 100, F.when(target, "possible_merge").otherwise("insufficient_evidence"))
        .when(target, F.when(supplied, "attach_supplier_variant").otherwise("attach_alias"))
        .when(~plausible, "insufficient_evidence")
        .otherwise("create_new")
    )
    typed = whole.withColumn("type", F.when(F.col("key").isNotNull() & ~F.col("safe"), kind))
    plain = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(x).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))
    alike = F.concat_ws("|", *map(plain, ("code", "source", "name", "key", "type", "target")))
    typed = stored(typed.withColumn("alike", F.when(F.col("type").isNotNull(), alike)), "proposals")
    firsts = typed.filter("alike is not null").groupBy("alike").agg(F.min("_id").alias("of"))
    state = F.when(F.col("key").isNull(), "none").when(F.col("safe"), "matched").when(F.col("of") == F.col("_id"), "proposed").otherwise("duplicate")
    proposing = F.col("type").isNotNull()
    return typed.join(firsts, "alike", "left").select(
        F.col("_id").alias(id), state.alias("state"), F.when(F.col("safe"), record["id"]).alias("record"), "type",
        F.when(proposing, F.col("target")).alias("target"), F.when(proposing, F.col("kind")).alias("kind"), "of",
    )


def described(part: DataFrame) -> DataFrame:
    """p_partkey, text: a description of each part."""
    text = F.get(F.array(*map(F.lit, TEXTS)), (F.col("p_partkey") % len(TEXTS)).cast("int"))
    for mark, value in (("{n}", F.col("p_name")), ("{N}", F.upper("p_name")), ("{t}", F.lower("p_type")), ("{s}", F.col("p_size").cast("string")), ("{b}", F.col("p_brand"))):
        text = F.replace(text, F.lit(mark), value)
    dealt = spread(part.select("p_partkey", "p_name", "p_type", "p_size", "p_brand"), "p_partkey", TASK_TEXTS)
    return dealt.select("p_partkey", text.alias("text"))


def _case(pairs) -> str:
    return " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_P, _UNITS = r"\d+(?:\.\d+)?", "|".join(names.PACK_UNITS)
_MARKS = "text"
for _mark, _value in (("{n}", "p_name"), ("{N}", "upper(p_name)"), ("{t}", "lower(p_type)"), ("{s}", "p_size::VARCHAR"), ("{b}", "p_brand")):
    _MARKS = f"replace({_MARKS}, '{_mark}', {_value})"
_MANY, _ONE = rf"(?i)({_P})\s*[x×]\s*({_P})\s*(\w+)", rf"(?i)({_P})\s*(\w+)"
#: The signals of a phrase: condition, points, what is told.
_SIGNALS = (
    ("n >= 1", "2.0", "contains alphabetic product words"), ("n >= 2", "1.5", "contains multiple meaningful words"),
    ("length(frag) >= 8", "least(2.0, length(frag) / 18.0)", "longer descriptive phrase"),
    ("i > 1 AND len(pw) BETWEEN 1 AND 2 AND length(prev) <= 12", "2.0", candidates.AFTER_PREFIX),
    (f"len(list_intersect(low, {_list(candidates.DESCRIPTIVE_WORDS)})) > 0", "0.5", "contains descriptive modifier"),
    (f"n = 1 AND list_contains({_list(names.PACK_UNITS)}, low[1])", "-4.0", "isolated unit token"),
    (f"n = 1 AND list_contains({_list(candidates.PACKAGING_WORDS)}, low[1])", "-2.5", "isolated packaging token"),
    ("n <= 2 AND upper(frag) = frag AND lower(frag) <> frag AND length(frag) <= 10", "-2.0", "very short all-caps fragment"),
    (r"len(regexp_extract_all(frag, '\d+')) > 0 AND len(regexp_extract_all(frag, '\d+')) >= n", "-2.0", "mostly numeric"),
    (r"regexp_full_match(frag, '[A-Z]{1,3}\d{2,5}')", "-4.0", "supplier-code shaped"),
    ("n <= 2 AND NOT regexp_matches(frag, '(?:^|[^A-Za-z])[A-Z]{6,}(?:[^A-Za-z]|$)')", "-1.0", "only one or two generic-looking tokens"),
    (r"regexp_matches(frag, '\d+\s*[xX]\s*\d+')", "-3.0", "dimension-like fragment"),
    (r"length(regexp_replace(frag, '[\w\s]', '', 'g')) > greatest(2, length(frag) // 3)", "-1.0", "punctuation-heavy fragment"),
)
_POINTS = " + ".join(f"CASE WHEN {c} THEN ({p})::DOUBLE ELSE 0 END" for c, p, _ in _SIGNALS)
_ALONE = " + ".join(f"CASE WHEN {c} THEN ({p})::DOUBLE ELSE 0 END" for c, p, r in _SIGNALS if r != candidates.AFTER_PREFIX)
_TOLD = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in _SIGNALS)
CANDIDATES_SQL = rf"""src AS (SELECT p_partkey, {_MARKS} AS text FROM (SELECT *, ({_list(TEXTS)})[p_partkey % {len(TEXTS)} + 1] AS text FROM part)),
norm AS (SELECT p_partkey, trim(text) AS source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '[^\w\s\-./()\[\]{{}}]+', ' ', 'g'), '\s+', ' ', 'g'), '\s*([.,;:])\s*', '\1 ', 'g'), '\s*([()])\s*', '\1', 'g') AS d FROM src),
coded AS (SELECT *, coalesce({", ".join(f"nullif(regexp_extract(d, '{form}', 1), '')" for form in names.SUPPLIER_CODES)}) AS code FROM norm),
rested AS (SELECT *, CASE WHEN code IS NULL THEN d ELSE regexp_replace(d, code, '') END AS rest FROM coded),
packs AS (SELECT *, CASE WHEN code IS NULL THEN rest ELSE regexp_replace(rest, code, '') END AS again, regexp_matches(rest, '{_MANY}') AS many,
  nullif(regexp_extract(rest, '{_ONE}', 1), '') AS one, list_contains({_list(names.PACK_UNITS)}, lower(regexp_extract(rest, '{_ONE}', 2))) AS sized FROM rested),
packed AS (SELECT *, (CASE WHEN many THEN regexp_extract(rest, '{_MANY}', 1) WHEN sized THEN CASE WHEN one::DOUBLE <> 0 THEN '1' END ELSE one END)::DOUBLE AS pack_count,
  (CASE WHEN many THEN regexp_extract(rest, '{_MANY}', 2) WHEN sized THEN one END)::DOUBLE AS pack_size,
  CASE WHEN many THEN regexp_extract(rest, '{_MANY}', 3) WHEN sized THEN regexp_extract(rest, '{_ONE}', 2) ELSE nullif(regexp_extract(rest, '(?i){_P}\s*\w+.*?\b({_UNITS})\b', 1), '') END AS raw FROM packs),
united AS (SELECT * REPLACE (CASE WHEN lower(raw) IN ('each', 'unit', 'units') THEN 'ea' WHEN lower(raw) IN ('boxes', 'bunches') THEN regexp_replace(lower(raw), 'es$', '')
  WHEN list_contains({_list(u + "s" for u in names.PLURAL_UNITS)}, lower(raw)) THEN regexp_replace(lower(raw), 's$', '') WHEN list_contains({_list(names.PACK_UNITS)}, lower(raw)) THEN lower(raw) ELSE raw END AS raw) FROM packed),
bared AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(again, '\b{_P}\s*[xX]\s*{_P}(?:\s*[xX]\s*{_P})?\b', ' ', 'g'), '(?i)\b{_P}\s*(?:kg|g|l|ml|lb|mc|mic)\b', ' ', 'g'),
  '(?i)\(\s*\d+\s*''?\s*s\s*\)', ' ', 'g'), '(?i)\b\d+\s*''?\s*s\b', ' ', 'g'), '\b{_P}\b', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM united),
parts AS (SELECT p_partkey, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(bare, '\s+-\s+|\s+-|-\s+|[()\[\],;]', '~', 'g'), '([A-Za-z])-([A-Za-z])', '\1~\2', 'g'), '([A-Za-z])-([A-Za-z])', '\1~\2', 'g'), '~'),
  lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[ .:]+|[ .:]+$', '', 'g')), lambda x: x <> '') AS frags FROM bared),
frags AS (SELECT p_partkey, unnest(frags) AS frag, generate_subscripts(frags, 1) AS i, frags FROM parts),
worded AS (SELECT *, regexp_extract_all(frag, '[A-Za-z]+') AS w, list_transform(regexp_extract_all(frag, '[A-Za-z]+'), lambda x: lower(x)) AS low, len(regexp_extract_all(frag, '[A-Za-z]+')) AS n, CASE WHEN i > 1 THEN frags[i - 1] END AS prev, regexp_extract_all(CASE WHEN i > 1 THEN frags[i - 1] END, '[A-Za-z]+') AS pw FROM frags),
points AS (SELECT p_partkey, i, frag, round(greatest(0, {_POINTS}), 3) AS score, greatest(0, {_ALONE}) AS alone, list_filter([{_TOLD}], lambda r: r IS NOT NULL) AS told FROM worded),
top AS (SELECT p_partkey, told, regexp_replace(regexp_replace(frag, '(?i)\b(?:{"|".join(candidates.ENDING_UNITS)})\b$', ''), '\b[xX]\b', '', 'g') AS kept FROM points WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, length(frag) DESC, i) = 1),
tidied AS (SELECT p_partkey, told, regexp_replace(trim(regexp_replace(CASE WHEN len(regexp_extract_all(kept, '[A-Za-z/]+')) >= 3 THEN regexp_replace(kept, '(?i)^\s*(?:{"|".join(candidates.LEADING_PACKAGES)})(?:[^A-Za-z/]|$)', ' ') ELSE kept END, '\s+', ' ', 'g')), '^[ .:-]+|[ .:-]+$', '', 'g') AS name FROM top),
chosen AS (SELECT b.*, coalesce(t.name, '') AS name, t.told FROM bared b LEFT JOIN tidied t USING (p_partkey)),
listed AS (SELECT p_partkey, count(*) AS n, string_agg(frag, ' | ' ORDER BY i) AS phrases, sum(score) AS points, bool_or(frag <> name AND alone >= 3.0) AS another FROM points JOIN chosen USING (p_partkey) GROUP BY p_partkey),
judged AS (SELECT c.*, coalesce(l.phrases, '') AS phrases, coalesce(l.points, 0) AS points, coalesce(another AND n >= 3, false) AS merged, len(regexp_extract_all(d, '{_P}')) > 2 AS numeric FROM chosen c LEFT JOIN listed l USING (p_partkey)),
candidate AS (SELECT *, (CASE WHEN length(d) > 10 THEN 0.2 ELSE 0 END + CASE WHEN length(name) > 2 THEN 0.3 ELSE 0 END + CASE WHEN code IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN raw IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN pack_count IS NOT NULL AND pack_size IS NOT NULL THEN 0.2 ELSE 0 END)::DOUBLE
  * CASE WHEN name = '' THEN 0.7 ELSE 1 END * CASE WHEN raw IS NULL THEN 0.8 ELSE 1 END * CASE WHEN numeric THEN 0.7 ELSE 1 END AS sure,
  list_filter([CASE WHEN numeric THEN '{NUMERIC}' END, CASE WHEN merged THEN '{MERGED}' END], lambda x: x IS NOT NULL) AS conflicts FROM judged)"""


@register(
    "ingredient_candidate",
    "X19 F33 F34 F35 F36 F71",
    f"""WITH {CANDIDATES_SQL} SELECT p_partkey, d AS description, name, code, pack_count, pack_size, raw AS pack_unit,
    CASE WHEN pack_count IS NOT NULL AND pack_size IS NOT NULL AND raw IS NOT NULL THEN CASE WHEN pack_count * pack_size = floor(pack_count * pack_size) THEN (pack_count * pack_size)::BIGINT::VARCHAR || '.0' ELSE (pack_count * pack_size)::VARCHAR END || ' ' || raw END AS pack_total,
    floor(sure * 1000 + 0.5) / 1000 AS confidence, phrases, floor(points * 1000 + 0.5) / 1000 AS points,
    CASE WHEN told IS NULL THEN '{candidates.NO_PHRASE}' ELSE '{candidates.CHOSEN}' || CASE WHEN len(told) > 0 THEN ': ' || array_to_string(told, ', ') ELSE '' END END AS selection_reason,
    array_to_string(list_filter([CASE WHEN name <> '' THEN 'Product-like description detected' END, CASE WHEN code IS NOT NULL THEN 'Supplier code detected' END, CASE WHEN pack_count IS NOT NULL AND pack_size IS NOT NULL THEN 'Pack pattern detected' END], lambda x: x IS NOT NULL), ', ') AS reasons,
    array_to_string(conflicts, ', ') AS conflicts FROM candidate""",
)
def ingredient_candidate(spark, sf_dir):
    """The ingredient that each part's description names, with every phrase's score, in one projection."""
    found = candidates.candidates(described(table(spark, sf_dir, "part")), "text")
    c, thousandths = F.col("candidate"), lambda x: F.floor(x * 1000 + 0.5) / 1000
    return found.select(
        "p_partkey",
        *(c[name].alias(name) for name in ("description", "name", "code", "pack_count", "pack_size", "pack_unit", "pack_total", "selection_reason")),
        thousandths(c["confidence"]).alias("confidence"),
        F.array_join(c["phrases"]["fragment"], " | ").alias("phrases"),
        thousandths(F.aggregate(c["phrases"], F.lit(0.0), lambda a, p: a + p["score"])).alias("points"),
        F.array_join(c["reasons"], ", ").alias("reasons"),
        F.array_join(c["conflicts"], ", ").alias("conflicts"),
    )


def _key_sql(x: str, name: str, source: str) -> str:
    """CTEs up to ``name``: the rows of ``source`` with the key of their text ``x``, as column ``key`` and words ``tokens``."""
    sizes = rf"{_P}\s*(?:kg|g|gr|l|lt|ml|mc|mic|lb|lbs)\b"
    dims = rf"{_P}\s*x\s*{_P}(?:\s*x\s*{_P})?"
    once = lambda c: f"list_filter({c}, lambda t, i: list_position({c}, t) = i)"
    single = "CASE WHEN regexp_matches(t, '^[0-9]*$') THEN '' " + _case((f"t = '{k}'", f"'{v}'") for k, v in keys.SINGULAR.items())
    single += f""" WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 3 AND t LIKE '%oes' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%es' AND list_contains({_list(keys.NOUNS)}, t[:-3]) THEN t[:-3]
      WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' AND list_contains({_list((*keys.NOUNS, *keys.STYLES))}, t[:-2]) THEN t[:-2] ELSE t END"""
    return rf"""{name}_w AS (SELECT *, list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower({x}), '{dims}', ' ', 'g'), '{sizes}', ' ', 'g'), '[^a-z0-9\s/]+', ' ', 'g'), '\s+'), lambda t: t <> '') AS words FROM {source}),
{name}_t AS (SELECT *, list_concat(list_filter(list_transform(words, lambda t: {single}), lambda t: t <> '' AND NOT list_contains({_list(keys.UNITS)}, t) AND NOT (list_contains({_list(keys.PACKAGES)}, t) AND len(words) > 1)),
  CASE WHEN regexp_matches(lower({x}), '(?:^|[^a-z])(?:{"|".join(keys.PACKAGING)})(?:[^a-z]|$)') THEN list_concat(list_transform(regexp_extract_all(lower({x}), '\b{dims}\b'), lambda t: 'dim_' || regexp_replace(t, '\s+', '', 'g')),
    list_transform(regexp_extract_all(lower({x}), '\(\s*\d+\s*''?s\s*\)|\b\d+\s*''?s\b'), lambda t: 'count_' || regexp_replace(t, '\D', '', 'g'))) ELSE [] END) AS found FROM {name}_w),
{name}_o AS (SELECT * EXCLUDE (found), CASE WHEN list_contains(found, 'pepper') THEN list_concat(list_filter(found, lambda t: list_contains({_list(keys.COLOURS)}, t)), ['pepper'], found) ELSE found END AS ordered FROM {name}_t),
{name} AS (SELECT * EXCLUDE (words, ordered), {once("ordered")} AS tokens, array_to_string({once("ordered")}, ' ') AS key FROM {name}_o)"""


_PLAIN = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_PACKAGED = f"regexp_matches(lower(name), '(?:^|[^a-z])(?:{'|'.join(keys.PACKAGING)})(?:[^a-z]|$)')"
_SQL = rf"""WITH {CANDIDATES_SQL}, texts AS (SELECT *, CASE WHEN {_PACKAGED} THEN name || ' ' || source ELSE name END AS x FROM candidate),
{_key_sql("x", "keyed", "texts")},
named AS (SELECT *, len(regexp_extract_all(name, '[A-Za-z]')) AS letters, len(regexp_extract_all(name, '[^A-Za-z0-9\s]')) AS others, regexp_extract_all(name, '[A-Za-z]+') AS nw FROM keyed),
flagged AS (SELECT *, (letters = 0 OR others > greatest(2, letters // 3)) AS noisy, (len(nw) = 0 OR (len(nw) = 1 AND length(nw[1]) <= 2)) AS weak FROM named),
summed AS (SELECT *, 65 + CASE WHEN len(list_intersect(tokens, {_list(keys.NOUNS)})) > 0 THEN 15 ELSE 0 END + CASE WHEN len(tokens) > 1 THEN 5 ELSE 0 END AS points2,
  CASE WHEN merged OR numeric OR noisy THEN '{AMBIGUOUS}' WHEN weak THEN '{WEAK}' END AS cap_reason,
  list_filter([CASE WHEN merged THEN '{FOR_MERGED}' END, CASE WHEN numeric THEN '{FOR_NUMBERS}' END, CASE WHEN weak THEN '{FOR_WEAK}' END, CASE WHEN noisy THEN '{FOR_NOISE}' END], lambda x: x IS NOT NULL) AS own FROM flagged),
analysis AS (SELECT *, CASE WHEN cap_reason IS NULL THEN points2 ELSE least(points2, {CAP}) END AS sureness, CASE WHEN cap_reason IS NULL THEN own ELSE list_concat(own, conflicts) END AS told2 FROM summed),
groups AS (SELECT p_name AS x, min(p_partkey) AS id, list(DISTINCT lower(p_type) || ' ' || p_name) AS aliases, list(DISTINCT 'QX10' || p_size::VARCHAR) AS codes FROM part GROUP BY p_name),
{_key_sql("x", "memory", "groups")}, stati AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'proposed' ELSE 'approved' END AS status FROM memory),
aliased AS (SELECT id, status, unnest(aliases) AS a FROM stati), {_key_sql("a", "akeys", "aliased")}, coded2 AS (SELECT id, status, unnest(codes) AS c FROM stati),
meets AS (SELECT p_partkey, 0 AS rank, m.id, m.status FROM analysis a JOIN stati m ON m.key = a.key AND a.key <> '' UNION ALL SELECT p_partkey, 1, m.id, m.status FROM analysis a JOIN akeys m ON m.key = a.key AND a.key <> ''
  UNION ALL SELECT p_partkey, 1, m.id, m.status FROM analysis a JOIN coded2 m ON m.c = a.code AND a.key <> ''),
met AS (SELECT * FROM meets QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rank, id) = 1),
wanted AS (SELECT DISTINCT key, string_split({_PLAIN("key")}, ' ') AS kw FROM analysis WHERE key <> ''), known AS (SELECT key, min(id) AS id, string_split({_PLAIN("key")}, ' ') AS mw FROM memory GROUP BY key),
shares AS (SELECT w.key, k.id, len(list_intersect(kw, mw))::DOUBLE / greatest(len(list_distinct(kw)), len(list_distinct(mw))) AS share, w.key = k.key AS exact FROM wanted w, known k),
targets AS (SELECT key, id AS target, CASE WHEN exact THEN 'exact' ELSE 'likely' END AS kind FROM shares WHERE exact OR share >= 0.5 QUALIFY row_number() OVER (PARTITION BY key ORDER BY exact DESC, share DESC, id) = 1),
gated AS (SELECT a.*, m.id AS record, t.target, t.kind, coalesce(m.status = 'approved' AND (m.rank > 0 OR sureness >= {SURE} OR len(told2) = 0), false) AS safe, lower(concat_ws(' ', name, source, array_to_string(conflicts, ' '), array_to_string(told2, ' '))) AS whole,
  string_split({_PLAIN("a.key")}, ' ') AS kparts FROM analysis a LEFT JOIN met m USING (p_partkey) LEFT JOIN targets t ON t.key = a.key),
typed AS (SELECT *, CASE WHEN key = '' OR safe THEN NULL WHEN contains(whole, 'merged') OR len(list_intersect(string_split({_PLAIN("whole")}, ' '), {_list(PRODUCTS)})) >= 2 THEN 'possible_merge'
  WHEN regexp_matches(lower(array_to_string(told2, ' ')), 'ocr|numeric ambiguity') THEN 'insufficient_evidence' WHEN sureness < {DOUBTLESS} THEN CASE WHEN target IS NOT NULL THEN 'possible_merge' ELSE 'insufficient_evidence' END
  WHEN target IS NOT NULL THEN CASE WHEN code IS NOT NULL OR source <> '' THEN 'attach_supplier_variant' ELSE 'attach_alias' END
  WHEN len(kparts) < 2 OR len(list_filter(kparts, lambda t: NOT regexp_matches(t, '^[0-9]+$'))) = 0 OR len(list_filter(kparts, lambda t: NOT list_contains({_list(GENERIC)}, t))) = 0 THEN 'insufficient_evidence' ELSE 'create_new' END AS type FROM gated)
SELECT p_partkey, nullif(key, '') AS key, CASE WHEN key <> '' THEN sureness / 100.0::DOUBLE END AS confidence, CASE WHEN key <> '' THEN cap_reason END AS cap_reason, CASE WHEN key <> '' THEN array_to_string(told2, ', ') END AS conflicts,
  CASE WHEN key = '' THEN 'none' WHEN safe THEN 'matched' WHEN p_partkey = min(p_partkey) OVER w THEN 'proposed' ELSE 'duplicate' END AS state, CASE WHEN safe THEN record END AS record, type,
  CASE WHEN type IS NOT NULL THEN target END AS target, CASE WHEN type IS NOT NULL THEN kind END AS kind, CASE WHEN type IS NOT NULL THEN min(p_partkey) OVER w END AS of
FROM typed WINDOW w AS (PARTITION BY {_PLAIN("coalesce(code, '')")}, {_PLAIN("source")}, {_PLAIN("name")}, {_PLAIN("key")}, type, target)"""


@register("ingredient_match", "M1 M2 M4 M5 M13 F72", _SQL)
def ingredient_match(spark, sf_dir):
    """Parts' descriptions against a memory of their names: safe matches, and proposals for the rest."""
    part = table(spark, sf_dir, "part")
    memory = part.groupBy("p_name").agg(
        F.min("p_partkey").alias("id"),
        F.collect_set(F.concat_ws(" ", F.lower("p_type"), "p_name")).alias("aliases"),
        F.collect_set(F.struct(F.concat(F.lit("QX10"), "p_size").alias("code"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("name"))).alias("variants"),
    )
    status = F.when(F.col("id") % 3 == 0, "proposed").otherwise("approved").alias("status")
    memory = memory.select("id", keys.match_key(F.col("p_name")).alias("normalized_key"), status, "aliases", "variants")
    rows = stored(analysed(candidates.candidates(described(part), "text")), "analysed")
    a = F.col("analysis")
    told = rows.select("p_partkey", a["key"].alias("key"), a["confidence"].alias("confidence"), a["cap_reason"].alias("cap_reason"), F.array_join(a["conflicts"], ", ").alias("conflicts"))
    return told.join(matched(rows, memory, "p_partkey"), "p_partkey")
