"""Operator 3: quality rules with thresholds from mergeable quantile sketches per language and source.

No cutoff is fixed: every fence follows from quantiles of the documents' own group, language and of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import stored, words

#: Fewest words, and the largest share (in %) of words in repeated 5-word windows.
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
#: Buckets of the sketch keep this many leading bits: a relative error of at most 1/128.
SKETCH_BITS = 8
#: Metrics, all in thousandths, over the counts.
METRICS = {
    "symbol_rate": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length": "word_chars * 1000 div greatest(n_words, 1)",
}
#: Fences: metric, quantile (in %), and how many times its distance to the median the fence lies beyond it; below the
#: median for a quantile under 50. A distance is one bucket of the sketch at least.
FENCES = {
    "max_symbol_rate": ("symbol_rate", 90, 3),
    "max_dup_line_rate": ("dup_line_rate", 99, 1),
    "max_repeat_rate": ("repeat_rate", 99, 1),
    "max_word_length": ("word_length", 90, 3),
    "min_word_length": ("word_length", 10, 3),
}
#: A group's fence counts with its number of documents, the fence of what it belongs to with this many.
EVIDENCE = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = F.size(ws)
    hashes = F.when(
        n > WINDOW,
        F.transform(
            F.slice(ws, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def repeated(placed: Column, p: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(placed, F.greatest(k - 1, F.lit(0)))["h"] == p["h"])
        return F.coalesce(before | (F.get(placed, k + 1)["h"] == p["h"]), F.lit(False))

    def span(pairs: Column) -> Column:
        return F.aggregate(
            F.array_sort(F.transform(pairs, lambda p: p["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")),
            lambda acc: acc["n"],
        )

    def covered(hs: Column) -> Column:
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # an array of one, so that the sorted windows are computed once and bound to a name
        return F.get(F.transform(F.array(placed), lambda b: span(F.filter(b, lambda p, k: repeated(b, p, k)))), F.lit(0))

    return F.get(
        F.transform(
            F.array(hashes),
            lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)),
        ),
        F.lit(0),
    )


def counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and the counts of each whole text; a null text has none of anything.

    n_lines counts lines that hold a word. Java's hash of five words stands for a window.
    """
    split = docs.select(*carry, F.col("text").alias("_text"), words(F.col("text")).alias("_words"))
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ws = F.col("_words")
    return split.select(
        *carry,
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("_text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(ws).cast("long").alias("n_repeat_words"),
    )


def _bucket(value: str) -> str:
    """Lower end of the log-linear bucket of a non-negative integer: its leading bits, the rest cleared."""
    shift = f"greatest(length(bin({value})) - {SKETCH_BITS}, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketch(counted: DataFrame) -> DataFrame:
    """Quantile sketch of every metric per (lang, source): bucket -> number of documents.

    Sketches of parts of the data merge by adding the counts; they hold some two thousand buckets at most.
    """
    stack = ", ".join(f"'{name}', cast({expr} as bigint)" for name, expr in METRICS.items())
    return (
        counted.filter("not base_failed")
        .selectExpr("lang", "source", f"stack({len(METRICS)}, {stack}) as (metric, value)")
        .withColumn("bucket", F.expr(_bucket("value")))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _fences(sketched: DataFrame, group: list[str], prefix: str) -> DataFrame:
    """``group``, ``prefix``_n (documents) and the group's own fences, read off its sketch."""
    by = ", ".join([*group, "metric"])
    running = (
        sketched.groupBy(*group, "metric", "bucket")
        .agg(F.sum("n").alias("n"))
        .selectExpr("*", f"sum(n) over (partition by {by} order by bucket) as below", f"sum(n) over (partition by {by}) as total")
    )
    levels = sorted({50, *(level for _, level, _ in FENCES.values())})
    quantiles = running.groupBy(*group, "metric").agg(
        F.max("total").alias("total"),
        *(F.min(F.expr(f"case when 100 * below >= {q} * total then bucket end")).alias(f"q{q}") for q in levels),
    )

    def fence(metric: str, q: int, times: int) -> str:
        step = f"greatest(abs(q{q} - q50), q{q} div {1 << (SKETCH_BITS - 1)}, 1)"
        return f"case when metric = '{metric}' then greatest(q{q} {'+' if q > 50 else '-'} {times} * {step}, 0) end"

    return quantiles.groupBy(*group).agg(
        F.max("total").alias(f"{prefix}_n"),
        *(F.max(F.expr(fence(*rule))).alias(f"{prefix}_{name}") for name, rule in FENCES.items()),
    )


def thresholds(sketched: DataFrame) -> DataFrame:
    """One row per (lang, source): every fence.

    The sketches of a language's sources merge into the language's, and these into one of all documents. A group's
    fence is drawn towards its language's, and that towards the fence of all, the more so the fewer documents it has.
    """
    own = _fences(sketched, ["lang", "source"], "own")
    whole = _fences(sketched, ["lang"], "lang").withColumnRenamed("lang", "_lang")
    every = _fences(sketched, [], "all")
    joined = own.join(whole, F.expr("lang <=> _lang")).join(every)

    def drawn(name: str) -> str:
        of_lang = f"((lang_n * lang_{name} + {EVIDENCE} * all_{name}) div (lang_n + {EVIDENCE}))"
        return f"(own_n * own_{name} + {EVIDENCE} * {of_lang}) div (own_n + {EVIDENCE}) as {name}"

    return joined.selectExpr("lang", "source", *map(drawn, FENCES))


def judge(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Quality verdict of every document: ``carry``, the counts, base_failed and kept.

    docs needs text, lang and source; null languages and sources form groups of their own. A document
    fails the base rules with fewer than 10 words or over 20 % of its words in repeated windows; of the
    others, those stay whose metrics all lie within the fences of their language and source. An empty table
    gives no rows. Counts come from one pass over the texts, written to the shared folder.
    Columns of docs that are not in ``carry`` are dropped; repeated rows are judged alike.
    """
    base = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words")
    counted = stored(counts(docs, list(dict.fromkeys([*carry, "lang", "source"]))).withColumn("base_failed", base), "quality")
    fences = thresholds(stored(sketch(counted), "quality-sketch"))
    fences = stored(fences.withColumnsRenamed({"lang": "_lang", "source": "_source"}), "quality-fences")
    within = " and ".join(
        f"cast({METRICS[metric]} as bigint) {'<=' if q > 50 else '>='} {name}" for name, (metric, q, _) in FENCES.items()
    )
    joined = counted.join(fences, F.expr("lang <=> _lang and source <=> _source"), "left")
    return joined.select(
        *carry, *COUNTS, "base_failed", F.expr(f"not base_failed and coalesce({within}, true)").alias("kept")
    )
