"""Operator 12: toxic passages as maximal-scoring segments of token log-odds.

Labelled documents give each word, and each beginning of a word, log-odds between toxic and other documents; a beginning
is the Dirichlet prior of the beginnings that are longer by one character, so an unseen form of a known word inherits its
stem's odds. A text is a sequence of such scores less a drift, which is negative on average; one linear scan finds all
its maximal-scoring segments. The extreme-value law of such maxima (Karlin and Altschul), with parameters estimated on
documents that are not toxic, says how surprising the best one, two, three ... segments of a text of its length are;
a logistic curve turns that surprise into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docledger.llm.common import batches_of, discard, doc_crc, stored, term_codes

#: The classifier is fitted on about so many labelled documents of each class, chosen by a hash of their id, whole texts.
FIT_DOCS = 5000
#: Longest beginning that is told apart, in characters, besides the whole word; documents that a prior is worth.
LONGEST, PRIOR = 12, 1.0
#: What each token's log-odds lose, and standard errors by which they are drawn to zero.
DRIFT, DOUBT = 1.0, 1.0
#: A segment is a passage where segments as good are expected at most so often in a clean text of that length.
SIGNIFICANT = 0.05
FOLDS = 5
END = "\n"


def beginnings(words: pa.Array) -> Iterator[pa.Array]:
    """For n of 1 to LONGEST the words' first n characters, null where a word is shorter; then the words and an end mark."""
    length = pc.utf8_length(words)
    for n in range(1, LONGEST + 1):
        yield pc.if_else(pc.greater_equal(length, n), pc.utf8_slice_codeunits(words, 0, n), pa.scalar(None, words.type))
    yield pc.binary_join_element_wise(words, pa.scalar(END, words.type), pa.scalar("", words.type))


def _spoken(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return term_codes(pc.utf8_lower(texts))


def count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings of a batch's words and the numbers of toxic and of other documents that hold them."""
    for batch in batches:
        for b in batches_of(batch, "text"):
            codes, per_text, words = _spoken(b.column("text"))
            row = np.repeat(np.arange(b.num_rows), per_text)
            pairs = np.unique(row.astype(np.int64) * max(len(words), 1) + codes)
            row, codes = pairs // max(len(words), 1), pairs % max(len(words), 1)
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for found in beginnings(words):
                coded = pc.dictionary_encode(found)
                at = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)[codes]
                held = np.unique(row[at >= 0] * max(len(coded.dictionary), 1) + at[at >= 0])
                own = toxic[held // max(len(coded.dictionary), 1)]
                n = np.bincount(2 * (held % max(len(coded.dictionary), 1)) + own, minlength=2 * len(coded.dictionary)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.cast(pa.string()), pa.array(n[:, 1]), pa.array(n[:, 0])], names=["part", "toxic", "other"]
                )


@dataclass
class Model:
    """Scores of beginnings by their length in characters (whole words last), law of the maxima, logistic curve."""

    parts: list[pa.Array] = field(default_factory=list)
    scores: list[np.ndarray] = field(default_factory=list)
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """Each word's score: that of its longest known beginning, less the drift."""
        found = np.zeros(len(words))
        for at, part in enumerate(beginnings(words.cast(pa.string()))):
            known = pc.index_in(part, value_set=self.parts[at], skip_nulls=True)
            some = np.nonzero(pc.is_valid(known).to_numpy(zero_copy_only=False))[0]
            found[some] = self.scores[at][pc.take(known, pa.array(some)).to_numpy(zero_copy_only=False).astype(np.int64)]
        return found - DRIFT

    def surprise(self, scores: list[float], n: int) -> float:
        """-ln of the probability that the best segments of a clean text of n tokens are at least so good."""
        if not scores:
            return 0.0
        normal = [self.lam * s - math.log(self.k * n) for s in sorted(scores, reverse=True)]
        e = math.exp(-normal[0]) if normal[0] > -700 else math.inf
        best, total = -math.log(-math.expm1(-e)) if e > 1e-12 else normal[0], normal[0]
        for r, x in enumerate(normal[1:], 2):
            total += x
            if x <= 0:
                break
            tail = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
            best = max(best, tail)
        return best

    def probability(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(surprise), -30, 30)))


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Beginnings' log-odds against the share of toxic documents.

    The prior of a beginning is what the next shorter one says without it (documents that hold the shorter one alone),
    itself drawn to its own prior, so no document counts twice.
    """
    share = (toxic + 0.5) / (toxic + other + 1)
    base, priors, found = math.log(share / (1 - share)), {"": share}, {}
    for part in sorted(counts, key=lambda p: (len(p), p.endswith(END), p)):
        t, c = counts[part]
        shorter = part[:-1][:LONGEST]
        more_t, more_c = counts.get(shorter, (0, 0))
        rest_t, rest_c = max(more_t - t, 0), max(more_c - c, 0)
        priors[part] = prior = (rest_t + PRIOR * priors.get(shorter, share)) / (rest_t + rest_c + PRIOR)
        odds = math.log((t + PRIOR * prior) / (c + PRIOR * (1 - prior))) - base
        sure = abs(odds) - DOUBT * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        found[part] = math.copysign(max(sure, 0.0), odds)
    return found


def segments(scores: np.ndarray, per_text: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """All maximal-scoring segments (first token, end, score) of each text, in one pass.

    Runs of tokens above zero are taken together first; the scan over them is linear, as a search for an earlier segment
    skips what earlier searches passed by.
    """
    found: list[list[tuple[int, int, float]]] = [[] for _ in per_text]
    above = scores > 0
    if not above.any():
        return found
    text = np.repeat(np.arange(len(per_text)), per_text)
    starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    edge = above.copy()
    edge[1:] &= ~above[:-1] | (text[1:] != text[:-1])
    first = np.nonzero(edge)[0]
    last = above.copy()
    last[:-1] &= ~above[1:] | (text[1:] != text[:-1])
    end = np.nonzero(last)[0] + 1
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    own, now = [], -1
    for t, a, z, left, right in zip(text[first].tolist(), first.tolist(), end.tolist(), sums[first].tolist(), sums[end].tolist(), strict=True):
        if t != now:
            if own:
                found[now] = [(a0 - at, z0 - at, r0 - l0) for a0, z0, l0, r0, _ in own]
            own, now, at = [], t, int(starts[t])
        while True:
            j = len(own) - 1
            while j >= 0 and own[j][2] >= left:
                j = own[j][4]
            if j < 0 or own[j][3] >= right:
                own.append((a, z, left, right, j))
                break
            a, left = own[j][0], own[j][2]
            del own[j:]
    found[now] = [(a0 - at, z0 - at, r0 - l0) for a0, z0, l0, r0, _ in own]
    return found


def _law(scores: np.ndarray, times: np.ndarray) -> float:
    """The lambda with mean exp(lambda * score) = 1; the mean score is below zero, some score above."""
    low, high = 0.0, 1.0
    mean = lambda x: float(np.average(np.exp(np.minimum(x * scores, 700)), weights=times))
    while mean(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic regression by Newton steps, with a weak pull to a slope of one."""
    a, b = -1.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum() - 0.01 * a, (w * (y - p) * x).sum() - 0.01 * (b - 1)])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, max(b, 1e-6)


def _share(total: int, wanted: int) -> float:
    return min(1.0, wanted / max(total, 1))


def chosen(labels: DataFrame, folds: int, limit: int) -> DataFrame:
    """doc_id, toxic (0 or 1), fold and weight of about ``limit`` labelled documents a class, none of fold 0.

    A document is toxic if any of its labels says so; null ids and null labels are left out.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("fold", (doc_crc(F.col("doc_id")) % folds).cast("int")).filter("fold <> 0")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, _share(total.get(1, 0), limit)).otherwise(_share(total.get(0, 0), limit))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    return known.withColumn("weight", 1 / share).filter(draw < share)


def _observe(model: Model):
    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_of(batch, "text"):
                codes, per_text, words = _spoken(b.column("text"))
                scores = np.round(model.word_scores(words)[codes], 2)
                best = [[s for _, _, s in found] for found in segments(scores, per_text)]
                seen = [np.unique(x, return_counts=True) for x in np.split(scores, np.cumsum(per_text)[:-1])] if len(per_text) else []
                yield pa.RecordBatch.from_arrays(
                    [b.column("toxic"), b.column("weight"), pa.array(per_text, pa.int64()), pa.array(best, pa.list_(pa.float64()))]
                    + [pa.array([v for v, _ in seen], pa.list_(pa.float64())), pa.array([n for _, n in seen], pa.list_(pa.int64()))],
                    names=["toxic", "weight", "n", "best", "values", "times"],
                )

    return observe


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, limit: int = FIT_DOCS) -> Model | None:
    """Log-odds from the chosen documents, but for those of fold 1, on which the law and the curve are estimated.

    Where fold 1 lacks a class, all chosen documents serve for both. None if one of the classes has no document.
    """
    pick = stored(chosen(labels, folds, limit), "toxic-labels")
    rows = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(pick, "doc_id"), "toxic-texts")
    sizes = {(r["toxic"], r["cal"]): r["n"] for r in rows.groupBy("toxic", (F.col("fold") == 1).alias("cal")).agg(F.count("*").alias("n")).collect()}
    model = None
    if all(any(sizes.get((y, cal)) for cal in (True, False)) for y in (0, 1)):
        apart = all(sizes.get((y, cal)) for y in (0, 1) for cal in (True, False))
        learn = rows.filter("fold <> 1") if apart else rows
        counted = learn.select("text", "toxic").mapInArrow(count_beginnings, "part string, toxic long, other long")
        summed = counted.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter("toxic + other > 1")
        table = summed.toArrow()
        counts = dict(zip(table["part"].to_pylist(), zip(table["toxic"].to_pylist(), table["other"].to_pylist(), strict=True), strict=True))
        n = [sum(sizes.get((y, cal), 0) for cal in ((False,) if apart else (True, False))) for y in (0, 1)]
        model = _with_scores(log_odds(counts, n[1], n[0]))
        seen = (rows.filter("fold = 1") if apart else rows).select("text", "toxic", "weight").mapInArrow(
            _observe(model), "toxic int, weight double, n long, best array<double>, values array<double>, times array<long>"
        )
        _calibrate(model, seen.collect())
    discard(pick, rows)
    return model


def _with_scores(odds: dict[str, float]) -> Model:
    """Beginnings that say the same as the next shorter kept one are left out."""
    kept: dict[str, float] = {}
    for part in sorted(odds, key=lambda p: (len(p), p.endswith(END), p)):
        up = part[:-1][:LONGEST]
        while up and up not in kept:
            up = up[:-1]
        if abs(odds[part] - kept.get(up, 0.0)) > 0.005:
            kept[part] = odds[part]
    by_length: list[dict[str, float]] = [{} for _ in range(LONGEST + 1)]
    for part, score in kept.items():
        by_length[LONGEST if part.endswith(END) else len(part) - 1][part] = score
    return Model([pa.array(list(x), pa.string()) for x in by_length], [np.fromiter(x.values(), float, len(x)) for x in by_length])


def _calibrate(model: Model, rows: list) -> None:
    clean = [r for r in rows if not r["toxic"]]
    values = np.array([v for r in clean for v in r["values"]] + [max((float(s.max()) for s in model.scores if len(s)), default=0.0) + 1.0])
    times = np.array([t for r in clean for t in r["times"]] + [1], dtype=float)
    if np.average(values, weights=times) >= 0:  # a table of a few words: the law needs a negative mean
        values, times = np.append(values, -1.0), np.append(times, 10 * times.sum() * max(1.0, float(values.max())))
    model.lam = _law(values, times)
    most = [(max(r["best"]), r["n"]) for r in clean if r["best"]]
    model.k = len(most) / sum(n * math.exp(-model.lam * s) for s, n in most) if most else 1 / max(sum(r["n"] for r in clean), 1)
    x = np.log1p([model.surprise(r["best"], max(r["n"], 1)) for r in rows])
    weight = np.array([r["weight"] for r in rows])
    model.curve = _curve(x, np.array([r["toxic"] for r in rows], dtype=float), weight * len(rows) / weight.sum())


def scan(docs: DataFrame, carry: list[str], model: Model | None, text: str = "text") -> DataFrame:
    """``carry``, then score, predicted, surprise and passages for every whole text.

    passages: the significant maximal segments, as first and end term, score, how many as good are expected in a clean
    text of that length, and their words. A null or empty text has surprise 0 and the score that goes with it; where no
    model could be learned (labels of one class, or none) every score is 0. Repeated rows are scored alike, very long
    texts whole, an empty table gives no rows; further columns are dropped. Columns of ``carry`` may have any name but
    those that are added and ``_text``.
    """
    passage = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64()), ("words", pa.string())])
    added = "score double, predicted int, surprise double, passages array<struct<first:int,end:int,score:double,expected:double,words:string>>"
    schema = StructType([*(docs.schema[c] for c in carry), *StructType.fromDDL(added)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_of(batch, "_text"):
                surprise, passages = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
                if model is not None:
                    codes, per_text, words = _spoken(b.column("_text"))
                    found = segments(np.round(model.word_scores(words)[codes], 2), per_text)
                    starts = np.cumsum(per_text) - per_text
                    for i, own in enumerate(found):
                        n = int(per_text[i])
                        surprise[i] = model.surprise([s for _, _, s in own], n)
                        for a, z, s in own:
                            expected = model.k * n * math.exp(-model.lam * s)
                            if expected <= SIGNIFICANT:
                                said = words.take(pa.array(codes[starts[i] + a : starts[i] + z])).to_pylist()
                                passages[i].append({"first": a, "end": z, "score": s, "expected": expected, "words": " ".join(said)})
                p = model.probability(surprise) if model is not None else surprise
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in carry), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(surprise)]
                    + [pa.array(passages, pa.list_(passage))],
                    names=[*carry, "score", "predicted", "surprise", "passages"],
                )

    return docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(score, schema)
