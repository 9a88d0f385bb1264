"""Operator 1: language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability under a language is
the sum over all its segmentations into pieces, found by the forward algorithm; a text's is the product over its words.
Expectation maximisation over all segmentations fits the probabilities to labelled text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docledger.llm.common import batches_of, doc_crc, stored, word_codes

#: Piece vocabulary; all its pieces count.
VOCABULARY = "piece_bpe_32k.model"
#: The classifier is fitted on about so many labelled documents of each language, chosen by a hash of their id, and on
#: their words of up to FIT_CHARS characters. Prediction takes words of any length.
FIT_DOCS, FIT_CHARS, ROUNDS, SMOOTHING = 4000, 64, 3, 0.1
#: Characters of a word that are looked up at a time, and places after which the forward table is scaled anew.
SPAN, RESCALE = 2048, 8
#: Probability of a word below which its expected pieces are found with stretched probabilities.
FAINT = 1e-200
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(codes.shape[0], dtype=np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k]
    return h


class Pieces:
    """Looks substrings up in the vocabulary by their 64-bit hash. Piece 0 is no piece, 1 any unknown character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [
            t
            for i in range(model.get_piece_size())
            if (t := model.id_to_piece(i)) and not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.longest = max(map(len, texts))
        hashes = np.array([_hash(_codes([t], len(t)))[0] for t in texts], dtype=np.uint64)
        order = np.argsort(hashes)
        self.size = len(texts) + 2
        self.keys = hashes[order]
        self.ids = (order + 2).astype(np.int32)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.keys >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(h.shape, dtype=np.int32)
        at = np.nonzero(self.seen[h >> np.uint64(44)])
        some = h[at]
        place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[at] = np.where(self.keys[place] == some, self.ids[place], 0)
        return out

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, the piece (or 0) that starts at each place of equally long words."""
        found, h = [], np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            h = h[:, :-1] * _BASE + codes[:, n - 1 :]
            found.append(self.find(h))
        found[0][found[0] == 0] = 1
        return found


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)


def _alike(words: list[str], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with their start mark, grouped by length: places in ``words``, and code points.

    A group has about ``cells`` characters, so that the forward table stays small; one word at least.
    """
    marked = ["▁" + w.replace("\0", "�") for w in words]  # numpy drops null characters at the end
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.nonzero(np.diff(lengths[order]))[0] + 1):
        if len(group):
            m = int(lengths[group[0]])
            for part in np.array_split(group, -(-len(group) // max(1, cells // m))):
                yield part, _codes([marked[i] for i in part], m)


def word_scores(words: list[str], table: Pieces, probs: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability under each language. probs: piece x language.

    The forward table keeps as many places as the longest piece has characters, scaled word by word and language by
    language, so that no word is too long for it.
    """
    out = np.zeros((len(words), probs.shape[1]))
    for owner, codes in _alike(words, max(2000, 800_000 // max(probs.shape[1], 1))):
        m, langs = codes.shape[1], probs.shape[1]
        alpha: dict[int, np.ndarray] = {0: np.ones((len(owner), langs))}
        scale = np.zeros((len(owner), langs))
        for first in range(0, m, SPAN):
            low = max(0, first - table.longest + 1)
            found = table.matches(codes[:, low : first + SPAN])
            for end in range(first + 1, min(first + SPAN, m) + 1):
                now = alpha[end - 1] * probs[found[0][:, end - 1 - low]]
                for n in range(2, min(len(found), end - low) + 1):
                    piece = found[n - 1][:, end - n - low]
                    some = np.nonzero(piece)[0]
                    if len(some):
                        now[some] += alpha[end - n][some] * probs[piece[some]]
                alpha[end] = now
                alpha.pop(end - table.longest, None)
                if end % RESCALE == 0:
                    scale += np.log(now)
                    for k in alpha:
                        if k != end:
                            alpha[k] = alpha[k] / now
                    alpha[end] = np.ones_like(now)
        out[owner] = np.log(alpha[m]) + scale
    return out


def expected_pieces(words: list[str], lang: np.ndarray, weight: np.ndarray, table: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by each language over all segmentations of its words (of FIT_CHARS at most)."""
    flat, langs = probs.ravel(), probs.shape[1]
    out = np.zeros(probs.size)
    for owner, codes in _alike(words, 200_000):
        found, of = table.matches(codes), lang[owner]
        m = codes.shape[1]
        cell = [f.astype(np.int64) * langs + of[:, None] for f in found]
        p = [flat[c] for c in cell]
        alpha = _forward(p, m)
        faint = np.nonzero(alpha[m] < FAINT)[0]
        if len(faint):  # too improbable for a double: stretched by the word's own probability, evenly over its characters
            logs = word_scores([words[i] for i in owner[faint]], table, probs)[np.arange(len(faint)), of[faint]]
            stretch = np.ones(len(owner))
            stretch[faint] = np.exp(-logs / m)
            p = [x * stretch[:, None] ** n for n, x in enumerate(p, 1)]
            alpha = _forward(p, m)
        beta = np.zeros((m + 1, codes.shape[0]))
        beta[m] = 1
        for start in range(m - 1, -1, -1):
            for n in range(1, min(len(p), m - start) + 1):
                beta[start] += p[n - 1][:, start] * beta[start + n]
        scale = weight[owner] / alpha[m]
        for n in range(1, len(p) + 1):
            for start in range(m - n + 1):
                uses = alpha[start] * p[n - 1][:, start] * beta[start + n] * scale
                out += np.bincount(cell[n - 1][:, start], weights=uses, minlength=len(out))
    if not np.isfinite(out).all():
        raise FloatingPointError("a word has no finite probability")
    return out.reshape(probs.shape)


def _forward(p: list[np.ndarray], m: int) -> np.ndarray:
    """Sums over all segmentations of the first 0, 1 ... m characters; p: probabilities by length and start."""
    alpha = np.zeros((m + 1, p[0].shape[0]))
    alpha[0] = 1
    for end in range(1, m + 1):
        for n in range(1, min(len(p), end) + 1):
            alpha[end] += alpha[end - n] * p[n - 1][:, end - n]
    return alpha


def fit(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages, and piece x language probabilities, from the docs' text and lang (both not null).

    docs: doc_id, text, lang. Only a bounded number of documents of each language is read, so the word table that
    the rounds go over is bounded too; the driver receives pieces times languages numbers a round.
    """
    labelled = docs.filter("text is not null and lang is not null and doc_id is not null")
    seen = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(seen)
    table_size = pieces(path).size
    if not langs:
        return [], np.zeros((table_size, 0))
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, FIT_DOCS / seen[k])))))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counted = stored(
        chosen.select("text", "lang")
        .mapInArrow(_count_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .filter(F.length("word") <= FIT_CHARS),
        "langid-words",
    )
    number = {k: i for i, k in enumerate(langs)}
    probs = np.full((table_size, len(langs)), 1.0 / table_size)
    for _ in range(ROUNDS):

        def count_pieces(batches: Iterator[pa.RecordBatch], probs: np.ndarray = probs) -> Iterator[pa.RecordBatch]:
            total = np.zeros(probs.shape)
            for b in batches:
                lang = np.array([number[x] for x in b.column("lang").to_pylist()], dtype=np.int64)
                weight = b.column("n").to_numpy(zero_copy_only=False).astype(float)
                total += expected_pieces(b.column("word").to_pylist(), lang, weight, pieces(path), probs)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])],
                names=["piece", "lang", "uses"],
            )

        uses = counted.mapInArrow(count_pieces, "piece int, lang int, uses double")
        summed = uses.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        got = np.full(probs.shape, SMOOTHING)
        got[summed["piece"], summed["lang"]] += summed["uses"]
        got[0] = 0
        probs = got / got.sum(axis=0)
    return langs, probs


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batches_of(batch, "text"):
            for lang in pc.unique(b.column("lang")).to_pylist():
                own = b.filter(pc.equal(b.column("lang"), lang))
                codes, _, words = word_codes(pc.utf8_lower(own.column("text")), lower=False)
                n = np.bincount(codes, minlength=len(words))
                some = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), words.take(pa.array(some)).cast(pa.string()), pa.array(n[some])],
                    names=["lang", "word", "n"],
                )


def predict(docs: DataFrame, carry: list[str], langs: list[str], probs: np.ndarray, path: str, text: str = "text") -> DataFrame:
    """``carry`` (columns of docs), lang_pred, score and margin for every whole text, which is in the column ``text``.

    lang_pred is the language under which the text is likeliest (the first by name on a tie), score its share of the
    likelihood summed over the languages; margin, in nats a word, says how much likelier it makes the text than the
    next language does, whatever the text's length (null with a single language). A text that is null or has no letter
    is ``und`` with score and margin 0; so is every text where no language was learned. Other columns of docs are
    dropped, repeated rows are scored alike, an empty table gives no rows.
    """
    schema = StructType([docs.schema[c] for c in carry]).add("lang_pred", "string").add("score", "double").add("margin", "double")
    names = np.array([*langs, UNDETERMINED], dtype=object)
    column = text if text in carry else "_text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_of(batch, column, 8 << 20):
                texts = b.column(column)
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best, share, margin = np.full(b.num_rows, len(langs)), np.zeros(b.num_rows), np.zeros(b.num_rows)
                if langs:
                    codes, per_text, words = word_codes(pc.utf8_lower(texts), lower=False)
                    logs = word_scores(words.to_pylist(), pieces(path), probs)
                    row = np.repeat(np.arange(b.num_rows), per_text)
                    total = np.stack([np.bincount(row, logs[codes, g], b.num_rows) for g in range(len(langs))], axis=1)
                    total -= total.max(axis=1, keepdims=True)
                    best = np.where(lettered, total.argmax(axis=1), len(langs))
                    share = np.where(lettered, 1 / np.exp(total).sum(axis=1), 0.0)
                    if len(langs) > 1:
                        margin = np.where(lettered, -np.sort(total, axis=1)[:, -2] / np.maximum(per_text, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in carry), pa.array(names[best], pa.string()), pa.array(share)]
                    + [pa.array(margin, mask=lettered & (len(langs) == 1))],
                    names=[*carry, "lang_pred", "score", "margin"],
                )

    more = [] if text in carry else [F.col(text).alias(column)]
    return docs.select(*carry, *more).mapInArrow(score, schema)


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(doc_crc(doc_id) % folds == 0, F.lit(False))


def identify(docs: DataFrame, carry: list[str], path: str | None = None, folds: int = 5) -> DataFrame:
    """Fits on the documents whose CRC-32 of the id is no multiple of ``folds``, then predicts all."""
    path = path or vocabulary_path()
    langs, probs = fit(docs.filter(~held_out(F.col("doc_id"), folds)).select("doc_id", "text", "lang"), path)
    return predict(docs, carry, langs, probs, path)
