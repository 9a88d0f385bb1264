"""Operator 10, first half: token ids of whole texts, each distinct word encoded once in a batch.

The byte-level pre-tokenizer never joins the end of a word to what follows it, so a text whose white space consists of
single spaces and line feeds between words can be cut before each of them. The tokenizers library encodes the distinct
cuts; all other texts it encodes whole.
"""

from __future__ import annotations

import os
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: White space or control characters other than a single space or line feed between two words; or a special token.
_IRREGULAR = (
    r"[\x00-\x09\x0b-\x1f\x7f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    r"|[ \n][ \n]|^[ \n]|[ \n]$|<\|"
)
_JOINED = 400  # words that are encoded as one text


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def in_worker(key: str, make):
    """What ``make`` gives, kept for later tasks of the same Python worker."""
    kept = sys.modules.setdefault("_docledger_worker", types.ModuleType("_docledger_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, put together in ``order``."""
    n = lengths[order]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[order] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.spaced = np.zeros(self.size, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.newline = np.zeros(self.size, dtype=bool)
        self.newline[vocabulary["Ċ"]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.int64) for x in found]

    def _words(self, words: list[str], mark: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, mark included, and how many each has: many are encoded as one text."""
        flat, lengths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(words), _JOINED * 16):
            part = words[k : k + _JOINED * 16]
            ids = np.concatenate(self.whole([mark + mark.join(part[j : j + _JOINED]) for j in range(0, len(part), _JOINED)]))
            at = np.nonzero(starts[ids])[0]
            if len(at) != len(part):
                raise ValueError("a word's ids do not begin with its mark")
            flat.append(ids)
            lengths.append(np.diff(np.append(at, len(ids))))
        return np.concatenate(flat), np.concatenate(lengths)

    def pieces(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts - pieces of text that begin at a pre-token and end before white space - and how many each has."""
        number: dict[str, int] = {}
        at, count = array("q"), array("q")
        for c in cuts:
            parts = (c,) if c[:1] == " " and c[1:].isalpha() else self.pattern.findall(c)
            count.append(len(parts))
            for p in parts:
                at.append(number.setdefault(p, len(number)))
        pre = list(number)
        spaced = [i for i, p in enumerate(pre) if p[:1] == " " and p[1:].isalpha()]
        bare = [i for i, p in enumerate(pre) if p.isalpha()]
        rest = sorted(set(range(len(pre))) - set(spaced) - set(bare))
        ids_a, n_a = self._words([pre[i][1:] for i in spaced], " ", self.spaced)
        ids_b, n_b = self._words([pre[i] for i in bare], "\n", self.newline)
        found = self.whole([pre[i] for i in rest])
        ids_c, n_c = np.concatenate([np.zeros(0, dtype=np.int64), *found]), np.array([len(x) for x in found], dtype=np.int64)
        own = np.array([*spaced, *bare, *rest], dtype=np.int64)
        lengths, starts = np.zeros(len(pre), dtype=np.int64), np.zeros(len(pre), dtype=np.int64)
        lengths[own] = np.concatenate((n_a, n_b - 1, n_c))
        starts[own] = np.cumsum(lengths[own]) - lengths[own]
        flat = np.concatenate((ids_a, ids_b[~self.newline[ids_b]], ids_c))
        at, count = np.frombuffer(at, dtype=np.int64), np.frombuffer(count, dtype=np.int64)
        return gathered(flat, starts, lengths, at), np.add.reduceat(lengths[at], np.cumsum(count) - count)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text; a null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        for i in np.nonzero(odd)[0]:
            out[i] = self.whole([texts[int(i)].as_py()])[0]
        plain = np.nonzero(~odd & ~empty)[0]
        if len(plain):
            lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
            offsets = lists.offsets.to_numpy(zero_copy_only=False)
            coded = pc.dictionary_encode(lists.values)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            chunks = coded.dictionary.to_pylist()
            firsts, code = np.unique(codes[offsets[:-1]], return_inverse=True)
            codes[offsets[:-1]] = code + len(chunks)  # a text's first cut has no space before it
            cuts = [c if c[:1] == "\n" else " " + c for c in chunks] + [chunks[i] for i in firsts]
            flat, lengths = self.pieces(cuts)
            ids = gathered(flat, np.cumsum(lengths) - lengths, lengths, codes)
            per_text = np.concatenate(([0], np.cumsum(lengths[codes])))[offsets]
            for k, i in enumerate(plain):
                out[i] = ids[per_text[k] : per_text[k + 1]]
        return out


def encoder(path: str) -> Encoder:
    return in_worker(f"encoder:{path}", lambda: Encoder(path))
