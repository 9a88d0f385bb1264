"""Language identification, quality rules, language-model scores, license scans and token shards."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docledger.llm import contextmix, langid, licenses, quality, sstable, tokens
from docledger.llm.common import batches_of, word_codes
from docledger.llm.queries import op1_language_id, op5_lm_score, op6_license_scan

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_of_parts_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["É A\x0bb", None, "", " x ", "ü" * 40, "Z z"]})
    got = []
    for part in batches_of(batch, "text", limit=8):
        codes, per_text, words = word_codes(part.column("text"))
        at, listed = 0, words.to_pylist()
        for n in per_text.tolist():
            got.append([listed[c] for c in codes[at : at + n]])
            at += n
    assert got == [["É", "a", "b"], [], [], ["x"], ["ü" * 40], ["z", "z"]]


def test_language_forward_sums_all_segmentations():
    table = langid.pieces(langid.vocabulary_path())
    probs = np.full((table.size, 1), 1e-3)
    probs[0] = 0

    def brute(units):
        if not len(units):
            return 1.0
        total = 0.0
        for n in range(1, min(table.longest, len(units)) + 1):
            piece = table.find(langid._hash(langid._codes([units[:n]], n)))[0] or (1 if n == 1 else 0)
            total += probs[piece, 0] * brute(units[n:])
        return total

    for w in ("the", "stone", "日本", "größe", "internationally"):
        assert langid.word_scores([w], table, probs)[0, 0] == pytest.approx(math.log(brute("▁" + w)))


def test_language_forward_has_no_longest_word(monkeypatch):
    """Against exact sums of fractions, over words and pieces of any length; improbable ones do not underflow."""
    table = langid.pieces(langid.vocabulary_path())
    rng = np.random.default_rng(1)
    exact = [Fraction(int(x) + 1, 10**12) for x in rng.integers(0, 1000, table.size)]
    probs = np.array([[float(x)] for x in exact])
    monkeypatch.setattr(langid, "SPAN", 50)

    def forward(text):
        alpha = [Fraction(1)]
        for end in range(1, len(text) + 1):
            total = Fraction(0)
            for n in range(1, min(table.longest, end) + 1):
                piece = table.find(langid._hash(langid._codes([text[end - n : end]], n)))[0] or (1 if n == 1 else 0)
                total += alpha[end - n] * exact[piece] if piece else 0
            alpha.append(total)
        return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)

    words = ["internationally" * 14, "straßenverkehr日" * 3, "x" * 200, "a"]
    got = langid.word_scores(words, table, probs)[:, 0]
    assert got == pytest.approx([forward("▁" + w) for w in words])


def test_language_ties_and_dirty_labels(spark):
    docs = spark.createDataFrame([(i, "one two three", k) for i in range(40) for k in ("b", "a")], "doc_id long, text string, lang string")
    got = langid.identify(docs, ["doc_id"]).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and all(r["score"] == 0.5 and r["margin"] == 0 for r in got)
    alone = langid.identify(docs.filter("lang = 'b'"), ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"], r["margin"]) for r in alone} == {("b", 1.0, None)}


def test_language_accuracy_on_held_out(spark):
    got = op1_language_id(spark, SF).toPandas()
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(langs, on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    own = both[both.held_out]
    assert (own.lang_pred == own.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_of_odd_rows(odd, none):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd, ["doc_id"]).collect()]
    pred = {i: p for i, p, _ in got}
    assert len(got) == 12 and all(pred[i] == "und" for i in (4, 5, 6, 8)) and pred[1] == "en"
    assert langid.identify(none, ["doc_id"]).collect() == []


def brute_counts(text):
    words = WORD.findall(text or "")
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(five), set()
    for i, g in enumerate(five):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(documents, odd, none):
    for docs in (documents.select("doc_id", "text", "lang", "source"), odd):
        texts = [r["text"] for r in docs.collect()]
        got = quality.judge(docs.select("doc_id", "text", "lang", "source"), ["doc_id"]).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert Counter(tuple(r[k] for k in names) for r in got) == Counter(map(brute_counts, texts))
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
        assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.judge(none, ["doc_id"]).collect() == []


def test_quality_fences_follow_the_group(spark):
    """Groups of many documents have fences of their own, small ones nearly those of their language."""
    rows = [("en", "many", "word_length", 4900 + i % 7 * 32, 300) for i in range(7)] + [("en", "few", "word_length", 9024, 1)]
    rows += [("de", None, "word_length", 6016 + i % 5 * 32, 100) for i in range(5)]
    rows += [(*r[:2], m, 0, r[4]) for r in rows for m in ("symbol_rate", "dup_line_rate", "repeat_rate")]
    made = quality.thresholds(spark.createDataFrame(rows, "lang string, source string, metric string, bucket long, n long"))
    got = {(r["lang"], r["source"]): r for r in made.collect()}
    many, few, de = got[("en", "many")], got[("en", "few")], got[("de", None)]
    assert 4900 < many["max_word_length"] < few["max_word_length"] < 5700 < de["max_word_length"]
    assert many["min_word_length"] < 4900 < de["min_word_length"] < 6016
    assert few["max_symbol_rate"] == many["max_symbol_rate"] == 3


def test_quality_sketch_is_close(spark):
    got = spark.range(1, 5000).selectExpr("id", f"{quality._bucket('id')} as b").collect()
    assert all(r["b"] <= r["id"] <= r["b"] * 129 / 128 for r in got)


def test_scores_against_brute_force(spark):
    docs = {r["doc_id"]: WORD.findall(lower(r["text"])) + ["\n"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    seen = Counter(w for i, ws in docs.items() if train(i) for w in ws)
    n, v = sum(seen.values()), len(seen)
    got = op5_lm_score(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = docs[r["doc_id"]]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(seen[w] > 0 for w in ws), n, not train(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_bit_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    tables = contextmix.encode_counts(rng.integers(0, 50, 2 * contextmix.SLOTS)).view(np.uint32)
    model = contextmix.Model(tables)
    got = 10.0 ** model.score([bytes([c]) for c in range(256)], np.ones(256))
    assert got.sum() == pytest.approx(1, abs=1e-3)
    deep = [b"begin" + bytes([c]) for c in range(256)]
    first = [b"b", b"be", b"beg", b"begi", b"begin"]
    total = model.score(deep, np.arange(256.0)) - model.score([first[-1]], np.zeros(1))
    assert (10.0**total).sum() == pytest.approx(1, abs=1e-3)


def test_first_bytes_of_words_depend_on_what_stands_before():
    texts = ["a bc def", "", None, "\u00fcber x\x00 y", "  z  "]
    got = contextmix.seam_keys(*word_codes(pa.array(texts)))
    streams = [b"".join(w + b" " for w in (t or "").encode().split(b" ") if w) for t in texts]
    words, ends = [], []
    for s in streams:
        at = 0
        for t in [w + b" " for w in s.split(b" ")[:-1]] + [b"\n"]:
            before = s[max(0, at - 4) : max(0, at - 1)].rjust(3, b"\0")
            (ends if t == b"\n" else words).append((before + t[:3]).ljust(6, b"\0"))
            at += len(t)
    assert [int(k).to_bytes(6, "big") for k in got] == words + ends
    rng = np.random.default_rng(1)
    model = contextmix.Model(contextmix.encode_counts(rng.integers(0, 50, 2 * contextmix.SLOTS)).view(np.uint32))
    after = lambda tail: model.score_seams(np.array([int.from_bytes(tail + bytes([c, 32, 0]), "big") for c in range(33, 256)]))
    assert abs(after(b"and") - after(b"the")).max() > 0.01
    key, word = int.from_bytes(b"theflo", "big"), [b"flowers "]
    whole = model.bits_score(contextmix.Bits(word, before=np.array([int.from_bytes(b"the ", "big")], dtype=np.uint64)), contextmix.deep_counts(word, np.ones(1))[0], 1)
    assert model.score_seams(np.array([key])) + model.score(word, np.ones(1), since=contextmix.HEAD) == pytest.approx(whole, abs=1e-4)


def test_scores_know_the_order_of_words(spark):
    rows = [(i, f"red {w} big {w}" if i % 3 else f"tall {w}s old {w}s") for i, w in enumerate(["ox", "fly", "cow", "ewe"] * 30)]
    rows += [(1000, "red ox big fly"), (1001, "fly big ox red")]
    got = {r["doc_id"]: r["score"] for r in contextmix.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 0.5


def test_counts_keep_small_values_and_64_bits():
    n = np.array([0, 1, 2, 3, 50, 699, 1 << 16, 1 << 33, (1 << 62) + 5], dtype=np.int64)
    got = contextmix._DECODED[contextmix.encode_counts(n)]
    assert (got[:6] == n[:6]).all() and got == pytest.approx(n, rel=1e-3)
    deep = contextmix.deep_counts([b"wonder ", b"wonders "], np.array([1 << 33, 2]))[0].reshape(-1, 8, 2)
    assert deep[0].sum(axis=1) == pytest.approx([2.0**33] * 8)  # the bits of "r", after "wonde"
    assert deep[1][0].sum() == pytest.approx(2.0**33) and deep[1][1].tolist() == [2.0**33, 2.0]  # " " and "s" part at the second bit


def test_scores_of_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in contextmix.score(odd).collect()}
    assert len(got) == 11 and got[4]["n_tokens"] == got[5]["n_tokens"] == got[6]["n_tokens"] == 1
    assert got[7]["n_tokens"] == 12001
    assert contextmix.score(none).collect() == []


def test_license_base_places(spark):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    some = 0
    for r in op6_license_scan(spark, "/root/testdata/sf0.01").collect():
        words = pattern.findall(lower(texts[r["doc_id"]]))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places, labels = [i for i, _ in at], {x for _, x in at}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        some += bool(at)
    assert some


def test_license_priority_and_containment():
    scanner = licenses.Scanner()
    label = lambda t: [r.label for _, _, r in scanner.detections(licenses.canonical(t)[0])]
    assert label("Licensed under the\n * Apache License,\n * Version 2.0") == ["apache-2.0"]
    assert label("SPDX-License-Identifier: CC-BY-NC-SA-4.0") == ["cc-by-nc-sa-4.0"]
    assert label("no terms here, only smith licenses") == []
    assert len(licenses.rules()) > 300


def test_license_scan_of_odd_rows(odd, none):
    got = licenses.scan(odd, ["doc_id"]).collect()
    assert len(got) == 12 and all(r["n_base"] == 0 and r["labels"] == "" for r in got)
    assert licenses.scan(none, ["doc_id"]).collect() == []


def test_token_ids_equal_the_librarys():
    encoder = tokens.Encoder(tokens.vocabulary_path())
    texts = ["a  b", " a", "a\n\nb", "a\n b", "it's we'll  ok\tx", "x\n", "", None, "é1a ñ2 <|endoftext|> y", "\xa0a b", "日本語 text", "word.\nNext's 3.14 $5", "a​b", "x" * 3000]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_shards_round_trip_and_lookup(spark, odd, none):
    manifest = sstable.write(odd)
    encoder = tokens.Encoder(tokens.vocabulary_path())
    got = sorted(map(tuple, sstable.read(spark, manifest).collect()), key=lambda r: r[1])
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    for found, r in zip(got, rows, strict=True):
        ids = encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert found == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert [len(sstable.lookup(manifest, i)) for i in (1, 2, None, 99)] == [1, 2, 1, 0]
    assert sstable.read(spark, sstable.write(none)).collect() == []


def test_license_rules_against_brute_force(spark):
    """All rules over all words without a prefilter, and detections resolved one against all others."""

    def brute(text):
        words, _ = licenses.canonical(text)
        found = [(m.start(), m.end(), i, r) for i, r in enumerate(licenses.rules()) for m in re.finditer(r.pattern, words)]
        kept = []
        for s, e, i, r in sorted(found, key=lambda d: (-d[3].priority, d[0] - d[1], d[0], d[2])):
            if not any((a <= s and e <= b and o.priority == r.priority) or (a < e and s < b and o.priority > r.priority) for a, b, o in kept):
                kept.append((s, e, r))
        return sorted((s, e, r.name) for s, e, r in kept)

    own = [
        "We permit the Expat license and the MIT License.", "SPDX-License-Identifier: BSD-3-Clause-Clear", "see https://www.apache.org/licenses/LICENSE-2.0 .",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "GNU General Public License " * 30, "cc by sa 4.0 / CC BY 4.0 / creativecommons.org/licenses/by-nc-sa/4.0", "", None, "x " * 20000 + "cc0",
        "This file is licensed under the GNU Lesser General Public License version 2.1 or any later", "permitted", "all rights reserved all rights reserved",
    ]
    texts = own + own[:2] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text rlike '(?i)licen|rights'").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = 0
    for r in licenses.scan(df, ["doc_id"]).collect():
        got = [(d["start"], d["end"], d["rule"]) for d in r["detections"]]
        assert sorted(got) == brute(texts[r["doc_id"]])
        words, _ = licenses.canonical(texts[r["doc_id"]])
        assert all(d["first_word"] == words.count(" ", 0, d["start"]) for d in r["detections"])
        assert r["labels"].split(",") == sorted({d["label"] for d in r["detections"]} | set(r["base_labels"].split(",")) - {""}) or not r["labels"]
        hits += len(got)
    assert hits > 80 and len({r.name for r in licenses.rules()}) == len(licenses.rules()) > 700


def test_license_keywords_stand_in_what_their_rules_find():
    """Texts made from the fixed sentences: with nothing else around, the keyword gate lets each rule run."""
    scanner = licenses.Scanner()
    for label, _, pattern in licenses.TEXTS:
        text = re.sub(r"\\[dw]\+?|\.\{\d+,\d+\}\?", "2", pattern)  # one text that the pattern matches
        while (m := re.search(r"\(\?[:!]([^()|]*)(?:\|[^()]*)?\)\??", text)):
            text = text[: m.start()] + ("" if m[0].startswith("(?!") else m[1]) + text[m.end() :]
        text = re.sub(r"\[(.)[^]]*\]", r"\1", text).replace("?", "")
        assert re.fullmatch(pattern, text), (pattern, text)
        words, _ = licenses.canonical(text)
        assert label in {r.label for own in dict(x for _, x in scanner.automaton.iter(words)).values() for _, r, regex in own if regex.search(words)}, text


def test_license_hits_by_the_thousand():
    words, _ = licenses.canonical("mit license apache license version 2 0 " * 20_000)
    assert len(licenses.Scanner().detections(words)) == 40_000 and len(licenses.Scanner().base(words)) == 40_000
