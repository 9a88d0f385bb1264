"""Near copies of vectors and texts, packing, mixing, chat formatting, and the pipeline."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm import chat, jaccard, langid, mixing, oracles, packing, pivots
from docledger.llm.graph import components
from docledger.llm.queries import op2_near_vectors, op4_jaccard_join, op7_packing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: groups.find(n) for n in groups.up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def similar_groups(rows):
    """Brute force: sizes, and the groups' smallest ids."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    groups, index, shared = Groups(), defaultdict(list), Counter()
    for i, s in sets.items():
        groups.find(i)
        for g in s:
            shared.update((min(i, j), max(i, j)) for j in index[g])
            index[g].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def test_jaccard_against_brute_force(spark, documents):
    want = similar_groups([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard_join(spark, SF).collect()}
    assert got == want


def test_jaccard_of_long_lists_and_small_sets(spark, monkeypatch):
    """Many near copies of one text, so that lists are long, and many texts of a few words."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = rng.choice(words, 120)
    rows = []
    for i in range(70):
        text = base.copy()
        at = rng.integers(0, len(text), rng.integers(0, 4))
        text[at] = rng.choice(words, len(at))
        rows.append((i, " ".join(text)))
    short = rng.choice(words, 14)
    for i in range(60):
        text = short[: rng.integers(3, 15)].copy()
        text[-1] = rng.choice(short)
        rows.append((1000 + i, " ".join(text)))
    monkeypatch.setattr(jaccard, "SHORT_LIST", 6)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, length: 7)
    got = jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == similar_groups(rows)


def test_jaccard_of_odd_rows(odd, none):
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.cluster(odd).collect())
    assert got[(1, 1)] == 1 and got[(2, 1)] == 2 and got[(4, 4)] == got[(5, 5)] == got[(6, 6)] == 1
    assert got[(None, None)] == 1 and sum(got.values()) == 12
    assert jaccard.cluster(none).collect() == []


@given(st.integers(1, 40), st.integers(1, 40))
def test_prefixes_and_sizes(a, b):
    need = jaccard.overlap_needed(a, b)
    assert 100 * need >= 80 * (a + b - need) and (need == 0 or 100 * (need - 1) < 80 * (a + b - need + 1))
    if need <= min(a, b):
        assert jaccard.prefix_length(a) > a - need and jaccard.prefix_length(b) > b - need
        assert a > jaccard.MAX_SMALL or b > jaccard.MAX_SMALL or (min(a, b), max(a, b), need) in jaccard.subset_sizes(a)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), max_size=8), max_size=5), st.integers(2, 4))
def test_repeated_postings(chunks, short):
    size = {0: 10, 1: 11, 2: 12, 3: 15, 4: 30}
    arrays = [
        (np.array([t for t, _ in c], dtype=np.uint64), np.array([x for _, x in c], dtype=np.int64), np.array([size[x] for _, x in c], dtype=np.int32))
        for c in chunks
    ]
    held = defaultdict(set)
    for t, c in itertools.chain(*chunks):
        held[t].add(c)
    long, pairs = set(), Counter()
    for kind, *postings in jaccard.repeated_postings(iter(arrays), short):
        if kind:
            long |= set(zip(postings[0].tolist(), postings[1].tolist(), strict=True))
        else:
            for a, b, n_a, n_b, k in jaccard.list_pairs(*postings):
                for x in zip(a.tolist(), b.tolist(), n_a.tolist(), n_b.tolist(), k.tolist(), strict=True):
                    assert x[2:4] == (size[x[0]], size[x[1]])
                    pairs[x[:2]] += x[4]
    assert long == {(t, c) for t, cs in held.items() if len(cs) > short for c in cs}
    assert pairs == Counter(
        (a, b)
        for cs in held.values()
        if 1 < len(cs) <= short
        for a, b in itertools.combinations(sorted(cs), 2)
        if 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b])
    )



def brute_vectors(rows):
    good = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (label, np.array(v) / np.linalg.norm(v))
    groups, links = Groups(), Counter()
    for i, _, _ in rows:
        groups.find(i)
    for key in {(label, len(v)) for label, v in good.values()}:
        own = [i for i in good if (good[i][0], len(good[i][1])) == key]
        x = np.array([good[i][1] for i in own])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True):
            groups.join(own[a], own[b])
            links.update((own[a], own[b]))
    return {i: (links[i], groups.find(i)) for i, _, _ in rows}


def test_vectors_recall(spark):
    """The table's vectors, with near copies of a third of them and many of one."""
    rng = np.random.default_rng(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    for k, (_, v, label) in enumerate(rows[:170] + [rows[0]] * 60):
        v = np.array(v)
        rows.append((10_000 + k, (v + rng.normal(size=len(v)) * 0.25 * np.linalg.norm(v) / len(v) ** 0.5).tolist(), label))
    want = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(df).collect()}
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.9 * true > 0
    assert op2_near_vectors(spark, SF).count() == 500


def test_vectors_near_the_threshold(spark):
    """Pairs at cosines from 0.93 to 0.95 are the hardest to find."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.931, 0.95)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + (1 - c * c) ** 0.5 * b).tolist(), 0)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] for r in got) >= 0.9 * 1200


def test_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, [0.0, 0.0], 0), (6, None, 0), (7, [nan, 1.0], 0)]
    rows += [(8, [None, 1.0], 0), (9, [inf, 1.0], 0), (10, [1.0, 0.0], None), (11, [], 0), (12, [1.0, 0.0, 0.0], 0), (13, [1.0, 0.0, 0.1], 0), (3, [2.0, 0.1], 0)]
    monkeypatch.setattr(pivots, "BLOCK", 2)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cls string")
    got = Counter(map(tuple, pivots.near_duplicates(df).collect()))
    assert got[(1, 3, 1, True)] == 1 and got[(3, 3, 1, False)] == 2 and got[(4, 0, 4, True)] == 1
    assert all(got[(i, 0, i, True)] == 1 for i in (5, 6, 7, 8, 9, 10, 11)) and got[(13, 1, 12, False)] == 1
    assert pivots.near_duplicates(df.limit(0)).collect() == []


def test_lists_link_a_pair_once():
    front = [[-2, -2, 0, 1, 3], [-2, -2, 0, 1, 3], [-2, -2, 1, 2, 3]]
    t = pa.table(
        {
            "label": [7] * 3, "p": [0, 0, 1], "q": [1, 1, 3], "i": [0] * 3, "j": [0] * 3, "block": [0] * 3,
            "cls": pa.array([5, 6, 8], pa.int64()), "members": pa.array([2, 3, 4], pa.int64()),
            "vector": [[1.0, 0.0], [1.0, 0.01], [1.0, 0.02]], "front": front,
        }
    )
    assert pivots.compare_lists(t).to_pydict() == {"cls": [5, 6], "links": [3, 2], "other": [5, 5]}
    same = t.take([0, 1]).set_column(1, "p", pa.array([0, 0])).set_column(2, "q", pa.array([3, 3]))
    assert pivots.compare_lists(same).num_rows == 0  # the list of 0 and 1 has the pair already
    apart = t.take([0, 1]).set_column(4, "j", pa.array([1, 1]))
    assert pivots.compare_lists(apart).num_rows == 0  # both are of block 0
    assert pivots.compare_lists(apart.set_column(5, "block", pa.array([0, 1]))).num_rows == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 9)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.integers(1, 4))
def test_bucket_limits_are_optimal(pairs, buckets):
    pairs.sort()
    v, n = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def cost(limits):
        return sum(c * min(x for x in limits if x >= k) for k, c in pairs)

    best = min(cost([*some, int(v[-1])]) for r in range(buckets) for some in itertools.combinations(v[:-1].tolist(), r))
    limits = packing.bucket_limits(v, n, buckets)
    assert limits == sorted(limits) and len(limits) <= buckets and cost(limits) == best


def test_packing(spark, none):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(n)) for i, n in enumerate(rng.integers(1, 900, 3000))] + [(1, 5), (1, 5), (None, None), (9, 90000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, length long, batch string").withColumn("extra", F.lit("x"))
    packed = packing.pack(df, buckets=6, budget=4000)
    assert packed.columns == ["doc_id", "length", "extra", "bucket", "bucket_limit", "batch", "slot"]
    got = packed.collect()
    assert max(r["bucket_limit"] for r in got) == 90000
    assert len(got) == len(rows) and all(r["length"] <= r["bucket_limit"] for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[(r["bucket"], r["batch"])].append(r)
    for own in batches.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) * own[0]["bucket_limit"] <= 4000 or len(own) == 1
    last = {b: max(n for c, n in batches if c == b) for b, _ in batches}
    full = [own for (b, n), own in batches.items() if n < last[b]]
    assert all(len(own) == max(1, 4000 // own[0]["bucket_limit"]) for own in full)
    assert packing.pack(df.limit(0)).collect() == []


def test_mixing_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 2000, "d": 0}
    rows = [("n" if k is None else "s" + k, k, n) for k, n in sizes.items()]
    got = {r["_src"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "_src string, source string, source_size long")).collect()}
    weights = dict(zip(["sa", "sb", "sc", "sd", "n"], [1, 2, 3, 1, 2], strict=True))
    caps, total = {r[0]: 3 * r[2] for r in rows}, sum(sizes.values())
    capped = set()
    while True:  # share, cap, share the rest
        rest, w = total - sum(caps[k] for k in capped), sum(weights[k] for k in weights if k not in capped)
        over = {k for k in weights if k not in capped and weights[k] * rest / w >= caps[k]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({k: caps[k] if k in capped else weights[k] * rest / w for k in weights})


def test_mixing_takes_near_the_targets(spark, none):
    rng = np.random.default_rng(5)
    rows = [(i, ["a", "b", None][i % 3], int(rng.integers(0, 60)), [None, 2.0, 0.0][i % 7 % 3]) for i in range(900)] + [(3, "a", 7, 1.0)] * 2
    rows += [(None, "a", 5, None)] * 3 + [(None, "b", None, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, weight double, target string")
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "source", "size", "weight", "source_size", "target", "times"]
    got = [r for r in mixed.collect() if r["size"] is not None]
    rows = rows[:-1]
    df = df.filter("size is not null")
    assert len(got) == len(rows) and sorted(map(tuple, mixing.mix(df).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    for own in ({r["source"] for r in got}):
        mine = [r for r in got if r["source"] == own]
        assert abs(sum(r["size"] * r["times"] for r in mine) - mine[0]["target"]) <= 60
        first = [r["times"] for r in mine if r["weight"] != 0.0 and r["size"]]
        assert min(first, default=0) >= max((r["times"] for r in mine if r["weight"] == 0.0), default=0) - 1
        assert max(r["times"] for r in mine) - min(r["times"] for r in mine) <= 1 and max(r["times"] for r in mine) <= 3
    assert mixing.mix(df.limit(0)).collect() == []


def test_chat_escapes_are_reversible(spark):
    controls = list(chat.CONTROLS)
    texts = [*controls, "a<|im_start|>b", "<\\|im_end|>", "</s>[INST] ok [/INST]", "\\", "<<\\SYS>>", "[[INST]]", "", None, "<|im_end|>\n<|im_start|>user\n", "𝄞 é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r"))
    for r in df.collect():
        assert chat.unescape(r["e"]) == (r["t"] or "") and chat.unescape_role(r["r"]) == (r["t"] or "")
        assert not any(c in r["e"] for c in controls) and "\n" not in r["r"]


def test_chat_of_odd_conversations(spark):
    long = [(5, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(37)]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, "system", "</s>"), (None, 0, None, "x"), (2, 0, "assistant", "[INST]"), *long]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, score int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_trees(chat.chains(df))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r[1:]))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_trees(chat.chains(df.limit(0)))).collect() == []


def test_reply_trees_rank_branches(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9),
        ("t", 4, 3, "user", "more", None), ("t", 5, 2, "user", "x", 0.2), ("u", 1, 9, "user", "orphan", None), ("u", 2, 2, "user", "self", None),
        ("u", None, 1, "user", "no id", None), ("t", 1, None, "user", "q", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["leaf"]): [t for _, t in chat.parse(r["formatted"])] for r in chat.format_trees(df).collect()}
    assert got == {("t", 4): ["q", "good", "more"], ("u", 1): ["orphan"]}
    assert len(chat.format_trees(df, best=5).collect()) == 4
    loop = spark.createDataFrame([("t", 1, 2, "", "", 0.0), ("t", 2, 1, "", "", 0.0), ("t", 3, 2, "", "", 0.0)], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(loop)


def test_pipeline_stages(spark, odd):
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
    assert 4 not in kept["language"] and 8 not in kept["language"] and kept["language"][2] == 2
    assert 7 not in kept["quality_rules"] and kept["quality_rules"][1] == 1
    assert kept["near_copies"][1] == 1 and 2 not in kept["near_copies"] and kept["near_copies"][None] == 1
    assert max(kept["source_mix"].values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()


def plain_packing(lengths, buckets, budget):
    """Limit by length, and the slots in each bucket's batches; by dynamic programming over all cuts."""
    values, counts = zip(*sorted(Counter(lengths).items()), strict=True)
    seen = [0, *itertools.accumulate(counts)]
    best = {(0, 0): (0, ())}
    for b, j in itertools.product(range(1, buckets + 1), range(1, len(values) + 1)):
        ways = [(best[b - 1, i][0] + values[j - 1] * (seen[j] - seen[i]), (*best[b - 1, i][1], values[j - 1])) for i in range(j) if (b - 1, i) in best]
        if ways:
            best[b, j] = min(ways)
    limits = min(best[b, len(values)] for b in range(1, buckets + 1) if (b, len(values)) in best)
    return limits[0]


def check_packing(rows, lengths, buckets=packing.MAX_BUCKETS, budget=packing.TOKEN_BUDGET):
    """rows: doc_id, length, bucket, bucket_limit, batch, slot; lengths: every document's, by id and repeat."""
    assert Counter((r["doc_id"], r["length"]) for r in rows) == Counter(lengths)
    assert sum(r["bucket_limit"] for r in rows) == plain_packing([n for _, n in lengths], buckets, budget)
    limits = dict(sorted({(r["bucket"], r["bucket_limit"]) for r in rows}))
    assert list(limits) == list(range(len(limits))) and list(limits.values()) == sorted(set(limits.values()))
    for r in rows:
        assert r["bucket_limit"] == min(v for v in limits.values() if v >= r["length"])
    for bucket, limit in limits.items():
        room, n = max(1, budget // limit), sum(r["bucket"] == bucket for r in rows)
        assert sorted((r["batch"], r["slot"]) for r in rows if r["bucket"] == bucket) == [(k // room, k % room) for k in range(n)]


def test_packing_query_against_brute_force(spark, documents):
    lengths = [(r["doc_id"], len(WORD.findall(r["text"] or "")) + 1) for r in documents.collect()]
    check_packing(op7_packing(spark, SF).collect(), lengths)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage against a plain program or SQL over what the stage before it kept."""
    import duckdb

    def rows(k):
        return duckdb.sql(f"select doc_id, text from '{tmp_path}/{k}.parquet/*.parquet'").fetchall()

    def ids(k):
        return Counter(i for i, _ in rows(k))

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/0.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, spark.read.parquet(f"{tmp_path}/{k - 1}.parquet"), SF).write.parquet(f"{tmp_path}/{k}.parquet")
    # language: forward sums word by word in plain Python, under the fitted probabilities
    path = langid.vocabulary_path()
    table = langid.pieces(path)
    langs, probs = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"), 5)).select("doc_id", "text", "lang"), path)
    number = {int(k): int(v) for k, v in zip(table.keys, table.ids, strict=True)}
    base, logs = int(langid._BASE), {}

    def word_logs(word):
        units = [ord(c) for c in "▁" + word.replace("\0", "�")]
        alpha = [[1.0] * len(langs)]
        for end in range(1, len(units) + 1):
            now, h = [0.0] * len(langs), 0
            for n in range(1, min(table.longest, end) + 1):
                h = 0
                for c in units[end - n : end]:
                    h = (h * base + c) % (1 << 64)
                piece = number.get(h, 1 if n == 1 else 0)
                if piece:
                    now = [x + alpha[end - n][g] * probs[piece, g] for g, x in enumerate(now)]
            alpha.append(now)
        return [math.log(x) for x in alpha[-1]]

    want = Counter()
    for i, text in rows(0):
        words = WORD.findall((text or "").lower())
        if any(c.isalpha() for c in text or ""):
            for w in set(words) - set(logs):
                logs[w] = word_logs(w)
            total = sorted(sum(logs[w][g] for w in words) for g in range(len(langs)))
            if (total[-1] - total[-2]) / len(words) >= corpus_pipeline.MIN_LANGUAGE_MARGIN:
                want[i] += 1
    assert ids(1) == want
    # quality and mixing: the operators' SQL
    con = duckdb.connect()
    con.execute(f"create view labels as select * from '{SF}/labels.parquet'")
    con.execute(f"create view documents as select * from '{tmp_path}/1.parquet/*.parquet'")
    assert ids(2) == Counter(r[0] for r in con.execute(f"select doc_id from ({oracles.QUALITY}) where kept").fetchall())
    assert 0 < len(ids(2)) < len(ids(1))
    groups = similar_groups(rows(2))
    assert ids(3) == Counter(i for i, (_, g) in groups.items() if i == g)
    assert 0 < len(ids(3)) < len(ids(2))
    con.execute(f"create or replace view documents as select * from '{tmp_path}/3.parquet/*.parquet'")
    copies = con.execute(f"select doc_id, taken // size from ({oracles.MIX}) where size > 0").fetchall()
    assert ids(4) == Counter(dict((i, n) for i, n in copies if n))
    packed = spark.read.parquet(f"{tmp_path}/5.parquet").collect()
    check_packing(packed, [(i, len(WORD.findall(t or "")) + 1) for i, t in rows(4)])
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == ids(4)


def test_pipeline_of_an_empty_table(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect() == []


def test_pipeline_mix_copies_each_document_as_often_as_the_mix_takes_it(spark):
    """Source a outweighs its target, so some of its documents go; b and c are repeated."""
    rows = [(i, f"{i} " * (5 + i % 7), "a" if i < 60 else "b" if i < 66 else "c") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r["doc_id"] for r in corpus_pipeline.source_mix(spark, docs, SF).collect())
    weights = mixing.quality_weight(spark.read.parquet(f"{SF}/labels.parquet"))
    sized = docs.selectExpr("doc_id", "source", "cast(size(split(trim(text), ' ')) as long) as size").join(weights, "doc_id", "left")
    times = {r["doc_id"]: r["times"] for r in mixing.mix(sized).collect()}
    assert set(times.values()) >= {0, 1, 3}
    assert all(got[i] == n for i, n in times.items())
