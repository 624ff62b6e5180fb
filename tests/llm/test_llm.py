"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and copies."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from hindcast.llm import audio, bpe, common, jaccard, language, lines, mixing, mixlm, quality, urls, winnow
from hindcast.llm import queries as registered

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "lorem ipsum dolor " * 4000
ODD = [None, "", "   ", "\n\n", "a", "Repeated line of text here\nother\n repeated LINE of text here ", "no spaces " + "x" * 3000, "ÄÖ ß é 漢字 \U0001f600", LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


def docs(spark, texts, first=1):
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), 0.5, "clash") for k, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD + ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []).where("1 = 0")


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, odd, empty):
    want = encoding()
    got = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, decoded_col="decoded").collect()
    for r in got:
        assert r["ids"] == want.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    again = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in again.collect())


def test_bpe_merges_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257}
    assert bpe.merge_piece(b"aaaaa", ranks) == [256, 257]
    assert bpe.merge_piece(b"aaab", ranks) == [257, 98] and bpe.merge_piece(b"", ranks) == []


def kept_by_brute_force(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i) for i, t in rows}


def test_line_dedup(spark, odd, empty):
    got = {r["doc_id"]: r["kept"] for r in lines.dedup(odd).collect()}
    assert got == kept_by_brute_force([(k, t) for k, t in enumerate(ODD + ODD, 1)])
    assert lines.dedup(empty).count() == 0


def test_line_dedup_of_rows_with_one_id(spark):
    """Rows of one id are one document: what only they share isn't repeated; null ids neither count nor change."""
    shared, own = "a line that two rows have", "a line that others have, too"
    rows = [(5, shared), (5, shared + "\n" + own), (7, own), (None, own), (None, shared), (3, own.upper())]
    got = sorted(((r["doc_id"] or 0), r["kept"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, shared), (0, own), (3, own.upper()), (5, shared), (5, shared), (7, "")] or got == sorted([(0, own), (0, shared), (3, own.upper()), (5, shared), (5, shared), (7, "")])


def test_line_dedup_is_reversible(spark):
    first = docs(spark, ["a shared line of text\nown line number one", "a shared line of text\nown line number two"])
    more = docs(spark, ["own line number two\nsomething else again", "A SHARED line of text "], first=3)
    store = lines.LineStore(spark, shard_keys=1)

    def now(df):
        return sorted((r["doc_id"], r["kept"]) for r in lines.without(df, store.drops()).collect())

    store.insert(first)
    before = now(first)
    store.insert(more)
    both = first.unionByName(more)
    assert dict(now(both)) == kept_by_brute_force([(r["doc_id"], r["text"]) for r in both.collect()])
    store.insert(more)
    store.delete(more.select("doc_id"))
    assert now(first) == before
    store.delete(first.where("doc_id = 1").select("doc_id"))
    assert dict(now(first))[2] == "a shared line of text\nown line number two"


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 3000))
    held = lines.CuckooFilter(lines.CuckooFilter.buckets_for(2000))
    held.add(hi[:1500], lo[:1500])
    held.add(hi[1500:2500], lo[1500:2500])  # more than it has room for: the rest is stashed
    assert held.has(hi[:2500], lo[:2500]).all()
    for a, b in zip(hi[:1000], lo[:1000], strict=True):
        held.remove(int(a), int(b))
    assert held.has(hi[1000:2500], lo[1000:2500]).all()
    assert held.has(hi[:1000], lo[:1000]).mean() < 0.05 and held.has(hi[2500:], lo[2500:]).mean() < 0.05


def components_by_brute_force(texts, width, percent):
    sets = {}
    for k, t in enumerate(texts, 1):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {k: (len(sets[k]), root[k]) for k in sets}


def test_jaccard_join(spark, odd, empty):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    base = [list(rng.choice(words, n)) for n in (5, 8, 40, 40, 90)]
    texts = list(ODD)
    for b in base:
        for _ in range(14):
            copy = list(b)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += texts[:12] + ["x y z", "X  y\tz", "x y"]
    want = components_by_brute_force(texts, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, texts), 4, 85).collect()}
    assert got == want
    assert jaccard.join(empty).count() == 0
    one = {r["doc_id"] for r in jaccard.one_of_each(docs(spark, texts)).collect()}
    assert one == {k for k, (_, c) in components_by_brute_force(texts, 5, 80).items() if c == k}


def test_jaccard_join_of_large_groups_of_near_copies(spark):
    """Copies about as far from each other as the threshold, with and without their common original, cut ones and spliced ones."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for size, share in ((80, 6), (60, 3), (120, 9)):
        base = list(rng.choice(words, size))
        for n in range(50):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(1, share))):
                copy[at] = f"new{rng.integers(1 << 30)}" if rng.random() < 0.7 else str(rng.choice(words))
            texts.append(" ".join(copy[: len(copy) - int(rng.integers(0, 6))] if n % 3 == 0 else copy))
        texts += [" ".join(base[k : k + size // 2] + list(rng.choice(words, size // 9))) for k in range(12)]
    want = components_by_brute_force(texts, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, texts), 4, 85).collect()}
    assert got == want and 20 < len({c for _, c in want.values()}) < len(texts)


def test_jaccard_join_of_rows_with_one_id(spark):
    t, u = " ".join(f"t{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [(5, t), (5, u), (7, t + " more"), (9, u + " more"), (None, t), (8, None), (8, t)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.join(table, 4, 85).collect())
        assert got == [(0, 57, None), (5, 57, 5), (5, 57, 5), (7, 58, 5), (8, 0, 8), (8, 57, 5), (9, 58, 5)]
        assert sorted(r["doc_id"] or 0 for r in jaccard.one_of_each(table).collect()) == [0, 5, 5, 8, 8]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (3, 5), (None, 1), (20, 3), *((k, k + 1) for k in range(100, 130))], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(edges, common.shared_dir(spark)).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 20: 3, 8: 8, 9: 8, 7: 7, **{k: 100 for k in range(100, 131)}}
    assert common.components(edges.where("a < 0"), common.shared_dir(spark)).count() == 0


def test_quality(spark, odd, empty):
    good, poor = ["the cat sat on the mat. it was a good day and we all went home."] * 30, ["BUY!! NOW!! CHEAP!! PILLS!! ### $$$"] * 30
    table = docs(spark, good + poor)
    labels = spark.createDataFrame([(k, 1 if k <= 30 else 0, 0) for k in range(1, 61)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(table, labels).collect()}
    assert all(got[k]["predicted"] == (k <= 30) for k in got)
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())
    model = quality.train(table, labels)
    assert quality.score(odd, model).count() == len(ODD) * 2 and quality.score(empty, model).count() == 0
    assert {r["predicted"] for r in quality.judged(table, labels.where("1 = 0")).collect()} == {1}


def test_quality_is_a_bradley_terry_fit():
    """Against gradient descent on the same loss over the same pairs; a text's score is the same in any batch and order."""
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["the", "cat", "sat!", "BUY", "x1", "#$"], int(rng.integers(3, 40)), p=p)) for p in ([0.4, 0.3, 0.1, 0.1, 0.05, 0.05], [0.2, 0.2, 0.2, 0.2, 0.1, 0.1]) for _ in range(60)]
    x, y = np.array([quality.measures(t) for t in texts]), np.repeat([1, 0], 60)
    model = quality.fit(x, y, pairs=500, ridge=0.05, seed=3)
    z = np.clip((x - model.mean) / model.spread, -8, 8)
    draw = np.random.default_rng(3)
    d = z[draw.choice(np.flatnonzero(y == 1), 500)] - z[draw.choice(np.flatnonzero(y == 0), 500)]
    w = np.zeros(x.shape[1])
    for _ in range(60_000):
        w += 0.05 * ((d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) - 0.05 * w)
    assert np.abs(w - model.weights).max() < 1e-6
    merit = model.merit(x)
    assert np.abs(merit - model.threshold).min() > 0
    # the share below the threshold parts the labels best among all cuts at the 401 quantiles
    balanced = lambda t: ((merit >= t) & (y == 0)).sum() / 60 + ((merit < t) & (y == 1)).sum() / 60
    assert balanced(model.threshold) <= min(balanced(t) for t in np.quantile(merit, np.linspace(0, 1, 401))) + 1e-12
    whole = model.score(x)
    for size in (1, 3, 30):
        assert (np.concatenate([model.score(x[k : k + size]) for k in range(0, len(x), size)]) == whole).all()
    assert (model.score(x[::-1])[::-1] == whole).all()


def test_quality_of_odd_rows(spark):
    """Several labels and rows of one doc_id, null ids and labels, labels of unknown kinds."""
    table = docs(spark, ["a good text. of words", "BAD!!! ###"] * 10).unionByName(docs(spark, ["a good text. of words", None])).unionByName(docs(spark, ["null id", None]).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 21)] + [(1, 0), (1, 1), (2, 5), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.judged(table, labels).collect()
    assert len(rows) == 24 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    by_text = {}
    for r in quality.score(table, quality.train(table, labels)).collect():
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_quality_on_held_out(spark):
    rows = quality.judged(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.85


def kneser_ney_by_definition(texts):
    """p(c, context) of interpolated Kneser-Ney with its definition in dictionaries."""
    counts = {}
    for t in texts:
        form = " " + " ".join(t.split()) + " "
        for k in range(len(form) - 3):
            counts[form[k : k + 4]] = counts.get(form[k : k + 4], 0) + 1
    levels = [counts]
    while len(levels) < 4:
        below = {}
        for g in levels[-1]:
            below[g[1:]] = below.get(g[1:], 0) + 1
        levels.append(below)
    symbols = len(levels[-1]) + 1

    def p(gram, level=0):
        if level == 4:
            return 1 / symbols
        c = levels[level]
        n1, n2 = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 else 0.5
        seen = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        if not seen:
            return p(gram[1:], level + 1)
        return max(c.get(gram, 0) - d, 0) / sum(seen) + max(1e-6, d * len(seen) / sum(seen)) * p(gram[1:], level + 1)

    return p


def test_kneser_ney_equals_its_definition(spark):
    texts = ["abracadabra", "banana bandana", "cabana", "абра", "a \U00020000b"]
    table = docs(spark, texts).withColumn("lang", F.lit("x")).withColumn("own", F.lit(False))
    rows = language.counted(table, ["x"]).collect()
    form = lambda g: "".join(chr(g >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0))
    want = {}
    for t in texts:
        t = " " + t.replace("\U00020000", chr(language.SURROGATES + 0x20000 % language.SPARE)) + " "
        for k in range(len(t) - 3):
            want[t[k : k + 4]] = want.get(t[k : k + 4], 0) + 1
    assert {form(r["gram"]): r["n"] for r in rows} == want
    model = language.kneser_ney(np.array([r["gram"] for r in rows]).view(np.uint64), np.zeros(len(rows), int), np.array([r["n"] for r in rows], float), ["x"])
    p = kneser_ney_by_definition([t.replace("\U00020000", chr(language.SURROGATES + 0x20000 % language.SPARE)) for t in texts])
    letters = sorted({g[-1] for g in want}) + ["ж"]
    for context in ("ban", "abr", "zzz", " ca", "zab"):
        symbols = np.array([[*map(ord, context), ord(c)] for c in letters], np.uint16)
        got = np.exp(model.log_probabilities(np.concatenate([language.packed(s, 4) for s in symbols])).astype(float))[:, 0]
        assert np.allclose(got, [p(context + c) for c in letters], rtol=1e-5) and math.isclose(got.sum(), 1, rel_tol=1e-5)


def test_language_is_the_same_in_any_partitions(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = [sorted((r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in language.predicted(table.repartition(n)).collect()) for n in (1, 7)]
    assert found[0] == found[1]


def test_language(spark, odd, empty):
    table = docs(spark, [("the quick brown fox jumps over the dog " if k % 2 else "der schnelle braune fuchs springt über den hund ") * 3 for k in range(60)])
    table = table.withColumn("lang", F.when(table.doc_id % 2 == 0, "en").otherwise("de"))
    got = {r["doc_id"]: r for r in language.predicted(table).collect()}
    assert all(r["lang_pred"] == ("en" if k % 2 == 0 else "de") for k, r in got.items())
    model = language.train(table)
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(found[k]["lang_pred"] == "und" for k in (1, 2, 3, 4)) and all(0 <= r["score"] <= 1 for r in found.values())
    assert language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_beyond_the_broadcast_leaves_no_ngram_out(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    few, all_ = ({r["doc_id"]: r for r in language.predicted(table, most).collect()} for most in (50, language.MOST_GRAMS))
    assert few.keys() == all_.keys()
    for k, r in all_.items():
        assert (few[k]["lang_pred"], few[k]["held_out"], few[k]["rejected"]) == (r["lang_pred"], r["held_out"], r["rejected"])
        assert math.isclose(few[k]["score"], r["score"], abs_tol=1e-4)


def test_language_on_held_out(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predicted(t).join(t.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95


def test_mixlm_base_is_exact_and_score_is_a_probability(spark, odd, empty):
    rows = [(k, t) for k, t in enumerate(ODD + ODD, 1)]
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]
    counts = {}
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for most in (mixlm.MOST_VOCABULARY, 0):
        got = {r["doc_id"]: r for r in mixlm.documents_scored(odd, most).collect()}
        for k, t in rows:
            base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words(t))
            assert math.isclose(got[k]["base_score"], base, rel_tol=1e-9)
            assert got[k]["n_tokens"] == len(words(t)) and got[k]["n_known"] == sum(w in counts for w in words(t)) and got[k]["train_tokens"] == n
            assert got[k]["score"] < 0
    assert mixlm.documents_scored(empty).count() == 0


def log_probability_by_definition(model, text):
    """One decision after another, in plain Python."""
    full = (1 << 64) - 1
    m1, m2, m3 = (int(x) for x in (mixlm._M1, mixlm._M2, mixlm._M3))
    own_hash = lambda w: (known[w] + 1) * m2 & full if w in known else xxhash.xxh3_64_intdigest(w)
    known = {w: k for k, w in enumerate(model.words)}
    one_counts, (check, codes, leaves) = model.one, model.two
    bits = (len(check) - 1).bit_length()
    path = lambda leaf: [(int(model.node[r]), bool(model.bit[r]), float(model.p[r]), int(model.own[r])) for r in range(model.starts[leaf], model.starts[leaf + 1])]
    odds = lambda z, o, doubt: min(max(math.log((o + 0.4) / (z + 0.4)) * (z + o) / max(z + o + doubt, 1e-9), -15), 15)
    off, sure, total = {}, {}, 0.0
    w, v, w_sure, v_sure = [1.0] * mixlm.KINDS, 1.0, [mixlm.WEIGHT_PRIOR] * mixlm.KINDS, mixlm.WEIGHT_PRIOR
    block, room, done = [], 1, 0

    def learn():
        """Newton steps on a block's decisions, all at once."""
        nonlocal v, v_sure
        steps = [[0.0, 0.0] for _ in range(mixlm.KINDS + 1)]
        for x, sign, slot, kind, s, p in block:
            for k, u in ((kind, x), (mixlm.KINDS, s)):
                steps[k][0] += u * sign * p
                steps[k][1] += u * u * p * (1 - p)
            one = 1 / (1 + math.exp(-x))
            off[slot] = off.get(slot, 0.0) + (sign > 0) - one
            sure[slot] = sure.get(slot, mixlm.OWN_PRIOR) + one * (1 - one)
        for k in range(mixlm.KINDS):
            w_sure[k] += steps[k][1]
            w[k] += steps[k][0] / w_sure[k]
        v_sure += steps[-1][1]
        v += steps[-1][0] / v_sure
        block.clear()

    def step(rows):
        nonlocal total, room, done
        for x, sign, slot, kind in rows:
            s = off.get(slot, 0.0) / sure.get(slot, mixlm.OWN_PRIOR)
            z = (x * w[kind] + s * v) * sign
            total -= math.log1p(math.exp(-z))
            block.append((x, sign, slot, kind, s, 1 / (1 + math.exp(z))))
        done, room = done + 1, room - 1
        if not room:
            learn()
            room = 1 + done // mixlm.BLOCK

    before = [0, 0]
    for word in [*mixlm.words_of(text), mixlm.END]:
        one, two = before[1], before[0]
        pair = ((one ^ two >> 31) * m1 + two * m3) & full
        pair = (pair ^ pair >> 29) * m2 & full
        pair ^= pair >> 32
        at = pair >> 64 - bits
        code = int(codes[at]) if int(check[at]) == pair >> 64 - bits - 8 & 255 else 0
        guessed = path(int(leaves[at])) if code & 15 >= 2 else []
        gate_there, rows = int(mixlm.gate_of(np.array([code]))[0]), []
        for k, (node, bit, p, own) in enumerate(path(known.get(word, 0))):
            slot = ((one * m2 & full) + (node * m3 & full) & full) * m1 % (1 << 64) >> 64 - mixlm.ONE_BITS
            on = k < len(guessed) and guessed[k][0] == node
            gate = gate_there if on else 0
            guess = (1 if guessed[k][1] else -1) if on else 0
            a, b, c = (float(x) for x in model.tree_weights[gate])
            rows.append((a * p + b * odds(*(float(x[slot]) for x in one_counts), mixlm.ONE_DOUBT) + c * guess, 1 if bit else -1, own, 1 if gate else 0))
        step(rows)
        if word not in known:
            _, bit, slots, own = mixlm.bit_rows([word], model.code)
            rows = []
            for k in range(len(bit)):
                counts = [[float(x) for x in t[:, slot[k]]] for t, slot in zip(model.spelled, slots, strict=True)]
                gate = int(np.searchsorted(mixlm.GATES, sum(counts[-1]), "right"))
                x = sum(int(odds(*c, d) * mixlm.SCALE) / mixlm.SCALE * float(model.byte_weights[gate, j]) for j, (c, d) in enumerate(zip(counts, mixlm.DOUBT, strict=True)))
                rows.append((x, 1 if bit[k] else -1, int(own[k]), 2 + (gate > 2)))
            step(rows)
        before = [one, own_hash(word)]
    return total


def test_mixlm_equals_its_definition(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(20)]
    texts += [texts[0], texts[1], "new" + texts[2], None, "", "odd unseen ÄÖ words " + texts[3][:50], "x" * 3000]
    table = docs(spark, texts)
    model, *_ = mixlm.train(table, common.shared_dir(spark))
    got = {r["doc_id"]: r["score"] for r in mixlm.documents_scored(table).collect()}
    model.prepare()
    assert np.abs(model.tree_weights - mixlm.TREE_WEIGHTS).max() > 0.01
    for k, t in enumerate(texts, 1):
        assert math.isclose(got[k], log_probability_by_definition(model, t or "") / math.log(10), rel_tol=2e-4)


def fitted_by_definition(model, texts):
    """The weights of the tree's gates by Newton's method on the decisions of all texts, one after another and not rounded."""
    model.prepare()
    full, bits = (1 << 64) - 1, (len(model.two[0]) - 1).bit_length()
    m1, m2, m3 = (int(x) for x in (mixlm._M1, mixlm._M2, mixlm._M3))
    known = {w: k for k, w in enumerate(model.words)}
    rows = []
    for text in texts:
        tokens = [known[w] for w in [*mixlm.words_of(text), mixlm.END]]
        _, pairs = model.contexts(np.array(tokens), np.array([0]))
        for leaf, before, pair in zip(tokens, [None, *tokens], pairs.tolist()):
            check, code, guessed = (x[pair >> 64 - bits] for x in model.two)
            code, guessed = int(code) if int(check) == pair >> 64 - bits - 8 & 255 else 0, int(guessed)
            n, m = code & 15, code >> 4
            if code and guessed == leaf:
                n -= 0 < n < 15
            elif code:
                m -= 0 < m < 15
            gate = int(mixlm.gate_of(np.array([n | m << 4]))[0])
            other = [(int(model.node[r]), 1.0 if model.bit[r] else -1.0) for r in range(model.starts[guessed], model.starts[guessed + 1])]
            for k, r in enumerate(range(model.starts[leaf], model.starts[leaf + 1])):
                node, bit = int(model.node[r]), bool(model.bit[r])
                one = 0 if before is None else (before + 1) * m2 * m2 & full
                slot = (one + node * m3 & full) * m1 % (1 << 64) >> 64 - mixlm.ONE_BITS
                z, o = (max(float(model.one[b][slot]) - (bit == b), 0) for b in (0, 1))
                odds = math.log((o + 0.4) / (z + 0.4)) * (z + o) / max(z + o + mixlm.ONE_DOUBT, 1e-9)
                on = gate > 0 and k < len(other) and other[k][0] == node
                rows.append((gate if on else 0, float(model.p[r]), odds, other[k][1] if on else 0.0, 1.0 if bit else -1.0))
    rows, want = np.array(rows), mixlm.TREE_WEIGHTS.astype(float)
    for g in range(len(want)):
        x, sign = rows[rows[:, 0] == g, 1:4], rows[rows[:, 0] == g, 4]
        for _ in range(mixlm.STEPS):
            p = 1 / (1 + np.exp(x @ want[g] * sign))
            slope = x.T @ (sign * p) - mixlm.PRIOR * (want[g] - mixlm.TREE_WEIGHTS[g])
            want[g] += np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + mixlm.PRIOR * np.eye(3), slope), -1, 1)
    return want


def test_mixlm_weights_are_of_all_training_texts(spark):
    """1,000 texts without order, those of the least hash of their id, and others that always go on alike."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(12)]
    ids = [k for k in range(1, 2000) if zlib.crc32(str(k).encode()) % 7 != 2]
    table = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    ids = [r["doc_id"] for r in table.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts = [" ".join(rng.choice(words, 6)) for _ in range(1000)] + [" ".join(words[j % 12] for j in range(k, k + 12)) for k in range(len(ids) - 1000)]
    table = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, lang string")
    model, *_ = mixlm.train(table, common.shared_dir(spark))
    want, some = fitted_by_definition(model, texts), fitted_by_definition(model, texts[:1000])
    assert np.abs(want - some).max() > 0.5
    assert np.abs(model.tree_weights - want).max() < 0.05


def test_mixlm_successors_of_two_words():
    rng = np.random.default_rng(6)
    pair = rng.integers(0, 1 << 44, 60).astype(np.uint64) << np.uint64(20)
    keys = (pair[rng.integers(0, 60, 900)] >> np.uint64(18) << np.uint64(18)) | rng.integers(0, 4, 900).astype(np.uint64)
    bits = 8
    check, code, leaf = mixlm.successors(keys, np.ones(900, np.uint32), bits, 0, 0)
    want = {}
    for key in {int(k) >> 18 for k in keys}:
        n = {}
        for k in keys:
            if int(k) >> 18 == key:
                n[int(k) & 0x3FFFF] = n.get(int(k) & 0x3FFFF, 0) + 1
        most = max(n.values())
        if most >= 2:
            best = min(x for x in n if n[x] == most)
            want.setdefault(key >> 46 - bits, []).append((-most, key << 18 | best, sum(n.values()) - most))
    for slot in range(1 << bits):
        if slot not in want:
            assert code[slot] == 0
        else:
            n, key, others = min(want[slot])
            assert (leaf[slot], check[slot], code[slot]) == (key & 0x3FFFF, key >> 64 - bits - 8 & 255, min(-n, 15) | min(others, 15) << 4)


def test_mixlm_splits_texts_in_arrow():
    rng = np.random.default_rng(7)
    texts = [None, "", " ", "  a", "a  ", "\x0b\x0c\r\n\ta B\u00c4\x1c\x85 \u00a0x ", "\x00escape a\x00b", *("".join(rng.choice(list(" \t\nabAB\u00c9\u3000\x1f"), 30)) for _ in range(200))]
    for column in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string())[1:], pa.array([], pa.string())):
        words, n = mixlm.split(column)
        want = [mixlm.words_of(t or "") for t in column.to_pylist()]
        assert words.to_pylist() == sum(want, []) and n.tolist() == [len(w) for w in want]
        ids, seen = mixlm.WordIds([mixlm.ESCAPE, mixlm.END, b"ab"]), 0
        for part, found, ends, sizes in mixlm.chunked(column, ids):
            names = [mixlm.ESCAPE, mixlm.END, b"ab", *ids.others]
            for k, words in enumerate(want[part]):
                assert [names[x] for x in found[ends[k] : ends[k + 1]]] == [*words, mixlm.END]
                assert (found[ends[k] : ends[k + 1] - 1] != 0).all() and sizes[k] == len(b" ".join([*words, b""])) + 1
                seen += 1
        assert seen == len(want)


def test_mixlm_shared_beginnings_are_looked_up_once():
    """Neighbours' shared bytes are one row with all their times; the sums by slot are those of all words."""
    rng = np.random.default_rng(3)
    for words in (sorted({"".join(rng.choice(list("ab\u00e9"), int(rng.integers(1, 9)))).encode() for _ in range(400)}), [b"b", b"ab", b"b", b"abc"], [b"x" * 3000], []):
        times, code = rng.integers(1, 9, len(words)), mixlm.huffman(np.ones(256))
        bit, slots, n = mixlm.beginnings(words, times, code)
        starts, all_bit, all_slots, _ = mixlm.bit_rows(words, code)
        for size, slot, every in zip(mixlm.TABLES, slots, all_slots, strict=True):
            want = np.bincount(every << 1 | all_bit, np.repeat(times, np.diff(starts)), 2 << size)
            assert (np.bincount(slot << 1 | bit, n, 2 << size) == want).all()
        assert len(bit) == len(all_bit) if len(words) < 10 else len(bit) < 0.6 * len(all_bit)


def test_mixlm_stretches_follow_the_predicted_path():
    """Weights that double make a tree of over 64 decisions; the last of a stretch is the one that parts the paths."""
    counts = np.array([1.0, 1, *(2.0 ** np.arange(90))])
    model = mixlm.Model([mixlm.ESCAPE, mixlm.END, *(b"w%d" % k for k in range(90))], counts, mixlm.huffman(np.ones(256)))
    model.grow()
    assert model.lengths.max() > 64
    path = lambda leaf: [(int(model.node[r]), bool(model.bit[r])) for r in range(model.starts[leaf], model.starts[leaf + 1])]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(92), np.arange(92)))
    code = np.where((a + b) % 5 == 0, 0, 3 | 1 << 4)
    gate, n, right = model.stretches(a, b, code)
    for leaf, other, c, g, k, same in zip(a.tolist(), b.tolist(), code.tolist(), gate.tolist(), n.tolist(), right.tolist(), strict=True):
        assert same == (leaf == other) and g == int(mixlm.gate_of(np.array([c]))[0])
        pairs = list(zip(path(leaf), path(other), strict=False)) if c else []
        on = [x[1] == y[1] for x, y in pairs if x[0] == y[0]]
        assert k == len(on) and all(on[:-1]) and (not on or on[-1] == same)


def test_mixlm_tells_repeated_texts_apart(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(60)]
    texts += texts[:6]
    got = {r["doc_id"]: r["bits_per_byte"] for r in mixlm.documents_scored(docs(spark, texts)).collect()}
    trained = [k for k in range(1, 7) if all(zlib.crc32(str(x).encode()) % 7 != 2 for x in (k, k + 60))]
    assert trained and max(got[k] for k in trained) < min(got[k] for k in range(7, 61))


def test_mixlm_beats_its_base_on_held_out(spark):
    rows = mixlm.documents_scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_mixlm_first_word_sums_to_one():
    """The probabilities of all leaves of the word tree, and of all next bytes, add up to one before anything is learned."""
    counts = np.array([5.0, 3, 100, 7, 1, 1, 40])
    model = mixlm.Model([mixlm.ESCAPE, mixlm.END, b"a", b"b", b"c", b"d", b"e"], counts, mixlm.huffman(np.ones(256)))
    model.spelled, model.one = [np.zeros((2, 1 << b), np.float16) for b in mixlm.TABLES], np.zeros((2, 1 << mixlm.ONE_BITS), np.float32)
    model.two, model.tree_weights, model.byte_weights = (np.zeros(4, np.uint8), np.zeros(4, np.uint8), np.zeros(4, np.int32)), mixlm.TREE_WEIGHTS, mixlm.WEIGHTS
    model.prepare()
    p = [math.exp(model.score(np.array([k]), np.array([0, 1]))[0]) for k in range(7)]
    assert math.isclose(sum(p), 1, rel_tol=1e-5)
    lengths, _, _ = mixlm.huffman(np.arange(256))
    assert math.isclose((0.5 ** lengths.astype(float)).sum(), 1)


def test_urls(spark):
    page = "<html><link rel='canonical' href='{}'></html>"
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f", ""), (2, "https://b.net", ""), (3, "https://b.net/en/", ""), (4, "ftp://x.example.com/de/1", ""), (5, "https://free.org/1", page.format("https://x.example.com/de/1")),
        (6, "https://free.org/2", page.format("https://free.org/1")), (7, "nothing", ""), (8, None, None), (9, "https://other.info/a", ""), (10, "https://www.other.info/a/", page.format("https://y.example.com/de/2")), (11, "https://m.org/fr/", page.format("/alias")),
        (12, "https://m.org/alias", None), (13, "https://y.example.com/de/2", ""),
    ]
    got = {r["page_id"]: r for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2]["path"], got[2]["rule"]) == ("", None) and (got[3]["rule"], got[3]["verdict"]) == ("net/", "block")
    assert [got[k]["verdict"] for k in (4, 5, 6, 9, 10, 11, 12, 13)] == ["block", "block", "block", "block", "block", "allow", "allow", "block"]
    assert got[7]["host"] == got[8]["host"] == "" and got[7]["verdict"] == got[8]["verdict"] == "allow"
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def verdicts_by_brute_force(rows):
    """Union of pages by the urls that urllib resolves; rows are (page_id, url, references)."""
    from urllib.parse import urljoin, urlsplit

    def form(url):
        u = urlsplit(urljoin(url, url))
        return re.sub(r"^(www|m)\.", "", u.netloc.lower()) + re.sub(r"(/|\.html?)$", "", u.path) + ("?" + u.query if u.query else "")

    def rule(url):
        u = urlsplit(url)
        fits = [(len(h + p), v) for h, p, v in urls.RULES if (u.netloc.lower() == h or u.netloc.lower().endswith("." + h)) and u.path.startswith(p)]
        return max(fits)[1] if fits else None

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, url, refs in rows:
        for ref in refs:
            if not re.match(r"(?!https?:)[a-z]+:", ref) and ref and not ref.startswith("#"):
                root[find(form(urljoin(url, ref)))] = find(form(url))
    out = {}
    for page, url, _ in rows:
        near = [rule(u) for _, u, _ in rows if find(form(u)) == find(form(url))]
        out[page] = rule(url) or ("block" if "block" in near and "allow" not in near else "allow")
    return out


def test_urls_follow_references_of_all_kinds(spark):
    kinds = ["<link rel=canonical href='{}'>", '<meta http-equiv="refresh" content="0; url={}">', '<meta property="og:url" content="{}">']
    rows = [
        (1, "https://a.info/x/p.html", ["//b.example.com/de/1"]), (2, "https://b.example.com/de/1", []), (3, "https://a.info/x/q", ["p.html"]), (4, "https://a.info/x/y/r?k=1", ["../q"]),
        (5, "https://a.info/p?id=1", ["https://c.net/"]), (6, "https://a.info/p?id=2", []), (7, "https://a.info/s", ["?id=2", "p?id=1"]), (8, "https://c.net", []), (9, "https://c.net/", []), (10, "http://WWW.c.net/index/", ["/"]),
        (11, "https://d.info/z", ["mailto:x@c.net", "#top", "javascript:void"]), (12, "https://d.info/w/", ["./v", "/u/./t/../z"]), (13, "https://d.info/w/v.html", ["https://x.org/fr/ok"]), (14, "https://x.org/fr/ok", ["https://b.example.com/de/1"]),
        (15, "https://e.info", ["f"]), (16, "https://e.info/f", ["https://y.example.com/de/"]),
    ]
    table = [(page, url, "<html>" + "".join(kinds[(page + k) % 3].format(ref) for k, ref in enumerate(refs)), "x", 7) for page, url, refs in rows]
    # repeated ids, null ids, columns with the names of results
    table += [(1, "https://again.info/", "", "x", 7), (None, "https://b.example.com/de/1", "", "x", 7), (17, "https://again.info", "", "x", 7)]
    got = urls.filtered(spark.createDataFrame(table, "page_id long, url string, html string, alias string, rule int")).collect()
    want = verdicts_by_brute_force(rows)
    assert {r["page_id"]: r["verdict"] for r in got if r["page_id"] in want and "again" not in r["url"]} == want
    assert {r["verdict"] for r in got if "again" in r["url"]} == {want[1]} == {"allow"} and len(got) == 19
    assert [r["verdict"] for r in got if r["page_id"] is None] == ["block"]


def test_winnowing(spark, odd, empty):
    got = {r["doc_id"]: r for r in winnow.fingerprints(odd).collect()}
    texts = [t or "" for t in ODD + ODD]
    for k, t in enumerate(texts, 1):
        after = texts[k % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["fingerprint"] == got[(k + len(ODD) - 1) % len(texts) + 1]["fingerprint"]
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    edited = [t[: len(t) - len(t) // 4] + texts[k % len(texts)][: len(t) // 4] for k, t in enumerate(texts, 1)]
    again = {r["doc_id"]: r["fingerprint"] for r in winnow.fingerprints(docs(spark, edited)).collect()}
    hashes = lambda shown: {x.split("@")[0] for x in shown.split()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k in range(1, len(texts) + 1):
        assert got[k]["edited_fingerprint"] == again[k]
        mine, after = hashes(got[k]["fingerprint"]), hashes(got[k % len(texts) + 1]["fingerprint"])
        assert math.isclose(got[k]["near_edited"], like(mine, hashes(again[k]))) and math.isclose(got[k]["near_next"], like(mine, after))
    assert winnow.fingerprints(empty).count() == 0
    alone = winnow.fingerprints(docs(spark, ["one two three four five six seven"])).first()
    assert alone["near_next"] == 1


def test_winnowing_follows_ids_wherever_they_lie(spark, monkeypatch):
    """Ids far apart, repeated, negative and null, in many small buckets."""
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 3)
    ids = [None, None, -(1 << 61), -5, *range(0, 300, 7), 43, 44, 45, 46, 1000, 1000, 1 << 60]
    rows = [(k, f"text of row {n} " * (1 + n % 5)) for n, k in enumerate(ids)]
    got = winnow.fingerprints(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_id = sorted((k, t) for k, t in rows if k is not None and k != 1000)
    found = {r["doc_id"]: r["edited_sha256"] for r in got}
    for (k, t), (after, u) in zip(by_id, by_id[1:], strict=False):
        if after != 1 << 60:
            assert found[k] == hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()


def test_winnowing_chooses_the_rightmost_least_of_each_window(spark):
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice([f"w{k}" for k in range(12)], 200))
    df = spark.createDataFrame([(text,)], "text string")
    keys = winnow.fingerprinted(df, "text", "f", 2, 6).selectExpr(f"transform(f, x -> shiftrightunsigned(x, {winnow.POSITION_BITS})) h", f"transform(f, x -> {winnow.LAST} - (x & {winnow.LAST})) p").first()
    tokens = text.split()
    grams = [int(r[0]) for r in spark.createDataFrame([(k, tokens[k], tokens[k + 1]) for k in range(len(tokens) - 1)], "k int, a string, b string").selectExpr("k", "shiftrightunsigned(xxhash64(array(xxhash64(a), xxhash64(b))), 26) g").orderBy("k").select("g").collect()]
    want = []
    for s in range(len(grams) - 5):
        least = min(grams[s : s + 6])
        at = max(k for k in range(s, s + 6) if grams[k] == least)
        if (least, at) not in want:
            want.append((least, at))
    assert list(zip(keys["h"], keys["p"], strict=True)) == want


def test_mixing(spark, odd, empty):
    weights = {"a": 5, "b": 3, "c": 2}
    slots = mixing.one_period(weights)
    assert sorted(x for s in slots.values() for x in s) == list(range(10))
    for s, w in weights.items():
        for t in range(11):
            assert abs(sum(x < t for x in slots[s]) - w * t / 10) < 1
    got = mixing.scheduled(odd, {"s": 2}, block_rows=4).collect()
    assert len(got) == 18 and sorted({r["slot"] for r in got}) == list(range(len({r["slot"] for r in got})))
    assert all(len({r["source"] for r in got if r["slot"] == t}) == 1 for t in {r["slot"] for r in got})
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(odd).columns == odd.columns
    plan = mixing.phases({"a": 7, "b": 30, "c": 1}, weights)
    taken = []
    for s, first, end, start, share, period, at in plan:
        taken += [start + (k - first) // share * period + at[(k - first) % share] for k in range(first, end)]
    assert sorted(taken) == list(range(38))


def slots_by_brute_force(blocks, weights):
    """The source of each slot: earliest deadline first over the released blocks, in exact fractions."""
    done, out = dict.fromkeys(blocks, 0), []
    while left := [s for s in blocks if done[s] < blocks[s]]:
        total, took = sum(Fraction(weights[x]) for x in left), dict.fromkeys(left, 0)
        share = {s: Fraction(weights[s]) / total for s in left}
        for slot in itertools.count():
            free = [s for s in left if math.floor(took[s] / share[s]) <= slot]
            s = min(free, key=lambda s: (math.ceil((took[s] + 1) / share[s]), -share[s], str(s)))
            out.append(s)
            took[s] += 1
            done[s] += 1
            if done[s] == blocks[s]:
                break
    return out


def test_mixing_holds_exact_weights():
    for blocks, weights in (({"a": 40, "b": 9, "c": 9, None: 1}, {"a": 2.5, "b": 0.3, "c": 1 / 3, None: 0.001}), ({"a": 3}, {"a": 0.1}), ({}, {})):
        want = slots_by_brute_force(blocks, weights)
        got = [x for sources, _, _ in mixing.simulated(blocks, weights, piece=7) for x in sources]
        assert got == want[: len(got)] and len(set(want[len(got) :])) <= 1
    # twenty sources, one with a third of over 100,000 rows, one with a share below a thousandth
    sizes = {"large": 600_000, "tiny": 1, **{f"s{k}": 60_000 + 1000 * k for k in range(18)}}
    weights = {s: float(n) ** mixing.EXPONENT for s, n in sizes.items()}
    total, took, slot = sum(weights.values()), dict.fromkeys(sizes, 0), 0
    for sources, ks, first in mixing.simulated({s: -(-n // 16) if s != "tiny" else 90 for s, n in sizes.items()}, weights, piece=5000):
        assert first == slot
        for s, k in zip(sources, ks, strict=True):
            assert k == took[s]
            took[s] += 1
            slot += 1
            assert abs(took[s] - slot * weights[s] / total) < 1
            if slot % 500 == 0:
                assert all(abs(took[x] - slot * weights[x] / total) < 1 for x in took)
        if slot >= 60_000:  # no source has run out yet
            break


def test_mixing_of_any_number_of_sources(spark):
    table = spark.range(3000).selectExpr("id as doc_id", "case when id < 1500 then 'big' else concat('s', id % 700) end as source")
    got = mixing.positioned(table, block_rows=2).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    blocks = {s: -(-n // 2) for s, n in sizes.items()}
    slots = {r["slot"]: r["source"] for r in got}
    assert len(got) == len({r["position"] for r in got}) == 3000 and len(blocks) == 701 and sorted(slots) == list(range(sum(blocks.values())))
    want = slots_by_brute_force(blocks, {s: float(n) ** 0.5 for s, n in sizes.items()})
    assert [slots[k] for k in range(len(want))] == want
    few = mixing.scheduled(table.where("doc_id < 1900"), {"big": 1.5, "s100": 2000.25}, block_rows=2).collect()
    assert sorted({r["slot"] for r in few}) == list(range(len({(r["source"], r["block"]) for r in few})))


def tune(seed, seconds, rate=8000):
    """Random chords, a quarter of a second each, as 8-bit samples."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    notes = 110 * 2 ** (rng.integers(0, 48, (int(seconds * 4) + 1, 3)) / 12)
    sound = sum(np.sin(2 * np.pi * notes[(t * 4).astype(int), k] * t) for k in range(3))
    return np.clip(128 + 30 * sound + rng.normal(0, 2, len(t)), 0, 255).astype(np.uint8)


def test_audio_parts_semitones():
    t = np.arange(audio.SOUND.rate * 2) / audio.SOUND.rate
    for hertz, want in ((110.0, 0), (116.54, 1), (130.81, 3), (233.08, 1), (440.0, 0), (1318.5, 7)):
        assert audio.chroma(60 * np.sin(2 * np.pi * hertz * t)).mean(0).argmax() == want
    with pytest.raises(ValueError):
        audio.Pitch(8000, 256, 64, 110.0, 3520.0).classes  # noqa: B018


def test_audio_areas_and_histogram_by_brute_force():
    rows = audio.chroma(tune(1, 4).astype(float) - 128)
    got = audio.fingerprint(tune(1, 4).tobytes())
    for t in range(0, len(got), 7):
        bits = 0
        for kind, y, classes, frames in audio.FILTERS:
            block = rows[t : t + frames, y : y + classes].astype(float)
            half, high, third = frames // 2, classes // 2, frames // 3
            a = {0: block[:half].sum(), 1: block[:, :high].sum(), 2: block[:half, :high].sum() + block[half:, high:].sum(), 3: block[third : 2 * third].sum()}[kind]
            value = math.log1p(a) - math.log1p(block.sum() - a)
            bits = bits << 2 | int(audio.GRAY[int(value > -audio.STEP) + int(value > 0) + int(value > audio.STEP)])
        assert bits == got[t]
    rng = np.random.default_rng(2)
    for a, b in ((rng.integers(0, 9, 60), rng.integers(0, 9, 45)), (np.zeros(300, int), np.zeros(200, int)), (np.r_[np.zeros(150, int), rng.integers(0, 4, 80)], np.r_[rng.integers(0, 4, 30), np.zeros(120, int)])):
        a, b = a.astype(np.uint32), b.astype(np.uint32)
        want = np.zeros(len(a) + len(b) - 1, int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                want[i - j + len(b) - 1] += x == y
        assert (audio.votes(a, b) == want).all()
    # a part of a long recording that repeats the same integers in other orders
    same = np.concatenate([np.random.default_rng(k).permutation(400) for k in range(3)]).astype(np.uint32)
    assert audio.align(same[800:], same) == (-800, 0.0)


def test_audio(spark, odd, empty):
    pcm = tune(0, 12)
    whole, cut = audio.fingerprint(pcm.tobytes()), audio.fingerprint(pcm[8 * audio.SOUND.hop :].tobytes())
    offset, error = audio.align(whole, cut)
    assert offset == 8 and error < 0.02
    assert audio.align(whole, whole) == (0, 0.0) and audio.align(whole[:0], whole) == (0, 1.0)
    got = {r["doc_id"]: r for r in audio.recordings(odd).collect()}
    assert len(got) == 18 and got[1]["n_places"] == 0 and all(r["next_error"] is not None for r in got.values())
    assert all(got[k]["fingerprint_sha256"] == got[k + 9]["fingerprint_sha256"] for k in range(1, 10))
    assert audio.recordings(empty).count() == 0
    rows = audio.recordings(spark.createDataFrame([(None, "x y"), (None, None), (3, "z"), (3, "zz")], "doc_id long, text string")).collect()
    assert len(rows) == 4 and sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 3, 3]


def test_audio_search_finds_excerpts(spark):
    """Excerpts, noisier and quieter copies of other recordings are found as a search of all pairs finds them."""
    rng = np.random.default_rng(3)
    sounds = {k: tune(k, 8) for k in range(1, 13)}
    queries = {}
    for k in range(1, 9):
        part = sounds[k][2 * 4096 : 2 * 4096 + 5 * 8000].astype(float) - 128
        queries[50 * k] = np.clip(128 + part * (0.5 + 0.1 * (k % 3)) + rng.normal(0, 1 + k % 3, len(part)), 0, 255).astype(np.uint8)
    table = spark.createDataFrame([(k, bytes(x)) for k, x in {**sounds, **queries}.items()] + [(9000, b""), (9001, None), (9002, b"\x80" * 40000), (9003, b"\x80" * 40000)], "doc_id long, audio binary")
    prints = audio.with_fingerprints(table, "audio")
    got = {(r["query"], r["id"]): (r["offset"], r["error"]) for r in audio.matches(prints, prints.where("doc_id % 50 = 0 and doc_id < 9000")).collect()}
    held = {r["doc_id"]: np.frombuffer(r["fingerprint"], np.uint32) for r in prints.collect()}
    want = searched_by_brute_force(held, list(queries))
    assert got == want and all((50 * k, k) in got for k in range(1, 9))
    assert {want[50 * k, k][0] for k in range(1, 9)} == {-16}


def overlap(a, b, offset):
    return min(len(a) - max(offset, 0), len(b) - max(-offset, 0))


def searched_by_brute_force(held, queries):
    """All matches: an equal integer at the offset that an alignment chooses, LEAST places or more, few differing bits."""
    out = {}
    for q in queries:
        for k, b in held.items():
            if k != q and len(held[q]) and len(b):
                offset, error = audio.align(held[q], b)
                same = len(held[q]) == len(b) and (held[q] == b).all()
                if same or (audio.votes(held[q], b).max() and error <= audio.MOST_ERROR and overlap(held[q], b, offset) >= audio.LEAST):
                    out[q, k] = (offset, error)
    return out


def test_audio_search_is_whole_on_documents(spark):
    """Recall against all pairs is 1, by every class of overlap: the search is exact."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("audio"))
    prints = audio.with_fingerprints(docs, "audio", pitch=audio.SHORT).drop("audio").cache()
    held = {r["doc_id"]: np.frombuffer(r["fingerprint"], np.uint32) for r in prints.collect()}
    want = searched_by_brute_force(held, [k for k in held if k % 50 == 0])
    first = {}
    for k in sorted(held):
        first.setdefault(held[k].tobytes(), k)
    got = {(r["query"], r["id"]): (r["offset"], r["error"]) for r in audio.matches(prints, prints.where("doc_id % 50 = 0")).collect() if len(held[r["query"]])}
    # copies are one, by the least id; a query's own class has the query itself in it
    classes = {(q, first[held[k].tobytes()]): v for (q, k), v in want.items()}
    assert {p: v for p, v in got.items() if p[0] != p[1]} == {p: v for p, v in classes.items() if p[0] != p[1]} and len(classes) > 3


@pytest.mark.parametrize("votes, many", [(1 << 20, 1 << 23), (50, 1 << 23), (50, 30)])
def test_audio_blocks(monkeypatch, votes, many):
    monkeypatch.setattr(audio, "VOTES", votes)
    monkeypatch.setattr(audio, "MANY", many)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    held = {k: base[10 * k : 10 * k + 40].copy() for k in range(20)} | {30: np.zeros(60, np.uint32), 31: np.zeros(45, np.uint32), 32: np.zeros(0, np.uint32), 33: base[:3], 34: rng.integers(0, 3, 50).astype(np.uint32), 35: rng.integers(0, 3, 70).astype(np.uint32)}
    for k in range(0, 20, 3):
        held[k][::2] ^= np.uint32(1 << (k % 32))
    queries = [0, 7, 15, 30, 32, 33, 34]
    names = list(held)
    block = audio.Block.made(queries, [held[q].tobytes() for q in queries])
    got = {(queries[q], names[r]): (offset, error) for r, q, offset, error in zip(*(x.tolist() for x in audio.found_in(block, [held[k].tobytes() for k in names], audio.LEAST, audio.MOST_ERROR)), strict=True)}
    want = searched_by_brute_force(held, queries)
    assert {p: v for p, v in got.items() if p[0] != p[1]} == {p: v for p, v in want.items() if overlap(held[p[0]], held[p[1]], v[0]) >= audio.LEAST} and len(want) > 10
    assert not audio.found_in(audio.Block.made([], []), [held[0].tobytes()], 8, 0.15)[0].size


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_equals_sql(spark, name):
    from oracle import compare

    assert compare(spark, registered.queries()[name], registered.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(registered.queries().keys() - registered.oracle_sql().keys() - {"pipeline"}))
def test_runs_on_every_row(spark, name):
    assert registered.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    columns = docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").columns
    table = odd.select(*columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == columns
    none = odd.select(*columns).where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_pipeline_equals_brute_force(spark):
    """Stage by stage in plain Python on the whole small table; the classifier's decisions are those of its operator."""
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = sorted((r["doc_id"], r["text"]) for r in quality.score(table, model).where("predicted = 1").collect())
    kept = sorted(kept_by_brute_force(kept).items())
    classes = components_by_brute_force([t for _, t in kept], 5, 80)
    kept = {i: t for k, (i, t) in enumerate(kept, 1) if classes[k][1] == k}
    want, rows = encoding(), corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: want.encode_ordinary(t) for i, t in kept.items()} and len(rows) == len(kept)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows) and [r["position"] for r in rows] == sorted(r["position"] for r in rows)


def test_pipeline_stages_of_odd_rows(spark):
    """Null ids, texts and sources, repeated rows and empty texts pass through every stage as its docstring says."""
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    text = "a line that is long enough to count\nand another line that is as long as it"
    rows = [(1, text, "en", None, 9), (1, text, "en", None, 9), (2, None, None, "a", 0), (None, text, "en", "a", 9), (3, "", "en", "b", 0), (4, text + " more words", None, "b", 9), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, columns)
    assert corpus_pipeline.keep_quality(spark, table, SF).columns == table.columns
    lines_ = corpus_pipeline.drop_repeated_lines(spark, table, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in lines_) == sorted([(1, text), (1, text), (2, ""), (0, text), (3, ""), (4, "and another line that is as long as it more words"), (0, "")])
    assert all(r["n_chars"] == len(r["text"]) for r in lines_)
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.keep_one_of_near_copies(spark, table, SF).collect()) == [0, 0, 1, 1, 2, 3]
    assert corpus_pipeline.mix_sources(spark, table, SF).count() == 7
    tokens = corpus_pipeline.tokenize(spark, table, SF).collect()
    assert len(tokens) == 7 and all(r["n_tokens"] == len(r["ids"]) for r in tokens) and len({r["position"] for r in tokens}) == 7


def test_pipeline_keeps_the_order_of_mixing(spark):
    import corpus_pipeline

    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # so that each stage writes several files
    try:
        out = corpus_pipeline.run(spark, SF)
        rows = out.collect()
    finally:
        spark.conf.unset(setting)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    blocks, block = {s: -(-n // mixing.BLOCK_ROWS) for s, n in sizes.items()}, mixing.BLOCK_ROWS
    want, taken = [], dict.fromkeys(sizes, 0)
    for s in slots_by_brute_force(blocks, {s: float(n) ** 0.5 for s, n in sizes.items()}):
        n = min(block, sizes[s] - taken[s])
        want += [s] * n
        taken[s] += n
    assert [r["source"] for r in rows] == want
    files = [[r["position"] for r in spark.read.parquet(f).collect()] for f in sorted(out.inputFiles())]
    assert len(files) > 1 and [p for f in files for p in f] == [r["position"] for r in rows]
