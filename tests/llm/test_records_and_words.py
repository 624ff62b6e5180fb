"""Fill-in-middle, WARC archives and spelling variants against brute force."""

import base64
import glob
import gzip
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hindcast.llm import fim, variants, warc
from hindcast.llm.common import shared_dir, written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UNIT = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
TEXTS = [None, "", " ", "one", " one ", "one two  three\n\nfour ", "\t\ttabs\tand\x0bmore\x0c", "a <P> marker", "<S>", "x<M>y", "almost <P >", "ÄÖ ß 漢字 \U0001f600 end", "same text here", "word " * 3000, "x" * 5000, " \n" * 500]


def cut_by_brute_force(doc_id, text, seed=42, cut=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rows = [(k, t, "clash", 7) for k, t in enumerate(TEXTS * 6)] + [(None, t, "clash", 7) for t in TEXTS] + [(3, t, "clash", 7) for t in TEXTS] + [(4, "same text here", "clash", 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, __n long")
    for options in ({}, {"seed": 7, "cut": 100, "suffix_first": 0}):
        got = fim.transformed(docs, **options)
        assert got.columns == ["doc_id", "text", "__n", "n", "form", "prefix_chars", "middle_chars", "output"]
        back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert len(back) == len(rows)
        forms = set()
        for r in back:
            want = cut_by_brute_force(r["doc_id"], r["text"], *options.values())
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
            assert r["back"] == r["text"]
            forms.add(r["form"])
        assert forms == ({"plain", "spm", "psm"} if not options else {"plain", "psm"})
        assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in back) == sorted((i is None, i, t or "") for i, t, _, _ in rows)
    assert fim.transformed(docs.where("1 = 0")).count() == 0


def test_fill_in_middle_deals_the_texts_out_once(spark):
    plan = fim.digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.findall(r"RepartitionByExpression.*\n.*Project \[(.*?)\]\n.*Relation", plan)
    assert len(re.findall("RepartitionByExpression", plan)) == 3 and "Filter" not in "".join(dealt)


PAGES = [
    (5, "http://a/1", "<html>one</html>"),
    (2, "http://a/2", "<html>one</html>"),
    (9, None, "<html>one</html>"),
    (None, "http://a/3", "<html>one</html>"),
    (1, "http://a/4", None),
    (3, "http://a/5", ""),
    (4, "http://a/\r\nWARC-Type: resource", "two\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"),
    (6, "", "ends\r\n"),
    (7, "http://ä/é", "\r\n\r\n"),
    (8, "http://a/8", "漢字 \U0001f600" * 5000),
    (10, "http://a/10", "漢字 \U0001f600" * 5000),
    (11, "http://a/11", "unique"),
    (11, "http://a/11", "unique"),
    (11, "http://a/other", "other"),
]


def resolved_by_brute_force(pages, least=0):
    order = sorted(pages, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for page, _, html in order:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = data in first and len(data) >= least
        out.append((page, len(data), digest, "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_warc_revisits(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    assert as_rows(warc.archived(pages.repartition(3), least)) == resolved_by_brute_force(PAGES, least)


def test_warc_of_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_files_are_records_with_headers_that_hold(spark):
    root = shared_dir(spark)
    warc.write(warc.records(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)), f"{root}/raw")
    (file,) = glob.glob(f"{root.removeprefix('file://')}/raw/*.gz")
    raw, seen, at = gzip.open(file).read(), [], 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        fields = warc.header_of(raw[at:head])
        block = raw[head + 4 : head + 4 + int(fields["content-length"])]
        assert fields["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        seen.append(block.partition(b"\r\n\r\n")[2])
        at = head + 4 + len(block)
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert seen == [(h or "").encode() for _, _, h in PAGES]
    back = warc.read(spark, f"{root}/raw", payloads=True).collect()
    assert [bytes(r["payload"]) for r in back] == seen and len({r["record_id"] for r in back}) == len(PAGES)
    assert back[6]["target_uri"] == "http://a/%0D%0AWARC-Type: resource" and back[2]["target_uri"] is None


def test_warc_resolves_archives_that_have_revisits(spark):
    root = shared_dir(spark)
    warc.write(warc.records(spark.createDataFrame(PAGES, "page_id long, url string, html string")), f"{root}/raw")
    for k, (source, target) in enumerate((("raw", "once"), ("once", "twice"))):
        warc.deduplicated(spark, f"{root}/{source}", f"{root}/{target}", f"{root}/{k}")
    once, twice = (warc.read(spark, f"{root}/{x}") for x in ("once", "twice"))
    assert not {r[0] for r in once.select("record_id").collect()} & {r[0] for r in twice.select("record_id").collect()}
    assert as_rows(warc.resolved(spark, f"{root}/twice", f"{root}/r2")) == as_rows(warc.resolved(spark, f"{root}/once", f"{root}/r1")) == resolved_by_brute_force(PAGES)


def test_warc_refuses_broken_archives(spark):
    root = shared_dir(spark)
    warc.write(warc.records(spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1)), f"{root}/raw")
    (file,) = glob.glob(f"{root.removeprefix('file://')}/raw/*.gz")
    raw = gzip.open(file).read()
    for name, bad in (("short", raw[:-12]), ("changed", raw.replace(b"<html>one", b"<html>two"))):
        target = f"{root.removeprefix('file://')}/{name}"
        os.makedirs(target)
        with gzip.open(f"{target}/a.gz", "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match="archive ends within|isn't the one of its digest"):
            warc.read(spark, f"{root}/{name}").collect()


def test_joining_to_one_splits_common_keys(spark):
    many = spark.range(400).select("id", F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"))
    few = spark.createDataFrame([(1, "a"), (350, "b"), (999, "c")], "k long, v string")
    got = {r["id"]: r["v"] for r in warc.to_one(many, few, ["k"], shares=4).collect()}
    assert got == {k: "a" if k < 300 else "b" if k == 350 else None for k in range(400)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"WARC/1.1\r\n", b"x"]), max_size=8).map(b"".join), max_size=6))
def test_records_are_put_together_from_any_parts(blocks):
    file = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in blocks)
    parts = file.split(b"\r\n\r\n")
    assert [b for _, b in warc.parsed(iter(parts))] == blocks


def neighbours_by_brute_force(word, letters):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in letters}
    out |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    return out - {word}


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_neighbourhoods_are_whole_and_distinct(monkeypatch, held):
    monkeypatch.setattr(variants, "HELD", held)
    letters = "abcé"
    codes = lambda words: np.array([[ord(c) for c in w] for w in words], np.uint32)
    for words in (["aab", "abc", "ccc", "béb"], ["a", "b"], ["aabbaabbcc"]):
        found = {k: [] for k in range(len(words))}
        for rows, hashes in variants.neighbours(codes(words), codes(letters)[:, 0]):
            for row, h in zip(rows.tolist(), hashes.tolist(), strict=True):
                found[row].append(h)
        for k, word in enumerate(words):
            want = neighbours_by_brute_force(word, letters)
            assert len(found[k]) == len(want)
            assert set(found[k]) == {int(variants.hashed(codes([w]))[0]) if w else 0 for w in want}


def forms_by_brute_force(n, ratio=5):
    letters = {c for w in n for c in w}
    out = {}
    for w in n:
        near = [x for x in neighbours_by_brute_force(w, letters) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= ratio * n[w] else None, len(near))
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in out.items()}


def words_by_brute_force(rows, one_in=199):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def word_rows():
    stems = ["kettle", "kettles", "settle", "settles", "nettle", "Garden", "gardens", "gardén", "ÀÉÎÕÜß", "àéîõüß", "aaaaaa", "aaaaaaa", "aaaaabaa"]
    rows = [(k, " ".join(s for j, s in enumerate(stems) for _ in range(5 ** (1 + (j + k) % 3)))) for k in range(3)]
    long = "q" * 3000 + "z" * 3000
    return rows + [(7, f"{long} {long[1:]} {long[:-1]}y " * 5), (8, f"{long} " * 40), (None, "kettlle " * 9), (None, None), (9, ""), (10, "short six666 " * 20), (10, "short six666 " * 20)]


def test_spelling_variants(spark):
    rows = word_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    for one_in in (None, 3, 199):
        want = forms_by_brute_force(words_by_brute_force(rows, one_in))
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.forms(variants.words(docs, one_in)).collect()}
        assert got == want and any(v[0] for v in want.values())
    assert variants.forms(variants.words(docs.where("1 = 0"))).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        variants.forms(variants.words(docs), ratio=1)


def test_spelling_variants_with_a_bitmap_that_is_full(spark, monkeypatch):
    monkeypatch.setattr(variants, "MOST_BITS", 15)
    monkeypatch.setattr(variants, "SPARSE", 0)
    rows = [(k, t) for k, t in enumerate(["kettle settle nettle kettles mettle metals petals"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.forms(variants.words(docs)).collect()}
    assert got == forms_by_brute_force(words_by_brute_force(rows, None))


def test_forms_are_followed_to_the_last_one(spark):
    chain = ["aaaaaa" + "b" * k for k in range(8)]
    n = {w: 5 * 5**k for k, w in enumerate(chain)}
    vocabulary = spark.createDataFrame([*n.items(), (None, 3)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in variants.forms(vocabulary).collect()}
    assert got == {w: (chain[k + 1] if k < 7 else None, chain[-1]) for k, w in enumerate(chain)}


def test_bitmap_has_every_hash(spark):
    root = shared_dir(spark)
    known = written(variants.with_hash(spark.range(500).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("word"), F.lit(9).cast("long").alias("n"))), root, "v")
    bits = variants.bitmap(known, 20)
    slots = {(r["h"] & (2**64 - 1)) >> 44 for r in known.collect()}
    assert {int(k) for k in np.nonzero(np.unpackbits(bits, bitorder="little"))[0]} == slots
