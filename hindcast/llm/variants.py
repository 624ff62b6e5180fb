"""Spelling variants: words one edit apart, and the commoner form that each rare one belongs to.

For every word of the vocabulary its full neighbourhood is generated: all distinct deletions, replacements and insertions
over the letters that the vocabulary has. A candidate that is itself a word is a near word; it is one by construction, so no
distance is computed to find it. Candidates are emitted as 64-bit hashes, which follow from sums over the word's letters
without spelling the candidate out: a run of 100,000 letters has 18 million neighbours of that length. A bitmap of the
vocabulary's hashes drops in the task nearly all candidates that are no word, the others are joined to the vocabulary by
hash, and the few pairs that are left are held against chance collisions of the hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import forget, shared_dir, small_batches, written
from hindcast.llm.urls import LOWER, UPPER

LETTERS = r"A-Za-zÀ-ÿ"
#: Letters of a word, and times that it must occur.
SHORTEST, RAREST = 6, 5
#: A word's form occurs at least so many times as often.
RATIO = 5
#: Bits of the bitmap for each word, as a power of two, and the most bits at all (32 MB); beyond them more candidates pass it.
SPARSE, MOST_BITS = 7, 28
#: Candidates that are held at once.
HELD = 1 << 20
#: The odd base of the hash's powers and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words(docs: DataFrame, one_in: int | None = None, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of `shortest` letters or more that occur `rarest` times or more.

    With one_in, a run loses a letter where that number divides its crc32 with the document's id before it, as a fixed share
    of misspellings. A null text has no word, a null id is empty. Counts are summed in each task before they are shuffled.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), run.alias("__run"))
    lower = F.lower("__run")
    # lower() is quick but also changes letters beyond Z
    word = F.when(lower == F.col("__run"), F.col("__run")).otherwise(F.translate("__run", UPPER, LOWER))
    found = found.select("__id", word.alias("word"))
    if one_in:
        found = found.withColumn("__h", F.crc32(F.concat("__id", F.lit(":"), "word").cast("binary")))
        at = (F.col("__h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.select(F.when(F.col("__h") % one_in == 0, less).otherwise(F.col("word")).alias("word"))
    return found.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)


def mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point, well spread."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The base's powers 0 to n - 1, modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), BASE, np.uint64)]), dtype=np.uint64)[:n]


def hashed(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of code points: the sum of value times power of place."""
    with np.errstate(over="ignore"):
        return (mixed(codes) * powers(codes.shape[1])).sum(1, dtype=np.uint64)


def neighbours(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all distinct deletions, replacements and insertions of words of one length, in blocks of places.

    Of edits with one result, in a run of equal letters, only the first is made; so no result comes twice.
    """
    n, length = codes.shape
    with np.errstate(over="ignore"):
        base, inverse, power = np.uint64(BASE), np.uint64(INVERSE), powers(length + 1)
        own, value = mixed(codes) * power[:length], mixed(letters)
        before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(own, axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1:]
        anew = np.concatenate([np.ones((n, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)
        row, _ = np.nonzero(anew)
        yield row, (before[:, :-1] + (whole - before[:, 1:]) * inverse)[anew]
        step = max(1, HELD // max(1, n * len(letters)))
        for a in range(0, length + 1, step):
            b = min(a + step, length)
            placed = value[None] * power[a : a + step, None]  # (places, letters)
            if b > a:
                found = (whole - own[:, a:b])[:, :, None] + placed[None, : b - a]
                new = codes[:, a:b, None] != letters
                yield np.nonzero(new)[0], found[new]
            c = min(a + step, length + 1)
            found = (before[:, a:c] + (whole - before[:, a:c]) * base)[:, :, None] + placed[None, : c - a]
            new = np.ones(found.shape, bool)
            first = max(a, 1)
            new[:, first - a :] = codes[:, first - 1 : c - 1, None] != letters
            yield np.nonzero(new)[0], found[new]


def by_length(found: list[str], letters: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, codes) of words grouped by length, each group cut so that its neighbourhoods are about HELD or one word's."""
    lengths = np.array([len(w) for w in found])
    for length in np.unique(lengths).tolist():
        at, most = np.nonzero(lengths == length)[0], max(1, HELD // max(1, length * letters))
        for k in range(0, len(at), most):
            part = at[k : k + most]
            yield part, np.frombuffer("".join(found[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), length)


def with_hash(vocabulary: DataFrame) -> DataFrame:
    """(word, n, h)"""
    small_batches(vocabulary.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, np.uint64)
            for at, codes in by_length(batch.column(0).to_pylist()):
                h[at] = hashed(codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h.view(np.int64))], names=["word", "n", "h"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, h long")


def bitmap(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value that the highest `bits` bits of a hash can have, set where a word has it: 2^bits / 8 bytes at most."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    pieces = vocabulary.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(slot % (1 << 15)).alias("set"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in pieces.toLocalIterator():
        out[row["at"] * 4096 : row["at"] * 4096 + 4096] = np.frombuffer(row["set"], np.uint8)
    return out


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words that differ by exactly one edit. vocabulary is (word, n, h), written."""
    spark = vocabulary.sparkSession
    n = vocabulary.count()
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(n + 1)) + SPARSE))
    # letters are bounded by the pattern, whatever the number of words
    letters = [r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]
    shared = spark.sparkContext.broadcast((np.array(sorted(map(ord, letters)), np.uint32), bitmap(vocabulary, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = shared.value
        for batch in batches:
            found = batch.column(0).to_pylist()
            rows, hashes = [], []
            for at, codes in by_length(found, len(letters)):
                for row, h in neighbours(codes, letters):
                    slot = h >> np.uint64(64 - bits)
                    kept = (known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    rows.append(at[row[kept]])
                    hashes.append(h[kept])
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(hashes).view(np.int64))], names=["word", "n", "h"])

    candidates = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, h long")
    pairs = candidates.join(vocabulary.select("h", F.col("word").alias("other"), F.col("n").alias("other_n")), "h")
    # two words of one hash by chance: in words of natural length about one pair in 2^64 / (words * candidates)
    return pairs.where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def forms(vocabulary: DataFrame, ratio: int = RATIO, root: str | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n).

    n_near counts near words. form is the near word that occurs most (of equals the first in code-point order) if it occurs
    `ratio` times as often or more, else null. root follows forms to the last one, a word without a form is its own. As
    counts grow by the ratio with each step, the longest chain has a known bound, and each round of joins doubles the steps.
    Null words are left out; an empty vocabulary gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a ratio of 2 or more keeps forms from going round")
    spark = vocabulary.sparkSession
    root = root or shared_dir(spark)
    known = written(with_hash(vocabulary.where("word is not null")), root, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    found = written(near(known).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), root, "near")
    out = known.drop("h").join(found, "word", "left").withColumn("form_n", -F.col("best.less"))
    out = out.withColumn("form", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("best.form")))
    out = written(out.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")), root, "forms")
    forget(spark, root, "words", "near")
    least, most = out.agg(F.min("n"), F.max("n")).first()
    steps = math.floor(math.log(most / least, ratio) + 1e-9) if least else 0
    up = out.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = written(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), root, f"roots-{k}")
        forget(spark, root, f"roots-{k - 1}")
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, one_in: int = 199) -> DataFrame:
    """The forms of all words of the texts, of which one in `one_in` lost a letter."""
    return forms(words(docs, one_in))


SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i::ubigint], list_transform(range(8), lambda j: 0::ubigint)), lambda c, j: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end)) as t
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents
), counted as (
  select w, hex(doc_id || ':' || w) as x, count(*) as n from runs where length(w) >= 6 group by 1, 2
), hashed as (
  select w, n, xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(length(x) // 2), lambda k: cast('0x' || substr(x, 2 * k + 1, 2) as ubigint))), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint]))) as h from counted, crc
), v as (
  select word, sum(n)::bigint as n from (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, n from hashed) where length(word) >= 6 group by 1 having sum(n) >= 5
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), near as (
  select distinct a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select a.word, a.n, v.word, v.n from cut a join v on a.d = v.word
  union select v.word, v.n, a.word, a.n from cut a join v on a.d = v.word
), best as (
  select word, any_value(n) as n, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by 1
), formed as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * v.n then other end as form, case when other_n >= 5 * v.n then other_n end as form_n from v left join best using (word)
), up as (
  select word, word as root from formed where form is null union all select f.word, up.root from up join formed f on f.form = up.word
)
select word, form, root, n, n_near, form_n from formed join up using (word)
"""
