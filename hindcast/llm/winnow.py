"""Document fingerprints by winnowing, in DataFrame functions only.

A text's tokens are its runs of non-space characters, cut every TOKEN characters. Every K tokens in a row are hashed; of
each window of W such hashes the least is chosen, the rightmost of equals, and kept with its position. Two texts that
share a passage of K + W - 1 tokens or more (cut alike) share a chosen hash. A text of fewer tokens than K has the
hash of them all, an empty or blank one has no hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W, TOKEN = 5, 16, 12
#: A chosen hash and its position share a long: 38 bits of hash above 25 bits that hold the distance from the last position.
POSITION_BITS = 25
LAST = (1 << POSITION_BITS) - 1
#: Rows a bucket of neighbouring ids should have, and the most buckets there are; their first ids are broadcast (24 bytes each).
BUCKET_ROWS, MOST_BUCKETS = 100, 1 << 20
#: Stretches of as many rows each that the ids are cut into first, by approximate quantiles.
STRETCHES = 256


def fingerprinted(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """df with `out`: the chosen (hash, position) pairs of the text, each one long, in order of position; null is empty.

    Each step is a column of its own that the next uses more than once, so that no step is computed again.
    """
    tokens, hashes, grams, keys = (f"__{out}_{x}" for x in ("tokens", "hashes", "grams", "keys"))
    df = df.withColumn(tokens, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S{1,%d}" % TOKEN), F.lit(0)))
    df = df.withColumn(hashes, F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(tokens, lambda t: F.xxhash64(t)))).drop(tokens)
    whole = F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(hashes)))
    rolled = F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(F.col(hashes), i, k)))
    df = df.withColumn(grams, F.when(F.size(hashes) < k, whole).otherwise(rolled)).drop(hashes)
    df = df.withColumn(keys, F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 64 - 38), POSITION_BITS).bitwiseOR(F.greatest(F.lit(LAST) - i, F.lit(0))))).drop(grams)
    windows = F.transform(F.sequence(F.lit(1), F.size(keys) - (w - 1)), lambda i: F.array_min(F.slice(F.col(keys), i, w)))
    few = F.when(F.size(keys) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.array_min(keys)))
    return df.withColumn(out, F.array_distinct(F.when(F.size(keys) < w, few).otherwise(windows))).drop(keys)


def hash_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, POSITION_BITS)


def position_of(key: Column) -> Column:
    return F.lit(LAST) - key.bitwiseAND(F.lit(LAST))


def shown(keys: str) -> Column:
    """The pairs as text: hash@position, parted by blanks."""
    return F.concat_ws(" ", F.transform(keys, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit("@"), position_of(x).cast("string"))))


def likeness(a: str, b: str) -> Column:
    """Share of the hashes of either set that both have; 1 for two empty sets."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows in buckets of neighbouring ids, each followed by the first row of the next bucket, and the window over a bucket.

    The text is dealt out once, by bucket. The ids are cut at approximate quantiles, and each stretch into buckets of equal
    width, so a few ids far from all others change the buckets of one stretch only. Null ids come first.
    """
    docs = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))))
    levels = F.array(*(F.lit(k / STRETCHES) for k in range(STRETCHES + 1)))
    cuts, n = docs.where(F.col(id_col).isNotNull()).agg(F.percentile_approx("__id", levels, 10_000), F.count(F.lit(1))).first()
    cuts = sorted(set(cuts or [0]))
    per = max(1, min(n // BUCKET_ROWS, MOST_BUCKETS) // len(cuts))
    edges = F.array(*(F.lit(c).cast("long") for c in [*cuts, cuts[-1] + 1]))
    docs = docs.withColumn("__stretch", F.size(F.filter(edges, lambda c: c <= F.col("__id"))))
    low, high = F.get(edges, F.col("__stretch") - 1), F.get(edges, F.least("__stretch", F.lit(len(cuts))))
    wide = lambda c: c.cast("double")
    place = F.least(F.floor((wide(F.col("__id")) - wide(low)) * per / F.greatest(wide(high) - wide(low), F.lit(1.0))), F.lit(per - 1))
    docs = docs.withColumn("__bucket", F.when(F.col("__stretch") == 0, -1).otherwise(F.col("__stretch") * per + place).cast("long")).drop("__stretch")
    firsts = docs.groupBy("__bucket").agg(F.min("__id").alias("__id"))
    order = Window.partitionBy(F.lit(0)).orderBy("__bucket")
    last = F.max("__bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("__id", F.coalesce(F.lag("__bucket").over(order), last).alias("__before"))
    places = F.array_compact(F.array(F.struct(F.col("__bucket").alias("at"), F.lit(False).alias("again")), F.when(F.col("__before").isNotNull(), F.struct(F.col("__before").alias("at"), F.lit(True).alias("again")))))
    rows = docs.join(F.broadcast(firsts), "__id", "left").withColumn("__place", F.explode(places))
    rows = rows.withColumns({"__at": F.col("__place.at"), "__again": F.col("__place.again")}).drop("__place", "__before", "__bucket")
    return rows, Window.partitionBy("__at").orderBy("__again", "__id", F.xxhash64(text_col), text_col)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter replaced by as much of the start of the next document. Null texts
    are empty; a single document is its own next; rows of one doc_id follow each other.
    """
    rows, window = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("__next", F.lead("text").over(window))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", "text", "__at", "__again", "__id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("__next", F.lit("")), F.lit(1), quarter)).alias("__edited"))
    rows = fingerprinted(fingerprinted(rows, "text", "__f", k, w), "__edited", "__e", k, w)
    rows = rows.withColumn("__fs", F.transform("__f", hash_of)).withColumn("__es", F.transform("__e", hash_of))
    rows = rows.withColumn("__ns", F.lead("__fs").over(window)).where("not __again")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), shown("__f").alias("fingerprint"), shown("__e").alias("edited_fingerprint"), likeness("__fs", "__es").alias("near_edited"), likeness("__fs", "__ns").alias("near_next"))
