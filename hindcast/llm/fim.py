"""Fill-in-middle transformation over relational units.

A text is cut into units: a word with the white space before it, or white space at the end. Units are rows: posexplode gives
their ordinals, a window sums their lengths. Each text that is to be cut asks for two ordinals; a join on the ordinal finds
where these units end, an aggregation brings both offsets of a document together, and substring cuts the text.

The texts are dealt out once, by document. Units, requests and texts all read that one exchange, so that neither the window
nor a join deals anything out again, and what a task holds at a time are the units of its own texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws, percent of the texts that are cut, percent of those that put the suffix first.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
KEYS = ["__id", "__hash"]


def drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th draw of a document, from 0 to 2^32 - 1: the k-th eight digits of a hash of seed and id; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def form_of(text: Column, doc_id: Column, seed: int, cut: int, suffix_first: int) -> Column:
    """plain, psm or spm. Empty texts and those with a marker in them stay plain, so that every form can be undone."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (drawn(doc_id, seed, 3) % 100 >= cut)
    return F.when(plain, "plain").when(drawn(doc_id, seed, 4) % 100 < suffix_first, "spm").otherwise("psm")


def n_units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def offsets(keyed: DataFrame, text: str, form: Column, doc_id: Column, seed: int) -> DataFrame:
    """(KEYS, __n, __first, __second) of the texts that are cut: their units, and the characters to the end of prefix and middle.

    Texts both of whose cuts lie at the start ask for no unit and have no row. keyed is dealt out by KEYS. The row's number
    keeps the filter above that exchange, where all readers share it, and the units of equal rows apart.
    """
    cut = keyed.withColumn("__copy", F.monotonically_increasing_id()).where(form != "plain")
    units = cut.select(*KEYS, "__copy", F.posexplode(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).alias("__at", "__unit"))
    so_far = Window.partitionBy(*KEYS, "__copy").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select(*KEYS, "__at", F.sum(F.length("__unit")).over(so_far).alias("__end"))
    # no filter here: it would be pushed below the exchange, and the texts be dealt out twice
    wanted = lambda c: F.when(form != "plain", c)
    asked = keyed.select(*KEYS, wanted(n_units(F.col(text))).alias("__n"), wanted(drawn(doc_id, seed, 1)).alias("__a"), wanted(drawn(doc_id, seed, 2)).alias("__b"))
    a, b = F.col("__a") % (F.col("__n") + 1), F.col("__b") % (F.col("__n") + 1)
    asked = asked.groupBy(*KEYS).agg(F.max("__n").alias("__n"), F.max(F.least(a, b) - 1).alias("__p"), F.max(F.greatest(a, b) - 1).alias("__q"))
    # the ordinals are a condition and not a key, so that both sides stay where they were dealt to
    met = ends.join(asked, KEYS).where("__at = __p or __at = __q")
    end = lambda which: F.coalesce(F.max(F.when(F.col("__at") == F.col(which), F.col("__end"))), F.lit(0)).cast("int")
    return met.groupBy(*KEYS).agg(F.max("__n").alias("__n"), end("__p").alias("__first"), end("__q").alias("__second"))


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and output; columns of these names are replaced.

    A null text is empty and plain. Rows of one id are cut alike if their texts are equal, each by its own units if not; a null
    id draws as an empty one. Positions count code points. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, "n", "form", "prefix_chars", "middle_chars", "output")]
    # other columns travel as one, so that no name of theirs meets one used here
    docs = docs.select(id_col, text_col, *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("__others")] if others else []))
    surrogate = F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType))
    docs = docs.withColumns({text_col: F.coalesce(text_col, F.lit("")), "__id": surrogate})
    # the id travels as __id alone, which joins need not to be null; __hash tells whether it was
    docs = docs.withColumn("__hash", F.xxhash64(F.col(id_col).isNull(), "__id", text_col))
    keyed = docs.drop(id_col).repartition(*KEYS)
    text = F.col(text_col)
    doc_id = F.when(F.col("__hash") == F.xxhash64(F.lit(False), "__id", text_col), F.col("__id"))
    form = form_of(text, doc_id, seed, cut, suffix_first)
    out = keyed.join(offsets(keyed.select(*KEYS, text_col), text_col, form, doc_id, seed), KEYS, "left")
    out = out.withColumns({id_col: doc_id, "form": form, "n": F.coalesce("__n", n_units(text)), "__p": F.coalesce("__first", F.lit(0)), "__q": F.coalesce("__second", F.lit(0))})
    prefix, middle = F.substring(text, F.lit(1), F.col("__p")), F.substring(text, F.col("__p") + 1, F.col("__q") - F.col("__p"))
    suffix = F.substring(text, F.col("__q") + 1, F.length(text))
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    out = out.withColumn("output", F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", spm).otherwise(psm))
    chars = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return out.select(id_col, text_col, *(["__others.*"] if others else []), "n", "form", chars(F.col("__p")).alias("prefix_chars"), chars(F.col("__q") - F.col("__p")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form; no marker is in a text that was cut, so the first of each kind is the marker."""
    body = F.substring(output, F.lit(4), F.length(output))
    by = lambda c, mark: F.split(c, mark, 2)
    one, rest = by(body, F.when(form == "spm", PREFIX).otherwise(SUFFIX))[0], by(body, F.when(form == "spm", PREFIX).otherwise(SUFFIX))[1]
    two, three = by(rest, F.lit(MIDDLE))[0], by(rest, F.lit(MIDDLE))[1]
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, three, one)).otherwise(F.concat(one, three, two))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text rebuilt from it."""
    out = transformed(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || doc_id) as s from documents
), drawn as (
  select doc_id, text, len(u)::bigint as n, list_transform(u, lambda x: length(x)) as l, cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2, cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4 from cut
), placed as (
  select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form,
    coalesce(list_sum(l[1:least(h1 % (n + 1), h2 % (n + 1))]), 0)::bigint as p, coalesce(list_sum(l[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0)::bigint as q from drawn
), built as (
  select *, case form when 'plain' then text when 'spm' then '<S>' || substr(text, q + 1) || '<P>' || substr(text, 1, p) || '<M>' || substr(text, p + 1, q - p)
    else '<P>' || substr(text, 1, p) || '<S>' || substr(text, q + 1) || '<M>' || substr(text, p + 1, q - p) end as output from placed
)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars, sha256(output) as output_sha256, sha256(text) as restored_sha256 from built
"""
