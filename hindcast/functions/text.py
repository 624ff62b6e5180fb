"""Text columns: cleaning, tokens, triage and keyword rules, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def squash(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, " ")


def clean_text(c: Column, most: int | None = None) -> Column:
    """Without terminal codes, control characters and white space runs; cut to `most` characters with "..."."""
    out = squash(F.regexp_replace(strip_ansi(c), CONTROL, " "))
    return out if most is None else F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("..."))).otherwise(out)


def light_clean(c: Column, boilerplate: list[str]) -> Column:
    """Boilerplate phrases, whatever their case, become a space."""
    return squash(F.regexp_replace(c, "(?i)" + "|".join(boilerplate), " "))


def clean_html(c: Column) -> Column:
    """The text of a page: no scripts, styles, comments and tags; the common entities decoded."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    for entity, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squash(c)


def bag(c: Column, separators: str, stop: list[str], shortest: int = 1, longest: int = 60) -> Column:
    """The different lower-cased parts of a text between separators, without stop values."""
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), separators), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x: (F.length(x) >= shortest) & (F.length(x) <= longest) & ~x.isin(stop or [""]))
    return F.array_distinct(kept)


def contains_all(fields: list[Column], terms: list[str]) -> Column:
    """Every term, whatever its case, is somewhere in the fields."""
    blob = F.lower(F.concat_ws(" ", *fields))
    return reduce(lambda a, b: a & b, (blob.contains(t.lower()) for t in terms), F.lit(True))


def first_rule(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule of which a keyword is in the lower-cased text."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), None
    for name, words in rules:
        hit = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def hits(c: Column, keywords: list[str]) -> Column:
    """How many words of a text are among the keywords, whatever their case."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\d]+"), F.lit(0)), lambda x: x.isin(keywords)))


def words(c: Column) -> Column:
    """The number of words."""
    trimmed = squash(F.coalesce(c, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def chain_length(c: Column) -> Column:
    """Steps of a causal chain: parts by the first delimiter present of ->, →, ;, |; 0 if empty, else 1."""
    t = F.trim(F.coalesce(c, F.lit("")))
    out = F.when(t == "", 0)
    for d in ("->", "→", ";", "|"):
        out = out.when(t.contains(d), F.size(F.split(t, "\\Q" + d + "\\E")))
    return out.otherwise(1)


def iso_week(d: Column) -> Column:
    """The ISO year and week, unpadded: 2004-W7."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.weekofyear(d).cast("string"))


def parsed_json(c: Column, schema: str) -> Column:
    """A struct from JSON as a model may wrap it: plain, in fences, or the outermost braces of a text; else null."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(F.try_parse_json(c).isNotNull(), c).when(inner != "", inner), schema)


def tagged(c: Column, tag: str, dropped: str) -> Column:
    """The text of the first `tag` if it is there, else the whole text without all `dropped` elements."""
    inner = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.trim(F.when(c.rlike(inner), F.regexp_extract(c, inner, 1)).otherwise(F.regexp_replace(c, rf"(?is)<{dropped}.*?</{dropped}>", "")))


def parsed_stop_list(option: str | None, default: list[str]) -> list[str]:
    """The words of an option: none if it is missing or blank, the default if it says so, else the parts between commas."""
    if option is None or not option.strip():
        return []
    return list(default) if option.strip().upper() == "DEFAULT" else [x.strip().lower() for x in option.split(",") if x.strip()]
