"""Readers: event records, vectors, series, cluster indexes and article dossiers, with schemas found or given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions import text as T
from hindcast.functions import vectors as V

#: The names that a field may have, in order of preference.
NAMES = {
    "event_id": ("event_id", "id", "document_id", "doc_id"),
    "date": ("date", "Date", "timestamp", "published"),
    "event_type": ("Event type", "Event_type", "event_type", "Event Types", "category"),
    "polarity": ("polarity", "Polarity"),
    "price": ("price", "WTI"),
    "embedding": ("embedding", "bert_embeddings"),
}
MISSING = ("", "nan", "none", "null", "unknown")


def first_of(df: DataFrame, names: tuple[str, ...], kind: str = "string") -> Column:
    """The first of the named columns that has a value; a text that stands for none is none."""
    found = []
    for name in names:
        if name in df.columns:
            c = F.col(f"`{name}`")
            found.append(F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c)) if dict(df.dtypes)[name] == "string" else c)
    return F.coalesce(*found, F.lit(None)).cast(kind) if found else F.lit(None).cast(kind)


def read_events(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of a file or folder of JSON, one array or one record a line; the form is seen from the start."""
    head = spark.read.text(path).where("trim(value) <> ''").select(F.ltrim("value").alias("v")).limit(1).collect()
    whole = bool(head) and head[0]["v"].startswith("[")
    raw = spark.read.option("wholetext", whole).text(path).where(F.trim("value") != "")
    bad = raw.where(F.try_parse_json("value").isNull())
    if whole:
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path), bad
    kind = schema or spark.read.option("mode", "DROPMALFORMED").json(path).schema
    good = raw.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", kind).alias("x")).select("x.*")
    return good, bad


def normalised(df: DataFrame, width: int = 768) -> DataFrame:
    """Records with canonical fields; vectors as arrays or text, cut or padded to width; missing ids are numbered by year."""
    kind = dict(df.dtypes).get(next((n for n in NAMES["embedding"] if n in df.columns), ""), "")
    vector = first_of(df, NAMES["embedding"], "array<double>") if kind.startswith("array") else V.parsed(first_of(df, NAMES["embedding"]), 1)
    d = F.to_date(F.try_to_timestamp(first_of(df, NAMES["date"])))
    out = df.select(first_of(df, NAMES["event_id"]).alias("id"), d.alias("d"), F.lower(first_of(df, NAMES["event_type"])).alias("event_type"), first_of(df, NAMES["polarity"]).alias("polarity"), first_of(df, NAMES["price"]).try_cast("double").alias("price"), F.when(F.size(vector) > 0, V.fitted(vector, width)).alias("embedding"))
    n = F.row_number().over(Window.partitionBy(F.year("d"), F.col("id").isNull()).orderBy("d", "event_type", "price"))
    named = F.coalesce("id", F.format_string("EVT_%d_%05d", F.year("d"), n))
    return out.where("d is not null").select(named.alias("event_id"), "d", "event_type", "polarity", "price", "embedding")


def with_vectors(meta: DataFrame, vectors: DataFrame, key: str = "document_id", width: int = 768) -> DataFrame:
    """meta with its vector by the lower-cased key; without one a zero vector, flagged in has_vector. Of a repeated key's vectors
    the least one counts."""
    v = vectors.groupBy(F.lower(F.trim(F.col(key))).alias("__key")).agg(F.min("embedding").alias("__v"))
    out = meta.join(v, F.lower(F.trim(F.col(key))) == F.col("__key"), "left").drop("__key")
    return out.withColumns({"has_vector": F.col("__v").isNotNull(), "embedding": F.coalesce(F.col("__v").cast("array<double>"), F.array_repeat(F.lit(0.0), width))}).drop("__v")


def read_series(spark: SparkSession, path: str, value: str | None = None, day_format: str | None = None) -> DataFrame:
    """(d, px) of a CSV file with a header: the date is the column called so, else the first one; bad values are left out."""
    df = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    day = next((c for c in df.columns if c.strip().lower() in ("date", "datetime", "name", "timestamp")), df.columns[0])
    px = value or next(c for c in df.columns if c != day)
    at = F.to_date(F.try_to_timestamp(F.col(f"`{day}`"), F.lit(day_format)) if day_format else F.try_to_timestamp(F.col(f"`{day}`")))
    return df.select(at.alias("d"), F.col(f"`{px}`").try_cast("double").alias("px")).where("d is not null and px is not null")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A cluster index whose maps and lists may be JSON texts, with native maps and arrays."""
    df = spark.read.parquet(path)
    kinds = {"entity_bag": "map<string,int>", "polarity_dist": "map<string,int>", "evtype_dist": "map<string,int>", "quantile_sig": "annual string, monthly string, cum_7d string, cum_15d string, cum_30d string", "propagation_prof": "array<double>", "realised_path": "array<double>", "members": "array<string>"}
    return df.withColumns({c: F.from_json(c, kind) for c, kind in kinds.items() if dict(df.dtypes).get(c) == "string"})


def merged(old: DataFrame, new: DataFrame, key: str = "Date") -> DataFrame:
    """An incremental append: of rows with one key the new one stays; columns that only one side has are null."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in (key, "__n")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*names), F.col("__n")).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in names))


def articles(texts: DataFrame, column: str = "text") -> DataFrame:
    """(…, n, article): the parts of a dossier that end with a line `Document <id>`; what follows the last one is left out."""
    parts = F.regexp_extract_all(F.col(column), F.lit(r"(?s)(.*?)\n\s*Document ([A-Za-z0-9]{16,})\s*(?:\n|$)"), F.lit(0))
    out = texts.select("*", F.posexplode(parts).alias("n", "article"))
    return out.withColumns({"article_id": F.regexp_extract("article", r"Document ([A-Za-z0-9]{16,})\s*$", 1), "body": F.trim(F.regexp_replace("article", r"\n\s*Document [A-Za-z0-9]{16,}\s*$", ""))})


def article_fields(df: DataFrame, body: str = "body") -> DataFrame:
    """df with title, author, word_count, date and page_ref found in the lines before the body's copyright line."""
    lines = F.filter(F.transform(F.split(F.col(body), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    of = lambda pattern: F.regexp_extract(F.col(body), pattern, 1)
    blank = lambda c: F.when(c != "", c)
    return df.withColumns({
        "title": F.get(lines, F.lit(0)), "author": blank(of(r"(?im)^\s*by\s+(.+)$")), "word_count": blank(of(r"(?im)^\s*([\d,]+) words\s*$")).try_cast("int"),
        "date": F.to_date(F.try_to_timestamp(blank(of(r"(?m)^\s*(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})\s*$")), F.lit("d MMMM yyyy"))),
        "page_ref": blank(of(r"(?m)^\s*([A-Z]{0,2}\d{1,3})\s*$")), "body_words": T.words(F.col(body)),
    })


def analogue_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(file, ..., one row for each element of `analogues`) of a folder of JSON files, one query's analogues each.

    Files that aren't JSON, or have no analogues, give no row.
    """
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*_analogues.json")
    df = (reader.schema(schema) if schema else reader).json(path)
    if "analogues" not in df.columns:
        return spark.createDataFrame([], "file string")
    rest = [c for c in df.columns if c != "analogues"]
    return df.select(F.input_file_name().alias("file"), *rest, F.explode("analogues").alias("x")).select("file", *rest, "x.*")


def stored_path(spark: SparkSession, path: str, key: str, value, column: str = "realised_path") -> DataFrame:
    """(key, column) of one key in a stored table: the filter and both columns reach the scan."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value)).select(key, column)
