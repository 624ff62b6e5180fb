"""The corpus pipeline: documents in, token ids in mixing order out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads it
again for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import bpe, jaccard, lines, mixing, quality
from hindcast.llm.common import forget, made, shared_dir, swept, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, accepts.

    Null and empty texts are scored as such; rows of one doc_id are judged each by its text, equal texts alike.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("predicted") == 1).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text.

    Null texts become empty. Rows of one doc_id are one document; those with a null id keep all lines.
    """
    kept = lines.dedup(docs)
    return kept.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies: five-word shingles, a similarity of 0.8.

    Texts without words and rows with a null id stay. Rows of one doc_id stay or go together.
    """
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixing schedule, sources by the square root of their size.

    A null source is a source; every row stays.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the token ids and position, in the order of position.

    Files of a table are not read in their order, so the place in the mixing schedule is found again from the documents,
    and position carries it in the rows. A null text has no tokens.
    """
    ordered = mixing.positioned(docs.select("doc_id", "source", "text")).drop("block", "slot").orderBy("position")
    coded = bpe.encode(ordered, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "position")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]
#: The classifier's and the tokenizer's rows can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows in mixing order; what a stage wrote for itself, and its input, are deleted when its result is there."""
    docs, root, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark), None
    for name, stage in STAGES:
        since = len(made)
        docs = written(stage(spark, docs, sf_dir), root, name)
        swept(spark, since)
        if before:
            forget(spark, root, before)
        before = name
    return docs.orderBy("position")
