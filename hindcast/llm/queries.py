"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import audio, bpe, fim, jaccard, language, lines, mixing, mixlm, quality, urls, variants, warc, winnow

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.recordings(table(spark, sf_dir, "documents"))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_mixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.documents_scored(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_jaccard": op2_jaccard,
        "op3_mixlm": op3_mixlm,
        "op4_line_dedup": op4_line_dedup,
        "op5_urls": op5_urls,
        "op6_language": op6_language,
        "op7_audio": op7_audio,
        "op8_winnow": op8_winnow,
        "op9_mixing": op9_mixing,
        "op10_bpe": op10_bpe,
        "op11_fim": op11_fim,
        "op12_warc": op12_warc,
        "op13_variants": op13_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard": jaccard.SQL,
        "op4_line_dedup": lines.SQL,
        "op5_urls": urls.SQL,
        "op11_fim": fim.SQL,
        "op12_warc": warc.SQL,
        "op13_variants": variants.SQL,
    }
