"""Streams of news events: late and repeated events, tumbling counts, and scoring against a corpus at rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first of the events of one key; state is dropped when the watermark has passed."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def volumes(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events per window and type; a window is final when the watermark has passed its end."""
    n = events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def scored(events: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each batch scored by a function of a batch DataFrame (such as retrieval against a corpus) and appended, in a folder of
    the batch's number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
