"""What the operators share: the shared folder, written tables, Arrow passes and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

WORD_BREAKS = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


#: The shared folders that this driver has made, for swept().
made: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS rows where the session has Spark's default of 10000, as a row may hold a very long text."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder inside spark.checkpoint.dir, which all machines see.

    Only where that setting is missing and the master is local (one machine, as in tests) a local folder is made and set.
    """
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    made.append(f"{base.rstrip('/')}/hindcast-{uuid.uuid4().hex}")
    return made[-1]


def written(df: DataFrame, root: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage is cut and lost executors cost nothing.

    What the writing shuffled is deleted when the table is there, not only when the driver collects garbage.
    """
    path, spark = f"{root}/{name}", df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, root: str, *names: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession, since: int = 0) -> None:
    """Deletes the shared folders made since there were so many; results that aren't written elsewhere go with them."""
    for root in made[since:]:
        forget(spark, root, "")
    del made[since:]


def with_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[StructField]) -> DataFrame:
    """df with the columns that fn returns for each Arrow batch; fields name and type them.

    Input columns of the same names are replaced, all others pass through.
    """
    small_batches(df.sparkSession)
    made = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in made]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + list(fn(batch))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, StructType(kept + fields))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def longs(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit integers in each value of a binary column, as views of the batch's memory. Nulls aren't looked for."""
    if isinstance(column, pa.LargeBinaryArray):
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    else:
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    return [np.frombuffer(data, np.int64, (b - a) // 8, a) if b > a else np.zeros(0, np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def crc_fold(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def in_fold(column: str, n: int, k: int):
    """Whether crc32 of the id modulo n is k; a null id is in no fold."""
    return F.coalesce(crc_fold(column, n) == k, F.lit(False))


def components(edges: DataFrame, root: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (id, component), component the smallest id reachable.

    Every round takes the least label among neighbours (an aggregation with partial sums, so hubs don't gather
    in one task), then jumps to the label's own label. Labels are written to the shared folder each round.
    Self loops give a component of one; no edges give an empty result; null ends are left out.
    """
    e = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = written(e.union(e.select("b", "a").toDF("a", "b")).distinct(), root, "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), root, "labels-0")
    for n in range(1, most_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        closer = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = closer.join(roots, "component").select("id", "was", F.least("component", "root").alias("component"))
        after = written(after, root, f"labels-{n}")
        forget(edges.sparkSession, root, f"labels-{n - 1}")
        changed = after.where("was <> component").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            forget(edges.sparkSession, root, "edges")
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
