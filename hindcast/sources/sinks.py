"""Writers. All write folders, from the executors; none brings rows to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the Parquet table at path doesn't hold yet; returns the whole table. Safe to repeat."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as missing:  # no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        df.write.parquet(path)
    else:
        df.join(done, key, "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def events(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """One memory in three forms: Parquet with vectors, JSON lines, and CSV without vectors."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").json(f"{path}/json")
    flat = df.drop(*[c for c, kind in df.dtypes if c == vector or kind.startswith(("array", "map", "struct"))])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def browse(df: DataFrame, path: str, columns: list[str], text: str = "text", most: int = 500) -> None:
    """A CSV of some columns, the text cut."""
    df.withColumn(text, F.substring(text, 1, most)).select(*columns).write.mode("overwrite").option("header", True).csv(path)


def by_bucket(df: DataFrame, path: str, *bucket: str) -> None:
    """JSON in a folder for each value of the bucket columns, such as a triage class or a horizon."""
    df.write.mode("overwrite").partitionBy(*bucket).json(path)


def posteriors(points: DataFrame, path: str, key: str, horizon: str = "horizon") -> None:
    """Grids as one row per key and horizon, in a folder for each horizon."""
    row = F.array_sort(F.collect_list(F.struct("i", "x", "dens")))
    nested = points.groupBy(key, horizon).agg(row.alias("g")).select(key, horizon, F.transform("g", lambda p: p["x"]).alias("x_grid"), F.transform("g", lambda p: p["dens"]).alias("density"))
    by_bucket(nested, path, horizon)


def topics(parts: list[DataFrame], path: str, topic: str = "topic", label: str = "label") -> None:
    """Topics of several periods as one CSV, and beside it a legend with each topic's label and size."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    every.write.mode("overwrite").option("header", True).csv(f"{path}/topics")
    every.groupBy(topic, label).agg(F.count(F.lit(1)).alias("size")).write.mode("overwrite").option("header", True).csv(f"{path}/legend")
