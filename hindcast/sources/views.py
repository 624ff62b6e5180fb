"""Views over the star-schema tables that stand for the market data and the event memory.

Money is summed in whole cents, so that any order of summation gives the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_price() -> F.Column:
    return (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count(F.lit(1)) / 100.0).alias("px")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, px): the daily price, for days with orders only."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(_mean_price())


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(leg, d, px): the daily price of each of five contracts."""
    leg = F.concat(F.lit("M"), F.substring("o_orderpriority", 1, 1)).alias("leg")
    return table(spark, sf_dir, "orders").groupBy(leg, F.to_date("o_orderdate").alias("d")).agg(_mean_price())


def vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, ovx): a daily volatility index."""
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(cents.alias("ovx"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, d, event_type, polarity, emb): dated events with their vectors."""
    vectors, orders = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "orders")
    joined = vectors.join(orders, vectors["vec_id"] == orders["o_orderkey"])
    return joined.select(F.col("vec_id").alias("event_id"), F.to_date("o_orderdate").alias("d"), F.col("label").alias("event_type"), F.col("o_orderstatus").alias("polarity"), F.col("embedding").alias("emb"))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).where(F.col("d") < F.lit(SPLIT).cast("date"))


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).where(F.col("d") >= F.lit(SPLIT).cast("date"))


#: The same views for DuckDB.
SQL = {
    "prices": "select cast(o_orderdate as date) as d, sum(cast(round(o_totalprice * 100) as bigint)) / count(*) / 100.0 as px from orders group by 1",
    "legs": "select 'M' || substr(o_orderpriority, 1, 1) as leg, cast(o_orderdate as date) as d, sum(cast(round(o_totalprice * 100) as bigint)) / count(*) / 100.0 as px from orders group by 1, 2",
    "vol": "select cast(l_shipdate as date) as d, sum(cast(round(l_discount * 100) as bigint)) / count(*) as ovx from lineitem group by 1",
    "memory": "select e.vec_id as event_id, cast(o.o_orderdate as date) as d, e.label as event_type, o.o_orderstatus as polarity, e.embedding as emb from embeddings e join orders o on e.vec_id = o.o_orderkey",
    "train": "select * from memory where d < date '2000-01-01'",
    "test": "select * from memory where d >= date '2000-01-01'",
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """A query with the named views before it."""
    if {"train", "test"} & set(names):
        names = ("memory", *(n for n in names if n != "memory"))
    return "with " + "recursive " * recursive + ", ".join(f"{n} as ({SQL[n]})" for n in names) + ("," if sql.lstrip().startswith(",,") else " ") + sql.lstrip().removeprefix(",,")
