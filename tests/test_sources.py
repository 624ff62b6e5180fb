"""Readers, writers, streams and service functions on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from hindcast.plans import analogues, api
from hindcast.sources import readers, sinks, views
from hindcast.streaming import news

SF = "/root/testdata/sf0.001"
RECORDS = [{"event_id": "a", "date": "2001-02-03", "Event type": "War", "category": "x", "bert_embeddings": "[1 2]", "price": "7.5"}, {"date": "2001-01-01", "Event type": "nan", "category": "Supply", "bert_embeddings": "[0.5, x, 1]", "price": "bad"}, {"event_id": "c", "date": "never"}]


@pytest.mark.parametrize("lines", [True, False])
def test_events(spark, tmp_path, lines):
    path = tmp_path / "e.json"
    path.write_text("\n".join(map(json.dumps, RECORDS)) + "\n{broken" if lines else json.dumps(RECORDS))
    good, bad = readers.read_events(spark, str(path))
    assert bad.count() == int(lines) and good.count() == 3
    got = {r["event_id"]: r for r in readers.normalised(good, 3).collect()}
    assert set(got) == {"a", "EVT_2001_00001"}
    assert got["a"]["embedding"] == [1.0, 2.0, 0.0] and got["a"]["event_type"] == "war" and got["a"]["price"] == 7.5
    assert got["EVT_2001_00001"]["event_type"] == "supply" and got["EVT_2001_00001"]["price"] is None and got["EVT_2001_00001"]["embedding"] == [0.5, 1.0, 0.0]


def test_vectors_by_key(spark):
    meta = spark.createDataFrame([("A ",), ("b",), (None,)], "document_id string")
    vec = spark.createDataFrame([("a", [1.0]), ("A", [1.0])], "document_id string, embedding array<double>")
    got = sorted((str(r["document_id"]), r["has_vector"], r["embedding"]) for r in readers.with_vectors(meta, vec, width=1).collect())
    assert got == [("A ", True, [1.0]), ("None", False, [0.0]), ("b", False, [0.0])]


def test_series_and_merge(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,Price\n01/31/2000,5.5\nbad,1\n02/01/2000,x\n02/02/2000,6\n")
    got = readers.read_series(spark, str(tmp_path / "s.csv"), day_format="MM/dd/yyyy").orderBy("d").collect()
    assert [(str(r["d"]), r["px"]) for r in got] == [("2000-01-31", 5.5), ("2000-02-02", 6.0)]
    old, new = spark.createDataFrame([(1, 1.0), (2, 2.0)], "Date int, x double"), spark.createDataFrame([(2, 9.0, 1)], "Date int, x double, y int")
    assert [tuple(r) for r in readers.merged(old, new).orderBy("Date").collect()] == [(1, 1.0, None), (2, 9.0, 1)]


def test_articles(spark):
    text = "Oil rises\nBy Jo Doe\n1,204 words\n3 May 2004\nThe body.\nDocument ABCDEF0123456789X\nSecond\nText\nDocument QQQQQQ0123456789X\ntail"
    df = readers.article_fields(readers.articles(spark.createDataFrame([(text,), (None,), ("none",)], "text string"))).orderBy("n").collect()
    assert [r["article_id"] for r in df] == ["ABCDEF0123456789X", "QQQQQQ0123456789X"]
    assert df[0]["title"] == "Oil rises" and df[0]["author"] == "Jo Doe" and df[0]["date"] == datetime.date(2004, 5, 3) and df[1]["author"] is None


def test_index(spark, tmp_path):
    spark.createDataFrame([('{"oil": 2}', "[0.5, 0.5]", '["a"]')], "entity_bag string, propagation_prof string, members string").write.parquet(str(tmp_path / "i"))
    r = readers.read_index(spark, str(tmp_path / "i")).first()
    assert r["entity_bag"] == {"oil": 2} and r["propagation_prof"] == [0.5, 0.5] and r["members"] == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [2.0])], "event_id int, text string, embedding array<double>")
    path = str(tmp_path / "t")
    assert sinks.append_new(df.limit(1), path, "event_id").count() == 1
    assert sinks.append_new(df, path, "event_id").count() == 2 and sinks.append_new(df, path, "event_id").count() == 2
    sinks.events(df, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e/csv")).columns == ["event_id", "text"]
    sinks.by_bucket(df, str(tmp_path / "b"), "text")
    assert spark.read.json(str(tmp_path / "b")).count() == 2


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = news.source(spark, f"{SF}/event*.parquet", schema)
    once = news.deduplicated(stream)
    news.appended(once, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    news.appended(news.volumes(stream), str(tmp_path / "v"), str(tmp_path / "d")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "v")).count() > 0
    news.scored(stream, lambda b: b.select("event_id", (F.col("value") * 2).alias("s")), str(tmp_path / "s"), str(tmp_path / "f")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s")).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_service(spark):
    m = views.memory(spark, SF)
    one = m.orderBy(F.desc("d"), "event_id").first()
    found = api.retrieve(m, one["event_id"], 0.4, 5, 7).collect()
    assert len(found) <= 7 and all(r["event_id"] != one["event_id"] for r in found)
    events = m.withColumn("text", F.concat(F.lit("Event "), "polarity"))
    assert api.find_events(events, "event f", limit=5).count() == 5
    assert api.report(analogues.forecasts(spark, SF)).first()["report"].startswith("Median")
    assert api.tail(views.prices(spark, SF), 10).count() == 10


def test_analogue_files_stored_paths_and_topics(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a_analogues.json").write_text('{"base_id": 1, "analogues": [{"event_id": 7, "sim": 0.5}, {"event_id": 8, "sim": 0.25}]}')
    (tmp_path / "q" / "b_analogues.json").write_text("not json")
    (tmp_path / "q" / "c.json").write_text('{"base_id": 2, "analogues": [{"event_id": 9, "sim": 0.5}]}')
    got = readers.analogue_files(spark, f"file://{tmp_path}/q", "base_id long, analogues array<struct<event_id:long,sim:double>>").collect()
    assert sorted((r["base_id"], r["event_id"], r["sim"]) for r in got) == [(1, 7, 0.5), (1, 8, 0.25)] and all("a_analogues" in r["file"] for r in got)
    spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [3.0], "y")], "event_id long, realised_path array<double>, text string").write.parquet(f"{tmp_path}/paths")
    found = readers.stored_path(spark, f"{tmp_path}/paths", "event_id", 2)
    assert [tuple(r) for r in found.collect()] == [(2, [3.0])]
    one, two = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "id long, topic int, label string"), spark.createDataFrame([(3, 0, "a", 9)], "id long, topic int, label string, more int")
    sinks.topics([one, two], f"{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/topics").count() == 3
    assert sorted((r["topic"], r["label"], r["size"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/t/legend").collect()) == [("0", "a", "2"), ("1", "b", "1")]
