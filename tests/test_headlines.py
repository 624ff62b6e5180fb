"""The keyword rules on headlines whose answers are known."""

from pyspark.sql import functions as F

from hindcast.functions import headlines as H


def test_headlines(spark):
    texts = ["OPEC agrees on production cut", "Missile ATTACK near the Strait of Hormuz", "China PMI slows", "Fed hikes rate", "Hurricane nears the coast", "Quiet day", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    lower = F.lower(F.coalesce("t", F.lit("")))
    kind = H.first_of(lower, H.TYPES, "other")
    got = {r["id"]: r for r in df.select("id", kind.alias("kind"), H.severity_of(lower, kind).alias("sev"), *(c.alias(n) for n, c in H.scored(F.col("t")).items())).collect()}
    assert [got[k]["kind"] for k in range(8)] == ["supply shock", "geopolitical risk", "demand shock", "monetary policy", "weather event", "other", "other", "other"]
    assert [got[k]["sev"] for k in range(8)] == [3, 4, 2, 2, 2, 1, 1, 1]
    assert [got[k]["event_type"] for k in range(6)] == ["Supply Shock", "Geopolitical Risk", "Demand Signal", "Monetary Policy", "Market News", "Market News"]
    for r in got.values():
        base = H.BASES[r["severity"]]
        assert base - 6 <= r["score"] <= min(base + 5, 100) and r["label"] == next(b[1] for b in H.BANDS if r["score"] >= b[0]) and r["p5"] == -r["p95"]
    a = {r["id"]: r for r in df.select("id", *(c.alias(n) for n, c in H.attributes(F.col("t")).items())).collect()}
    assert tuple(a[0])[1:] == ("Supply Shock", "Moderate", "Yes", "No", "No", "Bearish", "Medium-term", "Middle East")
    assert tuple(a[1])[1:] == ("Geopolitical Risk", "Extreme", "No", "No", "Yes", "Bearish", "Immediate", "Middle East")
    assert tuple(a[6])[1:] == tuple(a[7])[1:] == ("Other", "Low", "No", "No", "No", "Neutral", "Medium-term", "Global")
