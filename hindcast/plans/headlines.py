"""The keyword rules for headlines, over every document's whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import headlines as H
from hindcast.sources.views import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


LOW = "select doc_id, coalesce(text, '') as text, lower(coalesce(text, '')) as t from documents"


@query(f"select doc_id, kind as event_type, least(coalesce({H.lookup_sql('kind', H.PRIORS)}, 1) + {H.any_sql(H.RAISING)}::int, {H.MOST_SEVERE}) as severity from (select *, {H.first_sql(H.TYPES, 'other')} as kind from ({LOW}))")
def headline_types(spark, sf):
    """Type and severity of each text by the classifier's rules."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    kind = H.first_of(lower, H.TYPES, "other")
    return table(spark, sf, "documents").select("doc_id", kind.alias("event_type"), H.severity_of(lower, kind).alias("severity"))


@query(
    f"""select doc_id, kind as event_type, sev as severity, {H.lookup_sql('sev', H.SEVERITY_NAMES)} as severity_label, score, case when score >= 80 then 'Critical' when score >= 60 then 'High' when score >= 40 then 'Monitor' else 'Ignore' end as label,
    case when score >= 80 then 'Immediate attention' when score >= 60 then 'Review within 30 min' when score >= 40 then 'Monitor' else 'No action' end as advice,
    round(-1.65e0 * (4 + sev * 1.5e0), 1) as p5, round(sev * 0.8 - 1.2, 1)::double as median, round(1.65e0 * (4 + sev * 1.5e0), 1) as p95, round(0.1 + sev * 0.06, 3)::double as tail_weight,
    round(sev * 0.5 - 0.8, 2)::double as mean_7d, round(sev * 0.9 - 1.2, 2)::double as mean_15d, round(0.45 + sev * 0.06, 2)::double as p_up, round(sev * 0.055, 2)::double as p_down10
    from (select *, cast(least(greatest({H.lookup_sql('sev', H.BASES)} + cast('0x' || substr(md5(text), 1, 8) as bigint) % 12 - 6, 0), 100) as int) as score
      from (select *, {H.lookup_sql('kind', H.SEVERITIES)} as sev from (select *, {H.first_sql(H.SIGNALS, 'Market News')} as kind from ({LOW}))))"""
)
def live_headline_scores(spark, sf):
    """The live scorer: severity, score, label and advice of each text, and the outlook of its severity."""
    return table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in H.scored(F.col("text")).items()))


@query("select doc_id, " + ", ".join(f"{H.first_sql(rules, other)} as {name}" for name, (rules, other) in H.ATTRIBUTES.items()) + f" from ({LOW})")
def headline_attributes(spark, sf):
    """The eight attributes of each text."""
    return table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in H.attributes(F.col("text")).items()))
