"""Keyword rules for headlines: types, severities, scores and attributes, as column expressions made from tables of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, tuple[str, ...]]]

#: The first rule of which a word is in the text gives its type; a type's severity; words that raise it by one.
TYPES: Rules = [
    ("supply shock", ("production cut", "barrel", "opec", "output cut", "supply", "shut", "pipeline", "tanker", "refinery", "sanction")),
    ("geopolitical risk", ("war", "military", "strike", "attack", "conflict", "tension", "iran", "russia", "ukraine", "israel", "hamas", "strait", "hormuz", "blockade", "invasion")),
    ("demand shock", ("demand", "recession", "gdp", "china", "slowdown", "pmi", "manufacturing", "consumption", "inventory build")),
    ("monetary policy", ("fed", "rate", "interest", "inflation", "powell", "ecb", "hike", "cut rate", "quantitative")),
    ("weather event", ("hurricane", "storm", "flood", "freeze", "cold snap", "tropical", "wildfire", "drought")),
    ("infrastructure disruption", ("pipeline", "terminal", "port", "outage", "explosion", "fire", "leak", "spill")),
    ("regulatory event", ("ban", "regulation", "law", "court", "ruling", "penalty", "fine", "license")),
]
PRIORS = {"supply shock": 3, "geopolitical risk": 3, "infrastructure disruption": 3, "monetary policy": 2, "demand shock": 2, "weather event": 2, "regulatory event": 2, "economic data release": 1, "corporate event": 1, "other": 1}
RAISING = ("unprecedented", "emergency", "war", "invasion", "attack", "major", "significant", "shock", "crisis", "collapse", "explosion", "sanctions", "military")
MOST_SEVERE = 4

#: The scorer's own rules with their severities, and what each severity is called and worth.
SIGNALS: Rules = [
    ("Geopolitical Risk", ("war", "attack", "military", "invasion", "strait", "hormuz", "sanction", "embargo", "geopolit", "iran", "russia", "hamas", "hezbollah", "blockade", "hostil")),
    ("Supply Shock", ("opec", "cut", "barrel", "production", "supply", "oversupply", "quota", "shutdown", "disruption")),
    ("Demand Signal", ("demand", "pmi", "china", "slowdown", "recession", "growth", "gdp", "manufacturing")),
    ("Monetary Policy", ("fed", "rate", "inflation", "dollar", "monetary", "interest", "central bank", "ecb")),
    ("Price Movement", ("price", "rally", "surge", "plunge", "crash", "volatile", "spike", "slump")),
]
SEVERITIES = {"Geopolitical Risk": 4, "Supply Shock": 3, "Demand Signal": 2, "Monetary Policy": 2, "Price Movement": 2, "Market News": 1}
SEVERITY_NAMES, BASES = {1: "Low", 2: "Moderate", 3: "High", 4: "Extreme"}, {1: 15, 2: 38, 3: 62, 4: 84}
#: Scores from which a label and an advice hold.
BANDS = ((80, "Critical", "Immediate attention"), (60, "High", "Review within 30 min"), (40, "Monitor", "Monitor"), (0, "Ignore", "No action"))

#: The eight attributes of a text; the last entry of each is what holds without any word.
ATTRIBUTES: dict[str, tuple[Rules, str]] = {
    "event_type": ([("Supply Shock", ("opec", "production cut", "barrel", "output", "supply", "pipeline")), ("Geopolitical Risk", ("war", "military", "iran", "russia", "sanctions", "attack", "conflict")), ("Demand Shock", ("demand", "pmi", "china", "slowdown", "recession", "consumption")), ("Monetary Policy", ("fed", "rate hike", "inflation", "ecb", "central bank"))], "Other"),
    "event_severity": ([("Extreme", ("war", "invasion", "attack", "collapse", "unprecedented", "crisis")), ("High", ("major", "significant", "shock", "sanctions", "military")), ("Moderate", ("cut", "increase", "decision", "agreement"))], "Low"),
    "supply_shock": ([("Yes", ("opec", "production", "supply", "output", "barrel", "pipeline", "tanker"))], "No"),
    "demand_shock": ([("Yes", ("demand", "pmi", "china", "recession", "consumption", "slowdown"))], "No"),
    "geopolitical_risk": ([("Yes", ("war", "military", "iran", "russia", "sanctions", "conflict", "attack"))], "No"),
    "sentiment": ([("Bearish", ("cut", "decline", "fall", "collapse", "sanction", "attack", "war")), ("Bullish", ("increase", "rise", "resume", "ceasefire", "agreement", "boost"))], "Neutral"),
    "impact_horizon": ([("Immediate", ("today", "immediately", "breaking", "now", "attack", "war")), ("Short-term", ("week", "monthly", "quarter", "q1", "q2", "q3", "q4"))], "Medium-term"),
    "affected_region": ([("Middle East", ("iran", "saudi", "opec", "gulf", "hormuz", "iraq", "uae")), ("Eastern Europe", ("russia", "ukraine", "europe")), ("Asia", ("china", "asia", "japan", "korea"))], "Global"),
}


def has_any(lower: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text has one of the words in it, as a part of another word too; a null text has none."""
    found = F.contains(lower, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(lower, F.lit(w))
    return F.coalesce(found, F.lit(False))


def first_of(lower: Column, rules: Rules, other: str) -> Column:
    """The name of the first rule that has a word in the text, else `other`."""
    out = F.when(has_any(lower, rules[0][1]), rules[0][0])
    for name, words in rules[1:]:
        out = out.when(has_any(lower, words), name)
    return out.otherwise(other)


def looked_up(key: Column, table: dict) -> Column:
    out = F.when(key == next(iter(table)), next(iter(table.values())))
    for k, v in list(table.items())[1:]:
        out = out.when(key == k, v)
    return out


def severity_of(lower: Column, kind: Column, priors: dict[str, int] = PRIORS, raising: tuple[str, ...] = RAISING) -> Column:
    """The severity of a type, one more if the text has a raising word, at most MOST_SEVERE."""
    return F.least(F.coalesce(looked_up(kind, priors), F.lit(1)) + has_any(lower, raising).cast("int"), F.lit(MOST_SEVERE))


def jitter(text: Column, n: int) -> Column:
    """A number from 0 to n - 1 that follows from the text."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def scored(text: Column) -> dict[str, Column]:
    """The live score of a headline: type, severity, score with its label and advice, and the outlook that goes with a severity.

    A null text counts as an empty one.
    """
    text = F.coalesce(text, F.lit(""))
    kind = first_of(F.lower(text), SIGNALS, "Market News")
    sev = looked_up(kind, SEVERITIES)
    score = F.least(F.greatest(looked_up(sev, BASES) + jitter(text, 12) - 6, F.lit(0)), F.lit(100))

    def band(k: int) -> Column:
        out = F.when(score >= BANDS[0][0], BANDS[0][k])
        for b in BANDS[1:-1]:
            out = out.when(score >= b[0], b[k])
        return out.otherwise(BANDS[-1][k])

    width = 1.65 * (4 + sev * 1.5)
    return {
        "event_type": kind, "severity": sev, "severity_label": looked_up(sev, SEVERITY_NAMES), "score": score, "label": band(1), "advice": band(2),
        "p5": F.round(-width, 1), "median": F.round(sev * 0.8 - 1.2, 1), "p95": F.round(width, 1), "tail_weight": F.round(0.1 + sev * 0.06, 3),
        "mean_7d": F.round(sev * 0.5 - 0.8, 2), "mean_15d": F.round(sev * 0.9 - 1.2, 2), "p_up": F.round(0.45 + sev * 0.06, 2), "p_down10": F.round(sev * 0.055, 2),
    }


def attributes(text: Column) -> dict[str, Column]:
    """The eight attributes of a text by its words, each under its own name."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return {name: first_of(lower, rules, other) for name, (rules, other) in ATTRIBUTES.items()}


def any_sql(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


def first_sql(rules: Rules, other: str) -> str:
    """The same for DuckDB, over the lower-cased text t."""
    return "case " + " ".join(f"when {any_sql(words)} then '{name}'" for name, words in rules) + f" else '{other}' end"


def lookup_sql(key: str, table: dict) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {key} " + " ".join(f"when {show(k)} then {show(v)}" for k, v in table.items()) + " end"
