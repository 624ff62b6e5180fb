"""Numbers: guards, ladders and the normal distribution, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def finite(c: Column) -> Column:
    """Null for what isn't a number or is infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    return 0.5 * (1 + erf((x - mu) / (sigma * math.sqrt(2))))


def normal_pdf(x: Column, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    z = (x - mu) / sigma
    return F.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi))


ERF_SQL = """(sign({x}) * (1 - (((((1.061405429 * (1 / (1 + 0.3275911 * abs({x}))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({x}))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({x})))
  - 0.284496736) * (1 / (1 + 0.3275911 * abs({x}))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({x})))) * exp(-({x}) * ({x}))))"""


def normal_cdf_sql(z: str) -> str:
    return f"(0.5 * (1 + {ERF_SQL.format(x=f'(({z}) / sqrt(2.0))')}))"


def ladder(c: Column, steps: list[tuple[float, str]], last: str, closed: str = "<") -> Column:
    """The label of the first step that c is below (or at, with closed "<="); null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in steps:
        out = out.when(c < edge if closed == "<" else c <= edge, label)
    return out.otherwise(last)


#: The number that each label of a price band stands for.
MIDPOINTS = {"0%-5%": 2.5, "5%-20%": 12.5, "20%-30%": 25.0, "30%-40%": 35.0, "40%-60%": 50.0, "60%-80%": 70.0, "80%-90%": 85.0, "90%-100%": 95.0}


def band_midpoint(label: Column) -> Column:
    """The middle of a price band by its label; 50 for an unknown one."""
    out = F.lit(50.0)
    for name, value in MIDPOINTS.items():
        out = F.when(F.trim(label) == name, value).otherwise(out)
    return out
