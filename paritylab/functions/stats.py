"""Statistical column expressions: erf / normal CDF and the two-proportion z-test.

Spark has no ``erf``; it is evaluated with the series
erf(x) = 2/sqrt(pi) * exp(-x^2) * sum_n 2^n x^(2n+1) / (2n+1)!!
inside one ``aggregate(sequence(...))`` expression (JVM side, codegen-friendly).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 200
_CUTOFF = 6.0  # erf(x) == 1 to double precision beyond this


def erf(x: Column) -> Column:
    ax = F.abs(x)
    two_x2 = F.lit(2.0) * ax * ax
    init = F.struct(ax.alias("t"), ax.alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        init,
        lambda acc, n: F.struct(
            (acc["t"] * two_x2 / (F.lit(2) * n + 1)).alias("t"),
            (acc["s"] + acc["t"] * two_x2 / (F.lit(2) * n + 1)).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    val = F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-ax * ax) * series
    val = F.when(ax > _CUTOFF, F.lit(1.0)).otherwise(F.least(val, F.lit(1.0)))
    return F.when(x.isNull(), None).when(x < 0, -val).otherwise(val)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(math.sqrt(2.0))))


def parity_p_value(n1, p1, n2, p2) -> Column:
    """Two-sided pooled two-proportion z-test; SE == 0 -> 1.0; NULL where a count or a rate is missing (an absent group)."""
    n1, p1, n2, p2 = [F.col(c) if isinstance(c, str) else c for c in (n1, p1, n2, p2)]
    pooled = (p1 * n1 + p2 * n2) / (n1 + n2)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = (p1 - p2) / se
    p = F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))
    return F.when(se == 0, F.lit(1.0)).otherwise(p)


def is_significant(p_value, alpha: float = 0.05) -> Column:
    p_value = F.col(p_value) if isinstance(p_value, str) else p_value
    return p_value < F.lit(alpha)
