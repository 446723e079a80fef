"""Scalar maths as Column expressions, plus the same formulas as SQL text.

Spark has no normal distribution, so the CDF uses the polynomial of Abramowitz
and Stegun 26.2.17 and the quantile uses Acklam's rational approximation.  The
SQL twins exist so that an independent engine can check the results.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 26.2.17.
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

# Acklam's approximation of the normal quantile (central and tail).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)
PPF_TAIL = 0.97575

_INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def z_value(service_level: float) -> float:
    """Normal quantile of a literal service level, folded into the plan."""
    return round(NormalDist().inv_cdf(service_level), 12)


def ratio(a, b, default: float | None = None) -> Column:
    """``a / b``; where b is zero or either is null, ``default``."""
    value = F.try_divide(a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))
    return value if default is None else F.coalesce(value, F.lit(default))


# Two-sided 5 % points of Student's t for 5 to 28 degrees of freedom.
T_CRITICAL = (2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813,
              2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
              2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407)


def t_critical(n: Column) -> Column:
    """Two-sided 5 % point of Student's t for a correlation of n >= 7 rows.

    Tabled up to 30 rows; from there the Cornish-Fisher series in 1 / (n - 2), which is exact to
    five places.
    """
    z = 1.959963985
    v = (n - 2).cast("double")
    far = (
        F.lit(z) + ratio(z**3 + z, 4 * v) + ratio(5 * z**5 + 16 * z**3 + 3 * z, 96 * v * v)
        + ratio(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z, 384 * v * v * v)
    )
    table = F.array(*[F.lit(t) for t in T_CRITICAL])
    return F.coalesce(F.when(n > 6, F.try_element_at(table, (n - 6).cast("int"))), far)


def t_passes(r2: Column, n: Column) -> Column:
    """Whether a correlation with square r2 over n rows differs from zero (two-sided, 5 %)."""
    crit = t_critical(n)
    return (r2 >= 1.0) | (F.coalesce(ratio(r2 * (n - 2), 1.0 - r2), F.lit(0.0)) > crit * crit)


def _horner(x: Column, coefs) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) * F.lit(_INV_SQRT_2PI)


def norm_cdf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * F.abs(x))
    tail = norm_pdf(x) * _horner(t, tuple(reversed(CDF_B))) * t
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """Quantile for p in [0.5, 1): the range service levels live in."""
    q = p - 0.5
    r = q * q
    centre = _horner(r, PPF_A) * q / (_horner(r, PPF_B) * r + 1.0)
    s = F.sqrt(-2.0 * F.log(1.0 - p))
    upper = -_horner(s, PPF_C) / (_horner(s, PPF_D) * s + 1.0)
    return F.when(p <= PPF_TAIL, centre).otherwise(upper)


def or_default(col: Column, default) -> Column:
    """``x or default``: null and zero both take the default."""
    return F.when(col.isNull() | (col == 0), F.lit(default)).otherwise(col)


def truncate(col: Column) -> Column:
    return col.cast("int")


def half_up(col: Column) -> Column:
    """Round to the nearest whole number as an int."""
    return F.floor(col + 0.5).cast("int")


# --------------------------------------------------------------------------
# SQL twins
# --------------------------------------------------------------------------

def _horner_sql(x: str, coefs) -> str:
    acc = repr(float(coefs[0])) + "::double"
    for c in coefs[1:]:
        acc = f"(({acc}) * ({x}) + ({float(c)!r}::double))"
    return acc


def norm_pdf_sql(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2.0::double) * {_INV_SQRT_2PI!r}::double)"


def norm_cdf_sql(x: str) -> str:
    t = f"(1.0::double / (1.0::double + {CDF_P!r}::double * abs({x})))"
    tail = f"({norm_pdf_sql(x)} * {_horner_sql(t, tuple(reversed(CDF_B)))} * {t})"
    return f"(case when ({x}) >= 0 then 1.0::double - {tail} else {tail} end)"


def norm_ppf_sql(p: str) -> str:
    q = f"(({p}) - 0.5::double)"
    r = f"({q} * {q})"
    s = f"sqrt(-2.0::double * ln(1.0::double - ({p})))"
    centre = f"({_horner_sql(r, PPF_A)} * {q} / ({_horner_sql(r, PPF_B)} * {r} + 1.0::double))"
    upper = f"(-({_horner_sql(s, PPF_C)}) / ({_horner_sql(s, PPF_D)} * {s} + 1.0::double))"
    return f"(case when ({p}) <= {PPF_TAIL!r} then {centre} else {upper} end)"
