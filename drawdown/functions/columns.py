"""Small Column expressions shared by the operators (all JVM-side)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

DAYS_PER_MONTH = 30.4  # averaging month used for every monthly volume


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ------------------------------------------------------------------ months
def month_index(d) -> Column:
    """Months since year 0 (January = 0 of its year), the integer time axis of all monthly series."""
    d = c(d)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def month_label(idx) -> Column:
    i = c(idx)
    return F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"))


def month_start(idx) -> Column:
    i = c(idx)
    return F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))


def days_in_month(idx) -> Column:
    return F.day(F.last_day(month_start(idx)))


def period_start(as_of, months: int) -> Column:
    """First month of the evaluation period that ends in the month of ``as_of``."""
    return month_index(as_of) - months + 1


def years_back(as_of, years: int) -> Column:
    return month_index(as_of) - 12 * years + 1


# ------------------------------------------------------------------ null / rounding hygiene
def clean(x) -> Column:
    """NaN and NULL unified to NULL."""
    x = c(x).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def rnd(x, nd: int = 4) -> Column:
    return F.round(c(x).cast("double"), nd)


def safe_div(a, b) -> Column:
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def guarded_slope(y, x, at_least: int = 3) -> Column:
    """Least-squares slope, NULL when fewer than ``at_least`` complete pairs."""
    y, x = c(y), c(x)
    return F.when(F.regr_count(y, x) >= at_least, F.regr_slope(y, x))


# ------------------------------------------------------------------ deterministic randomness
def hash_uniform(*keys) -> Column:
    """Uniform (0,1) from the first 13 hex digits of md5(keys): independent of partitioning and re-runs."""
    text = F.concat_ws("|", *[c(k).cast("string") for k in keys])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(2 ** 52))


# Coefficients of the published rational approximations of the normal quantile
# (P. J. Acklam) and of the normal distribution function (Abramowitz & Stegun 26.2.17).
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687,
         138.3577518672690, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866,
         66.80131188771972, -13.28068155288572)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
         -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
PPF_LOW = 0.02425
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CDF_P = 0.2316419


def horner(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(float(coefs[0]))
    for k in coefs[1:]:
        out = out * x + float(k)
    return out


def normal_ppf(u, tail=None) -> Column:
    u = c(u)
    tail = c(tail) if tail is not None else F.sqrt(-2.0 * F.ln(F.when(u < 0.5, u).otherwise(1.0 - u)))
    t = horner(PPF_C, tail) / (horner(PPF_D, tail) * tail + 1.0)
    q = u - 0.5
    r = q * q
    mid = horner(PPF_A, r) * q / (horner(PPF_B, r) * r + 1.0)
    return F.when(u < PPF_LOW, t).when(u > 1 - PPF_LOW, -t).otherwise(mid)


def with_normal(df, name: str, *keys):
    """Add a standard normal draw keyed by a hash; the uniform and the tail term are separate columns so that each
    row evaluates them once."""
    u, t = f"_u_{name}", f"_t_{name}"
    d = df.withColumn(u, hash_uniform(*keys))
    d = d.withColumn(t, F.sqrt(-2.0 * F.ln(F.when(F.col(u) < 0.5, F.col(u)).otherwise(1.0 - F.col(u)))))
    return d.withColumn(name, normal_ppf(u, t)).drop(u, t)


def normal_cdf(z) -> Column:
    z = c(z)
    t = 1.0 / (1.0 + CDF_P * F.abs(z))
    poly = horner(tuple(reversed(CDF_B)), t) * t
    upper = F.exp(-z * z / 2.0) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


# ------------------------------------------------------------------ arrays
def array_lerp(values, u) -> Column:
    """Linear interpolation of sorted ``values`` placed at plotting positions (i + .5)/n."""
    v, u = c(values), c(u)
    n = F.size(v)
    pos = F.greatest(F.lit(0.0), F.least(u * n - 0.5, (n - 1).cast("double")))
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, n - 1)
    a, b = F.get(v, lo), F.get(v, hi)
    return a + (b - a) * (pos - lo)
