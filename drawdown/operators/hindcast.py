"""Hindcast protocol: fit on the first H months, compare with what followed."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.curves import fit_udf, rate as arps_rate, remaining_struct
from ..session import materialise
from . import physics as P
from .decline import BEST
from .ranking import dated_row_number

MONTH = 30.4


def library_split(series: DataFrame, *, entity: str = "entity_id", order: str = "start_month") -> DataFrame:
    """Alternate entities by start order: odd positions feed the prior library, even ones are evaluated."""
    heads = series.groupBy(entity).agg(F.min(order).alias(order))
    r = dated_row_number(heads, [], order, entity, total=None)
    return series.join(r.select(entity, (F.col("rn") % 2 == 1).alias("in_library")), entity)


def horizon_rows(series: DataFrame, horizons: Sequence[int], *, entity: str = "entity_id", t: str = "t", q: str = "rate", min_fit: int = 5,
                 min_future: int = 8) -> DataFrame:
    """One row per (entity, H): arrays of the observed part, actual next-12 / next-24 / remaining volumes and the future times."""
    w = Window.partitionBy(entity)
    d = series.withColumn("_last", F.max(t).over(w)).withColumn("_t0", F.min(t).over(w)).where("_last >= 20")
    d = d.withColumn("H", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    x = F.col(t)
    seen, n12, n24 = x < F.col("H"), (x > F.col("H")) & (x < F.col("H") + 12), (x > F.col("H")) & (x < F.col("H") + 24)
    pt = F.struct((x - F.col("_t0")).alias("t"), F.col(q).alias("q"))
    keep = [c for c in ("grp", "cum") if c in series.columns]
    rest = x > F.col("H")
    g = d.groupBy(entity, "H").agg(
        F.array_sort(F.collect_list(F.when(rest, pt))).alias("_r"),
        F.array_sort(F.collect_list(F.when(seen, pt))).alias("_s"), F.array_sort(F.collect_list(F.when(n12, pt))).alias("_a"),
        F.array_sort(F.collect_list(F.when(n24, pt))).alias("_b"), F.max("_last").alias("_last"), F.max("_t0").alias("_t0"),
        *[F.max(k).alias(k) for k in keep])
    g = g.where((F.size("_s") >= min_fit) & (F.size("_a") >= min_future))
    full = (F.size("_b") >= 18) & (F.col("_last") >= F.col("H") + 23)
    vol = lambda a: F.aggregate(a, F.lit(0.0), lambda p, r: p + r["q"]) * MONTH
    return g.select(entity, "H", *keep, F.col("_s.t").alias("ts"), F.col("_s.q").alias("qs"), F.col("_a.t").alias("t12"), F.col("_b.t").alias("t24"), F.col("_r.t").alias("t_rest"),
                    (F.col("H") - F.col("_t0")).cast("double").alias("t_now"), vol("_a").alias("actual12"), vol("_r").alias("actual_rest"), F.when(full, vol("_b")).alias("actual24"))


def _volume(times: str, at):
    return F.aggregate(times, F.lit(0.0), lambda p, x: p + at(x)) * MONTH


def hindcast(rows: DataFrame, priors: DataFrame | None, *, q_econ: float, group: str = "grp") -> DataFrame:
    """Adds arps / physics_wide / physics_analog next-12, next-24 and remaining volumes."""
    d = rows.withColumn("fit", fit_udf(BEST)("ts", "qs"))
    d = P.fit_physics(d, q_econ=q_econ).withColumnRenamed("pfit", "wide")
    if priors is not None:
        d = d.join(priors.select(group, "prior"), group, "left")
        d = P.fit_physics(d, q_econ=q_econ, prior="prior").withColumnRenamed("pfit", "analog").drop("prior")
    else:
        d = d.withColumn("analog", F.col("wide"))
    for name, fn, col in (("arps", arps_rate, "fit"), ("physics_wide", P.rate, "wide"), ("physics_analog", P.rate, "analog")):
        d = d.withColumn(f"{name}_next12", _volume("t12", lambda x, f=fn, k=col: f(x, F.col(k))))
        d = d.withColumn(f"{name}_next24", F.when(F.col("actual24").isNotNull(), _volume("t24", lambda x, f=fn, k=col: f(x, F.col(k)))))
    d = d.withColumn("arps_remaining", remaining_struct(F.col("fit"), F.lit(q_econ), "t_now")["remaining"])
    return d.withColumn("physics_remaining", P.remaining_struct(F.col("analog"), F.lit(q_econ), "t_now")["remaining"]).drop("ts", "qs", "t12", "t24", "t_rest")


def hindcast_errors(h: DataFrame, *, entity: str = "entity_id", bound: tuple[str, str] = ("next12", "next24")) -> DataFrame:
    """Long relative errors (entity, H, method, window, err) of every method."""
    items = ", ".join(f"'{m}', '{w}', {m}_{w} / actual{w[4:]} - 1" for m in ("arps", "physics_wide", "physics_analog") for w in bound)
    n = 3 * len(bound)
    keep = [c for c in ("grp",) if c in h.columns]
    return h.select(entity, "H", *keep, F.expr(f"stack({n}, {items}) as (method, win, err)")).where("err IS NOT NULL")


def log_ratios(rows: DataFrame, *, at_least: int = 20) -> DataFrame:
    """Error model: log(actual / predicted) of the volume that remained after each horizon, for the empirical fit of what was seen before it.

    Both volumes are taken over the months that the entity went on. Horizons with fewer than ``at_least`` samples are dropped.
    """
    d = rows.withColumn("fit", fit_udf(BEST)("ts", "qs")).where("fit.converged").withColumn("_p", _volume("t_rest", lambda x: arps_rate(x, F.col("fit"))))
    r = d.where("_p > 0 AND actual_rest > 0").select("H", "grp", F.ln(F.col("actual_rest") / F.col("_p")).alias("e"))
    r = materialise(r)
    enough = r.groupBy("H").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return r.join(F.broadcast(enough.select("H")), "H", "left_semi")  # one row a horizon
