"""Evaluation of units: type curves, new / old / measure components, shut-in and planned volumes.

Everything is keyed by (entity) or (entity, scenario); fits depend on the entity and its cut-off only and
are joined to the price scenarios afterwards, so one fit serves all scenarios. Tables with a row per entity meet by
merge joins: they grow with the input, and a copy of one that is broadcast is built on the driver.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialise, spread
from ..functions.columns import DAYS_PER_MONTH, c, days_in_month, guarded_slope, safe_div
from ..functions.curves import fit_udf, rate, remaining_struct
from .decline import TERMINAL, entity_decline_fit, remaining_low_best
from .ranking import exact_percentiles
from .series import fit_rate, producing_time
from .spatial import radius_count

HORIZON = 360


@dataclass(frozen=True)
class Config:
    """Rules of a unit evaluation; defaults are the published ones."""
    period: int = 12
    idle: int = 3
    min_fit: int = 12
    open_share: float = 0.5
    curve_history: int = 24
    curve_wells: int = 5
    dynamic_months: int = 12
    max_pre: int = 24
    min_pre: int = 6
    min_post: int = 3
    min_days_on: int = 10
    max_shut_in: int = 24
    pud_radius: float = 1000.0
    pud_neighbours: int = 3
    pud_years: int = 5
    certainty: float = 0.85


# ------------------------------------------------------------------ type curve and analog forecast
def type_curve(monthly: DataFrame, master: DataFrame, as_of: int, cfg: Config, *, unit: str = "unit_id",
               entity: str = "entity_id") -> DataFrame:
    """Median calendar rate by months on production, contiguous from month 1, entities with a long history only."""
    old = master.where(as_of - F.col("fmi") + 1 >= cfg.curve_history).select(entity, unit, "fmi")
    r = monthly.where(F.col("mi") <= as_of).join(old.hint("merge"), entity)
    r = r.select(unit, (F.col("mi") - F.col("fmi") + 1).alias("k"), (F.col("oil") / days_in_month("mi")).alias("rate"))
    med = exact_percentiles(r, [unit, "k"], "rate", {"rate": 0.5})
    n = r.groupBy(unit, "k").agg(F.count(F.lit(1)).alias("n_wells"))
    w = Window.partitionBy(unit).orderBy("k")
    keep = (F.col("k") == F.row_number().over(w)) & (F.col("n_wells") >= cfg.curve_wells)
    g = n.join(med, [unit, "k"]).withColumn("_keep", keep.cast("int"))
    return g.withColumn("_alive", F.min("_keep").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_alive = 1").select(
        unit, "k", "rate", "n_wells")


def packed_curve(curve: DataFrame, *, unit: str = "unit_id") -> DataFrame:
    """(unit, tc array, ext): ext is the monthly decline used beyond the end of the curve."""
    n = F.max("k").over(Window.partitionBy(unit))
    tail = F.when(F.col("k") > F.col("_n") - 12, F.ln(F.greatest("rate", F.lit(1e-6))))
    g = curve.withColumn("_n", n).groupBy(unit).agg(
        F.array_sort(F.collect_list(F.struct("k", "rate"))).alias("s"), guarded_slope(tail, F.col("k"), 2).alias("_s"))
    return g.select(unit, F.col("s.rate").alias("tc"), F.greatest(-F.coalesce("_s", F.lit(-0.02)), F.lit(0.005)).alias("ext"))


def analog_rate(j: Column, months_on, scale) -> Column:
    """Rate j months ahead: scaled type curve, then exponential extension from its last value."""
    size = F.size("tc")
    pos = c(months_on) + j
    beyond = F.element_at("tc", -1) * c(scale) * F.exp(-F.col("ext") * (pos - size))
    return F.when(pos <= size, F.get("tc", pos - 1) * c(scale)).otherwise(beyond)


def volume_until(rate_at, q_econ, horizon: int = HORIZON, start: int = 1) -> Column:
    """Σ rate·30.4 over the months until the rate first drops below the limit."""
    q = c(q_econ)
    zero = F.struct(F.lit(True).alias("on"), F.lit(0.0).alias("v"))

    def step(acc, j):
        r = rate_at(j)
        on = acc["on"] & (r >= q)
        return F.struct(on.alias("on"), F.when(on, acc["v"] + r).otherwise(acc["v"]).alias("v"))

    return F.aggregate(F.sequence(F.lit(start), F.lit(start + horizon - 1)), zero, step)["v"] * DAYS_PER_MONTH


@F.pandas_udf(T.DoubleType())
def analog_volume(tc: pd.Series, ext: pd.Series, months_on: pd.Series, scale: pd.Series, q_econ: pd.Series) -> pd.Series:
    """``volume_until`` of ``analog_rate``, whole batches at once; a rate or limit that is missing ends the sum."""
    out = np.full(len(tc), np.nan)
    j = np.arange(1, HORIZON + 1)
    known = np.flatnonzero(tc.notna().to_numpy() & scale.notna().to_numpy())
    for lo in range(0, len(known), 256):
        at = known[lo:lo + 256]
        curves = [np.asarray(x, float) for x in tc.iloc[at]]
        size = np.array([len(x) for x in curves])
        own = np.arange(max(size.max(), 1)) < size[:, None]
        flat = np.full(own.shape, np.nan)
        flat[own] = np.concatenate(curves)
        e, n, k, q = (x.iloc[at].to_numpy(float)[:, None] for x in (ext, months_on, scale, q_econ))
        pos = n + j
        inside = np.take_along_axis(flat, np.clip(pos - 1, 0, flat.shape[1] - 1).astype(int), 1) * k
        last = np.take_along_axis(flat, np.maximum(size - 1, 0)[:, None], 1)
        with np.errstate(invalid="ignore", over="ignore"):
            r = np.where(pos <= size[:, None], np.where(pos >= 1, inside, np.nan), last * k * np.exp(-e * (pos - size[:, None])))
            on = np.logical_and.accumulate(r >= q, axis=1)
        out[at] = np.where(on, r, 0.0).sum(1) * DAYS_PER_MONTH
    return pd.Series(out)


analog_volume = analog_volume.asNondeterministic()


# ------------------------------------------------------------------ new entities
def new_entity_reserves(monthly: DataFrame, info: DataFrame, curves: DataFrame, econ: DataFrame, as_of: int, cfg: Config, *,
                        model: DataFrame | None = None, entity: str = "entity_id", unit: str = "unit_id") -> DataFrame:
    """Dynamic, analog and model estimate side by side; best = dynamic else analog, capped by the model's low case.

    ``monthly`` holds only the rows that may be used, ``econ`` one row per (unit, scenario).
    """
    m = monthly.where(F.col("mi") <= as_of).join(info.select(entity, unit, "fmi").hint("merge"), entity)
    m = m.withColumn("rate", F.col("oil") / days_in_month("mi")).withColumn("k", F.col("mi") - F.col("fmi") + 1)
    g = spread(m, entity).groupBy(entity).agg(
        F.max(unit).alias(unit), F.max("fmi").alias("fmi"), F.sum("oil").alias("cum"),
        F.array_sort(F.collect_list(F.struct("k", "rate"))).alias("_s"))
    g = g.withColumn("months_on", (as_of - F.col("fmi") + 1).cast("long")).withColumn("_r", F.col("_s.rate"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    last3 = F.slice("_r", F.greatest(F.size("_r") - 2, F.lit(1)), 3)
    g = g.withColumn("rate_now", total(last3) / F.size(last3))
    # dynamic: from the first maximum on, by record position
    kp = F.array_position("_r", F.array_max("_r"))
    post = F.slice("_r", kp, F.size("_r"))
    g = g.withColumn("_post", F.when(F.size("_r") >= cfg.dynamic_months, post)).withColumn(
        "_post", F.when((F.size("_post") >= 6) & (F.size(F.filter("_post", lambda v: v > 0)) >= 6), F.col("_post")))
    t = F.transform(F.sequence(F.lit(0), F.size("_post") - 1), lambda i: i.cast("double"))
    dyn = g.where("_post IS NOT NULL").select(entity, t.alias("ts"), F.col("_post").alias("qs"))
    dyn = dyn.withColumn("dyn_fit", fit_udf(TERMINAL)("ts", "qs")).select(entity, "dyn_fit", (F.size("ts") - 1).cast("double").alias("_tn"))
    g = g.join(dyn.hint("merge"), entity, "left").join(curves, unit, "left")
    inside = F.filter("_s", lambda r: (r["k"] >= 1) & (r["k"] <= F.size("tc")))
    den = total(F.transform(inside, lambda r: F.get("tc", r["k"] - 1)))
    use = (F.size("tc") > F.col("months_on")) & (den > 0)
    g = g.withColumn("scale", F.when(use, total(F.transform(inside, lambda r: r["rate"])) / den))
    g = g.drop("_s", "_r", "_post")
    if model is not None:
        g = g.join(model.select(entity, F.col("p10").alias("_p10")).hint("merge"), entity, "left").withColumn(
            "model_low", F.greatest(F.col("_p10") - F.col("cum"), F.lit(0.0))).drop("_p10")
    else:
        g = g.withColumn("model_low", F.lit(None).cast("double"))
    e = g.join(econ.select(unit, "scenario", "q_econ"), unit)
    e = e.withColumn("dynamic_t", F.when(F.col("dyn_fit").isNotNull(), remaining_struct(F.col("dyn_fit"), "q_econ", "_tn")["remaining"]))
    e = e.withColumn("analog_t", F.when(F.col("scale").isNotNull(), analog_volume("tc", "ext", "months_on", "scale", "q_econ")))
    return pick_new_reserves(e)


def pick_new_reserves(e: DataFrame) -> DataFrame:
    best = F.coalesce("dynamic_t", "analog_t")
    key = F.when(F.col("dynamic_t").isNotNull(), "dynamic").when(F.col("analog_t").isNotNull(), "analog")
    low = F.col("model_low")
    capped = best.isNull() | (low < best)
    return (e.withColumn("best_estimate", best)
            .withColumn("reserves", F.when(low.isNotNull() & capped, low).otherwise(best))
            .withColumn("basis", F.when(low.isNotNull() & capped, "model_low").otherwise(key)))


# ------------------------------------------------------------------ measures
def measure_effects(monthly: DataFrame, events: DataFrame, as_of: int, cfg: Config, *, entity: str = "entity_id") -> DataFrame:
    """One row per (entity, emi, event_type): baseline from the months before, increments after.

    ``events`` carries (entity, emi, event_type); rates are per producing day.
    """
    ev = events.where(F.col("emi") <= as_of).select(entity, "emi", "event_type").distinct()
    keys = [entity, "emi", "event_type"]
    m = (monthly.where(F.col("mi") <= as_of).select(entity, "mi", "oil", "days_on").join(ev.hint("merge"), entity)
         .withColumn("rate", F.col("oil") / F.greatest("days_on", F.lit(1)))
         .withColumn("valid", F.col("days_on") >= cfg.min_days_on))
    is_pre = F.col("valid") & (F.col("mi") < F.col("emi")) & (F.col("mi") >= F.col("emi") - cfg.max_pre)
    pre_pts = m.where(is_pre)
    base = spread(pre_pts, *keys).groupBy(*keys).agg(
        F.min("mi").alias("t0"), F.count(F.lit(1)).alias("n_pre"),
        F.array_sort(F.collect_list(F.struct("mi", "rate"))).alias("_p")).where(F.col("n_pre") >= cfg.min_pre)
    t0 = F.col("t0")
    base = base.withColumn("ts", F.transform("_p", lambda r: (r["mi"] - t0).cast("double"))).withColumn("qs", F.col("_p.rate"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q) / F.size(a)
    base = base.withColumn("pre_rate", mean(F.slice("qs", F.greatest(F.size("qs") - 2, F.lit(1)), 3)))
    base = materialise(base.withColumn("fit", fit_udf(TERMINAL)("ts", "qs")).drop("_p", "ts", "qs"), plain=True)  # two branches take the fits
    after = m.where(F.col("mi") >= F.col("emi")).join(base.hint("merge"), keys)
    after = after.withColumn("base", rate(F.col("mi") - F.col("t0"), F.col("fit")))
    inc = F.col("rate") - F.col("base")
    is_post = F.col("valid") & (F.col("mi") > F.col("emi"))
    after = after.withColumn("inc", F.when(is_post, inc)).withColumn("d", (F.col("mi") - F.col("emi")).cast("double"))
    g = after.groupBy(*keys).agg(
        F.sum(F.col("oil") - F.col("base") * F.col("days_on")).alias("realized"),
        F.sum(is_post.cast("long")).alias("n_post"), F.max(F.when(is_post, F.col("mi"))).alias("_last"),
        guarded_slope(F.when(F.col("inc") > 0, F.ln("inc")), F.col("d")).alias("_slope"),
        F.array_sort(F.collect_list(F.when(is_post, F.struct("mi", "rate", "inc")))).alias("_q"))
    last3 = F.slice("_q", F.greatest(F.size("_q") - 2, F.lit(1)), 3)
    first3 = F.slice("_q", 1, 3)
    g = (g.withColumn("inc_now", F.when(F.size("_q") > 0, F.greatest(mean(F.transform(last3, lambda r: r["inc"])), F.lit(0.0))))
         .withColumn("rate_gain", F.when(F.size("_q") > 0, mean(F.transform(first3, lambda r: r["inc"]))))
         .withColumn("post_rate", F.when(F.size("_q") > 0, mean(F.transform(first3, lambda r: r["rate"])))).drop("_q"))
    n_pre = pre_pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pre"))
    out = ev.join(n_pre.hint("merge"), keys, "left").join(base.drop("n_pre").hint("merge"), keys, "left").join(g.hint("merge"), keys, "left")
    out = out.withColumn("n_pre", F.coalesce("n_pre", F.lit(0))).withColumn("n_post", F.coalesce("n_post", F.lit(0)))
    status = (F.when(F.col("n_pre") < cfg.min_pre, "insufficient_pre").when(F.col("n_post") < cfg.min_post, "insufficient_post").otherwise("ok"))
    tn = (F.col("_last") - F.col("t0")).cast("double")
    q1, q2 = rate(tn, F.col("fit")), rate(tn + 1, F.col("fit"))
    own = F.ln(F.greatest(q1, F.lit(1e-9)) / F.greatest(q2, F.lit(1e-9)))
    d_inc = F.greatest(F.when(F.col("_slope") < 0, -F.col("_slope")).otherwise(own), F.lit(0.005))
    ok = F.col("status") == "ok"
    return (out.withColumn("status", status).withColumn("t_now", F.when(ok, tn)).withColumn("d_inc", F.when(ok, d_inc))
            .withColumn("inc_now", F.when(ok, F.col("inc_now"))).withColumn("rate_gain", F.when(ok, F.col("rate_gain")))
            .withColumn("post_rate", F.when(ok, F.col("post_rate")))
            .withColumn("realized", F.when(F.col("status") != "insufficient_pre", F.coalesce("realized", F.lit(0.0))))
            .withColumn("effective", F.when(ok, F.col("realized") > 0)).drop("_last", "_slope"))


def increment_remaining(q_econ) -> Column:
    """Remaining volume with the measure minus without, both cut at the limit; needs fit, t_now, inc_now, d_inc."""
    def base(h):
        return rate(F.col("t_now") + h, F.col("fit"))
    with_m = volume_until(lambda h: base(h) + F.col("inc_now") * F.exp(-F.col("d_inc") * h), q_econ)
    return F.greatest(with_m - volume_until(base, q_econ), F.lit(0.0))


def measure_increments(monthly: DataFrame, effects: DataFrame, *, entity: str = "entity_id") -> DataFrame:
    """(entity, emi, event_type, mi, inc): monthly production above the baseline since the event month."""
    e = effects.where("fit IS NOT NULL").select(entity, "emi", "event_type", "t0", "fit")
    j = monthly.select(entity, "mi", "oil", "days_on").join(e.hint("merge"), entity).where(F.col("mi") >= F.col("emi"))
    return j.select(entity, "emi", "event_type", "mi",
                    (F.col("oil") - rate(F.col("mi") - F.col("t0"), F.col("fit")) * F.col("days_on")).alias("inc"))


def summarize_measures(effects: DataFrame, key: str = "event_type") -> DataFrame:
    """Counts, effective share and means over evaluated measures, per type and overall; needs inc_remaining."""
    ok = F.col("status") == "ok"
    def mean(x):
        return F.avg(F.when(ok, F.col(x)))
    def total(x):
        return F.coalesce(F.sum(F.when(ok, F.col(x))), F.lit(0.0))
    e = effects.withColumn("inc_eur", F.col("realized") + F.col("inc_remaining"))
    from .stats import grouped_and_overall
    g = grouped_and_overall(e, key, [
        F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("n_evaluated"),
        F.sum((ok & F.col("effective")).cast("long")).alias("n_effective"),
        mean("pre_rate").alias("pre_rate_avg"), mean("post_rate").alias("post_rate_avg"), mean("rate_gain").alias("rate_gain_avg"),
        mean("inc_eur").alias("inc_eur_avg"), total("inc_eur").alias("inc_eur_total"), total("inc_remaining").alias("inc_remaining_total"),
        total("realized").alias("realized_total")])
    return g.withColumn("effective_rate_pct", safe_div(F.col("n_effective") * 100.0, "n_evaluated"))


# ------------------------------------------------------------------ production composition
def monthly_composition(monthly: DataFrame, master: DataFrame, increments: DataFrame, *, since: int, start: int, end: int,
                        unit: str = "unit_id", entity: str = "entity_id") -> DataFrame:
    """Total = new entities + measure increments + old base, per unit and month.

    ``increments`` come from measures; those before ``since`` or on new entities are not separated.
    """
    info = master.select(entity, unit, "fmi")
    m = monthly.where(F.col("mi").between(start, end)).join(info.hint("merge"), entity)
    new = F.col("fmi") >= since
    g = m.groupBy(unit, "mi").agg(
        F.sum("oil").alias("total_oil"), F.sum(F.when(new, F.col("oil")).otherwise(0.0)).alias("new_oil"),
        F.sum((F.col("days_on") > 0).cast("long")).alias("n_producing"),
        F.sum(((F.col("days_on") > 0) & new).cast("long")).alias("n_new_producing"))
    kept = increments.where(F.col("emi") >= since).join(info.where(~new).hint("merge"), entity)
    inc = kept.where(F.col("mi").between(start, end)).groupBy(unit, "mi").agg(F.sum("inc").alias("measure_inc"))
    n_ev = kept.select(unit, entity, "emi", "event_type").distinct().groupBy(unit, F.col("emi").alias("mi")).agg(F.count(F.lit(1)).alias("_ev"))
    j = g.join(inc, [unit, "mi"], "left").join(n_ev, [unit, "mi"], "full_outer").na.fill(0.0, ["measure_inc"])
    w = Window.partitionBy(unit).orderBy("mi").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("n_measures_cum", F.coalesce(F.sum("_ev").over(w), F.lit(0))).where(F.col("total_oil").isNotNull()).drop("_ev")
    return (j.withColumn("old_base", F.col("total_oil") - F.col("new_oil") - F.col("measure_inc"))
            .withColumn("n_old_producing", F.col("n_producing") - F.col("n_new_producing"))
            .withColumn("old_base_rate", F.col("old_base") / days_in_month("mi")))


# ------------------------------------------------------------------ old entities and shut-ins
def old_entities(monthly: DataFrame, master: DataFrame, effects: DataFrame, curves: DataFrame, econ: DataFrame, as_of: int, cfg: Config,
                 *, entity: str = "entity_id", unit: str = "unit_id") -> DataFrame:
    """Status and remaining volume of every entity older than the period, per scenario.

    ``effects`` are the in-period measures; entities with a usable baseline are fitted on earlier months only.
    ``econ`` carries (unit, scenario, q_econ, restart_min).
    """
    start = as_of - cfg.period + 1
    old = master.where(F.col("fmi") < start).select(entity, unit, "fmi")
    cut = effects.where("status IN ('ok', 'insufficient_post')").groupBy(entity).agg(F.max("emi").alias("cutoff"))
    m = monthly.where(F.col("mi") <= as_of).join(old.hint("merge"), entity)
    m = producing_time(m, entity=entity)
    m = fit_rate(m, share=cfg.open_share).join(cut.hint("merge"), entity, "left")
    w = Window.partitionBy(entity)
    m = (m.withColumn("_recent", F.sum(F.when(F.col("mi") > as_of - cfg.idle, F.col("oil")).otherwise(0.0)).over(w))
         .withColumn("last_prod", F.max(F.when(F.col("oil") > 0, F.col("mi"))).over(w))
         .withColumn("gap", F.max("idle_months").over(w)))
    producing = F.col("_recent") > 0
    usable = F.when(producing, F.col("cutoff").isNull() | (F.col("mi") < F.col("cutoff"))).otherwise(F.col("mi") <= F.col("last_prod"))
    head = m.groupBy(entity).agg(F.max(unit).alias(unit), F.max("fmi").alias("fmi"), F.max("cutoff").alias("cutoff"),
                                 F.max(producing.cast("int")).alias("_prod"), F.max("last_prod").alias("last_prod"),
                                 F.max("gap").alias("gap"),
                                 F.max(F.when(F.col("mi") <= F.col("last_prod"), F.col("ptime"))).alias("_last_eff"))
    pts = m.where(usable).select(entity, F.col("ptime").alias("t"), F.col("fit_rate").alias("q"))
    fits = entity_decline_fit(pts, entity, min_tail=cfg.min_fit)
    j = head.join(fits.hint("merge"), entity, "left")
    j = materialise(j.withColumn("now_eff", F.when(F.col("_prod") == 1, as_of - F.col("gap")).otherwise(F.col("_last_eff"))), plain=True)
    fitted = spread(j.where("best IS NOT NULL"), entity).join(econ.select(unit, "scenario", "q_econ", "restart_min"), unit)
    fitted = remaining_low_best(fitted, q_econ=F.col("q_econ"), now=F.col("now_eff"))
    fitted = fitted.withColumn("rate_now", rate(F.col("now_eff") - F.col("fit_start"), F.col("best")))
    # producing entities without a usable fit fall back to the analog ladder on the same months
    short = j.where("best IS NULL AND _prod = 1")
    rows = m.where(producing & usable).select(entity, "mi", "oil").join(short.select(entity).hint("merge"), entity, "left_semi")
    alt = new_entity_reserves(rows, short.select(entity, unit, "fmi"), curves, econ, as_of, cfg, entity=entity, unit=unit)
    alt = alt.where("reserves IS NOT NULL").select(entity, "scenario", F.col("reserves").alias("_alt"), F.col("basis").alias("_basis"), F.col("rate_now").alias("_alt_rate"))
    base = j.select(entity, unit, "cutoff", "_prod", "last_prod", "gap", F.col("best").isNotNull().alias("_fit"), "n_fit",
                    "best", "low", "fit_start", "now_eff").join(
        econ.select(unit, "scenario"), unit)
    f = fitted.select(entity, "scenario", "remaining_low", "remaining_best", "rate_now", "restart_min")
    out = base.join(f.hint("merge"), [entity, "scenario"], "left").join(alt.hint("merge"), [entity, "scenario"], "left")
    prod = F.col("_prod") == 1
    status = (F.when(~prod, "not_producing").when(F.col("_fit"), "ok").when(F.col("_alt").isNotNull(), "short_history").otherwise("insufficient"))
    basis = (F.when(F.col("status") == "ok", F.when(F.col("cutoff").isNotNull(), "measure_baseline").otherwise("own_history"))
             .when(F.col("status") == "short_history", F.col("_basis")))
    shut = (as_of - F.col("last_prod")).cast("long")
    pd_ok = (F.col("remaining_low") > 0) & (F.col("remaining_low") >= F.coalesce("restart_min", F.lit(0.0)))
    pdnp = (F.when(prod, None).when(F.col("last_prod").isNull(), "no_history").when(shut > cfg.max_shut_in, "long_shut_in")
            .when(~F.col("_fit"), "no_fit").when(pd_ok, "booked").otherwise("uneconomic"))
    zero = F.lit(0.0)
    return out.withColumn("status", status).withColumn("pdnp_status", pdnp).select(
        entity, unit, "scenario", "status", basis.alias("basis"), "n_fit", F.col("gap").alias("gap_months"), "last_prod", F.when(~prod, shut).alias("shut_in_months"),
        F.when(prod & F.col("_fit"), F.col("remaining_low")).when(prod, F.coalesce("_alt", zero)).otherwise(zero).alias("remaining_low"),
        F.when(prod & F.col("_fit"), F.col("remaining_best")).when(prod, F.coalesce("_alt", zero)).otherwise(zero).alias("remaining_best"),
        F.when(prod, F.coalesce("rate_now", "_alt_rate")).alias("rate_now"), "pdnp_status",
        F.when(~prod, F.when(F.col("pdnp_status") == "booked", F.col("remaining_low")).otherwise(zero)).alias("pdnp"),
        F.when((F.col("pdnp_status").isin("booked", "uneconomic")), F.col("remaining_low")).alias("pdnp_estimate"),
        "cutoff", "best", "low", "fit_start", "now_eff")


# ------------------------------------------------------------------ planned locations
def planned_locations(locations: DataFrame, producing: DataFrame, drilled: DataFrame, curves: DataFrame, econ: DataFrame, as_of: int,
                      cfg: Config, *, fx: float, default_capex: float, unit: str = "unit_id") -> DataFrame:
    """Booking status of planned locations: ordered rules, five-year deadline, continuity, cash test.

    ``locations``: location_id, unit, x, y, planned_mi, first_booked_mi, status, drilled_id, capex.
    ``drilled``: (drilled_id, drilled_fmi). ``econ``: unit, scenario, q_econ, net_t, opex_month.
    """
    near = radius_count(locations, producing, cfg.pud_radius, ident="location_id", split=None, out="n_near").select("location_id", "n_near")
    fc = curves.where(F.size("tc") >= 2).join(econ, unit)
    zero = F.lit(cfg.certainty)
    def at(j):
        return analog_rate(j, F.lit(0), zero)
    # truncation starts at the curve's first maximum
    peak = F.aggregate(F.sequence(F.lit(1), F.lit(HORIZON)), F.struct(F.lit(0).alias("k"), F.lit(-1.0).alias("v")),
                       lambda a, j: F.when(at(j) > a["v"], F.struct(j.alias("k"), at(j).alias("v"))).otherwise(a))["k"]
    fc = fc.withColumn("_kp", peak)

    def step(acc, j):
        r = at(j)
        on = acc["on"] & ((j < F.col("_kp")) | (r >= F.col("q_econ")))
        return F.struct(on.alias("on"), F.when(on, acc["v"] + r).otherwise(acc["v"]).alias("v"), F.when(on, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    acc0 = F.struct(F.lit(True).alias("on"), F.lit(0.0).alias("v"), F.lit(0).alias("n"))
    fc = fc.withColumn("_a", F.aggregate(F.sequence(F.lit(1), F.lit(HORIZON)), acc0, step))
    fc = fc.select(unit, "scenario", (F.col("_a.v") * DAYS_PER_MONTH).alias("estimate"), F.col("_a.n").cast("long").alias("n_months"),
                   ((F.col("_a.v") * DAYS_PER_MONTH * F.col("net_t") - F.col("_a.n") * F.col("opex_month")) * fx / 1e4).alias("cash"))
    j = (locations.join(near.hint("merge"), "location_id").join(drilled.hint("merge"), "drilled_id", "left")
         .join(econ.select(unit, "scenario"), unit).join(fc, [unit, "scenario"], "left"))
    fb = F.col("first_booked_mi")
    booked_mi = F.when(fb <= as_of, fb).otherwise(as_of)
    j = j.withColumn("deadline_mi", F.coalesce(booked_mi, F.lit(as_of)) + cfg.pud_years * 12).withColumn(
        "capex", F.when(F.coalesce("capex", F.lit(0.0)) == 0, default_capex).otherwise(F.col("capex")))
    status = (
        F.when(F.coalesce(F.col("drilled_fmi") <= as_of, F.lit(False)) | ((F.col("status") == "drilled") & F.col("drilled_id").isNull()), "drilled")
        .when(F.col("status") == "cancelled", "cancelled").when(fb > as_of, "not_booked_yet")
        .when(F.lit(as_of) >= F.col("deadline_mi"), "expired_5yr").when(F.col("planned_mi") > F.col("deadline_mi"), "beyond_5yr")
        .when(F.col("estimate").isNull(), "no_type_curve").when(F.col("n_near") < cfg.pud_neighbours, "not_certain")
        .when(F.col("cash") < F.col("capex"), "uneconomic").otherwise("booked"))
    j = j.withColumn("status", status)
    booked = F.col("status") == "booked"
    return j.select("location_id", unit, "scenario", "status", "planned_mi", "first_booked_mi", "deadline_mi", "n_near", "capex", "cash", "estimate", "n_months",
                    F.when(booked, F.col("estimate")).otherwise(0.0).alias("reserves"),
                    (booked & (fb.isNull() | (fb == as_of))).alias("new_booking"),
                    ((F.col("deadline_mi") - as_of) / 12.0).alias("years_to_deadline"))


# ------------------------------------------------------------------ the whole evaluation
@dataclass
class Evaluation:
    as_of: int
    old: DataFrame
    new: DataFrame
    measures: DataFrame
    effects: DataFrame
    components: DataFrame
    production: DataFrame
    curves: DataFrame


def evaluate(monthly: DataFrame, master: DataFrame, events: DataFrame, new_entities: DataFrame, econ: DataFrame, as_of: int, cfg: Config, *,
             model: DataFrame | None = None, entity: str = "entity_id", unit: str = "unit_id", store: bool = False) -> Evaluation:
    """All units and scenarios of one evaluation date in one plan. Components come out long: (unit, scenario, component, …).

    ``store`` writes the rows of old and new entities and of measures once, for callers that take several of the tables.
    """
    start = as_of - cfg.period + 1
    info = master.select(entity, unit, "fmi")
    m = monthly.where(F.col("mi") <= as_of)
    econ = materialise(econ)  # a few rows a unit, read by many joins: else each builds the prices and their copies on the driver again
    eff = materialise(measure_effects(m, events, as_of, cfg, entity=entity).join(info.hint("merge"), entity).withColumn(
        "in_period", (F.col("emi") >= start) & (F.col("fmi") < start)), plain=True)
    curves = materialise(packed_curve(type_curve(m, master, as_of, cfg, unit=unit, entity=entity), unit=unit))
    old = old_entities(m, master, eff.where("in_period"), curves, econ, as_of, cfg, entity=entity, unit=unit)
    fresh = materialise(new_entities.select(entity, unit, "fmi", "category", "n_old"), plain=True)
    rows = m.join(fresh.select(entity).hint("merge"), entity, "left_semi")
    new = new_entity_reserves(rows, fresh, curves, econ, as_of, cfg, model=model, entity=entity, unit=unit).join(
        fresh.select(entity, "category", "n_old").hint("merge"), entity)
    done = eff.where("in_period AND status = 'ok'").join(econ.select(unit, "scenario", "q_econ"), unit)
    done = done.withColumn("inc_remaining", increment_remaining("q_econ"))
    prod = m.where(F.col("mi") >= start).groupBy(entity).agg(F.sum("oil").alias("production")).join(info.hint("merge"), entity, "inner")
    if store:
        old, new, done = (materialise(d, plain=True) for d in (old, new, done))
    a = old.groupBy(unit, "scenario").agg(
        F.lit("old_base").alias("component"), F.sum("remaining_low").alias("reserves"),
        F.sum(F.col("status").isin("ok", "short_history").cast("long")).alias("n_items"))
    b = done.groupBy(unit, "scenario").agg(F.lit("measure").alias("component"), F.sum("inc_remaining").alias("reserves"), F.count(F.lit(1)).alias("n_items"))
    c_ = new.groupBy(unit, "scenario", F.when(F.col("category") == "infill", "new_infill").otherwise("extension").alias("component")).agg(
        F.sum(F.coalesce("reserves", F.lit(0.0))).alias("reserves"), F.count(F.lit(1)).alias("n_items"))
    comp = a.unionByName(b).unionByName(c_.select(unit, "scenario", "component", "reserves", "n_items"))
    return Evaluation(as_of, old, new, eff, done, comp, prod, curves)
