"""Aggregations, analytic windows and set operations."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import c, guarded_slope, safe_div
from .ranking import exact_percentiles


# ------------------------------------------------------------------ roll-ups
def timeline(monthly: DataFrame, master: DataFrame, *, month: str = "mi", oil: str = "oil",
             days_on: str = "days_on", first: str = "fmi") -> DataFrame:
    """Field totals on a complete month spine, producing and new entity counts, running cumulative."""
    tot = monthly.groupBy(month).agg(F.sum(oil).alias("oil"),
                                     F.sum((F.col(days_on) > 0).cast("long")).alias("n_producing"))
    new = master.groupBy(F.col(first).alias(month)).agg(F.count(F.lit(1)).alias("n_new"))
    spine = tot.agg(F.explode(F.sequence(F.min(month), F.max(month))).alias(month))
    zero = ["oil", "n_producing", "n_new"]
    w = Window.partitionBy(F.lit(0)).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return (spine.join(tot, month, "left").join(new, month, "left").na.fill(0, zero)
            .withColumn("cum_oil", F.sum("oil").over(w)))


def hierarchy_rollup(df: DataFrame, levels: Sequence[str], sums: Sequence[str],
                     ratios: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Additive figures for every level of a hierarchy; ratios recomputed from the sums of each level."""
    out = df.rollup(*levels).agg(*[F.sum(s).alias(s) for s in sums], F.grouping_id().alias("_g"))
    depth = {2 ** (len(levels) - i) - 1: i for i in range(len(levels) + 1)}
    level = F.create_map(*[x for g, d in depth.items() for x in (F.lit(g), F.lit(d))])
    out = out.withColumn("depth", F.element_at(level, F.col("_g").cast("int"))).drop("_g")
    for name, (num, den) in (ratios or {}).items():
        out = out.withColumn(name, safe_div(num, den))
    return out


def grouped_and_overall(df: DataFrame, key: str, aggs: Sequence[Column], overall: str = "all") -> DataFrame:
    """Same aggregates per group and over everything in one pass (grouping sets)."""
    out = df.groupingSets([[F.col(key)], []], F.col(key)).agg(*aggs, F.grouping(key).alias("_all"))
    return out.withColumn(key, F.when(F.col("_all") == 1, overall).otherwise(F.col(key))).drop("_all")


def status_map(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    counts = df.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "_n")))).alias("counts"))


# ------------------------------------------------------------------ statistics
def robust_scale(df: DataFrame, keys: Sequence[str], value: str, floor: float = 0.0) -> DataFrame:
    """Median and 1.4826·MAD per key (exact, two passes, no group ever in one task)."""
    med = exact_percentiles(df, keys, value, {"median": 0.5})
    dev = df.join(med, list(keys)).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mad = exact_percentiles(dev, keys, "_dev", {"_mad": 0.5})
    return med.join(mad, list(keys)).withColumn(
        "robust_sd", F.greatest(F.col("_mad") * 1.4826, F.lit(floor))).drop("_mad")


def icc_oneway(df: DataFrame, value: str, group: str) -> DataFrame:
    """Intra-class correlation of a one-way layout, negative values clipped to 0. One row."""
    g = (df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group)
         .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.var_pop(value).alias("v")))
    grand = g.agg(F.sum("s") / F.sum("n")).scalar()
    t = g.withColumn("_d", F.col("n") * F.pow(F.col("s") / F.col("n") - grand, 2)).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), F.sum("_d").alias("_between"),
        F.sum(F.col("n") * F.col("v")).alias("_within"))
    msb = safe_div("_between", F.col("n_groups") - 1)
    msw = safe_div("_within", F.col("n") - F.col("n_groups"))
    k = F.col("n") / F.col("n_groups")
    icc = F.when((F.col("n_groups") < 2) | (F.col("n") <= F.col("n_groups")), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.coalesce(safe_div(msb - msw, msb + (k - 1) * msw), F.lit(0.0))))
    return t.select("n_groups", "n", icc.alias("icc"))


def model_metrics(df: DataFrame, keys: Sequence[str], *, y: str = "y", p10: str = "p10", p50: str = "p50",
                  p90: str = "p90") -> DataFrame:
    ok = df.where(F.col(y).isNotNull() & F.col(p50).isNotNull()).withColumn("_err", F.abs(F.col(p50) - F.col(y)))
    med = exact_percentiles(ok, keys, "_err", {"medae": 0.5})
    out = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_err").alias("mae"),
        (F.avg(F.col("_err") / F.greatest(F.abs(F.col(y)), F.lit(1e-6))) * 100).alias("mape"),
        F.avg(((F.col(y) >= F.col(p10)) & (F.col(y) <= F.col(p90))).cast("double")).alias("coverage"),
        F.avg(F.col(p90) - F.col(p10)).alias("width"))
    return out.join(med, list(keys)) if keys else out.withColumn("medae", med.scalar())


def error_summary(df: DataFrame, keys: Sequence[str], err: str) -> DataFrame:
    """Relative-error summary: median |e| %, bias %, share over +20 %, 90th percentile %."""
    ok = df.where(F.col(err).isNotNull() & ~F.isnan(err) & (F.abs(F.col(err)) < float("inf"))) \
        .withColumn("_abs", F.abs(F.col(err)))
    base = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 (F.avg((F.col(err) > 0.2).cast("double")) * 100).alias("over20_pct"))
    a = exact_percentiles(ok, keys, "_abs", {"_a": 0.5})
    b = exact_percentiles(ok, keys, err, {"_b": 0.5, "_p": 0.9})
    keys = list(keys)
    return base.join(a, keys).join(b, keys).select(
        *keys, "n", F.round(F.col("_a") * 100, 1).alias("mdape_pct"), F.round(F.col("_b") * 100, 1).alias("bias_pct"),
        F.round("over20_pct", 1).alias("over20_pct"), F.round(F.col("_p") * 100, 1).alias("p90_pct"))


def recovery_reference(df: DataFrame, group: str, *, eur: str = "eur", ooip: str = "ooip", at_least: int = 8,
                       default: tuple[float, float, float] = (1.0, 3.0, 8.0)) -> DataFrame:
    """Recovery-factor band per block, a fixed default where fewer than ``at_least`` entities qualify."""
    rf = df.withColumn("_rf", F.when(F.col(ooip) > 0, F.col(eur) / F.col(ooip) * 100))
    n = rf.groupBy(group).agg(F.count("_rf").alias("n"))
    p = exact_percentiles(rf, [group], "_rf", {"low_pct": .1, "mid_pct": .5, "high_pct": .9})
    j = n.join(p, group, "left")
    few = F.col("n") < at_least
    return j.select(group, "n", F.when(few, "default").otherwise("observed").alias("source"),
                    *[F.when(few, d).otherwise(F.round(k, 2)).alias(k)
                      for k, d in zip(("low_pct", "mid_pct", "high_pct"), default)])


def case_metrics(results: DataFrame, targets: DataFrame, flags: Sequence[str], latency: str,
                 category: str) -> DataFrame:
    """Rate of each flag overall and per category, latency median / p95, compared with targets."""
    rates = F.expr("stack({n}, {items}) as (metric, hit)".format(
        n=len(flags), items=", ".join(f"'{f}', cast({f} as double)" for f in flags)))
    long = results.select(category, rates).where("hit IS NOT NULL")
    by = long.groupingSets([[F.col(category), F.col("metric")], [F.col("metric")]], F.col(category), F.col("metric")).agg(
        F.avg("hit").alias("value"), F.count(F.lit(1)).alias("n"), F.grouping(category).alias("_all"))
    by = by.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(category)).alias(category), "metric", "value", "n")
    lat = exact_percentiles(results, [], latency, {
        "latency_p50": 0.5, "latency_p95": lambda n: F.floor(0.95 * (n - 1))})
    n = results.agg(F.count(latency)).scalar()
    lat = lat.select(F.lit("all").alias(category), F.expr("stack(2, 'latency_p50', latency_p50, 'latency_p95', latency_p95) as (metric, value)"),
                     n.alias("n"))
    j = by.unionByName(lat).join(F.broadcast(targets), "metric", "left")  # targets: one row per metric name
    hit = F.when(F.col("direction") == "max", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return j.select(category, "metric", "value", "n", "target", F.when(F.col("target").isNotNull(), hit).alias("passed"))


# ------------------------------------------------------------------ windows
def running_total(df: DataFrame, *, entity: str, order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def rolling_slope(df: DataFrame, *, entity: str, order: str, x: Column, y: Column, half: int,
                  out: str = "slope") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-half, half)
    ok = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w) >= 3
    return df.withColumn(out, F.when(ok, F.regr_slope(y, x).over(w)))


def steep_onset(df: DataFrame, *, entity: str, order: str, slope: str = "slope", limit: float = -0.85,
                run: int = 3, at: str = "t", out: str = "t_elf") -> DataFrame:
    """First position where ``run`` consecutive slopes are below ``limit``; the test shortens at the series end."""
    w = Window.partitionBy(entity).orderBy(order)
    s = F.coalesce(F.col(slope), F.lit(0.0)) < limit
    cond = s
    for i in range(1, run):
        cond = cond & F.coalesce(F.lead(s, i).over(w), F.lit(True))
    return df.withColumn("_on", cond).groupBy(entity).agg(F.min(F.when(F.col("_on"), F.col(at))).alias(out))


def fill_gaps(df: DataFrame, *, entity: str, order: str, value: str, out: str, back: bool = True) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(order)
    fwd = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if back:
        fwd = F.coalesce(fwd, F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return df.withColumn(out, fwd)


def prefix_sums(df: DataFrame, *, entity: str, order: str, x: str, y: str) -> DataFrame:
    """Running Σ1, Σx, Σy, Σx², Σxy, Σy²: any segment's regression error is then a difference of two rows."""
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.col(x), F.col(y)
    parts = {"n": F.lit(1.0), "sx": a, "sy": b, "sxx": a * a, "sxy": a * b, "syy": b * b}
    return df.select("*", *[F.sum(v).over(w).alias(f"c_{k}") for k, v in parts.items()])


def segment_error(n, sx, sy, sxx, sxy, syy) -> Column:
    """Residual sum of squares of a line through a segment given its sums; empty segments cost 0."""
    n1 = F.greatest(n, F.lit(1.0))
    vx = sxx - sx * sx / n1
    vy = syy - sy * sy / n1
    cov = sxy - sx * sy / n1
    sse = F.when(vx <= 1e-12, vy).otherwise(vy - cov * cov / F.when(vx <= 1e-12, 1.0).otherwise(vx))
    return F.when(n < 2, 0.0).otherwise(F.greatest(sse, F.lit(0.0)))


def first_crossing(df: DataFrame, *, keys: Sequence[str], order: str, rate: str, limit, after: str | None = None,
                   out: str = "alive") -> DataFrame:
    """Alive until the rate first drops below the limit; with ``after`` only rows past that order may kill."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col(rate) >= c(limit)
    if after is not None:
        ok = ok | (F.col(order) < F.col(after))
    return df.withColumn(out, F.min(ok.cast("int")).over(w) == 1)


def period_chain(df: DataFrame, *, unit: str, period: str, opening: str, step) -> DataFrame:
    """Carry a closing balance into the next period where no opening is given.

    The evaluation periods of a unit are few (bounded by the evaluation dates), so they are folded as one
    ordered array. ``step(opening, row)`` returns the closing balance Column.
    """
    cols = [x for x in df.columns if x != unit]
    packed = df.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(period, *[x for x in cols if x != period]))).alias("_p"))
    empty = F.struct(F.lit(None).cast("double").alias("prev"),
                     F.expr("cast(array() as array<struct<opening_used:double,carried:boolean,closing:double>>)").alias("out"))

    def fold(acc, row):
        start = F.coalesce(row[opening], acc["prev"])
        closing = step(start, row)
        item = F.struct(start.cast("double").alias("opening_used"),
                        (row[opening].isNull() & acc["prev"].isNotNull()).alias("carried"),
                        closing.cast("double").alias("closing"))
        return F.struct(closing.cast("double").alias("prev"), F.concat(acc["out"], F.array(item)).alias("out"))

    done = packed.withColumn("_o", F.aggregate("_p", empty, fold)["out"])
    z = done.select(unit, F.explode(F.arrays_zip("_p", "_o")).alias("z"))
    return z.select(unit, *[F.col(f"z._p.{x}").alias(x) for x in cols], "z._o.opening_used", "z._o.carried", "z._o.closing")


def loglinear_decline(df: DataFrame, keys: Sequence[str], *, x: str, rate: str, name: str,
                      at_least: int = 6) -> DataFrame:
    """Monthly and annual decline in % from a log-linear fit on positive rates, with r²."""
    y = F.when(F.col(rate) > 0, F.ln(F.col(rate)))
    g = df.groupBy(*keys).agg(guarded_slope(y, F.col(x), at_least).alias("_s"),
                              F.when(F.regr_count(y, F.col(x)) >= at_least, F.regr_r2(y, F.col(x))).alias(f"{name}_r2"))
    return g.select(*keys, ((1 - F.exp("_s")) * 100).alias(f"{name}_monthly_pct"),
                    ((1 - F.exp(12 * F.col("_s"))) * 100).alias(f"{name}_annual_pct"), f"{name}_r2")
