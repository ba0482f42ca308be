"""Early-window and static features."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import guarded_slope
from .spatial import nearest, with_fallback_group
from .stats import fill_gaps


def early_features(df: DataFrame, obs_days: int, *, entity: str = "entity_id", day: str = "day_index",
                   oil: str = "oil", on: str = "hours_on", whp: str = "whp", water_cut: str = "water_cut",
                   gor: str = "gor", cums=(30, 60, 90), tail: int = 14, ends: int = 5) -> DataFrame:
    """Features of the first ``obs_days`` only; one pass of windows, one aggregation."""
    w = df.where(F.col(day) <= obs_days)
    q, d, p = F.col(oil), F.col(day).cast("double"), F.col(whp)
    live = F.col(on) > 0
    per = Window.partitionBy(entity)
    x = (
        w.withColumn("_on", live)
        .withColumn("_qmax", F.max(F.when(live, q)).over(per)).withColumn("_dmax", F.max(F.when(live, d)).over(per))
        .withColumn("_rk", F.when(live, F.row_number().over(Window.partitionBy(entity, "_on").orderBy(day))))
        .withColumn("_rd", F.when(live, F.row_number().over(Window.partitionBy(entity, "_on").orderBy(F.desc(day)))))
    )
    qo = F.when(live, q)
    g = x.groupBy(entity).agg(
        *[(F.sum(F.when(d <= k, q).otherwise(0.0)) if obs_days >= k else F.lit(None).cast("double")).alias(f"cum_{k}d") for k in cums],
        F.sum(q).alias("cum_obs"), F.max(qo).alias("q_max_obs"), F.avg(qo).alias("q_mean_obs"),
        F.avg(F.when(live & (d >= F.col("_dmax") - tail), q)).alias("q_tail_mean"),
        F.stddev_pop(qo).alias("_sd"), (F.avg(F.when(live, F.col(on))) / 24).alias("uptime"),
        F.sum(live.cast("int")).cast("double").alias("n_obs_days"),
        guarded_slope(F.when(live & (q > 0.2 * F.col("_qmax")), F.ln(F.greatest(q, F.lit(1e-3)))), d).alias("ramp_slope"),
        F.min(F.when(live & (q >= 0.5 * F.col("_qmax")), d)).alias("days_to_half_max"),
        F.min(F.when(live & (q == F.col("_qmax")), d)).alias("days_to_max_obs"), F.max("_dmax").alias("_dl"),
        F.avg(F.when(F.col("_rk") <= ends, p)).alias("whp_first"), F.avg(F.when(F.col("_rd") <= ends, p)).alias("whp_last"),
        guarded_slope(F.when(live, p), d).alias("dp_dt"), F.stddev_pop(F.when(live, p)).alias("_psd"), F.avg(F.when(live, p)).alias("_pm"),
        guarded_slope(F.when(live, F.col(water_cut)), d).alias("wc_slope"),
        F.avg(F.when(F.col("_rd") <= ends, F.col(water_cut))).alias("wc_last"),
        F.avg(F.when(live, F.col(gor))).alias("gor_mean"),
    )
    return (
        g.withColumn("q_cv", F.col("_sd") / F.greatest("q_mean_obs", F.lit(1e-6)))
        .withColumn("max_at_edge", (F.col("days_to_max_obs") >= F.col("_dl") - 3).cast("double"))
        .withColumn("whp_drop", F.col("whp_first") - F.col("whp_last"))
        .withColumn("pi_proxy", F.col("cum_obs") / F.greatest("whp_drop", F.lit(1e-3)))
        .withColumn("whp_cv", F.col("_psd") / F.greatest("_pm", F.lit(1e-6)))
        .drop("_sd", "_dl", "_psd", "_pm")
    )


def completion_features(df: DataFrame, *, perm: str, proppant: str, stages: str, net_pay: str, well_type: str,
                        horizontal: str) -> DataFrame:
    return df.select(
        "*", F.log10(F.greatest(F.col(perm), F.lit(1e-4))).alias("log_perm"),
        (F.col(proppant) / F.greatest(F.col(stages), F.lit(1))).alias("proppant_per_stage"),
        (F.col(well_type) == horizontal).cast("double").alias("is_horizontal"),
        (F.col(perm) * F.col(net_pay)).alias("kh"))


def neighbour_features(master: DataFrame, labels: DataFrame, k: int = 5, *, entity: str = "entity_id",
                       group: str = "layer", min_pool: int = 2, cell: float = 4.0) -> DataFrame:
    """Distances to and label medians of the k nearest labelled entities (same group if it has enough)."""
    refs = labels.join(master.select(entity, group, "x", "y"), entity).withColumnRenamed(entity, "ref_id")
    p, r = with_fallback_group(master, refs, ident=entity, ref_ident="ref_id", group=group, min_pool=min_pool)
    nb = nearest(p, r, k, ident=entity, group="grp", cell=cell)
    j = nb.join(labels.withColumnRenamed(entity, "ref_id"), "ref_id")
    med = lambda v: F.percentile(v, F.lit(0.5))  # noqa: E731  (at most k values)
    g = j.groupBy(entity).agg(
        F.min("dist").alias("nb_dist_min"), F.avg("dist").alias("nb_dist_mean"), med("t_peak").alias("nb_t_peak_med"),
        med("q_peak").alias("nb_q_peak_med"), med("eur").alias("nb_eur_med"),
        F.when(F.count("t_peak") > 2, F.percentile("t_peak", F.lit(.75)) - F.percentile("t_peak", F.lit(.25))).alias("nb_t_peak_iqr"),
        F.count(F.lit(1)).alias("nb_count"))
    return master.select(entity).join(g, entity, "left")


def sequence_channels(df: DataFrame, obs_days: int, *, entity: str = "entity_id", day: str = "day_index", oil: str = "oil",
                      on: str = "hours_on", whp: str = "whp", water_cut: str = "water_cut", gor: str = "gor",
                      first: int = 5) -> DataFrame:
    """Six daily channels on a dense calendar of ``obs_days`` positions, one array per channel."""
    w = df.where(F.col(day).between(1, obs_days))
    live = (F.col(on) > 0).cast("double")
    x = w.withColumn("_on", live).withColumn("_q", F.when(F.col(on) > 0, F.coalesce(F.col(oil), F.lit(0.0))).otherwise(0.0))
    x = fill_gaps(x, entity=entity, order=day, value=whp, out="_p")
    x = fill_gaps(x, entity=entity, order=day, value=water_cut, out="_wc", back=False)
    x = fill_gaps(x, entity=entity, order=day, value=gor, out="_gor", back=False)
    run = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_cum", F.sum("_q").over(run)).withColumn("_i", F.row_number().over(Window.partitionBy(entity).orderBy(day)))
    x = x.withColumn("_ref", F.percentile(F.when(F.col("_i") <= first, F.col("_p")), F.lit(0.5)).over(Window.partitionBy(entity)))
    ch = {
        "oil": F.log1p("_q"), "on": F.col("_on"),
        "pressure": F.coalesce(F.col("_p") / F.greatest("_ref", F.lit(1e-6)), F.lit(0.0)) * F.col("_on"),
        "water_cut": F.coalesce("_wc", F.lit(0.0)) / 100.0,
        "gor": F.log1p(F.greatest(F.coalesce("_gor", F.lit(0.0)), F.lit(0.0))) / 5.0,
        "cum": F.log1p("_cum") / 10.0,
    }
    rows = x.select(entity, day, *[v.alias(f"c_{k}") for k, v in ch.items()])
    spine = rows.groupBy(entity).agg(F.lit(1)).select(entity, F.explode(F.sequence(F.lit(1), F.lit(obs_days))).alias(day))
    dense = spine.join(rows, [entity, day], "left")
    dense = dense.withColumn("c_cum", F.coalesce(F.max("c_cum").over(run), F.lit(0.0)))
    packed = dense.na.fill(0.0).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(day, *[f"c_{k}" for k in ch]))).alias("s"))
    return packed.select(entity, *[F.col(f"s.c_{k}").alias(k) for k in ch])


def resampled_curve(df: DataFrame, obs_days: int, points: int = 30, *, entity: str = "entity_id", day: str = "day_index",
                    oil: str = "oil", on: str = "hours_on", min_points: int = 5) -> DataFrame:
    """Peak-normalised curve on ``points`` even positions; linear between records, flat outside."""
    w = df.where((F.col(day) <= obs_days) & (F.col(on) > 0))
    packed = w.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(day).cast("double").alias("d"), F.col(oil).alias("q")))).alias("s")) \
        .where(F.size("s") >= min_points)
    step = (obs_days - 1) / (points - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: 1.0 + i * step)

    def value(t):
        lo = F.size(F.filter("s", lambda r: r["d"] <= t))
        a, b = F.get(F.col("s"), F.greatest(lo - 1, F.lit(0))), F.get(F.col("s"), F.least(lo, F.size("s") - 1))
        same = (lo == 0) | (lo == F.size("s"))
        edge = F.when(lo == 0, F.get(F.col("s"), F.lit(0))["q"]).otherwise(a["q"])
        return F.when(same, edge).otherwise(a["q"] + (b["q"] - a["q"]) * (t - a["d"]) / (b["d"] - a["d"]))

    c = packed.withColumn("curve", F.transform(at, value))
    top = F.array_max("curve")
    return c.select(entity, F.when(top > 0, F.transform("curve", lambda v: v / top)).otherwise(F.col("curve")).alias("curve"))
