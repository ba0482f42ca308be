"""Label extraction and series shaping on (entity, day) and (entity, month) rows.

All windows are partitioned by entity over day- or month-grain rows, so a partition never exceeds the
number of calendar days.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import DAYS_PER_MONTH, clean, days_in_month, month_index
from .ranking import top_k


def first_run(df: DataFrame, *, entity: str = "entity_id", day: str = "day_index", value: str = "oil",
              on: str = "hours_on", threshold: float = 0.5, length: int = 3) -> DataFrame:
    """First day of the first run of ``length`` consecutive *records* (off days skipped) at or above threshold."""
    w = Window.partitionBy(entity).orderBy(day)
    recs = df.where(F.col(on) > 0).withColumn("_ok", (F.coalesce(F.col(value), F.lit(float("-inf"))) >= threshold))
    ends = F.min(F.col("_ok").cast("int")).over(w.rowsBetween(0, length - 1))
    full = F.count(F.lit(1)).over(w.rowsBetween(0, length - 1))
    return (
        recs.withColumn("_run", (ends == 1) & (full == length))
        .groupBy(entity).agg(F.min(F.when(F.col("_run"), F.col(day))).alias("t_break"))
    )


def smoothed(df: DataFrame, *, entity: str = "entity_id", day: str = "day_index", value: str = "oil",
             on: str = "hours_on", half: int = 3, min_obs: int = 3) -> DataFrame:
    """Centred moving mean over calendar days; off days carry no value; days without a record are added."""
    span = df.groupBy(entity).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    spine = span.select(entity, F.explode(F.sequence("_a", "_b")).alias(day))
    dense = spine.join(df.select(entity, day, F.when(F.col(on) > 0, F.col(value)).alias("_v")), [entity, day], "left")
    w = Window.partitionBy(entity).orderBy(day).rangeBetween(-half, half)
    return (
        dense.withColumn("_m", F.when(F.count("_v").over(w) >= min_obs, F.avg("_v").over(w)))
        .where(F.col("_m").isNotNull()).select(entity, day, F.round("_m", 9).alias("smooth"))
    )


def outside_event_windows(series: DataFrame, events: DataFrame, *, entity: str = "entity_id",
                          day: str = "day_index", event_day: str = "event_day", block_days: int = 60) -> DataFrame:
    """Rows that are not within [event, event + block_days]; an entity that would lose all rows keeps them.

    The interval condition is turned into an equi-join by expanding each event to the days it blocks
    (a bounded number), so no range join is needed.
    """
    blocked = (
        events.select(entity, F.explode(F.sequence(F.col(event_day), F.col(event_day) + block_days)).alias(day))
        .distinct().withColumn("_blocked", F.lit(True))
    )
    w = Window.partitionBy(entity)
    return (
        series.join(blocked, [entity, day], "left")
        .withColumn("_free", F.sum(F.when(F.col("_blocked").isNull(), 1).otherwise(0)).over(w))
        .where(F.col("_blocked").isNull() | (F.col("_free") == 0))
        .drop("_blocked", "_free")
    )


def peak(smooth: DataFrame, events: DataFrame, *, entity: str = "entity_id", day: str = "day_index",
         ignore_days: int = 30, block_days: int = 60, confirm: int = 2, confirm_days: int = 30,
         drop: float = 0.02, min_obs: int = 8, candidates: int | None = 12) -> DataFrame:
    """Peak day and value: candidates in falling order, accepted once the following means keep declining.

    That only the twelve highest days are tried is part of the rule as it is defined; ``candidates=None`` tries all.
    """
    w = Window.partitionBy(entity).orderBy(day)
    looked = smooth
    ok = F.lit(True)
    for k in range(1, confirm + 1):
        f = w.rangeBetween(confirm_days * (k - 1) + 1, confirm_days * k)
        looked = looked.withColumn(f"_n{k}", F.count("smooth").over(f)).withColumn(f"_m{k}", F.avg("smooth").over(f))
        ok = ok & (F.col(f"_n{k}") >= min_obs) & (F.col(f"_m{k}") < F.col("smooth") * (1.0 - drop * k))
    cand = looked.withColumn("_ok", F.coalesce(ok, F.lit(False))).where(F.col(day) >= ignore_days)
    usable = outside_event_windows(cand, events, entity=entity, day=day, block_days=block_days)
    tried = usable.withColumn("rk", -F.col("smooth")) if candidates is None else top_k(usable, [entity], [F.desc("smooth"), F.asc(day)], candidates)
    pick = tried.groupBy(entity).agg(
        F.min(F.when(F.col("_ok"), F.struct("rk", day, "smooth"))).alias("_c"),
        F.min(F.struct("rk", day, "smooth")).alias("_first"))
    got = F.coalesce("_c", "_first")
    return pick.select(entity, got[day].alias("t_peak"), got["smooth"].alias("q_peak"),
                       F.col("_c").isNotNull().alias("confirmed"))


def value_at(df: DataFrame, points: DataFrame, *, entity: str = "entity_id", day: str = "day_index",
             at: str = "t_peak", value: str = "whp", near: int = 1, wide: int = 3, out: str = "p_peak") -> DataFrame:
    """Mean of ``value`` within ±near days of the point, else within ±wide days."""
    d = F.abs(F.col(day) - F.col(at))
    return (
        df.join(points.select(entity, at), entity).where(d <= wide)
        .groupBy(entity).agg(F.coalesce(F.avg(F.when(d <= near, F.col(value))), F.avg(value)).alias(out))
    )


def cumulative_to(df: DataFrame, days: int = 360, *, entity: str = "entity_id", day: str = "day_index",
                  value: str = "oil", out: str = "cum_360") -> DataFrame:
    return df.groupBy(entity).agg(F.sum(F.when(F.col(day) <= days, F.col(value)).otherwise(0.0)).alias(out))


def before_first_event(df: DataFrame, events: DataFrame, *, entity: str = "entity_id", day: str = "day_index",
                       event_day: str = "event_day") -> DataFrame:
    first = events.groupBy(entity).agg(F.min(event_day).alias("_first"))
    return (df.join(first, entity, "left")
            .where(F.col("_first").isNull() | (F.col(day) < F.col("_first"))).drop("_first"))


# ------------------------------------------------------------------ monthly shapes
def to_monthly(df: DataFrame, *, entity: str = "entity_id", date: str = "dt", oil: str = "oil",
               water: str = "water", on: str = "hours_on") -> DataFrame:
    return df.groupBy(entity, month_index(date).alias("mi")).agg(
        F.sum(oil).alias("oil"), F.sum(water).alias("water"),
        F.sum((F.col(on) > 0).cast("int")).alias("days_on"), F.count(F.lit(1)).alias("days"))


def binned_rate(df: DataFrame, *, entity: str = "entity_id", day: str = "day_index", value: str = "oil",
                on: str = "hours_on", bin_days: float = DAYS_PER_MONTH, min_obs: int = 8) -> DataFrame:
    """Mean on-day rate per 30.4-day bin since start, bin centre k + 0.5, thin bins dropped."""
    k = F.floor((F.col(day) - 1) / bin_days)
    return (
        df.where((F.col(on) > 0) & clean(value).isNotNull()).groupBy(entity, k.cast("int").alias("k"))
        .agg(F.count(F.lit(1)).alias("n_obs"), F.avg(value).alias("rate")).where(F.col("n_obs") >= min_obs)
        .withColumn("t", F.col("k") + 0.5)
    )


def display_curve(df: DataFrame, *, entity: str = "entity_id", day: str = "day_index", on: str = "hours_on",
                  values=("oil", "whp", "water"), width: int = 30) -> DataFrame:
    bucket = (F.floor((F.col(day) - 1) / width) + 1).cast("int")
    return df.where(F.col(on) > 0).groupBy(entity, bucket.alias("period")).agg(
        *[F.avg(v).alias(f"{v}_mean") for v in values])


def producing_time(df: DataFrame, *, entity: str = "entity_id", month: str = "mi", oil: str = "oil",
                   min_gap: int = 3) -> DataFrame:
    """Month axis with the idle gaps that later resumed taken out."""
    w = Window.partitionBy(entity).orderBy(month)
    last_on = F.last(F.when(F.col(oil) > 0, F.col(month)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when((F.col(oil) > 0) & (F.col(month) - F.col("_prev") - 1 >= min_gap),
                 F.col(month) - F.col("_prev") - 1).otherwise(0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_prev", last_on).withColumn("_gap", gap)
        .withColumn("idle_months", F.sum("_gap").over(run).cast("long"))
        .withColumn("ptime", (F.col(month) - F.col("idle_months")).cast("long")).drop("_prev", "_gap")
    )


def fit_rate(df: DataFrame, *, month: str = "mi", oil: str = "oil", days_on: str = "days_on",
             share: float = 0.5, out: str = "fit_rate") -> DataFrame:
    """Calendar-day rate, NULL in months open for less than ``share`` of the days."""
    dim = days_in_month(month)
    return df.withColumn(out, F.when(F.col(days_on) >= share * dim, F.col(oil) / dim))


def public_series(df: DataFrame, reported: DataFrame, *, entity: str = "entity_id", month: str = "mi",
                  oil: str = "oil", days: str = "days", min_producing: int = 36, peak_window: int = 4) -> DataFrame:
    """Series re-indexed from the early peak; duplicated reports summed, missing reports are not zeros.

    Entities that already produced in the first report are dropped (their start is unknown). Reports are summed and placed by windows
    that all have the order of the months: rows are sorted once, and no task holds them in tables of groups besides.
    """
    first_report = reported.agg(F.min(month)).scalar()
    same = Window.partitionBy(entity, month)
    one = df.select(entity, month, F.col(oil).alias("oil"), F.col(days).alias("days")).repartition(entity).withColumn("_no", F.row_number().over(same.orderBy("oil")))
    g = one.withColumn("oil", F.sum("oil").over(same)).withColumn("days", F.sum("days").over(same)).where("_no = 1 AND oil > 0").drop("_no")
    until = Window.partitionBy(entity).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    w = until.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    on = F.col("days") > 0
    kept = (
        g.withColumn("_start", F.min(month).over(w))
        .withColumn("_n_on", F.sum(on.cast("int")).over(w))
        .where((F.col("_start") > first_report) & (F.col("_n_on") >= min_producing))
    )
    rate = F.when(on, F.col("oil") / F.greatest(F.col("days"), F.lit(1)))
    ordered = kept.withColumn("rate", rate).withColumn("_rank_on", F.sum(on.cast("int")).over(until))
    best = ordered.withColumn("_p", F.max(F.when(on & (F.col("_rank_on") <= peak_window),
                                                 F.struct(F.col("rate"), (-F.col(month)).alias("_neg")))).over(w))
    peak_m = -F.col("_p._neg")
    placed = best.withColumn("_peak", peak_m).withColumn(
        "cum_before_peak", F.sum(F.when(F.col(month) < F.col("_peak"), F.col("oil")).otherwise(0.0)).over(w))
    return (
        placed.where((F.col(month) >= F.col("_peak")) & on)
        .join(reported.select(month).distinct(), month, "left_semi")
        .select(entity, (F.col(month) - F.col("_peak") + 0.5).alias("t"), "rate", F.col("oil").alias("volume"),
                "cum_before_peak", F.col("_start").alias("start_month"))
    )


def post_peak_guard(df: DataFrame, labels: DataFrame, *, entity: str = "entity_id", day: str = "day_index",
                    oil: str = "oil", on: str = "hours_on", min_points: int = 60, min_days: int = 180) -> DataFrame:
    """Whether an entity has enough post-peak data, with a typed reason instead of an exception."""
    use = (F.col(day) >= F.col("t_peak")) & (F.col(on) > 0) & (F.col(oil) > 0)
    g = (
        df.join(labels.select(entity, "t_peak", "quality"), entity, "left")
        .groupBy(entity).agg(F.max("t_peak").alias("t_peak"), F.max("quality").alias("quality"),
                             F.sum(F.when(use, 1).otherwise(0)).cast("long").alias("n_points"),
                             (F.max(day) - F.max("t_peak")).cast("long").alias("days_after_peak"))
    )
    reason = (
        F.when(F.col("t_peak").isNull(), "no_label")
        .when(F.col("quality") == "rejected", "label_rejected")
        .when(F.col("n_points") < min_points, "too_few_points")
        .when(F.col("days_after_peak") < min_days, "too_short_after_peak")
    )
    return g.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def recent_state(df: DataFrame, *, entity: str = "entity_id", day: str = "day_index", on: str = "hours_on",
                 values=("oil", "whp"), last: int = 14) -> DataFrame:
    recent = top_k(df.where(F.col(on) > 0), [entity], F.desc(day), last)
    return recent.groupBy(entity).agg(*[F.avg(v).alias(f"{v}_now") for v in values],
                                      F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_used"))


def change_evidence(monthly: DataFrame, open_mi: int, close_mi: int, *, entity: str = "entity_id",
                    months: int = 3, density: float = 0.85) -> DataFrame:
    """Opening against closing rate and water cut; both windows come out of one aggregation."""
    def in_window(end):
        return F.col("mi").between(end - months + 1, end)

    def span(end):
        return sum((days_in_month(F.lit(i)) for i in range(end - months + 1, end + 1)), F.lit(0))

    aggs = []
    for tag, end in (("open", open_mi), ("close", close_mi)):
        aggs += [F.sum(F.when(in_window(end), F.col("oil"))).alias(f"_oil_{tag}"),
                 F.sum(F.when(in_window(end), F.col("water"))).alias(f"_water_{tag}")]
    g = (monthly.where(in_window(open_mi) | in_window(close_mi)).groupBy(entity).agg(*aggs)
         .where(F.col("_oil_open").isNotNull() & F.col("_oil_close").isNotNull()))
    for tag, end in (("open", open_mi), ("close", close_mi)):
        liquid = F.col(f"_water_{tag}") + F.col(f"_oil_{tag}") / density
        g = g.withColumn(f"rate_{tag}", F.col(f"_oil_{tag}") / span(end)).withColumn(
            f"wc_{tag}", F.when(liquid > 0, F.col(f"_water_{tag}") / liquid * 100))
    return g.where("rate_open > 0").withColumn("rate_change", F.col("rate_close") - F.col("rate_open")).select(
        entity, "rate_open", "rate_close", "rate_change", "wc_open", "wc_close")


