"""Development and operating indicators, anchor scoring, anchor validation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import safe_div

# Indicator, group, good anchor, bad anchor, weight (example set) and the overlay of the second profile.
ANCHORS = [
    ("natural_decline_pct", "development", 20.0, 45.0, 1.5),
    ("comprehensive_decline_pct", "development", 15.0, 40.0, 1.0),
    ("water_cut_pct", "development", 50.0, 95.0, 0.8),
    ("water_cut_rise_pct", "development", 0.0, 10.0, 1.0),
    ("open_well_rate_pct", "development", 95.0, 70.0, 0.8),
    ("measure_effective_rate_pct", "development", 90.0, 50.0, 1.0),
    ("reserve_production_ratio", "development", 5.0, 1.5, 1.2),
    ("production_plan_attainment_pct", "operation", 102.0, 85.0, 1.2),
    ("new_well_plan_attainment_pct", "operation", 100.0, 70.0, 1.0),
    ("opex_usd_per_t", "operation", 60.0, 250.0, 1.2),
    ("net_revenue_usd_per_t", "operation", 420.0, 250.0, 1.0),
    ("profit_usd_per_t", "operation", 300.0, 50.0, 1.5),
]
WATERFLOOD = [
    ("natural_decline_pct", 8.0, 20.0), ("comprehensive_decline_pct", 5.0, 15.0), ("water_cut_pct", 85.0, 97.0), ("water_cut_rise_pct", 0.0, 3.0),
    ("open_well_rate_pct", 92.0, 75.0), ("measure_effective_rate_pct", 85.0, 50.0), ("reserve_production_ratio", 12.0, 6.0),
    ("production_plan_attainment_pct", 100.0, 90.0), ("new_well_plan_attainment_pct", 100.0, 75.0), ("opex_usd_per_t", 150.0, 380.0),
    ("net_revenue_usd_per_t", 420.0, 250.0), ("profit_usd_per_t", 220.0, 20.0),
]
ANCHOR_SCHEMA = "indicator string, grp string, good double, bad double, weight double"
INDICATORS = [a[0] for a in ANCHORS]


def compute(df: DataFrame) -> DataFrame:
    """The twelve indicators from one wide row per unit; a missing input gives a missing indicator, never zero."""
    opex_t = safe_div(F.col("producing_well_months") * F.col("opex_month"), "production")
    cols = {
        "natural_decline_pct": F.col("natural_annual_pct"), "comprehensive_decline_pct": F.col("comprehensive_annual_pct"),
        "water_cut_pct": F.col("water_cut"), "water_cut_rise_pct": F.col("water_cut") - F.col("water_cut_prev"),
        "open_well_rate_pct": safe_div(F.col("n_producing") * 100.0, "n_wells"),
        "measure_effective_rate_pct": safe_div(F.col("n_effective") * 100.0, "n_evaluated"),
        "reserve_production_ratio": safe_div("pdp", "production"),
        "production_plan_attainment_pct": safe_div(F.col("production") * 100.0, "plan_production"),
        "new_well_plan_attainment_pct": safe_div(F.col("new_oil") * 100.0, "plan_new_oil"),
        "opex_usd_per_t": opex_t, "net_revenue_usd_per_t": F.col("net_t"), "profit_usd_per_t": F.col("net_t") - opex_t,
    }
    return df.select("unit_id", *[v.alias(k) for k, v in cols.items()])


def unpivoted(values: DataFrame) -> DataFrame:
    items = ", ".join(f"'{i}', {i}" for i in INDICATORS)
    return values.select("unit_id", F.expr(f"stack({len(INDICATORS)}, {items}) as (indicator, value)"))


def score(long: DataFrame, anchors: DataFrame) -> DataFrame:
    """Linear score between the anchors, clipped to 0…100; NULL values stay unscored."""
    raw = (F.col("value") - F.col("bad")) / (F.col("good") - F.col("bad")) * 100
    s = F.when(F.col("value").isNotNull() & (F.col("good") != F.col("bad")), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    return long.join(F.broadcast(anchors), "indicator").withColumn("score", s)  # anchors: one row per indicator


def group_scores(scored: DataFrame) -> DataFrame:
    s = scored.where("score IS NOT NULL")
    return s.groupBy("unit_id", "grp").agg(safe_div(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("score"))


def overlay(base: DataFrame, override: DataFrame) -> DataFrame:
    o = override.select("indicator", F.col("good").alias("_g"), F.col("bad").alias("_b"))
    return base.join(o, "indicator", "left").select("indicator", "grp", F.coalesce("_g", "good").alias("good"), F.coalesce("_b", "bad").alias("bad"), "weight")


def validate_anchors(spec: DataFrame, reference: DataFrame) -> DataFrame:
    """Issue rows (set_id, indicator, problem) for any number of anchor sets at once.

    ``spec``: set_id, indicator, good, bad, weight as strings; ``reference``: indicator, grp.
    """
    num = {k: F.expr(f"try_cast({k} as double)") for k in ("good", "bad", "weight")}
    ref = reference.agg(F.collect_list("indicator")).scalar()
    have = spec.groupBy("set_id").agg(F.collect_set("indicator").alias("_h")).withColumn("_r", ref)
    missing = have.select("set_id", F.explode(F.array_except("_r", "_h")).alias("indicator"), F.lit("missing").alias("problem"))
    extra = have.select("set_id", F.explode(F.array_except("_h", "_r")).alias("indicator"), F.lit("unknown").alias("problem"))
    known = spec.join(F.broadcast(reference.select("indicator", "grp")), "indicator").select("set_id", "indicator", "grp", *[v.alias(k) for k, v in num.items()])
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))
    ok = finite("good") & finite("bad") & finite("weight")
    problems = F.array_compact(F.array(
        F.when(~ok, "not numeric"), F.when(ok & (F.col("good") == F.col("bad")), "anchors equal"), F.when(ok & (F.col("weight") < 0), "negative weight")))
    cell = known.select("set_id", "indicator", F.explode(problems).alias("problem"))
    groups = known.groupBy("set_id", "grp").agg(F.sum(F.when(ok, F.greatest("weight", F.lit(0.0))).otherwise(0.0)).alias("_w")).where("_w <= 0").select(
        "set_id", F.col("grp").alias("indicator"), F.lit("group weight not positive").alias("problem"))
    return missing.unionByName(extra).unionByName(cell).unionByName(groups)
