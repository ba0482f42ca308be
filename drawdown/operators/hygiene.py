"""Quality gate, eligibility, splits, scope resolution and feature alignment."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import hash_uniform
from .ranking import dated_row_number

# Limits of the quality gate.
MAX_NULL_RATE = 0.05
MIN_CONTINUITY = 0.95
MIN_RECORDS = 60
BOUNDS = {"oil": (0.0, 500.0), "water": (0.0, 2000.0), "whp": (0.0, 60.0),
          "bhp": (0.0, 90.0), "water_cut": (0.0, 100.0), "gor": (0.0, 3000.0)}


def quality_gate(df: DataFrame, static: DataFrame, *, entity: str = "entity_id", day: str = "day_index",
                 key_fields: Sequence[str] = ("oil", "whp"), bounds: Mapping[str, tuple] = BOUNDS,
                 outlier_field: str = "oil", min_records: int = MIN_RECORDS,
                 min_continuity: float = MIN_CONTINUITY, max_null: float = MAX_NULL_RATE) -> DataFrame:
    """One row per entity with the measured figures, the reasons and the verdict.

    ``df`` is at (entity, day) grain, so an entity has at most one row per calendar day.
    """
    out_of_bounds = sum(
        (F.when((F.col(k) < lo) | (F.col(k) > hi), 1).otherwise(0)
         for k, (lo, hi) in bounds.items() if k in df.columns), F.lit(0))
    stats = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.max(day) - F.min(day) + 1).alias("_span"),
        *[F.avg(F.col(k).isNull().cast("double")).alias(f"null_{k}") for k in key_fields],
        F.sum(out_of_bounds).alias("n_violations"),
        F.count(outlier_field).alias("_n_obs"),
        F.percentile(outlier_field, F.array(F.lit(.25), F.lit(.75))).alias("_q"),
    )
    q1, q3 = F.get("_q", 0), F.get("_q", 1)
    fenced = stats.withColumn("_lo", q1 - 3 * (q3 - q1)).withColumn("_hi", q3 + 3 * (q3 - q1))
    x = F.col(outlier_field)
    outliers = (
        df.join(fenced.where("_n_obs > 20").select(entity, "_lo", "_hi"), entity)
        .where((x < F.col("_lo")) | (x > F.col("_hi")))
        .groupBy(entity).agg(F.count(F.lit(1)).alias("n_outliers"))
    )
    known = static.select(entity).distinct().withColumn("_static", F.lit(True))
    j = (
        fenced.join(outliers, entity, "left").join(known, entity, "left")
        .withColumn("continuity", F.col("n_days") / F.col("_span"))
        .withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)).cast("long"))
    )
    reasons = [
        F.when(F.col("n_days") < min_records, F.lit(f"history under {min_records} days")),
        F.when(F.col("continuity") < min_continuity,
               F.concat(F.lit("continuity "), F.format_string("%.2f", F.col("continuity")))),
        *[F.when(F.col(f"null_{k}") > max_null,
                 F.concat(F.lit(f"{k} null rate "), F.format_string("%.2f", F.col(f"null_{k}"))))
          for k in key_fields],
        F.when(F.col("n_violations") > 0,
               F.concat(F.lit("out of bounds "), F.col("n_violations").cast("string"))),
        F.when(F.col("_static").isNull(), F.lit("no static record")),
    ]
    return (
        j.withColumn("reject_reason", F.concat_ws("; ", *reasons))
        .withColumn("passed", F.col("reject_reason") == "")
        .withColumn("continuity", F.round("continuity", 4))
        .select(entity, "n_days", "continuity", *[F.round(f"null_{k}", 4).alias(f"null_{k}") for k in key_fields],
                "n_violations", "n_outliers", "passed", "reject_reason")
    )


def gate_summary(report: DataFrame, top: int = 5) -> DataFrame:
    """Pass rate next to the most frequent reasons, one row per reason."""
    head = report.agg(F.struct(F.count(F.lit(1)).alias("n_entities"),
                               F.sum(F.col("passed").cast("long")).alias("n_passed"),
                               F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))).scalar()
    reasons = (
        report.where(~F.col("passed")).select(F.explode(F.split("reject_reason", "; ")).alias("reason"))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason").limit(top)
    )
    return reasons.withColumn("_h", head).select("reason", "n", "_h.n_entities", "_h.n_passed", "_h.pass_rate")


def eligible_entities(df: DataFrame, accepted: DataFrame, *, entity: str = "entity_id", day: str = "day_index",
                      min_days: int = 420) -> DataFrame:
    long_enough = df.groupBy(entity).agg(F.max(day).alias("history_days")).where(F.col("history_days") >= min_days)
    return long_enough.join(accepted, entity, "left_semi")


def _cut(rn: Column, n: Column, calib: float, test: float) -> Column:
    n_test, n_cal = F.floor(n * test), F.floor(n * calib)
    return (F.when(rn > n - n_test, "test").when(rn > n - n_test - n_cal, "calib").otherwise("train"))


def split_by_time(master: DataFrame, *, entity: str = "entity_id", order: str = "first_prod",
                  calib: float = 0.2, test: float = 0.25) -> DataFrame:
    ranked = dated_row_number(master, [], order, entity)
    return ranked.select(entity, _cut(F.col("rn"), F.col("n_total"), calib, test).alias("part"))


def split_by_group(master: DataFrame, *, entity: str = "entity_id", group: str = "block",
                   order: str = "first_prod", calib: float = 0.2) -> DataFrame:
    """The last group (by name) is held out; of the rest the last share by (group, order) calibrates."""
    tagged = master.withColumn("_held", F.col(group) == master.agg(F.max(group)).scalar())
    rest = tagged.where(~F.col("_held"))
    # position = rows of earlier groups + position inside the group
    inside = dated_row_number(rest, [group], order, entity, out="_in", total=None)
    sizes = rest.groupBy(group).agg(F.count(F.lit(1)).alias("_g"))
    w = Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_g").over(
        w.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_g").over(w))
    placed = inside.join(sizes, group).withColumn("rn", F.col("_before") + F.col("_in"))
    part = F.when(F.col("rn") > F.col("_n") - F.floor(F.col("_n") * calib), "calib").otherwise("train")
    return placed.select(entity, part.alias("part")).unionByName(
        tagged.where("_held").select(entity, F.lit("test").alias("part")))


def split_random(master: DataFrame, *, entity: str = "entity_id", seed: int = 0,
                 calib: float = 0.2, test: float = 0.25) -> DataFrame:
    """Order by a hash of the identifier: reproducible whatever the partitioning."""
    keyed = master.select(entity).withColumn("_u", hash_uniform(F.lit(seed), entity)) \
        .withColumn("_bin", F.floor(F.col("_u") * 4096))
    counts = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_off", F.coalesce(F.sum("_m").over(
        w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_m").over(w))
    ranked = keyed.join(F.broadcast(counts), "_bin").withColumn(
        "rn", F.col("_off") + F.row_number().over(Window.partitionBy("_bin").orderBy("_u", entity)))
    return ranked.select(entity, _cut(F.col("rn"), F.col("_n"), calib, test).alias("part"))


def as_of_filter(df: DataFrame, month: str, as_of_index: int) -> DataFrame:
    """Point-in-time restriction on the integer month, applied before any window."""
    return df.where(F.col(month) <= as_of_index)


def resolve_scope(units: DataFrame, scopes: DataFrame, *, levels: Sequence[str] = ("unit", "plant", "company"),
                  scope: str = "scope") -> DataFrame:
    """(scope, level, unit): a name may be a unit, a plant or a company; the finest matching level wins."""
    long = None
    for i, level in enumerate(levels):
        part = units.select(F.col(level).alias(scope), F.lit(level).alias("level"), F.lit(i).alias("_o"),
                            F.col(levels[0]).alias("member")).distinct()
        long = part if long is None else long.unionByName(part)
    hit = long.join(scopes.select(scope).distinct(), scope, "left_semi")
    best = hit.groupBy(scope).agg(F.min("_o").alias("_o"))
    return hit.join(best, [scope, "_o"]).drop("_o")


def resolve_codes(asked: DataFrame, master: DataFrame, *, asked_col: str, ident: str, code: str) -> DataFrame:
    """Accept either an identifier or a code (case-insensitive); unknown ones keep a NULL identifier."""
    keys = master.select(F.upper(F.col(ident).cast("string")).alias("_k"), F.col(ident)).unionByName(
        master.select(F.upper(F.col(code)).alias("_k"), F.col(ident)))
    one = keys.groupBy("_k").agg(F.min(ident).alias(ident))
    return (asked.withColumn("_k", F.upper(F.trim(F.col(asked_col)))).join(one, "_k", "left").drop("_k"))


def align_features(df: DataFrame, columns: Sequence[str], one_hot: Sequence[str] = ("block_", "layer_")) -> DataFrame:
    """Same column list as at training time: absent one-hot → 0, other absent features → NULL."""
    def pick(name):
        if name in df.columns:
            return F.col(name)
        fill = 0.0 if name.startswith(tuple(one_hot)) else None
        return F.lit(fill).cast("double").alias(name)
    keep = [x for x in df.columns if x not in columns and not x.startswith(tuple(one_hot))]
    return df.select(*keep, *[pick(x) for x in columns])


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Indicator columns for a declared category list (the list comes from training, not from a scan)."""
    return df.select("*", *[(F.coalesce(F.col(column) == v, F.lit(False))).cast("double").alias(f"{column}_{v}")
                            for v in values])
