"""Conformal calibration, blending of two model families, drift guard, guarded prediction."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import exact_percentiles, top_k

GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
TAUS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def higher_rank(alpha: float):
    """0-based position of the conformal order statistic, numpy's "higher" rule on level ceil((n+1)(1-α))/n."""
    def pos(n: Column) -> Column:
        level = F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)
        return F.ceil(F.round((n - 1) * level, 9))
    return pos


def conformal_delta(df: DataFrame, keys: Sequence[str], *, y: str = "y", lo: str = "p10", hi: str = "p90",
                    alpha: float = 0.2, normalized: bool = True, at_least: int = 10) -> DataFrame:
    raw = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))
    score = raw / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) if normalized else raw
    s = df.where(F.col(y).isNotNull() & F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("_s", score)
    n = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calib"))
    d = exact_percentiles(s, keys, "_s", {"_d": higher_rank(alpha)})
    return n.join(d, list(keys)).select(*keys, "n_calib", F.when(F.col("n_calib") < at_least, 0.0).otherwise(F.col("_d")).alias("delta"))


def apply_delta(df: DataFrame, delta: Column, *, lo: str = "p10", hi: str = "p90", normalized: bool = True,
                suffix: str = "") -> DataFrame:
    w = F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) if normalized else F.lit(1.0)
    return df.withColumn("_lo", F.col(lo) - delta * w).withColumn(hi + suffix, F.col(hi) + delta * w) \
        .withColumn(lo + suffix, F.col("_lo")).drop("_lo")


def pinball(y: Column, p: dict[str, Column]) -> Column:
    """Mean pinball loss of one row over the three quantiles."""
    loss = F.lit(0.0)
    for name, tau in TAUS.items():
        e = y - p[name]
        loss = loss + F.greatest(tau * e, (tau - 1.0) * e)
    return loss / len(TAUS)


def mixed(w: Column, a: str = "a_", b: str = "b_") -> Column:
    """Sorted convex combination of two quantile triples as an array (p10, p50, p90)."""
    return F.array_sort(F.array(*[(1 - w) * F.col(a + q) + w * F.col(b + q) for q in TAUS]))


def _as_triple(arr: Column) -> dict[str, Column]:
    return {q: F.get(arr, i) for i, q in enumerate(TAUS)}


def weight_losses(df: DataFrame, keys: Sequence[str], grid: Sequence[float] = GRID, *, y: str = "y") -> DataFrame:
    x = df.where(F.col(y).isNotNull()).withColumn("w", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return x.groupBy(*keys, "w").agg(F.avg(pinball(F.col(y), _as_triple(mixed(F.col("w"))))).alias("loss"),
                                     F.count(F.lit(1)).alias("n"))


def choose_weights(df: DataFrame, keys: Sequence[str], grid: Sequence[float] = GRID, *, y: str = "y") -> DataFrame:
    """Smallest loss per key; ties go to the smaller weight."""
    return weight_losses(df, keys, grid, y=y).groupBy(*keys).agg(
        F.min(F.struct(F.round("loss", 9).alias("loss"), "w", "n")).alias("_m")).select(*keys, "_m.w", "_m.loss", "_m.n")


def crossfit_blend(df: DataFrame, *, target: str = "target", fold: str = "fold", y: str = "y",
                   flagged: str | None = None) -> DataFrame:
    """Each fold is blended with the weight the *other* fold chose; flagged rows take no part and get weight 0."""
    off = F.col(flagged) if flagged else F.lit(False)
    sel = choose_weights(df.where(~off), [target, fold], y=y)
    opposite = sel.select(target, (1 - F.col(fold)).alias(fold), F.col("w").alias("_w"))  # one row per target and fold
    j = df.join(F.broadcast(opposite), [target, fold], "left")
    w = F.when(off, 0.0).otherwise(F.coalesce("_w", F.lit(0.0)))
    m = mixed(w)
    return j.withColumn("weight", w).select(*df.columns, "weight", *[F.get(m, i).alias(q) for i, q in enumerate(TAUS)])


# ------------------------------------------------------------------ drift
def _long(df: DataFrame, ident: str, features: Sequence[str]) -> DataFrame:
    items = ", ".join(f"'{f}', cast({f} as double)" for f in features)
    return df.select(ident, F.expr(f"stack({len(features)}, {items}) as (feature, x)"))


def drift_profile(train: DataFrame, features: Sequence[str], *, ident: str = "entity_id") -> DataFrame:
    """Median and scale of every feature: p90 − p10, else sample sd, else 1. One row per feature."""
    long = _long(train, ident, features).where("x IS NOT NULL AND NOT isnan(x)")
    p = exact_percentiles(long, ["feature"], "x", {"center": .5, "_lo": .1, "_hi": .9})
    sd = long.groupBy("feature").agg(F.stddev_samp("x").alias("_sd"))
    spread = F.col("_hi") - F.col("_lo")
    scale = F.when(spread > 1e-9, spread).when(F.col("_sd") > 1e-9, F.col("_sd")).otherwise(1.0)
    return p.join(sd, "feature").select("feature", "center", scale.alias("scale"))


def drift_scores(df: DataFrame, profile: DataFrame, features: Sequence[str], *, ident: str = "entity_id") -> DataFrame:
    """Largest scaled deviation and the feature it comes from (NULLs do not count)."""
    z = _long(df, ident, features).join(F.broadcast(profile), "feature").withColumn(
        "_z", F.coalesce(F.abs(F.col("x") - F.col("center")) / F.col("scale"), F.lit(0.0)))
    best = z.groupBy(ident).agg(F.max(F.struct(F.round("_z", 9).alias("z"), F.col("feature"))).alias("_b"))
    return best.select(ident, F.col("_b.z").alias("score"), F.col("_b.feature").alias("top_feature"))


def drift_assess(scores: DataFrame, threshold: Column, df: DataFrame, seen: DataFrame, category: str, *,
                 ident: str = "entity_id") -> DataFrame:
    """Flag rows beyond the calibration threshold or with a category absent from training."""
    known = seen.select(category).distinct().withColumn("_seen", F.lit(True))
    j = df.select(ident, category).join(known, category, "left").join(scores, ident)
    novel = F.col("_seen").isNull()
    return j.withColumn("_t", threshold).select(ident, "score", "top_feature", novel.alias("novel_category"),
                                                (novel | (F.col("score") > F.col("_t"))).alias("flagged"))


def drift_threshold(scores: DataFrame, level: float = 0.99) -> Column:
    return exact_percentiles(scores, [], "score", {"t": level}).scalar()


# ------------------------------------------------------------------ guarded prediction
def guarded_intervals(df: DataFrame, delta: DataFrame, delta_fallback: DataFrame, *, keys: Sequence[str] = ("target",),
                      flagged: str = "flagged", floor: str | None = None) -> DataFrame:
    """Calibrated interval; flagged rows use the fallback family and its own correction; optional physical floor."""
    keys = list(keys)
    a = delta.select(*keys, F.col("delta").alias("_da"))          # one row per target
    b = delta_fallback.select(*keys, F.col("delta").alias("_db"))
    j = df.join(F.broadcast(a), keys, "left").join(F.broadcast(b), keys, "left")
    off = F.col(flagged)
    base = {q: F.when(off, F.col("a_" + q)).otherwise(F.col(q)) for q in TAUS}
    d = F.coalesce(F.when(off, F.col("_db")).otherwise(F.col("_da")), F.lit(0.0))
    w = F.greatest(base["p90"] - base["p10"], F.lit(1e-9))
    out = {"p10": base["p10"] - d * w, "p50": base["p50"], "p90": base["p90"] + d * w}
    if floor:
        out = {k: F.greatest(v, F.col(floor)) for k, v in out.items()}
    rest = [x for x in df.columns if x not in TAUS]
    return j.select(*rest, *[v.alias(k) for k, v in out.items()])


def worst_cases(df: DataFrame, *, target: str = "target", y: str = "y", k: int = 8, ident: str = "entity_id") -> DataFrame:
    e = df.where(F.col(y).isNotNull()).withColumn("abs_error", F.round(F.abs(F.col("p50") - F.col(y)), 6))
    side = F.when(F.col(y) < F.col("p10"), "below").when(F.col(y) > F.col("p90"), "above").otherwise("inside")
    return top_k(e, [target], [F.desc("abs_error"), ident], k).withColumn("side", side)
