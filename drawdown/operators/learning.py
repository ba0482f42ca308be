"""Attributions and importance of fitted quantile models (:mod:`.boosting`)."""
from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import hash_uniform
from ..session import materialise
from .boosting import Models, scored
from .ranking import range_rank


def medians(background: DataFrame, features: Sequence[str]) -> Column:
    """The background's median of every feature, as one struct."""
    return background.agg(F.struct(*[F.percentile_approx(F.col(f).cast("double"), 0.5, 10000).alias(f) for f in features])).scalar()


def ablation_attribution(models: Models, target: str, df: DataFrame, background: DataFrame, features: Sequence[str], *, ident: str = "entity_id", level: float = 0.5, k: int = 5) -> DataFrame:
    """Effect on the prediction of replacing one feature by its background median; all substitutions in one pass."""
    b = df.select(ident, *[F.col(f).cast("double").alias(f) for f in features]).withColumn("_m", medians(background, features))
    alt = F.array(F.struct(F.lit("").alias("n"), *[F.col(f).alias(f) for f in features]), *[
        F.struct(F.lit(g).alias("n"), *[(F.col(f"_m.{f}") if f == g else F.col(f)).alias(f) for f in features]) for g in features])
    x = b.withColumn("_a", F.explode(alt)).select(ident, F.col("_a.n").alias("feature"), *[F.col(f"_a.{f}").alias(f) for f in features])
    p = x.withColumn("_p", scored(models, features, target, level)).select(ident, "feature", "_p")
    w = Window.partitionBy(ident)
    d = p.withColumn("_base", F.max(F.when(F.col("feature") == "", F.col("_p"))).over(w)).where("feature <> ''")
    d = d.withColumn("effect", F.col("_base") - F.col("_p"))
    return d.withColumn("rk", F.row_number().over(w.orderBy(F.desc(F.abs("effect")), "feature"))).where(F.col("rk") <= k).select(ident, "feature", "effect", "rk")


def shapley(models: Models, target: str, df: DataFrame, background: DataFrame, features: Sequence[str], *, ident: str = "entity_id", level: float = 0.5) -> DataFrame:
    """Exact Shapley values over the lattice of all coalitions: ``ident``, base (every feature at the background's median), prediction, and phi_<feature>.

    A row is predicted for each of the 2^n subsets of features; a value is the sum of those predictions with the weights of their sizes, so base and
    values add up to the prediction.
    """
    n = len(features)
    if n > 12:
        raise ValueError("the lattice has 2^n coalitions: at most 12 features")
    weight = [factorial(s) * factorial(n - s - 1) / factorial(n) for s in range(n)]
    share = [[weight[bits.bit_count() - 1] if bits >> i & 1 else -weight[bits.bit_count()] for bits in range(1 << n)] for i in range(n)]
    b = df.select(ident, *[F.col(f).cast("double").alias(f) for f in features]).withColumn("_m", medians(background, features))
    d = b.withColumn("_bits", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    d = d.select(ident, "_bits", *[F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0, F.col(f)).otherwise(F.col(f"_m.{f}")).alias(f) for i, f in enumerate(features)])
    d = d.withColumn("_p", scored(models, features, target, level))
    of = lambda row: F.get(F.array(*map(F.lit, row)), F.col("_bits"))
    at = lambda bits: F.max(F.when(F.col("_bits") == bits, F.col("_p")))
    return d.groupBy(ident).agg(at(0).alias("base"), at((1 << n) - 1).alias("prediction"), *[F.sum(of(row) * F.col("_p")).alias(f"phi_{f}") for f, row in zip(features, share)])


def waterfall(values: DataFrame, features: Sequence[str], *, ident: str = "entity_id", k: int = 3) -> DataFrame:
    """Steps of every entity in order: the base, its ``k`` largest contributions, the sum of the rest, the prediction."""
    parts = F.array_sort(F.array(*[F.struct((-F.abs(F.col(f"phi_{f}"))).alias("o"), F.lit(f).alias("step"), F.col(f"phi_{f}").alias("amount")) for f in features]))
    rest = F.aggregate(F.slice("_p", k + 1, len(features)), F.lit(0.0), lambda s, x: s + x["amount"])
    one = lambda name, amount: F.struct(F.lit(name).alias("step"), amount.alias("amount"))
    steps = F.concat(F.array(one("base", F.col("base"))), F.transform(F.slice("_p", 1, k), lambda x: F.struct(x["step"].alias("step"), x["amount"].alias("amount"))),
                     F.array(one("rest", rest), one("prediction", F.col("prediction"))))
    return values.withColumn("_p", parts).select(ident, F.posexplode(steps).alias("no", "s")).select(ident, "no", "s.step", "s.amount")


def permutation_importance(models: Models, target: str, df: DataFrame, features: Sequence[str], label: str, *, ident: str = "entity_id", level: float = 0.5, repeats: int = 5, seed: int = 0) -> DataFrame:
    """feature, mae_increase (mean over ``repeats``) and sd when a feature's values are taken from other rows.

    Every repeat ranks all rows by a hash of their own and takes the values of the next row, the last of the first: a permutation without
    bins, from one ranking for all features.
    """
    base = df.where(F.col(label).isNotNull()).select(ident, F.col(label).alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    d = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", hash_uniform(F.lit(seed), "rep", ident))
    d = materialise(range_rank(d, ["rep"], ["_h", ident], "_k"))
    n = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    other = d.select("rep", ((F.col("_k") + n - 1) % n).alias("_k"), *[F.col(f).alias(f"_o_{f}") for f in features])
    j = d.join(other, ["rep", "_k"])
    alt = F.array(F.struct(F.lit("").alias("n"), *[F.col(f).alias(f) for f in features]), *[
        F.struct(F.lit(g).alias("n"), *[(F.col(f"_o_{f}") if f == g else F.col(f)).alias(f) for f in features]) for g in features])
    x = j.withColumn("_a", F.explode(alt)).select("rep", "_y", F.col("_a.n").alias("feature"), *[F.col(f"_a.{f}").alias(f) for f in features])
    mae = x.withColumn("_p", scored(models, features, target, level)).groupBy("rep", "feature").agg(F.avg(F.abs(F.col("_p") - F.col("_y"))).alias("mae"))
    w = Window.partitionBy("rep")  # one row a feature
    gain = mae.withColumn("_g", F.col("mae") - F.max(F.when(F.col("feature") == "", F.col("mae"))).over(w)).where("feature <> ''")
    return gain.groupBy("feature").agg(F.avg("_g").alias("mae_increase"), F.stddev_pop("_g").alias("sd"))
