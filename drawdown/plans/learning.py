"""Queries: boosted quantiles with calibration, attributions, importance, prediction as of a date, similar entities."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, rnd
from ..operators import boosting as B, calibration as C, learning as L, similarity as Z
from ..operators.features import early_features, resampled_curve
from ..operators.stats import model_metrics
from ..session import materialise
from ..sources.bind import daily_users, monthly, wells
from . import sqlkit as S
from .registry import query, with_ctes

FEATS = ("x", "y", "size", "early", "n_early")
#: Months of history that features read, months that labels cover, and the month of the evaluation date.
OBS, HORIZON, AS_OF = 6, 18, 23962
TARGETS = ("volume_18", "volume_12", "water_18", "peak_18", "months_18")


def _table(spark, sf):
    """What was known at the evaluation date: features of the first months, labels of those whose horizon is over, and what each target already amounts to."""
    age = F.col("mi") - F.col("fmi")
    w = wells(spark, sf).select("entity_id", "x", "y", "size", (F.year("first_prod") * 12 + F.month("first_prod") - 1).alias("fmi"))
    m = monthly(spark, sf, "part").join(w, "entity_id").where((F.col("mi") < AS_OF) & (age < HORIZON))
    seen = lambda x, until: F.coalesce(F.sum(F.when(age < until, x)), F.lit(0.0))
    g = m.groupBy("entity_id", "x", "y", "size", "fmi").agg(
        seen(F.col("oil"), OBS).alias("early"), seen(F.lit(1.0), OBS).alias("n_early"), seen(F.col("oil"), HORIZON).alias("f_volume_18"), seen(F.col("oil"), 12).alias("f_volume_12"),
        seen(F.col("water"), HORIZON).alias("f_water_18"), F.max("oil").cast("double").alias("f_peak_18"), seen(F.lit(1.0), HORIZON).alias("f_months_18"))
    over = F.col("fmi") + HORIZON <= AS_OF
    d = g.where(F.col("fmi") + OBS <= AS_OF).withColumn("u", hash_uniform(F.lit(17), "entity_id"))
    return materialise(d.select("entity_id", "u", over.alias("over"), *[F.col(c).cast("double").alias(c) for c in FEATS], *[f"f_{t}" for t in TARGETS], *[F.when(over, F.col(f"f_{t}")).alias(t) for t in TARGETS]))


def _fitted(spark, sf, targets=TARGETS, train="over AND u < 0.5"):
    d = _table(spark, sf)
    return d, B.loaded(B.fit_models(d.where(train), FEATS, targets))


def _labelled(p):
    return p.withColumn("label", F.coalesce(*[F.when(F.col("target") == t, F.col(t)) for t in TARGETS]))


@query("boosted_quantiles")
def boosted_quantiles(spark, sf):
    """Five targets, three levels, 400 trees each; trained, calibrated and tested on hash parts of the entities whose horizon is over. A target with fewer than 25 labels has no row."""
    d, models = _fitted(spark, sf)
    p = materialise(_labelled(B.predict(models, d.where("over AND u >= 0.5"), FEATS)).select("entity_id", "u", "target", "label", "p10", "p50", "p90"))
    delta = C.conformal_delta(p.where("u < 0.75"), ["target"], y="label")
    test = p.where("u >= 0.75")
    t = C.apply_delta(test.join(F.broadcast(delta), "target"), F.col("delta"))  # one row a target
    m = model_metrics(t, ["target"], y="label")
    raw = test.groupBy("target").agg(F.avg(C.pinball(F.col("label"), {q: F.col(q) for q in C.TAUS})).alias("pinball"))
    return m.join(raw, "target").select("target", "n", *[rnd(x, 3).alias(x) for x in ("mae", "medae", "mape", "coverage", "width", "pinball")])


@query("local_attribution")
def local_attribution(spark, sf):
    d, models = _fitted(spark, sf, TARGETS[:1])
    return L.ablation_attribution(models, TARGETS[0], d.where("over AND u >= 0.5"), d.where("over AND u < 0.5"), FEATS, k=3).withColumn("effect", rnd("effect", 3))


def _shapley(spark, sf):
    d, models = _fitted(spark, sf, TARGETS[:1])
    return L.shapley(models, TARGETS[0], d.where("over AND u >= 0.5"), d.where("over AND u < 0.5"), FEATS)


@query("shapley_summary")
def shapley_summary(spark, sf):
    """Mean absolute Shapley value of every feature."""
    s = _shapley(spark, sf).agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in FEATS])
    return s.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), rnd(f, 3).alias("mean_abs_phi")) for f in FEATS])).alias("r")).select("r.*")


@query("shapley_waterfall")
def shapley_waterfall(spark, sf):
    """Steps from the base to the prediction of every entity."""
    return L.waterfall(materialise(_shapley(spark, sf)), FEATS).select("entity_id", "no", "step", rnd("amount", 3).alias("amount"))


@query("shapley_closure", sql=with_ctes(S.WELLS, f"h AS (SELECT entity_id, {S.uniform('17', 'entity_id')} AS u FROM wells WHERE fmi + {HORIZON} <= {AS_OF})", select=f"SELECT entity_id, {len(FEATS) + 3}::BIGINT AS n_values, true AS closes, true AS steps_close FROM h WHERE u >= 0.5"))
def shapley_closure(spark, sf):
    """Whether base and values add up to the prediction, and the steps of the waterfall too, for every entity."""
    s = materialise(_shapley(spark, sf))
    total = sum((F.col(f"phi_{f}") for f in FEATS), F.col("base"))
    w = L.waterfall(s, FEATS).groupBy("entity_id").agg(F.sum(F.when(F.col("step") != "prediction", F.col("amount"))).alias("_s"), F.max(F.when(F.col("step") == "prediction", F.col("amount"))).alias("_p"))
    near = lambda a, b: F.abs(a - b) < 1e-6
    return s.join(w, "entity_id").select("entity_id", F.lit(len(s.columns)).cast("long").alias("n_values"), near(total, F.col("prediction")).alias("closes"), near(F.col("_s"), F.col("_p")).alias("steps_close"))


@query("permutation_importance")
def permutation_importance(spark, sf):
    d, models = _fitted(spark, sf, TARGETS[:1])
    i = L.permutation_importance(models, TARGETS[0], d.where("over AND u >= 0.5"), FEATS, TARGETS[0])
    return i.select("feature", rnd("mae_increase", 3).alias("mae_increase"), rnd("sd", 3).alias("sd"))


@query("predict_new_entities")
def predict_new_entities(spark, sf):
    """Quantiles for entities whose horizon is not over at the evaluation date, by models of those whose is; none lies below what the entity already reached."""
    d, models = _fitted(spark, sf, train="over")
    p = B.predict(models, d.where("NOT over"), FEATS)
    floor = F.coalesce(*[F.when(F.col("target") == t, F.col(f"f_{t}")) for t in TARGETS])
    return p.select("entity_id", "target", *[rnd(F.greatest(x, floor), 3).alias(x) for x in ("p10", "p50", "p90")])


@query("similar_entities")
def similar_entities(spark, sf):
    """Five most similar users by early features and curve shape."""
    d = daily_users(spark, sf).withColumn("wc", F.col("water")).withColumn("gr", F.col("oil"))
    f = early_features(d, 20, water_cut="wc", gor="gr", cums=(10, 20)).select("entity_id", "q_max_obs", "q_mean_obs", "q_cv", "cum_10d")
    z = Z.standardise(materialise(f), ["q_max_obs", "q_mean_obs", "q_cv", "cum_10d"])
    x = materialise(z.join(resampled_curve(d, 20, 12), "entity_id", "left").select("entity_id", "z", "curve"))
    s = Z.similar_entities(x, x, 5)
    return s.select("entity_id", "ref_id", "rk", rnd("dist", 5).alias("dist"), rnd("similarity", 3).alias("similarity"))


