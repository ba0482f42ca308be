"""Queries: conformal calibration, blending, drift guard, guarded prediction, worst cases."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import calibration as C
from ..sources.bind import monthly, wells
from . import sqlkit as S
from .aggregates import QT, quantile_table
from .registry import query, with_ctes

BASE = [S.monthly("part"), *QT]
Q3 = ("p10", "p50", "p90")


def delta_sql(src: str, lo: str, hi: str, name: str, alpha: float = 0.2) -> list[str]:
    return [f"""{name}_s AS (SELECT target, greatest({lo}-y, y-{hi})/greatest({hi}-{lo}, 1e-9) AS s FROM {src})""",
            f"""{name} AS (SELECT target, count(*) AS n_calib, CASE WHEN count(*) < 10 THEN 0.0 ELSE
 list_sort(list(s))[1 + CAST(ceil(round((count(*)-1)*least(1.0::DOUBLE, ceil((count(*)+1)*(1-{alpha}::DOUBLE))/count(*)),9)) AS BIGINT)] END AS delta FROM {name}_s GROUP BY 1)"""]


@query("conformal_delta", sql=with_ctes(BASE, "cal AS (SELECT * FROM qt WHERE u < 0.5)", delta_sql("cal", "a_p10", "a_p90", "dl"), select="""
SELECT target, n_calib, round(delta,6) AS delta, (SELECT round(avg(CASE WHEN y BETWEEN a_p10 - delta*greatest(a_p90-a_p10,1e-9) AND a_p90 + delta*greatest(a_p90-a_p10,1e-9) THEN 1.0::DOUBLE ELSE 0 END),6)
 FROM qt WHERE u >= 0.5 AND qt.target = dl.target) AS test_coverage FROM dl"""))
def conformal_delta(spark, sf):
    q = quantile_table(spark, sf)
    d = C.conformal_delta(q.where("u < 0.5"), ["target"], lo="a_p10", hi="a_p90")
    t = C.apply_delta(q.where("u >= 0.5").join(F.broadcast(d), "target"), F.col("delta"), lo="a_p10", hi="a_p90")
    cov = t.groupBy("target").agg(F.avg(((F.col("y") >= F.col("a_p10")) & (F.col("y") <= F.col("a_p90"))).cast("double")).alias("c"))
    return d.join(cov, "target").select("target", "n_calib", rnd("delta", 6).alias("delta"), rnd("c", 6).alias("test_coverage"))


def pin_sql(a: str) -> str:
    terms = "+".join(f"greatest({t}::DOUBLE*(y-{a}[{i}]), ({t}::DOUBLE-1.0)*(y-{a}[{i}]))" for i, t in ((1, .1), (2, .5), (3, .9)))
    return f"(({terms})/3)"


def mix_sql(w: str) -> str:
    return "list_sort([" + ", ".join(f"(1-{w})*a_{q}+{w}*b_{q}" for q in Q3) + "])"


@query("pinball_loss", sql=with_ctes(BASE, select=f"SELECT target, round(avg({pin_sql('[a_p10,a_p50,a_p90]')}),6) AS loss_a, round(avg({pin_sql('[b_p10,b_p50,b_p90]')}),6) AS loss_b FROM qt GROUP BY 1"))
def pinball_loss(spark, sf):
    q = quantile_table(spark, sf)
    a, b = ({k: F.col(p + k) for k in Q3} for p in ("a_", "b_"))
    return q.groupBy("target").agg(rnd(F.avg(C.pinball(F.col("y"), a)), 6).alias("loss_a"), rnd(F.avg(C.pinball(F.col("y"), b)), 6).alias("loss_b"))


@query("blended_quantiles", sql=with_ctes(BASE, select=f"SELECT entity_id, target, round(m[1],5) AS p10, round(m[2],5) AS p50, round(m[3],5) AS p90 FROM (SELECT entity_id, target, {mix_sql('0.25::DOUBLE')} AS m FROM qt)"))
def blended_quantiles(spark, sf):
    q = quantile_table(spark, sf).withColumn("m", C.mixed(F.lit(0.25)))
    return q.select("entity_id", "target", *[rnd(F.get("m", i), 5).alias(n) for i, n in enumerate(Q3)])


LOSS = f"""loss AS (SELECT target, CAST(u*1000 AS BIGINT) % 2 AS fold, w, avg({pin_sql(mix_sql('w'))}) AS loss, count(*) AS n
 FROM qt, (SELECT unnest([0.0::DOUBLE,0.25,0.5,0.75,1.0]) AS w) GROUP BY ALL)"""


def folds(q):
    return q.withColumn("fold", (F.round(F.col("u") * 1000).cast("long") % 2).cast("int"))


@query("weight_selection", sql=with_ctes(BASE, LOSS, select="""
SELECT target, fold::INTEGER AS fold, w, n, round(loss,5) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY target, fold ORDER BY round(loss,9), w) AS rk FROM loss) WHERE rk = 1"""))
def weight_selection(spark, sf):
    return C.choose_weights(folds(quantile_table(spark, sf)), ["target", "fold"]).select("target", "fold", "w", "n", rnd("loss", 5).alias("loss"))


@query("crossfit_blend", sql=with_ctes(BASE, LOSS, "sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, fold ORDER BY round(loss,9), w) AS rk FROM loss) WHERE rk = 1)", f"""
x AS (SELECT q.target, entity_id, s.w AS weight, {mix_sql('s.w')} AS m FROM qt q JOIN sel s ON s.target = q.target AND s.fold = 1 - CAST(u*1000 AS BIGINT) % 2)""",
       select="SELECT target, entity_id, weight, round(m[1],5) AS p10, round(m[2],5) AS p50, round(m[3],5) AS p90 FROM x"))
def crossfit_blend(spark, sf):
    b = C.crossfit_blend(folds(quantile_table(spark, sf)))
    return b.select("target", "entity_id", "weight", *[rnd(x, 5).alias(x) for x in Q3])


# ------------------------------------------------------------------ drift
FEATS = ("x", "y", "size", "cum")
DRIFT_SQL = [S.WELLS, S.monthly("part"), """
ft AS (SELECT entity_id, first_prod, layer, x, CASE WHEN size > 45 THEN NULL ELSE y END AS y, size, cum, """ + S.uniform("3", "entity_id") + """ AS u FROM wells JOIN (SELECT entity_id, sum(oil) AS cum FROM monthly GROUP BY 1) USING (entity_id))""", """
lf AS (SELECT entity_id, u, feature, v FROM ft UNPIVOT INCLUDE NULLS (v FOR feature IN (x, y, size, cum)))""", """
prof AS (SELECT feature, median(v) AS center, CASE WHEN quantile_cont(v,.9)-quantile_cont(v,.1) > 1e-9 THEN quantile_cont(v,.9)-quantile_cont(v,.1) WHEN stddev_samp(v) > 1e-9 THEN stddev_samp(v) ELSE 1.0 END AS scale FROM lf WHERE u < 0.5 GROUP BY 1)""", """
sc AS (SELECT entity_id, any_value(u) AS u, max({'z': round(coalesce(abs(v-center)/scale,0),9), 'f': feature}) AS b FROM lf JOIN prof USING (feature) GROUP BY 1)"""]


def _drift(spark, sf):
    from ..functions.columns import hash_uniform
    cum = monthly(spark, sf, "part").groupBy("entity_id").agg(F.sum("oil").alias("cum"))
    f = wells(spark, sf).join(cum, "entity_id").select(
        "entity_id", "layer", "x", F.when(F.col("size") <= 45, F.col("y")).alias("y"), "size", "cum",
        hash_uniform(F.lit(3), "entity_id").alias("u"))
    prof = C.drift_profile(f.where("u < 0.5"), FEATS)
    return f, prof, C.drift_scores(f, prof, FEATS)


@query("drift_profile", sql=with_ctes(DRIFT_SQL, select="SELECT feature, round(center,6) AS center, round(scale,6) AS scale FROM prof"))
def drift_profile(spark, sf):
    return _drift(spark, sf)[1].select("feature", rnd("center", 6).alias("center"), rnd("scale", 6).alias("scale"))


@query("drift_guard", sql=with_ctes(DRIFT_SQL, """
thr AS (SELECT quantile_cont(b.z,.99) AS t FROM sc WHERE u >= 0.5 AND u < 0.7)""", select="""
SELECT entity_id, round(b.z,6) AS score, b.f AS top_feature, layer NOT IN (SELECT layer FROM ft WHERE u < 0.01) AS novel_category,
 layer NOT IN (SELECT layer FROM ft WHERE u < 0.01) OR b.z > (SELECT t FROM thr) AS flagged FROM sc JOIN ft USING (entity_id)"""))
def drift_guard(spark, sf):
    f, _, s = _drift(spark, sf)
    calib = s.join(f.where("u >= 0.5 AND u < 0.7").select("entity_id"), "entity_id", "left_semi")
    a = C.drift_assess(s, C.drift_threshold(calib), f, f.where("u < 0.01"), "layer")
    return a.withColumn("score", rnd("score", 6))


@query("guarded_intervals", sql=with_ctes(BASE, "mx AS (SELECT *, " + mix_sql("0.5::DOUBLE") + " AS m FROM qt)",
       "cal AS (SELECT target, y, m[1] AS lo, m[3] AS hi, a_p10, a_p90 FROM mx WHERE u < 0.5)", delta_sql("cal", "lo", "hi", "db"), delta_sql("cal", "a_p10", "a_p90", "da"), """
g AS (SELECT entity_id, mx.target, y, u > 0.9 AS flagged, CASE WHEN u > 0.9 THEN a_p10 ELSE m[1] END AS p10, CASE WHEN u > 0.9 THEN a_p50 ELSE m[2] END AS p50, CASE WHEN u > 0.9 THEN a_p90 ELSE m[3] END AS p90,
 CASE WHEN u > 0.9 THEN da.delta ELSE db.delta END AS d FROM mx JOIN da ON da.target=mx.target JOIN db ON db.target=mx.target WHERE u >= 0.5)""", select="""
SELECT entity_id, target, flagged, round(greatest(p10-d*greatest(p90-p10,1e-9), 1.0),5) AS p10, round(greatest(p50,1.0),5) AS p50, round(greatest(p90+d*greatest(p90-p10,1e-9),1.0),5) AS p90 FROM g"""))
def guarded_intervals(spark, sf):
    return _guarded(spark, sf).select("entity_id", "target", "flagged", *[rnd(x, 5).alias(x) for x in Q3])


def _guarded(spark, sf):
    q = quantile_table(spark, sf).withColumn("_m", C.mixed(F.lit(0.5)))
    q = q.select("*", *[F.get("_m", i).alias(n) for i, n in enumerate(Q3)]).drop("_m")
    cal = q.where("u < 0.5")
    test = q.where("u >= 0.5").withColumn("flagged", F.col("u") > 0.9).withColumn("floor", F.lit(1.0))
    return C.guarded_intervals(test, C.conformal_delta(cal, ["target"]), C.conformal_delta(cal, ["target"], lo="a_p10", hi="a_p90"),
                               floor="floor")


@query("worst_cases", sql=with_ctes(BASE, select="""
SELECT target, entity_id, rk, abs_error, CASE WHEN y < a_p10 THEN 'below' WHEN y > a_p90 THEN 'above' ELSE 'inside' END AS side FROM (
 SELECT *, round(abs(a_p50-y),6) AS abs_error, row_number() OVER (PARTITION BY target ORDER BY round(abs(a_p50-y),6) DESC, entity_id) AS rk FROM qt) WHERE rk <= 8"""))
def worst_cases(spark, sf):
    q = quantile_table(spark, sf)
    for x in Q3:
        q = q.withColumn(x, F.col("a_" + x))
    return C.worst_cases(q).select("target", "entity_id", "rk", "abs_error", "side")
