"""Queries: decline curves, fits, economic truncation, start selection, bootstrap, synthesis."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..functions.curves import MODELS, rate, remaining_struct
from ..operators import decline as D
from ..sources.bind import calendar_rate, monthly
from . import sqlkit as S
from .fitsql import best_ctes, fit_ctes, fit_rate_sql, remaining_ctes
from .registry import query, with_ctes
from .series import PTIME

Q_ECON = 3.0

# post-peak calendar rates of the whole history, per supplier
PTS = [S.monthly("supplier"), f"""cr AS (SELECT entity_id, mi, oil/{S.dim('mi')} AS rate FROM monthly)""", """
pts AS (SELECT entity_id, mi AS t, rate AS q FROM (SELECT *, max({'q': rate, 'n': -mi}) OVER (PARTITION BY entity_id) AS pk FROM cr) WHERE mi >= -pk.n)"""]


def points(spark, sf):
    m = calendar_rate(monthly(spark, sf, "supplier")).select("entity_id", F.col("mi").alias("t"), F.col("rate").alias("q"))
    return D.post_peak(m, "entity_id")


def _fit_cols(df, nd=4):
    f = F.col("fit")
    return df.select("entity_id", f["model"].alias("model"), F.round(f["qi"], 3).alias("qi"), F.round(f["di"], 6).alias("di"), F.round(f["b"], 5).alias("b"),
                     F.round(f["a"], 5).alias("a"), F.round(f["m"], 5).alias("m"), F.round(f["rmse"], 5).alias("rmse"), F.round(f["r2"], 5).alias("r2"), f["n"].alias("n"))


SEL = "entity_id, model, round(qi,3) AS qi, round(di,6) AS di, round(b,5) AS b, round(a,5) AS a, round(m,5) AS m, round(rmse,5) AS rmse, round(r2,5) AS r2, n"


def _register_fit(model):
    @query(f"fit_{model}", sql=with_ctes(PTS, fit_ctes("pts", "ft", model), select=f"SELECT {SEL} FROM ft"))
    def run(spark, sf):
        d = D.fit_series(points(spark, sf), "entity_id", (model,)).where("fit.converged")
        return _fit_cols(d)
    run.__name__ = f"fit_{model}"


for _m in MODELS:
    _register_fit(_m)


@query("fit_best", sql=with_ctes(PTS, best_ctes("pts", "bf", D.BEST), select=f"SELECT {SEL} FROM bf"))
def fit_best(spark, sf):
    return _fit_cols(D.fit_series(points(spark, sf), "entity_id", D.BEST).where("fit.converged"))


@query("curve_rates", sql=f"""
WITH f AS (SELECT p_partkey AS entity_id, p_retailprice/10 AS qi, 0.01::DOUBLE*p_size AS di, CASE WHEN p_size%5=0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE*(p_size%5) END AS b, 0.00625::DOUBLE AS d_min FROM part)
SELECT entity_id, t::INTEGER AS t, round({fit_rate_sql('t')},6) AS q FROM f, (SELECT unnest([0, 6, 24, 120, 360])::DOUBLE AS t)""")
def curve_rates(spark, sf):
    from ..sources.bind import table
    n = F.lit(0.0)
    f = F.struct(F.lit("modified_hyperbolic").alias("model"), (F.col("p_retailprice") / 10).alias("qi"), (0.01 * F.col("p_size")).alias("di"),
                 F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(0.3 * (F.col("p_size") % 5)).alias("b"), F.lit(0.00625).alias("d_min"), n.alias("a"), n.alias("m"))
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), f.alias("fit")).withColumn(
        "t", F.explode(F.array(*[F.lit(x) for x in (0, 6, 24, 120, 360)])))
    return d.select("entity_id", "t", rnd(rate("t", F.col("fit")), 6).alias("q"))


@query("economic_volume", sql=with_ctes(PTS, best_ctes("pts", "bf", D.BEST), "tn AS (SELECT entity_id, max(t)-min(t) AS t_now FROM pts GROUP BY 1)",
       "bt AS (SELECT * FROM bf JOIN tn USING (entity_id))", remaining_ctes("bt", "rm", "entity_id", str(Q_ECON), "f.t_now", ("arps", "duong")),
       select="SELECT entity_id, round(log10(total+1),6) AS log_total, round(log10(remaining+1),6) AS log_remaining, t_econ, capped FROM rm"))
def economic_volume(spark, sf):
    p = D.pack(points(spark, sf), "entity_id").withColumn("fit", D.fit_udf(D.BEST)("ts", "qs")).where("fit.converged")
    t_now = F.array_max("ts") - F.array_min("ts")
    v = p.withColumn("v", remaining_struct(F.col("fit"), F.lit(Q_ECON), t_now))
    return v.select("entity_id", rnd(F.log10(F.col("v.total") + 1), 6).alias("log_total"), rnd(F.log10(F.col("v.remaining") + 1), 6).alias("log_remaining"),
                    "v.t_econ", "v.capped")


def seg(n, sx, sy, sxx, sxy, syy):
    vx = f"({sxx}-{sx}*{sx}/greatest({n},1))"
    vy = f"({syy}-{sy}*{sy}/greatest({n},1))"
    cv = f"({sxy}-{sx}*{sy}/greatest({n},1))"
    return f"(CASE WHEN {n} < 2 THEN 0.0 WHEN {vx} <= 1e-12 THEN greatest({vy},0) ELSE greatest({vy}-{cv}*{cv}/{vx},0) END)"


def start_ctes(src="pts", name="st", min_tail=12, key="entity_id"):
    k6 = ("n", "sx", "sy", "sxx", "sxy", "syy")
    cum = ", ".join(f"sum({e}) OVER w AS c_{k}" for k, e in zip(k6, ("1.0", "x", "y", "x*x", "x*y", "y*y")))
    pre = ", ".join(f"c_{k}-{e} AS p_{k}" for k, e in zip(k6, ("1.0", "x", "y", "x*x", "x*y", "y*y")))
    tot = ", ".join(f"max(c_{k}) FILTER (WHERE i = n-1) OVER (PARTITION BY {key}) AS t_{k}" for k in k6)
    parts = [f"""{name}_0 AS (SELECT {key}, t, q, i, n, {pre}, {tot}, 0 AS st, 0 AS br, true AS op FROM (
  SELECT *, {cum} FROM (SELECT {key}, t, q, t::DOUBLE AS x, ln(q) AS y, row_number() OVER (PARTITION BY {key} ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {src} WHERE q > 0)
  WINDOW w AS (PARTITION BY {key} ORDER BY t ROWS UNBOUNDED PRECEDING)))"""]
    for r in range(1, 4):
        at = ", ".join(f"max(p_{k}) FILTER (WHERE i = st) OVER (PARTITION BY {key}) AS a_{k}" for k in k6)
        head = seg(*[f"(p_{k}-a_{k})" for k in k6])
        tail = seg(*[f"(t_{k}-p_{k})" for k in k6])
        one = seg(*[f"(t_{k}-a_{k})" for k in k6])
        cols = ", ".join(f"p_{k}, t_{k}" for k in k6)
        parts.append(f"""{name}_{r} AS (SELECT {key}, t, q, i, n, {cols}, CASE WHEN go THEN best.k ELSE st END AS st, br + go::INT AS br, go AS op FROM (
  SELECT *, coalesce(op AND n-st >= {min_tail + 3} AND one > 1e-12 AND (one-best.s)/one >= 0.25, false) AS go FROM (
  SELECT *, {one} AS one, min(CASE WHEN i >= st+3 AND i <= n-{min_tail} THEN {{'s': round({head}+{tail},9), 'k': i}} END) OVER (PARTITION BY {key}) AS best FROM (
  SELECT *, {at} FROM {name}_{r - 1}))))""")
    parts.append(f"""{name} AS (SELECT *, max(t) FILTER (WHERE i = st) OVER (PARTITION BY {key}) AS start_t FROM {name}_3)""")
    return parts


# the whole supplier series (not only post-peak) carries breaks to find
RAW = [S.monthly("supplier"), f"""raw AS (SELECT entity_id, mi AS t, oil/{S.dim('mi')} AS q FROM monthly)"""]


@query("decline_start", sql=with_ctes(RAW, start_ctes("raw", "st"), select="""
SELECT entity_id, max(start_t) AS start_t, max(st)::INTEGER AS start_index, max(n-st)::BIGINT AS n_tail, max(br)::BIGINT AS n_breaks, round(regr_slope(ln(q), t),6) AS tail_slope, regr_slope(ln(q), t) < 0 AS declining
FROM st WHERE t >= start_t GROUP BY 1"""))
def decline_start(spark, sf):
    m = calendar_rate(monthly(spark, sf, "supplier")).select("entity_id", F.col("mi").alias("t"), F.col("rate").alias("q"))
    s = D.tail_slope(D.decline_start(m, "entity_id"), "entity_id")
    return s.withColumn("tail_slope", rnd("tail_slope", 6))


def entity_fit_ctes(src, name, min_tail=12, key="entity_id"):
    """UE-style fit: post-peak, segment, retry on the whole post-peak series; (key, b_*, l_*, fit_start, n_fit)."""
    a = [f"""{name}_e AS (SELECT {key}, t, q FROM (SELECT *, count(*) FILTER (WHERE q > 0) OVER (PARTITION BY {key}) AS nn, max(CASE WHEN q > 0 THEN {{'q': q, 'n': -t}} END) OVER (PARTITION BY {key}) AS pk FROM {src}) WHERE nn >= {min_tail} AND q > 0 AND t >= -pk.n)""",
         f"""{name}_q AS (SELECT {key}, t, q FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS nn FROM {name}_e) WHERE nn >= {min_tail})""",
         *start_ctes(f"{name}_q", f"{name}_s", min_tail, key),
         f"""{name}_a AS (SELECT {key}, t, q FROM {name}_s WHERE t >= start_t)""",
         f"""{name}_b AS (SELECT {key}, t, q FROM {name}_s WHERE st > 0)""",
         *best_ctes(f"{name}_a", f"{name}_ab", D.TERMINAL, key), *fit_ctes(f"{name}_a", f"{name}_al", "exponential", key),
         *best_ctes(f"{name}_b", f"{name}_bb", D.TERMINAL, key), *fit_ctes(f"{name}_b", f"{name}_bl", "exponential", key)]
    def pick(src_pts, b, lo, t):
        return f"""SELECT {key}, {t} AS try, b.model AS b_model, b.qi AS b_qi, b.di AS b_di, b.b AS b_b, b.d_min AS b_dmin, l.qi AS l_qi, l.di AS l_di, s.t0 AS fit_start, s.nf AS n_fit
  FROM {b} b JOIN {lo} l USING ({key}) JOIN (SELECT {key}, min(t)::DOUBLE AS t0, count(*) AS nf FROM {src_pts} GROUP BY 1) s USING ({key}) WHERE l.di >= 0.001"""
    a.append(f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY try) AS rk FROM ({pick(name + '_a', name + '_ab', name + '_al', 0)} UNION ALL {pick(name + '_b', name + '_bb', name + '_bl', 1)})) WHERE rk = 1)""")
    return a


def low_best_ctes(src, name, key, q_econ, now, keep=""):
    """remaining_best / remaining_low from a CTE of :func:`entity_fit_ctes` rows."""
    return [f"""{name}_fb AS (SELECT *, b_qi AS qi, b_di AS di, b_b AS b, b_dmin AS d_min, 'arps' AS model FROM {src})""",
            f"""{name}_fl AS (SELECT *, l_qi AS qi, greatest(l_di, b_dmin) AS di, 0.0::DOUBLE AS b, 0.0::DOUBLE AS d_min, 'arps' AS model FROM {src})""",
            *remaining_ctes(f"{name}_fb", f"{name}_rb", key, q_econ, f"({now}) - f.fit_start", keep=keep),
            *remaining_ctes(f"{name}_fl", f"{name}_rl", key, q_econ, f"({now}) - f.fit_start", keep=keep),
            f"""{name} AS (SELECT b.*, b.remaining AS remaining_best, least(l.remaining, b.remaining) AS remaining_low FROM {name}_rb b JOIN {name}_rl l USING ({key}{keep}))"""]


NOW = 23993
FR = [S.monthly("supplier"), PTIME, f"""fr AS (SELECT entity_id, mi - idle_months AS t, CASE WHEN days_on >= 0.1*{S.dim('mi')} THEN oil/{S.dim('mi')} END AS q FROM ptime WHERE mi <= {NOW})"""]


def supplier_fit_points(spark, sf, now=NOW):
    from ..operators.series import fit_rate, producing_time
    m = producing_time(monthly(spark, sf, "supplier").where(F.col("mi") <= now))
    return fit_rate(m, share=0.1).select("entity_id", F.col("ptime").alias("t"), F.col("fit_rate").alias("q"))


@query("entity_decline_fit", sql=with_ctes(FR, entity_fit_ctes("fr", "ef"), low_best_ctes("ef", "lb", "entity_id", str(Q_ECON), str(NOW)), select="""
SELECT entity_id, b_model AS model, round(b_qi,3) AS qi, round(b_di,6) AS di, round(b_b,5) AS b, round(l_di,6) AS low_di, fit_start, n_fit, round(remaining_best,1) AS remaining_best, round(remaining_low,1) AS remaining_low
FROM ef JOIN lb USING (entity_id)"""))
def entity_decline_fit(spark, sf):
    f = D.entity_decline_fit(supplier_fit_points(spark, sf), "entity_id")
    r = D.remaining_low_best(f, q_econ=F.lit(Q_ECON), now=F.lit(NOW))
    return r.select("entity_id", F.col("best.model").alias("model"), rnd("best.qi", 3).alias("qi"), rnd("best.di", 6).alias("di"), rnd("best.b", 5).alias("b"),
                    rnd("low.di", 6).alias("low_di"), "fit_start", "n_fit", rnd("remaining_best", 1).alias("remaining_best"), rnd("remaining_low", 1).alias("remaining_low"))


@query("bootstrap_band")
def bootstrap_band(spark, sf):
    p = D.pack(points(spark, sf), "entity_id").withColumn("fit", D.fit_udf(("exponential",))("ts", "qs")).where("fit.converged")
    b = D.bootstrap_remaining(p, "entity_id", q_econ=Q_ECON, n_boot=120)
    return b.select("entity_id", "n_boot", *[rnd(x, 2).alias(x) for x in ("base", "p10", "p50", "p90")])


@query("eur_band")
def eur_band(spark, sf):
    """Cumulative (certain) plus the remaining band."""
    pts = points(spark, sf)
    p = D.pack(pts, "entity_id").withColumn("fit", D.fit_udf(("exponential",))("ts", "qs")).where("fit.converged")
    b = D.bootstrap_remaining(p, "entity_id", q_econ=Q_ECON, n_boot=120, seed=1)
    cum = monthly(spark, sf, "supplier").groupBy("entity_id").agg(F.sum("oil").alias("cum"))
    return b.join(cum, "entity_id").select("entity_id", rnd("cum", 2).alias("cum"), *[rnd(F.col("cum") + F.col(x), 2).alias(f"eur_{x}") for x in ("p10", "p50", "p90")])


@query("synthesised_curve", sql=with_ctes(S.monthly("supplier"), """
pr AS (SELECT entity_id, max(oil)/30 AS q_peak, 30.0::DOUBLE*(1+entity_id%7) AS t_peak, sum(oil)/2 AS eur FROM monthly GROUP BY 1)""", """
tg AS (SELECT *, greatest(eur - q_peak*t_peak/1.62, q_peak*30.4) AS target FROM pr)""", """
bs AS (SELECT entity_id, q_peak, t_peak, target, 0.001::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS it FROM tg UNION ALL
 SELECT entity_id, q_peak, t_peak, target, CASE WHEN cum > target THEN mid ELSE lo END, CASE WHEN cum > target THEN hi ELSE mid END, it+1 FROM (
  SELECT *, (lo+hi)/2 AS mid, list_sum(list_transform(range(240), lambda i: q_peak*""" + fit_rate_sql("0.5::DOUBLE*i", "z").replace("z.qi*", "").replace("z.di", "((lo+hi)/2)").replace("z.b", "0.9::DOUBLE").replace("z.d_min", "0.00625::DOUBLE") + """))*15.2 AS cum FROM bs) WHERE it < 40)""",
       select="SELECT entity_id, round((lo+hi)/2, 6) AS di FROM bs WHERE it = 40"))
def synthesised_curve(spark, sf):
    m = monthly(spark, sf, "supplier").groupBy("entity_id").agg((F.max("oil") / 30).alias("q_peak"), (F.sum("oil") / 2).alias("eur"))
    m = m.withColumn("t_peak", 30.0 * (1 + F.col("entity_id") % 7))
    return D.synthesised_curve(m).select("entity_id", rnd("di", 6).alias("di"))


@query("decline_report", sql=with_ctes(PTS, best_ctes("pts", "bf", D.TERMINAL), "tn AS (SELECT entity_id, max(t)-min(t) AS t_now FROM pts GROUP BY 1)",
       "bt AS (SELECT * FROM bf JOIN tn USING (entity_id))", remaining_ctes("bt", "rm", "entity_id", str(Q_ECON), "f.t_now"), """
cm AS (SELECT entity_id, sum(oil) AS cum FROM monthly GROUP BY 1)""", select="""
SELECT entity_id, CASE WHEN n IS NULL THEN 'too_few_points' END AS reason, model, n, round(cum,2) AS cum, round(remaining,2) AS remaining, round(cum+remaining,2) AS eur, t_econ, capped
FROM cm LEFT JOIN bf USING (entity_id) LEFT JOIN rm USING (entity_id)"""))
def decline_report(spark, sf):
    """One line per entity: fit, economics, EUR, or the reason why there is none."""
    p = D.pack(points(spark, sf), "entity_id").withColumn("fit", D.fit_udf(D.TERMINAL)("ts", "qs")).where("fit.converged")
    v = p.withColumn("v", remaining_struct(F.col("fit"), F.lit(Q_ECON), F.array_max("ts") - F.array_min("ts")))
    cum = monthly(spark, sf, "supplier").groupBy("entity_id").agg(F.sum("oil").alias("cum"))
    j = cum.join(v, "entity_id", "left")
    return j.select("entity_id", F.when(F.col("fit").isNull(), "too_few_points").alias("reason"), F.col("fit.model").alias("model"), F.col("fit.n").alias("n"),
                    rnd("cum", 2).alias("cum"), rnd("v.remaining", 2).alias("remaining"), rnd(F.col("cum") + F.col("v.remaining"), 2).alias("eur"), "v.t_econ", "v.capped")
