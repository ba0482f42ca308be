"""Queries: constrained decline, diagnostics, volumetrics, copula aggregation, hindcast, cross-check, classification."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.columns import hash_uniform, rnd
from ..functions.curves import fit_udf, remaining_struct
from ..operators import decline as D, hindcast as H, montecarlo as M, physics as P, rules as R
from ..operators.stats import error_summary, icc_oneway, recovery_reference, running_total
from ..session import materialise, spread
from ..sources.bind import calendar_rate, daily, monthly, table
from . import sqlkit as S
from .decline import PTS, Q_ECON, RAW, points
from .fitsql import best_ctes, fit_rate_sql, remaining_ctes
from .registry import query, with_ctes

PAR = """pp AS (SELECT p_partkey AS id, p_brand AS layer, p_retailprice/10 AS qi, 0.004::DOUBLE*p_size AS di, (p_size % 13)::DOUBLE AS te, 0.1::DOUBLE + 0.09::DOUBLE*(p_partkey % 11) AS b, 0.00625::DOUBLE AS dm FROM part)"""


def _params(spark, sf):
    k = F.col("p_partkey")
    fit = F.struct((F.col("p_retailprice") / 10).alias("qi"), (0.004 * F.col("p_size")).alias("di"), (F.col("p_size") % 13).cast("double").alias("t_elf"),
                   (0.1 + 0.09 * (k % 11)).alias("b_bdf"), F.lit(0.00625).alias("d_min"), F.lit(True).alias("converged"), F.lit(30).cast("long").alias("n"))
    return table(spark, sf, "part").select(k.alias("id"), F.col("p_brand").alias("layer"), fit.alias("pfit"))


def prate(t):
    te = "(CASE WHEN di > dm THEN least(te, (di/dm-1)/(2*di)) ELSE te END)"
    de, qe, tb = f"(di/(1+2*di*{te}))", f"(qi/sqrt(1+2*di*{te}))", f"greatest({t}-{te},0)"
    tsw = f"(({de}/dm-1)/(b*{de}))"
    return (f"(CASE WHEN {t} < {te} THEN qi/sqrt(1+2*di*{t}) WHEN {de} <= dm THEN {qe}*exp(-dm*{tb}) WHEN {tb} > {tsw} THEN {qe}*pow(1+b*{de}*{tsw},-1/b)*exp(-dm*({tb}-{tsw})) ELSE {qe}*pow(1+b*{de}*{tb},-1/b) END)")


@query("physics_rates", sql=with_ctes(PAR, select=f"SELECT id, t::INTEGER AS t, round({prate('t')},6) AS q FROM pp, (SELECT unnest([0,3,12,60,240])::DOUBLE AS t)"))
def physics_rates(spark, sf):
    d = _params(spark, sf).withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0, 3, 12, 60, 240)])))
    return d.select("id", "t", rnd(P.rate("t", F.col("pfit")), 6).alias("q"))


@query("physics_remaining", sql=with_ctes(PAR, f"pv AS (SELECT id, i, {prate('(10+0.5*i)::DOUBLE')} AS q FROM pp, range(1180) r(i))", """
pa AS (SELECT *, min(CASE WHEN q >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS alive FROM pv)""",
       select="SELECT id, round(coalesce(sum(q) FILTER (WHERE alive=1),0)*15.2,2) AS remaining, 10 + 0.5::DOUBLE*coalesce(max(i) FILTER (WHERE alive=1),0) AS t_econ FROM pa GROUP BY 1"))
def physics_remaining(spark, sf):
    r = _params(spark, sf).withColumn("r", P.remaining_struct(F.col("pfit"), F.lit(20.0), F.lit(10.0)))
    return r.select("id", rnd("r.remaining", 2).alias("remaining"), "r.t_econ")


@query("analog_prior", sql=with_ctes(PAR, "lg AS (SELECT layer, b, ln(greatest(te,.05)) AS te, ln(di) AS di FROM pp)", """
md AS (SELECT layer, count(*) AS n, median(b) AS mb, median(te) AS mt, median(di) AS mdi FROM lg GROUP BY 1 HAVING count(*) >= 5)""", select="""
SELECT layer, any_value(n) AS n_analogs, round(any_value(mb),6) AS b_mean, round(greatest(1.4826*median(abs(b-mb)),.12),6) AS b_sd, round(exp(any_value(mt)),6) AS t_elf, round(greatest(1.4826*median(abs(te-mt)),.5),6) AS t_elf_sd, round(any_value(mdi),6) AS ln_di, round(greatest(1.4826*median(abs(di-mdi)),.25),6) AS ln_di_sd FROM lg JOIN md USING (layer) GROUP BY 1"""))
def analog_prior(spark, sf):
    p = P.analog_prior(_params(spark, sf), "layer")
    return p.select("layer", "n_analogs", *[rnd(f"prior.{x}", 6).alias(x) for x in P.PRIOR_COLS])


@query("physics_fit")
def physics_fit(spark, sf):
    p = P.fit_physics(D.pack(points(spark, sf), "entity_id"), q_econ=Q_ECON)
    return p.select("entity_id", *[rnd(f"pfit.{x}", 5).alias(x) for x in ("qi", "di", "t_elf", "b_bdf", "rmse", "r2")], "pfit.n", "pfit.converged")


@query("physics_bootstrap")
def physics_bootstrap(spark, sf):
    p = P.fit_physics(D.pack(points(spark, sf), "entity_id"), q_econ=Q_ECON)
    return P.bootstrap_physics(p, "entity_id", q_econ=Q_ECON, n_boot=40).select("entity_id", *[rnd(x, 2).alias(x) for x in ("base", "p10", "p50", "p90")])


@query("prior_of_others", sql=with_ctes(PAR, "lg AS (SELECT id, layer, b, ln(greatest(te,.05)) AS te, ln(di) AS di FROM pp)", select="""
SELECT a.id, count(*) AS n_analogs, round(median(o.b),6) AS b_mean, round(greatest(1.4826*mad(o.b),0.12),6) AS b_sd, round(exp(median(o.te)),6) AS t_elf, round(greatest(1.4826*mad(o.te),0.5),6) AS t_elf_sd,
 round(median(o.di),6) AS ln_di, round(greatest(1.4826*mad(o.di),0.25),6) AS ln_di_sd FROM lg a JOIN lg o ON o.layer = a.layer AND o.id <> a.id GROUP BY a.id HAVING count(*) >= 5"""))
def prior_of_others(spark, sf):
    """The prior of every entity from the others of its layer."""
    p = P.analog_prior_of_others(materialise(_params(spark, sf)), "layer", entity="id")
    return p.select("id", "n_analogs", *[rnd(f"prior.{c}", 6).alias(c) for c in P.PRIOR_COLS])


@query("physics_review")
def physics_review(spark, sf):
    """Constrained against empirical remaining volume: the prior comes from the other mature entities of the block, and the total ends at the volumetric median times
    the 90 % quantile of the block's recovery; with the band of 30 replicates under the same limits."""
    block = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("b"), (F.col("s_nationkey") % 5).cast("string")).alias("block"))
    cum = monthly(spark, sf, "supplier").groupBy("entity_id").agg(F.sum("oil").alias("cum"))
    place = materialise(M.volumetric(_rock(spark, sf), 10_000, 7).select("entity_id", F.col("p50").alias("ooip")))
    known = block.join(cum, "entity_id").join(place, "entity_id")
    recovery = recovery_reference(known.withColumnRenamed("cum", "eur"), "block").select("block", "high_pct")
    limits = known.join(recovery, "block").select("entity_id", "block", "cum", (F.col("ooip") * F.col("high_pct") / 100).alias("cap"))
    # few bytes, long fits: every step deals the series over all tasks
    p = materialise(spread(D.pack(points(spark, sf), "entity_id").join(limits, "entity_id"), "entity_id").withColumn("fit", fit_udf(D.BEST)("ts", "qs")).where("fit.converged"))
    free = materialise(P.fit_physics(spread(p, "entity_id"), q_econ=Q_ECON).select("entity_id", "block", "pfit"))
    prior = P.analog_prior_of_others(free, "block").select("entity_id", "prior", "n_analogs")
    p = materialise(P.fit_physics(spread(p.join(prior, "entity_id", "left"), "entity_id"), q_econ=Q_ECON, cum="cum", cap="cap", prior="prior"))
    t_now = F.array_max("ts") - F.array_min("ts")
    r = p.withColumn("a", remaining_struct(F.col("fit"), F.lit(Q_ECON), t_now)["remaining"])
    band = P.bootstrap_physics(p, "entity_id", q_econ=Q_ECON, n_boot=30, cum="cum", cap="cap", prior="prior")
    return r.join(band, "entity_id").select("entity_id", F.coalesce("n_analogs", F.lit(0)).alias("n_analogs"), rnd("cap", 1).alias("cap"), "pfit.cap_binding", rnd("a", 2).alias("arps_remaining"), rnd("base", 2).alias("physics_remaining"),
                                            rnd(F.try_divide(100 * (F.col("base") - F.col("a")), F.col("cum") + F.col("a")), 2).alias("delta_pct"), *[rnd(F.col("cum") + F.col(x), 1).alias(f"eur_{x}") for x in ("p10", "p50", "p90")])


FRP = """fl AS (SELECT *, ln(t) AS lx, ln(q) AS ly, row_number() OVER (PARTITION BY entity_id ORDER BY t) AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT entity_id, (t-min(t) OVER (PARTITION BY entity_id)+1)::DOUBLE AS t, q FROM raw) WHERE q > 0)"""


@query("flow_regime", sql=with_ctes(RAW, FRP, """
sl AS (SELECT a.entity_id, a.i, a.t, CASE WHEN count(*) >= 3 THEN regr_slope(b.ly, b.lx) END AS s FROM fl a JOIN fl b ON b.entity_id=a.entity_id AND b.i BETWEEN a.i - greatest(5, a.n//5)//2 AND a.i + greatest(5, a.n//5)//2 WHERE a.n >= 6 GROUP BY ALL)""", """
on3 AS (SELECT entity_id, min(t) FILTER (WHERE a AND coalesce(b,true) AND coalesce(c,true)) AS t_elf FROM (SELECT entity_id, t, coalesce(s,0) < -0.85 AS a, lead(coalesce(s,0) < -0.85) OVER w AS b, lead(coalesce(s,0) < -0.85,2) OVER w AS c FROM sl WINDOW w AS (PARTITION BY entity_id ORDER BY i)) GROUP BY 1)""", """
el AS (SELECT entity_id, regr_slope(ly,lx) FILTER (WHERE i <= greatest(3,n//3)) AS e, regr_slope(ly,lx) FILTER (WHERE i > n-greatest(3,n//3)) AS l, count(*) AS n FROM fl WHERE n >= 6 GROUP BY 1)""", select="""
SELECT entity_id, round(e,5) AS early_slope, round(l,5) AS late_slope, n, t_elf, CASE WHEN l < -0.85 THEN 'boundary_dominated' WHEN l > -0.7 THEN 'linear_flow' ELSE 'transition' END AS regime FROM el JOIN on3 USING (entity_id)"""))
def flow_regime(spark, sf):
    m = calendar_rate(monthly(spark, sf, "supplier"))
    t = (F.col("mi") - F.min("mi").over(Window.partitionBy("entity_id")) + 1).cast("double")
    r = P.flow_regime(m.select("entity_id", t.alias("t"), F.col("rate").alias("q")), "entity_id")
    return r.select("entity_id", rnd("early_slope", 5).alias("early_slope"), rnd("late_slope", 5).alias("late_slope"), "n", "t_elf", "regime")


@query("pressure_diagnostic", sql=with_ctes(S.daily("group"), """
pd AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day_index) AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT *, sum(oil) OVER (PARTITION BY entity_id ORDER BY day_index) AS cum FROM daily) WHERE cum > 0 AND oil > 0 AND whp IS NOT NULL)""", """
pi AS (SELECT *, max(CASE WHEN i <= greatest(5, n//10) THEN whp END) OVER (PARTITION BY entity_id)*1.05 AS p FROM pd)""", """
gd AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day_index) AS j, count(*) OVER (PARTITION BY entity_id) AS m FROM pi WHERE p > whp)""", select="""
SELECT entity_id, round(any_value(p),5) AS p_init, round(regr_slope(ln((p-whp)/oil), ln(cum/oil)) FILTER (WHERE j > m//2),5) AS slope FROM gd GROUP BY 1"""))
def pressure_diagnostic(spark, sf):
    d = running_total(daily(spark, sf, "group"), entity="entity_id", order="day_index", value="oil", out="cum")
    r = P.pressure_diagnostic(d, "entity_id", order="day_index", cum="cum", q="oil", whp="whp")
    return r.select("entity_id", rnd("p_init", 5).alias("p_init"), rnd("slope", 5).alias("slope"))


# ------------------------------------------------------------------ volumetrics
ROCK = """rk AS (SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE 800.0 + s_suppkey % 700 END::DOUBLE AS lat, 5 + (s_acctbal+1000)/1000 AS pay, 6.0::DOUBLE + s_suppkey % 9 AS porosity, 40.0::DOUBLE + s_suppkey % 31 AS saturation FROM supplier)"""
AREA = "(CASE WHEN lat > 0 THEN lat*300 ELSE pi()*40000 END)"


def _rock(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("entity_id"), F.when(k % 3 == 0, 0.0).otherwise(800.0 + k % 700).alias("lateral"),
                                               (5 + (F.col("s_acctbal") + 1000) / 1000).alias("pay"), (6.0 + k % 9).alias("porosity"), (40.0 + k % 31).alias("saturation"))


@query("oil_in_place", sql=with_ctes(ROCK, select=f"SELECT entity_id, round({AREA},3) AS area, round({AREA}*pay*porosity/100*saturation/100*.85/1.15,2) AS ooip FROM rk"))
def oil_in_place(spark, sf):
    return _rock(spark, sf).select("entity_id", rnd(M.drainage_area("lateral"), 3).alias("area"), rnd(M.ooip(M.drainage_area("lateral"), "pay", "porosity", "saturation"), 2).alias("ooip"))


def _logn(u, m, cv):
    import math
    s = math.sqrt(math.log(1 + cv * cv))
    return f"exp(ln({m})-{s * s / 2!r}+{s!r}*z_{u})"


DRAWS = [ROCK, f"""uu AS (SELECT *, {S.uniform("7", "'area'", "entity_id", "i")} AS u1, {S.uniform("7", "'pay'", "entity_id", "i")} AS u2, {S.uniform("7", "'porosity'", "entity_id", "i")} AS u3, {S.uniform("7", "'saturation'", "entity_id", "i")} AS u4, {S.uniform("7", "'recovery'", "entity_id", "i")} AS u5 FROM rk, range(10000) r(i))""",
         f"""zz AS (SELECT *, {S.ppf('u1')} AS z_1, {S.ppf('u2')} AS z_2, {S.ppf('u3')} AS z_3, {S.ppf('u4')} AS z_4, {S.ppf('u5')} AS z_5 FROM uu)""",
         f"""vv AS (SELECT entity_id, {_logn(1, AREA, .25)}*{_logn(2, 'pay', .18)}*least({_logn(3, 'porosity', .18 * .8)},35)/100*least({_logn(4, 'saturation', .18 * .6)},95)/100*.85/1.15 AS v, {_logn(5, '(3.0::DOUBLE+entity_id%6)', .2)} AS r FROM zz)"""]


@query("volumetric_monte_carlo", sql=with_ctes(DRAWS, select="SELECT entity_id, round(quantile_cont(v,.1),1) AS p10, round(median(v),1) AS p50, round(quantile_cont(v,.9),1) AS p90, round(avg(v),1) AS mean, round(stddev_pop(v),1) AS sd, round(quantile_cont(v*r/100,.1),1) AS rec_p10, round(median(v*r/100),1) AS rec_p50, round(quantile_cont(v*r/100,.9),1) AS rec_p90 FROM vv GROUP BY 1"))
def volumetric_monte_carlo(spark, sf):
    """Oil in place and recoverable volume, 10 000 draws an entity."""
    v = M.volumetric(_rock(spark, sf).withColumn("recovery", 3.0 + F.col("entity_id") % 6), 10_000, 7, recovery="recovery")
    return v.select("entity_id", *[rnd(x, 1).alias(x) for x in ("p10", "p50", "p90", "mean", "sd", "rec_p10", "rec_p50", "rec_p90")])


@query("parameter_draws", sql=with_ctes(ROCK, f"uu AS (SELECT entity_id, pay, i, {S.uniform('3', 'entity_id', 'i')} AS u FROM rk, range(5) r(i))", select=f"""
SELECT entity_id, i::INTEGER AS i, round(pay+pay*.15*{S.ppf('u')},6) AS normal, round(CASE WHEN u < .5 THEN pay*.7+sqrt(u*(pay*.6)*(pay*.3)) ELSE pay*1.3-sqrt((1-u)*(pay*.6)*(pay*.3)) END,6) AS triangular FROM uu"""))
def parameter_draws(spark, sf):
    d = _rock(spark, sf).select("entity_id", "pay").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    u = hash_uniform(F.lit(3), "entity_id", "i")
    return d.select("entity_id", "i", rnd(M.sample(u, "pay", 0.15, "normal"), 6).alias("normal"), rnd(M.sample(u, "pay", 0.15, "triangular"), 6).alias("triangular"))


# ------------------------------------------------------------------ copula
ERR = """er AS (SELECT CASE WHEN user_id % 2 = 0 THEN 12 ELSE 24 END AS bucket, list(e ORDER BY e) AS sample, count(*) AS n FROM (SELECT user_id, ln(avg(value) FILTER (WHERE day(ts) > 15)/avg(value) FILTER (WHERE day(ts) <= 15)) AS e FROM events GROUP BY 1) WHERE e IS NOT NULL GROUP BY 1)"""
CW = [S.monthly("supplier"), ERR, """cw AS (SELECT entity_id, 'g' || s_nationkey AS grp, CASE WHEN count(*) >= 80 THEN 24 ELSE 12 END AS bucket, sum(oil)/10 AS best FROM monthly JOIN supplier ON s_suppkey = entity_id GROUP BY ALL)"""]


def lerp(u):
    pos = f"greatest(0.0::DOUBLE, least({u}*n-0.5, (n-1)::DOUBLE))"
    return f"(sample[1+floor({pos})::BIGINT] + (sample[1+least(floor({pos})::BIGINT+1, n-1)]-sample[1+floor({pos})::BIGINT])*({pos}-floor({pos})))"


def _copula_inputs(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.avg(F.when(F.day("ts") > 15, F.col("value"))).alias("a"), F.avg(F.when(F.day("ts") <= 15, F.col("value"))).alias("b"))
    err = e.where("a IS NOT NULL AND b IS NOT NULL").select(F.when(F.col("user_id") % 2 == 0, 12).otherwise(24).alias("bucket"), F.ln(F.col("a") / F.col("b")).alias("e"))
    w = monthly(spark, sf, "supplier").groupBy("entity_id").agg((F.sum("oil") / 10).alias("best"), F.count(F.lit(1)).alias("n"))
    w = w.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("grp")), "entity_id")
    return w.withColumn("bucket", F.when(F.col("n") >= 80, 24).otherwise(12)), M.order_statistics(err, "bucket", "e")


@query("quantile_mapping", sql=with_ctes(ERR, select=f"SELECT bucket, u, round({lerp('u')},6) AS e FROM er, (SELECT unnest([0.001::DOUBLE,0.1,0.5,0.9,0.999]) AS u)"))
def quantile_mapping(spark, sf):
    s = _copula_inputs(spark, sf)[1]
    u = s.where("k = 0").select("bucket", F.explode(F.array(*[F.lit(x) for x in (0.001, 0.1, 0.5, 0.9, 0.999)])).alias("u"))
    return M.mapped(u, s, "bucket", "u", "e").select("bucket", "u", rnd("e", 6).alias("e"))


@query("copula_aggregation", sql=with_ctes(CW, f"""
sm AS (SELECT c.*, sample, n, rho, i, {S.uniform("7", "'group'", "grp", "i")} AS ug, {S.uniform("7", "'entity'", "entity_id", "i")} AS ue FROM cw c JOIN er USING (bucket), (SELECT unnest([0.0::DOUBLE,0.5,1.0]) AS rho), range(4000) r(i))""", f"""
sz AS (SELECT *, sqrt(rho)*{S.ppf('ug')} + sqrt(1-rho)*{S.ppf('ue')} AS z FROM sm)""", f"su AS (SELECT *, {S.cdf('z')} AS u FROM sz)", f"""
st AS (SELECT rho, i, sum(best*exp({lerp('u')})) AS t FROM su GROUP BY ALL)""", f"rf AS (SELECT sum(best*exp({lerp('0.10::DOUBLE')})) AS p, sum(best) AS b, count(*) AS n FROM cw JOIN (SELECT bucket, sample, n FROM er) USING (bucket))", select="""
SELECT rho, (SELECT n FROM rf) AS n_wells, round(quantile_cont(t,.1),2) AS p10, round(median(t),2) AS p50, round(quantile_cont(t,.9),2) AS p90, round((SELECT b FROM rf),2) AS sum_best, round((SELECT p FROM rf),2) AS sum_well_p10, round(quantile_cont(t,.1)-(SELECT p FROM rf),2) AS aggregation_gain FROM st GROUP BY 1"""))
def copula_aggregation(spark, sf):
    w, s = _copula_inputs(spark, sf)
    r = M.aggregate_copula(w, s, (0.0, 0.5, 1.0), 4000, 7)
    return r.select("rho", "n_wells", *[rnd(x, 2).alias(x) for x in ("p10", "p50", "p90", "sum_best", "sum_well_p10", "aggregation_gain")])


# ------------------------------------------------------------------ hindcast
def _series(spark, sf):
    """Series of all suppliers, indexed from the first month."""
    m = calendar_rate(monthly(spark, sf, "supplier"))
    s0 = F.min("mi").over(Window.partitionBy("entity_id"))
    s = m.withColumn("start_month", s0).withColumn("t", F.col("mi") - F.col("start_month") + 0.5)
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("b"), (F.col("s_nationkey") % 5).cast("string")).alias("grp"))
    return H.library_split(s.select("entity_id", "t", "rate", "start_month").join(g, "entity_id"))


def _hindcast(spark, sf):
    s = materialise(_series(spark, sf))
    lib = D.pack(s.where("in_library"), ["entity_id", "grp"], q="rate").where(F.size("ts") >= 24)
    priors = P.analog_prior(P.fit_physics(lib, q_econ=Q_ECON), "grp")
    rows = H.horizon_rows(s.where("NOT in_library"), (6, 12, 24))
    return materialise(H.hindcast(rows, materialise(priors), q_econ=Q_ECON))


@query("hindcast_summary")
def hindcast_summary(spark, sf):
    return error_summary(H.hindcast_errors(_hindcast(spark, sf)), ["H", "method", "win"], "err")


RATIOS = [S.monthly("supplier"), f"""sr AS (SELECT entity_id, mi, oil/{S.dim('mi')} AS rate, min(mi) OVER (PARTITION BY entity_id) AS sm FROM monthly)""",
          """lb AS (SELECT entity_id, row_number() OVER (ORDER BY sm, entity_id) % 2 = 1 AS lib FROM (SELECT entity_id, min(sm) AS sm FROM sr GROUP BY 1))""",
          """sv AS (SELECT entity_id, (mi-sm)::DOUBLE AS t, rate AS q, 'b'||(s_nationkey%5) AS grp, max(mi-sm) OVER (PARTITION BY entity_id) + 0.5 AS last FROM sr JOIN lb USING (entity_id) JOIN supplier ON s_suppkey=entity_id WHERE NOT lib)""",
          """hz AS (SELECT entity_id||'/'||H AS ek, H, grp, t, t+0.5 AS x, q FROM sv, (SELECT unnest([6,12,24]) AS H) WHERE last >= 20)""",
          """hk AS (SELECT ek FROM hz GROUP BY ek HAVING count(*) FILTER (WHERE x < H) >= 5 AND count(*) FILTER (WHERE x > H AND x < H+12) >= 8)""",
          """hs AS (SELECT ek, t, q FROM hz JOIN hk USING (ek) WHERE x < H)""", best_ctes("hs", "hf", D.BEST, "ek"),
          f"""lr AS (SELECT H, grp, ln(a/p) AS e FROM (SELECT z.ek, any_value(H) AS H, any_value(grp) AS grp, sum(z.q)*30.4 AS a, sum({fit_rate_sql('z.t', 'f', ('arps', 'duong'))})*30.4 AS p FROM hz z JOIN hf f ON f.ek=z.ek WHERE x > H GROUP BY z.ek) WHERE a > 0 AND p > 0)""",
          """lk AS (SELECT * FROM lr WHERE H IN (SELECT H FROM lr GROUP BY 1 HAVING count(*) >= 20))""",
          """ig AS (SELECT grp, count(*) AS n, avg(e) AS m, var_pop(e) AS vp FROM lk WHERE H = 24 GROUP BY 1)""",
          """it AS (SELECT count(*) AS k, sum(n) AS n, sum(n*(m-(SELECT avg(e) FROM lk WHERE H = 24))**2)/(count(*)-1) AS msb, sum(n*vp)/(sum(n)-count(*)) AS msw FROM ig)""",
          """ic AS (SELECT k, CASE WHEN k < 2 OR n <= k THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE,(msb-msw)/(msb+(n/k-1)*msw)) END AS icc FROM it)"""]


def _ratios(spark, sf):
    return materialise(H.log_ratios(H.horizon_rows(materialise(_series(spark, sf)).where("NOT in_library"), (6, 12, 24)), at_least=20))


@query("error_model", sql=with_ctes(*RATIOS, select="SELECT H, count(*) AS n, round(quantile_cont(e,.1),4) AS p10, round(median(e),4) AS p50, round(quantile_cont(e,.9),4) AS p90, round((SELECT icc FROM ic),4) AS icc FROM lk GROUP BY H"))
def error_model(spark, sf):
    """Log-ratio error classes of the hindcast and their intra-block correlation."""
    from ..operators.ranking import exact_percentiles
    r = _ratios(spark, sf)
    p = exact_percentiles(r, ["H"], "e", {"p10": .1, "p50": .5, "p90": .9})
    icc = icc_oneway(r.where("H = 24"), "e", "grp").select("icc").scalar()
    n = r.groupBy("H").agg(F.count(F.lit(1)).alias("n"))
    return n.join(p, "H").select("H", "n", rnd("p10").alias("p10"), rnd("p50").alias("p50"), rnd("p90").alias("p90"), rnd(icc).alias("icc"))


def _total(scope: str, rhos: str) -> str:
    return f"""SELECT {scope} AS scope, rho, count(DISTINCT entity_id) AS n_wells, i, sum(best*exp({lerp('u')})) AS t FROM su WHERE rho IN ({rhos}) GROUP BY ALL"""


@query("probabilistic_reserves", sql=with_ctes(PTS, best_ctes("pts", "pf", D.TERMINAL), "tn AS (SELECT entity_id, max(t)-min(t) AS t_now FROM pts GROUP BY 1)", "bt AS (SELECT * FROM pf JOIN tn USING (entity_id))",
       remaining_ctes("bt", "rm", "entity_id", str(Q_ECON), "f.t_now", ("arps",), keep=", n"), *RATIOS, """
er AS (SELECT H AS bucket, list(e ORDER BY e) AS sample, count(*) AS n FROM lk WHERE H IN (12, 24) GROUP BY 1)""", """
cw AS (SELECT entity_id, 'b'||(s_nationkey%5) AS grp, 'u'||s_nationkey AS unit, remaining AS best, CASE WHEN n >= 18 THEN 24 ELSE 12 END AS bucket FROM rm JOIN supplier ON s_suppkey=entity_id WHERE remaining > 0)""", """
rr AS (SELECT DISTINCT unnest([0.0::DOUBLE, 0.5, 1.0, CASE WHEN k >= 5 THEN round(icc,3) ELSE 0.5 END]) AS rho FROM ic)""", "rf AS (SELECT CASE WHEN k >= 5 THEN round(icc,3) ELSE 0.5 END AS rho FROM ic)", f"""
sm AS (SELECT c.*, sample, n, rho, i, {S.uniform("7", "'group'", "grp", "i")} AS ug, {S.uniform("7", "'entity'", "entity_id", "i")} AS ue FROM cw c JOIN er USING (bucket), rr, range(4000) r(i))""", f"""
sz AS (SELECT *, sqrt(rho)*{S.ppf('ug')} + sqrt(1-rho)*{S.ppf('ue')} AS z FROM sm)""", f"su AS (SELECT *, {S.cdf('z')} AS u FROM sz)", f"""
st AS ({_total("'all'", 'SELECT rho FROM rr')} UNION ALL {_total('unit', 'SELECT rho FROM rf')})""", f"""
ref AS (SELECT unit AS scope, sum(best*exp({lerp('0.10::DOUBLE')})) AS p, sum(best) AS b FROM cw JOIN er USING (bucket) GROUP BY 1 UNION ALL SELECT 'all', sum(best*exp({lerp('0.10::DOUBLE')})), sum(best) FROM cw JOIN er USING (bucket))""", select="""
SELECT scope, rho, any_value(n_wells) AS n_wells, round(quantile_cont(t,.1),1) AS p10, round(median(t),1) AS p50, round(quantile_cont(t,.9),1) AS p90, round(any_value(b),1) AS sum_best, round(any_value(p),1) AS sum_well_p10, round(quantile_cont(t,.1)-any_value(p),1) AS aggregation_gain FROM st JOIN ref USING (scope) GROUP BY scope, rho"""))
def probabilistic_reserves(spark, sf):
    """Copula totals of fitted suppliers with the hindcast's error classes: all of them for ρ from {0, .5, 1} and the estimated correlation, every unit for
    the reference ρ. With fewer than 5 groups the estimate counts for nothing and the reference is 0.5."""
    r = _ratios(spark, sf)
    sm = M.order_statistics(r.where("H IN (12, 24)").withColumnRenamed("H", "bucket"), "bucket", "e")
    p = D.pack(points(spark, sf), "entity_id").withColumn("fit", fit_udf(D.TERMINAL)("ts", "qs")).where("fit.converged")
    v = p.withColumn("best", remaining_struct(F.col("fit"), F.lit(Q_ECON), F.array_max("ts") - F.array_min("ts"))["remaining"])
    n = F.col("s_nationkey")
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("b"), (n % 5).cast("string")).alias("grp"), F.concat(F.lit("u"), n.cast("string")).alias("unit"))
    w = materialise(v.where("best > 0").join(g, "entity_id").select("entity_id", "grp", "unit", "best", F.when(F.col("fit.n") >= 18, 24).otherwise(12).alias("bucket")))
    icc = icc_oneway(r.where("H = 24"), "e", "grp").first()
    reference = round(icc["icc"], 3) if icc["n_groups"] >= 5 else 0.5
    total = M.aggregate_copula(w, sm, sorted({0.0, 0.5, 1.0, reference}), 4000, 7).withColumn("scope", F.lit("all"))
    units = M.aggregate_copula(w, sm, [reference], 4000, 7, scope=["unit"]).withColumnRenamed("unit", "scope")
    return total.unionByName(units).select("scope", "rho", "n_wells", *[rnd(x, 1).alias(x) for x in ("p10", "p50", "p90", "sum_best", "sum_well_p10", "aggregation_gain")])


# ------------------------------------------------------------------ rule engines
CLS = """cs AS (SELECT c_custkey AS entity_id, coalesce(n,0) AS prod_days, CASE WHEN c_custkey % 17 = 0 THEN 'planned' WHEN c_custkey % 13 = 0 THEN 'completed_not_producing' WHEN c_custkey % 5 = 0 THEN 'shut_in' WHEN c_custkey % 23 = 0 THEN '' ELSE 'producing' END AS status,
  coalesce(rate,0) > 80 AS economic, coalesce(rate,0) AS rate, c_acctbal > 2000 AS in_plan, c_acctbal > 5000 AS continuity FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderdate) AS n, avg(o_totalprice)/3000 AS rate FROM orders GROUP BY 1) ON o_custkey=c_custkey)"""
CAT = """cat AS (SELECT *, CASE WHEN prod_days > 0 AND status='producing' THEN CASE WHEN economic THEN 'PDP' ELSE 'NOT_PROVED' END WHEN prod_days > 0 AND status='shut_in' THEN 'PDNP' WHEN status='completed_not_producing' THEN 'PDNP'
  WHEN status='planned' OR prod_days=0 THEN CASE WHEN in_plan AND continuity THEN 'PUD' ELSE 'NOT_PROVED' END ELSE 'NOT_PROVED' END AS category,
  CASE WHEN prod_days > 0 AND status='producing' THEN false ELSE true END AS needs_human FROM cs)"""


def _cases(spark, sf):
    k = F.col("c_custkey")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderdate").alias("n"), (F.avg("o_totalprice") / 3000).alias("r"))
    st = F.when(k % 17 == 0, "planned").when(k % 13 == 0, "completed_not_producing").when(k % 5 == 0, "shut_in").when(k % 23 == 0, "").otherwise("producing")
    return table(spark, sf, "customer").join(o, "c_custkey", "left").select(
        k.alias("entity_id"), F.coalesce("n", F.lit(0)).alias("prod_days"), st.alias("status"), (F.coalesce("r", F.lit(0.0)) > 80).alias("economic"), F.coalesce("r", F.lit(0.0)).alias("rate"),
        (F.col("c_acctbal") > 2000).alias("in_plan"), (F.col("c_acctbal") > 5000).alias("continuity"))


@query("reserve_classes", sql=with_ctes(CLS, CAT, select="SELECT entity_id, category, needs_human FROM cat"))
def reserve_classes(spark, sf):
    return R.classify(_cases(spark, sf)).select("entity_id", "cls.category", "cls.needs_human")


@query("compliance_checklist", sql=with_ctes(CLS, CAT, """
it AS (SELECT entity_id, unnest(['production_evidence','economic','price_basis','current_methods','reasonable_certainty','category_basis','reliable_technology','traceability']) AS item, unnest([CASE WHEN prod_days>0 THEN 'pass' ELSE 'needs_human' END, CASE WHEN rate > 80 THEN 'pass' ELSE 'fail' END, 'pass', 'pass',
  CASE WHEN abs(0.78::DOUBLE-0.8)<=0.08 THEN 'pass' ELSE 'needs_human' END, CASE WHEN needs_human THEN 'needs_human' ELSE 'pass' END, 'needs_human', 'pass']) AS st FROM cat UNION ALL SELECT entity_id, 'five_year_plan', CASE WHEN in_plan THEN 'pass' ELSE 'needs_human' END FROM cat WHERE category='PUD')""", select="""
SELECT entity_id, count(*) AS n_items, count(*) FILTER (WHERE st='pass') AS n_pass, count(*) FILTER (WHERE st='fail') AS n_fail, count(*) FILTER (WHERE st='needs_human') AS n_needs_human FROM it GROUP BY 1"""))
def compliance_checklist(spark, sf):
    return R.checklist_summary(R.checklist(R.classify(_cases(spark, sf)), q_econ=F.lit(80.0), coverage=F.lit(0.78)))


@query("entity_screen", sql=with_ctes(CLS, CAT, select="SELECT entity_id, category, CASE WHEN category='NOT_PROVED' THEN 0.0 WHEN prod_days < 8 THEN NULL ELSE round(rate*10,8) END AS low_estimate FROM cat"))
def entity_screen(spark, sf):
    d = R.classify(_cases(spark, sf)).withColumn("remaining", F.when(F.col("prod_days") >= 8, F.col("rate") * 10))
    return R.screen(d, low="remaining").select("entity_id", F.col("cls.category").alias("category"), rnd("low_estimate", 8).alias("low_estimate"))


XC = ["""xc AS (SELECT c_custkey AS entity_id, s/1000 AS e50, s/1500 AS e10, s/700 AS e90, (c_acctbal+1100)*40 AS o50, (c_acctbal+1100)*25 AS o10, (c_acctbal+1100)*60 AS o90, 0.3::DOUBLE+0.1*(c_custkey%12) AS b, CASE WHEN c_custkey%4=0 THEN 0.0 ELSE 0.006 END AS dm FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey=c_custkey)""", """
xd AS (SELECT *, round(e50/o50*100,3) AS rf, e10/greatest(o90,1e-9)*100 > 8 OR e90/greatest(o10,1e-9)*100 < 1 AS disj, b > 1 AND dm <= 0 AS bad FROM xc)"""]


@query("cross_check", sql=with_ctes(XC, select="""
SELECT entity_id, rf AS rf_implied_pct, CASE WHEN disj THEN 'conflict' WHEN rf < 1 THEN 'low' WHEN rf > 8 THEN 'high' ELSE 'consistent' END AS consistency, disj OR bad AS needs_human,
 (1 + disj::INT + bad::INT)::INTEGER AS n_findings FROM xd"""))
def cross_check(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    k, a = F.col("c_custkey"), F.col("c_acctbal") + 1100
    d = table(spark, sf, "customer").join(o, "c_custkey").select(
        k.alias("entity_id"), (F.col("s") / 1000).alias("eur_p50"), (F.col("s") / 1500).alias("eur_p10"), (F.col("s") / 700).alias("eur_p90"), (a * 40).alias("ooip_p50"), (a * 25).alias("ooip_p10"), (a * 60).alias("ooip_p90"),
        (0.3 + 0.1 * (k % 12)).alias("b"), F.when(k % 4 == 0, 0.0).otherwise(0.006).alias("d_min"), F.lit(1.0).alias("low_pct"), F.lit(8.0).alias("high_pct"))
    x = R.cross_check(d)
    return x.select("entity_id", "rf_implied_pct", "consistency", "needs_human", F.size("findings").alias("n_findings"))


