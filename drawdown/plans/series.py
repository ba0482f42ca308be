"""Queries: label extraction and series shapes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, rnd
from ..operators import series as T
from ..operators.ranking import top_k
from ..sources.bind import daily, daily_users, monthly, table, well_events, wells
from . import sqlkit as S
from .registry import query, with_ctes


def user_events(spark, sf):
    """Purchases above 40 play the role of interventions on the user series."""
    first = daily_users(spark, sf).groupBy("entity_id").agg(F.min("dt").alias("_d0"))
    ev = table(spark, sf, "events").where("event_type = 'purchase' AND value > 40")
    return (ev.select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("dt")).distinct()
            .join(first, "entity_id")
            .select("entity_id", (F.datediff("dt", "_d0") + 1).cast("int").alias("event_day")))


UEV = """uev AS (SELECT DISTINCT e.user_id AS entity_id, CAST(date_diff('day', d0, CAST(ts AS DATE))+1 AS INTEGER) AS event_day
  FROM events e JOIN (SELECT entity_id, min(dt) AS d0 FROM users GROUP BY 1) f ON f.entity_id = e.user_id
  WHERE event_type='purchase' AND value > 40)"""

RUN = """run3 AS (SELECT entity_id, min(day_index) FILTER (WHERE m = 1 AND c = 3) AS t_break FROM (
  SELECT entity_id, day_index, min(CASE WHEN oil >= 20 THEN 1 ELSE 0 END) OVER w AS m, count(*) OVER w AS c
  FROM users WHERE hours_on > 0 WINDOW w AS (PARTITION BY entity_id ORDER BY day_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
  GROUP BY 1)"""


@query("first_run", sql=with_ctes(S.USERS, RUN, select="SELECT * FROM run3"))
def first_run(spark, sf):
    return T.first_run(daily_users(spark, sf), threshold=20.0, length=3)


def smooth_sql(src, half, name="sm"):
    return f"""{name} AS (SELECT entity_id, day_index, smooth FROM (
  SELECT s.entity_id, s.day_index, count(v) OVER w AS c, round(avg(v) OVER w, 9) AS smooth FROM
   (SELECT entity_id, CAST(unnest(range(min(day_index), max(day_index)+1)) AS INTEGER) AS day_index FROM {src} GROUP BY 1) s
   LEFT JOIN (SELECT entity_id, day_index, CASE WHEN hours_on > 0 THEN oil END AS v FROM {src}) d USING (entity_id, day_index)
   WINDOW w AS (PARTITION BY s.entity_id ORDER BY s.day_index RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING))
  WHERE c >= 3)"""


@query("smoothed_rate", sql=with_ctes(S.daily("group"), smooth_sql("daily", 3),
                                      select="SELECT entity_id, day_index, round(smooth, 6) AS smooth FROM sm"))
def smoothed_rate(spark, sf):
    return T.smoothed(daily(spark, sf, "group"), half=3).withColumn("smooth", F.round("smooth", 6))


PEAK = [smooth_sql("users", 2), """
cand AS (SELECT *, n1 >= 3 AND n2 >= 3 AND m1 < smooth*0.98 AND m2 < smooth*0.96 AS ok FROM (
  SELECT *, count(*) OVER (PARTITION BY entity_id ORDER BY day_index RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n1,
   avg(smooth) OVER (PARTITION BY entity_id ORDER BY day_index RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS m1,
   count(*) OVER (PARTITION BY entity_id ORDER BY day_index RANGE BETWEEN 6 FOLLOWING AND 10 FOLLOWING) AS n2,
   avg(smooth) OVER (PARTITION BY entity_id ORDER BY day_index RANGE BETWEEN 6 FOLLOWING AND 10 FOLLOWING) AS m2
  FROM sm) WHERE day_index >= 3)""", """
tagged AS (SELECT c.*, EXISTS (SELECT 1 FROM uev e WHERE e.entity_id = c.entity_id AND c.day_index BETWEEN e.event_day AND e.event_day+4) AS blocked FROM cand c)""", """
usable AS (SELECT * FROM (SELECT *, sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id) AS free FROM tagged) WHERE NOT blocked OR free = 0)""", """
tried AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY smooth DESC, day_index) AS rk FROM usable) WHERE rk <= 12)""", """
peaks AS (SELECT entity_id, coalesce(arg_min(day_index, rk) FILTER (WHERE ok), arg_min(day_index, rk)) AS t_peak,
  coalesce(arg_min(smooth, rk) FILTER (WHERE ok), arg_min(smooth, rk)) AS q_peak, coalesce(bool_or(ok), false) AS confirmed
  FROM tried GROUP BY 1)"""]


def user_peaks(spark, sf):
    d = daily_users(spark, sf)
    return T.peak(T.smoothed(d, half=2), user_events(spark, sf), ignore_days=3, block_days=4, confirm=2,
                  confirm_days=5, min_obs=3)


@query("peak_detection", sql=with_ctes(S.USERS, UEV, PEAK,
                                       select="SELECT entity_id, t_peak, round(q_peak, 6) AS q_peak, confirmed FROM peaks"))
def peak_detection(spark, sf):
    return user_peaks(spark, sf).withColumn("q_peak", F.round("q_peak", 6))


PAT = """pat AS (SELECT entity_id, coalesce(avg(whp) FILTER (WHERE abs(day_index-t_peak) <= 1), avg(whp)) AS p_peak
  FROM users JOIN peaks USING (entity_id) WHERE abs(day_index-t_peak) <= 3 GROUP BY 1)"""


@query("value_at_peak", sql=with_ctes(S.USERS, UEV, PEAK, PAT, select="SELECT entity_id, round(p_peak, 6) AS p_peak FROM pat"))
def value_at_peak(spark, sf):
    return T.value_at(daily_users(spark, sf), user_peaks(spark, sf)).withColumn("p_peak", F.round("p_peak", 6))


@query("cumulative_cut", sql=with_ctes(S.USERS, UEV, select="""
SELECT entity_id, round(sum(CASE WHEN day_index <= 10 THEN oil ELSE 0 END),4) AS cum_10,
 round(sum(CASE WHEN day_index < coalesce(f, 1000000) THEN oil END),4) AS cum_before_event
FROM users LEFT JOIN (SELECT entity_id, min(event_day) AS f FROM uev GROUP BY 1) USING (entity_id) GROUP BY 1"""))
def cumulative_cut(spark, sf):
    d = daily_users(spark, sf)
    a = T.cumulative_to(d, 10, out="cum_10")
    b = T.before_first_event(d, user_events(spark, sf)).groupBy("entity_id").agg(F.sum("oil").alias("cum_before_event"))
    return a.join(b, "entity_id", "left").select("entity_id", rnd("cum_10").alias("cum_10"),
                                                 rnd("cum_before_event").alias("cum_before_event"))


@query("monthly_rollup", sql=with_ctes(S.daily("part"), select=f"""
SELECT entity_id, {S.mi('dt')} AS mi, sum(oil) AS oil, round(sum(water),4) AS water,
 count(*) FILTER (WHERE hours_on > 0) AS days_on, count(*) AS days FROM daily GROUP BY ALL"""))
def monthly_rollup(spark, sf):
    return T.to_monthly(daily(spark, sf, "part", indexed=False)).withColumn("water", rnd("water"))


@query("binned_rate", sql=with_ctes(S.daily("supplier"), select="""
SELECT entity_id, CAST(floor((day_index-1)/30.4::DOUBLE) AS INTEGER) AS k, count(*) AS n_obs, round(avg(oil),6) AS rate,
 floor((day_index-1)/30.4::DOUBLE)+0.5 AS t FROM daily WHERE hours_on > 0 GROUP BY ALL HAVING count(*) >= 5"""))
def binned_rate(spark, sf):
    return T.binned_rate(daily(spark, sf, "supplier"), min_obs=5).withColumn("rate", F.round("rate", 6))


@query("display_curve", sql=with_ctes(S.daily("group"), select="""
SELECT entity_id, CAST(floor((day_index-1)/30)+1 AS INTEGER) AS period, round(avg(oil),5) AS oil_mean,
 round(avg(whp),5) AS whp_mean, round(avg(water),5) AS water_mean FROM daily WHERE hours_on > 0 GROUP BY ALL"""))
def display_curve(spark, sf):
    out = T.display_curve(daily(spark, sf, "group"))
    return out.select("entity_id", "period", *[rnd(x, 5).alias(x) for x in ("oil_mean", "whp_mean", "water_mean")])


PTIME = """ptime AS (SELECT entity_id, mi, oil, days_on, sum(CASE WHEN oil > 0 AND mi - prev - 1 >= 3 THEN mi-prev-1 ELSE 0 END)
   OVER (PARTITION BY entity_id ORDER BY mi)::BIGINT AS idle_months FROM (
  SELECT *, last_value(CASE WHEN oil > 0 THEN mi END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY mi
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM monthly))"""


@query("producing_time", sql=with_ctes(S.monthly("part"), PTIME,
                                       select="SELECT entity_id, mi, idle_months, mi - idle_months AS ptime FROM ptime"))
def producing_time(spark, sf):
    return T.producing_time(monthly(spark, sf, "part")).select("entity_id", "mi", "idle_months", "ptime")


@query("fit_rate_mask", sql=with_ctes(S.monthly("group"), select=f"""
SELECT entity_id, mi, round(CASE WHEN days_on >= .5*{S.dim('mi')} THEN oil/{S.dim('mi')} END, 6) AS fit_rate FROM monthly"""))
def fit_rate_mask(spark, sf):
    return T.fit_rate(monthly(spark, sf, "group")).select("entity_id", "mi", F.round("fit_rate", 6).alias("fit_rate"))


PUBLIC = ["""rep AS (SELECT DISTINCT """ + S.mi("o_orderdate") + """ AS mi FROM orders WHERE month(o_orderdate) <> 7)""", """
g AS (SELECT entity_id, mi, sum(oil) AS oil, sum(days) AS days FROM monthly WHERE oil > 0 GROUP BY ALL)""", """
k AS (SELECT *, oil/greatest(days,1) AS rate FROM (SELECT *, min(mi) OVER (PARTITION BY entity_id) AS st, count(*) FILTER (WHERE days>0) OVER (PARTITION BY entity_id) AS n_on FROM g)
  WHERE st > (SELECT min(mi) FROM rep) AND n_on >= 15)""", """
pk AS (SELECT entity_id, arg_max(mi, {'r': rate, 'm': -mi}) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY mi) AS rk FROM k WHERE days > 0) WHERE rk <= 4 GROUP BY 1)"""]


@query("public_series", sql=with_ctes(S.monthly("part"), PUBLIC, select="""
SELECT entity_id, mi-peak+0.5::DOUBLE AS t, round(rate,6) AS rate, oil AS volume, cum_before_peak, st AS start_month
FROM k JOIN pk USING (entity_id) JOIN (SELECT entity_id, sum(CASE WHEN mi < peak THEN oil ELSE 0 END) AS cum_before_peak FROM k JOIN pk USING (entity_id) GROUP BY 1) USING (entity_id)
WHERE mi >= peak AND days > 0 AND mi IN (SELECT mi FROM rep)"""))
def public_series(spark, sf):
    rep = table(spark, sf, "orders").where(F.month("o_orderdate") != 7).select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("mi")).distinct()
    return T.public_series(monthly(spark, sf, "part"), rep, min_producing=15).withColumn("rate", F.round("rate", 6))


@query("sampled_entities", sql=with_ctes(S.WELLS, select=f"""
SELECT entity_id, block FROM (SELECT entity_id, block, {S.uniform("20260916", "entity_id")} AS u FROM wells) ORDER BY u, entity_id LIMIT 300"""))
def sampled_entities(spark, sf):
    w = wells(spark, sf).select("entity_id", "block")
    return w.orderBy(hash_uniform(F.lit(20260916), "entity_id"), "entity_id").limit(300)


@query("production_timeline", sql=with_ctes(S.monthly("part"), S.WELLS, """
spine AS (SELECT unnest(range((SELECT min(mi) FROM monthly), (SELECT max(mi) FROM monthly)+1)) AS mi)""", select="""
SELECT s.mi, coalesce(t.oil,0.0) AS oil, coalesce(t.n,0) AS n_producing, coalesce(f.n,0) AS n_new,
  coalesce(sum(t.oil) OVER (ORDER BY s.mi), 0.0) AS cum_oil
FROM spine s LEFT JOIN (SELECT mi, sum(oil) AS oil, count(*) FILTER (WHERE days_on>0) AS n FROM monthly GROUP BY 1) t USING (mi)
LEFT JOIN (SELECT fmi AS mi, count(*) AS n FROM wells GROUP BY 1) f USING (mi)"""))
def production_timeline(spark, sf):
    from ..operators.stats import timeline
    return timeline(monthly(spark, sf, "part"), wells(spark, sf))


@query("recent_state", sql=with_ctes(S.daily("supplier"), select="""
SELECT entity_id, round(avg(oil),6) AS oil_now, round(avg(whp),6) AS whp_now, max(day_index) AS last_day, count(*) AS n_used FROM
 (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day_index DESC) AS rk FROM daily WHERE hours_on > 0) WHERE rk <= 14 GROUP BY 1"""))
def recent_state(spark, sf):
    return T.recent_state(daily(spark, sf, "supplier")).withColumn("oil_now", F.round("oil_now", 6)).withColumn(
        "whp_now", F.round("whp_now", 6))


@query("post_peak_guard", sql=with_ctes(S.USERS, UEV, PEAK, select="""
SELECT entity_id, max(t_peak) AS t_peak, max(CASE WHEN confirmed THEN 'ok' ELSE 'suspect' END) AS quality,
 count(*) FILTER (WHERE day_index >= t_peak AND hours_on>0 AND oil>0) AS n_points, (max(day_index)-max(t_peak))::BIGINT AS days_after_peak,
 CASE WHEN max(t_peak) IS NULL THEN 'no_label' WHEN count(*) FILTER (WHERE day_index >= t_peak AND hours_on>0 AND oil>0) < 10 THEN 'too_few_points'
  WHEN max(day_index)-max(t_peak) < 14 THEN 'too_short_after_peak' END AS reason,
 NOT (max(t_peak) IS NULL OR count(*) FILTER (WHERE day_index >= t_peak AND hours_on>0 AND oil>0) < 10 OR max(day_index)-max(t_peak) < 14) AS usable
FROM users LEFT JOIN peaks USING (entity_id) GROUP BY 1"""))
def post_peak_guard(spark, sf):
    lab = user_peaks(spark, sf).withColumn("quality", F.when(F.col("confirmed"), "ok").otherwise("suspect"))
    return T.post_peak_guard(daily_users(spark, sf), lab, min_points=10, min_days=14)


@query("event_window_anti", sql=with_ctes(S.monthly("supplier"), S.EVENTS, f"""
em AS (SELECT DISTINCT entity_id, {S.mi('dt')} AS e FROM wevents WHERE event_type = 'P')""", """
tg AS (SELECT m.*, EXISTS (SELECT 1 FROM em WHERE em.entity_id=m.entity_id AND mi BETWEEN e AND e+2) AS b FROM monthly m)""",
       select="""SELECT entity_id, count(*) AS n_months, sum(oil) AS oil FROM (
 SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id) AS f FROM tg) WHERE NOT b OR f = 0 GROUP BY 1"""))
def event_window_anti(spark, sf):
    from ..functions.columns import month_index
    ev = well_events(spark, sf).where("event_type = 'P'").select("entity_id", month_index("dt").alias("event_day")).distinct()
    left = T.outside_event_windows(monthly(spark, sf, "supplier"), ev, day="mi", block_days=2)
    return left.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_months"), F.sum("oil").alias("oil"))


@query("change_evidence", sql=with_ctes(S.monthly("part"), S.WELLS, """
w AS (SELECT entity_id, sum(oil) FILTER (WHERE mi BETWEEN 23950 AND 23952) AS oo, sum(water) FILTER (WHERE mi BETWEEN 23950 AND 23952) AS wo,
  sum(oil) FILTER (WHERE mi BETWEEN 23962 AND 23964) AS oc, sum(water) FILTER (WHERE mi BETWEEN 23962 AND 23964) AS wc FROM monthly GROUP BY 1)""", f"""
e AS (SELECT entity_id, unit_id, oo/({'+'.join(S.dim(str(i)) for i in (23950, 23951, 23952))}) AS ro,
  oc/({'+'.join(S.dim(str(i)) for i in (23962, 23963, 23964))}) AS rc, wo/nullif(wo+oo/0.85,0)*100 AS a, wc/nullif(wc+oc/0.85,0)*100 AS b
  FROM w JOIN wells USING (entity_id) WHERE oo > 0 AND oc IS NOT NULL)""", select="""
SELECT unit_id, entity_id, rk, round(ro,6) AS rate_open, round(rc,6) AS rate_close, round(rc-ro,6) AS rate_change,
 round(a,4) AS wc_open, round(b,4) AS wc_close FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY round(rc-ro,9), entity_id) AS rk FROM e) WHERE rk <= 3"""))
def change_evidence(spark, sf):
    e = T.change_evidence(monthly(spark, sf, "part"), 23952, 23964).join(
        wells(spark, sf).select("entity_id", "unit_id"), "entity_id")
    r = top_k(e, ["unit_id"], [F.round("rate_change", 9), "entity_id"], 3)
    return r.select("unit_id", "entity_id", "rk", *[F.round(x, 6).alias(x) for x in ("rate_open", "rate_close", "rate_change")],
                    rnd("wc_open").alias("wc_open"), rnd("wc_close").alias("wc_close"))
