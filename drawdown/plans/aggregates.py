"""Queries: aggregations, statistics, analytic windows, set operations, ordering, scalar functions."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.columns import days_in_month, hash_uniform, month_index, rnd
from ..operators import stats as A
from ..operators.ranking import exact_percentiles, top_k
from ..sources.bind import calendar_rate, daily, daily_users, monthly, table, well_events, wells
from . import sqlkit as S
from .registry import query, with_ctes


@query("entity_totals", sql=with_ctes(S.daily("supplier"), select="""
SELECT entity_id, sum(oil) AS cum_oil, max(day_index) AS history_days, count(*) AS n_days FROM daily GROUP BY 1"""))
def entity_totals(spark, sf):
    return daily(spark, sf, "supplier").groupBy("entity_id").agg(
        F.sum("oil").alias("cum_oil"), F.max("day_index").alias("history_days"), F.count(F.lit(1)).alias("n_days"))


@query("hierarchy_rollup", sql=with_ctes(S.monthly("part"), S.WELLS, """
u AS (SELECT block, layer, sum(oil) AS oil, sum(water) AS water, count(DISTINCT entity_id) AS n FROM monthly JOIN wells USING (entity_id) GROUP BY ALL)""",
       select="""SELECT block, layer, CAST(2 - grouping(block) - grouping(layer) AS INTEGER) AS depth, sum(oil) AS oil, round(sum(water),2) AS water,
  sum(n)::BIGINT AS n_entities, round(sum(water)/sum(oil), 6) AS wor FROM u GROUP BY ROLLUP(block, layer)"""))
def hierarchy_rollup(spark, sf):
    per = monthly(spark, sf, "part").groupBy("entity_id").agg(F.sum("oil").alias("oil"), F.sum("water").alias("water"))
    u = per.join(wells(spark, sf), "entity_id").groupBy("block", "layer").agg(
        F.sum("oil").alias("oil"), F.sum("water").alias("water"), F.count(F.lit(1)).alias("n_entities"))
    r = A.hierarchy_rollup(u, ["block", "layer"], ["oil", "water", "n_entities"], {"wor": ("water", "oil")})
    return r.withColumn("water", rnd("water", 2)).withColumn("wor", rnd("wor", 6))


@query("overview", sql=with_ctes(S.WELLS, """d AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS dt FROM lineitem GROUP BY ALL)""", select="""
SELECT (SELECT count(*) FROM wells) AS n_entities, (SELECT count(*) FROM d) AS n_daily_rows,
 (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT block AS b FROM wells)) AS blocks,
 (SELECT max(dt) FROM d) AS last_date, (SELECT count(*) FROM wells WHERE size >= 25) AS n_labelled"""))
def overview(spark, sf):
    w = wells(spark, sf)
    a = w.agg(F.count(F.lit(1)).alias("n_entities"), F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"),
              F.sum((F.col("size") >= 25).cast("long")).alias("n_labelled"))
    d = daily(spark, sf, "part", indexed=False)
    return a.withColumn("n_daily_rows", d.agg(F.count(F.lit(1))).scalar()).withColumn(
        "last_date", table(spark, sf, "lineitem").agg(F.to_date(F.max("l_shipdate"))).scalar())


@query("unit_catalogue", sql=with_ctes(S.WELLS, select="""
SELECT block AS plant, sum(n)::BIGINT AS n_entities, count(*) AS n_units, string_agg(layer || ':' || n, ',' ORDER BY layer) AS units
FROM (SELECT block, layer, count(*) AS n FROM wells GROUP BY ALL) GROUP BY 1"""))
def unit_catalogue(spark, sf):
    u = wells(spark, sf).groupBy("block", "layer").agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("layer", "n"))),
                         lambda s: F.concat(s["layer"], F.lit(":"), s["n"].cast("string")))
    return u.groupBy(F.col("block").alias("plant")).agg(
        F.sum("n").alias("n_entities"), F.count(F.lit(1)).alias("n_units"), F.array_join(listed, ",").alias("units"))


@query("status_counts", sql="""
SELECT o_orderpriority AS priority, max(n) FILTER (WHERE o_orderstatus='F') AS n_f, max(n) FILTER (WHERE o_orderstatus='O') AS n_o,
 max(n) FILTER (WHERE o_orderstatus='P') AS n_p FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def status_counts(spark, sf):
    m = A.status_map(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus")
    return m.select(F.col("o_orderpriority").alias("priority"), *[
        F.try_element_at("counts", F.lit(k)).alias(f"n_{k.lower()}") for k in "FOP"])


@query("group_percentiles", sql="""
SELECT l_returnflag AS grp, round(quantile_cont(l_extendedprice,.1),4) AS p10, round(quantile_cont(l_extendedprice,.5),4) AS p50,
 round(quantile_cont(l_extendedprice,.9),4) AS p90, round(quantile_cont(l_extendedprice,.75)-quantile_cont(l_extendedprice,.25),4) AS iqr FROM lineitem GROUP BY 1""")
def group_percentiles(spark, sf):
    p = exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
                          {"p10": .1, "p50": .5, "p90": .9, "q1": .25, "q3": .75})
    return p.select(F.col("l_returnflag").alias("grp"), rnd("p10").alias("p10"), rnd("p50").alias("p50"),
                    rnd("p90").alias("p90"), rnd(F.col("q3") - F.col("q1")).alias("iqr"))


@query("robust_scale", sql="""
WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1)
SELECT event_type, round(any_value(med),4) AS median, round(greatest(1.4826*median(abs(value-med)), 0.12),4) AS robust_sd
FROM events JOIN m USING (event_type) GROUP BY 1""")
def robust_scale(spark, sf):
    r = A.robust_scale(table(spark, sf, "events"), ["event_type"], "value", 0.12)
    return r.select("event_type", rnd("median").alias("median"), rnd("robust_sd").alias("robust_sd"))


@query("intraclass_correlation", sql=with_ctes(S.WELLS, S.monthly("part"), """
v AS (SELECT block, ln(sum(oil)) AS v FROM monthly JOIN wells USING (entity_id) GROUP BY entity_id, block)""", """
g AS (SELECT block, count(*) AS n, avg(v) AS m, var_pop(v) AS vp FROM v GROUP BY 1)""", """
t AS (SELECT count(*) AS k, sum(n) AS n, sum(n*(m-(SELECT avg(v) FROM v))**2)/(count(*)-1) AS msb, sum(n*vp)/(sum(n)-count(*)) AS msw FROM g)""",
       select="SELECT k AS n_groups, n::BIGINT AS n, round(greatest(0.0::DOUBLE,(msb-msw)/(msb+(n/k-1)*msw)),6) AS icc FROM t"))
def intraclass_correlation(spark, sf):
    v = monthly(spark, sf, "part").groupBy("entity_id").agg(F.ln(F.sum("oil")).alias("v")).join(
        wells(spark, sf).select("entity_id", "block"), "entity_id")
    return A.icc_oneway(v, "v", "block").withColumn("icc", rnd("icc", 6))


# quantile predictions of two families and the held-out actual, per entity and target
def _tri(cond, name):
    return ", ".join(f"quantile_cont(v, {q}) FILTER (WHERE {cond}) AS {name}{p}" for p, q in (("p10", .1), ("p50", .5), ("p90", .9)))


QT = ["""mv AS (SELECT entity_id, mi, 'oil' AS target, oil AS v FROM monthly UNION ALL SELECT entity_id, mi, 'water', water FROM monthly)""",
      f"""qt AS (SELECT * FROM (SELECT entity_id, target, {_tri('mi < 23964', 'a_')}, {_tri('mi >= 23964 AND mi < 23988', 'b_')},
  avg(v) FILTER (WHERE mi >= 23988) AS y, {S.uniform('11', 'entity_id')} AS u FROM mv GROUP BY 1, 2)
  WHERE a_p50 IS NOT NULL AND b_p50 IS NOT NULL AND y IS NOT NULL)"""]


def quantile_table(spark, sf):
    """Percentile triples of monthly totals before 1997 (family a), in 1997-98 (family b), mean after (actual)."""
    m = monthly(spark, sf, "part").select("entity_id", "mi", F.expr("stack(2, 'oil', oil, 'water', water) as (target, v)"))
    def tri(cond, name):
        p = F.percentile(F.when(cond, F.col("v")), F.array(F.lit(.1), F.lit(.5), F.lit(.9)))
        return [F.get(p, i).alias(f"{name}{q}") for i, q in enumerate(("p10", "p50", "p90"))]
    t = m.groupBy("entity_id", "target").agg(
        *tri(F.col("mi") < 23964, "a_"), *tri((F.col("mi") >= 23964) & (F.col("mi") < 23988), "b_"),
        F.avg(F.when(F.col("mi") >= 23988, F.col("v"))).alias("y"))
    return t.where("a_p50 IS NOT NULL AND b_p50 IS NOT NULL AND y IS NOT NULL").withColumn("u", hash_uniform(F.lit(11), "entity_id"))


@query("model_metrics", sql=with_ctes(S.monthly("part"), QT, select="""
SELECT target, count(*) AS n, round(avg(abs(a_p50-y)),4) AS mae, round(median(abs(a_p50-y)),4) AS medae,
 round(avg(abs(a_p50-y)/greatest(abs(y),1e-6))*100,4) AS mape, round(avg(CASE WHEN y BETWEEN a_p10 AND a_p90 THEN 1.0::DOUBLE ELSE 0 END),6) AS coverage,
 round(avg(a_p90-a_p10),4) AS width FROM qt GROUP BY 1"""))
def model_metrics(spark, sf):
    m = A.model_metrics(quantile_table(spark, sf), ["target"], p10="a_p10", p50="a_p50", p90="a_p90")
    return m.select("target", "n", *[rnd(x).alias(x) for x in ("mae", "medae", "mape", "width")], rnd("coverage", 6).alias("coverage"))


@query("error_summary", sql=with_ctes(S.monthly("part"), QT, select="""
SELECT target, count(*) AS n, round(median(abs(e))*100,1) AS mdape_pct, round(median(e)*100,1) AS bias_pct,
 round(avg(CASE WHEN e > .2 THEN 1.0::DOUBLE ELSE 0 END)*100,1) AS over20_pct, round(quantile_cont(e,.9)*100,1) AS p90_pct
 FROM (SELECT target, a_p50/y-1 AS e FROM qt WHERE y > 0) GROUP BY 1"""))
def error_summary(spark, sf):
    q = quantile_table(spark, sf).where("y > 0").withColumn("e", F.col("a_p50") / F.col("y") - 1)
    return A.error_summary(q, ["target"], "e")


@query("recovery_reference", sql=with_ctes(S.WELLS, S.monthly("part"), """
e AS (SELECT layer, sum(oil) AS eur, any_value(x*y/4) AS ooip FROM monthly JOIN wells USING (entity_id) GROUP BY entity_id, layer)""", select="""
SELECT layer, count(*) AS n, CASE WHEN count(*) < 70 THEN 'default' ELSE 'observed' END AS source,
 CASE WHEN count(*) < 70 THEN 1.0 ELSE round(quantile_cont(eur/ooip*100,.1),2) END AS low_pct,
 CASE WHEN count(*) < 70 THEN 3.0 ELSE round(quantile_cont(eur/ooip*100,.5),2) END AS mid_pct,
 CASE WHEN count(*) < 70 THEN 8.0 ELSE round(quantile_cont(eur/ooip*100,.9),2) END AS high_pct FROM e GROUP BY 1"""))
def recovery_reference(spark, sf):
    e = monthly(spark, sf, "part").groupBy("entity_id").agg(F.sum("oil").alias("eur")).join(
        wells(spark, sf).select("entity_id", "layer", (F.col("x") * F.col("y") / 4).alias("ooip")), "entity_id")
    return A.recovery_reference(e, "layer", at_least=70)


@query("set_algebra", sql="""
WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate < DATE '1995-02-01'),
 b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= DATE '2001-10-01')
SELECT 'both' AS part, count(*) AS n, min(k) AS first_key FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'only_first', count(*), min(k) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'only_last', count(*), min(k) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
UNION ALL SELECT 'either', count(*), min(k) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_algebra(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), "l_shipdate")
    a = li.where("l_shipdate < DATE '1995-02-01'").select("k").distinct()
    b = li.where("l_shipdate >= DATE '2001-10-01'").select("k").distinct()
    def row(name, d):
        return d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"))
    return (row("both", a.intersect(b)).unionByName(row("only_first", a.join(b, "k", "left_anti")))
            .unionByName(row("only_last", b.subtract(a))).unionByName(row("either", a.unionByName(b).distinct())))


@query("case_metrics", sql="""
WITH r AS (SELECT event_type AS category, event_type <> 'error' AS ok, CASE WHEN value > 5 THEN value < 50 END AS cheap, value AS latency FROM events),
 l AS (SELECT category, 'ok' AS metric, ok::INT::DOUBLE AS hit FROM r UNION ALL SELECT category, 'cheap', cheap::INT::DOUBLE FROM r),
 m AS (SELECT coalesce(category,'all') AS category, metric, avg(hit) AS value, count(*) AS n FROM l WHERE hit IS NOT NULL GROUP BY GROUPING SETS ((category, metric),(metric))
  UNION ALL SELECT 'all', 'latency_p50', median(latency), count(*) FROM r
  UNION ALL SELECT 'all', 'latency_p95', list_sort(list(latency))[1+CAST(floor(.95*(count(*)-1)) AS BIGINT)], count(*) FROM r)
SELECT category, metric, round(value,6) AS value, n, target, CASE WHEN target IS NULL THEN NULL WHEN metric LIKE 'latency%' THEN value <= target ELSE value >= target END AS passed
FROM m LEFT JOIN (VALUES ('ok', 0.8::DOUBLE), ('latency_p95', 60.0::DOUBLE)) t(metric, target) USING (metric)""")
def case_metrics(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_type").alias("category"), (F.col("event_type") != "error").alias("ok"),
                                          F.when(F.col("value") > 5, F.col("value") < 50).alias("cheap"), F.col("value").alias("latency"))
    goals = spark.createDataFrame([("ok", 0.8, "min"), ("latency_p95", 60.0, "max")], "metric string, target double, direction string")
    return A.case_metrics(r, goals, ["ok", "cheap"], "latency", "category").withColumn("value", rnd("value", 6))


@query("split_comparison", sql=with_ctes(S.monthly("part"), QT, S.WELLS, """
s AS (SELECT target, abs(a_p50-y) AS e, row_number() OVER (PARTITION BY target ORDER BY first_prod, entity_id) > 0.75*count(*) OVER (PARTITION BY target) AS late, u > 0.75 AS rnd
  FROM qt JOIN (SELECT entity_id, first_prod FROM wells) USING (entity_id))""", select="""
SELECT target, round(avg(e) FILTER (WHERE late),4) AS mae_time, round(avg(e) FILTER (WHERE rnd),4) AS mae_random,
 round(100*(1-avg(e) FILTER (WHERE rnd)/avg(e) FILTER (WHERE late)),4) AS optimism_pct FROM s GROUP BY 1"""))
def split_comparison(spark, sf):
    from ..operators.ranking import dated_row_number
    q = quantile_table(spark, sf).join(wells(spark, sf).select("entity_id", "first_prod"), "entity_id")
    r = dated_row_number(q, ["target"], "first_prod", "entity_id").withColumn("e", F.abs(F.col("a_p50") - F.col("y")))
    g = r.groupBy("target").agg(F.avg(F.when(F.col("rn") > 0.75 * F.col("n_total"), F.col("e"))).alias("t"),
                                F.avg(F.when(F.col("u") > 0.75, F.col("e"))).alias("r"))
    return g.select("target", rnd("t").alias("mae_time"), rnd("r").alias("mae_random"),
                    rnd(100 * (1 - F.col("r") / F.col("t"))).alias("optimism_pct"))


# ------------------------------------------------------------------ windows
@query("latest_records", sql=with_ctes(S.USERS, select="""
SELECT entity_id, dt, oil, rk FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day_index DESC) AS rk FROM users) WHERE rk <= 14"""))
def latest_records(spark, sf):
    return top_k(daily_users(spark, sf), ["entity_id"], F.desc("day_index"), 14).select("entity_id", "dt", "oil", "rk")


@query("running_cumulative", sql=with_ctes(S.monthly("supplier"), select="""
SELECT entity_id, mi, sum(oil) OVER (PARTITION BY entity_id ORDER BY mi) AS cum_oil FROM monthly"""))
def running_cumulative(spark, sf):
    return A.running_total(monthly(spark, sf, "supplier"), entity="entity_id", order="mi", value="oil", out="cum_oil").select(
        "entity_id", "mi", "cum_oil")


LOGLOG = """ll AS (SELECT entity_id, mi, k, ln(k) AS lx, ln(oil) AS ly FROM (SELECT *, (mi - min(mi) OVER (PARTITION BY entity_id) + 1)::DOUBLE AS k FROM monthly) WHERE oil > 0)"""
SLOPES = """sl AS (SELECT entity_id, mi, k, CASE WHEN count(*) OVER w >= 3 THEN regr_slope(ly, lx) OVER w END AS slope FROM ll
  WINDOW w AS (PARTITION BY entity_id ORDER BY mi ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def _slopes(spark, sf):
    m = monthly(spark, sf, "supplier").where("oil > 0")
    k = (F.col("mi") - F.min("mi").over(Window.partitionBy("entity_id")) + 1).cast("double")
    return A.rolling_slope(m.withColumn("k", k), entity="entity_id", order="mi", x=F.ln("k"), y=F.ln("oil"), half=2)


@query("rolling_slope", sql=with_ctes(S.monthly("supplier"), LOGLOG, SLOPES,
                                      select="SELECT entity_id, mi, round(slope, 5) AS slope FROM sl"))
def rolling_slope(spark, sf):
    return _slopes(spark, sf).select("entity_id", "mi", rnd("slope", 5).alias("slope"))


@query("steep_onset", sql=with_ctes(S.monthly("supplier"), LOGLOG, SLOPES, select="""
SELECT entity_id, min(k) FILTER (WHERE a AND coalesce(b, true) AND coalesce(c, true)) AS t_elf FROM (
 SELECT entity_id, k, coalesce(slope,0) < -0.85 AS a, lead(coalesce(slope,0) < -0.85) OVER w AS b, lead(coalesce(slope,0) < -0.85, 2) OVER w AS c
 FROM sl WINDOW w AS (PARTITION BY entity_id ORDER BY mi)) GROUP BY 1"""))
def steep_onset(spark, sf):
    return A.steep_onset(_slopes(spark, sf), entity="entity_id", order="mi", at="k")


@query("gap_fill", sql=with_ctes(S.daily("group"), select="""
SELECT entity_id, day_index, coalesce(last_value(whp IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY day_index),
  first_value(whp IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY day_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS whp_filled FROM daily"""))
def gap_fill(spark, sf):
    return A.fill_gaps(daily(spark, sf, "group"), entity="entity_id", order="day_index", value="whp", out="whp_filled").select(
        "entity_id", "day_index", "whp_filled")


@query("top_entities", sql=with_ctes(S.WELLS, S.monthly("part"), select="""
SELECT unit_id, entity_id, cum, rk FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY cum DESC, entity_id) AS rk FROM
 (SELECT entity_id, sum(oil) AS cum FROM monthly GROUP BY 1) JOIN wells USING (entity_id)) WHERE rk <= 3"""))
def top_entities(spark, sf):
    cum = monthly(spark, sf, "part").groupBy("entity_id").agg(F.sum("oil").alias("cum"))
    return top_k(cum.join(wells(spark, sf).select("entity_id", "unit_id"), "entity_id"), ["unit_id"],
                 [F.desc("cum"), "entity_id"], 3).select("unit_id", "entity_id", "cum", "rk")


@query("cumulative_events", sql=with_ctes(S.EVENTS, select=f"""
SELECT mi, sum(n)::BIGINT AS n_events, (sum(sum(n)) OVER (ORDER BY mi))::BIGINT AS n_cum FROM (SELECT {S.mi('dt')} AS mi, count(*) AS n FROM wevents GROUP BY 1) GROUP BY mi"""))
def cumulative_events(spark, sf):
    g = well_events(spark, sf).groupBy(month_index("dt").alias("mi")).agg(F.count(F.lit(1)).alias("n_events"))
    w = Window.partitionBy(F.lit(0)).orderBy("mi")  # one row per month
    return g.withColumn("n_cum", F.sum("n_events").over(w))


@query("first_crossing", sql=with_ctes(S.monthly("supplier"), select=f"""
SELECT entity_id, round(sum(rate)*30.4,4) AS volume, count(*) AS n_alive FROM (SELECT *, min(CASE WHEN rate >= 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY mi) AS alive
 FROM (SELECT *, oil/{S.dim('mi')} AS rate FROM monthly)) WHERE alive = 1 GROUP BY 1"""))
def first_crossing(spark, sf):
    r = A.first_crossing(calendar_rate(monthly(spark, sf, "supplier")), keys=["entity_id"], order="mi", rate="rate", limit=F.lit(2.0))
    return r.where("alive").groupBy("entity_id").agg(rnd(F.sum("rate") * 30.4).alias("volume"), F.count(F.lit(1)).alias("n_alive"))


@query("period_chain", sql=with_ctes(S.WELLS, """
y AS (SELECT unit_id, CAST(year(l_shipdate) AS BIGINT) AS yr, sum(l_extendedprice)/10000 AS prod FROM lineitem JOIN wells ON entity_id = l_partkey GROUP BY ALL)""",
       select="""SELECT unit_id, yr, row_number() OVER w > 1 AS carried,
  round(50000.0 - 0.5*coalesce(sum(prod) OVER (PARTITION BY unit_id ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 8) AS opening_used,
  round(50000.0 - 0.5*sum(prod) OVER (PARTITION BY unit_id ORDER BY yr), 8) AS closing FROM y WINDOW w AS (PARTITION BY unit_id ORDER BY yr)"""))
def period_chain(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.year("l_shipdate").cast("long").alias("yr"), "l_extendedprice")
    y = li.groupBy("entity_id", "yr").agg(F.sum("l_extendedprice").alias("v")).join(wells(spark, sf).select("entity_id", "unit_id"), "entity_id")
    y = y.groupBy("unit_id", "yr").agg((F.sum("v") / 10000).alias("prod"))
    first = F.row_number().over(Window.partitionBy("unit_id").orderBy("yr")) == 1
    y = y.withColumn("opening", F.when(first, 50000.0))
    done = A.period_chain(y, unit="unit_id", period="yr", opening="opening", step=lambda o, r: o - r["prod"] * 0.5)
    return done.select("unit_id", "yr", "carried", rnd("opening_used", 8).alias("opening_used"), rnd("closing", 8).alias("closing"))


# ------------------------------------------------------------------ joins, ordering, scalar functions
@query("filled_join", sql=with_ctes(S.monthly("supplier"), S.EVENTS, f"""
n AS (SELECT entity_id, {S.mi('dt')} AS mi, count(*) AS n_events FROM wevents GROUP BY ALL)""",
       select="SELECT entity_id, mi, oil, coalesce(n_events, 0) AS n_events FROM monthly LEFT JOIN n USING (entity_id, mi)"))
def filled_join(spark, sf):
    n = well_events(spark, sf).groupBy("entity_id", month_index("dt").alias("mi")).agg(F.count(F.lit(1)).alias("n_events"))
    return monthly(spark, sf, "supplier").join(n, ["entity_id", "mi"], "left").na.fill(0, ["n_events"]).select(
        "entity_id", "mi", "oil", "n_events")


@query("semi_anti", sql="""
SELECT 'kept' AS side, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT')
UNION ALL SELECT 'dropped', count(*), sum(l_quantity) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT')""")
def semi_anti(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    u = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    def side(name, how):
        return li.join(u, "o_orderkey", how).agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return side("kept", "left_semi").unionByName(side("dropped", "left_anti"))


@query("status_ordering", sql="""
SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus='P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 40""")
def status_ordering(spark, sf):
    order = F.array_position(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), F.col("o_orderpriority"))
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return (table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
            .orderBy(F.when(order == 0, 99).otherwise(order), price.desc_nulls_last(), "o_orderkey").limit(40))


@query("scalar_functions", sql="""
SELECT p_partkey, substr(upper(p_name),1,3) AS head, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no, replace(lower(p_type),'o','0') AS leet,
 string_split(p_name,' ')[2] AS second_word, round(ln(1+p_size),6) AS log_size, round(exp(-p_size/50.0),6) AS decay, round(sqrt(p_size*p_size+p_retailprice*p_retailprice),4) AS hyp,
 round(tanh(p_size/25.0),6) AS squash, least(greatest(p_size,10),40) AS clipped, round(p_retailprice*0.1364,4) AS bbl_to_t,
 coalesce(map {'SMALL': 450.0::DOUBLE, 'LARGE': 200.0::DOUBLE}[p_type], 400.0) AS capex, 'ND-' || substr(sha1(CAST(p_partkey AS VARCHAR)),1,8) AS anon, substr(sha256(p_name),1,12) AS digest FROM part""")
def scalar_functions(spark, sf):
    capex = F.create_map(F.lit("SMALL"), F.lit(450.0), F.lit("LARGE"), F.lit(200.0))
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", F.substring(F.upper("p_name"), 1, 3).alias("head"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand_no"),
        F.regexp_replace(F.lower("p_type"), "o", "0").alias("leet"), F.get(F.split("p_name", " "), 1).alias("second_word"),
        rnd(F.log1p("p_size"), 6).alias("log_size"), rnd(F.exp(-F.col("p_size") / 50.0), 6).alias("decay"),
        rnd(F.hypot("p_size", "p_retailprice")).alias("hyp"), rnd(F.tanh(F.col("p_size") / 25.0), 6).alias("squash"),
        F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clipped"), rnd(F.col("p_retailprice") * 0.1364).alias("bbl_to_t"),
        F.coalesce(F.try_element_at(capex, F.col("p_type")), F.lit(400.0)).alias("capex"),
        F.concat(F.lit("ND-"), F.substring(F.sha1(key.cast("binary")), 1, 8)).alias("anon"),
        F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 12).alias("digest"))


@query("array_functions", sql=with_ctes(S.monthly("supplier"), """
a AS (SELECT entity_id, list(oil ORDER BY mi) AS v FROM monthly GROUP BY 1)""", select="""
SELECT entity_id, list_sum(v[1:12]) AS first_year, list_max(v) AS peak, CAST(list_position(v, list_max(v)) AS BIGINT) AS peak_pos,
 round(list_dot_product(v[1:6], v[7:12]),4) AS dot, len(v) AS n FROM a"""))
def array_functions(spark, sf):
    a = monthly(spark, sf, "supplier").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("mi", "oil"))).alias("s")).select(
        "entity_id", F.col("s.oil").alias("v"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda p, q: p + q)
    dot = total(F.zip_with(F.slice("v", 1, 6), F.slice("v", 7, 6), lambda p, q: p * q))
    return a.select("entity_id", total(F.slice("v", 1, 12)).alias("first_year"), F.array_max("v").alias("peak"),
                    F.array_position("v", F.array_max("v")).alias("peak_pos"), rnd(dot).alias("dot"), F.size("v").alias("n"))


@query("json_fields", sql="""
SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props,'$.k') AS BIGINT))::BIGINT AS sum_k, min(props) AS canonical FROM events GROUP BY 1""")
def json_fields(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "struct<k:bigint>"))
    canon = F.regexp_replace(F.to_json("p"), ":", ": ")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("sum_k"), F.min(canon).alias("canonical"))
