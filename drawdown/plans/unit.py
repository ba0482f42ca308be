"""Queries: unit evaluation on the customer series."""
from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import rnd
from ..operators import economics as E, stats as A, unit as U
from ..operators.ranking import top_k
from ..operators.spatial import radius_count
from ..session import materialise
from ..sources.bind import account_events, account_monthly, accounts, locations, table
from . import sqlkit as S
from .registry import query, with_ctes
from .unitsql import BASE, LOC, evaluation

OPEN, CLOSE = 23947, 23959  # 1995-08 and 1996-08: most customers start within the first year
CFG = U.Config(period=12, idle=3, min_fit=6, open_share=0.0, curve_history=12, curve_wells=5, dynamic_months=6, min_pre=6, min_post=2,
               min_days_on=1, pud_radius=400.0)
CFG_OPEN = replace(CFG, period=6, curve_history=6)
RADIUS, MIN_OLD = 250.0, 3


def cfg_of(as_of: int) -> U.Config:
    return CFG_OPEN if as_of == OPEN else CFG


SEC26 = [("sec", "deck_2026_12", "sec")]
ALL26 = SEC26 + [("assessment", "deck_2026_12", "assessment"), ("impairment", "deck_2026_12", "impairment")]
SEC25 = [("sec", "deck_2025_12", "sec")]
CLOSE_ECON = SEC26 + [("opening_price", "deck_2025_12", "sec")]


def limits(spark, acc: DataFrame) -> DataFrame:
    decks = spark.createDataFrame(E.DECKS, E.DECK_SCHEMA)
    scen = spark.createDataFrame(E.SCENARIOS, E.SCENARIO_SCHEMA)
    lim = E.economic_limits(acc.select("unit_id", "opex_factor").distinct(), E.scenario_prices(decks, scen))
    return lim.withColumn("restart_min", E.RESTART_COST * 1e4 / E.FX / F.greatest("net_t", F.lit(1e-9)))


def labelled(lim: DataFrame, rows) -> DataFrame:
    parts = [lim.where((F.col("deck") == dk) & (F.col("scenario") == sc)).withColumn("scenario", F.lit(lab)) for lab, dk, sc in rows]
    return reduce(DataFrame.unionByName, parts).select("unit_id", "scenario", "price", "net_t", "opex_month", "q_econ", "restart_min")


def fresh(acc: DataFrame, as_of: int) -> DataFrame:
    start = as_of - cfg_of(as_of).period + 1
    new = acc.where(F.col("fmi").between(start, as_of))
    c = radius_count(new.select("entity_id", "x", "y"), acc.where(F.col("fmi") < start), RADIUS, split=None, out="n_old").select("entity_id", "n_old")
    return new.join(c.hint("merge"), "entity_id").withColumn("category", F.when(F.col("n_old") >= MIN_OLD, "infill").otherwise("extension")).select(
        "entity_id", "unit_id", "fmi", "category", "n_old")


def inputs(spark, sf):
    m = materialise(account_monthly(spark, sf), plain=True)
    return m, materialise(accounts(spark, sf, m), plain=True), account_events(spark, sf)


def run(spark, sf, as_of, econ_rows, model=None):
    cfg = cfg_of(as_of)
    m, acc, ev = inputs(spark, sf)
    return U.evaluate(m, acc, ev, fresh(acc, as_of), labelled(limits(spark, acc), econ_rows), as_of, cfg, model=model)


def ev_sql(p, as_of, econ, model=None):
    return [*BASE, *evaluation(p, as_of, cfg_of(as_of), econ, RADIUS, MIN_OLD, model)]


@query("deck_lookup", sql="""
SELECT as_of, 'deck_' || year(as_of) || '_12' AS deck, n FROM (SELECT make_date(year(o_orderdate), 12, 31) AS as_of, count(*) AS n FROM orders GROUP BY 1)""")
def deck_lookup(spark, sf):
    """The price deck of every evaluation date, by exact match; a date without a deck would stop the query."""
    dates = table(spark, sf, "orders").groupBy(F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("as_of")).agg(F.count(F.lit(1)).alias("n"))
    first = F.year(F.min(F.to_date("l_shipdate")))
    years = table(spark, sf, "lineitem").agg(first.alias("a"), F.year(F.max(F.to_date("l_shipdate"))).alias("b")).select(F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("y"))
    decks = years.select(F.make_date("y", F.lit(12), F.lit(31)).alias("as_of"), F.concat(F.lit("deck_"), F.col("y").cast("string"), F.lit("_12")).alias("deck"))
    return E.deck_for(dates, decks).select("as_of", "deck", "n")


@query("economic_limits", sql=with_ctes(BASE, select="SELECT unit_id, deck, scenario, round(price,4) AS price, round(net_t,4) AS net_t, round(opex_month,2) AS opex_month, round(q_econ,6) AS q_econ FROM lim"))
def economic_limits(spark, sf):
    lim = limits(spark, accounts(spark, sf))
    return lim.select("unit_id", "deck", "scenario", rnd("price").alias("price"), rnd("net_t").alias("net_t"), rnd("opex_month", 2).alias("opex_month"), rnd("q_econ", 6).alias("q_econ"))


@query("type_curve", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select="SELECT unit_id, k, round(rate,6) AS rate, n_wells FROM c_tc"))
def type_curve(spark, sf):
    m, acc, _ = inputs(spark, sf)
    return U.type_curve(m, acc, CLOSE, CFG).withColumn("rate", rnd("rate", 6))


@query("analog_forecast", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select="""
SELECT unit_id, j::INTEGER AS j, round(CASE WHEN 3+j <= l THEN tc[3+j]*1.5 ELSE tc[l]*1.5*exp(-ext*(3+j-l)) END, 6) AS r FROM c_tp, (SELECT unnest([1,2,12,60,360]) AS j)"""))
def analog_forecast(spark, sf):
    m, acc, _ = inputs(spark, sf)
    p = U.packed_curve(U.type_curve(m, acc, CLOSE, CFG)).withColumn("j", F.explode(F.array(*[F.lit(x) for x in (1, 2, 12, 60, 360)])))
    return p.select("unit_id", "j", rnd(U.analog_rate(F.col("j"), F.lit(3), F.lit(1.5)), 6).alias("r"))


EFF_COLS = "entity_id, emi, event_type, unit_id, status, n_pre, n_post, round(realized,3) AS realized, CASE WHEN status='ok' THEN round(d_inc,6) END AS d_inc, CASE WHEN status='ok' THEN round(inc_now,6) END AS inc_now, CASE WHEN status='ok' THEN round(rate_gain,6) END AS rate_gain, round(pre_rate,6) AS pre_rate, CASE WHEN status='ok' THEN realized > 0 END AS effective"


def effects(spark, sf, as_of, ins=None):
    m, acc, ev = ins or inputs(spark, sf)
    start = as_of - CFG.period + 1
    return U.measure_effects(m, ev, as_of, CFG).join(acc.select("entity_id", "unit_id", "fmi").hint("merge"), "entity_id").withColumn(
        "in_period", (F.col("emi") >= start) & (F.col("fmi") < start))


@query("measure_effects", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select=f"SELECT {EFF_COLS}, in_period FROM c_eff"))
def measure_effects(spark, sf):
    return effects(spark, sf, CLOSE).select(
        "entity_id", "emi", "event_type", "unit_id", "status", "n_pre", "n_post", rnd("realized", 3).alias("realized"), rnd("d_inc", 6).alias("d_inc"), rnd("inc_now", 6).alias("inc_now"),
        rnd("rate_gain", 6).alias("rate_gain"), rnd("pre_rate", 6).alias("pre_rate"), "effective", "in_period")


def done(spark, sf, as_of, econ_rows):
    ins = inputs(spark, sf)
    acc = ins[1]
    e = effects(spark, sf, as_of, ins).where("in_period AND status = 'ok'").join(labelled(limits(spark, acc), econ_rows).select("unit_id", "scenario", "q_econ"), "unit_id")
    return e.withColumn("inc_remaining", U.increment_remaining("q_econ"))


@query("increment_remaining", sql=with_ctes(ev_sql("c", CLOSE, ALL26), select="SELECT entity_id, emi, event_type, scenario, round(inc_remaining,2) AS inc_remaining, round(realized+inc_remaining,2) AS inc_eur FROM c_done"))
def increment_remaining(spark, sf):
    return done(spark, sf, CLOSE, ALL26).select("entity_id", "emi", "event_type", "scenario", rnd("inc_remaining", 2).alias("inc_remaining"),
                                                rnd(F.col("realized") + F.col("inc_remaining"), 2).alias("inc_eur"))


@query("measure_summary", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select="""
SELECT coalesce(event_type,'all') AS event_type, count(*) AS n, count(*) FILTER (WHERE status='ok') AS n_evaluated, count(*) FILTER (WHERE status='ok' AND realized > 0) AS n_effective,
 round(avg(pre_rate) FILTER (WHERE status='ok'),5) AS pre_rate_avg, round(avg(rate_gain) FILTER (WHERE status='ok'),5) AS rate_gain_avg, round(avg(realized+inc_remaining) FILTER (WHERE status='ok'),3) AS inc_eur_avg,
 round(coalesce(sum(realized+inc_remaining) FILTER (WHERE status='ok'),0),2) AS inc_eur_total, round(coalesce(sum(realized) FILTER (WHERE status='ok'),0),2) AS realized_total,
 round(count(*) FILTER (WHERE status='ok' AND realized > 0)*100.0::DOUBLE/nullif(count(*) FILTER (WHERE status='ok'),0),4) AS effective_rate_pct
FROM c_eff LEFT JOIN (SELECT ek, inc_remaining FROM c_done) USING (ek) WHERE in_period GROUP BY GROUPING SETS ((event_type),())"""))
def measure_summary(spark, sf):
    e = effects(spark, sf, CLOSE).where("in_period")
    d = done(spark, sf, CLOSE, SEC26).select("entity_id", "emi", "event_type", "inc_remaining")
    s = U.summarize_measures(e.join(d, ["entity_id", "emi", "event_type"], "left"))
    return s.select("event_type", "n", "n_evaluated", "n_effective", rnd("pre_rate_avg", 5).alias("pre_rate_avg"), rnd("rate_gain_avg", 5).alias("rate_gain_avg"), rnd("inc_eur_avg", 3).alias("inc_eur_avg"),
                    rnd("inc_eur_total", 2).alias("inc_eur_total"), rnd("realized_total", 2).alias("realized_total"), rnd("effective_rate_pct").alias("effective_rate_pct"))


@query("new_entity_reserves", sql=with_ctes(ev_sql("c", CLOSE, ALL26), select="""
SELECT entity_id, unit_id, scenario, category, n_old, months_on::BIGINT AS months_on, cum, round(rate_now,6) AS rate_now, round(dynamic_t,2) AS dynamic_t, round(analog_t,2) AS analog_t, round(reserves,2) AS reserves, basis FROM c_new"""))
def new_entity_reserves(spark, sf):
    n = run(spark, sf, CLOSE, ALL26).new
    return n.select("entity_id", "unit_id", "scenario", "category", "n_old", "months_on", "cum", rnd("rate_now", 6).alias("rate_now"), rnd("dynamic_t", 2).alias("dynamic_t"),
                    rnd("analog_t", 2).alias("analog_t"), rnd("reserves", 2).alias("reserves"), "basis")


@query("old_entity_reserves", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select="""
SELECT entity_id, unit_id, scenario, status, basis, n_fit, gap AS gap_months, round(remaining_low,2) AS remaining_low, round(remaining_best,2) AS remaining_best FROM c_old"""))
def old_entity_reserves(spark, sf):
    o = run(spark, sf, CLOSE, SEC26).old
    return o.select("entity_id", "unit_id", "scenario", "status", "basis", "n_fit", "gap_months", rnd("remaining_low", 2).alias("remaining_low"), rnd("remaining_best", 2).alias("remaining_best"))


@query("shut_in_reserves", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select=f"""
SELECT entity_id, unit_id, pdnp_status, last_prod, ({CLOSE}-last_prod)::BIGINT AS shut_in_months, round(pdnp,2) AS pdnp, round(pdnp_estimate,2) AS pdnp_estimate FROM c_old WHERE status='not_producing'"""))
def shut_in_reserves(spark, sf):
    o = run(spark, sf, CLOSE, SEC26).old.where("status = 'not_producing'")
    return o.select("entity_id", "unit_id", "pdnp_status", "last_prod", "shut_in_months", rnd("pdnp", 2).alias("pdnp"), rnd("pdnp_estimate", 2).alias("pdnp_estimate"))


@query("unit_components", sql=with_ctes(ev_sql("c", CLOSE, ALL26), select="SELECT unit_id, scenario, component, n_items, round(reserves,1) AS reserves FROM c_comp"))
def unit_components(spark, sf):
    return run(spark, sf, CLOSE, ALL26).components.select("unit_id", "scenario", "component", "n_items", rnd("reserves", 1).alias("reserves"))


@query("composition_report", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select="""
SELECT plant, unit_id, component, CAST(2-grouping(plant)-grouping(unit_id) AS INTEGER) AS depth, round(sum(reserves),1) AS reserves, sum(n_items)::BIGINT AS n_items,
 round(100*sum(reserves)/sum(sum(reserves)) OVER (PARTITION BY plant, unit_id, grouping(plant), grouping(unit_id)),2) AS share_pct
FROM (SELECT split_part(unit_id,'/',1) AS plant, * FROM c_comp) GROUP BY GROUPING SETS ((component, plant, unit_id),(component, plant),(component))"""))
def composition_report(spark, sf):
    from pyspark.sql import Window
    c = run(spark, sf, CLOSE, SEC26).components.withColumn("plant", F.split_part("unit_id", F.lit("/"), F.lit(1)))
    g = c.groupingSets([[F.col("component"), F.col("plant"), F.col("unit_id")], [F.col("component"), F.col("plant")], [F.col("component")]],
                       F.col("component"), F.col("plant"), F.col("unit_id")).agg(
        (2 - F.grouping("plant").cast("int") - F.grouping("unit_id").cast("int")).alias("depth"), F.sum("reserves").alias("reserves"), F.sum("n_items").alias("n_items"))
    w = Window.partitionBy("plant", "unit_id", "depth")
    return g.select("plant", "unit_id", "component", "depth", rnd("reserves", 1).alias("reserves"), "n_items",
                    rnd(100 * F.try_divide("reserves", F.sum("reserves").over(w)), 2).alias("share_pct"))


COMP_SQL = [f"""inc AS (SELECT m.entity_id, ek, emi, mi, oil - base*days_on AS inc FROM c_af m)""", """
cmp AS (SELECT unit_id, mi, sum(oil) AS total_oil, sum(CASE WHEN fmi >= {since} THEN oil ELSE 0 END) AS new_oil, count(*) FILTER (WHERE days_on>0) AS n_producing, count(*) FILTER (WHERE days_on>0 AND fmi >= {since}) AS n_new_producing
  FROM am JOIN acc USING (entity_id) WHERE mi BETWEEN {start} AND {end} GROUP BY ALL)""", """
ki AS (SELECT a.unit_id, i.* FROM inc i JOIN acc a USING (entity_id) WHERE emi >= {since} AND a.fmi < {since})""", """
cmi AS (SELECT c.*, coalesce(k.m,0) AS measure_inc, c.total_oil - c.new_oil - coalesce(k.m,0) AS old_base FROM cmp c LEFT JOIN (SELECT unit_id, mi, sum(inc) AS m FROM ki GROUP BY ALL) k USING (unit_id, mi))"""]


def comp_sql(since, start, end):
    return [x.replace("{since}", str(since)).replace("{start}", str(start)).replace("{end}", str(end)) for x in COMP_SQL]


def composition(spark, sf, since, start, end):
    m, acc, ev = inputs(spark, sf)
    eff = U.measure_effects(m, ev, CLOSE, CFG)
    return U.monthly_composition(m, acc, U.measure_increments(m.where(F.col("mi") <= CLOSE), eff), since=since, start=start, end=end)


@query("monthly_composition", sql=with_ctes(ev_sql("c", CLOSE, SEC26), comp_sql(CLOSE - 11, CLOSE - 35, CLOSE), select=f"""
SELECT unit_id, mi, total_oil, new_oil, round(measure_inc,3) AS measure_inc, round(old_base,3) AS old_base, round(old_base/{S.dim('mi')},5) AS old_base_rate, n_producing, n_new_producing, n_producing-n_new_producing AS n_old_producing,
 (SELECT count(DISTINCT ek) FROM ki WHERE ki.unit_id=cmi.unit_id AND ki.emi <= cmi.mi) AS n_measures_cum FROM cmi"""))
def monthly_composition(spark, sf):
    c = composition(spark, sf, CLOSE - 11, CLOSE - 35, CLOSE)
    return c.select("unit_id", "mi", "total_oil", "new_oil", rnd("measure_inc", 3).alias("measure_inc"), rnd("old_base", 3).alias("old_base"), rnd("old_base_rate", 5).alias("old_base_rate"),
                    "n_producing", "n_new_producing", "n_old_producing", "n_measures_cum")


def _decl(y, name):
    r = f"ln(({y})/{S.dim('mi')})"
    ok = f"({y}) > 0"
    n = f"count(*) FILTER (WHERE {ok})"
    return (f"CASE WHEN {n} >= 6 THEN round((1-exp(12*regr_slope({r}, mi) FILTER (WHERE {ok})))*100,4) END AS {name}_annual_pct, "
            f"CASE WHEN {n} >= 6 THEN round((1-exp(regr_slope({r}, mi) FILTER (WHERE {ok})))*100,4) END AS {name}_monthly_pct, CASE WHEN {n} >= 6 THEN round(regr_r2({r}, mi) FILTER (WHERE {ok}),5) END AS {name}_r2")


@query("unit_decline", sql=with_ctes(ev_sql("c", CLOSE, SEC26), comp_sql(CLOSE - 23, CLOSE - 23, CLOSE), select=f"""
SELECT unit_id, count(*) AS n_months, {_decl('old_base', 'natural')}, {_decl('old_base+measure_inc', 'comprehensive')} FROM cmi GROUP BY 1"""))
def unit_decline(spark, sf):
    """Natural and comprehensive decline after taking out new entities and measures of the last two years."""
    from ..functions.columns import days_in_month
    since = CLOSE - 23
    c = composition(spark, sf, since, since, CLOSE)
    c = c.withColumn("n_rate", F.col("old_base") / days_in_month("mi")).withColumn("c_rate", (F.col("old_base") + F.col("measure_inc")) / days_in_month("mi"))
    n = A.loglinear_decline(c, ["unit_id"], x="mi", rate="n_rate", name="natural")
    k = A.loglinear_decline(c, ["unit_id"], x="mi", rate="c_rate", name="comprehensive")
    cnt = c.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_months"))
    j = cnt.join(n, "unit_id").join(k, "unit_id")
    return j.select("unit_id", "n_months", *[rnd(x, 5 if x.endswith("r2") else 4).alias(x) for x in j.columns if x not in ("unit_id", "n_months")])


@query("plan_vs_actual", sql=with_ctes(BASE, """
act AS (SELECT plant, mi, sum(oil) AS actual FROM am JOIN acc USING (entity_id) GROUP BY ALL)""", f"""
pl AS (SELECT {S.mi('o_orderdate')} AS mi, c_mktsegment AS plant, sum(o_totalprice)/10000 AS plan FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY ALL)""", f"""
sp AS (SELECT plant, unnest(range({CLOSE - 11},{CLOSE + 1})) AS mi FROM (SELECT DISTINCT plant FROM acc))""", select="""
SELECT plant, mi::INTEGER AS mi, round(plan,3) AS plan, actual, round(100*(actual-plan)/plan,3) AS deviation_pct, round(100*(sum(actual) OVER w-sum(plan) OVER w)/sum(plan) OVER w,3) AS period_deviation_pct FROM sp LEFT JOIN pl USING (plant, mi) LEFT JOIN act USING (plant, mi) WINDOW w AS (PARTITION BY plant)"""))
def plan_vs_actual(spark, sf):
    from pyspark.sql import Window
    from ..functions.columns import month_index
    from ..sources.bind import table
    m, acc, _ = inputs(spark, sf)
    act = m.join(acc.select("entity_id", "plant"), "entity_id").groupBy("plant", "mi").agg(F.sum("oil").alias("actual"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("plant")), "o_custkey")
    pl = o.groupBy("plant", month_index("o_orderdate").alias("mi")).agg((F.sum("o_totalprice") / 10000).alias("plan"))
    spine = acc.select("plant").distinct().withColumn("mi", F.explode(F.sequence(F.lit(CLOSE - 11), F.lit(CLOSE))))
    j = spine.join(pl, ["plant", "mi"], "left").join(act, ["plant", "mi"], "left")
    w = Window.partitionBy("plant")  # twelve rows each
    tot = F.try_divide(100 * (F.sum("actual").over(w) - F.sum("plan").over(w)), F.sum("plan").over(w))
    return j.select("plant", "mi", rnd("plan", 3).alias("plan"), "actual", rnd(F.try_divide(100 * (F.col("actual") - F.col("plan")), F.col("plan")), 3).alias("deviation_pct"), rnd(tot, 3).alias("period_deviation_pct"))


# ------------------------------------------------------------------ planned locations
def pud_sql(p, as_of, name):
    c = CFG
    return [LOC, f"""{name}_act AS (SELECT x, y FROM acc WHERE entity_id IN (SELECT entity_id FROM am WHERE mi BETWEEN {as_of - 2} AND {as_of} AND oil > 0))""",
            f"""{name}_nb AS (SELECT location_id, count(a.x) AS n_near FROM loc l LEFT JOIN {name}_act a ON round(sqrt((l.x-a.x)**2+(l.y-a.y)**2),9) <= {c.pud_radius} GROUP BY 1)""",
            f"""{name}_f AS (SELECT c.unit_id, e.scenario, e.q_econ, e.net_t, e.opex_month, j, CASE WHEN j <= l THEN tc[j]*{c.certainty}::DOUBLE ELSE tc[l]*{c.certainty}::DOUBLE*exp(-ext*(j-l)) END AS r FROM {p}_tp c JOIN {p}_econ e ON e.unit_id=c.unit_id, range(1,361) h(j) WHERE l >= 2)""",
            f"""{name}_k AS (SELECT unit_id, scenario, arg_max(j, {{'r': r, 'n': -j}}) AS kp FROM {name}_f GROUP BY ALL)""",
            f"""{name}_v AS (SELECT unit_id, scenario, sum(r)*30.4 AS estimate, count(*) AS n_months, (sum(r)*30.4*any_value(net_t) - count(*)*any_value(opex_month))*7.1/1e4 AS cash FROM (
  SELECT *, min(CASE WHEN j < kp OR r >= q_econ THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id, scenario ORDER BY j) AS alive FROM {name}_f JOIN {name}_k USING (unit_id, scenario)) WHERE alive=1 GROUP BY ALL)""",
            f"""{name} AS (SELECT *, CASE WHEN status='booked' THEN estimate ELSE 0 END AS reserves, status='booked' AND (first_booked_mi IS NULL OR first_booked_mi={as_of}) AS new_booking, (deadline_mi-{as_of})/12.0::DOUBLE AS years_to_deadline FROM (
  SELECT l.location_id, l.unit_id, e.scenario, planned_mi, first_booked_mi, deadline_mi, n_near, cx AS capex, estimate, n_months, cash,
   CASE WHEN coalesce(d.fmi <= {as_of}, false) OR (l.status='drilled' AND drilled_id IS NULL) THEN 'drilled' WHEN l.status='cancelled' THEN 'cancelled' WHEN first_booked_mi > {as_of} THEN 'not_booked_yet' WHEN {as_of} >= deadline_mi THEN 'expired_5yr'
    WHEN planned_mi > deadline_mi THEN 'beyond_5yr' WHEN estimate IS NULL THEN 'no_type_curve' WHEN n_near < {c.pud_neighbours} THEN 'not_certain' WHEN cash < cx THEN 'uneconomic' ELSE 'booked' END AS status
  FROM (SELECT *, CASE WHEN first_booked_mi <= {as_of} THEN first_booked_mi ELSE {as_of} END + {c.pud_years * 12} AS deadline_mi, CASE WHEN coalesce(capex,0)=0 THEN 500.0 ELSE capex END AS cx FROM loc) l JOIN {name}_nb USING (location_id) LEFT JOIN acc d ON d.entity_id = l.drilled_id
  JOIN {p}_econ e ON e.unit_id=l.unit_id LEFT JOIN {name}_v v ON v.unit_id=l.unit_id AND v.scenario=e.scenario))"""]


def planned(spark, sf, as_of, econ_rows):
    m, acc, _ = inputs(spark, sf)
    act = acc.join(m.where(F.col("mi").between(as_of - 2, as_of) & (F.col("oil") > 0)).select("entity_id").distinct().hint("merge"), "entity_id", "left_semi")
    curves = U.packed_curve(U.type_curve(m, acc, as_of, cfg_of(as_of)))
    drilled = acc.select(F.col("entity_id").alias("drilled_id"), F.col("fmi").alias("drilled_fmi"))
    return U.planned_locations(locations(spark, sf), act, drilled, curves, labelled(limits(spark, acc), econ_rows), as_of, cfg_of(as_of), fx=E.FX, default_capex=E.PUD_CAPEX)


@query("planned_locations", sql=with_ctes(ev_sql("c", CLOSE, ALL26), pud_sql("c", CLOSE, "pud"), select="""
SELECT location_id, unit_id, scenario, status, planned_mi, deadline_mi, n_near, capex, round(cash,2) AS cash, round(estimate,2) AS estimate, round(reserves,2) AS reserves, new_booking, round(years_to_deadline,4) AS years_to_deadline FROM pud"""))
def planned_locations(spark, sf):
    return planned(spark, sf, CLOSE, ALL26).select(
        "location_id", "unit_id", "scenario", "status", "planned_mi", "deadline_mi", "n_near", "capex", rnd("cash", 2).alias("cash"), rnd("estimate", 2).alias("estimate"), rnd("reserves", 2).alias("reserves"),
        "new_booking", rnd("years_to_deadline").alias("years_to_deadline"))


# ------------------------------------------------------------------ flagship on the part series
@query("unit_decline_rollup", sql=with_ctes(S.WELLS, S.monthly("part"), """
d AS (SELECT block, layer, mi, sum(oil) AS total, sum(CASE WHEN fmi >= 23946 THEN oil ELSE 0 END) AS new_oil FROM monthly JOIN wells USING (entity_id) WHERE mi BETWEEN 23940 AND 23975 GROUP BY ALL)""", """
g AS (SELECT block, layer, mi, grouping(layer)::INT AS gl, grouping(block)::INT AS gb, sum(total) AS total, sum(new_oil) AS new_oil FROM d GROUP BY GROUPING SETS ((block, layer, mi),(block, mi),(mi)))""", select=f"""
SELECT block, layer, CAST(2-gl-gb AS INTEGER) AS depth, sum(total) AS total_oil, sum(new_oil) AS new_oil, count(*) AS n_months,
 CASE WHEN count(*) FILTER (WHERE total > new_oil) >= 6 THEN round((1-exp(12*regr_slope(ln((total-new_oil)/{S.dim('mi')}), mi) FILTER (WHERE total > new_oil)))*100,4) END AS annual_decline_pct,
 CASE WHEN count(*) FILTER (WHERE total > new_oil) >= 6 THEN round(regr_r2(ln((total-new_oil)/{S.dim('mi')}), mi) FILTER (WHERE total > new_oil),5) END AS r2
FROM g GROUP BY block, layer, gl, gb"""))
def unit_decline_rollup(spark, sf):
    """Monthly old/new split and base decline of every unit, plant and the company in one pass."""
    from ..functions.columns import days_in_month, guarded_slope
    from ..sources.bind import monthly, wells
    m = monthly(spark, sf, "part").where(F.col("mi").between(23940, 23975)).join(wells(spark, sf).select("entity_id", "block", "layer", "fmi"), "entity_id")
    d = m.groupBy("block", "layer", "mi").agg(F.sum("oil").alias("total"), F.sum(F.when(F.col("fmi") >= 23946, F.col("oil")).otherwise(0.0)).alias("new_oil"))
    cols = [F.col("block"), F.col("layer"), F.col("mi")]
    g = d.groupingSets([cols, [cols[0], cols[2]], [cols[2]]], *cols).agg(
        F.sum("total").alias("total"), F.sum("new_oil").alias("new_oil"), (2 - F.grouping("block").cast("int") - F.grouping("layer").cast("int")).alias("depth"))
    base = F.col("total") - F.col("new_oil")
    y = F.when(base > 0, F.ln(base / days_in_month("mi")))
    r = g.groupBy("block", "layer", "depth").agg(
        F.sum("total").alias("total_oil"), F.sum("new_oil").alias("new_oil"), F.count(F.lit(1)).alias("n_months"),
        guarded_slope(y, F.col("mi"), 6).alias("_s"), F.when(F.regr_count(y, F.col("mi")) >= 6, F.regr_r2(y, F.col("mi"))).alias("r2"))
    return r.select("block", "layer", "depth", "total_oil", "new_oil", "n_months", rnd((1 - F.exp(12 * F.col("_s"))) * 100).alias("annual_decline_pct"), rnd("r2", 5).alias("r2"))


@query("new_entity_list", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select="""
SELECT unit_id, entity_id, category, n_old, basis, round(reserves,2) AS reserves, rk FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY round(coalesce(reserves,0),6) DESC, entity_id) AS rk FROM c_new) WHERE rk <= 3"""))
def new_entity_list(spark, sf):
    n = run(spark, sf, CLOSE, SEC26).new
    return top_k(n, ["unit_id"], [F.desc(F.round(F.coalesce("reserves", F.lit(0.0)), 6)), "entity_id"], 3).select(
        "unit_id", "entity_id", "category", "n_old", "basis", rnd("reserves", 2).alias("reserves"), "rk")
