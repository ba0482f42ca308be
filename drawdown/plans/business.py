"""Queries: reconciliation, categories, attribution, sensitivity, finance, indicators, records on the customer units."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import days_in_month, rnd
from ..operators import economics as E, finance as N, indicators as I, recon as R, stats as A, unit as U
from ..session import materialise
from ..sources.bind import account_events, account_monthly, accounts, table
from ..sources.snapshot import files_of, fingerprint, snapshot
from . import sqlkit as S
from .fitsql import remaining_ctes
from .registry import query, with_ctes
from .unit import (ALL26, CFG, cfg_of, CLOSE, CLOSE_ECON, OPEN, SEC25, SEC26, comp_sql, ev_sql, fresh, labelled, limits, planned, pud_sql)
from .unitsql import new_ctes

NAMES = ("old", "new", "measures", "done", "components", "production", "curves")
ROWSETS = {"open": (OPEN, SEC25), "close": (CLOSE, CLOSE_ECON), "prices": (CLOSE, ALL26)}


#: Raised when the evaluation itself changes, so that stored results of older code are not taken.
VERSION = "4"
_digests: dict[tuple, str] = {}


def source_digest(spark, sf) -> str:
    """Key of the evaluation: every column of the tables behind it, the settings and decks, computed once for the files as they are: name, size and time of each."""
    names = ("lineitem", "orders", "customer", "supplier", "nation", "region", "part")
    known = spark.sparkContext.applicationId, sf, *(files_of(table(spark, sf, n)) for n in names)
    if known not in _digests:
        tables = [(d, d.columns) for d in (table(spark, sf, n) for n in names)]
        _digests[known] = fingerprint(tables, sf, repr(CFG), repr(ROWSETS), repr([(k, v) for k, v in vars(E).items() if k.isupper()]), VERSION)
    return _digests[known]


def base(spark, sf, digest):
    t = snapshot(spark, f"{digest}/base", lambda: dict(m=account_monthly(spark, sf)), ("m",))
    return t["m"], snapshot(spark, f"{digest}/master", lambda: dict(a=accounts(spark, sf, t["m"])), ("a",))["a"]


def evaluated(spark, sf, which):
    """Evaluation tables of one date, taken from the snapshot when the inputs are unchanged."""
    as_of, rows = ROWSETS[which]
    digest = source_digest(spark, sf)

    def build():
        m, acc = base(spark, sf, digest)
        ev = U.evaluate(m, acc, account_events(spark, sf), fresh(acc, as_of), labelled(limits(spark, acc), rows), as_of, cfg_of(as_of), store=True)
        return {"old": ev.old, "new": ev.new, "measures": ev.measures, "done": ev.effects, "components": ev.components, "production": ev.production, "curves": ev.curves}

    t = snapshot(spark, f"{digest}/{which}", build, NAMES)
    m, acc = base(spark, sf, digest)
    return dict(t, m=m, acc=acc)


def _at(df, scenario):
    return df.where(F.col("scenario") == scenario)


OC = [*ev_sql("o", OPEN, SEC25), *ev_sql("c", CLOSE, CLOSE_ECON)]
MOVES_SQL = """mv AS (SELECT c.entity_id, c.unit_id, 'reactivated' AS change, c.remaining_low + coalesce(p.production,0) AS value FROM (SELECT * FROM c_old WHERE scenario='sec') c JOIN o_old o ON o.entity_id=c.entity_id AND o.status='not_producing'
  LEFT JOIN c_prod p ON p.entity_id=c.entity_id WHERE c.status IN ('ok','short_history')
 UNION ALL SELECT c.entity_id, c.unit_id, 'shut_in', coalesce(p.production,0) - w.v FROM (SELECT * FROM c_old WHERE scenario='sec') c JOIN (SELECT entity_id, remaining_low AS v FROM o_old WHERE status IN ('ok','short_history') UNION ALL SELECT entity_id, coalesce(reserves,0) FROM o_new) w ON w.entity_id=c.entity_id AND w.v > 0
  LEFT JOIN c_prod p ON p.entity_id=c.entity_id WHERE c.status='not_producing')"""
REC_SQL = """rec AS (SELECT *, closing - opening - production - price_revision - new_wells - measure - extension - category_change AS technical_revision FROM (
 SELECT u.unit_id, coalesce(o.v,0) AS opening, coalesce(c.v,0) AS closing, -coalesce(p.v,0) AS production, coalesce(c.v,0)-coalesce(a.v,0) AS price_revision, coalesce(n.i,0) AS new_wells, coalesce(m.v,0) AS measure, coalesce(n.e,0) AS extension, coalesce(k.v,0) AS category_change
 FROM (SELECT DISTINCT unit_id FROM acc) u LEFT JOIN (SELECT unit_id, sum(reserves) AS v FROM o_comp GROUP BY 1) o USING (unit_id) LEFT JOIN (SELECT unit_id, sum(reserves) AS v FROM c_comp WHERE scenario='sec' GROUP BY 1) c USING (unit_id)
 LEFT JOIN (SELECT unit_id, sum(reserves) AS v FROM c_comp WHERE scenario='opening_price' GROUP BY 1) a USING (unit_id) LEFT JOIN (SELECT unit_id, sum(production) AS v FROM c_prod GROUP BY 1) p USING (unit_id)
 LEFT JOIN (SELECT unit_id, sum(coalesce(reserves,0)+coalesce(production,0)) FILTER (WHERE category='infill') AS i, sum(coalesce(reserves,0)+coalesce(production,0)) FILTER (WHERE category='extension') AS e FROM (SELECT * FROM c_new WHERE scenario='sec') x LEFT JOIN (SELECT entity_id, production FROM c_prod) USING (entity_id) GROUP BY 1) n USING (unit_id)
 LEFT JOIN (SELECT unit_id, sum(inc_remaining+realized) AS v FROM c_done WHERE scenario='sec' GROUP BY 1) m USING (unit_id) LEFT JOIN (SELECT unit_id, sum(value) AS v FROM mv GROUP BY 1) k USING (unit_id)))"""
TAB_SQL = "tab AS (" + " UNION ALL ".join(f"SELECT unit_id, {i} AS line, '{r}' AS item, round({r},1) AS value FROM rec" for i, r in enumerate((*R.ROWS, "closing"))) + ")"


def reconciled(spark, sf):
    o, c = evaluated(spark, sf, "open"), evaluated(spark, sf, "close")
    moves = R.category_moves(o["old"], o["new"], _at(c["old"], "sec"), c["production"])
    v = R.reconcile(o["components"], _at(c["components"], "sec"), _at(c["components"], "opening_price"), _at(c["done"], "sec"), _at(c["new"], "sec"), c["production"], moves)
    return v, moves, o, c


@query("reconciliation", sql=with_ctes(OC, MOVES_SQL, REC_SQL, TAB_SQL, select="SELECT unit_id, line::INTEGER AS line, item, value, true AS balanced FROM tab"))
def reconciliation(spark, sf):
    return R.reconciliation_table(reconciled(spark, sf)[0])


@query("reconciliation_rollup", sql=with_ctes(OC, MOVES_SQL, REC_SQL, TAB_SQL, select="""
SELECT coalesce(plant,'ALL') AS scope, item, round(sum(value),1) AS value FROM (SELECT split_part(unit_id,'/',1) AS plant, * FROM tab) GROUP BY GROUPING SETS ((plant, item),(item))"""))
def reconciliation_rollup(spark, sf):
    t = R.reconciliation_table(reconciled(spark, sf)[0]).withColumn("scope", F.split_part("unit_id", F.lit("/"), F.lit(1)))
    g = t.groupingSets([[F.col("scope"), F.col("item")], [F.col("item")]], F.col("scope"), F.col("item")).agg(F.sum("value").alias("value"))
    return g.select(F.coalesce("scope", F.lit("ALL")).alias("scope"), "item", rnd("value", 1).alias("value"))


@query("stored_opening", sql=with_ctes(OC, MOVES_SQL, REC_SQL, """
st AS (SELECT unit_id, round(opening,0)+10 AS st FROM rec)""", select="SELECT unit_id, 'stored' AS opening_source, round(st,1) AS opening, round(technical_revision-(st-opening),1) AS technical_revision FROM rec JOIN st USING (unit_id)"))
def stored_opening(spark, sf):
    v = materialise(reconciled(spark, sf)[0])
    r = R.stored_opening(v, v.select("unit_id", (F.round("opening", 0) + 10).alias("reserves")))
    return r.select("unit_id", "opening_source", rnd("opening", 1).alias("opening"), rnd("technical_revision", 1).alias("technical_revision"))


@query("change_attribution", sql=with_ctes(OC, MOVES_SQL, REC_SQL, TAB_SQL, select="""
SELECT unit_id, item, value, rank, round(share_pct,3) AS share_pct FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY abs(value) DESC, line) AS rank, 100*abs(value)/CASE WHEN sum(abs(value)) OVER (PARTITION BY unit_id)=0 THEN 1 ELSE sum(abs(value)) OVER (PARTITION BY unit_id) END AS share_pct
 FROM tab WHERE item NOT IN ('opening','closing'))"""))
def change_attribution(spark, sf):
    a = R.attribution(R.reconciliation_table(reconciled(spark, sf)[0]))
    return a.select("unit_id", "item", "value", "rank", rnd("share_pct", 3).alias("share_pct"))


@query("category_moves", sql=with_ctes(OC, MOVES_SQL, select="""
SELECT unit_id, change, entity_id, round(value,2) AS value, rk FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, change ORDER BY round(abs(value),4) DESC, entity_id) AS rk FROM mv) WHERE rk <= 3"""))
def category_moves(spark, sf):
    """Three largest movers per unit and direction, the evidence behind the category line."""
    from ..operators.ranking import top_k
    m = reconciled(spark, sf)[1]
    return top_k(m, ["unit_id", "change"], [F.desc(F.round(F.abs("value"), 4)), "entity_id"], 3).select("unit_id", "change", "entity_id", rnd("value", 2).alias("value"), "rk")


ROLL = """SELECT unit_id, move, round(sum(v),2) AS value, count(*) AS n FROM (
 SELECT unit_id, 'opening' AS move, ov AS v FROM j WHERE was UNION ALL SELECT unit_id, 'closing', cv FROM j WHERE now
 UNION ALL SELECT unit_id, CASE WHEN was AND NOT now THEN {leave} WHEN was AND now THEN 'revision' ELSE '{fresh}' END, CASE WHEN was AND NOT now THEN -ov WHEN was AND now THEN cv-ov ELSE cv END FROM j WHERE was OR now) GROUP BY ALL"""


@query("planned_rollforward", sql=with_ctes(OC, pud_sql("o", OPEN, "po"), pud_sql("c", CLOSE, "pc"), """
j AS (SELECT o.unit_id, coalesce(o.status='booked',false) AS was, coalesce(c.status='booked',false) AS now, o.reserves AS ov, c.reserves AS cv, c.status AS cs FROM po o JOIN pc c ON c.location_id=o.location_id AND c.scenario='sec')""",
       select=ROLL.format(leave="CASE cs WHEN 'drilled' THEN 'converted' WHEN 'expired_5yr' THEN 'expired_5yr' ELSE 'removed' END", fresh="new_booking")))
def planned_rollforward(spark, sf):
    o, c = planned(spark, sf, OPEN, SEC25), planned(spark, sf, CLOSE, SEC26)
    r = R.rollforward(o, c, "location_id", moves={"drilled": "converted", "expired_5yr": "expired_5yr"}, rest="removed", fresh="new_booking")
    return r.withColumn("value", rnd("value", 2))


@query("shut_in_rollforward", sql=with_ctes(OC, """
os AS (SELECT entity_id, unit_id, CASE WHEN status='not_producing' THEN pdnp_status ELSE status END AS st, coalesce(pdnp,0) AS v FROM o_old)""", """
cs AS (SELECT entity_id, unit_id, CASE WHEN status='not_producing' THEN pdnp_status ELSE status END AS st, coalesce(pdnp,0) AS v FROM c_old WHERE scenario='sec')""", """
j AS (SELECT coalesce(o.unit_id, c.unit_id) AS unit_id, coalesce(o.st='booked',false) AS was, coalesce(c.st='booked',false) AS now, o.v AS ov, c.v AS cv, c.st AS cst FROM os o FULL JOIN cs c ON c.entity_id=o.entity_id)""",
       select=ROLL.format(leave="CASE WHEN cst IN ('ok','short_history') THEN 'reactivated' ELSE 'removed' END", fresh="new_shut_in")))
def shut_in_rollforward(spark, sf):
    o, c = evaluated(spark, sf, "open"), evaluated(spark, sf, "close")

    def state(df):
        return df.select("entity_id", "unit_id", F.when(F.col("status") == "not_producing", F.col("pdnp_status")).otherwise(F.col("status")).alias("status"),
                         F.coalesce("pdnp", F.lit(0.0)).alias("reserves"))
    r = R.rollforward(state(o["old"]), state(_at(c["old"], "sec")), "entity_id", moves={"ok": "reactivated", "short_history": "reactivated"}, rest="removed", fresh="new_shut_in")
    return r.withColumn("value", rnd("value", 2))


# ------------------------------------------------------------------ categories report and disclosure
@query("proved_categories", sql=with_ctes(ev_sql("c", CLOSE, SEC26), pud_sql("c", CLOSE, "pc"), """
x AS (SELECT unit_id, 'PDP' AS category, sum(reserves) AS v, sum(n_items)::BIGINT AS n FROM c_comp GROUP BY 1 UNION ALL SELECT unit_id, 'PDNP', sum(coalesce(pdnp,0)), count(*) FILTER (WHERE pdnp_status='booked') FROM c_old GROUP BY 1
 UNION ALL SELECT unit_id, 'PUD', sum(reserves), count(*) FILTER (WHERE status='booked') FROM pc GROUP BY 1)""", select="""
SELECT coalesce(unit_id,'ALL') AS unit_id, category, round(sum(v),1) AS reserves, sum(n)::BIGINT AS n_items, round(100*sum(v)/nullif(sum(sum(v)) OVER (PARTITION BY unit_id),0),3) AS share_pct FROM x GROUP BY GROUPING SETS ((unit_id, category),(category))"""))
def proved_categories(spark, sf):
    from pyspark.sql import Window
    c = evaluated(spark, sf, "close")
    pdp = _at(c["components"], "sec").groupBy("unit_id").agg(F.lit("PDP").alias("category"), F.sum("reserves").alias("v"), F.sum("n_items").alias("n"))
    pdnp = _at(c["old"], "sec").groupBy("unit_id").agg(F.lit("PDNP").alias("category"), F.sum(F.coalesce("pdnp", F.lit(0.0))).alias("v"), F.sum((F.coalesce("pdnp_status", F.lit("")) == "booked").cast("long")).alias("n"))
    pud = planned(spark, sf, CLOSE, SEC26).groupBy("unit_id").agg(F.lit("PUD").alias("category"), F.sum("reserves").alias("v"), F.sum((F.col("status") == "booked").cast("long")).alias("n"))
    x = pdp.unionByName(pdnp).unionByName(pud)
    g = x.groupingSets([[F.col("unit_id"), F.col("category")], [F.col("category")]], F.col("unit_id"), F.col("category")).agg(F.sum("v").alias("v"), F.sum("n").alias("n_items"))
    tot = F.sum("v").over(Window.partitionBy("unit_id"))
    return g.select(F.coalesce("unit_id", F.lit("ALL")).alias("unit_id"), "category", rnd("v", 1).alias("reserves"), "n_items", rnd(100 * F.col("v") / F.nullif(tot, F.lit(0.0)), 3).alias("share_pct"))


STATUS_ORDER = ("booked", "not_certain", "uneconomic", "no_type_curve", "beyond_5yr", "expired_5yr", "not_booked_yet", "cancelled", "drilled")


@query("planned_listing", sql=with_ctes(ev_sql("c", CLOSE, SEC26), pud_sql("c", CLOSE, "pc"), select=f"""
SELECT location_id, unit_id, status, deadline_mi, CASE WHEN status='booked' AND years_to_deadline <= 1 THEN 'deadline within a year' WHEN status='booked' AND planned_mi < {CLOSE} THEN 'planned date passed' END AS warning
FROM pc ORDER BY list_position({list(STATUS_ORDER)!r}, status), deadline_mi, location_id"""))
def planned_listing(spark, sf):
    p = planned(spark, sf, CLOSE, SEC26)
    booked = F.col("status") == "booked"
    warn = F.when(booked & (F.col("years_to_deadline") <= 1), "deadline within a year").when(booked & (F.col("planned_mi") < CLOSE), "planned date passed")
    order = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    return p.select("location_id", "unit_id", "status", "deadline_mi", warn.alias("warning"), order.alias("_o")).orderBy("_o", "deadline_mi", "location_id").drop("_o")


@query("planned_disclosure", sql=with_ctes(ev_sql("o", OPEN, SEC25), ev_sql("c", CLOSE, SEC26), pud_sql("o", OPEN, "po"), pud_sql("c", CLOSE, "pc"), """
j AS (SELECT o.*, c.status AS cs FROM po o JOIN pc c USING (location_id) WHERE o.status='booked')""", select=f"""
SELECT 'a' AS section, 'closing_volume' AS fact, round(sum(reserves),1) AS value FROM pc UNION ALL SELECT 'a', 'booked_locations', count(*)::DOUBLE FROM pc WHERE status='booked'
UNION ALL SELECT 'b', 'opening_volume', round(coalesce(sum(reserves),0),1) FROM po UNION ALL SELECT 'b', 'converted', round(coalesce(sum(reserves) FILTER (WHERE cs='drilled'),0),1) FROM j UNION ALL SELECT 'b', 'expired', round(coalesce(sum(reserves) FILTER (WHERE cs='expired_5yr'),0),1) FROM j
UNION ALL SELECT 'c', 'converted_capex', round(coalesce(sum(capex) FILTER (WHERE cs='drilled'),0),1) FROM j UNION ALL SELECT 'c', 'planned_next_12', count(*)::DOUBLE FROM pc WHERE status='booked' AND planned_mi <= {CLOSE + 12}
UNION ALL SELECT 'c', 'capex_next_12', round(coalesce(sum(capex),0),1) FROM pc WHERE status='booked' AND planned_mi <= {CLOSE + 12}
UNION ALL SELECT 'd', 'undeveloped_5_years', count(*)::DOUBLE FROM pc WHERE status='booked' AND ({CLOSE}-coalesce(first_booked_mi,{CLOSE}))/12.0 >= 5 UNION ALL SELECT 'd', 'near_deadline', count(*)::DOUBLE FROM pc WHERE status='booked' AND years_to_deadline <= 1"""))
def planned_disclosure(spark, sf):
    """Facts of the four disclosure paragraphs (a)–(d)."""
    o, c = planned(spark, sf, OPEN, SEC25), materialise(planned(spark, sf, CLOSE, SEC26))
    b = c.where("status = 'booked'")
    z = F.lit(0.0)
    j = o.select("location_id", "status", "reserves", "capex").where("status = 'booked'").join(c.select("location_id", F.col("status").alias("cs")), "location_id")
    soon, old = F.col("planned_mi") <= CLOSE + 12, (CLOSE - F.coalesce("first_booked_mi", F.lit(CLOSE))) / 12.0 >= 5
    def facts(df, section, items):
        cols = [v.cast("double").alias(k) for k, v in items.items()]
        st = ", ".join(f"'{k}', {k}" for k in items)
        return df.agg(*cols).select(F.lit(section).alias("section"), F.expr(f"stack({len(items)}, {st}) as (fact, value)"))
    def total(cond, x):
        return F.coalesce(F.sum(F.when(cond, F.col(x))), z)
    parts = [facts(b, "a", {"closing_volume": F.coalesce(F.sum("reserves"), z), "booked_locations": F.count(F.lit(1))}),
             facts(j, "b", {"opening_volume": F.coalesce(F.sum("reserves"), z), "converted": total(F.col("cs") == "drilled", "reserves"), "expired": total(F.col("cs") == "expired_5yr", "reserves")}),
             facts(j, "c", {"converted_capex": total(F.col("cs") == "drilled", "capex")}),
             facts(b, "c", {"planned_next_12": F.sum(soon.cast("int")), "capex_next_12": total(soon, "capex")}),
             facts(b, "d", {"undeveloped_5_years": F.sum(old.cast("int")), "near_deadline": F.sum((F.col("years_to_deadline") <= 1).cast("int"))})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.coalesce(rnd("value", 1), z))


# ------------------------------------------------------------------ sensitivity
GRID = R.perturbations()
PT_SQL = "pt(param, x, role) AS (VALUES " + ", ".join(f"('{p}', {x!r}::DOUBLE, '{r}')" for p, x, r in GRID) + ")"
SENS = [*ev_sql("c", CLOSE, SEC26), PT_SQL, """
pe AS (SELECT u.unit_id, param || '|' || x || '|' || role AS scenario, param, x, role, opex_month*CASE WHEN param='opex' THEN 1+x ELSE 1 END/greatest((price*CASE WHEN param='price' THEN 1+x ELSE 1 END-4.5)*(1-0.28::DOUBLE)*7.3*30.4,1e-9) AS q_econ,
  CASE WHEN param='rate' THEN 1+x ELSE 1 END AS rf, CASE WHEN param='decline' THEN x/100 ELSE 0 END AS dd FROM c_econ u, pt)""", """
of AS (SELECT e.entity_id, p.scenario, p.q_econ, e.now_eff, e.fit_start, b_qi*rf AS qi, CASE WHEN dd=0 THEN b_di ELSE greatest(b_di+dd/12,1e-5) END AS di, b_b AS b, CASE WHEN b_dmin > 0 AND dd<>0 THEN greatest(b_dmin+dd/12,1e-5) ELSE b_dmin END AS d_min, 'arps' AS model
  FROM c_ej e JOIN c_oh h ON h.entity_id=e.entity_id AND h.prod JOIN pe p ON p.unit_id=h.unit_id)""",
    *remaining_ctes("of", "orr", "entity_id", "f.q_econ", "f.now_eff-f.fit_start", keep=", scenario, q_econ, now_eff, fit_start"), """
ninfo AS (SELECT entity_id, unit_id, fmi FROM c_nw UNION ALL SELECT entity_id, unit_id, fmi FROM c_sh)""", """
nrows AS (SELECT * FROM c_nr UNION ALL SELECT * FROM c_sr)""",
    *[x.replace("{econ}", "pe").replace("{tp}", "c_tp") for x in new_ctes("sx", "nrows", "ninfo", CLOSE, CFG)],
    """tot AS (SELECT unit_id, scenario, sum(v) AS v FROM (SELECT h.unit_id, o.scenario, o.remaining AS v FROM orr o JOIN c_oh h USING (entity_id) UNION ALL SELECT unit_id, scenario, coalesce(reserves,0) FROM sx) GROUP BY ALL)""", """
tt AS (SELECT p.unit_id, p.param, p.x, p.role, coalesce(t.v,0) AS v FROM pe p LEFT JOIN tot t USING (unit_id, scenario))"""]


def _usable(m, short, new_ids):
    """Months of the short series up to their cutoff, and all months of the new entities.

    Written once: Spark takes a union of two dealt halves for one dealing, and a merge join over it failed where their partitions were not as many as the other side's.
    """
    rows = m.join(short.hint("merge"), "entity_id").where(F.col("cutoff").isNull() | (F.col("mi") < F.col("cutoff"))).select("entity_id", "mi", "oil")
    return materialise(rows.unionByName(m.join(new_ids.hint("merge"), "entity_id", "left_semi").select("entity_id", "mi", "oil")))


def sensitivity_totals(spark, sf):
    """Best-estimate volume of fitted, analog and new entities at every perturbation point, one pass."""
    c = evaluated(spark, sf, "close")
    econ = labelled(limits(spark, c["acc"]), SEC26)
    d = E.DECKS[0]
    def limit(pf, of):
        net = (F.col("price") * pf - d[4]) * (1 - d[5]) * d[6]
        return F.col("opex_month") * of / F.greatest(net * 30.4, F.lit(1e-9))
    pts = R.with_perturbations(econ.select("unit_id", "price", "opex_month"), GRID, limit)
    pts = pts.withColumn("scenario", F.concat_ws("|", "param", F.col("x").cast("string"), "role"))
    old = _at(c["old"], "sec")
    fitted = R.perturbed_old(old.where("status = 'ok'").select("entity_id", "unit_id", "best", "low", "fit_start", "now_eff"),
                             pts.select("unit_id", "param", "x", "role", "q_econ", "rate_factor", "decline_delta"))
    short = old.where("status = 'short_history'").select("entity_id", "cutoff")
    m = c["m"].where(F.col("mi") <= CLOSE)
    new_ids = _at(c["new"], "sec").select("entity_id")
    rows = _usable(m, short, new_ids)
    info = c["acc"].join(short.select("entity_id").unionByName(new_ids).hint("merge"), "entity_id", "left_semi").select("entity_id", "unit_id", "fmi")
    alt = U.new_entity_reserves(rows, info, c["curves"], pts.select("unit_id", "scenario", "q_econ"), CLOSE, CFG)
    alt = alt.groupBy("unit_id", "scenario").agg(F.sum(F.coalesce("reserves", F.lit(0.0))).alias("_a"))
    j = pts.select("unit_id", "scenario", "param", "x", "role").join(fitted, ["unit_id", "param", "x", "role"], "left").join(alt, ["unit_id", "scenario"], "left")
    return j.select("unit_id", "param", "x", "role", (F.coalesce("v", F.lit(0.0)) + F.coalesce("_a", F.lit(0.0))).alias("v"))


@query("sensitivity_curves", sql=with_ctes(SENS, select="SELECT t.unit_id, t.param, t.x, round(t.v-b.v,2) AS delta FROM tt t JOIN tt b ON b.unit_id=t.unit_id AND b.role='base' WHERE t.role='curve'"))
def sensitivity_curves(spark, sf):
    return R.sensitivity_curves(materialise(sensitivity_totals(spark, sf))).withColumn("delta", rnd("delta", 2))


@query("sensitivity_weights", sql=with_ctes(SENS, """
sw AS (SELECT unit_id, param, abs(arg_max(v,x)-arg_min(v,x)) AS swing FROM tt WHERE role='swing' GROUP BY ALL)""",
       select="SELECT unit_id, param, round(swing,2) AS swing, round(swing/CASE WHEN sum(swing) OVER (PARTITION BY unit_id)=0 THEN 1 ELSE sum(swing) OVER (PARTITION BY unit_id) END,5) AS weight FROM sw"))
def sensitivity_weights(spark, sf):
    return R.sensitivity_weights(sensitivity_totals(spark, sf)).select("unit_id", "param", rnd("swing", 2).alias("swing"), rnd("weight", 5).alias("weight"))


# ------------------------------------------------------------------ finance
FIN_SQL = ["""bk AS (SELECT unit_id, CASE WHEN k=0 THEN 300.0::DOUBLE+100*(length(unit_id)%7) END AS opening_nbv, k FROM (SELECT DISTINCT unit_id FROM acc), range(2) r(k))""", f"""
cx AS (SELECT unit_id, count(*) FILTER (WHERE fmi BETWEEN {OPEN - 11} AND {OPEN})*4.0::DOUBLE AS c0, count(*) FILTER (WHERE fmi BETWEEN {CLOSE - 11} AND {CLOSE})*4.0::DOUBLE AS c1 FROM acc GROUP BY 1)""", f"""
rc AS (SELECT unit_id, k, sum(oil)/3.0 AS monthly, count(*) FILTER (WHERE days_on>0)/3.0 AS wm FROM am JOIN acc USING (entity_id), range(2) r(k) WHERE mi BETWEEN CASE WHEN k=0 THEN {OPEN} ELSE {CLOSE} END-2 AND CASE WHEN k=0 THEN {OPEN} ELSE {CLOSE} END GROUP BY ALL)""", """
pdv AS (SELECT unit_id, 0 AS k, sum(v) AS pd FROM (SELECT unit_id, reserves AS v FROM o_comp UNION ALL SELECT unit_id, coalesce(pdnp,0) FROM o_old) GROUP BY 1 UNION ALL SELECT unit_id, 1, sum(v) FROM (SELECT unit_id, reserves AS v FROM c_comp WHERE scenario='sec' UNION ALL SELECT unit_id, coalesce(pdnp,0) FROM c_old WHERE scenario='sec') GROUP BY 1)""", """
prd AS (SELECT unit_id, 0 AS k, sum(production) AS production FROM o_prod GROUP BY 1 UNION ALL SELECT unit_id, 1, sum(production) FROM c_prod GROUP BY 1)""", """
ec2 AS (SELECT unit_id, 0 AS k, net_t, opex_month FROM o_econ UNION ALL SELECT unit_id, 1, net_t, opex_month FROM c_econ WHERE scenario='sec')""", """
fi AS (SELECT bk.unit_id, bk.k, opening_nbv, CASE WHEN bk.k=0 THEN c0 ELSE c1 END AS capex, coalesce(production,0) AS production, coalesce(pd,0) AS pd, coalesce(monthly,0) AS monthly, net_t, CASE WHEN monthly > 0 THEN wm*opex_month/monthly ELSE 0 END AS opex_t FROM bk JOIN cx USING (unit_id)
  LEFT JOIN prd USING (unit_id, k) LEFT JOIN pdv USING (unit_id, k) LEFT JOIN rc USING (unit_id, k) JOIN ec2 USING (unit_id, k))""", """
fr2 AS (SELECT *, CASE WHEN pd > 0 AND monthly > 0 THEN least(monthly, pd*0.999) END AS q0 FROM fi)""", """
fv AS (SELECT *, -ln(1-q0/pd) AS d FROM fr2)""", """
fw AS (SELECT *, coalesce(greatest(net_t-opex_t,0)*q0/(1-exp(-d)*pow(1.1::DOUBLE,-1.0/12))*7.1/1e4,0) AS recoverable, CASE WHEN pd+production > 0 THEN production/(pd+production) END AS rate FROM fv)""", """
ch AS (SELECT a.*, opening_nbv AS op, least((opening_nbv+capex)*(1-coalesce(rate,0)), recoverable) AS cl FROM fw a WHERE k=0)""", """
fc2 AS (SELECT unit_id, k, op, capex, production, pd, recoverable, rate, d FROM ch UNION ALL SELECT f.unit_id, f.k, ch.cl, f.capex, f.production, f.pd, f.recoverable, f.rate, f.d FROM fw f JOIN ch USING (unit_id) WHERE f.k=1)"""]


def _finance_rows(spark, sf):
    o, c = evaluated(spark, sf, "open"), evaluated(spark, sf, "close")
    acc, m = c["acc"], c["m"]
    lim = limits(spark, acc)
    out = None
    for k, (as_of, ev, rows) in enumerate(((OPEN, o, SEC25), (CLOSE, c, SEC26))):
        units = acc.groupBy("unit_id").agg((F.sum(F.col("fmi").between(as_of - 11, as_of).cast("int")) * 4.0).alias("capex"))
        pd_ = _at(ev["components"], "sec").select("unit_id", "reserves").unionByName(_at(ev["old"], "sec").select("unit_id", F.coalesce("pdnp", F.lit(0.0)).alias("reserves")))
        pd_ = pd_.groupBy("unit_id").agg(F.sum("reserves").alias("pd_reserves"))
        prod = ev["production"].groupBy("unit_id").agg(F.sum("production").alias("production"))
        rec = m.where(F.col("mi").between(as_of - 2, as_of)).join(acc.select("entity_id", "unit_id").hint("merge"), "entity_id").groupBy("unit_id").agg(
            (F.sum("oil") / 3.0).alias("monthly"), (F.sum((F.col("days_on") > 0).cast("int")) / 3.0).alias("wm"))
        j = units.join(pd_, "unit_id", "left").join(prod, "unit_id", "left").join(rec, "unit_id", "left").na.fill(0.0).join(
            labelled(lim, rows).select("unit_id", "net_t", "opex_month"), "unit_id")
        j = j.withColumn("opex_t", F.when(F.col("monthly") > 0, F.col("wm") * F.col("opex_month") / F.col("monthly")).otherwise(0.0))
        j = j.withColumn("as_of", F.lit(k)).withColumn("opening_nbv", F.lit(None).cast("double") if k else 300.0 + 100 * (F.length("unit_id") % 7))
        out = j if out is None else out.unionByName(j)
    return N.recoverable(out, reserves="pd_reserves", monthly="monthly", net="net_t", opex_t="opex_t", discount=E.DISCOUNT, fx=E.FX)


@query("recoverable_amount", sql=with_ctes(OC, FIN_SQL, select="SELECT unit_id, k::INTEGER AS as_of, round(net_t-opex_t,4) AS cash_per_t, round(d,6) AS decline_month, round(recoverable,3) AS recoverable FROM fw"))
def recoverable_amount(spark, sf):
    return _finance_rows(spark, sf).select("unit_id", "as_of", rnd("cash_per_t").alias("cash_per_t"), rnd("decline_month", 6).alias("decline_month"), rnd("recoverable", 3).alias("recoverable"))


@query("depletion_impairment", sql=with_ctes(OC, FIN_SQL, select="""
SELECT unit_id, k::INTEGER AS as_of, round(op,3) AS opening_used, round(coalesce((op+capex)*rate,0),3) AS depletion, round((op+capex)*(1-coalesce(rate,0)),3) AS carrying, round(greatest((op+capex)*(1-coalesce(rate,0))-recoverable,0),3) AS impairment,
 round(least((op+capex)*(1-coalesce(rate,0)),recoverable),3) AS closing_nbv, (op+capex)*(1-coalesce(rate,0)) > recoverable AS impaired FROM fc2"""))
def depletion_impairment(spark, sf):
    f = _finance_rows(spark, sf).select("unit_id", "as_of", "opening_nbv", "capex", "production", "pd_reserves", "recoverable")
    d = N.depletion_chain(f)
    return d.select("unit_id", "as_of", *[rnd(x, 3).alias(x) for x in ("opening_used", "depletion", "carrying", "impairment", "closing_nbv")], "impaired")


def sm_ctes(tag, p, k, price="sec"):
    """Yearly cash flow ``yt{tag}`` of one date (k: 0 opening, 1 closing), valued at the prices of one scenario of its evaluation."""
    pud, now = "po" if k == 0 else "pc", OPEN if k == 0 else CLOSE
    return [*pud_sql(p, now, pud), f"""
pw{tag} AS (SELECT unit_id, list(CASE WHEN alive=1 THEN r ELSE 0 END*30.4 ORDER BY j) AS vols FROM (SELECT *, min(CASE WHEN j < kp OR r >= q_econ THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id, scenario ORDER BY j) AS alive FROM {pud}_f JOIN {pud}_k USING (unit_id, scenario)) WHERE scenario='sec' AND alive=1 GROUP BY 1)""", f"""
bl{tag} AS (SELECT location_id, p.unit_id, greatest(planned_mi-{now},0)+1 AS s, capex, vols FROM {pud} p JOIN pw{tag} USING (unit_id) WHERE status='booked' AND scenario='sec')""", f"""
nb2{tag} AS (SELECT unit_id, count(*) FILTER (WHERE pdnp_status='booked')*15.0::DOUBLE AS dev0 FROM {p}_old WHERE scenario='sec' GROUP BY 1)""", f"""
fx2{tag} AS (SELECT f.* EXCLUDE (net_t, opex_t), e.net_t, f.opex_t*e.opex_month/b.opex_month AS opex_t, e.opex_month, coalesce(n.dev0,0) AS dev0 FROM fv f JOIN {p}_econ e ON e.unit_id=f.unit_id AND e.scenario='{price}' JOIN {p}_econ b ON b.unit_id=f.unit_id AND b.scenario='sec' LEFT JOIN nb2{tag} n ON n.unit_id=f.unit_id WHERE k={k})""", f"""
sch{tag} AS (SELECT unit_id, m, sum(v) AS v, sum(inf) AS inf, sum(pc) AS pc, sum(dc) AS dc FROM (
 SELECT unit_id, m, coalesce(q0*exp(-d*m),0) AS v, coalesce(q0*exp(-d*m),0)*net_t*7.1/1e4 AS inf, coalesce(q0*exp(-d*m),0)*opex_t*7.1/1e4 AS pc, CASE WHEN m=0 THEN dev0 ELSE 0 END AS dc FROM fx2{tag}, range(600) r(m)
 UNION ALL SELECT b.unit_id, s+i-1, vols[i], vols[i]*net_t*7.1/1e4, CASE WHEN vols[i]>0 THEN opex_month*7.1/1e4 ELSE 0 END, 0 FROM (SELECT *, unnest(range(1,len(vols)+1)) AS i FROM bl{tag} WHERE s < 600) b JOIN fx2{tag} f ON f.unit_id=b.unit_id WHERE s+i-1 < 600
 UNION ALL SELECT unit_id, greatest(s-1,0), 0, 0, 0, capex FROM bl{tag} WHERE s < 600) GROUP BY ALL)""", f"""
yr{tag} AS (SELECT * FROM (SELECT *, max(CASE WHEN v>1e-9 OR dc>0 THEN y END) OVER (PARTITION BY unit_id) AS ly FROM (SELECT unit_id, m//12 AS y, sum(v) AS v, sum(inf) AS inf, sum(pc) AS pc, sum(dc) AS dc FROM sch{tag} GROUP BY ALL)) WHERE y <= ly)""", f"""
yt{tag} AS (SELECT *, .25::DOUBLE*greatest(inf-pc-dc,0) AS tax, pow(1.1::DOUBLE,-(y+0.5)) AS f, sum(v) OVER (PARTITION BY unit_id ORDER BY y) AS cv, sum(v) OVER (PARTITION BY unit_id) AS tv FROM yr{tag})"""]


SM_SQL = sm_ctes("", "c", 1)


def _measure(spark, sf, k=1, value=None):
    """Yearly cash flow of the opening (0) or closing (1) quantities, valued at their own prices or at those of ``value``."""
    as_of, which, rows = ((OPEN, "open", SEC25), (CLOSE, "close", SEC26))[k]
    c = evaluated(spark, sf, which)
    prices = labelled(limits(spark, c["acc"]), value or rows).select("unit_id", "net_t", "opex_month")
    d = _finance_rows(spark, sf).where(F.col("as_of") == k).drop("net_t", "opex_month", "opex_t").join(prices, "unit_id")
    d = d.withColumn("opex_t", F.when(F.col("monthly") > 0, F.col("wm") * F.col("opex_month") / F.col("monthly")).otherwise(0.0))
    n = _at(c["old"], "sec").groupBy("unit_id").agg((F.sum((F.coalesce("pdnp_status", F.lit("")) == "booked").cast("int")) * E.RESTART_COST).alias("development_now"))
    dev = d.join(n, "unit_id", "left").select("unit_id", F.col("pd_reserves").alias("reserves"), "monthly", "opex_t", F.col("net_t").alias("net"), F.coalesce("development_now", F.lit(0.0)).alias("development_now"))
    p = planned(spark, sf, as_of, rows).where("status = 'booked'")
    j = p.select("location_id", "unit_id", "planned_mi", "capex", "n_months").join(c["curves"].join(prices, "unit_id"), "unit_id")
    vols = F.transform(F.sequence(F.lit(1), F.col("n_months").cast("int")), lambda i: U.analog_rate(i, F.lit(0), F.lit(CFG.certainty)) * 30.4)
    pl = j.select("unit_id", (F.greatest(F.col("planned_mi") - as_of, F.lit(0)) + 1).alias("start_month"), vols.alias("volumes"), "capex", "opex_month", F.col("net_t").alias("net"))
    return N.annual_measure(N.cash_flow(dev, pl, fx=E.FX), tax=E.TAX)


@query("annual_cash_flow", sql=with_ctes(OC, FIN_SQL, SM_SQL, select="""
SELECT unit_id, y::INTEGER AS year, round(v,2) AS volume, round(inf,3) AS inflow, round(pc,3) AS production_cost, round(dc,3) AS development_cost, round(tax,3) AS income_tax, round((inf-pc-dc-tax)*f,3) AS discounted FROM yt"""))
def annual_cash_flow(spark, sf):
    a = _measure(spark, sf)
    return a.select("unit_id", "year", rnd("volume", 2).alias("volume"), rnd("inflow", 3).alias("inflow"), rnd("production_cost", 3).alias("production_cost"), rnd("development_cost", 3).alias("development_cost"),
                    rnd("income_tax", 3).alias("income_tax"), rnd(F.col("net_cash") * F.col("factor"), 3).alias("discounted"))


@query("standardized_measure", sql=with_ctes(OC, FIN_SQL, SM_SQL, select="""
SELECT unit_id, round(sum(v),2) AS volume, round(sum(inf),3) AS inflow, round(sum(dc),3) AS development_cost, round(sum(tax),3) AS income_tax, round(sum((inf-pc-dc-tax)*f),3) AS standardized_measure, round(sum((inf-pc-dc)*f),3) AS pre_tax_discounted,
 round(sum(tax*f),3) AS discounted_tax, greatest(coalesce(min(CASE WHEN tv>0 AND cv >= .995*tv THEN y+1 END),0), coalesce(max(CASE WHEN dc>0 THEN y+1 END),0))::BIGINT AS life_years FROM yt GROUP BY 1"""))
def standardized_measure(spark, sf):
    s = N.standardized_measure(_measure(spark, sf))
    return s.select("unit_id", rnd("volume", 2).alias("volume"), *[rnd(x, 3).alias(x) for x in ("inflow", "development_cost", "income_tax", "standardized_measure", "pre_tax_discounted", "discounted_tax")], "life_years")


def _sums_sql(name, tag):
    return f"{name} AS (SELECT unit_id, sum((inf-pc-dc-tax)*f) AS sm, sum((inf-pc-dc)*f) AS pre, sum(tax*f) AS taxd FROM yt{tag} GROUP BY 1)"


@query("measure_changes", sql=with_ctes(OC, FIN_SQL, sm_ctes("_o", "o", 0), sm_ctes("_c", "c", 1), sm_ctes("_r", "c", 1, "opening_price"), _sums_sql("mo", "_o"), _sums_sql("mc", "_c"), _sums_sql("mr", "_r"), """
mv2 AS (SELECT f.unit_id, coalesce(o.sm,0) AS opening, -production*(net_t-opex_t)*7.1/1e4 AS sales_net, coalesce(c.pre,0)-coalesce(r.pre,0) AS price_cost, capex AS development_incurred, 0.1::DOUBLE*coalesce(o.pre,0) AS accretion,
 -(coalesce(c.taxd,0)-coalesce(o.taxd,0)) AS income_tax, coalesce(c.sm,0) AS closing FROM fv f LEFT JOIN mo o USING (unit_id) LEFT JOIN mc c USING (unit_id) LEFT JOIN mr r USING (unit_id) WHERE k=1)""", """
mq AS (SELECT *, closing-opening-sales_net-price_cost-development_incurred-accretion-income_tax AS quantity_other FROM mv2)""", """
ml AS (SELECT split_part(unit_id,'/',1) AS plant, unit_id, unnest([{'k':'opening','v':opening},{'k':'sales_net','v':sales_net},{'k':'price_cost','v':price_cost},{'k':'development_incurred','v':development_incurred},{'k':'accretion','v':accretion},{'k':'income_tax','v':income_tax},
 {'k':'quantity_other','v':quantity_other},{'k':'closing','v':closing}]) AS x FROM mq)""", select="""
SELECT CASE WHEN grouping(unit_id)=0 THEN unit_id WHEN grouping(plant)=0 THEN plant ELSE 'ALL' END AS scope, x.k AS item, round(sum(x.v),1) AS value FROM ml GROUP BY GROUPING SETS ((plant, unit_id, x.k), (plant, x.k), (x.k))""".replace("x.k", "k").replace("x.v", "v").replace("FROM ml", "FROM (SELECT plant, unit_id, x.k AS k, x.v AS v FROM ml)")))
def measure_changes(spark, sf):
    """Why the standardized measure moved between the two dates, per unit, plant and in total; opening and all lines add up to closing."""
    sums = [materialise(N.standardized_measure(_measure(spark, sf, k, value)).select("unit_id", "standardized_measure", "pre_tax_discounted", "discounted_tax")) for k, value in ((0, None), (1, None), (1, SEC25))]
    f = _finance_rows(spark, sf).where("as_of = 1").select("unit_id", "production", F.col("net_t").alias("net"), "opex_t", "capex")
    return N.measure_changes(*sums, f, fx=E.FX).withColumn("value", rnd("value", 1))


# ------------------------------------------------------------------ indicators
PLAN_SQL = f"""pln AS (SELECT unit_id, sum(o_totalprice)/10000 AS plan_production, sum(o_totalprice) FILTER (WHERE fmi >= {CLOSE - 11})/10000 AS plan_new_oil FROM orders JOIN acc ON entity_id=o_custkey WHERE {S.mi('o_orderdate')} BETWEEN {CLOSE - 11} AND {CLOSE} GROUP BY 1)"""
IND_SQL = [*ev_sql("c", CLOSE, SEC26), *comp_sql(CLOSE - 11, CLOSE - 11, CLOSE), PLAN_SQL, f"""
dc AS (SELECT unit_id, CASE WHEN count(*) FILTER (WHERE old_base>0)>=6 THEN (1-exp(12*regr_slope(ln(old_base/{S.dim('mi')}),mi) FILTER (WHERE old_base>0)))*100 END AS nat,
  CASE WHEN count(*) FILTER (WHERE old_base+measure_inc>0)>=6 THEN (1-exp(12*regr_slope(ln((old_base+measure_inc)/{S.dim('mi')}),mi) FILTER (WHERE old_base+measure_inc>0)))*100 END AS com, sum(new_oil) AS new_oil, sum(total_oil) AS production FROM cmi GROUP BY 1)""", f"""
wc AS (SELECT unit_id, sum(water) FILTER (WHERE mi>{CLOSE - 3})*100/nullif(sum(water+oil/.85::DOUBLE) FILTER (WHERE mi>{CLOSE - 3}),0) AS wc, sum(water) FILTER (WHERE mi BETWEEN {CLOSE - 14} AND {CLOSE - 12})*100/nullif(sum(water+oil/.85::DOUBLE) FILTER (WHERE mi BETWEEN {CLOSE - 14} AND {CLOSE - 12}),0) AS wp,
  count(*) FILTER (WHERE days_on>0 AND mi>{CLOSE - 12}) AS wm, count(*) FILTER (WHERE days_on>0 AND mi={CLOSE}) AS np FROM am JOIN acc USING (entity_id) WHERE mi <= {CLOSE} GROUP BY 1)""", f"""
iw AS (SELECT u.unit_id, nat AS natural_decline_pct, com AS comprehensive_decline_pct, wc AS water_cut_pct, wc-wp AS water_cut_rise_pct, np*100.0::DOUBLE/n AS open_well_rate_pct, ne*100.0::DOUBLE/nullif(nv,0) AS measure_effective_rate_pct, pdp/production AS reserve_production_ratio,
  production*100/plan_production AS production_plan_attainment_pct, new_oil*100/plan_new_oil AS new_well_plan_attainment_pct, wm*opex_month/production AS opex_usd_per_t, net_t AS net_revenue_usd_per_t, net_t-wm*opex_month/production AS profit_usd_per_t
  FROM (SELECT unit_id, count(*) FILTER (WHERE fmi <= {CLOSE}) AS n FROM acc GROUP BY 1) u JOIN dc USING (unit_id) JOIN wc USING (unit_id) LEFT JOIN pln USING (unit_id) JOIN c_econ USING (unit_id) JOIN (SELECT unit_id, sum(reserves) AS pdp FROM c_comp GROUP BY 1) USING (unit_id)
  LEFT JOIN (SELECT unit_id, count(*) AS nv, count(*) FILTER (WHERE realized>0) AS ne FROM c_done GROUP BY 1) USING (unit_id))""", """
il AS (SELECT unit_id, indicator, value FROM iw UNPIVOT INCLUDE NULLS (value FOR indicator IN (""" + ", ".join(I.INDICATORS) + ")))"]
ANC_SQL = "anc(indicator, grp, good, bad, weight) AS (VALUES " + ", ".join(f"('{a}','{g}',{x}::DOUBLE,{y}::DOUBLE,{w}::DOUBLE)" for a, g, x, y, w in I.ANCHORS) + ")"
WF_SQL = "wfl(indicator, g2, b2) AS (VALUES " + ", ".join(f"('{a}',{x}::DOUBLE,{y}::DOUBLE)" for a, x, y in I.WATERFLOOD) + ")"
SCO_SQL = "sco AS (SELECT *, CASE WHEN value IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, (value-bad)/(good-bad)*100)) END AS score FROM il JOIN anc USING (indicator))"


def indicator_values(spark, sf):
    digest = source_digest(spark, sf)

    def build():
        c = evaluated(spark, sf, "close")
        m, acc = c["m"].where(F.col("mi") <= CLOSE), c["acc"]
        start = CLOSE - 11
        comp = materialise(U.monthly_composition(m, acc, U.measure_increments(m, c["measures"]), since=start, start=start, end=CLOSE))
        comp = comp.withColumn("n_rate", F.col("old_base") / days_in_month("mi")).withColumn("c_rate", (F.col("old_base") + F.col("measure_inc")) / days_in_month("mi"))
        nat = A.loglinear_decline(comp, ["unit_id"], x="mi", rate="n_rate", name="natural")
        com = A.loglinear_decline(comp, ["unit_id"], x="mi", rate="c_rate", name="comprehensive")
        tot = comp.groupBy("unit_id").agg(F.sum("total_oil").alias("production"), F.sum("new_oil").alias("new_oil"))
        mu = m.join(acc.select("entity_id", "unit_id").hint("merge"), "entity_id")
        def cut(lo, hi):
            on = F.col("mi").between(lo, hi)
            w = F.sum(F.when(on, F.col("water")))
            return F.try_divide(w * 100, F.sum(F.when(on, F.col("water") + F.col("oil") / E.OIL_DENSITY)))
        wc = mu.groupBy("unit_id").agg(cut(CLOSE - 2, CLOSE).alias("water_cut"), cut(CLOSE - 14, CLOSE - 12).alias("water_cut_prev"),
                                       F.sum(((F.col("days_on") > 0) & (F.col("mi") >= start)).cast("long")).alias("producing_well_months"),
                                       F.sum(((F.col("days_on") > 0) & (F.col("mi") == CLOSE)).cast("long")).alias("n_producing"))
        o = table(spark, sf, "orders").withColumn("mi", F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).where(F.col("mi").between(start, CLOSE))
        plan = o.join(acc.select(F.col("entity_id").alias("o_custkey"), "unit_id", "fmi").hint("merge"), "o_custkey").groupBy("unit_id").agg(
            (F.sum("o_totalprice") / 10000).alias("plan_production"), (F.sum(F.when(F.col("fmi") >= start, F.col("o_totalprice"))) / 10000).alias("plan_new_oil"))
        nw = acc.groupBy("unit_id").agg(F.sum((F.col("fmi") <= CLOSE).cast("long")).alias("n_wells"))
        pdp = _at(c["components"], "sec").groupBy("unit_id").agg(F.sum("reserves").alias("pdp"))
        meas = _at(c["done"], "sec").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_evaluated"), F.sum((F.col("realized") > 0).cast("long")).alias("n_effective"))
        econ = labelled(limits(spark, acc), SEC26).select("unit_id", "net_t", "opex_month")
        j = nw.join(tot, "unit_id").join(nat, "unit_id", "left").join(com, "unit_id", "left").join(wc, "unit_id").join(plan, "unit_id", "left").join(pdp, "unit_id").join(meas, "unit_id", "left").join(econ, "unit_id")
        return {"v": I.compute(j)}

    return snapshot(spark, f"{digest}/indicators", build, ("v",))["v"]


@query("indicators", sql=with_ctes(IND_SQL, select="SELECT unit_id, indicator, round(value,4) AS value FROM il"))
def indicators(spark, sf):
    return I.unpivoted(indicator_values(spark, sf)).withColumn("value", rnd("value"))


def anchors(spark):
    return spark.createDataFrame(I.ANCHORS, I.ANCHOR_SCHEMA)


@query("indicator_scores", sql=with_ctes(IND_SQL, ANC_SQL, SCO_SQL, select="SELECT unit_id, indicator, grp, round(score,3) AS score FROM sco"))
def indicator_scores(spark, sf):
    s = I.score(I.unpivoted(indicator_values(spark, sf)), anchors(spark))
    return s.select("unit_id", "indicator", "grp", rnd("score", 3).alias("score"))


@query("group_scores", sql=with_ctes(IND_SQL, ANC_SQL, SCO_SQL, select="SELECT unit_id, grp, round(sum(score*weight)/sum(weight),3) AS score FROM sco WHERE score IS NOT NULL GROUP BY ALL"))
def group_scores(spark, sf):
    return I.group_scores(I.score(I.unpivoted(indicator_values(spark, sf)), anchors(spark))).withColumn("score", rnd("score", 3))


@query("profile_preview", sql=with_ctes(IND_SQL, ANC_SQL, WF_SQL, """
sc2 AS (SELECT *, CASE WHEN value IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, (value-b2)/(g2-b2)*100)) END AS score FROM il JOIN anc USING (indicator) JOIN wfl USING (indicator))""",
       select="SELECT unit_id, grp, round(sum(score*weight)/sum(weight),3) AS score FROM sc2 WHERE score IS NOT NULL GROUP BY ALL"))
def profile_preview(spark, sf):
    """Group scores under another profile: overlay of its anchors on the base set."""
    over = spark.createDataFrame(I.WATERFLOOD, "indicator string, good double, bad double")
    return I.group_scores(I.score(I.unpivoted(indicator_values(spark, sf)), I.overlay(anchors(spark), over))).withColumn("score", rnd("score", 3))


# ------------------------------------------------------------------ records, report rows, derived business inputs
@query("evaluation_records", sql=with_ctes(ev_sql("c", CLOSE, ALL26), select="""
SELECT unit_id, scenario, coalesce(component,'total') AS component, round(sum(reserves),1) AS reserves, sum(n_items)::BIGINT AS n_items FROM c_comp GROUP BY GROUPING SETS ((unit_id, scenario, component),(unit_id, scenario))"""))
def evaluation_records(spark, sf):
    c = evaluated(spark, sf, "prices")["components"]
    k = [F.col("unit_id"), F.col("scenario"), F.col("component")]
    g = c.groupingSets([k, k[:2]], *k).agg(F.sum("reserves").alias("reserves"), F.sum("n_items").alias("n_items"))
    return g.select("unit_id", "scenario", F.coalesce("component", F.lit("total")).alias("component"), rnd("reserves", 1).alias("reserves"), "n_items")


@query("report_rows", sql=with_ctes(ev_sql("c", CLOSE, ALL26), select="""
SELECT 'composition' AS section, unit_id AS item, round(sum(reserves),1) AS value FROM c_comp WHERE scenario='sec' GROUP BY unit_id UNION ALL SELECT 'scenario', scenario, round(sum(reserves),1) FROM c_comp GROUP BY scenario UNION ALL SELECT 'component', component, round(sum(reserves),1) FROM c_comp WHERE scenario='sec' GROUP BY component"""))
def report_rows(spark, sf):
    """Section frames of the report stacked into one long table."""
    c = evaluated(spark, sf, "prices")["components"]
    sec = c.where("scenario = 'sec'")
    def part(df, section, key):
        return df.groupBy(F.col(key).alias("item")).agg(rnd(F.sum("reserves"), 1).alias("value")).select(F.lit(section).alias("section"), "item", "value")
    return part(sec, "composition", "unit_id").unionByName(part(c, "scenario", "scenario")).unionByName(part(sec, "component", "component"))


@query("asset_book", sql=with_ctes(ev_sql("c", CLOSE, SEC26), select=f"""
SELECT a.unit_id, round(coalesce(o.nbv,0),2) AS opening_nbv, round((coalesce(n.capex,0)+coalesce(e.cost,0))::DOUBLE,2) AS additions FROM (SELECT DISTINCT unit_id FROM acc) a
LEFT JOIN (SELECT unit_id, sum(CASE WHEN x > 5000 THEN 450.0 ELSE 400.0 END*greatest(0.1,least(1.0,1-({CLOSE - 11}-fmi)/12.0/8))) AS nbv FROM acc WHERE fmi < {CLOSE - 11} GROUP BY 1) o USING (unit_id)
LEFT JOIN (SELECT unit_id, sum(CASE WHEN x > 5000 THEN 450.0 ELSE 400.0 END) AS capex FROM acc WHERE fmi BETWEEN {CLOSE - 11} AND {CLOSE} GROUP BY 1) n USING (unit_id)
LEFT JOIN (SELECT unit_id, sum(CASE event_type WHEN 'F' THEN 90.0 WHEN 'O' THEN 35.0 ELSE 30.0 END) AS cost FROM aev JOIN acc USING (entity_id) WHERE emi BETWEEN {CLOSE - 11} AND {CLOSE} GROUP BY 1) e USING (unit_id)"""))
def asset_book(spark, sf):
    """Opening value from age-depreciated capex, additions from new entities and measures of the period."""
    digest = source_digest(spark, sf)
    _, acc = base(spark, sf, digest)
    start = CLOSE - 11
    kind = F.create_map(F.lit("F"), F.lit(E.MEASURE_COST["frac"]), F.lit("O"), F.lit(E.MEASURE_COST["workover"]))
    capex = F.when(F.col("x") > 5000, E.CAPEX["horizontal"]).otherwise(E.CAPEX["default"])
    left = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - (start - F.col("fmi")) / 12.0 / 8))
    g = acc.groupBy("unit_id").agg(F.sum(F.when(F.col("fmi") < start, capex * left)).alias("nbv"), F.sum(F.when(F.col("fmi").between(start, CLOSE), capex)).alias("capex"))
    ev = account_events(spark, sf).where(F.col("emi").between(start, CLOSE)).join(acc.select("entity_id", "unit_id").hint("merge"), "entity_id")
    e = ev.groupBy("unit_id").agg(F.sum(F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit(E.MEASURE_COST["default"]))).alias("cost"))
    z = F.lit(0.0)
    return g.join(e, "unit_id", "left").select("unit_id", rnd(F.coalesce("nbv", z), 2).alias("opening_nbv"), rnd(F.coalesce("capex", z) + F.coalesce("cost", z), 2).alias("additions"))
