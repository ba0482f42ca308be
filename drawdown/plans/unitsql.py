"""Oracle SQL of the unit evaluation, stated with joins and windows."""
from __future__ import annotations

from ..operators.decline import TERMINAL
from ..operators.economics import DECKS, FX, RESTART_COST, SCENARIOS
from ..operators.unit import Config
from . import sqlkit as S
from .decline import entity_fit_ctes, low_best_ctes
from .fitsql import best_ctes, fit_rate_sql, remaining_ctes

AM = f"""am AS (SELECT entity_id, {S.mi('dt')} AS mi, sum(oil) AS oil, round(sum(water),4) AS water, sum(act)::INTEGER AS days_on, count(*)::INTEGER AS days FROM (
  SELECT o_custkey AS entity_id, CAST(l_shipdate AS DATE) AS dt, sum(l_quantity) AS oil, round(10*sum(l_quantity*l_discount),4) AS water,
   max(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) AS act FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL) GROUP BY ALL)"""
ACC = """acc AS (SELECT c_custkey AS entity_id, c_mktsegment || '/' || n_regionkey AS unit_id, c_mktsegment AS plant, c_acctbal AS x, (c_custkey*7919 % 10007)::DOUBLE AS y,
  0.9::DOUBLE + 0.05::DOUBLE*n_regionkey AS opex_factor, fmi FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT entity_id, min(mi) AS fmi FROM am GROUP BY 1) f ON f.entity_id = c_custkey)"""
AEV = f"""aev AS (SELECT entity_id, {S.mi('e.dt')} AS emi, e.event_type AS event_type FROM (SELECT o_custkey AS entity_id, year(o_orderdate) AS y,
  min({{'dt': CAST(o_orderdate AS DATE), 'k': o_orderkey, 'event_type': o_orderstatus}}) AS e FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY ALL))"""
LOC = """loc AS (SELECT s_suppkey AS location_id, (['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'])[1 + s_suppkey % 5] || '/' || n_regionkey AS unit_id, s_acctbal AS x,
  (s_suppkey*7919 % 10007)::DOUBLE AS y, (23965 + s_suppkey*13 % 90)::INTEGER AS planned_mi, CASE WHEN s_suppkey % 3 > 0 THEN 23900 + s_suppkey*7 % 80 END::INTEGER AS first_booked_mi,
  CASE WHEN s_suppkey % 11 = 0 THEN 'drilled' WHEN s_suppkey % 13 = 0 THEN 'cancelled' ELSE 'planned' END AS status, CASE WHEN s_suppkey % 22 = 0 THEN s_suppkey END AS drilled_id,
  CASE WHEN s_suppkey % 4 > 0 THEN 100.0::DOUBLE*(s_suppkey % 7) END AS capex FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_prices = {d[0]: d for d in DECKS}
DECK_ROWS = ", ".join(
    f"('{dk}', '{sc}', ({'+'.join(repr(x) for x in _prices[dk][2])})::DOUBLE/12, {pr if pr is not None else 'NULL'}::DOUBLE, {_prices[dk][3]}::DOUBLE, {_prices[dk][4]}::DOUBLE, {_prices[dk][5]}::DOUBLE, {_prices[dk][6]}::DOUBLE, {f}::DOUBLE)"
    for dk, sc, pr, f in SCENARIOS)
DECK = f"""deck AS (SELECT deck, scenario, CASE WHEN scenario='sec' THEN avgp ELSE p END AS price, avgp AS avg_price, opex, transport, tax, bbl, f FROM (VALUES {DECK_ROWS}) t(deck, scenario, avgp, p, opex, transport, tax, bbl, f))"""
LIM = f"""lim AS (SELECT unit_id, deck, scenario, price, net_t, opex_month, opex_month/greatest(net_t*30.4,1e-9) AS q_econ, {RESTART_COST}::DOUBLE*1e4/{FX}/greatest(net_t,1e-9) AS restart_min FROM (
  SELECT u.unit_id, deck, scenario, price, (price-transport)*(1-tax)*bbl AS net_t, opex*f*opex_factor AS opex_month FROM (SELECT DISTINCT unit_id, opex_factor FROM acc) u, deck))"""
BASE = [AM, ACC, AEV, DECK, LIM]


def econ_cte(p: str, rows: list[tuple[str, str, str]]) -> str:
    """rows: (label, deck, scenario)."""
    return f"{p}_econ AS (" + " UNION ALL ".join(
        f"SELECT unit_id, '{lab}' AS scenario, price, net_t, opex_month, q_econ, restart_min FROM lim WHERE deck='{dk}' AND scenario='{sc}'" for lab, dk, sc in rows) + ")"


def new_ctes(p: str, rows: str, info: str, as_of: int, cfg: Config, model: str | None = None) -> list[str]:
    """``p`` = (entity_id, unit_id, scenario, months_on, cum, rate_now, dynamic_t, analog_t, model_low, reserves, basis, best_estimate)."""
    out = [f"""{p}_m AS (SELECT r.entity_id, i.unit_id, i.fmi, mi, oil, oil/{S.dim('mi')} AS rate, mi-i.fmi+1 AS k, row_number() OVER (PARTITION BY r.entity_id ORDER BY mi) AS rn, count(*) OVER (PARTITION BY r.entity_id) AS n
   FROM {rows} r JOIN {info} i ON i.entity_id = r.entity_id WHERE mi <= {as_of})""",
           f"""{p}_g AS (SELECT entity_id, any_value(unit_id) AS unit_id, {as_of} - any_value(fmi) + 1 AS months_on, sum(oil) AS cum, avg(rate) FILTER (WHERE rn > n-3) AS rate_now, arg_max(rn, {{'r': rate, 'n': -rn}}) AS kp, any_value(n) AS n FROM {p}_m GROUP BY 1)""",
           f"""{p}_pp AS (SELECT m.entity_id, (rn-kp)::DOUBLE AS t, rate AS q FROM {p}_m m JOIN {p}_g g ON g.entity_id = m.entity_id WHERE g.n >= {cfg.dynamic_months} AND rn >= kp AND g.n-kp+1 >= 6)""",
           *best_ctes(f"{p}_pp", f"{p}_df", TERMINAL),
           f"""{p}_dt AS (SELECT f.*, g.n-g.kp AS tn, e.scenario, e.q_econ FROM {p}_df f JOIN {p}_g g ON g.entity_id = f.entity_id JOIN {{econ}} e ON e.unit_id = g.unit_id)""",
           *remaining_ctes(f"{p}_dt", f"{p}_dr", "entity_id", "f.q_econ", "f.tn", keep=", scenario, q_econ, tn"),
           f"""{p}_sc AS (SELECT m.entity_id, sum(rate)/sum(tc[k]) AS scale FROM {p}_m m JOIN {p}_g g ON g.entity_id = m.entity_id JOIN {{tp}} c ON c.unit_id = m.unit_id WHERE c.l > g.months_on AND k BETWEEN 1 AND c.l GROUP BY 1 HAVING sum(tc[k]) > 0)""",
           f"""{p}_fc AS (SELECT s.entity_id, e.scenario, e.q_econ, j, CASE WHEN months_on + j <= c.l THEN tc[months_on+j]*scale ELSE tc[c.l]*scale*exp(-ext*(months_on+j-c.l)) END AS r
   FROM {p}_sc s JOIN {p}_g g ON g.entity_id = s.entity_id JOIN {{tp}} c ON c.unit_id = g.unit_id JOIN {{econ}} e ON e.unit_id = g.unit_id, range(1,361) h(j))""",
           f"""{p}_an AS (SELECT entity_id, scenario, coalesce(sum(r) FILTER (WHERE alive = 1),0)*30.4 AS analog_t FROM (SELECT *, min(CASE WHEN r >= q_econ THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, scenario ORDER BY j) AS alive FROM {p}_fc) GROUP BY ALL)""",
           f"""{p}_x AS (SELECT g.entity_id, g.unit_id, e.scenario, months_on, cum, rate_now, d.remaining AS dynamic_t, a.analog_t, {'greatest(ml.p10 - cum, 0)' if model else 'NULL::DOUBLE'} AS model_low
   FROM {p}_g g JOIN {{econ}} e ON e.unit_id = g.unit_id LEFT JOIN {p}_dr d ON d.entity_id = g.entity_id AND d.scenario = e.scenario LEFT JOIN {p}_an a ON a.entity_id = g.entity_id AND a.scenario = e.scenario
   {f'LEFT JOIN {model} ml ON ml.entity_id = g.entity_id' if model else ''})""",
           f"""{p} AS (SELECT *, coalesce(dynamic_t, analog_t) AS best_estimate, CASE WHEN model_low IS NOT NULL AND (coalesce(dynamic_t, analog_t) IS NULL OR model_low < coalesce(dynamic_t, analog_t)) THEN model_low ELSE coalesce(dynamic_t, analog_t) END AS reserves,
   CASE WHEN model_low IS NOT NULL AND (coalesce(dynamic_t, analog_t) IS NULL OR model_low < coalesce(dynamic_t, analog_t)) THEN 'model_low' WHEN dynamic_t IS NOT NULL THEN 'dynamic' WHEN analog_t IS NOT NULL THEN 'analog' END AS basis FROM {p}_x)"""]
    return out


def curve_ctes(p: str, as_of: int, cfg: Config) -> list[str]:
    return [f"""{p}_tg AS (SELECT unit_id, mi-fmi+1 AS k, median(oil/{S.dim('mi')}) AS rate, count(*) AS n_wells FROM am JOIN acc USING (entity_id) WHERE mi <= {as_of} AND {as_of}-fmi+1 >= {cfg.curve_history} GROUP BY ALL)""",
            f"""{p}_tc AS (SELECT unit_id, k, rate, n_wells FROM (SELECT *, min(CASE WHEN k = rn AND n_wells >= {cfg.curve_wells} THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY k) AS alive FROM (
   SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS rn FROM {p}_tg)) WHERE alive = 1)""",
            f"""{p}_tp AS (SELECT unit_id, list(rate ORDER BY k) AS tc, max(k) AS l, greatest(-coalesce(CASE WHEN count(*) FILTER (WHERE k > mx-12) >= 2 THEN regr_slope(ln(greatest(rate,1e-6)), k) FILTER (WHERE k > mx-12) END, -0.02), 0.005) AS ext
   FROM (SELECT *, max(k) OVER (PARTITION BY unit_id) AS mx FROM {p}_tc) GROUP BY 1)"""]


def measure_ctes(p: str, as_of: int, cfg: Config) -> list[str]:
    start = as_of - cfg.period + 1
    q = fit_rate_sql
    return [f"""{p}_em AS (SELECT e.entity_id, e.emi, e.event_type, e.entity_id || '|' || e.emi || '|' || e.event_type AS ek, m.mi, m.oil, m.days_on, m.oil/greatest(m.days_on,1) AS rate, m.days_on >= {cfg.min_days_on} AS valid
   FROM (SELECT DISTINCT * FROM aev WHERE emi <= {as_of}) e JOIN am m ON m.entity_id = e.entity_id WHERE mi <= {as_of})""",
            f"""{p}_pr AS (SELECT *, count(*) OVER (PARTITION BY ek) AS n_pre, min(mi) OVER (PARTITION BY ek) AS t0, row_number() OVER (PARTITION BY ek ORDER BY mi DESC) AS rd FROM {p}_em WHERE valid AND mi < emi AND mi >= emi-{cfg.max_pre})""",
            f"""{p}_bp AS (SELECT ek, (mi-t0)::DOUBLE AS t, rate AS q FROM {p}_pr WHERE n_pre >= {cfg.min_pre})""",
            *best_ctes(f"{p}_bp", f"{p}_bf", TERMINAL, "ek"),
            f"""{p}_bs AS (SELECT b.*, s.t0, s.n_pre, s.pre_rate FROM {p}_bf b JOIN (SELECT ek, any_value(t0) AS t0, any_value(n_pre) AS n_pre, avg(rate) FILTER (WHERE rd <= 3) AS pre_rate FROM {p}_pr GROUP BY 1) s USING (ek))""",
            f"""{p}_af AS (SELECT *, CASE WHEN valid AND mi > emi THEN rate-base END AS inc, valid AND mi > emi AS post FROM (SELECT m.*, f.t0, {q('(m.mi-f.t0)::DOUBLE')} AS base FROM {p}_em m JOIN {p}_bs f ON f.ek = m.ek WHERE m.mi >= m.emi))""",
            f"""{p}_ag AS (SELECT ek, sum(oil-base*days_on) AS realized, count(*) FILTER (WHERE post) AS n_post, max(mi) FILTER (WHERE post) AS last_mi,
   CASE WHEN count(*) FILTER (WHERE inc > 0) >= 3 THEN regr_slope(ln(inc), (mi-emi)::DOUBLE) FILTER (WHERE inc > 0) END AS slope,
   greatest(avg(inc) FILTER (WHERE post AND rd <= 3), 0) AS inc_now, avg(inc) FILTER (WHERE post AND ra <= 3) AS rate_gain, avg(rate) FILTER (WHERE post AND ra <= 3) AS post_rate
   FROM (SELECT *, row_number() OVER (PARTITION BY ek, post ORDER BY mi) AS ra, row_number() OVER (PARTITION BY ek, post ORDER BY mi DESC) AS rd FROM {p}_af) GROUP BY 1)""",
            f"""{p}_eff AS (SELECT e.*, acc.unit_id, acc.fmi, e.emi >= {start} AND acc.fmi < {start} AS in_period FROM (
   SELECT e.entity_id, e.emi, e.event_type, e.ek, coalesce(c.n_pre,0) AS n_pre, coalesce(g.n_post,0) AS n_post, b.t0, b.pre_rate, b.qi, b.di, b.b, b.d_min, b.model,
    CASE WHEN coalesce(c.n_pre,0) < {cfg.min_pre} THEN 'insufficient_pre' WHEN coalesce(g.n_post,0) < {cfg.min_post} THEN 'insufficient_post' ELSE 'ok' END AS status,
    CASE WHEN coalesce(c.n_pre,0) >= {cfg.min_pre} THEN coalesce(g.realized,0) END AS realized, (g.last_mi-b.t0)::DOUBLE AS t_now, g.inc_now, g.rate_gain, g.post_rate,
    greatest(CASE WHEN slope < 0 THEN -slope ELSE ln(greatest({q('(g.last_mi-b.t0)::DOUBLE', 'b')},1e-9)/greatest({q('(g.last_mi-b.t0+1)::DOUBLE', 'b')},1e-9)) END, 0.005) AS d_inc
   FROM (SELECT DISTINCT entity_id, emi, event_type, entity_id || '|' || emi || '|' || event_type AS ek FROM aev WHERE emi <= {as_of}) e
   LEFT JOIN (SELECT ek, count(*) AS n_pre FROM {p}_pr GROUP BY 1) c USING (ek) LEFT JOIN {p}_bs b USING (ek) LEFT JOIN {p}_ag g USING (ek)) e JOIN acc ON acc.entity_id = e.entity_id)"""]


def done_ctes(p: str) -> list[str]:
    b = fit_rate_sql("(f.t_now+j)::DOUBLE")
    return [f"""{p}_dh AS (SELECT f.ek, f.scenario, f.q_econ, j, {b} AS base, {b} + f.inc_now*exp(-f.d_inc*j) AS tot FROM (SELECT x.*, e.scenario, e.q_econ FROM {p}_eff x JOIN {{econ}} e ON e.unit_id = x.unit_id WHERE in_period AND status = 'ok') f, range(1,361) h(j))""",
            f"""{p}_dv AS (SELECT ek, scenario, greatest(coalesce(sum(tot) FILTER (WHERE a2=1),0) - coalesce(sum(base) FILTER (WHERE a1=1),0), 0)*30.4 AS inc_remaining FROM (SELECT *,
   min(CASE WHEN base >= q_econ THEN 1 ELSE 0 END) OVER (PARTITION BY ek, scenario ORDER BY j) AS a1, min(CASE WHEN tot >= q_econ THEN 1 ELSE 0 END) OVER (PARTITION BY ek, scenario ORDER BY j) AS a2 FROM {p}_dh) GROUP BY ALL)""",
            f"""{p}_done AS (SELECT x.*, d.scenario, d.inc_remaining FROM {p}_eff x JOIN {p}_dv d USING (ek))"""]


def old_ctes(p: str, as_of: int, cfg: Config) -> list[str]:
    start = as_of - cfg.period + 1
    return [f"""{p}_om AS (SELECT m.*, a.unit_id, a.fmi, c.cutoff, CASE WHEN days_on >= {cfg.open_share}::DOUBLE*{S.dim('m.mi')} THEN oil/{S.dim('m.mi')} END AS fr,
   last_value(CASE WHEN oil>0 THEN mi END IGNORE NULLS) OVER (PARTITION BY m.entity_id ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
   FROM (SELECT * FROM am WHERE mi <= {as_of}) m JOIN acc a ON a.entity_id = m.entity_id AND a.fmi < {start}
   LEFT JOIN (SELECT entity_id, max(emi) AS cutoff FROM {p}_eff WHERE in_period AND status IN ('ok','insufficient_post') GROUP BY 1) c ON c.entity_id = m.entity_id)""",
            f"""{p}_op AS (SELECT *, mi-idle AS ptime, sum(CASE WHEN mi > {as_of - cfg.idle} THEN oil ELSE 0 END) OVER (PARTITION BY entity_id) > 0 AS prod, max(CASE WHEN oil>0 THEN mi END) OVER (PARTITION BY entity_id) AS last_prod, max(idle) OVER (PARTITION BY entity_id) AS gap FROM (
   SELECT *, sum(CASE WHEN oil>0 AND mi-prev-1 >= 3 THEN mi-prev-1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY mi)::BIGINT AS idle FROM {p}_om))""",
            f"""{p}_us AS (SELECT * FROM {p}_op WHERE CASE WHEN prod THEN cutoff IS NULL OR mi < cutoff ELSE mi <= last_prod END)""",
            f"""{p}_fp AS (SELECT entity_id, ptime AS t, fr AS q FROM {p}_us)""",
            *entity_fit_ctes(f"{p}_fp", f"{p}_ef", cfg.min_fit),
            f"""{p}_oh AS (SELECT entity_id, any_value(unit_id) AS unit_id, any_value(fmi) AS fmi, any_value(cutoff) AS cutoff, bool_or(prod) AS prod, max(last_prod) AS last_prod, max(gap) AS gap, max(ptime) FILTER (WHERE mi <= last_prod) AS last_eff FROM {p}_op GROUP BY 1)""",
            f"""{p}_ej AS (SELECT f.*, e.scenario, e.q_econ, e.restart_min, CASE WHEN h.prod THEN {as_of}-h.gap ELSE h.last_eff END AS now_eff FROM {p}_ef f JOIN {p}_oh h USING (entity_id) JOIN {{econ}} e ON e.unit_id = h.unit_id)""",
            *low_best_ctes(f"{p}_ej", f"{p}_lb", "entity_id", "f.q_econ", "f.now_eff", keep=", scenario, q_econ, now_eff, fit_start, restart_min, n_fit"),
            f"""{p}_sh AS (SELECT * FROM {p}_oh WHERE prod AND entity_id NOT IN (SELECT entity_id FROM {p}_ef))""",
            f"""{p}_sr AS (SELECT entity_id, mi, oil FROM {p}_us WHERE prod AND entity_id IN (SELECT entity_id FROM {p}_sh))""",
            *new_ctes(f"{p}_alt", f"{p}_sr", f"{p}_sh", as_of, cfg),
            f"""{p}_old AS (SELECT *, CASE WHEN status='ok' THEN CASE WHEN cutoff IS NOT NULL THEN 'measure_baseline' ELSE 'own_history' END WHEN status='short_history' THEN alt_basis END AS basis,
    CASE WHEN prod AND fitted THEN low0 WHEN prod THEN coalesce(alt,0) ELSE 0 END AS remaining_low, CASE WHEN prod AND fitted THEN best0 WHEN prod THEN coalesce(alt,0) ELSE 0 END AS remaining_best,
    CASE WHEN prod THEN NULL ELSE CASE WHEN pdnp_status='booked' THEN low0 ELSE 0 END END AS pdnp, CASE WHEN pdnp_status IN ('booked','uneconomic') THEN low0 END AS pdnp_estimate FROM (
   SELECT h.entity_id, h.unit_id, e.scenario, h.cutoff, h.prod, h.last_prod, h.gap, l.n_fit, l.entity_id IS NOT NULL AS fitted, l.remaining_low AS low0, l.remaining_best AS best0, a.reserves AS alt, a.basis AS alt_basis,
    CASE WHEN NOT h.prod THEN 'not_producing' WHEN l.entity_id IS NOT NULL THEN 'ok' WHEN a.reserves IS NOT NULL THEN 'short_history' ELSE 'insufficient' END AS status,
    CASE WHEN h.prod THEN NULL WHEN h.last_prod IS NULL THEN 'no_history' WHEN {as_of}-h.last_prod > {cfg.max_shut_in} THEN 'long_shut_in' WHEN l.entity_id IS NULL THEN 'no_fit' WHEN l.remaining_low > 0 AND l.remaining_low >= l.restart_min THEN 'booked' ELSE 'uneconomic' END AS pdnp_status
   FROM {p}_oh h JOIN {{econ}} e ON e.unit_id = h.unit_id LEFT JOIN {p}_lb l ON l.entity_id = h.entity_id AND l.scenario = e.scenario LEFT JOIN {p}_alt a ON a.entity_id = h.entity_id AND a.scenario = e.scenario))"""]


def fresh_ctes(p: str, as_of: int, cfg: Config, radius: float, min_old: int) -> list[str]:
    start = as_of - cfg.period + 1
    return [f"""{p}_nw AS (SELECT n.entity_id, n.unit_id, n.fmi, coalesce(c.n_old,0) AS n_old, CASE WHEN coalesce(c.n_old,0) >= {min_old} THEN 'infill' ELSE 'extension' END AS category FROM acc n LEFT JOIN (
   SELECT n.entity_id, count(*) AS n_old FROM acc n JOIN acc o ON o.fmi < {start} AND round(sqrt((n.x-o.x)**2+(n.y-o.y)**2),9) <= {radius} WHERE n.fmi BETWEEN {start} AND {as_of} GROUP BY 1) c USING (entity_id) WHERE n.fmi BETWEEN {start} AND {as_of})""",
            f"""{p}_nr AS (SELECT entity_id, mi, oil FROM am WHERE entity_id IN (SELECT entity_id FROM {p}_nw))"""]


def evaluation(p: str, as_of: int, cfg: Config, econ: list[tuple[str, str, str]], radius: float, min_old: int, model: str | None = None) -> list[str]:
    start = as_of - cfg.period + 1
    parts = [econ_cte(p, econ), *curve_ctes(p, as_of, cfg), *measure_ctes(p, as_of, cfg), *done_ctes(p), *old_ctes(p, as_of, cfg), *fresh_ctes(p, as_of, cfg, radius, min_old),
             *new_ctes(f"{p}_nx", f"{p}_nr", f"{p}_nw", as_of, cfg, model),
             f"""{p}_new AS (SELECT x.*, w.category, w.n_old FROM {p}_nx x JOIN {p}_nw w USING (entity_id))""",
             f"""{p}_prod AS (SELECT entity_id, unit_id, fmi, sum(oil) AS production FROM am JOIN acc USING (entity_id) WHERE mi BETWEEN {start} AND {as_of} GROUP BY ALL)""",
             f"""{p}_comp AS (SELECT unit_id, scenario, 'old_base' AS component, sum(remaining_low) AS reserves, count(*) FILTER (WHERE status IN ('ok','short_history')) AS n_items FROM {p}_old GROUP BY ALL
   UNION ALL SELECT unit_id, scenario, 'measure', sum(inc_remaining), count(*) FROM {p}_done GROUP BY ALL
   UNION ALL SELECT unit_id, scenario, CASE WHEN category='infill' THEN 'new_infill' ELSE 'extension' END, sum(coalesce(reserves,0)), count(*) FROM {p}_new GROUP BY ALL)"""]
    return [x.replace("{econ}", f"{p}_econ").replace("{tp}", f"{p}_tp") for x in parts]
