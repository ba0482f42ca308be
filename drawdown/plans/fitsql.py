"""Oracle SQL of the decline fits: the same grid and narrowing rounds, spelled out as joins and aggregates."""
from __future__ import annotations

from ..functions.curves import (B_FLOOR, HALF_LIFE, HORIZON_STEPS, MIN_POINTS, QI_BOX, ZOOM_HALF, ZOOMS, axes, terminal)


def shape_sql(model: str, t: str, p: str, s: str, d_min: float | str) -> str:
    if model == "duong":
        ts = f"greatest({t}, 1e-6)"
        return f"(pow({ts}, -({s})) * exp(({p})/(1.0-({s})) * (pow({ts}, 1.0-({s})) - 1.0)))"
    body = f"pow(1.0+({s})*({p})*({t}), -1.0/({s}))"
    if isinstance(d_min, float) and d_min == 0.0:
        return f"(CASE WHEN ({s}) <= {B_FLOOR} THEN exp(-({p})*({t})) ELSE {body} END)"
    tsw = f"((({p})/({d_min})-1.0)/(({s})*({p})))"
    late = f"pow(1.0+({s})*({p})*{tsw}, -1.0/({s}))*exp(-({d_min})*(({t})-{tsw}))"
    return (f"(CASE WHEN ({s}) <= {B_FLOOR} THEN exp(-({p})*({t})) WHEN ({d_min}) > 0 AND {tsw} > 0 AND ({t}) > {tsw} THEN {late} ELSE {body} END)")


def fit_ctes(src: str, name: str, model: str, key: str = "entity_id") -> list[str]:
    """CTEs ending in ``name``(key, model, qi, di, b, d_min, a, m, rmse, r2, n). ``src`` has (key, t, q) with q > 0."""
    u, v = axes(model)
    dm = terminal(model)
    p = "exp(u)" if u.log else "u"
    pts = f"""{name}_p AS (SELECT {key}, t, q, w2/(mw*mw) AS w2 FROM (SELECT {key}, t, q, w*w AS w2, avg(w) OVER (PARTITION BY {key}) AS mw FROM (
  SELECT {key}, t - min(t) OVER (PARTITION BY {key}) AS t, q, pow(0.5::DOUBLE, (max(t) OVER (PARTITION BY {key}) - t)/{HALF_LIFE}) AS w, count(*) OVER (PARTITION BY {key}) AS n
  FROM (SELECT {key}, t::DOUBLE AS t, q::DOUBLE AS q FROM {src}) WHERE q > 0) WHERE n >= {MIN_POINTS}))"""
    parts = [pts, f"""{name}_y AS (SELECT {key}, sum(w2*q*q) AS syy FROM {name}_p GROUP BY 1)""",
             f"""{name}_g0 AS (SELECT {key}, {u.origin!r}::DOUBLE + {u.step!r}::DOUBLE*i AS u, {v.origin!r}::DOUBLE + {v.step!r}::DOUBLE*j AS v FROM {name}_y, range({u.n}) a(i), range({v.n}) b(j))"""]
    su, sv = u.step, v.step

    def solve(g: str, out: str) -> str:
        return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round((syy - 2*qi*sa + qi*qi*sb)/syy, 9), u, v) AS rk FROM (
  SELECT *, least(greatest(sa/greatest(sb,1e-300), {QI_BOX[0]!r}::DOUBLE), {QI_BOX[1]!r}::DOUBLE) AS qi FROM (
   SELECT {key}, u, v, sum(w2*q*s) AS sa, sum(w2*s*s) AS sb FROM (SELECT p.{key}, g.u, g.v, p.w2, p.q, {shape_sql(model, 'p.t', p.replace('u', 'g.u'), 'g.v', dm)} AS s FROM {name}_p p JOIN {g} g ON p.{key} = g.{key}) GROUP BY ALL
  ) JOIN {name}_y USING ({key}))) WHERE rk = 1)"""

    parts.append(solve(f"{name}_g0", f"{name}_b0"))
    for r in range(1, ZOOMS + 1):
        su, sv = su / ZOOM_HALF, sv / ZOOM_HALF
        vs = f"range({-ZOOM_HALF}, {ZOOM_HALF + 1})" if v.n > 1 else "range(0, 1)"
        parts.append(f"""{name}_g{r} AS (SELECT * FROM (SELECT {key}, u + {su!r}::DOUBLE*i AS u, v + {sv!r}::DOUBLE*j AS v FROM {name}_b{r - 1}, range({-ZOOM_HALF}, {ZOOM_HALF + 1}) a(i), {vs} b(j))
  WHERE u >= {u.origin - 1e-12!r} AND u <= {u.end + 1e-12!r} AND v >= {v.origin - 1e-12!r} AND v <= {v.end + 1e-12!r})""")
        parts.append(solve(f"{name}_g{r}", f"{name}_b{r}"))
    last = f"{name}_b{ZOOMS}"
    pr = f"b.qi*{shape_sql(model, 'p.t', p.replace('u', 'b.u'), 'b.v', dm)}"
    zero = "0.0::DOUBLE"
    cols = (f"{zero} AS di, {zero} AS b, {zero} AS d_min, any_value({p.replace('u', 'pu')}) AS a, any_value(pv) AS m" if model == "duong"
            else f"any_value({p.replace('u', 'pu')}) AS di, any_value(pv) AS b, {dm!r}::DOUBLE AS d_min, {zero} AS a, {zero} AS m")
    parts.append(f"""{name} AS (SELECT {key}, '{model}' AS model, any_value(qi) AS qi, {cols}, sqrt(sum((pred-q)**2)/count(*)) AS rmse,
  1 - sum((pred-q)**2)/any_value(tot) AS r2, count(*) AS n FROM (
  SELECT p.{key}, p.q, b.qi, b.u AS pu, b.v AS pv, {pr} AS pred FROM {name}_p p JOIN {last} b ON p.{key} = b.{key}) JOIN
  (SELECT {key}, CASE WHEN sum((q-mq)**2) = 0 THEN 1 ELSE sum((q-mq)**2) END AS tot FROM (SELECT {key}, q, avg(q) OVER (PARTITION BY {key}) AS mq FROM {name}_p) GROUP BY 1) USING ({key}) GROUP BY {key})""")
    return parts


def best_ctes(src: str, name: str, candidates: tuple[str, ...], key: str = "entity_id") -> list[str]:
    parts: list[str] = []
    for i, mname in enumerate(candidates):
        parts += fit_ctes(src, f"{name}_{i}", mname, key)
    union = " UNION ALL ".join(f"SELECT *, {i} AS ord FROM {name}_{i}" for i in range(len(candidates)))
    parts.append(f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(rmse,6), ord) AS rk FROM ({union})) WHERE rk = 1)""")
    return parts


def fit_rate_sql(t: str, f: str = "f", models: tuple[str, ...] = ("arps",)) -> str:
    arps = f"{f}.qi*{shape_sql('arps', t, f + '.di', f + '.b', f + '.d_min')}"
    if "duong" not in models:
        return arps
    return f"(CASE WHEN {f}.model='duong' THEN {f}.qi*{shape_sql('duong', t, f + '.a', f + '.m', 0.0)} ELSE {arps} END)"


def remaining_ctes(src: str, name: str, key: str, q_econ: str, t_start: str, models=("arps",), keep: str = "") -> list[str]:
    """(key…, total, remaining, t_econ, capped) of every fit row in ``src``."""
    r = fit_rate_sql("0.5::DOUBLE*i", "f", models)
    return [f"""{name} AS (SELECT {key}{keep}, coalesce(sum(q) FILTER (WHERE ok), 0)*15.2 AS total, coalesce(sum(q) FILTER (WHERE ok AND 0.5*i >= ts), 0)*15.2 AS remaining,
  coalesce(max(0.5*i) FILTER (WHERE ok), 0)::DOUBLE AS t_econ, bool_or(ok AND i = {HORIZON_STEPS - 1}) AS capped FROM (
  SELECT *, q >= qe AS ok FROM (SELECT {', '.join('f.' + k.strip() for k in (key + keep).split(','))}, i, {r} AS q, ({q_econ})::DOUBLE AS qe, ({t_start})::DOUBLE AS ts FROM {src} f, range({HORIZON_STEPS}) g(i))) GROUP BY {key}{keep})"""]
