"""DuckDB snippets of the bindings, so that each oracle restates its inputs independently of Spark."""
from __future__ import annotations

from ..functions.columns import CDF_B, CDF_P, PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW

ENTITY = {"group": "l_suppkey % 8", "supplier": "l_suppkey", "part": "l_partkey"}


def mi(d: str) -> str:
    return f"(year({d})*12+month({d})-1)"


def ym(i: str) -> str:
    return f"printf('%04d-%02d', ({i})//12, ({i})%12+1)"


def month_start(i: str) -> str:
    return f"make_date(({i})//12, ({i})%12+1, 1)"


def dim(i: str) -> str:
    return f"day(last_day({month_start(i)}))"


def daily(by: str = "group", name: str = "daily") -> str:
    return f"""{name} AS (
  SELECT *, CAST(date_diff('day', min(dt) OVER (PARTITION BY entity_id), dt) + 1 AS INTEGER) AS day_index
  FROM (SELECT CAST({ENTITY[by]} AS BIGINT) AS entity_id, CAST(l_shipdate AS DATE) AS dt, sum(l_quantity) AS oil,
        round(10*sum(l_quantity*l_discount), 4) AS water,
        CASE WHEN max(l_linestatus)='O' THEN 24.0::DOUBLE ELSE 0.0::DOUBLE END AS hours_on,
        CASE WHEN max(l_discount) > 0 THEN round(100*avg(l_tax), 6) END AS whp
        FROM lineitem GROUP BY ALL))"""


USERS = """users AS (
  SELECT *, CAST(date_diff('day', min(dt) OVER (PARTITION BY entity_id), dt) + 1 AS INTEGER) AS day_index
  FROM (SELECT user_id AS entity_id, CAST(ts AS DATE) AS dt, round(sum(value), 2) AS oil,
        CASE WHEN bool_or(event_type <> 'error') THEN 24.0::DOUBLE ELSE 0.0::DOUBLE END AS hours_on,
        round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS whp,
        count(*)::DOUBLE AS water
        FROM events GROUP BY ALL))"""


def monthly(by: str = "supplier", name: str = "monthly") -> str:
    return f"""{name} AS (
  SELECT entity_id, {mi('dt')} AS mi, sum(oil) AS oil, round(sum(water), 4) AS water,
         count(*) FILTER (WHERE hours_on > 0) AS days_on, count(*) AS days
  FROM (SELECT {ENTITY[by]} AS entity_id, CAST(l_shipdate AS DATE) AS dt, sum(l_quantity) AS oil,
        round(10*sum(l_quantity*l_discount), 4) AS water,
        CASE WHEN max(l_linestatus)='O' THEN 24.0 ELSE 0.0 END AS hours_on
        FROM lineitem GROUP BY ALL) GROUP BY ALL)"""


WELLS = f"""wells AS (
  SELECT p_partkey AS entity_id, p_name AS code, p_type AS block, p_brand AS layer,
         p_type || '/' || p_brand AS unit_id, p_retailprice AS x, p_size*20.0::DOUBLE AS y,
         p_size::DOUBLE AS size, first_prod, {mi('first_prod')} AS fmi
  FROM part JOIN (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS first_prod FROM lineitem GROUP BY 1)
  ON p_partkey = l_partkey)"""

EVENTS = """wevents AS (
  SELECT entity_id, e.dt AS dt, e.event_type AS event_type FROM (
    SELECT l_suppkey AS entity_id, date_trunc('quarter', o_orderdate) AS q,
           min({'dt': CAST(o_orderdate AS DATE), 'k': o_orderkey, 'event_type': o_orderstatus}) AS e
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL))"""


# ------------------------------------------------------------------ numerics
def uniform(*keys: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return f"((CAST('0x'||substr(md5({text}),1,13) AS BIGINT)::DOUBLE + 0.5)/4503599627370496.0)"


def horner(coefs, x: str) -> str:
    out = f"({float(coefs[0])!r})::DOUBLE"
    for k in coefs[1:]:
        out = f"({out}*{x}+({float(k)!r})::DOUBLE)"
    return out


def ppf(u: str) -> str:
    tail = f"sqrt(-2.0*ln(CASE WHEN {u} < 0.5 THEN {u} ELSE 1.0-{u} END))"
    t = f"({horner(PPF_C, tail)}/({horner(PPF_D, tail)}*{tail}+1.0))"
    r = f"(({u}-0.5)*({u}-0.5))"
    mid = f"({horner(PPF_A, r)}*({u}-0.5)/({horner(PPF_B, r)}*{r}+1.0))"
    return f"(CASE WHEN {u} < {PPF_LOW} THEN {t} WHEN {u} > {1 - PPF_LOW} THEN -{t} ELSE {mid} END)"


def cdf(z: str) -> str:
    t = f"(1.0/(1.0+{CDF_P}*abs({z})))"
    upper = f"(exp(-{z}*{z}/2.0)/2.5066282746310002*{horner(tuple(reversed(CDF_B)), t)}*{t})"
    return f"(CASE WHEN {z} >= 0 THEN 1.0-{upper} ELSE {upper} END)"
