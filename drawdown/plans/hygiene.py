"""Queries: months, gate, eligibility, splits, scopes, catalogue."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import (days_in_month, month_index, month_label, period_start, rnd, years_back)
from ..operators import hygiene as H
from ..operators.ranking import dated_row_number
from ..sources.bind import daily, monthly, table, wells
from . import sqlkit as S
from .registry import query, with_ctes

AS_OF = "1995-12-31"
AS_OF_MI = 1995 * 12 + 11


@query("month_keys", sql=f"""
SELECT mi AS month_idx, {S.ym('mi')} AS month, {S.dim('mi')} AS days_in_month, mi-11 AS period_start_idx,
       {S.ym('mi-11')} AS period_start, mi-35 AS three_years_back_idx, count(*) AS n_orders
FROM (SELECT {S.mi('o_orderdate')} AS mi FROM orders) GROUP BY mi""")
def month_keys(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("d")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    idx = month_index("d")
    return o.select(idx.alias("month_idx"), month_label(idx).alias("month"), days_in_month(idx).alias("days_in_month"),
                    period_start("d", 12).alias("period_start_idx"),
                    month_label(period_start("d", 12)).alias("period_start"),
                    years_back("d", 3).alias("three_years_back_idx"), "n_orders")


GATE_SQL = [S.daily("group"), """
static AS (SELECT DISTINCT s_suppkey % 8 AS entity_id FROM supplier WHERE s_acctbal > 8500)""", """
gstats AS (SELECT entity_id, count(*) AS n_days, max(day_index)-min(day_index)+1 AS span,
  avg(CASE WHEN oil IS NULL THEN 1.0 ELSE 0 END) AS null_oil, avg(CASE WHEN whp IS NULL THEN 1.0 ELSE 0 END) AS null_whp,
  sum(CASE WHEN oil < 0 OR oil > 500 THEN 1 ELSE 0 END + CASE WHEN water < 0 OR water > 2000 THEN 1 ELSE 0 END
    + CASE WHEN whp < 0 OR whp > 60 THEN 1 ELSE 0 END)::BIGINT AS n_violations,
  count(oil) AS n_obs, quantile_cont(oil, .25) AS q1, quantile_cont(oil, .75) AS q3 FROM daily GROUP BY 1)""", """
gout AS (SELECT d.entity_id, count(*) AS n_outliers FROM daily d JOIN gstats s USING (entity_id)
  WHERE n_obs > 20 AND (oil < q1-3*(q3-q1) OR oil > q3+3*(q3-q1)) GROUP BY 1)""", """
gate AS (SELECT entity_id, n_days, round(n_days/span, 4) AS continuity, round(null_oil,4) AS null_oil,
  round(null_whp,4) AS null_whp, n_violations, coalesce(n_outliers, 0)::BIGINT AS n_outliers,
  concat_ws('; ', CASE WHEN n_days < 60 THEN 'history under 60 days' END,
    CASE WHEN n_days/span < 0.95 THEN 'continuity ' || printf('%.2f', n_days/span) END,
    CASE WHEN null_oil > 0.05 THEN 'oil null rate ' || printf('%.2f', null_oil) END,
    CASE WHEN null_whp > 0.05 THEN 'whp null rate ' || printf('%.2f', null_whp) END,
    CASE WHEN n_violations > 0 THEN 'out of bounds ' || n_violations END,
    CASE WHEN st.entity_id IS NULL THEN 'no static record' END) AS reject_reason
  FROM gstats LEFT JOIN gout USING (entity_id) LEFT JOIN static st USING (entity_id))"""]


def _gate(spark, sf):
    static = table(spark, sf, "supplier").where("s_acctbal > 8500").select(
        (F.col("s_suppkey") % 8).cast("long").alias("entity_id"))
    return H.quality_gate(daily(spark, sf, "group"), static)


@query("quality_gate", sql=with_ctes(GATE_SQL, select="SELECT *, reject_reason = '' AS passed FROM gate"))
def quality_gate(spark, sf):
    return _gate(spark, sf)


@query("gate_summary", sql=with_ctes(GATE_SQL, select="""
SELECT r.reason, count(*) AS n, (SELECT count(*) FROM gate) AS n_entities,
  (SELECT count(*) FROM gate WHERE reject_reason='') AS n_passed,
  (SELECT round(avg(CASE WHEN reject_reason='' THEN 1.0::DOUBLE ELSE 0 END),4) FROM gate) AS pass_rate
FROM (SELECT unnest(string_split(reject_reason, '; ')) AS reason FROM gate WHERE reject_reason <> '') r
GROUP BY 1 ORDER BY n DESC, reason LIMIT 5"""))
def gate_summary(spark, sf):
    return H.gate_summary(_gate(spark, sf))


@query("eligible_entities", sql=with_ctes(S.daily("part"), select=f"""
SELECT entity_id, max(day_index) AS history_days FROM daily
WHERE entity_id IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT {S.mi('l_shipdate')}) >= 12)
GROUP BY 1 HAVING max(day_index) >= 420"""))
def eligible_entities(spark, sf):
    accepted = monthly(spark, sf, "part").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    return H.eligible_entities(daily(spark, sf, "part"), accepted)


@query("train_splits", sql=with_ctes(S.WELLS, """
u AS (SELECT entity_id, """ + S.uniform("0", "entity_id") + """ AS u FROM wells)""", """
ranked AS (
  SELECT 'time' AS method, entity_id, row_number() OVER (ORDER BY first_prod, entity_id) AS rn, count(*) OVER () AS n, .25 AS test FROM wells
  UNION ALL SELECT 'random', entity_id, row_number() OVER (ORDER BY u, entity_id), count(*) OVER (), .25 FROM u
  UNION ALL SELECT 'group', entity_id, row_number() OVER (ORDER BY block, first_prod, entity_id), count(*) OVER (), 0
    FROM wells WHERE block < (SELECT max(block) FROM wells))""", select="""
SELECT method, entity_id, CASE WHEN rn > n - floor(n*test) THEN 'test' WHEN rn > n - floor(n*test) - floor(n*.2) THEN 'calib' ELSE 'train' END AS part FROM ranked
UNION ALL SELECT 'group', entity_id, 'test' FROM wells WHERE block = (SELECT max(block) FROM wells)"""))
def train_splits(spark, sf):
    m = wells(spark, sf)
    parts = [("time", H.split_by_time(m)), ("random", H.split_random(m)), ("group", H.split_by_group(m))]
    out = None
    for name, p in parts:
        p = p.select(F.lit(name).alias("method"), "entity_id", "part")
        out = p if out is None else out.unionByName(p)
    return out


@query("point_in_time", sql=with_ctes(S.monthly("supplier"), select=f"""
SELECT entity_id, sum(oil) AS cum_oil, max(mi) AS last_mi, count(*) AS n_months FROM monthly WHERE mi <= {AS_OF_MI} GROUP BY 1"""))
def point_in_time(spark, sf):
    return H.as_of_filter(monthly(spark, sf, "supplier"), "mi", AS_OF_MI).groupBy("entity_id").agg(
        F.sum("oil").alias("cum_oil"), F.max("mi").alias("last_mi"), F.count(F.lit(1)).alias("n_months"))


UNITS_SQL = "units AS (SELECT DISTINCT unit_id AS unit, block AS plant, 'ALL' AS company FROM wells)"


def units_of(w):
    return w.select(F.col("unit_id").alias("unit"), F.col("block").alias("plant"), F.lit("ALL").alias("company")).distinct()


@query("scope_members", sql=with_ctes(S.WELLS, UNITS_SQL, select="""
SELECT scope, level, member, count(entity_id) AS n_entities FROM (
  SELECT unit AS scope, 'unit' AS level, unit AS member FROM units
  UNION SELECT plant, 'plant', unit FROM units UNION SELECT company, 'company', unit FROM units)
LEFT JOIN wells ON unit_id = member
WHERE scope IN ('ALL', 'ECONOMY', 'SMALL/Brand#5', 'NOWHERE') GROUP BY ALL"""))
def scope_members(spark, sf):
    w = wells(spark, sf)
    asked = spark.createDataFrame([("ALL",), ("ECONOMY",), ("SMALL/Brand#5",), ("NOWHERE",)], "scope string")
    hit = H.resolve_scope(units_of(w), asked)
    members = w.groupBy(F.col("unit_id").alias("member")).agg(F.count(F.lit(1)).alias("n_entities"))
    return hit.join(members, "member")


@query("code_resolution", sql="""
SELECT c_mktsegment AS segment, count(*) AS n_asked, count(s.s_suppkey) AS n_found, min(s.s_suppkey) AS first_id
FROM (SELECT c_mktsegment, c_custkey, 'supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code FROM customer)
LEFT JOIN supplier s ON upper(s.s_name) = upper(code) OR CAST(s.s_suppkey AS VARCHAR) = code GROUP BY 1""")
def code_resolution(spark, sf):
    asked = table(spark, sf, "customer").select(
        "c_mktsegment", F.concat(F.lit("supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("asked"))
    hit = H.resolve_codes(asked, table(spark, sf, "supplier"), asked_col="asked", ident="s_suppkey", code="s_name")
    return hit.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n_asked"), F.count("s_suppkey").alias("n_found"), F.min("s_suppkey").alias("first_id"))


@query("entity_catalogue", sql=with_ctes(S.WELLS, S.daily("part"), select="""
SELECT entity_id, block, layer, first_prod, cum_oil, history_days, history_days < 420 AS is_new FROM wells LEFT JOIN
  (SELECT entity_id, sum(oil) AS cum_oil, max(day_index) AS history_days FROM daily GROUP BY 1) USING (entity_id)
ORDER BY first_prod DESC, entity_id LIMIT 50"""))
def entity_catalogue(spark, sf):
    agg = daily(spark, sf, "part").groupBy("entity_id").agg(
        F.sum("oil").alias("cum_oil"), F.max("day_index").alias("history_days"))
    return (wells(spark, sf).join(agg, "entity_id", "left")
            .select("entity_id", "block", "layer", "first_prod", "cum_oil", "history_days",
                    (F.col("history_days") < 420).alias("is_new"))
            .orderBy(F.desc("first_prod"), "entity_id").limit(50))


@query("aligned_features", sql=with_ctes(S.WELLS, select="""
SELECT entity_id, size, CAST(NULL AS DOUBLE) AS depth, CAST(block='ECONOMY' AS INT)::DOUBLE AS block_ECONOMY,
  CAST(block='SMALL' AS INT)::DOUBLE AS block_SMALL, 0.0::DOUBLE AS block_UNSEEN FROM wells"""))
def aligned_features(spark, sf):
    cats = ["ECONOMY", "SMALL", "PROMO"]
    x = H.one_hot(wells(spark, sf).select("entity_id", "size", "block"), "block", cats).drop("block")
    return H.align_features(x, ["size", "depth", "block_ECONOMY", "block_SMALL", "block_UNSEEN"])


@query("global_order", sql=with_ctes(S.WELLS, select="""
SELECT entity_id, row_number() OVER (PARTITION BY block ORDER BY first_prod, entity_id) AS rn FROM wells"""))
def global_order(spark, sf):
    return dated_row_number(wells(spark, sf).select("entity_id", "block", "first_prod"), ["block"], "first_prod",
                            "entity_id", total=None).select("entity_id", "rn")


@query("null_hygiene", sql="""
SELECT event_type, count(*) AS n, count(v) AS n_valid, round(sum(v), 3) AS total, round(avg(v), 3) AS mean FROM
 (SELECT event_type, CASE WHEN value < 1 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""")
def null_hygiene(spark, sf):
    from ..functions.columns import clean
    v = clean(F.when(F.col("value") < 1, float("nan")).otherwise(F.col("value")))
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_valid"), rnd(F.sum(v), 3).alias("total"),
        rnd(F.avg(v), 3).alias("mean"))
