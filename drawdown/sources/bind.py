"""Bindings of the driver's tables to the roles the operators expect.

The first thing every binding does is aggregate to the (entity, day) or (entity, month) grain. That
aggregation is combined map-side, so a key that holds a third of the raw rows is reduced before the
shuffle; afterwards the rows of one entity are bounded by the calendar, which is what makes the
per-entity windows further on safe.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import days_in_month, month_index


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


ENTITY = {"group": "l_suppkey % 8", "supplier": "l_suppkey", "part": "l_partkey"}


def daily(spark: SparkSession, sf: str, by: str = "group", indexed: bool = True) -> DataFrame:
    """(entity_id, dt, oil, water, hours_on, whp[, day_index]) — one row per entity and day."""
    li = table(spark, sf, "lineitem")
    out = (
        li.groupBy(F.expr(ENTITY[by]).cast("long").alias("entity_id"), F.to_date("l_shipdate").alias("dt"))
        .agg(
            F.sum("l_quantity").alias("oil"),
            F.round(10 * F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("water"),
            F.when(F.max("l_linestatus") == "O", 24.0).otherwise(0.0).alias("hours_on"),
            F.when(F.max("l_discount") > 0, F.round(100 * F.avg("l_tax"), 6)).alias("whp"),
        )
    )
    if not indexed:
        return out
    first = F.min("dt").over(Window.partitionBy("entity_id"))
    return out.withColumn("day_index", (F.datediff("dt", first) + 1).cast("int"))


def daily_users(spark: SparkSession, sf: str) -> DataFrame:
    """Dense short series from ``events``: one row per user and active day."""
    ev = table(spark, sf, "events")
    out = (
        ev.groupBy(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("dt"))
        .agg(
            F.round(F.sum("value"), 2).alias("oil"),
            F.when(F.max(F.when(F.col("event_type") != "error", 1).otherwise(0)) == 1, 24.0)
             .otherwise(0.0).alias("hours_on"),
            F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("whp"),
            F.count(F.lit(1)).cast("double").alias("water"),
        )
    )
    first = F.min("dt").over(Window.partitionBy("entity_id"))
    return out.withColumn("day_index", (F.datediff("dt", first) + 1).cast("int"))


def monthly(spark: SparkSession, sf: str, by: str = "supplier") -> DataFrame:
    """(entity_id, mi, oil, water, days_on, days) with mi the integer month."""
    d = daily(spark, sf, by, indexed=False)
    return (
        d.groupBy("entity_id", month_index("dt").alias("mi"))
        .agg(
            F.sum("oil").alias("oil"), F.round(F.sum("water"), 4).alias("water"),
            F.sum(F.when(F.col("hours_on") > 0, 1).otherwise(0)).cast("int").alias("days_on"),
            F.count(F.lit(1)).cast("int").alias("days"),
        )
    )


def wells(spark: SparkSession, sf: str) -> DataFrame:
    """Master data from ``part``: plant = p_type, unit = p_type/p_brand, planar offsets, first month."""
    first = (
        table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity_id"))
        .agg(F.to_date(F.min("l_shipdate")).alias("first_prod"))
    )
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("code"),
        F.col("p_type").alias("block"), F.col("p_brand").alias("layer"),
        F.concat_ws("/", "p_type", "p_brand").alias("unit_id"),
        F.col("p_retailprice").alias("x"), (F.col("p_size") * 20.0).alias("y"),
        F.col("p_size").cast("double").alias("size"),
    )
    return p.join(first, "entity_id", "inner").withColumn("fmi", month_index("first_prod"))


def well_events(spark: SparkSession, sf: str) -> DataFrame:
    """First urgent order of each supplier and quarter: (entity_id, dt, event_type)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("l_suppkey").alias("entity_id"), F.trunc(F.to_date("o_orderdate"), "quarter").alias("q"))
        .agg(F.min(F.struct(F.to_date("o_orderdate").alias("dt"), F.col("o_orderkey").alias("k"),
                            F.col("o_orderstatus").alias("event_type"))).alias("e"))
        .select("entity_id", "e.dt", "e.event_type")
    )


def calendar_rate(monthly_df: DataFrame) -> DataFrame:
    return monthly_df.withColumn("rate", F.col("oil") / days_in_month("mi"))


# ------------------------------------------------------------------ unit evaluation roles
def account_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly series of each customer: shipped quantity, producing days = days with an open line."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_linestatus", F.to_date("l_shipdate").alias("dt"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity_id"))  # orders grow with the input: no copy by way of the driver
    d = li.join(o.hint("merge"), "l_orderkey").groupBy("entity_id", "dt").agg(
        F.sum("l_quantity").alias("oil"), F.round(10 * F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("water"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("on"))
    return d.groupBy("entity_id", month_index("dt").alias("mi")).agg(
        F.sum("oil").alias("oil"), F.round(F.sum("water"), 4).alias("water"), F.sum("on").cast("int").alias("days_on"),
        F.count(F.lit(1)).cast("int").alias("days"))


def accounts(spark: SparkSession, sf: str, monthly_df: DataFrame | None = None) -> DataFrame:
    """Master data of the customers: unit = segment/region, plant = segment, planar offsets, first month."""
    m = monthly_df if monthly_df is not None else account_monthly(spark, sf)
    first = m.groupBy("entity_id").agg(F.min("mi").alias("fmi"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    cu = table(spark, sf, "customer").join(F.broadcast(n), "c_nationkey")  # nation has 25 rows
    return cu.select(
        F.col("c_custkey").alias("entity_id"), F.concat_ws("/", "c_mktsegment", F.col("n_regionkey").cast("string")).alias("unit_id"),
        F.col("c_mktsegment").alias("plant"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"),
        (0.9 + 0.05 * F.col("n_regionkey")).alias("opex_factor")).join(first.hint("merge"), "entity_id")  # customers grow with the input


def account_events(spark: SparkSession, sf: str) -> DataFrame:
    """First urgent order of each customer and year: (entity_id, emi, event_type)."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    e = o.groupBy(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("y")).agg(
        F.min(F.struct(F.to_date("o_orderdate").alias("dt"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("event_type"))).alias("e"))
    return e.select("entity_id", month_index("e.dt").alias("emi"), "e.event_type")


def locations(spark: SparkSession, sf: str) -> DataFrame:
    """Planned locations from ``supplier``."""
    k = F.col("s_suppkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    seg = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return table(spark, sf, "supplier").join(F.broadcast(n), "s_nationkey").select(
        k.alias("location_id"), F.concat_ws("/", F.get(seg, (k % 5).cast("int")), F.col("n_regionkey").cast("string")).alias("unit_id"),
        F.col("s_acctbal").alias("x"), (k * 7919 % 10007).cast("double").alias("y"), (23965 + k * 13 % 90).cast("int").alias("planned_mi"),
        F.when(k % 3 > 0, 23900 + k * 7 % 80).cast("int").alias("first_booked_mi"),
        F.when(k % 11 == 0, "drilled").when(k % 13 == 0, "cancelled").otherwise("planned").alias("status"),
        F.when(k % 11 == 0, F.when(k % 2 == 0, k)).alias("drilled_id"), F.when(k % 4 > 0, 100.0 * (k % 7)).alias("capex"))
