"""Exact order statistics and row numbers that do not put one key into one task.

Two-level scheme: values are first placed into buckets that are shared by all keys and sized by
approximate quantiles, the bucket counts give every bucket its rank offset, and only inside a bucket is
anything sorted. A key that owns a third of the rows is spread over all buckets.
"""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.columns import c
from ..session import materialise


def _below(cuts: str, value: str):
    """How many of the sorted cut points are smaller than the value, by binary search over at most 2,047 of them."""
    v, at = F.col(value), F.col(cuts)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(10, -1, -1)]), F.lit(0), lambda n, step: F.when((n + step <= F.size(at)) & (F.get(at, n + step - 1) < v), n + step).otherwise(n))


def _ordinal(df: DataFrame, ident: str):
    """A number that grows with ``ident``: the value itself, or for text the seven bytes after what all values start with."""
    if not isinstance(df.schema[ident].dataType, T.StringType):
        return F.col(ident)
    ends = df.agg(F.min(ident), F.max(ident)).first()
    same = len(os.path.commonprefix([x or "" for x in ends]))
    return F.conv(F.rpad(F.substring(F.hex(F.encode(F.substring(F.col(ident), same + 1, 7), "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict,
                      buckets: int = 128) -> DataFrame:
    """Linear-interpolation percentiles per key, any group size.

    ``probs`` maps an output name to a level in [0, 1], or to a function of the group size that returns the
    0-based position wanted (order statistics such as "higher" quantiles).
    """
    keys = list(keys)

    def position(p):
        n = F.col("_total").cast("double")
        return (p(n) if callable(p) else F.lit(p) * (n - 1)).cast("double")

    seen = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # scalar subquery: the bucket borders, an array whose length is fixed by ``buckets``
    # (_n is read as well so that this branch and the next share one shuffle of ``seen``)
    cuts = seen.agg(F.struct(
        F.percentile_approx("_v", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10000).alias("at"),
        F.sum("_n").alias("n")))
    spread = (
        seen.withColumn("_cuts", cuts.scalar())
        .withColumn("_b", _below("_cuts.at", "_v")).drop("_cuts")
    )
    per_bucket = spread.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = (
        per_bucket
        .withColumn("_off", F.sum("_m").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_off", F.coalesce("_off", F.lit(0)))
        .withColumn("_total", F.sum("_m").over(w))
    )
    want = F.array(*[F.struct(F.lit(name).alias("name"), position(p).alias("pos"))
                     for name, p in probs.items()])
    needed = (
        offsets.select(*keys, "_b", "_m", "_off", "_total", F.explode(want).alias("q"))
        .where((F.ceil("q.pos") >= F.col("_off")) & (F.floor("q.pos") < F.col("_off") + F.col("_m")))
        .groupBy(*keys, "_b", "_off").agg(F.collect_list("q").alias("_qs"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        spread.join(needed, [*keys, "_b"])
        .withColumn("_hi", F.col("_off") + F.sum("_n").over(inside) - 1)
        .withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
        .select(*keys, "_v", "_lo", "_hi", F.explode("_qs").alias("q"))
        .where((F.ceil("q.pos") >= F.col("_lo")) & (F.floor("q.pos") <= F.col("_hi")))
    )
    low = F.floor("q.pos").between(F.col("_lo"), F.col("_hi"))
    high = F.ceil("q.pos").between(F.col("_lo"), F.col("_hi"))
    a = F.max(F.when(low, F.col("_v")))
    b = F.max(F.when(high, F.col("_v")))
    frac = F.max(F.col("q.pos") - F.floor("q.pos"))
    solved = ranked.groupBy(*keys, F.col("q.name").alias("_name")).agg((a + (b - a) * frac).alias("_x"))
    return solved.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in probs])


def range_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with its 0-based rank by ``order`` inside ``keys``.

    Rows are dealt by ranges of keys and order together, so a key with most of the rows lies in many tasks; of each task only its count of a key
    meets the others. Ties share their range and are numbered in no stated order.
    """
    keys = list(keys)
    rows = materialise(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    parts = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return rows.join(parts, [*keys, "_part"]).withColumn(out, F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_first", "_before")


def dated_row_number(df: DataFrame, keys: Sequence[str], date: str, ident: str, out: str = "rn",
                     total: str | None = "n_total", fan: int = 64) -> DataFrame:
    """1-based row number by (date, ident) inside ``keys``.

    The number of distinct dates is bounded by the calendar, so the offsets are small; rows of one date
    are ranked inside ``fan`` identifier ranges. Identifiers may be numbers or text.
    """
    keys = list(keys)
    df = df.withColumn("_o", _ordinal(df, ident))
    cuts = df.agg(F.percentile_approx("_o", F.array(*[F.lit(i / fan) for i in range(1, fan)]), 10000).alias("_cuts"))
    spread = (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn("_b", _below("_cuts", "_o")).drop("_cuts", "_o")
    )
    per = spread.groupBy(*keys, date, "_b").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("_off", F.coalesce(F.sum("_m").over(
            w.orderBy(date, "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_m").over(w)).drop("_m")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, date, "_b").orderBy(ident))
    res = (
        spread.join(per, [*keys, date, "_b"])
        .withColumn(out, (F.col("_off") + inside).cast("long"))
    )
    if total:
        res = res.withColumn(total, F.col("_total").cast("long"))
    return res.drop("_off", "_b", "_total")


def top_k(df: DataFrame, keys: Sequence[str], order, k: int, rank: str = "rk") -> DataFrame:
    """First k rows per key; Spark limits each map partition to k rows per key before the shuffle."""
    order = order if isinstance(order, (list, tuple)) else [order]
    w = Window.partitionBy(*keys).orderBy(*[c(o) for o in order])
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def scored_rank(df: DataFrame, keys: Sequence[str], score: str, ident: str, out: str, buckets: int = 128) -> DataFrame:
    """Exact rank by falling score (then ident) inside ``keys`` without sorting a whole key in one task."""
    keys = list(keys)
    cuts = df.agg(F.percentile_approx(score, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10000))
    spread = df.withColumn("_cuts", cuts.scalar()).withColumn("_b", F.size("_cuts") - _below("_cuts", score)).drop("_cuts")
    per = spread.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_m").over(w), F.lit(0))).drop("_m")
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(F.desc(score), ident))
    return spread.join(per, [*keys, "_b"]).withColumn(out, F.col("_off") + inside).drop("_b", "_off")


def others_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the median of the other rows of its keys as ``out``; null for a row alone.

    Without its own row, every larger rank moves down by one. So all medians of a group are read from three neighbouring ranks, and no group is
    aggregated anew for each of its rows.
    """
    keys = list(keys)
    r = materialise(range_rank(df, keys, [value], "_k"))
    size = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lo = F.floor((F.col("_n") - 2) / 2)
    near = r.join(size, keys).withColumn("_lo", lo).where(F.col("_k").between(F.col("_lo"), F.col("_lo") + 2))
    three = near.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_k") == F.col("_lo") + i, F.col(value))).alias(f"_s{i}") for i in range(3)])
    # the j-th of the others is the j-th of all below the row's own rank, and the next one from there on
    low = F.when(lo < F.col("_k"), F.col("_s0")).otherwise(F.col("_s1"))
    high = F.when(lo + 1 < F.col("_k"), F.col("_s1")).otherwise(F.col("_s2"))
    odd = F.col("_n") % 2 == 0  # an odd number of others has one middle
    return r.join(three, keys).withColumn(out, F.when(F.col("_n") > 1, F.when(odd, low).otherwise((low + high) / 2))).drop("_k", "_n", "_s0", "_s1", "_s2")
