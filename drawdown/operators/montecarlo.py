"""Volumetrics by Monte Carlo and probabilistic aggregation with a one-factor copula.

Draws come from a hash of (seed, keys, draw number), so a re-run task or another partitioning gives the same values.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW, c, normal_cdf, normal_ppf
from ..session import materialise, spread
from .ranking import range_rank

# Volumetric constants.
RHO, BO = 0.85, 1.15
HALF_SPACING, VERTICAL_RADIUS = 150.0, 200.0
CV_AREA, CV_PAY = 0.25, 0.18
POROSITY_MAX, SATURATION_MAX = 35.0, 95.0


def drainage_area(lateral) -> Column:
    x = c(lateral)
    return F.when(x > 0, x * 2.0 * HALF_SPACING).otherwise(math.pi * VERTICAL_RADIUS ** 2)


def ooip(area, pay, porosity_pct, saturation_pct) -> Column:
    return c(area) * c(pay) * (c(porosity_pct) / 100.0) * (c(saturation_pct) / 100.0) * RHO / BO


def sample(u: Column, mean, cv: float, dist: str = "lognormal", low: float | None = None, high: float | None = None, z: Column | None = None) -> Column:
    """Inverse-CDF draw from u (or from a ready normal draw z), clipped to [low, high]."""
    m = c(mean)
    z = normal_ppf(u) if z is None and dist != "triangular" else z
    if dist == "normal":
        v = m + m * cv * z
    elif dist == "triangular":
        a = F.lit(low) if low is not None else m * (1 - 2 * cv)
        b = F.lit(high) if high is not None else m * (1 + 2 * cv)
        f = (m - a) / (b - a)
        v = F.when(u < f, a + F.sqrt(u * (b - a) * (m - a))).otherwise(b - F.sqrt((1 - u) * (b - a) * (b - m)))
    else:
        sigma = math.sqrt(math.log(1 + cv * cv))
        v = F.exp(F.ln(F.greatest(m, F.lit(1e-9))) - sigma * sigma / 2 + sigma * z)
    v = F.greatest(v, F.lit(low if low is not None else 1e-9))
    return F.least(v, F.lit(high)) if high is not None else v


def draws(seed: int, tag: str, key, n: int) -> np.ndarray:
    """``n`` standard normal draws of one key: the numbers of ``hash_uniform(seed, tag, key, i)`` through the normal quantile."""
    # the first 13 hex digits are the upper 52 bits of the first 8 bytes
    bits = md5_heads(f"{seed}|{tag}|{key}|".encode(), n) >> np.uint64(12)
    u = (bits.astype(float) + 0.5) / 2.0 ** 52
    q = u - 0.5
    z = np.polyval(PPF_A, q * q) * q / (np.polyval(PPF_B, q * q) * q * q + 1.0)
    out = np.flatnonzero((u < PPF_LOW) | (u > 1 - PPF_LOW))
    tail = np.sqrt(-2.0 * np.log(np.where(u[out] < 0.5, u[out], 1.0 - u[out])))
    z[out] = np.copysign(np.polyval(PPF_C, tail) / (np.polyval(PPF_D, tail) * tail + 1.0), q[out])
    return z


#: MD5 (RFC 1321): the shifts of the four rounds, the words they read and their constants.
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
READS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
FIRST = [np.array([x], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_heads(prefix: bytes, n: int) -> np.ndarray:
    """The first 8 bytes, as a number, of the MD5 digests of ``prefix`` followed by each of the numbers 0 to ``n`` - 1 in decimal: all digests step by step together."""
    if len(prefix) + len(str(n)) > 55:  # more than one block
        return np.frombuffer(b"".join(hashlib.md5(prefix + i).digest() for i in _numbers(n)), ">u8")[::2].astype(np.uint64)
    words = list(np.frombuffer(prefix.ljust(64, b"\0"), "<u4").astype(np.uint32).reshape(16, 1))
    for at, w in _endings(len(prefix), n):
        words[at] = words[at] | w
    a, b, c, d = FIRST
    for i in range(64):
        if i < 16:
            f = (c ^ d) & b ^ d
        elif i < 32:
            f = (b ^ c) & d ^ c
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = ~d | b
            f = f ^ c
        f = f + a + (words[READS[i]] + SINES[i])
        a, d, c, b = d, c, b, b + (f << np.uint32(SHIFTS[i]) | f >> np.uint32(32 - SHIFTS[i]))
    ends = np.stack([a + FIRST[0], b + FIRST[1]], 1).astype("<u4")
    return ends.view(">u8")[:, 0].astype(np.uint64)


@lru_cache(maxsize=64)
def _endings(start: int, n: int) -> list[tuple[int, np.ndarray]]:
    """(place, words) of the block's words that hold more than a prefix of ``start`` bytes: the digits of each number, the closing bit and the length."""
    digits = _numbers(n)
    block = np.frombuffer(b"".join((b"\0" * start + i + b"\x80").ljust(56, b"\0") + (8 * (start + len(i))).to_bytes(8, "little") for i in digits), "<u4").reshape(-1, 16)
    return [(at, block[:, at].astype(np.uint32)) for at in range(16) if block[:, at].any()]


@lru_cache(maxsize=2)
def _numbers(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def _lognormal(z: np.ndarray, mean: float, cv: float, high: float = math.inf) -> np.ndarray:
    sigma = math.sqrt(math.log(1 + cv * cv))
    return np.minimum(np.maximum(np.exp(math.log(max(mean, 1e-9)) - sigma * sigma / 2 + sigma * z), 1e-9), high)


LEVELS = (0.1, 0.5, 0.9)


def volumetric(df: DataFrame, n: int, seed: int, *, entity: str = "entity_id", lateral: str = "lateral", pay: str = "pay",
               porosity: str = "porosity", saturation: str = "saturation", recovery: str | None = None, cv: float = CV_PAY) -> DataFrame:
    """p10/p50/p90/mean/sd of the oil in place per entity, and rec_p10/p50/p90 of what a ``recovery`` factor in percent leaves recoverable.

    The ``n`` draws of an entity stay where its row is: one array each, of which only the figures leave the task. A null parameter gives null figures.
    """
    base = ["p10", "p50", "p90", "mean", "sd"]
    out = base + ([f"rec_{x}" for x in ("p10", "p50", "p90")] if recovery else [])
    names = [pay, porosity, saturation] + ([recovery] if recovery else [])
    rows = df.select(F.col(entity).alias("entity"), drainage_area(lateral).cast("double").alias("area"), *[F.col(x).cast("double").alias(f"v{i}") for i, x in enumerate(names)])
    ddl = T.StructType([T.StructField(entity, rows.schema["entity"].dataType), *[T.StructField(x, T.DoubleType()) for x in out]])
    plan = [("area", CV_AREA, math.inf), ("pay", cv, math.inf), ("porosity", cv * 0.8, POROSITY_MAX), ("saturation", cv * 0.6, SATURATION_MAX), ("recovery", 0.2, math.inf)]

    def figures(key, means: list) -> list:
        if any(m is None for m in means):
            return [None] * len(out)
        area, pay_, por, sat, *rest = (_lognormal(draws(seed, tag, key, n), m, spread, high) for (tag, spread, high), m in zip(plan, means))
        v = area * pay_ * (por / 100.0) * (sat / 100.0) * RHO / BO
        got = [*np.quantile(v, LEVELS).tolist(), float(v.mean()), float(v.std())]
        return got + np.quantile(v * rest[0] / 100.0, LEVELS).tolist() if rest else got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *means = (c_.to_pylist() for c_ in batch.columns)
            rows_ = [figures(k, list(m)) for k, *m in zip(keys, *means)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows_], pa.float64()) for i in range(len(out)))], names=[entity, *out])

    # few bytes but much work each: over all cores, whatever the size of the files
    return spread(rows, "entity").mapInArrow(run, ddl)


# ------------------------------------------------------------------ copula aggregation
def order_statistics(errors: DataFrame, bucket: str, value: str) -> DataFrame:
    """The sorted sample of every bucket as rows: bucket, k (from 0), lo (the k-th smallest value), hi (the next one, or the last itself), n.

    Ranks come from ranges of (bucket, value) and the counts of the ranges before, so no task and no row holds a bucket.
    """
    r = range_rank(errors.where(F.col(value).isNotNull()).select(bucket, F.col(value).cast("double").alias("lo")), [bucket], ["lo"], "k")
    following = r.select(bucket, (F.col("k") - 1).alias("k"), F.col("lo").alias("hi"))
    total = r.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return materialise(r.join(following, [bucket, "k"], "left").join(total, bucket).select(bucket, "k", "lo", F.coalesce("hi", "lo").alias("hi"), "n"))


def mapped(df: DataFrame, sample: DataFrame, bucket: str, u: str, out: str) -> DataFrame:
    """Empirical quantile ``out`` at level ``u`` of every row's bucket: linear between the plotting positions (i + .5)/n, by a join at the position's rank."""
    size = sample.where("k = 0").select(bucket, F.col("n").alias("_n"))
    d = df.join(size, bucket).withColumn("_pos", F.greatest(F.lit(0.0), F.least(F.col(u) * F.col("_n") - 0.5, (F.col("_n") - 1).cast("double"))))
    d = d.withColumn("_k", F.floor("_pos"))
    at = sample.select(F.col(bucket).alias("_b"), F.col("k").alias("_k"), "lo", "hi")
    return d.join(at, (F.col(bucket) == F.col("_b")) & (d["_k"] == at["_k"])).withColumn(out, F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_pos") - d["_k"])).drop("_n", "_pos", "_b", "_k", "lo", "hi")


def aggregate_copula(wells: DataFrame, samples: DataFrame, rhos: Sequence[float], n_sims: int, seed: int, *, scope: Sequence[str] = (), entity: str = "entity_id",
                     best: str = "best", group: str = "grp", bucket: str = "bucket") -> DataFrame:
    """Total p10/p50/p90 per scope and ρ with wells of a group sharing one Gaussian factor. ``samples``: :func:`order_statistics` of the errors.

    Rows are entity × ρ × simulation; totals are summed map-side, so what is shuffled is one row per (scope, ρ, simulation), as long as the
    sample is small enough for Spark to send it to the draws; a larger one is joined by rank.
    """
    scope = list(scope)
    w = wells.select(*scope, entity, best, group, bucket)
    ref = mapped(w.withColumn("_u", F.lit(0.10)), samples, bucket, "_u", "_e")
    ref = ref.groupBy(*scope).agg(F.sum(F.col(best) * F.exp("_e")).alias("sum_well_p10"), F.sum(best).alias("sum_best"), F.count(F.lit(1)).alias("n_wells"))
    fields = T.StructType([T.StructField("_x", w.schema[entity].dataType), T.StructField("_g", w.schema[group].dataType), T.StructField("_s", T.IntegerType()), T.StructField("_zg", T.DoubleType()), T.StructField("_ze", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.array(np.arange(n_sims), pa.int32())
        shared: dict = {}
        for batch in batches:
            for i, (x, g) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if g not in shared:
                    if len(shared) >= 256:
                        shared.clear()
                    shared[g] = draws(seed, "group", g, n_sims)
                one = pa.array([0] * n_sims, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(one), batch.column(1).slice(i, 1).take(one), number, pa.array(shared[g]), pa.array(draws(seed, "entity", x, n_sims))],
                                                 names=["_x", "_g", "_s", "_zg", "_ze"])

    drawn = spread(w.select(entity, group), entity).mapInArrow(run, fields).select(F.col("_x").alias(entity), "_s", "_zg", "_ze")
    # the wells are few against their draws: Spark sends them along where their size allows
    d = drawn.join(materialise(w), entity)
    d = d.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in rhos])))  # the draws are shared by all ρ
    d = d.withColumn("_u", normal_cdf(F.sqrt("rho") * F.col("_zg") + F.sqrt(1.0 - F.col("rho")) * F.col("_ze")))
    d = mapped(d, samples, bucket, "_u", "_e").withColumn("_v", F.col(best) * F.exp("_e"))
    sims = d.groupBy(*scope, "rho", "_s").agg(F.sum("_v").alias("_t"))
    p = sims.groupBy(*scope, "rho").agg(F.percentile("_t", F.array(*map(F.lit, LEVELS))).alias("_p"), F.avg("_t").alias("mean"))  # n_sims values
    if scope:
        j = p.join(ref, scope)
    else:
        j = p.withColumn("_r", ref.agg(F.struct(*[F.max(x).alias(x) for x in ref.columns])).scalar()).select("*", "_r.*")
    return j.select(*scope, "rho", "n_wells", *[F.get("_p", i).alias(x) for i, x in enumerate(("p10", "p50", "p90"))], "mean", "sum_best", "sum_well_p10",
                    (F.get("_p", 0) - F.col("sum_well_p10")).alias("aggregation_gain"))
