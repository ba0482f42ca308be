"""Centroid clustering in whole numbers over subvector dictionaries.

Vectors are dealt into shards. In every shard each block of dimensions is encoded, without loss, by a dictionary of the distinct subvectors that occur
there. A round computes the exact squared distance of every dictionary entry to every centroid's part once; the distance of a vector is the sum
of what its codes point to, and the sums of the members are dictionary entries times how often each cluster holds them.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import col, schema, stored, table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64.0, 1
#: Dimensions of a block; whole numbers of a small range repeat often in pairs, and seldom in longer blocks.
WIDTH = 2
#: Vectors of a shard at most: the bound of its memory and of its dictionaries.
SHARD = 1 << 15
#: Whole components end here on both sides; sums over a shard then fit 64 bits.
MOST = 1 << 40
FAR = (1 << 63) - 1

Centroids = list[list[int]]


def whole(vectors: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count (exactly ``dims`` components, none null or non-finite), and the whole components of those, floor(scale * x)."""
    size = np.asarray(vectors.value_lengths().fill_null(-1))
    right = np.flatnonzero(size == dims)
    flat = vectors.take(pa.array(right)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64).reshape(len(right), dims)
    sound = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        q = np.clip(np.floor(scale * x[sound]), -MOST, MOST).astype(np.int64)
    return right[sound], q


def encode(q: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per block: its distinct subvectors, and the code of every vector."""
    entries, codes = [], []
    for at in range(0, q.shape[1], width):
        sub, code = np.unique(q[:, at:at + width], axis=0, return_inverse=True)
        entries.append(sub)
        codes.append(code.reshape(-1).astype(np.uint16 if len(sub) <= 1 << 16 else np.uint32))
    return entries, codes


def nearest(entries: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of every vector of a shard; ties go to the smaller number. Distances are exact below 2^63 - 1, where they end."""
    n, k = len(codes[0]), len(centroids)
    total, rough, at = np.zeros((n, k), np.int64), np.zeros((n, k)), 0
    for sub, code in zip(entries, codes, strict=True):
        gap = sub[:, None, :] - centroids[None, :, at:at + sub.shape[1]]
        with np.errstate(over="ignore"):
            total += (gap * gap).sum(2)[code]
        if np.abs(gap).max(initial=0) > 1 << 27:  # the sum may leave 64 bits
            rough += (gap.astype(float) ** 2).sum(2)[code]
        at += sub.shape[1]
    total[(rough > 9.2e18) | (total < 0)] = FAR
    best = total.argmin(1)
    return best, total[np.arange(n), best]


def read_shard(row: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Dictionaries and codes of a stored shard."""
    flat, wide = np.frombuffer(row["entries"], np.int64), row["dims"]
    entries, codes, at, byte = [], [], 0, 0
    for size, first in zip(row["sizes"], range(0, wide, row["width"])):
        w = min(row["width"], wide - first)
        entries.append(flat[at:at + size * w].reshape(size, w))
        kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        codes.append(np.frombuffer(row["codes"], kind, row["n"], byte))
        at, byte = at + size * w, byte + row["n"] * kind.itemsize
    return entries, codes


def shards(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: float, width: int) -> DataFrame:
    """The vectors that count as encoded shards: n, dims, width, ids, sizes, entries, codes."""
    rows = df.select(col(id_col).alias("id"), col(vector_col).alias("v"))
    out = schema("n int, dims int, width int, sizes array<int>, entries binary, codes binary").add("ids", T.ArrayType(rows.schema["id"].dataType))
    arrow = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("width", pa.int32()), ("sizes", pa.list_(pa.int32())), ("entries", pa.binary()), ("codes", pa.binary())])

    def pack(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        entries, codes = encode(np.concatenate(parts), width)
        every = pa.concat_arrays(ids)
        row = [[len(codes[0])], [dims], [width], [[len(e) for e in entries]], [b"".join(e.tobytes() for e in entries)], [b"".join(c.tobytes() for c in codes)]]
        made = [pa.array(v, f.type) for v, f in zip(row, arrow, strict=True)]
        return pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)], names=[*arrow.names, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                piece = batch.slice(start, SHARD)
                kept, q = whole(piece.column(1), dims, scale)
                if held and held + len(kept) > SHARD:
                    yield pack(ids, parts)
                    ids, parts, held = [], [], 0
                if len(kept):
                    ids.append(piece.column(0).take(pa.array(kept)))
                    parts.append(q)
                    held += len(kept)
        if held:
            yield pack(ids, parts)

    return stored(rows.mapInArrow(run, out))


def first_centroids(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: float, k: int, seed: int) -> Centroids:
    """The whole components of the ``k`` vectors that count with the smallest hash of ``seed:id``; equal ids by their components, null ids last."""
    rows = df.select(col(id_col).cast("string").alias("id"), F.transform(col(vector_col), lambda x: x.cast("double")).alias("v"))
    # null if any component is null; a sum of finite numbers may be infinite, so they are judged one by one
    rows = rows.filter((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole_ = F.transform("v", lambda x: F.floor(F.least(F.greatest(F.floor(x * scale), F.lit(float(-MOST))), F.lit(float(MOST)))))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256)
    got = rows.select(key.alias("key"), whole_.alias("q")).orderBy(F.col("key").asc_nulls_last(), "q").limit(k).collect()
    return [[int(x) for x in r.q] for r in got]


def moved(data: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round. Only a count and one sum a dimension reach the driver for each cluster."""
    now, dims = np.array(centroids, np.int64), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries, codes = read_shard(row)
                best, _ = nearest(entries, codes, now)
                sums = [np.bincount(best.astype(np.int64) * len(sub) + code, minlength=len(now) * len(sub)).reshape(len(now), -1) @ sub for sub, code in zip(entries, codes, strict=True)]
                count = np.bincount(best, minlength=len(now))
                held = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held], pa.int64()), pa.array(np.concatenate(sums, 1)[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    part = data.drop("ids").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    # one decimal sum a dimension: no group holds more than a number
    every = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
    out = [list(c) for c in centroids]
    for r in every.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def assigned(data: DataFrame, centroids: Centroids) -> DataFrame:
    """id, cluster and distance of every vector."""
    now = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            rows = batch.drop_columns(["ids"]).to_pylist()
            for i, row in enumerate(rows):
                best, far = nearest(*read_shard(row), now)
                yield pa.RecordBatch.from_arrays([ids.slice(i, 1).flatten(), pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    return data.mapInArrow(run, T.StructType([T.StructField("id", data.schema["ids"].dataType.elementType), *schema("cluster int, distance bigint")]))


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: float = SCALE,
            seed: int = SEED, width: int = WIDTH) -> tuple[DataFrame, Centroids]:
    """(``id_col``, cluster and distance per vector that counts; the final centroids).

    Vectors with another number of components, or with a null or non-finite one, don't count. Null ids are kept, repeated rows are repeated; ties go to
    the smaller centroid; fewer vectors than ``k`` give fewer centroids, none an empty result. Components beyond 2^40 in either direction end there,
    and distances at 2^63 - 1. Other columns are not looked at. Vectors are read once and stay encoded in the shared folder.
    """
    centroids = first_centroids(df, id_col, vector_col, dims, scale, k, seed)
    data = shards(df, id_col, vector_col, dims, scale, width)
    if not centroids:
        return df.limit(0).select(col(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(data, centroids)
    return assigned(data, centroids).withColumnRenamed("id", id_col), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = stored(found)
    sums = {r["cluster"]: int(r["far"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()}
    rows = [(i, Decimal(sums[i]), Decimal(sum(sums.values())), digest(c)) for i, c in enumerate(centroids) if i in sums]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    end = lambda c: F.least(F.col(c), F.lit(FAR)).cast("bigint").alias(c)
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", end("cluster_inertia"), end("inertia"), "centroid_sha256")
