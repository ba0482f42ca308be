"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2 bits of each other share a value that is within 1 bit of both. Every distinct fingerprint therefore emits its
65 variants (itself and every single flip); fingerprints that meet on a variant are candidates. A variant has at most 65 fingerprints
around it, so no group is large however many documents share one fingerprint.
"""
from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import col, map_texts, schema, stored, table, text_of
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included. No words: zero."""
    words = data.lower().split()
    if not words:
        return 0
    one = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return one(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[shingle - 1:]
    hashes = np.fromiter((one(flat[a:b], seed) for a, b in zip(starts, last)), np.uint64, len(last))
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[k:k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``keep`` plus the fingerprint as a signed long."""

    def make():
        def work(values: list[str]) -> dict[str, list]:
            fps = [fingerprint(v.encode("utf-8", "surrogatepass"), shingle, seed) for v in values]
            return {"fp": [f - (1 << 64) if f >> 63 else f for f in fps]}

        return work

    return map_texts(df, keep, text_of(text_col), schema("fp bigint"), make)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that connect all distinct fingerprints (column fp) within RADIUS of each other.

    The fingerprints around one variant lie within RADIUS of each other, so an edge from the smallest of them to each of the rest connects
    what all their pairs would.
    """
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    around = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = around.groupBy("variant").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def grouped(docs: DataFrame, *least: Column) -> DataFrame:
    """fp and root (one fingerprint of its component) of every fingerprint of ``docs``, with the smallest ``least`` among the documents that have it."""
    seen = stored(docs.groupBy("fp").agg(*least))
    # few bytes, but many variants each: spread over the cluster before they are made
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    label = components(links(seen.select("fp").repartition(tasks, "fp")))
    return seen.join(label, seen.fp == label.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per input row: ``id_col``, fp (signed long) and component_id, the smallest id that links reach.

    Texts without words, null ones included, have fingerprint zero and link like any other. Rows with a null id keep it and take part in the
    links; a component of null ids only has a null component_id. Repeated rows repeat. An empty table gives an empty result.
    """
    docs = stored(fingerprints(df.select(col(id_col).alias("id"), text_of(text_col).alias("text")), ["id"], shingle=shingle, seed=seed))
    least = grouped(docs, F.min("id").alias("id"))
    smallest = least.groupBy("root").agg(F.min("id").alias("component_id"))
    by_fp = least.join(smallest, "root").select("fp", "component_id")
    return docs.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` but for near duplicates: of each component one row stays, that with the smallest id (null last), then the smallest hash of its text.

    Rows are told apart by id and text, so rows of one id with other texts stand for themselves, and of rows that share both one stays. Any other columns are carried along, whatever
    their names.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[col(c).alias(n) for c, n in names.items()]).withColumn("mark", F.xxhash64(text_of(names[text_col])))
    key, mark = F.col(names[id_col]), F.col("mark")
    docs = stored(fingerprints(rows.select(key.alias("id"), "mark", text_of(names[text_col]).alias("text")), ["id", "mark"], shingle=shingle, seed=seed))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    roots = grouped(docs, F.min(place).alias("place"))
    first = roots.groupBy("root").agg(F.min("place").alias("first"))
    best = roots.join(first, "root").select("fp", "first")
    judged = stored(docs.groupBy("id", "mark", "fp").agg(F.count(F.lit(1)).alias("n")).join(best, "fp").select("id", "mark", "n", (place == F.col("first")).alias("stays")))
    gone, repeated = (judged.filter(c).select(F.col("id").alias("i"), F.col("mark").alias("m")) for c in ("not stays", "stays and n > 1"))
    same = key.eqNullSafe(F.col("i")) & (mark == F.col("m"))
    kept = rows.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates([names[id_col], "mark"]))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
