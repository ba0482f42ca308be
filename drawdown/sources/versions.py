"""Versioned tables: complete versions next to each other, and a log of commits that only one of two writers can extend."""
from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

LOG = "_commits"


class Conflict(RuntimeError):
    """Another writer committed first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, root: str) -> list[dict]:
    """The commits of a table, oldest first: number, version, folder. None if the table does not exist."""
    fs, at = _fs(spark, f"{root.rstrip('/')}/{LOG}")
    if not fs.exists(at):
        return []
    rows = spark.read.schema("number int, version string, folder string").json(f"{root.rstrip('/')}/{LOG}/*.json").orderBy("number").collect()  # one short row a commit
    return [r.asDict() for r in rows]


def _commit(spark: SparkSession, root: str, entry: dict) -> None:
    """Create the log entry of this number. Creation without overwriting is the compare-and-set: the second writer of a number fails."""
    fs, at = _fs(spark, f"{root.rstrip('/')}/{LOG}/{entry['number']:08d}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception).lower():
            raise Conflict(f"commit {entry['number']} of {root} was made by another writer") from None
        raise
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()


def publish(df: DataFrame, root: str, version: str, *, after: int | None = None, partition_by: Sequence[str] = ()) -> int:
    """Write ``df`` as a complete version and make it the latest; returns the commit's number.

    ``after``: the commit that the caller read (0 for a new table). If another one was made since, :class:`Conflict` is raised and the table stays as
    it is; without it the caller replaces whatever is there. Data lies in a folder of its own before the commit names it, so readers never see half of it.
    """
    spark = df.sparkSession
    done = commits(spark, root)
    last = done[-1]["number"] if done else 0
    if after is not None and after != last:
        raise Conflict(f"{root} is at commit {last}, not {after}")
    folder = f"data-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{root.rstrip('/')}/{folder}")
    _commit(spark, root, {"number": last + 1, "version": version, "folder": folder})
    return last + 1


def append(df: DataFrame, root: str, version: str, *, after: int | None = None) -> int:
    """A version with the latest one's rows and ``df``'s, columns by name; columns that one side lacks are null there."""
    done = commits(df.sparkSession, root)
    rows = read_version(df.sparkSession, root).unionByName(df, allowMissingColumns=True) if done else df
    return publish(rows, root, version, after=(done[-1]["number"] if done else 0) if after is None else after)


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The latest version, or the last commit of a named one."""
    done = [c for c in commits(spark, root) if version in (None, c["version"])]
    if not done:
        raise ValueError(f"no version {version or ''} at {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{done[-1]['folder']}")


def revert(spark: SparkSession, root: str) -> int:
    """Make the version before the latest one the latest again, as a commit of its own; nothing is written or deleted but the log entry."""
    done = commits(spark, root)
    if len(done) < 2:
        raise ValueError(f"{root} has no earlier version")
    _commit(spark, root, {"number": done[-1]["number"] + 1, "version": done[-2]["version"], "folder": done[-2]["folder"]})
    return done[-1]["number"] + 1


def history(spark: SparkSession, root: str) -> DataFrame:
    """number, version and the rows of every commit."""
    parts = [spark.read.parquet(f"{root.rstrip('/')}/{c['folder']}").agg(F.lit(c["number"]).alias("number"), F.lit(c["version"]).alias("version"), F.count(F.lit(1)).alias("n_rows")) for c in commits(spark, root)]
    if not parts:
        return spark.createDataFrame([], "number int, version string, n_rows bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
