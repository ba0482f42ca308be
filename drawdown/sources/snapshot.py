"""Result snapshots keyed by the content of their inputs."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import PLAIN, shared_folder


def fingerprint(inputs: Sequence[tuple[DataFrame, Sequence[str]]], *extra: str) -> str:
    """Digest of the named columns of every input, plus parameters: the row count and the sums of two 64-bit hashes of each row.

    A sum does not depend on the order of rows, and any changed value changes its row's hashes. One aggregate per input reaches the driver.
    """
    parts = [str(x) for x in extra]
    for df, cols in inputs:
        row = F.struct(*[F.col(x) for x in cols])
        both = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64(row), F.xxhash64(F.lit(1), row))]
        parts.append("|".join(str(v) for v in df.agg(F.count(F.lit(1)).cast("string"), *both).first()))
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


def files_of(df: DataFrame) -> tuple:
    """Name, length and time of change of the files behind a table: no data is read, and a rewritten file is another one."""
    spark = df.sparkSession
    out = []
    for name in sorted(df.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        s = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)


def snapshot(spark: SparkSession, key: str, build: Callable[[], Mapping[str, DataFrame]], names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables stored under ``key``; built and written only when one of them is missing. The key names the content, not the session, so another
    session with the same folder finds them."""
    root = f"{shared_folder(spark).rstrip('/')}/snapshots/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(f"{root}/{DONE}")):
        # written aside and named at the end: of two sessions that build one key, the later finds the place taken and drops its copy
        aside = f"{root}-{uuid.uuid4().hex}"
        made = build()
        for n in names:
            made[n].write.mode("errorifexists").options(**PLAIN).parquet(f"{aside}/{n}")
        fs.create(hadoop(f"{aside}/{DONE}"), True).close()
        if fs.exists(hadoop(root)) or not fs.rename(hadoop(aside), hadoop(root)):
            fs.delete(hadoop(aside), True)
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


#: Name of the file that a finished snapshot holds.
DONE = "_COMPLETE"
