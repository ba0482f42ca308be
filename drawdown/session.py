"""Session settings. Operators never need these; they are the defaults used by the tests and the bench."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("drawdown")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; in local mode, where it is unset, one made for this session."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
              or spark.sparkContext.getCheckpointDir())
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="drawdown-"))
    return spark.sparkContext.getCheckpointDir()


#: Writer options of tables whose file size is near their size in memory. Spark judges by file size which side of a join is broadcast,
#: and compressed files of repeated values take ten times as much and more on the driver.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def materialise(df: DataFrame, partitions: int | None = None, plain: bool = False) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where one result feeds several branches (a monthly roll-up, one fit per entity): the branches then
    scan a small columnar table with known size instead of repeating the upstream work, and a lost executor
    costs a re-read, not a recomputation. The files go when the application ends. ``plain``: see PLAIN.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    out.write.mode("errorifexists").options(**PLAIN if plain else {}).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into at least as many partitions as there are cores.

    Packed series are tiny in bytes but expensive to fit; without a stated count, adaptive coalescing would put
    them into a handful of tasks. A following groupBy on the same keys reuses this partitioning.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
