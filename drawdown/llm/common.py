"""Helpers shared by the corpus operators: tables, Arrow batches over texts, stored intermediates."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text handed to a batch function at once; a single longer text makes a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset (tests in local mode) one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs a re-read.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that no later plan reads."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pieces(batch: pa.RecordBatch, sizes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about BATCH_BYTES."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, keep: Sequence[str], value: Column, outputs: T.StructType, make: Callable[[], Callable[[list], dict[str, list]]],
              weight: Column | None = None) -> DataFrame:
    """Add ``outputs`` to the columns ``keep``: ``make()`` is called once a task and gives a function from the list of values
    of some rows to a list per output. Kept columns whose name is that of an output are replaced. ``weight``: bytes of a value that has no length."""
    new = {f.name.lower() for f in outputs}
    keep = [c for c in keep if c.lower() not in new]
    fields = {f.name: f for f in df.schema}
    schema = T.StructType([*(fields[c] for c in keep), *outputs])
    source = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], value.alias("v"), (F.lit(0) if weight is None else weight).alias("w"))
    names = [f.name for f in schema]
    width = len(keep)
    kinds = [to_arrow(f.dataType) for f in outputs]
    order = [f.name for f in outputs]
    weighed = weight is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            values = batch.column(width).to_pylist()
            at = 0
            sizes = batch.column(width + 1).to_pylist() if weighed else [len(x) if x is not None else 0 for x in values]
            for piece in pieces(batch, sizes):
                got = work(values[at:at + piece.num_rows])
                at += piece.num_rows
                yield pa.RecordBatch.from_arrays([*piece.columns[:width], *(pa.array(got[o], k) for o, k in zip(order, kinds, strict=True))], names=names)

    return source.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind.simpleString()]


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
