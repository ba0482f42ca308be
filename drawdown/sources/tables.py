"""Readers and writers: CSV uploads, monthly report files, clause markdown, keyed upsert."""
from __future__ import annotations

import csv
import io
from collections.abc import Sequence

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import materialise

BBL_TO_T = 0.1364  # fixed value: barrels to tonnes


def _records(content: pd.Series) -> pd.Series:
    """The records of CSV files by their own header; a file is UTF-8 if all its bytes are, else GBK. Quoted fields may hold line ends."""

    def parsed(b: bytes) -> list[dict[str, str]]:
        try:
            text = b.decode("utf-8")
        except UnicodeDecodeError:
            text = b.decode("gbk", errors="replace")
        rows = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
        head = [h.strip() for h in next(rows, [])]
        # a header on its own still names the columns
        return [dict.fromkeys(head, ""), *(dict(zip(head, r)) for r in rows if any(x.strip() for x in r))]

    return content.map(parsed)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV files as strings: BOM removed, blank rows dropped, quoted line ends kept, every file read by its own encoding and its own header.

    Columns come in the order of the first file (by path), then those that only others have; a row has null where its file has no such column or the
    record is short. An upload is a file that a person sends, so a file is read whole by one task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read = F.pandas_udf(_records, "array<map<string,string>>")
    rows = files.select("path", F.posexplode(read("content")).alias("pos", "r"))
    rows = materialise(rows)
    heads = [r["h"] for r in rows.where("pos = 0").groupBy(F.map_keys("r").alias("h")).agg(F.min("path").alias("p")).orderBy("p").collect()]  # one row for each header in use
    names = list(dict.fromkeys(n for h in heads for n in h))
    if not names:
        raise ValueError(f"no file with a header at {path}")
    return rows.where("pos > 0").select(*[F.try_element_at("r", F.lit(n)).alias(n) for n in names])


def read_reports(spark: SparkSession, path: str, pools: Sequence[str]) -> DataFrame:
    """Monthly public-production exports: five of N columns, pool filter, unit conversion, irreversible identifier."""
    cols = T.StructType([T.StructField(n, T.StringType()) for n in ("ReportDate", "API_WELLNO", "Pool", "Oil", "Days")])
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    raw = raw.select(*[F.col(f.name) for f in cols]).where(F.upper("Pool").isin(*[p.upper() for p in pools]))
    well = F.concat(F.lit("ND-"), F.substring(F.sha1(F.expr("cast(cast(cast(API_WELLNO as double) as bigint) as string)").cast("binary")), 1, 8))
    return raw.select(well.alias("entity_id"), F.upper("Pool").alias("pool"), F.date_format(F.to_date("ReportDate"), "yyyy-MM").alias("ym"),
                      (F.coalesce(F.col("Oil").cast("double"), F.lit(0.0)) * BBL_TO_T).alias("oil"), F.coalesce(F.col("Days").cast("double"), F.lit(0.0)).alias("days"),
                      F.input_file_name().alias("source_file"))


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    """Markdown clause files: ``## [citation] title``, JSON meta comment, body, optional note; file order kept as ``pos``."""
    raw = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    body = F.split(F.concat(F.lit("\n"), "value"), r"\n## (?=\[)")
    d = raw.select("source", F.posexplode(body).alias("pos", "part")).where("pos > 0")
    meta = F.from_json(F.regexp_extract("part", r"(?s)<!--\s*meta:\s*(\{.*?\})\s*-->", 1),
                       "cfr string, parent string, kind string, level int, regulation string, zh_title string, source string")
    d = d.withColumn("citation", F.regexp_extract("part", r"^\[([^\]]+)\]", 1)).withColumn("meta", meta)
    title = F.trim(F.regexp_extract("part", r"^\[[^\]]+\][ \t]*([^\n]*)", 1))
    text = F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"(?s)<!--\s*meta:.*?-->", "")

    def strip(x):
        return F.regexp_replace(x, r"^\s+|\s+$", "")

    note = "要点（非官方中文说明）："
    return d.select("source", "pos", "citation", F.when(F.col("meta.zh_title").isNotNull(), F.replace(title, F.concat(F.lit(" · "), F.col("meta.zh_title")), F.lit(""))).otherwise(title).alias("title"),
                    strip(F.split_part(text, F.lit(note), F.lit(1))).alias("text"), F.nullif(strip(F.split_part(text, F.lit(note), F.lit(2))), F.lit("")).alias("note"), "meta")


# ------------------------------------------------------------------ writers
def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after replacing the rows whose keys occur in ``new``."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*existing.columns))


def entities_to_units(master: DataFrame, rules: DataFrame, on: Sequence[str]) -> DataFrame:
    """Assignment by rule table; entities outside the rules stay unassigned (NULL)."""
    return master.join(rules, list(on), "left")
