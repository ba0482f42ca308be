"""Validation of uploaded tables, preview, commit with journal, undo."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Rule:
    """One column of an upload: kind is str, int, float, ym, date, enum or ref (key of a reference table)."""
    name: str
    label: str
    kind: str
    required: bool = True
    minimum: float | None = None
    choices: Mapping[str, str] = field(default_factory=dict)


def normalise_header(h: str) -> str:
    for ch in " _（）()-":
        h = h.replace(ch, "")
    return h.lower()


def map_headers(columns: Sequence[str], rules: Sequence[Rule]) -> tuple[dict[str, str], list[str], list[str]]:
    """(header → column, ignored headers, missing required columns)."""
    alias = {}
    for r in rules:
        for a in (r.name, r.label, r.label.split("(")[0]):
            alias[normalise_header(a)] = r.name
    mapping, ignored = {}, []
    for h in columns:
        k = alias.get(normalise_header(h))
        if k and k not in mapping.values():
            mapping[h] = k
        elif not k:
            ignored.append(h)
    return mapping, ignored, [r.name for r in rules if r.required and r.name not in mapping.values()]


def _ym(v: Column) -> Column:
    m = F.regexp_extract(v, r"^(20\d{2})[-/.年]?\s*(\d{1,2})月?(?:[-/.]\d{1,2}(?:\s.*)?)?$", 2)
    y = F.regexp_extract(v, r"^(20\d{2})[-/.年]?\s*(\d{1,2})月?(?:[-/.]\d{1,2}(?:\s.*)?)?$", 1)
    mo = F.when(m != "", m.cast("int"))
    return F.when(mo.between(1, 12), F.format_string("%s-%02d", y, mo))


def _date(v: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(v, "[年月/.]", "-"), "日", "")
    return F.date_format(F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-M-d")), F.try_to_timestamp(x, F.lit("yyyy-M-d H:m:s"))), "yyyy-MM-dd")


def _typed(rule: Rule, v: Column) -> tuple[Column, Column]:
    """(typed value, message or NULL) for a non-empty cell."""
    if rule.kind in ("int", "float"):
        num = F.regexp_replace(v, ",", "").try_cast("double")
        bad = num.isNull() | F.isnan(num)
        if rule.kind == "int":
            bad = bad | (F.abs(num - F.rint(num)) > 1e-9)
        msg = F.when(bad, f"not {'an integer' if rule.kind == 'int' else 'a number'}")
        if rule.minimum is not None:
            msg = F.coalesce(msg, F.when(num < rule.minimum, f"below {rule.minimum:g}"))
        return (F.rint(num).cast("long") if rule.kind == "int" else num), msg
    if rule.kind == "ym":
        return _ym(v), F.when(_ym(v).isNull(), "not a month")
    if rule.kind == "date":
        return _date(v), F.when(_date(v).isNull(), "not a date")
    if rule.kind == "enum":
        m = F.create_map(*[F.lit(x) for kv in rule.choices.items() for x in kv])
        got = F.coalesce(F.try_element_at(m, F.lower(v)), F.try_element_at(m, v))
        return got, F.when(got.isNull(), "not an allowed value")
    if rule.kind == "ref":
        return F.upper(v), F.lit(None).cast("string")
    return v, F.lit(None).cast("string")


def validate(raw: DataFrame, rules: Sequence[Rule], keys: Sequence[str], *, line: str = "line",
             references: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, issue rows). ``raw`` holds strings and a line number; ``references`` one-column key tables per ref column."""
    d = raw.select(line, *[F.trim(F.coalesce(F.col(r.name), F.lit(""))).alias(r.name) for r in rules])
    for r in rules:
        if r.kind == "ref":
            known = references[r.name].select(F.upper(F.col(references[r.name].columns[0]).cast("string")).alias("_k")).distinct().withColumn(f"_ok_{r.name}", F.lit(True))
            d = d.withColumn("_k", F.upper(F.col(r.name))).join(known, "_k", "left").drop("_k")
    cells, typed = [], []
    for r in rules:
        v = F.col(r.name)
        val, msg = _typed(r, v)
        if r.kind == "ref":
            msg = F.when(F.col(f"_ok_{r.name}").isNull(), "unknown key")
        full = F.when(v == "", F.lit("required") if r.required else None).otherwise(msg)
        cells.append(F.when(full.isNotNull(), F.struct(F.lit(r.name).alias("column"), v.alias("value"), full.alias("message"))))
        typed.append(F.when(v != "", val).alias(r.name))
    d = d.withColumn("_issues", F.array_compact(F.array(*cells)))
    clean = d.where(F.size("_issues") == 0).select(line, *typed)
    # duplicates: every row of a key after its first line
    first = clean.groupBy(*keys).agg(F.min(line).alias("_first"))
    marked = clean.join(first, list(keys))
    dup = marked.where(F.col(line) > F.col("_first")).select(
        line, F.lit(",".join(keys)).alias("column"), F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys]).alias("value"),
        F.concat(F.lit("same key as line "), F.col("_first").cast("string")).alias("message"))
    issues = d.select(line, F.explode("_issues").alias("i")).select(line, "i.column", "i.value", "i.message").unionByName(dup)
    return marked.where(F.col(line) == F.col("_first")).drop("_first"), issues


def plan_warnings(plan: DataFrame, actual: DataFrame, *, keys: Sequence[str], plan_cols: Sequence[str], actual_col: str, limit: float = 0.5) -> DataFrame:
    total = sum((F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in plan_cols), F.lit(0.0))
    j = plan.withColumn("_plan", total).join(actual.select(*keys, F.col(actual_col).alias("_actual")), list(keys)).where("_actual > 0")
    dev = (F.col("_plan") - F.col("_actual")) / F.col("_actual")
    return j.where(F.abs(dev) > limit).select(*keys, F.col("_plan").alias("planned"), F.col("_actual").alias("actual"), (100 * dev).alias("deviation_pct"))


def preview(rows: DataFrame, existing: DataFrame, keys: Sequence[str], unit: str, *, ranges: Sequence[str] = ()) -> DataFrame:
    """Rows to insert and to replace, units, and the smallest and largest value of every column in ``ranges``."""
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(1))
    j = rows.join(have, list(keys), "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_have").isNull().cast("long")).alias("n_insert"), F.count("_have").alias("n_replace"),
                 F.count_distinct(unit).alias("n_units"), *[f(x).alias(f"{n}_{x}") for x in ranges for n, f in (("min", F.min), ("max", F.max))])


def commit(existing: DataFrame, rows: DataFrame, keys: Sequence[str], batch_id: str) -> tuple[DataFrame, DataFrame]:
    """(new table state, journal rows). The journal keeps each key with the row it replaced, so undo needs nothing else."""
    keys = list(keys)
    cols = existing.columns
    new = rows.select(*cols)
    state = existing.join(new.select(*keys), keys, "left_anti").unionByName(new)
    old = existing.withColumn("replaced", F.struct(*cols)).select(*keys, "replaced")
    journal = new.select(*keys).join(old, keys, "left").withColumn("batch_id", F.lit(batch_id))
    return state, journal


def undo(current: DataFrame, journal: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    back = journal.where("replaced IS NOT NULL").select("replaced.*")
    return current.join(journal.select(*keys), keys, "left_anti").unionByName(back.select(*current.columns))


def history(batches: DataFrame) -> DataFrame:
    """Batches with the one per type that may still be undone: the newest active one. Presentation order is left to the reader."""
    newest = batches.where("status = 'active'").groupBy("type").agg(F.max("created").alias("_newest"))
    d = batches.join(newest, "type", "left")
    return d.withColumn("can_undo", F.coalesce((F.col("status") == "active") & (F.col("created") == F.col("_newest")), F.lit(False))).drop("_newest")
