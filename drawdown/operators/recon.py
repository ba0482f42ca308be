"""Reconciliation between two evaluation dates, roll-forwards, attribution and sensitivities."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


from ..session import spread
from .decline import remaining_low_best
from .ranking import top_k

ROWS = ("opening", "production", "price_revision", "new_wells", "measure", "extension", "category_change", "technical_revision")
TOLERANCE = 1.0


def _sum_by(df: DataFrame, unit: str, value: Column, name: str) -> DataFrame:
    return df.groupBy(unit).agg(F.sum(value).alias(name))


def category_moves(open_old: DataFrame, open_new: DataFrame, close_old: DataFrame, production: DataFrame, *, unit: str = "unit_id",
                   entity: str = "entity_id") -> DataFrame:
    """(entity, unit, change, value): idle entities that came back, producing entities that were shut in."""
    live = ("ok", "short_history")
    prod = production.select(entity, "production")
    was_idle = open_old.where("status = 'not_producing'").select(entity)
    back = (close_old.where(F.col("status").isin(*live)).join(was_idle.hint("merge"), entity, "left_semi").join(prod.hint("merge"), entity, "left")
            .select(entity, unit, F.lit("reactivated").alias("change"), (F.col("remaining_low") + F.coalesce("production", F.lit(0.0))).alias("value")))
    was_on = open_old.where(F.col("status").isin(*live)).select(entity, F.col("remaining_low").alias("_v")).unionByName(
        open_new.select(entity, F.coalesce("reserves", F.lit(0.0)).alias("_v")))
    shut = (close_old.where("status = 'not_producing'").select(entity, unit).join(was_on.where("_v > 0").hint("merge"), entity).join(prod.hint("merge"), entity, "left")
            .select(entity, unit, F.lit("shut_in").alias("change"), (F.coalesce("production", F.lit(0.0)) - F.col("_v")).alias("value")))
    return back.unionByName(shut)


def reconcile(opening: DataFrame, closing: DataFrame, at_opening_price: DataFrame, done: DataFrame, new: DataFrame, production: DataFrame,
              moves: DataFrame, *, unit: str = "unit_id", entity: str = "entity_id") -> DataFrame:
    """One row per unit with every line; the technical revision is the residual, so the table closes by construction.

    ``opening`` / ``closing`` / ``at_opening_price``: component rows; ``done``: evaluated in-period measures.
    """
    nw = new.join(production.select(entity, "production").hint("merge"), entity, "left")  # entities grow with the input: not by way of the driver
    val = F.coalesce("reserves", F.lit(0.0)) + F.coalesce("production", F.lit(0.0))
    parts = [
        _sum_by(opening, unit, F.col("reserves"), "opening"), _sum_by(closing, unit, F.col("reserves"), "closing"),
        _sum_by(at_opening_price, unit, F.col("reserves"), "_at_open"), _sum_by(production, unit, -F.col("production"), "production"),
        _sum_by(nw.where("category = 'infill'"), unit, val, "new_wells"), _sum_by(nw.where("category = 'extension'"), unit, val, "extension"),
        _sum_by(done, unit, F.col("inc_remaining") + F.col("realized"), "measure"), _sum_by(moves, unit, F.col("value"), "category_change"),
    ]
    j = reduce(lambda a, b: a.join(b, unit, "full_outer"), parts)
    j = j.na.fill(0.0).withColumn("price_revision", F.col("closing") - F.col("_at_open"))
    known = sum((F.col(r) for r in ROWS if r != "technical_revision"), F.lit(0.0))
    return j.withColumn("technical_revision", F.col("closing") - known).select(unit, *ROWS, "closing")


def reconciliation_table(values: DataFrame, *, unit: str = "unit_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Long form with rounded lines and the closure check per unit."""
    calc = sum((F.col(r) for r in ROWS), F.lit(0.0))
    d = values.withColumn("_diff", F.col("closing") - calc)
    items = ", ".join(f"{i}, '{r}', {r}" for i, r in enumerate((*ROWS, "closing")))
    return d.select(unit, F.expr(f"stack({len(ROWS) + 1}, {items}) as (line, item, value)"), (F.abs("_diff") <= tolerance).alias("balanced")).withColumn(
        "value", F.round("value", 1))


def stored_opening(values: DataFrame, stored: DataFrame, *, unit: str = "unit_id") -> DataFrame:
    """Use stored opening totals only when every unit has one; the difference goes to the technical revision."""
    n_all = values.agg(F.count_distinct(unit)).scalar()
    have = stored.select(unit, F.col("reserves").alias("_st"))
    n_have = values.join(have, unit, "left_semi").agg(F.count_distinct(unit)).scalar()
    j = values.join(have, unit, "left").withColumn("_use", n_have == n_all)
    opening = F.when(F.col("_use"), F.col("_st")).otherwise(F.col("opening"))
    return j.withColumn("_shift", opening - F.col("opening")).withColumn("opening", opening).withColumn(
        "technical_revision", F.col("technical_revision") - F.col("_shift")).withColumn(
        "opening_source", F.when(F.col("_use"), "stored").otherwise("recomputed")).drop("_st", "_use", "_shift")


def rollforward(opening: DataFrame, closing: DataFrame, key: str, *, moves: dict[str, str], rest: str, fresh: str, unit: str = "unit_id",
                value: str = "reserves") -> DataFrame:
    """Roll of booked items between two states: full-outer join, one move per item, opening + moves = closing.

    ``moves`` maps a closing status to the name of its leaving move; other leavers are ``rest``; ``fresh`` names new items.
    """
    o = opening.select(key, unit, F.col("status").alias("_os"), F.col(value).alias("_ov"))
    cl = closing.select(key, unit, F.col("status").alias("_cs"), F.col(value).alias("_cv"))
    j = o.join(cl, [key, unit], "full_outer")
    was, now = F.coalesce(F.col("_os") == "booked", F.lit(False)), F.coalesce(F.col("_cs") == "booked", F.lit(False))
    leave = F.lit(rest)
    for st, name in moves.items():
        leave = F.when(F.col("_cs") == st, name).otherwise(leave)
    lines = F.array(
        F.struct(F.lit("opening").alias("move"), F.when(was, F.col("_ov")).alias("v")),
        F.struct(F.when(was & ~now, leave).when(was & now, "revision").when(now, fresh).alias("move"),
                 F.when(was & ~now, -F.col("_ov")).when(was & now, F.col("_cv") - F.col("_ov")).when(now, F.col("_cv")).alias("v")),
        F.struct(F.lit("closing").alias("move"), F.when(now, F.col("_cv")).alias("v")))
    x = j.select(unit, F.explode(lines).alias("l")).where("l.v IS NOT NULL AND l.move IS NOT NULL")
    return x.groupBy(unit, F.col("l.move").alias("move")).agg(F.sum("l.v").alias("value"), F.count(F.lit(1)).alias("n"))


def attribution(table: DataFrame, *, unit: str = "unit_id") -> DataFrame:
    """Drivers of the change ranked by size with their share of the sum of absolute values."""
    d = table.where(~F.col("item").isin("opening", "closing"))
    w = Window.partitionBy(unit)
    share = 100 * F.abs("value") / F.when(F.sum(F.abs("value")).over(w) == 0, 1.0).otherwise(F.sum(F.abs("value")).over(w))
    return d.withColumn("share_pct", share).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("value")), "line")))


def evidence(df: DataFrame, keys, order, fields, k: int = 3) -> DataFrame:
    """Top-k rows per key folded into one ordered list."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    t = top_k(df, keys, order, k)
    return t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rk", *fields))).alias("evidence"))


# ------------------------------------------------------------------ sensitivity
def perturbations(price: float | None = None) -> list[tuple[str, float, str]]:
    """(param, x, role): curve points and the two swing points of each parameter, in relative terms.

    price / opex / rate are factors −20 … +20 % in nine points, decline is −3 … +3 annual points.
    """
    nine = [round(-0.2 + 0.05 * i, 10) for i in range(9)]
    out = [(p, v, "curve") for p in ("price", "opex", "rate") for v in nine] + [("decline", float(v), "curve") for v in range(-3, 4)]
    out += [(p, v, "swing") for p in ("price", "opex", "rate") for v in (0.1, -0.1)] + [("decline", v, "swing") for v in (1.0, -1.0)]
    return [("base", 0.0, "base")] + out


def with_perturbations(econ: DataFrame, grid, limit) -> DataFrame:
    """Expand unit rows by the perturbation points; ``limit(price_factor, opex_factor)`` returns the economic limit."""
    pts = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(float(x)).alias("x"), F.lit(r).alias("role")) for p, x, r in grid])
    e = econ.withColumn("_p", F.explode(pts)).select(*econ.columns, "_p.param", "_p.x", "_p.role")
    pf = F.when(F.col("param") == "price", 1 + F.col("x")).otherwise(1.0)
    of = F.when(F.col("param") == "opex", 1 + F.col("x")).otherwise(1.0)
    return (e.withColumn("q_econ", limit(pf, of)).withColumn("rate_factor", F.when(F.col("param") == "rate", 1 + F.col("x")).otherwise(1.0))
            .withColumn("decline_delta", F.when(F.col("param") == "decline", F.col("x") / 100).otherwise(0.0)))


def perturbed_old(fits: DataFrame, points: DataFrame, *, unit: str = "unit_id") -> DataFrame:
    """Σ best remaining of fitted entities per unit and perturbation point."""
    j = spread(fits, "entity_id").join(points, unit)
    scale = F.greatest(F.col("rate_factor"), F.lit(1e-9))
    r = remaining_low_best(j, q_econ=F.col("q_econ"), now=F.col("now_eff"), scale=scale, decline_delta=F.col("decline_delta"))
    return r.groupBy(unit, "param", "x", "role").agg(F.sum("remaining_best").alias("v"))


def sensitivity_curves(total: DataFrame, *, unit: str = "unit_id") -> DataFrame:
    base = total.where("role = 'base'").select(unit, F.col("v").alias("_b"))
    return total.where("role = 'curve'").join(base, unit).select(unit, "param", "x", (F.col("v") - F.col("_b")).alias("delta"))


def sensitivity_weights(total: DataFrame, *, unit: str = "unit_id") -> DataFrame:
    s = total.where("role = 'swing'").groupBy(unit, "param").agg(F.abs(F.max(F.struct("x", "v"))["v"] - F.min(F.struct("x", "v"))["v"]).alias("swing"))
    w = F.sum("swing").over(Window.partitionBy(unit))
    return s.withColumn("weight", F.col("swing") / F.when(w == 0, 1.0).otherwise(w))


