"""Price decks, scenarios and economic limits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import DAYS_PER_MONTH

# The two example price decks (USD), their scenarios, and the finance parameters.
DECKS = [
    ("deck_2026_12", "2026-12-31", [72.1, 70.4, 74.8, 76.2, 73.5, 71.9, 69.8, 72.6, 75.1, 77.3, 74.0, 72.8], 9000.0, 4.5, 0.28, 7.3),
    ("deck_2025_12", "2025-12-31", [81.0, 79.5, 83.2, 84.6, 80.9, 78.4, 76.2, 79.1, 82.0, 83.5, 80.2, 78.9], 8600.0, 4.5, 0.28, 7.3),
]
SCENARIOS = [
    ("deck_2026_12", "sec", None, 1.0), ("deck_2026_12", "assessment", 65.0, 1.0), ("deck_2026_12", "impairment", 58.0, 1.05),
    ("deck_2025_12", "sec", None, 1.0), ("deck_2025_12", "assessment", 70.0, 1.0), ("deck_2025_12", "impairment", 62.0, 1.05),
]
FX, DISCOUNT, TAX = 7.10, 0.10, 0.25
CAPEX = {"horizontal": 450.0, "vertical": 200.0, "default": 400.0}
MEASURE_COST = {"frac": 90.0, "perforation": 20.0, "acid": 15.0, "workover": 35.0, "sand_control": 25.0, "waterflood": 10.0, "default": 30.0}
RESTART_COST, PUD_CAPEX = 15.0, 500.0
OIL_DENSITY = 0.85

DECK_SCHEMA = "deck string, as_of string, prices array<double>, opex double, transport double, tax double, bbl_per_t double"
SCENARIO_SCHEMA = "deck string, scenario string, price double, opex_factor double"


def average_price(decks: DataFrame) -> DataFrame:
    """Unweighted mean of exactly twelve first-of-month prices; any other count fails the job."""
    n = F.size("prices")
    mean = F.aggregate("prices", F.lit(0.0), lambda a, p: a + p) / n
    return decks.withColumn("avg_price", F.when(n == 12, mean).otherwise(
        F.raise_error(F.concat(F.lit("twelve monthly prices required for "), F.col("deck")))))


def scenario_prices(decks: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The ``sec`` scenario always takes the twelve-month average, whatever the table says."""
    j = average_price(decks).join(F.broadcast(scenarios.withColumnRenamed("opex_factor", "_f")), "deck")  # a few scenario rows
    return j.withColumn("price", F.when(F.col("scenario") == "sec", F.col("avg_price")).otherwise(F.col("price"))) \
        .withColumn("scenario_factor", F.coalesce("_f", F.lit(1.0))).drop("_f", "prices")


def net_per_tonne(price, transport="transport", tax="tax", bbl="bbl_per_t") -> Column:
    price = price if isinstance(price, Column) else F.col(price)
    return (price - F.col(transport)) * (1 - F.col(tax)) * F.col(bbl)


def economic_limits(units: DataFrame, priced: DataFrame, *, factor: str = "opex_factor") -> DataFrame:
    """Daily rate at which net revenue just pays the operating cost, per unit × deck × scenario."""
    # the few deck × scenario rows travel as one array, so each unit row is expanded in place
    cols = ["deck", "scenario", "price", "opex", "transport", "tax", "bbl_per_t", "scenario_factor"]
    rows = priced.agg(F.array_sort(F.collect_list(F.struct(*cols)))).scalar()
    j = units.withColumn("_p", F.explode(rows)).select(*units.columns, *[F.col(f"_p.{x}") for x in cols])
    opex = F.col("opex") * F.col("scenario_factor") * F.col(factor)
    net = net_per_tonne("price")
    return j.withColumn("net_t", net).withColumn("opex_month", opex).withColumn(
        "q_econ", opex / F.greatest(net * DAYS_PER_MONTH, F.lit(1e-9)))


def deck_for(dates: DataFrame, decks: DataFrame, *, as_of: str = "as_of") -> DataFrame:
    """Exact evaluation-date match; a date without its own deck fails instead of borrowing another year's."""
    j = dates.join(F.broadcast(decks.select(F.col("as_of").alias(as_of), "deck")), as_of, "left")
    return j.withColumn("deck", F.coalesce("deck", F.raise_error(F.concat(F.lit("no price deck for "), F.col(as_of))).cast("string")))
