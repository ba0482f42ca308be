"""Ordered rule engines: reserve category, compliance checklist, screening, static/dynamic cross-check."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import c

# Rule citations.
CITE_DEVELOPED, CITE_ECONOMIC, CITE_PUD = "Rule 4-10(a)(6)(i)", "Rule 4-10(a)(10)", "Rule 4-10(a)(31)(ii)"
CITE_RESERVOIR, CITE_PRICE, CITE_CERTAINTY, CITE_TECHNOLOGY = "Rule 4-10(a)(22)", "Rule 4-10(a)(22)(v)", "Rule 4-10(a)(24)", "Rule 4-10(a)(25)"


def _verdict(category, citation, human: bool, *evidence) -> Column:
    ev = F.array_compact(F.array(*[e if isinstance(e, Column) else F.lit(e) for e in evidence]))
    return F.struct(F.lit(category).alias("category"), F.lit(citation).cast("string").alias("citation"), F.lit(human).alias("needs_human"), ev.alias("evidence"))


def classify(df: DataFrame) -> DataFrame:
    """Adds ``cls``: category, citation, whether a person must confirm, and the evidence list.

    Needs prod_days, status, economic, in_plan, continuity.
    """
    st, days = F.lower(F.coalesce("status", F.lit(""))), F.col("prod_days")
    d = F.concat(F.lit("days with production: "), days.cast("string"))
    plan, cont = F.coalesce("in_plan", F.lit(False)), F.coalesce("continuity", F.lit(False))
    rule = (
        F.when((days > 0) & (st == "producing") & ~F.col("economic"), _verdict("NOT_PROVED", CITE_ECONOMIC, False, "rate below the economic limit"))
        .when((days > 0) & (st == "producing"), _verdict("PDP", CITE_DEVELOPED, False, d, "producing", "rate above the economic limit"))
        .when((days > 0) & (st == "shut_in"), _verdict("PDNP", CITE_DEVELOPED, True, d, "shut in"))
        .when(st == "completed_not_producing", _verdict("PDNP", CITE_DEVELOPED, True, "completed, not on production"))
        .when(((st == "planned") | (days == 0)) & plan & cont, _verdict("PUD", CITE_PUD, True, "undrilled", "in the five-year plan", "continuity evidence"))
        .when((st == "planned") | (days == 0), _verdict("NOT_PROVED", CITE_PUD, True, F.when(~plan, "five-year plan not confirmed"), F.when(~cont, "no continuity evidence")))
        .otherwise(_verdict("NOT_PROVED", None, True, "status unknown")))
    return df.withColumn("cls", rule)


def checklist(df: DataFrame, *, q_econ, coverage, reliability: bool = False, ident: str = "entity_id") -> DataFrame:
    """One row per entity and checklist item (item, status, citation). Needs prod_days, rate, in_plan and ``cls``."""
    def item(name, status, citation=None):
        return F.struct(F.lit(name).alias("item"), status.alias("status"), F.lit(citation).cast("string").alias("citation"))
    def check(cond, otherwise="needs_human"):
        return F.when(cond, "pass").otherwise(otherwise)
    ok = F.lit("pass")
    items = F.array_compact(F.array(
        item("production_evidence", check(F.col("prod_days") > 0), CITE_RESERVOIR), item("economic", check(F.col("rate") > c(q_econ), "fail"), CITE_ECONOMIC),
        item("price_basis", ok, CITE_PRICE), item("current_methods", ok, CITE_PRICE),
        item("reasonable_certainty", check(F.coalesce(F.abs(c(coverage) - 0.8) <= 0.08, F.lit(False))), CITE_CERTAINTY),
        item("category_basis", check(~F.col("cls.needs_human")), None),
        F.when(F.col("cls.category") == "PUD", item("five_year_plan", check(F.coalesce("in_plan", F.lit(False))), CITE_PUD)),
        item("reliable_technology", ok if reliability else F.lit("needs_human"), CITE_TECHNOLOGY), item("traceability", ok, None)))
    return df.select(ident, F.explode(items).alias("i")).select(ident, "i.item", "i.status", "i.citation")


def checklist_summary(items: DataFrame, *, ident: str = "entity_id") -> DataFrame:
    def n(s):
        return F.sum((F.col("status") == s).cast("long"))
    return items.groupBy(ident).agg(F.count(F.lit(1)).alias("n_items"), n("pass").alias("n_pass"), n("fail").alias("n_fail"), n("needs_human").alias("n_needs_human"))


def screen(df: DataFrame, *, low: str) -> DataFrame:
    """Low-estimate reserves: 0 where nothing is proved, NULL where no decline is available."""
    return df.withColumn("low_estimate", F.when(F.col("cls.category") == "NOT_PROVED", 0.0).otherwise(F.col(low)))


def cross_check(df: DataFrame) -> DataFrame:
    """Implied recovery against the block band, disjoint intervals, divergent decline exponent.

    Needs eur_/ooip_ p10, p50, p90, b, d_min, low_pct, high_pct.
    """
    rf = F.when(F.col("ooip_p50") > 0, F.round(F.col("eur_p50") / F.col("ooip_p50") * 100, 3))
    lo, hi = F.col("low_pct"), F.col("high_pct")
    disjoint = F.coalesce((F.col("eur_p10") / F.greatest("ooip_p90", F.lit(1e-9)) * 100 > hi) | (F.col("eur_p90") / F.greatest("ooip_p10", F.lit(1e-9)) * 100 < lo), F.lit(False))
    diverges = F.coalesce((F.col("b") > 1.0) & (F.coalesce("d_min", F.lit(0.0)) <= 0), F.lit(False))
    def finding(code, severity):
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    base = F.when(rf.isNull(), finding("NO_DATA", "info")).when(rf < lo, finding("RF_TOO_LOW", "warn")).when(rf > hi, finding("RF_TOO_HIGH", "warn")).otherwise(finding("RF_IN_RANGE", "info"))
    have = rf.isNotNull()
    findings = F.array_compact(F.array(base, F.when(have & disjoint, finding("INTERVAL_DISJOINT", "critical")), F.when(have & diverges, finding("B_GT_1_NO_DMIN", "critical"))))
    state = F.when(~have, "unknown").when(disjoint, "conflict").when(rf < lo, "low").when(rf > hi, "high").otherwise("consistent")
    d = df.withColumn("rf_implied_pct", rf).withColumn("consistency", state).withColumn("findings", findings)
    return d.withColumn("needs_human", (F.col("consistency") == "conflict") | F.exists("findings", lambda f: f["severity"] == "critical"))
