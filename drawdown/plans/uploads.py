"""Queries: validation, preview, commit and undo of uploaded tables; anchor-set validation; unit assignment."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import month_label, rnd
from ..operators import imports as M, indicators as I
from ..session import materialise, shared_folder
from ..sources.bind import monthly, table, wells
from ..sources import versions as V
from ..sources.tables import entities_to_units, read_upload, upsert
from . import sqlkit as S
from .registry import query, with_ctes

RULES = [M.Rule("unit_id", "Unit", "ref"), M.Rule("ym", "Month", "ym"), M.Rule("volume", "Volume(t)", "float", minimum=0), M.Rule("wells", "Wells", "int", minimum=0),
         M.Rule("status", "Status", "enum", required=False, choices={"f": "final", "o": "open", "p": "partial"})]


def upload(spark, sf):
    """``orders`` turned into an upload with deterministic defects."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").withColumn("d10", F.add_months(F.to_date("o_orderdate"), 120)).select(
        (k + 2).alias("line"), F.when(k % 17 == 0, F.concat(F.lit("Z"), k.cast("string"))).otherwise(F.concat(F.lit("supplier#"), F.lpad((F.col("o_custkey") % 100).cast("string"), 9, "0"))).alias("unit_id"),
        F.when(k % 19 == 0, "2001-13").when(k % 3 == 0, F.date_format("d10", "yyyy/MM")).when(k % 3 == 1, F.concat(F.year("d10"), F.lit("年"), F.month("d10"), F.lit("月"))).otherwise(F.date_format("d10", "yyyy-MM")).alias("ym"),
        F.when(k % 23 == 0, "abc").when(k % 29 == 0, "-5").when(k % 31 == 0, "").otherwise(F.concat((k % 9).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5"))).alias("volume"),
        F.when(k % 37 == 0, "2.5").otherwise((k % 12).cast("string")).alias("wells"), F.when(k % 41 == 0, "X").when(k % 2 == 0, F.col("o_orderstatus")).alias("status"))


UP = ["""u0 AS (SELECT o_orderkey+2 AS line, CASE WHEN o_orderkey%17=0 THEN 'Z'||o_orderkey ELSE 'supplier#'||lpad(CAST(o_custkey%100 AS VARCHAR),9,'0') END AS unit_id, CASE WHEN o_orderkey%19=0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 10 YEAR,'%Y-%m') END AS ymv, CASE WHEN o_orderkey%19=0 THEN '2001-13' END AS ymbad,
 CASE WHEN o_orderkey%23=0 THEN 'abc' WHEN o_orderkey%29=0 THEN '-5' WHEN o_orderkey%31=0 THEN '' ELSE (o_orderkey%9)||','||lpad(CAST(o_orderkey%1000 AS VARCHAR),3,'0')||'.5' END AS volume, CASE WHEN o_orderkey%37=0 THEN '2.5' ELSE CAST(o_orderkey%12 AS VARCHAR) END AS wells,
 coalesce(CASE WHEN o_orderkey%41=0 THEN 'X' WHEN o_orderkey%2=0 THEN o_orderstatus END,'') AS status, o_custkey%100 AS ck, (SELECT count(*) FROM supplier) AS ns FROM orders)""", """
iss AS (SELECT line, 'unit_id' AS "column", unit_id AS value, 'unknown key' AS message FROM u0 WHERE unit_id LIKE 'Z%' OR ck >= ns UNION ALL SELECT line, 'ym', ymbad, 'not a month' FROM u0 WHERE ymbad IS NOT NULL
 UNION ALL SELECT line, 'volume', volume, CASE volume WHEN 'abc' THEN 'not a number' WHEN '' THEN 'required' ELSE 'below 0' END FROM u0 WHERE volume IN ('abc','-5','') UNION ALL SELECT line, 'wells', wells, 'not an integer' FROM u0 WHERE wells='2.5' UNION ALL SELECT line, 'status', status, 'not an allowed value' FROM u0 WHERE status='X')""", """
ok AS (SELECT upper(unit_id) AS unit_id, ymv AS ym, CAST(replace(volume,',','') AS DOUBLE) AS volume, CAST(wells AS BIGINT) AS wells, line, min(line) OVER (PARTITION BY upper(unit_id), ymv) AS fl FROM u0 WHERE line NOT IN (SELECT line FROM iss))"""]


def _checked(spark, sf):
    # the header of the file names the labels, in capitals, and has a column of no use
    sent = upload(spark, sf).withColumnsRenamed({r.name: r.label.upper() for r in RULES}).withColumn("remark", F.lit("x"))
    mapping, ignored, missing = M.map_headers([x for x in sent.columns if x != "line"], RULES)
    if missing or ignored != ["remark"]:
        raise ValueError(f"columns not found: {missing}; not used: {ignored}")
    return M.validate(sent.withColumnsRenamed(mapping).drop(*ignored), RULES, ["unit_id", "ym"], references={"unit_id": table(spark, sf, "supplier").select("s_name")})


@query("import_issues", sql=with_ctes(UP, select="""SELECT * FROM iss UNION ALL SELECT line, 'unit_id,ym', unit_id || ' / ' || ym, 'same key as line ' || fl FROM ok WHERE line > fl"""))
def import_issues(spark, sf):
    return _checked(spark, sf)[1]


@query("import_preview", sql=with_ctes(UP, """
ex AS (SELECT upper(s_name) AS unit_id, '2007-05' AS ym FROM supplier)""", """
g AS (SELECT o.*, e.unit_id IS NOT NULL AS have FROM (SELECT * FROM ok WHERE line=fl) o LEFT JOIN ex e ON e.unit_id=o.unit_id AND e.ym=o.ym)""",
       select="SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT have) AS n_insert, count(*) FILTER (WHERE have) AS n_replace, count(DISTINCT unit_id) AS n_units, min(ym) AS min_ym, max(ym) AS max_ym, min(volume) AS min_volume, max(volume) AS max_volume, min(wells) AS min_wells, max(wells) AS max_wells FROM g"))
def import_preview(spark, sf):
    ex = table(spark, sf, "supplier").select(F.upper("s_name").alias("unit_id"), F.lit("2007-05").alias("ym"))
    return M.preview(_checked(spark, sf)[0], ex, ["unit_id", "ym"], "unit_id", ranges=["ym", "volume", "wells"])


@query("import_commit_undo", sql=with_ctes(UP, """
ex AS (SELECT upper(s_name) AS unit_id, '2007-05' AS ym, s_acctbal AS volume FROM supplier)""", """
nw AS (SELECT unit_id, ym, volume FROM ok WHERE line=fl)""", select="""
SELECT 'committed' AS state, count(*) AS n, round(sum(volume),2) AS volume FROM (SELECT * FROM ex WHERE (unit_id, ym) NOT IN (SELECT unit_id, ym FROM nw) UNION ALL SELECT * FROM nw) UNION ALL SELECT 'undone', count(*), round(sum(volume),2) FROM ex"""))
def import_commit_undo(spark, sf):
    ex = table(spark, sf, "supplier").select(F.upper("s_name").alias("unit_id"), F.lit("2007-05").alias("ym"), F.col("s_acctbal").alias("volume"))
    state, journal = M.commit(ex, _checked(spark, sf)[0], ["unit_id", "ym"], "b1")
    state, journal = materialise(state), materialise(journal)
    back = M.undo(state, journal, ["unit_id", "ym"])
    def row(name, d):
        return d.agg(F.lit(name).alias("state"), F.count(F.lit(1)).alias("n"), rnd(F.sum("volume"), 2).alias("volume"))
    return row("committed", state).unionByName(row("undone", back))


@query("csv_upload", sql="""
SELECT 'C' || c_custkey AS code, CASE WHEN c_custkey%2=0 THEN 'Customer ' || c_custkey || CASE WHEN c_custkey%3=0 THEN chr(10) || 'second, "line"' ELSE '' END END AS name, CAST(CAST(round(c_acctbal*100) AS BIGINT) AS VARCHAR) AS cents, CASE WHEN c_custkey%2=1 THEN '油井 ' || (c_custkey%7) END AS note FROM customer""")
def csv_upload(spark, sf):
    """All customers written as CSV files of two kinds and read back: UTF-8 with quoted line ends, and GBK with other columns in another order."""
    k = F.col("c_custkey")
    root = f"{shared_folder(spark).rstrip('/')}/upload-{uuid.uuid4().hex}"
    cents = F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")
    code = F.concat(F.lit("C"), k.cast("string")).alias("code")
    name = F.concat(F.lit("Customer "), k.cast("string"), F.when(k % 3 == 0, '\nsecond, "line"').otherwise("")).alias("name")
    note = F.concat(F.lit("油井 ".encode("gbk").decode("latin-1")), (k % 7).cast("string")).alias("note")
    c = table(spark, sf, "customer")
    how = {"header": True, "quoteAll": True, "escape": '"'}
    c.where(k % 2 == 0).select(code, name, cents).write.options(**how).csv(f"{root}/a")
    # Spark writes no GBK, but Latin-1, whose every byte stands for itself
    c.where(k % 2 == 1).select(cents, note, code).write.options(**how, encoding="ISO-8859-1").csv(f"{root}/b")
    return read_upload(spark, f"{root}/*/part-*").select("code", "name", "cents", "note")


@query("versioned_table", sql="""
WITH s AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), u AS (SELECT * FROM s WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT * FROM c),
t AS (SELECT 1 AS number, 'first' AS version, 'committed' AS outcome, v FROM s UNION ALL SELECT 2, 'second', 'committed', v FROM u UNION ALL SELECT 3, 'third', 'committed', v FROM (SELECT * FROM u UNION ALL SELECT * FROM s) UNION ALL SELECT 4, 'second', 'committed', v FROM u
 UNION ALL SELECT 0, 'late', 'conflict', v FROM s UNION ALL SELECT 9, 'first', 'by name', v FROM s UNION ALL SELECT 9, 'second', 'latest', v FROM u)
SELECT number, version, outcome, count(*) AS n_rows, round(sum(v),2) AS total FROM t GROUP BY ALL""")
def versioned_table(spark, sf):
    """Publish, upsert, append and revert; a writer that read an older commit is refused; the latest and a named version are read."""
    root = f"{shared_folder(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    V.publish(s, root, "first", after=0)
    V.publish(upsert(V.read_version(spark, root), c, ["k"]), root, "second", after=1)
    try:
        V.publish(s, root, "late", after=1)
        outcome = "committed"
    except V.Conflict:
        outcome = "conflict"
    V.append(s, root, "third")
    V.revert(spark, root)

    def row(d, number, version, outcome):
        return d.agg(F.lit(number).alias("number"), F.lit(version).alias("version"), F.lit(outcome).alias("outcome"), F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("v"), 2).alias("total"))

    out = row(s, 0, "late", outcome).unionByName(row(V.read_version(spark, root, "first"), 9, "first", "by name")).unionByName(row(V.read_version(spark, root), 9, V.commits(spark, root)[-1]["version"], "latest"))
    for e in V.commits(spark, root):
        out = out.unionByName(row(spark.read.parquet(f"{root}/{e['folder']}"), e["number"], e["version"], "committed"))
    return out


@query("plan_deviation", sql=with_ctes(S.monthly("supplier"), """
pl AS (SELECT s_suppkey AS entity_id, 23952+s_suppkey%12 AS mi, s_acctbal/20 AS p FROM supplier WHERE s_acctbal > 0)""", select=f"""
SELECT entity_id, {S.ym('mi')} AS ym, round(p,6) AS planned, oil AS actual, round(100*(p-oil)/oil,3) AS deviation_pct FROM pl JOIN monthly USING (entity_id, mi) WHERE oil > 0 AND abs(p-oil)/oil > .5"""))
def plan_deviation(spark, sf):
    pl = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity_id"), month_label(23952 + F.col("s_suppkey") % 12).alias("ym"), (F.col("s_acctbal") / 20).alias("p"))
    act = monthly(spark, sf, "supplier").select("entity_id", month_label("mi").alias("ym"), "oil")
    w = M.plan_warnings(pl, act, keys=["entity_id", "ym"], plan_cols=["p"], actual_col="oil")
    return w.select("entity_id", "ym", rnd("planned", 6).alias("planned"), "actual", rnd("deviation_pct", 3).alias("deviation_pct"))


@query("import_history", sql="""
WITH b AS (SELECT o_orderkey AS id, o_orderpriority AS type, o_orderdate AS created, CASE WHEN o_orderstatus='F' THEN 'undone' ELSE 'active' END AS status FROM orders)
SELECT id, type, status, status='active' AND row_number() OVER (PARTITION BY type, status ORDER BY created*1 DESC)=1 AS can_undo FROM (SELECT id, type, status, epoch(created)*100000+id AS created FROM b)""")
def import_history(spark, sf):
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_orderstatus") == "F", "undone").otherwise("active").alias("status"),
                                          (F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400 * 100000 + F.col("o_orderkey")).alias("created"))
    return M.history(b).select("id", "type", "status", "can_undo")


@query("keyed_upsert", sql="""
WITH e AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), n AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)
SELECT * FROM e WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n""")
def keyed_upsert(spark, sf):
    e = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return upsert(e, n, ["k"])


@query("unit_assignment", sql=with_ctes(S.WELLS, """
ru AS (SELECT DISTINCT block, layer, block || '_' || layer AS unit FROM wells WHERE layer < 'Brand#2')""",
       select="SELECT coalesce(unit,'unassigned') AS unit, count(*) AS n FROM wells LEFT JOIN ru USING (block, layer) GROUP BY 1"))
def unit_assignment(spark, sf):
    w = wells(spark, sf)
    rules = w.where("layer < 'Brand#2'").select("block", "layer", F.concat_ws("_", "block", "layer").alias("unit")).distinct()
    return entities_to_units(w, rules, ["block", "layer"]).groupBy(F.coalesce("unit", F.lit("unassigned")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


REFS = ", ".join(f"('{a}','{g}')" for a, g, *_ in I.ANCHORS)


@query("anchor_validation", sql=f"""
WITH ref(indicator, grp) AS (VALUES {REFS}), s AS (SELECT DISTINCT n_nationkey AS set_id FROM nation),
 sp AS (SELECT set_id, CASE WHEN indicator='profit_usd_per_t' AND set_id%5=0 THEN 'bogus' ELSE indicator END AS indicator, CASE WHEN set_id%7=0 AND indicator='water_cut_pct' THEN 'x' ELSE '10' END AS good, CASE WHEN set_id%3=0 AND indicator='opex_usd_per_t' THEN '10' ELSE '20' END AS bad,
  CASE WHEN set_id%4=0 AND grp='operation' THEN '0' WHEN set_id%6=0 AND indicator='open_well_rate_pct' THEN '-1' ELSE '1' END AS weight FROM s, ref),
 kn AS (SELECT sp.*, grp, try_cast(good AS DOUBLE) AS g, try_cast(bad AS DOUBLE) AS b, try_cast(weight AS DOUBLE) AS w FROM sp JOIN ref USING (indicator))
SELECT set_id, indicator, 'missing' AS problem FROM s, ref WHERE (set_id, indicator) NOT IN (SELECT set_id, indicator FROM sp) UNION ALL SELECT set_id, indicator, 'unknown' FROM sp WHERE indicator NOT IN (SELECT indicator FROM ref)
UNION ALL SELECT set_id, indicator, 'not numeric' FROM kn WHERE g IS NULL OR b IS NULL OR w IS NULL UNION ALL SELECT set_id, indicator, 'anchors equal' FROM kn WHERE g=b AND w IS NOT NULL UNION ALL SELECT set_id, indicator, 'negative weight' FROM kn WHERE w<0 AND g IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT set_id, grp, 'group weight not positive' FROM kn GROUP BY set_id, grp HAVING sum(CASE WHEN g IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL THEN greatest(w,0) ELSE 0 END) <= 0""")
def anchor_validation(spark, sf):
    """One anchor set per nation with deterministic defects, all validated in one job."""
    ref = spark.createDataFrame([(a, g) for a, g, *_ in I.ANCHORS], "indicator string, grp string")
    names = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(g).alias("g")) for a, g, *_ in I.ANCHORS])
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("set_id"), F.explode(names).alias("r"))
    k, i = F.col("set_id"), F.col("r.i")
    sp = s.select("set_id", F.when((i == "profit_usd_per_t") & (k % 5 == 0), "bogus").otherwise(i).alias("indicator"), F.when((k % 7 == 0) & (i == "water_cut_pct"), "x").otherwise("10").alias("good"),
                  F.when((k % 3 == 0) & (i == "opex_usd_per_t"), "10").otherwise("20").alias("bad"), F.when((k % 4 == 0) & (F.col("r.g") == "operation"), "0").when((k % 6 == 0) & (i == "open_well_rate_pct"), "-1").otherwise("1").alias("weight"))
    return I.validate_anchors(sp, ref)
