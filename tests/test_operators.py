import numpy as np
import pytest
from pyspark.sql import functions as F

from drawdown.operators import finance, imports, ranking, recon, series, spatial, stats, text


def test_exact_percentiles_match_numpy_on_a_hot_key(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 1, 3000)] + [("cold", float(v)) for v in rng.normal(0, 1, 7)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.a, r.b) for r in ranking.exact_percentiles(df, ["k"], "v", {"a": .1, "b": .5}).collect()}
    for k in ("hot", "cold"):
        v = [x for g, x in rows if g == k]
        assert np.allclose(got[k], np.percentile(v, [10, 50]))


def test_scored_rank_is_a_row_number(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 3, i, float(rng.integers(0, 50))) for i in range(600)]
    got = ranking.scored_rank(spark.createDataFrame(rows, "q int, d int, s double"), ["q"], "s", "d", "r").collect()
    for q in range(3):
        want = [d for _, d, _ in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))]
        assert [r.d for r in sorted((r for r in got if r.q == q), key=lambda r: r.r)] == want


def test_nearest_and_radius_against_brute_force(spark):
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.uniform(0, 1000, (150, 2)), rng.normal(500, 1, (100, 2))])
    pts = spark.createDataFrame([(i, float(x), float(y), "*") for i, (x, y) in enumerate(xy)], "entity_id int, x double, y double, grp string")
    refs = pts.withColumnRenamed("entity_id", "ref_id")
    d = np.round(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]), 6)
    got = spatial.nearest(pts, refs, 4).collect()
    for i in range(len(xy)):
        order = [j for j in np.lexsort((np.arange(len(xy)), d[i])) if j != i][:4]
        assert [r.ref_id for r in sorted((r for r in got if r.entity_id == i), key=lambda r: r.rk)] == order
    n = {r.entity_id: r.n_near for r in spatial.radius_count(pts, pts, 60.0).collect()}
    assert all(n[i] == int((d[i] <= 60.0).sum()) for i in range(len(xy)))


def test_first_run_counts_records_not_days(spark):
    df = spark.createDataFrame([(1, d, o, h) for d, o, h in [(1, 0.1, 24.0), (2, 1.0, 24.0), (3, 0.0, 0.0), (5, 1.0, 24.0), (6, 1.0, 24.0)]],
                               "entity_id int, day_index int, oil double, hours_on double")
    assert series.first_run(df).first().t_break == 2


def test_depletion_and_recoverable_identities(spark):
    df = spark.createDataFrame([(1000.0, 200.0, 10.0, 90.0)], "nbv double, capex double, prod double, res double")
    r = finance.depletion(df, nbv="nbv", capex="capex", production="prod", reserves="res").first()
    assert r.depletion_rate == pytest.approx(0.1) and r.depletion == pytest.approx(120) and r.carrying == pytest.approx(1080)
    one = spark.createDataFrame([(12000.0, 300.0, 350.0, 120.0)], "res double, m double, net double, opex double")
    v = finance.recoverable(one, reserves="res", monthly="m", net="net", opex_t="opex", discount=0.1, fx=7.1).first().recoverable
    d = -np.log(1 - 300 / 12000)
    t = np.arange(5000)
    assert v == pytest.approx((300 * np.exp(-d * t) * 1.1 ** (-t / 12)).sum() * 230 * 7.1 / 1e4, rel=1e-6)


def test_reconciliation_closes(spark):
    v = spark.createDataFrame([("u", 100.0, -10.0, -2.0, 1.0, 5.0, 0.0, 0.0, 0.0, 94.0)], "unit_id string, " + ", ".join(f"{r} double" for r in (*recon.ROWS, "closing")))
    assert recon.reconciliation_table(v).where("NOT balanced").count() == 0


def test_decline_rate_is_exact(spark):
    df = spark.createDataFrame([("u", k, 1000 * float(np.exp(-0.01 * k))) for k in range(24)], "unit_id string, mi int, r double")
    r = stats.loglinear_decline(df, ["unit_id"], x="mi", rate="r", name="n").first()
    assert r.n_monthly_pct == pytest.approx((1 - np.exp(-0.01)) * 100, abs=1e-6)


def test_upload_faults_have_distinct_messages(spark):
    rules = [imports.Rule("unit", "Unit", "ref"), imports.Rule("ym", "Month", "ym"), imports.Rule("v", "Volume", "float", minimum=0)]
    raw = spark.createDataFrame([(2, "A", "2026-01", "1"), (3, "Z", "2026-01", "1"), (4, "A", "2026-13", "1"), (5, "A", "2026-02", "x"), (6, "A", "2026-03", "-1"), (7, "A", "2026-01", "2"), (8, "A", "", "1")],
                                "line int, unit string, ym string, v string")
    ok, bad = imports.validate(raw, rules, ["unit", "ym"], references={"unit": spark.createDataFrame([("a",)], "u string")})
    assert [r.line for r in ok.collect()] == [2]
    assert len({r.message for r in bad.collect()}) == 6


def test_pinned_citations_come_first(spark):
    hyb = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, d string, rk int")
    pin = spark.createDataFrame([(1, "c", 0)], "q int, d string, pos int")
    got = sorted(text.with_pinned(hyb, pin, ident="d", qid="q", k=2).collect(), key=lambda r: r.rk)
    assert [(r.d, r.match) for r in got] == [("c", "citation"), ("a", "hybrid")]


def test_rollforward_balances(spark):
    o = spark.createDataFrame([("a", "u", "booked", 10.0), ("b", "u", "booked", 5.0), ("c", "u", "uneconomic", 0.0)], "k string, unit_id string, status string, reserves double")
    c = spark.createDataFrame([("a", "u", "drilled", 0.0), ("b", "u", "booked", 6.0), ("c", "u", "booked", 4.0)], "k string, unit_id string, status string, reserves double")
    m = {r.move: r.value for r in recon.rollforward(o, c, "k", moves={"drilled": "converted"}, rest="removed", fresh="new").collect()}
    assert m == {"opening": 15.0, "converted": -10.0, "revision": 1.0, "new": 4.0, "closing": 10.0}


def test_nearest_is_exact_at_any_extent_and_with_repeated_places(spark):
    from drawdown.operators.spatial import nearest
    far = [(i, float(40_000 * i), 0.0, "g") for i in range(8)]
    same = [(100 + i, 7.0, 7.0, "h") for i in range(30)] + [(200, 9.0, 7.0, "h"), (201, 5_000_000.0, 1.0, "h")]
    for rows, k in ((far, 3), (same, 4)):
        d = spark.createDataFrame(rows, "entity_id long, x double, y double, grp string")
        got = sorted((r.entity_id, r.rk, r.ref_id) for r in nearest(d, d.withColumnRenamed("entity_id", "ref_id"), k).collect())
        want = []
        for i, x, y, _ in rows:
            others = sorted((round(((x - a) ** 2 + (y - b) ** 2) ** .5, 6), j) for j, a, b, _ in rows if j != i)
            want += [(i, n + 1, j) for n, (_, j) in enumerate(others[:k])]
        assert got == sorted(want)


def test_row_numbers_of_text_identifiers(spark):
    from drawdown.operators.ranking import dated_row_number
    rows = [(f"well-{i * 7919 % 1000:04d}", i % 3) for i in range(500)]
    d = spark.createDataFrame(rows, "entity_id string, day int")
    got = {r.entity_id: r.rn for r in dated_row_number(d, [], "day", "entity_id").collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted((day, i) for i, day in rows))}


def test_uploads_of_any_encoding_in_one_folder(spark, tmp_path):
    from drawdown.sources.tables import read_upload
    (tmp_path / "a.csv").write_bytes("单元,量\n甲,1\n,\n".encode("gbk"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + "单元,量\n乙,2\n".encode())
    (tmp_path / "c.csv").write_bytes(("单元,量\n" + "丙,3\n" * 20_000).encode())
    got = read_upload(spark, str(tmp_path))
    assert got.columns == ["单元", "量"]
    assert {(r["单元"], r["量"], r["count"]) for r in got.groupBy("单元", "量").count().collect()} == {("甲", "1", 1), ("乙", "2", 1), ("丙", "3", 20_000)}


def test_citations_fall_back_at_any_depth(spark):
    from drawdown.operators.text import clause_ancestors, explicit_citations
    keys = spark.createDataFrame([("4-10(a)", "4-10(a)"), ("1203(a)", "1203(a)"), ("1203(b)", "1203(b)")], "key string, citation string")
    q = spark.createDataFrame([(1, "see Rule 4-10(a)(1)(2)(3)(4)(5)(6)(7)(8)"), (2, "and Item 1203"), (3, "Item 1299")], "qid long, text string")
    assert {(r.qid, r.citation) for r in explicit_citations(q, keys, qid="qid", text="text", ident="citation").collect()} == {(1, "4-10(a)"), (2, "1203(a)")}
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(20)], "citation string, parent string")
    got = {(r.citation, r.ancestor, r.up) for r in clause_ancestors(chain).collect()}
    assert got == {(str(i), str(j), i - j) for i in range(20) for j in range(i)}


def test_fingerprint_sees_every_column_and_exchange(spark):
    from drawdown.sources.snapshot import fingerprint
    a = spark.createDataFrame([(1, 2.0, "x"), (2, 3.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(2, 3.0, "y"), (1, 2.0, "x")], "k int, v double, s string")
    swapped = spark.createDataFrame([(1, 3.0, "x"), (2, 2.0, "y")], "k int, v double, s string")
    key = lambda d: fingerprint([(d, d.columns)])
    assert key(a) == key(b) != key(swapped)


def test_breaks_of_a_batch_equal_single_ones():
    import numpy as np
    from drawdown.operators.decline import last_breaks
    rng = np.random.default_rng(3)
    series = [(np.arange(n, dtype=float), np.log(50 + 5 * np.arange(n) if n < 20 else np.concatenate([50 + 5 * np.arange(18), 140 * np.exp(-.05 * np.arange(n - 18))])) + rng.normal(0, .01, n)) for n in (0, 5, 14, 30, 66)]
    assert last_breaks(series, 12).tolist() == [last_breaks([s], 12)[0] for s in series]


def test_similar_entities_equal_all_pairs(spark):
    import numpy as np
    from drawdown.operators.similarity import similar_entities
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 3).tolist(), None if i % 7 == 0 else rng.random(6).tolist()) for i in range(40)]

    def dtw(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return d[-1, -1] / (len(a) + len(b))

    want = []
    for i, z, c in rows:
        far = sorted((round(.5 * float(np.sqrt(((np.array(z) - np.array(y)) ** 2).sum())) / 3 ** .5 + 1.5 * (1.0 if c is None or e is None else dtw(c, e)), 9), j) for j, y, e in rows if j != i)
        want += [(i, n + 1, j) for n, (_, j) in enumerate(far[:5])]
    x = spark.createDataFrame(rows, "entity_id long, z array<double>, curve array<double>")
    assert sorted((r.entity_id, r.rk, r.ref_id) for r in similar_entities(x, x, 5).collect()) == sorted(want)


def test_radius_count_never_broadcasts_copies_of_the_points(spark):
    from drawdown.operators.spatial import radius_count
    pts = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "entity_id long, x double, y double")
    refs = spark.range(500).select("id", (F.col("id") % 50).cast("double").alias("x"), F.lit(0.0).alias("y"))
    near = radius_count(pts, refs, 10.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    assert {r.entity_id: r.n_near for r in near.collect()} == {0: 110, 1: 120, 2: 130}
    far = radius_count(pts.withColumn("y", F.lit(1e6)), refs, 10.0)
    assert [r.n_near for r in far.collect()] == [0, 0, 0]


def test_plain_tables_say_their_size(spark):
    from drawdown.session import materialise
    same = spark.range(100_000).select(F.lit("one value in all rows").alias("v"))
    said = [int(str(materialise(same, plain=p)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for p in (True, False)]
    assert said[0] > 2_000_000 > 100_000 > said[1]


def test_stored_evaluations_write_entities_once(spark):
    """The components of a stored evaluation read the rows that were written."""
    from drawdown.operators import unit as U
    from drawdown.plans import unit as P
    m, acc, ev = P.inputs(spark, "/root/testdata/sf0.001")
    econ = P.labelled(P.limits(spark, acc), P.SEC26)
    e = U.evaluate(m, acc, ev, P.fresh(acc, P.CLOSE), econ, P.CLOSE, P.CFG, store=True)
    plan = e.components._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_radius_count_does_not_depend_on_the_cells(spark):
    from drawdown.operators.spatial import radius_count
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0), (3, None, 1.0)], "entity_id long, x double, y double")
    rows = [(float(i % 41), float(i * 7 % 53)) for i in range(3000)] + [(3.0, 4.0), (3.0000000004, 4.0), (3.000000002, 4.0)]
    refs = spark.createDataFrame(rows, "x double, y double")
    for radius in (5.0, 20.0):
        import math
        want = {k: sum(round(math.hypot(a - x, b - y), 9) <= radius for a, b in rows) for k, x, y in ((1, 0.0, 0.0), (2, 50.0, 50.0))} | {3: 0}
        for split in (None, 4, 9):
            assert {r.entity_id: r.n_near for r in radius_count(pts, refs, radius, split=split).collect()} == want
    assert [r.n_near for r in radius_count(pts, refs.where("x < 0"), 5.0, split=None).collect()] == [0, 0, 0]


def test_entities_do_not_meet_by_way_of_the_driver(spark):
    """Joins of a table with a row per entity are merge joins, whatever Spark takes its size to be."""
    from drawdown.operators import recon as R
    n = spark.range(50).select(F.col("id").alias("entity_id"), F.lit("u").alias("unit_id"), F.lit("sec").alias("scenario"), F.lit("infill").alias("category"), F.lit("ok").alias("status"),
                               F.lit(1.0).alias("reserves"), F.lit(1.0).alias("remaining_low"), F.lit(2.0).alias("production"))
    rows = n.drop("production")
    moves = R.category_moves(rows.withColumn("status", F.lit("not_producing")), rows, rows, n)
    assert "Broadcast" not in moves._jdf.queryExecution().executedPlan().toString()
    assert moves.agg(F.sum("value")).first()[0] == 150.0


def test_analog_volume_equals_the_month_by_month_sum(spark):
    from drawdown.operators import unit as U
    rows = [(1, [9.0, 7.0, 5.0], 0.02, 1, 1.5, 0.5), (2, [9.0, 7.0, 5.0], 0.02, 2, 1.5, 6.0), (3, [9.0, None, 5.0], 0.1, 1, 1.0, 0.5), (4, [9.0, 7.0], 0.02, 1, 1.0, None),
            (5, [9.0, 7.0], 0.02, 1, None, 1.0), (6, [4.0], 0.005, 7, 2.0, 1e-9)]
    d = spark.createDataFrame(rows, "id long, tc array<double>, ext double, months_on long, scale double, q_econ double")
    step = U.volume_until(lambda j: U.analog_rate(j, "months_on", "scale"), "q_econ")
    got = d.select("id", F.when(F.col("scale").isNotNull(), step).alias("a"), F.when(F.col("scale").isNotNull(), U.analog_volume("tc", "ext", "months_on", "scale", "q_econ")).alias("b")).collect()
    for r in got:
        assert (r.a is None and r.b is None) or abs(r.a - r.b) < 1e-9 * max(1, r.a), r


def test_public_series_sorts_once_and_sums_repeated_reports(spark):
    rows = [(1, 0, 9.0, 30)] + [(2, m, float(20 - abs(m - 3)), 30) for m in range(1, 9)] + [(2, 4, 5.0, 1), (2, 20, 3.0, 0), (None, 5, 7.0, 10), (None, 6, 8.0, 10), (3, 2, None, 5), (3, 3, 1.0, 5)]
    df = spark.createDataFrame(rows, "entity_id long, mi long, oil double, days int")
    out = series.public_series(df, df.select("mi"), min_producing=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate(keys=[entity_id" not in plan and sum("Sort [entity_id" in line for line in plan.splitlines()) == 1
    got = sorted(((r.entity_id or 0, r.t, r.rate, r.volume, r.cum_before_peak, r.start_month) for r in out.collect()))
    # month 4 sums two reports and is the peak of the first four
    want = [(0, 0.5, .8, 8.0, 7.0, 5)] + [(2, m - 4 + .5, v / d, v, 18.0 + 19.0 + 20.0, 1) for m, v, d in ((4, 24.0, 31), (5, 18.0, 30), (6, 17.0, 30), (7, 16.0, 30), (8, 15.0, 30))]
    assert len(got) == len(want) and all(np.allclose(a, b) for a, b in zip(got, want))


def test_texts_of_one_row_group_are_tokenised_by_many_tasks(spark):
    docs = spark.createDataFrame([(1, "proved reserves proved"), (1, "proved reserves proved"), (2, None), (None, "decline"), (3, "the of")], "doc_id long, text string").coalesce(1)
    p = text.postings(docs, "doc_id", "text")
    assert "REPARTITION_BY_NUM" in p._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id or 0, r.dl, r.term, r.tf) for r in p.collect()) == [(0, 1, "decline", 1), (1, 3, "proved", 4), (1, 3, "reserve", 2)]


def test_orders_and_cells_do_not_meet_by_way_of_the_driver(spark, tmp_path):
    import datetime
    from drawdown.operators.spatial import radius_count
    from drawdown.sources.bind import account_monthly
    day = datetime.datetime(1995, 3, 1)
    lines = [(1, 5.0, .1, "O", day), (1, 2.0, .0, "F", day), (2, 1.0, .2, "F", day + datetime.timedelta(40)), (None, 9.0, .1, "O", day), (9, 9.0, .1, "O", day)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_discount double, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (2, 8), (None, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    m = account_monthly(spark, str(tmp_path))
    assert "Broadcast" not in m._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.entity_id, r.oil, r.days_on, r.days) for r in m.collect()) == [(7, 1.0, 0, 1), (7, 7.0, 1, 1), (8, 1.0, 0, 1)]
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "entity_id long, x double, y double")
    near = radius_count(pts, spark.range(300).select((F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y")), 10.0, split=4)
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
    assert {r.entity_id: r.n_near for r in near.collect()} == {1: 300, 2: 0}
