"""Statute builder, order statistics, Monte Carlo, quantile boosting and attributions against plain versions."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawdown.operators import boosting as B, learning as L, montecarlo as M, ranking
from drawdown.sources.statute import marker_path, read_statute, statute_clauses

XML = """<?xml version="1.0"?>
<DIV8 N="210.4-10" TYPE="SECTION"><HEAD>§ 210.4-10 (Item 12) Accounting for producers.</HEAD>
<P>This section applies to <I>all</I> filers.</P>
<P>(a) <I>Definitions.</I> The following apply &amp; bind:</P>
<P>(1) <I>Acquisition.</I> Costs of property. (i) Bonus payments</P>
<FP>and fees.</FP>
<P>(ii) Broker fees are costs.</P>
<P>(h) Letters go on.</P><P>(i) The ninth letter.</P><P>(2) Second.</P>
<P>Instruction 1 to paragraph (a)(1): Read both.</P><P>Also this.</P></DIV8>"""


def test_marker_paths():
    assert marker_path(["a", "1", "i", "A", "1", "2", "2", "ii", "b"]) == ["(a)", "(a)(1)", "(a)(1)(i)", "(a)(1)(i)(A)", "(a)(1)(i)(A)(1)", "(a)(1)(i)(A)(2)", "(a)(2)", "(a)(2)(ii)", "(b)"]
    assert marker_path(["u", "v", "w", "x", "i"]) == ["(u)", "(v)", "(w)", "(x)", "(x)(i)"] and marker_path([]) == []


def test_statute_units(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML, encoding="utf-8")
    got = [tuple(r)[1:] for r in read_statute(spark, str(tmp_path), {"210.4-10": "Rule 4-10"}).orderBy("no").collect()]
    p = "Rule 4-10"
    assert [(c, lv, up, t) for _, c, lv, up, t, *_ in got] == [
        (p, 0, None, "Accounting for producers"), (f"{p}(a)", 1, p, "Definitions"), (f"{p}(a)(1)", 2, f"{p}(a)", "Acquisition. Costs of property"), (f"{p}(a)(1)(i)", 3, f"{p}(a)(1)", "Acquisition. Costs of property"),
        (f"{p}(a)(1)(ii)", 3, f"{p}(a)(1)", "Acquisition. Costs of property"), (f"{p}(h)", 1, p, "Accounting for producers"), (f"{p}(i)", 1, p, "Accounting for producers"), (f"{p}(i)(2)", 2, f"{p}(i)", "Accounting for producers"),
        (f"{p}(a)(1) Instruction 1", 3, f"{p}(a)(1)", "Instruction 1")]
    assert [x[-2] for x in got] == ["This section applies to all filers.", "Definitions. The following apply & bind:", "Acquisition. Costs of property.", "Bonus payments\n\nand fees.", "Broker fees are costs.", "Letters go on.",
                                    "The ninth letter.", "Second.", "Read both.\n\nAlso this."]
    odd = spark.createDataFrame([("1", None, "R"), ("2", "", "R"), ("3", "<P> </P>", "R")], "section string, xml string, prefix string")
    assert statute_clauses(odd).count() == 0


def test_order_statistics_on_a_hot_bucket(spark):
    rng = np.random.default_rng(4)
    v = {"hot": rng.normal(size=3000).round(2), "cold": rng.normal(size=3), "one": np.array([2.5])}
    df = spark.createDataFrame([(b, float(x)) for b, xs in v.items() for x in xs] + [("hot", None)], "bucket string, e double").repartition(4)
    s = M.order_statistics(df, "bucket", "e")
    levels = (0.0, 0.01, 0.3, 0.5, 0.77, 1.0)
    u = s.where("k = 0").select("bucket", F.explode(F.array(*map(F.lit, levels))).alias("u"))
    for r in M.mapped(u, s, "bucket", "u", "q").collect():
        x = np.sort(v[r.bucket])
        assert r.q == pytest.approx(np.interp(r.u, (np.arange(len(x)) + .5) / len(x), x))
    ranks = ranking.range_rank(df.where("e IS NOT NULL"), ["bucket"], ["e"], "k").collect()
    for b, xs in v.items():
        mine = sorted((r.k, r.e) for r in ranks if r.bucket == b)
        assert [k for k, _ in mine] == list(range(len(xs))) and [e for _, e in mine] == sorted(xs.tolist())


def test_draws_equal_the_column_functions(spark):
    from drawdown.functions.columns import hash_uniform, normal_ppf
    d = spark.range(300).select(normal_ppf(hash_uniform(F.lit(7), F.lit("area"), F.lit("w1"), "id")).alias("z")).orderBy(F.monotonically_increasing_id())
    assert np.allclose([r.z for r in d.collect()], M.draws(7, "area", "w1", 300), atol=1e-12)
    rock = spark.createDataFrame([(1, 900.0, 8.0, 9.0, 55.0, 5.0), (2, 0.0, 8.0, 9.0, None, 5.0)], "entity_id int, lateral double, pay double, porosity double, saturation double, rf double")
    a, b = sorted(M.volumetric(rock, 20000, 1, recovery="rf").collect(), key=lambda r: r.entity_id)
    assert b.p50 is None and b.rec_p90 is None
    assert a.p10 < a.p50 < a.p90 and a.mean == pytest.approx(900 * 300 * 8 * .09 * .55 * .85 / 1.15, rel=0.02) and a.rec_p50 == pytest.approx(a.p50 * .05, rel=0.05)


def test_digests_of_numbers_are_made_together():
    import hashlib
    from time import perf_counter
    for prefix in (b"", b"7|area|5|", b"x" * 50, b"x" * 51, b"y" * 130, "é|ü".encode()):
        for n in (1, 7, 1203):
            want = [int.from_bytes(hashlib.md5(prefix + b"%d" % i).digest()[:8], "big") for i in range(n)]
            assert M.md5_heads(prefix, n).tolist() == want
    M.draws(7, "area", 0, 10_000)
    one_by_one = [b"7|area|1|%d" % i for i in range(10_000)]
    took = []
    for run in (lambda: M.draws(7, "area", 1, 10_000), lambda: [hashlib.md5(x).digest() for x in one_by_one]):
        ends = []
        for _ in range(9):
            start = perf_counter()
            run()
            ends.append(perf_counter() - start)
        took.append(min(ends))
    assert took[0] < took[1]  # the draws with all that follows, and only the digests one by one


def _data(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, np.where(x[:, 0] > 0, 3.0, 0.0) + x[:, 1] + rng.exponential(1, n)


def test_quantiles_are_not_symmetric(spark):
    """Skewed noise: each level covers its share, and the pinball loss is below that of a median with a symmetric spread around it."""
    x, y = _data(1500, 0)
    train = spark.createDataFrame([(i, *map(float, r), float(v), None) for i, (r, v) in enumerate(zip(x, y))], "entity_id int, a double, b double, c double, t double, empty double")
    models = B.loaded(B.fit_models(train, ["a", "b", "c"], ["t", "empty"], trees=150))
    assert list(models) == ["t"]
    xt, yt = _data(1500, 1)
    test = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(xt, yt))], "entity_id int, a double, b double, c double, y double")
    p = B.predict(models, test, ["a", "b", "c"]).toPandas().sort_values("entity_id")
    assert (p.p10 <= p.p50).all() and (p.p50 <= p.p90).all() and set(p.target) == {"t"}
    loss = lambda q, f: float(np.mean(np.maximum(q * (yt - f), (q - 1) * (yt - f))))
    spread = 1.2815515655446004 * np.std(y - models["t"][0.5].predict(x))
    assert sum(loss(q, p[c].to_numpy()) for q, c in ((.1, "p10"), (.5, "p50"), (.9, "p90"))) < sum(loss(q, p.p50.to_numpy() + k * spread) for q, k in ((.1, -1), (.5, 0), (.9, 1)))
    for c, q in (("p10", .1), ("p50", .5), ("p90", .9)):
        assert abs((yt < p[c].to_numpy()).mean() - q) < 0.12


def test_boosted_missing_values_and_few_labels(spark):
    x, y = _data(200, 2)
    x[::3, 0] = np.nan
    b = B.fit_booster(x, y, 0.5, trees=20)
    assert np.isfinite(b.predict(np.full((4, 3), np.nan))).all()
    assert B.fit_booster(np.ones((30, 2)), np.arange(30.0), 0.5, trees=3).predict(np.ones((1, 2)))[0] == pytest.approx(14.5)
    few = spark.createDataFrame([(i, 1.0, 1.0) for i in range(24)], "entity_id int, a double, t double")
    models = B.loaded(B.fit_models(few, ["a"], ["t"]))
    assert models == {} and B.predict(models, few, ["a"]).count() == 0


def _walk(b, x):
    codes, out = B.coded(x, b.edges), np.full(len(x), b.start)
    for root in b.roots:
        at = np.full(len(x), root)
        while (inner := b.feature[at] >= 0).any():
            at = np.where(inner, b.child[at] + (codes[np.arange(len(x)), np.maximum(b.feature[at], 0)] > b.bin[at]), at)
        out += b.value[at]
    return out


def test_prediction_equals_the_walk_down_the_trees_and_is_faster():
    from time import perf_counter
    x, y = _data(1500, 6)
    x[::7, 1], x[::11, 2] = np.nan, np.inf
    z = np.concatenate([_data(4000, 7)[0], x])
    for leaves in (2, 15, 16, 17, 40, 64):
        b = B.fit_booster(x, y, 0.5, trees=5, leaves=leaves)
        assert (b.predict(z) == _walk(b, z)).all() and b.predict(z[:0]).shape == (0,)
    b = B.fit_booster(x, y, 0.5, trees=100)
    took = []
    for run in (lambda: b.predict(z), lambda: _walk(b, z)):
        run()
        ends = []
        for _ in range(3):
            start = perf_counter()
            run()
            ends.append(perf_counter() - start)
        took.append(min(ends))
    assert 3 * took[0] < took[1]


def test_shapley_lattice_equals_all_orders(spark):
    x, y = _data(400, 3)
    f = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "entity_id int, a double, b double, c double, t double")
    models = B.loaded(B.fit_models(df, f, ["t"], levels=(0.5,), trees=30))
    s = L.shapley(models, "t", df.where("entity_id < 20"), df, f)
    med = df.agg(*[F.percentile_approx(c, 0.5, 10000) for c in f]).first()
    model = models["t"][0.5]
    for r in s.collect():
        phi = np.zeros(3)
        for order in itertools.permutations(range(3)):
            now = np.array(med, float)
            before = model.predict(now[None])[0]
            for j in order:
                now[j] = x[r.entity_id][j]
                after = model.predict(now[None])[0]
                phi[j] += (after - before) / math.factorial(3)
                before = after
        assert np.allclose([r.phi_a, r.phi_b, r.phi_c], phi) and r.base + phi.sum() == pytest.approx(r.prediction)
    w = L.waterfall(s, f, k=2).where("entity_id = 7").orderBy("no").collect()
    assert [x.step for x in w][0] == "base" and [x.step for x in w][-2:] == ["rest", "prediction"] and sum(x.amount for x in w[:-1]) == pytest.approx(w[-1].amount)


def test_importance_ranks_the_used_feature_first(spark):
    x, y = _data(600, 5)
    f = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "entity_id int, a double, b double, c double, t double")
    models = B.loaded(B.fit_models(df, f, ["t"], levels=(0.5,), trees=40))
    got = {r.feature: r.mae_increase for r in L.permutation_importance(models, "t", df, f, "t").collect()}
    assert max(got, key=got.get) == "a" and abs(got["c"]) < 0.1 < got["b"]
