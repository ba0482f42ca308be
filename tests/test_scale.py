"""Whole results at sizes where a task, a join or a disk would give out."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drawdown.operators import boosting as B, physics, similarity, spatial, text
from drawdown.plans import business


def test_sensitivity_rows_are_written_before_they_are_joined(spark):
    m = spark.createDataFrame([(e, mi, float(10 * e + mi)) for e in range(1, 5) for mi in range(3)], "entity_id long, mi int, oil double")
    short = spark.createDataFrame([(1, 2), (2, None)], "entity_id long, cutoff int")
    new = spark.createDataFrame([(3,), (3,)], "entity_id long")
    rows = business._usable(m, short, new)
    assert sorted((r.entity_id, r.mi) for r in rows.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)]
    plan = rows.join(m.groupBy("entity_id").count().hint("merge"), "entity_id")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan  # of two dealt halves: its partitions do not match those of the other side


def test_models_learn_from_all_labelled_rows(spark):
    df = spark.range(20500).select(F.col("id").alias("entity_id"), (F.col("id") % 50).cast("double").alias("a"), F.when(F.col("id") % 100 > 0, F.col("id").cast("double")).alias("t"))
    got = B.fit_models(df, ["a"], ["t"], levels=(0.5,), trees=2).collect()
    assert [r.n for r in got] == [20500 - 205]
    pdf = df.where("t IS NOT NULL").toPandas()
    whole = B.fit_booster(pdf[["a"]].to_numpy(), pdf["t"].to_numpy(), 0.5, trees=2)
    assert got[0].start == whole.start and got[0].value == whole.value.tolist() and got[0].bin == whole.bin.tolist()


def test_variogram_copies_points_to_a_bounded_number_of_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [("g", *map(float, r)) for r in rng.uniform(0, 100, (900, 3)).round(3)] + [("h", float(i % 5), 0.0, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "grp string, x double, y double, v double")
    assert spatial._block_pairs(spatial._blocks(df, "grp", "x", "y", "v", 10)).count() <= spatial.BLOCKS * (spatial.BLOCKS + 1) // 2 + 6  # 90 blocks would have 4095 pairs
    got = {(r.grp, r.bin): r for r in spatial.experimental_variogram(df, group="grp", rows_per_block=10).collect()}
    for g in "gh":
        p = np.array([r[1:] for r in rows if r[0] == g])
        i, j = np.triu_indices(len(p), 1)
        h, s = np.sqrt((p[i, 0] - p[j, 0]) ** 2 + (p[i, 1] - p[j, 1]) ** 2), 0.5 * (p[i, 2] - p[j, 2]) ** 2
        top = np.quantile(h, 0.6)
        k = np.floor(h[h < top] / top * 14).astype(int)
        for b in range(14):
            if (k == b).sum() >= 8:
                r = got.pop((g, b))
                assert (r.n, r.h, r.gamma) == (int((k == b).sum()), pytest.approx(h[h < top][k == b].mean()), pytest.approx(s[h < top][k == b].mean()))
    assert not got


def test_tiles_hold_every_pair_once():
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 9, (3, 1000)), rng.uniform(0, 9, (3, 401))
    for other, same in ((a, True), (b, False)):
        h, dv = (np.concatenate(x) for x in zip(*spatial._tiles(a, other, same, True)))
        full = np.hypot(a[0][:, None] - other[0], a[1][:, None] - other[1])
        want = full[np.triu_indices(1000, 1)] if same else full.ravel()
        assert len(h) == len(dv) == len(want) and np.allclose(np.sort(h), np.sort(want))


def test_blocks_send_on_a_few_pairs_even_of_equal_ones(spark, monkeypatch):
    rank = np.arange(1000)[::-1]
    assert set(similarity._best(np.zeros(1000, int), np.zeros(1000), rank, 5)) == {995, 996, 997, 998, 999}
    assert set(similarity._best(np.array([1, 1, 0, 1]), np.array([2.0, 1.0, 9.0, 3.0]), np.arange(4), 2)) == {0, 1, 2}
    monkeypatch.setattr(similarity, "TILE", 5000)  # several tiles in a block
    rng = np.random.default_rng(6)
    z = np.r_[rng.normal(0, 1, (1900, 2)), np.zeros((200, 2))]  # two blocks, and a group of equal entities
    x = spark.createDataFrame([(i, r.tolist(), None) for i, r in enumerate(z)], "entity_id long, z array<double>, curve array<double>")
    d = similarity.similar_entities(x, x, 3)
    assert "Python" not in d._jdf.queryExecution().optimizedPlan().toString().replace("FlatMapCoGroupsInPandas", "")  # no pair is a row that Python reads
    got = {(r.entity_id, r.rk): (r.ref_id, r.dist) for r in d.collect()}
    assert len(got) == 3 * 2100
    for i in range(0, 2100, 50):
        f = np.round(.5 * np.sqrt(((z[i] - z) ** 2).sum(1)) / 2 ** .5 + 1.5, 9)
        want = [j for j in np.lexsort((np.arange(2100), f)) if j != i][:3]
        assert [got[i, n + 1] for n in range(3)] == [(j, pytest.approx(f[j], abs=2e-9)) for j in want]


def _plain_fit(t, q, q_econ, cum, cap, prior):
    """The search of np_fit_rows cell by cell, with the volume of every cell."""
    w = 0.5 ** ((t.max() - t) / 24.0)
    w = w / w.mean() / physics.SIGMA ** 2
    mid, half, best = [sum(x) / 2 for x in physics.BOXES], [(x[1] - x[0]) / 2 for x in physics.BOXES], None
    for k in ((15, 11, 6), *[(7, 7, 5)] * 5):
        k = (*k, 6)
        u, v, b, s = (x.ravel() for x in np.meshgrid(*(np.unique(np.clip(m + h * np.linspace(-1, 1, n), *box)) for m, h, n, box in zip(mid, half, k, physics.BOXES)), indexing="ij"))
        ls = np.log(physics._shape(t[:, None], np.exp(u), np.exp(v), b))
        lnq = (w[:, None] * (np.log(q)[:, None] - ls)).sum(0) / w.sum() + s
        z = (w[:, None] * (lnq + ls - np.log(q)[:, None]) ** 2).sum(0) + ((b - prior["b_mean"]) / prior["b_sd"]) ** 2 + ((v - np.log(prior["t_elf"])) / prior["t_elf_sd"]) ** 2 + ((u - prior["ln_di"]) / prior["ln_di_sd"]) ** 2
        z += (50 * np.maximum(0, (cum + physics._remaining(np.exp(lnq), np.exp(u), np.exp(v), b, q_econ, t.max(), 2.0)[0]) / cap - 1)) ** 2
        i = int(np.argmin(np.round(z, 9)))
        if best is None or z[i] <= best[0]:
            best = z[i], u[i], v[i], b[i], s[i], lnq[i]
        mid, half = list(best[1:5]), [h * 2 / (n - 1) for h, n in zip(half, k)]
    return np.exp(best[5]), np.exp(best[1]), np.exp(best[2]), best[3]


def test_bounded_volumes_find_the_cells_of_the_whole_search(monkeypatch):
    rng = np.random.default_rng(7)
    t = np.arange(30.0)
    rows = np.stack([300 * np.exp(-d * t + rng.normal(0, 0.25, 30)) for d in (0.0, 0.01, 0.05)])
    cum, summed = 30.4 * rows[0].sum(), []
    under = physics._under_cap
    monkeypatch.setattr(physics, "_under_cap", lambda z, *a: summed.append(np.isfinite(out := under(z, *a)).sum() - np.isfinite(z).sum()) or out)
    for cap in (1.02 * cum, 1.3 * cum, 30 * cum):
        got = np.stack(physics.np_fit_rows(t, rows, 20.0, cum, cap, physics.DEFAULT_PRIOR), 1)
        assert np.allclose(got, [_plain_fit(t, q, 20.0, cum, cap, physics.DEFAULT_PRIOR) for q in rows], rtol=1e-9)
        assert np.allclose(got[1], physics.np_fit(t, rows[1], 20.0, cum, cap, physics.DEFAULT_PRIOR)[:4], rtol=1e-9)
    assert summed


def test_volume_bounds_hold_for_step_sums():
    rng = np.random.default_rng(8)
    lnq, u, v, b = rng.uniform(0, 9, 4000), rng.uniform(*physics.LN_DI, 4000), rng.uniform(*physics.LN_TELF, 4000), rng.choice([0.05, 0.3, 0.7, 1.0], 4000)
    for now in (0.0, 12.0, 83.0):
        low, high, _ = physics._volume_bounds(lnq, np.exp(u), np.exp(v), b, 3.0, now, 2.0)
        full = physics._remaining(np.exp(lnq), np.exp(u), np.exp(v), b, 3.0, now, 2.0)[0]
        assert (low <= full * (1 + 1e-9) + 1e-9).all() and (full <= high * (1 + 1e-9) + 1e-9).all()


def test_log_shapes_are_the_logarithms_of_shapes():
    rng = np.random.default_rng(9)
    t, u, v, b = np.arange(0, 200, 7.0), rng.uniform(*physics.LN_DI, 500), rng.uniform(*physics.LN_TELF, 500), rng.uniform(physics.B_MIN, physics.B_MAX, 500)
    want = np.log(physics._shape(t[:, None], np.exp(u), np.exp(v), b))
    assert np.allclose(physics._log_shape(t[:, None], np.exp(u), np.exp(v), b), want, rtol=1e-9, atol=1e-9)


def test_fusion_of_heads_equals_that_of_full_rankings(spark):
    rng = np.random.default_rng(10)
    a = {(q, d): float(rng.integers(0, 40)) / 8 for q in range(3) for d in range(400) if rng.random() < (0.9, 0.5, 0.01)[q]}
    b = {(q, d): float(rng.integers(0, 40)) / 8 for q in range(3) for d in range(400) if rng.random() < 0.6}
    frame = lambda x, name: spark.createDataFrame([(*k, v) for k, v in x.items()], f"q long, d long, {name} double")
    got = {(r.q, r.rk): (r.d, r.rrf) for r in text.fused(frame(a, "bm25"), frame(b, "cosine"), ident="d", qid="q", k=5).collect()}
    ranks = [{(q, d): n for q in range(3) for n, (_, d) in enumerate(sorted((-v, d) for (p, d), v in x.items() if p == q), 1)} for x in (a, b)]
    for q in range(3):
        full = sorted((-round(sum(1 / (60 + r[q, d]) for r in ranks if (q, d) in r), 9), d) for d in range(400) if (q, d) in a or (q, d) in b)
        assert [got[q, n + 1] for n in range(5)] == [(d, pytest.approx(-s, abs=1e-9)) for s, d in full[:5]]


def test_postings_are_dealt_once(spark):
    docs = spark.createDataFrame([(1, "red widgets red"), (2, "blue ring"), (2, "blue ring")], "doc_id long, text string")
    p = text.postings(docs, "doc_id", "text")
    assert p._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange") == 1
    assert {(r.doc_id, r.term): (r.tf, r.dl) for r in p.collect()} == {(1, "red"): (2, 3), (1, "widget"): (1, 3), (2, "blue"): (2, 2), (2, "ring"): (2, 2)}
