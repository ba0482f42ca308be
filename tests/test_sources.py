"""Uploads, versioned tables, threshold retrieval and kriging systems."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawdown.operators import spatial as P, text as X
from drawdown.sources import versions as V
from drawdown.sources.tables import read_upload


def test_quoted_line_ends_and_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('code, name\r\nA,"two\nlines, ""quoted"""\r\n , \r\nB,x\x0cy z\r\n'.encode())
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfname,extra,code\nN,E,C\nshort\n")
    (tmp_path / "c.csv").write_bytes(b"")
    got = read_upload(spark, str(tmp_path))
    assert got.columns == ["code", "name", "extra"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", 'two\nlines, "quoted"', None), ("B", "x\x0cy z", None), ("C", "N", "E"), (None, "short", None)], key=str)
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        read_upload(spark, str(empty))


def test_versions_conflict_revert_and_append(spark, tmp_path):
    root = str(tmp_path / "t")
    assert V.commits(spark, root) == [] and V.history(spark, root).count() == 0
    with pytest.raises(ValueError):
        V.read_version(spark, root)
    assert V.publish(spark.range(3), root, "a", after=0) == 1
    with pytest.raises(V.Conflict):
        V.publish(spark.range(9), root, "b", after=0)
    with pytest.raises(V.Conflict):  # two writers that read the same commit: the log takes one entry a number
        V._commit(spark, root, {"number": 1, "version": "b", "folder": "x"})
    with pytest.raises(ValueError):
        V.revert(spark, root)
    assert V.append(spark.range(2).withColumn("more", F.lit(1)), root, "b") == 2
    assert V.read_version(spark, root).count() == 5 and V.read_version(spark, root).where("more IS NULL").count() == 3 and V.read_version(spark, root, "a").count() == 3
    assert V.revert(spark, root) == 3 and V.read_version(spark, root).count() == 3
    assert [(r.number, r.version, r.n_rows) for r in V.history(spark, root).orderBy("number").collect()] == [(1, "a", 3), (2, "b", 5), (3, "a", 3)]


def test_threshold_retrieval_equals_scoring_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    docs = {d: {rng.choice(words[:rng.choice([10, 60, 300])]): rng.choice([0.5, 1.0, rng.random()]) for _ in range(rng.randint(1, 25))} for d in range(500)}
    asks = {q: {rng.choice(words): rng.choice([1.0, 2.0, rng.random()]) for _ in range(rng.choice([1, 3, 12]))} for q in range(12)} | {99: {"unseen": 1.0}}
    w = spark.createDataFrame([(t, d, v) for d, x in docs.items() for t, v in x.items()], "term string, d int, w double")
    t = spark.createDataFrame([(q, a, v) for q, x in asks.items() for a, v in x.items()], "q int, term string, qw double")
    got = {}
    for heads in (1, 16):
        for r in X.top_matches(w, t, 5, ident="d", qid="q", heads=heads).collect():
            got.setdefault((heads, r.q), {})[r.rk] = (r.d, r.score)
    for q, x in asks.items():
        s = {d: round(sum(v * y[a] for a, v in x.items() if a in y), 9) for d, y in docs.items() if set(x) & set(y)}
        want = sorted(s.items(), key=lambda p: (-p[1], p[0]))[:5]
        for heads in (1, 16):
            mine = got.get((heads, q), {})
            assert [mine[i + 1][0] for i in range(len(mine))] == [d for d, _ in want] and [mine[i + 1][1] for i in range(len(mine))] == pytest.approx([v for _, v in want])


def _dense(at, v, target, nugget, sill, rng, drift=None, drift0=()):
    n = len(v)
    g = lambda h: nugget + (sill - nugget) * (1 - np.exp(-3 * h / rng))
    c = np.ones((n, 1)) if drift is None else np.column_stack([np.ones(n), drift])
    a = np.block([[g(np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))), c], [c.T, np.zeros((c.shape[1],) * 2)]]) + 1e-8 * np.eye(n + c.shape[1])
    b = np.concatenate([g(np.hypot(*(at - target).T)), [1.0], drift0])
    w = np.linalg.solve(a, b)
    return w[:n] @ v, np.sqrt(max(w @ b, 0))


def test_stacked_kriging_equals_dense_solves():
    rng = np.random.default_rng(3)
    k, sizes = 6, [6, 4, 6, 1]
    at, v, far, drift = (np.full(s, np.nan) for s in ((4, k, 2), (4, k), (4, k), (4, k, 1)))
    shape, d0, want, plain = rng.uniform(1, 3, (4, 3)) * [0.1, 1, 50], rng.normal(size=(4, 1)), [], []
    for i, n in enumerate(sizes):
        at[i, :n], v[i, :n], drift[i, :n] = rng.uniform(0, 100, (n, 2)), rng.normal(size=n), rng.normal(size=(n, 1))
        far[i, :n] = np.hypot(*(at[i, :n] - 50.0).T)
        plain.append(_dense(at[i, :n], v[i, :n], np.array([50.0, 50.0]), *shape[i]))
        if n > 1:
            want.append(_dense(at[i, :n], v[i, :n], np.array([50.0, 50.0]), *shape[i], drift[i, :n], d0[i]))
    est, sd = P.solve_kriging(at, v, far, shape)
    assert np.allclose(est, [e for e, _ in plain]) and np.allclose(sd, [s for _, s in plain])
    est, sd = P.solve_kriging(at, v, far, shape, drift, d0)
    assert np.allclose(est[:3], [e for e, _ in want]) and np.allclose(sd[:3], [s for _, s in want])
    # a value that is linear in the drift is met exactly
    est, _ = P.solve_kriging(at[:3], 2 + 3 * drift[:3, :, 0], far[:3], shape[:3], drift[:3], d0[:3])
    assert np.allclose(est, 2 + 3 * d0[:3, 0], atol=1e-4)


def test_a_date_without_its_own_deck_fails(spark):
    from drawdown.operators.economics import deck_for
    decks = spark.createDataFrame([("2024-12-31", "d24")], "as_of string, deck string")
    assert deck_for(spark.createDataFrame([("2024-12-31",)], "as_of string"), decks).first().deck == "d24"
    with pytest.raises(Exception, match="no price deck for 2025-12-31"):
        deck_for(spark.createDataFrame([("2025-12-31",)], "as_of string"), decks).collect()


def test_medians_of_the_others(spark):
    from drawdown.operators import physics as H, ranking
    rng = np.random.default_rng(6)
    v = {"a": rng.normal(size=9).round(1), "b": rng.normal(size=10).round(1), "c": np.array([1.0, 5.0]), "d": np.array([2.0])}
    df = spark.createDataFrame([(g, i, float(x)) for g, xs in v.items() for i, x in enumerate(xs)], "g string, i int, x double")
    for r in ranking.others_median(df, ["g"], "x", "m").collect():
        rest = np.delete(v[r.g], r.i)
        assert r.m == pytest.approx(np.median(rest)) if len(rest) else r.m is None
    n = {"p": 12, "q": 7, "s": 4}
    rows = [(f"{g}{i}", g, (float(rng.uniform(.1, .9)), float(rng.uniform(1, 9)), float(rng.uniform(.01, .2)), i % 6 != 5, 30)) for g, k in n.items() for i in range(k)]
    fits = spark.createDataFrame(rows, "entity_id string, g string, pfit struct<b_bdf:double,t_elf:double,di:double,converged:boolean,n:int>")
    got = {r.entity_id: r for r in H.analog_prior_of_others(fits, "g").collect()}
    library = {g: [(e, f[0], np.log(max(f[1], .05)), np.log(f[2])) for e, gg, f in rows if gg == g and f[3]] for g in n}
    for e, g, f in rows:
        rest = [x[1:] for x in library[g] if x[0] != e]
        if len(rest) < 5:
            assert e not in got
            continue
        b, te, di = np.array(rest).T
        mad = lambda x: 1.4826 * np.median(np.abs(x - np.median(x)))
        p = got[e].prior
        assert got[e].n_analogs == len(rest)
        assert [p.b_mean, p.b_sd, p.t_elf, p.t_elf_sd, p.ln_di, p.ln_di_sd] == pytest.approx([np.median(b), max(mad(b), .12), np.exp(np.median(te)), max(mad(te), .5), np.median(di), max(mad(di), .25)])
