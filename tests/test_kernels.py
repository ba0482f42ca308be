import numpy as np

from drawdown.functions.curves import np_fit, np_shape
from drawdown.operators.decline import last_breaks
from drawdown.operators.physics import DEFAULT_PRIOR, np_fit as physics_fit


def test_exponential_recovery():
    t = np.arange(48.0)
    f = np_fit("exponential", t, 30 * np.exp(-0.04 * t))
    assert abs(f[2] - 0.04) < 1e-4 and abs(f[1] - 30) < 0.05 and f[-1]


def test_short_series_is_not_converged():
    f = np_fit("exponential", np.arange(4.0), np.ones(4))
    assert not f[-1] and f[9] == 4


def test_modified_hyperbolic_switches_to_terminal_decline():
    q = np_shape("modified_hyperbolic", np.array([400.0, 401.0]), np.float64(0.3), np.float64(1.2), np.float64(0.00625))
    assert abs(-np.log(q[1] / q[0]) - 0.00625) < 1e-6


def test_last_break_on_rise_then_decline():
    rng = np.random.default_rng(1)
    q = np.concatenate([100 * 1.06 ** np.arange(18), 100 * 1.06 ** 18 * 0.97 ** np.arange(48)]) * np.exp(rng.normal(0, 0.03, 66))
    assert abs(last_breaks([(np.arange(66.0), np.log(q))], 12)[0] - 18) <= 3


def test_clean_decline_has_no_break():
    assert last_breaks([(np.arange(48.0), np.log(50 * np.exp(-0.025 * np.arange(48))))], 12)[0] == 0


def test_physics_fit_follows_linear_flow():
    t = np.arange(0.5, 36)
    f = physics_fit(t, 30 / np.sqrt(1 + 2 * 0.2 * (t - 0.5)), 1.0, 0.0, np.nan, DEFAULT_PRIOR)
    assert f[8] and f[6] > 0.97


def test_rows_of_one_series_fit_as_single_ones():
    from drawdown.functions import curves as C
    rng = np.random.default_rng(3)
    t = np.arange(30) + 5.0
    for model in C.MODELS:
        rows = np.exp(rng.normal(1.9, 0.3, (6, 30))) * np.exp(-0.02 * t)
        alone = np.array([[x[1], *(x[5:7] if model == "duong" else x[2:4])] for x in (C.np_fit(model, t, r) for r in rows)])
        assert np.allclose(np.stack(C.np_fit_rows(model, t, rows), 1), alone, rtol=1e-9)


def test_replicates_with_missing_points_take_the_plain_fit():
    import pandas as pd
    from drawdown.functions import curves as C
    from drawdown.operators import decline as D
    t, q = np.arange(14) * 1.0, np.r_[np.nan, 9 * np.exp(-0.05 * np.arange(13))]
    fit = pd.DataFrame([C.np_fit("harmonic", t, q)[:7]], columns=["model", "qi", "di", "b", "d_min", "a", "m"])
    got = D._replicates.func(*(pd.Series([x]) for x in (t, q)), fit, *(pd.Series([x]) for x in ([[0, 0, 0, 0], [2, 6, 1, 9]], 4, 3.0, 13.0)))[0]
    assert len(got) == 2 and np.isfinite(got).all()


def test_shapes_end_where_cells_cross_and_rows_share_their_steps(monkeypatch):
    import pandas as pd
    from drawdown.operators import physics as P
    rng = np.random.default_rng(4)
    p = [rng.uniform(1, 90, 300), rng.uniform(0.005, 0.3, 300), rng.uniform(0, 12, 300), rng.uniform(0.05, 1, 300)]
    q = p[0][:, None] * P._shape(np.arange(10.0, P.HORIZON, 0.5)[None, :], *(x[:, None] for x in p[1:]))
    alive = np.cumprod(q >= 20.0, axis=1).astype(bool)
    calls, plain = [], P._shape
    monkeypatch.setattr(P, "_shape", lambda t, *a: calls.append(np.broadcast(t, *a).size) or plain(t, *a))
    r = P._rem.func(*(pd.Series(x) for x in p), pd.Series([20.0] * 300), pd.Series([10.0] * 300))
    assert np.array_equal(r.remaining, np.where(alive, q, 0.0).sum(1) * 0.5 * P.DAYS_PER_MONTH)
    assert np.array_equal(r.t_econ, np.where(alive.any(1), 10 + 0.5 * (alive.sum(1) - 1), 10.0)) and not r.capped.any()
    assert len(calls) < 20 and sum(calls) < q.size / 2


def test_series_fitted_side_by_side_equal_those_fitted_alone():
    from drawdown.functions import curves as C
    r = np.random.default_rng(5)
    series = []
    for n in (0, 3, 6, 7, 20, 45, 60) * 8:
        t = np.sort(r.choice(84, n, replace=False)).astype(float)
        series.append((t, 40 * np.exp(-r.uniform(0, 0.2) * t) * r.lognormal(0, 0.5, n)))
    series += [(np.arange(9.0), np.full(9, 7.0)), (np.arange(9.0), np.array([np.nan, 9, 8, 0, 7, 6, 5, 4, 3])), (np.sort(r.uniform(0, 90, 30)), r.lognormal(2, 1, 30))]
    for model in C.MODELS:
        for fit, (t, q) in zip(C.np_fit_many(model, series), series):
            alone = C.np_fit(model, t, q)
            assert [fit[i] for i in (0, 9, 10)] == [alone[i] for i in (0, 9, 10)]
            assert np.allclose(np.array(fit[1:9], float), np.array(alone[1:9], float), rtol=1e-9, atol=1e-9, equal_nan=True)
