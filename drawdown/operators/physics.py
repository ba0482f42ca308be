"""Physics-constrained decline: linear flow, boundary-dominated flow, terminal decline; diagnostics, priors, hindcast."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import DAYS_PER_MONTH, c
from .ranking import exact_percentiles, others_median
from ..session import materialise, spread
from .stats import steep_onset

# Bounds, noise and default prior of the constrained model.
B_MIN, B_MAX = 0.05, 1.0
SIGMA = 0.12
HORIZON = 600.0
DEFAULT_PRIOR = {"b_mean": 0.8, "b_sd": 0.35, "t_elf": 3.0, "t_elf_sd": 1.5, "ln_di": float(np.log(0.12)), "ln_di_sd": 0.8}
LN_DI = (float(np.log(1e-4)), float(np.log(3.0)))
LN_TELF = (float(np.log(0.05)), float(np.log(240.0)))
D_MIN = 0.075 / 12.0
FIT = ("qi", "di", "t_elf", "b_bdf", "d_min")


def rate(t, fit: Column) -> Column:
    """Rate at t months: b = 2 until the end of linear flow, then b ≤ 1, then exponential; rate and decline continuous."""
    t = F.greatest(c(t).cast("double"), F.lit(0.0))
    qi, di, dm = fit["qi"], fit["di"], fit["d_min"]
    te = F.greatest(fit["t_elf"], F.lit(0.0))
    te = F.when((dm > 0) & (di > dm), F.least(te, (di / dm - 1.0) / (2.0 * di))).otherwise(te)
    b = F.least(F.greatest(fit["b_bdf"], F.lit(B_MIN)), F.lit(B_MAX))
    d_e, q_e = di / (1.0 + 2.0 * di * te), qi / F.sqrt(1.0 + 2.0 * di * te)
    tb = F.greatest(t - te, F.lit(0.0))
    tsw = (d_e / F.when(dm > 0, dm) - 1.0) / (b * d_e)
    bdf = q_e * F.pow(1.0 + b * d_e * tb, -1.0 / b)
    late = q_e * F.pow(1.0 + b * d_e * tsw, -1.0 / b) * F.exp(-dm * (tb - tsw))
    tail = F.when((dm > 0) & (d_e <= dm), q_e * F.exp(-dm * tb)).when((dm > 0) & (tb > tsw), late).otherwise(bdf)
    return F.when(t < te, qi / F.sqrt(1.0 + 2.0 * di * t)).otherwise(tail)


def _shape(t, di, te, b, dm=D_MIN):
    te = np.where(di > dm, np.minimum(te, (di / dm - 1.0) / (2.0 * di)), te)
    d_e, q_e = di / (1 + 2 * di * te), 1 / np.sqrt(1 + 2 * di * te)
    tb = np.maximum(t - te, 0.0)
    with np.errstate(all="ignore"):
        tsw = (d_e / dm - 1.0) / (b * d_e)
        bdf = q_e * (1 + b * d_e * tb) ** (-1 / b)
        late = q_e * (1 + b * d_e * np.maximum(tsw, 0)) ** (-1 / b) * np.exp(-dm * (tb - tsw))
        out = np.where(d_e <= dm, q_e * np.exp(-dm * tb), np.where(tb > tsw, late, bdf))
    return np.where(t < te, 1 / np.sqrt(1 + 2 * di * t), out)


def _remaining(qi, di, te, b, q_econ, t_now, step=0.5):
    """First-crossing volume of parameter arrays (cells in axis 0)."""
    qi, di, te, b = (np.asarray(x, float) for x in (qi, di, te, b))
    return _first_crossing(qi, _ahead(qi, di, te, b, q_econ, t_now, step), q_econ, step)


def _ahead(qi, di, te, b, q_econ, t_now, step):
    """Shapes of the cells from t_now to the horizon, zero after the stretch in which a cell falls below the limit; stretches double in length."""
    t = np.arange(t_now, HORIZON, step)
    out, live, lo, width = np.zeros((len(qi), len(t))), np.arange(len(qi)), 0, 32
    while lo < len(t) and len(live):
        block = _shape(t[None, lo:lo + width], di[live, None], te[live, None], b[live, None])
        out[live, lo:lo + width] = block
        live = live[(qi[live, None] * block >= q_econ).all(1)]
        lo, width = lo + width, 2 * width
    return out


def _first_crossing(qi, shape, q_econ, step):
    q = qi[:, None] * shape
    alive = np.logical_and.accumulate(q >= q_econ, axis=1)
    return np.where(alive, q, 0.0).sum(1) * step * DAYS_PER_MONTH, alive


#: Cells of the first lattice and of the narrower ones along ln di, ln t_elf and b, and the levels at which a volume cap lowers ln qi.
CELLS, LEVELS = ((15, 11, 6), *[(7, 7, 5)] * 5), 6
BOXES = (LN_DI, LN_TELF, (B_MIN, B_MAX), (-1.0, 0.0))
#: Series that are searched together: the shapes of their lattices stay in the cache.
FIT_ROWS = 8
#: Shapes of the first lattice at whole months, under 0, as far as they were asked for.
_first: dict[int, np.ndarray] = {}


def _parts(di, te, b, dm: float = D_MIN) -> tuple:
    """End of linear flow, the decline there, and the time from there to the terminal decline."""
    te = np.where(di > dm, np.minimum(te, (di / dm - 1.0) / (2.0 * di)), te)
    d_e = di / (1 + 2 * di * te)
    return te, d_e, np.maximum((d_e / dm - 1.0) / (b * d_e), 0.0)


def _log_shape(t, di, te, b, dm: float = D_MIN) -> np.ndarray:
    """ln of :func:`_shape` of arrays that broadcast; what b has no part in is computed without its axis.

    Linear flow goes on to t_elf, boundary-dominated flow to the terminal decline: each part stays as it is from its end on, so their logarithms add up.
    """
    te, d_e, tsw = _parts(di, te, b, dm)
    flow = np.minimum(t, te)
    base = -0.5 * np.log(1 + 2 * di * flow) - dm * (t - flow)
    boundary = np.minimum(t - flow, tsw)
    out = boundary * (b * d_e)
    out += 1.0
    np.log(out, out=out)
    out *= -1.0 / b
    boundary *= dm
    out += boundary
    out += base
    return out


def _log_shapes(t: np.ndarray, u: np.ndarray, v: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for the lattices over the axes u = ln di, v = ln t_elf and b, one lattice a row: [time, lattice, cell]."""
    return _log_shape(t[:, None, None, None, None], np.exp(u)[:, :, None, None], np.exp(v)[:, None, :, None], b[:, None, None, :]).reshape(len(t), len(u), -1)


def _volume_bounds(lnq, di, te, b, q_econ: float, t_now: float, step: float, dm: float = D_MIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, end): bounds of the step sum of :func:`_first_crossing`, and the time when the rate falls to the limit, at most the horizon.

    Rates fall and are convex, but for one end of linear flow: the trapezoids of the steps lie above the integral, by at most an eighth of the squared step times the slope now.
    """
    te, d_e, tsw = _parts(di, te, b, dm)
    l_e, l_sw = -0.5 * np.log(1 + 2 * di * te), -np.log(1 + b * d_e * tsw) / b
    q_e, q_sw = np.exp(l_e), np.exp(l_e + l_sw)

    def at(t):
        """Volume so far and rate, in units of qi."""
        flow = np.minimum(t, te)
        root = np.sqrt(1 + 2 * di * flow)
        log = np.log(1 + b * d_e * np.minimum(t - flow, tsw))
        grown = np.where(b < 1 - 1e-6, -np.expm1(-log * (1 - b) / b) / np.maximum(1 - b, 1e-9), log) / d_e
        tail = np.exp(-dm * np.maximum(t - te - tsw, 0.0))
        return (root - 1) / di + q_e * grown + q_sw * (1 - tail) / dm, np.exp(-log / b) * tail / root

    left = np.minimum(np.log(q_econ) - lnq, 0.0)  # how far ln of the shape falls until the limit
    below = np.minimum(left - l_e, 0.0)
    end = np.where(left >= l_e, np.expm1(-2 * np.maximum(left, l_e)) / (2 * di),
                   te + np.where(below >= l_sw, np.expm1(-b * np.maximum(below, l_sw)) / (b * d_e), tsw - np.minimum(below - l_sw, 0.0) / dm))
    end = np.minimum(end, HORIZON)
    steps = (end - t_now) / step
    n = np.minimum(np.floor(steps) + 1, len(np.arange(t_now, HORIZON, step)))
    scale = np.exp(lnq) * DAYS_PER_MONTH
    (v0, r0), (v1, r1) = at(t_now), at(t_now + np.maximum(n - 1, 0.0) * step)
    since = np.where(t_now < te, di / (1 + 2 * di * np.minimum(t_now, te)), d_e / (1 + b * d_e * np.clip(t_now - te, 0.0, tsw)))
    body = (v1 - v0) + step / 2 * (r0 + r1)
    unsure = np.where(np.abs(steps - np.round(steps)) < 1e-6, step * r1, 0.0) + 1e-9 * (v1 + r0)  # whether a last step belongs to it, and rounding
    unsure = unsure + step * step / 8 * np.maximum(dm - d_e, 0.0) * r0  # where linear flow ends below the terminal decline, rates fall faster from there on
    known = steps > -1e-6
    return (np.where(known, np.maximum(scale * (body - unsure), 0.0), 0.0),
            np.where(known, scale * (body + unsure + step * step / 8 * np.maximum(since, dm) * r0), 0.0), end)


def _first_shapes(t: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """Shapes of the first lattice, the same for all series; those of whole months are computed once."""
    months = t.astype(int)
    if (months != t).any() or months.max() > HORIZON:
        return _log_shapes(t, *sides)
    if months.max() >= len(_first.get(0, ())):
        _first[0] = _log_shapes(np.arange(2.0 * months.max() + 1), *sides)
    return _first[0][months]


def _under_cap(z: np.ndarray, lnq: np.ndarray, di: np.ndarray, te: np.ndarray, b: np.ndarray, bounds: tuple, q_econ: float, t_now: float, cum: float, cap: float, step: float = 2.0) -> np.ndarray:
    """``z`` of one series with the penalty of the volume cap where the sum can be least, infinite elsewhere.

    The penalty is known to be 0 where the upper bound of the volume stays under the cap, and between bounds elsewhere, so few cells need their volume summed.
    """
    volume, most, end = bounds
    beyond = lambda x: (50.0 * np.maximum(0.0, (cum + x) / cap - 1.0)) ** 2
    out = np.where(cum + most <= cap, z, np.inf)
    least, lower = min(out.min(), (z + beyond(most)).min()), z + beyond(volume)
    at = np.flatnonzero((lower <= least + 1e-8) & np.isinf(out))
    at = at[np.argsort(lower[at], kind="stable")]
    while len(at):
        part, at = at[:8], at[8:]
        t = np.arange(t_now, min(HORIZON, end[part].max() + 2 * step), step)
        q = np.exp(lnq[part, None] + _log_shape(t[None, :], di[part, None], te[part, None], b[part, None]))
        alive = np.logical_and.accumulate(q >= q_econ, axis=1)
        out[part] = z[part] + beyond(np.where(alive, q, 0.0).sum(1) * step * DAYS_PER_MONTH)
        least = min(least, out[part].min())
        at = at[lower[at] <= least + 1e-8]
    return out


def np_fit_rows(t: np.ndarray, rows: np.ndarray, q_econ: float, cum: float, cap, prior: dict) -> tuple[np.ndarray, ...]:
    """(qi, di, t_elf, b_bdf) of series with the same times, one a row, all positive: penalised least squares on log rates.

    ln qi is solved in closed form for every cell of a (di, t_elf, b) lattice that is narrowed around its best cell.
    A volume cap adds a fourth axis that lowers ln qi, because the penalty couples it to the other parameters.
    """
    if len(rows) > FIT_ROWS:
        return tuple(map(np.concatenate, zip(*(np_fit_rows(t, rows[i:i + FIT_ROWS], q_econ, cum, cap, prior) for i in range(0, len(rows), FIT_ROWS)))))
    n, lq = len(rows), np.log(rows)
    t_now = float(t.max())
    w = 0.5 ** ((t_now - t) / 24.0)
    w = w / w.mean() / SIGMA ** 2
    total, has_cap = w.sum(), cap is not None and np.isfinite(cap) and cap > 0
    mid = [np.full(n, (lo + hi) / 2) for lo, hi in BOXES]
    half = [(hi - lo) / 2 for lo, hi in BOXES]
    best = np.full((n, 6), np.inf)  # cost, u, v, b, s, ln qi
    every = np.arange(n)
    for turn, k in enumerate(CELLS):
        sides = [np.clip(m[:, None] + h * np.linspace(-1, 1, kk), *box) for m, h, kk, box in zip(mid, half, (*k, LEVELS), BOXES)]
        u, v, b, s = sides if has_cap else (*sides[:3], np.zeros((n, 1)))
        ls = _log_shapes(t, u, v, b) if turn else np.broadcast_to(_first_shapes(t, [u[:1], v[:1], b[:1]]), (len(t), n, np.prod(k)))
        free = ((w @ lq.T)[:, None] - np.tensordot(w, ls, 1)) / total
        r = ls + free
        r -= lq.T[:, :, None]
        r *= r
        away = lambda x, mean, sd: ((x - prior[mean]) / prior[sd]) ** 2
        near = ((v - np.log(prior["t_elf"])) / prior["t_elf_sd"]) ** 2
        z = np.tensordot(w, r, 1) + (away(u, "ln_di", "ln_di_sd")[:, :, None, None] + near[:, None, :, None] + away(b, "b_mean", "b_sd")[:, None, None, :]).reshape(n, -1)
        # residuals have weighted mean 0 where ln qi is free, so lowering it adds its square
        z = (z[:, :, None] + total * (s * s)[:, None, :]).reshape(n, -1)
        cells = lambda row, i: [x[row, j] for x, j in zip((u, v, b, s), np.unravel_index(i, (*k, s.shape[1])))]
        if has_cap:
            shape = (n, *k, LEVELS)
            lnq = (free[:, :, None] + s[:, None, :]).reshape(shape)
            di, te, bb = np.exp(u)[:, :, None, None, None], np.exp(v)[:, None, :, None, None], b[:, None, None, :, None]
            flat = lambda x: np.broadcast_to(x, shape).reshape(n, -1)
            bounds = [flat(x) for x in _volume_bounds(lnq, di, te, bb, q_econ, t_now, 2.0)]
            for row, *of in zip(every, flat(lnq), flat(di), flat(te), flat(bb)):
                z[row] = _under_cap(z[row], *of, tuple(x[row] for x in bounds), q_econ, t_now, cum, cap)
        i = np.argmin(np.round(z, 9), 1)
        found = np.stack([z[every, i], *cells(every, i), np.zeros(n)], 1)
        found[:, 5] = free[every, i // s.shape[1]] + found[:, 4]
        best = np.where(found[:, :1] <= best[:, :1], found, best)
        mid = [best[:, c] for c in range(1, 5)]
        half = [h * (2.0 / (kk - 1)) for h, kk in zip(half, (*k, LEVELS))]
    return np.exp(best[:, 5]), np.exp(best[:, 1]), np.exp(best[:, 2]), best[:, 3].copy()


def np_fit(t, q, q_econ: float, cum: float, cap, prior: dict) -> tuple:
    """(qi, di, t_elf, b_bdf, d_min, rmse, r2, n, converged, cap_binding) by the search of :func:`np_fit_rows`."""
    ok = np.isfinite(t) & np.isfinite(q) & (q > 0)
    t, q = t[ok], q[ok]
    n = len(t)
    if n < 4:
        return (float(q[0]) if n else 0.0, float(np.exp(prior["ln_di"])), prior["t_elf"], prior["b_mean"], D_MIN, None, None, n, False, False)
    t = t - t.min()
    qi, di, te, b = (float(x[0]) for x in np_fit_rows(t, q[None], q_econ, cum, cap, prior))
    pred = qi * _shape(t, di, te, b)
    res, tot = float(((pred - q) ** 2).sum()), float(((q - q.mean()) ** 2).sum()) or 1.0
    binding = False
    if cap is not None and np.isfinite(cap) and cap > 0:
        binding = bool(cum + _remaining([qi], [di], [te], [b], q_econ, float(t.max()))[0][0] >= 0.995 * cap)
    return (qi, di, te, b, D_MIN, float(np.sqrt(res / n)), 1 - res / tot, n, True, binding)


_NAMES = ["qi", "di", "t_elf", "b_bdf", "d_min", "rmse", "r2", "n", "converged", "cap_binding"]
FIT_TYPE = T.StructType([T.StructField(x, T.LongType() if x == "n" else T.BooleanType() if x in ("converged", "cap_binding") else T.DoubleType()) for x in _NAMES])
PRIOR_COLS = ("b_mean", "b_sd", "t_elf", "t_elf_sd", "ln_di", "ln_di_sd")


def fit_physics(packed: DataFrame, *, q_econ: float, cum: str | None = None, cap: str | None = None, prior: str | None = None) -> DataFrame:
    """Adds ``pfit``. ``packed``: ts, qs arrays; optional cumulative, volume cap and a prior struct column (NULL → default)."""
    default = dict(DEFAULT_PRIOR)

    @F.pandas_udf(FIT_TYPE)
    def run(ts: pd.Series, qs: pd.Series, cm: pd.Series, cp: pd.Series, *pr: pd.Series) -> pd.DataFrame:
        rows = []
        for i, (t, q, cu, ca) in enumerate(zip(ts, qs, cm, cp)):
            p = {k: (float(s.iloc[i]) if np.isfinite(s.iloc[i]) else default[k]) for k, s in zip(PRIOR_COLS, pr)}
            rows.append(np_fit(np.asarray(t, float), np.asarray(q, float), q_econ, float(cu), float(ca), p))
        out = pd.DataFrame(rows, columns=_NAMES)
        for x in ("rmse", "r2"):
            out[x] = out[x].astype(float)
        return out

    nan = F.lit(float("nan"))
    pr = [F.coalesce(F.col(prior)[k], nan) if prior else nan for k in PRIOR_COLS]
    return packed.withColumn("pfit", run.asNondeterministic()("ts", "qs", F.coalesce(F.col(cum), F.lit(0.0)) if cum else F.lit(0.0),
                                         F.coalesce(F.col(cap).cast("double"), nan) if cap else nan, *pr))


_REM = T.StructType([T.StructField("remaining", T.DoubleType()), T.StructField("t_econ", T.DoubleType()), T.StructField("capped", T.BooleanType())])


@F.pandas_udf(_REM)
def _rem(qi: pd.Series, di: pd.Series, te: pd.Series, b: pd.Series, q_econ: pd.Series, t_now: pd.Series) -> pd.DataFrame:
    p = np.stack([x.to_numpy(float) for x in (qi, di, te, b, q_econ, t_now)])
    volume, end, capped = np.zeros(len(qi)), p[5].copy(), np.zeros(len(qi), bool)
    for limit, start in np.unique(p[4:], axis=1).T:  # rows of one limit and time share their steps
        same = np.flatnonzero((p[4] == limit) & (p[5] == start))
        for k in (same[i:i + 256] for i in range(0, len(same), 256)):
            volume[k], alive = _remaining(*p[:4, k], limit, start)
            n = alive.sum(1)
            end[k] = np.where(n > 0, start + 0.5 * (n - 1), start)
            capped[k] = alive[:, -1] if alive.shape[1] else False
    return pd.DataFrame({"remaining": volume, "t_econ": end, "capped": capped})


_rem = _rem.asNondeterministic()


def remaining_struct(fit: Column, q_econ, t_now) -> Column:
    """Volume until the first crossing of the limit, the crossing time, and whether the horizon was hit."""
    return _rem(fit["qi"], fit["di"], fit["t_elf"], fit["b_bdf"], c(q_econ).cast("double"), c(t_now).cast("double"))


# ------------------------------------------------------------------ diagnostics
def flow_regime(points: DataFrame, entity: str, *, t: str = "t", q: str = "q", t_peak: str | None = None) -> DataFrame:
    """Early and late log-log slopes (first and last third), onset of boundary flow, regime label."""
    ok = (F.col(t) > 0) & (F.col(q) > 0)
    if t_peak:
        ok = ok & (F.col(t) >= F.col(t_peak))
    w = Window.partitionBy(entity)
    d = points.where(ok).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 6")
    d = d.withColumn("_i", F.row_number().over(w.orderBy(t))).withColumn("_lx", F.ln(t)).withColumn("_ly", F.ln(q))
    third = F.greatest(F.lit(3), F.floor(F.col("_n") / 3))
    g = d.groupBy(entity).agg(F.regr_slope(F.when(F.col("_i") <= third, F.col("_ly")), F.col("_lx")).alias("early_slope"),
                              F.regr_slope(F.when(F.col("_i") > F.col("_n") - third, F.col("_ly")), F.col("_lx")).alias("late_slope"), F.count(F.lit(1)).alias("n"))
    half = F.floor(F.greatest(F.lit(5), F.floor(F.col("_n") / 5)) / 2)
    # the half-width depends on the length: slopes come from running sums at i ± half
    run = w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.col("_lx"), F.col("_ly")
    s = d.withColumn("_h", half).withColumn("_c", F.struct(F.sum(x).over(run).alias("x"), F.sum(y).over(run).alias("y"), F.sum(x * x).over(run).alias("xx"), F.sum(x * y).over(run).alias("xy")))
    arr = s.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(t).alias("t"), "_c", "_h", "_n"))).alias("a"))
    def slope_at(r):
        lo, hi = F.greatest(r["_i"] - r["_h"] - 1, F.lit(0)).cast("int"), F.least(r["_i"] + r["_h"], r["_n"]).cast("int")
        def cut(k):
            return F.get(F.col("a"), hi - 1)["_c"][k] - F.when(lo > 0, F.get(F.col("a"), lo - 1)["_c"][k]).otherwise(0.0)
        m = (hi - lo).cast("double")
        return F.when(m >= 3, F.try_divide(m * cut("xy") - cut("x") * cut("y"), m * cut("xx") - cut("x") * cut("x")))
    e = arr.select(entity, F.explode(F.transform("a", lambda r: F.struct(r["_i"].alias("i"), r["t"].alias("t"), slope_at(r).alias("slope")))).alias("z")).select(entity, "z.i", "z.t", "z.slope")
    onset = steep_onset(e, entity=entity, order="i", at="t")
    label = (F.when(F.col("late_slope") < -0.85, "boundary_dominated").when(F.col("late_slope") > -0.7, "linear_flow").otherwise("transition"))
    return g.join(onset, entity).withColumn("regime", label)


def pressure_diagnostic(df: DataFrame, entity: str, *, order: str, cum: str, q: str, whp: str) -> DataFrame:
    """Log-log slope of normalised pressure against material-balance time over the second half of the record."""
    ok = F.col(cum).isNotNull() & (F.col(cum) > 0) & (F.col(q) > 0) & F.col(whp).isNotNull()
    w = Window.partitionBy(entity)
    d = df.where(ok).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 8").withColumn("_i", F.row_number().over(w.orderBy(order)))
    early = F.greatest(F.lit(5), F.floor(F.col("_n") / 10))
    d = d.withColumn("p_init", F.max(F.when(F.col("_i") <= early, F.col(whp))).over(w) * 1.05)
    d = d.withColumn("_mbt", F.col(cum) / F.col(q)).withColumn("_rnp", (F.col("p_init") - F.col(whp)) / F.col(q))
    g = d.where("_mbt > 0 AND _rnp > 0").withColumn("_m", F.count(F.lit(1)).over(w)).where("_m >= 8").withColumn("_j", F.row_number().over(w.orderBy(order)))
    s = g.where(F.col("_j") > F.floor(F.col("_m") / 2)).groupBy(entity).agg(F.regr_slope(F.ln("_rnp"), F.ln("_mbt")).alias("slope"))
    p = d.groupBy(entity).agg(F.max("p_init").alias("p_init"))
    return p.join(s, entity, "left")


# ------------------------------------------------------------------ priors
def _parameters(fits: DataFrame, group: str, min_points: int, *keep: str) -> DataFrame:
    f = fits.where(F.col("pfit.converged") & (F.col("pfit.n") >= min_points))
    return f.select(group, *keep, F.expr("stack(3, 'b', pfit.b_bdf, 'te', ln(greatest(pfit.t_elf, 0.05)), 'di', ln(pfit.di)) as (par, x)"))


def _prior(per_parameter: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_analogs, prior) from rows (keys, par, n_analogs, m, d)."""
    j = per_parameter.groupBy(*keys).agg(F.max("n_analogs").alias("n_analogs"), *[F.max(F.when(F.col("par") == p, F.col(v))).alias(f"{p}_{v}") for p in ("b", "te", "di") for v in ("m", "d")])
    sd = lambda p, floor: F.greatest(1.4826 * F.col(f"{p}_d"), F.lit(floor))
    prior = F.struct(F.col("b_m").alias("b_mean"), sd("b", 0.12).alias("b_sd"), F.exp("te_m").alias("t_elf"), sd("te", 0.5).alias("t_elf_sd"), F.col("di_m").alias("ln_di"), sd("di", 0.25).alias("ln_di_sd"))
    return j.select(*keys, "n_analogs", prior.alias("prior"))


def analog_prior(fits: DataFrame, group: str, *, min_n: int = 5, min_points: int = 24) -> DataFrame:
    """Median and robust spread of the fitted parameters per group as a prior struct; exact medians of any group size."""
    f = _parameters(fits, group, min_points)
    n = f.where("par = 'b'").groupBy(group).agg(F.count(F.lit(1)).alias("n_analogs")).where(F.col("n_analogs") >= min_n)
    long = f.join(n, group)
    med = exact_percentiles(long, [group, "par"], "x", {"m": .5})
    dev = long.join(med, [group, "par"]).withColumn("_d", F.abs(F.col("x") - F.col("m")))
    mad = exact_percentiles(dev, [group, "par"], "_d", {"d": .5})
    return _prior(med.join(mad, [group, "par"]).join(n, group), [group])


def analog_prior_of_others(fits: DataFrame, group: str, *, entity: str = "entity_id", min_n: int = 5, min_points: int = 24) -> DataFrame:
    """The same for every entity from the other members of its group: ``entity``, n_analogs, prior. Entities outside the library take all of its members.

    Medians without a member come from ranks (:func:`.ranking.others_median`). They take at most three values in a group, so the deviations are ranked around
    each of these, again without the member.
    """
    f = materialise(_parameters(fits, group, min_points, entity))
    n = f.where("par = 'b'").groupBy(group).agg((F.count(F.lit(1)) - 1).alias("n_analogs"))
    m = materialise(others_median(f, [group, "par"], "x", "m").where("m IS NOT NULL"))
    around = m.select(group, "par", "m").distinct()
    dev = f.join(around, [group, "par"]).withColumn("_d", F.abs(F.col("x") - F.col("m")))
    d = others_median(dev, [group, "par", "m"], "_d", "d").select(entity, group, "par", "m", "d")
    own = _prior(m.join(d, [entity, group, "par", "m"]).join(n.where(F.col("n_analogs") >= min_n), group), [entity, group])
    outside = fits.select(entity, group).join(f.select(entity).distinct(), entity, "left_anti").join(analog_prior(fits, group, min_n=min_n, min_points=min_points), group)
    return own.select(entity, "n_analogs", "prior").unionByName(outside.select(entity, "n_analogs", "prior"))


def bootstrap_physics(packed: DataFrame, entity: str, *, q_econ: float, n_boot: int = 40, seed: int = 0, cum: str | None = None, cap: str | None = None, prior: str | None = None) -> DataFrame:
    """Block bootstrap of the log residuals; every replicate is refitted with the prior, cumulative and volume cap of the fit itself."""
    from .decline import block_draws, resampled
    d = packed.withColumn("n", F.size("ts")).withColumn("t_now", F.array_max("ts") - F.array_min("ts"))
    d = d.withColumn("base", remaining_struct(F.col("pfit"), F.lit(q_econ), "t_now")["remaining"])
    reps = spread(block_draws(d.where("n >= 12"), entity, n_boot, seed, least=3), entity, "chunk")
    default = dict(DEFAULT_PRIOR)

    @F.pandas_udf("array<double>")
    def volumes(ts: pd.Series, qs: pd.Series, fit: pd.DataFrame, draws: pd.Series, block: pd.Series, limits: pd.DataFrame, pr: pd.DataFrame) -> pd.Series:
        out = []
        for i in range(len(ts)):
            t, q, f, cut = np.asarray(ts.iloc[i], float), np.asarray(qs.iloc[i], float), fit.iloc[i], limits.iloc[i]
            t = t - t.min()
            curve = np.maximum(f.qi * _shape(t, f.di, f.t_elf, f.b_bdf), 1e-9)
            drawn = curve * np.exp(resampled(np.log(q / curve), draws.iloc[i], int(block.iloc[i])))
            known = {k: float(pr.iloc[i][k]) if np.isfinite(pr.iloc[i][k]) else default[k] for k in PRIOR_COLS}
            whole = len(t) >= 4 and bool(np.isfinite(t).all()) and bool((np.isfinite(drawn) & (drawn > 0)).all())
            fits = (np.stack(np_fit_rows(t, drawn, q_econ, float(cut.cum), float(cut.cap), known), 1) if whole
                    else np.array([np_fit(t, row, q_econ, float(cut.cum), float(cut.cap), known)[:4] for row in drawn], float))
            out.append(_remaining(*fits.T, q_econ, float(t.max()))[0].tolist())
        return pd.Series(out)

    nan = F.lit(float("nan"))
    limits = F.struct((F.coalesce(F.col(cum).cast("double"), F.lit(0.0)) if cum else F.lit(0.0)).alias("cum"), (F.coalesce(F.col(cap).cast("double"), nan) if cap else nan).alias("cap"))
    pr = F.struct(*[(F.coalesce(F.col(prior)[k].cast("double"), nan) if prior else nan).alias(k) for k in PRIOR_COLS])
    f = F.struct(*[F.col("pfit")[x].alias(x) for x in ("qi", "di", "t_elf", "b_bdf")])
    v = reps.select(entity, F.explode(volumes("ts", "qs", f, "draws", "block", limits, pr)).alias("v"))
    g = v.groupBy(entity).agg(F.percentile("v", F.array(F.lit(.1), F.lit(.5), F.lit(.9))).alias("_p"))
    fallback = (0.68, 1.0, 1.32)  # p10 / p50 / p90 of the band (0.6, 1.0, 1.4)
    return d.select(entity, "base").join(g, entity, "left").select(
        entity, "base", *[F.coalesce(F.get("_p", i), F.col("base") * fallback[i]).alias(x) for i, x in enumerate(("p10", "p50", "p90"))])
