"""Decline curves: JVM-side rate expressions and the numpy kernels used inside Arrow batches.

Every family is linear in its initial rate, so a fit scans the remaining one or two parameters on a grid,
solves the rate in closed form per cell and narrows the grid around the best cell. The grid definition
below is the single source for the kernel and for the oracle SQL.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .columns import DAYS_PER_MONTH, c

# Box constraints, terminal decline and weighting of the decline fits.
D_MIN_YEAR = 0.075
HALF_LIFE = 24.0
DI_BOX = (1e-5, 2.0)
B_FLOOR = 1e-6
B_TOP = {"exponential": 0.0, "harmonic": 1.0, "hyperbolic": 1.0, "modified_hyperbolic": 1.6}
QI_BOX = (1e-6, 1e4)
DUONG_A = (1e-4, 5.0)
DUONG_M = (1e-3, 2.0)
MODELS = ("exponential", "harmonic", "hyperbolic", "modified_hyperbolic", "duong")
MIN_POINTS = 6
HORIZON_STEPS = 1200  # half-months
STEP = 0.5


@dataclass(frozen=True)
class Axis:
    """One scanned parameter: ``n`` values between lo and hi, evenly spaced (in ln where ``log``)."""
    lo: float
    hi: float
    n: int
    log: bool

    @property
    def origin(self) -> float:
        return float(np.log(self.lo)) if self.log else self.lo

    @property
    def end(self) -> float:
        return float(np.log(self.hi)) if self.log else self.hi

    @property
    def step(self) -> float:
        return (self.end - self.origin) / (self.n - 1) if self.n > 1 else 0.0


ZOOMS = 5          # narrowing rounds
ZOOM_HALF = 4      # cells on each side of the current best; the step shrinks by this factor per round


def axes(model: str) -> tuple[Axis, Axis]:
    """(first, second) scanned parameters: (di, b), or (a, m) for Duong. A single-valued axis has n = 1."""
    if model == "duong":
        return Axis(*DUONG_A, 24, True), Axis(*DUONG_M, 24, False)
    di = Axis(*DI_BOX, 25 if model != "exponential" else 49, True)
    if model == "exponential":
        return di, Axis(0.0, 0.0, 1, False)
    if model == "harmonic":
        return di, Axis(1.0, 1.0, 1, False)
    return di, Axis(B_FLOOR, B_TOP[model], 9, False)


def terminal(model: str) -> float:
    return D_MIN_YEAR / 12.0 if model in ("harmonic", "modified_hyperbolic") else 0.0


# ------------------------------------------------------------------ Column expressions
def shape(t, di, b, d_min) -> Column:
    """Rate relative to the initial rate for the Arps families."""
    t, di, b, d_min = c(t), c(di), c(b), c(d_min)
    bb = F.when(b <= B_FLOOR, 1.0).otherwise(b)
    body = F.pow(1.0 + bb * di * t, -1.0 / bb)
    t_sw = (di / F.when(d_min > 0, d_min) - 1.0) / (bb * di)
    late = F.pow(1.0 + bb * di * t_sw, -1.0 / bb) * F.exp(-d_min * (t - t_sw))
    return (F.when(b <= B_FLOOR, F.exp(-di * t))
            .when((d_min > 0) & (t_sw > 0) & (t > t_sw), late).otherwise(body))


def rate(t, fit: Column) -> Column:
    """Rate of a fit struct at t months after the fit start. A b above 1 without terminal decline is refused (NULL)."""
    t = c(t).cast("double")
    ts = F.greatest(t, F.lit(1e-6))
    m = fit["m"]
    duong = fit["qi"] * F.pow(ts, -m) * F.exp(fit["a"] / (1.0 - m) * (F.pow(ts, 1.0 - m) - 1.0))
    diverges = (fit["b"] > 1.0) & (F.coalesce(fit["d_min"], F.lit(0.0)) <= 0)
    return F.when(fit["model"] == "duong", duong).when(diverges, None).otherwise(
        fit["qi"] * shape(t, fit["di"], fit["b"], fit["d_min"]))


# ------------------------------------------------------------------ numpy kernels
def np_shape(model: str, t: np.ndarray, p: np.ndarray, s: np.ndarray, d_min) -> np.ndarray:
    """Shape on broadcast arrays; p/s are (di, b) or (a, m)."""
    if model == "duong":
        ts = np.maximum(t, 1e-6)
        return ts ** (-s) * np.exp(p / (1.0 - s) * (ts ** (1.0 - s) - 1.0))
    t, di, b, d_min = np.broadcast_arrays(t, p, s, d_min)
    flat = b <= B_FLOOR
    bb = np.where(flat, 1.0, b)
    out = np.where(flat, np.exp(-di * t), (1.0 + bb * di * t) ** (-1.0 / bb))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        t_sw = np.where(d_min > 0, (di / np.where(d_min > 0, d_min, 1.0) - 1.0) / (bb * di), 0.0)
        late = (~flat) & (d_min > 0) & (t_sw > 0) & (t > t_sw)
        tail = (1.0 + bb * di * np.maximum(t_sw, 0)) ** (-1.0 / bb) * np.exp(-d_min * (t - t_sw))
    return np.where(late, tail, out)


def np_fit(model: str, t: np.ndarray, q: np.ndarray, half_life: float | None = HALF_LIFE) -> tuple:
    """(model, qi, di, b, d_min, a, m, rmse, r2, n, converged) for one series."""
    ok = np.isfinite(t) & np.isfinite(q) & (q > 0)
    t, q = t[ok], q[ok]
    n = len(t)
    if n < MIN_POINTS:
        return (model, float(q[0]) if n else 0.0, 0.1, 0.5, 0.0, 0.0, 0.0, None, None, n, False)
    t = t - t.min()
    w = 0.5 ** ((t.max() - t) / half_life) if half_life else np.ones(n)
    w2 = (w / w.mean()) ** 2
    syy = float((w2 * q * q).sum())
    first, second = axes(model)
    d_min = terminal(model)

    def evaluate(u: np.ndarray, v: np.ndarray):
        p = np.exp(u) if first.log else u
        s = np_shape(model, t[:, None], p[None, :], v[None, :], d_min)
        # einsum instead of @: a threaded BLAS inside every worker would oversubscribe the cores
        a = np.einsum("i,ij->j", w2 * q, s)
        b = np.einsum("i,ij,ij->j", w2, s, s)
        qi = np.clip(a / np.maximum(b, 1e-300), *QI_BOX)
        sse = syy - 2 * qi * a + qi * qi * b
        return qi, np.round(sse / syy, 9)

    def lattice(us, vs):
        gu, gv = np.meshgrid(us, vs, indexing="ij")
        return gu.ravel(), gv.ravel()

    u, v = lattice(first.origin + first.step * np.arange(first.n), second.origin + second.step * np.arange(second.n))
    qi, sse = evaluate(u, v)
    k = int(np.argmin(sse))
    cu, cv, cq = u[k], v[k], qi[k]
    su, sv = first.step, second.step
    offsets = np.arange(-ZOOM_HALF, ZOOM_HALF + 1)
    for _ in range(ZOOMS):
        su, sv = su / ZOOM_HALF, sv / ZOOM_HALF
        us = cu + su * offsets
        vs = cv + sv * offsets if second.n > 1 else np.array([cv])
        u, v = lattice(us[(us >= first.origin - 1e-12) & (us <= first.end + 1e-12)],
                       vs[(vs >= second.origin - 1e-12) & (vs <= second.end + 1e-12)])
        qi, sse = evaluate(u, v)
        k = int(np.argmin(sse))
        cu, cv, cq = u[k], v[k], qi[k]
    p = float(np.exp(cu) if first.log else cu)
    pred = cq * np_shape(model, t, np.float64(p), np.float64(cv), d_min)
    res = float(((pred - q) ** 2).sum())
    tot = float(((q - q.mean()) ** 2).sum()) or 1.0
    di, b, a, m = (0.0, 0.0, p, float(cv)) if model == "duong" else (p, float(cv), 0.0, 0.0)
    return (model, float(cq), di, b, d_min, a, m, float(np.sqrt(res / n)), 1.0 - res / tot, n, True)


def np_fit_rows(model: str, t: np.ndarray, rows: np.ndarray, half_life: float | None = HALF_LIFE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qi, first, second parameter) of series with the same times, one a row, all positive: the search of :func:`np_fit` for all rows at once."""
    t = t - t.min()
    w = 0.5 ** ((t.max() - t) / half_life) if half_life else np.ones(len(t))
    w2 = (w / w.mean()) ** 2
    weighted = w2 * rows
    syy = (weighted * rows).sum(1)
    first, second = axes(model)
    d_min, every = terminal(model), np.arange(len(rows))

    def best(u, v, inside):
        """Best cell of each row; lattices (rows or one, cells)."""
        s = np_shape(model, t[:, None], (np.exp(u) if first.log else u)[:, None, :], v[:, None, :], d_min)
        a = np.einsum("ri,ij->rj", weighted, s[0]) if len(s) == 1 else np.einsum("ri,rij->rj", weighted, s)
        b = np.einsum("i,rij,rij->rj", w2, s, s)
        qi = np.clip(a / np.maximum(b, 1e-300), *QI_BOX)
        sse = np.round((syy[:, None] - 2 * qi * a + qi * qi * b) / syy[:, None], 9)
        k = np.where(inside, sse, np.inf).argmin(1)
        return np.broadcast_to(u, qi.shape)[every, k], np.broadcast_to(v, qi.shape)[every, k], qi[every, k]

    def lattice(us, vs):
        shape = len(us), us.shape[1], vs.shape[1]
        return (np.broadcast_to(x, shape).reshape(len(us), -1) for x in (us[:, :, None], vs[:, None, :]))

    u, v = lattice(first.origin + first.step * np.arange(first.n)[None], second.origin + second.step * np.arange(second.n)[None])
    cu, cv, cq = best(u, v, True)
    su, sv = first.step, second.step
    offsets = np.arange(-ZOOM_HALF, ZOOM_HALF + 1)
    for _ in range(ZOOMS):
        su, sv = su / ZOOM_HALF, sv / ZOOM_HALF
        u, v = lattice(cu[:, None] + su * offsets, cv[:, None] + sv * offsets if second.n > 1 else cv[:, None])
        inside = (u >= first.origin - 1e-12) & (u <= first.end + 1e-12)
        if second.n > 1:
            inside &= (v >= second.origin - 1e-12) & (v <= second.end + 1e-12)
        cu, cv, cq = best(u, v, inside)
    return cq, np.exp(cu) if first.log else cu, cv


#: Series that are fitted side by side: enough to spread the cost of a numpy call, few enough for their lattices to stay in the cache.
FIT_ROWS = 48


def _shape_of(model: str, t: np.ndarray, p: np.ndarray, s: np.ndarray, d_min) -> np.ndarray:
    """:func:`np_shape` for parameters that do not vary along the times: what depends on the parameters alone is computed once."""
    if model == "duong":
        return np_shape(model, t, p, s, d_min)
    if model == "exponential":
        return np.exp(-p * t)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        flat = s <= B_FLOOR
        b = np.where(flat, 1.0, s)
        out = 1.0 + b * p * t
        np.power(out, -1.0 / b, out=out)
        if flat.any():
            out = np.where(flat, np.exp(-p * t), out)
        if np.any(d_min > 0):
            t_sw = np.where(d_min > 0, (p / np.where(d_min > 0, d_min, 1.0) - 1.0) / (b * p), 0.0)
            late = (~flat) & (t_sw > 0) & (t > t_sw)
            if late.any():
                start = (1.0 + b * p * np.maximum(t_sw, 0)) ** (-1.0 / b)
                out = np.where(late, start * np.exp(-d_min * (t - t_sw)), out)
    return out


def np_fit_many(model: str, series: list[tuple[np.ndarray, np.ndarray]], half_life: float | None = HALF_LIFE) -> list[tuple]:
    """The rows of :func:`np_fit` for many series (t, q): FIT_ROWS of about the same length are padded to one matrix and searched together."""
    out: list = [None] * len(series)
    rows = []
    for i, (t, q) in enumerate(series):
        ok = np.isfinite(t) & np.isfinite(q) & (q > 0)
        if ok.sum() < MIN_POINTS:
            out[i] = np_fit(model, t, q, half_life)
        else:
            rows.append((i, t[ok] - t[ok].min(), q[ok]))
    rows.sort(key=lambda r: len(r[1]))
    for lo in range(0, len(rows), FIT_ROWS):
        part = rows[lo:lo + FIT_ROWS]
        for (i, *_), fit in zip(part, _fit_padded(model, [r[1] for r in part], [r[2] for r in part], half_life)):
            out[i] = fit
    return out


def _fit_padded(model: str, times: list[np.ndarray], rates: list[np.ndarray], half_life: float | None) -> list[tuple]:
    size = np.array([len(x) for x in times])
    own = np.arange(size.max()) < size[:, None]
    t, q = np.zeros(own.shape), np.zeros(own.shape)
    t[own], q[own] = np.concatenate(times), np.concatenate(rates)
    t = np.where(own, t, t.max(1, keepdims=True))  # padding weighs nothing, so its shapes have to be finite
    w = np.where(own, 0.5 ** ((t.max(1, keepdims=True) - t) / half_life) if half_life else 1.0, 0.0)
    w2 = (w / (w.sum(1) / size)[:, None]) ** 2
    weighted = w2 * q
    syy = (weighted * q).sum(1)
    first, second = axes(model)
    d_min, every = terminal(model), np.arange(len(size))

    def best(u, v, inside, a, b):
        """Best cell of each row, from the weighted sums of rate times shape and of squared shapes."""
        qi = np.clip(a / np.maximum(b, 1e-300), *QI_BOX)
        sse = np.round((syy[:, None] - 2 * qi * a + qi * qi * b) / syy[:, None], 9)
        k = np.where(inside, sse, np.inf).argmin(1)
        return np.broadcast_to(u, qi.shape)[every, k], np.broadcast_to(v, qi.shape)[every, k], qi[every, k]

    def lattice(us, vs):
        shape = len(us), us.shape[1], vs.shape[1]
        return (np.broadcast_to(x, shape).reshape(len(us), -1) for x in (us[:, :, None], vs[:, None, :]))

    def sums(u, v):
        s = _shape_of(model, t[:, :, None], (np.exp(u) if first.log else u)[:, None, :], v[:, None, :], d_min)
        return np.einsum("ri,rij->rj", weighted, s), np.einsum("rij,rij->rj", w2[:, :, None] * s, s)

    u, v = lattice(first.origin + first.step * np.arange(first.n)[None], second.origin + second.step * np.arange(second.n)[None])
    seen, at = np.unique(t[own], return_inverse=True)
    if model != "duong" and len(seen) <= 2 * own.shape[1]:  # months: the first lattice is the same for all rows, so its shapes are made once for every time that occurs
        place = np.nonzero(own)[0], at.reshape(-1)
        wide, wide_q = np.zeros((len(size), len(seen))), np.zeros((len(size), len(seen)))
        np.add.at(wide, place, w2[own])
        np.add.at(wide_q, place, weighted[own])
        s = _shape_of(model, seen[:, None], (np.exp(u) if first.log else u), v, d_min)
        cu, cv, cq = best(u, v, True, np.einsum("ri,ij->rj", wide_q, s), np.einsum("ri,ij->rj", wide, s * s))
    else:
        cu, cv, cq = best(u, v, True, *sums(np.broadcast_to(u, (len(size), u.shape[1])), np.broadcast_to(v, (len(size), v.shape[1]))))
    su, sv = first.step, second.step
    offsets = np.arange(-ZOOM_HALF, ZOOM_HALF + 1)
    for _ in range(ZOOMS):
        su, sv = su / ZOOM_HALF, sv / ZOOM_HALF
        u, v = lattice(cu[:, None] + su * offsets, cv[:, None] + sv * offsets if second.n > 1 else cv[:, None])
        inside = (u >= first.origin - 1e-12) & (u <= first.end + 1e-12)
        if second.n > 1:
            inside &= (v >= second.origin - 1e-12) & (v <= second.end + 1e-12)
        cu, cv, cq = best(u, v, inside, *sums(u, v))
    p = np.exp(cu) if first.log else cu
    pred = cq[:, None] * np_shape(model, t, p[:, None], cv[:, None], d_min)
    res = np.where(own, (pred - q) ** 2, 0.0).sum(1)
    tot = np.where(own, (q - (q.sum(1) / size)[:, None]) ** 2, 0.0).sum(1)
    tot[tot == 0] = 1.0
    rmse, r2 = np.sqrt(res / size), 1.0 - res / tot
    nil = np.zeros(len(size))
    di, b, a, m = (nil, nil, p, cv) if model == "duong" else (p, cv, nil, nil)
    return [(model, *row, True) for row in zip(*(x.tolist() for x in (cq, di, b, np.full(len(size), d_min), a, m, rmse, r2, size)))]


_NAMES = ["model", "qi", "di", "b", "d_min", "a", "m", "rmse", "r2", "n", "converged"]
FIT_TYPE = T.StructType([T.StructField(n, T.StringType() if n == "model" else T.LongType() if n == "n" else
                                       T.BooleanType() if n == "converged" else T.DoubleType()) for n in _NAMES])
VOLUME_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("total", "remaining", "t_econ")]
                           + [T.StructField("capped", T.BooleanType())])


def fit_udf(candidates: tuple[str, ...], half_life: float | None = HALF_LIFE):
    """Arrow-batched fit of (t array, q array); several candidates → smallest unweighted error, first wins ties."""
    candidates = tuple(candidates)

    @F.pandas_udf(FIT_TYPE)
    def run(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        series = [tuple(np.asarray(x if x is not None else [], float) for x in pair) for pair in zip(t, q)]
        rows = []
        for (ts, qs), *found in zip(series, *(np_fit_many(m, series, half_life) for m in candidates)):
            best = None
            for f in found:
                if f[-1] and (best is None or round(f[7], 6) < round(best[7], 6)):
                    best = f
            rows.append(best if best is not None else np_fit("exponential", ts, qs, half_life))
        out = pd.DataFrame(rows, columns=_NAMES)
        for x in ("rmse", "r2"):
            out[x] = out[x].astype(float)
        return out

    return run.asNondeterministic()  # keeps the optimizer from copying the fit into every filter and projection


@F.pandas_udf(VOLUME_TYPE)
def volumes(model: pd.Series, qi: pd.Series, di: pd.Series, b: pd.Series, d_min: pd.Series, a: pd.Series, m: pd.Series,
            q_econ: pd.Series, t_start: pd.Series) -> pd.DataFrame:
    """Volume above the economic limit on the half-month grid over 50 years (every grid point at or above counts)."""
    size = len(qi)
    t = STEP * np.arange(HORIZON_STEPS)
    total, rem, last, cap = (np.full(size, np.nan) for _ in range(4))
    cols = [x.to_numpy(float) for x in (qi, di, b, d_min, a, m, q_econ, t_start)]
    names = model.to_numpy()
    for lo in range(0, size, 64):
        k = slice(lo, min(lo + 64, size))
        q0, d, bb, dm, aa, mm, qe, ts = (x[k, None] for x in cols)
        duong = (names[k] == "duong")[:, None]
        with np.errstate(all="ignore"):
            arps = np.empty((len(d), len(t)))
            flat = np.nan_to_num(bb)[:, 0] <= B_FLOOR
            arps[flat] = np.exp(-np.nan_to_num(d[flat]) * t)
            arps[~flat] = _shape_of("arps", t[None, :], np.nan_to_num(d[~flat]), np.nan_to_num(bb[~flat]), np.nan_to_num(dm[~flat]))
            q = q0 * (np.where(duong, np_shape("duong", t[None, :], aa, mm, 0.0), arps) if duong.any() else arps)
            ok = q >= qe
        total[k] = np.where(ok, q, 0.0).sum(1) * STEP * DAYS_PER_MONTH
        rem[k] = np.where(ok & (t[None, :] >= ts), q, 0.0).sum(1) * STEP * DAYS_PER_MONTH
        idx = HORIZON_STEPS - 1 - np.argmax(ok[:, ::-1], axis=1)
        last[k] = np.where(ok.any(1), t[idx], 0.0)
        cap[k] = ok[:, -1]
    missing = ~np.isfinite(cols[0])
    for x in (total, rem, last):
        x[missing] = np.nan
    out = pd.DataFrame({"total": total, "remaining": rem, "t_econ": last})
    out = out.astype(object).where(~np.isnan(out.to_numpy(float)), None)
    out["capped"] = [None if z else bool(x) for x, z in zip(cap, missing)]
    return out.astype({"total": float, "remaining": float, "t_econ": float})


volumes = volumes.asNondeterministic()


def remaining_struct(fit: Column, q_econ, t_start) -> Column:
    return volumes(*[fit[x] for x in ("model", "qi", "di", "b", "d_min", "a", "m")], c(q_econ).cast("double"), c(t_start).cast("double"))


def adjusted(fit: Column, scale, decline_delta) -> Column:
    """Perturbed fit: initial rate scaled, declines shifted by an annual amount, floors kept."""
    s, d = c(scale), c(decline_delta) / 12.0
    return F.struct(fit["model"].alias("model"), (fit["qi"] * s).alias("qi"),
                    F.when(d == 0, fit["di"]).otherwise(F.greatest(fit["di"] + d, F.lit(1e-5))).alias("di"), fit["b"].alias("b"),
                    F.when((fit["d_min"] > 0) & (d != 0), F.greatest(fit["d_min"] + d, F.lit(1e-5))).otherwise(fit["d_min"]).alias("d_min"),
                    fit["a"].alias("a"), fit["m"].alias("m"))
