"""Quantile gradient boosting: every leaf holds the exact quantile of the residuals that reach it.

A model per (target, level) is fitted by a task of its own on all labelled rows, which it holds as one byte a feature and three numbers; a fitted model is a table of nodes whose
size the numbers of trees and leaves bound, so it is sent to wherever rows are predicted. Trees follow the sign of the residual (the slope of the pinball loss) over binned
features; missing values are a bin below all others.
"""
from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

# The published defaults of the model family.
TREES, RATE, LEAVES, MIN_LEAF, L2, LEVELS, AT_LEAST = 400, 0.06, 15, 8, 1.0, (0.1, 0.5, 0.9), 25
BINS = 64


def _edges(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    seen = column[np.isfinite(column)]
    return np.unique(np.quantile(seen, np.linspace(0, 1, bins)[1:-1], method="lower")) if len(seen) else np.empty(0)


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values that part its bins: between distinct values, at even shares of the rows."""
    return [_edges(column, bins) for column in x.T]


def _codes(column: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(column), np.searchsorted(edges, column, "left") + 1, 0)


def coded(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value, from 1; 0 where it is missing."""
    return np.stack([_codes(c, e) for c, e in zip(x.T, edges)], 1).astype(np.int64)


def _split(codes: np.ndarray, slope: np.ndarray, rows: np.ndarray, least: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) of the best split; gain 0 if there is none. ``codes``: [feature, row]."""
    n = len(rows)
    if n < 2 * least:
        return 0.0, 0, 0
    g = slope[rows]
    size, left = np.empty((len(codes), BINS), np.int64), np.empty((len(codes), BINS))
    for f, column in enumerate(codes):
        at = column[rows]
        size[f] = np.bincount(at, minlength=BINS + 1).cumsum()[:-1]
        left[f] = np.bincount(at, g, BINS + 1).cumsum()[:-1]
    total = g.sum()
    gain = left ** 2 / (size + l2) + (total - left) ** 2 / (n - size + l2) - total ** 2 / (n + l2)
    gain[(size < least) | (n - size < least)] = 0.0
    at = int(gain.argmax())
    return float(gain.flat[at]), at // BINS, at % BINS


#: Factor and shift that give every single bit of a number of this width a place of its own (de Bruijn).
PLACES = {"u2": (0x0F65, 12), "u4": (0x077CB531, 27), "u8": (0x03F79D71B4CB0A89, 58)}


@dataclass
class Booster:
    """Nodes of all trees one after another: feature (-1: leaf), last bin that goes left, the left child (the right one follows it), leaf value."""

    start: float
    edges: list[np.ndarray]
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray

    @cached_property
    def admitted(self) -> tuple[np.ndarray, np.ndarray]:
        """[feature, bin, tree]: bits of the tree's leaves that its splits on this feature leave open to the bin; [tree, place of the leaf's bit]: value.

        A split asks for one feature, so what all features of a row leave open is the one leaf it ends in.
        """
        ends = [*self.roots[1:], len(self.feature)]
        most = max((int((self.feature[a:b] < 0).sum()) for a, b in zip(self.roots, ends)), default=1)
        if most > 64:
            raise ValueError("a tree has at most 64 leaves")
        bits = np.dtype(next(t for t in PLACES if most <= 8 * np.dtype(t).itemsize))
        every = (1 << 8 * bits.itemsize) - 1
        factor, shift = PLACES[bits.str[1:]]
        open_ = np.full((len(self.edges), BINS + 1, len(self.roots)), every, bits)
        value = np.zeros((len(self.roots), 8 * bits.itemsize))
        for tree, (first, end) in enumerate(zip(self.roots, ends)):
            below, leaf = {}, 0
            for node in range(end - 1, first - 1, -1):  # children come after their parent
                if self.feature[node] < 0:
                    below[node] = 1 << leaf
                    value[tree, (below[node] * factor & every) >> shift] = self.value[node]
                    leaf += 1
                    continue
                left, right = below[self.child[node]], below[self.child[node] + 1]
                side = open_[self.feature[node], :, tree]
                side[: self.bin[node] + 1] &= bits.type(every & ~right)
                side[self.bin[node] + 1:] &= bits.type(every & ~left)
                below[node] = left | right
            open_[:, :, tree] &= bits.type(below[first])
        return open_, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = coded(x, self.edges)
        open_, value = self.admitted
        factor, shift = PLACES[open_.dtype.str[1:]]
        out, at = np.empty(len(x)), np.arange(len(value)) * value.shape[1]
        for low in range(0, len(x), 256):  # as many rows as stay in the cache with all their trees
            part = codes[low:low + 256]
            leaf = open_[0].take(part[:, 0], 0)
            for f in range(1, len(open_)):
                leaf &= open_[f].take(part[:, f], 0)
            each = np.empty((len(part), len(value) + 1))
            each[:, 0] = self.start
            each[:, 1:] = value.take((leaf * leaf.dtype.type(factor) >> leaf.dtype.type(shift)).astype(np.intp) + at)
            out[low:low + 256] = each.cumsum(1)[:, -1]  # tree after tree
        return out


def fit_booster(x: np.ndarray, y: np.ndarray, level: float, trees: int = TREES, rate: float = RATE, leaves: int = LEAVES, least: int = MIN_LEAF, l2: float = L2) -> Booster:
    edges = edges_of(x)
    return _grown(np.stack([_codes(c, e).astype(np.uint8) for c, e in zip(x.T, edges)]), edges, y, level, trees, rate, leaves, least, l2)


def _grown(codes: np.ndarray, edges: list[np.ndarray], y: np.ndarray, level: float, trees: int = TREES, rate: float = RATE, leaves: int = LEAVES, least: int = MIN_LEAF, l2: float = L2) -> Booster:
    """``codes``: [feature, row], a byte each, so that a task can hold many rows."""
    start = float(np.quantile(y, level))
    now = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, bin, child, value
    roots = []
    for _ in range(trees):
        slope = level - (y < now)
        roots.append(len(nodes))
        nodes.append([-1, 0, 0, 0.0])
        open_: list[tuple[float, int, np.ndarray, int, int]] = []
        ends = []

        def offer(node: int, rows: np.ndarray) -> None:
            gain, feature, last = _split(codes, slope, rows, least, l2)
            if gain > 1e-12:
                heapq.heappush(open_, (-gain, node, rows, feature, last))
            else:
                ends.append((node, rows))

        offer(roots[-1], np.arange(len(y)))
        count = 1
        while open_ and count < leaves:
            _, node, rows, feature, last = heapq.heappop(open_)
            nodes[node][:3] = [feature, last, len(nodes)]
            first = len(nodes)
            nodes += [[-1, 0, 0, 0.0], [-1, 0, 0, 0.0]]
            goes = codes[feature][rows] <= last
            offer(first, rows[goes])
            offer(first + 1, rows[~goes])
            count += 1
        for node, rows in [*ends, *((node, rows) for _, node, rows, _, _ in open_)]:
            nodes[node][3] = rate * float(np.quantile(y[rows] - now[rows], level))
            now[rows] += nodes[node][3]
    table = np.array(nodes, float).reshape(-1, 4)
    return Booster(start, edges, np.array(roots, np.int64), *(table[:, i].astype(np.int64) for i in range(3)), table[:, 3])


MODEL = "target string, level double, n bigint, start double, edges array<array<double>>, roots array<bigint>, feature array<bigint>, bin array<bigint>, child array<bigint>, value array<double>"


def fit_models(train: DataFrame, features: Sequence[str], targets: Sequence[str], *, ident: str = "entity_id", levels: Sequence[float] = LEVELS, at_least: int = AT_LEAST, trees: int = TREES) -> DataFrame:
    """One row per (target, level): the fitted nodes. Targets with fewer than ``at_least`` labels have none.

    Models are fitted side by side, one a task, each on all of the target's labels in the order of ``ident``; null labels are left out. A task takes its rows
    batch by batch and then keeps the bins of the features, one byte each.
    """
    features = list(features)
    known = [(t, q) for t in targets for q in levels]
    labels = F.array(*[F.struct(F.lit(i).alias("_model"), F.col(t).cast("double").alias("_label")) for i, (t, _) in enumerate(known)])
    long = train.select(ident, *[F.col(f).cast("double").alias(f) for f in features], F.explode(labels).alias("_t")).select(ident, *features, "_t.*").where("_label IS NOT NULL")
    names = [ident, "_label", *features]

    def fit(batches):
        held: dict[int, list[list[pd.Series]]] = {}
        for part in batches:
            for model, rows in part.groupby("_model"):
                for kept, name in zip(held.setdefault(int(model), [[] for _ in names]), names):
                    kept.append(rows[name])
        for model in sorted(held):
            columns = held.pop(model)
            order = pd.concat(columns.pop(0), ignore_index=True).sort_values().index.to_numpy()
            y = np.concatenate(columns.pop(0))[order]
            if len(y) < at_least:
                continue
            codes, edges = np.empty((len(features), len(y)), np.uint8), []
            for i in range(len(features)):
                x = np.concatenate(columns.pop(0))[order]
                edges.append(_edges(x))
                codes[i] = _codes(x, edges[-1])
            target, level = known[model]
            b = _grown(codes, edges, y, level, trees)
            yield pd.DataFrame([dict(target=target, level=level, n=len(y), start=b.start, edges=[e.tolist() for e in b.edges], roots=b.roots.tolist(),
                                     feature=b.feature.tolist(), bin=b.bin.tolist(), child=b.child.tolist(), value=b.value.tolist())])

    return materialise(long.repartitionById(max(len(known), 1), "_model").mapInPandas(fit, MODEL))


Models = dict[str, dict[float, Booster]]


def loaded(models: DataFrame) -> Models:
    """The models by target and level. Their number and size are parameters, whatever was learned from."""
    out: Models = {}
    for r in models.collect():
        out.setdefault(r["target"], {})[r["level"]] = Booster(r["start"], [np.array(e) for e in r["edges"]], *(np.array(r[c]) for c in ("roots", "feature", "bin", "child", "value")))
    return out


def scored(models: Models, features: Sequence[str], target: str, level: float = 0.5) -> Column:
    """One model's prediction as a column over the columns ``features``."""
    model = models[target][level]

    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict(x.to_numpy(float)))

    return F.pandas_udf(run, "double")(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))


def predict(models: Models, df: DataFrame, features: Sequence[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """``df`` with one row per target that has a model: target and p10 / p50 / p90 (one column a level), in rising order in every row."""
    targets = sorted(models)
    names = [f"p{round(100 * q)}" for q in levels]

    def run(x: pd.DataFrame) -> pd.Series:
        at = x.to_numpy(float)
        got = [np.sort(np.stack([models[t][q].predict(at) for q in levels], 1), 1) for t in targets]
        return pd.Series(list(np.concatenate(got, 1)) if len(at) else [], dtype=object)

    if not targets:
        return df.limit(0).select("*", F.lit("").alias("target"), *[F.lit(0.0).alias(n) for n in names])
    all_ = F.pandas_udf(run, "array<double>")(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))
    each = F.array(*[F.struct(F.lit(t).alias("target"), *[F.get("_all", i * len(levels) + j).alias(n) for j, n in enumerate(names)]) for i, t in enumerate(targets)])
    return df.withColumn("_all", all_).withColumn("_t", F.explode(each)).select("*", "_t.*").drop("_all", "_t")
