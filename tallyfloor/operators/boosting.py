"""Boosted Poisson trees on categories, grown best first (K4), for a whole grid of settings at once (K6)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyfloor.operators.settle import settle

#: Codes of a feature. One with more levels is cut into so many classes by the levels' training means.
CODES = 255
#: Cells that one task of the fit holds.
TASK_CELLS = 200_000
#: Rows (in hessian weight) that a level needs in a node to be ordered; what has less stays on the right side. Also smooths the order.
SUPPORT = 10.0
LEAST_HESSIAN = 1e-3
LONG = 100_000  # levels of a feature from which its codes are not broadcast


@dataclass(frozen=True)
class Setting:
    learning_rate: float
    leaves: int
    l2: float


def code_tables(cell: DataFrame, features: Sequence[str]) -> dict[str, DataFrame]:
    """For each feature its levels with their code, ``c_<feature>`` (0 to CODES - 1)."""
    out = {}
    for f in features:
        levels = settle(cell.groupBy(f).agg((F.sum("cell_sum") / F.sum("cell_n")).alias("mean")))
        many = levels.count()
        if many <= CODES:
            names = [r[0] for r in levels.select(f).orderBy(f).collect()]  # CODES levels at most
            code = F.coalesce(*[F.when(F.col(f).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in enumerate(names)]) if names else F.lit(0)
        else:
            cuts = levels.select(F.percentile_approx("mean", [k / CODES for k in range(1, CODES)], 100_000)).first()[0]
            cuts = sorted(set(cuts))
            code = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("mean")))
        table = settle(levels.select(f, code.cast("int").alias(f"c_{f}")))
        out[f] = table if many <= LONG else table.hint("merge")  # a long table would be broadcast by its file size
    return out


def encode(rows: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Adds the codes; -1 for a level that training has not seen."""
    for f, table in codes.items():
        held = table.select(F.col(f).alias(f"__{f}"), f"c_{f}")
        rows = rows.join(held, F.col(f).eqNullSafe(F.col(f"__{f}")), "left").drop(f"__{f}").fillna(-1, [f"c_{f}"])
    return rows


# --- one tree -----------------------------------------------------------------------------


def best_split(hist: np.ndarray, starts: np.ndarray, l2: float, least_rows: float):
    """(gain, feature, codes of the left side, larger side is left) of the best split of a node, or None.

    ``hist`` has gradient, hessian and rows of each code, features one after the other from ``starts``. Codes with
    enough support are ordered by gradient / (hessian + SUPPORT); the left side is a run from either end of that order."""
    best = None
    if hist[2, starts[0] : starts[1]].sum() < 2 * least_rows:
        return None
    for f in range(len(starts) - 1):
        g, h, n = hist[:, starts[f] : starts[f + 1]]
        G, H, N = g.sum(), h.sum(), n.sum()
        if H <= 0:
            continue
        used = np.flatnonzero(h * (N / H) >= SUPPORT)
        if not len(used):
            continue
        order = used[np.argsort(g[used] / (h[used] + SUPPORT), kind="stable")]
        for run in (order, order[::-1]):
            left = np.cumsum(np.stack([g[run], h[run], n[run]]), axis=1)
            right = np.array([[G], [H], [N]]) - left
            fits = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
            gain = np.where(fits, left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - G**2 / (H + l2), -np.inf)
            k = int(gain.argmax())
            if gain[k] > 1e-12 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), f, np.sort(run[: k + 1]), bool(left[2][k] > right[2][k]))
    return best


class _Tree:
    """A tree in growth. Leaves wait in a queue by gain; nodes may be opened (given children) before it is known whether they are
    split, so that one exchange of histograms serves many nodes."""

    def __init__(self, setting: Setting, least_rows: float, starts: np.ndarray):
        self.setting, self.least_rows, self.starts = setting, least_rows, starts
        self.totals, self.splits, self.children, self.parent = [], [], {}, []
        self.queue, self.leaves, self.split = [], {0}, set()

    def add(self, hist: np.ndarray, parent: int) -> None:
        node = len(self.totals)
        first = hist[:, self.starts[0] : self.starts[1]].sum(1)
        self.totals.append(first)
        self.parent.append(parent)
        self.splits.append(best_split(hist, self.starts, self.setting.l2, self.least_rows))
        if node == 0:
            self.wait(0)

    def wait(self, node: int) -> None:
        if self.splits[node] is not None:
            heapq.heappush(self.queue, (-self.splits[node][0], node))

    def grow(self) -> None:
        """Splits the leaves of largest gain as far as their children are known."""
        while self.queue and len(self.leaves) < self.setting.leaves and self.queue[0][1] in self.children:
            _, node = heapq.heappop(self.queue)
            self.split.add(node)
            self.leaves.remove(node)
            for child in self.children[node]:
                self.leaves.add(child)
                self.wait(child)

    def to_open(self) -> list[int]:
        """Waiting leaves that could still be split and have no children yet; none when the tree is done."""
        room = self.setting.leaves - len(self.leaves)
        return [node for _, node in heapq.nsmallest(room, self.queue) if node not in self.children] if room > 0 else []

    def value(self, node: int) -> float:
        g, h, _ = self.totals[node]
        return -self.setting.learning_rate * g / (h + self.setting.l2)

    def leaf_of(self) -> np.ndarray:
        """For each node the leaf of the finished tree it belongs to."""
        out = np.arange(len(self.totals))
        for node in range(1, len(self.totals)):
            p = self.parent[node]
            if p not in self.split:
                out[node] = out[p]
        return out

    def rows(self) -> Iterator[tuple]:
        """(node, feature, codes on the left, left child, right child, larger side is left, value) of the nodes that remain."""
        for node in sorted(self.split):
            _, f, left, larger = self.splits[node]
            yield (node, f, left.tolist(), *self.children[node], larger, 0.0)
        for node in sorted(self.leaves):
            yield (node, -1, [], -1, -1, False, self.value(node))


def boost(x: np.ndarray, n: np.ndarray, s: np.ndarray, sizes: Sequence[int], base: float, settings: Sequence[Setting], rounds: int,
          least_rows: float, exchange) -> Iterator[tuple]:
    """Rows (setting, round, node, ...) of all trees from the cells of one task: codes, rows and target totals.

    ``exchange`` adds up an array over all tasks and gives each the same sum, so that all grow the same trees. Trees of all
    settings grow side by side; an exchange carries the histograms of the nodes that were opened since the last one."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = x + starts[:-1]
    eta = np.full((len(settings), len(n)), base)
    for k in range(rounds):
        trees = [_Tree(p, least_rows, starts) for p in settings]
        node_of = np.zeros((len(settings), len(n)), np.int64)
        mu = n * np.exp(eta)
        fresh = [(t, 0, -1) for t in range(len(trees))]  # tree, node, parent
        while fresh:
            hist = np.zeros((len(fresh), 3, starts[-1]))
            for i, (t, node, _) in enumerate(fresh):
                own = np.flatnonzero(node_of[t] == node)
                for j, w in enumerate((mu[t, own] - s[own], mu[t, own], n[own])):
                    hist[i, j] = np.bincount(flat[own].ravel(), np.repeat(w, len(sizes)), starts[-1])
            hist = exchange(hist)
            for (t, _, parent), own in zip(fresh, hist):
                trees[t].add(own, parent)
            fresh = []
            for t, tree in enumerate(trees):
                tree.grow()
                at = len(tree.totals)
                for node in tree.to_open():
                    _, f, left, larger = tree.splits[node]
                    side = np.zeros(sizes[f], bool)
                    side[left] = True
                    own = np.flatnonzero(node_of[t] == node)
                    node_of[t, own] = np.where(side[x[own, f]], at, at + 1)
                    tree.children[node] = (at, at + 1)
                    fresh += [(t, at, node), (t, at + 1, node)]
                    at += 2
        for t, tree in enumerate(trees):
            value = np.array([tree.value(v) for v in range(len(tree.totals))])[tree.leaf_of()]
            eta[t] += value[node_of[t]]
            yield from ((t, k, *row) for row in tree.rows())


_ROWS = "setting int, round int, node int, feature int, codes array<int>, left int, right int, larger boolean, value double"


class Boosted:
    """Fitted trees: log of the mean plus the leaf values of all trees."""

    def __init__(self, features: Sequence[str], codes: dict[str, DataFrame], sizes: Sequence[int], base: float, rows: list):
        self.features, self.codes, self.sizes, self.base, self.trees = list(features), codes, list(sizes), base, {}
        for r in rows:
            self.trees.setdefault(r["setting"], {}).setdefault(r["round"], []).append(r)

    def eta(self, *codes: Column, setting: int = 0) -> Column:
        """The linear predictor from codes, one vectorised pass over the trees for each batch."""
        base, width = self.base, max([1, *self.sizes])
        packed = []
        for _, rows in sorted(self.trees.get(setting, {}).items()):
            place = {r["node"]: i for i, r in enumerate(sorted(rows, key=lambda r: r["node"]))}
            rows = sorted(rows, key=lambda r: r["node"])
            left = np.zeros((len(rows), width + 1), bool)  # the last column is that of an unseen level
            for i, r in enumerate(rows):
                left[i, r["codes"]] = True
                left[i, width] = r["larger"]
            follow = lambda name: np.array([place.get(r[name], -1) for r in rows])
            packed.append((np.array([r["feature"] for r in rows]), left, follow("left"), follow("right"), np.array([r["value"] for r in rows])))

        def walk(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(np.int64) for c in columns], axis=1)
            out = np.full(len(x), base)
            at = np.arange(len(x))
            for feature, left, yes, no, value in packed:
                node = np.zeros(len(x), np.int64)
                while True:
                    f = feature[node]
                    inner = np.flatnonzero(f >= 0)
                    if not len(inner):
                        break
                    go = left[node[inner], x[at[inner], f[inner]]]
                    node[inner] = np.where(go, yes[node[inner]], no[node[inner]])
                out += value[node]
            return pd.Series(out)

        return F.pandas_udf(walk, "double")(*codes)

    def predict(self, rows: DataFrame, out: str = "prediction", setting: int = 0) -> DataFrame:
        """``rows`` with the expected count; an unseen level goes with the larger side of a split."""
        names = [f"c_{f}" for f in self.features]
        return encode(rows, self.codes).withColumn(out, F.exp(self.eta(*names, setting=setting))).drop(*names)


def fit(cell: DataFrame, features: Sequence[str], settings: Sequence[Setting], rounds: int = 250, least_rows: float = 50.0, task_cells: int = TASK_CELLS) -> Boosted:
    """Additive Poisson trees for each of ``settings``.

    The features' codes split the cells once more, to one row per combination of codes; those are dealt to a few tasks that run together (a barrier stage) and
    hold ``task_cells`` each. The tasks exchange histograms of gradient, hessian and rows for (node, feature, code), whose size does not depend on the data, and
    grow the same trees from their sum: the leaf with the largest gain is split first, up to the setting's leaves, each side with at least ``least_rows`` rows. A
    stage for all rounds, so no plan grows with them; if an executor is lost the stage starts anew and gives the same trees."""
    features = list(features)
    codes = code_tables(cell, features)
    names = [f"c_{f}" for f in features]
    small = settle(encode(cell, codes).groupBy(*names).agg(F.sum("cell_n").cast("double").alias("n"), F.sum("cell_sum").cast("double").alias("s")))
    size, n, s, *top = small.agg(F.count(F.lit(1)), F.sum("n"), F.sum("s"), *[F.max(c) for c in names]).first()
    if not size:
        return Boosted(features, codes, [1] * len(features), math.log(1e-9), [])
    sizes, base = [int(t) + 1 for t in top], math.log(max(s / n, 1e-9))
    slots = small.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(slots, -(-size // task_cells)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        table = pa.Table.from_batches(list(batches), schema=layout)
        x = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], axis=1) if len(table) else np.zeros((0, len(names)), np.int64)
        own_n, own_s = (table.column(c).to_numpy() for c in ("n", "s"))

        def exchange(a: np.ndarray) -> np.ndarray:
            if tasks == 1:
                return a
            parts = context.allGather(base64.b64encode(a.tobytes()).decode())
            return sum(np.frombuffer(base64.b64decode(p)).reshape(a.shape) for p in parts)

        out = []
        for row in boost(x, own_n, own_s, sizes, base, settings, rounds, least_rows, exchange):
            if context.partitionId() == 0:
                out.append(row)
        if out:
            kinds = [pa.int32()] * 4 + [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[p.split()[0] for p in _ROWS.split(", ")])

    layout = pa.schema([*[(c, pa.int32()) for c in names], ("n", pa.float64()), ("s", pa.float64())])
    dealt = small.select(*[F.col(c).cast("int") for c in names], "n", "s").repartition(tasks, *names)
    trees = dealt.mapInArrow(run, _ROWS, barrier=True)
    return Boosted(features, codes, sizes, base, settle(trees).collect())  # settings x rounds x nodes
