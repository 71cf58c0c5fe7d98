"""A regression forest of deep trees whose nodes never pass through the driver: they are grown in tasks and kept as a table.

Nodes with many rows are split level by level, for all trees at once, by histograms that tasks make and a shuffle adds up; only these
splits (about 1.6 for each LEAF_ROWS rows of a bag) reach the driver. Below them rows are shuffled by tree and node, and a task grows what hangs
there, on all values. A row's bag weight in a tree is told by a hash of the row, so every pass over the table sees the same bags.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.shuffles import _mixed
from lumenrank.plans.stages import cut

#: Rows of a bag that a task takes on as one subtree; nodes with more are split by histograms.
LEAF_ROWS = 32_768

#: Rows that a task routes at a time, and trees whose rows it sends on together.
CHUNK_ROWS, CHUNK_TREES = 16_384, 10

#: Bag weights are Poisson numbers of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the bag of a tree."""
    return np.searchsorted(_POISSON[:-1], (_mixed(keys, seed * 1_000_003 + tree) >> np.uint64(11)) * 2.0**-53, side="right")


def descend(feature: np.ndarray, number: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node without split that each row comes to; a row goes right where its value is above the node's number."""
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        at[rows] = left[here] + (x[rows, feature[here]] > number[here])
    return at


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature (-1: none), number (threshold, or mean where there is no split) and left child of a tree's nodes.

    Grown a level at a time for all its nodes; each feature's order is kept sorted by node. Splits leave at least `least` rows on each side.
    """
    middle = np.average(y, weights=w)
    v, at, k, made = w * (y - middle), np.zeros(len(y), dtype=np.int64), 1, 1
    orders = [np.argsort(x[:, j], kind="stable") for j in range(x.shape[1])]
    out: list[tuple[np.ndarray, ...]] = []
    for level in range(depth + 1):
        o = orders[0]
        node = at[o]
        n = np.bincount(node, minlength=k)
        end = np.cumsum(n)
        start = end - n
        total, weight = np.add.reduceat(v[o], start), np.add.reduceat(w[o], start)
        best = total**2 / weight
        best = np.where(np.minimum.reduceat(y[o], start) == np.maximum.reduceat(y[o], start), np.inf, best + 1e-12 * (1 + best))
        feature, number, left = np.full(k, -1), middle + total / weight, np.zeros(k, dtype=np.int64)
        if level == depth:
            out.append((feature, number, left))
            break
        here = np.arange(len(o)) - start[node] + 1
        room = (here >= least) & (n[node] - here >= least) & np.isfinite(best)[node]
        for j, o in enumerate(orders):
            xs = x[o, j]
            i = np.flatnonzero(room[:-1] & (xs[:-1] < xs[1:]))
            if not len(i):
                continue
            of = node[i]
            s, q = np.concatenate([[0.0], np.cumsum(v[o])]), np.concatenate([[0.0], np.cumsum(w[o])])
            ls, lw = s[i + 1] - s[start[of]], q[i + 1] - q[start[of]]
            gain = ls**2 / lw + (total[of] - ls) ** 2 / (weight[of] - lw)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(i)])))
            hit = hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]
            hit = hit[gain[hit] > best[of[hit]]]
            where, a, b = of[hit], xs[i[hit]].astype(float), xs[i[hit] + 1].astype(float)
            with np.errstate(invalid="ignore"):
                half = (a + b) / 2
            best[where], feature[where], number[where] = gain[hit], j, np.where(half < b, half, a)
        split = feature >= 0
        rank = np.cumsum(split) - 1
        left[split] = made + 2 * rank[split]
        out.append((feature, number, left))
        k = 2 * int(split.sum())
        made += k
        if not k:
            break
        o = orders[0][split[node]]
        own = at[o]
        at[o] = 2 * rank[own] + (x[o, feature[own]] > number[own])
        keep = np.zeros(len(y), dtype=bool)
        keep[o] = True
        kind = np.uint16 if k < 2**16 else np.int64  # short numbers are sorted by radix
        orders = [o[np.argsort(at[o].astype(kind), kind="stable")] for o in (o[keep[o]] for o in orders)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Top:
    """The splits of all trees above the subtrees; in each tree a list of (feature, threshold, left child, depth)."""

    def __init__(self, trees: int):
        self.nodes = [[(-1, 0.0, 0, 0)] for _ in range(trees)]

    def split(self, tree: int, node: int, feature: int, threshold: float) -> int:
        own = self.nodes[tree]
        depth = own[node][3]
        own[node] = (feature, threshold, len(own), depth)
        own += [(-1, 0.0, 0, depth + 1)] * 2
        return own[node][2]

    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        kinds = (np.int64, float, np.int64, np.int64)
        return [tuple(np.array(c, dtype=d) for c, d in zip(zip(*t, strict=True), kinds, strict=True)) for t in self.nodes]


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task, about CHUNK_ROWS at a time."""
    held, n = [], 0
    for pdf in parts:
        for at in range(0, len(pdf), CHUNK_ROWS):
            held.append(pdf.iloc[at : at + CHUNK_ROWS])
            n += len(held[-1])
            if n >= CHUNK_ROWS:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32)


def _histograms(top: Top, active: list[dict[int, int]], edges: list[np.ndarray], middle: float, seed: int) -> Callable:
    """A function that adds up a task's rows by tree, active node, feature and bin: rows, weights, weighted distances from middle."""
    trees, bins = top.arrays(), max(len(e) for e in edges) + 1

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = [(len(a), len(edges), bins) for a in active]
        held = [(np.zeros(s, np.int64), np.zeros(s), np.zeros(s)) for s in shape]
        for pdf in _chunks(parts):
            x, y, keys = _matrix(pdf["x"]), pdf["y"].to_numpy() - middle, pdf["key"].to_numpy(np.int64)
            bin_ = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
            for t, own in enumerate(active):
                if own:
                    feature, number, left, _ = trees[t]
                    place = np.full(len(feature), -1)
                    place[list(own)] = list(own.values())
                    w = bag(keys, t, seed)
                    rows = np.flatnonzero(w)
                    at = place[descend(feature, number, left, x[rows])]
                    rows, at = rows[at >= 0], at[at >= 0]
                    cell = ((at[:, None] * len(edges) + np.arange(len(edges))) * bins + bin_[rows]).ravel()
                    for h, value in zip(held[t], (None, w[rows], w[rows] * y[rows]), strict=True):
                        h += np.bincount(cell, None if value is None else np.repeat(value, len(edges)), h.size).reshape(h.shape).astype(h.dtype)
        for t, own in enumerate(active):
            for node, i in own.items():
                if held[t][0][i].any():
                    yield pd.DataFrame({"tree": [t], "node": [node], **{c: [h[i].tobytes()] for c, h in zip("nws", held[t], strict=True)}})

    return go


def _choose(features: int, least: int) -> Callable:
    """A function that picks the best split of each node of a tree from the histograms of all tasks."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, node), own in pdf.groupby(["tree", "node"]):
            n, w, s = (sum(np.frombuffer(b, d).reshape(features, -1) for b in own[c]) for c, d in (("n", np.int64), ("w", float), ("s", float)))
            (ln, lw, ls), (n, w, s) = (np.cumsum(h, axis=1)[:, :-1] for h in (n, w, s)), (h[:1].sum(axis=1)[0] for h in (n, w, s))
            ok = (ln >= least) & (n - ln >= least)
            gain = np.where(ok, ls**2 / np.where(ok, lw, 1) + (s - ls) ** 2 / np.where(ok, w - lw, 1), -np.inf)
            at = int(gain.argmax()) if gain.size else 0
            j, e = divmod(at, max(1, gain.shape[1]))
            good = gain.size > 0 and gain.flat[at] > s**2 / w * (1 + 1e-12) + 1e-12
            out.append((tree, node, j if good else -1, e, int(ln[j, e]) if good else 0, int(n)))
        return pd.DataFrame(out, columns=["tree", "node", "feature", "edge", "below", "all"])

    return go


def _packed(top: Top, seed: int | None, parts_of: int = 1) -> Callable:
    """A function that sends rows (key, x and y) to the subtrees they come to, as blocks: with bag weights and y, or without (no seed)."""
    trees = top.arrays()

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _chunks(parts):
            x, keys = _matrix(pdf["x"]), pdf["key"].to_numpy(np.int64)
            y = None if seed is None else pdf["y"].to_numpy(float)
            out = []
            for t, (feature, number, left, _) in enumerate(trees):
                w = np.ones(len(x), np.int64) if seed is None else bag(keys, t, seed)
                rows = np.flatnonzero(w)
                at = descend(feature, number, left, x[rows]) * parts_of + (keys[rows] % parts_of if parts_of > 1 else 0)
                order = np.argsort(at, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if len(own):
                        r = rows[own]
                        told = keys[r].tobytes() if seed is None else y[r].tobytes() + w[r].astype(np.uint8).tobytes()
                        out.append((t, *divmod(int(at[own[0]]), parts_of), len(r), x[r].tobytes(), told))
                if out and (t % CHUNK_TREES == CHUNK_TREES - 1 or t == len(trees) - 1):
                    yield pd.DataFrame(out, columns=["tree", "sub", "part", "n", "x", "told"])
                    out = []

    return go


_BLOCKS = "tree int, sub int, part int, n int, x binary, told binary"
_TREES = "tree int, sub int, nodes int, feature binary, number binary, left binary"


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.float32).reshape(n, -1) for n, b in zip(pdf["n"], pdf["x"], strict=True)])


@dataclass
class DeepForestModel:
    """Splits at the top, and a table of the subtrees below."""

    featuresCol: str
    top: Top
    subtrees: DataFrame
    trained: int

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction, the mean of the trees. Rows are shuffled to the subtrees they come to."""
        numbered = cut(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        n = numbered.count()
        parts = max(1, math.ceil(n / max(self.trained, LEAF_ROWS)))  # no group of rows is much greater than those of training

        def judge(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(tree):
                return pd.DataFrame({"_row": np.zeros(0, np.int64), "_p": np.zeros(0)})
            feature, number, left = (np.frombuffer(tree[c].iloc[0], d).astype(k) for c, d, k in (("feature", np.int16, np.int64), ("number", float, float), ("left", np.int32, np.int64)))
            return pd.DataFrame({"_row": np.concatenate([np.frombuffer(b, np.int64) for b in rows["told"]]), "_p": number[descend(feature, number, left, _rows(rows))]})

        blocks = numbered.select(F.col("_row").alias("key"), vector_to_array(self.featuresCol, "float32").alias("x")).mapInPandas(_packed(self.top, None, parts), _BLOCKS)
        trees = self.subtrees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        by = ("tree", "sub", "part")
        each = blocks.groupBy(*by).cogroup(trees.groupBy(*by)).applyInPandas(judge, "_row long, _p double")
        return numbered.join(each.groupBy("_row").agg(F.avg("_p").alias("prediction")), "_row", "left").drop("_row")


@dataclass
class DeepForest:
    """Trees on bags of all rows, every feature at every split; a split leaves at least minInstancesPerNode rows (counted once) on each side.

    Nodes of more than LEAF_ROWS rows are split at one of maxBins - 1 quantiles, others between any two values (in single
    precision). Rows that are alike in every column share their bag weights: tell them apart by a column such as image_id.
    Where so many rows are alike in all features that no quantile parts them, one task takes them.
    """

    featuresCol: str = "_x"
    labelCol: str = "label"
    numTrees: int = 300
    minInstancesPerNode: int = 2
    maxDepth: int = 30
    maxBins: int = 32
    seed: int = 42

    def getNumTrees(self) -> int:
        return self.numTrees

    def getMaxDepth(self) -> int:
        return self.maxDepth

    def getFeatureSubsetStrategy(self) -> str:
        return "all"

    def fit(self, df: DataFrame) -> DeepForestModel:
        names = [c for c in df.columns if c != self.featuresCol]
        rows = df.select(F.xxhash64(*names, vector_to_array(self.featuresCol)).alias("key"), vector_to_array(self.featuresCol, "float32").alias("x"), F.col(self.labelCol).cast("double").alias("y"))
        rows = cut(rows, "rows")
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("middle"), F.min(F.size("x")).alias("width")).first()
        if not stats["n"]:
            raise ValueError("no rows to learn from")
        top = self._top(rows, stats["n"], stats["middle"], stats["width"])
        depths = [[node[3] for node in t] for t in top.nodes]
        deepest, least = self.maxDepth, self.minInstancesPerNode

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            y = np.concatenate([np.frombuffer(b, float, n) for n, b in zip(pdf["n"], pdf["told"], strict=True)])
            w = np.concatenate([np.frombuffer(b, np.uint8, n, 8 * n) for n, b in zip(pdf["n"], pdf["told"], strict=True)]).astype(float)
            tree, sub = int(pdf["tree"].iloc[0]), int(pdf["sub"].iloc[0])
            feature, number, left = grow(_rows(pdf), y, w, deepest - depths[tree][sub], least)
            return pd.DataFrame({"tree": [tree], "sub": [sub], "nodes": [len(feature)], "feature": [feature.astype(np.int16).tobytes()], "number": [number.tobytes()], "left": [left.astype(np.int32).tobytes()]})

        subtrees = rows.mapInPandas(_packed(top, self.seed), _BLOCKS).groupBy("tree", "sub").applyInPandas(learn, _TREES)
        return DeepForestModel(self.featuresCol, top, cut(subtrees, "trees"), stats["n"])

    def _top(self, rows: DataFrame, n: int, middle: float, width: int) -> Top:
        """Splits of the nodes that have more than LEAF_ROWS rows."""
        top = Top(self.numTrees)
        if n <= LEAF_ROWS:
            return top
        shares = [i / self.maxBins for i in range(1, self.maxBins)]
        found = rows.agg(*[F.percentile_approx(F.col("x")[j], shares, 10_000) for j in range(width)]).first()
        edges = [np.unique(np.array(e, dtype=np.float32)) for e in found]
        active = [{0: 0} for _ in range(self.numTrees)]
        # a task sends sums for each node, so there are few tasks: as many as run at once, or one for 250,000 rows
        dealt = cut(rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // 250_000)), "dealt")
        while any(active):
            sums = dealt.mapInPandas(_histograms(top, active, edges, middle, self.seed), "tree int, node int, n binary, w binary, s binary")
            picked = sums.groupBy("tree").applyInPandas(_choose(width, self.minInstancesPerNode), "tree int, node int, feature int, edge int, below long, all long").collect()
            large: list[list[int]] = [[] for _ in range(self.numTrees)]
            for r in picked:
                if r["all"] > LEAF_ROWS and r["feature"] >= 0 and top.nodes[r["tree"]][r["node"]][3] < self.maxDepth:
                    left = top.split(r["tree"], r["node"], r["feature"], float(edges[r["feature"]][r["edge"]]))
                    large[r["tree"]] += [left + side for side, size in enumerate((r["below"], r["all"] - r["below"])) if size > LEAF_ROWS]
            active = [{node: i for i, node in enumerate(sorted(own))} for own in large]
        return top
