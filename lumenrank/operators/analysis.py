"""Comparisons of features and items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.functions.ranks import quantiles
from lumenrank.functions.tdist import two_sided
from lumenrank.plans.stages import cut


def feature_columns(df: DataFrame, key: str = "image_id") -> list[str]:
    """Numeric columns other than the key."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if c != key and (t in kinds or t.startswith("decimal"))]


def long_form(df: DataFrame, columns: list[str], key: str = "image_id") -> DataFrame:
    """key, feature, value: one row for each item and feature, nulls included."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(key, F.explode(cells).alias("x")).select(key, "x.*")


def quantile_selectors(df: DataFrame, column: str = "mean_score") -> tuple[Column, Column]:
    """(high: the top tenth, mid: from the 40 % to the 60 % quantile) as conditions on column."""
    q = quantiles(df, [column], [0.4, 0.6, 0.9])[column]
    return F.col(column) >= F.lit(q[2]), F.col(column).between(F.lit(q[0]), F.lit(q[1]))


def compare_groups(features: DataFrame, labels: DataFrame, high: Column, mid: Column, with_p: bool = True) -> DataFrame:
    """feature, high_mean, mid_mean, effect_size_d, t_stat, p_value of two groups of items, the largest effect first.

    Effect: Cohen's d, 0 with fewer than two rows in a group or no spread. t and p are Welch's.
    """
    names = feature_columns(features)
    both = features.join(labels, "image_id").withColumn("_g", F.when(high, 1)).withColumn("_m", F.when(mid, 1))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])
    rows = both.filter("_g = 1 OR _m = 1").select("_g", "_m", F.explode(cells).alias("x")).select("_g", "_m", "x.*").filter("value IS NOT NULL")
    a, b = F.when(F.col("_g") == 1, F.col("value")), F.when(F.col("_m") == 1, F.col("value"))
    got = rows.groupBy("feature").agg(F.avg(a).alias("high_mean"), F.avg(b).alias("mid_mean"), F.count(a).alias("_na"), F.count(b).alias("_nb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    got = got.filter("_na > 0 AND _nb > 0")
    pooled = F.sqrt(((F.col("_na") - 1) * F.col("_va") + (F.col("_nb") - 1) * F.col("_vb")) / (F.col("_na") + F.col("_nb") - 2))
    gap = F.col("high_mean") - F.col("mid_mean")
    enough = (F.col("_na") >= 2) & (F.col("_nb") >= 2)
    d = F.when(enough & (pooled > 0), gap / pooled).otherwise(0.0)
    sa, sb = F.col("_va") / F.col("_na"), F.col("_vb") / F.col("_nb")
    t = F.when(enough & (sa + sb > 0), gap / F.sqrt(sa + sb))
    freedom = F.when(enough & (sa + sb > 0), (sa + sb) ** 2 / (sa**2 / (F.col("_na") - 1) + sb**2 / (F.col("_nb") - 1)))
    out = got.select("feature", "high_mean", "mid_mean", d.alias("effect_size_d"), t.alias("t_stat"), freedom.alias("_df"))
    if with_p:

        @F.pandas_udf("double")
        def p_value(stat: pd.Series, df: pd.Series) -> pd.Series:
            return pd.Series([two_sided(x, n) for x, n in zip(stat, df, strict=True)], dtype=float)

        out = out.withColumn("p_value", p_value("t_stat", "_df"))
    return out.drop("_df").orderBy(F.desc("effect_size_d"), "feature")


def correlation(features: DataFrame) -> DataFrame:
    """f1, f2, r for every two features, over the rows that have both."""
    names = feature_columns(features)
    pairs = list(combinations(names, 2))

    def of(a: str, b: str) -> Column:
        return F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))

    one = features.agg(*[of(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("x")).select("x.*")


def medians(features: DataFrame) -> DataFrame:
    """One row with the median of every feature."""
    names = feature_columns(features)
    middle = quantiles(features, names, [0.5])
    return features.sparkSession.createDataFrame([tuple(middle[c][0] for c in names)], ", ".join(f"`{c}` double" for c in names))


def median_deviation(features: DataFrame, k: int | None = None) -> DataFrame:
    """image_id, feature, value, delta: distance of each feature from its median; the k largest of each item."""
    names = feature_columns(features)
    middle = medians(features).select(*[F.col(c).alias(f"_m_{c}") for c in names])
    wide = features.crossJoin(F.broadcast(middle))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.abs(F.col(c) - F.col(f"_m_{c}")).alias("delta")) for c in names])
    rows = wide.select("image_id", F.explode(cells).alias("x")).select("image_id", "x.*")
    if k is None:
        return rows
    w = Window.partitionBy("image_id").orderBy(F.desc_nulls_last("delta"), "feature")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def as_vector(features: DataFrame, key: str = "image_id") -> DataFrame:
    """key, vector: the numeric columns as one array, nulls as 0."""
    return features.select(key, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_columns(features, key)]).alias("vector"))


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, item: object, k: int = 5, key: str = "image_id") -> DataFrame:
    """key, similarity: the k items most like one item by cosine, itself left out; none for an unknown id."""
    one = vectors.filter(F.col(key) == F.lit(item)).limit(1).select(F.col("vector").alias("_q"))
    size = F.sqrt(_dot("vector", "vector")) * F.sqrt(_dot("_q", "_q"))
    found = vectors.filter(F.col(key) != F.lit(item)).crossJoin(F.broadcast(one))
    return found.select(key, F.when(size > 0, _dot("vector", "_q") / size).otherwise(0.0).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


#: Queries and items in one block of nearest_all, about, and cells of their product that are held at once.
BLOCK_ROWS, SLICE_CELLS = 16_384, 4_000_000

#: Columns of a product whose largest cells are looked at first, and pairs whose similarity is told at once.
MAXIMA, EXACT_PAIRS = 512, 65_536

#: Items of a block that are too few for cells.
FEW_ITEMS = 1_024


def _likely(near: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells that may be among the k largest of their rows, if cells are off by less than half of slack.

    Columns are dealt into runs; the k-th of the runs' maxima is no larger than the k-th largest cell.
    """
    runs = min(near.shape[1], max(MAXIMA, 4 * k))
    whole = near.shape[1] // runs * runs
    best = near[:, :whole].reshape(len(near), -1, runs).max(axis=1)
    least = np.partition(best, runs - k, axis=1)[:, runs - k] if runs >= k else np.full(len(near), -np.inf)
    return np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))


def _multiply(k: int, key: str, itself: bool = False):
    """A function that multiplies queries (query, qv) by items (item, iv) and keeps k for each query; itself: its own key may be among them.

    Items of a block lie in cells of their nearest pivot, queries are grouped by theirs: the own cell tells how near the k-th item
    is at least, and by the triangle inequality of angles a group skips cells that cannot hold a nearer one. A product of
    unit vectors, in single precision where they are long, tells the few cells of the product that can be among the k; their
    similarities are then told in double precision.
    """

    def multiply(left: pd.DataFrame, right: pd.DataFrame, asks: np.ndarray | None = None) -> pd.DataFrame:
        """asks: which queries (rows) meet the items whose column part is so much. Where left has bound, items less like a query than
        its bound may be left out."""
        none = pd.DataFrame({"query": pd.Series([], dtype=object), key: pd.Series([], dtype=object), "similarity": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        right = right.sort_values("item", kind="stable")
        items, b, a = right["item"].to_numpy(), np.stack(right["iv"].to_numpy()), np.stack(left["qv"].to_numpy())
        kind = np.float32 if b.shape[1] >= 32 else np.float64
        size_a, size_b, out = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1), []
        unit = lambda v, size: v / np.where(size > 0, size, 1)[:, None]
        points, cell, radius = _cells(unit(b, size_b), size_b > 0)
        # zero queries, which skip nothing, are a group of their own
        angle = np.arccos(np.clip(unit(a, size_a) @ points.T, -1, 1))
        group = np.where(size_a > 0, angle.argmin(axis=1), len(points))
        by = np.argsort(group, kind="stable")
        every, a, size_a, group, angle = left["query"].to_numpy()[by], a[by], size_a[by], group[by], angle[by]
        bound = left["bound"].fillna(-np.inf).to_numpy(float)[by] if "bound" in left else np.full(len(a), -np.inf)
        asked = None if asks is None else asks[by]
        part = None if asks is None else right["part"].to_numpy()
        whole, across = unit(a, size_a).astype(kind), np.ascontiguousarray(unit(b, size_b).astype(kind).T)
        slack = 8 * b.shape[1] * float(np.finfo(kind).eps) + 2e-12
        left_out = pd.DataFrame({"id": items[:0] if itself else items, "col": np.arange(0 if itself else len(items))})
        own = pd.DataFrame({"id": every, "row": np.arange(len(every))}).merge(left_out, on="id").sort_values("row")
        own_row, own_col = own["row"].to_numpy(), own["col"].to_numpy()

        def product(low: int, high: int, columns: np.ndarray) -> np.ndarray:
            """Similarities, about, of queries from low to high with items of some columns; nothing for those that do not meet."""
            near = whole[low:high] @ (across if len(columns) == len(items) else across[:, columns])
            same = slice(*np.searchsorted(own_row, [low, high]))
            at = np.searchsorted(columns, own_col[same])
            hit = columns[np.minimum(at, len(columns) - 1)] == own_col[same]
            near[own_row[same][hit] - low, at[hit]] = -np.inf
            if asked is not None:
                near[~asked[low:high][:, part[columns]]] = -np.inf
            return near

        edges = np.flatnonzero(np.diff(group, prepend=-1, append=len(points) + 1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            at, mine = group[low], np.flatnonzero(cell == group[low])
            needed = np.ones(len(radius), dtype=bool)
            if at < len(points) and len(points) > 1:
                if len(mine) >= k:
                    step = max(1, SLICE_CELLS // len(mine))
                    for i in range(low, high, step):
                        j = min(high, i + step)
                        kth = np.partition(product(i, j, mine), len(mine) - k, axis=1)[:, len(mine) - k]
                        bound[i:j] = np.maximum(bound[i:j], kth)
                # angles near 0 are told to about 1e-8
                far = np.where(bound[low:high] > -1, np.arccos(np.clip(bound[low:high] - slack, -1, 1)), np.inf)
                needed[:-1] = (angle[low:high] - radius[:-1] <= far[:, None] + 1e-7).any(axis=0)
            columns = np.flatnonzero(needed[cell])
            step = max(1, SLICE_CELLS // max(1, len(columns)))
            for i in range(low, high, step) if len(columns) else ():
                j = min(high, i + step)
                near = product(i, j, columns)
                near[near < (bound[i:j] - slack)[:, None]] = -np.inf
                row, col = _likely(near, k, slack)
                row, col = row + i, columns[col]
                sizes, dot = size_a[row] * size_b[col], np.zeros(len(row))
                for p in range(0, len(row), EXACT_PAIRS):
                    dot[p : p + EXACT_PAIRS] = np.einsum("ij,ij->i", a[row[p : p + EXACT_PAIRS]], b[col[p : p + EXACT_PAIRS]])
                told = np.where(sizes > 0, dot / np.where(sizes > 0, sizes, 1), 0.0)
                order = np.lexsort((col, -told.round(12), row))
                row, col, told = row[order], col[order], told[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append((every[row[kept]], items[col[kept]], told[kept]))
        return pd.DataFrame(dict(zip(("query", key, "similarity"), map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else none

    return multiply


def _cells(units: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivots, the cell of each unit vector, the largest angle to a pivot in each cell). Vectors that are not there (zero) are a last cell.

    About as many cells as cells have vectors; one where vectors are few.
    """
    some = np.flatnonzero(there)
    count = max(1, round(len(some) ** 0.5)) if len(some) >= FEW_ITEMS else 1
    points = units[some[np.linspace(0, len(some) - 1, count).astype(int)]] if len(some) else np.zeros((1, units.shape[1]))
    cell, radius = np.full(len(units), len(points)), np.zeros(len(points) + 1)
    near = units[some] @ points.T
    cell[some] = near.argmax(axis=1)
    np.maximum.at(radius, cell[some], np.arccos(np.clip(near.max(axis=1, initial=-1), -1, 1)))
    return points, cell, radius


def nearest_all(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "image_id", sizes: tuple[int, int] | None = None, itself: bool = False) -> DataFrame:
    """query, key, similarity, rank: the k nearest items of every query, exactly. sizes: rows of both, if they are known; itself: the item of
    a query's own key is not left out.

    Queries and items are dealt into blocks of about BLOCK_ROWS; a task multiplies one block by another, slice by slice,
    and keeps k for each query, so no side is broadcast, no group grows with the table, and the best of the
    blocks are merged. All pairs are compared: the work grows with the product of both sides.
    """
    n_q, n_v = (max(1, -(-n // BLOCK_ROWS)) for n in sizes or (queries.count(), vectors.count()))
    deal = lambda c, seed, n: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(key).alias("query"), F.col("vector").alias("qv"), deal(key, 0, n_q).alias("_qb"), every(n_v).alias("_vb"))
    v = vectors.select(F.col(key).alias("item"), F.col("vector").alias("iv"), deal(key, 1, n_v).alias("_vb"), every(n_q).alias("_qb"))
    kind = dict(vectors.dtypes)[key]
    multiply = _multiply(k, key, itself)
    found = q.groupBy("_qb", "_vb").cogroup(v.groupBy("_qb", "_vb")).applyInPandas(lambda left, right: multiply(left, right), f"query {kind}, {key} {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Pivots of nearest_pruned, at most, whose vectors pass through the driver; queries that are sent to cells at once.
PIVOTS, SEND_ROWS = 256, 2_000


def nearest_pruned(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "image_id", pivots: int | None = None, itself: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query, key, similarity, rank of the k nearest items of every query, exactly, as nearest_all; one row with pairs that
    could not be skipped and pairs in all).

    Items lie in the cell of their nearest pivot, whose radius is the largest angle to it. A query first meets its own cell. By the
    triangle inequality of angles no item of another cell can be nearer than the query's angle to its pivot less the
    radius, so cells that cannot hold one of the k nearest are skipped. Zero vectors have similarity 0 to all: they are
    a cell of their own that only a k-th similarity above 0 skips, and such queries skip nothing.
    """
    size = F.sqrt(_dot("vector", "vector"))
    items, asked = (cut(df.select(F.col(key).alias("id"), "vector").filter("vector IS NOT NULL"), "vectors") for df in (vectors, queries))
    kind, n = dict(items.dtypes)["id"], items.count()
    wanted = pivots or max(1, min(PIVOTS, round(n**0.5 / 2)))
    chosen = items.filter(size > 0).orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    points = np.array([r["vector"] for r in chosen], dtype=float) if chosen else np.zeros((0, 0))
    points = points / np.linalg.norm(points, axis=1)[:, None] if len(points) else points

    def angles(pdf: pd.DataFrame) -> np.ndarray:
        """Angles to the pivots; not a number for zero vectors."""
        v = np.stack(pdf["vector"].to_numpy())
        length = np.linalg.norm(v, axis=1)[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.arccos(np.clip(v @ points.T / length, -1, 1)) if len(points) else np.full((len(v), 0), np.nan)

    def celled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                at = angles(pdf)
                none = np.isnan(at).any(axis=1) | (at.shape[1] == 0)
                near = np.where(none[:, None], 0, at) if at.shape[1] else np.zeros((len(pdf), 1))
                cell = near.argmin(axis=1)
                yield pdf.assign(cell=np.where(none, -1, cell), angle=np.where(none, 0.0, near[np.arange(len(pdf)), cell]))

    shape = f"id {kind}, vector array<double>, cell int, angle double"
    plain = lambda df: df.select("id", F.col("vector").cast("array<double>").alias("vector"))
    placed, posed = (cut(plain(df).mapInPandas(celled, shape), "cells") for df in (items, asked))
    # a row for each cell
    cells = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    # cells in the order of a walk from pivot to near pivot fill packs of about BLOCK_ROWS items; a larger cell is dealt into blocks
    walk, left = [c for c in (-1,) if c in cells], [c for c in cells if c >= 0]
    while left:
        at = left[0] if not walk or walk[-1] < 0 else max(left, key=dict(zip(left, points[left] @ points[walk[-1]], strict=True)).get)
        walk.append(at)
        left.remove(at)
    packs: list[list[int]] = []
    held = 0
    for c in walk:
        if not packs or held + cells[c][0] > BLOCK_ROWS:
            packs.append([])
            held = 0
        packs[-1].append(c)
        held += cells[c][0]
    blocks = lambda n: max(1, -(-n // BLOCK_ROWS))
    deals = placed.sparkSession.createDataFrame([(c, p, blocks(sum(cells[x][0] for x in pack))) for p, pack in enumerate(packs) for c in pack], "cell int, pack int, blocks int")
    deal = lambda c, seed, n: F.pmod(F.xxhash64(c, F.lit(seed)), n).cast("int")
    multiply = _multiply(k, key, itself)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Queries (with the bits of the cells they ask for) by the items of a pack: in one product where most are asked for."""
        if not len(left) or not len(right):
            return multiply(left, right)
        members, cell = packs[right["pack"].iloc[0]], right["cell"].to_numpy()
        asks = np.unpackbits(np.frombuffer(b"".join(left["cells"]), np.uint8).reshape(len(left), -1), axis=1)[:, : len(members)].astype(bool)
        there = [j for j, c in enumerate(members) if (cell == c).any()]
        if asks[:, there].mean() > 0.5:
            return multiply(left, right.assign(part=right["cell"].map({members[j]: i for i, j in enumerate(there)})), asks[:, there])
        return pd.concat([multiply(left[asks[:, j]], right[cell == members[j]]) for j in there])

    def asking(wanted, vectors: bool):
        """A function that gives a row for each query and pack: with vector and bits of the pack's cells, or with how many pairs they are."""

        def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for at in range(0, len(pdf), SEND_ROWS):
                    some = pdf.iloc[at : at + SEND_ROWS]
                    asks = wanted(some)
                    for p, pack in enumerate(packs):
                        own = asks[:, [x + 1 for x in pack]]
                        row = np.flatnonzero(own.any(axis=1))
                        if len(row) and vectors:
                            bits = np.packbits(own[row], axis=1)
                            kth = some["kth"].to_numpy(float)[row] if "kth" in some else np.full(len(row), np.nan)
                            yield pd.DataFrame({"query": some["id"].to_numpy()[row], "qv": some["vector"].to_numpy()[row], "bound": kth, "pack": p, "cells": [x.tobytes() for x in bits]})
                        elif len(row):
                            yield pd.DataFrame({"pack": [p], "rows": [len(row)], "pairs": [int((own * np.array([cells[x][0] for x in pack])).sum())]})

        return send

    def compare(known: DataFrame, wanted) -> tuple[DataFrame, DataFrame]:
        """The k nearest of queries among the items of the cells that wanted names (one column a cell, from -1), and how many pairs they are, by pack."""
        counted = cut(known.mapInPandas(asking(wanted, False), "pack int, rows long, pairs long").groupBy("pack").agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")), "counted")
        both = cut(deals.join(counted, "pack").select("cell", "pack", "blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("groups")), "deals")
        sent = known.mapInPandas(asking(wanted, True), f"query {kind}, qv array<double>, bound double, pack int, cells binary")
        q = sent.join(F.broadcast(both.select("pack", "blocks", "groups").distinct()), "pack").select("query", "qv", "bound", "cells", "pack", deal("query", 0, F.col("groups")).alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        v = placed.join(F.broadcast(both), "cell").select(F.col("id").alias("item"), F.col("vector").alias("iv"), "cell", "pack", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), deal("id", 1, F.col("blocks")).alias("block"))
        by = ("pack", "group", "block")
        return q.groupBy(*by).cogroup(v.groupBy(*by)).applyInPandas(meet, f"query {kind}, {key} {kind}, similarity double"), counted

    def own_cell(pdf: pd.DataFrame) -> np.ndarray:
        there = np.zeros((len(pdf), len(points) + 1), dtype=bool)
        there[np.arange(len(pdf)), pdf["cell"].to_numpy() + 1] = True
        return there & filled

    filled = np.array([c in cells for c in range(-1, len(points))], dtype=bool)
    radius = np.array([cells.get(c, (0, 0.0))[1] for c in range(len(points))])

    def other_cells(pdf: pd.DataFrame) -> np.ndarray:
        at, kth, cell = angles(pdf), pdf["kth"].fillna(-np.inf).to_numpy(float), pdf["cell"].to_numpy()
        # angles near 0 are told to about 1e-8
        best = np.where(np.isnan(at), 0.0, np.cos(np.maximum(0, at - radius - 1e-7)))
        there = np.c_[(kth <= 1e-9) & (cell != -1), best >= kth[:, None] - 1e-9]
        there[np.arange(len(pdf)), cell + 1] = False
        return there & filled

    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), key)
    first, near = compare(posed, own_cell)
    first = cut(first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "first")
    bound = first.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("kth"))
    known = cut(posed.join(bound, posed["id"] == bound["query"], "left").drop("query"), "known")
    rest, far = compare(known, other_cells)
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    met = near.unionByName(far).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared"))
    return found, met.withColumn("pairs", F.lit(n) * F.lit(asked.count()))


#: Pairs that are all compared sooner than pivots are looked for.
ALL_PAIRS = 20_000_000_000


#: Pairs that are compared before equal vectors are looked for.
FEW_PAIRS = 1_000_000_000


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str, sizes: tuple[int, int], itself: bool = False) -> DataFrame:
    """As nearest_all; by pivots where the pairs are more than ALL_PAIRS."""
    if sizes[0] * sizes[1] <= ALL_PAIRS:
        return nearest_all(queries, vectors, k, key, sizes, itself)
    return nearest_pruned(queries, vectors, k, key, itself=itself)[0]


def nearest_exact(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "image_id") -> DataFrame:
    """As nearest_all. Where the pairs are many and equal vectors make half of them or more, each vector is compared once.

    Of the items with one vector the k + 1 of least key can be among the k nearest of any item. So the k + 1 nearest of
    distinct vectors, each with these of its items, hold the k + 1 nearest items of all queries with one vector; a query leaves itself out.
    """
    queries, vectors = (cut(df, "vectors") for df in (queries, vectors))
    sizes = queries.count(), vectors.count()
    if sizes[0] * sizes[1] <= FEW_PAIRS:
        return _nearest(queries, vectors, k, key, sizes)
    # about how many differ: tables without equal vectors are not grouped for nothing
    about = [df.agg(F.approx_count_distinct("vector")).first()[0] for df in (queries, vectors)]
    if about[0] * about[1] > 0.6 * sizes[0] * sizes[1]:
        return _nearest(queries, vectors, k, key, sizes)
    least = Window.partitionBy("vector").orderBy(key)
    few = vectors.filter("vector IS NOT NULL").select(key, "vector").withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= k + 1)
    groups = cut(few.groupBy("vector").agg(F.array_sort(F.collect_list(key)).alias("ids")).select(F.col("ids")[0].alias(key), "vector", "ids"), "groups")
    asked = cut(queries.filter("vector IS NOT NULL").groupBy("vector").agg(F.min(key).alias(key)).select(key, "vector"), "asked")
    distinct = asked.count(), groups.count()
    if 2 * distinct[0] * distinct[1] > sizes[0] * sizes[1]:
        return _nearest(queries, vectors, k, key, sizes)
    near = _nearest(asked, groups.select(key, "vector"), k + 1, key, distinct, itself=True)
    each = near.select("query", key, "similarity").join(groups.select(key, "ids"), key).select("query", F.explode("ids").alias("id"), "similarity")
    first = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "id")
    each = each.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
    told = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_r", "id", "similarity"))).alias("told"))
    told = asked.select(F.col(key).alias("query"), "vector").join(told, "query").select("vector", "told")
    others = F.slice(F.filter("told", lambda x: x["id"] != F.col(key)), 1, k)
    found = queries.select(key, "vector").join(told, "vector").select(F.col(key).alias("query"), F.posexplode(others).alias("_p", "x"))
    return found.select("query", F.col("x.id").alias(key), F.col("x.similarity").alias("similarity"), (F.col("_p") + 1).alias("rank"))


def compare_items(features: DataFrame, a: object, b: object, n: int = 20) -> DataFrame:
    """feature, a, b, delta: two items side by side, the n largest differences."""
    rows = long_form(features.filter(F.col("image_id").isin(a, b)), feature_columns(features))
    sides = rows.groupBy("feature").agg(F.max(F.when(F.col("image_id") == F.lit(a), F.col("value"))).alias("a"), F.max(F.when(F.col("image_id") == F.lit(b), F.col("value"))).alias("b"))
    return sides.withColumn("delta", F.col("b") - F.col("a")).orderBy(F.desc_nulls_last(F.abs("delta")), "feature").limit(n)
