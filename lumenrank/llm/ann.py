"""Approximate nearest neighbours: inverted lists with adaptive dimension scans.

Each vector lies in the lists of its ``ASSIGN`` nearest centroids (fitted on a bounded sample). How many lists
a query probes is calibrated: the exact neighbours of up to ``CALIBRATED`` queries are found by one pass over all
vectors, and the probes are the fewest with which ``TARGET`` of those neighbours lie in a probed list. In a
list, vectors are rotated at random and read in blocks of columns: after each block the distance over the
dimensions seen so far is scaled up to all of them, and a candidate is given up once a hypothesis test says
that its true distance exceeds the worst that the query keeps. What is left is scored on the original vectors in
double precision. A query meets a vector in the first of the vector's lists that it probes only.

Lists lie in cells, a task reads a cell: crowded cells are cut into chunks of about ``CHUNK`` entries and blocks
of about ``BLOCK_QUERIES`` queries, so neither side of a group grows with the table. Equal vectors are searched once
and keep their ``k + 1`` smallest ids, which is all that ties can ask for.

Nulls: a vector that is null, zero, or holds a null or non-finite component, and a row with a null
id, take no part. Vectors of different lengths are not compared: each length is searched apart. Rows that
repeat an id with the same vector count once. Ties of scores go to the smaller id. An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import stage_table

#: Vectors that centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 4

#: Lists: so many times the root of the number of vectors, at most a quarter of the sample. Lists that a vector lies in.
LISTS_OF_ROOT, ASSIGN = 4.0, 3

#: Entries and queries in one group of the search.
CHUNK, BLOCK_QUERIES = 8_192, 4_096

#: Queries that the number of probes is calibrated on, and the share of their neighbours that must lie in probed lists.
CALIBRATED, TARGET = 256, 0.95

#: Vectors that a query's lists must hold at least.
LEAST_CANDIDATES = 200

#: Columns in a block, and how far a scaled partial distance may lie above the true one (in deviations).
BLOCK, TEST = 16, 2.1

#: Share of the pairs below which a scan goes on pair by pair instead of with whole blocks.
SPARSE = 0.15

SCHEMA = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector (array<double>) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & v.isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists(v, lambda x: x != 0))


def fit_centroids(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float32)
    centres = sample[rng.choice(len(sample), size=min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centres)
    return centres


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very small or large components neither vanish nor overflow
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Scan:
    """An adaptive scan of one group: queries keep their k nearest candidates from list to list."""

    def __init__(self, queries: np.ndarray, k: int, turn: np.ndarray):
        self.q, self.k, self.turn, self.d = _unit(queries), k, turn, queries.shape[1]
        self.u = (self.q @ turn).astype(np.float32)
        self.bound = np.full(len(queries), np.inf)
        self.scores = np.full((len(queries), k), -np.inf)
        self.keys = np.full((len(queries), k), np.iinfo(np.int64).max)

    def _limit(self, row: np.ndarray, seen: int) -> np.ndarray:
        """The partial distance over the dimensions seen beyond which the test gives a candidate up."""
        return (self.bound[row] + 1e-6) * (1 + TEST / math.sqrt(seen)) ** 2 * seen / self.d

    def read(self, row: np.ndarray, vectors: np.ndarray, keys: np.ndarray, allowed: np.ndarray) -> None:
        """Let the queries of row meet the unit vectors of a list, where allowed."""
        v, u, d = (vectors @ self.turn).astype(np.float32), self.u[row], self.d
        part, keep, seen = np.zeros((len(row), len(v)), np.float32), allowed, 0
        while seen < d and np.count_nonzero(keep) > SPARSE * keep.size:
            to = min(d, seen + BLOCK)
            a, b = u[:, seen:to], v[:, seen:to]
            part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            seen = to
            keep = keep & (part <= self._limit(row, seen)[:, None])
        at, col = np.nonzero(keep)
        part = part[at, col]
        while seen < d and len(at):
            to = min(d, seen + BLOCK)
            part = part + ((u[at, seen:to] - v[col, seen:to]) ** 2).sum(axis=1)
            seen = to
            left = part <= self._limit(row[at], seen)
            at, col, part = at[left], col[left], part[left]
        if not len(at):
            return
        scores = np.einsum("pd,pd->p", self.q[row[at]], vectors[col])
        # each query's best so far and its new ones, best first
        own = row[at]
        touched = np.unique(own)
        own = np.concatenate((own, np.repeat(touched, self.k)))
        scores, found = np.concatenate((scores, self.scores[touched].ravel())), np.concatenate((keys[col], self.keys[touched].ravel()))
        order = np.lexsort((found, -scores, own))
        own, scores, found = own[order], scores[order], found[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        best = rank < self.k
        self.scores[own[best], rank[best]], self.keys[own[best], rank[best]] = scores[best], found[best]
        self.bound[touched] = 2 - 2 * self.scores[touched, -1]


def _sampled(classes: DataFrame, n: int) -> np.ndarray:
    return _matrix(classes.orderBy(F.xxhash64("key"), "key").limit(n).select("vector").toArrow().column(0))


class Lists:
    """Centroids, the cells that they lie in, and the search over them."""

    def __init__(self, classes: DataFrame, n: int, k: int):
        self.spark, self.k = classes.sparkSession, k
        sample = _unit(_sampled(classes, SAMPLE))
        self.d = sample.shape[1]
        self.centres = fit_centroids(sample, max(1, min(int(LISTS_OF_ROOT * math.sqrt(n)), len(sample) // 4)))
        self.turn = rotation(self.d)
        self.assign = min(ASSIGN, len(self.centres))
        # neighbouring lists share a cell
        coarse = fit_centroids(self.centres, max(1, self.assign * n // CHUNK), seed=5)
        self.cell = np.argmax(self.centres @ coarse.T, axis=1)
        self.listed = stage_table(self._assigned(classes), "lists")
        counted = self.listed.select(F.explode("lists").alias("list")).groupBy("list").count().collect()
        self.counts = np.zeros(len(self.centres), dtype=np.int64)
        self.counts[[r[0] for r in counted]] = [r[1] for r in counted]

    def near(self, rows: np.ndarray) -> np.ndarray:
        """Closeness of each centroid."""
        return _unit(rows).astype(np.float32) @ self.centres.T

    def _assigned(self, classes: DataFrame) -> DataFrame:
        """key, vector, ids, lists (nearest first) of each vector."""
        centres, assign = self.centres, self.assign

        def run(batches):
            for b in batches:
                if b.num_rows:
                    near = _unit(_matrix(b.column("vector"))).astype(np.float32) @ centres.T
                    few = np.argpartition(-near, assign - 1, axis=1)[:, :assign]
                    few = np.take_along_axis(few, np.argsort(-np.take_along_axis(near, few, 1), axis=1, kind="stable"), 1)
                    lists = pa.ListArray.from_arrays(np.arange(0, few.size + 1, assign, dtype=np.int32), pa.array(few.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vector"), b.column("ids"), lists], names=["key", "vector", "ids", "lists"])

        return classes.select("key", "vector", "ids").mapInArrow(run, "key long, vector array<double>, ids array<long>, lists array<int>")

    def probes(self, asked: DataFrame) -> int:
        """The fewest probes with which TARGET of the exact neighbours of some queries lie in a probed list."""
        some = asked.select("key", "vector").distinct().orderBy(F.xxhash64("key"), "key").limit(CALIBRATED).toArrow()
        queries, own, k = _unit(_matrix(some.column("vector"))), some.column("key").to_numpy(), self.k

        def exact(batches):
            for b in batches:
                if b.num_rows:
                    scores = queries @ _unit(_matrix(b.column("vector"))).T
                    keys = b.column("key").to_numpy()
                    scores[own[:, None] == keys[None, :]] = -2
                    m = min(k, scores.shape[1])
                    few = np.argpartition(-scores, m - 1, axis=1)[:, :m]
                    taken = b.column("lists").take(pa.array(few.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), m)), pa.array(np.take_along_axis(scores, few, 1).ravel()), taken], names=["q", "score", "lists"])

        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        hits = self.listed.select("key", "vector", "lists").mapInArrow(exact, "q long, score double, lists array<int>").filter("score > -2").withColumn("r", best).filter(F.col("r") <= k)
        found = hits.select("q", "lists").toArrow()
        if not found.num_rows:
            return 1
        order = np.argsort(-self.near(queries), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        ranks = np.sort(place[found.column("q").to_numpy()[:, None], _matrix(found.column("lists"))].min(axis=1))
        return int(ranks[min(len(ranks) - 1, math.ceil(TARGET * len(ranks)) - 1)]) + 1

    def probing(self, asked: DataFrame, probes: int) -> DataFrame:
        """key, vector, cell, lists: a row for each cell in which a query probes lists, with all its lists."""
        centres, counts, cell = self.centres, self.counts, self.cell

        def run(batches):
            for b in batches:
                if b.num_rows:
                    near = _unit(_matrix(b.column("vector"))).astype(np.float32) @ centres.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    at, cells, lists = [], [], []
                    for i, by in enumerate(order):
                        held = np.cumsum(counts[by])
                        m = max(probes, int(np.searchsorted(held, min(LEAST_CANDIDATES * ASSIGN, held[-1]))) + 1)
                        mine = np.unique(cell[by[:m]])
                        at.append(np.full(len(mine), i))
                        cells.append(mine)
                        lists += [by[:m].astype(np.int32)] * len(mine)
                    rows = b.take(pa.array(np.concatenate(at)))
                    yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("vector"), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))], names=["key", "vector", "cell", "lists"])

        return asked.select("key", "vector").distinct().mapInArrow(run, "key long, vector array<double>, cell int, lists array<int>")

    def search(self, asked: DataFrame, probes: int) -> DataFrame:
        """key, found, score: the k nearest candidates of each query, by group."""
        probing = stage_table(self.probing(asked, probes), "probing")
        # a row for each cell: fewer than lists
        queries = {r[0]: r[1] for r in probing.groupBy("cell").count().collect()}
        entries = np.bincount(self.cell, weights=self.counts, minlength=int(self.cell.max()) + 1)
        cuts = [(c, max(1, math.ceil(n / CHUNK)), max(1, math.ceil(queries.get(c, 0) / BLOCK_QUERIES))) for c, n in enumerate(entries.tolist())]
        cuts = F.broadcast(self.spark.createDataFrame(cuts, "cell int, chunks int, blocks int"))
        of_list = F.broadcast(self.spark.createDataFrame([(i, int(c)) for i, c in enumerate(self.cell)], "list int, cell int"))
        entry = self.listed.select("key", "vector", "lists", F.posexplode("lists").alias("turn", "list")).join(of_list, "list").join(cuts, "cell")
        entry = entry.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        question = probing.join(cuts, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        turn, k, n_lists = self.turn, self.k, len(self.centres)

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"key": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            own = Scan(_matrix(left.column("vector")), k, turn)
            probed = np.zeros((left.num_rows, n_lists), dtype=bool)
            sizes = np.diff(left.column("lists").combine_chunks().offsets.to_numpy())
            probed[np.repeat(np.arange(left.num_rows), sizes), left.column("lists").combine_chunks().flatten().to_numpy()] = True
            vectors, keys = _unit(_matrix(right.column("vector"))), right.column("key").to_numpy()
            lists, place, at = _matrix(right.column("lists")), right.column("turn").to_numpy(), right.column("list").to_numpy()
            order = np.argsort(at, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                row = np.flatnonzero(probed[:, at[some[0]]])
                if not len(row):
                    continue
                # a vector is met in the first of its lists that the query probes
                allowed = np.ones((len(row), len(some)), dtype=bool)
                for j in range(lists.shape[1] - 1):
                    later = np.flatnonzero(place[some] > j)
                    allowed[:, later] &= ~probed[row][:, lists[some[later], j]]
                own.read(row, vectors[some], keys[some], allowed)
            q, c = np.nonzero(np.isfinite(own.scores))
            return pa.table({"key": pa.array(left.column("key").to_numpy()[q]), "found": pa.array(own.keys[q, c]), "score": pa.array(own.scores[q, c])})

        by = ("cell", "chunk", "block")
        return question.select(*by, "key", "vector", "lists").groupBy(*by).cogroup(entry.select(*by, "key", "vector", "lists", "turn", "list").groupBy(*by)).applyInArrow(scan, "key long, found long, score double")


def _of_length(rows: DataFrame, queries_every: int, k: int) -> DataFrame:
    """nearest, of rows (id, vector) whose vectors have one length."""
    # equal vectors as one, under their least id, with the k + 1 smallest ids
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.distinct().withColumn("_r", order).filter(F.col("_r") <= k + 1)
    classes = few.groupBy("vector").agg(F.min("id").alias("key"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stage_table(classes, "classes")
    # queries: each distinct vector that a query row has
    asked = rows.filter(F.col("id") % queries_every == 0).distinct()
    asked = stage_table(asked.join(classes.select("vector", "key"), "vector").select("id", "key", "vector"), "queries")
    if asked.isEmpty():
        return rows.sparkSession.createDataFrame([], SCHEMA)
    lists = Lists(classes, classes.count(), k + 1)
    hits = lists.search(asked, lists.probes(asked))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "found"))
    hits = stage_table(hits.withColumn("_r", best).filter(F.col("_r") <= k + 1).drop("_r"), "hits")
    named = hits.join(classes.select(F.col("key").alias("found"), "ids"), "found").select("key", "score", F.explode("ids").alias("vec_id"))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answers = asked.select(F.col("id").alias("query_id"), "key").join(named, "key").filter("query_id <> vec_id")
    return answers.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries_every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row whose id is a multiple of queries_every."""
    rows = stage_table(usable(vectors, id_col, vector_col), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    spark: SparkSession = vectors.sparkSession
    return reduce(DataFrame.unionByName, [_of_length(rows.filter(F.size("vector") == d), queries_every, k) for d in lengths], spark.createDataFrame([], SCHEMA))
