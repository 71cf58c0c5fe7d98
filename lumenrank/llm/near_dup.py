"""Near-duplicate documents by a chosen-path similarity join over sets of word shingles.

Each of several independent trees sends a document down a path: at every node the document's least
shingle, under a hash that depends on the path so far, chooses the branch. Two sets of similarity s
go on together with probability s at each node, unrelated ones almost never. Rows of equal sets are
joined first and walk the trees as one. A node of at most ``SMALL`` members is compared where it arises,
a larger one is branched on, down to ``DEPTH``; there it is compared whatever its size.

Comparing a node is exhaustive, but makes no pairs within groups of copies. Every member is compared with
the node's hub, the one that meets most others over all trees, and a hub settles all its nodes at once. Beside a hub
of at most ``LANE`` members those that are not joined yet are compared in the hub's task. Beside a larger one, two
members x, y are told apart by what sets them off from hub h: with the symmetric differences
D = x ^ h and E = y ^ h the sets x and y differ by |D| + |E| - 2 |D & E|, so a link needs |D & E| to reach a
number that sizes alone give. Where that number is 0 the link is certain, and the member nearest to the hub has
it too. Otherwise x and y must share one of the rarest elements of D and E, as many of each as can lie outside
an overlap of that size (fewer for the member nearer to the hub), and at the first that they share enough of both must
follow; members of one component need no link among themselves. What is left is confirmed on full sets.
Elements that many odd members share are met as stars around their least holder first, and pair by pair only between
components that this leaves apart.

Chances of missing a pair: at the threshold of 0.85 it meets in no tree at depth 3 with (1 - 0.85**3)**12 =
0.00001, at 0.8 with 0.0002; in nodes that stay small on the way less. Nothing else loses a link.

Nulls: a null text has an empty set and is linked with nothing; a row with a null doc_id is
linked with nothing and kept. Rows that repeat a doc_id are one document: they share their links.
Ties of hubs go to the smaller id. Very long texts are hashed one by one (``small_batches`` bounds what a
worker holds). An empty table gives no rows. Other columns are ignored, and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import small_batches, stage_table
from lumenrank.llm.components import components
from lumenrank.llm.words import gram_hashes, mix, text_runs, word_hashes

TREES, DEPTH, SHINGLE = 12, 3, 5

#: A node of so many members is not branched on.
SMALL = 4

#: Members beside a hub that meet in one task. Hubs with more, or with more shingles, are cut into lanes of so many.
LANE, LANE_SHINGLES = 64, 4_000_000

_U = np.uint64


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text has its whole word sequence as one shingle."""
    for first, last, data, bounds in text_runs(column):
        words, cuts = word_hashes(data, bounds, lower=True)
        grams = gram_hashes(words, size)
        for i in range(last - first):
            a, b = int(cuts[i]), int(cuts[i + 1])
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield gram_hashes(words[a:b], b - a) ^ _U(b - a)
            else:
                yield np.zeros(0, dtype=_U)


def _paths(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """Nodes of each set, trees x DEPTH: hashes of the shingles chosen so far."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), trees, DEPTH), dtype=_U)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([sets[i] for i in some])
    starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
    for tree in range(trees):
        path = np.full(len(some), tree + 1, dtype=_U)
        for depth in range(DEPTH):
            seed = mix(path * _U(0x9E3779B97F4A7C15) + _U(depth + 1))
            # mixing by an odd factor and a shift: the order it gives depends on the path
            x = (flat ^ np.repeat(seed, sizes[some])) * _U(0xD1342543DE82EF95)
            x ^= x >> _U(29)
            x *= _U(0xAF251AF3B0F025B5)
            path = mix(path + np.minimum.reduceat(x, starts))
            out[some, tree, depth] = path
    return out


_SIGNED = "doc_id long, n long, s1 long, s2 long, paths array<long>"


def _signatures(trees: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sets = list(shingle_sets(batch.column("text")))
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2) if sets else np.zeros((0, 2), np.int64)
            paths = _paths(sets, trees).view(np.int64).ravel()
            ends = np.arange(0, len(paths) + 1, trees * DEPTH, dtype=np.int32)
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.ListArray.from_arrays(ends, pa.array(paths))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "paths"])

    return run


def _packed_sets(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v (the first half of the set's hash) and shingles of each text."""
    for batch in found:
        packed = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        keys = [int.from_bytes(xxhash.xxh3_128_digest(s)[:8], "little", signed=True) for s in packed]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["v", "shingles"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


_COMPARED = "a long, b long, n_a long, n_b long, shared long, linked boolean, size long, tokens array<long>"


def _compare(percent: int, members: bool):
    """Rows a, lane, b, n_b, size, whole, shingles, sorted by a and lane, the hub (b = a) first, to compared pairs.

    Each member is compared with its hub; of a hub that is cut into lanes (not whole) the elements that set the member
    off are given too. The members of a whole hub are compared among themselves, but for those that are joined already
    and those that sizes and differences keep apart; their links are given (members: whether to do so).
    """

    def linked(n: int, m: int, shared: int) -> bool:
        return 100 * shared >= percent * (n + m - shared)

    def settle(hub: int, rows: list) -> Iterator[tuple]:
        (n_hub, own), rows = (rows[0][1], rows[0][4]), rows[1:]
        kept, root = [], []
        for b, n, size, whole, shingles in rows:
            shared = _shared(own, shingles)
            joined = linked(n_hub, n, shared)
            yield hub, b, n_hub, n, shared, joined, size, None if whole else np.setxor1d(own, shingles, assume_unique=True).view(np.int64)
            if whole and members:
                kept.append((n_hub + n - 2 * shared, n, b, shingles))
                root.append(-1 if joined else len(root))
        # the odd ones with all others: differences from the hub bound the difference of two
        for i, (d, n, b, x) in enumerate(kept):
            for j in range(i):
                e, m, c, y = kept[j]
                if root[i] != root[j] and (100 + percent) * abs(d - e) <= (100 - percent) * (n + m) and 100 * min(n, m) >= percent * max(n, m):
                    shared = _shared(x, y)
                    if linked(n, m, shared):
                        yield b, c, n, m, shared, True, 0, None
                        old, new = max(root[i], root[j]), min(root[i], root[j])
                        root[:] = [new if r == old else r for r in root]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _COMPARED.split(", ")])

        for batch in found:
            for hub, lane, b, n, size, whole, shingles in zip(*(batch.column(c).to_pylist() for c in ("a", "lane", "b", "n_b", "size", "whole", "shingles")), strict=True):
                if (hub, lane) != key:
                    out += settle(key[0], held) if key else ()
                    key, held = (hub, lane), []
                held.append((b, n, size, whole, np.frombuffer(shingles, dtype=_U)))
            yield told()
            out = []
        if key:
            out += settle(key[0], held)
            yield told()

    return run


def _repeated(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub, size, token, k: elements that several members of a hub have, counted within each batch (once there: left out)."""
    for batch in found:
        tokens = batch.column("tokens")
        row = np.repeat(np.arange(batch.num_rows), np.diff(tokens.offsets.to_numpy()))
        own, hub = tokens.flatten().to_numpy(), batch.column("hub").to_numpy()[row]
        order = np.lexsort((own, hub))
        own, hub, row = own[order], hub[order], row[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (hub[1:] != hub[:-1])
        first = np.flatnonzero(new)
        k = np.diff(np.append(first, len(own)))
        first, k = first[k > 1], k[k > 1]
        size = batch.column("size").to_numpy()[row[first]]
        yield pa.RecordBatch.from_arrays([pa.array(hub[first]), pa.array(size), pa.array(own[first]), pa.array(k)], names=["hub", "size", "token", "k"])


_PREFIXES = "hub long, token long, rep long, n long, d long, e long, component long, odd boolean, low boolean, left long"


def _prefixes(percent: int):
    """The rarest elements of each member's difference from its hub: as many as can lie outside a link's overlap.

    low: those that are enough where the partner's e is as large or larger. left: elements from this one on, which bound
    the overlap of a pair whose first common element it is.
    """
    unit = 2 * (100 + percent)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = {name: [] for name in ("at", "token", "low", "left")}
            d, e, least = (batch.column(c).to_numpy() for c in ("d", "e", "least"))
            for i, (tokens, often) in enumerate(zip(batch.column("tokens"), batch.column("often"), strict=True)):
                own = tokens.values.to_numpy()
                common = often.values.to_numpy() if often.is_valid else own[:0]
                # rare ones by their hash, then common ones by their number
                place = np.zeros(len(own), dtype=np.int64)
                if len(common):
                    by = np.argsort(common, kind="stable")
                    at = np.minimum(np.searchsorted(common[by], own), len(common) - 1)
                    place = np.where(common[by][at] == own, by[at] + 1, 0)
                own = own[np.lexsort((own, place))]
                # the overlap with a partner whose e is at least this
                low, high = (max(0, int(d[i]) - max(1, -(-(int(e[i]) + other) // unit)) + 1) for other in (int(e[i]), min(int(e[i]), int(least[i]))))
                out["at"].append(np.full(high, i))
                out["token"].append(own[:high])
                out["low"].append(np.arange(high) < low)
                out["left"].append(int(d[i]) - np.arange(high))
            at, token, low, left = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out.values())
            kept = batch.select(["hub", "rep", "n", "d", "e", "component", "odd"]).take(pa.array(at.astype(np.int64)))
            columns = dict(zip(kept.schema.names, kept.columns, strict=True)) | {"token": pa.array(token.astype(np.int64)), "low": pa.array(low.astype(bool)), "left": pa.array(left.astype(np.int64))}
            yield pa.RecordBatch.from_pydict({name.split()[0]: columns[name.split()[0]] for name in _PREFIXES.split(", ")})

    return run


class _Join:
    """One similarity join: links and components accumulate."""

    def __init__(self, docs: DataFrame, percent: int, trees: int):
        small_batches(docs.sparkSession)
        self.percent, self.trees = percent, trees
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
        self.signed = stage_table(self.docs.mapInArrow(_signatures(trees), _SIGNED), "signatures")
        # one vertex for equal sets; empty sets stay out
        classes = self.signed.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("paths").alias("paths"))
        self.classes = stage_table(classes.withColumnRenamed("s1", "v"), "classes")
        self.sets: DataFrame | None = None
        # whether rows repeat an id, so that a set can come more than once
        self.repeats = not self.signed.groupBy("doc_id").count().filter("count > 1").isEmpty()

    def same_sets(self) -> DataFrame:
        own = self.signed.filter("n > 0").select("s1", "s2", "doc_id")
        reps = self.classes.select(F.col("v").alias("s1"), "s2", "rep")
        return own.join(reps, ["s1", "s2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    def nodes(self) -> DataFrame:
        """node, v, n, members of the nodes that are compared: small ones as they arise, all at the last depth."""
        each = [F.struct(*[F.col("paths")[tree * DEPTH + k].alias(f"node_{k}") for k in range(DEPTH)]) for tree in range(self.trees)]
        open_, done = self.classes.select("v", "n", F.explode(F.array(*each)).alias("x")).select("v", "n", "x.*"), None
        for k in range(DEPTH):
            here = F.col(f"node_{k}")
            shared = open_.groupBy(here).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
            placed = stage_table(open_.join(shared, f"node_{k}"), f"nodes-{k}")
            settled = placed if k == DEPTH - 1 else placed.filter(F.col("members") <= SMALL)
            settled = settled.select(here.alias("node"), "v", "n", "members")
            done = settled if done is None else done.unionByName(settled)
            open_ = placed.filter(F.col("members") > SMALL).drop("members", f"node_{k}")
        return done

    def compared(self, pairs: DataFrame, name: str, members: bool) -> DataFrame:
        """Distinct pairs (a, b, n_a, n_b) compared on their full sets, as a table (see _compare).

        A hub's set goes once to each of its lanes, a member's once to each of its hubs.
        """
        pairs = stage_table(pairs.select("a", "b", "n_a", "n_b").distinct(), f"{name}-pairs")
        sizes = pairs.groupBy("a", "n_a").agg(F.count(F.lit(1)).alias("size"), F.sum("n_b").alias("held"))
        lanes = F.greatest(F.ceil(F.col("size") / LANE), F.ceil(F.col("held") / LANE_SHINGLES))
        dealt = pairs.join(sizes.select("a", "size", lanes.alias("lanes")), "a").withColumn("lane", F.pmod(F.xxhash64("b"), F.col("lanes"))).withColumn("whole", F.col("lanes") == 1)
        columns = ("a", "lane", "b", "n_b", "size", "whole")
        heads = dealt.select("a", "lane", F.col("a").alias("b"), F.col("n_a").alias("n_b"), "size", "whole").distinct()
        rows = dealt.select(*columns).unionByName(heads.select(*columns)).join(self.sets.withColumnRenamed("v", "b"), "b")
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "a", "lane").sortWithinPartitions("a", "lane", F.col("b") != F.col("a"), "b")
        return stage_table(rows.mapInArrow(_compare(self.percent, members), _COMPARED), name)

    def beside_hubs(self, judged: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members of hubs beside which several components lie, certain links among them).

        Members: hub, rep, n, d (shingles that set it off from the hub), e, component, odd (not in the hub's main
        component), least (what the e of a partner is at least), size (members), tokens. Hubs that are one lane are settled
        already and left out. Two members x, y of one hub are linked
        where 2 (100 + percent) |D & E| >= e of x + e of y.
        """
        p = self.percent
        rows = judged.filter("tokens IS NOT NULL").select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.col("n_b").alias("n"), F.col("n_a").alias("n_hub"), (F.col("n_a") + F.col("n_b") - 2 * F.col("shared")).alias("d"), "tokens")
        rows = rows.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        rows = rows.withColumn("e", (100 + p) * F.col("d") - (100 - p) * F.col("n"))
        parts = stage_table(rows.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("k"), F.min("e").alias("e")), "parts")
        mains = parts.groupBy("hub").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.min("e").alias("least_all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
        odd_least = F.min(F.when(F.col("component") != F.col("main"), F.col("e")))
        bounds = parts.join(mains, "hub").groupBy("hub", "main", "size", "least_all").agg(odd_least.alias("least_odd"))
        # by sizes alone, d is at least the difference from the hub; by the triangle inequality, partners differ from it about alike
        small, large = F.ceil(F.lit(p) * F.col("n") / 100), F.floor(F.lit(100) * F.col("n") / p)
        by_size = F.when(small > F.col("n_hub"), 2 * p * small - (100 + p) * F.col("n_hub")).when(large < F.col("n_hub"), (100 + p) * F.col("n_hub") - 200 * large).otherwise(-(100 - p) * F.col("n_hub"))
        odd = F.col("component") != F.col("main")
        least = F.greatest(by_size, F.col("e") - 2 * (100 - p) * large, F.when(odd, F.col("least_all")).otherwise(F.col("least_odd")))
        rows = rows.join(bounds, "hub").withColumn("odd", odd).withColumn("least", least)
        rows = stage_table(rows.select("hub", "rep", "n", "d", "e", "component", "odd", "least", "size", "tokens"), "beside")
        nearest = rows.groupBy("hub").agg(F.min(F.struct("e", "rep", "component")).alias("y"))
        sure = rows.join(nearest, "hub").filter((F.col("e") + F.col("y.e") <= 0) & (F.col("rep") != F.col("y.rep")) & (F.col("component") != F.col("y.component")))
        return rows, sure.select(F.col("y.rep").alias("a"), F.col("rep").alias("b"))

    def prefixes(self, rows: DataFrame) -> DataFrame:
        """Elements by which members of a hub may find each other, as a table."""
        # common elements come last: those that more than the root of the members have, at most root x mean |D| of a hub.
        # Any one order serves, so those that no batch has twice need not be counted
        often = rows.select("hub", "size", "tokens").mapInArrow(_repeated, "hub long, size long, token long, k long")
        often = often.groupBy("hub", "size", "token").agg(F.sum("k").alias("k")).filter("k > 2 AND k * k > size")
        often = often.groupBy("hub").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]).alias("often"))
        found = rows.withColumn("lane", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / LANE)))
        heads = found.select("hub", "lane").distinct().join(often, "hub")
        return stage_table(found.join(heads, ["hub", "lane"], "left").mapInArrow(_prefixes(self.percent), _PREFIXES), "prefixes")

    def possible(self) -> Column:
        """Whether x and y, of different components, may be linked: by their sizes and differences."""
        unit = 2 * (100 + self.percent)
        return (F.col("c_x") != F.col("c_y")) & (F.col("e_x") + F.col("e_y") <= unit * F.least("d_x", "d_y")) & (100 * F.least("n_x", "n_y") >= self.percent * F.greatest("n_x", "n_y"))

    def candidates(self, tokens: DataFrame) -> DataFrame:
        """a, b, n_a, n_b of members of different components that share an element that they may find each other by.

        x is the one with the larger e. Members of the main component need not meet each other.
        """

        def side(s: str) -> DataFrame:
            return tokens.select("hub", "token", "low", "odd", *[F.col(c).alias(f"{k}_{s}") for k, c in zip("rndecl", ("rep", "n", "d", "e", "component", "left"), strict=True)])

        x, low = side("x"), side("y").filter("low").withColumnsRenamed({"hub": "h", "token": "t"})
        above = (F.col("e_x") > F.col("e_y")) | (F.col("e_x") == F.col("e_y")) & (F.col("r_x") > F.col("r_y"))
        # a linked pair meets this bound at its first common element
        reach = F.col("e_x") + F.col("e_y") <= 2 * (100 + self.percent) * F.least("l_x", "l_y")
        met = (F.col("hub") == F.col("h")) & (F.col("token") == F.col("t")) & above & reach & self.possible()
        found = [_ordered(x.filter(a).drop("low", "odd").join(low.filter(b).drop("low", "odd"), met)) for a, b in (("odd", "true"), ("NOT odd", "odd"))]
        return found[0].unionByName(found[1])

    def stars(self, tokens: DataFrame) -> DataFrame:
        """Of each element, pairs of its least odd holder with the other odd ones: as many as there are holders."""
        mine = tokens.filter("odd").select("hub", "token", F.col("rep").alias("r_y"), *[F.col(c).alias(f"{k}_y") for k, c in zip("ndec", ("n", "d", "e", "component"), strict=True)])
        first = mine.groupBy("hub", "token").agg(F.min(F.struct("r_y", "n_y", "d_y", "e_y", "c_y")).alias("x"))
        met = mine.join(first, ["hub", "token"]).select("*", *[F.col(f"x.{k}_y").alias(f"{k}_x") for k in "rndec"]).filter(F.col("r_x") != F.col("r_y")).filter(self.possible())
        return _ordered(met)

    def run(self) -> DataFrame:
        """doc_id (distinct), n_shingles, component."""
        members = self.nodes()
        # texts are shuffled once, to get the sets of documents that share a node
        ids = members.select("v").distinct().join(self.classes.select("v", F.col("rep").alias("doc_id")), "v").select("doc_id").distinct()
        sets = self.docs.join(ids, "doc_id", "left_semi").mapInArrow(_packed_sets, "v long, shingles binary")
        self.sets = stage_table(sets.dropDuplicates(["v"]) if self.repeats else sets, "sets")
        # the hub of a node: whoever meets most others over all trees
        met = members.groupBy("v").agg(F.sum("members").alias("met"))
        placed = stage_table(members.join(met, "v"), "placed")
        hubs = placed.groupBy("node").agg(F.max(F.struct("met", -F.col("v"), "v", "n")).alias("hub"))
        around = placed.join(hubs, "node").filter("v <> hub.v")
        judged = self.compared(around.select(F.col("hub.v").alias("a"), F.col("v").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b")), "hubs", members=True)
        found = judged.filter("linked").select("a", "b")
        if not judged.filter("tokens IS NOT NULL").isEmpty():
            rows, sure = self.beside_hubs(judged, components(found))
            starred = self.compared(self.stars(self.prefixes(rows)), "stars", members=False).filter("linked").select("a", "b")
            found = found.unionByName(sure).unionByName(starred)
            # members by what the stars have joined; hubs beside which one component is left are done
            labels = components(found).withColumnRenamed("v", "rep")
            rows = rows.drop("component").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            mixed = rows.groupBy("hub").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed").select("hub")
            tokens = self.prefixes(stage_table(rows.join(mixed, "hub", "left_semi"), "beside"))
            found = found.unionByName(self.compared(self.candidates(tokens), "links", members=False).filter("linked").select("a", "b"))
        # back to documents: rows that repeat an id join its sets
        reps = self.classes.select("v", "rep")
        links = found.join(reps.withColumnsRenamed({"v": "a", "rep": "x"}), "a").join(reps.withColumnsRenamed({"v": "b", "rep": "y"}), "b")
        labels = components(self.same_sets().unionByName(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        sizes = self.signed.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
        return sizes.join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _ordered(met: DataFrame) -> DataFrame:
    """a, b, n_a, n_b with a < b, of pairs r_x, r_y."""
    first = F.col("r_x") < F.col("r_y")
    columns = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in (("a", "r_x", "r_y"), ("b", "r_y", "r_x"), ("n_a", "n_x", "n_y"), ("n_b", "n_y", "n_x"))]
    return met.select(*columns).distinct()


def near_duplicate_classes(docs: DataFrame, percent: int = 85, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each distinct doc_id, and one for each null."""
    found = _Join(docs, percent, trees).run()
    named = found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    nulls = docs.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(_signatures(1), _SIGNED)
    return named.unionByName(nulls.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def keep_one_of_each(docs: DataFrame, percent: int = 85, trees: int = TREES) -> DataFrame:
    """docs without the documents whose component has a smaller id; columns as they are."""
    lost = near_duplicate_classes(docs, percent, trees).filter("NOT kept").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
