"""How the sources of a language differ in their terms, by chunk factorization.

1. Tasks cut texts into chunks at white space and count them for each document. A task works on blocks of documents; a
   block's distinct chunks, each with the places of its documents in the block and its occurrences in each, are dealt to
   buckets by the chunk's hash, and what goes to one bucket is one packed row. A frequent chunk costs an entry a block.
2. A bucket holds all entries of its chunks, so a task that reads it cuts each globally distinct chunk into terms once; the
   terms take the chunk's place in every entry, which goes back to its block. (A chunk with more than ``HOT_PLACES`` places in a
   block is dealt to one of ``HOT_BUCKETS`` buckets by block, and cut once in each.)
3. A document that holds a term through several chunks counts once: places are united within the block, and occurrences and
   documents of a group (lang, source) are summed over blocks, in buckets of terms.

Terms hold no character below U+0041, so no term crosses a chunk. Sources are compared in tiles of ``TILE`` by ``TILE``
sources and parts of about ``PART`` terms; a term that neither source of a pair holds adds the same value each time, so it is
counted, not visited.

Nulls in text, lang and source are ''. Repeated rows (and rows that repeat a doc_id) are documents of their own. Texts may
be of any length; a text is cut in one task. Ties go by the UTF-8 bytes of the item. No documents give no rows; a lang
without kept terms gives its pairs of sources with the value 0. Other columns are ignored. Counts are exact up to 2^63.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import small_batches, stage_table

#: What a term is: letters, and everything above ASCII.
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bounds of a block of documents; a longer text is a block of its own. Places fit in 2 bytes.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 32_768

#: Buckets of chunks for each shuffle partition of the session; a task keeps the terms of one bucket's distinct chunks.
BUCKETS = 8

HOT_PLACES, HOT_BUCKETS = 4_096, 16

#: Rows in one Arrow batch that a task hands over.
BATCH_ROWS = 20_000

#: Sources on a side of a tile, and terms in a part of one, about.
TILE, PART = 256, 4096



_PACKED = "block long, words string, counts binary, places binary, times binary"


def _packed(block: list[int], words: list[str], counts: list[bytes | None], places: list[bytes], times: list[bytes], bucket: list[int] | None = None) -> pa.RecordBatch:
    columns = {"block": pa.array(block, pa.int64()), "words": pa.array(words, pa.string()), "counts": pa.array(counts, pa.binary()), "places": pa.array(places, pa.binary()), "times": pa.array(times, pa.binary())}
    if bucket is not None:
        columns["bucket"] = pa.array(bucket, pa.int32())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _count_block(held: list[pa.RecordBatch], block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of a block's chunks (counts: places of each chunk), and one without counts that names the groups and the
    places where they begin. A place is repeated where its times do not fit in a byte."""
    docs = pa.Table.from_batches(held)
    lang, source = (docs.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    group = np.asarray(lang.indices, dtype=np.int64) * len(source.dictionary) + np.asarray(source.indices)
    order = np.argsort(group, kind="stable")  # places follow the groups
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found, begins = np.unique(group[order], return_index=True)
    at_lang, at_source = np.divmod(found, len(source.dictionary))
    head = json.dumps([lang.dictionary.take(pa.array(at_lang)).to_pylist(), source.dictionary.take(pa.array(at_source)).to_pylist(), begins.tolist()])
    yield _packed([block], [head], [None], [b""], [b""], [block % buckets])

    lists = pc.ascii_split_whitespace(docs.column("text").combine_chunks())
    chunks, parent = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    filled = pc.greater(pc.binary_length(chunks), 0)
    chunks, parent = chunks.filter(filled).dictionary_encode(), parent[np.asarray(filled)]
    if not len(chunks):
        return
    words = chunks.dictionary.to_pylist()
    many = np.bincount(np.asarray(chunks.indices), minlength=len(words)) > HOT_PLACES
    dealt = pd.util.hash_array(np.array(words, dtype=object), categorize=False) + np.where(many, np.uint64(block % HOT_BUCKETS), np.uint64(0))
    dealt = (dealt % np.uint64(buckets)).astype(np.int64)
    sort = np.argsort(dealt, kind="stable")
    rank = np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))
    keys, times = np.unique(rank[np.asarray(chunks.indices)] << 16 | place[parent], return_counts=True)
    copies = -(-times // 255)
    last = np.cumsum(copies) - 1
    keys, left = np.repeat(keys, copies), np.full(last[-1] + 1, 255)
    left[last] = times - (copies - 1) * 255
    code = keys >> 16
    counts = np.bincount(code, minlength=len(words)).astype("<u4")
    places, times = (keys & 65535).astype("<u2"), left.astype("u1")
    upto = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    dealt = dealt[sort]
    words = [words[k] for k in sort]
    edges = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1], True])
    for a in range(0, len(edges) - 1, 256):
        some = list(zip(edges[a : a + 256], edges[a + 1 : a + 257], strict=False))
        yield _packed([block] * len(some), ["\n".join(words[i:j]) for i, j in some], [counts[i:j].tobytes() for i, j in some], [places[upto[i] : upto[j]].tobytes() for i, j in some], [times[upto[i] : upto[j]].tobytes() for i, j in some], [int(dealt[i]) for i, _ in some])


def chunk_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows of the texts of docs (lang, source, text without nulls), with their buckets."""
    small_batches(docs.sparkSession)

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, small = TaskContext.get().partitionId() << 32, [], 0, 512
        for batch in found:
            for a in range(0, len(batch), small):
                held.append(batch.slice(a, small))
                size += held[-1].nbytes
                if size >= BLOCK_BYTES or sum(map(len, held)) + small > BLOCK_ROWS:
                    yield from _count_block(held, block, buckets)
                    block, held, size = block + 1, [], 0
        if sum(map(len, held)):
            yield from _count_block(held, block, buckets)

    return docs.select("lang", "source", "text").mapInArrow(cut, f"{_PACKED}, bucket int")


_TERM, _LOWER = re.compile(TERM_PATTERN), str.maketrans(UPPER, LOWER)


def _cut_chunks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows with terms in place of chunks, of rows that come bucket by bucket."""
    bucket, known = None, {}
    for batch in found:
        out = []
        for block, words, counts, places, times, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if counts is None:
                out.append((block, words, None, b"", b""))
                continue
            if own != bucket:
                bucket, known = own, {}
            words = words.split("\n")
            for w in words:
                if w not in known:
                    known[w] = [t.translate(_LOWER) for t in _TERM.findall(w)]
            terms = [known[w] for w in words]
            counts, places, times = np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(places, "<u2"), np.frombuffer(times, "u1")
            n = np.fromiter(map(len, terms), np.int64, len(terms))
            if (n != 1).any():
                # a term that a chunk holds several times stands there as often
                which = np.repeat(np.arange(len(n)), n)
                starts, counts = (np.cumsum(counts) - counts)[which], counts[which]
                take = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                places, times = places[take], times[take]
            if len(counts):
                out.append((block, "\n".join(t for each in terms for t in each), counts.astype("<u4").tobytes(), places.tobytes(), times.tobytes()))
        if out:
            yield _packed(*map(list, zip(*out, strict=True)))


_SUMMED = "bucket int, head string, words string, counts binary, groups binary, n binary, docs binary"


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values))


def _merge_block(found: pa.Table, buckets: int) -> pa.Table:
    """Packed rows (occurrences and documents of each term and group) of the packed rows of one block, by the term's bucket."""
    plain = pc.is_valid(found["counts"])
    langs, sources, begins = json.loads(found.filter(pc.invert(plain))["words"][0].as_py())
    rows = found.filter(plain)
    words = "\n".join(rows["words"].to_pylist())
    terms = pa.array(words.split("\n") if words else [], pa.string()).dictionary_encode()
    counts, place, n = (np.frombuffer(b"".join(rows[c].to_pylist()), k).astype(np.int64) for c, k in (("counts", "<u4"), ("places", "<u2"), ("times", "u1")))
    words = terms.dictionary.to_pylist()
    dealt = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int64) if words else np.zeros(0, np.int64)
    sort = np.argsort(dealt, kind="stable")
    rank = np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))
    # an entry for each document and term, then one for each group and term
    key, n = _summed(np.repeat(rank[np.asarray(terms.indices)], counts) << 16 | place, n)
    key = key >> 16 << 16 | np.searchsorted(begins, key & 65535, side="right") - 1
    key, n, docs = _summed(key, n, np.ones(len(key), np.int64))
    counts = np.bincount(key >> 16, minlength=len(words)).astype("<u4")
    upto = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    dealt, words = dealt[sort], [words[k] for k in sort]
    edges = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1], True]) if words else np.zeros(1, int)
    some = list(zip(edges[:-1], edges[1:], strict=True))
    cells = lambda v, kind: pa.array([v[upto[i] : upto[j]].astype(kind).tobytes() for i, j in some], pa.binary())
    head = json.dumps([langs, sources])
    return pa.table({
        "bucket": pa.array([int(dealt[i]) for i, _ in some], pa.int32()), "head": pa.array([head] * len(some), pa.string()), "words": pa.array(["\n".join(words[i:j]) for i, j in some], pa.string()),
        "counts": pa.array([counts[i:j].tobytes() for i, j in some], pa.binary()), "groups": cells(key & 65535, "<u2"), "n": cells(n, "<u8"), "docs": cells(docs, "<u4"),
    })


#: Sums that a task holds before it adds up those of equal terms and groups.
HELD_SUMS = 1 << 21


def _kept_terms(found: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, lang_n, first (of its lang and term) of terms in enough documents, of rows that come bucket by bucket."""
    bucket, names, words, held = None, {}, {}, []

    def put() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not held:
            return
        key, n, docs = _summed(*map(np.concatenate, zip(*held, strict=True)))
        held = [(key, n, docs)]
        term, group = key >> 32, key & (1 << 32) - 1
        pairs = list(names)
        langs = {x: k for k, x in enumerate(dict.fromkeys(lang for lang, _ in pairs))}
        own = term << 32 | np.array([langs[lang] for lang, _ in pairs], dtype=np.int64)[group]
        both, lang_n, lang_docs = _summed(own, n, docs)
        at = np.searchsorted(both, own)
        kept = np.flatnonzero(lang_docs[at] >= min_docs)
        first = np.zeros(len(key), np.int64)
        first[np.unique(own, return_index=True)[1]] = 1
        all_words, take = pa.array(list(words), pa.string()), lambda values, k: pa.array(values, pa.string()).take(pa.array(k))
        for a in range(0, len(kept), BATCH_ROWS):
            k = kept[a : a + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([take([x for x, _ in pairs], group[k]), take([x for _, x in pairs], group[k]), all_words.take(pa.array(term[k])), pa.array(n[k]), pa.array(lang_n[at[k]]), pa.array(first[k])], names=["lang", "source", "term", "n", "lang_n", "first"])

    for batch in found:
        for own, head, terms, counts, groups, n, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != bucket:
                yield from put()
                bucket, names, words, held = own, {}, {}, []
            local = np.array([names.setdefault((lang, source), len(names)) for lang, source in zip(*json.loads(head), strict=True)], dtype=np.int64)
            code = np.array([words.setdefault(w, len(words)) for w in terms.split("\n")], dtype=np.int64)
            held.append((np.repeat(code, np.frombuffer(counts, "<u4")) << 32 | local[np.frombuffer(groups, "<u2")], np.frombuffer(n, "<u8").astype(np.int64), np.frombuffer(docs, "<u4").astype(np.int64)))
            if sum(len(x[0]) for x in held[1:]) > HELD_SUMS:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
    yield from put()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n (occurrences), lang_n (in the lang), first (1 in one source of a lang and term, else 0) of the terms
    that at least min_docs documents of a lang hold; docs: lang, source, text without nulls."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunk_counts(docs, buckets).repartition("bucket").sortWithinPartitions("bucket")
    each = dealt.mapInArrow(_cut_chunks, _PACKED)
    merged = each.groupBy("block").applyInArrow(lambda found: _merge_block(found, buckets), _SUMMED)
    sums = merged.repartition("bucket").sortWithinPartitions("bucket")
    return sums.mapInArrow(lambda found: _kept_terms(found, min_docs), "lang string, source string, term string, n long, lang_n long, first long")


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (n + 2) / (size + 2 * terms)), in whole numbers."""
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2), (size + 2 * terms).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), in whole numbers (p and q are at most 1,000,000,001)."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile(found: pd.DataFrame, size: int) -> pd.DataFrame:
    """lang, i, j, value, seen, rest of the pairs of sources in one part of a tile: the sum over terms that some source of the
    tile holds, their number, and what each other term adds. Rows without a term tell the share of an absent term."""
    heads = found[found["term"].isna()]
    rows = found[found["term"].notna()]
    codes, _ = pd.factorize(rows["term"])
    seen = int(codes.max()) + 1 if len(codes) else 0
    sides = []
    for tile, own in heads.sort_values("number").groupby("tile"):
        base = own["share"].to_numpy(np.int64)
        dense = np.repeat(base[:, None], seen, axis=1)
        mine = rows["tile"].to_numpy() == tile
        dense[rows["number"].to_numpy()[mine] - tile * size, codes[mine]] = rows["share"].to_numpy()[mine]
        sides.append((int(tile) * size, base, dense))
    (lo, base, left), (lo2, base2, right) = sides[0], sides[-1]
    out = []
    for i in range(len(base)):
        j = np.arange(i + 1 if lo == lo2 else 0, len(base2))
        if len(j):
            p, q, p0, q0 = left[i], right[j], base[i], base2[j]
            out.append(pd.DataFrame({"i": lo + i, "j": lo2 + j, "value": ((p - q) ** 2 // (p + q)).sum(axis=1), "rest": (p0 - q0) ** 2 // (p0 + q0)}))
    got = pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("i", "j", "value", "rest")})
    return got.assign(lang=heads["lang"].iloc[0], seen=seen)[["lang", "i", "j", "value", "seen", "rest"]]


def compare_sources(present: DataFrame, groups: DataFrame, tile: int = TILE, part: int = PART) -> DataFrame:
    """lang, source, item (another source of the lang), value of all pairs of sources.

    present: lang, source, term, n of kept terms; groups: lang, source, size, terms (of its lang), sources (of its lang),
    number (of the source in its lang, from 0).
    tile: sources on a side of a tile; part: terms in a part of one, about.
    """
    groups = groups.withColumn("tiles", F.ceil(F.col("sources") / tile).cast("int"))
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.col("terms"))).otherwise(F.lit(1))
    parts = F.ceil(F.greatest("terms", F.lit(1)) / part).cast("int")
    own = F.floor(F.col("number") / tile).cast("int")
    heads = groups.select("lang", own.alias("tile"), "tiles", F.lit(None).cast("string").alias("term"), "number", base.alias("share"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    each = present.join(groups, ["lang", "source"])
    rows = each.select("lang", own.alias("tile"), "tiles", "term", "number", share(F.col("n"), F.col("size"), F.col("terms")).alias("share"), F.pmod(F.xxhash64("term"), parts).cast("int").alias("part"))
    # a tile's row goes to each pair of tiles that it is part of
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    sent = heads.unionByName(rows).select("*", other).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    sums = sent.groupBy("lang", "a", "b", "part").applyInPandas(lambda found: _tile(found, tile), "lang string, i int, j int, value long, seen long, rest long")
    pairs = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"))
    both = pairs.select("lang", "value", "seen", "rest", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")).select("lang", "value", "seen", "rest", "x.*")
    named = lambda k, name: groups.select("lang", F.col("number").alias(k), F.col("source").alias(name))
    got = both.join(groups.select("lang", F.col("number").alias("i"), "source", "terms"), ["lang", "i"]).join(named("j", "item"), ["lang", "j"])
    return got.select("lang", "source", "item", (F.col("value") + F.when(F.col("terms") > 0, (F.col("terms") - F.col("seen")) * F.col("rest")).otherwise(0)).alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, tile: int = TILE, part: int = PART) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other of its lang (part pair), and the
    terms that set it most apart from its lang (part term)."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    present = stage_table(kept_terms(plain, min_docs), "terms")
    langs = present.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_size"))
    sizes = present.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    all_groups = plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    numbered = all_groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    groups = stage_table(numbered.withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups")

    pairs = compare_sources(present.select("lang", "source", "term", "n"), groups, tile, part).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = present.join(groups.select("lang", "source", "size", "terms", "lang_size"), ["lang", "source"])
    own = own.withColumns({"p": share(F.col("n"), F.col("size"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_size"), F.col("terms"))})
    apart = own.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", order).unionByName(apart.withColumn("rank", order).filter(F.col("rank") <= top))
