"""Each text operator against a brute-force version: odd cases, and the small tables."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.llm.common import documents
from lumenrank.llm.components import components
from lumenrank.llm.line_dedup import keep_first_lines, line_dedup_digest
from lumenrank.llm.mixing import mix_hash, mix_sources, take_mix
from lumenrank.llm.near_dup import keep_one_of_each, near_duplicate_classes
from lumenrank.llm.substring import repeats_digest
from lumenrank.llm.suffix_automaton import SuffixAutomaton, remove_reference_spans
from lumenrank.llm.syncmers import K, S, _smers, anchors, compare_with_edits, likeness, match_positions, sketch
from lumenrank.llm.words import gram_hashes, mix, text_runs, word_hashes

SF = "/root/testdata/sf0.001"
LAST = 1 << 70
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
small = lambda spark: documents(spark, SF)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(row):
    return repr(row)


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_line_dedup(spark, odd, none, which):
    df = {"odd": odd, "none": none}.get(which) or small(spark)
    first = {}
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    rows = rows_of(df)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = strip(line)
            first[k] = min(first.get(k, LAST), LAST - 1 if d is None else d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(strip(x)) < 10 or first[strip(x)] == (LAST - 1 if d is None else d)]
        want.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert sorted(map(tuple, line_dedup_digest(df).collect()), key=key) == sorted(want, key=key)
    assert keep_first_lines(df).columns == df.columns


CLASHING = ("_doc", "_tag", "_dropped", "doc", "tag", "dropped", "n_lines", "n_dropped", "N_lines_", "_source", "_whole", "_threshold", "whole", "threshold", "h", "_h", "times", "_times", "copy", "_copy", "row", "target", "source_size")


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as anything inside the operators come back as they were."""
    text = "the same long line\nand one of its own"
    rows = [(d, f"{text} {d}", f"s{d % 2}", *[f"{c}{d}" for c in CLASHING]) for d in range(6)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASHING])
    for stage in (keep_first_lines, take_mix, keep_one_of_each):
        got = stage(df)
        assert got.columns == df.columns
        own = {tuple(r)[3:] for r in got.collect()}
        assert own and own <= {r[3:] for r in rows}, stage
    assert {r.text for r in keep_first_lines(df).collect()} == {f"{text} 0", *(f"and one of its own {d}" for d in range(1, 6))}


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_substring_dedup(spark, odd, none, which):
    df = {"odd": odd, "none": none}.get(which) or small(spark)
    rows = [(d, WORD.findall(t or "")) for d, t in rows_of(df)]
    at, first = lambda d, i: (LAST if d is None else d, i), {}
    for d, w in rows:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (LAST + 1, 0)), at(d, i))
    want = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < at(d, i):
                gone[i : i + 20] = [True] * 20
        want.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    assert sorted(map(tuple, repeats_digest(df).collect()), key=key) == sorted(want, key=key)


def test_substring_dedup_of_random_words(spark):
    """Few words and many repeats, so windows overlap, nest and repeat within a document."""
    rng = random.Random(4)
    blocks = [[rng.choice("abc") for _ in range(rng.randint(15, 40))] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 4)) for w in rng.choice(blocks))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, want = {}, []
    for d, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (d, i)) != (d, i):
                gone[i : i + 20] = [True] * 20
        want.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    assert sorted(map(tuple, repeats_digest(df).collect())) == want


def exact_components(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [(d, s) for d, ss in sets.items() for s in ss if s and d is not None]
    for k, (a, x) in enumerate(ids):
        for b, y in ids[:k]:
            if a != b and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {d: (max(map(len, ss)), root(d)) for d, ss in sets.items() if d is not None}


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_near_duplicates(spark, odd, none, which):
    df = {"odd": odd, "none": none}.get(which) or small(spark)
    got = near_duplicate_classes(df).collect()
    want = exact_components(rows_of(df))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert sum(r.doc_id is None for r in got) == sum(d is None for d, _ in rows_of(df))


def test_near_duplicates_of_edited_copies(spark):
    """A group of copies with edits of their own, chains, and documents that share a passage only."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(60):
        w = list(base)
        w[rng.randrange(10, 110)] = f"e{d}"
        rows.append((d, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for d in range(60, 70):
        chain[10 * (d - 59)] = f"n{d}"
        rows.append((d, " ".join(chain)))
    rows += [(d, " ".join(passage + [f"own{d}_{i}" for i in range(40)])) for d in range(70, 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_classes(df).collect()}
    assert got == exact_components(rows)
    assert keep_one_of_each(df).count() == len({c for _, c in got.values()})


def test_near_duplicates_beside_the_hub(spark):
    """Copies of a hub, a longer near copy, and one that is too long for the hub and linked with that near copy only."""
    rng, rows = random.Random(3), []
    for g in range(6):
        hub = [f"h{g}_{i}" for i in range(1004)]
        for d in range(100 * g, 100 * g + 12):
            w = list(hub)
            w[rng.randrange(10, 990)] = f"e{d}"
            rows.append((d, " ".join(w)))
        longer = hub + [f"y{g}_{i}" for i in range(10)]
        rows += [(100 * g + 20, " ".join(hub)), (100 * g + 21, " ".join(longer)), (100 * g + 22, " ".join(longer + [f"x{g}_{i}" for i in range(167)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_classes(df).collect()}
    want = exact_components(rows)
    assert {want[100 * g + 22] for g in range(6)} == {(1177, 100 * g) for g in range(6)}
    assert got == want


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_of_copies_of_copies(spark, percent):
    """Edits pile up from copy to copy, so families lie just within and just beyond the threshold of a common hub."""
    rng, rows = random.Random(percent), []
    for g in range(3):
        texts = [[f"t{g}_{rng.randrange(90)}" for _ in range(rng.choice((60, 150, 400)))]]
        for _ in range(90):
            w = list(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w))
                if rng.random() < 0.2:
                    w[at : at + 12] = []
                else:
                    w[at] = f"t{g}_{rng.randrange(90)}" if rng.random() < 0.7 else f"edit{rng.randrange(4)}"
            texts.append(w)
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_classes(df, percent=percent).collect()}
    want = exact_components(rows, percent)
    assert got == want and len({c for _, c in want.values()}) > 10


def test_near_dedup_stage_takes_out_copies_from_80_percent_on(spark):
    """Pairs of similarity 0.82 (490 of 600 shingles) lose one document, pairs of 0.78 (490 of 628) none."""
    from corpus_pipeline import near_dedup

    rows = []
    for g in range(8):
        base = [f"b{g}_{i}" for i in range(494)]
        for d, own in enumerate((0, 110 if g < 4 else 138)):
            rows.append((2 * g + d, " ".join(base + [f"o{g}_{i}" for i in range(own)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(spark, df, "").collect()) == [0, 2, 4, 6, *range(8, 16)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40, 90)] + [(1, 5), (9, 5), (9, 12), (3, 4), (4, 3)]
    got = {r.v: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 40 for i in range(40, 91)}, 1: 1, 5: 1, 9: 1, 12: 1, 3: 3, 4: 3}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def plain_sketch(text):
    """{hash: first place} of the 64 least closed syncmers, k-mer by k-mer, from the hashes of single s-mers."""
    mask = (1 << 64) - 1

    def mixed(x):
        return int(mix(np.array([x & mask], dtype=np.uint64))[0]) >> 32

    if len(text) < K:
        total = len(text)
        for c in text:
            total = total * 0x9E3779B97F4A7C15 + ord(c) & mask
        return {mixed(total): 0} if text else {}
    smer = lambda i: int(_smers(np.array([ord(c) for c in text[i : i + S]], dtype=np.uint64))[0])
    hashes, found = [smer(i) for i in range(len(text) - S + 1)], {}
    for i in range(len(text) - K + 1):
        inner = hashes[i : i + K - S + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(mixed(inner[0] * 3 + inner[(K - S) // 2] * 0xC2B2AE3D27D4EB4F + inner[-1] * 0x9E3779B97F4A7C15), i)
    return dict(sorted(found.items())[:64])


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    union = sorted({*a, *b})[:64]
    places = [(a[h], b[h]) for h in union if h in a and h in b]
    best = {}
    for p in sorted(places):
        best[p] = 1 + max((n for q, n in best.items() if q[0] < p[0] and q[1] < p[1]), default=0)
    return max(best.values(), default=0) / len(union)


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_fingerprints(spark, odd, none, which):
    df = {"odd": odd, "none": none}.get(which) or small(spark).filter("n_chars < 4000")
    rows = sorted(((d, t or "") for d, t in rows_of(df)), key=lambda r: (-r[0] if r[0] is not None else LAST, r[1]))
    got = Counter(tuple(r) for r in compare_with_edits(df).collect())
    told = lambda x: "".join(f"{h:08x}{i:08x}" for h, i in x.items())
    want, plain = Counter(), {t: plain_sketch(t) for _, t in rows}
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        own, other = plain[t], plain_sketch(e)
        want[d, len(t), sha(e), told(own), told(other), plain_likeness(own, other), plain_likeness(own, plain[n])] += 1
    assert got == want


def test_syncmers_are_context_free():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    at, h = anchors(text)
    moved = anchors("some other words " + text)
    assert set(h.tolist()) <= set(moved[1].tolist())
    assert 0.15 < len(at) / len(text) < 0.3
    pairs = match_positions(text, "some other words " + text)
    assert pairs and all(b - a == len("some other words ") for a, b in pairs)
    words = text.split(" ")
    rng.shuffle(words)
    assert likeness(sketch(text), sketch(" ".join(words))) < 0.2
    a, b = sketch(text), sketch(text[:1500] + "".join(rng.choice("abcdefgh ") for _ in range(1500)))
    assert likeness(a, a) == 1.0 and abs(likeness(a, b) - 1 / 3) < 0.2
    assert likeness(sketch(""), sketch("")) == 1.0 and likeness(sketch(""), a) == 0.0


def test_word_hashes():
    import pyarrow as pa

    texts = ["A b\tc", None, "", " x  A\x0bb ", "é b A", "A"]
    for first, last, data, bounds in text_runs(pa.array(texts)):
        words, cuts = word_hashes(data, bounds)
        plain = [w for t in texts[first:last] for w in WORD.findall(t or "")]
        assert len(words) == len(plain) and np.diff(cuts).tolist() == [len(WORD.findall(t or "")) for t in texts[first:last]]
        by = defaultdict(set)
        for w, h in zip(plain, words):
            by[w].add(int(h))
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
        low, _ = word_hashes(data, bounds, lower=True)
        assert low[0] == word_hashes(np.frombuffer(b"a", np.uint8), np.array([0, 1]))[0][0]
    assert len(gram_hashes(words, 20)) == 0


def test_automaton_against_search(spark):
    rng = random.Random(3)
    reference = [[rng.choice("abcd") for _ in range(50)] for _ in range(4)]
    text = [rng.choice("abcd") for _ in range(80)] + reference[1][5:30] + [rng.choice("abcd") for _ in range(20)]
    automaton = SuffixAutomaton()
    for r in reference:
        automaton.add(r)
    stats = automaton.matching_statistics(text)
    inside = {tuple(r[i:j]) for r in reference for i in range(50) for j in range(i + 1, 51)}
    assert stats == [max(n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in inside) for i in range(len(text))]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, None)], "doc_id long, text string")
    refs = spark.createDataFrame([(" ".join(r),) for r in reference], "text string")
    got = {r.doc_id: r for r in remove_reference_spans(docs, refs, 20).collect()}
    assert got[1].n_removed >= 25 and got[2].n_words == 0


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_mixing(spark, odd, none, which):
    df = {"odd": odd, "none": none}.get(which) or small(spark)
    got = mix_sources(df).collect()
    assert len(got) == df.count()
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    texts = defaultdict(list)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 2 * r.size
        texts[r.doc_id].append(r.size)
    for d, t in rows_of(df):
        assert len(WORD.findall(t or "")) in texts[d]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9}
        if not over:
            want |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(largest[s], 1)
    again = mix_sources(df).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert take_mix(df).columns == df.columns and take_mix(df).count() == sum(r.repeats for r in got)
    assert df.filter((mix_hash(F.col("doc_id")) < 0) | (mix_hash(F.col("doc_id")) >= 1 << 60)).isEmpty()
