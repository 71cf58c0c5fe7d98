"""Quality, neighbours, personal data, token files, packing and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenrank.llm import ann, pii, registry
from lumenrank.llm.ann import nearest
from lumenrank.llm.common import documents
from lumenrank.llm.packing import pack_documents, place_pieces, sweep
from lumenrank.llm import quality_crf
from lumenrank.llm.quality_crf import Model, keep_good, line_features, line_measures, marginals, score_documents, train
from lumenrank.llm.token_store import EliasFano, Shard, encode_shard, token_files, write_token_files
from lumenrank.llm.tokens import encoder, vocabulary

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def pick(spark, odd, none, which):
    return {"odd": odd, "none": none}[which] if which != "small" else documents(spark, SF)


# --- tokens


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_ids_equal_the_library(kind, name):
    import random

    library, own = Tokenizer.from_file(vocabulary(name)), encoder(kind, vocabulary(name))
    rng = random.Random(2)
    parts = ["a", "b", "Word", "é", "ß", "Σ", "ς", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "23", ".", ",", "...", "!", "é", "́", "İ", "漢", "　", "\x85", "\xa0", "\x1c", "<|endoftext|>", "\r\n", "K", "ª", "<|", "\U0001f600"]
    letters = [" ".join("".join(rng.choice("abehnotyéßñªºµçABÉ") for _ in range(rng.randint(1, 12))) for _ in range(6)) for _ in range(300)]
    for text in letters + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(4000)]:
        assert own.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_elias_fano_and_shards():
    rng = np.random.default_rng(0)
    for lengths in ([], [0], [5], [0, 0, 7, 0], rng.integers(0, 900, 2000).tolist(), [1] * 700, [10**7, 3] + [2] * 600 + [10**6] * 3):
        bounds = np.concatenate(([0], np.cumsum(np.array(lengths, dtype=np.int64))))
        ef, _ = EliasFano.decoded(b"xy" + EliasFano.of(bounds).encoded(), 2)
        assert np.concatenate(list(ef.runs())).tolist() == bounds.tolist()
        assert [ef.select(i) for i in range(0, len(bounds), 7)] == bounds[::7].tolist()
        assert len(ef.low) + len(ef.upper) <= len(bounds) * (2 + np.log2(max(1, bounds[-1]) / len(bounds) + 1) + 1) / 8 + 16
    assert list(EliasFano.of(np.zeros(0, np.uint64)).runs()) == []
    for ids in (np.array([1, 2, 65535, 7], "<u4"), np.array([1, 70000, 3, 4], "<u4")):
        shard = Shard(encode_shard([None, 4], [1, 3], ids.tobytes()))
        assert [(d, b.tolist()) for d, b in shard.documents()] == [([None, 4], [0, 1, 4])] and shard.ids.tolist() == ids.tolist()
    own = [None, None, -(2**63), -5, -5, 2**63 - 1]
    assert [d for ids, _ in Shard(encode_shard(own, [1] * 6, bytes(24))).documents() for d in ids] == own


def test_reading_boundaries_keeps_no_table_of_them():
    """A million boundaries are served from their code, a directory of a hundredth of it, and a run at a time."""
    import tracemalloc

    values = np.sort(np.random.default_rng(1).integers(0, 5 * 10**8, 10**6))
    code = EliasFano.of(values).encoded()
    tracemalloc.start()
    ef, _ = EliasFano.decoded(code, 0)
    assert sum(int(run.sum()) for run in ef.runs()) == int(values.sum())
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1.05 * len(code) + 10_000 and len(code) < 1_500_000 < values.nbytes


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_token_files(spark, odd, none, which, tmp_path):
    df = pick(spark, odd, none, which)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want, start = [], 0
    for d, t in sorted(rows_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files(df, vocabulary("word_bpe_49k.json")).collect()), key=lambda r: r[1])
    assert got == want
    shards = write_token_files(df, str(tmp_path / "t"), vocabulary("word_bpe_49k.json"), partitions=3)
    assert sum(s["n_docs"] for s in shards) == len(want) and not list((tmp_path / "t").glob("_*"))


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_packing(spark, odd, none, which):
    df = pick(spark, odd, none, which)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for d, t in rows_of(df):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % 1024 or 1024) if at == 0 else 1024
            want[d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    got = pack_documents(df, vocabulary("byte_bpe_50k.json")).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(held) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_sweep_matches_successor_gaps(spark):
    """From the longest unit down, each takes the smallest gap that is left and holds it; ties by number."""
    rng = np.random.default_rng(6)
    for n_units, n_gaps in ((60, 40), (40, 60), (5, 0), (0, 5), (30, 30)):
        units, gaps = rng.integers(1, 20, n_units).tolist(), rng.integers(1, 25, n_gaps).tolist()
        got = {r.unit: (r.sequence, r.room) for r in sweep(spark.createDataFrame(list(enumerate(units)), "unit long, size long"), spark.createDataFrame(list(enumerate(gaps)), "sequence long, room long")).collect()}
        open_, want = dict(enumerate(gaps)), {}
        for u in sorted(range(n_units), key=lambda u: (-units[u], u)):
            fits = [(room, -g) for g, room in open_.items() if room >= units[u]]
            if fits:
                room, g = min(fits)
                want[u] = (-g, room)
                del open_[-g]
        assert got == want


def test_rounds_pack_about_as_well_as_best_fit_decreasing(spark):
    rng = np.random.default_rng(7)
    for lengths in (rng.integers(1, 1025, 600), np.minimum(1024, rng.exponential(200, 900).astype(int) + 1), np.ones(5000, dtype=int), np.full(50, 600)):
        rows = [(i % 7, i, int(n), 0) for i, n in enumerate(lengths)]
        got = place_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")).collect()
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        assert len(got) == len(rows) and all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] for x in held.values())
        bins = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= n]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= n
            else:
                bins.append(1024 - n)
        assert len(held) <= 1.02 * len(bins) + 1


# --- quality


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    counts, transition = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    potential = rng.normal(size=8)
    got, expected, total = marginals(potential, counts, transition)
    want, moved, logs, at = [], np.zeros((2, 2)), 0.0, 0
    for n in counts:
        p, paths = potential[at : at + n], list(product((0, 1), repeat=int(n)))
        weights = np.array([np.exp(sum(p[i] for i in range(n) if y[i]) + sum(transition[a, b] for a, b in zip(y, y[1:]))) for y in paths])
        logs += np.log(weights.sum())
        weights /= weights.sum()
        want += [sum(w for y, w in zip(paths, weights) if y[i]) for i in range(n)]
        for y, w in zip(paths, weights):
            for a, b in zip(y, y[1:]):
                moved[a, b] += w
        at += n
    assert np.allclose(got, want) and np.allclose(expected, moved) and total == pytest.approx(logs)


def test_scores_against_enumeration(monkeypatch):
    """Scores are calibrated, length-weighted means of enumerated marginals, whatever the blocks."""
    from itertools import product

    rng = np.random.default_rng(2)
    texts = ["", "One line only.", "Some words here!\n\nMORE | words 12\nand an end.", "a\nb\n" + "c " * 40 + "\n" + "d" * 300]
    model = Model(rng.normal(size=quality_crf.N_FEATURES), rng.normal(size=(2, 2)), 1.3, -0.2)
    want = []
    for text in texts:
        measures, sizes, counts = line_measures([text])
        p, t = line_features(measures, counts) @ model.weights, model.transition
        paths = list(product((0, 1), repeat=len(p)))
        w = np.array([np.exp(sum(p[i] for i in range(len(p)) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:]))) for y in paths])
        good = np.array([sum(x for y, x in zip(paths, w) if y[i]) for i in range(len(p))]) / w.sum()
        mean = np.clip((good * (sizes + 1)).sum() / (sizes + 1).sum(), 1e-6, 1 - 1e-6)
        want.append(1 / (1 + np.exp(-(1.3 * np.log(mean / (1 - mean)) - 0.2))))
    for lines, chars in ((16_384, 1_000_000), (2, 1_000_000), (3, 20)):
        monkeypatch.setattr(quality_crf, "BLOCK_LINES", lines)
        monkeypatch.setattr(quality_crf, "BLOCK_CHARS", chars)
        assert np.allclose(model.scores(texts), want, atol=1e-4)


def test_quality_of_a_text_of_a_million_lines():
    """Blocks of lines bound the memory; time grows with the lines, not with the longest chain's square."""
    import resource
    import time

    model = Model(np.full(quality_crf.N_FEATURES, 0.01), np.zeros((2, 2)), 1.0, 0.0)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert 0 <= model.scores(["ab c\n" * 1_000_000])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800_000 and time.time() - began < 120


def test_training_bounds_rows_and_lines(spark, monkeypatch):
    """Rows that repeat an id are learned from once, and longer samples stop at the bound on lines."""
    seen = []
    monkeypatch.setattr(quality_crf, "fit", lambda features, sizes, counts, labels: seen.append((len(counts), int(counts.sum()))))
    rows = [(i, "a line\n" * 9 + "end") for i in range(40) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    train(docs, labels)
    monkeypatch.setattr(quality_crf, "SAMPLE_LINES", 105)
    train(docs, labels)
    n = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))
    assert seen == [(n, 10 * n), (10, 100)]


def test_quality_on_held_out_documents(spark):
    got = {r.doc_id: r for r in registry.op1_quality_crf(spark, SF01).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    judged = [(labels[d], r.score, r.predicted) for d, r in got.items() if r.held_out and d in labels]
    good, bad = [s for y, s, _ in judged if y], [s for y, s, _ in judged if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    assert np.mean([y == p for y, _, p in judged]) > 0.93


def test_quality_odd_cases(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 1), (9, 0), (12, 1), (7, 1), (7, 1), (None, 0), (1, 5), (2, None)], "doc_id long, quality int")
    for df in (odd, none):
        model = train(odd, labels)
        got = score_documents(df, model).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert keep_good(df, labels).columns == df.columns
    assert train(odd, labels.limit(0)) is None
    assert {r.score for r in score_documents(odd, None).collect()} == {0.5}


# --- neighbours


def cosine_top(rows, q, k):
    ids, x = list(rows), np.array(list(rows.values()), dtype=float)
    s = x @ rows[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(rows[q])
    return sorted((-round(float(v), 12), i) for v, i in zip(s, ids) if i != q)[:k]


def test_neighbours_recall(spark, monkeypatch):
    """Nine of ten true neighbours are found, though fewer than half of the lists are read."""
    read, calibrate = [], ann.Lists.probes
    monkeypatch.setattr(ann.Lists, "probes", lambda self, asked: read.append((calibrate(self, asked), len(self.centres))) or read[-1][0])
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in registry.op3_nearest_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert len(read) == 1 and read[0][0] < read[0][1] / 2
    asked = [i for i in rows if i % 50 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        want = {i for _, i in cosine_top(rows, q, 5)}
        hits += len(want & {i for i, _ in got[q]})
        for i, s in got[q]:
            assert s == pytest.approx(rows[i] @ rows[q] / np.linalg.norm(rows[i]) / np.linalg.norm(rows[q]), abs=1e-12)
    assert hits / (5 * len(asked)) >= 0.9


def test_scan_against_all_pairs():
    """A scan over lists keeps the nearest allowed vectors, or nearly so, and never a pair that is not allowed."""
    rng = np.random.default_rng(5)
    queries, vectors = rng.normal(size=(30, 48)), rng.normal(size=(1500, 48))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    allowed = rng.random((30, 1500)) < 0.7
    scan = ann.Scan(queries, 6, ann.rotation(48))
    for a in range(0, 1500, 100):
        scan.read(np.arange(30), vectors[a : a + 100], np.arange(a, a + 100), allowed[:, a : a + 100])
    scores = np.where(allowed, queries @ vectors.T / np.linalg.norm(queries, axis=1, keepdims=True), -2)
    best = np.argsort(-scores, axis=1)[:, :6]
    hits = sum(len(set(best[i]) & set(scan.keys[i])) for i in range(30))
    assert hits >= 0.95 * 180
    assert all(allowed[i, scan.keys[i]].all() and np.allclose(scan.scores[i], scores[i, scan.keys[i]]) for i in range(30))


def test_neighbours_odd_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[i % 40].tolist()) for i in range(120)]  # each vector three times
    rows += [(200, None), (250, [0.0] * 8), (300, [float("nan")] * 8), (350, [float("inf")] + [1.0] * 7), (400, [None] * 8), (None, [1.0] * 8), (50, base[10].tolist())]
    rows += [(450, [1.0] * 7), (551, [2.0] * 6 + [1.0]), (600, [1e-200] * 7), (650, [1.0] * 6)]  # other lengths are searched apart
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS list", "'x' AS key", "2 AS id", "3 AS lists")
    got = defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    valid = {i: base[i % 40] for i in range(120)}
    assert dict(got) == {q: [i for _, i in cosine_top(valid, q, 5)] for q in (0, 50, 100)} | {450: [600, 551], 600: [450, 551]}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in nearest(few).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert nearest(few.limit(0)).count() == 0


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


EDGES = [
    (1, ""), (2, "a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 001.02.3.0255 999.1.1.1"), (3, "4111 1111-1111 1111 and 41111111111111112 +1 (017) 555-7713 +12 3"), (4, "é" * 50 + " \U0001f600 mail@x.example.com " + "1" * 20000),
    (5, "a" * 15000 + "@"), (6, "call (555) 123-4567 or bob [at] mail.example.com"), (7, "1-" * 10000 + "1"), (8, "+1" * 200), (9, "a.b" * 7000 + "@x" + ".y" * 10000), (10, "1." * 5000), (11, "+1 2 3 4 5 6 7 8 9 " * 50),
]


@pytest.mark.parametrize("which", ["edges", "odd", "small", "none"])
def test_base_spans(spark, odd, none, which):
    df = spark.createDataFrame(EDGES, "doc_id long, text string") if which == "edges" else pick(spark, odd, none, which)
    got = sorted((tuple(r)[:6] for r in pii.personal_data_digest(df).collect()), key=repr)
    want = []
    for d, t in rows_of(df):
        spans = base_spans(t or "")
        want.append((d, *(sum(s.startswith(k + ":") for s in spans) for k in PATTERNS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_added_spans(spark):
    rows = [(i, f"Please phone me: (555) 123-{1000 + i} today") for i in range(60)] + [(100 + i, f"mail me at user{i}@mail.example.com or phone +1 (017) 555-{1000 + i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data_digest(df).collect()}
    for d, t in rows:
        spans = set(filter(None, got[d].spans.split(",")))
        assert set(base_spans(t)) <= spans
        ends = sorted(tuple(map(int, s.split(":")[1:])) for s in spans)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert sum("phone:" in got[i].spans for i in range(60)) >= 50
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[100] == "mail me at [PII] or phone [PII]"


def test_estimate_finds_reliable_labelers():
    rng = np.random.default_rng(2)
    counts = Counter()
    truth = Counter()
    for _ in range(4000):
        y = int(rng.random() < 0.4)
        votes = tuple(int(y if rng.random() < p else 1 - y) for p in (0.95, 0.9, 0.85)) + (-1,)
        counts[votes] += 1
        truth[votes] += y
    posterior, share, reliable = pii.estimate(sorted(counts.items()))
    assert abs(share - 0.4) < 0.05
    assert np.mean([abs(posterior[v] - truth[v] / n) for v, n in counts.items() if n > 30]) < 0.1
    assert reliable[1, 0, 1] > 0.85 and reliable[0, 1, 0] > 0.8


def test_native_plan(spark):
    plan = pii.personal_data_digest(documents(spark, SF))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline


def test_pipeline(spark):
    """Each stage against a brute-force version on what its predecessor kept."""
    docs = documents(spark, SF)
    columns, seen = docs.columns, docs
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, seen, SF).persist()
        if name != "best_fit_packing":
            assert out[name].columns == columns, name
        seen = out[name]
    assert list(stages) == ["quality_crf", "line_dedup", "near_dedup", "source_mix", "best_fit_packing"]
    full = lambda name: sorted(map(tuple, out[name].collect()), key=repr)
    # quality: the documents with a score of the threshold or more, as they are
    scores = {r.doc_id: r.score for r in registry.op1_quality_crf(spark, SF).collect()}
    assert full("quality_crf") == sorted((tuple(r) for r in docs.collect() if scores[r.doc_id] >= 0.3), key=repr)
    # lines: every line of ten characters or more stays in its first document only
    first, strip = {}, lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    rows = out["quality_crf"].collect()
    for r in sorted(rows, key=lambda r: r.doc_id):
        for line in (r.text or "").split("\n"):
            first.setdefault(strip(line), r.doc_id)
    want = []
    for r in rows:
        kept = [x for x in (r.text or "").split("\n") if len(strip(x)) < 10 or first[strip(x)] == r.doc_id]
        text = r.text if len(kept) == len((r.text or "").split("\n")) else "\n".join(kept)
        want.append((r.doc_id, text, r.lang, r.source, len(text or "")))
    assert full("line_dedup") == sorted((tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), w))[c] for c in columns) for w in want), key=repr)
    # near copies: the least id of each component of similarity 0.8
    from test_text_operators import exact_components

    classes = exact_components([(r.doc_id, r.text) for r in out["line_dedup"].collect()], 80)
    assert full("near_dedup") == sorted((tuple(r) for r in out["line_dedup"].collect() if classes[r.doc_id][1] == r.doc_id), key=repr)
    # mix: whole documents, each at most twice, near the targets
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    kept, times = {r.doc_id: r for r in out["near_dedup"].collect()}, Counter(r.doc_id for r in out["source_mix"].collect())
    assert all(tuple(r) == tuple(kept[r.doc_id]) for r in out["source_mix"].collect()) and max(times.values()) <= 2
    total, of = sum(size(r.text) for r in kept.values()), defaultdict(int)
    for r in kept.values():
        of[r.source] += size(r.text)
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight, left, open_, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * total, set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * of[s] + 1e-9}
        target |= {s: 2 * of[s] if s in over else weight[s] * level for s in (over or open_)}
        left -= sum(2 * of[s] for s in over)
        open_ = open_ - over if over else set()
    for s in order:
        own = [r for r in kept.values() if r.source == s]
        assert abs(sum(times[r.doc_id] * size(r.text) for r in own) - target[s]) <= max(1, *(size(r.text) for r in own))
    # packing: the pieces of every copy, gapless in sequences of at most 1024
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = out["best_fit_packing"].collect()
    assert Counter(p.doc_id for p in pieces if p.piece == 0) == times
    for d, r in kept.items():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert sum(p.length for p in pieces if p.doc_id == d) == n * times[d]
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    assert all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] for x in held.values())
    again = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in again) == Counter(tuple(r)[:5] for r in pieces)


def test_pipeline_odd_cases(spark, odd, none):
    for df in (odd, none):
        seen = df.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, SF).persist()
            seen.count()


def test_a_long_labelled_text_leaves_room_for_others(spark, monkeypatch):
    """A text of more lines than the sample may hold, first by hash, does not close the sample."""
    from pyspark.sql import functions as F

    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    first = labels.filter(~quality_crf.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("a line of words\n"), quality_crf.SAMPLE_LINES + 100)).otherwise(F.col("text")))
    model = train(long, labels)
    assert model is not None
    assert score_documents(docs, model).agg(F.count_distinct("score")).first()[0] > 50


def test_units_meet_gaps_of_earlier_ranges():
    """Left-over units of a range take the last open gaps of the ranges before."""
    from lumenrank.llm.packing import _across

    assert _across([]) == [] and _across([(0, 5, 0), (3, 2, 1)]) == []
    assert _across([(0, 0, 3), (1, 1, 1), (2, 5, 0)]) == [(1, 0, 1, 0, 2), (2, 0, 1, 1, 0), (2, 1, 3, 0, 2)]
