"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, repetition and lengths of
words, each cut into steps, and the same of the lines before and after it. Transition weights tie
neighbouring lines. Forward-backward gives each line's probability of being good; their mean, weighted
by length, is the document's score, calibrated by a logistic curve on the same sample.

Training sees only labelled documents outside the held-out fold, at most ``sample`` of them
(those with the least hash of their id) and ``SAMPLE_LINES`` lines (of one text the first ``MOST_LINES``), each line labelled as its document. Scores
depend on the text alone; long texts are measured and weighed in blocks of lines, messages passing from block to block.

Nulls: a null text is the empty text, one empty line; a null doc_id has a score, is in no fold
and is never learned from. Labels other than 0 and 1 are ignored; a doc_id labelled twice counts by
its least label. Without labels of both kinds every score is 0.5. Rows that repeat are scored alike, and learned
from once; ties have equal scores, and a score at the threshold is good. An empty table gives no rows. Other columns are ignored by ``score_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import small_batches

#: Labelled documents that training sees at most, the lines that they have together at most, and rounds of gradient steps.
SAMPLE, SAMPLE_LINES, ROUNDS = 2_000, 400_000, 80

#: Lines that one document may give to the sample; of a longer one the first so many are learned from.
MOST_LINES = SAMPLE_LINES // 100

#: Characters and lines that are measured and weighed at once (a longer line makes a block of its own).
BLOCK_CHARS, BLOCK_LINES = 1_000_000, 16_384

#: A document with this score or more is predicted good.
THRESHOLD = 0.3

#: Kinds of characters: letters, upper case, digits, white space, sentence marks, !, |, other ASCII symbols.
_KINDS = 8


def _kinds() -> np.ndarray:
    kind = np.zeros(129, dtype=np.uint8)  # 128 stands for everything beyond ASCII, counted as a letter
    for c in range(128):
        ch = chr(c)
        kind[c] = 1 if ch.isupper() else 0 if ch.isalpha() else 2 if ch.isdigit() else 3 if ch.isspace() or c < 32 else 4 if ch in ".,;:?'\"()-" else 5 if ch == "!" else 6 if ch == "|" else 7
    return kind


_KIND = _kinds()

#: Steps that each line measure is cut into (a feature for each step that it exceeds).
_STEPS = {
    "upper": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6),
    "digit": (0.001, 0.01, 0.03, 0.08, 0.2, 0.5),
    "space": (0.05, 0.1, 0.13, 0.16, 0.19, 0.22, 0.3),
    "mark": (0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1),
    "bang": (0.001, 0.01, 0.05, 0.15),
    "pipe": (0.001, 0.02, 0.06, 0.1),
    "symbol": (0.001, 0.01, 0.05, 0.15, 0.3),
    "words": (0.5, 1.5, 3.5, 7.5, 15.5, 31.5, 63.5, 127.5),
    "distinct": (0.05, 0.15, 0.3, 0.5, 0.65, 0.8, 0.9, 0.999),
    "run": (1.5, 2.5, 4.5, 9.5, 19.5),
    "twice": (0.02, 0.1, 0.3, 0.6),
    "mean_word": (2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 10.0, 15.0),
    "ends": (0.5,),
}
_CUTS = [(k, x) for k, steps in enumerate(_STEPS.values()) for x in steps]
_OWN = len(_CUTS)

#: Features of a line: its own steps, those of the line before and after, first, last, and 1.
N_FEATURES = 3 * _OWN + 3


def _block_measures(lines: list[str]) -> np.ndarray:
    """Measures of a block of lines."""
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _KIND[np.minimum(points, 128)]
    line = np.repeat(np.arange(len(lines)), size)
    table = np.bincount(line * _KINDS + kind, minlength=len(lines) * _KINDS).reshape(-1, _KINDS).astype(float)
    share = table / np.maximum(size, 1)[:, None]
    words = []
    for x in lines:
        w = x.split()
        run = longest = 1 if w else 0
        twice, distinct = 0, len(set(w))
        if distinct < 0.7 * len(w):
            for p, q in zip(w, w[1:], strict=False):
                run = run + 1 if p == q else 1
                twice += p == q
                longest = max(longest, run)
        words.append((len(w), distinct / len(w) if w else 1.0, longest, twice / max(1, len(w) - 1)))
    words = np.array(words, dtype=float)
    solid = (size - table[:, 3]) / np.maximum(words[:, 0], 1)
    ends = np.array([x.rstrip()[-1:] in (".", "!", "?") for x in lines], dtype=float)
    return np.column_stack((share[:, 1:8], words, solid, ends))


def line_measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line, its code points, and how many lines each text has."""
    lines = [text.split("\n") for text in texts]
    counts = np.array([len(x) for x in lines])
    lines = [x for each in lines for x in each]
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    measures, first = [], 0
    upto = np.cumsum(sizes)
    while first < len(lines):
        before = upto[first - 1] if first else 0
        last = max(first + 1, min(first + BLOCK_LINES, int(np.searchsorted(upto, before + BLOCK_CHARS, side="right"))))
        measures.append(_block_measures(lines[first:last]))
        first = last
    return np.concatenate(measures), sizes, counts


_WHICH, _AT = np.array([k for k, _ in _CUTS]), np.array([x for _, x in _CUTS])


def line_features(measures: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of each line, with its neighbours' in the same text."""
    own = (measures[:, _WHICH] > _AT).astype(np.float32)
    n = len(own)
    first = np.zeros(n, dtype=np.float32)
    last = np.zeros(n, dtype=np.float32)
    ends = np.cumsum(counts)
    first[ends - counts] = 1
    last[ends - 1] = 1
    before = np.vstack((np.zeros((1, _OWN), np.float32), own[:-1])) * (1 - first)[:, None]
    after = np.vstack((own[1:], np.zeros((1, _OWN), np.float32))) * (1 - last)[:, None]
    return np.column_stack((own, before, after, first, last, np.ones(n, dtype=np.float32)))


def potentials(weights: np.ndarray, measures: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's log-odds of good before its neighbours have their say; features are made block by block."""
    n, out = len(measures), np.zeros(len(measures))
    edge = np.concatenate(([0], np.cumsum(counts)))
    for a in range(0, n, BLOCK_LINES):
        b = min(n, a + BLOCK_LINES)
        # with the line before and the line after, where they belong to the same text
        low, high = max(0, a - 1), min(n, b + 1)
        inner = edge[(edge > low) & (edge < high)]
        own = np.diff(np.concatenate(([low], inner, [high])))
        features = line_features(measures[low:high], own)[a - low : b - low]
        # a block's first and last line are those of their texts only where a text begins or ends there
        features[:, 3 * _OWN] = np.isin(np.arange(a, b), edge)
        features[:, 3 * _OWN + 1] = np.isin(np.arange(a + 1, b + 1), edge)
        out[a:b] = features @ weights
    return out


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms: first, then the other."""
    return np.logaddexp(first[:, :, :1] + then[:, :1, :], first[:, :, 1:] + then[:, 1:, :])


def messages(potential: np.ndarray, counts: np.ndarray, transition: np.ndarray, backward: bool = False) -> np.ndarray:
    """Logarithms of the forward (or backward) messages of each line, n x 2.

    Steps of a chain are 2 x 2 matrices; all their products are found by doubling, in as many rounds as the
    logarithm of the longest chain. Products stop at the start of a chain. Long
    tables go block by block, the last message of one being the first of the next.
    """
    n = len(potential)
    starts = np.zeros(n, dtype=bool)
    ends = np.cumsum(counts)
    starts[(ends - counts) if not backward else n - ends] = True
    order = slice(None) if not backward else slice(None, None, -1)
    p, move = potential[order], transition if not backward else transition.T
    out = np.zeros((n, 2))
    for a in range(0, n, BLOCK_LINES):
        b = min(n, a + BLOCK_LINES)
        steps = np.tile(move, (b - a, 1, 1))
        if backward:  # what a line says of the one before it: its own potential, then the transition
            steps[1 if not a else 0 :, 1, :] += p[max(a, 1) - 1 : b - 1, None]
        else:
            steps[:, :, 1] += p[a:b, None]
        at = starts[a:b]
        steps[at] = 0.0
        if not backward:
            steps[at, :, 1] = p[a:b][at, None]
        if a:
            head = out[a - 1]
            if not at[0]:
                steps[0] = np.logaddexp(head[0] + steps[0, 0], head[1] + steps[0, 1])[None, :]
        shift, longest, whole = 1, int(counts.max()), at.copy()
        while shift < min(b - a, longest):
            # products that reach back to the start of their chain are whole
            steps = np.concatenate((steps[:shift], np.where(whole[shift:, None, None], steps[shift:], _compose(steps[:-shift], steps[shift:]))))
            whole[shift:] |= whole[:-shift]
            shift *= 2
        out[a:b] = steps[:, 0, :]
    return out[order]


def marginals(potential: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each line is good, expected transitions (2 x 2), and the log partition sum."""
    ahead, back = messages(potential, counts, transition), messages(potential, counts, transition, backward=True)
    ends = np.cumsum(counts) - 1
    total = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    odds = (ahead[:, 1] + back[:, 1]) - (ahead[:, 0] + back[:, 0])
    inner = np.ones(len(potential), dtype=bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    nxt = back[at + 1].copy()
    nxt[:, 1] += potential[at + 1]
    expected = np.exp(ahead[at][:, :, None] + transition + nxt[:, None, :] - np.repeat(total, counts)[at][:, None, None]).sum(axis=0)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500))), expected, float(total.sum())


@dataclass
class Model:
    """Weights of the field and of the calibration of document scores."""

    weights: np.ndarray
    transition: np.ndarray
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> np.ndarray:
        measures, sizes, counts = line_measures(texts)
        return self.calibrate(document_means(self, potentials(self.weights, measures, counts), sizes, counts))

    def calibrate(self, means: np.ndarray) -> np.ndarray:
        p = np.clip(means, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def document_means(model: Model, potential: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities in each text."""
    ahead, back = messages(potential, counts, model.transition), messages(potential, counts, model.transition, backward=True)
    odds = (ahead[:, 1] + back[:, 1]) - (ahead[:, 0] + back[:, 0])
    good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    weight = sizes + 1.0
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def fit(features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, penalty: float = 2.0) -> Model:
    """Weights that maximise the penalised likelihood of the lines' labels; then the calibration of means."""
    line = np.repeat(labels, counts).astype(float)
    starts = np.cumsum(counts) - counts
    inner = np.ones(len(line), dtype=bool)
    inner[starts + counts - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (np.repeat(labels, counts)[inner], np.repeat(labels, counts)[inner]), 1)
    model = Model(np.zeros(features.shape[1]), np.zeros((2, 2)), 1.0, 0.0)
    x = np.concatenate((model.weights, np.zeros(4)))
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = max(1, len(counts))
    observed = np.concatenate((features.T @ line, seen.ravel()))
    # a transition is held back more: lines of a document were labelled alike, whatever they say
    hold = np.concatenate((np.full(features.shape[1], penalty), np.full(4, 50 * penalty)))
    for step in range(1, ROUNDS + 1):
        good, expected, _ = marginals(features @ x[:-4], counts, x[-4:].reshape(2, 2))
        gradient = (observed - np.concatenate((features.T @ good, expected.ravel())) - hold * x) / n
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x = x + 0.1 * (1 - step / (ROUNDS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(x[:-4], x[-4:].reshape(2, 2), 1.0, 0.0)
    means = np.clip(document_means(model, features @ model.weights, sizes, counts), 1e-6, 1 - 1e-6)
    z = np.log(means / (1 - means))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's rounds of a logistic regression with two weights
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((labels - p) * z).sum() - 1e-3 * a, (labels - p).sum() - 1e-3 * b])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that training never sees."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


_LINES = "quality int, counts int, sizes array<int>, measures binary"


def _measured(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        sizes, packed, counts = [], [], []
        for text in batch.column("text"):
            measures, size, count = line_measures([text.as_py() or ""])
            sizes.append(size.astype(np.int32))
            packed.append(measures.astype("<f4").tobytes())
            counts.append(int(count[0]))
        yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(counts, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(packed, pa.binary())], names=["quality", "counts", "sizes", "measures"])


def _text_groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, so many at once as have BLOCK_CHARS characters together, or one longer one."""
    group, held = [], 0
    for text in texts:
        text = text.as_py() or ""
        if group and held + len(text) > BLOCK_CHARS:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return np.concatenate([model.scores(group) for group in _text_groups(texts)] or [np.zeros(0)])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of labelled documents outside the held-out fold; None without both labels."""
    small_batches(docs.sparkSession)
    doc = F.col("doc_id").cast("long")
    known = labels.select(doc.alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # broadcast: at most so many ids and labels
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(doc.alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").withColumn("lines", F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")) + 1)
    # one row of each document (rows may repeat an id), and documents as long as their lines fit; ids, hashes and counts only
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    first = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lines")).alias("x")).select("doc_id", "x.*")
    few = first.withColumn("upto", F.sum(F.least("lines", F.lit(MOST_LINES))).over(order)).filter(F.col("upto") <= SAMPLE_LINES).select("doc_id", "h")
    texts = texts.join(F.broadcast(few), "doc_id").filter(F.xxhash64("text") == F.col("h")).select("doc_id", "quality", F.substring_index("text", "\n", MOST_LINES).alias("text")).dropDuplicates(["doc_id"])
    rows = sorted(texts.select("quality", "text").mapInArrow(_measured, _LINES).collect(), key=lambda r: (r["quality"], bytes(r["measures"])))
    found = np.array([r["quality"] for r in rows], dtype=np.int64)
    if len(set(found.tolist())) < 2:
        return None
    counts = np.array([r["counts"] for r in rows])
    measures = np.concatenate([np.frombuffer(bytes(r["measures"]), "<f4").reshape(r["counts"], -1) for r in rows])
    sizes = np.concatenate([np.array(r["sizes"]) for r in rows])
    return fit(line_features(measures, counts), sizes, counts, found)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    small_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch.column("text")), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; columns as they are. Texts are read once and not shuffled."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.filter(pa.array(_scores(model, batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
