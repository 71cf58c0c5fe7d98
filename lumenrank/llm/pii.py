"""Personal data by aggregated weak supervision, in DataFrame operations only.

Candidate spans come from the base patterns (all of their matches, valid or not) and from looser ones.
Labelers vote on each candidate, or abstain: its format, a gazetteer (endings of hosts, country codes,
card issuers, reserved networks), the words before it, and its grouping. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for each kind; the posteriors train a logistic
classifier of spans on votes and shape. A valid match of a base pattern is always kept; other
candidates are added where the classifier is sure and no base span overlaps them.

Patterns are written so that no position is tried twice: a run of characters is entered at its start,
or where the last match ended, and repeated groups are possessive, so long texts cost linear time
and no stack.

Nulls: a null text is the empty text; a null doc_id is kept. Rows with equal doc_id and text have equal
results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import stage_table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"[A-Za-z0-9._%+-]"
_HOST = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def _once(cls: str) -> str:
    """At the start of a run of cls, or where the last match ended."""
    return rf"(?:(?<!{cls})|\G)"


#: (kind, loose, pattern, a cheaper pattern or text without which there is no match)
PATTERNS = (
    ("email", False, rf"{_once(_LOCAL)}{_LOCAL}++@{_HOST}", "@"),
    ("ip", False, rf"{_once('[0-9]')}[0-9]++(?:\.[0-9]++){{3}}", r"[0-9]\.[0-9]"),
    ("card", False, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", False, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", True, rf"{_once(_LOCAL)}{_LOCAL}++\x20?[\[(]at[\])]\x20?{_HOST}", r"[\[(]at[\])]"),
    ("phone", True, r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
)

# Gazetteers and context words of the labelers.
_ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "info", "biz", "io", "co", "de", "fr", "es", "it", "nl", "uk", "us", "ca", "au", "ch", "at", "be", "eu", "jp", "cn", "in", "br", "ru", "pl", "se", "no", "dk", "fi", "pt", "mx", "example", "test")
_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_ISSUERS = r"^(?:4[0-9]{15}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12})$"
_CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|address|correo|courriel|mailto",
    "ip": r"(?i)\bip\b|host|server|address|network|client",
    "card": r"(?i)card|visa|master|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|\btel\b|call|mobile|fax|telefon|téléphone|teléfono",
}
_AGAINST = r"(?i)version|isbn|order|invoice|serial|build|release|ticket|\bid\b|\bno\.|total"

#: Code points before a candidate that the context labeler reads.
CONTEXT_CHARS = 40

#: A loose candidate is added when the classifier gives it this probability or more.
SURE = 0.9



def _matches(kind: str, loose: bool, pattern: str, quick: str) -> Column:
    """array of (kind, loose, i, gap: code points between it and the match before, match, before: words before it)."""
    text, p = F.col("text"), F.lit(pattern)
    there = F.contains(text, F.lit(quick)) if quick == "@" else F.rlike(text, F.lit(quick))
    gaps = F.split("text", pattern, -1)
    found = F.regexp_extract_all(text, p, F.lit(0))
    paired = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), i.alias("i"), F.char_length(x["g"]).alias("gap"), x["m"].alias("match"), F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("before")),
    )
    return F.when(there, paired)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id and h, a hash of the text, of every row; the candidate spans with start, end, match, before)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    empty = F.array().cast("array<struct<kind:string,loose:boolean,i:int,gap:int,match:string,before:string>>")
    lists = [F.coalesce(_matches(*p), empty) for p in PATTERNS]
    rows = stage_table(named.select("doc_id", F.xxhash64("text").alias("h"), F.concat(*lists).alias("c")), "candidates")
    each = rows.filter(F.size("c") > 0).select("doc_id", "h", F.explode("c").alias("c")).select("doc_id", "h", "c.*")
    # equal rows hold equal candidates
    each = each.groupBy("doc_id", "h", "kind", "loose", "i").agg(F.first("gap").alias("gap"), F.first("match").alias("match"), F.first("before").alias("before"))
    upto = Window.partitionBy("doc_id", "h", "kind", "loose").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("match")).over(upto)
    return rows.select("doc_id", "h"), each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("match"))


def _luhn(digits: Column) -> Column:
    """Whether digits pass the check sum (at most 19 are looked at)."""
    each = F.split(F.reverse(digits), "")
    value = lambda x: x.cast("int")
    twice = lambda x: F.when(value(x) > 4, value(x) * 2 - 9).otherwise(value(x) * 2)
    points = F.transform(F.filter(each, lambda x: x != ""), lambda x, i: F.when(i % 2 == 1, twice(x)).otherwise(value(x)))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def with_votes(spans: DataFrame) -> DataFrame:
    """spans with valid (by the base rules), votes v_* (1, 0, or -1 to abstain) and shape features."""
    kind, match = F.col("kind"), F.col("match")
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length("digits")
    parts = F.split("match", r"\.")
    octets = F.forall(parts, lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.lit(False)) | F.regexp_replace(x, "^0+", "").isin(""))
    number = F.when(n.between(16, 19), _luhn(F.col("digits"))).otherwise(False)
    valid = ~F.col("loose") & F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", number).otherwise(n.between(8, 15))
    plain = F.when(kind == "email", ~F.col("loose")).when(kind == "phone", n.between(8, 15)).otherwise(F.col("valid"))
    ending = F.lower(F.substring_index(match, ".", -1)).isin(*_ENDINGS)
    reserved = match.rlike(r"^(?:0+|255|2[2-5][0-9])\.|\.0+\.0+\.0+$")
    listed = (
        F.when(kind == "email", ending.cast("int"))
        .when(kind == "phone", F.when(match.rlike(_CODES), 1).when(match.startswith("+"), 0).otherwise(-1))
        .when(kind == "card", F.col("digits").rlike(_ISSUERS).cast("int"))
        .otherwise(F.when(reserved, 0).otherwise(-1))
    )
    near = F.lit(False)
    for k, words in _CONTEXT.items():
        near = F.when(kind == k, F.col("before").rlike(words)).otherwise(near)
    context = F.when(near, 1).when(F.col("before").rlike(_AGAINST), 0).otherwise(-1)
    grouped = (
        F.when(kind == "card", F.when(match.rlike(r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), 1).when(match.rlike("^[0-9]+$"), -1).otherwise(0))
        .when(kind == "phone", F.when(match.rlike(r"[0-9]{3}[\x20.)-]+[0-9]{3}[\x20.-][0-9]{4}$"), 1).when(match.rlike(r"[.(-][.(-]|\x20\x20"), 0).otherwise(-1))
        .when(kind == "ip", F.when(match.rlike(r"(?:^|\.)0[0-9]"), 0).otherwise(-1))
        .otherwise(F.when(match.rlike(r"\.\.|^\.|\.@|-\.|\.-"), 0).otherwise(-1))
    )
    # what is neither valid nor of a likely size is no candidate
    likely = F.when(kind == "card", n.between(13, 19)).when(kind == "phone", n.between(7, 15)).when(kind == "ip", ~match.rlike("[0-9]{4}")).otherwise(True)
    length = F.when(n == 0, 0).when(n < 8, 1).when(n < 13, 2).when(n < 16, 3).when(n < 20, 4).otherwise(5)
    return (
        spans.withColumn("digits", digits)
        .withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("v_format", F.coalesce(plain, F.lit(False)).cast("int"))
        .withColumn("v_listed", listed)
        .withColumn("v_context", context)
        .withColumn("v_grouped", grouped)
        .withColumn("f_length", length)
        .filter(F.col("valid") | likely)
        .drop("digits")
    )


#: Weight of what is known of the format labeler, as a share of all votes.
ANCHOR = 0.25

VOTES = ("v_format", "v_listed", "v_context", "v_grouped")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], float, np.ndarray]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns each pattern's probability of being personal data, the share of it, and the reliabilities:
    for either truth, labeler and vote (0, 1), how often that vote is cast by a labeler that doesn't
    abstain (abstaining tells nothing). Before any vote is seen the format is taken to be right nine times
    in ten, as by a quarter as many votes as there are, and the others more often than not, as by a few;
    without such an anchor the two truths could change places.
    """
    votes = np.array([p for p, _ in patterns]).reshape(-1, len(VOTES))
    n = np.array([c for _, c in patterns], dtype=float)
    cast, vote = votes >= 0, np.maximum(votes, 0)
    known = np.tile(np.array([[8.0, 2.0], [2.0, 8.0]])[:, None, :], (1, len(VOTES), 1))
    known[:, 0] = np.array([[0.9, 0.1], [0.1, 0.9]]) * max(10.0, ANCHOR * n.sum())
    reliable, share = known / known.sum(axis=2, keepdims=True), 0.5
    p = np.full(len(n), 0.5)
    for _ in range(rounds):
        logs = [(np.log(reliable[y, np.arange(len(VOTES)), vote]) * cast).sum(axis=1) for y in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + math.log((1 - share) / share), -500, 500)))
        share = float((p @ n + 2) / (n.sum() + 4))
        for y, w in ((1, p * n), (0, (1 - p) * n)):
            for k in range(len(VOTES)):
                got = known[y, k] + np.bincount(vote[cast[:, k], k], weights=w[cast[:, k]], minlength=2)
                reliable[y, k] = got / got.sum()
    return {q: float(x) for (q, _), x in zip(patterns, p, strict=True)}, share, reliable


def train_classifier(rows: list[tuple[tuple[int, ...], int, float]], rounds: int = 40) -> dict[tuple[int, int], float]:
    """Logistic weights by (feature, value) from feature values, counts and soft labels; (-1, 0) is the constant."""
    keys = sorted({(k, v) for f, _, _ in rows for k, v in enumerate(f)}) + [(-1, 0)]
    at = {key: i for i, key in enumerate(keys)}
    x = np.zeros((len(rows), len(keys)))
    for r, (f, _, _) in enumerate(rows):
        x[r, [at[k, v] for k, v in enumerate(f)]] = 1
        x[r, -1] = 1
    n, y = np.array([c for _, c, _ in rows], dtype=float), np.array([p for _, _, p in rows])
    w = np.zeros(len(keys))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(keys))
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return {key: float(w[i]) for key, i in at.items()}


def fit(voted: DataFrame) -> dict[str, dict[tuple[int, int], float]]:
    """A span classifier for each kind. Only counts by votes and shape (a few hundred rows at most) reach the driver."""
    seen = voted.groupBy("kind", *VOTES, "f_length").count().collect()
    models = {}
    for kind in KINDS:
        rows = [(tuple(r[v] for v in (*VOTES, "f_length")), r["count"]) for r in seen if r["kind"] == kind]
        patterns: dict[tuple[int, ...], int] = {}
        for f, c in rows:
            patterns[f[:-1]] = patterns.get(f[:-1], 0) + c
        if rows:
            posterior, _, _ = estimate(sorted(patterns.items()))
            models[kind] = train_classifier(sorted((f, c, posterior[f[:-1]]) for f, c in rows))
    return models


def probability(models: dict[str, dict[tuple[int, int], float]]) -> Column:
    """The classifier's probability of a span, from its votes and shape."""
    total = F.lit(0.0)
    for kind, weights in models.items():
        one = F.lit(weights[-1, 0])
        for k, name in enumerate((*VOTES, "f_length")):
            w = F.lit(0.0)
            for (feature, value), x in weights.items():
                if feature == k:
                    w = F.when(F.col(name) == value, x).otherwise(w)
            one = one + w
        total = F.when(F.col("kind") == kind, one).otherwise(total)
    return 1 / (1 + F.exp(-total))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind number, start, end, in order) of each row of docs."""
    rows, spans = candidates(docs)
    voted = stage_table(with_votes(spans), "votes")
    models = fit(voted)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(order.alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    told = voted.withColumn("p", probability(models)).filter(F.col("valid") | (F.col("p") >= SURE))
    told = told.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.when(F.col("valid"), span))).alias("base"), F.sort_array(F.collect_list(F.when(~F.col("valid"), span))).alias("more"))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    told = told.withColumn("spans", F.sort_array(F.concat("base", free))).drop("more")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    same = rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g"))
    both = rows.join(told.withColumnsRenamed({"doc_id": "d", "h": "g"}), same, "left")
    return both.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as text)."""
    found = personal_spans(docs)

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS, 1)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, with_text: str = "[PII]") -> DataFrame:
    """doc_id and text of docs with every span replaced; overlapping spans are replaced as one."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = personal_spans(docs).distinct()
    places = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    both = named.join(found.select(F.col("doc_id").alias("d"), places.alias("places")), F.col("doc_id").eqNullSafe(F.col("d")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] > acc["at"], F.concat(F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(with_text))).otherwise(F.when(acc["at"] == 0, F.lit(with_text)).otherwise(F.lit("")))
        return F.struct(F.concat(acc["out"], before).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("places", start, step)
    return both.withColumn("_d", done).select("doc_id", F.concat("_d.out", F.substr("text", F.col("_d.at") + 1, F.char_length("text"))).alias("text"))
