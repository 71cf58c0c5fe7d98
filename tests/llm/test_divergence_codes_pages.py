"""Source divergence, vector codes and main texts, against brute force and the SQL."""

import hashlib
import html as escapes
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumenrank.llm import divergence, registry, vector_codes
from lumenrank.llm.common import documents
from lumenrank.llm.divergence import source_divergence
from lumenrank.llm.main_text import FEATURES, FILLS, LAYOUTS, labelled_blocks, labelled_pages, main_text, read_blocks, train_blocks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,table", [("op11_source_divergence", "documents"), ("op12_vector_codes", "embeddings")])
def test_matches_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ran = con.execute(registry.SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*names).collect()), key=repr) == sorted(ran.fetchall(), key=repr)


# --- source divergence


def plain_divergence(rows, min_docs, top):
    occurs, holds, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(str.maketrans(divergence.UPPER, divergence.LOWER)) for t in re.findall(divergence.TERM_PATTERN, text or "")]
        occurs[lang, source].update(terms)
        holds[lang].update(set(terms))
        groups.add((lang, source))
    apart, out = lambda p, q: (p - q) ** 2 // (p + q), []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holds[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        size = {s: sum(occurs[lang, s][t] for t in kept) for s in sources}
        share = lambda n, of: 1 + 10**9 * (n + 2) // (of + 2 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(occurs[lang, s][t], size[s]) for t in kept} for s in sources}
        q = {t: share(sum(occurs[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-apart(p[s][t], q[t]), t.encode(), t) for t in kept if occurs[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms[:top])) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_of(docs, *given, **named):
    return sorted(map(tuple, source_divergence(docs, *given, **named).collect()))


def test_divergence_of_odd_documents(spark, odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert divergence_of(odd, 2) == plain_divergence(rows, 2, 10)
    assert divergence_of(odd, 1, top=2, tile=1, part=7) == plain_divergence(rows, 1, 2)
    assert divergence_of(odd, 10_000) == plain_divergence(rows, 10_000, 10)  # no term is kept
    assert source_divergence(none).count() == 0


def test_divergence_of_nulls_repeats_and_several_chunks_of_a_term(spark):
    rows = [("a", "x", "one, One two\xa0b x-x-X one!"), (None, None, None), ("a", None, ""), ("b", "q", "zz zz\tzz\x0bZZ"), ("b", "q", "zz zz\tzz\x0bZZ"), ("b", "r", "É1é x-x X " + "y " * 600_000), ("b", "s", "[]{}123"), ("a", "é퟿", "漢字 \U0001f600two two")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("block", F.lit(1)).withColumn("chunk", F.lit("z"))
    for min_docs in (1, 2):
        assert divergence_of(docs, min_docs) == plain_divergence(rows, min_docs, 10)


def test_divergence_blocks_and_tiles(spark, monkeypatch):
    """Documents in many blocks, and sources in many tiles, give the same."""
    docs = documents(spark, SF)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    want = plain_divergence(rows, 10, 10)
    assert divergence_of(docs.repartition(7), tile=3, part=50) == want


# --- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        met = code()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, met, strict=True) if m[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    met, sums = code(), Counter()
    for (_, label, _), m in zip(kept, met, strict=True):
        sums[label] += sum(d for d, _ in m)
    return sorted([(i, "".join(f"{k:02x}" for _, k in m), sum(d for d, _ in m), sums[label], digest) for (i, label, _), m in zip(kept, met, strict=True)], key=repr)


def codes_of(df, **named):
    return sorted(map(tuple, vector_codes.vector_codes(df, **named).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, row int, part int"


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(0, 0.3, 32).round(3).tolist() for _ in range(70)]
    rows = [(i * 3, v, i % 4 or None) for i, v in enumerate(vectors)]
    rows += [(9, vectors[1], 1), (9, vectors[1], 1), (None, vectors[2], None), (5, None, 2), (6, [None, *vectors[0][1:]], 2), (7, [float("nan"), *vectors[0][1:]], 2), (8, [float("inf"), *vectors[0][1:]], 2), *[(1000 + i, vectors[7], 3) for i in range(1200)]]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS).repartition(3)
    assert codes_of(df) == plain_codes([(i, k, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v, k in rows])
    few = df.filter("vec_id < 30")
    assert codes_of(few, entries=64) == plain_codes([(i, k, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v, k in rows if i is not None and i < 30])


def test_codes_without_rows_and_of_other_lengths(spark):
    none = spark.createDataFrame([(1, None, 1, 0, 0)], VECTORS)
    assert codes_of(none) == [] and codes_of(none.limit(0)) == []
    empty = spark.createDataFrame([(1, [], 1, 0, 0)], VECTORS)
    assert [r[1:4] for r in codes_of(empty)] == [("00" * 16, 0, 0)]
    for lengths in ((16, 32), (17,)):
        with pytest.raises(ValueError, match="components"):
            vector_codes.vector_codes(spark.createDataFrame([(i, [0.5] * n, 1, 0, 0) for i, n in enumerate(lengths)], VECTORS))
    with pytest.raises(ValueError, match="exact"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e9] * 16, 1, 0, 0)], VECTORS))


def test_shortlists_lose_nothing_and_leave_something_out():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (64, 4))
    points = rng.integers(-300, 300, (40_000, 4))
    order = np.argsort(vector_codes.hilbert_keys(points, points.min(0), points.max(0)), kind="stable")
    lengths = []
    for a in range(0, len(points), vector_codes.BLOCK):
        held = points[order[a : a + vector_codes.BLOCK]]
        some = vector_codes.shortlist(entries, held.min(0), held.max(0))
        code, error = vector_codes.nearest_entries(held, entries, some)
        want = ((held[:, None] - entries[None]) ** 2).sum(2)
        assert (code == want.argmin(1)).all() and (error == want.min(1)).all()
        lengths.append(len(some))
    assert np.mean(lengths) < 40
    same = vector_codes.shortlist(entries, points[0], points[0])
    assert same.tolist() == np.flatnonzero(((points[0] - entries) ** 2).sum(1) == ((points[0] - entries) ** 2).sum(1).min()).tolist()


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(monkeypatch, dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims).astype(np.int64)
    monkeypatch.setattr(vector_codes, "KEY_BITS", dims * bits)
    keys = vector_codes.hilbert_keys(grid, np.zeros(dims, np.int64), np.full(dims, (1 << bits) - 1))
    assert len(set(keys.tolist())) == len(grid)
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


# --- main texts


def test_main_text_of_the_pages(spark):
    """The pages keep their article in one element; its blocks, read apart by patterns, are the text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(escapes.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?p>|</?h1>", article)]
        want[r.page_id] = (r.url, "\n\n".join(b for b in blocks if b))
    got = registry.QUERIES["op13_main_text"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(want)
    assert {r.page_id: (r.url, r.text) for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_held_out_layouts(spark):
    """Each third of the layouts is classified by a tree of the others."""
    pages, right, n = labelled_pages(), 0, 0
    for k in range(3):
        own = [i // len(FILLS) % 3 == k for i in range(len(pages))]
        model = train_blocks(spark, [p for p, o in zip(pages, own, strict=True) if not o])
        judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled_blocks(spark, [p for p, o in zip(pages, own, strict=True) if o])))
        counts = judged.selectExpr("count_if(prediction = label)", "count(*)").first()
        right, n = right + counts[0], n + counts[1]
    assert len(pages) == len(LAYOUTS) * len(FILLS) and right / n > 0.9


ODD_PAGES = [
    (1, "u", None, ""), (2, None, "", ""), (3, "u", "plain words without any tag, long enough to be the text of a page by themselves, as it seems", None),
    (4, "u", "<article><p>a &lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;x<br>y\n z<p>two<script>if (a</b) '</p>'</script><style>p{}</style><!-- <p>no</p> --></article><footer>no</footer>", "a <b> &amp; éé x y z\n\ntwo"),
    (5, "u", "<nav><a>x</a><article><p>kept</nav><p>kept too</article></div></div>", None), (6, "u", "<article><p>" + "long text " * 200_000 + "</p></article>", ("long text " * 200_000).strip()),
    (6, "u", "<article>same id</article>", "same id"), (None, None, "<main><h1>T</h1><div class='comments'><p>not this</p></div><p>this</p></main>", "T\n\nthis"),
    (7, "u", "<div>" * 20_000 + "deep", None), (8, "u", "<article><p title='a > b'>q</p><p unclosed=\"x>r</p></article>", None), (9, "u", "<script>never closed <p>x", ""), (10, "u", "<article>x<p>y</p>z</article>", "x\n\ny\n\nz"),
]


def test_odd_pages(spark):
    df = spark.createDataFrame([(i, u, h, 7) for i, u, h, _ in ODD_PAGES], "page_id long, url string, html string, text int").repartition(2)
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in main_text(df).collect())
    assert sum(got.values()) == len(ODD_PAGES)
    for i, u, _, want in ODD_PAGES:
        if want is not None:
            assert got[i, u, want, len(want)] == 1
    assert main_text(df.limit(0)).count() == 0


def test_blocks_keep_their_places():
    blocks = read_blocks("<article><p>a <a href=x>b c</a></p><form>d</form><aside><article>e</article></aside></article><form><main>f</main>g</form>")
    assert [(b[0], b[1], round(b[2], 3), b[3], b[4]) for b in blocks] == [("a b c", 3, 0.667, 1, 0), ("d", 1, 0.0, 1, 1), ("e", 1, 0.0, 1, 1), ("f", 1, 0.0, 1, 0), ("g", 1, 0.0, 0, 1)]
