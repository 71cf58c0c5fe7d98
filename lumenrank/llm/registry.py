"""Queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.ann import nearest
from lumenrank.llm.common import documents
from lumenrank.llm.divergence import source_divergence
from lumenrank.llm.line_dedup import line_dedup_digest
from lumenrank.llm.main_text import main_text
from lumenrank.llm.mixing import mix_sources
from lumenrank.llm.near_dup import near_duplicate_classes
from lumenrank.llm.packing import pack_documents
from lumenrank.llm.pii import personal_data_digest
from lumenrank.llm.quality_crf import score_documents, train
from lumenrank.llm.substring import repeats_digest
from lumenrank.llm.syncmers import compare_with_edits
from lumenrank.llm.token_store import token_files
from lumenrank.llm.tokens import vocabulary
from lumenrank.llm.vector_codes import vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries_every=50, k=5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(documents(spark, sf_dir), window=20)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir), percent=85)


def op9_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(documents(spark, sf_dir), min_chars=10)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir), min_docs=10, top=10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_crf, op2_syncmer_fingerprints, op3_nearest_neighbours, op4_best_fit_packing, op5_source_mix, op6_token_files, op7_substring_dedup, op8_near_duplicates, op9_pii_weak_supervision, op10_line_dedup, op11_source_divergence, op12_vector_codes, op13_main_text)}

SQL: dict[str, str] = {}

SQL["op5_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
total AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM weighted),
-- sources by the level at which they reach their cap: the level is right where it lies at or below the next one's
steps AS (
  SELECT source, cap / w AS own, coalesce(sum(cap) OVER o, 0) AS capped, sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM weighted WINDOW o AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (budget - capped) / free AS level FROM steps, total WHERE (budget - capped) / free <= own ORDER BY own, source LIMIT 1),
targets AS (SELECT source, source_size, least(w * level, cap) AS target FROM weighted, level),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM targets),
parts AS (SELECT *, target - whole * source_size AS rest FROM whole),
hashes AS (SELECT source, h, sum(size) AS n FROM sized GROUP BY source, h),
running AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes)
SELECT s.doc_id, s.size, p.source_size, p.target,
  CAST(s.size * (p.whole + CASE WHEN p.whole < 2 AND (r.upto <= p.rest OR (r.upto - r.n <= p.rest AND r.upto - p.rest < p.rest - (r.upto - r.n))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source JOIN running r ON s.source IS NOT DISTINCT FROM r.source AND s.h = r.h
"""

SQL["op7_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS i, words FROM w WHERE len(words) >= 20),
keyed AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS k FROM win),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM late, generate_series(0, 19) AS t(j)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS kept, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

SQL["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
judged AS (SELECT doc_id, pos, line, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op8_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM w, generate_series(1, greatest(1, len(words) - 4)) AS t(i)
  WHERE len(words) > 0),
n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM reach r JOIN edges e ON r.u = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.u) AS component_id, n.doc_id = min(r.u) AS kept FROM n JOIN reach r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""

SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
each AS (SELECT r, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM each GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS size FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (
  SELECT g.lang, g.source, sum(c.n) AS size FROM groups g JOIN kept k ON g.lang = k.lang JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term GROUP BY g.lang, g.source),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // CAST(coalesce(s.size, 0) + 2 * l.terms AS HUGEINT) AS HUGEINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * CAST(k.n + 2 AS HUGEINT)) // CAST(l.size + 2 * l.terms AS HUGEINT) AS HUGEINT) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _codebook_round(i: int) -> str:
    """DuckDB SQL of codebooks c{i} from c{i - 1}; a whole-number key holds the distance and, below it, the entry."""
    return f"""
a{i} AS (
  SELECT r, part, min(d * 64 + entry) AS nearest FROM (
    SELECT e.r, e.part, c.entry, CAST(sum((e.v - c.v) * (e.v - c.v)) AS BIGINT) AS d FROM e JOIN c{i - 1} c ON e.part = c.part AND e.pos = c.pos GROUP BY e.r, e.part, c.entry) GROUP BY r, part),
m{i} AS (
  SELECT e.part, a.nearest % 64 AS entry, e.pos, CAST(sum(e.v) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{i} a ON e.r = a.r AND e.part = a.part GROUP BY e.part, a.nearest % 64, e.pos),
c{i} AS (
  SELECT c.part, c.entry, c.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v) AS v FROM c{i - 1} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos),"""


SQL["op12_vector_codes"] = f"""
WITH n AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT r, len(embedding) AS dims, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM n),
odd AS (SELECT DISTINCT r FROM x WHERE x IS NULL OR NOT isfinite(x)),
k AS (SELECT r, vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM n WHERE r NOT IN (SELECT r FROM odd)),
e AS (SELECT k.r, CAST(i // (dims // 16) AS BIGINT) AS part, CAST(i % (dims // 16) AS BIGINT) AS pos, CAST(floor(256 * x) AS BIGINT) AS v FROM x JOIN k ON x.r = k.r),
c0 AS (SELECT e.part, k.entry, e.pos, e.v FROM e JOIN k ON e.r = k.r WHERE k.entry < 64),{"".join(map(_codebook_round, (1, 2, 3)))}
coded AS (
  SELECT r, string_agg(printf('%02x', nearest % 64), '' ORDER BY part) AS code, CAST(sum(nearest // 64) AS BIGINT) AS error FROM a3 GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS digest FROM c2)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.digest AS codebooks_sha256 FROM coded c JOIN k ON c.r = k.r, books b
"""
