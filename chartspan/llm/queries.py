"""Registered queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.llm import (alignment, decontaminate, divergence, html, language, licenses, linededup, mixing, mtree, pii, simhash, toxicity,
                           urlfilter)
from chartspan.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold_is(part: int, parts: int) -> Column:
    """Whether a document is held out; rows without an id never are."""
    return F.coalesce(fold(F.col("doc_id"), parts) == part, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Model of the documents outside the held-out quarter."""
    return toxicity.fit(docs, labels.where(~_fold_is(2, 4)))


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", _fold_is(2, 4).alias("held_out"),
                         toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~_fold_is(1, 3)))
    judged = docs.select("doc_id", _fold_is(1, 3).alias("held_out"), language.predict(F.col("text"), model).alias("p"))
    return judged.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@_query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLES["op3_source_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3] AS weight
  FROM sizes GROUP BY source),
tried AS (
  SELECT a.weight AS w,
         1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)
           - 2 * COALESCE((SELECT sum(b.source_size) FROM weighed b WHERE b.source_size / b.weight < a.source_size / a.weight), 0) AS words,
         (SELECT sum(weight) FROM weighed)
           - COALESCE((SELECT sum(b.weight) FROM weighed b WHERE b.source_size / b.weight < a.source_size / a.weight), 0) AS weights,
         a.source_size AS source_size
  FROM weighed a),
filling AS (
  SELECT words, weights FROM tried WHERE w * words <= 2 * source_size * weights ORDER BY weights DESC LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN weight * f.words <= 2 * source_size * f.weights THEN weight * f.words / f.weights
              ELSE 2.0::DOUBLE * source_size END AS target
  FROM weighed LEFT JOIN filling f ON true),
expected AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, 1.0::DOUBLE * t.target / t.source_size) ELSE 0 END AS e,
         (('0x' || substr(md5(s.doc_id || '/mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / (1::BIGINT << 48) AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, floor(e) AS certain, CASE WHEN e > floor(e) AND size > 0
         THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q,
         target - sum(floor(e) * size) OVER (PARTITION BY source) AS missing FROM expected),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked),
taken AS (
  SELECT *, (certain + CASE WHEN q IS NOT NULL AND missing > 0 AND upto - size / 2.0::DOUBLE < missing THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM summed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM taken
"""


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "n", "containment")


ORACLES["op4_benchmark_decontamination"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
tokens AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM texts),
shingles AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i + 4], ' '))) AS shingle
  FROM tokens WHERE len(t) > 0),
sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'i'),
shared AS (
  SELECT d.id AS doc_id, s.id AS item_id, count(*) AS shared, any_value(s.n) AS n
  FROM shingles d JOIN sized s USING (shingle) WHERE d.kind = 'd' GROUP BY d.id, s.id)
SELECT doc_id, item_id, shared, n, shared / n AS containment FROM shared WHERE shared >= ceil(n * 0.8::DOUBLE - 1e-9)
"""


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    found = licenses.scan(docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text"))
    doc_id = F.substring_index("path", "/", -1).cast("long")
    return found.select(doc_id.alias("doc_id"), "path", "license", F.round("cosine", 6).alias("cosine"), "basis", "directory")


ORACLES["op5_license_scan"] = r"""
WITH templates(license, text) AS (VALUES """ + ", ".join(
    "('" + name + "', '" + text.replace("'", "''") + "')" for name, text in licenses.TEMPLATES) + r"""),
files AS (
  SELECT doc_id, COALESCE(source, 'none') AS s, COALESCE(lang, 'none') AS l, text FROM documents WHERE doc_id IS NOT NULL),
cued AS (SELECT * FROM files WHERE regexp_matches(text, '""" + licenses.CUE + r"""')),
passages AS (
  SELECT DISTINCT doc_id, false AS whole, trim(line) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM cued) WHERE regexp_matches(line, '""" + licenses.CUE + r"""')
  UNION SELECT doc_id, true, trim(text) FROM cued),
found AS (
  SELECT text, term, count(*) AS tf FROM (
    SELECT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:\.[\p{N}]+)*')) AS term FROM (SELECT DISTINCT text FROM passages))
  GROUP BY ALL),
known AS (
  SELECT text, term, count(*) AS tf FROM (
    SELECT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:\.[\p{N}]+)*')) AS term FROM (SELECT DISTINCT text FROM templates))
  GROUP BY ALL),
size AS (
  SELECT (SELECT count(DISTINCT text) FROM passages) + (SELECT count(DISTINCT text) FROM templates) + 1.0::DOUBLE AS n),
idf AS (
  SELECT term, ln((SELECT n FROM size) / (1 + count(*))) + 1 AS idf
  FROM (SELECT term FROM found WHERE term IN (SELECT term FROM known) UNION ALL SELECT term FROM known) GROUP BY term),
weighed AS (SELECT k.text, k.term, k.tf * i.idf AS w FROM known k JOIN idf i USING (term)),
vectors AS (
  SELECT t.license, w.text AS template, w.term, w.w / sqrt(sum(w.w * w.w) OVER (PARTITION BY t.license, w.text)) AS w
  FROM weighed w JOIN templates t USING (text)),
own AS (
  SELECT f.text, f.term, f.tf * COALESCE(i.idf, ln((SELECT n FROM size)) + 1) AS v FROM found f LEFT JOIN idf i USING (term)),
norms AS (SELECT text, sqrt(sum(v * v)) AS norm FROM own GROUP BY text),
dots AS (
  SELECT o.text, v.license, v.template, sum(o.v * v.w) AS dot FROM own o JOIN vectors v USING (term) GROUP BY ALL),
scored AS (
  SELECT text, license, round(dot / norm, 9) AS cosine,
         row_number() OVER (PARTITION BY text ORDER BY round(dot / norm, 9) DESC, license) AS rank FROM dots JOIN norms USING (text)),
hits AS (
  SELECT p.doc_id, p.whole AND c.cosine >= 0.9 AS whole, c.license, c.cosine,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY c.cosine DESC, c.license) AS rank
  FROM passages p JOIN scored c USING (text) WHERE c.rank = 1 AND c.cosine >= 0.6),
licensed AS (
  SELECT h.doc_id, h.license, h.cosine, CASE WHEN w.whole THEN 'file' ELSE 'header' END AS basis
  FROM hits h JOIN (SELECT doc_id, bool_or(whole) AS whole FROM hits GROUP BY doc_id) w USING (doc_id) WHERE h.rank = 1),
given AS (
  SELECT f.s || '/' || f.l AS directory, o.license, o.cosine,
         row_number() OVER (PARTITION BY f.s, f.l ORDER BY o.cosine DESC, o.license) AS rank
  FROM licensed o JOIN files f USING (doc_id) WHERE o.basis = 'file')
SELECT f.doc_id, f.s || '/' || f.l || '/' || f.doc_id AS path, COALESCE(o.license, g.license) AS license,
       round(COALESCE(o.cosine, g.cosine), 6) AS cosine,
       COALESCE(o.basis, CASE WHEN g.license IS NULL THEN 'none' ELSE 'inherited' END) AS basis,
       CASE WHEN o.license IS NULL THEN g.directory END AS directory
FROM files f LEFT JOIN licensed o USING (doc_id) LEFT JOIN given g ON g.rank = 1 AND g.directory = f.s || '/' || f.l
"""


@_query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"), width=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


@_query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.quantised(_table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op7_exact_top_k"] = r"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    texts = pages.select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


ORACLES["op9_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, COALESCE(rest, '') AS rest, regexp_extract(COALESCE(rest, ''), '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS rank
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM fits WHERE rank = 1
"""


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.find(F.col("text"), pii.telling_terms(docs)).alias("f"))
    return found.select("doc_id", *[f"f.n_{k}" for k in pii.KINDS],
                        F.sha2(F.col("f.base"), 256).alias("base_sha256"), "f.spans")


@_query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = linededup.drop_repeated(docs, min_docs=10, min_chars=1)
    return cut.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY r, doc_id
"""


@_query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"), min_docs=3, top=200)


ORACLES["op12_source_audit"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, COALESCE(text, '') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sized AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term
  GROUP BY w.lang, w.source, w.term),
totals AS (
  SELECT s.lang, s.source, COALESCE(sum(c.c), 0)::HUGEINT AS n FROM sources s LEFT JOIN cells c USING (lang, source) GROUP BY s.lang, s.source),
shares AS (
  SELECT k.lang, t.source, k.term, COALESCE(c.c, 0) AS c,
         1 + 1000000000::HUGEINT * (COALESCE(c.c, 0) + 1) // (t.n + s.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 1) // (s.n + s.v) AS q
  FROM kept k JOIN sized s USING (lang) JOIN totals t USING (lang)
  LEFT JOIN cells c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C")::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@_query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tokenizers; held against a plain Python version."""
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents").select("doc_id", "text"))
