"""Notes, rules and annotations derived from the driver's tables, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.functions import vocab
from chartspan.operators.rules import Rule, default_rules

TERMS = [("Q1", "the "), ("Q2", " und "), ("Q3", " pour "), ("Q4", " de "), ("Q5", "tion")]
REGEXES = [("Q6", r"\d+\s*mm\b"), ("Q7", r"[a-z]+ment\b"), ("Q8", r"\d+")]
RULES = [Rule(q, "term", p) for q, p in TERMS]
ALL_RULES = RULES + [Rule(q, "regex", p) for q, p in REGEXES]
CLINICAL_RULES = default_rules()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def notes(spark: SparkSession, sf: str, gap: str = "\n") -> DataFrame:
    """One note per document with three header lines; ``gap`` replaces the line feeds."""
    d = F.col("doc_id")
    kind = F.when(d % 5 == 0, "RAD").when(d % 5 == 1, "ED").when(d % 5 == 2, "OP").otherwise("OUT")
    g = F.lit(gap)
    return documents(spark, sf).select(
        F.concat(kind, F.lit(".IDX."), F.lpad(d.cast("string"), 6, "0")).alias("note_id"),
        F.concat(
            F.lit("HPI:"), g, F.substring("text", 1, 400), g, g,
            F.lit("MEDICATIONS:"), g, F.substring("text", 401, 400), g, g,
            F.lit("PLAN:"), g, F.substring("text", 801, 1 << 30),
        ).alias("text"),
        F.when(d % 11 != 0, F.col("source")).alias("type"),
        F.col("lang").alias("date"),
        F.concat("source", F.lit(".txt")).alias("source"),
        F.col("text").alias("raw_text"),
        d.alias("pos"),
    )


NOTES_SQL = """
notes AS (
  SELECT concat(CASE WHEN doc_id % 5 = 0 THEN 'RAD' WHEN doc_id % 5 = 1 THEN 'ED' WHEN doc_id % 5 = 2 THEN 'OP' ELSE 'OUT' END,
                '.IDX.', lpad(CAST(doc_id AS VARCHAR), 6, '0')) AS note_id,
         concat('HPI:', chr(10), substr(text, 1, 400), chr(10), chr(10), 'MEDICATIONS:', chr(10), substr(text, 401, 400),
                chr(10), chr(10), 'PLAN:', chr(10), substr(text, 801)) AS text,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS type,
         lang AS date, concat(source, '.txt') AS source, text AS raw_text, doc_id AS pos
  FROM documents)"""

RULES_SQL = """
rules AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{q}', '{p}', {i})" for i, (q, p) in enumerate(TERMS)) + """) AS r(question_id, pattern, no))"""


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """First occurrence of each term as one annotation, and a second, shifted one on even notes."""
    rules = F.array(*[F.struct(
        F.lit(q).alias("q"), F.lit(p).alias("p"), F.lit(i).alias("no")) for i, (q, p) in enumerate(TERMS)])
    base = (
        notes(spark, sf).select("note_id", "text", "pos", F.lower("text").alias("low"))
        .withColumn("r", F.explode(F.filter(rules, lambda r: F.contains(F.col("low"), r["p"]))))
        .withColumn("at", F.instr(F.col("low"), F.col("r.p")))
        .drop("low")
    )
    size = F.length("r.p")
    seq = F.col("pos") * 16 + F.col("r.no")
    stamp = lambda s: F.timestamp_millis(F.lit(1_700_000_000_000) + s * 1234)
    first = base.select(
        F.concat(F.lit("a1_"), "note_id", F.lit("_"), "r.q").alias("ann_id"),
        "note_id",
        (F.col("at") - 1).alias("start"),
        (F.col("at") - 1 + size).alias("end"),
        F.substring("text", F.col("at"), size).alias("text"),
        F.when(F.col("pos") % 7 == 0, F.array(F.col("r.q"), F.lit("Q10"))).otherwise(F.array("r.q")).alias("questions"),
        F.when(F.col("pos") % 4 == 0, "check").when(F.col("pos") % 4 == 1, "  ").alias("comment"),
        stamp(seq).alias("created_at"),
        F.when(F.col("pos") % 3 == 0, "suggested").otherwise("manual").alias("source"),
        seq.alias("seq"),
    )
    second = base.where((F.col("pos") % 2 == 0) & (F.col("at") + 13 <= F.length("text"))).select(
        F.concat(F.lit("a2_"), "note_id", F.lit("_"), "r.q").alias("ann_id"),
        "note_id",
        (F.col("at") + 1).alias("start"),
        (F.col("at") + 13).alias("end"),
        F.substring("text", F.col("at") + 2, F.lit(12)).alias("text"),
        F.array(F.lit("Q6")).alias("questions"),
        F.lit(None).cast("string").alias("comment"),
        stamp(seq + 8).alias("created_at"),
        F.lit("suggested").alias("source"),
        (seq + 8).alias("seq"),
    )
    return first.unionByName(second)


ANNOTATIONS_SQL = """
annotations AS (
  SELECT *, epoch_ms(1700000000000 + seq * 1234) AS created_at FROM (
    SELECT concat('a1_', n.note_id, '_', r.question_id) AS ann_id, n.note_id,
           CAST(instr(lower(n.text), r.pattern) - 1 AS INT) AS "start",
           CAST(instr(lower(n.text), r.pattern) - 1 + length(r.pattern) AS INT) AS "end",
           substr(n.text, instr(lower(n.text), r.pattern), length(r.pattern)) AS text,
           CASE WHEN n.pos % 7 = 0 THEN concat(r.question_id, ';Q10') ELSE r.question_id END AS questions,
           CASE WHEN n.pos % 4 = 0 THEN 'check' WHEN n.pos % 4 = 1 THEN '  ' END AS comment,
           CASE WHEN n.pos % 3 = 0 THEN 'suggested' ELSE 'manual' END AS source,
           n.pos * 16 + r.no AS seq
    FROM notes n, rules r WHERE instr(lower(n.text), r.pattern) > 0
    UNION ALL
    SELECT concat('a2_', n.note_id, '_', r.question_id), n.note_id,
           CAST(instr(lower(n.text), r.pattern) + 1 AS INT), CAST(instr(lower(n.text), r.pattern) + 13 AS INT),
           substr(n.text, instr(lower(n.text), r.pattern) + 2, 12), 'Q6', NULL, 'suggested', n.pos * 16 + r.no + 8
    FROM notes n, rules r WHERE instr(lower(n.text), r.pattern) > 0 AND n.pos % 2 = 0
                            AND instr(lower(n.text), r.pattern) + 13 <= length(n.text)))"""

QUESTIONS_SQL = """
questions AS (SELECT * FROM (VALUES ('Q1','Symptoms','#b45309'), ('Q2','Progression','#be123c'), ('Q3','Rare Disease','#7c3aed'),
  ('Q4','SDOH','#a21caf'), ('Q5','Devices','#1d4ed8'), ('Q6','Radiology','#0f766e'), ('Q7','Diet Advice','#4d7c0f'),
  ('Q8','ER Visit','#c2410c'), ('Q9','Post-op Complication','#b91c1c'), ('Q10','Stone Passage','#4338ca')) AS q(question_id, name, color))"""

# Every occurrence of every term. The padded terms can share a blank with the next occurrence,
# so their cores are located first and the full term is checked around each.
MATCHES_SQL = """
cores AS (
  SELECT n.note_id, n.pos, n.text, lower(n.text) AS low, r.question_id, r.pattern, trim(r.pattern) AS core,
         CASE WHEN r.pattern LIKE ' %' THEN 1 ELSE 0 END AS pad
  FROM notes n, rules r WHERE contains(lower(n.text), r.pattern)),
cut AS (
  SELECT *, string_split(low, core) AS parts FROM cores),
spots AS (
  SELECT note_id, pos, text, low, question_id, pattern, pad, core, i,
         list_sum(list_transform(parts[1:i], lambda x: length(x)))::INT + (i - 1) * length(core) AS hit_at
  FROM cut, unnest(range(1, len(parts))) AS u(i)),
hits AS (
  SELECT note_id, pos, text, question_id, pattern, CAST(hit_at - pad AS INT) AS "start",
         CAST(hit_at - pad + length(pattern) AS INT) AS "end"
  FROM spots WHERE hit_at - pad >= 0 AND substr(low, hit_at - pad + 1, length(pattern)) = pattern),
matches AS (
  SELECT note_id, pos, question_id, "start", "end", substr(text, "start" + 1, "end" - "start") AS term FROM hits)"""

# Every match of every expression: the text between matches and the matches alternate.
REGEX_SQL = """
rx AS (SELECT * FROM (VALUES """ + ", ".join(f"('{q}', '{p}')" for q, p in REGEXES) + """) AS r(question_id, pattern)),
rx_cut AS (
  SELECT n.note_id, n.text, r.question_id, regexp_extract_all(n.text, '(?i)' || r.pattern) AS found,
         regexp_split_to_array(n.text, '(?i)' || r.pattern) AS gaps
  FROM notes n, rx r WHERE regexp_matches(n.text, '(?i)' || r.pattern)),
rx_hits AS (
  SELECT note_id, question_id, found[i] AS term,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS INT) AS "start"
  FROM rx_cut, unnest(range(1, len(found) + 1)) AS u(i)),
regex_matches AS (
  SELECT note_id, question_id, term, "start", CAST("start" + length(term) AS INT) AS "end" FROM rx_hits)"""


def _ws(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def section_case(line: str) -> str:
    bare = _ws(f"regexp_replace(lower({line}), ':$', '')")
    whens = " ".join(
        f"WHEN regexp_matches(bare, '^(?:{p})\\s*:?$') THEN '{n}'" for n, p in vocab.SECTION_PATTERNS)
    return bare, f"CASE {whens} ELSE 'NONE' END"


_BARE, _SECTION = section_case("line")

# Lines with offsets, the section each names and the one it inherits.
LINES_SQL = f"""
line_parts AS (SELECT note_id, pos, string_split(text, chr(10)) AS parts FROM notes),
raw_lines AS (
  SELECT note_id, pos, CAST(i - 1 AS INT) AS line_no, parts[i] AS line, length(parts[i]) AS size FROM line_parts, unnest(range(1, len(parts) + 1)) AS u(i)),
placed AS (
  SELECT *, CAST(sum(size + 1) OVER (PARTITION BY note_id ORDER BY line_no) - size - 1 AS INT) AS "start", {_BARE} AS bare FROM raw_lines),
lines AS (SELECT *, {_SECTION} AS section FROM placed),
carried AS (
  SELECT *, coalesce(last_value(CASE WHEN section <> 'NONE' THEN section END IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY line_no), 'NONE') AS carried
  FROM lines)"""

BADGES_SQL = f"""
badges AS (SELECT note_id, CAST("start" + length(line) - length(ltrim(line)) AS INT) AS pos, carried AS section FROM (
  SELECT *, lag(carried) OVER (PARTITION BY note_id ORDER BY line_no) AS prior FROM carried WHERE {_ws('line')} <> '')
  WHERE carried <> 'NONE' AND prior IS DISTINCT FROM carried)"""

TOKENS_SQL = """
tok_cut AS (SELECT note_id, pos, text, regexp_extract_all(text, '\\S+') AS found, regexp_split_to_array(text, '\\S+') AS gaps FROM notes),
tok_parts AS (SELECT note_id, pos, i, found[i] AS token, length(gaps[i]) AS gap FROM tok_cut, unnest(range(1, len(found) + 1)) AS u(i)),
toks AS (
  SELECT note_id, pos, CAST(i - 1 AS INT) AS idx, token,
         CAST(sum(gap + length(token)) OVER (PARTITION BY note_id ORDER BY i) - length(token) AS INT) AS "start",
         CAST(sum(gap + length(token)) OVER (PARTITION BY note_id ORDER BY i) AS INT) AS "end"
  FROM tok_parts),
labelled AS (SELECT *, CASE WHEN (idx * 7 + pos) % 11 < 2 AND (idx // 20) % 3 = 0 THEN 1 + idx % 2 ELSE 0 END AS label_no FROM toks)"""




def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


N = NOTES_SQL
NR = (NOTES_SQL, RULES_SQL)
NA = (NOTES_SQL, RULES_SQL, ANNOTATIONS_SQL)
NAQ = NA + (QUESTIONS_SQL,)
NM = (NOTES_SQL, RULES_SQL, MATCHES_SQL)
