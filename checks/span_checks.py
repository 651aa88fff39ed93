"""Span algebra: overlaps, segments, merging and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import BADGES_SQL, LINES_SQL, N, NA, TOKENS_SQL, annotations, notes, sql
from chartspan.operators import lines, ordering, spans, tokens

def joined():
    return F.array_join("questions", ";").alias("questions")

# The a1_ spans are the existing annotations, a span of 6 characters around every a1_ start of
# odd sequence number the new ones.
_NEW_SQL = """
fresh AS (SELECT 's' || ann_id AS span_id, note_id, CAST("start" + 3 + seq % 3 AS INT) AS "start", CAST("start" + 9 AS INT) AS "end", 'Q9' AS question_id
          FROM annotations WHERE ann_id LIKE 'a1%' AND seq % 2 = 1),
old AS (SELECT * FROM annotations WHERE ann_id LIKE 'a1%' OR seq % 3 = 0)"""


def fresh(spark, sf):
    return annotations(spark, sf).where("ann_id LIKE 'a1%' AND seq % 2 = 1").select(
        F.concat(F.lit("s"), "ann_id").alias("span_id"), "note_id",
        (F.col("start") + 3 + F.col("seq") % 3).cast("int").alias("start"),
        (F.col("start") + 9).alias("end"), F.lit("Q9").alias("question_id"))


def old(spark, sf):
    return annotations(spark, sf).where("ann_id LIKE 'a1%' OR seq % 3 = 0")


_OVER = 'f.note_id = o.note_id AND f."start" < o."end" AND f."end" > o."start"'
_TOUCH = 'f.note_id = o.note_id AND (f."start" = o."end" OR f."end" = o."start")'


@query("find_overlaps", sql(
    f'SELECT f.span_id, f.note_id, o.ann_id, f."start", f."end", o."start" AS b_start, o."end" AS b_end FROM fresh f, old o WHERE {_OVER}',
    *NA, _NEW_SQL))
def _(spark, sf):
    return spans.find_overlaps(fresh(spark, sf), old(spark, sf))


@query("find_adjacent", sql(
    f'SELECT f.span_id, f.note_id, o.ann_id, f."start", f."end", o."start" AS b_start, o."end" AS b_end FROM fresh f, old o '
    f"WHERE {_TOUCH} AND NOT EXISTS (SELECT 1 FROM old o2 WHERE {_OVER.replace('o.', 'o2.')})", *NA, _NEW_SQL))
def _(spark, sf):
    return spans.find_adjacent(fresh(spark, sf), old(spark, sf))


_PRIMARY_SQL = f"""
cand AS (SELECT f.span_id, o.ann_id, o.seq, 0 AS level FROM fresh f, old o WHERE {_OVER}
         UNION ALL SELECT f.span_id, o.ann_id, o.seq, 1 FROM fresh f, old o WHERE {_TOUCH}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY level, seq) AS rn FROM cand) WHERE rn = 1),
paired AS (
  SELECT f.span_id, f.note_id, f."start" AS fs, f."end" AS fe, f.question_id, b.level, o.ann_id, o.questions,
         least(f."start", o."start") AS s, greatest(f."end", o."end") AS e, n.text AS ntext
  FROM fresh f JOIN notes n USING (note_id) LEFT JOIN best b USING (span_id) LEFT JOIN old o ON o.ann_id = b.ann_id)"""
_GROWN = 'span_id, ann_id, s AS "start", e AS "end", substr(ntext, s + 1, e - s) AS text'


@query("overlap_extend", sql(f"SELECT {_GROWN}, questions FROM paired WHERE ann_id IS NOT NULL", *NA, _NEW_SQL, _PRIMARY_SQL))
def _(spark, sf):
    return spans.overlap_extend(fresh(spark, sf), old(spark, sf), notes(spark, sf)).select(
        "span_id", "ann_id", "start", "end", "text", joined())


@query("overlap_merge", sql(
    f"SELECT {_GROWN}, questions || ';Q9' AS questions FROM paired WHERE ann_id IS NOT NULL", *NA, _NEW_SQL, _PRIMARY_SQL))
def _(spark, sf):
    return spans.overlap_merge(fresh(spark, sf), old(spark, sf), notes(spark, sf)).select(
        "span_id", "ann_id", "start", "end", "text", joined())


@query("overlap_resolve", sql(
    """SELECT 'merge' AS policy, span_id, coalesce(ann_id, '-') AS ann_id, coalesce(s, fs) AS "start", coalesce(e, fe) AS "end",
         coalesce(questions || ';Q9', 'Q9') AS questions, CASE WHEN ann_id IS NULL THEN 'create' ELSE 'update' END AS action,
         coalesce(level = 1, false) AS is_adjacent FROM paired
       UNION ALL SELECT 'keep_both', span_id, '-', fs, fe, 'Q9', 'create', coalesce(level = 1, false) FROM paired
       UNION ALL SELECT 'cancel', span_id, '-', fs, fe, 'Q9', 'create', false FROM paired WHERE ann_id IS NULL""",
    *NA, _NEW_SQL, _PRIMARY_SQL))
def _(spark, sf):
    return spans.overlap_outcomes(
        fresh(spark, sf), old(spark, sf), notes(spark, sf), ("merge", "keep_both", "cancel")).select(
        "policy", "span_id", F.coalesce("ann_id", F.lit("-")).alias("ann_id"),
        "start", "end", joined(), "action", "is_adjacent")


_ISLES = """
reach AS (SELECT *, max("end") OVER (PARTITION BY note_id ORDER BY "start", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM annotations),
marked AS (SELECT *, sum(CASE WHEN r IS NULL OR "start" >= r THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY "start", seq) AS island FROM reach)"""


@query("coalesce_annotations", sql(
    """SELECT m.note_id, m."start", m."end", m.ann_id, m.n_merged, m.is_suggested, substr(n.text, m."start" + 1, m."end" - m."start") AS text, questions FROM (
         SELECT note_id, island, min("start") AS "start", max("end") AS "end", min(ann_id) AS ann_id, count(*) AS n_merged, bool_and(source = 'suggested') AS is_suggested
         FROM marked GROUP BY 1, 2) m JOIN notes n USING (note_id) JOIN (
         SELECT note_id, island, string_agg(DISTINCT q, ';' ORDER BY q) AS questions FROM (
           SELECT note_id, island, unnest(string_split(questions, ';')) AS q FROM marked) GROUP BY 1, 2) USING (note_id, island)""",
    *NA, _ISLES))
def _(spark, sf):
    return spans.coalesce_annotations(annotations(spark, sf), notes(spark, sf)).withColumn(
        "questions", F.array_join("questions", ";"))


_SEGS = """
edges AS (
  SELECT note_id, 0 AS pos FROM notes UNION SELECT note_id, CAST(length(text) AS INT) FROM notes
  UNION SELECT a.note_id, least(greatest(p, 0), length(n.text))::INT FROM (
    SELECT note_id, "start" AS p FROM annotations UNION ALL SELECT note_id, "end" FROM annotations) a JOIN notes n USING (note_id)),
segs AS (SELECT * FROM (
  SELECT note_id, pos AS "start", lead(pos) OVER (PARTITION BY note_id ORDER BY pos) AS "end",
         CAST(row_number() OVER (PARTITION BY note_id ORDER BY pos) - 1 AS INT) AS seg_no FROM edges) WHERE "end" IS NOT NULL),
covers AS (SELECT s.note_id, s.seg_no, a.ann_id, a."start" AS a_s, a."end" AS a_e, a.questions, a.source FROM segs s JOIN annotations a
           ON a.note_id = s.note_id AND a."start" <= s."start" AND a."end" >= s."end")"""


@query("distinct_edges", sql("SELECT note_id, pos FROM edges", *NA, _SEGS))
def _(spark, sf):
    return spans.distinct_edges(annotations(spark, sf), notes(spark, sf))


@query("build_segments", sql(
    """SELECT s.note_id, s.seg_no, s."start", s."end", substr(n.text, s."start" + 1, s."end" - s."start") AS text,
         CASE WHEN c.n IS NULL THEN 'plain' ELSE 'highlight' END AS kind, coalesce(c.n, 0) AS n_annotations,
         coalesce(c.ids, '') AS annotation_ids, coalesce(c.sug, false) AS is_suggested, coalesce(q.qs, '') AS questions
       FROM segs s JOIN notes n USING (note_id)
       LEFT JOIN (SELECT note_id, seg_no, count(*) AS n, string_agg(ann_id, ';' ORDER BY a_s, a_e, ann_id) AS ids, bool_or(source = 'suggested') AS sug
                  FROM covers GROUP BY 1, 2) c USING (note_id, seg_no)
       LEFT JOIN (SELECT note_id, seg_no, string_agg(DISTINCT x, ';' ORDER BY x) AS qs FROM (
                  SELECT note_id, seg_no, unnest(string_split(questions, ';')) AS x FROM covers) GROUP BY 1, 2) q USING (note_id, seg_no)""",
    *NA, _SEGS))
def _(spark, sf):
    return spans.build_segments(annotations(spark, sf), notes(spark, sf)).withColumns({
        "questions": F.array_join("questions", ";"), "annotation_ids": F.array_join("annotation_ids", ";")})


@query("segment_annotations", sql("SELECT note_id, seg_no, ann_id FROM covers", *NA, _SEGS))
def _(spark, sf):
    return spans.segment_annotations(annotations(spark, sf))


def badges(spark, sf):
    return lines.section_badges(lines.carry_sections(lines.detect_sections(lines.explode_lines(notes(spark, sf)))))


@query("badges_in_segments", sql(
    'SELECT b.note_id, b.pos, b.section, s.seg_no, s."start", s."end" FROM badges b JOIN segs s ON b.note_id = s.note_id '
    'AND b.pos >= s."start" AND b.pos < s."end"', *NA, _SEGS, LINES_SQL, BADGES_SQL))
def _(spark, sf):
    return spans.badges_in_segments(badges(spark, sf), spans.build_segments(annotations(spark, sf), notes(spark, sf)))


@query("annotations_in_sections", sql(
    """SELECT ann_id, coalesce((SELECT section FROM badges b WHERE b.note_id = a.note_id AND b.pos <= a."start" ORDER BY pos DESC LIMIT 1), 'NONE') AS section
       FROM annotations a""", *NA, LINES_SQL, BADGES_SQL))
def _(spark, sf):
    return spans.annotations_in_sections(annotations(spark, sf), badges(spark, sf)).select("ann_id", "section")


@query("distinct_sections_in_order", sql(
    "SELECT note_id, section, pos, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS section_no FROM "
    "(SELECT note_id, section, min(pos) AS pos FROM badges GROUP BY 1, 2)", N, LINES_SQL, BADGES_SQL))
def _(spark, sf):
    return ordering.distinct_sections_in_order(badges(spark, sf)).withColumn("section_no", F.col("section_no").cast("long"))


# --- token spans ---------------------------------------------------------------------------

def labelled(spark, sf):
    """Tokens with made labels: positive in every third stretch of twenty tokens."""
    t = tokens.tokenize_offsets(notes(spark, sf), ("note_id", "pos"))
    i = F.col("idx")
    positive = ((i * 7 + F.col("pos")) % 11 < 2) & (F.floor(i / 20) % 3 == 0)
    return tokens.label_tokens(
        t.withColumn("label_no", F.when(positive, 1 + i % 2).otherwise(0)), ["O", "SIZE", "LOC"])


def _chain_sql(typed):
    extra = "OR lag(label_no) OVER w <> label_no " if typed else ""
    kind = "CASE WHEN min(label_no) = 1 THEN 'SIZE' ELSE 'LOC' END" if typed else "'RADIOLOGY'"
    return f"""
runs AS (SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR idx - lag(idx) OVER w > 7 {extra}THEN 1 ELSE 0 END AS fresh FROM labelled
         WHERE label_no <> 0 WINDOW w AS (PARTITION BY note_id ORDER BY idx)),
chained AS (SELECT note_id, {kind} AS type, min("start") AS "start", max("end") AS "end" FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY note_id ORDER BY idx) AS run FROM runs) GROUP BY note_id, run)"""


@query("chain_merge_spans", sql('SELECT note_id, type, "start", "end", CAST(1 AS DOUBLE) AS confidence FROM chained',
                                N, TOKENS_SQL, _chain_sql(False)))
def _(spark, sf):
    return spans.chain_merge_spans(labelled(spark, sf)).drop("mean_prob")


def _merge_sql(source, gap, name):
    return f"""
{name}_b AS (SELECT *, sum(turn) OVER (PARTITION BY note_id ORDER BY "start", type) AS block FROM (
  SELECT *, CASE WHEN lag(type) OVER (PARTITION BY note_id ORDER BY "start", type) = type THEN 0 ELSE 1 END AS turn FROM
  (SELECT note_id, type, "start", max("end") AS "end" FROM {source} GROUP BY 1, 2, 3))),
{name}_r AS (SELECT *, max("end") OVER (PARTITION BY note_id, block ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {name}_b),
{name} AS (SELECT note_id, type, min("start") AS "start", max("end") AS "end" FROM (
  SELECT *, sum(CASE WHEN r IS NULL OR "start" - r > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY note_id, block ORDER BY "start") AS island FROM {name}_r)
  GROUP BY note_id, type, block, island)"""


@query("merge_adjacent_spans", sql('SELECT note_id, type, "start", "end" FROM merged',
                                   N, TOKENS_SQL, _chain_sql(True), _merge_sql("chained", 30, "merged")))
def _(spark, sf):
    return spans.merge_adjacent_spans(spans.chain_merge_spans(labelled(spark, sf), collapse_all=False), 30)


def _word(s, e, text="text"):
    """Columns ws, we: the span grown to white space."""
    return (f"{s} - length(regexp_extract(substr({text}, 1, {s}), '\\S*$')) AS ws, "
            f"{e} + length(regexp_extract(substr({text}, {e} + 1), '^\\S*')) AS we")


_INNER = 'spans_in AS (SELECT a.ann_id, a."start" AS s, a."end" AS e, n.text FROM annotations a JOIN notes n USING (note_id))'


@query("expand_to_word", sql(
    f'SELECT ann_id, ws AS "start", we AS "end", trim(substr(text, ws + 1, we - ws), chr(10) || \' \') AS text FROM '
    f"(SELECT *, {_word('s', 'e')} FROM spans_in)", *NA, _INNER))
def _(spark, sf):
    a = annotations(spark, sf).select("ann_id", "note_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return spans.expand_to_word(a.withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")}), notes(spark, sf)).select(
        "ann_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


_SENT = """
sent AS (SELECT *, s - length(back) + length(regexp_extract(back, '^\\s*')) AS a, e + length(regexp_extract(substr(text, e + 1), '^[^\\n.!?]*[\\n.!?]?')) AS b
  FROM (SELECT *, regexp_extract(substr(text, 1, s), '[^\\n.!?]*$') AS back FROM spans_in))"""


@query("expand_to_sentence", sql(
    f'SELECT ann_id, ws AS "start", we AS "end", trim(substr(text, ws + 1, we - ws), chr(10) || \' \') AS text FROM '
    f"(SELECT *, {_word('a', 'b')} FROM sent)", *NA, _INNER, _SENT))
def _(spark, sf):
    return spans.expand_to_sentence(annotations(spark, sf).select("ann_id", "note_id", "start", "end"), notes(spark, sf)).select(
        "ann_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


_RAD = """
rad AS (SELECT note_id, text FROM notes WHERE note_id LIKE 'RAD%' OR contains(lower(coalesce(type, '')), 'rad')
        OR contains(lower(coalesce(type, '')), 'imaging'))"""


@query("extract_radiology_entities", sql(
    'SELECT note_id, type, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM m2',
    N, TOKENS_SQL, _chain_sql(False), _RAD, _merge_sql("(SELECT chained.* FROM chained JOIN rad USING (note_id))", 120, "m1"),
    'spans_in AS (SELECT m1.note_id, m1.type, m1."start" AS s, m1."end" AS e, rad.text FROM m1 JOIN rad USING (note_id))',
    _SENT,
    f'grown AS (SELECT note_id, type, CAST(ws AS INT) AS "start", CAST(we AS INT) AS "end" FROM (SELECT *, {_word("a", "b")} FROM sent))',
    _merge_sql("grown", 0, "m2")))
def _(spark, sf):
    return spans.extract_radiology_entities(notes(spark, sf), labelled(spark, sf)).select(
        "note_id", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
