"""Annotation filters, edits, joins, statistics and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import N, NA, NAQ, annotations, notes, sql, table
from chartspan.operators import annotations as ann
from chartspan.operators import changes, ordering, stats
from chartspan.operators.rules import questions_table
from chartspan.sources import sinks

def joined():
    return F.array_join("questions", ";").alias("questions")
BASE = 'ann_id, note_id, "start", "end", text, questions, comment, source'


def flat(df):
    """The comparable columns of annotations."""
    return df.select("ann_id", "note_id", "start", "end", "text", joined(), "comment", "source")


def ids(df, condition):
    return df.where(condition).select("ann_id")


# --- filters -------------------------------------------------------------------------------

@query("filter_ann_source", sql(
    "SELECT ann_id, 'auto' AS kind FROM annotations WHERE source = 'suggested' UNION ALL "
    "SELECT ann_id, 'manual' FROM annotations WHERE source <> 'suggested'", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    return ann.filter_ann_source(a, "auto").select("ann_id", F.lit("auto").alias("kind")).unionByName(
        ann.filter_ann_source(a, "manual").select("ann_id", F.lit("manual").alias("kind")))


@query("filter_ann_comment", sql(
    "SELECT ann_id, coalesce(trim(comment), '') <> '' AS has FROM annotations", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    return ann.filter_ann_comment(a, "with").select("ann_id", F.lit(True).alias("has")).unionByName(
        ann.filter_ann_comment(a, "without").select("ann_id", F.lit(False).alias("has")))


@query("filter_ann_question", sql(
    f"SELECT {BASE} FROM annotations WHERE list_contains(string_split(questions, ';'), 'Q10')", *NA))
def _(spark, sf):
    return flat(ann.filter_ann_question(annotations(spark, sf), "Q10"))


@query("search_annotations", sql(
    f"SELECT {BASE} FROM annotations WHERE contains(lower(text), 'he') OR contains(lower(coalesce(comment, '')), 'he')", *NA))
def _(spark, sf):
    return flat(ann.search_annotations(annotations(spark, sf), "HE"))


# --- joins ---------------------------------------------------------------------------------

def context(k, alias="j", text="note_text"):
    s, e = f'{alias}."start"', f'{alias}."end"'
    return (f"substr({text}, greatest({s} - {k}, 0) + 1, {s} - greatest({s} - {k}, 0)) AS context_before, "
            f"substr({text}, {e} + 1, {k}) AS context_after")


_KEPT = "kept AS (SELECT * FROM notes WHERE pos % 6 <> 1)"


def kept(spark, sf):
    return notes(spark, sf).where("pos % 6 <> 1")


@query("join_annotations_notes", sql(
    "SELECT a.ann_id, a.note_id, n.type AS note_type, length(n.text) AS size FROM annotations a JOIN kept n USING (note_id)",
    *NA, _KEPT))
def _(spark, sf):
    return ann.join_annotations_notes(annotations(spark, sf), kept(spark, sf)).select(
        "ann_id", "note_id", "note_type", F.length("note_text").cast("long").alias("size"))


@query("join_annotations_notes_left", sql(
    f"SELECT ann_id, type AS note_type, {context(40, 'j', 'coalesce(ntext, chr(0))')} FROM "
    "(SELECT a.*, n.type, n.text AS ntext FROM annotations a JOIN kept n USING (note_id)) j UNION ALL "
    "SELECT ann_id, NULL, '', '' FROM annotations WHERE note_id NOT IN (SELECT note_id FROM kept)", *NA, _KEPT))
def _(spark, sf):
    return ann.join_annotations_notes_left(annotations(spark, sf), kept(spark, sf)).select(
        "ann_id", "note_type", "context_before", "context_after")


@query("annotation_context", sql(
    f"SELECT ann_id, {context(25)} FROM (SELECT a.*, n.text AS note_text FROM annotations a JOIN kept n USING (note_id)) j",
    *NA, _KEPT))
def _(spark, sf):
    return ann.annotation_context(annotations(spark, sf), kept(spark, sf), 25).select(
        "ann_id", "context_before", "context_after")


@query("annotations_with_questions", sql(
    "SELECT ann_id, e.question_id, coalesce(q.name, e.question_id) AS name, q.color FROM "
    "(SELECT ann_id, unnest(string_split(questions, ';')) AS question_id FROM annotations) e "
    "LEFT JOIN (SELECT * FROM questions WHERE question_id <> 'Q5') q USING (question_id)", *NAQ))
def _(spark, sf):
    q = questions_table(spark).where("question_id <> 'Q5'")
    return ann.annotations_with_questions(annotations(spark, sf), q).select(
        "ann_id", "question_id", "name", "color")


@query("annotated_notes", sql(
    "SELECT note_id FROM notes WHERE note_id IN (SELECT note_id FROM annotations WHERE source = 'manual')", *NA))
def _(spark, sf):
    return ann.annotated_notes(notes(spark, sf), annotations(spark, sf).where("source = 'manual'")).select("note_id")


@query("unannotated_notes", sql(
    "SELECT note_id FROM notes WHERE note_id NOT IN (SELECT note_id FROM annotations WHERE source = 'manual')", *NA))
def _(spark, sf):
    return ann.unannotated_notes(notes(spark, sf), annotations(spark, sf).where("source = 'manual'")).select("note_id")


@query("orphan_annotations", sql(
    f"SELECT {BASE} FROM annotations WHERE note_id NOT IN (SELECT note_id FROM kept)", *NA, _KEPT))
def _(spark, sf):
    return flat(ann.orphan_annotations(annotations(spark, sf), kept(spark, sf)))


@query("complete_questions", sql(
    "SELECT question_id, name, color FROM questions WHERE question_id NOT IN ('Q5', 'Q10') UNION ALL "
    "SELECT DISTINCT question_id, question_id, '#78716c' FROM (SELECT unnest(string_split(questions, ';')) AS question_id "
    "FROM annotations) WHERE question_id IN ('Q5', 'Q10')", *NAQ))
def _(spark, sf):
    q = questions_table(spark).where("question_id NOT IN ('Q5', 'Q10')")
    return ann.complete_questions(q, annotations(spark, sf)).select("question_id", "name", "color")


# --- edits ---------------------------------------------------------------------------------

_NEW = "SELECT note_id, 0 AS \"start\", 3 AS \"end\", substr(text, 1, 3) AS text, 'Q1;Q2' AS questions"


def new_spans(spark, sf):
    return notes(spark, sf).select(
        "note_id", F.lit(0).alias("start"), F.lit(3).alias("end"), F.substring("text", 1, 3).alias("text"),
        F.array(F.lit("Q1"), F.lit("Q2")).alias("questions"), F.lit(None).cast("string").alias("comment"),
        F.when(F.col("pos") % 2 == 0, "suggested").alias("source"))


def added(df):
    return df.select("note_id", "start", "end", "text", joined(), "source")


@query("add_annotations", sql(
    'SELECT note_id, "start", "end", text, questions, source FROM annotations UNION ALL '
    + _NEW + ", CASE WHEN pos % 2 = 0 THEN 'suggested' ELSE 'manual' END FROM notes", *NA))
def _(spark, sf):
    return added(ann.add_annotations(annotations(spark, sf), new_spans(spark, sf)))


@query("add_suggested_annotations", sql(
    'SELECT note_id, "start", "end", text, questions, source FROM annotations UNION ALL '
    + _NEW + ", 'suggested' FROM notes", *NA))
def _(spark, sf):
    return added(ann.add_suggested_annotations(annotations(spark, sf), new_spans(spark, sf)))


@query("remove_annotations", sql(f"SELECT {BASE} FROM annotations WHERE seq % 3 <> 0", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    return flat(ann.remove_annotations(a, ids(a, "seq % 3 = 0")))


@query("update_annotations", sql(
    "SELECT ann_id, note_id, CASE WHEN seq % 3 = 0 THEN \"start\" + 1 ELSE \"start\" END AS \"start\", \"end\", text, questions, "
    "CASE WHEN seq % 3 = 0 THEN 'seen' ELSE comment END AS comment, source FROM annotations", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    patch = a.where("seq % 3 = 0").select("ann_id", (F.col("start") + 1).alias("start"), F.lit("seen").alias("comment"))
    return flat(ann.update_annotations(a, patch))


@query("add_question_to_ann", sql(
    "SELECT ann_id, CASE WHEN seq % 3 = 0 AND NOT list_contains(string_split(questions, ';'), 'Q6') "
    "THEN questions || ';Q6' ELSE questions END AS questions FROM annotations", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    return ann.add_question_to_ann(a, "Q6", ids(a, "seq % 3 = 0")).select("ann_id", joined())


@query("remove_question_from_ann", sql(
    "SELECT ann_id, CASE WHEN questions LIKE '%;Q10' THEN replace(questions, ';Q10', '') ELSE questions END AS questions "
    "FROM annotations", *NA))
def _(spark, sf):
    return ann.remove_question_from_ann(annotations(spark, sf), "Q10").select("ann_id", joined())


@query("set_comment", sql(
    "SELECT ann_id, CASE WHEN seq % 5 = 0 THEN 'ok' WHEN seq % 5 = 1 THEN NULL ELSE comment END AS comment FROM annotations", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    new = a.where("seq % 5 < 2").select("ann_id", F.when(F.col("seq") % 5 == 0, "  ok ").otherwise(" ").alias("comment"))
    return ann.set_comment(a, new).select("ann_id", "comment")


@query("promote_annotations", sql(
    "SELECT ann_id, CASE WHEN seq % 2 = 0 THEN 'manual' ELSE source END AS source FROM annotations", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    return ann.promote_annotations(a, ids(a, "seq % 2 = 0")).select("ann_id", "source")


@query("resize_annotations", sql(
    """SELECT ann_id, s AS "start", e AS "end", substr(ntext, s + 1, e - s) AS text FROM (
         SELECT ann_id, ntext, s, least(greatest(e0, s + 1), length(ntext))::INT AS e FROM (
           SELECT a.ann_id, n.text AS ntext, greatest(0, least(a."start" - 5, length(n.text) - 1))::INT AS s, a."end" + 100000 * (a.seq % 2) AS e0
           FROM annotations a JOIN notes n USING (note_id) WHERE a.seq % 3 = 0))
       UNION ALL SELECT ann_id, "start", "end", text FROM annotations WHERE seq % 3 <> 0""", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    moved = a.where("seq % 3 = 0").select(
        "ann_id", (F.col("start") - 5).alias("start"), (F.col("end") + 100000 * (F.col("seq") % 2)).cast("int").alias("end"))
    return ann.resize_annotations(a, notes(spark, sf), moved).select("ann_id", "start", "end", "text")


@query("clear_note_annotations", sql(f"SELECT {BASE} FROM annotations WHERE note_id NOT LIKE 'ED%'", *NA))
def _(spark, sf):
    return flat(ann.clear_note_annotations(annotations(spark, sf), notes(spark, sf).where("note_id LIKE 'ED%'")))


@query("clear_suggested", sql(f"SELECT {BASE} FROM annotations WHERE source <> 'suggested'", *NA))
def _(spark, sf):
    return flat(ann.clear_suggested(annotations(spark, sf)))


@query("clear_all", sql("SELECT count(*) - count(*) AS n FROM annotations", *NA))
def _(spark, sf):
    return ann.clear_all(annotations(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query("union_notes", sql(
    "SELECT note_id, pos FROM notes WHERE pos % 6 <> 1 UNION ALL SELECT note_id, pos FROM notes WHERE pos % 6 = 1", N))
def _(spark, sf):
    return ann.union_notes(kept(spark, sf), notes(spark, sf).where("pos % 6 = 1")).select("note_id", "pos")


@query("union_annotations", sql("SELECT ann_id FROM annotations UNION ALL SELECT ann_id || 'x' FROM annotations", *NA))
def _(spark, sf):
    a = annotations(spark, sf)
    return ann.union_annotations(a, a.withColumn("ann_id", F.concat("ann_id", F.lit("x")))).select("ann_id")


# --- change log ----------------------------------------------------------------------------

def change_log(spark, sf):
    """Events as changes: error removes, anything else adds or updates the annotation of a user."""
    e = table(spark, sf, "events")
    image = F.struct(
        F.concat(F.lit("ann_"), F.col("user_id").cast("string")).alias("ann_id"),
        F.col("event_type").alias("comment"), F.col("value").alias("value"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "add")
        .otherwise("update").alias("op"),
        F.concat(F.lit("ann_"), F.col("user_id").cast("string")).alias("ann_id"),
        image.alias("after"))


def _fold_sql(where):
    return f"""SELECT 'ann_' || CAST(user_id AS VARCHAR) AS ann_id, event_id AS seq, event_type AS comment FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE {where})
    WHERE rn = 1 AND event_type <> 'error'"""


@query("fold_changes", _fold_sql("true"))
def _(spark, sf):
    return changes.fold_changes(change_log(spark, sf)).select("ann_id", "seq", "after.comment")


@query("rollback_changes", _fold_sql("event_id < (SELECT min(event_id) FROM (SELECT event_id FROM events ORDER BY 1 DESC LIMIT 15))"))
def _(spark, sf):
    return changes.rollback_changes(change_log(spark, sf), 15).select("ann_id", "seq", "after.comment")


# --- statistics ----------------------------------------------------------------------------

_SOME_Q = "some_q AS (SELECT question_id FROM questions WHERE question_id <> 'Q10')"
_BY_Q = """by_q AS (SELECT coalesce(s.question_id, u.question_id) AS question_id, coalesce(n, 0) AS n FROM some_q s FULL JOIN (
  SELECT question_id, count(*) AS n FROM (SELECT unnest(string_split(questions, ';')) AS question_id FROM annotations) GROUP BY 1) u
  ON s.question_id = u.question_id)"""


def some_questions(spark):
    return questions_table(spark).where("question_id <> 'Q10'")


@query("count_by_question", sql("SELECT * FROM by_q", *NAQ, _SOME_Q, _BY_Q))
def _(spark, sf):
    return stats.count_by_question(annotations(spark, sf), some_questions(spark))


@query("count_by_note", sql("SELECT note_id, count(*) AS n FROM annotations GROUP BY 1", *NA))
def _(spark, sf):
    return stats.count_by_note(annotations(spark, sf))


@query("notes_with_suggested", sql(
    "SELECT note_id, bool_or(source = 'suggested') AS has_suggested FROM annotations GROUP BY 1", *NA))
def _(spark, sf):
    return stats.notes_with_suggested(annotations(spark, sf))


@query("count_by_type", sql(
    "SELECT type, count(*) AS n FROM notes WHERE coalesce(type, '') <> '' GROUP BY 1", N))
def _(spark, sf):
    return stats.count_by_type(notes(spark, sf))


@query("source_and_comment_counts", sql(
    "SELECT count(*) FILTER (WHERE source <> 'suggested') AS manual, count(*) FILTER (WHERE source = 'suggested') AS suggested, "
    "count(*) FILTER (WHERE coalesce(trim(comment), '') <> '') AS with_comment FROM annotations", *NA))
def _(spark, sf):
    return stats.source_and_comment_counts(annotations(spark, sf))


@query("suggested_count", sql("SELECT count(*) FILTER (WHERE source = 'suggested') AS suggested FROM annotations", *NA))
def _(spark, sf):
    return stats.suggested_count(annotations(spark, sf))


@query("annotated_note_count", sql(
    "SELECT count(*) AS annotated_notes FROM kept WHERE note_id IN (SELECT note_id FROM annotations)", *NA, _KEPT))
def _(spark, sf):
    return stats.annotated_note_count(kept(spark, sf), annotations(spark, sf))


@query("annotation_index_by_note", sql(
    'SELECT note_id, CAST((rn - 1) // 2 AS BIGINT) AS chunk_no, string_agg(ann_id, \';\' ORDER BY rn) AS ids FROM '
    '(SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY "start", seq) AS rn FROM annotations) GROUP BY 1, 2', *NA))
def _(spark, sf):
    return stats.annotation_index_by_note(annotations(spark, sf), 2).select(
        "note_id", "chunk_no", F.array_join(F.col("annotations.ann_id"), ";").alias("ids"))


@query("note_overview", sql(
    "SELECT row_number() OVER (ORDER BY pos) AS position, note_id, type, coalesce(n, 0) AS n, coalesce(has, false) AS has_suggested, "
    "substr(text, 1, 50) AS preview FROM notes LEFT JOIN (SELECT note_id, count(*) AS n, bool_or(source = 'suggested') AS has "
    "FROM annotations WHERE source = 'manual' OR seq % 2 = 0 GROUP BY 1) USING (note_id)", *NA))
def _(spark, sf):
    return stats.note_overview(notes(spark, sf), annotations(spark, sf).where("source = 'manual' OR seq % 2 = 0"))


@query("export_stats", sql(
    """SELECT (SELECT count(*) FROM kept) AS total_notes, count(DISTINCT note_id) AS annotated_notes, count(*) AS total_annotations,
       count(*) FILTER (WHERE source <> 'suggested') AS manual, count(*) FILTER (WHERE source = 'suggested') AS suggested,
       (SELECT string_agg(question_id || '=' || CAST(n AS VARCHAR), ';' ORDER BY question_id) FROM by_q) AS by_question
       FROM annotations""", *NAQ, _KEPT, _SOME_Q, _BY_Q))
def _(spark, sf):
    out = stats.export_stats(kept(spark, sf), annotations(spark, sf), some_questions(spark))
    return out.withColumn("by_question", F.array_join(F.transform(
        F.map_entries("by_question"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";"))


@query("export_csv_rows", sql(
    f"""SELECT ann_id AS annotation_id, note_id, coalesce(type, '') AS note_type, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end",
        regexp_replace(text, '[\\n\\r]', ' ', 'g') AS text, questions, source,
        strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, coalesce(comment, '') AS comment,
        regexp_replace(context_before, '[\\n\\r]', ' ', 'g') AS context_before, regexp_replace(context_after, '[\\n\\r]', ' ', 'g') AS context_after
        FROM (SELECT j.*, {context(50)} FROM (SELECT a.*, n.type, n.text AS note_text FROM annotations a JOIN kept n USING (note_id)) j)""",
    *NA, _KEPT))
def _(spark, sf):
    return sinks.export_csv_rows(kept(spark, sf), annotations(spark, sf))


# --- ordering ------------------------------------------------------------------------------

@query("sort_annotations", sql('SELECT note_id, "start", "end", ann_id FROM annotations ORDER BY 1, 2, 3, 4', *NA))
def _(spark, sf):
    return ordering.sort_annotations(annotations(spark, sf)).select("note_id", "start", "end", "ann_id")


@query("assign_batches", sql(
    "SELECT note_id, row_number() OVER (ORDER BY pos) AS rn, CAST(ceil(row_number() OVER (ORDER BY pos) / 50.0) AS BIGINT) AS batch "
    "FROM kept", N, _KEPT))
def _(spark, sf):
    return ordering.assign_batches(kept(spark, sf)).select("note_id", "rn", "batch")


@query("limit_notes", sql("SELECT note_id, pos FROM notes ORDER BY pos LIMIT 37", N))
def _(spark, sf):
    return ordering.limit_notes(notes(spark, sf), 37).select("note_id", "pos")


@query("next_unannotated", sql(
    "SELECT note_id, pos, coalesce(min(CASE WHEN note_id NOT IN (SELECT note_id FROM annotations WHERE source = 'manual') THEN pos END) "
    "OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_pos FROM notes", *NA))
def _(spark, sf):
    return ordering.next_unannotated(
        notes(spark, sf), annotations(spark, sf).where("source = 'manual'")
    ).withColumn("next_pos", F.coalesce("next_pos", F.lit(-1).cast("long")))


@query("neighbour_annotations", sql(
    """SELECT note_id, ann_id, coalesce(lag(ann_id) OVER w, last_value(ann_id) OVER f) AS prev_id,
       coalesce(lead(ann_id) OVER w, first_value(ann_id) OVER f) AS next_id,
       "start" - coalesce(lag("start") OVER w, last_value("start") OVER f) AS prev_distance,
       coalesce(lead("start") OVER w, first_value("start") OVER f) - "start" AS next_distance FROM annotations
       WINDOW w AS (PARTITION BY note_id ORDER BY "start", seq),
              f AS (PARTITION BY note_id ORDER BY "start", seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", *NA))
def _(spark, sf):
    return ordering.neighbour_annotations(annotations(spark, sf))


@query("dedupe_note_ids", sql(
    "SELECT CASE WHEN rn > 1 THEN id || '_' || CAST(rn AS VARCHAR) ELSE id END AS note_id, pos FROM "
    "(SELECT source AS id, pos, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM notes)", N))
def _(spark, sf):
    n = notes(spark, sf).withColumn("note_id", F.col("source"))
    return ordering.dedupe_note_ids(n).select("note_id", "pos")


@query("append_or_replace_notes", sql(
    "SELECT 'append' AS mode, note_id, 1 AS kept_annotations FROM notes UNION ALL "
    "SELECT 'replace', note_id, 0 FROM notes WHERE pos % 6 = 1", N))
def _(spark, sf):
    old, new, a = kept(spark, sf), notes(spark, sf).where("pos % 6 = 1"), annotations(spark, sf)
    out = []
    for mode in ("append", "replace"):
        n, left = sinks.append_or_replace_notes(old, new, a, mode)
        has = left.limit(1).agg(F.count(F.lit(1)).cast("int")).scalar()
        out.append(n.select(F.lit(mode).alias("mode"), "note_id", has.alias("kept_annotations")))
    return out[0].unionByName(out[1])
