"""Readers, sinks and streams, on files that Spark writes from the driver's tables first."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from checks.annotation_checks import change_log, flat, _fold_sql
from checks.registry import query
from checks.views import MATCHES_SQL, N, NA, NAQ, NM, RULES, RULES_SQL, annotations, documents, notes, sql, table
from chartspan import schemas
from chartspan.operators import stats
from chartspan.operators.rules import questions_table
from chartspan.plans.session import new_folder
from chartspan.sources import readers, sinks
from chartspan.streaming import streams


def write_files(files, base):
    """Write (path, content) rows as files under a shared folder, each task its own rows.

    A file gets its name when it is complete, so a task that is lost, or that runs a second time
    beside the first, leaves no part of a text to be read.
    """
    root = re.sub(r"\Afile:(?://)?(?=/)", "", base)

    def run(rows):
        for r in rows:
            target = os.path.join(root, r.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf8", newline="") as f:
                f.write(r.content)
            os.replace(part, target)

    files.select("path", "content").foreachPartition(run)
    return base


def text_tree(spark, sf):
    """documents as ``<lang>/<doc_id> n+1.txt``."""
    d = documents(spark, sf)
    return write_files(d.select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(" n+1.txt")).alias("path"),
        F.col("text").alias("content")), new_folder(spark, "txt"))


def _batched(spark, sf, ending, opening, sep, closing):
    """Raw notes, fifty to a file."""
    raw = F.to_json(F.struct(
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).otherwise("").alias("note_id"),
        "text", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("note_type"),
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit("M").alias("type"), F.col("lang").alias("date"))).alias("meta")))
    d = documents(spark, sf)
    files = d.groupBy(F.floor(F.col("doc_id") / 50).alias("g")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", raw.alias("j")))), lambda x: x["j"]), sep).alias("body"))
    base = write_files(files.select(
        F.concat(F.lit("K/b"), F.col("g").cast("string"), F.lit(ending)).alias("path"),
        F.concat(F.lit(opening), "body", F.lit(closing)).alias("content")), new_folder(spark, "raw"))
    bad = spark.range(2).select(F.concat(F.lit("K/bad"), F.col("id").cast("string"), F.lit(ending)).alias("path"),
                                F.lit('{"text": "cut').alias("content"))
    write_files(bad, base)
    write_files(spark.range(1).select(F.lit("K/readme.md").alias("path"), F.lit("not a note").alias("content")), base)
    return base


def _raw_sql(folder="NULL"):
    return f"""SELECT CASE WHEN doc_id % 3 = 2 THEN 'made' ELSE CAST(doc_id AS VARCHAR) END AS note_id, text,
      CASE WHEN doc_id % 5 = 0 THEN 'M' WHEN doc_id % 2 = 0 THEN source ELSE {folder} END AS type,
      CASE WHEN doc_id % 5 = 0 THEN lang END AS date FROM documents"""


def _made(df):
    return df.select(
        F.when(F.col("note_id").startswith("note_"), "made").otherwise(F.col("note_id")).alias("note_id"),
        "text", "type", "date")


@query("read_txt_notes", """SELECT CAST(doc_id AS VARCHAR) || ' n+1' AS note_id, text, lang AS type,
       CAST(doc_id AS VARCHAR) || ' n+1.txt' AS source, text AS raw_text FROM documents""")
def _(spark, sf):
    return readers.read_txt_notes(spark, text_tree(spark, sf)).drop("date")


@query("read_json_notes", _raw_sql())
def _(spark, sf):
    return _made(readers.read_json_notes(spark, _batched(spark, sf, ".json", '{"notes": [', ",", "]}")))


@query("read_jsonl_notes", _raw_sql())
def _(spark, sf):
    return _made(readers.read_jsonl_notes(spark, _batched(spark, sf, ".jsonl", "", "\n\n", "\n")))


@query("read_notes_dir", _raw_sql("'K'"))
def _(spark, sf):
    found, _errors = readers.read_notes_dir(spark, _batched(spark, sf, ".json", "[", ",\n", "]"))
    return _made(found)


@query("import_summary", "SELECT count(*) AS processed, CAST(2 AS BIGINT) AS failed, count(*) + 2 AS total FROM documents")
def _(spark, sf):
    return stats.import_summary(*readers.read_notes_dir(spark, _batched(spark, sf, ".jsonl", "", "\n", "")))


@query("normalize_notes", _raw_sql())
def _(spark, sf):
    d = documents(spark, sf)
    key = F.col("doc_id").cast("string")
    raw = d.select(
        F.when(F.col("doc_id") % 3 == 0, key).alias("id"),
        F.when(F.col("doc_id") % 3 == 1, key).otherwise("").alias("note_id"), "text",
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("note_type"),
        F.when(F.col("doc_id") % 5 == 0, F.struct(
            F.lit("M").alias("type"), F.col("lang").alias("date"), F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("string").alias("rawText"))).alias("meta"))
    return _made(readers.normalize_notes(raw))


_SESSION = """SELECT a.ann_id, a.note_id, n.type, a."start", a."end", a.text, a.questions, a.source, q.name FROM annotations a
  JOIN notes n USING (note_id) LEFT JOIN questions q ON q.question_id = string_split(a.questions, ';')[1]"""


def _session(got):
    n, a, q = got
    return a.join(n.select("note_id", "type"), "note_id").join(
        q.select("question_id", "name"), F.element_at("questions", 1) == F.col("question_id"), "left"
    ).select("ann_id", "note_id", "type", "start", "end", "text",
             F.array_join("questions", ";").alias("questions"), "source", "name")


@query("write_session", sql(_SESSION, *NAQ))
def _(spark, sf):
    path = new_folder(spark, "session")
    sinks.write_session(notes(spark, sf), annotations(spark, sf), questions_table(spark), path)
    return _session(readers.read_session(spark, path))


@query("read_session", sql(_SESSION, *NAQ))
def _(spark, sf):
    """The table form, reached through its manifest."""
    path = new_folder(spark, "session")
    sinks.write_session(
        notes(spark, sf), annotations(spark, sf), questions_table(spark).where("question_id <> 'Q99'"), path)
    return _session(readers.read_session(spark, path))


@query("session_parts", sql(_SESSION, *NAQ))
def _(spark, sf):
    """The exchanged JSON records in sixteen ranges of note ids, written and read by all tasks."""
    path = new_folder(spark, "session")
    sinks.write_session(notes(spark, sf), annotations(spark, sf), questions_table(spark), path, parts=16)
    return _session(readers.read_session(spark, path))


@query("export_json", sql(
    """SELECT (SELECT count(*) FROM notes) AS total_notes, (SELECT sum(length(text)) FROM notes)::BIGINT AS note_chars,
       count(*) AS total_annotations, sum("start")::BIGINT AS starts, min(epoch_ms(created_at)) AS first_ms FROM annotations""", *NA))
def _(spark, sf):
    path = new_folder(spark, "json")
    sinks.export_json(notes(spark, sf), annotations(spark, sf), questions_table(spark), path)
    n = spark.read.schema("id string, text string").json(f"{path}/notes")
    a = spark.read.schema(schemas.SESSION_ANNOTATION).json(f"{path}/annotations")
    return a.agg(
        F.count(F.lit(1)).alias("total_annotations"), F.sum("start").alias("starts"),
        F.min("createdAt").alias("first_ms")
    ).withColumn("total_notes", n.agg(F.count(F.lit(1))).scalar()).withColumn(
        "note_chars", n.agg(F.sum(F.length("text"))).scalar())


@query("write_csv", sql(
    """SELECT ann_id AS annotation_id, "start", text, questions, coalesce(comment, '') AS comment FROM (
         SELECT ann_id, CAST("start" AS VARCHAR) AS "start", regexp_replace(text, '[\\n\\r]', ' ', 'g') AS text, questions, comment FROM annotations)""", *NA))
def _(spark, sf):
    path = new_folder(spark, "csv")
    sinks.write_csv(notes(spark, sf), annotations(spark, sf), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True,
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.select("annotation_id", "start", "text", "questions", F.coalesce("comment", F.lit("")).alias("comment"))


@query("write_formatted_corpus", "SELECT count(*) AS processed, CAST(0 AS BIGINT) AS failed, count(*) AS total FROM documents")
def _(spark, sf):
    return sinks.write_formatted_corpus(spark, text_tree(spark, sf), new_folder(spark, "formatted"))


# --- streams -------------------------------------------------------------------------------

def _drain(spark, stream, label):
    """Run a stream over what is there and read back what it wrote."""
    out, mark = new_folder(spark, label), new_folder(spark, label + "-checkpoint")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_notes", "SELECT CAST(doc_id AS VARCHAR) || ' n+1' AS note_id, text, lang AS type FROM documents")
def _(spark, sf):
    arriving = streams.stream_notes(spark, text_tree(spark, sf), files_per_batch=400)
    return _drain(spark, arriving, "notes").select("note_id", "text", "type")


@query("stream_auto_tag", sql('SELECT note_id, "start", "end", term AS text, question_id AS questions FROM matches',
                              "notes AS (SELECT CAST(doc_id AS VARCHAR) || ' n+1' AS note_id, text, doc_id AS pos FROM documents)",
                              RULES_SQL, MATCHES_SQL))
def _(spark, sf):
    arriving = streams.stream_notes(spark, text_tree(spark, sf))
    return _drain(spark, streams.stream_auto_tag(arriving, RULES), "tags").select(
        "note_id", "start", "end", "text", F.array_join("questions", ";").alias("questions"))


@query("stream_annotation_state", _fold_sql("true"))
def _(spark, sf):
    source = new_folder(spark, "changes")
    log = change_log(spark, sf)
    log.repartition(4, (F.col("seq") * 7) % 4).write.parquet(source)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    state = new_folder(spark, "state")
    streams.stream_annotation_state(
        arriving, state, new_folder(spark, "state-checkpoint"), snapshot_every=3).awaitTermination()
    return streams.read_annotation_state(spark, state).select("ann_id", "seq", "after.comment")


@query("stream_question_counts", sql(
    "SELECT question_id, count(*) AS n FROM (SELECT unnest(string_split(questions, ';')) AS question_id FROM annotations) GROUP BY 1", *NA))
def _(spark, sf):
    source = new_folder(spark, "annotations")
    a = annotations(spark, sf).select("ann_id", "questions")
    a.repartition(4).write.parquet(source)
    arriving = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 2).parquet(source)
    out = new_folder(spark, "counts")
    run = streams.stream_question_counts(arriving).writeStream.outputMode("complete").foreachBatch(
        lambda df, _n: df.write.mode("overwrite").parquet(out)
    ).option("checkpointLocation", new_folder(spark, "counts-checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)
