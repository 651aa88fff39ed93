"""Exports and session bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.functions.text import after, before
from chartspan.operators.annotations import join_annotations_notes
from chartspan.operators.stats import export_stats
from chartspan.sources.readers import utf16_units

CSV_COLUMNS = [
    "annotation_id", "note_id", "note_type", "start", "end", "text", "questions", "source",
    "created_at", "comment", "context_before", "context_after",
]
VERSION = "1.0"
#: Tasks that format a folder tree, for each core.
TASKS_PER_CORE = 32


def export_csv_rows(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row of twelve text columns per annotation that has a note."""

    def one_line(c):
        return F.regexp_replace(c, r"[\n\r]", " ")

    joined = join_annotations_notes(annotations, notes)
    empty = F.lit("")
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return joined.select(
        F.col("ann_id").alias("annotation_id"),
        "note_id",
        F.coalesce("note_type", empty).alias("note_type"),
        F.col("start").cast("string").alias("start"),
        F.col("end").cast("string").alias("end"),
        one_line(F.col("text")).alias("text"),
        F.array_join("questions", ";").alias("questions"),
        F.coalesce("source", F.lit("manual")).alias("source"),
        F.coalesce(stamp, empty).alias("created_at"),
        F.coalesce("comment", empty).alias("comment"),
        one_line(before("note_text", F.col("start"), 50)).alias("context_before"),
        one_line(after("note_text", F.col("end"), 50)).alias("context_after"),
    )


def write_csv(notes: DataFrame, annotations: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled; one part per task."""
    export_csv_rows(notes, annotations).write.mode("overwrite").csv(
        path, header=True, quoteAll=True, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _session_notes(notes: DataFrame) -> DataFrame:
    meta = F.struct("type", "date", "source", F.col("raw_text").alias("rawText"))
    return notes.select(F.col("note_id").alias("id"), "text", meta.alias("meta"))


def _session_annotations(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """Annotations as sessions carry them; their offsets count UTF-16 units."""
    return utf16_units(annotations, notes).select(
        F.col("ann_id").alias("id"), F.col("note_id").alias("noteId"), "start", "end", "text",
        "questions", "comment", F.unix_millis("created_at").alias("createdAt"), "source")


def export_json(notes: DataFrame, annotations: DataFrame, questions: DataFrame, path: str) -> None:
    """Stats, notes and annotations as JSON Lines folders under one path."""
    export_stats(notes, annotations, questions).withColumn(
        "exported_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/stats")
    _session_notes(notes).write.mode("overwrite").json(f"{path}/notes")
    _session_annotations(annotations, notes).write.mode("overwrite").json(f"{path}/annotations")


def write_session(
    notes: DataFrame, annotations: DataFrame, questions: DataFrame, path: str, bundle: bool = False, parts: int | None = None
) -> None:
    """A session as Parquet tables and a manifest.

    ``parts`` writes the exchanged JSON records instead, cut into that many ranges of note ids.
    ``bundle=True`` writes one JSON document, the form single sessions are exchanged in. That
    form is one value by nature and one task writes it; a corpus goes into tables or parts.
    """
    spark = notes.sparkSession
    if parts:
        _write_parts(notes, annotations, questions, path, parts)
        return
    if bundle:
        _write_bundle(notes, annotations, questions, path)
        return
    notes.write.mode("overwrite").parquet(f"{path}/notes")
    annotations.write.mode("overwrite").parquet(f"{path}/annotations")
    questions.write.mode("overwrite").parquet(f"{path}/questions")
    spark.range(1).select(
        F.lit(VERSION).alias("version"), F.current_timestamp().alias("exported_at")
    ).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _write_parts(notes: DataFrame, annotations: DataFrame, questions: DataFrame, path: str, parts: int) -> None:
    """JSON Lines by range of note ids, and a manifest of the ranges.

    Every range has a folder of notes and one of the annotations on them, so that a range can be
    exchanged by itself. Only the first ids of the ranges, at most ``parts``, reach the driver.
    """
    spark = notes.sparkSession
    root = f"{path}/parts"
    ranged = _session_notes(notes).repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id())
    ranged.write.mode("overwrite").partitionBy("part").json(f"{root}/notes")
    # read from what was written: ranges of a second run could be cut elsewhere
    ranges = spark.read.schema("id string, part int").json(f"{root}/notes").groupBy("part").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("notes"))
    cuts = ranges.orderBy("first").select("part", "first").collect()
    marks = _session_annotations(annotations, notes)
    below = F.array_max(F.filter(F.array(*[F.struct(F.lit(r["first"]).alias("first"), F.lit(r["part"]).alias("part")) for r in cuts]),
                                 lambda r: r["first"] <= F.col("noteId")))["part"] if cuts else F.lit(None).cast("int")
    # annotations on no note of the session go into the first range
    marks = marks.withColumn("part", F.coalesce(below, F.lit(cuts[0]["part"] if cuts else 0)))
    marks.write.mode("overwrite").partitionBy("part").json(f"{root}/annotations")
    _session_questions(questions).write.mode("overwrite").json(f"{root}/questions")
    head = spark.range(1).select(F.lit(VERSION).alias("version"), F.current_timestamp().alias("exportedAt"))
    head.join(ranges, F.lit(True), "left").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def _session_questions(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("question_id").alias("id"), "name", "color", "hotkey", "hint")


def _write_bundle(notes: DataFrame, annotations: DataFrame, questions: DataFrame, path: str) -> None:
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.collect_list(F.struct("*")).alias(name)).withColumn("__one", F.lit(1))

    one = (
        listed(_session_notes(notes), "notes")
        .join(listed(_session_annotations(annotations, notes), "annotations"), "__one")
        .join(listed(_session_questions(questions), "questions"), "__one")
        .select(
            F.lit(VERSION).alias("version"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exportedAt"),
            "notes", "annotations", "questions")
    )
    one.coalesce(1).write.mode("overwrite").json(path)


def append_or_replace_notes(
    existing: DataFrame, new: DataFrame, annotations: DataFrame, mode: str
) -> tuple[DataFrame, DataFrame]:
    """Import into a session: add to its notes, or replace them and clear the annotations."""
    if mode == "append":
        return existing.unionByName(new), annotations
    if mode == "replace":
        return new, annotations.limit(0)
    raise ValueError(f"unknown mode {mode}")


def write_formatted_corpus(spark, in_dir: str, out_dir: str, limit: int | None = None) -> DataFrame:
    """Format a folder tree of text files into Parquet keyed by relative path; returns a summary
    row (processed, failed, total).

    Rows are partitioned by folder on disk, so the tree can be written back or read in part.
    """
    from chartspan.formatting.jobs import format_notes
    from chartspan.sources.readers import whole_files

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(in_dir)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    above = len(system.makeQualified(root).toUri().getPath().rstrip("/"))
    # what stands before the path of a file is its scheme and authority
    whole = F.regexp_replace(F.url_decode(F.replace("__file", F.lit("+"), F.lit("%2B"))), r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    files = whole_files(spark, in_dir, ".txt").withColumn("path", F.ltrim(F.substr(whole, F.lit(above + 1)), F.lit("/")))
    if limit:
        chosen = files.select("path").orderBy("path").limit(limit)
        files = files.join(chosen, "path", "left_semi")
    notes = files.select(
        "path",
        F.regexp_replace("path", r"\A(?:.*/)?([^/]*)\.txt\z", "$1").alias("note_id"),
        F.col("__text").alias("text"),
        F.col("__text").alias("raw_text"))
    folder = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    # a task of few small files would build the expressions of all rules for them, and write files of its own
    most = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = format_notes(notes.coalesce(most)).withColumn("folder", F.when(folder == "", ".").otherwise(folder))
    done.write.mode("overwrite").partitionBy("folder").parquet(out_dir)
    written = spark.read.parquet(out_dir)
    return written.agg(
        F.count_if(F.col("text").isNotNull()).alias("processed"),
        F.count_if(F.col("text").isNull()).alias("failed"),
        F.count(F.lit(1)).alias("total"))
