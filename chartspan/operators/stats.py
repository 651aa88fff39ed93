"""Counts and summaries. All are plain aggregates, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.functions import vocab
from chartspan.functions.text import blank
from chartspan.operators.ordering import rank_annotations, rank_in_bins

SECTIONS = sorted(name for name, _ in vocab.SECTION_PATTERNS)


def _suggested():
    return F.col("source").eqNullSafe("suggested")


def question_counts(annotations: DataFrame) -> DataFrame:
    return annotations.select(F.explode("questions").alias("question_id")).groupBy(
        "question_id").agg(F.count(F.lit(1)).alias("n"))


def count_by_question(annotations: DataFrame, questions: DataFrame) -> DataFrame:
    """Every dictionary question with its count, zero when unused; unknown ids appear as well."""
    return questions.select("question_id").join(
        question_counts(annotations), "question_id", "full"
    ).select("question_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def count_by_note(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))


def notes_with_suggested(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("note_id").agg(F.bool_or(_suggested()).alias("has_suggested"))


def count_by_type(notes: DataFrame) -> DataFrame:
    return notes.where(F.coalesce("type", F.lit("")) != "").groupBy("type").agg(
        F.count(F.lit(1)).alias("n")).orderBy("type")


def source_and_comment_counts(annotations: DataFrame) -> DataFrame:
    return annotations.agg(
        F.count_if(~_suggested()).alias("manual"),
        F.count_if(_suggested()).alias("suggested"),
        F.count_if(~blank("comment")).alias("with_comment"),
    )


def suggested_count(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.count_if(_suggested()).alias("suggested"))


def annotated_note_count(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    return notes.select("note_id").join(
        annotations.select("note_id"), "note_id", "left_semi"
    ).agg(F.count(F.lit(1)).alias("annotated_notes"))


def annotation_index_by_note(annotations: DataFrame, chunk: int = 1000) -> DataFrame:
    """note -> its annotations by start, as lists of at most ``chunk``; ``chunk_no`` orders them.

    Nearly every note has one list. A note with very many annotations gets several, so no row
    or task has to hold them all.
    """
    ranked = rank_annotations(annotations, "__rank")
    numbered = ranked.withColumn("chunk_no", F.floor((F.col("__rank") - 1) / chunk))
    entry = F.struct("__rank", "ann_id", "start", "end", "questions")
    return numbered.groupBy("note_id", "chunk_no").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(
            e["ann_id"].alias("ann_id"), e["start"].alias("start"),
            e["end"].alias("end"), e["questions"].alias("questions"))).alias("annotations"))


def note_overview(notes: DataFrame, annotations: DataFrame, order: str = "pos") -> DataFrame:
    """The list row of a note: position, id, type, count, suggested flag, preview."""
    per_note = annotations.groupBy("note_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(_suggested()).alias("has_suggested"))
    short = notes.select("note_id", order, "type", F.substring("text", 1, 50).alias("preview"))
    return rank_in_bins(short, [], order, "position").join(per_note, "note_id", "left").select(
        "position", "note_id", "type",
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.coalesce("has_suggested", F.lit(False)).alias("has_suggested"),
        "preview",
    )


def export_stats(notes: DataFrame, annotations: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of totals; ``by_question`` maps every known or used question id to its count."""
    by_question = count_by_question(annotations, questions).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_id", "n")))))
    total = notes.agg(F.count(F.lit(1)))
    totals = annotations.agg(
        F.count_distinct("note_id").alias("annotated_notes"),
        F.count(F.lit(1)).alias("total_annotations"),
        F.count_if(~_suggested()).alias("manual"),
        F.count_if(_suggested()).alias("suggested"),
    )
    return totals.select(
        total.scalar().alias("total_notes"), "*", by_question.scalar().alias("by_question"))


def token_stats(tokens: DataFrame) -> DataFrame:
    """Per note: break totals, mean confidence, headers, list items, sections found."""
    start = F.col("is_line_start")
    # a set of section names is a number, so that the totals are summed up before the shuffle
    known = F.when(F.lit(False), F.lit(0).cast("long"))
    for i, name in enumerate(SECTIONS):
        known = known.when(F.col("detected") == name, F.lit(1 << i).cast("long"))
    known = known.otherwise(F.lit(0).cast("long"))
    return tokens.groupBy("note_id").agg(
        F.count(F.lit(1)).alias("total_tokens"),
        F.count_if(F.col("decision") == "space").alias("spaces"),
        F.count_if(F.col("decision") == "newline").alias("newlines"),
        F.count_if(F.col("decision") == "blank_line").alias("blank_lines"),
        F.round(F.avg("raw_confidence"), 3).alias("avg_confidence"),
        F.count_if(start & F.col("line_type").isin("MAJOR_HEADER", "MINOR_HEADER")).alias("headers"),
        F.count_if(start & (F.col("line_type") == "LIST_ITEM")).alias("list_items"),
        F.bit_or(known).alias("__sections"),
    ).select("*", F.filter(
        F.array(*[F.when(F.getbit("__sections", F.lit(i)) == 1, n) for i, n in enumerate(SECTIONS)]),
        lambda s: s.isNotNull()).alias("sections_found")).drop("__sections")


def import_summary(notes: DataFrame, errors: DataFrame) -> DataFrame:
    """Notes read, inputs that failed, both together."""
    failed = errors.agg(F.count(F.lit(1)))
    return notes.agg(F.count(F.lit(1)).alias("processed")).withColumn(
        "failed", failed.scalar()).withColumn("total", F.col("processed") + F.col("failed"))
