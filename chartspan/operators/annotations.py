"""Annotation filters and edits as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.functions.text import after, before, blank, slice_text, strip


def filter_ann_source(annotations: DataFrame, which: str) -> DataFrame:
    if which == "all":
        return annotations
    suggested = F.col("source").eqNullSafe("suggested")
    return annotations.where({"manual": ~suggested, "auto": suggested}[which])


def filter_ann_comment(annotations: DataFrame, which: str) -> DataFrame:
    if which == "all":
        return annotations
    return annotations.where({"with": ~blank("comment"), "without": blank("comment")}[which])


def filter_ann_question(annotations: DataFrame, question_id: str) -> DataFrame:
    return annotations.where(F.array_contains("questions", question_id))


def search_annotations(annotations: DataFrame, query: str) -> DataFrame:
    if not query.strip():
        return annotations
    q = query.lower()
    return annotations.where(
        F.lower("text").contains(q) | F.coalesce(F.lower("comment").contains(q), F.lit(False))
    )


def join_annotations_notes(annotations: DataFrame, notes: DataFrame, how: str = "inner") -> DataFrame:
    """Annotations with their note's text and type. The side sizes decide the join at run time;
    a hot note is split by the adaptive skew join."""
    note = notes.select("note_id", F.col("text").alias("note_text"), F.col("type").alias("note_type"))
    return annotations.join(note, "note_id", how)


def join_annotations_notes_left(annotations: DataFrame, notes: DataFrame, k: int = 40) -> DataFrame:
    """Every annotation, with empty context when its note is missing."""
    return _context(join_annotations_notes(annotations, notes, "left"), k)


def annotation_context(annotations: DataFrame, notes: DataFrame, k: int = 40) -> DataFrame:
    return _context(join_annotations_notes(annotations, notes), k)


def _context(joined: DataFrame, k: int) -> DataFrame:
    none = F.lit("")
    return joined.withColumns({
        "context_before": F.coalesce(before("note_text", F.col("start"), k), none),
        "context_after": F.coalesce(after("note_text", F.col("end"), k), none),
    }).drop("note_text")


def with_ids(spans: DataFrame, source: str, created_at: Column | None = None) -> DataFrame:
    """Assign id, creation time and source to new spans.

    The id is a hash of what the row says plus its ``seq`` when there is one, so a task that is
    run again yields the same ids.
    """
    cols = spans.columns
    parts = ["note_id", "start", "end", F.array_join("questions", ";")]
    if "seq" in cols:
        parts.append("seq")
    out = spans.withColumn(
        "ann_id", F.concat(F.lit("ann_"), F.lower(F.hex(F.xxhash64(*parts)))))
    stamp = created_at if created_at is not None else F.current_timestamp()
    out = out.withColumn("created_at", stamp)
    if source == "suggested" or "source" not in cols:
        return out.withColumn("source", F.lit(source))
    return out.withColumn("source", F.coalesce("source", F.lit(source)))


def add_annotations(
    annotations: DataFrame, spans: DataFrame, created_at: Column | None = None
) -> DataFrame:
    """Append spans; source stays as given, or becomes manual."""
    return annotations.unionByName(with_ids(spans, "manual", created_at), allowMissingColumns=True)


def add_suggested_annotations(
    annotations: DataFrame, spans: DataFrame, created_at: Column | None = None
) -> DataFrame:
    return annotations.unionByName(with_ids(spans, "suggested", created_at), allowMissingColumns=True)


def remove_annotations(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    return annotations.join(ids.select("ann_id"), "ann_id", "left_anti")


def update_annotations(annotations: DataFrame, patch: DataFrame) -> DataFrame:
    """Overwrite the columns a patch row carries; nulls in the patch leave the value alone.

    The patch is keyed by ``ann_id`` and must hold each id once.
    """
    fields = [c for c in patch.columns if c != "ann_id"]
    renamed = patch.select("ann_id", *[F.col(c).alias(f"__{c}") for c in fields])
    joined = annotations.join(renamed, "ann_id", "left")
    return joined.withColumns(
        {c: F.coalesce(f"__{c}", c) for c in fields}
    ).select(*annotations.columns)


def _where_edited(annotations: DataFrame, ids: DataFrame | None, column: str, value: Column) -> DataFrame:
    """Set a column for the listed ids, or for all."""
    if ids is None:
        return annotations.withColumn(column, value)
    marked = annotations.join(
        ids.select("ann_id").distinct().withColumn("__hit", F.lit(True)), "ann_id", "left")
    return marked.withColumn(
        column, F.when(F.col("__hit"), value).otherwise(F.col(column))
    ).select(*annotations.columns)


def add_question_to_ann(annotations: DataFrame, question_id: str, ids: DataFrame | None = None) -> DataFrame:
    value = F.when(F.array_contains("questions", question_id), F.col("questions")).otherwise(
        F.array_append("questions", F.lit(question_id)))
    return _where_edited(annotations, ids, "questions", value)


def remove_question_from_ann(annotations: DataFrame, question_id: str, ids: DataFrame | None = None) -> DataFrame:
    """The last question of an annotation stays."""
    value = F.when(F.size("questions") > 1, F.array_remove("questions", question_id)).otherwise(
        F.col("questions"))
    return _where_edited(annotations, ids, "questions", value)


def set_comment(annotations: DataFrame, comments: DataFrame) -> DataFrame:
    """New comments by id: trimmed, blank becomes null."""
    new = comments.select("ann_id", F.nullif(strip("comment"), F.lit("")).alias("__c"), F.lit(True).alias("__hit"))
    return (
        annotations.join(new, "ann_id", "left")
        .withColumn("comment", F.when(F.col("__hit"), F.col("__c")).otherwise(F.col("comment")))
        .select(*annotations.columns)
    )


def promote_annotations(annotations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return _where_edited(annotations, ids, "source", F.lit("manual"))


def resize_annotations(annotations: DataFrame, notes: DataFrame, spans: DataFrame) -> DataFrame:
    """New start and end by id, kept inside the note and at least one character long; the text
    is cut again. Only notes with a resized annotation are read."""
    moved = annotations.drop("start", "end", "text").join(
        spans.select("ann_id", F.col("start").alias("__s"), F.col("end").alias("__e")), "ann_id")
    text = notes.select("note_id", F.col("text").alias("note_text"))
    size = F.length("note_text")
    lo = F.greatest(F.lit(0), F.least(F.col("__s"), size - 1))
    cut = (
        moved.join(text, "note_id")
        .withColumn("start", lo)
        .withColumn("end", F.least(F.greatest(F.col("__e"), F.col("start") + 1), size))
        .withColumn("text", slice_text("note_text", F.col("start"), F.col("end")))
        .select(*annotations.columns)
    )
    return annotations.join(spans.select("ann_id"), "ann_id", "left_anti").unionByName(cut)


def clear_note_annotations(annotations: DataFrame, note_ids: DataFrame) -> DataFrame:
    return annotations.join(note_ids.select("note_id"), "note_id", "left_anti")


def clear_suggested(annotations: DataFrame) -> DataFrame:
    return annotations.where(~F.col("source").eqNullSafe("suggested"))


def clear_all(annotations: DataFrame) -> DataFrame:
    return annotations.limit(0)


def annotations_with_questions(annotations: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per annotation and question with the question's name and color; an id the
    dictionary lacks shows itself."""
    rows = annotations.withColumn("question_id", F.explode("questions")).drop("questions")
    named = questions.select("question_id", "name", "color")
    return rows.join(named, "question_id", "left").withColumn(
        "name", F.coalesce("name", "question_id"))


def annotated_notes(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    return notes.join(annotations.select("note_id"), "note_id", "left_semi")


def unannotated_notes(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    return notes.join(annotations.select("note_id"), "note_id", "left_anti")


def orphan_annotations(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    return annotations.join(notes.select("note_id"), "note_id", "left_anti")


def complete_questions(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Add a dictionary row for every question id the annotations use but the dictionary lacks."""
    from chartspan.functions import vocab

    used = annotations.select(F.explode("questions").alias("question_id")).distinct()
    missing = used.join(questions.select("question_id"), "question_id", "left_anti").select(
        "question_id",
        F.col("question_id").alias("name"),
        F.lit(vocab.UNKNOWN_QUESTION_COLOR).alias("color"),
        F.lit("").alias("hotkey"),
        F.lit(vocab.UNKNOWN_QUESTION_HINT).alias("hint"),
    )
    return questions.unionByName(missing)


def union_notes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_annotations(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)
