"""Note filters: plain predicates first, joins only where another table decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.functions import vocab
from chartspan.functions.text import any_of, let, quote
from chartspan.operators.matching import question_predicates
from chartspan.operators.rules import Rule


def filter_min_length(notes: DataFrame, n: int) -> DataFrame:
    return notes.where(F.length("text") >= n) if n else notes


def exclude_terms(text: str) -> list[str]:
    return [t for t in (part.strip().lower() for part in text.split(",")) if t]


def filter_exclude_terms(notes: DataFrame, terms: str) -> DataFrame:
    words = exclude_terms(terms)
    return notes.where(~F.col("text").rlike(any_of(words))) if words else notes


def _admitted(min_length: int, excludes: str) -> Column:
    ok = F.lit(True)
    if min_length:
        ok = F.length("text") >= min_length
    words = exclude_terms(excludes)
    return ok & ~F.col("text").rlike(any_of(words)) if words else ok


def _any_question(rules: list[Rule], selected: list[str] | None) -> Column:
    if not selected:
        return F.lit(True)
    hit = F.lit(False)
    for q, predicate in question_predicates([r for r in rules if r.question_id in selected]).items():
        hit = hit | predicate
    return hit


def smart_filter(
    notes: DataFrame,
    rules: list[Rule],
    selected: list[str] | None = None,
    min_length: int = 0,
    excludes: str = "",
    entities: DataFrame | None = None,
    entity_question: str = "Q6",
) -> DataFrame:
    """Notes that pass length and exclusions and match any selected question.

    Cheap tests come first and stop the row early. Model entities, when given, replace the
    rules of ``entity_question``.
    """
    admitted = notes.where(_admitted(min_length, excludes))
    if not selected:
        return admitted
    if entities is None or entity_question not in selected:
        return admitted.where(_any_question(rules, selected))
    ruled = [r for r in rules if r.question_id != entity_question]
    tagged = entities.select("note_id").distinct().withColumn("__model", F.lit(True))
    return (
        admitted.join(tagged, "note_id", "left")
        .where(F.coalesce(F.col("__model"), F.lit(False)) | _any_question(ruled, [
            q for q in selected if q != entity_question] or ["\0"]))
        .drop("__model")
    )


def smart_filter_report(
    notes: DataFrame,
    rules: list[Rule],
    selected: list[str] | None = None,
    min_length: int = 0,
    excludes: str = "",
    entities: DataFrame | None = None,
    entity_question: str = "Q6",
) -> DataFrame:
    """One row: notes matching, notes excluded, notes matched by the model."""
    ok = _admitted(min_length, excludes)
    if entities is None or not selected or entity_question not in selected:
        return notes.agg(
            F.count_if(ok & _any_question(rules, selected)).alias("matching"),
            F.count_if(~ok).alias("excluded"),
            F.lit(0).cast("long").alias("model_matches"),
        )
    ruled = [r for r in rules if r.question_id != entity_question]
    others = [q for q in selected if q != entity_question] or ["\0"]
    tagged = entities.select("note_id").distinct().withColumn("__model", F.lit(True))
    flagged = notes.join(tagged, "note_id", "left")
    model = F.coalesce(F.col("__model"), F.lit(False))
    return flagged.agg(
        F.count_if(ok & (model | _any_question(ruled, others))).alias("matching"),
        F.count_if(~ok).alias("excluded"),
        F.count_if(ok & model).alias("model_matches"),
    )


def is_radiology_note() -> Column:
    """By id prefix, by type, or by phrase."""
    phrases = "|".join(quote(p) for p in vocab.RADIOLOGY_PHRASES)
    kind = F.lower(F.coalesce(F.col("type"), F.lit("")))
    # a phrase must sit between word boundaries, as one that ends in ":" needs a word after it
    return (
        F.col("note_id").startswith("RAD")
        | kind.contains("rad") | kind.contains("imaging")
        | F.coalesce(F.nullif("text", F.lit("")), F.col("raw_text"), F.lit("")).rlike(
            rf"(?i)\b(?:{phrases})\b")
    )


def filter_radiology_notes(notes: DataFrame) -> DataFrame:
    return notes.where(is_radiology_note())


def reads_like_radiology(text: Column | str) -> Column:
    """One strong sign, or two when at least two signs of another kind of note are present."""
    upper = F.upper(F.col(text) if isinstance(text, str) else text)
    return let(upper, _signs_of_radiology)


def _signs_of_radiology(upper: Column) -> Column:
    def signs(words: list[str], up: Column) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + up.contains(w).cast("int")
        return total

    strong = signs(vocab.RADIOLOGY_STRONG, upper)
    anti = signs(vocab.RADIOLOGY_ANTI, upper)
    return F.when(anti >= 2, strong >= 2).otherwise(strong >= 1)


def detect_radiology_format(notes: DataFrame) -> DataFrame:
    return notes.withColumn("is_radiology", reads_like_radiology("text"))


def search_notes_substring(notes: DataFrame, query: str) -> DataFrame:
    if not query:
        return notes
    q = query.lower()
    return notes.where(F.lower("note_id").contains(q) | F.lower("text").contains(q))


def filter_note_type(notes: DataFrame, note_type: str) -> DataFrame:
    return notes.where(F.col("type") == note_type)


def filter_note_status(notes: DataFrame, annotations: DataFrame, status: str) -> DataFrame:
    if status == "all":
        return notes
    how = {"done": "left_semi", "todo": "left_anti"}[status]
    return notes.join(annotations.select("note_id"), "note_id", how)


def restrict_to_note_set(notes: DataFrame, note_ids: DataFrame) -> DataFrame:
    return notes.join(note_ids.select("note_id"), "note_id", "left_semi")


def delete_non_matching(notes: DataFrame, keep: DataFrame, path: str | None = None) -> DataFrame:
    """Keep the matching notes. With ``path`` the result is written there, never over its input."""
    kept = restrict_to_note_set(notes, keep)
    if path:
        kept.write.mode("errorifexists").parquet(path)
        return notes.sparkSession.read.schema(kept.schema).parquet(path)
    return kept
