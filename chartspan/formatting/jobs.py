"""The format jobs: NOTE in, NOTE out, text rewritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.formatting import breaks, clinical, repairs  # noqa: F401  (register their steps)
from chartspan.formatting.engine import STEPS, chained
from chartspan.functions.text import strip

WIDTH = 98
COLLAPSE = 7

JOBS = sorted({s.job for s in STEPS})


def _run(notes: DataFrame, rules: list) -> DataFrame:
    """Apply rules to the text column.

    Rules are nested a few at a time: one projection each would make the plan long to analyse,
    all in one would make the expression deep.
    """
    for at in range(0, len(rules), 12):
        text: Column = F.col("text")
        for rule in rules[at:at + 12]:
            text = rule(text)
        notes = notes.withColumn("text", text)
    return notes


def format_job(notes: DataFrame, job: str) -> DataFrame:
    """One job: its rules in their order."""
    rules = chained(s for s in sorted(STEPS, key=lambda s: s.no) if s.job == job)
    if not rules:
        raise ValueError(f"unknown job {job}; one of {', '.join(JOBS)}")
    return _run(notes, rules)


def format_notes(notes: DataFrame, width: int = WIDTH, keep_gaps: bool = False) -> DataFrame:
    """All rules of all jobs in their overall order, then trimmed.

    ``keep_gaps`` leaves runs of blanks in place until the rules that cut at gaps have run; by
    default runs are collapsed first.
    """
    ordered = sorted(STEPS, key=lambda s: s.no)
    if keep_gaps:
        early = [s for s in ordered if s.no < 60 and s.no != COLLAPSE]
        collapse = [s for s in ordered if s.no == COLLAPSE]
        ordered = early + collapse + [s for s in ordered if s.no >= 60]
    rules = chained(ordered)
    if width != WIDTH:
        rules.append(lambda t: repairs.wrap(t, width))
    return _run(notes, rules + [strip])


def format_with_fallback(
    notes: DataFrame, mode: str, predicted: DataFrame | None = None
) -> DataFrame:
    """Text under a mode: ``none``, ``regex`` or ``model``.

    For ``model``, ``predicted`` holds (note_id, text, error) from a scored run; a note without a
    prediction, or with an error, falls back to the rules and says why. Only those notes are
    formatted by rule.
    """
    no_error = F.lit(None).cast("string").alias("error")
    if mode == "none":
        return notes.select("*", F.lit("none").alias("mode"), no_error)
    if mode == "regex":
        return format_notes(notes).select("*", F.lit("regex").alias("mode"), no_error)
    if mode != "model" or predicted is None:
        raise ValueError(f"unknown mode {mode}, or no predictions given")
    result = predicted.select(
        "note_id", F.col("text").alias("__text"), F.col("error").alias("__error"))
    joined = notes.join(result, "note_id", "left")
    good = F.col("__text").isNotNull() & F.col("__error").isNull()
    cols = [c for c in notes.columns if c != "text"]
    done = joined.where(good).select(
        *cols, F.col("__text").alias("text"), F.lit("model").alias("mode"), no_error)
    why = F.concat(F.lit("Model error: "), F.coalesce("__error", F.lit("Unknown")),
                   F.lit(" - using regex fallback"))
    failed = joined.where(~good).select(*cols, "text", why.alias("error"))
    fallen = format_notes(failed).select(*cols, "text", F.lit("regex").alias("mode"), "error")
    return done.unionByName(fallen)


def format_diff(notes: DataFrame, formatted: DataFrame) -> DataFrame:
    """Raw against formatted: line counts, breaks added, changed or not."""
    after = formatted.select("note_id", F.col("text").alias("__after"))
    before = F.coalesce("raw_text", "text")
    lines = lambda c: F.size(F.split(c, "\n", -1))
    return notes.join(after, "note_id").select(
        "note_id",
        lines(before).alias("raw_lines"),
        lines(F.col("__after")).alias("formatted_lines"),
        (lines(F.col("__after")) - lines(before)).alias("breaks_added"),
        (before != F.col("__after")).alias("changed"),
    )
