"""The two end-to-end flows: import to stored notes, and notes to reviewed annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartspan.formatting.jobs import format_notes
from chartspan.operators.filters import smart_filter
from chartspan.operators.matching import auto_tag, match_questions
from chartspan.operators.rules import Rule
from chartspan.operators.stats import import_summary
from chartspan.sources.readers import read_notes_dir


def import_notes(spark: SparkSession, path: str, out: str, formatted: bool = True) -> DataFrame:
    """Read a folder tree, format the text, store notes and errors; returns the import summary."""
    notes, errors = read_notes_dir(spark, path)
    (format_notes(notes) if formatted else notes).write.mode("overwrite").parquet(f"{out}/notes")
    errors.write.mode("overwrite").parquet(f"{out}/errors")
    return import_summary(spark.read.parquet(f"{out}/notes"), spark.read.parquet(f"{out}/errors"))


def tag_notes(
    notes: DataFrame, rules: list[Rule], selected: list[str], min_length: int = 0, excludes: str = ""
) -> DataFrame:
    """Filter the corpus by question and tag every match: one scan, no shuffle."""
    chosen = [r for r in rules if r.question_id in selected]
    return auto_tag(match_questions(smart_filter(notes, rules, selected, min_length, excludes), chosen))
