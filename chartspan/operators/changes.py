"""Change log of annotations: folding it, and the table as it was some changes ago."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_id(changes: DataFrame) -> DataFrame:
    """Last change of every annotation id. ``max_by`` combines map-side, so an id with very
    many changes sends one row per task."""
    rest = [c for c in changes.columns if c != "ann_id"]
    return changes.groupBy("ann_id").agg(
        F.max_by(F.struct(*rest), "seq").alias("last")
    ).select("ann_id", "last.*")


def fold_changes(changes: DataFrame) -> DataFrame:
    """Current annotations: the image after the last change, unless that was a removal."""
    return latest_per_id(changes).where(F.col("op") != "remove")


def rollback_changes(changes: DataFrame, k: int) -> DataFrame:
    """The table as it was ``k`` changes ago, however long the log; beyond its start, no rows.

    The ``k``-th newest sequence number is a top-k query, so the log is not sorted as a whole.
    """
    if k <= 0:
        return fold_changes(changes)
    newest = changes.select("seq").orderBy(F.desc("seq")).limit(k)
    cut = newest.agg(F.min("seq")).scalar()
    return fold_changes(changes.where(F.col("seq") < cut))
