"""Numbering, neighbours, batches and limits without a single global task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartspan.plans.scale import BIN_ROWS, by_range, per_range, rank_in_bins, rank_in_order, ranged

BATCH = 50


def sort_annotations(annotations: DataFrame) -> DataFrame:
    """By note, start, end: a range-partitioned sort, so no note has to fit one task."""
    return annotations.orderBy("note_id", "start", "end", "ann_id")


def assign_batches(notes: DataFrame, order: str = "pos", size: int = BATCH) -> DataFrame:
    """Number the notes in order and cut them into work batches: a prefix scan, whatever the order's values are."""
    numbered = rank_in_order(notes, order, "rn")
    return numbered.withColumn("batch", F.ceil(F.col("rn") / size))


def batch_count(notes: DataFrame, size: int = BATCH) -> DataFrame:
    return notes.agg(F.ceil(F.count(F.lit(1)) / size).alias("batches"))


def limit_notes(notes: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """First ``n`` notes: a top-n, not a sort of the corpus."""
    return notes.orderBy(order).limit(n)


def next_unannotated(notes: DataFrame, annotations: DataFrame, order: str = "pos") -> DataFrame:
    """For each note the order value of the next note without annotations, null at the end.

    Inside a range of the order the answer is a minimum over the rows that follow; past it, the
    first free note of the nearest later range that has one.
    """
    tagged = annotations.select("note_id").distinct().withColumn("__tagged", F.lit(True))
    flagged = notes.select("note_id", order).join(tagged, "note_id", "left").select(
        "note_id", order, F.when(F.col("__tagged").isNull(), F.col(order)).alias("__free"))
    ranges = ranged(flagged, order)
    beyond, nearest = {}, None
    for i, first in reversed(per_range(ranges, F.min("__free"))):
        beyond[i] = nearest
        nearest = nearest if first is None else first
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return ranges.select(
        "note_id", order, F.coalesce(F.min("__free").over(inside), by_range(beyond)).alias("next_pos"))


def rank_annotations(annotations: DataFrame, name: str = "rank") -> DataFrame:
    """Position of an annotation among its note's, by start then insertion (``seq``)."""
    return rank_in_bins(annotations, ["note_id"], "seq", name, position="start")


def neighbour_annotations(annotations: DataFrame) -> DataFrame:
    """Previous and next annotation of the note by start and ``seq``, wrapping at its ends, with the
    distance of their starts.

    Annotations of one start lie in bins of bounded size; neighbours are read inside the bin.
    Only a bin's first and last annotation go into the note's order, which the text bounds.
    """
    at = annotations.select(
        "note_id", "ann_id", "start", "seq", F.coalesce("start", F.lit(-1)).alias("__at"),
        F.coalesce(F.floor(F.col("seq") / BIN_ROWS), F.lit(-1)).alias("__slot"))
    bins = at.groupBy("note_id", "__at", "__slot").agg(
        F.min(F.struct("seq", "ann_id", "start")).alias("__head"), F.max(F.struct("seq", "ann_id", "start")).alias("__tail"))
    order = Window.partitionBy("note_id").orderBy("__at", "__slot")
    note = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = bins.select(
        "note_id", "__at", "__slot",
        F.coalesce(F.lag("__tail").over(order), F.last("__tail").over(note)).alias("__before"),
        F.coalesce(F.lead("__head").over(order), F.first("__head").over(note)).alias("__after"))
    inside = Window.partitionBy("note_id", "__at", "__slot").orderBy("seq")
    me = F.struct("seq", "ann_id", "start")
    return at.join(edges, ["note_id", "__at", "__slot"]).select(
        "note_id", "ann_id", "start",
        F.coalesce(F.lag(me).over(inside), "__before").alias("__prev"),
        F.coalesce(F.lead(me).over(inside), "__after").alias("__next"),
    ).select(
        "note_id", "ann_id", F.col("__prev.ann_id").alias("prev_id"), F.col("__next.ann_id").alias("next_id"),
        (F.col("start") - F.col("__prev.start")).alias("prev_distance"),
        (F.col("__next.start") - F.col("start")).alias("next_distance"),
    )


def dedupe_note_ids(notes: DataFrame, order: str = "pos") -> DataFrame:
    """Second and later notes with one id get ``_2``, ``_3``… in order of arrival."""
    ranked = rank_in_bins(notes, ["note_id"], order, "__rn")
    return ranked.withColumn(
        "note_id",
        F.when(F.col("__rn") > 1, F.concat_ws("_", "note_id", F.col("__rn").cast("string")))
        .otherwise(F.col("note_id")),
    ).drop("__rn")


def distinct_sections_in_order(badges: DataFrame) -> DataFrame:
    """Sections of a note by first position."""
    first = badges.groupBy("note_id", "section").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("note_id").orderBy("pos")
    return first.withColumn("section_no", F.row_number().over(order))
