"""Plans for groups of any size.

A group keyed by a note is bounded when its rows are pieces of that note's text (lines,
tokens, distinct offsets). Rows *about* a note (annotations, repeated ids) are not bounded,
so ranking and coverage over them go through the plans below, which split a hot key into
bounded bins and only ever put one small row per bin into a common window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.plans.session import new_folder

BIN_ROWS = 1 << 16
SPAN_BIN = 512


def rank_in_bins(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str,
    position: str | None = None,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """``row_number`` over ``keys`` ordered by (``position``, ``order``) without one task per key.

    ``order`` is an integer column, unique within the key. A bin is one value of ``position``
    (when given) and a run of ``bin_rows`` consecutive ``order`` values, so it holds at most
    ``bin_rows`` rows. Bin counts are combined map-side and summed over the bins of a key;
    rows are numbered inside their bin.
    """
    slot = F.floor(F.col(order) / F.lit(bin_rows)).cast("long")
    bins = ([position] if position else []) + ["__slot"]
    slotted = df.withColumn("__slot", slot)
    sizes = slotted.groupBy(*keys, *bins).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, *bins, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")
    )
    # null keys and orders are values like any other (null orders rank first)
    other = offsets.select(*[F.col(c).alias(f"__o_{c}") for c in [*keys, *bins]], "__offset")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in [*keys, *bins]])
    joined = slotted.join(other, same).drop(*[f"__o_{c}" for c in [*keys, *bins]])
    inside = Window.partitionBy(*keys, *bins).orderBy(order)
    return joined.withColumn(name, F.row_number().over(inside) + F.col("__offset")).drop(
        "__slot", "__offset"
    )


def ranged(df: DataFrame, order: str) -> DataFrame:
    """``df`` cut into ranges of ``order`` and written once, with the number of the range as ``__range``.

    Ranges follow the data, not its values, so sparse or uneven orders fill them alike. A later
    range holds only later rows; nulls come first.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "ranges")
    df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()).write.parquet(folder)
    return spark.read.parquet(folder)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder, for plans that read it in several places."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def per_range(ranges: DataFrame, value: Column) -> list[tuple]:
    """``(range, value)`` of an aggregate, in order: one row per range reaches the driver."""
    return sorted(tuple(r) for r in ranges.groupBy("__range").agg(value.alias("__value")).collect())


def by_range(values: dict[int, int | None]) -> Column:
    """The value of a row's range."""
    most = max(values, default=0)
    return F.element_at(F.array(*[F.lit(values.get(i)).cast("long") for i in range(most + 1)]), F.col("__range") + 1)


def rank_in_order(df: DataFrame, order: str, name: str) -> DataFrame:
    """``row_number`` over all rows by ``order`` (unique): a prefix scan over ranges.

    Rows are numbered inside their range; what earlier ranges hold is added.
    """
    ranges = ranged(df, order)
    before, offsets = 0, {}
    for i, n in per_range(ranges, F.count(F.lit(1))):
        offsets[i] = before
        before += n
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranges.withColumn(name, inside + by_range(offsets)).drop("__range")


def span_bins(start: Column, end: Column, width: int = SPAN_BIN) -> Column:
    """Bins of text positions a span touches; an empty span touches the bin of its start."""
    first = F.floor(start / width).cast("int")
    last = F.floor(F.greatest(end - 1, start) / width).cast("int")
    return F.sequence(first, last)


def bin_of(pos: Column, width: int = SPAN_BIN) -> Column:
    return F.floor(pos / width).cast("int")


def islands(df: DataFrame, key: list[str], start: str, end: str, gap: Column | int = 0) -> DataFrame:
    """Number the groups of spans that lie within ``gap`` of the running end.

    Input rows must be distinct per (key, start); the group is then bounded by the text.
    """
    prior = Window.partitionBy(*key).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(prior)
    fresh = (reach.isNull() | (F.col(start) - reach > gap)).cast("int")
    return df.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(upto)).drop("__new")
