"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.plans.session import BATCH_ROWS, by_value, new_folder, shared_folder, text_batches  # noqa: F401

#: White space of the word contracts, and the class of everything else.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder as compressed Parquet and read again: the lineage ends, and the size is known."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def side(key: Column) -> Column:
    """Second join key that follows from the first.

    A side that was just grouped by the key alone then counts as not yet dealt out for the
    join, both sides get an exchange of their own, and the adaptive plan may split a hot key.
    """
    return F.pmod(F.xxhash64(key), F.lit(7))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside the named columns: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(name) for name, c in columns.items()])
