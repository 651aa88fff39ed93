"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item counts as leaked into a document when the document holds at least ``threshold`` of
the item's distinct five-word shingles. Items are short and documents can be very long, so the
documents' own minima would almost never show an item. The sketch is therefore kept on the
item's side: the smallest hashes of its shingles (its MinHash bottom-k sketch), which are
looked up among all shingles of the documents. Sketches are partitioned by item size: an item
of ``n`` shingles may miss at most ``n - ceil(threshold * n)`` of them, so a sketch of one
more holds at least one shingle of every document that reaches the threshold. No document is
lost, whatever its length; the rows that the lookup returns are few.

A document of too few shingles for an item's partition is not compared with it. Candidates are
verified on the shingles themselves, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.llm.common import checkpointed, packed, side

WIDTH, THRESHOLD = 5, 0.8
#: Sketch rows up to which the lookup table is sent to every executor: 2 million rows of 20 bytes.
#: Beyond that both sides are dealt out by shingle instead, with the same result.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not again for each element of an inner lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(tokens: Column, width: int, join) -> Column:
    """``join`` of every ``width`` neighbours; of all tokens where there are fewer; nothing for none."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: join(tokens, i))
    return (F.when(n >= width, many).when(n > 0, F.array(join(tokens, F.lit(1))))
            .otherwise(F.slice(many, 1, 0)))


def shingle_texts(tokens: Column, width: int) -> Column:
    return _let(tokens, lambda t: _runs(t, width, lambda a, i: F.array_join(F.slice(a, i, width), " ")))


def shingle_hashes(tokens: Column, width: int) -> Column:
    """Hashes of the shingles, from one hash per word."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return _let(hashed, lambda t: _runs(t, width, lambda a, i: F.xxhash64(*[F.get(a, i - 1 + k) for k in range(width)])))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, shingle, hash, n`` with the distinct shingles of every item."""
    tokens = items.select("item_id", words(F.col("text")).alias("t"))
    pairs = F.arrays_zip(shingle_texts(F.col("t"), width).alias("shingle"), shingle_hashes(F.col("t"), width).alias("hash"))
    each = tokens.select("item_id", F.explode(pairs).alias("s")).select("item_id", "s.shingle", "s.hash").distinct()
    n = each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    joined = each.join(n.withColumnRenamed("item_id", "other"), F.col("item_id").eqNullSafe(F.col("other")))
    return joined.drop("other")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``hash, least``: bottom-k hashes, k by the size of the item, and the shingles a document needs."""
    need = F.ceil(F.col("n") * threshold - 1e-9)
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("hash", F.lit(1)), "hash")
    kept = shingles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("n") - need + 1)
    return kept.groupBy("hash").agg(F.min(need).alias("least"))


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, item_id, shared, n, containment`` of every document and item at the threshold.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; other columns are ignored.
    Null, empty and wordless texts hold nothing and match nothing. A text of fewer words than
    ``width`` has one shingle, all its words. Rows with the same id are judged together, a
    null id is an id, repeated rows change nothing, empty tables give no rows.
    """
    shingles = checkpointed(item_shingles(items, width))
    lookup = checkpointed(sketches(shingles, threshold))
    small = lookup.count() <= broadcast_rows
    tokens = docs.select("doc_id", "text", shingle_hashes(words(F.col("text")), width).alias("hashes"))
    probes = tokens.select("doc_id", F.size("hashes").alias("most"), F.explode("hashes").alias("hash"))
    hits = probes.join(F.broadcast(lookup) if small else lookup, "hash").where("most >= least")
    candidates = checkpointed(hits.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none")).distinct())
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"), "text")
    found = texts.join(candidates, ["id", "none"], "left_semi")
    own = (found.select("doc_id", F.explode(F.array_distinct(shingle_texts(words(F.col("text")), width))).alias("shingle"))
           .withColumn("s", side(F.col("shingle"))))
    asked = shingles.select("item_id", "n", "shingle").withColumn("s", side(F.col("shingle")))
    small_items = shingles.count() <= broadcast_rows
    shared = own.join(F.broadcast(asked) if small_items else asked, ["shingle", "s"])
    return (shared.groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("shared"), F.first("n").alias("n"))
            .withColumn("containment", F.col("shared") / F.col("n"))
            .where(F.col("shared") >= F.ceil(F.col("n") * threshold - 1e-9)))


def drop_leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose id holds a test item; all columns stay as they are."""
    leaked = leaks(docs, items, **options).select("doc_id").distinct()
    rows = packed(docs, doc_id=F.col("doc_id"))
    return (rows.alias("r").join(checkpointed(leaked).alias("l"), F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")), "left_anti")
            .select("row.*"))
