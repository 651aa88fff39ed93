"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight
bytes, so they share at least six positional bytes: the count filter's guaranteed minimum.
Lists of single bytes would hold 1/256 of all fingerprints each and their pairs would grow
with the square of the corpus. The index therefore keys its lists by six (position, byte)
postings at once: being in a common list *is* the tally reaching six. A list can hold at most
65,536 distinct fingerprints (two free bytes), whatever the corpus, and is linked in time
linear in its size; every link is verified on the exact bit difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, checkpointed, packed, side, text_batches
from chartspan.llm.graph import connected_components

by_value(__name__)

BYTES, FAR = 8, 2
SEED = 42
#: Byte positions left free by each of the 28 keys.
FREE = list(combinations(range(BYTES), FAR))
_CHUNK = 1 << 16
_FEW = 24


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _kept(free: tuple[int, ...]) -> int:
    return ~sum(0xFF << 8 * p for p in free) & (1 << 64) - 1


def text_fingerprint(text: str | None, width: int) -> int:
    """SimHash of the word shingles; bytes split on the ASCII white space and fold only A-Z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = zip(*(islice(words, i, None) for i in range(width)))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total = np.zeros(64, np.int64), 0
    while chunk := [digest(join(s), SEED) for s in islice(shingles, _CHUNK)]:
        bits = np.unpackbits(np.array(chunk, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(chunk)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """Signed 64-bit SimHash of a text column (null and wordless texts: zero)."""

    text_batches()

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        values = [text_fingerprint(t, width) for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return simhash(text)


def _masks() -> np.ndarray:
    """All differences of one or two bits in sixteen."""
    single = [1 << i for i in range(16)]
    return np.array(single + [a | b for a, b in combinations(single, 2)], np.int64)


def _links(members: np.ndarray, free: tuple[int, int], masks: np.ndarray) -> np.ndarray:
    """Spanning links of the groups that one list's fingerprints form at two bits or fewer.

    Few members are compared directly; more are looked up by flipping the 136 differences in
    a table of the two free bytes, so the work is linear in the list.
    """
    n = len(members)
    order = np.arange(n)
    if n <= _FEW:
        near = np.bitwise_count(members[:, None] ^ members[None, :]) <= FAR
        a, b = np.nonzero(near)
        ends = [(a, b)]
    else:
        low, high = (np.uint64(8 * p) for p in free)
        byte = np.uint64(255)
        code = ((members >> low) & byte | ((members >> high) & byte) << np.uint64(8)).astype(np.int64)
        place = np.full(1 << 16, -1, np.int64)
        place[code] = order
        ends = []
        for mask in masks:
            other = place[code ^ mask]
            hit = np.flatnonzero(other >= 0)
            ends.append((hit, other[hit]))
    label = order
    while True:
        fresh = label.copy()
        for a, b in ends:
            np.minimum.at(fresh, a, label[b])
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    out = np.flatnonzero(label != order)
    return np.stack([members[out], members[label[out]]], axis=1)


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = _masks()
    for batch in batches:
        found = [np.zeros((0, 2), np.uint64)]
        for which, members in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = members.values.to_numpy().view(np.uint64)
            found.append(_links(values, FREE[which], masks))
        pairs = np.concatenate(found).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that span the groups at two bits."""
    keys = F.explode(F.array(*[
        F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(_kept(free)))).alias("shared"))
        for i, free in enumerate(FREE)])).alias("key")
    lists = (prints.select("fp", keys).groupBy("key.which", "key.shared")
             .agg(F.array_sort(F.collect_list("fp")).alias("members")).where(F.size("members") > 1))
    return lists.select("which", "members").mapInArrow(_link_lists, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Rows whose fingerprints are connected by steps of at most two bits get the least
    ``doc_id`` of their group. Exact copies fold into one fingerprint before any pairing.
    Null or wordless texts have fingerprint zero and link like any other; null ids get a
    component but never name one (null where a whole group has none); repeated rows stay; an
    empty table gives no rows; other columns are ignored.
    """
    slim = checkpointed(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")))
    prints = checkpointed(slim.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(prints))
    known = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    known = checkpointed(known)
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = (known.withColumn("s", side(F.col("root")))
             .join(names.withColumn("s", side(F.col("root"))), ["root", "s"])
             .select("fp", "root", "component_id"))
    return (slim.withColumn("s", side(F.col("fp")))
            .join(named.withColumn("s", side(F.col("fp"))), ["fp", "s"])
            .select("doc_id", "fp", "root", "component_id"))


def drop_near_copies(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each SimHash group, the one of the least id.

    Of several rows of that id in the group the least by content hash stays; an id that is
    repeated in another group stays there too. Rows without an id stay only where no row of
    their group has one, one row to a group. An empty table gives no rows.
    """
    groups = simhash_groups(docs, width)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("k"))
    kept = checkpointed(kept.select(F.col("k.doc_id").alias("id"), F.col("k.fp").alias("print")))
    rows = packed(docs, doc_id=F.col("doc_id"), fp=fingerprint(F.col("text"), width), hash=F.xxhash64("text"))
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("print")), "left_semi")
    return found.groupBy("doc_id", "fp").agg(F.min_by("row", "hash").alias("row")).select("row.*")
