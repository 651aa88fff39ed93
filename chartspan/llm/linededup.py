"""Repeated lines, found by a pair of Bloom filters and confirmed exactly.

Every task keeps two filters while it reads its texts: one of keys seen in a document, one of
keys met again. The filters of two tasks combine by bits: once = a | b, twice = a | b | (once
of a & once of b). That is associative and never forgets a repeat, so the tasks' filters are
merged block by block, as a stream, in any order.

Only keys that the twice-filter holds leave their task, combined there to one row a key; they
are counted exactly, which settles what is repeated and where it comes first. The filters
have a documented largest size. Beyond it more keys are suspected and counted for nothing;
the result stays exact.

A key is told apart by a 128-bit hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, checkpointed, side, text_batches

by_value(__name__)

#: Bits to a block; a key sets ``PROBES`` bits of one block.
BLOCK_BITS, PROBES = 1 << 16, 4
BLOCK = BLOCK_BITS // 8
#: Bits of filter to a line, and the most blocks of a filter (64 MB).
BITS, MOST_BLOCKS = 12, 8192
#: Repeated keys that are sent to every task; more are joined to the texts instead.
TABLE_ROWS = 1_000_000

_FIRST = "first struct<nameless: boolean, doc_id: bigint, line: bigint>"


def line_keys(text: str | bytes | None, min_chars: int = 1) -> list[bytes | None]:
    """Key of each line: ASCII white space off both ends, A-Z lower-cased; None where too short."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    keys = [line.strip().lower() for line in raw.split(b"\n")]
    if min_chars <= 1:
        return [k or None for k in keys] if min_chars == 1 else keys
    return [k if len(k) >= min_chars and len(k.decode("utf-8", "surrogatepass")) >= min_chars else None for k in keys]


def digests(keys: list[bytes | None]) -> list[bytes | None]:
    return [k if k is None else xxhash.xxh3_128_digest(k) for k in keys]


class Filters:
    """The pair of filters of one task."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.once = np.zeros(blocks * BLOCK, np.uint8)
        self.twice = np.zeros(blocks * BLOCK, np.uint8)

    def add(self, found: Counter) -> None:
        """Count documents that hold each digest; met twice, here or before, goes into both."""
        if not found:
            return
        at = positions(list(found), self.blocks)
        again = (np.fromiter(found.values(), np.int64, len(found)) > 1) | held(self.once, at)
        _set(self.twice, at[again])
        _set(self.once, at)


def positions(found: list[bytes], blocks: int) -> np.ndarray:
    """Bit numbers, one row a digest: its block and ``PROBES`` places in there."""
    words = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
    block = (words[:, 0] % np.uint64(blocks)).astype(np.int64)
    return block[:, None] * BLOCK_BITS + np.ascontiguousarray(words[:, 1:]).view("<u2").astype(np.int64)


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    if not len(at):
        return
    byte = at >> 3
    starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
    bits[byte[starts]] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), starts)


def pack(block: np.ndarray) -> bytes:
    """A block as its bytes, or as the numbers of its bits where those are shorter."""
    at = np.flatnonzero(np.unpackbits(block, bitorder="little"))
    return at.astype("<u2").tobytes() if 2 * len(at) < BLOCK else block.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if len(packed) == BLOCK:
        return np.frombuffer(packed, np.uint8)
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[np.frombuffer(packed, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def _rows(blocks: list[int], once: list[bytes], twice: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])


def _filled(blocks: int, min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(blocks)
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found.update({d for d in digests(line_keys(text, min_chars)) if d is not None})
            own.add(found)
        once, twice = own.once.reshape(-1, BLOCK), own.twice.reshape(-1, BLOCK)
        some = np.flatnonzero(once.any(axis=1)).tolist()
        for i in range(0, len(some), 64):
            part = some[i:i + 64]
            yield _rows(part, [pack(once[b]) for b in part], [pack(twice[b]) for b in part])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows that come ordered by block; one block is in memory at a time."""
    at, once, twice = None, None, None
    for batch in batches:
        for block, o, t in zip(*(c.to_pylist() for c in batch.columns)):
            o, t = unpack(o), unpack(t)
            if block == at:
                once, twice = once | o, twice | t | (once & o)
                continue
            if at is not None and twice.any():
                yield _rows([at], [b""], [pack(twice)])
            at, once, twice = block, o, t
    if at is not None and twice.any():
        yield _rows([at], [b""], [pack(twice)])


def twice_filter(docs: DataFrame, min_chars: int = 1, most_blocks: int = MOST_BLOCKS) -> tuple[int, DataFrame]:
    """Number of blocks, and ``block, twice``: the merged filter of keys that several rows of ``docs`` may hold."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    blocks = min(most_blocks, max(1, -(-lines * BITS // BLOCK_BITS)))
    text_batches()
    parts = docs.select(F.col("text").cast("binary")).mapInArrow(_filled(blocks, min_chars), "block int, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block int, once binary, twice binary")
    return blocks, merged.select("block", "twice")


def _suspects(bits, blocks: int, min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``id, line, key`` of the distinct keys of each text that the filter holds, at their first line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(blocks * BLOCK, np.uint8)
        for block, packed in bits.value:
            filled[block * BLOCK:(block + 1) * BLOCK] = unpack(packed)
        for batch in batches:
            rows, lines, keys = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                first: dict[bytes, int] = {}
                for line, d in enumerate(digests(line_keys(text, min_chars))):
                    if d is not None:
                        first.setdefault(d, line)
                rows += [i] * len(first)
                lines += first.values()
                keys += first
            hit = np.flatnonzero(held(filled, positions(keys, blocks))) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.array(rows, np.int64)[hit])), pa.array(np.array(lines, np.int64)[hit]),
                 pa.array([keys[i] for i in hit], pa.binary())], ["id", "line", "key"])

    return run


def _suspected(docs: DataFrame, id_column: str, id_type: str, min_chars: int, filled: tuple) -> DataFrame:
    bits, blocks = filled
    return (docs.select(F.col(id_column).alias("id"), F.col("text").cast("binary"))
            .mapInArrow(_suspects(bits, blocks, min_chars), f"id {id_type}, line long, key binary"))


def _broadcast_filter(spark: SparkSession, docs: DataFrame, min_chars: int, most_blocks: int) -> tuple:
    """The filter for every task: at most ``most_blocks`` of 8 KB."""
    blocks, merged = twice_filter(docs, min_chars, most_blocks)
    return spark.sparkContext.broadcast([(r.block, bytes(r.twice)) for r in merged.collect()]), blocks


def repeated_keys(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``key, docs, first``: keys that at least ``min_docs`` rows of ``docs`` (``doc_id``, ``text``) hold.

    Each row is a document, whatever its id; ``first`` is the place of the least id (rows
    without one last). Only keys that the filter holds are shuffled.
    """
    filled = _broadcast_filter(docs.sparkSession, docs, min_chars, most_blocks)
    return _confirmed(docs, min_docs, min_chars, filled)


def _confirmed(docs: DataFrame, min_docs: int, min_chars: int, filled: tuple) -> DataFrame:
    rows = _suspected(docs, "doc_id", "long", min_chars, filled)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("doc_id"), "line")).alias("first")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), first).where(F.col("docs") >= min_docs)


def cut_lines(text: str | None, found: dict[bytes, tuple | None], min_chars: int, doc_id) -> tuple[int, int, str]:
    """Lines, dropped lines, and what is left of a text; ``found`` has the place that each repeated key keeps, if any."""
    lines = (text or "").split("\n")
    kept, seen = [], set()
    for i, (line, d) in enumerate(zip(lines, digests(line_keys(text, min_chars)))):
        if d is None or d not in found:
            kept.append(line)
        elif found[d] == (doc_id, i) and d not in seen:
            kept.append(line)
        if d is not None:
            seen.add(d)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


_CUT = "n_lines long, n_dropped long, text string"


def _cut_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "text"])


def _cut_by_table(table, min_chars: int) -> Callable:
    @F.pandas_udf(_CUT)
    def cut(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        return _cut_frame([cut_lines(t, table.value, min_chars, i) for t, i in zip(texts, _ids(ids))])

    return cut


def _cut_by_lists(min_chars: int) -> Callable:
    @F.pandas_udf(_CUT)
    def cut(texts: pd.Series, ids: pd.Series, keys: pd.Series, own: pd.Series, lines: pd.Series) -> pd.DataFrame:
        rows = []
        for t, i, k, o, n in zip(texts, _ids(ids), keys, own, lines):
            found = {} if k is None else dict(zip(k, [_place(a, b) for a, b in zip(o, n)]))
            rows.append(cut_lines(t, found, min_chars, i))
        return _cut_frame(rows)

    return cut


def _ids(ids: pd.Series) -> list:
    return [None if pd.isna(i) else int(i) for i in ids.astype("object")]


def _place(doc_id, line) -> tuple | None:
    """Where a key stays; nowhere without a line number."""
    if line is None or line < 0:
        return None
    return (None if doc_id is None or pd.isna(doc_id) else int(doc_id)), int(line)


def drop_repeated(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = False,
                  most_blocks: int = MOST_BLOCKS, table_rows: int = TABLE_ROWS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and a struct ``lines`` of ``n_lines, n_dropped``.

    A line goes where its key (ASCII white space off both ends, A-Z lower-cased, at least
    ``min_chars`` code points) is found in at least ``min_docs`` rows; with ``keep_first`` the
    first occurrence, by least ``doc_id`` and line, stays. Lines repeated inside one row only
    stay. A null text is an empty one: one line. Each row is a document: repeated rows count
    each, and all rows of the first id keep the line; rows without an id come last. An empty
    table gives no rows. Other columns are kept; one named ``lines`` is replaced.

    Up to ``table_rows`` repeated keys go to every task; more are joined to the distinct texts
    that hold them, so no task needs all of them.
    """
    docs = docs.drop("lines")
    spark = docs.sparkSession
    text_batches()
    filled = _broadcast_filter(spark, docs.select("doc_id", "text"), min_chars, most_blocks)
    found = checkpointed(_confirmed(docs.select("doc_id", "text"), min_docs, min_chars, filled))
    no_place = F.lit(None).cast("long")
    place = [F.col("first.doc_id").alias("own"), F.col("first.line").alias("line")] if keep_first else [no_place.alias("own"), F.lit(-1).cast("long").alias("line")]
    found = found.select("key", *place)
    text, doc_id = F.col("text"), F.col("doc_id").cast("long")
    if found.limit(table_rows + 1).count() <= table_rows:
        table = spark.sparkContext.broadcast({bytes(r.key): _place(r.own, r.line) for r in found.collect()})
        cut = docs.withColumn("lines", _cut_by_table(table, min_chars)(text, doc_id))
    else:
        mark = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
        texts = docs.select(mark.alias("mark"), "text").groupBy("mark").agg(F.first("text").alias("text"))
        held_in = (_suspected(texts, "mark", "string", min_chars, filled).drop("line").withColumn("s", side(F.col("key")))
                   .join(found.withColumn("s", side(F.col("key"))), ["key", "s"]).groupBy("id")
                   .agg(F.collect_list(F.struct("key", "own", "line")).alias("__found")))
        joined = (docs.withColumn("__mark", mark).withColumn("__s", side(F.col("__mark")))
                  .join(held_in.select(F.col("id").alias("__mark"), "__found", side(F.col("id")).alias("__s")), ["__mark", "__s"], "left"))
        cut = joined.withColumn("lines", _cut_by_lists(min_chars)(
            text, doc_id, F.col("__found.key"), F.col("__found.own"), F.col("__found.line"))).drop("__mark", "__s", "__found")
    return cut.withColumn("text", F.col("lines.text")).withColumn("lines", F.col("lines").dropFields("text"))
