"""How far the sources of a language differ in their words, exactly, by bitmaps of equal counts.

Within a language every kept term has a count in each source. All terms of one count in one
source are a set of term numbers: a bitmap. The terms that have count i in one source and j in
another are the AND of two bitmaps, so a pair of sources needs one divergence term per cell
(i, j), times a popcount, and not one per word. Terms that a source lacks are the complement
of its bitmaps.

Term numbers are dealt to chunks of about ``CHUNK`` terms of similar frequency. Rare terms
have few different counts, so their chunks have few bitmaps; in a chunk of frequent terms no
source can have more bitmaps than there are terms. Sources go in blocks of about ``BLOCK``, and
a task compares two blocks on one chunk, so memory is bounded whatever the vocabulary and the
number of sources. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, checkpointed, text_batches

by_value(__name__)

#: Parts of a probability of one.
UNIT = 1_000_000_000
CHUNK, BLOCK = 256, 64
#: Terms that a task counts before it hands them on.
HELD = 600_000
SALTS = 16
#: A-Z to a-z, a-z and bytes above ASCII as they are, all else a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in held.items():
            n = len(words) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([None, *words], pa.binary()),
                 pa.array([0, *words.values()], pa.int64()), pa.array([0, *(docs[w] for w in words)], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            words, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = text.translate(_LETTERS).split()
            words.update(found)
            docs.update(set(found))
        if sum(len(words) for words, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and rows that hold them; a null term stands for the group itself.

    Terms are runs of letters and of code points beyond ASCII; only A-Z are lower-cased.
    """
    text_batches()
    blank = F.lit("")
    slim = docs.select(F.coalesce(F.col("lang"), blank).alias("lang"), F.coalesce(F.col("source"), blank).alias("source"),
                       F.coalesce(F.col("text"), blank).cast("binary").alias("text"))
    return (slim.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
            .groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _with_small(big: DataFrame, small: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Join a large side to a small one on keys that may be hot: the small side is copied ``SALTS`` times."""
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def _share(n: Column, all_of: Column) -> Column:
    """1 + floor(UNIT (n + 1) / all), exact for any long."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(n + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(all_of))


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The tables both parts need, each written once."""

    def __init__(self, docs: DataFrame, min_docs: int = 3):
        counts = checkpointed(term_counts(docs))
        total = (counts.where("term is not null").groupBy("lang", "term")
                 .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
                 .select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("bucket")))
        total = checkpointed(total)
        parts = total.groupBy("lang", "bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
        dealt = _with_small(total, parts, ["lang", "bucket"], F.col("term")).withColumn(
            "part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
        number = F.row_number().over(Window.partitionBy("lang", "bucket", "part").orderBy("term")) - 1
        #: ``lang, term, total, bucket, part, bit``
        self.terms = checkpointed(dealt.select("lang", "term", "total", "bucket", "part", number.alias("bit")))
        self.cells = checkpointed(counts.where("term is not null").select("lang", "source", "term", "n")
                                  .join(self.terms, ["lang", "term"]))
        kept = total.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("of_lang"))
        own = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("of_source"))
        groups = counts.select("lang", "source").distinct()
        blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        #: ``lang, source, own, whole, block, blocks``: what counts are divided by in the source and in the language
        self.groups = checkpointed(
            groups.join(own, ["lang", "source"], "left").join(kept, "lang", "left").join(blocks, "lang")
            .select("lang", "source", (zero("of_source") + zero("v")).alias("own"), (zero("of_lang") + zero("v")).alias("whole"),
                    F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), F.col("blocks").cast("int").alias("blocks")))


_CHUNK_KEY = ["lang", "bucket", "part"]


def bitmaps(audit: Audit) -> DataFrame:
    """One row per chunk and source: ``p`` of each count found there, and a bitmap of the chunk's terms for each."""
    none = F.lit(None)
    cells = audit.cells.select(*_CHUNK_KEY, "source", F.struct("bit", "n").alias("cell"), none.cast("int").alias("size"),
                               none.cast("long").alias("own"), none.cast("int").alias("block"), none.cast("int").alias("blocks"))
    sizes = audit.terms.groupBy(*_CHUNK_KEY).agg(F.count(F.lit(1)).cast("int").alias("size"))
    members = audit.groups.select("lang", "source", "own", "block", "blocks")
    every = _with_small(sizes, members, ["lang"], F.struct("bucket", "part")).select(
        *_CHUNK_KEY, "source", none.cast("struct<bit: int, n: bigint>").alias("cell"), "size", "own", "block", "blocks")
    # a source has one cell a term, so a list is as long as the chunk
    rows = (cells.unionByName(every).groupBy(*_CHUNK_KEY, "source")
            .agg(F.collect_list("cell").alias("cells"), *[F.max(c).alias(c) for c in ("size", "own", "block", "blocks")]))
    of = F.pandas_udf(_level_bitmaps, "p array<long>, bits binary")(F.col("cells.bit"), F.col("cells.n"), F.col("size"), F.col("own"))
    return rows.select(*_CHUNK_KEY, "block", "blocks", "source", of.alias("of")).select(
        *_CHUNK_KEY, "block", "blocks", "source", "of.p", "of.bits")


def _level_bitmaps(bits: pd.Series, counts: pd.Series, sizes: pd.Series, wholes: pd.Series) -> pd.DataFrame:
    out = []
    for bit, n, size, own in zip(bits, counts, sizes, wholes):
        levels, at = np.unique(n, return_inverse=True)
        rows = np.zeros((len(levels) + 1, -(-size // 64) * 64), np.uint8)
        rows[at + 1, np.asarray(bit, np.int64)] = 1
        # terms the source lacks: the complement of all its bitmaps
        rows[0, :size] = 1 - rows[1:, :size].any(axis=0)
        p = [1 + UNIT * (int(c) + 1) // int(own) for c in (0, *levels)]
        out.append((p, np.packbits(rows, axis=1, bitorder="little").tobytes()))
    return pd.DataFrame(out, columns=["p", "bits"])


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Divergence sums of all pairs of sources of two blocks over one chunk."""
    x = rows["x"].iloc[0]
    y = rows["y"].iloc[0]
    levels = [len(p) for p in rows["p"]]
    words = [np.frombuffer(b, "<u8").reshape(n, -1) for b, n in zip(rows["bits"], levels)]
    p = [np.array(v, np.int64) for v in rows["p"]]
    block = rows["block"].to_numpy()
    right = np.flatnonzero(block == y)
    all_words = np.concatenate([words[j] for j in right])
    all_p = np.concatenate([p[j] for j in right])
    owner = np.repeat(np.arange(len(right)), [levels[j] for j in right])
    a, b, value = [], [], []
    names = rows["source"].to_numpy()
    for i in np.flatnonzero(block == x):
        cells = np.bitwise_count(words[i][:, None, :] & all_words[None, :, :]).sum(axis=2, dtype=np.int64)
        at, to = np.nonzero(cells)
        n, of_a, of_b = cells[at, to], p[i][at], all_p[to]
        square = (of_a - of_b) ** 2
        for forth, q in ((True, of_b), (False, of_a)):
            if x == y and not forth:
                continue
            sums = np.zeros(len(right), np.int64)
            np.add.at(sums, owner[to], n * (square // q))
            mine, other = [names[i]] * len(right), names[right].tolist()
            a += mine if forth else other
            b += other if forth else mine
            value += sums.tolist()
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": a, "item": b, "value": value})


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def source_pairs(audit: Audit) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every ordered pair of sources of a language."""
    maps = checkpointed(bitmaps(audit))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    faced = maps.withColumn("other", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    sums = (faced.drop("other", "blocks").groupBy(*_CHUNK_KEY, "x", "y").applyInPandas(_compare, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")))
    names = audit.groups.select("lang", "source")
    pairs = _with_small(names, names.withColumnRenamed("source", "item"), ["lang"], F.col("source")).where("source <> item")
    return _ranked(pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long"))), "pair")


def telling_terms(audit: Audit, top: int = 200) -> DataFrame:
    """The ``top`` terms of every source that are more frequent there than in its language."""
    sized = _with_small(audit.cells, audit.groups.select("lang", "source", "own", "whole"), ["lang", "source"], F.col("term"))
    p, q = F.col("p"), F.col("q")
    found = (sized.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("own")).alias("p"),
                          _share(F.col("total"), F.col("whole")).alias("q"))
             .where("p > q").withColumn("value", _far(p, q)))
    return _ranked(found, "term").where(F.col("rank") <= top)


def audit_sources(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources and telling terms of each (lang, source).

    ``value`` is the sum over the kept terms (those in at least ``min_docs`` rows of their
    language) of floor((p - q)^2 / q), p and q being shares in billionths with one added to
    every count: chi-square distance to the other source (part ``pair``) or of one term to the
    language (part ``term``, the first ``top``). Null ``text``, ``lang`` and ``source`` are
    empty strings; groups without terms take part with all counts zero, languages without
    kept terms give zeros. Each row is a document, repeated rows too. Ties go to the smaller
    item. An empty table gives no rows; other columns are ignored.
    """
    audit = Audit(docs, min_docs)
    return source_pairs(audit).unionByName(telling_terms(audit, top))
