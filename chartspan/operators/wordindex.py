"""A stored word index: a dictionary of word parts in front of bucketed postings.

Every part of the index is a folder ``part=k`` with three tables:

* ``grams``: (gram, word) for the runs of two and three characters of each distinct word, cut into buckets
  by the gram;
* ``postings``: (word, note_id), cut into buckets by the word;
* ``members``: the note ids of the part, which stand for these notes in place of any earlier part.

Buckets are written through Spark's rebalancing: small ones share a task, one that a frequent word makes large is split.

A look-up of a query word reads the buckets of its grams, keeps the dictionary words that contain it, and reads
the buckets of those words. It never meets the other postings. Adding notes writes a part and touches no other;
``merge_word_index`` folds all parts into one.

A part counts once its row stands in ``log``, written last. A writer that is lost halfway leaves no row, and the
next one writes the same part anew. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.operators.matching import build_word_index, query_words

BUCKETS = 64

_LOG = "part int, first int, buckets int"


@dataclass(frozen=True)
class Parts:
    """Numbers of the parts that count, oldest first, and the buckets of the index."""

    numbers: tuple[int, ...]
    buckets: int

    @property
    def next(self) -> int:
        return self.numbers[-1] + 1 if self.numbers else 0


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def index_parts(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Parts:
    """What the log names; ``buckets`` is taken where no part has been written."""
    log = f"{path}/log"
    if not _exists(spark, log):
        return Parts((), buckets)
    rows = spark.read.schema(_LOG).parquet(log).collect()  # a row a part
    if not rows:
        return Parts((), buckets)
    first = max(r["first"] for r in rows)
    return Parts(tuple(sorted({r["part"] for r in rows if r["part"] >= first})), rows[0]["buckets"])


def grams(word: Column) -> Column:
    """Distinct runs of two and of three characters."""
    def runs(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(word) - F.lit(n - 1))
        return F.when(F.length(word) >= n, F.transform(at, lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array())

    return F.array_distinct(F.concat(runs(2), runs(3)))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_part(spark: SparkSession, path: str, at: Parts, postings: DataFrame, members: DataFrame, first: int) -> None:
    folder = f"{path}/part={at.next}"
    held = postings.withColumn("bucket", _bucket(F.col("word"), at.buckets))
    (held.hint("rebalance", "bucket")
     .write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings"))
    words = spark.read.parquet(f"{folder}/postings").select("word").distinct()
    parts = words.select(F.explode(grams(F.col("word"))).alias("gram"), "word")
    (parts.withColumn("bucket", _bucket(F.col("gram"), at.buckets))
     .hint("rebalance", "bucket")
     .write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/grams"))
    members.select("note_id").distinct().write.mode("overwrite").parquet(f"{folder}/members")
    spark.createDataFrame([(at.next, first, at.buckets)], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def add_to_word_index(notes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Index ``notes`` as a new part. A note indexed before is found by its new words only.

    Null texts give the words of the id; notes without an id are left out. An id that occurs twice in ``notes`` has the
    words of both texts. No notes, no part.
    """
    spark = notes.sparkSession
    given = notes.where("note_id is not null").select("note_id", F.coalesce("text", F.lit("")).alias("text"))
    if given.isEmpty():
        return
    at = index_parts(spark, path, buckets)
    _write_part(spark, path, at, build_word_index(given).distinct(), given, at.numbers[0] if at.numbers else 0)


def _any_of(column: str, values: list) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def _read(spark: SparkSession, path: str, part: int, table: str, schema: str) -> DataFrame:
    """A table of a part. A part without any word has no bucket, so the schema is given."""
    return spark.read.schema(schema).parquet(f"{path}/part={part}/{table}")


def _current(spark: SparkSession, path: str, at: Parts, found: list[DataFrame]) -> DataFrame:
    """Rows with a note id, a frame a part, without notes that a later part holds anew."""
    out, later = [], None
    for part, rows in zip(reversed(at.numbers), reversed(found)):
        out.append(rows if later is None else rows.join(later, "note_id", "left_anti"))
        mine = _read(spark, path, part, "members", "note_id string")
        later = mine if later is None else later.unionByName(mine)
    return reduce(DataFrame.unionByName, out)


def words_containing(spark: SparkSession, path: str, part: int, buckets: int, words: list[str]) -> DataFrame:
    """Dictionary words of a part that contain any of ``words`` (two characters or more each).

    A word that contains a query word has all its grams, so the rows of one gram hold every candidate; each is verified.
    The gram in the middle is taken: words share their beginnings and endings more than the rest.
    """
    table = _read(spark, path, part, "grams", "gram string, word string, bucket int")
    picked = {w: w[max(0, len(w) // 2 - 1):][:3] if len(w) > 2 else w for w in words}
    places = _buckets_of(spark, sorted(set(picked.values())), buckets)
    found = [table.where((F.col("bucket") == places[g]) & (F.col("gram") == g) & F.col("word").contains(w)).select("word")
             for w, g in picked.items()]
    return reduce(DataFrame.unionByName, found).distinct()


def _buckets_of(spark: SparkSession, keys: list[str], buckets: int) -> dict[str, int]:
    """The bucket of every key of a query, as the writer computed it."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), _bucket(F.lit(k), buckets).alias("b")) for k in keys])
    return dict(spark.range(1).select(F.inline(pairs)).collect())


def look_up(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Distinct ids of indexed notes with a word that contains any word of the query.

    A query without a usable word finds no id here (``search_stored_index`` returns all notes then).
    """
    at, words = index_parts(spark, path), query_words(query)
    if not at.numbers or not words:
        return spark.createDataFrame([], "note_id string")
    found = []
    for part in at.numbers:
        hits = words_containing(spark, path, part, at.buckets, words)
        # at most one number a bucket reaches the driver, to prune folders
        needed = sorted(r[0] for r in hits.select(_bucket(F.col("word"), at.buckets)).distinct().collect())
        postings = _read(spark, path, part, "postings", "word string, note_id string, bucket int")
        rows = postings.where(_any_of("bucket", needed)).join(hits, "word", "left_semi")
        found.append(rows.select("note_id").distinct())
    return _current(spark, path, at, found).distinct()


def search_stored_index(notes: DataFrame, path: str, query: str) -> DataFrame:
    """Notes with an indexed word that contains any word of the query; no usable word, all notes."""
    if not query_words(query):
        return notes
    return notes.join(look_up(notes.sparkSession, path, query), "note_id", "left_semi")


def stored_postings(spark: SparkSession, path: str) -> DataFrame:
    """(word, note_id) of the notes as last indexed."""
    at = index_parts(spark, path)
    if not at.numbers:
        return spark.createDataFrame([], "word string, note_id string")
    return _current(spark, path, at, [
        _read(spark, path, p, "postings", "word string, note_id string, bucket int").select("word", "note_id")
        for p in at.numbers])


def merge_word_index(spark: SparkSession, path: str) -> None:
    """Fold all parts into one; what later parts hold anew goes. Earlier folders stay for readers under way."""
    at = index_parts(spark, path)
    if len(at.numbers) < 2:
        return
    members = reduce(DataFrame.unionByName, [_read(spark, path, p, "members", "note_id string") for p in at.numbers])
    _write_part(spark, path, at, stored_postings(spark, path), members, at.next)
