"""Mixing sources to target weights by Pareto order sampling.

Every document of a source gets the same expected number of copies: the source's target over
its size, or, with ``measure``, a share in proportion to a given measure. The whole part of
that number is certain. For the rest the documents are ranked by random odds over inclusion
odds, ``u / (1 - u)`` over ``p / (1 - p)``, and taken in that order until the words still
missing are covered, up to the document that comes closest: a sample of fixed size in words
with unequal probabilities. Random numbers are hashes of the document id, so runs agree.

No source is sorted as a whole. The ranking values are counted in fine bins, bins before the
one that holds the cut are taken, bins after it are not, and only the rows of the one bin that
holds the cut are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.llm.common import WORD, checkpointed, packed, side

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Rows a bin of ranking values should hold, and the steps from 0 to 1 that bins are cut from.
BIN_ROWS = 2048
STEPS = 1 << 20


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_unit(doc_id: Column, seed: str) -> Column:
    """A number inside (0, 1) that follows from the id: 48 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("/", doc_id.cast("string"), F.lit(seed)).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` per source.

    Weights repeat over the sources in code point order, null last. Targets share ``share``
    times all sizes by weight; none exceeds ``most`` times its source's size, and the excess
    goes to the others by weight. Filling by rising ``size / weight`` settles all rounds of
    that at once: the sources up to the last that is full keep their limit. Expects one row
    per distinct source, which is what the two global windows run over.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(order)
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = weighed.select(
        "*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weight"),
        F.sum("source_size").over(whole).alias("all_size"), F.sum("weight").over(whole).alias("all_weight"))
    left = F.lit(share) * F.col("all_size") - most * F.col("full_size")
    fits = F.col("weight") * left <= most * F.col("source_size") * (F.col("all_weight") - F.col("full_weight"))
    cut = running.select("*", F.min(F.when(fits, F.col("full_weight"))).over(whole).alias("cut_weight"),
                         F.min(F.when(fits, F.struct("full_weight", left.alias("left")))).over(whole)["left"].alias("left"))
    share_of = F.col("weight") * F.col("left") / (F.col("all_weight") - F.col("cut_weight"))
    full = F.col("cut_weight").isNull() | (F.col("full_weight") < F.col("cut_weight"))
    return cut.select("source", "source_size",
                      F.when(full, (most * F.col("source_size")).cast("double")).otherwise(share_of).alias("target"))


def allocate(sizes: DataFrame, targets: DataFrame, seed: str = "mix", measure: str | None = None,
             most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for rows ``doc_id, source, size``.

    ``measure`` names a column of ``sizes`` that expected copies follow within a source (null
    or negative: none); without it all documents of a source expect the same. Expected copies
    stop at ``most``; with a measure, a source may fall short of its target by what that cuts. Wordless rows get the certain copies only. Rows with equal ids and sizes
    rank alike and are told apart by nothing but their order in the cut bin.
    """
    weight = F.col("size") if measure is None else F.col("size") * F.greatest(F.coalesce(F.col(measure), F.lit(0.0)), F.lit(0.0))
    own = F.lit(1.0) if measure is None else F.greatest(F.coalesce(F.col(measure), F.lit(0.0)), F.lit(0.0)).cast("double")
    rows = sizes.select("doc_id", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("k"),
                        "source", "size", own.alias("own"), weight.cast("double").alias("mass"))
    masses = rows.groupBy("k").agg(F.sum("mass").alias("mass_all"), F.count(F.lit(1)).alias("n_rows"))
    keyed = targets.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("k"),
                           "source_size", "target")
    plan = keyed.join(masses, "k")
    expected = F.least(F.lit(float(most)), F.when(F.col("mass_all") > 0, F.col("own") * F.col("target") / F.col("mass_all")).otherwise(0.0))
    spread = (rows.drop("mass").withColumn("s", side(F.col("k"))).join(plan.withColumn("s", side(F.col("k"))), ["k", "s"])
              .withColumn("expected", expected)
              .withColumn("certain", F.floor("expected"))
              .withColumn("p", F.col("expected") - F.col("certain")))
    u = random_unit(F.col("doc_id"), seed)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    bins = F.least(F.lit(float(STEPS)), F.greatest(F.lit(1.0), F.ceil(F.col("n_rows") / BIN_ROWS).cast("double")))
    ranked = checkpointed(
        spread.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), q))
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins))
        .select("doc_id", "source", "size", "k", "source_size", "target", "certain", "q", "bin"))
    sure = ranked.groupBy("k").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"),
                                   F.first("target").alias("target"))
    counted = ranked.where("q is not null").groupBy("k", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = (counted.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
             .join(sure, "k").withColumn("missing", F.col("target") - F.col("sure"))
             .where("before < missing and before + words >= missing")
             .select("k", F.col("bin").alias("cut_bin"), "before", "missing"))
    none_cut = sure.join(edges, "k", "left").select(
        "k", F.coalesce("cut_bin", F.when(F.col("target") - F.col("sure") > 0, F.lit(1 << 40)).otherwise(-1)).alias("cut_bin"),
        "before", "missing")
    told = (ranked.withColumn("s", side(F.col("k")))
            .join(checkpointed(none_cut).withColumn("s", side(F.col("k"))), ["k", "s"]))
    at_cut = F.col("q").isNotNull() & (F.col("bin") == F.col("cut_bin"))
    order = Window.partitionBy("k").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = told.where(at_cut).withColumn("upto", F.col("before") + F.sum("size").over(order))
    extra_in = (F.col("upto") - F.col("size") / 2.0 < F.col("missing")).cast("long")
    extra_out = (F.col("q").isNotNull() & (F.col("bin") < F.col("cut_bin"))).cast("long")
    names = ["doc_id", "source", "size", "source_size", "target"]
    return (inside.select(*names, (F.col("certain") + extra_in).alias("copies"))
            .unionByName(told.where(~at_cut).select(*names, (F.col("certain") + extra_out).alias("copies"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        seed: str = "mix", measure: str | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    Null texts have size 0, null sources are one source, null ids share one random number,
    repeated rows are rows of their own, an empty table gives no rows, other columns are
    ignored. Rows of size 0 take no words.
    """
    chosen = ["doc_id", "source", word_count(F.col("text")).alias("size")] + ([measure] if measure else [])
    sizes = checkpointed(docs.select(*chosen))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(by_source, weights, share, most))
    return (allocate(sizes, targets, seed, measure, most)
            .withColumn("taken", F.col("copies") * F.col("size")))


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their words, targets and ``copies`` beside them.

    Added columns are ``size, source_size, target, copies, taken``; columns of ``docs`` with
    those names give way. Rows of one id with the same size and source share their copies'
    order; rows without id or words stay only with a copy of their own.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    rows = packed(docs.drop(*added), doc_id=F.col("doc_id"), source=F.col("source"),
                  size=word_count(F.col("text")))
    mixed = mix(docs, **options).groupBy("doc_id", "source", "size").agg(
        *[F.max(c).alias(c) for c in added[1:]])
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("doc_id", "source", "size")]
    return (rows.alias("r").join(mixed.where("copies > 0").alias("m"), same)
            .select("r.row.*", "r.size", *[f"m.{c}" for c in added[1:]]))
