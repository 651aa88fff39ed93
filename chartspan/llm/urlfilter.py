"""URL rules through Bloom filter cascades that are exact over a corpus.

A rule is a host and a path; it fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's. Every URL therefore has a few candidate keys (host suffix,
path beginning), of as many labels and characters as rules have. The distinct candidate keys
of the corpus are the key universe. One cascade holds the blocking rules, one the allowing:
level 1 encodes the listed keys, level 2 the unlisted keys of the universe that level 1 lets
through, level 3 the listed keys that level 2 lets through, and so on until nothing is let
through. The first level without a key decides by its parity, so membership is exact for
every key of the corpus, and URLs are judged on their own row by bit tests, without a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import checkpointed, packed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_LEVELS = 64
#: Rules up to which their keys are sent to every executor when the universe is split.
SENT_RULES = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.char_length(rest) + 4)).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(after, F.char_length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def candidate_keys(host: Column, path: Column, rules) -> Column:
    """Keys of a URL that a rule could equal, longest first (then the longer host)."""
    shapes = {(host_.count(".") + 1, len(path_)) for host_, path_ in map(split_rule, (r for _, r in rules))}
    labels = sorted({n for n, _ in shapes}, reverse=True)
    lengths = sorted({n for _, n in shapes}, reverse=True)
    tail = lambda n: F.substring_index(host, ".", -n)
    parts = F.size(F.split(host, r"\."))
    keys = F.array(*[
        F.when((parts >= n) & (F.char_length(path) >= k),
               F.struct((F.char_length(tail(n)) + k).alias("size"), F.char_length(tail(n)).alias("host_size"),
                        F.concat(tail(n), F.substring(path, 1, k)).alias("key")))
        for n in labels for k in lengths if (n, k) in shapes])
    return F.transform(F.reverse(F.array_sort(F.array_compact(keys))), lambda s: s["key"])


class Level:
    """One Bloom filter: its bits as longs, its size and its number of hashes."""

    def __init__(self, words: list[int], bits: int, hashes: int, salt: int):
        self.words, self.bits, self.hashes, self.salt = words, bits, hashes, salt

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt * 97 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        bits = F.array(*[F.lit(w).cast("long") for w in self.words]) if len(self.words) < 64 else F.from_json(
            F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        out = F.lit(True)
        for at in self.positions(key):
            word = F.get(bits, F.floor(at / 63).cast("int"))
            out = out & (F.getbit(word, (at % 63).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """Filter of the ``count`` keys (column ``key``) at a false positive rate; bits are set by an aggregation.

    The driver sees the finished filter, about ``1.44 * log2(1 / rate)`` bits a key.
    """
    bits = max(63, math.ceil(count * math.log2(1 / rate) / math.log(2)))
    level = Level([0] * math.ceil(bits / 63), bits, max(1, round(math.log2(1 / rate))), salt)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    word = at.groupBy(F.floor(F.col("at") / 63).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 63 as int))")).alias("bits"))
    for w, value in word.collect():
        level.words[w] = value
    return level


def build_cascade(listed: DataFrame, unlisted: DataFrame) -> list[Level]:
    """Levels that tell the keys of ``listed`` from those of ``unlisted`` (column ``key``, distinct) exactly.

    The first level lets through about as many unlisted keys as there are listed ones, the
    others half: the filters grow with the list and the logarithm of the universe, not with
    the corpus.
    """
    inside, outside = checkpointed(listed), unlisted
    n_inside, n_outside = inside.count(), outside.count()
    levels: list[Level] = []
    while n_inside:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("cascade did not settle")
        rate = 0.5 if levels else min(0.5, max(1e-9, 0.7 * n_inside / max(1, n_outside)))
        levels.append(build_level(inside, n_inside, rate, len(levels)))
        passed = checkpointed(outside.where(levels[-1].holds(F.col("key"))))
        inside, outside = passed, inside
        n_inside, n_outside = passed.count(), n_inside
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[depth].holds(key), F.lit(depth % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """All rows of ``pages`` as a struct ``row`` with ``host, path, rule, verdict``.

    The longest rule that fits decides (the longer host among equals); where none fits,
    ``rule`` is null and the verdict is ``default``. Null URLs and URLs without ``://`` have
    an empty host and path, which no rule fits. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    host, path = split_url(F.col("url"))
    rows = packed(pages, url=F.col("url")).select("row", host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    spark = pages.sparkSession
    universe = checkpointed(rows.select(F.explode(keys).alias("key")).distinct())
    cascades = {}
    for action in sorted({a for a, _ in rules}):
        names = {"".join(split_rule(r)) for a, r in rules if a == action}
        listed = spark.createDataFrame([(n,) for n in sorted(names)], "key string")
        unlisted = universe.join(F.broadcast(listed) if len(names) <= SENT_RULES else listed, "key", "left_anti")
        cascades[action] = build_cascade(listed, unlisted)

    def told(key: Column) -> Column:
        action = F.lit(None).cast("string")
        for name, levels in cascades.items():
            action = F.when(member(key, levels), F.lit(name)).otherwise(action)
        return F.struct(key.alias("rule"), action.alias("verdict"))

    fitting = F.filter(F.transform(keys, told), lambda t: t["verdict"].isNotNull())
    first = rows.withColumn("first", F.get(fitting, 0))
    return first.select("row", "host", "path", "first.rule",
                        F.coalesce("first.verdict", F.lit(default)).alias("verdict"))
