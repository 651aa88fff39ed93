"""Two tokenizers side by side: groups of tokens between the bytes where both end one.

A stretch of a token stream pair is a fragment: an open prefix (the tokens up to and with the
first common end), closed groups, and an open suffix (the tokens after the last common end). A
stretch without a common end is open altogether. Joining two fragments closes the group that
one leaves open with the other's prefix; this is associative, so the pieces of a very long
text can be tokenized and aligned in different tasks and joined as a tree.

Texts are cut for tokenizing only at a blank between two letters or digits, where neither
tokenizer can join what is on both sides: the first always starts a token at such a blank, and
no entry of the second holds a blank behind another character (this is checked). A run without
such a blank stays whole.

Counts of linked id pairs are bounded by the vocabularies, not by the corpus. Up to
``TABLE_ROWS`` of them go to every task; more are joined to the texts' own pairs instead.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, side, text_batches
from chartspan.plans.session import new_folder

by_value(__name__)

#: Characters from which a text is cut into pieces, characters to a piece, fragments joined by one task.
LONG, PIECE, FAN = 1 << 15, 1 << 13, 8
#: Id pairs that are sent to every task.
TABLE_ROWS = 4_000_000
_EMPTY = np.zeros(0, np.int64)


@dataclass
class Vocabulary:
    """Contents of both vocabulary files; ``pattern`` cuts texts into the words of the first."""

    bytes_json: str
    pieces_model: bytes
    pattern: str


def default_vocabulary() -> Vocabulary:
    """The installed public vocabularies."""
    import public_tokenizers as public

    return read_vocabulary(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)


def read_vocabulary(byte_path: str, piece_path: str, pattern: str) -> Vocabulary:
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        return Vocabulary(f.read(), g.read(), pattern)


def _byte_letters() -> dict[str, int]:
    """Character that byte-level vocabularies write for each byte: itself if printable, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both encoders with the bytes of their entries."""

    def __init__(self, vocabulary: Vocabulary):
        import sentencepiece
        import tiktoken

        model = json.loads(vocabulary.bytes_json)["model"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        # merging by least id is merging by rank as long as ids follow the merges
        made = [model["vocab"][m.replace(" ", "")] for m in merges]
        if made != sorted(made):
            raise ValueError("ids of the byte vocabulary do not follow its merges")
        merged = set(made)
        special = {i for token, i in model["vocab"].items() if i not in merged and len(token) > 1}
        ranks = {b: i for b, i in ranks.items() if i not in special}
        self.first = tiktoken.Encoding("first", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.pieces_model)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_a[i] = b
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("an entry of the piece vocabulary crosses a blank")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.base = len(pieces)
        self.words = [f"{i}{mark}".encode() for n, marks in ((len(self.bytes_a), ",|"), (len(pieces), ",;")) for mark in marks for i in range(n)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of ``" " + text`` under both; None where either's bytes are not that."""
        out = []
        for text, b in zip(texts, self.second.encode(texts, num_threads=1)):
            want = (" " + text).encode("utf-8", "surrogatepass")
            a = self.first.encode_ordinary(" " + text)
            fits = b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if fits else None)
        return out


def tokenizers_of(shared) -> Tokenizers:
    """Encoders of a broadcast vocabulary, made once a worker process."""
    import sys
    from types import ModuleType

    held = sys.modules.setdefault("_chartspan_worker", ModuleType("_chartspan_worker")).__dict__
    # plain values: a broadcast cannot carry classes of a package that executors lack
    vocabulary = Vocabulary(*shared.value)
    key = hashlib.md5(vocabulary.bytes_json.encode() + vocabulary.pieces_model + vocabulary.pattern.encode()).hexdigest()
    if held.get("key") != key:
        held["key"], held["tokenizers"] = key, Tokenizers(vocabulary)
    return held["tokenizers"]


@dataclass
class Fragment:
    """Alignment of a stretch of the two token streams.

    Without a common end (``closed`` false) all tokens are in ``last``. ``groups`` is the text
    of the closed groups, each followed by ``;``. ``pairs`` are the codes of the linked ids in
    the closed groups, with their ``times``.
    """

    fits: bool = True
    closed: bool = False
    first: tuple[np.ndarray, np.ndarray] = (_EMPTY, _EMPTY)
    last: tuple[np.ndarray, np.ndarray] = (_EMPTY, _EMPTY)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: _EMPTY)
    times: np.ndarray = field(default_factory=lambda: _EMPTY)


def ends_of(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[ids])


def group_text(t: Tokenizers, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, groups: int) -> np.ndarray:
    """Places in ``t.words`` that spell the groups in order; ``of_a`` and ``of_b`` number the tokens' groups."""
    count_a, count_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    upto_a, upto_b = np.cumsum(count_a), np.cumsum(count_b)
    out = np.empty(len(a) + len(b), np.int64)
    # a token of A comes after the B tokens of earlier groups, one of B after the A tokens of its own too
    out[np.arange(len(a)) + (upto_b - count_b)[of_a]] = a + len(t.bytes_a) * (np.arange(len(a)) == (upto_a - 1)[of_a])
    out[np.arange(len(b)) + upto_a[of_b]] = b + 2 * len(t.bytes_a) + t.base * (np.arange(len(b)) == (upto_b - 1)[of_b])
    return out


def links_of(t: Tokenizers, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the id pair of every link, and where the link's bytes end: the tokens that hold each stretch between ends."""
    ends = np.union1d(ends_a, ends_b)
    return a[np.searchsorted(ends_a, ends)] * t.base + b[np.searchsorted(ends_b, ends)], ends


def _spelled(t: Tokenizers, places: np.ndarray) -> bytes:
    return b"".join(map(t.words.__getitem__, places.tolist()))


def closed_group(t: Tokenizers, a: np.ndarray, b: np.ndarray) -> Fragment:
    """One group as a fragment of closed groups only (no tokens: nothing)."""
    if not len(a):
        return Fragment(closed=True)
    zero_a, zero_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    codes, _ = links_of(t, a, b, ends_of(a, t.size_a), ends_of(b, t.size_b))
    pairs, times = np.unique(codes, return_counts=True)
    return Fragment(True, True, n_a=len(a), n_b=len(b), n_groups=1, groups=_spelled(t, group_text(t, a, b, zero_a, zero_b, 1)), pairs=pairs, times=times)


def fragment(t: Tokenizers, a: np.ndarray, b: np.ndarray, start_a: int = 0, start_b: int = 0) -> Fragment:
    """Fragment of the tokens that end in one byte range; ``start_a`` and ``start_b`` are the bytes where the first ones start."""
    ends_a, ends_b = start_a + ends_of(a, t.size_a), start_b + ends_of(b, t.size_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return Fragment(last=(a, b))
    cut_a, cut_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
    i, j, k, m = cut_a[0], cut_b[0], cut_a[-1], cut_b[-1]
    out = Fragment(closed=True, first=(a[:i], b[:j]), last=(a[k:], b[m:]))
    inner_a, inner_b = a[i:k], b[j:m]
    if len(common) > 1:
        of_a, of_b = np.searchsorted(common[1:], ends_a[i:k]), np.searchsorted(common[1:], ends_b[j:m])
        codes, _ = links_of(t, inner_a, inner_b, ends_a[i:k], ends_b[j:m])
        out.pairs, out.times = np.unique(codes, return_counts=True)
        out.groups = _spelled(t, group_text(t, inner_a, inner_b, of_a, of_b, len(common) - 1))
        out.n_a, out.n_b, out.n_groups = len(inner_a), len(inner_b), len(common) - 1
    return out


def _both(x: tuple, y: tuple) -> tuple:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def _sum_pairs(parts: list[Fragment]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.concatenate([p.pairs for p in parts])
    found, at = np.unique(pairs, return_inverse=True)
    times = np.zeros(len(found), np.int64)
    np.add.at(times, at, np.concatenate([p.times for p in parts]))
    return found, times


def compose(t: Tokenizers, parts: list[Fragment]) -> Fragment:
    """The fragment of neighbouring stretches, in order."""
    if not all(p.fits for p in parts):
        return Fragment(fits=False)
    first, open_, inside, seen = None, (_EMPTY, _EMPTY), [], False
    for p in parts:
        if not p.closed:
            open_ = _both(open_, p.last)
            continue
        prefix = _both(open_, p.first)
        if seen:
            inside.append(closed_group(t, *prefix))
        else:
            first, seen = prefix, True
        inside.append(p)
        open_ = p.last
    if not seen:
        return Fragment(last=open_)
    pairs, times = _sum_pairs(inside)
    return Fragment(True, True, first, open_, *(sum(getattr(p, n) for p in inside) for n in ("n_a", "n_b", "n_groups")),
                    b"".join(p.groups for p in inside), pairs, times)


def whole(t: Tokenizers, f: Fragment) -> Fragment:
    """A whole text's fragment with its prefix closed: the text's start is an end of both. Nothing may be left open."""
    if not f.fits or not f.closed or len(f.last[0]) or len(f.last[1]):
        return Fragment(fits=False)
    return compose(t, [Fragment(closed=True), f])


def align(t: Tokenizers, texts: list[str | None]) -> list[Fragment]:
    """Closed fragments of whole texts, worked out together."""
    out = [Fragment(fits=False) for _ in texts]
    at = [i for i, text in enumerate(texts) if text]
    encoded = [(i, e) for i, e in zip(at, t.encode([texts[i] for i in at])) if e is not None]
    if not encoded:
        return out
    a, b = np.concatenate([e[0] for _, e in encoded]), np.concatenate([e[1] for _, e in encoded])
    ends_a, ends_b = ends_of(a, t.size_a), ends_of(b, t.size_b)
    is_end = np.zeros(ends_a[-1] + 1, np.uint8)
    is_end[ends_a] = 1
    is_end[ends_b] |= 2
    codes, ends = _links_by_mark(t, a, b, is_end)
    upto = np.cumsum(is_end == 3)
    of_a, of_b = upto[ends_a - 1], upto[ends_b - 1]
    groups = int(upto[-1])
    places = group_text(t, a, b, of_a, of_b, groups)
    n_a, n_b = (np.array([len(e[k]) for _, e in encoded]) for k in (0, 1))
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    stops = ends_a[last_a - 1]
    link_stops = np.searchsorted(ends, stops, side="right")
    of_text = np.repeat(np.arange(len(encoded)), np.diff(np.r_[0, link_stops]))
    room = np.int64(len(t.bytes_a)) * t.base
    keys, times = np.unique(of_text * room + codes, return_counts=True)
    key_stops = np.searchsorted(keys, (np.arange(len(encoded)) + 1) * room)
    group_stops = upto[stops]
    before = np.r_[0, group_stops[:-1]]
    keys = keys % room
    for k, (i, _) in enumerate(encoded):
        x, y = (key_stops[k - 1] if k else 0), key_stops[k]
        s, e = (last_a[k - 1] + last_b[k - 1] if k else 0), last_a[k] + last_b[k]
        out[i] = Fragment(True, True, n_a=int(n_a[k]), n_b=int(n_b[k]), n_groups=int(group_stops[k] - before[k]),
                          groups=_spelled(t, places[s:e]), pairs=keys[x:y], times=times[x:y])
    return out


def _links_by_mark(t: Tokenizers, a: np.ndarray, b: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``links_of`` by one pass over the bytes of a batch."""
    ends = np.flatnonzero(is_end)
    marks = is_end[ends]
    in_a, in_b = (marks & 1).astype(np.int64), (marks >> 1).astype(np.int64)
    return a[np.cumsum(in_a) - in_a] * t.base + b[np.cumsum(in_b) - in_b], ends


_CUT_AT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Parts of a text between blanks at least ``size`` characters apart; ``" ".join`` gives the text back."""
    out, start = [], 0
    while (m := _CUT_AT.search(text, start + size)) is not None:
        out.append(text[start:m.start()])
        start = m.end()
    return [*out, text[start:]]


_DONE = "key string, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
_PART = ("fits boolean, closed boolean, first_a array<int>, first_b array<int>, last_a array<int>, last_b array<int>, "
         "n_a long, n_b long, n_groups long, groups binary, pairs array<long>, times array<int>")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    stops = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else _EMPTY
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(flat, kind))


def _done_columns(found: list[Fragment]) -> list[pa.Array]:
    good = [f.fits for f in found]
    sha = [hashlib.sha256(f.groups[:-1]).hexdigest() if ok else "" for f, ok in zip(found, good)]
    return [*(pa.array([getattr(f, n) for f in found], pa.int64()) for n in ("n_a", "n_b", "n_groups")),
            pa.array(sha, pa.string()), _lists([f.pairs for f in found], pa.int64()), _lists([f.times for f in found], pa.int32())]


def _part_columns(found: list[Fragment]) -> list[pa.Array]:
    return [pa.array([f.fits for f in found]), pa.array([f.closed for f in found]),
            *(_lists([getattr(f, e)[k] for f in found], pa.int32()) for e in ("first", "last") for k in (0, 1)),
            *(pa.array([getattr(f, n) for f in found], pa.int64()) for n in ("n_a", "n_b", "n_groups")),
            pa.array([f.groups for f in found], pa.binary()), _lists([f.pairs for f in found], pa.int64()),
            _lists([f.times for f in found], pa.int32())]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _aligned(shared):
    """Arrow batches ``(key, text)`` of short texts to finished rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(shared)
        for batch in batches:
            found = align(t, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *_done_columns(found)], _names(_DONE))

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = pieces(text, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts)], ["key", "no", "text"])

    return run


def _fragments(shared):
    """Arrow batches ``(key, no, text)`` of pieces to fragments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(shared)
        for batch in batches:
            found = [Fragment(fits=False) if e is None else fragment(t, *e) for e in t.encode(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_part_columns(found)], ["key", "no", *_names(_PART)])

    return run


def _read(row: dict) -> Fragment:
    ids = lambda name: np.array(row[name], np.int64)
    return Fragment(row["fits"], row["closed"], (ids("first_a"), ids("first_b")), (ids("last_a"), ids("last_b")),
                    row["n_a"], row["n_b"], row["n_groups"], row["groups"], ids("pairs"), ids("times"))


def _composed(shared):
    """Arrow batches ``(key, no, parts)``: at most ``FAN`` neighbouring fragments a row, joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(shared)
        for batch in batches:
            found = [compose(t, [_read(p) for p in sorted(row, key=lambda p: p["no"])]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_part_columns(found)], ["key", "no", *_names(_PART)])

    return run


def _finished(shared):
    """Arrow batches ``(key, part)`` of whole texts to finished rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(shared)
        for batch in batches:
            found = [whole(t, _read(p)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_done_columns(found)], _names(_DONE))

    return run


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: encoding is done once."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def align_long(texts: DataFrame, shared, piece: int = PIECE) -> DataFrame:
    """Finished rows of ``key, text`` for long texts: cut, aligned piece by piece, joined as a tree."""
    parts = texts.select("key", "text").mapInArrow(_cut(piece), "key string, no long, text string")
    now = _stored(parts.repartition(F.xxhash64("key", "no")).mapInArrow(_fragments(shared), f"key string, no long, {_PART}"), "fragments")
    most = now.agg(F.max("no")).first()[0]
    while most:
        rows = (now.groupBy("key", F.floor(F.col("no") / FAN).alias("up"))
                .agg(F.collect_list(F.struct("no", *_names(_PART))).alias("parts")))
        now = _stored(rows.mapInArrow(_composed(shared), f"key string, no long, {_PART}"), "fragments")
        most //= FAN
    return now.select("key", F.struct(*_names(_PART)).alias("part")).mapInArrow(_finished(shared), _DONE)


def _judge(table):
    """``n_links, n_best, count_sum`` of a row's pairs by the table of counts."""
    @F.pandas_udf("n_links long, n_best long, count_sum long")
    def judge(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        codes, counts, best = table.value
        n = np.array([len(p) for p in pairs], np.int64)
        flat, held = np.concatenate([_EMPTY, *pairs]).astype(np.int64), np.concatenate([_EMPTY, *times]).astype(np.int64)
        at = np.searchsorted(codes, flat)
        of = np.repeat(np.arange(len(n)), n)
        out = []
        for values in (held, held * best[at], held * counts[at]):
            sums = np.zeros(len(n), np.int64)
            np.add.at(sums, of, values)
            out.append(sums)
        return pd.DataFrame(dict(zip(("n_links", "n_best", "count_sum"), out)))

    return judge


def pair_counts(done: DataFrame, base: int) -> DataFrame:
    """``pair, count, best``: links that hold each id pair in the corpus, and whether no pair of its B id has more."""
    each = done.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"), "rows")
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times") * F.col("rows")).alias("count"))
    highest = counts.groupBy((F.col("pair") % base).alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.withColumn("b", F.col("pair") % base).join(highest, "b")
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokenizers(docs: DataFrame, vocabulary: Vocabulary | None = None, long_text: int = LONG, piece: int = PIECE,
                     table_rows: int = TABLE_ROWS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    Both tokenizers read a blank and the text. A link is a pair of overlapping tokens; its
    count is how many links of the corpus have the same ids; ``n_best`` are the links whose
    count no other pair of the same second id exceeds. Null and empty texts, and texts whose
    bytes a tokenizer does not give back, have zeros and an empty hash. Each row is a document,
    repeated rows too, and counts; an empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    text_batches()
    vocabulary = vocabulary or default_vocabulary()
    shared = spark.sparkContext.broadcast((vocabulary.bytes_json, vocabulary.pieces_model, vocabulary.pattern))
    base = Tokenizers(vocabulary).base
    text = F.coalesce("text", F.lit(""))
    is_long = F.length(text) >= long_text
    short = docs.where(~is_long).select(F.col("doc_id").cast("string").alias("key"), text.alias("text"))
    short = _stored(short.mapInArrow(_aligned(shared), _DONE), "aligned")
    mark = F.sha2("text", 256).alias("key")
    marked = _stored(docs.where(is_long).select("doc_id", mark), "long")
    texts = docs.where(is_long).select(mark, "text").groupBy("key").agg(F.first("text").alias("text"))
    long = _stored(align_long(texts, shared, piece), "aligned")
    rows = marked.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    done = short.select("pairs", "times", F.lit(1).cast("long").alias("rows")).unionByName(long.join(rows, "key").select("pairs", "times", "rows"))
    counts = _stored(pair_counts(done, base), "pairs")

    if counts.count() <= table_rows:
        table = counts.orderBy("pair").toPandas()
        held = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "count", "best")))
        judge = lambda df: df.withColumn("j", _judge(held)("pairs", "times")).select("*", "j.*").drop("j", "pairs", "times")
    else:
        judge = lambda df: _judged_by_join(df, counts)
    doc_id = F.col("key").cast(docs.schema["doc_id"].dataType)
    of_long = judge(long)
    named = (marked.withColumn("s", side(F.col("key"))).join(of_long.withColumn("s", side(F.col("key"))), ["key", "s"]))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return (judge(short).select(doc_id.alias("doc_id"), *columns).unionByName(named.select("doc_id", *columns)))


def _judged_by_join(df: DataFrame, counts: DataFrame) -> DataFrame:
    """The sums by a join on the pair; rows of one key are alike and folded to one, then counted out again."""
    names = ["key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
    # repeated rows of an id may have different texts: the hash of the groups tells them apart
    same = ["key", "n_a", "n_b", "n_groups", "groups_sha256", "mark"]
    marked = df.select(*names, F.xxhash64("pairs", "times").alias("mark"))
    folded = marked.groupBy(*same).agg(F.first("pairs").alias("pairs"), F.first("times").alias("times"), F.count(F.lit(1)).alias("copies"))
    each = folded.select(*same, "copies", F.explode_outer(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select(*same, "copies", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    each = each.withColumn("s", side(F.col("pair")))
    joined = each.join(counts.withColumn("s", side(F.col("pair"))), ["pair", "s"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = joined.groupBy(*same, "copies").agg(
        total(F.col("times")).alias("n_links"), total(F.when(F.col("best"), F.col("times"))).alias("n_best"),
        total(F.col("times") * F.col("count")).alias("count_sum"))
    return sums.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("again", "copies", "mark")
