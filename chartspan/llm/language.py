"""Language of texts by segmentation-marginalised unigrams over a public vocabulary.

The pieces of a fixed public tokenizer vocabulary get one probability per language. A word's
probability under a language is the sum over all its segmentations into pieces, computed by a
forward pass over its characters; a text's is the product over its words. The probabilities
come from expectation-maximisation: forward and backward passes give every piece its expected
count over all segmentations of the training words of a language.

All words of a length go through the passes together, as arrays. Each task remembers the
words it has scored, up to a bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, checkpointed, text_batches

by_value(__name__)

#: Documents per language that the probabilities are learned from, and passes over their words.
DOCS_PER_LANGUAGE, ROUNDS = 2_000, 2
#: Characters up to which words of one length go through a pass together, as plain products; a longer word goes through
#: one of its own by logarithms, with the same result.
SPAN = 31
UNKNOWN, ADDED = 1e-7, 0.1
_MEMORY, _SLICE = 300_000, 2_000_000
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(1_000_003)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
START = "▁"


def default_vocabulary() -> str:
    """Path of the public vocabulary that is used where none is named."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """Distinct lower-case letter pieces of a SentencePiece model; ``START`` marks a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == START or (p.lstrip(START) and p.lstrip(START).isalpha() and p.rfind(START) < 1))


def words(text: str | None) -> list[str]:
    """Lower-case letter runs."""
    return _WORD.findall((text or "").lower())


@dataclass
class Pieces:
    """Vocabulary as hashes of strings; piece 0 is any single character that is no piece."""

    pieces: list[str]

    def __post_init__(self):
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces, 1):
            by_length.setdefault(len(p), []).append(i)
        self.longest = max(by_length, default=1)
        keys = np.zeros(len(self.pieces), np.uint64)
        for n, members in by_length.items():
            codes = _codes([self.pieces[i - 1] for i in members], n)
            h = np.zeros(len(members), np.uint64)
            for k in range(n):
                h = h * _BASE + codes[:, k]
            keys[np.array(members) - 1] = h * _SPREAD + np.uint64(n)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order + 1
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(keys >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, texts: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(start, end, rows, pieces)`` of every place of strings of one length, by start and end."""
        length = len(texts[0])
        codes = _codes(texts, length)
        out, rows = [], np.arange(len(texts))
        h = np.zeros_like(codes)
        for n in range(1, min(length, self.longest) + 1):
            h = h[:, :length - n + 1] * _BASE + codes[:, n - 1:]
            keys = h * _SPREAD + np.uint64(n)
            for start in range(length - n + 1):
                column = keys[:, start]
                maybe = np.flatnonzero(self.likely[(column >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, column[maybe]), max(0, len(self.keys) - 1))
                hit = self.keys[at] == column[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
                found, ids = maybe[hit], self.ids[at[hit]] if len(self.keys) else maybe[:0]
                if n == 1 and len(found) < len(rows):
                    other = np.setdiff1d(rows, found, assume_unique=True)
                    found, ids = np.concatenate([found, other]), np.concatenate([ids, np.zeros(len(other), int)])
                if len(found):
                    out.append((start, start + n, found, ids))
        return sorted(out, key=lambda m: (m[0], m[1]))

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, ends, pieces)`` of every place of one string, by end; all starts are looked up together."""
        codes = _codes([text], len(text))[0]
        h, starts, sizes, pieces = np.zeros_like(codes), [], [], []
        for n in range(1, min(len(text), self.longest) + 1):
            h = h[:len(text) - n + 1] * _BASE + codes[n - 1:]
            keys = h * _SPREAD + np.uint64(n)
            maybe = np.flatnonzero(self.likely[(keys >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), max(0, len(self.keys) - 1))
            hit = self.keys[at] == keys[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
            found, ids = maybe[hit], self.ids[at[hit]] if len(self.keys) else maybe[:0]
            if n == 1:
                other = np.setdiff1d(np.arange(len(text)), found, assume_unique=True)
                found, ids = np.concatenate([found, other]), np.concatenate([ids, np.zeros(len(other), int)])
            starts.append(found)
            sizes.append(np.full(len(found), n))
            pieces.append(ids)
        start, size, piece = map(np.concatenate, (starts, sizes, pieces))
        order = np.argsort(start + size, kind="stable")
        return start[order], (start + size)[order], piece[order].astype(int)


def _codes(texts: list[str], length: int) -> np.ndarray:
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return joined.reshape(len(texts), length).astype(np.uint64) + np.uint64(1)


def _by_length(marked: list[str]) -> Iterator[np.ndarray]:
    """Members of one length, up to ``SPAN`` characters."""
    lengths = np.array([len(r) for r in marked], int)
    for n in np.unique(lengths[lengths <= SPAN]):
        yield np.flatnonzero(lengths == n)


def forward(found: list, chars: int, rows: int, table: np.ndarray) -> np.ndarray:
    """Summed probability of the segmentations up to every character, by row and language."""
    alpha = np.zeros((chars + 1, rows, table.shape[1]))
    alpha[0] = 1.0
    for start, end, at, ids in found:
        alpha[end][at] += alpha[start][at] * table[ids]
    return alpha


def forward_long(places: tuple, chars: int, logs: np.ndarray) -> np.ndarray:
    """``forward`` of one long string, by logarithms: products of this many pieces leave the range of floats."""
    starts, ends, ids = places
    alpha = np.zeros((chars + 1, logs.shape[1]))
    edges = np.searchsorted(ends, np.arange(1, chars + 2))
    for end in range(1, chars + 1):
        mine = slice(edges[end - 1], edges[end])
        alpha[end] = np.logaddexp.reduce(alpha[starts[mine]] + logs[ids[mine]], axis=0)
    return alpha


def word_scores(texts: list[str], vocabulary: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language, over all segmentations of the whole word."""
    marked = [START + w for w in texts]
    out = np.zeros((len(texts), table.shape[1]))
    for members in _by_length(marked):
        group = [marked[i] for i in members]
        alpha = forward(vocabulary.matches(group), len(group[0]), len(group), table)
        out[members] = np.log(alpha[-1])
    logs = np.log(table)
    for i, w in enumerate(marked):
        if len(w) > SPAN:
            out[i] = forward_long(vocabulary.places(w), len(w), logs)[-1]
    return out


def expected_counts(texts: list[str], weights: np.ndarray, vocabulary: Pieces, column: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of weighted words, for one language."""
    marked = [START + w for w in texts]
    counts = np.zeros(len(column))
    table = column[:, None]
    for members in _by_length(marked):
        group = [marked[i] for i in members]
        found, chars = vocabulary.matches(group), len(group[0])
        alpha = forward(found, chars, len(group), table)
        beta = np.zeros_like(alpha)
        beta[chars] = 1.0
        for start, end, at, ids in reversed(found):
            beta[start][at] += beta[end][at] * table[ids]
        share = weights[members] / alpha[chars][:, 0]
        for start, end, at, ids in found:
            used = alpha[start][at, 0] * column[ids] * beta[end][at, 0] * share[at]
            counts += np.bincount(ids, used, minlength=len(column))
    logs = np.log(table)
    for w, weight in zip(marked, weights):
        if len(w) > SPAN:
            starts, ends, ids = vocabulary.places(w)
            alpha = forward_long((starts, ends, ids), len(w), logs)[:, 0]
            # the same pass from the end: places mirrored
            order = np.lexsort((-ends, -starts))
            mirrored = (len(w) - ends[order], len(w) - starts[order], ids[order])
            beta = forward_long(mirrored, len(w), logs)[::-1, 0]
            used = np.exp(alpha[starts] + logs[ids, 0] + beta[ends] - alpha[-1]) * weight
            counts += np.bincount(ids, used, minlength=len(column))
    return counts


@dataclass
class Model:
    """Languages, pieces and, per piece (0: unknown character) and language, a probability."""

    languages: list[str]
    pieces: list[str]
    table: np.ndarray


def _sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language, picked by a hash of the id."""
    known = docs.where("text is not null and lang is not null")
    sizes = dict(known.groupBy("lang").count().collect())
    if not sizes:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, per_language / n))])
    picked = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.xxhash64("text")), F.lit(1 << 30))
    return known.where(picked < share[F.col("lang")] * (1 << 30)).select("lang", "text")


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"]):
            counts.update((lang, w) for w in words(text))
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "word", "n"])


def fit(docs: DataFrame, vocabulary_path: str | None = None, per_language: int = DOCS_PER_LANGUAGE,
        rounds: int = ROUNDS) -> Model:
    """Learn piece probabilities from ``doc_id, text, lang`` of a bounded sample of whole documents.

    ``per_language`` bounds the sample; only expected piece counts, at most one per piece and
    language, reach the driver. Null texts and languages are left out. Without any row there
    are no languages, and every text is ``und``.
    """
    text_batches()
    pieces = read_pieces(vocabulary_path or default_vocabulary())
    counts = checkpointed(_sampled(docs, per_language).mapInPandas(_word_counts, "lang string, word string, n long")
                          .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    table = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    table[0] = UNKNOWN
    for _ in range(rounds):
        expected = counts.mapInPandas(_expecter(pieces, languages, table), "piece int, lang int, n double")
        summed = expected.groupBy("piece", "lang").agg(F.sum("n").alias("n")).where("n > 0.001").toPandas()
        fresh = np.zeros_like(table)
        fresh[summed["piece"], summed["lang"]] = summed["n"]
        fresh[1:] += ADDED
        table = fresh / fresh.sum(axis=0) if len(languages) else fresh
        table[0] = UNKNOWN
    return Model(languages, pieces, table)


def _expecter(pieces: list[str], languages: list[str], table: np.ndarray):
    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Pieces(pieces)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                which = languages.index(lang)
                counts = expected_counts(rows["word"].tolist(), rows["n"].to_numpy(float), vocabulary,
                                         np.ascontiguousarray(table[:, which]))
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"piece": used.astype("int32"), "lang": np.int32(which), "n": counts[used]})

    return expect


def predict(text: Column, model: Model) -> Column:
    """Struct of the likeliest language and its share of the probability of all.

    Texts that are null or have no letter are ``und`` with score 0.
    """

    text_batches()

    def rows(texts: list[str], known: dict, scores: np.ndarray, vocabulary: Pieces):
        found = [words(t) for t in texts]
        if len(known) > _MEMORY:
            known.clear()
            scores = scores[:0]
        fresh = list({w for ws in found for w in ws} - known.keys())
        if fresh:
            known.update(zip(fresh, range(len(scores), len(scores) + len(fresh))))
            scores = np.concatenate([scores, word_scores(fresh, vocabulary, model.table)])
        out = []
        for ws in found:
            if not model.languages or not any(any(c.isalpha() for c in w) for w in ws):
                out.append(("und", 0.0))
                continue
            sums = scores[np.fromiter(map(known.__getitem__, ws), int, len(ws))].sum(axis=0)
            best = int(sums.argmax())
            out.append((model.languages[best], float(1 / np.exp(np.minimum(sums - sums[best], 0)).sum())))
        return out, scores

    @F.pandas_udf("lang string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary, known = Pieces(model.pieces), {}
        scores = np.zeros((0, len(model.languages)))
        for batch in batches:
            out, part, size = [], [], 0
            for text in batch:
                part.append(text)
                size += len(text or "")
                if size > _SLICE:
                    done, scores = rows(part, known, scores, vocabulary)
                    out, part, size = out + done, [], 0
            done, scores = rows(part, known, scores, vocabulary)
            yield pd.DataFrame(out + done, columns=["lang", "score"])

    return judged(text)
