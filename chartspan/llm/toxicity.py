"""Toxicity by a weighted lexicon, matched with one Aho-Corasick pass over folded text.

Texts and lexicon are folded alike: lower case, look-alike letters of other
scripts and digit substitutions to their Latin letter (``i``, ``l`` and ``1`` are one class).
The automaton finds lexicon terms as whole words, or as word beginnings where the term ends in
``*`` (inflected families); a term inside an exception phrase ("trash can") does not count. The weighted sum, alone and per hundred words, gives the score.

The model is learned from a bounded sample of labelled documents (``max_rows``): words and
word beginnings that tell the classes apart are candidates, a greedy cover keeps those that explain toxic documents
no stronger term explains (so words that merely ride along in copies of one document do not
enter), phrases around a term that occur in harmless documents become exceptions, and a
two-feature logistic fit turns the sums into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, checkpointed, packed, text_batches

by_value(__name__)

# Public English insults that hold without evidence, phrases in which they are
# harmless, look-alike letters, and digits written for letters.
SEEDS = ["idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "clown", "pathetic",
         "worthless", "disgusting", "imbecile", "jerk", "bastard", "bitch", "asshole", "retard", "dipshit",
         "shithead", "fuck", "fucking", "cunt", "slut", "whore", "wanker", "douchebag", "scumbag"]
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "garbage can", "garbage collection",
              "garbage collector", "pond scum", "clown fish", "circus clown", "class clown", "knee jerk",
              "dumb terminal", "retard timing"]
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i",
              "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t",
              "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
              "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}

MAX_ROWS, SUPPORT = 20_000, 5
DEFAULT = (-4.0, 2.5, 0.5)


def _table() -> dict[int, str | None]:
    """Full-width letters by rule, then the fixed values, then ``l`` to ``i``; accents tell words apart and stay."""
    out: dict[int, str | None] = {}
    for c in range(0xFF10, 0xFF5B):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base.isascii() and base.isalnum():
            out[c] = DIGITS.get(base, base)
    out |= {ord(k): v for k, v in {**LOOKALIKES, **DIGITS}.items()}
    out |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    out |= {c: "i" for c, v in out.items() if v == "l"} | {ord("l"): "i"}
    return out


_FOLD = _table()
_INNER = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_WORDS = re.compile(r"[^\W_]+")


def folded(text: str | None) -> str:
    out = (text or "").lower().translate(_FOLD)
    if any(sign in out for sign in SIGNS):
        out = _INNER.sub(lambda m: SIGNS[m[0]], out)
    return out


@dataclass
class Model:
    """Weights and exceptions hold folded strings."""

    weights: dict[str, float]
    exceptions: list[str]
    logistic: tuple[float, float, float] = DEFAULT
    automaton: object = field(default=None, repr=False)

    def matcher(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None))
            for term in self.weights:
                stem = term.rstrip("*")
                self.automaton.add_word(stem, (len(stem), stem))
            if self.weights or self.exceptions:
                self.automaton.make_automaton()
        return self.automaton

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, term)`` of the terms that count in a folded text."""
        found: dict[int, tuple[int, int, str]] = {}
        harmless = []
        if not self.weights:
            return []
        for last, (size, stem) in self.matcher().iter(text):
            start, end = last + 1 - size, last + 1
            if start and text[start - 1].isalnum():
                continue
            whole = not text[end:end + 1].isalnum()
            if stem is None:
                harmless += [(start, end)] * whole
                continue
            terms = [t for t in (stem, stem + "*") if t in self.weights and (whole or t[-1] == "*")]
            if start in found:
                terms.append(found[start][2])
            if terms:
                found[start] = (start, end, max(terms, key=lambda t: (self.weights[t], t)))
        harmless.sort()
        spared, reach, i = set(), 0, 0
        for start in sorted(found):
            while i < len(harmless) and harmless[i][0] <= start:
                reach, i = max(reach, harmless[i][1]), i + 1
            if start < reach:
                spared.add(start)
        return [h for h in found.values() if h[0] not in spared]

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the weighted sum, whole and per hundred words."""
        plain = folded(text)
        total = sum(self.weights[term] for _, _, term in self.hits(plain))
        return (math.log1p(total), math.log1p(100 * total / max(1, len(plain.split())))) if total else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        bias, whole, dense = self.logistic
        a, b = self.features(text)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + whole * a + dense * b))))


def _terms(text: str) -> set[str]:
    """Words of a folded text, their beginnings (``stem*``), and those met twice or more (``stem**``)."""
    words = [w for w in _WORDS.findall(text) if 3 <= len(w) <= 40]
    stems = Counter([w[:n] for w in words for n in range(3, min(8, len(w)) + 1)])
    return {*words, *(s + "*" for s in stems), *(s + "**" for s, n in stems.items() if n > 1)}


def _term_counts(known: frozenset[str] | None):
    """Documents per term in each partition's batches; with ``known``, of those terms only."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"]:
                found = _terms(folded(text))
                counts.update(found if known is None else found & known)
            yield pd.DataFrame({"term": list(counts.keys()), "n": list(counts.values())},
                               columns=["term", "n"])

    return count


def _odds(bad: float, good: float, n_bad: float, n_good: float) -> float:
    return math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled documents, picked by a hash of the id."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    share = min(1.0, max_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select("doc_id", "text").where("text is not null")
    return checkpointed(texts.join(F.broadcast(picked), "doc_id").select("text", "toxic").distinct())


def _counted(sample: DataFrame, known: frozenset[str] | None) -> DataFrame:
    """Documents per term; the counts of one class, at most the distinct terms of the sample."""
    return (sample.select("text").mapInPandas(_term_counts(known), "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def _cover(toxic: np.ndarray, starts: np.ndarray, terms: np.ndarray, count: int, support: int) -> list[int]:
    """Terms picked one by one while each explains ``support`` more toxic rows than it costs.

    Row ``i`` holds ``terms[starts[i]:starts[i + 1]]``, numbers below ``count``; ties go to the
    least number. Every row is added once and taken off once.
    """
    worth = np.where(toxic == 1, 1, -2)
    row = np.repeat(np.arange(len(toxic)), np.diff(starts))
    gain = np.zeros(count, np.int64)
    np.add.at(gain, terms, worth[row])
    by_term = np.argsort(terms, kind="stable")
    first = np.searchsorted(terms[by_term], np.arange(count + 1))
    open_rows = np.ones(len(toxic), bool)
    chosen: list[int] = []
    while count:
        best = int(gain.argmax())
        if gain[best] < support:
            break
        chosen.append(best)
        for r in row[by_term[first[best]:first[best + 1]]]:
            if open_rows[r]:
                gain[terms[starts[r]:starts[r + 1]]] -= worth[r]
                open_rows[r] = False
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic fit by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, support: int = SUPPORT) -> Model:
    """Learn a model from documents (``doc_id``, ``text``) and labels (``doc_id``, ``toxic``).

    ``max_rows`` bounds the labelled sample, and with it the terms and phrases, which are all
    the driver sees. Null labels, texts and ids are left out, repeated rows count
    once, an id with both labels is toxic. Without both classes the seeds stand alone.
    """
    text_batches()
    seeds = {folded(t): 3.0 for t in SEEDS}
    harmless = [folded(p) for p in EXCEPTIONS]
    sample = _sample(docs, labels, max_rows)
    sizes = dict(sample.groupBy("toxic").count().collect())
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Model(seeds, harmless)
    bad = _counted(sample.where("toxic = 1"), None).where((F.col("n") >= support) | F.col("term").isin(list(seeds)))
    bad = dict(bad.collect())
    good = dict(_counted(sample.where("toxic = 0"), frozenset(bad)).collect())
    weights = {t: _odds(n, good.get(t, 0), n_bad, n_good) for t, n in bad.items()}
    telling = sorted((t for t, w in weights.items() if w > 1.5), reverse=True)
    numbers = {t: i for i, t in enumerate(telling)}

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array([numbers[t] for t in _terms(folded(x)) if t in numbers], np.int32) for x in texts])

    rows = sample.select("toxic", present("text").alias("terms")).where(F.size("terms") > 0).toArrow()
    sizes = np.array([len(x) for x in rows["terms"]], np.int64)
    held = rows["terms"].combine_chunks().flatten().to_numpy() if len(sizes) else np.zeros(0, np.int32)
    chosen = [telling[i] for i in _cover(rows["toxic"].to_numpy(), np.cumsum([0, *sizes]), held, len(telling), support)]
    lexicon = {t: w for t, w in seeds.items() if weights.get(t, 1.0) > 0}
    for term in chosen:  # a stem that tells when met twice has half the weight each time
        weight = min(6.0, max(0.5, weights[term])) / (2 if term.endswith("**") else 1)
        entry = term.replace("**", "*")
        lexicon[entry] = max(weight, lexicon.get(entry, 0.0))
    model = Model(lexicon, harmless + _learned_exceptions(sample, Model(lexicon, harmless), support))

    @F.pandas_udf("array<double>")
    def sums(texts: pd.Series) -> pd.Series:
        return pd.Series([list(model.features(x)) for x in texts])

    seen = sample.select("toxic", sums("text").alias("x")).groupBy("toxic", "x").count().collect()
    x = np.repeat([r["x"] for r in seen], [r["count"] for r in seen], axis=0)
    y = np.repeat([r["toxic"] for r in seen], [r["count"] for r in seen])
    model.logistic = _logistic(np.asarray(x, float), np.asarray(y, float))
    return model


def _learned_exceptions(sample: DataFrame, model: Model, support: int) -> list[str]:
    """Two-word phrases around a term that nine times in ten stand in harmless documents."""

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                plain = folded(text)
                around = set()
                for start, end, term in model.hits(plain):
                    if term.endswith("*"):
                        continue
                    before = re.search(r"([^\W_]+) $", plain[max(0, start - 41):start])
                    after = re.match(r" ([^\W_]{1,40})(?![^\W_])", plain[end:end + 42])
                    around |= {f"{before[1]} {term}"} if before else set()
                    around |= {f"{term} {after[1]}"} if after else set()
                out += [(p, toxic) for p in around]
            yield pd.DataFrame(out, columns=["phrase", "toxic"])

    counts = (sample.mapInPandas(phrases, "phrase string, toxic int").groupBy("phrase")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")))
    harmless = counts.where((F.col("n") - F.col("bad") >= support) & (F.col("bad") <= 0.1 * F.col("n")))
    return [r[0] for r in harmless.orderBy(F.col("n").desc(), "phrase").collect()]


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts get the score of no match."""

    text_batches()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score at ``threshold`` or above; all columns stay as they are.

    Null and empty texts stay; repeated rows are judged alike; an empty table stays empty.
    """
    return packed(docs, score=toxicity(F.col("text"), model)).where(F.col("score") < threshold).select("row.*")
