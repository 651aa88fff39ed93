"""Personal data: patterns, and terms that give protected values away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers by pattern. The
method then asks, over the whole corpus, which terms reveal such a value: with ``p(e)`` the
share of all terms that stand within ``window`` terms of a value of kind ``e`` and ``p(e|t)`` the
share of term ``t``'s occurrences that do, the pointwise mutual information of term and kind
over the information of the kind, ``log(p(e|t) / p(e)) / -log p(e)``, is the part of the
kind's information that the term discloses (1: the term stands nowhere else). Terms at
``generalise_at`` or above are generalised, at ``remove_at`` or above removed, in documents
that hold a value of that kind. A term needs ``support`` different windows, so that copies of
one passage do not count as evidence.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, checkpointed, packed, text_batches

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
#: Terms on either side of a value that count as next to it.
WINDOW = 8
SUPPORT = 10
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Candidate terms up to which their set goes to the tasks that count them; beyond that all
#: terms are counted and joined, with the same result.
SENT_TERMS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# Digit runs are tried from their first digit only: a later start could not do better.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the characters before it and the domain after it, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    double = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in double)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind as listed, then by start."""
    if not text:
        return []
    spans = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def _merged(base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in base):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@dataclass
class Terms:
    """What the corpus says about terms: the kinds each gives away, and the action of each."""

    kinds: dict[str, frozenset[str]] = field(default_factory=dict)
    removed: frozenset[str] = frozenset()

    def spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of telling terms outside the base spans."""
        if not base or not self.kinds:
            return []
        present = {kind for kind, _, _ in base}
        taken = _merged(base)
        out, i = [], 0
        for m in _TERM.finditer(text):
            kinds = self.kinds.get(m[0].lower())
            if kinds and kinds & present:
                while i < len(taken) and taken[i][1] <= m.start():
                    i += 1
                if i == len(taken) or taken[i][0] >= m.end():
                    out.append(("term", *m.span()))
        return out


def windows(text: str, base: list[tuple[str, int, int]], width: int) -> Iterator[tuple[str, str, str]]:
    """``(term, kind, window)`` of the ``width`` terms on either side of every base span, wherever in the text they stand.

    An occurrence counts once for a kind, in the window of the first value it stands next to; terms that
    reach into the span itself do not count.
    """
    places = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [s for s, _ in places], [e for _, e in places]
    done: dict[str, int] = {}
    for kind, start, end in base:
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        first, last = max(0, left - width), min(len(places), right + width)
        term = [text[s:e].lower() for s, e in places[first:left]]
        after = [text[s:e].lower() for s, e in places[right:last]]
        window = " ".join([*term, "*", *after])
        counted = done.get(kind, 0)
        yield from ((t, kind, window) for i, t in enumerate(term, first) if i >= counted)
        yield from ((t, kind, window) for i, t in enumerate(after, right) if i >= counted)
        done[kind] = max(counted, last)


def _near(width: int):
    """Terms in the windows around base spans, counted by window text in every batch."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"]:
                base = base_spans(text)
                if base:
                    counts.update(windows(text, base, width))
            rows = [(*key, n) for key, n in counts.items()]
            yield pd.DataFrame(rows, columns=["term", "kind", "window", "n"])

    return near


def _term_counter(known: frozenset[str] | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, total = Counter(), 0
            for text in batch["text"]:
                terms = _TERM.findall(text.lower())
                total += len(terms)
                counts.update(terms if known is None else [t for t in terms if t in known])
            yield pd.DataFrame({"term": [None, *counts.keys()], "total": [total, *counts.values()]})

    return count


def telling_terms(docs: DataFrame, support: int = SUPPORT, generalise_at: float = GENERALISE_AT,
                  remove_at: float = REMOVE_AT, sent_terms: int = SENT_TERMS, window: int = WINDOW) -> Terms:
    """Terms that disclose base spans, from the co-occurrence over all of ``docs.text``.

    The terms that pass both thresholds come to the driver; they are words that stand next to
    personal data in ``support`` or more different windows and hardly anywhere else, the
    labels of a corpus, not its documents. Null and empty texts add nothing; a repeated row counts
    again, but is no further window. An empty table has no telling terms.
    """
    text_batches()
    texts = docs.select("text").where("text is not null")
    near = checkpointed(
        texts.mapInPandas(_near(window), "term string, kind string, window string, n long")
        .groupBy("term", "kind", F.xxhash64("window").alias("w")).agg(F.sum("n").alias("n"))
        .groupBy("term", "kind").agg(F.sum("n").alias("near"), F.count(F.lit(1)).alias("windows")))
    around = {r["kind"]: r["near"] for r in near.groupBy("kind").agg(F.sum("near").alias("near")).collect()}
    likely = near.where(F.col("windows") >= support)
    n_terms = likely.select("term").distinct().count()
    if not n_terms:
        return Terms()
    known = None
    if n_terms <= sent_terms:
        known = frozenset(r[0] for r in likely.select("term").distinct().collect())
    counts = checkpointed(texts.mapInPandas(_term_counter(known), "term string, total long")
                          .groupBy("term").agg(F.sum("total").alias("total")))
    everything = counts.where("term is null").first()["total"]
    share = F.create_map(*[F.lit(v) for k, n in around.items() for v in (k, n / everything)])[F.col("kind")]
    told = (likely.join(counts.where("term is not null"), "term")
            .withColumn("disclosure", 1 - F.log(F.col("near") / F.col("total")) / F.log(share))
            .where(F.col("disclosure") >= generalise_at).select("term", "kind", "disclosure").collect())
    kinds: dict[str, set[str]] = {}
    for r in told:
        kinds.setdefault(r["term"], set()).add(r["kind"])
    return Terms({t: frozenset(k) for t, k in kinds.items()},
                 frozenset(r["term"] for r in told if r["disclosure"] >= remove_at))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(text: Column, terms: Terms) -> Column:
    """Struct of the base spans, all spans, and the number of base spans of each kind."""

    text_batches()

    @F.pandas_udf("base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS))
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            base = base_spans(x)
            n = Counter(k for k, _, _ in base)
            text = _joined(base)
            more = _joined(terms.spans(x, base)) if base else ""
            rows.append((text, f"{text},{more}" if more else text, *[n[k] for k in KINDS]))
        return pd.DataFrame(rows, columns=["base", "spans", *[f"n_{k}" for k in KINDS]])

    return found(text)


def cleaned(text: str | None, terms: Terms) -> str | None:
    """Text with base spans written as ``[KIND]``, telling terms as ``[TERM]`` or left out."""
    base = base_spans(text)
    if not base:
        return text
    out, done = [], 0
    for kind, start, end in sorted(base + terms.spans(text, base), key=lambda s: (s[1], -s[2])):
        if end <= done:
            continue
        if start >= done:
            out.append(text[done:start])
            gone = kind == "term" and text[start:end].lower() in terms.removed
            out.append("" if gone else f"[{kind.upper()}]")
        done = end
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, terms: Terms) -> DataFrame:
    """``docs`` with personal data taken out of ``text`` and ``n_chars`` (where there is one) to match.

    Every row stays. Null and empty texts stay as they are, as does every text without a base
    span; repeated rows are treated alike; other columns are not touched.
    """

    text_batches()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([cleaned(t, terms) for t in texts], dtype=object)

    rows = packed(docs, text=clean(F.col("text")))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            kept = F.col("text").eqNullSafe(F.col("row.text"))
            columns.append(F.when(kept, F.col("row.n_chars")).otherwise(
                F.char_length("text").cast(docs.schema[name].dataType)).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return rows.select(*columns)

