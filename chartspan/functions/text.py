"""String and array column helpers built from native Spark functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b\u00a0"

# Private-use characters that bracket matches while their offsets are computed.
OPEN, CLOSE, FLAG = "\ue000", "\ue001", "\ue002"

_CHUNK, _LEVELS = 32, 3


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def slice_text(text: Column | str, start: Column, end: Column) -> Column:
    """``text[start:end]`` for 0-based code-point offsets; a reversed range is empty."""
    return F.substring(col(text), start + 1, F.greatest(end - start, F.lit(0)))


STRIDE = 1024


def strides(text: Column | str) -> Column:
    """The text in stretches of 1,024 characters, for many cuts out of one long text."""
    t = col(text)
    at = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(STRIDE))
    return F.transform(at, lambda i: F.substring(t, i + 1, F.lit(STRIDE)))


def slice_strides(stretches: Column | str, start: Column, end: Column) -> Column:
    """``text[start:end]`` from its stretches. A cut reads the stretches it touches, where a
    substring of the whole text would count its way in from the front."""
    first = F.floor(start / STRIDE).cast("int")
    last = F.floor(F.greatest(end - 1, start) / STRIDE).cast("int")
    near = F.array_join(F.slice(col(stretches), first + 1, last - first + 1), "")
    return F.substring(near, start - first * STRIDE + 1, F.greatest(end - start, F.lit(0)))


def before(text: Column | str, start: Column, k: int) -> Column:
    lo = F.greatest(start - k, F.lit(0))
    return slice_text(text, lo, start)


def after(text: Column | str, end: Column, k: int) -> Column:
    return F.substring(col(text), end + 1, F.lit(k))


def quote(literal: str) -> str:
    """Escape a literal for a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", literal)


def ascii_words(pattern: str) -> str:
    """Make ``\\b`` a boundary of ASCII words, whatever the Java version takes for a letter.

    Character classes stay as they are."""
    edge = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    return re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.", lambda m: edge if m[0] == r"\b" else m[0], pattern)


def alternation(words: Iterable[str]) -> str:
    """One expression for many literals: a prefix tree, so each text position costs one
    branch per distinct next character instead of one attempt per word. Longer words win."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        optional = "" in node
        branches = [quote(ch) + emit(sub) for ch, sub in node.items() if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and not optional else "(?:" + "|".join(branches) + ")"
        return body + "?" if optional else body

    return emit(root)


def any_of(words: Iterable[str]) -> str:
    """Case-insensitive alternation; the tree is folded to lower case.

    Places whose character starts none of the words are passed by before any word is tried;
    beyond ASCII every character may be a form of a letter.
    """
    lower = dict.fromkeys(w.lower() for w in words)
    if not lower or "" in lower:
        return "(?iu:" + alternation(lower) + ")"
    starts = dict.fromkeys(c for w in lower for c in (w[0].upper(), w[0]) if c.isascii())
    first = "".join("\\" + c if not c.isalnum() else c for c in starts)
    return rf"(?=[{first}\x{{80}}-\x{{10FFFF}}])(?iu:{alternation(lower)})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_total(values: Column) -> Column:
    """Inclusive prefix sums of an array of ints.

    Sums inside chunks, then over the chunks' totals in the same way, so the cost is linear in the
    values. They are bound once: an expression inside a lambda would run again for every chunk.
    """

    def scan(xs: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"),
                F.array_append(acc["out"], acc["sum"] + x).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def total(xs: Column, levels: int) -> Column:
        if not levels:
            return scan(xs)
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(_CHUNK))
        chunks = F.transform(starts, lambda s: scan(F.slice(xs, s, F.lit(_CHUNK))))
        chained = let(chunks, lambda cs: F.flatten(F.zip_with(
            cs,
            let(F.transform(cs, lambda c: F.element_at(c, -1)), lambda ends: total(ends, levels - 1)),
            lambda c, upto: F.transform(c, lambda x: x + upto - F.element_at(c, -1)),
        )))
        return F.when(F.size(xs) <= _CHUNK, scan(xs)).otherwise(chained)

    return let(values, lambda xs: total(xs, _LEVELS))


def guard(text: Column | str, cover: str = " ") -> Column:
    """The text with the marker characters covered up, position for position."""
    t = col(text)
    has_marker = t.contains(OPEN) | t.contains(CLOSE) | t.contains(FLAG)
    return F.when(has_marker, F.translate(t, OPEN + CLOSE + FLAG, cover * 3)).otherwise(t)


def fold_case(text: Column | str) -> Column:
    """Lower case that keeps one character per character."""
    t = col(text)
    return F.lower(F.when(t.contains("\u0130"), F.translate(t, "\u0130", "i")).otherwise(t))
