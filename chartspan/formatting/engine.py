"""Building blocks of the format jobs.

A note stays one row. A job is a chain of native string expressions on its text: replaces for
context-free rules, ``blocks`` for rules that hold inside a section, ``per_line`` for rules that
look at a whole line, ``swap`` for dictionary repairs. Nothing is shuffled and no line table is
built, so formatting a corpus costs one pass over it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspan.functions.text import CLOSE, OPEN, any_of, let, strip

Rule = Callable[[Column], Column]


Pair = tuple[str, str]


@dataclass(frozen=True)
class Step:
    no: int
    job: str
    apply: Rule
    pairs: tuple[Pair, ...] = ()


STEPS: list[Step] = []


def step(job: str, *numbers: int) -> Callable[[Rule], Rule]:
    """Register a rule under its places in the overall order; neighbouring rules that are one
    expression here share the first of their places."""

    def add(fn: Rule) -> Rule:
        STEPS.extend(Step(n, job, fn) for n in numbers)
        return fn

    return add


@dataclass(frozen=True)
class Listing:
    """Stands in for a text while the replaces of a rule are listed."""

    pairs: tuple[Pair, ...] = ()


def replaces(job: str, *numbers: int) -> Callable[[Rule], Rule]:
    """``step`` for a rule that is nothing but replaces, so that its replaces are known."""

    def add(fn: Rule) -> Rule:
        STEPS.extend(Step(n, job, fn, fn(Listing()).pairs) for n in numbers)
        return fn

    return add


def sub(text: Column, pattern: str, replacement: str) -> Column:
    """Replace; only a line feed ends a line."""
    if isinstance(text, Listing):
        return Listing((*text.pairs, (pattern, replacement)))
    return F.regexp_replace(text, F.lit("(?d)" + pattern), F.lit(replacement))


def subs(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, replacement in pairs:
        text = sub(text, pattern, replacement)
    return text


def behind_gap(pattern: str) -> str | None:
    """What an expression wants to find behind a gap of two blanks or more; None if it can do without one."""
    head, mark, rest = re.sub(r"\\s\{3,\}", r"\\s{2,}", pattern).partition(r"\s{2,}")
    flags = re.match(r"\(\?([im]+)\)", head)
    head = head[flags.end():] if flags else head
    # the gap is one part of a sequence, not of a group or of an alternative
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", head)
    if not mark or rest[:1] in ("+", "*", "?") or plain.count("(") != plain.count(")") or "|" in plain:
        return None
    return f"(?{flags[1] if flags else ''}:{rest})"


def at_gaps(text: Column, pairs: tuple[Pair, ...]) -> Column:
    """``subs`` of expressions that all need a gap.

    A text in which no gap is followed by what one of them wants passes as it is, after one look
    at it; else each half of them is looked for by itself.
    """
    if len(pairs) < 3:
        return subs(text, *pairs)
    half = len(pairs) // 2
    wanted = "|".join(dict.fromkeys(behind_gap(p) for p, _ in pairs))
    return only_if(text, lambda t: t.rlike(rf"(?d)\s{{2,}}(?:{wanted})"),
                   lambda t: at_gaps(at_gaps(t, pairs[:half]), pairs[half:]))


def chained(steps: Iterable[Step]) -> list[Rule]:
    """The rules of steps in their order, neighbouring replaces at gaps taken together."""
    rules: list[Rule] = []
    waiting: list[Pair] = []

    def flush() -> None:
        if waiting:
            rules.append(lambda t, pairs=tuple(waiting): at_gaps(t, pairs))
            waiting.clear()

    for s in steps:
        if not s.pairs:
            flush()
            rules.append(s.apply)
        for pair in s.pairs:
            if behind_gap(pair[0]) and len(waiting) < TOGETHER:
                waiting.append(pair)
                continue
            flush()
            if behind_gap(pair[0]):
                waiting.append(pair)
            else:
                rules.append(lambda t, pair=pair: sub(t, *pair))
    flush()
    return rules


#: Replaces at gaps that share one look at the text.
TOGETHER = 24


def only_if(text: Column, test: Rule, body: Rule) -> Column:
    """Apply ``body`` only where a cheap test says it can matter."""
    return let(text, lambda t: F.when(test(t), body(t)).otherwise(t))


def if_contains(text: Column, literals: Iterable[str], body: Rule) -> Column:
    def test(t: Column) -> Column:
        hit = F.lit(False)
        for x in literals:
            hit = hit | t.contains(x)
        return hit

    return only_if(text, test, body)


def where_found(text: Column, literals: Iterable[str], *pairs: Pair) -> Column:
    """``subs`` of expressions whose every match holds one of the literals: other texts pass after a plain search."""
    return if_contains(text, literals, lambda t: subs(t, *pairs))


def per_line(text: Column, fn: Rule) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), fn), "\n")


def between_marks(text: Column, marks: str, fn: Rule) -> Column:
    """Apply ``fn`` to each stretch up to and with one of the marks, for rules whose matches hold no mark."""
    return F.array_join(F.transform(F.split(text, f"(?<=[{marks}])", -1), fn), "")


GAP = r"[^\S\n]{2}"


def per_line_with_gaps(text: Column, fn: Rule) -> Column:
    """Per-line rules about runs of blanks; skipped for texts that have none."""
    return only_if(text, lambda t: t.rlike(GAP), lambda t: per_line(t, fn))


def blocks(text: Column, opens: str, closes: str, body: Rule) -> Column:
    """Apply ``body`` to each stretch that starts at a line matching ``opens`` and runs up to the
    next line matching ``opens`` or ``closes``. Both are whole-line expressions.

    Every line that can change the state starts a piece, so each piece knows its own state.
    """
    def cut(t: Column) -> Column:
        pieces = F.split(t, rf"(?md)(?=^(?:{opens}|{closes}))", -1)
        opened = rf"(?md)\A(?:{opens})"
        return F.array_join(F.transform(
            pieces, lambda p: F.when(p.rlike(opened), body(p)).otherwise(p)), "")

    return only_if(text, lambda t: t.rlike(rf"(?md)^(?:{opens})"), cut)


def below(piece: Column, fn: Rule) -> Column:
    """Apply ``fn`` to the lines of a piece after its first."""
    return F.array_join(F.transform(
        F.split(piece, "\n", -1), lambda x, i: F.when(i > 0, fn(x)).otherwise(x)), "\n")


def runs(text: Column, member: str, head: Rule, join: Rule) -> Column:
    """Rules by which a head line takes in the lines that follow it.

    ``member`` is a whole-line expression for lines that may be taken in. Pieces start at every
    other line; those whose head passes ``head`` are rewritten by ``join``.
    """
    pieces = F.split(text, rf"(?md)(?=^(?!{member}))", -1)
    return F.array_join(F.transform(pieces, lambda p: F.when(head(p), join(p)).otherwise(p)), "")


def join_lines(piece: Column) -> Column:
    """All lines of a piece as one, its closing line feed kept."""
    return sub(piece, r"[ \t]*\n[ \t]*(?=\S)", " ")


def swap(text: Column, pattern: str, repair: Rule) -> Column:
    """Rewrite every match of one expression by a function of the matched text."""

    def rewrite(t: Column) -> Column:
        marked = F.split(sub(t, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)
        return F.array_join(F.transform(marked, lambda p: F.when(
            F.contains(p, F.lit(CLOSE)),
            F.concat(
                repair(F.substring_index(p, CLOSE, 1)),
                F.substring(p, F.locate(CLOSE, p) + 1, F.length(p)),
            ),
        ).otherwise(p)), "")

    return only_if(text, lambda t: t.rlike("(?d)" + pattern), rewrite)


def lookup(table: dict[str, str], key: Rule) -> Rule:
    """Repair by dictionary; a key that is not listed leaves the match alone."""

    def repair(match: Column) -> Column:
        entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(F.try_element_at(entries, key(match)), match)

    return repair


@dataclass(frozen=True)
class Rejoin:
    """Compiled table of broken phrases: what to find, how to repair it, and a cheap test."""

    pattern: str
    repairs: dict[str, str]
    near: str
    test: str


def rejoin_rules(words: dict[str, str], stems: dict[str, str]) -> Rejoin:
    """Compile phrases, given as their parts with blanks between, and what they are meant to be.

    A phrase counts as broken where at least one of its gaps holds a line feed. A gap that is
    a blank in the meant form needs white space, any other gap may be closed. ``words`` end
    with a word, ``stems`` may go on. The tests start from line breaks: what stands right
    after one (``near``), then what stands before it.
    """
    patterns, repairs, lefts, rights = [], {}, {}, {}
    for ends, table in ((r"\b", words), ("", stems)):
        for phrase, meant in table.items():
            parts = phrase.split(" ")
            gaps = [r"\s+" if f"{a} {b}" in meant else r"\s*" for a, b in zip(parts, parts[1:])]
            body = re.escape(parts[0]) + "".join(g + re.escape(p) for g, p in zip(gaps, parts[1:]))
            patterns.append(body + ends)
            repairs[_squeeze(phrase)] = meant
            lefts |= dict.fromkeys(parts[:-1])
            rights |= dict.fromkeys(parts[1:])
    patterns.sort(key=len, reverse=True)
    return Rejoin(
        r"(?i)\b(?:" + "|".join(patterns) + ")", repairs, rf"\n\s*{any_of(rights)}",
        rf"(?=\s*\n\s*{any_of(rights)})(?<={any_of(lefts)})")


def _squeeze(form: str) -> str:
    return re.sub(r"[\s&/:-]", "", form.lower())


def rejoin(text: Column, rules: Rejoin) -> Column:
    key = lambda m: F.lower(F.regexp_replace(m, r"[\s&/:-]", ""))
    known = lookup(rules.repairs, key)
    return only_if(text, lambda t: t.rlike(rules.near) & t.rlike(rules.test), lambda t: swap(
        t, rules.pattern, lambda m: F.when(m.contains("\n"), known(m)).otherwise(m)))


def trimmed_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")
