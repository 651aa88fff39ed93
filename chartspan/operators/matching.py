"""Finding terms and expressions in note text, with offsets.

A note is scanned in place: rules are literals exploded per note, each surviving rule marks
its matches in the text with one native replace, and offsets are prefix sums of the piece
lengths between the marks. No join, no shuffle and no Python is involved.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.functions import vocab
from chartspan.functions.text import (
    CLOSE, FLAG, OPEN, after, any_of, ascii_words, before, fold_case, guard, quote, running_total, slice_text,
)
from chartspan.operators.rules import Rule, overlaps_itself

#: A capturing group.
_GROUP = re.compile(r"(?<!\\)\((?!\?(?!<[A-Za-z]))")
_CUE = "(?<=" + "|".join(vocab.NEGATION_CUES) + ")"
_NOT_CUE = "(?<!" + "|".join(vocab.NEGATION_CUES) + ")"


def _rule_literals(rules: list[Rule]) -> Column:
    def literal(r: Rule) -> Column:
        is_term = r.kind == "term"
        here = f"(?={quote(r.pattern)})" if is_term else f"(?:{ascii_words(r.pattern)})"
        cues = "(?iu)" + here + _CUE if is_term and r.negation else None
        return F.struct(
            F.lit(r.question_id).alias("question_id"),
            F.lit(is_term).alias("is_term"),
            F.lit(r.pattern.lower()).alias("needle"),
            F.lit("(?iu)" + here).alias("regex"),
            F.lit(OPEN if is_term else f"{OPEN}$0{CLOSE}").alias("mark"),
            F.lit(cues).cast("string").alias("cue_regex"),
            F.lit(is_term and overlaps_itself(r.pattern)).alias("self_overlap"),
        )

    return F.array(*[literal(r) for r in rules])


def _marked(notes: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per note and rule that occurs: ``pieces`` of the text cut before each match."""
    candidates = (
        notes.withColumn("__low", fold_case("text"))
        .withColumn("__safe", guard("text"))
        .withColumn("__plain", F.col("__safe") == F.col("text"))
        .withColumn("__rule", F.explode(F.filter(
            _rule_literals(rules), lambda r: ~r["is_term"] | F.contains(F.col("__low"), r["needle"])
        )))
        .drop("__low")
    )
    cued = F.when(
        F.col("__rule.cue_regex").isNotNull(),
        F.regexp_replace(F.col("__safe"), F.col("__rule.cue_regex"), F.lit(FLAG)),
    ).otherwise(F.col("__safe"))
    return (
        candidates.withColumn("__cued", cued)
        .withColumn("__marked", F.regexp_replace(
            F.col("__cued"), F.col("__rule.regex"), F.col("__rule.mark")))
        .where(F.contains(F.col("__marked"), F.lit(OPEN)))
        .withColumn("__pieces", F.split("__marked", OPEN, -1))
        .drop("__safe", "__cued", "__marked")
    )


def _matches(notes: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Every match: keep columns, question, term, start, end, negated."""
    marks = _marked(notes, rules)
    flagged = lambda p: F.endswith(p, F.lit(FLAG)).cast("int")
    closed = lambda p: F.contains(p, F.lit(CLOSE)).cast("int")
    located = marks.withColumn("__upto", running_total(F.transform(
        "__pieces", lambda p: F.length(p) - flagged(p) - closed(p)
    )))
    size = F.length("__rule.needle")

    def hit(i: Column) -> Column:
        at = i.cast("int")
        piece, before = F.element_at("__pieces", at), F.element_at("__pieces", at - 1)
        start = F.element_at("__upto", at - 1)
        term = (
            F.when(~F.col("__rule.is_term"), F.substring_index(piece, CLOSE, 1))
            .when(F.col("__rule.self_overlap"), F.substring("text", start + 1, size))
            .otherwise(F.left(piece, size))
        )
        # where markers were blanked out the words come from the text itself
        term = F.when(F.col("__plain"), term).otherwise(F.substring("text", start + 1, F.length(term)))
        return F.struct(start.alias("start"), term.alias("term"), F.endswith(before, F.lit(FLAG)).alias("negated"))

    found = F.transform(F.sequence(F.lit(2), F.size("__pieces")), hit)
    spans = located.select(
        *keep,
        F.col("__rule.question_id").alias("question_id"),
        F.explode(found).alias("__hit"),
    ).select(*keep, "question_id", "__hit.*")
    return spans.where(F.length("term") > 0).withColumn("end", F.col("start") + F.length("term"))


def match_terms(notes: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """Every occurrence of every term, case-insensitive, overlaps with itself included."""
    terms = [r for r in rules if r.kind == "term"]
    return _matches(notes, terms, list(keep)).select(
        *keep, "term", "start", "end", "question_id", "negated"
    )


def negation_flag(text: Column | str, start: Column) -> Column:
    """A cue ends right before ``start`` (within the 15 characters looked at)."""
    return before(text, start, 15).rlike("(?iu)(?:" + "|".join(vocab.NEGATION_CUES) + r")\z")


def match_regex(notes: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """Every non-empty match of every expression; negation does not apply to expressions."""
    regexes = [r for r in rules if r.kind == "regex"]
    return _matches(notes, regexes, list(keep)).select(*keep, "term", "start", "end", "question_id")


def match_questions(
    notes: DataFrame,
    rules: list[Rule],
    entities: DataFrame | None = None,
    entity_question: str = "Q6",
    keep: tuple[str, ...] = ("note_id",),
) -> DataFrame:
    """Term and expression matches of all questions in one scan of the notes.

    With ``entities``, the spans of a model stand in for the rules of ``entity_question``.
    """
    used = [r for r in rules if entities is None or r.question_id != entity_question]
    hits = _matches(notes, used, list(keep)).where(~F.col("negated")).select(
        *keep, "term", "start", "end", "question_id"
    )
    if entities is None:
        return hits
    from_model = notes.select(*keep).join(entities, "note_id").select(
        *keep, F.col("text").alias("term"), "start", "end",
        F.lit(entity_question).alias("question_id"),
    )
    return hits.unionByName(from_model)


def question_predicates(rules: list[Rule]) -> dict[str, Column]:
    """question -> does the note match it; one expression per question, no match is exploded."""
    out: dict[str, Column] = {}
    for q in dict.fromkeys(r.question_id for r in rules):
        mine = [r for r in rules if r.question_id == q]
        plain = [r.pattern for r in mine if r.kind == "term" and not r.negation]
        negatable = [r.pattern for r in mine if r.kind == "term" and r.negation]
        parts = []
        if plain:
            parts.append(any_of(plain))
        if negatable:
            parts.append(f"(?={any_of(negatable)}){_NOT_CUE}")
        expressions = [f"(?:{ascii_words(r.pattern)})" for r in mine if r.kind == "regex"]
        # a group keeps its number only in an expression of its own
        numbered = [x for x in expressions if _GROUP.search(x)]
        parts += [x for x in expressions if x not in numbered]
        tests = [F.col("text").rlike("(?iu)" + x) for x in ["|".join(parts)] * bool(parts) + numbered]
        out[q] = reduce(Column.__or__, tests)
    return out


def rules_x_notes(notes: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """(note, rule) pairs where the term occurs; a theta join done inside the note's row."""
    terms = [r for r in rules if r.kind == "term"]
    return (
        notes.withColumn("__low", fold_case("text"))
        .withColumn("__rule", F.explode(F.filter(
            F.array(*[F.struct(F.lit(r.question_id).alias("question_id"),
                               F.lit(r.pattern).alias("pattern"),
                               F.lit(r.pattern.lower()).alias("needle")) for r in terms]),
            lambda r: F.contains(F.col("__low"), r["needle"]),
        )))
        .select(*keep, "__rule.question_id", "__rule.pattern")
    )


def auto_tag(matches: DataFrame) -> DataFrame:
    """One suggested annotation per match; the id is a hash of what it marks."""
    return matches.select(
        F.concat(F.lit("ann_"), F.lower(F.hex(F.xxhash64(
            "note_id", "start", "end", "question_id")))).alias("ann_id"),
        "note_id", "start", "end",
        F.col("term").alias("text"),
        F.array("question_id").alias("questions"),
        F.lit(None).cast("string").alias("comment"),
        F.lit("suggested").alias("source"),
    )


def find_phrase(notes: DataFrame, phrase: str, keep: tuple[str, ...] = ("note_id",), k: int = 25) -> DataFrame:
    """Occurrences of one phrase with ``k`` characters of context on both sides."""
    columns = list(keep) + ["text"]
    hits = _matches(notes.select(*columns), [Rule("", "term", phrase)], columns)
    return hits.select(
        *keep,
        F.concat("note_id", F.lit("_"), F.col("start").cast("string")).alias("match_id"),
        "term", "start", "end",
        before("text", F.col("start"), k).alias("context_before"),
        after("text", F.col("end"), k).alias("context_after"),
    )


def untagged_matches(matches: DataFrame, annotations: DataFrame) -> DataFrame:
    """Matches whose exact span carries no annotation yet."""
    taken = annotations.select("note_id", "start", "end")
    return matches.join(taken, ["note_id", "start", "end"], "left_anti")


def first_k_per_note(matches: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` matches of a note in text order. Spark drops rows beyond ``k`` before the
    shuffle, so a note with very many matches sends ``k`` per task."""
    order = Window.partitionBy("note_id").orderBy("start", "end")
    return matches.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def search_and_tag(
    notes: DataFrame,
    annotations: DataFrame,
    phrase: str,
    per_note: int | None = None,
    stop_at: int | None = None,
    order: str = "pos",
) -> DataFrame:
    """Untagged occurrences of a phrase: all, or the first ``per_note`` of a note, or those of the
    notes taken in order until ``stop_at`` are found (a review screen asks for 10 and 500).

    Every note taken holds at least one match, so the first ``stop_at`` notes always suffice
    and the running total is taken over at most that many rows.
    """
    if not phrase.strip():
        raise ValueError("phrase is blank")
    hits = untagged_matches(find_phrase(notes, phrase, ("note_id", order)), annotations)
    if per_note is not None:
        hits = first_k_per_note(hits, per_note).drop("rn")
    if stop_at is None:
        return hits
    per = hits.groupBy("note_id", order).agg(F.count(F.lit(1)).alias("n"))
    head = per.orderBy(order).limit(stop_at)
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept = head.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(
        F.col("before") < stop_at
    )
    return hits.join(kept.select("note_id"), "note_id", "left_semi")


def deselect_matches(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    return matches.join(excluded.select("match_id"), "match_id", "left_anti")


def build_word_index(notes: DataFrame, head: int | None = None) -> DataFrame:
    """(word, note): words of the id (2+ characters) and of the text (3+), or of its first ``head`` characters."""

    def words(c: Column, least: int) -> Column:
        return F.filter(F.split(F.lower(c), r"[^A-Za-z0-9_]+"), lambda w: F.length(w) >= least)

    both = F.array_union(
        F.array_distinct(words(F.col("note_id"), 2)),
        F.array_distinct(words(F.col("text") if head is None else F.substring("text", 1, head), 3)),
    )
    return notes.select(F.explode(both).alias("word"), "note_id")


def query_words(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^a-z0-9_]+", query.lower()) if len(w) >= 2]


def search_word_index(index: DataFrame, notes: DataFrame, query: str) -> DataFrame:
    """Notes with an indexed word that contains any word of the query; no usable word, all notes."""
    words = query_words(query)
    if not words:
        return notes
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("word").contains(w)
    return notes.join(index.where(hit).select("note_id"), "note_id", "left_semi")


def write_word_index(index: DataFrame, path: str) -> None:
    """Store the index by first letter so a prefix lookup prunes folders. A frequent letter is
    spread over several files by the note."""
    (index.withColumn("letter", F.substring("word", 1, 1))
     .repartition("letter", (F.xxhash64("note_id") % 16))
     .write.partitionBy("letter").mode("overwrite").parquet(path))
