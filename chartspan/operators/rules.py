"""Rule and question dictionaries: small parameter tables turned into literals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chartspan import schemas
from chartspan.functions import vocab


@dataclass(frozen=True)
class Rule:
    question_id: str
    kind: str
    pattern: str
    negation: bool = False


def default_rules() -> list[Rule]:
    terms = [
        Rule(q, "term", t, q in vocab.NEGATED_QUESTIONS)
        for q, words in vocab.DEFAULT_TERMS.items() for t in words
    ]
    regexes = [
        Rule(q, "regex", p, q in vocab.NEGATED_QUESTIONS)
        for q, patterns in vocab.DEFAULT_REGEXES.items() for p in patterns
    ]
    return terms + regexes


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    rows = [(r.question_id, r.kind, r.pattern, r.negation) for r in rules or default_rules()]
    return spark.createDataFrame(rows, schemas.RULE)


def questions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.DEFAULT_QUESTIONS, schemas.QUESTION)


def load_rules(table: DataFrame) -> list[Rule]:
    """Read a RULE table for use as literals. Expressions that do not compile are dropped.

    A rule table is configuration, written by people: all of it becomes literals of the plan.
    """
    rows = table.select("question_id", "kind", "pattern", "negation").collect()
    compiles = _compiler(table.sparkSession)
    return [
        Rule(r.question_id, r.kind, r.pattern, bool(r.negation))
        for r in rows
        if r.pattern and (r.kind == "term" or compiles(r.pattern))
    ]


def usable(rules: list[Rule], spark: SparkSession) -> list[Rule]:
    compiles = _compiler(spark)
    return [r for r in rules if r.pattern and (r.kind == "term" or compiles(r.pattern))]


def _compiler(spark: SparkSession):
    """Compile check by the engine that will run the expression, else by Python's."""
    try:
        pattern = spark._jvm.java.util.regex.Pattern
    except AttributeError:
        pattern = re

    def compiles(expression: str) -> bool:
        try:
            pattern.compile(expression)
            return True
        except Exception:
            return False

    return compiles


def overlaps_itself(term: str) -> bool:
    """True when an occurrence of the term can start inside another one."""
    t = term.lower()
    return any(t.startswith(t[i:]) for i in range(1, len(t)))
