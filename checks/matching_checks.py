"""Matching, filters and search over the derived notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import (
    ALL_RULES, CLINICAL_RULES, N, NA, NM, NR, REGEX_SQL, RULES, annotations, notes, sql,
)
from chartspan.functions import vocab
from chartspan.operators import filters, matching, stats, wordindex
from chartspan.operators.rules import Rule, questions_table
from chartspan.plans.session import new_folder


@query("match_terms", sql('SELECT note_id, question_id, term, "start", "end" FROM matches', *NM))
def _(spark, sf):
    return matching.match_terms(notes(spark, sf), RULES).drop("negated")


NEG = [Rule("Q1", "term", "tion", True)]
_CUES = ["no ", "not ", "denies ", "negative for ", "without ", "absent ", "de ", "the "]


@query("negation_flag", sql(
    'SELECT note_id, "start", "end", ' + " OR ".join(
        f"ends_with(substr(lower(text), greatest(\"start\" - 15, 0) + 1, \"start\" - greatest(\"start\" - 15, 0)), '{c}')"
        for c in vocab.NEGATION_CUES) + " AS negated FROM hits WHERE question_id = 'Q5'", *NM))
def _(spark, sf):
    return matching.match_terms(notes(spark, sf), NEG).select("note_id", "start", "end", "negated")


@query("match_regex", sql('SELECT note_id, question_id, term, "start", "end" FROM regex_matches', N, REGEX_SQL))
def _(spark, sf):
    return matching.match_regex(notes(spark, sf), ALL_RULES)


@query("match_questions", sql(
    'SELECT note_id, question_id, term, "start", "end" FROM matches UNION ALL '
    'SELECT note_id, question_id, term, "start", "end" FROM regex_matches', *NM, REGEX_SQL))
def _(spark, sf):
    return matching.match_questions(notes(spark, sf), ALL_RULES)


@query("auto_tag", sql(
    'SELECT note_id, "start", "end", term AS text, question_id AS questions, '
    "'suggested' AS source FROM matches", *NM))
def _(spark, sf):
    tagged = matching.auto_tag(matching.match_questions(notes(spark, sf), RULES))
    return tagged.select(
        "note_id", "start", "end", "text", F.array_join("questions", ";").alias("questions"), "source")


@query("rules_x_notes", sql(
    "SELECT n.note_id, r.question_id, r.pattern FROM notes n, rules r WHERE contains(lower(n.text), r.pattern)", *NR))
def _(spark, sf):
    return matching.rules_x_notes(notes(spark, sf), RULES)


_PHRASE_SQL = """
found AS (
  SELECT note_id, pos, "start", "end", term FROM matches m WHERE question_id = 'Q5'
    AND NOT EXISTS (SELECT 1 FROM annotations a WHERE a.note_id = m.note_id AND a."start" = m."start" AND a."end" = m."end")),
ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY "start") AS rn FROM found)"""


@query("untagged_matches", sql('SELECT note_id, "start", "end", term FROM found',
                               *NA, NM[2], _PHRASE_SQL))
def _(spark, sf):
    hits = matching.match_terms(notes(spark, sf), [Rule("Q5", "term", "tion")])
    return matching.untagged_matches(hits, annotations(spark, sf)).select("note_id", "start", "end", "term")


@query("first_k_per_note", sql('SELECT note_id, "start", "end", term FROM ranked WHERE rn <= 10',
                               *NA, NM[2], _PHRASE_SQL))
def _(spark, sf):
    hits = matching.match_terms(notes(spark, sf), [Rule("Q5", "term", "tion")])
    free = matching.untagged_matches(hits, annotations(spark, sf))
    return matching.first_k_per_note(free, 10).select("note_id", "start", "end", "term")


_SEARCH_SQL = _PHRASE_SQL + """,
capped AS (SELECT * FROM ranked WHERE rn <= 10),
per AS (SELECT note_id, pos, count(*) AS n FROM capped GROUP BY 1, 2),
run AS (SELECT note_id, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM per),
tagged AS (
  SELECT c.note_id, c.note_id || '_' || CAST(c."start" AS VARCHAR) AS match_id, c.term, c."start", c."end",
         substr(n.text, greatest(c."start" - 25, 0) + 1, c."start" - greatest(c."start" - 25, 0)) AS context_before,
         substr(n.text, c."end" + 1, 25) AS context_after
  FROM capped c JOIN run USING (note_id) JOIN notes n USING (note_id) WHERE run.b < 500)"""


def _search(spark, sf):
    return matching.search_and_tag(notes(spark, sf), annotations(spark, sf), "tion", per_note=10, stop_at=500).drop("pos")


@query("search_and_tag", sql("SELECT * FROM tagged", *NA, NM[2], _SEARCH_SQL))
def _(spark, sf):
    return _search(spark, sf)


@query("deselect_matches", sql('SELECT note_id, "start", "end", term FROM found WHERE "start" % 2 = 0', *NA, NM[2], _PHRASE_SQL))
def _(spark, sf):
    """From all untagged occurrences."""
    found = matching.search_and_tag(notes(spark, sf), annotations(spark, sf), "tion")
    left = matching.deselect_matches(found, found.where(F.col("start") % 2 == 1))
    return left.select("note_id", "start", "end", "term")


_INDEX_SQL = """
words AS (
  SELECT note_id, unnest(regexp_split_to_array(lower(note_id), '[^A-Za-z0-9_]+')) AS word, 2 AS least FROM notes
  UNION ALL
  SELECT note_id, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')), 3 FROM notes),
posting AS (SELECT DISTINCT word, note_id FROM words WHERE length(word) >= least)"""


@query("build_word_index", sql("SELECT word, note_id FROM posting", N, _INDEX_SQL))
def _(spark, sf):
    return matching.build_word_index(notes(spark, sf))


@query("search_word_index", sql(
    "SELECT note_id FROM notes n WHERE EXISTS (SELECT 1 FROM posting p WHERE p.note_id = n.note_id "
    "AND (contains(word, 'ation') OR contains(word, 'ung')))", N, _INDEX_SQL))
def _(spark, sf):
    n = notes(spark, sf)
    return matching.search_word_index(matching.build_word_index(n), n, "Ation, ung").select("note_id")


_STORED = ["Ation, ung", "le", "12", "medication", "idx.0000"]


@query("stored_word_index", sql(
    "SELECT q.query, n.note_id FROM notes n, asked q WHERE EXISTS (SELECT 1 FROM posting p WHERE p.note_id = n.note_id AND ("
    "contains(word, q.a) OR contains(word, q.b)))", N, _INDEX_SQL,
    "asked AS (SELECT * FROM (VALUES " + ", ".join(
        f"('{q}', '{matching.query_words(q)[0]}', '{matching.query_words(q)[-1]}')" for q in _STORED) + ") AS q(query, a, b))"))
def _(spark, sf):
    """Two parts, the second with notes of the first indexed anew, merged, then a third part and look-ups over both."""
    n, path = notes(spark, sf), new_folder(spark, "words")
    wordindex.add_to_word_index(n.where("pos % 3 = 0").withColumn("text", F.lit("medication 12")), path, buckets=8)
    wordindex.add_to_word_index(n.where("pos % 3 < 2"), path)
    wordindex.merge_word_index(spark, path)
    wordindex.add_to_word_index(n.where("pos % 3 = 2"), path)
    out = [wordindex.search_stored_index(n, path, q).select(F.lit(q).alias("query"), "note_id") for q in _STORED]
    return reduce(DataFrame.unionByName, out)


@query("filter_min_length", sql("SELECT note_id FROM notes WHERE length(text) >= 2000", N))
def _(spark, sf):
    return filters.filter_min_length(notes(spark, sf), 2000).select("note_id")


@query("filter_exclude_terms", sql(
    "SELECT note_id FROM notes WHERE NOT contains(lower(text), 'und ') AND NOT contains(lower(text), 'pour')", N))
def _(spark, sf):
    return filters.filter_exclude_terms(notes(spark, sf), " Und , POUR,, ".replace("Und ,", "pour,")
                                        ).where(~F.lower("text").contains("und ")).select("note_id")


_SMART = ("length(text) >= 300 AND NOT contains(lower(text), 'pour') AND (contains(lower(text), 'the ') "
          "OR regexp_matches(text, '(?i)[a-z]+ment\\b'))")


@query("smart_filter", sql(f"SELECT note_id FROM notes WHERE {_SMART}", N))
def _(spark, sf):
    return filters.smart_filter(
        notes(spark, sf), ALL_RULES, ["Q1", "Q7"], min_length=300, excludes="Pour").select("note_id")


@query("smart_filter_report", sql(
    f"SELECT count(*) FILTER (WHERE {_SMART}) AS matching, count(*) FILTER (WHERE length(text) < 300 OR "
    "contains(lower(text), 'pour')) AS excluded, CAST(0 AS BIGINT) AS model_matches FROM notes", N))
def _(spark, sf):
    return filters.smart_filter_report(
        notes(spark, sf), ALL_RULES, ["Q1", "Q7"], min_length=300, excludes="Pour")


@query("filter_radiology_notes", sql(
    "SELECT note_id FROM notes WHERE note_id LIKE 'RAD%' OR contains(lower(coalesce(type, '')), 'rad') "
    "OR contains(lower(coalesce(type, '')), 'imaging') OR regexp_matches(text, "
    "'(?i)\\b(renal sonogram|renal ultrasound|ct abdomen|ct urogram|mri abdomen|impression:|findings:|kidneys/ureters)\\b')", N))
def _(spark, sf):
    return filters.filter_radiology_notes(notes(spark, sf)).select("note_id")


def _signs(words):
    return " + ".join(f"CAST(contains(upper(text), '{w}') AS INT)" for w in words)


@query("detect_radiology_format", sql(
    f"SELECT note_id, CASE WHEN {_signs(vocab.RADIOLOGY_ANTI)} >= 2 THEN {_signs(vocab.RADIOLOGY_STRONG)} >= 2 "
    f"ELSE {_signs(vocab.RADIOLOGY_STRONG)} >= 1 END AS is_radiology FROM "
    "(SELECT note_id, CASE WHEN pos % 3 = 0 THEN 'Findings: ' || text ELSE text END AS text FROM notes)", N))
def _(spark, sf):
    n = notes(spark, sf).withColumn("text", F.when(
        F.col("pos") % 3 == 0, F.concat(F.lit("Findings: "), "text")).otherwise(F.col("text")))
    return filters.detect_radiology_format(n).select("note_id", "is_radiology")


@query("search_notes_substring", sql(
    "SELECT note_id FROM notes WHERE contains(lower(note_id), 'rad') OR contains(lower(text), 'rad')", N))
def _(spark, sf):
    return filters.search_notes_substring(notes(spark, sf), "Rad").select("note_id")


@query("filter_note_type", sql("SELECT note_id, type FROM notes WHERE type = 'src3'", N))
def _(spark, sf):
    return filters.filter_note_type(notes(spark, sf), "src3").select("note_id", "type")


_SOME = "a.source = 'manual'"


@query("filter_note_status", sql(
    "SELECT note_id, EXISTS (SELECT 1 FROM annotations a WHERE a.note_id = n.note_id AND " + _SOME + ") AS done FROM notes n", *NA))
def _(spark, sf):
    n = notes(spark, sf).select("note_id")
    a = annotations(spark, sf).where("source = 'manual'")
    done = filters.filter_note_status(n, a, "done").withColumn("done", F.lit(True))
    todo = filters.filter_note_status(n, a, "todo").withColumn("done", F.lit(False))
    return done.unionByName(todo)


@query("restrict_to_note_set", sql(
    "SELECT note_id FROM notes WHERE note_id IN (SELECT note_id FROM matches WHERE question_id = 'Q2')", *NM))
def _(spark, sf):
    n = notes(spark, sf)
    found = matching.match_terms(n, [Rule("Q2", "term", " und ")])
    return filters.restrict_to_note_set(n, found).select("note_id")


@query("delete_non_matching", sql(
    f"SELECT note_id, length(text) AS size FROM notes WHERE {_SMART}", N))
def _(spark, sf):
    from chartspan.plans.session import new_folder

    n = notes(spark, sf)
    keep = filters.smart_filter(n, ALL_RULES, ["Q1", "Q7"], min_length=300, excludes="Pour")
    kept = filters.delete_non_matching(n, keep, new_folder(spark, "kept"))
    return kept.select("note_id", F.length("text").cast("long").alias("size"))


@query("tag_and_count", sql(
    "SELECT q.question_id, count(m.note_id) AS n FROM (SELECT unnest(['Q1','Q2','Q3','Q4','Q5','Q6','Q7','Q8','Q9','Q10']) AS question_id) q "
    "LEFT JOIN matches m USING (question_id) GROUP BY 1", *NM))
def tag_and_count(spark, sf):
    """Flagship: match every question, tag the matches, count the tags per question."""
    tagged = matching.auto_tag(matching.match_questions(notes(spark, sf), RULES))
    return stats.count_by_question(tagged, questions_table(spark))


@query("clinical_rule_matches", sql(
    "SELECT count(*) AS n FROM notes WHERE " + " OR ".join(
        f"contains(lower(text), '{r.pattern.lower()}')" for r in CLINICAL_RULES if r.kind == "term" and not r.negation),
    N))
def _(spark, sf):
    plain = [r for r in CLINICAL_RULES if r.kind == "term" and not r.negation]
    return filters.smart_filter(notes(spark, sf), plain, [r.question_id for r in plain]).agg(
        F.count(F.lit(1)).alias("n"))
