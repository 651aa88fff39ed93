"""Term and expression matching against plain Python, and the documented quirks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chartspan.operators import filters, matching, tokens, wordindex
from chartspan.operators.rules import Rule, default_rules, load_rules, overlaps_itself, rules_table

NOTE = "note_id string, text string, type string, date string, source string, raw_text string, pos long"


def frame(spark, texts):
    rows = [(f"n{i}", t, None, None, None, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, NOTE)


def all_starts(text, term):
    low, t = text.lower(), term.lower()
    return [i for i in range(len(low) - len(t) + 1) if low.startswith(t, i)]


def test_terms_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abAB n\né😀") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    terms = ["ab", "aa", "aba", "n a", "é", "😀", "a"]
    got = matching.match_terms(frame(spark, texts), [Rule("Q", "term", t) for t in terms]).collect()
    found = sorted((r.note_id, r.start, r.end, r.term) for r in got)
    want = sorted(
        (f"n{i}", s, s + len(t), text[s:s + len(t)])
        for i, text in enumerate(texts) for t in terms for s in all_starts(text, t))
    assert found == want


def test_many_matches_in_one_note(spark):
    """More matches than one chunk of the running total holds, overlapping ones included."""
    text = "a" * 3000 + "xyz" * 500
    got = matching.match_terms(frame(spark, [text]), [Rule("Q", "term", "aa"), Rule("Q", "term", "yz")])
    assert sorted(r.start for r in got.where("term = 'aa'").collect()) == list(range(2999))
    assert sorted(r.start for r in got.where("term = 'yz'").collect()) == all_starts(text, "yz")


def test_regexes_equal_python(spark):
    texts = ["5 mm and 12MM, 3 x 4, 10x20 mGy", "no sizes", "1mm2mm3 mm", "", "x" * 50 + "7 cm"]
    patterns = [r"\d+\s*mm\b", r"\d+\s*x\s*\d+", "mgy", r"\d*", r"\d+\s*cm\b"]
    got = matching.match_regex(frame(spark, texts), [Rule(p, "regex", p) for p in patterns]).collect()
    want = sorted(
        (f"n{i}", p, m.start(), m.group(0))
        for i, t in enumerate(texts) for p in patterns
        for m in re.finditer(p, t, re.I) if m.group(0))
    assert sorted((r.note_id, r.question_id, r.start, r.term) for r in got) == want


@pytest.mark.parametrize("text, negated", [
    ("denies hematuria", True), ("no hematuria", True), ("casino hematuria", True),
    ("no evidence of hematuria", False), ("NOT hematuria", True), ("negative for hematuria", True),
    ("hematuria", False), ("no  hematuria", False),
])
def test_negation_is_a_suffix_test(spark, text, negated):
    rules = [Rule("Q1", "term", "hematuria", True)]
    notes = frame(spark, [text])
    [row] = matching.match_terms(notes, rules).collect()
    assert row.negated is negated
    assert notes.select(matching.negation_flag("text", F.lit(row.start))).first()[0] is negated
    assert matching.match_questions(notes, rules).count() == (0 if negated else 1)
    assert filters.smart_filter(notes, rules, ["Q1"]).count() == (0 if negated else 1)


def test_negation_does_not_apply_to_expressions(spark):
    notes = frame(spark, ["no 5 mm stone"])
    assert matching.match_questions(notes, [Rule("Q6", "regex", r"\d+\s*mm\b", True)]).count() == 1


def test_filter_agrees_with_matches(spark):
    texts = ["Flank pain, 5mm stone", "denies flank pain", "22 Fr sheath and basket", "nothing here", "unemployed"]
    notes, rules = frame(spark, texts), default_rules()
    questions = sorted({r.question_id for r in rules})
    kept = {r.note_id for r in filters.smart_filter(notes, rules, questions).collect()}
    assert kept == {r.note_id for r in matching.match_questions(notes, rules).collect()}
    assert kept == {"n0", "n2", "n4"}


def test_no_selection_keeps_every_admitted_note(spark):
    notes = frame(spark, ["long enough text", "short", "has Bad word in it"])
    assert [r.note_id for r in filters.smart_filter(notes, default_rules(), None, 6, " bad ,").collect()] == ["n0"]


def test_model_entities_replace_rules_of_their_question(spark):
    notes = frame(spark, ["5 mm stone", "nothing"])
    entities = spark.createDataFrame([("n1", "RADIOLOGY", "nothing", 0, 7)], "note_id string, type string, text string, start int, end int")
    got = matching.match_questions(notes, default_rules(), entities).collect()
    assert [(r.note_id, r.question_id, r.term) for r in got] == [("n1", "Q6", "nothing")]
    kept = filters.smart_filter(notes, default_rules(), ["Q6"], entities=entities).collect()
    assert [r.note_id for r in kept] == ["n1"]


def test_rules_that_do_not_compile_are_dropped(spark):
    table = rules_table(spark, [Rule("Q", "regex", "("), Rule("Q", "regex", r"\d+"), Rule("Q", "term", "(")])
    assert [r.pattern for r in load_rules(table)] == [r"\d+", "("]
    assert len(default_rules()) == 58


def test_marker_characters_in_text_do_not_shift_offsets(spark):
    text = "x stone stone"
    got = matching.match_terms(frame(spark, [text]), [Rule("Q", "term", "stone")]).collect()
    assert sorted(r.start for r in got) == all_starts(text, "stone")


def test_search_and_tag_caps(spark):
    notes = frame(spark, ["tag " * 14] * 60 + ["other"])
    taken = spark.createDataFrame([("n0", 0, 3)], "note_id string, start int, end int")
    got = matching.search_and_tag(notes, taken, "TAG", per_note=10, stop_at=500)
    per = {r.note_id: r["count"] for r in got.groupBy("note_id").count().collect()}
    assert len(per) == 50 and set(per.values()) == {10}
    assert got.where("note_id = 'n0'").agg(F.min("start")).first()[0] == 4
    assert matching.search_and_tag(notes, taken, "TAG").count() == 60 * 14 - 1


def test_self_overlap():
    assert overlaps_itself(" de ") and overlaps_itself("aba") and not overlaps_itself("stone")


def test_matching_never_shuffles(spark):
    plan = matching.auto_tag(matching.match_questions(frame(spark, ["a"]), default_rules()))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_marker_characters_stay(spark):
    notes = frame(spark, ["ab\ue000cd ef"])
    assert [(r.token, r.start) for r in tokens.tokenize_offsets(notes).collect()] == [("ab\ue000cd", 0), ("ef", 6)]
    hits = matching.match_regex(notes, [Rule("Q", "regex", "b.c")]).collect()
    assert [(r.term, r.start, r.end) for r in hits] == [("b\ue000c", 1, 4)]


def test_groups_keep_their_numbers(spark):
    rules = [Rule("Q", "regex", "(foo)bar"), Rule("Q", "regex", r"(x)\1"), Rule("Q", "regex", r"[\b]q")]
    notes = frame(spark, ["xx", "foobar", "xfoo", "none"])
    found = notes.where(matching.question_predicates(rules[:2])["Q"]).count()
    assert found == matching.match_regex(notes, rules[:2]).select("note_id").distinct().count() == 2


def test_word_index_covers_whole_texts(spark):
    notes = frame(spark, ["word " * 200 + "lastword"])
    assert matching.build_word_index(notes).where("word = 'lastword'").count() == 1
    assert matching.build_word_index(notes, head=500).where("word = 'lastword'").count() == 0


def test_a_failing_note_costs_no_other(spark):
    from chartspan.formatting.jobs import format_with_fallback

    def model():
        def score(words):
            if "bad" in words:
                raise RuntimeError("no scores")
            return [[0.0, float(w.endswith(".")), 0.0] if w != "end" else [0.0, 0.0, 1.0] for w in words]
        return score

    notes = frame(spark, ["one. two end three", "bad note", "   "]).selectExpr(
        "note_id", "text", "cast(null as string) type", "cast(null as string) date", "cast(null as string) source", "text raw_text")
    scored = tokens.score_notes(notes, model)
    assert tokens.score_tokens(notes, model).select("note_id").distinct().count() == 1
    got = {r.note_id: r for r in format_with_fallback(notes, "model", tokens.predicted_text(scored)).collect()}
    assert got["n0"].text == "one.\ntwo end\n\nthree" and got["n0"].mode == "model"
    assert got["n1"].mode == "regex" and "no scores" in got["n1"].error and got["n2"].mode == "regex"


def test_breaks_explained_in_the_row(spark):
    """The array form equals the window form, and its plan has no exchange."""
    def model():
        return lambda words: [[(len(w) * (j + 3) + i * (j + 1)) % 11 / 4 for j in range(3)] for i, w in enumerate(words)]

    notes = frame(spark, ["PLAN: rest and fluids . ALLERGIES: none known\n- one\n- two MEDICATIONS: aspirin daily " * 4, "one", "a b"])
    scored = tokens.score_notes(notes, model)
    rows = tokens.explain_notes(scored)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = tokens.explain_breaks(tokens.line_lookahead(tokens.decode_logits(tokens.score_tokens(notes, model))))
    same = ["note_id", "idx", "token", "start", "end", "label_no", "is_line_start", "line_text", "detected", "section",
            "decision", "line_type", "reason"]
    assert sorted(rows.select(same).collect()) == sorted(want.select(same).collect())
    badges = lambda df: sorted(tokens.token_badges(df).collect())
    assert badges(rows) == badges(want)


def _holding(texts, query):
    """Ids of texts with a word of three or more characters, or an id part of two, that contains a word of the query."""
    wanted = matching.query_words(query)
    out = set()
    for note, text in texts.items():
        words = [w for w in re.split(r"[^a-z0-9_]+", note.lower()) if len(w) >= 2]
        words += [w for w in re.split(r"[^a-z0-9_]+", text.lower()) if len(w) >= 3]
        if not wanted or any(q in w for q in wanted for w in words):
            out.add(note)
    return out


def test_stored_index_equals_scan(spark, tmp_path):
    """Random queries over parts, a note indexed anew, and the merged index."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    texts = {f"n{i}": " ".join(word() for _ in range(rng.randint(0, 12))) for i in range(60)}
    path, frame_of = str(tmp_path / "index"), lambda d: spark.createDataFrame(list(d.items()), "note_id string, text string")
    assert wordindex.look_up(spark, path, "abc").count() == 0
    wordindex.add_to_word_index(frame_of(dict(list(texts.items())[:40])), path, buckets=8)
    later = dict(list(texts.items())[40:]) | {"n3": "entirely other words", "n4": ""}
    texts |= later
    wordindex.add_to_word_index(frame_of(later), path)
    wordindex.add_to_word_index(frame_of(later).limit(0), path)
    assert wordindex.index_parts(spark, path) == wordindex.Parts((0, 1), 8)
    notes = frame_of(texts)
    queries = ["ab", "abc", "cab, dd", "abcde", "n1", "x", "", "other", "zzz"] + [word() for _ in range(6)]

    def check(some):
        for q in some:
            got = [r.note_id for r in wordindex.search_stored_index(notes, path, q).collect()]
            assert len(got) == len(set(got)) and set(got) == _holding(texts, q), q

    check(queries)
    wordindex.merge_word_index(spark, path)
    assert wordindex.index_parts(spark, path).numbers == (2,)
    check(queries[:5])
    scan = matching.build_word_index(notes).distinct()
    assert wordindex.stored_postings(spark, path).exceptAll(scan).count() == 0
    assert scan.exceptAll(wordindex.stored_postings(spark, path)).count() == 0


def test_stored_index_reads_needed_buckets(spark, tmp_path):
    """A rare word is found in one bucket of postings; null texts and null ids do not fail."""
    path = str(tmp_path / "index")
    rows = [(f"k{i}", f"common filler{i} words{i % 7}") for i in range(50)] + [("q1", "zebrafish"), ("q2", None), (None, "lost")]
    notes = spark.createDataFrame(rows, "note_id string, text string")
    wordindex.add_to_word_index(notes, path, buckets=16)
    hits = wordindex.look_up(spark, path, "brafi")
    assert [r.note_id for r in hits.collect()] == ["q1"]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[([^\]]*bucket[^\]]*)\]", plan)
    assert len(pruned) >= 2
    files = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{path}/part=0/postings").inputFiles()}
    assert len(files) > 4
    assert [r.note_id for r in wordindex.look_up(spark, path, "q2").collect()] == ["q2"]


def test_token_work_is_linear_and_in_bounded_batches(spark):
    """The model meets a few hundred notes at a time, totals of long arrays hold, sections are summed up without sets."""
    from chartspan.functions.text import running_total
    from chartspan.operators import stats

    got = spark.range(1).select(running_total(F.sequence(F.lit(1), F.lit(40_000))).alias("x")).first().x
    assert got == [i * (i + 1) // 2 for i in range(1, 40_001)]

    def model():
        return lambda words: [[0.0, float(w.endswith(":")), 0.0] for w in words]

    notes = frame(spark, ["Plan: rest ALLERGIES: none", "a b", ""])
    scored = tokens.score_notes(notes, model)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    per_note = stats.token_stats(tokens.explain_notes(scored))
    assert "ObjectHash" not in per_note._jdf.queryExecution().executedPlan().toString()
    assert {r.note_id: r.sections_found for r in per_note.collect()} == {"n0": ["PLAN"], "n1": []}
    rows = tokens.decode_logits(tokens.score_tokens(notes, model))
    assert sorted(tokens.predicted_text(scored).select("note_id", "text").collect()) == sorted(tokens.apply_breaks(rows).collect())


def test_units_end_before_any_letter_beyond_ascii(spark):
    """Word edges and white space of line classes are those of ASCII, as in SQL."""
    from chartspan.operators import lines

    rows = spark.createDataFrame([("n", 0, "10 gâteaux"), ("n", 1, "\x0b2) x"), ("n", 2, "10 grams")], "note_id string, line_no int, line string")
    got = {r.line_no: (r.is_medication, r.is_numbered) for r in lines.classify_lines(rows).collect()}
    assert got == {0: (True, False), 1: (False, False), 2: (False, False)}


def test_scores_are_explained_in_one_pass(spark):
    """The rows of both steps, a note that fails and notes without tokens included, by one Python step."""
    texts = ["HPI: flank pain\nPLAN: drink  water", "", "fail here", "a:b PLAN:: ~ - x y \U0001f600z 1 2 3", None, "ALLERGIES: none " * 40]
    notes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "note_id string, text string")

    def model():
        def score(toks):
            if toks[0] == "fail":
                raise ValueError("no")
            return [[float((len(t) * (j + 2) + i) % 5) for j in range(3)] for i, t in enumerate(toks)]

        return score

    apart = tokens.explain_notes(tokens.score_notes(notes, model))
    at_once = tokens.score_and_explain(notes, model)
    assert at_once.schema == apart.schema
    rows = sorted(map(str, at_once.collect()))
    assert rows == sorted(map(str, apart.collect())) and len(rows) == 96
    assert at_once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
