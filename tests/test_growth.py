"""Plans whose cost goes with the input: what is read once, and what needs no sort."""

import re

from chartspan.operators import spans, tokens

SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_cut_by_every_white_space(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_BYTES", 40)
    texts = ["", None, "  ", "a", " b\u00e9\u200bc  d\x1ce ", f"x{SPACES}y", "\u00fc\u3000\u65e5\u672c \U0001F600z", "\u00c2\x80\u1681 \u2010", "a b " * 30, "end\u2003"]
    texts += [f"p{s}q{s}" for s in SPACES]
    notes = spark.createDataFrame([(f"n{i}", i, t) for i, t in enumerate(texts)], "note_id string, pos int, text string")
    found = tokens.tokenize_offsets(notes, ("note_id", "pos"))
    assert "regexp_replace" not in plan_of(found) and found.columns == ["note_id", "pos", "idx", "token", "start", "end"]
    want = [(f"n{i}", i, k, m[0], m.start(), m.end()) for i, t in enumerate(texts) for k, m in enumerate(re.finditer(f"[^{SPACES}]+", t or ""))]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    scored = tokens.score_tokens(notes, lambda: lambda words: [[float(len(w))] for w in words])
    assert sorted((r.note_id, r.idx, r.token, r.start, r.end) for r in scored.collect()) == sorted((n, k, t, a, b) for n, _, k, t, a, b in want)


def test_runs_are_aggregated_without_a_sort_of_their_own(spark):
    rows = [("n", i, 10 * i, 10 * i + 5, 1 + i % 2, "AB"[i % 2]) for i in range(6)]
    marked = spark.createDataFrame(rows, "note_id string, idx int, start int, end int, label_no int, label string")
    merged = spans.merge_adjacent_spans(spans.chain_merge_spans(marked, collapse_all=False), 30)
    assert "SortAggregate" not in plan_of(merged)
    assert sorted((r.type, r.start, r.end) for r in merged.collect()) == sorted(("AB"[i % 2], 10 * i, 10 * i + 5) for i in range(6))
    assert spans.chain_merge_spans(marked).collect()[0].asDict() == {
        "note_id": "n", "type": "RADIOLOGY", "start": 0, "end": 55, "confidence": 1.0, "mean_prob": 1.0}


def test_sentences_of_any_length(spark):
    long, most = "word " * 400, spans._NEAR
    texts = [f"A. {long}x {long}. B", f"{'y' * 2000} z {'w' * 2000}", f"Q.{'a' * (most - 1)}b c", f"Q.{'a' * most}b c", " " * 900 + "k m"]
    at = [texts[0].index("x"), texts[1].index("z"), texts[2].index("b"), texts[3].index("b"), texts[4].index("m")]
    notes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "note_id string, text string")
    marks = spark.createDataFrame([(f"n{i}", a, a + 1) for i, a in enumerate(at)], "note_id string, start int, end int")
    grown = {r.note_id: r.text for r in spans.expand_to_sentence(marks, notes).collect()}
    assert grown == {"n0": f"{long}x {long}.".strip(), "n1": texts[1], "n2": texts[2], "n3": texts[3], "n4": "k m"}
    worded = {r.note_id: r.text for r in spans.expand_to_word(marks, notes).collect()}
    assert worded == {"n0": "x", "n1": "z", "n2": texts[2][:-2], "n3": texts[3][:-2], "n4": "m"}


def test_radiology_notes_are_told_apart_once(spark):
    notes = spark.createDataFrame([("RAD.1", "One stone. Two", None, None)], "note_id string, text string, type string, raw_text string")
    marked = spark.createDataFrame([("RAD.1", 1, 4, 9, 1, "A")], "note_id string, idx int, start int, end int, label_no int, label string")
    found = spans.extract_radiology_entities(notes, marked)
    assert "rlike" not in plan_of(found).lower() and [r.text for r in found.collect()] == ["One stone."]


def test_segments_read_annotations_once(spark):
    notes = spark.createDataFrame([("n", "abcdef"), ("m", ""), ("o", "xyz")], "note_id string, text string")
    rows = [("b", "n", 1, 3, ["Q2", None], "manual"), ("a", "n", 1, 3, None, "suggested"), ("a", "n", 1, 3, ["Q1"], None),
            ("c", "n", 2, 9, ["Q2"], "manual"), ("d", "n", 4, 4, [], "manual"), (None, "o", -2, 2, ["Q3"], "manual")]
    ann = spark.createDataFrame(rows, "ann_id string, note_id string, start int, end int, questions array<string>, source string")
    found = spans.build_segments(ann, notes)
    assert plan_of(found).split("Initial Plan")[-1].count("ExistingRDD") == 1
    got = [(r.note_id, r.seg_no, r.text, r.kind, r.questions, r.n_annotations, r.annotation_ids, r.is_suggested)
           for r in found.orderBy("note_id", "seg_no").collect()]
    assert got == [
        ("m", 0, "", "plain", [], 0, [], False),
        ("n", 0, "a", "plain", [], 0, [], False),
        ("n", 1, "b", "highlight", ["Q1", "Q2"], 2, ["a", "a", "b"], True),
        ("n", 2, "c", "highlight", ["Q1", "Q2"], 3, ["a", "a", "b", "c"], True),
        ("n", 3, "d", "highlight", ["Q2"], 1, ["c"], False),
        ("n", 4, "ef", "highlight", ["Q2"], 1, ["c"], False),
        ("o", 0, "xy", "highlight", ["Q3"], 0, [None], False),
        ("o", 1, "z", "plain", [], 0, [], False)]
