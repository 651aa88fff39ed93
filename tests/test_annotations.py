"""Edits, change log, statistics and note sets on small tables."""

from pyspark.sql import functions as F

from chartspan.operators import annotations as ann
from chartspan.operators import changes, filters, ordering, stats
from chartspan.operators.rules import questions_table
from chartspan.sources import sinks

ANN = ("ann_id string, note_id string, start int, end int, text string, questions array<string>, "
       "comment string, created_at timestamp, source string")


def table(spark, *rows):
    full = [(i, n, s, e, t, q, c, None, src) for i, n, s, e, t, q, c, src in rows]
    return spark.createDataFrame(full, ANN)


def ids(df):
    return sorted(r.ann_id for r in df.collect())


def test_add_assigns_ids_and_source(spark):
    base = table(spark)
    new = spark.createDataFrame(
        [("n1", 0, 5, "hello", ["Q1"])], "note_id string, start int, end int, text string, questions array<string>")
    one = ann.add_annotations(base, new).collect()
    again = ann.add_annotations(base, new).collect()
    assert one[0].source == "manual" and one[0].ann_id == again[0].ann_id and one[0].created_at is not None
    assert ann.add_suggested_annotations(base, new).first().source == "suggested"


def test_remove_clear_and_promote(spark):
    t = table(spark, ("m", "n3", 0, 1, "a", ["Q1"], None, "manual"), ("s", "n3", 1, 2, "b", ["Q1"], " x ", "suggested"),
              ("o", "n4", 1, 2, "b", ["Q2"], "", None))
    assert ids(ann.clear_suggested(t)) == ["m", "o"]
    assert ids(ann.remove_annotations(t, t.where("ann_id = 'm'"))) == ["o", "s"]
    assert ids(ann.clear_note_annotations(t, t.where("note_id = 'n3'"))) == ["o"]
    assert ann.clear_all(t).count() == 0
    assert ids(ann.filter_ann_source(t, "manual")) == ["m", "o"]
    assert ids(ann.filter_ann_comment(t, "with")) == ["s"]
    assert ids(ann.filter_ann_source(ann.promote_annotations(t, t.where("ann_id = 's'")), "auto")) == []


def test_last_question_stays(spark):
    t = table(spark, ("a", "n", 0, 1, "x", ["Q1"], None, "manual"), ("b", "n", 0, 1, "x", ["Q1", "Q2"], None, "manual"))
    got = {r.ann_id: r.questions for r in ann.remove_question_from_ann(t, "Q1").collect()}
    assert got == {"a": ["Q1"], "b": ["Q2"]}
    got = {r.ann_id: r.questions for r in ann.add_question_to_ann(t, "Q2").collect()}
    assert got == {"a": ["Q1", "Q2"], "b": ["Q1", "Q2"]}


def test_resize_stays_inside_the_note(spark):
    notes = spark.createDataFrame([("n", "abcdef")], "note_id string, text string")
    t = table(spark, ("a", "n", 1, 2, "b", ["Q1"], None, "manual"), ("b", "n", 2, 3, "c", ["Q1"], None, "manual"))
    spans = spark.createDataFrame([("a", -4, 99), ("b", 5, 2)], "ann_id string, start int, end int")
    got = {r.ann_id: (r.start, r.end, r.text) for r in ann.resize_annotations(t, notes, spans).collect()}
    assert got == {"a": (0, 6, "abcdef"), "b": (5, 6, "f")}


def log(spark, *rows):
    return spark.createDataFrame(
        [(s, op, i, (v,)) for s, op, i, v in rows], "seq long, op string, ann_id string, after struct<v:string>")


def test_fold_and_rollback(spark):
    c = log(spark, (1, "add", "a", "1"), (2, "add", "b", "1"), (3, "update", "a", "2"), (4, "remove", "b", None))
    state = lambda df: {r.ann_id: r.after.v for r in df.collect()}
    assert state(changes.fold_changes(c)) == {"a": "2"}
    assert state(changes.rollback_changes(c, 1)) == {"a": "2", "b": "1"}
    assert state(changes.rollback_changes(c, 2)) == {"a": "1", "b": "1"}
    assert state(changes.rollback_changes(c, 4)) == {}
    many = log(spark, *[(i, "add", f"x{i}", "1") for i in range(30)])
    assert changes.rollback_changes(many, 25).count() == 5 and changes.rollback_changes(many, 99).count() == 0


def test_counts(spark):
    t = table(spark, ("a", "n1", 0, 1, "x", ["Q1", "QX"], "c", "manual"), ("b", "gone", 0, 1, "x", ["Q1"], " ", "suggested"))
    notes = spark.createDataFrame([("n1", "T"), ("n2", None), ("n3", "")], "note_id string, type string")
    counts = {r.question_id: r.n for r in stats.count_by_question(t, questions_table(spark)).collect()}
    assert counts["Q1"] == 2 and counts["QX"] == 1 and counts["Q2"] == 0 and len(counts) == 11
    row = stats.export_stats(notes, t, questions_table(spark)).first()
    assert (row.total_notes, row.annotated_notes, row.manual, row.suggested) == (3, 2, 1, 1)
    assert row.by_question["Q1"] == 2 and row.by_question["Q10"] == 0
    assert stats.annotated_note_count(notes, t).first()[0] == 1
    assert [(r.type, r.n) for r in stats.count_by_type(notes).collect()] == [("T", 1)]
    assert ids(ann.orphan_annotations(t, notes)) == ["b"]
    added = ann.complete_questions(questions_table(spark), t).where("question_id = 'QX'").first()
    assert (added.name, added.color, added.hint) == ("QX", "#78716c", "Imported from session")


def test_csv_rows(spark):
    notes = spark.createDataFrame([("n", "line one\nsays \"hi\", then", None)], "note_id string, text string, type string")
    t = table(spark, ("a", "n", 5, 13, "one\nsays", ["Q1", "Q2"], 'a "b", c', None), ("z", "gone", 0, 1, "x", ["Q1"], None, "manual"))
    t = t.withColumn("created_at", F.timestamp_millis(F.lit(1700000000123)))
    [r] = sinks.export_csv_rows(notes, t).collect()
    assert r.text == "one says" and r.questions == "Q1;Q2" and r.source == "manual" and r.note_type == ""
    assert r.created_at == "2023-11-14T22:13:20.123Z" and r.context_before == "line " and r.context_after == ' "hi", then'


def test_note_sets_and_next(spark):
    notes = spark.createDataFrame([(f"n{i}", i) for i in range(6)], "note_id string, pos long")
    t = spark.createDataFrame([("n0",), ("n2",), ("n3",)], "note_id string")
    assert {r.note_id: r.next_pos for r in ordering.next_unannotated(notes, t).collect()} == {
        "n0": 1, "n1": 4, "n2": 4, "n3": 4, "n4": 5, "n5": None}
    assert filters.filter_note_status(notes, t, "done").count() == 3
    assert filters.filter_note_status(notes, t, "todo").count() == 3
    same = notes.withColumn("note_id", F.lit("x"))
    assert sorted(r.note_id for r in ordering.dedupe_note_ids(same).collect()) == ["x", "x_2", "x_3", "x_4", "x_5", "x_6"]
    batches = ordering.assign_batches(notes, size=4).orderBy("pos").collect()
    assert [(r.rn, r.batch) for r in batches] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2)]


def test_null_orders_are_numbered(spark):
    from chartspan.operators.ordering import assign_batches, next_unannotated

    notes = spark.createDataFrame([("a", 1), ("b", None), ("c", 2)], "note_id string, pos int")
    assert {r.note_id: r.rn for r in assign_batches(notes).collect()} == {"b": 1, "a": 2, "c": 3}
    assert next_unannotated(notes, spark.createDataFrame([], "note_id string")).count() == 3


def test_prefix_scan_of_sparse_orders(spark):
    """Orders that are far apart and uneven: numbers and next notes as in a plain loop, and no window without a key."""
    import random

    from chartspan.operators.ordering import assign_batches, next_unannotated

    rng = random.Random(4)
    places = sorted(rng.sample(range(-10**15, 10**15), 300) + list(range(200)))
    notes = spark.createDataFrame([(f"n{i}", p) for i, p in enumerate(places)], "note_id string, pos long").repartition(5)
    done = {i for i in range(500) if rng.random() < .7 or i > 480}
    tagged = spark.createDataFrame([(f"n{i}",) for i in done] * 2, "note_id string")
    batches = assign_batches(notes, size=7)
    assert {r.note_id: (r.rn, r.batch) for r in batches.collect()} == {f"n{i}": (i + 1, i // 7 + 1) for i in range(500)}
    following = next_unannotated(notes, tagged)
    want = {f"n{i}": next((places[k] for k in range(i + 1, 500) if k not in done), None) for i in range(500)}
    assert {r.note_id: r.next_pos for r in following.collect()} == want
    for frame in (batches, following):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    none = notes.limit(0)
    assert assign_batches(none).count() == 0 and next_unannotated(none, tagged).count() == 0


def test_neighbours_of_many_copies(spark, monkeypatch):
    """Copies of a start fill several bins; the exchange is of bins' borders."""
    from chartspan.operators import ordering

    monkeypatch.setattr(ordering, "BIN_ROWS", 8)
    rows = [(f"a{i}", "n", 5 if i % 3 else i % 7, i) for i in range(100)] + [("b", "m", 1, 3)]
    ann = spark.createDataFrame(rows, "ann_id string, note_id string, start int, seq long")
    order = sorted((r for r in rows if r[1] == "n"), key=lambda r: (r[2], r[3]))
    got = {r.ann_id: (r.prev_id, r.next_id, r.prev_distance, r.next_distance) for r in ordering.neighbour_annotations(ann).collect()}
    for i, r in enumerate(order):
        before, after = order[i - 1], order[(i + 1) % len(order)]
        assert got[r[0]] == (before[0], after[0], r[2] - before[2], after[2] - r[2])
    assert got["b"] == ("b", "b", 0, 0)
    plan = ordering.neighbour_annotations(ann)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
