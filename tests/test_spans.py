"""Span algebra against brute force, with one note holding most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from chartspan.operators import ordering, spans, stats
from chartspan.plans.scale import rank_in_bins

ANN = "ann_id string, note_id string, start int, end int, questions array<string>, source string, seq long"
NOTE = "note_id string, text string"


def skewed(spark, n=300, size=2500, seed=3):
    """A third or more of the annotations on one note, many of them copies of one span."""
    rng = random.Random(seed)
    texts = {f"n{i}": "".join(rng.choice("abc .\n") for _ in range(size)) for i in range(4)}
    texts["empty"] = ""
    rows = []
    for i in range(n):
        note = "n0" if i % 2 else f"n{rng.randint(0, 3)}"
        start = 600 if i % 5 == 0 else rng.randint(0, size - 60)
        end = start + (20 if i % 5 == 0 else rng.randint(1, 60))
        rows.append((f"a{i:04d}", note, start, end, rng.sample(["Q1", "Q2", "Q3"], rng.randint(1, 2)),
                     rng.choice(["manual", "suggested"]), i))
    return texts, rows, spark.createDataFrame(rows, ANN), spark.createDataFrame(list(texts.items()), NOTE)


@pytest.fixture(scope="module")
def data(spark):
    return skewed(spark)


def test_overlaps(spark, data):
    _, rows, ann, _ = data
    new = ann.where("seq % 3 = 0").select(F.col("ann_id").alias("span_id"), "note_id", "start", "end")
    got = {(r.span_id, r.ann_id) for r in spans.find_overlaps(new, ann).collect()}
    want = {(x[0], y[0]) for x in rows if x[6] % 3 == 0 for y in rows
            if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    assert got == want and len(got) == spans.find_overlaps(new, ann).count()


def test_segments_cover_the_text(spark, data):
    texts, rows, ann, notes = data
    got = spans.build_segments(ann, notes).orderBy("note_id", "seg_no").collect()
    joined = {}
    for r in got:
        joined[r.note_id] = joined.get(r.note_id, "") + r.text
        cover = sorted((y for y in rows if y[1] == r.note_id and y[2] <= r.start and y[3] >= r.end and r.end > r.start),
                       key=lambda y: (y[2], y[3], y[0]))
        assert r.annotation_ids == [y[0] for y in cover]
        assert r.questions == sorted({q for y in cover for q in y[4]})
        assert r.n_annotations == len(cover) and r.kind == ("highlight" if cover else "plain")
        assert r.is_suggested == any(y[5] == "suggested" for y in cover)
    assert joined == texts


def test_segments_list_all_ids_and_keep_exact_counts(spark, data):
    _, _, ann, notes = data
    full = {(r.note_id, r.seg_no): r.n_annotations for r in spans.build_segments(ann, notes).collect()}
    long = spans.segment_annotations(ann).groupBy("note_id", "seg_no").count().collect()
    assert {(r.note_id, r.seg_no): r["count"] for r in long} == {k: v for k, v in full.items() if v}


def test_coalesce_is_the_closure_and_idempotent(spark, data):
    texts, rows, ann, notes = data
    want = {}
    for note in texts:
        merged = []
        for s, e in sorted((y[2], y[3]) for y in rows if y[1] == note):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want[note] = [tuple(m) for m in merged]
    once = spans.coalesce_annotations(ann, notes)
    got = once.collect()
    for note in texts:
        assert sorted((r.start, r.end) for r in got if r.note_id == note) == want[note]
    assert all(r.text == texts[r.note_id][r.start:r.end] for r in got)
    again = spans.coalesce_annotations(once.withColumn("source", F.lit("manual"))).collect()
    assert {(r.note_id, r.start, r.end) for r in again} == {(r.note_id, r.start, r.end) for r in got}


def test_resolve_policies(spark):
    notes = spark.createDataFrame([("n", "abcdefghijklmnop")], NOTE)
    ann = spark.createDataFrame([
        ("late", "n", 2, 6, ["Q1"], "manual", 9), ("early", "n", 4, 8, ["Q2"], "manual", 1), ("touch", "n", 10, 12, ["Q3"], "manual", 2)], ANN)
    new = spark.createDataFrame(
        [("s1", "n", 5, 7, "Q2"), ("s2", "n", 8, 10, "Q9"), ("s3", "n", 14, 16, "Q9")],
        "span_id string, note_id string, start int, end int, question_id string")
    merged = {r.span_id: r for r in spans.overlap_resolve(new, ann, notes, "merge").collect()}
    assert (merged["s1"].ann_id, merged["s1"].text, merged["s1"].questions) == ("early", "efgh", ["Q2"])
    assert (merged["s2"].ann_id, merged["s2"].is_adjacent, merged["s2"].questions) == ("early", True, ["Q2", "Q9"])
    assert (merged["s3"].ann_id, merged["s3"].action) == (None, "create")
    kept = spans.overlap_resolve(new, ann, notes, "keep_both").collect()
    assert all(r.ann_id is None for r in kept) and len(kept) == 3
    assert [r.span_id for r in spans.overlap_resolve(new, ann, notes, "cancel").collect()] == ["s3"]
    grown = {r.span_id: r.questions for r in spans.overlap_extend(new, ann, notes).collect()}
    assert grown == {"s1": ["Q2"], "s2": ["Q2"]}


def test_outcomes_equal_brute_force(spark, data):
    """Every policy from one pass over candidates, with many copies of one span and spans at bin edges."""
    texts, rows, ann, notes = data
    rng = random.Random(8)
    new_rows = [(f"s{i}", f"n{i % 4}", s, s + rng.choice([0, 1, 5, 700]), rng.choice(["Q1", "Q9"]))
                for i, s in enumerate([511, 512, 513, 600, 620, 580, 1024] + [rng.randint(0, 1700) for _ in range(60)])]
    new_rows.append(("alone", "empty", 0, 0, "Q9"))
    new = spark.createDataFrame(new_rows, "span_id string, note_id string, start int, end int, question_id string")
    want = set()
    for sid, note, s, e, q in new_rows:
        near = [a for a in rows if a[1] == note]
        over = [a for a in near if s < a[3] and e > a[2]]
        touch = [a for a in near if s == a[3] or e == a[2]]
        best = min(over or touch, key=lambda a: a[6], default=None)
        adjacent = best is not None and not over
        alone = (sid, None, s, e, (q,), "create", adjacent)
        if best is None:
            want |= {(p, *alone) for p in spans.POLICIES}
            continue
        lo, hi, old = min(s, best[2]), max(e, best[3]), tuple(best[4])
        want.add(("extend", sid, best[0], lo, hi, old, "update", adjacent))
        want.add(("merge", sid, best[0], lo, hi, old if q in old else (*old, q), "update", adjacent))
        want.add(("keep_both", *alone))
    out = spans.overlap_outcomes(new, ann, notes, tuple(spans.POLICIES))
    got = out.collect()
    assert {(r.policy, r.span_id, r.ann_id, r.start, r.end, tuple(r.questions), r.action, r.is_adjacent) for r in got} == want
    assert len(got) == len(want) and all(r.text == texts[r.note_id][r.start:r.end] for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") <= 6


def tokens(spark, labels):
    rows = [("n", i, 4 * i, 4 * i + 3, x, ["O", "SIZE", "LOC"][x]) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "note_id string, idx int, start int, end int, label_no int, label string")


@pytest.mark.parametrize("gap, n", [(6, 1), (7, 2)])
def test_chain_gap(spark, gap, n):
    assert spans.chain_merge_spans(tokens(spark, [1] + [0] * gap + [2])).count() == n


def test_chain_of_types(spark):
    got = spans.chain_merge_spans(tokens(spark, [1, 0, 1, 2, 1]), collapse_all=False).orderBy("start").collect()
    assert [(r.type, r.start, r.end) for r in got] == [("SIZE", 0, 11), ("LOC", 12, 15), ("SIZE", 16, 19)]


@pytest.mark.parametrize("distance, n", [(120, 1), (121, 2)])
def test_merge_gap(spark, distance, n):
    df = spark.createDataFrame([("n", "R", 0, 10), ("n", "R", 10 + distance, 200)], "note_id string, type string, start int, end int")
    assert spans.merge_adjacent_spans(df, 120).count() == n


def test_nested_span_does_not_shrink(spark):
    df = spark.createDataFrame([("n", "R", 0, 50), ("n", "R", 10, 20)], "note_id string, type string, start int, end int")
    assert [(r.start, r.end) for r in spans.merge_adjacent_spans(df, 0).collect()] == [(0, 50)]


def test_growth(spark):
    text = "One two. Three four five\nsix seven! eight"
    notes = spark.createDataFrame([("n", text)], NOTE)
    at = text.index("our")
    df = spark.createDataFrame([("n", at, at + 2)], "note_id string, start int, end int")
    assert spans.expand_to_word(df, notes).first().text == "four"
    # the line feed that closes the line is taken in, and the word that starts there is completed
    assert spans.expand_to_sentence(df, notes).first().text == "Three four five\nsix"
    two = text.index("two")
    end = spark.createDataFrame([("n", two, two + 1)], "note_id string, start int, end int")
    assert spans.expand_to_sentence(end, notes).first().text == "One two."


def test_sections_of_annotations(spark):
    ann = spark.createDataFrame([("a", "n", 0), ("b", "n", 5), ("c", "n", 9), ("d", "m", 3)], "ann_id string, note_id string, start int")
    badges = spark.createDataFrame([("n", 5, "HPI"), ("n", 8, "PLAN")], "note_id string, pos int, section string")
    got = {r.ann_id: r.section for r in spans.annotations_in_sections(ann, badges).collect()}
    assert got == {"a": "NONE", "b": "HPI", "c": "PLAN", "d": "NONE"}


def test_rank_of_a_hot_key_equals_row_number(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{rng.randint(0, 5)}", rng.randint(0, 4), i) for i in rng.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "k string, p int, seq long")
    got = {r.seq: r.rn for r in rank_in_bins(df, ["k"], "seq", "rn", position="p", bin_rows=64).collect()}
    want, seen = {}, {}
    for k, p, seq in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[seq] = seen[k]
    assert got == want


def test_neighbours_wrap_and_lists_are_chunked(spark, data):
    _, rows, ann, _ = data
    by_note = {}
    for y in sorted(rows, key=lambda y: (y[2], y[6])):
        by_note.setdefault(y[1], []).append(y)
    got = {r.ann_id: r for r in ordering.neighbour_annotations(ann).collect()}
    for group in by_note.values():
        for i, y in enumerate(group):
            r = got[y[0]]
            assert (r.prev_id, r.next_id) == (group[i - 1][0], group[(i + 1) % len(group)][0])
    lists = stats.annotation_index_by_note(ann, 10).orderBy("note_id", "chunk_no").collect()
    flat = {}
    for r in lists:
        assert len(r.annotations) <= 10
        flat.setdefault(r.note_id, []).extend(a.ann_id for a in r.annotations)
    assert flat == {k: [y[0] for y in v] for k, v in by_note.items()}


def test_segment_with_very_many_annotations(spark):
    notes = spark.createDataFrame([("n", "abcdef")], "note_id string, text string")
    ann = spark.range(10_001).select(
        F.concat(F.lit("a"), "id").alias("ann_id"), F.lit("n").alias("note_id"), F.lit(1).alias("start"), F.lit(3).alias("end"),
        F.array(F.lit("Q1")).alias("questions"), F.lit("manual").alias("source"))
    rows = {r.start: r for r in spans.build_segments(ann, notes).collect()}
    assert len(rows[1].annotation_ids) == rows[1].n_annotations == 10_001 and rows[0].annotation_ids == rows[3].annotation_ids == []
