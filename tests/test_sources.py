"""Readers, session bundles and streams on a small folder tree."""

import json

import pytest
from pyspark.sql import functions as F

from chartspan.operators.changes import fold_changes
from chartspan.operators.rules import Rule, questions_table
from chartspan.plans.flows import import_notes, tag_notes
from chartspan.sources import readers, sinks
from chartspan.streaming import streams


@pytest.fixture()
def tree(tmp_path):
    def put(path, text):
        target = tmp_path / "in" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf8")

    put("ED/n 1.txt", "first note")
    put("RAD/a+b%20c.txt", "second\nnote")
    put("RAD/list.json", json.dumps([{"id": "j1", "text": "one", "note_type": "T"}, {"note_id": "j2", "text": "two"}]))
    put("RAD/wrapped.json", json.dumps({"notes": [{"id": "", "text": "three", "meta": {"type": "M", "date": "2024"}, "note_type": "X"}]}))
    put("ED/lines.jsonl", '{"id": "l1", "text": "four"}\n\n{"id": 7, "text": "five"}\n')
    put("ED/broken.json", '[{"id": "x", "text": "lost"')
    put("ED/broken.jsonl", '{"id": "y", "text": "lost"}\n{"id":')
    put("ED/other.json", '{"something": 1}')
    put("ED/readme.md", "ignored")
    return str(tmp_path / "in")


def test_mixed_folder(spark, tree):
    notes, errors = readers.read_notes_dir(spark, tree)
    got = {r.note_id: r for r in notes.collect()}
    made = [k for k in got if k.startswith("note_")]
    assert set(got) - set(made) == {"n 1", "a+b%20c", "j1", "j2", "l1", "7", "y"} and len(made) == 1
    assert (got["n 1"].type, got["n 1"].source, got["a+b%20c"].type) == ("ED", "n 1.txt", "RAD")
    assert (got["j1"].type, got["j2"].type, got["l1"].type) == ("T", "RAD", "ED")
    assert (got[made[0]].type, got[made[0]].date, got[made[0]].raw_text) == ("M", "2024", "three")
    assert sorted(r.file.rsplit("/", 1)[1] for r in errors.collect()) == ["broken.json", "broken.jsonl", "other.json"]


def test_import_flow(spark, tree, tmp_path):
    row = import_notes(spark, tree, str(tmp_path / "out")).first()
    assert (row.processed, row.failed, row.total) == (8, 3, 11)
    summary = sinks.write_formatted_corpus(spark, tree, str(tmp_path / "formatted"), limit=1).first()
    assert (summary.processed, summary.failed) == (1, 0)
    again = sinks.write_formatted_corpus(spark, "file://" + tree, str(tmp_path / "formatted"), limit=1).first()
    assert again.total == 1
    back = spark.read.parquet(str(tmp_path / "formatted")).first()
    assert back.path == "ED/n 1.txt" and back.folder == "ED" and back.text == "first note"


def session(spark):
    notes = spark.createDataFrame(
        [("n1", "a😀b stone", "T", "d", "s", "raw"), ("n2", "plain", None, None, None, "plain")],
        "note_id string, text string, type string, date string, source string, raw_text string")
    annotations = spark.createDataFrame(
        [("a1", "n1", 4, 9, "stone", ["Q1", "QX"], None, "manual"), ("a2", "n2", 0, 5, "plain", ["Q2"], "c", "suggested")],
        "ann_id string, note_id string, start int, end int, text string, questions array<string>, comment string, source string"
    ).withColumn("created_at", F.timestamp_millis(F.lit(1700000000123)))
    return notes, annotations


def plain(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def test_session_tables_come_back(spark, tmp_path):
    notes, annotations = session(spark)
    sinks.write_session(notes, annotations, questions_table(spark), str(tmp_path / "s"))
    n, a, q = readers.read_session(spark, str(tmp_path / "s"))
    assert plain(n) == plain(notes) and plain(a) == plain(annotations)
    assert q.count() == 11


def test_session_document(spark, tmp_path):
    notes, annotations = session(spark)
    sinks.write_session(notes, annotations, questions_table(spark), str(tmp_path / "s"), bundle=True)
    document = tmp_path / "one.json"
    body = json.loads(next((tmp_path / "s").glob("part-*.json")).read_text())
    assert body["version"] == "1.0" and len(body["notes"]) == 2
    # bundles count UTF-16 units: the emoji is two
    one = next(x for x in body["annotations"] if x["id"] == "a1")
    assert (one["start"], one["end"]) == (5, 10)
    document.write_text(json.dumps(body, indent=1))
    n, a, q = readers.read_session(spark, str(document))
    assert plain(n) == plain(notes) and plain(a) == plain(annotations) and q.count() == 11
    del body["version"]
    document.write_text(json.dumps(body))
    assert readers.read_session(spark, str(document))[2] is None
    document.write_text('{"notes": []}')
    with pytest.raises(ValueError):
        readers.read_session(spark, str(document))


def test_session_parts_come_back(spark, tmp_path):
    """Ranges of note ids as JSON parts, wide characters included; nothing goes through one task."""
    notes, annotations = session(spark)
    more = spark.range(40).select(F.format_string("n%03d", "id").alias("id"))
    first = notes.limit(1).drop("note_id")
    many = notes.unionByName(more.crossJoin(first).withColumnRenamed("id", "note_id").select(*notes.columns))
    path = str(tmp_path / "s")
    sinks.write_session(many, annotations, questions_table(spark), path, parts=9)
    manifest = [r for r in spark.read.json(f"{path}/parts/manifest").orderBy("first").collect()]
    assert len(manifest) >= 8 and sum(r["notes"] for r in manifest) == 42
    assert all(a["last"] < b["first"] for a, b in zip(manifest, manifest[1:]))
    n, a, q = readers.read_session(spark, path)
    assert plain(n) == plain(many) and plain(a) == plain(annotations) and q.count() == 11
    sinks.write_session(notes.limit(0), annotations.limit(0), questions_table(spark), path, parts=9)
    n, a, q = readers.read_session(spark, path)
    # no annotation adds its own question
    assert (n.count(), a.count(), q.count()) == (0, 0, 10)


def test_streams_equal_batch(spark, tree, tmp_path):
    rules = [Rule("Q1", "term", "not")]
    batch = plain(tag_notes(readers.read_txt_notes(spark, tree), rules, ["Q1"]))
    tagged = streams.stream_auto_tag(streams.stream_notes(spark, tree, files_per_batch=1), rules)
    tagged.writeStream.format("parquet").option("path", str(tmp_path / "t")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert plain(spark.read.parquet(str(tmp_path / "t"))) == batch and len(batch) == 2


def test_annotation_state_over_batches(spark, tmp_path):
    rows = [(i, ["add", "update", "remove"][i % 3], f"a{i % 7}", (str(i),)) for i in range(40)]
    schema = "seq long, op string, ann_id string, after struct<v:string>"
    for part, chunk in enumerate((rows[20:], rows[:10], rows[10:20])):  # newest first
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    for _ in range(2):  # a second run finds nothing new
        streams.stream_annotation_state(arriving, str(tmp_path / "state"), str(tmp_path / "mark")).awaitTermination()
    assert streams.read_annotation_state(spark, str(tmp_path / "none")).count() == 0
    state = {(r.ann_id, r.seq) for r in streams.read_annotation_state(spark, str(tmp_path / "state")).collect()}
    assert state == {(r.ann_id, r.seq) for r in fold_changes(log).collect()}


def test_annotation_state_snapshots(spark, tmp_path):
    """Any snapshot distance gives the fold of the log; a read meets one snapshot and the parts after it."""
    rows = [(i, ["add", "update", "remove"][i % 3], f"a{i % 11}", (str(i),)) for i in range(56)]
    schema = "seq long, op string, ann_id string, after struct<v:string>"
    for chunk in range(7):  # an id's changes come late and out of order
        spark.createDataFrame(rows[(6 - chunk)::7], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    want = {(r.ann_id, r.seq) for r in fold_changes(log).collect()}
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    path = str(tmp_path / "state")
    streams.stream_annotation_state(arriving, path, str(tmp_path / "mark"), snapshot_every=3).awaitTermination()
    now = streams.read_annotation_state(spark, path)
    assert {(r.ann_id, r.seq) for r in now.collect()} == want
    assert {f.split("state/")[1].rsplit("/", 1)[0] for f in now.inputFiles()} == {"snapshots/upto=5", "parts/batch=6"}
    (tmp_path / "state" / "snapshots" / "upto=5" / "_SUCCESS").unlink()  # as if its writer had been lost
    assert {(r.ann_id, r.seq) for r in streams.read_annotation_state(spark, path).collect()} == want
    streams.compact_annotation_state(spark, path)
    last = streams.read_annotation_state(spark, path)
    assert {(r.ann_id, r.seq) for r in last.collect()} == want and all("upto=6" in f for f in last.inputFiles())


def test_batches_of_files_are_bounded(spark, tree, tmp_path, monkeypatch):
    """Without a number of files a batch is bounded too, and every file is read."""
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 1)
    out = str(tmp_path / "notes")
    run = streams.stream_notes(spark, tree).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [p.numInputRows for p in run.recentProgress if p.numInputRows] == [1, 1]
    assert {r.note_id for r in spark.read.parquet(out).collect()} == {"n 1", "a+b%20c"}


def test_small_files_are_read_as_bytes_and_formatted_by_few_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / "ED").mkdir(parents=True)
    for i in range(20):
        (tmp_path / "in" / "ED" / f"n{i}.txt").write_bytes(f"note {i}\r\n".encode())
    monkeypatch.setattr(sinks, "TASKS_PER_CORE", 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        files = readers.whole_files(spark, str(tmp_path / "in"), ".txt")
        # the reader of whole texts copies the job's settings for each file
        assert "content" in files._jdf.queryExecution().optimizedPlan().toString()
        got = {r.note_id: r.text for r in readers.read_txt_notes(spark, str(tmp_path / "in")).collect()}
        assert len(got) == 20 and got["n7"] == "note 7\r\n"
        summary = sinks.write_formatted_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (summary.processed, summary.failed, summary.total) == (20, 0, 20)
    assert len(list((tmp_path / "out" / "folder=ED").glob("*.parquet"))) <= spark.sparkContext.defaultParallelism


def test_empty_files_are_notes(spark, tmp_path):
    """Spark's listing drops empty files; a note without text is a note all the same."""
    for path, text in (("ED/a+b %20.txt", ""), ("ED/n2.txt", "two"), ("RAD/n3.txt", ""), ("RAD/cut.json", ""), ("RAD/readme.md", "")):
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    tree = str(tmp_path / "in")
    got = {(r.note_id, r.text, r.type, r.source, r.raw_text) for r in readers.read_txt_notes(spark, tree).collect()}
    assert got == {("a+b %20", "", "ED", "a+b %20.txt", ""), ("n2", "two", "ED", "n2.txt", "two"), ("n3", "", "RAD", "n3.txt", "")}
    notes, errors = readers.read_notes_dir(spark, tree)
    assert notes.count() == 3 and [r.file.rsplit("/", 1)[1] for r in errors.collect()] == ["cut.json"]
    summary = sinks.write_formatted_corpus(spark, tree, str(tmp_path / "out")).first()
    assert (summary.processed, summary.failed, summary.total) == (3, 0, 3)


def test_files_of_the_queries_are_whole(spark, tmp_path):
    """A task that fails leaves no part of a text, and a folder may be named with its scheme."""
    from checks.source_checks import write_files

    base = str(tmp_path / "txt")
    rows = spark.createDataFrame([("en/1 n+1.txt", "one"), ("en/2 n+1.txt", None)], "path string, content string")
    with pytest.raises(Exception):
        write_files(rows.coalesce(1), base)
    assert [p.name for p in (tmp_path / "txt" / "en").glob("*.txt")] == ["1 n+1.txt"]
    named = write_files(rows.where("content is not null"), f"file://{tmp_path}/named")
    assert [r.note_id for r in readers.read_txt_notes(spark, named).collect()] == ["1 n+1"]


def test_batches_take_one_job_and_the_log_is_rewritten_seldom(spark, tmp_path):
    (tmp_path / "in" / "ED").mkdir(parents=True)
    for i in range(44):
        (tmp_path / "in" / "ED" / f"n{i}.txt").write_text(f"note {i}")

    def drained(files_per_batch):
        label = f"{tmp_path}/{files_per_batch}"
        run = streams.stream_notes(spark, str(tmp_path / "in"), files_per_batch).writeStream.format("parquet").option(
            "path", f"{label}/out").option("checkpointLocation", f"{label}/mark").trigger(availableNow=True).start()
        run.awaitTermination()
        assert {r.text for r in spark.read.parquet(f"{label}/out").collect()} == {f"note {i}" for i in range(44)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(run.runId))), label

    # 40 files and 4: no job of its own to look at the files of a batch
    assert drained(40)[0] == 2
    jobs, label = drained(4)
    assert jobs == 11
    assert not [p.name for p in (tmp_path / "4" / "mark" / "sources" / "0").iterdir() if p.name.endswith(".compact")]
