"""Streams give what the batch gives; readers and writers round-trip."""

import datetime as dt

from pyspark.sql import functions as F

from textloom.operators import runs
from textloom.plans.catalog import _drained
from textloom.sources import files
from textloom.streaming import runs as streams

RUN = "seq long, command_key string, grp string, skeleton_id string, before_tokens long, after_tokens long, context_type string, warnings array<string>"


def run_files(spark, path):
    data = [(i, "chatOptimize" if i % 3 else "reviewDiff", "prompt" if i % 3 else "selection", f"psk_{i % 2}" if i % 3 else None, 10 + i, 5, "diff", ["Volatile context detected (x)."] if i % 4 == 0 else []) for i in range(20)]
    d = spark.createDataFrame(data, RUN)
    d.repartition(3).write.parquet(path)
    return d


def test_stats_stream_equals_batch(spark, tmp_path):
    d = run_files(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _drained(spark, streams.stats(stream), "complete").collect()
    assert got == d.agg(*runs.run_counters()).collect()


def test_nudges_stream_equals_batch(spark, tmp_path):
    d = run_files(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = _drained(spark, streams.nudges(stream), "append")
    assert sorted(map(tuple, got.select("skeleton_id", "running").collect())) == sorted(map(tuple, runs.nudges(d).select("skeleton_id", "running").collect()))


def test_debounce(spark):
    t = dt.datetime(2024, 1, 1)
    data = [("w", t, "a"), ("w", t + dt.timedelta(milliseconds=200), "b"), ("w", t + dt.timedelta(milliseconds=600), "c")]
    got = streams.debounce(spark.createDataFrame(data, "workspace string, ts timestamp, path string")).orderBy("first_save").collect()
    assert [(r.path, r.saves) for r in got] == [("b", 2), ("c", 1)]


def test_reset(spark):
    d = spark.createDataFrame([("run", 1), ("reset", 2), ("run", 3)], "event_type string, ts long")
    assert runs.since_reset(d).count() == 1 and runs.since_reset(d.where("event_type = 'run'")).count() == 2


def test_chunks(spark):
    d = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b")], "id long, seq int, chunk string")
    assert streams.joined_chunks(d).first().text == "abc"


def test_files(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.md").write_text("one\ntwo")
    (tmp_path / "d/sub/b.md").write_text("x")
    (tmp_path / "d/c.txt").write_text("skip")
    got = files.read_markdown(spark, str(tmp_path / "d")).collect()
    assert sorted(r.text for r in got) == ["one\ntwo", "x"]
    assert files.find_files(spark, str(tmp_path / "d"), "*.md", 1).count() == 1
    assert files.latest_change(spark, str(tmp_path / "d")).first().latest is not None
    (tmp_path / "p.txt").write_text("# c\n\n  ask  \n")
    assert [r.prompt for r in files.prompt_list(spark, str(tmp_path / "p.txt")).collect()] == ["ask"]
    assert files.from_stdin(spark, "x").first().filename == "stdin.txt"


def test_sinks_redact(spark, tmp_path):
    d = spark.createDataFrame([("ghp_" + "a" * 40,)], "output string")
    files.write_text(d, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "[REDACTED_GITHUB_TOKEN]"


def test_state_and_lists(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long").write.parquet(str(tmp_path / "s"))
    got = files.merge_state(str(tmp_path / "s"), spark, spark.createDataFrame([("a", 2)], "k string, v long"), "k")
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 1)]
    both = files.committable(spark.createDataFrame([("x",)], "file string"), spark.createDataFrame([("x",), ("y",)], "file string"))
    assert sorted(map(tuple, both.collect())) == [("x", True), ("y", False)]
    assert files.staged(spark.createDataFrame([("x", "A"), ("y", "D")], "file string, status string")).count() == 1


def test_references(spark):
    refs = [("vscode.implicit.x", None, "hidden"), ("file:a", None, " "), ("file:b", None, "text"), ("vscode.instructions.y", "1-2", "ranged")]
    d = spark.createDataFrame([(" ", refs)], "s string, r array<struct<id:string,range:string,text:string>>")
    got = d.select(files.intentional_references(F.col("r")).alias("r"), "s").select(F.size("r"), files.editor_context(F.col("s"), F.col("r"))).first()
    assert tuple(got) == (3, "text")


def test_state_is_written_merged(spark, tmp_path):
    path, table = str(tmp_path / "state"), lambda rows: spark.createDataFrame(rows, "k string, v long")
    files.write_state(path, spark, table([("a", 1), ("b", 1)]), "k")
    files.write_state(path, spark, table([("b", 2), ("c", 2)]), "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 2)]
