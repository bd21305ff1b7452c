"""Readers, sinks, stages, scorer hook and streaming runs."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.scorer import score_batches
from tidemark.plans import narrative
from tidemark.sources import params, readers, sinks
from tidemark.streaming import windows

SPIKE = "audio_combat_spike"


def test_event_logs_and_broken_files(spark, tmp_path):
    good = [{"timestamp_s": 1.5, "label": "x"}, {"label": "y", "text": "t"}]
    (tmp_path / "rec 7+.json").write_text(json.dumps(good))
    (tmp_path / "broken.json").write_text("[{broken")
    (tmp_path / "object.json").write_text("{}")
    (tmp_path / "empty.json").write_bytes(b"")
    (tmp_path / "bytes.json").write_bytes(b"[\xff\xfe]")
    (tmp_path / "none.json").write_text("[]")
    names = spark.createDataFrame([(str(tmp_path / "rec 7+.json"), 7)], "file STRING, source_id BIGINT")
    read = readers.event_logs(spark, f"file://{tmp_path}", names)
    assert [(r.source_id, r.event_id, r.timestamp_s, r.label) for r in read.rows.orderBy("event_id").collect()] == [(7, 0, 1.5, "x"), (7, 1, None, "y")]
    bad = {r.file.rsplit("/", 1)[1]: r.reason for r in read.unreadable.collect()}
    assert bad == {"broken.json": "not JSON", "object.json": "not a list", "empty.json": "empty", "bytes.json": "not UTF-8"}


def test_sources_are_told_by_their_whole_path(spark, tmp_path):
    for name in ("a/7.json", "a/007.json", "b/7.json", "b/c/7.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('[{"timestamp_s": 1.0, "label": "x"}]')
    rows = readers.read_event_logs(spark, str(tmp_path)).collect()
    assert len(rows) == len({r.source_id for r in rows}) == 4
    again = readers.read_event_logs(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert {r.source_id for r in again} == {r.source_id for r in rows}


def test_mixed_audio_logs(spark, tmp_path):
    (tmp_path / "1.json").write_text('[[1.5, "a", 0.25], {"timestamp_s": 2, "label": "b", "confidence": "0.5"}, [3, "short"], 7, null, "x", ["soon", "c", 1, 9], {}]')
    (tmp_path / "2.json").write_text("[1, ")
    read = readers.audio_logs(spark, str(tmp_path))
    rows = [(r.timestamp_s, r.label, r.score) for r in read.rows.collect()]
    assert rows == [(1.5, "a", 0.25), (2.0, "b", 0.5), (None, "c", 1.0), (None, None, None)]
    assert [r.reason for r in read.unreadable.collect()] == ["not JSON"]
    assert readers.read_audio_events(spark, str(tmp_path)).count() == 4


def test_transcript_files(spark, tmp_path):
    (tmp_path / "talk.txt").write_text("no times here\n")
    rows = readers.read_transcript_lines(spark, str(tmp_path)).orderBy("ix").collect()
    assert [(r.ix, r.start) for r in rows] == [(0, -1.0), (1, -1.0)]


def test_manifest_shapes_and_class_names(spark, tmp_path):
    clip = {"clip_id": "clip_0", "start": 1.0, "end": 2.0}
    (tmp_path / "1.json").write_text(json.dumps([clip]))
    (tmp_path / "2.json").write_text(json.dumps({"vision_frame_timestamps": [0.5], "clips": [clip, clip]}))
    out = readers.read_manifests(spark, str(tmp_path)).groupBy("source_id").count().orderBy("source_id").collect()
    assert sorted(r["count"] for r in out) == [1, 2]
    (tmp_path / "classes.txt").write_text("a\n\n b \r\n")
    assert [tuple(r) for r in readers.read_class_names(spark, str(tmp_path / "classes.txt")).collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r) for r in readers.read_class_names(spark, str(tmp_path / "none.txt")).collect()] == [(0, "target_indicator")]


def test_file_list(spark, tmp_path):
    for n in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / n).write_text("x")
    assert {r.stem for r in readers.list_files(spark, str(tmp_path), [".jpg", ".png"]).collect()} == {"a", "b"}


def test_params_replace_whole_sections():
    p = params.layered({"scoring": {"points_system": {"victory": 1000}}, "clumping": {"end_buffer": 1.0}})
    assert p["scoring"]["points_system"] == {"victory": 1000}
    assert p["clumping"]["end_buffer"] == 1.0 and p["clumping"]["clip_merge_gap"] == 60.0


def test_stage_is_reused(spark, tmp_path):
    a = spark.range(5)
    assert sinks.stage(a, str(tmp_path), "one").count() == 5
    assert sinks.stage(a.where("id < 0"), str(tmp_path), "one").count() == 5
    assert sinks.stage(a.where("id < 2"), str(tmp_path), "one", refresh=True).count() == 2


def test_plain_sinks_and_params(spark, tmp_path):
    rows = [(i % 5 if i % 7 else None, i, float(i), "x", 0.5, "t") for i in range(200)]
    events = spark.createDataFrame(rows, "source_id BIGINT, event_id BIGINT, timestamp_s DOUBLE, label STRING, confidence DOUBLE, text STRING")
    sinks.write_events(events, str(tmp_path / "events"), buckets=4)
    back = spark.read.schema(events.schema).json(str(tmp_path / "events")).select(events.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, events.collect()))
    assert len([f for f in (tmp_path / "events").iterdir() if f.name.startswith("bucket=")]) <= 4
    clips = spark.createDataFrame([(1, "clip_1.mp4", None, 1.0, 3.5)], "source_id BIGINT, file_name STRING, title STRING, start DOUBLE, end DOUBLE")
    sinks.write_metadata(clips, "/out/", str(tmp_path / "meta"))
    assert [(r.file_path, r.title, r.duration) for r in spark.read.json(str(tmp_path / "meta")).collect()] == [("/out/clip_1.mp4", "Untitled", 2.5)]
    lines = spark.createDataFrame([(1, "b"), (0, "a"), (2, "c")], "ix INT, line STRING")
    sinks.write_dataset_text(lines, str(tmp_path / "data"))
    assert [r.value for r in spark.read.text(str(tmp_path / "data")).collect()] == ["a", "b", "c"]
    (tmp_path / "scenario.json").write_text('{"clumping": {"end_buffer": 1.0}}')
    assert params.read_params(spark, str(tmp_path / "scenario.json"))["clumping"]["end_buffer"] == 1.0


def test_scorer_turns_failures_into_rows(spark):
    def scorer(batch):
        if (batch["id"] >= 8).any():
            raise RuntimeError("down")
        return [float(i) if i % 2 else KeyError("even") for i in batch["id"]]

    out = {r.id: (r.value, r.error) for r in score_batches(spark.range(10).coalesce(1), scorer, keep=["id"], batch_size=4).collect()}
    assert out[1] == (1.0, None) and out[0] == (None, "KeyError: 'even'") and out[9] == (None, "RuntimeError: down")


def test_prompt_text_is_not_searched_for_placeholders(spark):
    c = spark.createDataFrame(
        [(1, 0, 0.0, 65.0, "{current}", "now {previous}", "later")],
        "source_id BIGINT, chapter_ix BIGINT, start DOUBLE, end DOUBLE, previous STRING, current STRING, upcoming STRING",
    )
    r = narrative.prompt_table(c, "{label}|{previous}|{current}").first()
    assert r.prompt == "Chapter 1 (00:00 to 01:05)|{current}|now {previous}"


BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROWS = [  # source, id, seconds, label, text
    (1, 1, 0, "ELIMINATED Text", "a"), (1, 2, 20, SPIKE, ""), (1, 3, 29, "ELIMINATED Text", "a"), (1, 4, 75, "x", ""),
    (1, 5, 110, "ELIMINATED Text", "b"), (1, 6, 110, "ELIMINATED Text", "b"), (2, 7, 5, SPIKE, ""), (1, 8, 900, "x", "end"),
    (2, 9, 900, "x", "end"),
]


@pytest.fixture
def stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [
        json.dumps({"source_id": s, "event_id": i, "ts": (BASE + timedelta(seconds=t)).isoformat(), "label": lb, "confidence": 0.5, "text": x})
        for s, i, t, lb, x in ROWS
    ]
    (src / "a.json").write_text("\n".join(lines))
    schema = "source_id BIGINT, event_id BIGINT, ts TIMESTAMP, label STRING, confidence DOUBLE, text STRING"

    def read():
        return spark.readStream.schema(schema).json(str(src))

    def run(df, mode="append"):
        out, ck = tmp_path / "out", tmp_path / "ck"
        if mode == "append":
            q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ck))
        else:
            q = df.writeStream.format("memory").queryName("got").outputMode(mode)
        q.trigger(availableNow=True).start().awaitTermination()
        return (spark.read.parquet(str(out)) if mode == "append" else spark.table("got")).collect()

    return read, run


def test_stream_bursts(stream):
    read, run = stream
    got = run(windows.session_bursts(read()))
    assert sorted(r.n for r in got) == [2, 2]


def test_stream_intensity(stream):
    read, run = stream
    got = run(windows.label_intensity(read()), mode="complete")
    assert sum(r.n for r in got) == len(ROWS)


def test_stream_dedupe(stream):
    read, run = stream
    ids = {r.event_id for r in run(windows.dedupe(read()))}
    assert len(ids) == len(ROWS) - 1 and len(ids & {5, 6}) == 1


def test_stream_pairs(stream):
    read, run = stream
    ev = read()
    got = run(windows.anchored_pairs(ev.where("label = 'ELIMINATED Text'"), ev.where(F.col("label") == SPIKE)))
    assert sorted(r.event_id for r in got) == [1, 3]


def test_stream_gap_segments(spark, stream):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    read, run = stream
    got = {r.event_id: r.segment_id for r in run(windows.gap_segments(read()))}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 8: 4, 7: 1, 9: 2}
