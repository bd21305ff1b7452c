"""Rules that the tables at hand do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import natural_key
from tidemark.operators import signal
from tidemark.plans import narrative
from tidemark.sources import readers, sinks


def test_natural_key_has_no_longest_number(spark):
    names = ["a2", "a10", "a010", "a123456789012345678901234", "a123456789012345678901235", "a99999999999999999999999999"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, n STRING").orderBy(natural_key(F.col("n")), "i").collect()
    assert [r["n"] for r in rows] == names


def test_numbers_of_replies(spark):
    reply = (
        '[{"start": "100.5", "end": 140.5}, {"start": "soon", "end": 40}, {"end": 40, "padding": {"start_buffer": "2"}},'
        ' {"start": 1, "end": null, "virality_metrics": {"hook_strength": "90"}}]'
    )
    items, bad = narrative.parse_replies(spark.createDataFrame([(1, 0, reply), (1, 1, "none")], "source_id BIGINT, chapter_ix INT, reply STRING"))
    rows = items.orderBy("item_ix").collect()
    assert [(r["item"]["start"], r["item"]["end"]) for r in rows] == [(100.5, 140.5), (None, 40.0), (0.0, 40.0), (1.0, 0.0)]
    assert rows[2]["item"]["padding"]["start_buffer"] == 2.0
    assert rows[3]["item"]["virality_metrics"]["hook_strength"] == 90.0
    assert bad.count() == 1


def test_sources_of_like_names(spark, tmp_path):
    for name in ("alpha_1", "beta_1", "7"):
        (tmp_path / f"{name}.json").write_text('[{"timestamp_s": 1.0, "label": "x", "confidence": 0.5, "text": "t"}]')
    rows = readers.read_event_logs(spark, str(tmp_path)).collect()
    assert len({r["source_id"] for r in rows}) == 3


def test_events_without_time_are_written(spark, tmp_path):
    events = spark.createDataFrame(
        [(1, 0, None, "a", 0.5, "x"), (1, 1, 2.0, "b", 0.5, "y")],
        "source_id BIGINT, event_id BIGINT, timestamp_s DOUBLE, label STRING, confidence DOUBLE, text STRING",
    )
    sinks.write_event_arrays(events, str(tmp_path / "out"))
    rows = readers.read_event_logs(spark, str(tmp_path / "out")).collect()
    assert sorted((r["timestamp_s"], r["label"]) for r in rows) == [(0.0, "a"), (2.0, "b")]


def test_shared_folder_is_that_of_the_context(spark):
    from tidemark.session import shared_folder

    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()


def test_manifest_from_an_editor(spark):
    reply = (
        '```json\n[{"clip_id": "clip_1", "title": "By title", "viral_archetype": "v", "engagement_trigger": "g", "selection_reason": "r"},'
        ' {"clip_id": "gone"}, {"clip_id": "clip_0", "clip_title": "Chosen", "title": "Second"}, {"clip_id": "clip_0"}]\n```'
    )
    selection = narrative.parse_selection(spark.createDataFrame([(1, reply)], "source_id BIGINT, reply STRING"))
    spans = '[{"clip_title": "Own", "start": 10, "end": 40}, {"clip_title": "Near", "start": "11", "end": "40"}]'
    transcript = spark.createDataFrame(
        [(1, i, 10.0 * i, 10.0 * i + 9, "Normal", "Normal", f"line {i}") for i in range(8)],
        "source_id BIGINT, ix BIGINT, start DOUBLE, end DOUBLE, loudness STRING, pace STRING, text STRING",
    )
    screen = spark.createDataFrame([], "source_id BIGINT, t DOUBLE, text STRING")
    candidates = narrative.score_candidates(
        spark.createDataFrame([(1, 0, spans)], "source_id BIGINT, chapter_ix INT, reply STRING"), transcript, screen
    )
    assert narrative.offered_candidates(candidates).count() == 1
    rows = narrative.build_manifest(selection, candidates, transcript, max_clips=3, fuzzy=False).orderBy("pick_no").collect()
    assert [(r["pick_no"], r["clip_id"], r["title"], r["viral_archetype"]) for r in rows] == [
        (1, "clip_1", "By title", "v"), (3, "clip_0", "Chosen", None),
    ]


def test_quantiles_with_an_outlier(spark):
    rng = np.random.default_rng(6)
    values = {1: [*rng.normal(0, 1, 900).tolist(), 1e12], 2: [5.0] * 40, 3: [1.0, 2.0], 4: rng.integers(0, 7, 300).astype(float).tolist()}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(4, None)], "source_id BIGINT, v DOUBLE")
    at = {"a": 0.0, "b": 0.3, "c": 0.77, "d": 1.0}
    for r in signal.exact_quantiles(rows, "v", at, buckets=16).collect():
        assert [r[n] for n in at] == pytest.approx(np.quantile(values[r["source_id"]], [*at.values()]).tolist())
