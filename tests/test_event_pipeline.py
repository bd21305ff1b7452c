"""The event pipeline against its steps, each run on written results of the one before."""

from pyspark.sql import functions as F

from tidemark.catalog import measures
from tidemark.catalog import samples as S
from tidemark.operators import intervals
from tidemark.plans import detection, gameplay, highlights, pacing
from tidemark.sources import sinks

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_steps(spark, tmp_path):
    frames = measures._in_signal(spark, SF)
    whole = gameplay.event_pipeline(S.events(spark, SF), S.profile(spark, SF), S.chunk_labels(spark, SF), *frames)
    spikes = sinks.stage(pacing.spike_events(S.profile(spark, SF), S.chunk_labels(spark, SF)), str(tmp_path), "spikes")
    events = S.events(spark, SF).select("source_id", "event_id", "timestamp_s", "label", "confidence", "text")
    at = F.floor(F.col("timestamp_s") * 30).cast("bigint")
    wanted = {(r.source_id, r.frame) for r in detection.window_frames(intervals.scan_windows(spikes), fps=30.0, interval_s=1.0, total_frames=1 << 62).collect()}
    heard = {r.source_id for r in spikes.select("source_id").distinct().collect()}
    kept = [r for r in events.withColumn("f", at - at % 30).collect() if r.source_id not in heard or (r.source_id, r.f) in wanted]
    assert 0 < len(kept) < events.count() and heard
    rows = [tuple(r)[:-1] for r in kept] + [(r.source_id, -1 - round(r.timestamp_s * 100), r.timestamp_s, r.label, r.score, "") for r in spikes.collect()]
    log = sinks.stage(spark.createDataFrame(rows, events.schema), str(tmp_path), "log")
    assert gameplay.merged_events(events, spikes).exceptAll(log).isEmpty()
    clips = sinks.stage(highlights.highlight_clips(log, spikes), str(tmp_path), "clips")
    named = clips.withColumn("clip_id", F.concat("origin", F.lit("_"), F.round(F.col("start_time") * 100).cast("bigint").cast("string")))
    paced = sinks.stage(pacing.pace_clips(named, *frames), str(tmp_path), "paced")
    want = sorted(map(tuple, highlights.render_list(paced).collect()))
    got = sorted(map(tuple, whole.collect()))
    assert got == want and len(got) == clips.count() > 0
    assert {t.split("_")[0] for *_, t in got} == {"anchored", "sliding"} or {t.split("_")[0] for *_, t in got} <= {"anchored", "sliding"}
