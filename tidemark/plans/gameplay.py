"""The event pipeline as one plan: audio spikes, pruned detections, merged log, clips, cut points, render list."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import scan_windows
from tidemark.operators.signal import Frames
from tidemark.plans import highlights, pacing
from tidemark.plans.detection import prune_frames
from tidemark.session import cut_lineage

KEY = "source_id"


def merged_events(
    detections: DataFrame, spikes: DataFrame, *, fps: float = 30.0, interval_s: float = 1.0, pad_s: float = 15.0
) -> DataFrame:
    """Detections in the sampled frames around spikes, with the spikes as events; a source without spikes keeps all.

    A detection belongs to the sampled frame at or before it.  Spikes get numbers below zero.
    """
    stride = max(1, int(fps * interval_s))
    at = F.floor(F.coalesce("timestamp_s", F.lit(0.0)) * fps).cast("bigint")
    framed = detections.withColumn("frame", at - at % stride)
    seen = prune_frames(framed, scan_windows(spikes, pad_s=pad_s), fps=fps, interval_s=interval_s).drop("frame")
    numbered = spikes.withColumn("event_id", -1 - F.round(F.col("timestamp_s") * 100).cast("bigint"))
    heard = numbered.select(KEY, "event_id", "timestamp_s", "label", F.col("score").alias("confidence"), F.lit("").alias("text"))
    return seen.select(KEY, "event_id", "timestamp_s", "label", "confidence", "text").unionByName(heard)


def event_pipeline(
    detections: DataFrame, profile: DataFrame, chunk_labels: DataFrame, scores: DataFrame | Frames, levels: DataFrame | Frames, *,
    mode: str = "elimination", audio: Mapping | None = None, frames: Mapping | None = None, clips: Mapping | None = None,
) -> DataFrame:
    """Render list (start, end, file name, title) of every source's highlights.

    ``profile`` and ``chunk_labels`` give the spikes, ``scores`` and ``levels`` the cut points.  What
    several steps read is written once to shared storage.
    """
    spikes = cut_lineage(pacing.spike_events(profile, chunk_labels, **(audio or {})))
    log = cut_lineage(merged_events(detections, spikes, **(frames or {})))
    found = highlights.highlight_clips(log, spikes, mode=mode, **(clips or {}))
    named = found.withColumn("clip_id", F.concat("origin", F.lit("_"), F.round(F.col("start_time") * 100).cast("bigint").cast("string")))
    paced = cut_lineage(pacing.pace_clips(named, scores, levels))
    return highlights.render_list(paced)
