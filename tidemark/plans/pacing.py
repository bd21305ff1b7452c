"""Audio analysis and paced cut points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.conflicts import deoverlap
from tidemark.operators.signal import Frames, chunk_scores, moving_average, offset, onset, quiet_gate, smooth_width
from tidemark.session import cut_lineage

KEY = "source_id"


def spike_events(
    profile: DataFrame, chunk_labels: DataFrame, *, chunk_s: float = 2.0, smooth_s: float = 5.0,
    gate_p: float = 0.7, threshold: float = 0.30, label: str = "audio_combat_spike",
) -> DataFrame:
    """Combat spikes: smooth the energy, gate quiet chunks, sum combat labels, keep the loud.

    ``profile`` has one row per half chunk (``ix``); ``chunk_labels`` one per chunk and label.
    Quiet chunks are dropped before their labels are ranked.
    """
    smoothed = moving_average(profile, rows=smooth_width(smooth_s, chunk_s))
    chunks = chunk_labels.select(KEY, "chunk_ix").distinct().withColumn("t", F.col("chunk_ix") * chunk_s)
    loud = quiet_gate(chunks, smoothed, chunk_s=chunk_s, p=gate_p)
    scored = chunk_scores(chunk_labels.join(loud.select(KEY, "chunk_ix"), [KEY, "chunk_ix"], "left_semi"))
    return scored.where(F.col("score") >= threshold).select(
        KEY,
        F.round(F.col("chunk_ix") * chunk_s, 2).alias("timestamp_s"),
        F.lit(label).alias("label"),
        F.round("score", 4).alias("score"),
    )


def safe_entry(
    clips: DataFrame, scores: DataFrame | Frames, profile: DataFrame | Frames, *, back_s: float = 60.0, pad_s: float = 4.0,
    default_s: float = 10.0, buffer_minutes: float = 1.2, half_chunk: float = 0.0, score_threshold: float = 0.30,
) -> DataFrame:
    """Entry point per clip: onset less the pad, or ``default_s`` before the start."""
    reach = min(buffer_minutes * 60, back_s)
    spans = clips.select(
        KEY, "clip_id", F.greatest(F.lit(0.0), F.col("start_time") - reach).alias("from_t"), F.col("start_time").alias("to_t")
    )
    found = onset(spans, scores, profile, start="from_t", end="to_t", half_chunk=half_chunk, score_threshold=score_threshold)
    limit = F.col("start_time") - back_s
    return clips.join(found.select(KEY, "clip_id", "onset_t", "confidence"), [KEY, "clip_id"], "left").select(
        *[clips[c] for c in clips.columns],
        F.struct(
            F.greatest(F.coalesce(F.col("onset_t") - pad_s, F.col("start_time") - default_s), limit).alias("timestamp"),
            F.coalesce("confidence", F.lit(0.4)).alias("confidence"),
        ).alias("safe_entry"),
    )


def safe_exit(
    clips: DataFrame, scores: DataFrame | Frames, profile: DataFrame | Frames, *, fwd_s: float = 45.0, default_s: float = 10.0,
    buffer_minutes: float = 1.5, half_chunk: float = 0.0, score_threshold: float = 0.30,
) -> DataFrame:
    """Exit point per clip: offset, or ``default_s`` after the end; never past ``fwd_s``."""
    reach = min(buffer_minutes * 60, fwd_s)
    spans = clips.select(KEY, "clip_id", F.col("end_time").alias("from_t"), (F.col("end_time") + reach).alias("to_t"))
    found = offset(spans, scores, profile, start="from_t", end="to_t", half_chunk=half_chunk, score_threshold=score_threshold)
    limit = F.col("end_time") + fwd_s
    return clips.join(found.select(KEY, "clip_id", "offset_t", "confidence"), [KEY, "clip_id"], "left").select(
        *[clips[c] for c in clips.columns],
        F.struct(
            F.least(F.coalesce("offset_t", F.col("end_time") + default_s), limit).alias("timestamp"),
            F.coalesce("confidence", F.lit(0.4)).alias("confidence"),
        ).alias("safe_exit"),
    )


def pace_clips(clips: DataFrame, scores: DataFrame | Frames, profile: DataFrame | Frames, *, half_chunk: float = 0.0,
               score_threshold: float = 0.30, width: float = 600.0) -> DataFrame:
    """Entry and exit per clip, overlaps pushed apart, paced duration."""
    clips = cut_lineage(clips)
    entered = safe_entry(clips, scores, profile, half_chunk=half_chunk, score_threshold=score_threshold)
    both = safe_exit(entered, scores, profile, half_chunk=half_chunk, score_threshold=score_threshold)
    both = cut_lineage(both)
    flat = both.withColumns({"__in": F.col("safe_entry.timestamp"), "__out": F.col("safe_exit.timestamp")})
    moved = deoverlap(flat, order=("start_time", "clip_id"), start="__in", end="__out", width=width)
    return moved.select(
        *[c for c in clips.columns],
        F.struct(
            F.col("new_start").alias("timestamp"),
            F.when(F.col("adjusted"), 0.3).otherwise(F.col("safe_entry.confidence")).alias("confidence"),
            F.when(F.col("adjusted"), "moved past an earlier clip").otherwise("audio").alias("reason"),
        ).alias("safe_entry"),
        F.col("safe_exit"),
        (F.col("__out") - F.col("new_start")).alias("safe_duration"),
        F.col("valid"),
    )
