"""Event logs to highlight clips."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import intensity, is_combat
from tidemark.operators.chains import TRIGGER_LABELS, trigger_windows
from tidemark.operators.intervals import (
    SPIKE, Agg, bursts, count, highest, islands, label_set, lowest, merge_intervals, number_segments,
    time_points, total,
)
from tidemark.operators.rangejoin import nearest_spikes, points_in_intervals
from tidemark.operators.scan import row_number, scan
from tidemark.session import cut_lineage

KEY = "source_id"


def merged_log(visual: DataFrame, audio: DataFrame) -> DataFrame:
    """Detector events plus audio events, the latter with empty text."""
    spikes = audio.select(KEY, "timestamp_s", "label", F.col("score").alias("confidence")).withColumn("text", F.lit(""))
    return visual.unionByName(spikes, allowMissingColumns=True)


def scored_events(events: DataFrame, weights: Mapping | None = None, audio_label: str = SPIKE) -> DataFrame:
    combat = is_combat(F.col("label"), F.col("text"))
    audio = F.coalesce(F.col("label") == audio_label, F.lit(False))
    return events.select(
        KEY, "event_id", F.coalesce("timestamp_s", F.lit(0.0)).alias("timestamp_s"), "label", "text",
        intensity(F.col("label"), F.col("confidence"), F.col("text"), weights).alias("score"),
        combat.alias("combat"), audio.alias("audio"), (combat & ~audio).alias("visual"),
    )


def clip_intensity(points: DataFrame, clips: DataFrame, *, start: str, end: str, ident: Sequence[str]) -> DataFrame:
    """Count and total score of the events inside each clip, from points already summed per time."""
    inside = points_in_intervals(
        points.select(KEY, "t", "n", "score"), clips.select(KEY, *ident, start, end), t="t", start=start, end=end
    )
    return inside.groupBy(KEY, *ident).agg(
        F.sum("n").alias("event_count"), F.sum("score").alias("intensity_score")
    )


def distinct_events(events: DataFrame, *, group: Sequence[str] = (KEY,)) -> DataFrame:
    """Events of equal time, label and text once per group, with the number of their copies."""
    return events.groupBy(*group, "timestamp_s", "label", "text").agg(F.count(F.lit(1)).alias("copies"))


def anchored_raw_clips(
    events: DataFrame, audio: DataFrame, *, anchor_label: str = "ELIMINATED Text",
    elim_merge_gap: float = 30.0, audio_lookback: float = 30.0, audio_lookahead: float = 30.0,
    end_buffer: float = 5.0, fallback_pad_start: float = 20.0, fallback_pad_end: float = 10.0,
    weights: Mapping | None = None, width: float = 600.0,
) -> DataFrame:
    """One clip per burst of anchor events, its ends moved to nearby audio spikes."""
    fights = bursts(events, anchor_label=anchor_label, gap_s=elim_merge_gap, width=width)
    found = nearest_spikes(
        fights, audio, start="start", end="end", spike_t="timestamp_s",
        lookback=audio_lookback, lookahead=audio_lookahead,
    )
    placed = found.withColumns(
        {
            "raw_start": F.greatest(F.lit(0.0), F.coalesce("spike_before", F.col("start") - fallback_pad_start)),
            "raw_end": F.coalesce(F.col("spike_after") + end_buffer, F.col("end") + fallback_pad_end),
        }
    )
    points = time_points(
        events, score=F.sum(intensity(F.col("label"), F.col("confidence"), F.col("text"), weights))
    )
    # a clip holds at least its own anchors, so the inner join keeps every burst
    inside = points_in_intervals(points.select(KEY, "t", "n", "score"), placed, t="t", start="raw_start", end="raw_end")
    clips = inside.groupBy(KEY, "burst_ix").agg(
        F.concat(F.lit("elim_"), F.floor(F.max("start")).cast("string")).alias("clip_id"),
        F.round(F.max("raw_start"), 2).alias("start_time"),
        F.round(F.max("raw_end"), 2).alias("end_time"),
        F.max("elim_count").alias("elim_count"),
        F.sum("n").alias("event_count"),
        F.round(F.sum("score"), 3).alias("intensity_score"),
    )
    heard = audio.select(KEY).distinct().withColumn("audio_anchored", F.lit(True))
    return clips.join(heard, KEY, "left").withColumn("audio_anchored", F.coalesce("audio_anchored", F.lit(False)))


def anchored_clips(
    events: DataFrame, audio: DataFrame, *, clip_merge_gap: float = 60.0, width: float = 600.0, **params
) -> DataFrame:
    """Anchored clips with neighbours up to ``clip_merge_gap`` apart merged.

    Event counts add up without removing doubles and the score is the highest of the parts,
    as events of merged clips are only concatenated.
    """
    raw = anchored_raw_clips(events, audio, width=width, **params)
    merged = merge_intervals(
        raw,
        {
            "first": lowest(F.struct("start_time", "burst_ix", "clip_id")),
            "elim_count": total(F.col("elim_count")),
            "event_count": total(F.col("event_count")),
            "intensity_score": highest(F.col("intensity_score")),
            "n_bursts": count(),
            "audio_anchored": Agg(F.bool_or("audio_anchored"), F.bool_or),
        },
        slack_s=clip_merge_gap, tie=["burst_ix"], width=width, number="clip_ix",
    )
    return merged.select(
        KEY, "clip_ix", F.col("first.clip_id").alias("clip_id"),
        F.col("start").alias("start_time"), F.col("end").alias("end_time"),
        F.round(F.col("end") - F.col("start"), 2).alias("duration"),
        "elim_count", "n_bursts", "event_count", "intensity_score", "audio_anchored",
    )


def window_candidates(ranked: DataFrame, *, window_s: float = 60.0, tail_s: float = 5.0, **params):
    """Trigger windows with their events' totals, and the (window, event) pairs."""
    group = [KEY, "segment_id"]
    windows = trigger_windows(ranked, window_s=window_s, **params).select(*group, "row_ix", "last_ix", "window_start")
    pairs = points_in_intervals(
        ranked, windows, t="ix", start="row_ix", end="last_ix", key=group, width=256
    )
    totals = pairs.groupBy(*group, "row_ix", "window_start").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("score").alias("intensity_score"),
        F.count_if("combat").alias("combat_events"),
        F.bool_or("visual").alias("has_visual"),
        F.bool_or("audio").alias("has_audio"),
        F.max("timestamp_s").alias("last_t"),
        F.max("segment_events").alias("segment_events"),
    ).withColumn("window_end", F.col("last_t") + tail_s)
    return windows, pairs, totals


def accepted_windows(totals: DataFrame, min_intensity: float = 3.0) -> DataFrame:
    """Windows that score enough and hold both a visual and an audio signal.

    Scores are sums of doubles, whose last digits depend on the order of adding; nine decimals don't.
    """
    return totals.where((F.round("intensity_score", 9) >= min_intensity) & F.col("has_visual") & F.col("has_audio"))


def segmented_events(events: DataFrame, *, weights=None, gap_s=30.0, bridge_s=60.0, audio_label=SPIKE,
                     triggers=TRIGGER_LABELS, width=600.0) -> DataFrame:
    """Scored events with their segment and their position in it."""
    return number_segments(
        scored_events(events, weights, audio_label), counted=F.col("label").isin(*triggers), gap_s=gap_s,
        bridge_s=bridge_s, audio_label=audio_label, width=width,
    )


def near_windows(kept: DataFrame, *, merge_s: float = 30.0, width: float = 600.0) -> DataFrame:
    """Merge accepted windows of a segment that are at most ``merge_s`` apart."""
    first = F.struct(
        F.col("window_start").alias("at"), "row_ix", "window_end", "last_t", "combat_events"
    )
    return islands(
        kept, lambda reach, tail, start, head: start - reach <= merge_s,
        {"n_windows": count(), "first": lowest(first), "segment_events": highest(F.col("segment_events"))},
        start=F.col("window_start"), end=F.col("window_end"), tie=["row_ix"],
        key=[KEY, "segment_id"], width=width, number="part_ix",
    )


def sliding_clips(
    events: DataFrame, *, weights: Mapping | None = None, window_s: float = 60.0,
    min_intensity: float = 3.0, gap_s: float = 30.0, bridge_s: float = 60.0, merge_s: float = 30.0,
    tail_s: float = 5.0, celebration_s: float = 10.0, triggers: Sequence[str] = TRIGGER_LABELS,
    audio_label: str = SPIKE, compat: bool = False, width: float = 600.0, page_rows: int = 256,
) -> DataFrame:
    """Gap segments, trigger windows, acceptance, merge of near windows, clip profile.

    A merged clip counts events of equal time, label and text once.  With ``compat`` its
    duration, combat count and story arc stay those of its first window.
    """
    group = [KEY, "segment_id"]
    # read five times below: written once, so segments and numbers are not worked out again
    ranked = cut_lineage(
        segmented_events(events, weights=weights, gap_s=gap_s, bridge_s=bridge_s,
                         audio_label=audio_label, triggers=triggers, width=width)
    )
    _, pairs, totals = window_candidates(
        ranked, window_s=window_s, tail_s=tail_s, triggers=triggers, width=width, page_rows=page_rows
    )
    # windows, clips and their profiles are read twice or more each: written once
    kept = cut_lineage(accepted_windows(totals, min_intensity))
    clips = cut_lineage(near_windows(kept, merge_s=merge_s, width=width))
    owner = points_in_intervals(
        kept.select(*group, "row_ix", "window_start"),
        clips.select(*group, "part_ix", "start", "end", "n_windows"),
        t="window_start", start="start", end="end", key=group, width=width,
    )
    members = pairs.join(owner.select(*group, "row_ix", "part_ix", "n_windows"), [*group, "row_ix"])
    merged = F.max("n_windows") > 1
    same = members.groupBy(*group, "part_ix", "timestamp_s", "label", "text").agg(
        F.when(merged, F.lit(1)).otherwise(F.count(F.lit(1))).alias("n"),
        F.when(merged, F.min_by("score", "event_id")).otherwise(F.sum("score")).alias("score"),
        F.bool_or("combat").alias("combat"),
    )
    profile = same.groupBy(*group, "part_ix").agg(
        F.sum("n").cast("bigint").alias("event_count"),
        F.sum(F.when(F.col("combat"), F.col("n")).otherwise(0)).cast("bigint").alias("combat_all"),
        F.sum("score").alias("intensity_score"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.min("timestamp_s").alias("first_t"),
        F.max("timestamp_s").alias("last_t"),
    )
    end_known = F.col("first.window_end") if compat else F.col("end")
    last_known = F.col("first.last_t") if compat else F.col("last_t")
    out = clips.join(profile, [*group, "part_ix"]).select(
        KEY,
        F.col("start").alias("start_time"),
        F.col("end").alias("end_time"),
        (end_known - F.col("start")).alias("duration"),
        "event_count",
        (F.col("first.combat_events") if compat else F.col("combat_all")).alias("combat_events"),
        "labels",
        "intensity_score",
        F.col("first_t").alias("buildup_start"),
        (last_known + celebration_s).alias("celebration_end"),
        F.struct(
            (F.col("first_t") - F.col("start")).alias("buildup_duration"),
            (end_known - F.col("first_t")).alias("action_duration"),
            (last_known + celebration_s - end_known).alias("celebration_duration"),
        ).alias("story_arc"),
        "n_windows",
        "segment_id",
        "segment_events",
    )
    return scan(cut_lineage(out), [KEY], ["start_time"], {"clip_n": row_number()}, pos="start_time", width=width).withColumn(
        "clip_ix", F.col("clip_n") - 1
    ).drop("clip_n")


def highlight_clips(events: DataFrame, audio: DataFrame, *, mode: str = "elimination",
                    anchor_label: str = "ELIMINATED Text", weights: Mapping | None = None,
                    sliding: Mapping | None = None, **anchored) -> DataFrame:
    """Anchored clips where a source has anchors and audio, sliding clips elsewhere.

    In elimination mode a source without audio uses the sliding settings given; a source
    with audio but without anchors uses the defaults.
    """
    shared = ["source_id", "start_time", "end_time", "duration", "event_count", "intensity_score", "origin"]
    if mode != "elimination":
        return sliding_clips(events, weights=weights, **(sliding or {})).withColumn("origin", F.lit("sliding")).select(shared)
    heard = audio.select(KEY).distinct()
    anchors = events.where(F.col("label") == anchor_label).select(KEY).distinct()
    anchored_part = anchored_clips(
        events.join(heard, KEY, "left_semi"), audio, anchor_label=anchor_label, weights=weights, **anchored
    ).withColumn("origin", F.lit("anchored"))
    if sliding:
        silent = sliding_clips(events.join(heard, KEY, "left_anti"), weights=weights, **sliding)
        plain = sliding_clips(
            events.join(heard, KEY, "left_semi").join(anchors, KEY, "left_anti"), weights=weights
        )
        rest = silent.unionByName(plain)
    else:  # both kinds of sources with the defaults: one run
        rest = sliding_clips(events.join(heard.join(anchors, KEY), KEY, "left_anti"), weights=weights)
    rest = rest.withColumn("origin", F.lit("sliding"))
    return anchored_part.select(shared).unionByName(rest.select(shared))


def render_list(clips: DataFrame, *, compat: bool = False, width: float = 600.0) -> DataFrame:
    """Start, end, file name and title per clip; paced times win where present.

    With ``compat`` a paced time of exactly 0 counts as missing.
    """
    def paced(col: str):
        c = F.col(f"{col}.timestamp") if col in clips.columns else F.lit(None).cast("double")
        return F.nullif(c, F.lit(0.0)) if compat else c

    n = scan(clips, [KEY], ["start_time", "clip_id"], {"file_ix": row_number()}, pos="start_time", width=width)
    return n.select(
        KEY,
        "file_ix",
        F.coalesce(paced("safe_entry"), "start_time").alias("start"),
        F.coalesce(paced("safe_exit"), "end_time").alias("end"),
        F.concat(F.lit("clip_"), F.col("file_ix").cast("string"), F.lit(".mp4")).alias("file_name"),
        F.coalesce("clip_id", F.concat(F.lit("Clip "), F.col("file_ix").cast("string"))).alias("title"),
    )


__all__ = [
    "accepted_windows", "anchored_clips", "anchored_raw_clips", "clip_intensity", "highlight_clips",
    "label_set", "merged_log", "near_windows", "render_list", "scored_events", "segmented_events",
    "sliding_clips", "window_candidates",
]
