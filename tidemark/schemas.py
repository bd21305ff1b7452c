"""One explicit schema per table (Spark DDL).  Times are seconds from the start of a source.

Times keep the two decimals a detector writes, so one second of one source holds at
most 100 distinct times.  Operators that first collapse rows of equal time therefore
work on groups whose size is bounded by the bin width and not by the row count.
"""

EVENTS = (
    "source_id BIGINT, event_id BIGINT, timestamp_s DOUBLE, label STRING, "
    "confidence DOUBLE, text STRING"
)
RAW_EVENT = "timestamp_s DOUBLE, label STRING, confidence DOUBLE, text STRING, _corrupt_record STRING"
AUDIO_EVENTS = "source_id BIGINT, timestamp_s DOUBLE, label STRING, score DOUBLE"
SIGNAL = "source_id BIGINT, chunk_ix BIGINT, samples ARRAY<FLOAT>"
PROFILE = "source_id BIGINT, ix BIGINT, t DOUBLE, rms DOUBLE"
SCORE_PROFILE = "source_id BIGINT, t DOUBLE, score DOUBLE"
CHUNK_LABELS = "source_id BIGINT, chunk_ix BIGINT, label STRING, score DOUBLE"
TRANSCRIPT = (
    "source_id BIGINT, ix BIGINT, start DOUBLE, end DOUBLE, loudness STRING, pace STRING, text STRING"
)
SCREEN_TEXT = "source_id BIGINT, t DOUBLE, text STRING"
SCENES = (
    "source_id BIGINT, scene_ix BIGINT, start_seconds DOUBLE, end_seconds DOUBLE, "
    "start_frame BIGINT, end_frame BIGINT"
)
DETECTIONS = (
    "source_id BIGINT, frame_ts DOUBLE, det_ix BIGINT, confidence DOUBLE, "
    "person_box ARRAY<INT>, face_box ARRAY<INT>"
)
WORDS = "source_id BIGINT, clip_id STRING, ix BIGINT, word STRING, start DOUBLE, end DOUBLE"

# numbers are read as text: models quote them, and an unreadable one is not a missing one
CANDIDATE = (
    "clip_title STRING, start STRING, end STRING, anchor_start_text STRING, anchor_end_text STRING, "
    "padding STRUCT<start_buffer: STRING, end_buffer: STRING>, "
    "virality_metrics STRUCT<hook_strength: STRING, payoff_satisfaction: STRING, "
    "retention_potential: STRING>, reasoning STRING"
)
SELECTION = (
    "clip_id STRING, clip_title STRING, title STRING, viral_archetype STRING, "
    "engagement_trigger STRING, selection_reason STRING"
)
MANIFEST_CLIP = (
    "clip_id STRING, file_name STRING, title STRING, start DOUBLE, end DOUBLE, duration DOUBLE, "
    "scores STRUCT<narrative: DOUBLE, hybrid: DOUBLE>, viral_archetype STRING, "
    "engagement_trigger STRING, selection_reason STRING"
)
PROBE = (
    "format STRUCT<duration: STRING, size: STRING>, "
    "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, "
    "r_frame_rate: STRING, avg_frame_rate: STRING>>"
)
