"""Hand cases at the edges of every rule."""

from pyspark.sql import functions as F

from tidemark.functions import scoring, text, timefmt
from tidemark.functions.similarity import fuzzy_ratio
from tidemark.operators import intervals
from tidemark.operators.conflicts import suppress_overlaps
from tidemark.operators.signal import onset
from tidemark.plans import detection, highlights

SPIKE = "audio_combat_spike"


def segments(ev):
    return [(r.start, r.end, r.n_events) for r in intervals.gap_segments(ev, width=100.0).orderBy("start").collect()]


def test_gap_of_exactly_thirty_splits(make_events):
    ev = make_events([(0, "a"), (29.9, "a"), (59.9, "a")])
    assert segments(ev) == [(0.0, 29.9, 2), (59.9, 59.9, 1)]


def test_gap_beside_a_spike_splits_at_sixty(make_events):
    assert len(segments(make_events([(0, SPIKE), (59.9, "a")]))) == 1
    assert len(segments(make_events([(0, "a"), (60, SPIKE)]))) == 2


def test_spike_at_the_same_time_counts_by_event_order(make_events):
    # the event just before the gap is the plain one, though a spike shares its time
    assert len(segments(make_events([(0, SPIKE), (0, "a"), (40, "a")]))) == 2
    assert len(segments(make_events([(0, "a"), (0, SPIKE), (40, "a")]))) == 1


def test_burst_joins_at_exactly_thirty(make_events):
    ev = make_events([(0, "ELIMINATED Text"), (30, "ELIMINATED Text"), (60.1, "ELIMINATED Text")])
    assert [r.elim_count for r in intervals.bursts(ev).orderBy("start").collect()] == [2, 1]


def test_touching_scan_windows_merge_and_clamp(make_events):
    out = intervals.scan_windows(make_events([(5, SPIKE), (35, SPIKE), (65.1, SPIKE)])).orderBy("start").collect()
    assert [(r.start, r.end) for r in out] == [(0.0, 50.0), (50.099999999999994, 80.1)]


def test_anchored_clip_falls_back_to_padding(make_events):
    ev = make_events([(50, "ELIMINATED Text"), (500, "ELIMINATED Text"), (480, SPIKE), (520, SPIKE)])
    audio = ev.where(F.col("label") == SPIKE).select("source_id", "timestamp_s", "label", F.col("confidence").alias("score"))
    out = highlights.anchored_clips(ev, audio).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time) for r in out] == [(30.0, 60.0), (480.0, 525.0)]
    assert out[0].clip_id == "elim_50" and out[0].audio_anchored


def test_clips_sixty_apart_merge(make_events):
    ev = make_events([(100, "ELIMINATED Text"), (190, "ELIMINATED Text"), (281, "ELIMINATED Text"), (9000, SPIKE)])
    audio = ev.where(F.col("label") == SPIKE).select("source_id", "timestamp_s", "label", F.col("confidence").alias("score"))
    out = highlights.anchored_clips(ev, audio).orderBy("start_time").collect()
    # [80,110] and [170,200] are exactly 60 apart; [261,291] starts 61 after
    assert [(r.start_time, r.end_time, r.n_bursts) for r in out] == [(80.0, 200.0, 2), (261.0, 291.0, 1)]


def test_window_needs_both_signals(make_events):
    only_visual = make_events([(0, "Floating Damage Numbers"), (1, "Floating Damage Numbers")])
    assert highlights.sliding_clips(only_visual).count() == 0
    both = make_events([(0, "Floating Damage Numbers"), (1, SPIKE)])
    clip = highlights.sliding_clips(both).collect()[0]
    assert (clip.start_time, clip.end_time, clip.event_count, clip.combat_events) == (0.0, 6.0, 2, 2)
    assert clip.intensity_score == (1 + 2 + 2) + (1 + 2 + 2)


def test_iou_equal_to_threshold_is_kept_and_ties_keep_the_first(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0.0, 10.0, 5.0), (1, 2, 0.0, 20.0, 4.0), (1, 3, 1.0, 10.0, 5.0), (1, 4, 7.0, 7.0, 1.0)],
        "source_id BIGINT, id BIGINT, start DOUBLE, end DOUBLE, score DOUBLE",
    )
    kept = {r.id for r in suppress_overlaps(rows, threshold=0.5).collect()}
    assert kept == {1, 2, 4}  # 2 has IoU exactly 0.5 with 1; 3 has 0.9; 4 has no length


def test_intensity_rules(make_events):
    ev = make_events(
        [(0, "Victory", None, 0.8), (1, "Victory", None, 0.81), (2, "Teammate", "squad"), (3, "x", "SQUAD ELIMINATED"),
         (4, "x", "+100"), (5, "x", "+"), (6, "loating Damage Numbers", "+20"), (7, "x", "")]
    )
    out = [r.s for r in ev.select("event_id", scoring.intensity(F.col("label"), F.col("confidence"), F.col("text")).alias("s")).orderBy("event_id").collect()]
    assert out == [6.0, 6.5, 0.0, 1 + 2 + 1.5 + 1, 1 + 2 + 10, 1.0, 1 + 2 + 2 + 2, 1.0]


def test_ocr_rules(make_events, spark):
    ev = make_events(
        [(0, "Victory", "victry"), (1, "Victory", "zzz", 0.85), (2, "Victory", "zzz", 0.84), (3, "Victory", " ", 0.9),
         (4, "Floating Damage Numbers", "abc", 0.1), (5, "ELIMINATED Text", "elininated", 0.1)]
    )
    valid = detection.validate_text(ev, detection.keyword_table(spark))
    assert {r.event_id for r in valid.collect()} == {0, 5}
    kept = {r.event_id: r.text for r in detection.keep_readable(ev, valid).collect()}
    assert kept == {0: "victry", 1: "zzz", 3: "[Unreadable text]", 4: "[Visual Indicator]", 5: "elininated"}


def test_fuzzy_ratio_is_not_symmetric(spark):
    row = spark.createDataFrame([("tide", "diet")], "a STRING, b STRING").select(
        fuzzy_ratio(F.col("a"), F.col("b")).alias("x"), fuzzy_ratio(F.col("b"), F.col("a")).alias("y")
    ).first()
    assert (row.x, row.y) == (0.25, 0.5)


def test_replies(spark):
    rows = [
        ("<think>[1]</think>```json\n[{\"a\": 1}]\n```",), ("[]",), ("no array",), ("thinking [x]</think> [2]",), ("pre [1] mid [2] post",),
    ]
    out = [r.j for r in spark.createDataFrame(rows, "reply STRING").select(text.reply_array(F.col("reply")).alias("j")).collect()]
    assert out == ['[{"a": 1}]', "[]", None, "[2]", "[1] mid [2]"]


def test_formats(spark):
    row = spark.range(1).select(
        timefmt.hms(F.lit(90061.9)).alias("a"), timefmt.mmss(F.lit(3725.0)).alias("b"), timefmt.duration_text(F.lit(3661)).alias("c"),
        timefmt.duration_text(F.lit(61)).alias("d"), timefmt.size_text(F.lit(1280)).alias("e"), timefmt.size_text(F.lit(1023)).alias("f"),
        text.title_slug(F.lit("  It's a \"Test\" - Ünï! "), F.lit("x")).alias("g"), text.natural_key(F.lit("Clip10.mp4")).alias("h"),
    ).first()
    assert tuple(row)[:7] == ("25:01:01", "62:05", "1h 01m 01s", "1m 01s", "1.2 KB", "1023 B", "its_a_test__ünï")
    assert row.h.startswith("clip") and row.h > "clip" + "9".rjust(20, "0")


def profile(spark, loud):
    """loud: list of booleans every 0.2 s from 0"""
    rows = [(1, i, round(i * 0.2, 1), 1.0 if x else 0.01, 0.0) for i, x in enumerate(loud)]
    rows[-1] = (*rows[-1][:4], 0.9)
    return spark.createDataFrame(rows, "source_id BIGINT, ix BIGINT, t DOUBLE, rms DOUBLE, score DOUBLE")


def test_ten_quiet_samples_are_bridged_eleven_are_not(spark):
    for quiet, want in ((10, 0.0), (11, (5 + 11) * 0.2)):
        p = profile(spark, [True] * 5 + [False] * quiet + [True] * 5)
        end = (5 + quiet + 4) * 0.2
        r = spark.createDataFrame([(1, 7, 0.0, end + 0.01)], "source_id BIGINT, clip_id BIGINT, a DOUBLE, b DOUBLE")
        got = onset(r, p, p, start="a", end="b").first()
        assert abs(got.onset_t - want) < 1e-6 and got.confidence == 0.9


def test_three_samples_give_no_onset(spark):
    p = profile(spark, [True, True, True])
    r = spark.createDataFrame([(1, 7, 0.0, 10.0)], "source_id BIGINT, clip_id BIGINT, a DOUBLE, b DOUBLE")
    assert onset(r, p, p, start="a", end="b").count() == 0
