"""Queries on intervals: gap splits, bursts, merges, range joins, clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import samples as S
from tidemark.catalog.registry import query, sql, view
from tidemark.functions.scoring import is_combat
from tidemark.operators import chains, conflicts, intervals, rangejoin, select
from tidemark.operators.scan import last_value, row_number, running_max, running_sum, scan
from tidemark.plans import highlights
from tidemark.session import cut_lineage

# ---------------------------------------------------------------- shared SQL views
COMBAT_SQL = """(label IN ('Floating Damage Numbers', 'loating Damage Numbers', 'audio_combat_spike')
  OR regexp_matches(lower(coalesce(text, '')), 'kill|eliminated|knocked|down|assist|damage|\\+100|\\+50|\\+150|\\+75|\\+25|squad|wipe|elimination'))"""
view(
    "sev",
    f"""SELECT source_id, event_id, timestamp_s, label, text, confidence, combat, label = 'audio_combat_spike' AS audio,
  combat AND label <> 'audio_combat_spike' AS visual,
  CASE WHEN label IN ('Combat Feed / Kill Feed Updates', 'POV Player', 'Teammate') THEN 0e0 ELSE
    1e0 + CASE label WHEN 'Victory' THEN 5e0 WHEN 'ELIMINATED Text' THEN 4e0 WHEN 'Floating Damage Numbers' THEN 2e0
      WHEN 'Directional Damage Indicators' THEN 15e-1 ELSE 0e0 END
    + CASE WHEN combat THEN 2e0 ELSE 0e0 END
    + CASE WHEN label = 'audio_combat_spike' THEN 2e0 ELSE 0e0 END
    + coalesce(TRY_CAST(regexp_extract(coalesce(text, ''), '\\+(\\d+)', 1) AS DOUBLE) * 1e-1, 0e0)
    + CASE WHEN confidence > 8e-1 THEN 5e-1 ELSE 0e0 END
    + CASE WHEN regexp_matches(lower(coalesce(text, '')), 'squad|wipe') THEN 15e-1 ELSE 0e0 END
    + CASE WHEN regexp_matches(lower(coalesce(text, '')), 'eliminated|elimination') THEN 1e0 ELSE 0e0 END END AS score
FROM (SELECT *, {COMBAT_SQL} AS combat FROM ev)""",
    "ev",
)
view(
    "seg_ev",
    """SELECT *, CAST(1 + sum(brk) OVER (PARTITION BY source_id ORDER BY timestamp_s, event_id) AS BIGINT) AS segment_id
FROM (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER w >=
    CASE WHEN label = 'audio_combat_spike' OR lag(label) OVER w = 'audio_combat_spike' THEN 60 ELSE 30 END THEN 1 ELSE 0 END AS brk
  FROM sev WINDOW w AS (PARTITION BY source_id ORDER BY timestamp_s, event_id))""",
    "sev",
)
view(
    "burst",
    """SELECT source_id, bi AS burst_ix, min(timestamp_s) AS start, max(timestamp_s) AS "end", count(*) AS elim_count
FROM (SELECT *, CAST(sum(brk) OVER (PARTITION BY source_id ORDER BY timestamp_s, event_id) AS BIGINT) AS bi
  FROM (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER (PARTITION BY source_id ORDER BY timestamp_s, event_id) <= 30 THEN 0
      WHEN lag(timestamp_s) OVER (PARTITION BY source_id ORDER BY timestamp_s, event_id) IS NULL THEN 0 ELSE 1 END AS brk
    FROM ev WHERE label = 'ELIMINATED Text'))
GROUP BY source_id, bi""",
    "ev",
)
view(
    "looked",
    """SELECT b.source_id, b.burst_ix, any_value(b.start) AS start, any_value(b."end") AS "end", any_value(b.elim_count) AS elim_count,
  min(CASE WHEN a.timestamp_s BETWEEN b.start - 30 AND b.start THEN a.timestamp_s END) AS spike_before,
  max(CASE WHEN a.timestamp_s BETWEEN b."end" AND b."end" + 30 THEN a.timestamp_s END) AS spike_after
FROM burst b LEFT JOIN au a ON a.source_id = b.source_id AND a.timestamp_s BETWEEN b.start - 30 AND b."end" + 30
GROUP BY b.source_id, b.burst_ix""",
    "burst", "au",
)
view(
    "raw_clip",
    """SELECT l.source_id, l.burst_ix, any_value('elim_' || CAST(floor(l.start) AS BIGINT)) AS clip_id,
  any_value(round(l.rs, 2)) AS start_time, any_value(round(l.re, 2)) AS end_time, any_value(l.elim_count) AS elim_count,
  count(e.event_id) AS event_count, round(coalesce(sum(e.score), 0e0), 3) AS intensity_score
FROM (SELECT *, greatest(0e0, coalesce(spike_before, start - 20)) AS rs, coalesce(spike_after + 5, "end" + 10) AS re FROM looked) l
LEFT JOIN sev e ON e.source_id = l.source_id AND e.timestamp_s BETWEEN l.rs AND l.re
GROUP BY l.source_id, l.burst_ix""",
    "looked", "sev",
)
view(
    "anchored",
    """SELECT source_id, ci AS clip_ix, arg_min(clip_id, burst_ix) AS clip_id, min(start_time) AS start_time, max(end_time) AS end_time,
  round(max(end_time) - min(start_time), 2) AS duration, CAST(sum(elim_count) AS BIGINT) AS elim_count, count(*) AS n_bursts,
  CAST(sum(event_count) AS BIGINT) AS event_count, max(intensity_score) AS intensity_score
FROM (SELECT *, CAST(sum(brk) OVER (PARTITION BY source_id ORDER BY start_time, burst_ix) AS BIGINT) AS ci
  FROM (SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY source_id ORDER BY start_time, burst_ix
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60 THEN 0
      WHEN row_number() OVER (PARTITION BY source_id ORDER BY start_time, burst_ix) = 1 THEN 0 ELSE 1 END AS brk FROM raw_clip))
GROUP BY source_id, ci""",
    "raw_clip",
)

# ---------------------------------------------------------------- window and sequence operators


@query(
    "w01_gap_split",
    sql(
        """SELECT source_id, segment_id, min(timestamp_s) AS start, max(timestamp_s) AS "end", count(*) AS n_events
FROM seg_ev GROUP BY source_id, segment_id""",
        "seg_ev",
    ),
)
def w01(spark, sf):
    return intervals.gap_segments(S.events(spark, sf)).withColumn("n_events", F.col("n_events").cast("bigint"))


@query("w01_event_segments", sql("SELECT event_id, segment_id FROM seg_ev", "seg_ev"))
def w01_events(spark, sf):
    ev = S.events(spark, sf).select("source_id", "event_id", "timestamp_s", "label")
    return intervals.assign_segments(ev, intervals.gap_segments(ev), salt=4).select("event_id", "segment_id")


@query("w02_bursts", sql("SELECT * FROM burst", "burst"))
def w02(spark, sf):
    return intervals.bursts(S.events(spark, sf)).withColumn("elim_count", F.col("elim_count").cast("bigint"))


_CHAIN = """rk AS (SELECT *, row_number() OVER w AS ix FROM seg_ev
  WINDOW w AS (PARTITION BY source_id, segment_id ORDER BY timestamp_s, event_id)),
nx AS (SELECT *, max(ix) OVER (PARTITION BY source_id, segment_id ORDER BY timestamp_s RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS last_ix FROM rk),
tg AS (SELECT *, last_ix - ix + 1 AS n_window, ix + greatest(1, (last_ix - ix + 1) // 2) AS try_ix FROM nx
  WHERE label IN ('Victory', 'ELIMINATED Text', 'Floating Damage Numbers', 'loating Damage Numbers', 'Directional Damage Indicators', 'audio_combat_spike')),
ptr AS (SELECT a.source_id, a.segment_id, a.ix, min(b.ix) AS nxt FROM tg a LEFT JOIN tg b
  ON b.source_id = a.source_id AND b.segment_id = a.segment_id AND b.ix >= a.try_ix GROUP BY ALL),
vis AS (SELECT source_id, segment_id, min(ix) AS ix FROM tg GROUP BY ALL
  UNION ALL SELECT p.source_id, p.segment_id, p.nxt FROM vis v JOIN ptr p
    ON p.source_id = v.source_id AND p.segment_id = v.segment_id AND p.ix = v.ix WHERE p.nxt IS NOT NULL),
win AS (SELECT t.* FROM tg t SEMI JOIN vis v ON v.source_id = t.source_id AND v.segment_id = t.segment_id AND v.ix = t.ix)"""


@query(
    "w03_trigger_windows",
    sql(
        """SELECT source_id, segment_id, event_id, ix AS row_ix, last_ix, n_window, timestamp_s AS window_start FROM win""",
        "seg_ev", recursive=True, ctes=_CHAIN,
    ),
)
def w03(spark, sf):
    ranked = highlights.segmented_events(S.events(spark, sf))
    return chains.trigger_windows(ranked)


_WIN_AGG = _CHAIN + """,
tot AS (SELECT w.source_id, w.segment_id, w.ix AS row_ix, w.timestamp_s AS window_start, w.last_ix, count(*) AS event_count,
    sum(e.score) AS intensity_score, CAST(count_if(e.combat) AS BIGINT) AS combat_events, bool_or(e.visual) AS has_visual, bool_or(e.audio) AS has_audio,
    max(e.timestamp_s) AS last_t, max(e.timestamp_s) + 5 AS window_end
  FROM win w JOIN rk e ON e.source_id = w.source_id AND e.segment_id = w.segment_id AND e.ix BETWEEN w.ix AND w.last_ix GROUP BY ALL),
kept AS (SELECT * FROM tot WHERE intensity_score >= 3 - 1e-9 AND has_visual AND has_audio),
near AS (SELECT *, sum(brk) OVER (PARTITION BY source_id, segment_id ORDER BY window_start, row_ix) AS part_ix FROM (
  SELECT *, CASE WHEN window_start - lag(window_end) OVER w <= 30 THEN 0 WHEN lag(window_end) OVER w IS NULL THEN 0 ELSE 1 END AS brk
  FROM kept WINDOW w AS (PARTITION BY source_id, segment_id ORDER BY window_start, row_ix)))"""


@query(
    "w04_near_windows",
    sql(
        """SELECT source_id, segment_id, CAST(part_ix AS BIGINT) AS part_ix, min(window_start) AS start, max(window_end) AS "end", count(*) AS n_windows
FROM near GROUP BY source_id, segment_id, part_ix""",
        "seg_ev", recursive=True, ctes=_WIN_AGG,
    ),
)
def w04(spark, sf):
    # read five times below, as in sliding_clips: written once
    ranked = cut_lineage(highlights.segmented_events(S.events(spark, sf)))
    _, _, totals = highlights.window_candidates(ranked)
    return highlights.near_windows(cut_lineage(highlights.accepted_windows(totals))).select(
        "source_id", "segment_id", "part_ix", "start", "end", F.col("n_windows").cast("bigint").alias("n_windows")
    )


_SLIDING = _WIN_AGG + """,
mem AS (SELECT DISTINCT n.source_id, n.segment_id, n.part_ix, e.event_id, e.timestamp_s, e.label, e.text, e.score, e.combat
  FROM near n JOIN rk e ON e.source_id = n.source_id AND e.segment_id = n.segment_id AND e.ix BETWEEN n.row_ix AND n.last_ix),
clip AS (SELECT source_id, segment_id, part_ix, min(window_start) AS start_time, max(window_end) AS end_time, count(*) AS n_windows,
    arg_min(window_end, row_ix) AS w1_end, arg_min(last_t, row_ix) AS w1_last, arg_min(combat_events, row_ix) AS w1_combat
  FROM near GROUP BY ALL),
memr AS (SELECT m.*, c.n_windows, row_number() OVER (PARTITION BY m.source_id, m.segment_id, m.part_ix, m.timestamp_s, m.label, m.text ORDER BY m.event_id) AS rn
  FROM mem m JOIN clip c USING (source_id, segment_id, part_ix)),
prof AS (SELECT source_id, segment_id, part_ix, count(*) AS event_count, CAST(count_if(combat) AS BIGINT) AS combat_all, sum(score) AS intensity_score,
    list_sort(list(DISTINCT label)) AS labels, min(timestamp_s) AS first_t, max(timestamp_s) AS last_t
  FROM memr WHERE n_windows = 1 OR rn = 1 GROUP BY ALL),
segn AS (SELECT source_id, segment_id, count(*) AS segment_events FROM seg_ev GROUP BY ALL),
slide AS (SELECT c.*, p.event_count, p.combat_all, p.intensity_score, p.labels, p.first_t, p.last_t, s.segment_events,
    row_number() OVER (PARTITION BY source_id ORDER BY start_time) - 1 AS clip_ix
  FROM clip c JOIN prof p USING (source_id, segment_id, part_ix) JOIN segn s USING (source_id, segment_id))"""


@query(
    "e01_sliding_clips",
    sql(
        """SELECT source_id, clip_ix, start_time, end_time, round(end_time - start_time, 6) AS duration, event_count, combat_all AS combat_events, labels,
  round(intensity_score, 6) AS intensity_score, first_t AS buildup_start, last_t + 10 AS celebration_end,
  round(first_t - start_time, 6) AS buildup_duration, round(end_time - first_t, 6) AS action_duration,
  round(last_t + 10 - end_time, 6) AS celebration_duration, segment_id, segment_events FROM slide""",
        "seg_ev", recursive=True, ctes=_SLIDING,
    ),
)
def e01(spark, sf):
    out = highlights.sliding_clips(S.events(spark, sf))
    return _clip_columns(out)


def _clip_columns(out):
    return out.select(
        "source_id", "clip_ix", "start_time", "end_time", F.round("duration", 6).alias("duration"), "event_count",
        "combat_events", "labels", F.round("intensity_score", 6).alias("intensity_score"), "buildup_start", "celebration_end",
        F.round("story_arc.buildup_duration", 6).alias("buildup_duration"),
        F.round("story_arc.action_duration", 6).alias("action_duration"),
        F.round("story_arc.celebration_duration", 6).alias("celebration_duration"),
        "segment_id", F.col("segment_events").cast("bigint").alias("segment_events"),
    )


@query(
    "e01_sliding_clips_compat",
    sql(
        """SELECT source_id, clip_ix, start_time, end_time, round(w1_end - start_time, 6) AS duration, event_count, w1_combat AS combat_events, labels,
  round(intensity_score, 6) AS intensity_score, first_t AS buildup_start, w1_last + 10 AS celebration_end,
  round(first_t - start_time, 6) AS buildup_duration, round(w1_end - first_t, 6) AS action_duration,
  round(w1_last + 10 - w1_end, 6) AS celebration_duration, segment_id, segment_events FROM slide""",
        "seg_ev", recursive=True, ctes=_SLIDING,
    ),
)
def e01_compat(spark, sf):
    return _clip_columns(highlights.sliding_clips(S.events(spark, sf), compat=True))


@query(
    "w05_scan_windows",
    sql(
        """SELECT source_id, CAST(wi AS BIGINT) AS window_ix, greatest(0e0, min(s)) AS start, max(e) AS "end", count(*) AS n_points
FROM (SELECT *, sum(brk) OVER (PARTITION BY source_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS wi FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0
    WHEN row_number() OVER (PARTITION BY source_id ORDER BY s) = 1 THEN 0 ELSE 1 END AS brk
  FROM (SELECT source_id, timestamp_s - 15 AS s, timestamp_s + 15 AS e FROM au)))
GROUP BY source_id, wi""",
        "au",
    ),
)
def w05(spark, sf):
    return intervals.scan_windows(S.audio(spark, sf)).withColumn("n_points", F.col("n_points").cast("bigint"))


@query(
    "w06_merge_with_slack",
    sql(
        """SELECT source_id, CAST(gi AS BIGINT) AS group_ix, min(start) AS start, max("end") AS "end", count(*) AS n, max(score) AS best
FROM (SELECT *, sum(brk) OVER (PARTITION BY source_id ORDER BY start, id) AS gi FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY source_id ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 THEN 0
    WHEN row_number() OVER (PARTITION BY source_id ORDER BY start, id) = 1 THEN 0 ELSE 1 END AS brk FROM iv))
GROUP BY source_id, gi""",
        "iv",
    ),
)
def w06(spark, sf):
    return intervals.merge_intervals(
        S.intervals(spark, sf), {"n": intervals.count(), "best": intervals.highest(F.col("score"))},
        slack_s=20.0, start="start", end="end", tie=["id"], number="group_ix",
    ).withColumn("n", F.col("n").cast("bigint"))


@query(
    "w11_deoverlap",
    sql(
        """SELECT source_id, clip_id, round(coalesce(ns, s0), 6) AS new_start, ns IS NOT NULL AS adjusted, coalesce(ns, s0) < e0 AS valid
FROM (SELECT n.source_id, n.clip_id, n.s0, n.e0, (SELECT arg_min(f.e0, f.ord) FROM o f WHERE f.source_id = n.source_id AND f.ord < n.ord
    AND f.e0 > n.s0) + 1 AS ns FROM o n)""",
        "cp",
        ctes="""o AS (SELECT source_id, clip_id, greatest(0e0, start_time - 20) AS s0, end_time + 20 AS e0,
  row_number() OVER (PARTITION BY source_id ORDER BY start_time, clip_id) AS ord FROM cp)""",
    ),
)
def w11(spark, sf):
    cp = S.clips(spark, sf).select(
        "source_id", "clip_id", "start_time",
        F.greatest(F.lit(0.0), F.col("start_time") - 20).alias("start"), (F.col("end_time") + 20).alias("end"),
    )
    out = conflicts.deoverlap(cp)
    return out.select("source_id", "clip_id", F.round("new_start", 6).alias("new_start"), "adjusted", "valid")


_NMS = """
cand AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS rk FROM iv),
cf AS (SELECT a.source_id, a.rk, list(b.rk) AS better FROM cand a JOIN cand b ON a.source_id = b.source_id AND b.rk < a.rk
    AND b.start < a."end" AND a.start < b."end"
  WHERE (least(a."end", b."end") - greatest(a.start, b.start)) /
    ((a."end" - a.start) + (b."end" - b.start) - (least(a."end", b."end") - greatest(a.start, b.start))) > 0.5e0 GROUP BY ALL),
walk AS (SELECT source_id, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT source_id FROM cand)
  UNION ALL
  SELECT w.source_id, c.rk, CASE WHEN len(list_intersect(w.kept, coalesce(cf.better, []))) > 0 THEN w.kept ELSE list_append(w.kept, c.rk) END
  FROM walk w JOIN cand c ON c.source_id = w.source_id AND c.rk = w.rk + 1 LEFT JOIN cf ON cf.source_id = c.source_id AND cf.rk = c.rk),
fin AS (SELECT source_id, unnest(arg_max(kept, rk)) AS rk FROM walk GROUP BY source_id)"""


@query(
    "w12_suppress_overlaps",
    sql(
        """SELECT c.source_id, c.id, c.score FROM cand c JOIN fin f ON f.source_id = c.source_id AND f.rk = c.rk""",
        "iv", recursive=True, ctes=_NMS,
    ),
)
def w12(spark, sf):
    return conflicts.suppress_overlaps(S.intervals(spark, sf), threshold=0.5).select("source_id", "id", "score")


@query(
    "w10_chapters",
    sql(
        """SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY s) - 1 AS chapter_ix, s AS start, e AS "end"
FROM (SELECT source_id, s, e FROM walk WHERE emit AND s < e
  UNION ALL SELECT source_id, arg_max(cur, ix), arg_max("end", ix) FROM walk GROUP BY source_id HAVING arg_max("end", ix) - arg_max(cur, ix) > 10)""",
        "tr", "sc", recursive=True,
        ctes="""ln AS (SELECT source_id, ix, start, "end", coalesce(lag("end") OVER (PARTITION BY source_id ORDER BY ix), 0e0) AS last_end FROM tr),
fl AS (SELECT l.*, (l.start - l.last_end >= 2 AND l.last_end > 0) OR EXISTS (SELECT 1 FROM sc WHERE sc.source_id = l.source_id
    AND sc.t BETWEEN l.last_end - 1 AND l.start + 1) AS cut FROM ln l),
walk AS (SELECT source_id, ix, "end", start AS cur, false AS emit, 0e0 AS s, 0e0 AS e, 0 AS n FROM fl WHERE ix = 0
  UNION ALL
  SELECT f.source_id, f.ix, f."end",
    CASE WHEN g.hit THEN f.start ELSE g.c0 END, g.hit, g.c0, f.last_end, w.n + CASE WHEN g.hit THEN 1 ELSE 0 END
  FROM walk w JOIN fl f ON f.source_id = w.source_id AND f.ix = w.ix + 1,
  LATERAL (SELECT CASE WHEN w.cur = 0 AND w.n = 0 THEN f.start ELSE w.cur END AS c0) c,
  LATERAL (SELECT c.c0 AS c0, (f.cut OR f."end" - c.c0 >= 180) AND f.last_end - c.c0 >= 45 AS hit) g)""",
    ),
)
def w10(spark, sf):
    return chains.chapters(S.transcript(spark, sf), S.screen(spark, sf))


@query("w13_changed_texts")
def w13(spark, sf):
    return conflicts.changed_texts(S.screen(spark, sf)).select("source_id", "event_id", "t", "text")


@query(
    "w13_changed_texts_native",
    sql(
        "SELECT source_id, event_id, t, text FROM walk WHERE kept",
        "sc", recursive=True,
        ctes="""nu AS (SELECT source_id, event_id, t, text, trim(text) AS x, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS n FROM sc WHERE length(trim(text)) > 4),
walk AS (SELECT source_id, event_id, t, text, n, x AS last, true AS kept FROM nu WHERE n = 1
  UNION ALL
  SELECT u.source_id, u.event_id, u.t, u.text, u.n, CASE WHEN g.k THEN u.x ELSE w.last END, g.k
  FROM walk w JOIN nu u ON u.source_id = w.source_id AND u.n = w.n + 1,
  LATERAL (SELECT 1 - levenshtein(w.last, u.x) / CAST(greatest(length(w.last), length(u.x)) AS DOUBLE) < 8e-1 AS k) g)""",
    ),
)
def w13_native(spark, sf):
    return conflicts.changed_texts(S.screen(spark, sf), fuzzy=False).select("source_id", "event_id", "t", "text")


@query(
    "w14_numbering",
    sql(
        """SELECT source_id, event_id, row_number() OVER (PARTITION BY source_id ORDER BY timestamp_s, event_id) AS n,
  count(*) OVER (PARTITION BY source_id, segment_id) AS segment_events FROM seg_ev""",
        "seg_ev",
    ),
)
def w14(spark, sf):
    ev = S.events(spark, sf).select("source_id", "event_id", "timestamp_s", "label")
    placed = intervals.assign_segments(ev, intervals.gap_segments(ev))
    return select.numbered(placed, ["timestamp_s", "event_id"], pos="timestamp_s").select(
        "source_id", "event_id", "n", F.col("segment_events").cast("bigint").alias("segment_events")
    )


@query(
    "w15_batches",
    sql(
        """SELECT source_id, batch_ix, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (
SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY timestamp_s, event_id) - 1) // 15 AS batch_ix FROM ev)
GROUP BY source_id, batch_ix""",
        "ev",
    ),
)
def w15(spark, sf):
    ev = S.events(spark, sf).select("source_id", "event_id", "timestamp_s")
    out = select.batches(ev, 15, ["timestamp_s", "event_id"], pos="timestamp_s")
    return out.groupBy("source_id", "batch_ix").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "w17_last_kept",
    sql(
        """SELECT event_id, last_value(CASE WHEN confidence >= 0.5e0 THEN text END IGNORE NULLS) OVER
  (PARTITION BY source_id ORDER BY timestamp_s, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM ev""",
        "ev",
    ),
)
def w17(spark, sf):
    ev = S.events(spark, sf).select("source_id", "event_id", "timestamp_s", "confidence", "text")
    good = F.when(F.col("confidence") >= 0.5, F.col("text"))
    out = scan(
        ev, ["source_id"], ["timestamp_s", "event_id"], {"filled": last_value(good)}, pos="timestamp_s", width=600.0
    )
    return out.select("event_id", "filled")


# ---------------------------------------------------------------- range joins


@query(
    "j01_events_in_clips",
    sql(
        "SELECT c.clip_id, e.event_id FROM cp c JOIN ev e ON e.source_id = c.source_id AND e.timestamp_s BETWEEN c.start_time AND c.end_time",
        "cp", "ev",
    ),
)
def j01(spark, sf):
    ev = S.events(spark, sf).select("source_id", "event_id", "timestamp_s")
    cp = S.clips(spark, sf).select("source_id", "clip_id", "start_time", "end_time")
    return rangejoin.points_in_intervals(
        ev, cp, t="timestamp_s", start="start_time", end="end_time", width=120.0, salt=4, salt_by=["event_id"]
    ).select("clip_id", "event_id")


def _looked(spark, sf):
    return rangejoin.nearest_spikes(
        intervals.bursts(S.events(spark, sf)), S.audio(spark, sf), start="start", end="end",
        spike_t="timestamp_s", lookback=30.0, lookahead=30.0,
    )


@query(
    "j02_lookback",
    sql(
        "SELECT source_id, burst_ix, greatest(0e0, coalesce(spike_before, start - 20)) AS clip_start FROM looked", "looked"
    ),
)
def j02(spark, sf):
    return _looked(spark, sf).select(
        "source_id", "burst_ix", F.greatest(F.lit(0.0), F.coalesce("spike_before", F.col("start") - 20)).alias("clip_start")
    )


@query(
    "j03_lookahead",
    sql("""SELECT source_id, burst_ix, coalesce(spike_after + 5, "end" + 10) AS clip_end FROM looked""", "looked"),
)
def j03(spark, sf):
    return _looked(spark, sf).select(
        "source_id", "burst_ix", F.coalesce(F.col("spike_after") + 5, F.col("end") + 10).alias("clip_end")
    )


@query(
    "j07_scene_overlap",
    sql(
        """SELECT c.clip_id, s.scene_ix FROM cp c JOIN scn s ON s.source_id = c.source_id
  AND s.end_seconds > c.start_time AND s.start_seconds < c.end_time""",
        "cp", "scn",
    ),
)
def j07(spark, sf):
    return rangejoin.overlaps(
        S.clips(spark, sf), S.scenes(spark, sf), left_span=("start_time", "end_time"),
        right_span=("start_seconds", "end_seconds"), width=120.0,
    ).select("clip_id", F.col("r_scene_ix").alias("scene_ix"))


@query(
    "j09_frame_scene",
    sql(
        """SELECT e.event_id, s.scene_ix FROM (SELECT source_id, event_id, timestamp_s, CAST(floor(timestamp_s * 30) AS BIGINT) + 7 AS f FROM ev) e
ASOF LEFT JOIN (SELECT source_id, start_frame, max(scene_ix) AS scene_ix FROM scn GROUP BY ALL) s ON e.source_id = s.source_id AND e.f >= s.start_frame""",
        "ev", "scn",
    ),
)
def j09(spark, sf):
    frames = S.events(spark, sf).select(
        "source_id", "event_id", (F.floor(F.col("timestamp_s") * 30) + 7).cast("bigint").alias("f")
    )
    marks = S.scenes(spark, sf).groupBy("source_id", "start_frame").agg(F.max("scene_ix").alias("scene_ix"))
    return rangejoin.asof_last(
        frames, marks, pos="f", mark_pos="start_frame", value=F.col("scene_ix"), name="scene_ix", tie="event_id",
        width=18000.0,
    ).select("event_id", "scene_ix")


@query(
    "j12_prune_frame_table",
    sql(
        """SELECT source_id, event_id, frame FROM (SELECT source_id, event_id, CAST(floor(timestamp_s * 30) AS BIGINT) - CAST(floor(timestamp_s * 30) AS BIGINT) % 30 AS frame FROM ev) f
WHERE source_id NOT IN (SELECT source_id FROM au) OR EXISTS (SELECT 1 FROM au WHERE au.source_id = f.source_id
  AND frame >= CAST(floor(greatest(0e0, timestamp_s - 15) * 30) AS BIGINT) // 30 * 30 AND frame < CAST(floor((timestamp_s + 15) * 30) AS BIGINT))""",
        "ev", "au",
    ),
)
def j12_table(spark, sf):
    """Detections of a frame table, kept where the frame is sampled around a spike."""
    from tidemark.plans.detection import prune_frames

    at = F.floor(F.col("timestamp_s") * 30).cast("bigint")
    frames = S.events(spark, sf).select("source_id", "event_id", (at - at % 30).alias("frame"))
    return prune_frames(frames, intervals.scan_windows(S.audio(spark, sf)))


@query(
    "j12_prune_frames",
    sql(
        """SELECT DISTINCT source_id, f AS frame FROM (SELECT source_id,
  unnest(range(CAST(floor(s * 30) AS BIGINT) - CAST(floor(s * 30) AS BIGINT) % 30, CAST(floor(e * 30) AS BIGINT), 30)) AS f
  FROM (SELECT source_id, greatest(0e0, timestamp_s - 15) AS s, timestamp_s + 15 AS e FROM au))""",
        "au",
    ),
)
def j12(spark, sf):
    from tidemark.plans.detection import window_frames

    windows = intervals.scan_windows(S.audio(spark, sf))
    return window_frames(windows, fps=30.0, interval_s=1.0, total_frames=10**9)


@query(
    "j16_conflicts",
    sql(
        """SELECT a.id, b.id AS r_id, round(x / ((a."end" - a.start) + (b."end" - b.start) - x), 6) AS iou FROM iv a JOIN iv b
  ON a.source_id = b.source_id AND a.id < b.id AND a.start < b."end" AND b.start < a."end",
  LATERAL (SELECT least(a."end", b."end") - greatest(a.start, b.start) AS x) WHERE x / ((a."end" - a.start) + (b."end" - b.start) - x) > 0.5e0""",
        "iv",
    ),
)
def j16(spark, sf):
    return conflicts.conflicting_pairs(S.intervals(spark, sf), threshold=0.5).select("id", "r_id", F.round("iou", 6).alias("iou"))


@query(
    "j17_overlaps_earlier",
    sql(
        """SELECT id, coalesce(max("end") OVER (PARTITION BY source_id ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start, false) AS overlaps_earlier FROM iv""",
        "iv",
    ),
)
def j17(spark, sf):
    return conflicts.overlaps_earlier(S.intervals(spark, sf)).select("id", "overlaps_earlier")


@query(
    "j18_scanned_time",
    sql(
        """SELECT source_id, count(*) AS windows, round(sum("end" - start), 6) AS scanned_s FROM (
SELECT source_id, greatest(0e0, min(s)) AS start, max(e) AS "end"
FROM (SELECT *, sum(brk) OVER (PARTITION BY source_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS wi FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk
  FROM (SELECT source_id, timestamp_s - 15 AS s, timestamp_s + 15 AS e FROM au)))
GROUP BY source_id, wi) GROUP BY source_id""",
        "au",
    ),
)
def j18(spark, sf):
    return intervals.scan_windows(S.audio(spark, sf)).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("scanned_s")
    )


# ---------------------------------------------------------------- clips


@query(
    "a03_burst_profile",
    sql("SELECT source_id, burst_ix, clip_id, start_time, end_time, elim_count, event_count, intensity_score FROM raw_clip", "raw_clip"),
)
def a03(spark, sf):
    ev = S.events(spark, sf)
    return highlights.anchored_raw_clips(ev, S.audio(spark, sf)).select(
        "source_id", "burst_ix", "clip_id", "start_time", "end_time", F.col("elim_count").cast("bigint").alias("elim_count"),
        F.col("event_count").cast("bigint").alias("event_count"), "intensity_score",
    )


@query("e02_anchored_clips", sql("SELECT * FROM anchored", "anchored"))
def e02(spark, sf):
    out = highlights.anchored_clips(S.events(spark, sf), S.audio(spark, sf))
    return out.drop("audio_anchored").withColumns(
        {c: F.col(c).cast("bigint") for c in ("elim_count", "n_bursts", "event_count")}
    )


@query(
    "e02_highlight_clips",
    sql(
        """SELECT source_id, start_time, end_time, round(duration, 6) AS duration, event_count, round(intensity_score, 6) AS intensity_score, 'anchored' AS origin FROM anchored
UNION ALL SELECT source_id, start_time, end_time, round(end_time - start_time, 6), event_count, round(intensity_score, 6), 'sliding' FROM slide
WHERE source_id NOT IN (SELECT source_id FROM au) OR source_id NOT IN (SELECT source_id FROM ev WHERE label = 'ELIMINATED Text')""",
        "seg_ev", "anchored", "au", "ev", recursive=True, ctes=_SLIDING,
    ),
)
def e02_highlights(spark, sf):
    """Clips of every source by the mode that it allows."""
    out = highlights.highlight_clips(S.events(spark, sf), S.audio(spark, sf))
    return out.withColumns({
        "event_count": F.col("event_count").cast("bigint"), "duration": F.round("duration", 6), "intensity_score": F.round("intensity_score", 6),
    })


@query(
    "e12_render_list",
    sql(
        """SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_time, clip_id) AS file_ix, start_time AS start, end_time AS "end",
  'clip_' || row_number() OVER (PARTITION BY source_id ORDER BY start_time, clip_id) || '.mp4' AS file_name, clip_id AS title FROM anchored""",
        "anchored",
    ),
)
def e12(spark, sf):
    return highlights.render_list(highlights.anchored_clips(S.events(spark, sf), S.audio(spark, sf)))


__all__ = ["is_combat", "row_number", "running_max", "running_sum"]
