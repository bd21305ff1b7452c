"""Queries on filters, aggregates, signals and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import samples as S
from tidemark.catalog import timeline as _shared_views  # noqa: F401  (registers the views used below)
from tidemark.catalog.registry import query, sql, view
from tidemark.functions.scoring import intensity, is_combat
from tidemark.operators import intervals, rangejoin, select, signal
from tidemark.operators.scan import bin_of
from tidemark.plans import detection, highlights, pacing

# ---------------------------------------------------------------- filters

_KEYS = """(VALUES ('Victory', 'you are the champion', 3e0), ('Victory', 'champion', 2e0), ('Victory', 'victory', 2e0), ('Victory', 'win', 1e0),
  ('ELIMINATED Text', 'squad', 3e0), ('ELIMINATED Text', 'eliminated', 2e0), ('ELIMINATED Text', 'wipe', 25e-1), ('ELIMINATED Text', 'match summary', 1e0),
  ('ELIMINATED Text', 'game over', 1e0), ('Combat Feed / Kill Feed Updates', 'you are the champion', 5e0), ('Combat Feed / Kill Feed Updates', 'squad eliminated', 4e0),
  ('Combat Feed / Kill Feed Updates', 'champion eliminated', 3e0), ('Combat Feed / Kill Feed Updates', 'eliminated', 2e0), ('Combat Feed / Kill Feed Updates', 'knocked down', 2e0),
  ('Combat Feed / Kill Feed Updates', 'assist', 15e-1)) AS kw(label, keyword, weight)"""
view(
    "exact",
    f"""SELECT event_id, sum(weight) AS score FROM ev JOIN {_KEYS} USING (label) WHERE trim(coalesce(text, '')) <> '' AND contains(lower(text), keyword) GROUP BY event_id
UNION ALL SELECT event_id, 1e0 FROM ev WHERE label IN ('Floating Damage Numbers', 'loating Damage Numbers') AND regexp_matches(text, '\\d')""",
    "ev",
)


@query("f01_allowed", sql("SELECT event_id FROM ev WHERE confidence >= 0.5e0 AND label IN ('ELIMINATED Text', 'audio_combat_spike')", "ev"))
def f01(spark, sf):
    return detection.allowed(S.events(spark, sf), labels=("ELIMINATED Text", "audio_combat_spike")).select("event_id")


@query("f02_exact_text_score", sql("SELECT event_id, score FROM exact", "exact"))
def f02(spark, sf):
    return detection.exact_text_score(S.events(spark, sf), detection.keyword_table(spark))


@query("f02_validate_text")
def f02_fuzzy(spark, sf):
    return detection.validate_text(S.events(spark, sf), detection.keyword_table(spark)).select(
        "event_id", F.round("score", 6).alias("score")
    )


_EDIT = "(1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE))"


@query(
    "f02_validate_text_native",
    sql(
        f"""SELECT event_id, round(sum(score), 6) AS score FROM (
SELECT event_id, weight AS score FROM pr WHERE contains(low, keyword)
UNION ALL SELECT event_id, arg_min(r, pos) * any_value(weight) FROM (
  SELECT *, {_EDIT.format(a="keyword", b="word")} AS r FROM (
    SELECT event_id, keyword, weight, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT *, string_split_regex(trim(low), '\\s+') AS w FROM pr WHERE NOT contains(low, keyword) AND NOT contains(keyword, ' ')))
  WHERE word <> '') WHERE r > 8e-1 GROUP BY event_id, keyword
UNION ALL SELECT event_id, {_EDIT.format(a="keyword", b="low")} * weight FROM pr
  WHERE NOT contains(low, keyword) AND contains(keyword, ' ') AND {_EDIT.format(a="keyword", b="low")} > 6e-1
UNION ALL SELECT event_id, 1e0 FROM ev WHERE label IN ('Floating Damage Numbers', 'loating Damage Numbers') AND regexp_matches(text, '\\d'))
GROUP BY event_id HAVING sum(score) > 0""",
        "ev",
        ctes=f"""pr AS (SELECT event_id, lower(text) AS low, keyword, weight FROM ev JOIN {_KEYS} USING (label)
  WHERE trim(coalesce(text, '')) <> '' AND label NOT IN ('Floating Damage Numbers', 'loating Damage Numbers'))""",
    ),
)
def f02_native(spark, sf):
    return detection.validate_text(S.events(spark, sf), detection.keyword_table(spark), fuzzy=False).select(
        "event_id", F.round("score", 6).alias("score")
    )


@query(
    "f03_keep_readable",
    sql(
        """SELECT event_id, CASE WHEN ex THEN '[Visual Indicator]' WHEN blank THEN '[Unreadable text]' ELSE text END AS text FROM (
SELECT e.*, label IN ('Directional Damage Indicators', 'loating Damage Numbers', 'Floating Damage Numbers') AS ex, trim(coalesce(text, '')) = '' AS blank, x.score IS NOT NULL AS ok
FROM ev e LEFT JOIN exact x USING (event_id)) WHERE ex OR confidence >= 85e-2 OR (NOT blank AND ok)""",
        "exact",
    ),
)
def f03(spark, sf):
    ev = S.events(spark, sf)
    valid = detection.exact_text_score(ev, detection.keyword_table(spark))
    return detection.keep_readable(ev, valid).select("event_id", "text")


@query(
    "f07_trigger_labels",
    sql("SELECT event_id FROM ev WHERE label IN ('Victory', 'ELIMINATED Text', 'Floating Damage Numbers', 'loating Damage Numbers', 'Directional Damage Indicators', 'audio_combat_spike')", "ev"),
)
def f07(spark, sf):
    from tidemark.operators.chains import TRIGGER_LABELS

    return S.events(spark, sf).where(F.col("label").isin(*TRIGGER_LABELS)).select("event_id")


view(
    "sm",
    """SELECT *, sum(rms) OVER (PARTITION BY source_id ORDER BY ix RANGE BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS smoothed FROM pf""",
    "pf",
)
view(
    "loud",
    """SELECT DISTINCT c.source_id, c.chunk_ix FROM cl c LEFT JOIN sm ON sm.source_id = c.source_id AND sm.ix = c.chunk_ix * 2
JOIN (SELECT source_id, quantile_cont(smoothed, 0.7) AS gate FROM sm GROUP BY source_id) g ON g.source_id = c.source_id
WHERE sm.smoothed IS NULL OR sm.smoothed >= g.gate""",
    "sm", "cl",
)


@query("w07_moving_average", sql("SELECT source_id, ix, round(smoothed, 8) AS smoothed FROM sm", "sm"))
def w07(spark, sf):
    out = signal.moving_average(S.profile(spark, sf).select("source_id", "ix", "rms"), rows=signal.smooth_width(5.0, 1.0), width=512)
    return out.select("source_id", "ix", F.round("smoothed", 8).alias("smoothed"))


def _smoothed(spark, sf):
    return signal.moving_average(S.profile(spark, sf).select("source_id", "ix", "t", "rms"), rows=10, width=512)


@query(
    "a06_percentiles",
    sql(
        "SELECT source_id, round(quantile_cont(rms, 0.7), 8) AS p70, round(quantile_cont(rms, 0.3), 8) AS p30, round(quantile_cont(rms, 0.2), 8) AS p20 FROM pf GROUP BY source_id",
        "pf",
    ),
)
def a06(spark, sf):
    found = signal.exact_quantiles(S.profile(spark, sf), "rms", {"p70": 0.7, "p30": 0.3, "p20": 0.2})
    return found.select("source_id", *[F.round(c, 8).alias(c) for c in ("p70", "p30", "p20")])


@query("f09_quiet_gate", sql("SELECT source_id, chunk_ix FROM loud", "loud"))
def f09(spark, sf):
    chunks = S.chunk_labels(spark, sf).select("source_id", "chunk_ix").distinct().withColumn("t", F.col("chunk_ix") * 1.0)
    return signal.quiet_gate(chunks, _smoothed(spark, sf), chunk_s=1.0).select("source_id", "chunk_ix")


@query(
    "j10_chunk_slots",
    sql(
        "SELECT DISTINCT c.source_id, c.chunk_ix, round(sm.smoothed, 8) AS level FROM cl c LEFT JOIN sm ON sm.source_id = c.source_id AND sm.ix = c.chunk_ix * 2",
        "sm", "cl",
    ),
)
def j10(spark, sf):
    chunks = S.chunk_labels(spark, sf).select("source_id", "chunk_ix").distinct()
    slots = _smoothed(spark, sf).select("source_id", F.col("ix").alias("slot"), F.round("smoothed", 8).alias("level"))
    at = chunks.withColumn("slot", F.floor(F.col("chunk_ix") * 1.0 / 0.5).cast("bigint"))
    return at.join(slots, ["source_id", "slot"], "left").select("source_id", "chunk_ix", "level")


_COMBAT = "('Gunshot, gunfire', 'Explosion', 'Fusillade', 'Artillery fire', 'Machine gun', 'Breaking', 'Shatter', 'Smash, crash', 'Bang', 'Burst, pop')"


@query(
    "a07_chunk_scores",
    sql(
        f"""SELECT source_id, chunk_ix, round(least(sum(CASE WHEN label IN {_COMBAT} THEN score ELSE 0e0 END), 1e0), 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_ix ORDER BY score DESC, label) AS r FROM cl) WHERE r <= 5 GROUP BY source_id, chunk_ix""",
        "cl",
    ),
)
def a07(spark, sf):
    return signal.chunk_scores(S.chunk_labels(spark, sf), top=5).withColumn("score", F.round("score", 6))


@query(
    "f11_spike_threshold",
    sql(
        f"""SELECT source_id, chunk_ix, round(s, 4) AS score FROM (SELECT source_id, chunk_ix, least(sum(CASE WHEN label IN {_COMBAT} THEN score ELSE 0e0 END), 1e0) AS s
FROM cl GROUP BY source_id, chunk_ix) WHERE round(s, 6) >= 3e-1""",
        "cl",
    ),
)
def f11(spark, sf):
    s = signal.chunk_scores(S.chunk_labels(spark, sf))
    return s.where(F.round("score", 6) >= 0.30).select("source_id", "chunk_ix", F.round("score", 4).alias("score"))


@query(
    "e03_spike_events",
    sql(
        f"""SELECT source_id, round(chunk_ix * 1e0, 2) AS timestamp_s, 'audio_combat_spike' AS label, round(s, 4) AS score FROM (
SELECT source_id, chunk_ix, least(sum(CASE WHEN label IN {_COMBAT} THEN score ELSE 0e0 END), 1e0) AS s FROM cl SEMI JOIN loud USING (source_id, chunk_ix)
GROUP BY source_id, chunk_ix) WHERE s >= 3e-1""",
        "loud",
    ),
)
def e03(spark, sf):
    pf = S.profile(spark, sf).select("source_id", "ix", "rms")
    return pacing.spike_events(pf, S.chunk_labels(spark, sf), chunk_s=1.0)


@query(
    "f08_window_acceptance",
    sql(
        """SELECT c.clip_id, count(*) AS n FROM cp c JOIN sev e ON e.source_id = c.source_id AND e.timestamp_s BETWEEN c.start_time AND c.end_time
GROUP BY c.clip_id HAVING sum(e.score) >= 3 - 1e-9 AND bool_or(e.visual) AND bool_or(e.audio)""",
        "cp", "sev",
    ),
)
def f08(spark, sf):
    totals = _clip_totals(spark, sf).withColumn("intensity_score", F.round("intensity_score", 6))
    return highlights.accepted_windows(totals).select("clip_id", F.col("event_count").cast("bigint").alias("n"))


def _clip_totals(spark, sf):
    scored = highlights.scored_events(S.events(spark, sf))
    per_time = scored.groupBy("source_id", F.col("timestamp_s").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.bool_or("visual").alias("v"), F.bool_or("audio").alias("a")
    )
    inside = rangejoin.points_in_intervals(
        per_time, S.clips(spark, sf).select("source_id", "clip_id", "start_time", "end_time"),
        t="t", start="start_time", end="end_time", width=120.0,
    )
    return inside.groupBy("source_id", "clip_id").agg(
        F.sum("n").alias("event_count"), F.sum("score").alias("intensity_score"),
        F.bool_or("v").alias("has_visual"), F.bool_or("a").alias("has_audio"),
    )


@query(
    "f10_local_gate",
    sql(
        """SELECT clip_id, t, CASE WHEN rms < g THEN 0e0 ELSE score END AS gated FROM (SELECT c.clip_id, p.t, p.rms, p.score, quantile_cont(p.rms, 0.3) OVER (PARTITION BY c.clip_id) AS g
FROM cp c JOIN pf p ON p.source_id = c.source_id AND p.t BETWEEN c.start_time AND c.end_time)""",
        "cp", "pf",
    ),
)
def f10(spark, sf):
    return signal.local_gate(_in_clips(spark, sf)).select("clip_id", "t", F.col("gated_score").alias("gated"))


def _in_clips(spark, sf):
    cp = S.clips(spark, sf).select("source_id", "clip_id", "start_time", "end_time")
    return signal.in_ranges(S.profile(spark, sf), cp, start="start_time", end="end_time")


@query(
    "f12_anchor_filter",
    sql(
        "SELECT source_id, chapter_ix, anchor FROM (SELECT source_id, chapter_ix, CASE chapter_ix % 3 WHEN 0 THEN 'first four words exactly' WHEN 1 THEN '' ELSE reply END AS anchor FROM rp) WHERE anchor <> '' AND anchor NOT IN ('first four words exactly', 'last four words exactly')",
        "rp",
    ),
)
def f12(spark, sf):
    from tidemark.functions.text import has_anchor

    m = F.col("chapter_ix") % 3
    rp = S.replies(spark, sf).select(
        "source_id", "chapter_ix",
        F.when(m == 0, "first four words exactly").when(m == 1, "").otherwise(F.col("reply")).alias("anchor"),
    )
    return rp.where(has_anchor(F.col("anchor")))


# ---------------------------------------------------------------- aggregates


@query(
    "a01_clip_intensity",
    sql(
        "SELECT c.clip_id, count(*) AS event_count, round(sum(e.score), 6) AS intensity_score FROM cp c JOIN sev e ON e.source_id = c.source_id AND e.timestamp_s BETWEEN c.start_time AND c.end_time GROUP BY c.clip_id",
        "cp", "sev",
    ),
)
def a01(spark, sf):
    score = intensity(F.col("label"), F.col("confidence"), F.col("text"))
    points = intervals.time_points(S.events(spark, sf), score=F.sum(score))
    t = highlights.clip_intensity(points, S.clips(spark, sf), start="start_time", end="end_time", ident=["clip_id"])
    return t.select("clip_id", F.col("event_count").cast("bigint").alias("event_count"), F.round("intensity_score", 6).alias("intensity_score"))


@query(
    "a02_clip_profile",
    sql(
        """SELECT c.clip_id, count(*) AS event_count, CAST(count_if(e.combat) AS BIGINT) AS combat_events, list_sort(list(DISTINCT e.label)) AS labels, min(e.timestamp_s) AS buildup_start, max(e.timestamp_s) + 10 AS celebration_end
FROM cp c JOIN sev e ON e.source_id = c.source_id AND e.timestamp_s BETWEEN c.start_time AND c.end_time GROUP BY c.clip_id""",
        "cp", "sev",
    ),
)
def a02(spark, sf):
    ev = highlights.scored_events(S.events(spark, sf)).select("source_id", "event_id", "timestamp_s", "label", "combat")
    inside = rangejoin.points_in_intervals(
        ev, S.clips(spark, sf).select("source_id", "clip_id", "start_time", "end_time"),
        t="timestamp_s", start="start_time", end="end_time", width=120.0, salt=4, salt_by=["event_id"],
    )
    return inside.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if("combat").alias("combat_events"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.min("timestamp_s").alias("buildup_start"),
        (F.max("timestamp_s") + 10).alias("celebration_end"),
    )


@query(
    "a05_dedupe_events",
    sql("SELECT source_id, timestamp_s, label, text, count(*) AS copies FROM (SELECT source_id, timestamp_s, label, text FROM ev UNION ALL SELECT source_id, timestamp_s, label, text FROM ev WHERE value > 20) GROUP BY ALL", "ev"),
)
def a05(spark, sf):
    """Events of which some came twice, as parts of a merged clip do."""
    ev = S.events(spark, sf)
    return highlights.distinct_events(ev.union(ev.where(F.col("value") > 20)))


@query(
    "a12_lowest_dip",
    sql(
        "SELECT c.clip_id, arg_min(t, (r, t)) AS dip_t, min(r) AS dip_value FROM (SELECT c.clip_id, s.t, round(s.smoothed, 8) AS r FROM cp c JOIN sm s ON s.source_id = c.source_id AND s.t BETWEEN c.start_time AND c.end_time) c GROUP BY c.clip_id",
        "cp", "sm",
    ),
)
def a12(spark, sf):
    prof = _smoothed(spark, sf).withColumn("smoothed", F.round("smoothed", 8))
    return signal.lowest_dip(prof, S.clips(spark, sf), start="start_time", end="end_time").select("clip_id", "dip_t", "dip_value")


@query(
    "a13_peaks",
    sql(
        "SELECT c.clip_id, arg_max(p.t, (p.score, -p.t)) AS peak_t, max(p.score) AS peak_score FROM cp c JOIN pf p ON p.source_id = c.source_id AND p.t BETWEEN c.start_time AND c.end_time GROUP BY c.clip_id HAVING max(p.score) >= 1e-1",
        "cp", "pf",
    ),
)
def a13(spark, sf):
    return signal.peaks(_in_clips(spark, sf)).select("clip_id", "peak_t", "peak_score")


@query(
    "a14_last_anchor",
    sql(
        "SELECT c.clip_id, max(p.t) AS anchor_t, arg_max(p.score, p.t) AS anchor_score FROM cp c JOIN pf p ON p.source_id = c.source_id AND p.t BETWEEN c.start_time AND c.end_time WHERE p.score >= 15e-2 GROUP BY c.clip_id",
        "cp", "pf",
    ),
)
def a14(spark, sf):
    return signal.last_anchor(_in_clips(spark, sf), threshold=signal.anchor_threshold(0.30)).select("clip_id", "anchor_t", "anchor_score")


LABEL_GROUPS = {
    # fixed values: label groups of the intensity chart
    "spike": ("audio_combat_spike",),
    "eliminated": ("Squad Eliminated", "ELIMINATED Text"),
    "feed": ("Combat Feed / Kill Feed Updates", "Knockdown/Kill Notifications"),
    "damage": ("Floating Damage Numbers", "loating Damage Numbers", "Directional Damage Indicators"),
    "victory": ("Victory",),
}


@query(
    "a15_label_timelines",
    sql(
        """SELECT g AS label_group, CAST(m AS BIGINT) AS minute, count(*) AS n FROM (SELECT CASE WHEN label = 'audio_combat_spike' THEN 'spike' WHEN label IN ('Squad Eliminated', 'ELIMINATED Text') THEN 'eliminated'
  WHEN label IN ('Floating Damage Numbers', 'loating Damage Numbers', 'Directional Damage Indicators') THEN 'damage' WHEN label = 'Victory' THEN 'victory' END AS g, floor(timestamp_s / 60) AS m FROM ev) WHERE g IS NOT NULL GROUP BY ROLLUP (g, m)""",
        "ev",
    ),
)
def a15(spark, sf):
    group = F.lit(None).cast("string")
    for name, labels in LABEL_GROUPS.items():
        group = F.when(F.col("label").isin(*labels), name).otherwise(group)
    ev = S.events(spark, sf).select(group.alias("label_group"), bin_of(F.col("timestamp_s"), 60.0).alias("minute"))
    return ev.where(F.col("label_group").isNotNull()).rollup("label_group", "minute").agg(F.count(F.lit(1)).alias("n"))


@query("a16_total_duration", "SELECT count(*) AS files, round(sum(CAST(p_retailprice AS DOUBLE)), 2) AS total_s FROM part")
def a16(spark, sf):
    from tidemark.sources.readers import media_info

    return media_info(S.probes(spark, sf)).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("duration"), 2).alias("total_s"))


view(
    "br",
    """SELECT clip_id, batch_ix, min(timestamp_s) AS first_t, max(timestamp_s) AS last_t,
  min(CASE WHEN value > 120 THEN timestamp_s END) AS candidate, 'batch ' || batch_ix || ' n=' || count(*) AS line
FROM (SELECT event_id // 40 AS clip_id, event_id % 40 // 8 AS batch_ix, timestamp_s, value FROM ev) GROUP BY clip_id, batch_ix""",
    "ev",
)


def _batch_results(spark, sf):
    ev = S.events(spark, sf)
    b = F.floor(F.col("event_id") % 40 / 8).cast("bigint")
    return ev.groupBy(
        F.lit(0).cast("bigint").alias("source_id"), F.floor(F.col("event_id") / 40).cast("bigint").alias("clip_id"), b.alias("batch_ix")
    ).agg(
        F.min("timestamp_s").alias("first_t"), F.max("timestamp_s").alias("last_t"),
        F.min(F.when(F.col("value") > 120, F.col("timestamp_s"))).alias("candidate"),
        F.count(F.lit(1)).alias("__n"),
    ).withColumn("line", F.concat(F.lit("batch "), F.col("batch_ix").cast("string"), F.lit(" n="), F.col("__n").cast("string"))).drop("__n")


@query(
    "a18_pick_candidates",
    sql(
        """SELECT clip_id, count(candidate) AS found, CASE WHEN count(candidate) = 0 THEN min(first_t) ELSE max(candidate) END AS entry_t, CASE WHEN count(candidate) = 0 THEN max(last_t) ELSE min(candidate) END AS exit_t,
  CASE count(candidate) WHEN 0 THEN 0.5e0 WHEN 1 THEN 75e-2 ELSE 7e-1 END AS confidence FROM br GROUP BY clip_id""",
        "br",
    ),
)
def a18(spark, sf):
    from tidemark.plans.narrative import pick_candidates

    res = _batch_results(spark, sf)
    a = pick_candidates(res, entry=True).select("source_id", "clip_id", "found", F.col("safe_t").alias("entry_t"), "confidence")
    b = pick_candidates(res, entry=False).select("source_id", "clip_id", F.col("safe_t").alias("exit_t"))
    return a.join(b, ["source_id", "clip_id"]).select("clip_id", "found", "entry_t", "exit_t", "confidence")


@query(
    "w16_rolling_summary",
    sql(
        "SELECT clip_id, batch_ix, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY clip_id ORDER BY batch_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS summary FROM br",
        "br",
    ),
)
def w16(spark, sf):
    from tidemark.plans.narrative import rolling_summary

    return rolling_summary(_batch_results(spark, sf)).select("clip_id", "batch_ix", "summary")


# ---------------------------------------------------------------- pacing

_WALK = """rg AS (SELECT source_id, clip_id, {lo} AS a, {hi} AS b FROM cp),
sp AS (SELECT r.*, p.t, p.rms, p.score, quantile_cont(p.rms, 0.3) OVER (PARTITION BY r.clip_id) AS g, count(*) OVER (PARTITION BY r.clip_id) AS n
  FROM rg r JOIN pf p ON p.source_id = r.source_id AND p.t BETWEEN r.a AND r.b),
gs AS (SELECT *, CASE WHEN rms < g THEN 0e0 ELSE score END AS s FROM sp WHERE n >= 4),
"""
_ENTRY = (
    _WALK.format(lo="greatest(0e0, start_time - 60)", hi="start_time")
    + """an AS (SELECT source_id, clip_id, any_value(a) AS a, max(t) AS at_, arg_max(s, t) AS asc_ FROM gs WHERE s >= 15e-2 GROUP BY source_id, clip_id),
rr AS (SELECT an.*, p.t, p.rms, quantile_cont(p.rms, 0.2) OVER (PARTITION BY an.clip_id) AS nf, row_number() OVER (PARTITION BY an.clip_id ORDER BY p.t DESC) AS k
  FROM an JOIN pf p ON p.source_id = an.source_id AND p.t BETWEEN an.a AND an.at_),
lo AS (SELECT *, rms > greatest(nf * {f}, 5e-3) AS loud FROM rr),
qt AS (SELECT *, k - coalesce(max(CASE WHEN loud THEN k END) OVER (PARTITION BY clip_id ORDER BY k), 0) AS quiet FROM lo),
st AS (SELECT *, max(CASE WHEN quiet >= {q} THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY k) AS stopped FROM qt),
fd AS (SELECT clip_id, any_value(at_) AS at_, any_value(asc_) AS asc_, least(any_value(at_), coalesce(min(CASE WHEN loud AND stopped = 0 THEN t END), any_value(at_))) AS ot FROM st GROUP BY clip_id),
ent AS (SELECT clip_id, at_ AS anchor_t, ot AS onset_t, least(1e0, CASE WHEN ot < at_ THEN greatest(asc_, 7e-1) ELSE asc_ END) AS confidence FROM fd)"""
)
_EXIT = (
    _WALK.format(lo="end_time", hi="end_time + 45")
    + """pk AS (SELECT source_id, clip_id, any_value(b) AS b, arg_max(t, (s, -t)) AS pt, max(s) AS ps, max(CASE WHEN s >= 15e-2 THEN t END) AS lt, arg_max(s, t) FILTER (WHERE s >= 15e-2) AS ls
  FROM gs GROUP BY source_id, clip_id HAVING max(s) >= 1e-1),
an AS (SELECT source_id, clip_id, b, CASE WHEN lt > pt THEN lt ELSE pt END AS at_, CASE WHEN lt > pt THEN ls ELSE ps END AS asc_ FROM pk),
rr AS (SELECT an.*, p.t, p.rms, quantile_cont(p.rms, 0.2) OVER (PARTITION BY an.clip_id) AS nf, row_number() OVER (PARTITION BY an.clip_id ORDER BY p.t) AS k
  FROM an JOIN pf p ON p.source_id = an.source_id AND p.t BETWEEN an.at_ AND an.b),
lo AS (SELECT *, rms > greatest(nf * {f}, 5e-3) AS loud FROM rr),
qt AS (SELECT *, k - coalesce(max(CASE WHEN loud THEN k END) OVER (PARTITION BY clip_id ORDER BY k), 0) AS quiet FROM lo),
st AS (SELECT *, max(CASE WHEN quiet >= {q} THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY k) AS stopped FROM qt),
fd AS (SELECT clip_id, any_value(at_) AS at_, any_value(asc_) AS asc_, greatest(any_value(at_), coalesce(max(CASE WHEN loud AND stopped = 0 THEN t END), any_value(at_))) AS ot FROM st GROUP BY clip_id),
ext AS (SELECT clip_id, at_ AS anchor_t, ot AS offset_t, least(1e0, CASE WHEN ot > at_ THEN greatest(asc_, 7e-1) ELSE asc_ END) AS confidence FROM fd)"""
)
_ENTRY_SQL, _EXIT_SQL = _ENTRY.replace("{f}", "12e-1").replace("{q}", "4"), _EXIT.replace("{f}", "12e-1").replace("{q}", "5")


@query("w08_onset", sql("SELECT clip_id, anchor_t, onset_t, round(confidence, 6) AS confidence FROM ent", "cp", "pf", ctes=_ENTRY_SQL))
def w08(spark, sf):
    pf, cp = S.profile(spark, sf), S.clips(spark, sf)
    r = cp.select("source_id", "clip_id", F.greatest(F.lit(0.0), F.col("start_time") - 60).alias("a"), F.col("start_time").alias("b"))
    out = signal.onset(r, pf, pf, start="a", end="b", silence_n=4, factor=1.2)
    return out.select("clip_id", "anchor_t", "onset_t", F.round("confidence", 6).alias("confidence"))


@query("w09_offset", sql("SELECT clip_id, anchor_t, offset_t, round(confidence, 6) AS confidence FROM ext", "cp", "pf", ctes=_EXIT_SQL))
def w09(spark, sf):
    pf, cp = S.profile(spark, sf), S.clips(spark, sf)
    r = cp.select("source_id", "clip_id", F.col("end_time").alias("a"), (F.col("end_time") + 45).alias("b"))
    out = signal.offset(r, pf, pf, start="a", end="b", silence_n=5, factor=1.2)
    return out.select("clip_id", "anchor_t", "offset_t", F.round("confidence", 6).alias("confidence"))


def _cut(ranges: str, lo: str, hi: str, stride: int) -> str:
    """Frames of a second (ten samples), every ``stride`` samples from each range's start."""
    return f"""(SELECT * EXCLUDE (arr), p / 10e0 + 5e-1 AS t,
  round(sqrt(list_sum(list_transform(arr[p + 1 : p + 10], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 10e0), 6) AS rms,
  round(least(1e0, abs(CAST(arr[p + 1] AS DOUBLE)) * 3e0), 4) AS score
  FROM (SELECT g.*, arr, unnest(generate_series(CAST(floor({lo} * 10) AS BIGINT), least(CAST(floor({hi} * 10) AS BIGINT), len(arr)) - 10, {stride})) AS p
    FROM {ranges} g JOIN smp USING (source_id)))"""


_GATED = f"""f5 AS (SELECT *, quantile_cont(rms, 0.3) OVER (PARTITION BY source_id, clip_id) AS g, count(*) OVER (PARTITION BY source_id, clip_id) AS n
  FROM {_cut("rg", "a", "b", 5)}),
gs AS (SELECT *, CASE WHEN rms < g THEN 0e0 ELSE score END AS s FROM f5 WHERE n >= 4),
"""


def _on_signal(text: str, lo: str, hi: str) -> str:
    """The statement of an entry or exit with frames cut at each range."""
    rest = text[text.index("gs AS ") :]
    rest = rest[rest.index("\n") + 1 :]
    begin = rest.index("rr AS (SELECT")
    order = "p.t DESC" if "p.t DESC" in rest else "p.t"
    lines = rest[rest.index("lo AS (SELECT") :]
    head = rest[:begin]
    ranges = text[: text.index("sp AS (")]
    # an anchor without a single frame on the finer grid stays as it is
    rr = f"""r2 AS {_cut("an", lo, hi, 2)},
rr AS (SELECT an.*, p.t, p.rms, quantile_cont(p.rms, 0.2) OVER (PARTITION BY an.source_id, an.clip_id) AS nf, row_number() OVER (PARTITION BY an.source_id, an.clip_id ORDER BY {order}) AS k
  FROM an LEFT JOIN r2 p ON p.source_id = an.source_id AND p.clip_id = an.clip_id),
"""
    return ranges + _GATED + head + rr + lines


_SIG_ENTRY, _SIG_EXIT = _on_signal(_ENTRY, "a", "at_"), _on_signal(_EXIT, "at_", "b")


def _signal_frames(spark, sf, resolution_s: float):
    score = lambda x: F.round(F.least(F.lit(1.0), F.abs(F.get(x, F.lit(0)).cast("double")) * 3), 4)
    return signal.signal_frames(
        S.waveform(spark, sf), rate=10.0, chunk_samples=64, window_s=1.0, resolution_s=resolution_s,
        measures={"rms": lambda x: F.round(signal.frame_energy(x), 6), "score": score},
    )


@query(
    "f10_range_profile",
    sql(
        """SELECT clip_id, round(t, 6) AS t, rms, s AS gated FROM gs UNION ALL
SELECT clip_id, round(t, 6), rms, NULL FROM r2""",
        "cp", "smp",
        ctes="rg AS (SELECT source_id, clip_id, start_time AS a, start_time + 30 AS b FROM cp),\n" + _GATED + "r2 AS " + _cut("rg", "a", "b", 2),
    ),
)
def f10_range(spark, sf):
    """Frames of 30 s from each clip's start on the grid of scores, gated, and on that of levels."""
    r = S.clips(spark, sf).select("source_id", "clip_id", F.col("start_time").alias("a"), (F.col("start_time") + 30).alias("b"))
    coarse = _signal_frames(spark, sf, 0.5)(r, "a", "b")
    enough = coarse.join(coarse.groupBy("source_id", "clip_id").count().where("count >= 4").drop("count"), ["source_id", "clip_id"], "left_semi")
    gated = signal.local_gate(enough).select("clip_id", F.round("t", 6).alias("t"), "rms", F.col("gated_score").alias("gated"))
    fine = _signal_frames(spark, sf, 0.2)(r, "a", "b")
    return gated.unionByName(fine.select("clip_id", F.round("t", 6).alias("t"), "rms", F.lit(None).cast("double").alias("gated")))


def _in_signal(spark, sf):
    return _signal_frames(spark, sf, 0.5), _signal_frames(spark, sf, 0.2)


@query(
    "w08_onset_in_signal",
    sql(
        "SELECT clip_id, anchor_t, round(onset_t, 6) AS onset_t, round(confidence, 6) AS confidence FROM ent",
        "cp", "smp", ctes=_SIG_ENTRY.replace("{f}", "12e-1").replace("{q}", str(signal.silence_steps(0.6, 0.2))),
    ),
)
def w08_signal(spark, sf):
    r = S.clips(spark, sf).select("source_id", "clip_id", F.greatest(F.lit(0.0), F.col("start_time") - 60).alias("a"), F.col("start_time").alias("b"))
    out = signal.onset(r, *_in_signal(spark, sf), start="a", end="b", silence_n=signal.silence_steps(0.6, 0.2), factor=1.2)
    return out.select("clip_id", "anchor_t", F.round("onset_t", 6).alias("onset_t"), F.round("confidence", 6).alias("confidence"))


@query(
    "w09_offset_in_signal",
    sql(
        "SELECT clip_id, anchor_t, round(offset_t, 6) AS offset_t, round(confidence, 6) AS confidence FROM ext",
        "cp", "smp", ctes=_SIG_EXIT.replace("{f}", "12e-1").replace("{q}", str(signal.silence_steps(0.8, 0.2))),
    ),
)
def w09_signal(spark, sf):
    r = S.clips(spark, sf).select("source_id", "clip_id", F.col("end_time").alias("a"), (F.col("end_time") + 45).alias("b"))
    out = signal.offset(r, *_in_signal(spark, sf), start="a", end="b", silence_n=signal.silence_steps(0.8, 0.2), factor=1.2)
    return out.select("clip_id", "anchor_t", F.round("offset_t", 6).alias("offset_t"), F.round("confidence", 6).alias("confidence"))


@query(
    "e04_safe_entry_in_signal",
    sql(
        """SELECT c.clip_id, round(greatest(coalesce(e.onset_t - 4, c.start_time - 10), c.start_time - 60), 6) AS entry_t, round(coalesce(e.confidence, 4e-1), 6) AS confidence
FROM cp c LEFT JOIN ent e USING (clip_id)""",
        "cp", "smp", ctes=_SIG_ENTRY.replace("{f}", "2e0").replace("{q}", str(signal.SILENCE_BEFORE)),
    ),
)
def e04_signal(spark, sf):
    out = pacing.safe_entry(S.clips(spark, sf), *_in_signal(spark, sf))
    return out.select(
        "clip_id", F.round("safe_entry.timestamp", 6).alias("entry_t"), F.round("safe_entry.confidence", 6).alias("confidence")
    )


@query(
    "e05_safe_exit_in_signal",
    sql(
        """SELECT c.clip_id, round(least(coalesce(e.offset_t, c.end_time + 10), c.end_time + 45), 6) AS exit_t, round(coalesce(e.confidence, 4e-1), 6) AS confidence
FROM cp c LEFT JOIN ext e USING (clip_id)""",
        "cp", "smp", ctes=_SIG_EXIT.replace("{f}", "25e-1").replace("{q}", str(signal.SILENCE_AFTER)),
    ),
)
def e05_signal(spark, sf):
    out = pacing.safe_exit(S.clips(spark, sf), *_in_signal(spark, sf))
    return out.select(
        "clip_id", F.round("safe_exit.timestamp", 6).alias("exit_t"), F.round("safe_exit.confidence", 6).alias("confidence")
    )


_E4 = _ENTRY.replace("{f}", "2e0").replace("{q}", "11")
_E5 = _EXIT.replace("{f}", "25e-1").replace("{q}", "15")


@query("e14_event_pipeline")
def e14(spark, sf):
    """Spikes, pruned detections, merged log, clips, cut points and render list, end to end."""
    from tidemark.plans import gameplay

    return gameplay.event_pipeline(S.events(spark, sf), S.profile(spark, sf), S.chunk_labels(spark, sf), *_in_signal(spark, sf))


@query(
    "e04_safe_entry",
    sql(
        """SELECT c.clip_id, round(greatest(coalesce(e.onset_t - 4, c.start_time - 10), c.start_time - 60), 6) AS entry_t, round(coalesce(e.confidence, 4e-1), 6) AS confidence
FROM cp c LEFT JOIN ent e USING (clip_id)""",
        "cp", "pf", ctes=_E4,
    ),
)
def e04(spark, sf):
    pf = S.profile(spark, sf)
    out = pacing.safe_entry(S.clips(spark, sf), pf, pf)
    return out.select(
        "clip_id", F.round("safe_entry.timestamp", 6).alias("entry_t"), F.round("safe_entry.confidence", 6).alias("confidence")
    )


@query(
    "e05_safe_exit",
    sql(
        """SELECT c.clip_id, round(least(coalesce(e.offset_t, c.end_time + 10), c.end_time + 45), 6) AS exit_t, round(coalesce(e.confidence, 4e-1), 6) AS confidence
FROM cp c LEFT JOIN ext e USING (clip_id)""",
        "cp", "pf", ctes=_E5,
    ),
)
def e05(spark, sf):
    pf = S.profile(spark, sf)
    out = pacing.safe_exit(S.clips(spark, sf), pf, pf)
    return out.select(
        "clip_id", F.round("safe_exit.timestamp", 6).alias("exit_t"), F.round("safe_exit.confidence", 6).alias("confidence")
    )


def _tag(block: str, suffix: str) -> str:
    import re

    return re.sub(r"\b(rg|sp|gs|an|rr|lo|qt|st|fd|pk|f5|r2)\b(?= AS \(|\b)", lambda m: m.group(1) + suffix, block)


@query(
    "e06_pace_clips",
    sql(
        """SELECT n.clip_id, round(coalesce(f.ns, n.s0), 6) AS entry_t, round(n.e0, 6) AS exit_t, f.ns IS NOT NULL AS adjusted, round(n.e0 - coalesce(f.ns, n.s0), 6) AS safe_duration
FROM ord_ n LEFT JOIN (SELECT n.clip_id, arg_min(f.e0, f.k) + 1 AS ns FROM ord_ n JOIN ord_ f ON f.source_id = n.source_id AND f.k < n.k AND f.e0 > n.s0 GROUP BY n.clip_id) f USING (clip_id)""",
        "cp", "pf",
        ctes=_tag(_E4, "1") + ",\n" + _tag(_E5, "2") + """,
ord_ AS (SELECT c.source_id, c.clip_id, greatest(coalesce(e.onset_t - 4, c.start_time - 10), c.start_time - 60) AS s0,
  least(coalesce(x.offset_t, c.end_time + 10), c.end_time + 45) AS e0, row_number() OVER (PARTITION BY c.source_id ORDER BY c.start_time, c.clip_id) AS k
  FROM cp c LEFT JOIN ent e USING (clip_id) LEFT JOIN ext x USING (clip_id))""",
    ),
)
def e06(spark, sf):
    pf = S.profile(spark, sf)
    out = pacing.pace_clips(S.clips(spark, sf).select("source_id", "clip_id", "start_time", "end_time"), pf, pf)
    return out.select(
        "clip_id", F.round("safe_entry.timestamp", 6).alias("entry_t"), F.round("safe_exit.timestamp", 6).alias("exit_t"),
        (F.col("safe_entry.reason") == "moved past an earlier clip").alias("adjusted"), F.round("safe_duration", 6).alias("safe_duration"),
    )


_S4 = _SIG_ENTRY.replace("{f}", "2e0").replace("{q}", str(signal.SILENCE_BEFORE))
_S5 = _SIG_EXIT.replace("{f}", "25e-1").replace("{q}", str(signal.SILENCE_AFTER))


@query(
    "e06_pace_clips_in_signal",
    sql(
        """SELECT n.clip_id, round(coalesce(f.ns, n.s0), 6) AS entry_t, round(CASE WHEN f.ns IS NOT NULL THEN 3e-1 ELSE n.c1 END, 6) AS entry_confidence,
  CASE WHEN f.ns IS NOT NULL THEN 'moved past an earlier clip' ELSE 'audio' END AS reason, round(n.e0, 6) AS exit_t, round(n.c2, 6) AS exit_confidence,
  round(n.e0 - coalesce(f.ns, n.s0), 6) AS safe_duration, coalesce(f.ns, n.s0) < n.e0 AS valid
FROM ord_ n LEFT JOIN (SELECT n.clip_id, arg_min(f.e0, f.k) + 1 AS ns FROM ord_ n JOIN ord_ f ON f.source_id = n.source_id AND f.k < n.k AND f.e0 > n.s0 GROUP BY n.clip_id) f USING (clip_id)""",
        "cp", "smp",
        ctes=_tag(_S4, "1") + ",\n" + _tag(_S5, "2") + """,
ord_ AS (SELECT c.source_id, c.clip_id, greatest(coalesce(e.onset_t - 4, c.start_time - 10), c.start_time - 60) AS s0, coalesce(e.confidence, 4e-1) AS c1,
  least(coalesce(x.offset_t, c.end_time + 10), c.end_time + 45) AS e0, coalesce(x.confidence, 4e-1) AS c2, row_number() OVER (PARTITION BY c.source_id ORDER BY c.start_time, c.clip_id) AS k
  FROM cp c LEFT JOIN ent e USING (clip_id) LEFT JOIN ext x USING (clip_id))""",
    ),
)
def e06_signal(spark, sf):
    """All that pacing says of a clip."""
    out = pacing.pace_clips(S.clips(spark, sf).select("source_id", "clip_id", "start_time", "end_time"), *_in_signal(spark, sf))
    rounded = lambda c: F.round(c, 6)
    return out.select(
        "clip_id", rounded("safe_entry.timestamp").alias("entry_t"), rounded("safe_entry.confidence").alias("entry_confidence"),
        F.col("safe_entry.reason").alias("reason"), rounded("safe_exit.timestamp").alias("exit_t"),
        rounded("safe_exit.confidence").alias("exit_confidence"), rounded("safe_duration").alias("safe_duration"), "valid",
    )


# ---------------------------------------------------------------- sort, limit, sample, sets


@query("o01_time_order", sql("SELECT source_id, event_id, coalesce(timestamp_s, 0) AS t FROM ev ORDER BY source_id, t, event_id", "ev"))
def o01(spark, sf):
    t = F.coalesce("timestamp_s", F.lit(0.0))
    return S.events(spark, sf).select("source_id", "event_id", t.alias("t")).orderBy("source_id", "t", "event_id")


@query("o02_score_order", sql("SELECT id, score FROM iv ORDER BY score DESC, id", "iv"))
def o02(spark, sf):
    return S.intervals(spark, sf).select("id", "score").orderBy(F.col("score").desc(), "id")


@query("o03_natural_order", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey")
def o03(spark, sf):
    from tidemark.functions.text import natural_key

    p = S.table(spark, sf, "part").select("p_partkey", "p_name")
    return p.orderBy(natural_key(F.concat(F.lit("clip"), F.col("p_partkey").cast("string"))))


@query(
    "o04_cap_per_source",
    sql("SELECT source_id, id, score FROM iv QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) <= 5", "iv"),
)
def o04(spark, sf):
    return select.cap_per_key(S.intervals(spark, sf), 5, [F.col("score").desc(), F.col("id")]).select("source_id", "id", "score")


@query(
    "f13_retention_cap",
    sql("SELECT source_id, id, score FROM iv WHERE score >= 75 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) <= 3", "iv"),
)
def f13(spark, sf):
    iv = S.intervals(spark, sf).where(F.col("score") >= 75)
    return select.cap_per_key(iv, 3, [F.col("score").desc(), F.col("id")]).select("source_id", "id", "score")


@query(
    "o05_even_subsample",
    sql(
        """SELECT clip_id, t FROM (SELECT clip_id, t, row_number() OVER (PARTITION BY clip_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n
FROM (SELECT c.clip_id, p.t FROM cp c JOIN pf p ON p.source_id = c.source_id AND p.t BETWEEN c.start_time AND c.end_time))
WHERE CASE WHEN n > 6 THEN i % (n // 6) = 0 AND i // (n // 6) < 6 ELSE true END""",
        "cp", "pf",
    ),
)
def o05(spark, sf):
    return select.even_subsample(_in_clips(spark, sf).select("source_id", "clip_id", "t"), ["source_id", "clip_id"], ["t"]).select("clip_id", "t")


@query(
    "o06_edge_texts",
    sql(
        """SELECT clip_id, list_filter(list_transform(list_sort(list({'t': timestamp_s, 'i': event_id, 'v': coalesce(text, '')}) FILTER (WHERE a <= 3)), lambda x: x.v), lambda v: trim(v) <> '') AS first_texts,
  list_filter(list_transform(list_sort(list({'t': timestamp_s, 'i': event_id, 'v': coalesce(text, '')}) FILTER (WHERE d <= 3)), lambda x: x.v), lambda v: trim(v) <> '') AS last_texts
FROM (SELECT c.clip_id, e.*, row_number() OVER (PARTITION BY c.clip_id ORDER BY e.timestamp_s, e.event_id) AS a, row_number() OVER (PARTITION BY c.clip_id ORDER BY e.timestamp_s DESC, e.event_id DESC) AS d
FROM cp c JOIN ev e ON e.source_id = c.source_id AND e.timestamp_s BETWEEN c.start_time AND c.end_time) GROUP BY clip_id""",
        "cp", "ev",
    ),
)
def o06(spark, sf):
    ev = S.events(spark, sf).select("source_id", "event_id", "timestamp_s", "text")
    cp = S.clips(spark, sf).select("source_id", "clip_id", "start_time", "end_time")
    m = rangejoin.points_in_intervals(ev, cp, t="timestamp_s", start="start_time", end="end_time", width=120.0)
    return select.edge_texts(m, ["source_id", "clip_id"], ["timestamp_s", "event_id"]).drop("source_id")


@query(
    "o07_merged_log",
    sql(
        "SELECT source_id, timestamp_s, label, confidence, text FROM ev WHERE label <> 'audio_combat_spike' UNION ALL SELECT source_id, timestamp_s, label, score, '' FROM au", "au",
    ),
)
def o07(spark, sf):
    visual = S.events(spark, sf).where(F.col("label") != "audio_combat_spike").drop("value", "event_id")
    return highlights.merged_log(visual, S.audio(spark, sf))


@query(
    "o08_distinct_frames",
    sql(
        """SELECT DISTINCT source_id, f AS frame FROM (SELECT source_id, unnest(range(a - a % 10, b, 10)) AS f FROM (SELECT source_id, CAST(floor(start * 10) AS BIGINT) AS a, least(CAST(floor("end" * 10) AS BIGINT), CAST(floor(length_s * 10) AS BIGINT)) AS b FROM (SELECT *, max(start) OVER (PARTITION BY source_id) AS length_s FROM iv)))""",
        "iv",
    ),
)
def o08(spark, sf):
    iv = S.intervals(spark, sf)
    windows = iv.join(iv.groupBy("source_id").agg(F.max("start").alias("length_s")), "source_id")
    return detection.window_frames(windows, fps=10.0, interval_s=1.0, total_frames=F.floor(F.col("length_s") * 10).cast("bigint"))


@query("o09_negative_sample", "SELECT doc_id, quality FROM labels WHERE quality <> 0 OR CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10")
def o09(spark, sf):
    d = S.table(spark, sf, "labels")
    return select.sample_negatives(d, F.col("quality") == 0, "doc_id").select("doc_id", "quality")


_SPLIT = "CASE WHEN row_number() OVER (ORDER BY md5(CAST({k} AS VARCHAR)), {k}) <= floor(count(*) OVER () * 0.8e0) THEN 'train' ELSE 'val' END"


@query("o10_split", f"SELECT doc_id, {_SPLIT.format(k='doc_id')} AS split FROM documents")
def o10(spark, sf):
    return select.hash_split(S.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "a17_split_counts",
    sql(
        f"SELECT split, count(*) AS images, CAST(count_if(has_label) AS BIGINT) AS labelled FROM (SELECT im.stem, lb.stem IS NOT NULL AS has_label, {_SPLIT.format(k='im.stem')} AS split FROM im LEFT JOIN lb USING (stem)) GROUP BY split",
        "im", "lb",
    ),
)
def a17(spark, sf):
    from tidemark.plans.curation import split_counts

    im, lb = S.files(spark, sf)
    paired = im.join(lb.select("stem", F.lit(True).alias("has_label")), "stem", "left").withColumn("has_label", F.coalesce("has_label", F.lit(False)))
    return split_counts(select.hash_split(paired, "stem"))


@query(
    "o11_label_union",
    sql("SELECT source_id, list_sort(list(DISTINCT label)) AS labels FROM ev GROUP BY source_id", "ev"),
)
def o11(spark, sf):
    per_bin = S.events(spark, sf).groupBy("source_id", bin_of(F.col("timestamp_s"), 600.0).alias("b")).agg(F.collect_set("label").alias("ls"))
    return per_bin.groupBy("source_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ls")))).alias("labels"))


@query(
    "j15_label_dimension",
    sql(
        """SELECT event_id, round(coalesce(b, 0e0), 6) AS bonus, coalesce(p, 0) AS points FROM ev LEFT JOIN (VALUES ('ELIMINATED Text', 8e0, 100), ('Floating Damage Numbers', 3e0, 5), ('Victory', 10e0, 1000)) AS d(label, b, p) USING (label)""",
        "ev",
    ),
)
def j15(spark, sf):
    from tidemark.sources.params import label_dimension, with_label_values

    dim = label_dimension(
        spark,
        {"bonus": {"ELIMINATED Text": 8.0, "Floating Damage Numbers": 3.0, "Victory": 10.0},
         "points": {"ELIMINATED Text": 100.0, "Floating Damage Numbers": 5.0, "Victory": 1000.0}},
    )
    out = with_label_values(S.events(spark, sf), dim)
    return out.select("event_id", F.round("bonus", 6).alias("bonus"), F.col("points").cast("int").alias("points"))


@query("a04_merged_profile", sql(
    """SELECT source_id, CAST(gi AS BIGINT) AS group_ix, min(start) AS start, max("end") AS "end", count(*) AS parts, round(sum(score), 6) AS total, max(score) AS best
FROM (SELECT *, sum(brk) OVER (PARTITION BY source_id ORDER BY start, id) AS gi FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY source_id ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0
    WHEN row_number() OVER (PARTITION BY source_id ORDER BY start, id) = 1 THEN 0 ELSE 1 END AS brk FROM iv)) GROUP BY source_id, gi""",
    "iv",
))
def a04(spark, sf):
    from tidemark.operators import intervals as I

    return I.merge_intervals(
        S.intervals(spark, sf), {"parts": I.count(), "total": I.total(F.col("score")), "best": I.highest(F.col("score"))},
        start="start", end="end", tie=["id"], number="group_ix",
    ).withColumns({"parts": F.col("parts").cast("bigint"), "total": F.round("total", 6)})


__all__ = ["intensity", "is_combat"]
