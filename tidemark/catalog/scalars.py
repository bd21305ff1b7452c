"""Queries on projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import samples as S
from tidemark.catalog.registry import query, sql
from tidemark.catalog.timeline import COMBAT_SQL
from tidemark.functions import scoring, spatial, text as T, timefmt
from tidemark.functions.intervals import iou
from tidemark.functions.similarity import edit_ratio, fuzzy_ratio
from tidemark.operators.signal import frame_energy, frame_rms
from tidemark.plans import narrative

_SECONDS = "SELECT o_orderkey AS id, o_totalprice / 3 AS s FROM orders"


def _seconds(spark, sf):
    return S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 3).alias("s"))


def _p2(x: str) -> str:
    return f"(CASE WHEN length(CAST({x} AS VARCHAR)) < 2 THEN lpad(CAST({x} AS VARCHAR), 2, '0') ELSE CAST({x} AS VARCHAR) END)"


_S = "CAST(floor(s) AS BIGINT)"


@query(
    "p01_hms",
    f"SELECT id, {_p2(f'({_S} // 3600)')} || ':' || {_p2(f'({_S} % 3600 // 60)')} || ':' || {_p2(f'({_S} % 60)')} AS hms FROM ({_SECONDS})",
)
def p01(spark, sf):
    return _seconds(spark, sf).select("id", timefmt.hms(F.col("s")).alias("hms"))


@query("p02_mmss", f"SELECT id, {_p2(f'({_S} // 60)')} || ':' || {_p2(f'({_S} % 60)')} AS mmss FROM ({_SECONDS})")
def p02(spark, sf):
    return _seconds(spark, sf).select("id", timefmt.mmss(F.col("s")).alias("mmss"))


@query(
    "p03_duration_text",
    f"""SELECT id, CASE WHEN s >= 3600 THEN {_S} // 3600 || 'h ' || {_p2(f'({_S} % 3600 // 60)')} || 'm ' || {_p2(f'({_S} % 60)')} || 's'
  WHEN s >= 60 THEN {_S} // 60 || 'm ' || {_p2(f'({_S} % 60)')} || 's' ELSE {_S} || 's' END AS d
FROM (SELECT id, s / (CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 50 ELSE 3000 END) AS s FROM ({_SECONDS}))""",
)
def p03(spark, sf):
    scale = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 50).otherwise(3000)
    return _seconds(spark, sf).select("id", timefmt.duration_text(F.col("s") / scale).alias("d"))


@query(
    "p04_size_text",
    """SELECT id, CASE WHEN b >= 1073741824 THEN printf('%.1f', b / 1073741824e0) || ' GB' WHEN b >= 1048576 THEN printf('%.1f', b / 1048576e0) || ' MB'
  WHEN b >= 1024 THEN printf('%.1f', b / 1024e0) || ' KB' ELSE b || ' B' END AS size
FROM (SELECT l_orderkey * 1000000 + l_partkey AS id, CAST(l_partkey * l_partkey * l_suppkey * (CASE l_linenumber % 2 WHEN 0 THEN 1 ELSE 40 END) // 7 AS BIGINT) AS b FROM lineitem)""",
)
def p04(spark, sf):
    li = S.table(spark, sf, "lineitem")
    b = li.l_partkey * li.l_partkey * li.l_suppkey * F.when(li.l_linenumber % 2 == 0, 1).otherwise(40)
    rows = li.select((li.l_orderkey * 1000000 + li.l_partkey).alias("id"), F.floor(b / 7).cast("bigint").alias("b"))
    return rows.select("id", timefmt.size_text(F.col("b")).alias("size"))


@query("p05_is_combat", sql(f"SELECT event_id, {COMBAT_SQL} AS combat FROM ev", "ev"))
def p05(spark, sf):
    return S.events(spark, sf).select("event_id", scoring.is_combat(F.col("label"), F.col("text")).alias("combat"))


@query(
    "p06_damage_bonus",
    sql(
        "SELECT event_id, round(coalesce(TRY_CAST(regexp_extract(coalesce(text, ''), '\\+(\\d+)', 1) AS DOUBLE) * 1e-1, 0e0), 6) AS bonus FROM ev",
        "ev",
    ),
)
def p06(spark, sf):
    return S.events(spark, sf).select("event_id", F.round(scoring.damage_bonus(F.col("text")), 6).alias("bonus"))


@query("p07_intensity", sql("SELECT event_id, round(score, 6) AS score FROM sev", "sev"))
def p07(spark, sf):
    c = F.col
    return S.events(spark, sf).select(
        "event_id", F.round(scoring.intensity(c("label"), c("confidence"), c("text")), 6).alias("score")
    )


@query(
    "p08_pace",
    sql(
        """SELECT source_id, ix, CASE WHEN w > 35e-1 THEN 'Fast' WHEN w < 15e-1 THEN 'Slow' ELSE 'Normal' END AS pace
FROM (SELECT source_id, ix, CASE WHEN "end" > start THEN words / ("end" - start) ELSE 0 END AS w FROM tr)""",
        "tr",
    ),
)
def p08(spark, sf):
    tr = S.transcript(spark, sf)
    return tr.select(
        "source_id", "ix", scoring.pace(T.word_count(F.col("text")), F.col("end") - F.col("start")).alias("pace")
    )


@query(
    "p09_loudness",
    sql(
        "SELECT source_id, ix, CASE WHEN rms > 15e-2 THEN 'Loud' WHEN rms < 3e-2 THEN 'Quiet' ELSE 'Normal' END AS loudness FROM (SELECT source_id, ix, rms * (1 + ix % 3) - 9e-2 AS rms FROM pf)",
        "pf",
    ),
)
def p09(spark, sf):
    pf = S.profile(spark, sf).withColumn("rms", F.col("rms") * (1 + F.col("ix") % 3) - 0.09)
    return pf.select("source_id", "ix", scoring.loudness(F.col("rms")).alias("loudness"))


_ITEMS = """it AS (SELECT source_id, chapter_ix, generate_subscripts(a, 1) - 1 AS item_ix, unnest(a) AS item
  FROM (SELECT source_id, chapter_ix, from_json(j, '[{"clip_title": "VARCHAR", "start": "DOUBLE", "end": "DOUBLE", "anchor_start_text": "VARCHAR",
    "padding": {"start_buffer": "DOUBLE"}, "virality_metrics": {"hook_strength": "DOUBLE", "retention_potential": "DOUBLE"}}]') AS a
  FROM (SELECT source_id, chapter_ix, CASE WHEN json_valid(js) THEN js END AS j FROM (
    SELECT source_id, chapter_ix, nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(reply, '<think>.*?</think>', '', 'gs'),
      '^.*</think>', '', 's'), '```json|```', '', 'gi'), '\\[.*\\]', 0, 's'), '') AS js FROM rp)) WHERE j IS NOT NULL)),
cand AS (SELECT source_id, chapter_ix, item_ix, item.clip_title AS clip_title, item.start AS start, item."end" AS "end", item."end" - item.start AS duration,
  item.anchor_start_text AS anchor_start_text, item.padding.start_buffer AS pad,
  (coalesce(item.virality_metrics.hook_strength, 50) + 50 + coalesce(item.virality_metrics.retention_potential, 50)) / 3 AS narrative FROM it)"""
_SCORED = _ITEMS + """,
hy AS (SELECT c.*, CASE WHEN duration IS NULL THEN 'bad_timestamps' WHEN duration < 15 THEN 'too_short' WHEN duration > 90 THEN 'too_long' ELSE 'accepted' END AS status,
  (SELECT count(*) FROM sc WHERE sc.source_id = c.source_id AND sc.t BETWEEN c.start AND c."end") AS screens,
  (SELECT count(*) FROM tr WHERE tr.source_id = c.source_id AND tr.start BETWEEN c.start AND c."end") AS lines,
  (SELECT count(*) FROM tr WHERE tr.source_id = c.source_id AND tr.start BETWEEN c.start AND c."end" AND loudness = 'Loud') AS loud,
  (SELECT count(*) FROM tr WHERE tr.source_id = c.source_id AND tr.start BETWEEN c.start AND c."end" AND pace = 'Fast') AS fast FROM cand c),
sco AS (SELECT *, CASE WHEN status = 'accepted' THEN round(narrative * 7e-1 + least(screens / greatest(duration / 4, 1e0) * 100, 100e0) * 15e-2
  + least((loud + fast * 15e-1) / greatest(lines, 1) * 100, 100e0) * 15e-2, 2) END AS hybrid_score,
  CASE WHEN status = 'accepted' THEN sum(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY chapter_ix, item_ix) - 1 END AS clip_no FROM hy)"""


@query(
    "p10_narrative_score",
    sql("SELECT source_id, chapter_ix, item_ix, round(narrative, 2) AS narrative_score FROM cand", "rp", ctes=_ITEMS),
)
def p10(spark, sf):
    items, _ = narrative.parse_replies(S.replies(spark, sf))
    m = F.col("item.virality_metrics")
    score = scoring.narrative_score(m.hook_strength, m.payoff_satisfaction, m.retention_potential)
    return items.select("source_id", "chapter_ix", F.col("item_ix").cast("bigint").alias("item_ix"), F.round(score, 2).alias("narrative_score"))


@query(
    "p11_hybrid_score",
    sql("SELECT source_id, chapter_ix, item_ix, hybrid_score FROM sco WHERE status = 'accepted'", "rp", "tr", "sc", ctes=_SCORED),
)
def p11(spark, sf):
    out = narrative.score_candidates(S.replies(spark, sf), S.transcript(spark, sf), S.screen(spark, sf))
    return out.where("status = 'accepted'").select("source_id", "chapter_ix", F.col("item_ix").cast("bigint").alias("item_ix"), "hybrid_score")


def _with_length(iv):
    """Intervals with the length of their recording: here, its last event."""
    return iv.join(iv.groupBy("source_id").agg(F.max("start").alias("length_s")), "source_id")


@query(
    "p12_padding",
    sql(
        """SELECT id, round(greatest(0e0, start - greatest(0e0, least(coalesce(ps, 3e-1), 5e0))), 6) AS s,
  round(least(length_s, "end" + greatest(0e0, least(coalesce(pe, 15e-1), 5e0))), 6) AS e
FROM (SELECT *, CASE WHEN id % 4 > 0 THEN score - 20 END AS ps, CASE WHEN id % 5 > 0 THEN score / 30 END AS pe, max(start) OVER (PARTITION BY source_id) AS length_s FROM iv)""",
        "iv",
    ),
)
def p12(spark, sf):
    iv = _with_length(S.intervals(spark, sf))
    ps = F.when(F.col("id") % 4 > 0, F.col("score") - 20)
    pe = F.when(F.col("id") % 5 > 0, F.col("score") / 30)
    s, e = scoring.padded_span(F.col("start"), F.col("end"), ps, pe, F.col("length_s"))
    return iv.select("id", F.round(s, 6).alias("s"), F.round(e, 6).alias("e"))


@query("p13_repaired_end", sql("""SELECT id, round(CASE WHEN "end" - start < 5 THEN start + 15 ELSE "end" END, 6) AS e FROM iv""", "iv"))
def p13(spark, sf):
    return S.intervals(spark, sf).select("id", F.round(scoring.repaired_end(F.col("start"), F.col("end")), 6).alias("e"))


@query(
    "p14_file_name",
    """SELECT doc_id, doc_id || '_' || coalesce(nullif(substr(regexp_replace(replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), ' ', '_'), '[^\\p{L}\\p{N}_]', '', 'g'), 1, 50), ''), 'clip_' || doc_id) || '.mp4' AS file_name FROM documents""",
)
def p14(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", T.clip_file_name(F.col("doc_id"), F.col("text")).alias("file_name"))


@query(
    "p15_clean_text",
    """SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN contains(text, chr(10)) THEN coalesce(list_filter(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '\\s+', '', 'g') <> '' AND NOT regexp_matches(lower(x), 'okay|need|figure|fix|text|user|mentioned|so|alright|step'))[1], '') ELSE text END, '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS cleaned FROM documents""",
)
def p15(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.clean_screen_text(F.col("text")).alias("cleaned"))


@query(
    "p16_reply_items",
    sql('SELECT source_id, chapter_ix, item_ix, clip_title, start, "end", pad FROM cand', "rp", ctes=_ITEMS),
)
def p16(spark, sf):
    items, _ = narrative.parse_replies(S.replies(spark, sf))
    return items.select(
        "source_id", "chapter_ix", F.col("item_ix").cast("bigint").alias("item_ix"), "item.clip_title", "item.start", "item.end",
        F.col("item.padding.start_buffer").alias("pad"),
    )


@query(
    "p16_bad_replies",
    sql("SELECT source_id, chapter_ix FROM rp ANTI JOIN it USING (source_id, chapter_ix)", "rp", ctes=_ITEMS),
)
def p16_bad(spark, sf):
    _, bad = narrative.parse_replies(S.replies(spark, sf))
    return bad.select("source_id", "chapter_ix")


_BATCH_SQL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'DESCRIPTION: ' || coalesce(text, '') || ' at ' || event_id || chr(10) || 'CANDIDATE: ' || timestamp_s
  WHEN 1 THEN 'description: none seen CANDIDATE: NONE' WHEN 2 THEN 'maybe around ' || timestamp_s || 's' ELSE 'no idea' END AS reply FROM ev"""


def _batch_replies(spark, sf):
    ev = S.events(spark, sf)
    i, t = F.col("event_id"), F.col("timestamp_s").cast("string")
    return ev.select(
        "source_id", "event_id", "timestamp_s",
        F.when(i % 4 == 0, F.concat(F.lit("DESCRIPTION: "), F.coalesce("text", F.lit("")), F.lit(" at "), i.cast("string"), F.lit("\nCANDIDATE: "), t))
        .when(i % 4 == 1, "description: none seen CANDIDATE: NONE")
        .when(i % 4 == 2, F.concat(F.lit("maybe around "), t, F.lit("s")))
        .otherwise("no idea")
        .alias("reply"),
    )


@query(
    "p17_reply_fields",
    sql(
        f"""SELECT event_id, coalesce(TRY_CAST(regexp_extract(reply, '(?i)CANDIDATE:\\s*(\\d+\\.?\\d*)', 1) AS DOUBLE),
  CASE WHEN NOT contains(upper(reply), 'NONE') THEN TRY_CAST(regexp_extract(reply, '(\\d+\\.?\\d*)', 1) AS DOUBLE) END) AS candidate,
  substr(CASE WHEN regexp_matches(reply, '(?i)DESCRIPTION:\\s*\\S') THEN regexp_replace(regexp_extract(reply, '(?is)DESCRIPTION:\\s*(.+?)(CANDIDATE:|$)', 1), '\\s+$', '') ELSE reply END, 1, 150) AS description
FROM ({_BATCH_SQL})""",
        "ev",
    ),
)
def p17(spark, sf):
    return _batch_replies(spark, sf).select(
        "event_id", T.reply_candidate(F.col("reply")).alias("candidate"), T.reply_description(F.col("reply")).alias("description")
    )


_ANSWER_SQL = "CASE doc_id % 5 WHEN 0 THEN 'Unclear' WHEN 1 THEN 'yes, no doubt' ELSE CASE WHEN quality = 1 THEN 'Yes.' ELSE 'no' END END"


def _answers(spark, sf):
    lb = S.table(spark, sf, "labels")
    return lb.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, "Unclear").when(F.col("doc_id") % 5 == 1, "yes, no doubt")
        .otherwise(F.when(F.col("quality") == 1, "Yes.").otherwise("no")).alias("answer"),
    )


@query(
    "p18_yes_no",
    f"SELECT doc_id, CASE WHEN contains(upper(a), 'YES') THEN 'YES' WHEN contains(upper(a), 'NO') THEN 'NO' ELSE 'UNEXPECTED' END AS reply_class FROM (SELECT doc_id, {_ANSWER_SQL} AS a FROM labels)",
)
def p18(spark, sf):
    return _answers(spark, sf).select("doc_id", T.yes_no(F.col("answer")).alias("reply_class"))


@query(
    "p19_anchor_key",
    sql(
        """SELECT source_id, ix, regexp_replace(regexp_replace(lower(regexp_replace('[1.0s] (Vol: x) ' || text, '\\[.*?\\] \\(.*?\\) ', '', 'g')), '^\\s+|\\s+$', '', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS k FROM tr""",
        "tr",
    ),
)
def p19(spark, sf):
    return S.transcript(spark, sf).select(
        "source_id", "ix", T.anchor_key(F.concat(F.lit("[1.0s] (Vol: x) "), F.col("text"))).alias("k")
    )


@query(
    "p20_frames",
    "SELECT vec_id, f AS frame_ix, round(sqrt(list_sum(list_transform(embedding[f * 10 + 1 : f * 10 + 16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 16e0), 6) AS rms FROM embeddings, (SELECT unnest(range(5)) AS f)",
)
def p20(spark, sf):
    emb = S.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    return frame_rms(emb, length=16, stride=10, key=("vec_id",)).select(
        "vec_id", F.col("frame_ix").cast("bigint").alias("frame_ix"), F.round("rms", 6).alias("rms")
    )


@query(
    "p21_rms",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 64e0), 6) AS rms FROM embeddings",
)
def p21(spark, sf):
    return S.table(spark, sf, "embeddings").select(
        "vec_id", F.round(frame_energy(F.col("embedding")), 6).alias("rms")
    )


@query(
    "p22_iou",
    """SELECT id, round(CASE WHEN u > 0 THEN x / u ELSE 0 END, 6) AS iou FROM (SELECT id, x, (b - a) + (d - c) - x AS u FROM (
SELECT *, greatest(0e0, least(b, d) - greatest(a, c)) AS x FROM (SELECT l_orderkey * 1000000 + l_partkey AS id, l_quantity AS a, l_quantity + l_tax * 100 AS b, l_discount * 400 AS c, l_discount * 400 + l_linenumber AS d FROM lineitem)))""",
)
def p22(spark, sf):
    li = S.table(spark, sf, "lineitem")
    a, c = F.col("l_quantity"), F.col("l_discount") * 400
    b, d = a + F.col("l_tax") * 100, c + F.col("l_linenumber")
    return li.select((li.l_orderkey * 1000000 + li.l_partkey).alias("id"), F.round(iou(a, b, c, d), 6).alias("iou"))


_CROP_SQL = """SELECT *, CASE WHEN r1 > 1920 THEN 1920 - w ELSE l1 END AS x1, CASE WHEN r1 > 1920 THEN 1920 ELSE r1 END AS x2 FROM (
SELECT *, CASE WHEN l < 0 THEN 0 ELSE l END AS l1, CASE WHEN l < 0 THEN w ELSE r END AS r1 FROM (
SELECT *, CAST(trunc((a + b) / 2 - w / 2) AS INTEGER) AS l, CAST(trunc((a + b) / 2 + w / 2) AS INTEGER) AS r FROM ({inner})))"""


@query(
    "p23_crop_box",
    "SELECT id, [x1, 0, x2, 1080] AS box FROM (" + _CROP_SQL.replace(
        "{inner}", "SELECT l_orderkey * 1000000 + l_partkey AS id, l_partkey % 1900 AS a, l_partkey % 1900 + CAST(l_quantity AS INTEGER) * 5 AS b, 607 AS w FROM lineitem"
    ) + ")",
)
def p23(spark, sf):
    li = S.table(spark, sf, "lineitem")
    a = li.l_partkey % 1900
    b = a + li.l_quantity.cast("int") * 5
    return li.select(
        (li.l_orderkey * 1000000 + li.l_partkey).alias("id"), spatial.crop_box(a, b, F.lit(1920), F.lit(1080)).alias("box")
    )


@query(
    "p24_crop_strategy",
    "SELECT id, CASE WHEN n = 0 THEN 'LETTERBOX' WHEN n = 1 THEN 'TRACK' WHEN w < 6075e-1 THEN 'TRACK' ELSE 'LETTERBOX' END AS strategy FROM (SELECT l_orderkey * 1000000 + l_partkey AS id, l_linenumber % 4 AS n, l_quantity * 15 AS w FROM lineitem)",
)
def p24(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return li.select(
        (li.l_orderkey * 1000000 + li.l_partkey).alias("id"),
        spatial.crop_strategy(li.l_linenumber % 4, li.l_quantity * 15, F.lit(1080)).alias("strategy"),
    )


@query(
    "p25_output_size",
    """SELECT id, w + w % 2 AS w, h FROM (SELECT id, CAST(floor(h * r) AS BIGINT) AS w, h FROM (SELECT p_partkey AS id, 700 + p_size + (700 + p_size) % 2 AS h,
  CASE p_partkey % 4 WHEN 0 THEN 9e0 / 16 WHEN 1 THEN 1e0 WHEN 2 THEN 4e0 / 5 ELSE 9e0 / 16 END AS r FROM part))""",
)
def p25(spark, sf):
    p = S.table(spark, sf, "part")
    m = p.p_partkey % 4
    ratio = F.when(m == 0, "9:16").when(m == 1, "1:1").when(m == 2, "4:5").otherwise("wide")
    w, h = spatial.even_size(F.lit(700) + p.p_size, ratio)
    return p.select(p.p_partkey.alias("id"), w.alias("w"), h.alias("h"))


@query(
    "p26_variable_rate",
    sql(
        """SELECT source_id, abs(r - a) > 5e-1 AS variable FROM (SELECT source_id, CASE WHEN contains(probe, '"r_frame_rate": "30000') THEN 30000 / 1001e0 WHEN contains(probe, '"r_frame_rate": "25') THEN 25e0 ELSE 60e0 END AS r,
  CASE WHEN contains(probe, '"avg_frame_rate": "24/1') THEN 24e0 WHEN contains(probe, '"avg_frame_rate": "30000') THEN 30000 / 1001e0 WHEN contains(probe, '"avg_frame_rate": "25') THEN 25e0 ELSE 60e0 END AS a FROM pr)""",
        "pr",
    ),
)
def p26(spark, sf):
    from tidemark.sources.readers import media_info

    return media_info(S.probes(spark, sf)).select(
        "source_id", timefmt.is_variable_rate(F.col("r_frame_rate"), F.col("avg_frame_rate")).alias("variable")
    )


@query(
    "p27_sampled_frames",
    sql(
        """SELECT id, f AS frame FROM (SELECT id, unnest(range(a - a % 25, b, 25)) AS f FROM (SELECT id, CAST(floor(start * 25) AS BIGINT) AS a, least(CAST(floor("end" * 25) AS BIGINT), CAST(floor(length_s * 25) AS BIGINT)) AS b FROM (SELECT *, max(start) OVER (PARTITION BY source_id) AS length_s FROM iv)))""",
        "iv",
    ),
)
def p27(spark, sf):
    iv = _with_length(S.intervals(spark, sf))
    frames = spatial.sampled_frames(F.col("start"), F.col("end"), F.lit(25.0), F.lit(1.0), F.floor(F.col("length_s") * 25).cast("bigint"))
    return iv.select("id", F.explode(frames).alias("frame"))


@query(
    "p29_natural_key",
    "SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(n, '\\d+|\\D+'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(CAST(length(coalesce(nullif(ltrim(r, '0'), ''), '0')) AS VARCHAR), 10, '0') || coalesce(nullif(ltrim(r, '0'), ''), '0') ELSE lower(r) END), 'string_agg', '') AS k FROM (SELECT p_partkey, p_name || '_' || p_partkey || '.MP4' AS n FROM part)",
)
def p29(spark, sf):
    p = S.table(spark, sf, "part")
    name = F.concat("p_name", F.lit("_"), p.p_partkey.cast("string"), F.lit(".MP4"))
    return p.select("p_partkey", T.natural_key(name).alias("k"))


@query(
    "p30_frame_name",
    "SELECT p_partkey, CASE WHEN t <> '' THEN 's1_' || t ELSE 's1' END || '_f' || lpad(CAST(p_partkey * 37 AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey * 37 AS VARCHAR))) AS INTEGER), '0') AS name FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN regexp_replace(p_brand, '[^\\p{L}\\p{N}_-]', '', 'g') ELSE '' END AS t FROM part)",
)
def p30(spark, sf):
    p = S.table(spark, sf, "part")
    tag = F.when(p.p_size % 2 == 0, p.p_brand)
    return p.select("p_partkey", T.frame_name(F.lit("s1"), tag, p.p_partkey * 37).alias("name"))


@query(
    "p31_ratios",
    "SELECT o_orderkey, round(CASE WHEN a = 0 THEN 0 ELSE (1 - b / a) * 100 END, 4) AS saved, round(CASE WHEN b > 0 THEN a / b ELSE 0 END, 4) AS speed FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_totalprice END AS a, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey * 11e0 END AS b FROM orders)",
)
def p31(spark, sf):
    o = S.table(spark, sf, "orders")
    a = F.when(o.o_custkey % 10 == 0, 0.0).otherwise(o.o_totalprice)
    b = F.when(o.o_custkey % 7 == 0, 0.0).otherwise(o.o_custkey * 11.0)
    return o.select(
        "o_orderkey", F.round(timefmt.size_reduction(a, b), 4).alias("saved"), F.round(timefmt.realtime_factor(a, b), 4).alias("speed")
    )


@query(
    "p32_tags",
    "SELECT p_partkey, CASE WHEN t = '' THEN '' ELSE ' [' || t || ']' END AS tags FROM (SELECT p_partkey, concat_ws('+', CASE WHEN p_size % 2 = 0 THEN 'crop' END, CASE WHEN p_size % 3 = 0 THEN 'subs' END) AS t FROM part)",
)
def p32(spark, sf):
    p = S.table(spark, sf, "part")
    return p.select("p_partkey", T.enrichment_tags(crop=p.p_size % 2 == 0, subs=p.p_size % 3 == 0).alias("tags"))


@query("p33_fuzzy_ratio")
def p33(spark, sf):
    p = S.table(spark, sf, "part")
    return p.select("p_partkey", F.round(fuzzy_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query(
    "p33_edit_ratio",
    "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 6) AS ratio FROM part",
)
def p33_edit(spark, sf):
    p = S.table(spark, sf, "part")
    return p.select("p_partkey", F.round(edit_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query("p34_pattern_tags", "SELECT doc_id, regexp_extract_all(text, '\\$?\\d+') AS tags FROM documents")
def p34(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.pattern_tags(F.col("text")).alias("tags"))
