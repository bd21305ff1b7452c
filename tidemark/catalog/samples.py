"""The driver's tables seen as timeline tables: once in Spark, once as SQL views.

Thirty days of events become one hour: ``timestamp_s`` counts hundredths of 1/720 of real
time, so the default gaps of 30 and 60 s select real structure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog.registry import view
from tidemark.functions.text import SPACE, strip, word_count
from tidemark.operators.scan import next_value, row_number, running_sum, scan
from tidemark.operators.signal import frame_rms


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LABELS = {
    "error": "audio_combat_spike",
    "purchase": "ELIMINATED Text",
    "click": "Floating Damage Numbers",
    "view": "Directional Damage Indicators",
    "signup": "Teammate",
}


def events(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.expr(
        "unix_micros(cast(TIMESTAMP_NTZ'2024-01-01 00:00:00' as timestamp))"
    )
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    label = F.lit(None).cast("string")
    for kind, name in LABELS.items():
        label = F.when(F.col("event_type") == kind, name).otherwise(label)
    return raw.select(
        F.col("user_id").alias("source_id"),
        "event_id",
        (F.floor(micros / F.lit(7_200_000)).cast("double") / 100).alias("timestamp_s"),
        label.alias("label"),
        F.least(F.col("value") / 150, F.lit(1.0)).alias("confidence"),
        F.when(k % 7 == 0, F.lit(None))
        .when(k % 7 == 1, "SQUAD ELIMINATED")
        .when(k % 7 == 2, "Team wiped")
        .when(k % 7 == 3, F.concat(F.lit("+"), k.cast("string"), F.lit(" hit")))
        .when(k % 7 == 4, "victry")
        .when(k % 7 == 5, "+")
        .otherwise(F.concat(F.lit("+"), k.cast("string")))
        .alias("text"),
        "value",
    )


view(
    "ev",
    """SELECT user_id AS source_id, event_id,
  CAST((epoch_us(ts) - 1704067200000000) // 7200000 AS DOUBLE) / 100 AS timestamp_s,
  CASE event_type WHEN 'error' THEN 'audio_combat_spike' WHEN 'purchase' THEN 'ELIMINATED Text'
    WHEN 'click' THEN 'Floating Damage Numbers' WHEN 'view' THEN 'Directional Damage Indicators'
    WHEN 'signup' THEN 'Teammate' END AS label,
  least(value / 150, 1.0) AS confidence,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'SQUAD ELIMINATED' WHEN 2 THEN 'Team wiped'
    WHEN 3 THEN '+' || k || ' hit' WHEN 4 THEN 'victry' WHEN 5 THEN '+' ELSE '+' || k END AS text,
  value
FROM (SELECT *, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k FROM events)""",
)


def audio(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    return ev.where(F.col("label") == "audio_combat_spike").select(
        "source_id", "timestamp_s", "label", F.col("confidence").alias("score")
    )


view("au", "SELECT source_id, timestamp_s, label, confidence AS score FROM ev WHERE label = 'audio_combat_spike'", "ev")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """One interval per event, at least a second long."""
    return events(spark, sf).select(
        "source_id", F.col("event_id").alias("id"), F.col("timestamp_s").alias("start"),
        (F.col("timestamp_s") + F.greatest("value", F.lit(1.0))).alias("end"), F.col("value").alias("score"),
    )


view(
    "iv",
    """SELECT source_id, event_id AS id, timestamp_s AS start, timestamp_s + greatest(value, 1e0) AS "end", value AS score
FROM ev""",
    "ev",
)

_FACTORS = (1, 2, 5)


def transcript(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    parts = conv.select(
        F.col("conv_id").alias("source_id"), "turn", F.posexplode(F.split("text", r"\. |\n")).alias("p", "part")
    ).select("source_id", "turn", "p", strip(F.col("part")).alias("text"))
    words = parts.withColumn("words", word_count(F.col("text"))).where(F.col("words") > 0)
    factor = F.element_at(F.array(*[F.lit(x) for x in _FACTORS]), (F.col("p") % 3 + 1).cast("int"))
    pause = F.when(F.col("p") == 0, F.col("turn") % 3 * 9).otherwise(0)
    units = words.withColumns({"u": F.col("words") * factor, "pause": pause})
    out = scan(
        units, ["source_id"], ["turn", "p"],
        {"upto": running_sum(F.col("u") + F.col("pause")), "n": row_number()}, pos="turn", width=8,
    )
    tenth = lambda c: F.floor((c * 10 + 3) / 6).cast("double") / 10
    return out.select(
        "source_id",
        (F.col("n") - 1).alias("ix"),
        tenth(F.col("upto") - F.col("u")).alias("start"),
        tenth(F.col("upto")).alias("end"),
        F.when(F.col("words") % 3 == 0, "Loud").when(F.col("words") % 3 == 1, "Normal").otherwise("Quiet").alias("loudness"),
        F.when(F.col("p") % 3 == 0, "Fast").when(F.col("p") % 3 == 1, "Normal").otherwise("Slow").alias("pace"),
        "text",
        "words",
    )


view(
    "tr",
    """SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY turn, p) - 1 AS ix,
  CAST(((upto - u) * 10 + 3) // 6 AS DOUBLE) / 10 AS start, CAST((upto * 10 + 3) // 6 AS DOUBLE) / 10 AS "end",
  CASE words % 3 WHEN 0 THEN 'Loud' WHEN 1 THEN 'Normal' ELSE 'Quiet' END AS loudness,
  CASE p % 3 WHEN 0 THEN 'Fast' WHEN 1 THEN 'Normal' ELSE 'Slow' END AS pace, text, words
FROM (SELECT *, CAST(sum(u + pause) OVER (PARTITION BY source_id ORDER BY turn, p) AS BIGINT) AS upto
  FROM (SELECT *, words * (CASE p % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END) AS u,
      CASE WHEN p = 0 THEN turn % 3 * 9 ELSE 0 END AS pause
    FROM (SELECT source_id, turn, p, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words
      FROM (SELECT source_id, turn, p, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS text
        FROM (SELECT conv_id AS source_id, turn, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS p
          FROM (SELECT conv_id, turn, string_split_regex(text, '\\. |\\n') AS parts FROM conversations))))
    WHERE words > 0))""",
)


def screen(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "source_id", "event_id", F.col("timestamp_s").alias("t"),
        F.concat_ws(" ", "label", F.coalesce("text", F.lit(""))).alias("text"),
    )


view(
    "sc",
    "SELECT source_id, event_id, timestamp_s AS t, label || ' ' || coalesce(text, '') AS text FROM ev",
    "ev",
)


def profile(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 100).cast("bigint").alias("source_id"),
        (F.col("vec_id") % 100).alias("chunk_ix"),
        F.col("embedding").alias("samples"),
    )
    frames = frame_rms(emb, length=8, stride=4, key=("source_id", "chunk_ix", "samples"))
    ix = F.col("chunk_ix") * 15 + F.col("frame_ix")
    sample = F.get("samples", F.col("frame_ix") * 4).cast("double")
    return frames.select(
        "source_id", ix.alias("ix"), (ix * 0.5 + 0.5).alias("t"), F.round("rms", 6).alias("rms"),
        F.round(F.least(F.lit(1.0), F.abs(sample) * 3), 4).alias("score"),
    )


view(
    "pf",
    """SELECT source_id, ix, ix * 0.5e0 + 0.5e0 AS t,
  round(sqrt(list_sum(list_transform(s, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 8e0), 6) AS rms,
  round(least(1e0, abs(CAST(s[1] AS DOUBLE)) * 3e0), 4) AS score
FROM (SELECT vec_id // 100 AS source_id, vec_id % 100 * 15 + f AS ix, embedding[f * 4 + 1 : f * 4 + 8] AS s
  FROM embeddings, (SELECT unnest(range(15)) AS f))""",
)

def waveform(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 64 samples, ten to the second: one vector each, a hundred to a source."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 100).cast("bigint").alias("source_id"), (F.col("vec_id") % 100).alias("chunk_ix"),
        F.col("embedding").alias("samples"),
    )


view("smp", "SELECT vec_id // 100 AS source_id, flatten(list(embedding ORDER BY vec_id)) AS arr FROM embeddings GROUP BY vec_id // 100")

SOUNDS = (
    "Gunshot, gunfire", "Explosion", "Speech", "Music", "Bang", "Silence", "Machine gun", "Laughter", "Wind",
)


def chunk_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Up to nine labels for each of eight chunks per vector; a chunk lasts one second."""
    emb = table(spark, sf, "embeddings")
    flat = emb.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    names = F.array(*[F.lit(s) for s in SOUNDS])
    return flat.select(
        F.floor(F.col("vec_id") / 100).cast("bigint").alias("source_id"),
        (F.col("vec_id") % 100 * 8 + F.floor(F.col("i") / 9)).alias("chunk_ix"),
        F.get(names, F.col("i") % 9).alias("label"),
        F.abs(F.col("x").cast("double")).alias("score"),
    )


view(
    "cl",
    """SELECT vec_id // 100 AS source_id, vec_id % 100 * 8 + i // 9 AS chunk_ix,
  ['Gunshot, gunfire', 'Explosion', 'Speech', 'Music', 'Bang', 'Silence', 'Machine gun', 'Laughter', 'Wind'][i % 9 + 1] AS label,
  abs(CAST(embedding[i + 1] AS DOUBLE)) AS score
FROM embeddings, (SELECT unnest(range(64)) AS i)""",
)


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """One clip per event, cut at the next event of its source, but at least a second long."""
    iv = intervals(spark, sf)
    nxt = scan(
        iv, ["source_id"], ["start", "id"], {"nxt": next_value(F.col("start"), inclusive=False)},
        pos="start", width=600.0, backward=True,
    )
    return nxt.select(
        "source_id", F.col("id").alias("clip_id"), F.col("start").alias("start_time"),
        F.greatest(F.col("start") + 1.0, F.least("end", F.coalesce("nxt", "end"))).alias("end_time"), "score",
    )


view(
    "cp",
    """SELECT source_id, id AS clip_id, start AS start_time, greatest(start + 1e0, least("end", coalesce(nxt, "end"))) AS end_time, score
FROM (SELECT *, lead(start) OVER (PARTITION BY source_id ORDER BY start, id) AS nxt FROM iv)""",
    "iv",
)


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """A scene lasts from one event to the next of its source."""
    ev = events(spark, sf)
    out = scan(
        ev, ["source_id"], ["timestamp_s", "event_id"], {"n": row_number()}, pos="timestamp_s", width=600.0
    )
    out = scan(
        out, ["source_id"], ["timestamp_s", "event_id"],
        {"nxt": next_value(F.col("timestamp_s"), inclusive=False)}, pos="timestamp_s", width=600.0, backward=True,
    )
    return out.where(F.col("nxt").isNotNull()).select(
        "source_id", (F.col("n") - 1).alias("scene_ix"), F.col("timestamp_s").alias("start_seconds"),
        F.col("nxt").alias("end_seconds"), F.floor(F.col("timestamp_s") * 30).cast("bigint").alias("start_frame"),
        F.floor(F.col("nxt") * 30).cast("bigint").alias("end_frame"),
    )


view(
    "scn",
    """SELECT source_id, n - 1 AS scene_ix, timestamp_s AS start_seconds, nxt AS end_seconds,
  CAST(floor(timestamp_s * 30) AS BIGINT) AS start_frame, CAST(floor(nxt * 30) AS BIGINT) AS end_frame
FROM (SELECT *, row_number() OVER w AS n, lead(timestamp_s) OVER w AS nxt FROM ev
  WINDOW w AS (PARTITION BY source_id ORDER BY timestamp_s, event_id)) WHERE nxt IS NOT NULL""",
    "ev",
)


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Person boxes: several per sampled frame; every third has a face."""
    li = table(spark, sf, "lineitem").withColumns(
        {"source_id": F.col("l_suppkey"), "frame_ts": (F.col("l_orderkey") % 360 * 10).cast("double")}
    )
    # a frame holds the people of one picture; boxes are made after the shuffle, which also serves joins by frame
    in_frame = Window.partitionBy("source_id", "frame_ts").orderBy("l_orderkey", "l_partkey", "l_extendedprice")
    x1, y1 = (F.col("l_partkey") % 1500).cast("int"), F.col("l_linenumber") * 20
    return li.withColumn("n", F.row_number().over(in_frame).cast("bigint")).select(
        "source_id", "frame_ts", (F.col("n") - 1).alias("det_ix"), (F.col("l_discount") * 10).alias("confidence"),
        F.array(x1, y1, x1 + (F.col("l_quantity") * 10).cast("int"), y1 + 300).alias("person_box"),
        F.when(F.col("l_partkey") % 3 == 0, F.array(x1 + 10, y1 + 10, x1 + 60, y1 + 60)).alias("face_box"),
    )


view(
    "det",
    """SELECT source_id, frame_ts, row_number() OVER (PARTITION BY source_id, frame_ts ORDER BY l_orderkey, l_partkey, l_extendedprice) - 1 AS det_ix,
  confidence, [x1, y1, x1 + q, y1 + 300] AS person_box,
  CASE WHEN l_partkey % 3 = 0 THEN [x1 + 10, y1 + 10, x1 + 60, y1 + 60] END AS face_box
FROM (SELECT l_suppkey AS source_id, CAST(l_orderkey % 360 * 10 AS DOUBLE) AS frame_ts, l_discount * 10 AS confidence,
  CAST(l_partkey % 1500 AS INTEGER) AS x1, l_linenumber * 20 AS y1, CAST(l_quantity * 10 AS INTEGER) AS q,
  l_orderkey, l_partkey, l_extendedprice FROM lineitem)""",
)


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies rendered from turns: thinking, fences, missing keys, broken ones."""
    conv = table(spark, sf, "conversations")
    n, turn = F.length("text"), F.col("turn")
    word = F.regexp_replace("text", "[^A-Za-z ]", "")

    def item(shift: int) -> F.Column:
        start = turn * 40 + shift
        # some models quote numbers, and some write words
        written = F.when(turn % 4 == 1, F.concat(F.lit('"'), start.cast("string"), F.lit('"'))).when(turn % 7 == 6, F.lit('"soon"'))
        return F.concat(
            F.lit('{"clip_title": "'), word, F.lit('", "start": '), written.otherwise(start.cast("string")), F.lit(', "end": '),
            (start + 10 + n % 100).cast("string"), F.lit(', "anchor_start_text": "'), word,
            F.lit('", "virality_metrics": {"hook_strength": '), (n % 97).cast("string"),
            F.when(turn % 3 != 0, F.concat(F.lit(', "retention_potential": '), (n % 89).cast("string"))).otherwise(""),
            F.lit("}"),
            F.when(turn % 2 == 0, F.lit(', "padding": {"start_buffer": 7.5}')).otherwise(""),
            F.lit("}"),
        )

    body = F.concat(F.lit("["), item(0), F.lit(", "), item(3), F.lit("]"))
    return conv.select(
        F.col("conv_id").alias("source_id"),
        turn.alias("chapter_ix"),
        F.when(n % 5 == 0, F.concat(F.lit("<think>maybe [1, 2]</think>```json\n"), body, F.lit("\n```")))
        .when(n % 5 == 1, F.concat(F.lit("still thinking [0]</think>"), body))
        .when(n % 5 == 2, F.lit("nothing good here"))
        .when(n % 5 == 3, F.concat(F.lit("[{bad "), word, F.lit("]")))
        .otherwise(body)
        .alias("reply"),
    )


_ITEM = """'{"clip_title": "' || word || '", "start": ' || CASE WHEN turn % 4 = 1 THEN '"' || (turn * 40 + @) || '"' WHEN turn % 7 = 6 THEN '"soon"' ELSE CAST(turn * 40 + @ AS VARCHAR) END || ', "end": ' || (turn * 40 + @ + 10 + n % 100)
  || ', "anchor_start_text": "' || word || '", "virality_metrics": {"hook_strength": ' || (n % 97)
  || CASE WHEN turn % 3 <> 0 THEN ', "retention_potential": ' || (n % 89) ELSE '' END || '}'
  || CASE WHEN turn % 2 = 0 THEN ', "padding": {"start_buffer": 7.5}' ELSE '' END || '}'"""
view(
    "rp",
    f"""SELECT source_id, chapter_ix, CASE n % 5 WHEN 0 THEN '<think>maybe [1, 2]</think>```json' || chr(10) || body || chr(10) || '```'
  WHEN 1 THEN 'still thinking [0]</think>' || body WHEN 2 THEN 'nothing good here'
  WHEN 3 THEN '[{{bad ' || word || ']' ELSE body END AS reply
FROM (SELECT *, '[' || {_ITEM.replace("@", "0")} || ', ' || {_ITEM.replace("@", "3")} || ']' AS body
  FROM (SELECT conv_id AS source_id, turn AS chapter_ix, turn, length(text) AS n,
    regexp_replace(text, '[^A-Za-z ]', '', 'g') AS word FROM conversations))""",
)


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Probe documents of media files, one per part."""
    p = table(spark, sf, "part")
    rate = F.when(F.col("p_size") % 3 == 0, "30000/1001").when(F.col("p_size") % 3 == 1, "25/0").otherwise("60")
    return p.select(
        F.col("p_partkey").alias("source_id"),
        F.concat(
            F.lit('{"format": {"duration": "'), F.col("p_retailprice").cast("string"), F.lit('", "size": "'),
            (F.col("p_partkey") * F.col("p_partkey") * 997).cast("string"), F.lit('"}, "streams": ['),
            F.when(F.col("p_size") % 2 == 0, F.lit('{"codec_type": "audio", "codec_name": "aac"}, ')).otherwise(""),
            F.lit('{"codec_type": "video", "codec_name": "h264", "width": '), (F.col("p_size") * 40).cast("string"),
            F.lit(', "height": 1080, "r_frame_rate": "'), rate, F.lit('", "avg_frame_rate": "'),
            F.when(F.col("p_size") % 5 == 0, "24/1").otherwise(rate),
            F.lit('"}, {"codec_type": "video", "codec_name": "mjpeg", "width": 1, "height": 1}]}'),
        ).alias("probe"),
    )


view(
    "pr",
    """SELECT source_id, '{"format": {"duration": "' || p_retailprice || '", "size": "' || (source_id * source_id * 997) || '"}, "streams": ['
  || CASE WHEN p_size % 2 = 0 THEN '{"codec_type": "audio", "codec_name": "aac"}, ' ELSE '' END
  || '{"codec_type": "video", "codec_name": "h264", "width": ' || (p_size * 40) || ', "height": 1080, "r_frame_rate": "' || rate
  || '", "avg_frame_rate": "' || CASE WHEN p_size % 5 = 0 THEN '24/1' ELSE rate END
  || '"}, {"codec_type": "video", "codec_name": "mjpeg", "width": 1, "height": 1}]}' AS probe
FROM (SELECT p_partkey AS source_id, p_size, p_retailprice,
  CASE p_size % 3 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/0' ELSE '60' END AS rate FROM part)""",
)


def files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Image files (documents) and label files (labelled documents) by stem."""
    stem = F.concat(F.lit("frame_"), F.col("doc_id").cast("string"))
    images = table(spark, sf, "documents").select(stem.alias("stem"), F.lit(".jpg").alias("ext"), "doc_id")
    labels = table(spark, sf, "labels").select(stem.alias("stem"), F.lit(".txt").alias("ext"), "quality", "toxic")
    return images, labels


view("im", "SELECT 'frame_' || doc_id AS stem, '.jpg' AS ext, doc_id FROM documents")
view("lb", "SELECT 'frame_' || doc_id AS stem, '.txt' AS ext, quality, toxic FROM labels")

__all__ = [
    "SPACE", "audio", "chunk_labels", "clips", "detections", "events", "files", "intervals", "probes",
    "profile", "replies", "scenes", "screen", "table", "transcript", "waveform",
]
