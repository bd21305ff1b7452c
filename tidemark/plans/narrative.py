"""Transcripts and model replies to a clip manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring, text as T
from tidemark.functions.similarity import edit_ratio, fuzzy_ratio
from tidemark.functions.timefmt import mmss
from tidemark.operators.conflicts import suppress_overlaps
from tidemark.operators.rangejoin import points_in_intervals
from tidemark.operators.scan import row_number, running_sum, scan
from tidemark.schemas import CANDIDATE, SELECTION
from tidemark.session import cut_lineage

KEY = "source_id"
NO_BEFORE, NO_AFTER = "[Beginning of video]", "[End of video]"


def _typed(item: Column) -> Column:
    """A candidate with its numbers."""
    number = lambda c: F.trim(c).try_cast("double")
    of = lambda part, *names: F.when(part.isNotNull(), F.struct(*[number(part[n]).alias(n) for n in names]))
    time = lambda n: F.when(item[n].isNull(), F.lit(0.0)).otherwise(number(item[n])).alias(n)
    return F.struct(
        item["clip_title"].alias("clip_title"), time("start"), time("end"),
        item["anchor_start_text"].alias("anchor_start_text"), item["anchor_end_text"].alias("anchor_end_text"),
        of(item["padding"], "start_buffer", "end_buffer").alias("padding"),
        of(item["virality_metrics"], "hook_strength", "payoff_satisfaction", "retention_potential").alias("virality_metrics"),
        item["reasoning"].alias("reasoning"),
    )


def parse_replies(replies: DataFrame, schema: str = CANDIDATE, *, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Items of the JSON arrays found in replies, and the replies that hold none.

    Items keep their reply's other columns and their position.  Numbers of candidates are read
    whether quoted or not; a missing start or end is 0, an unreadable one null.
    """
    parsed = replies.withColumn(
        "__items", F.from_json(T.reply_array(F.col(reply)), f"array<struct<{schema}>>")
    )
    if schema == CANDIDATE:
        parsed = parsed.withColumn("__items", F.transform("__items", _typed))
    good = parsed.where(F.col("__items").isNotNull())
    keep = [c for c in replies.columns if c != reply]
    items = good.select(*keep, F.posexplode("__items").alias("item_ix", "item"))
    return items, parsed.where(F.col("__items").isNull()).drop("__items")


def count_screens(clips: DataFrame, screen_text: DataFrame, *, ident: str, start: str, end: str) -> DataFrame:
    """Screen texts inside each clip, counted per time before the join."""
    per_time = screen_text.groupBy(KEY, "t").agg(F.count(F.lit(1)).alias("n"))
    inside = points_in_intervals(per_time, clips.select(KEY, ident, start, end), t="t", start=start, end=end)
    return inside.groupBy(KEY, ident).agg(F.sum("n").alias("screens"))


def count_lines(clips: DataFrame, transcript: DataFrame, *, ident: str, start: str, end: str) -> DataFrame:
    """Transcript lines starting inside each clip: all, loud and fast ones."""
    per_time = transcript.groupBy(KEY, F.col("start").alias("__t")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("loudness") == "Loud").alias("l"),
        F.count_if(F.col("pace") == "Fast").alias("f"),
    )
    inside = points_in_intervals(per_time, clips.select(KEY, ident, start, end), t="__t", start=start, end=end)
    return inside.groupBy(KEY, ident).agg(
        F.sum("n").alias("lines"), F.sum("l").alias("loud"), F.sum("f").alias("fast")
    )


def score_candidates(
    replies: DataFrame, transcript: DataFrame, screen_text: DataFrame, *, min_s: float = 15.0, max_s: float = 90.0
) -> DataFrame:
    """Candidates of all replies with narrative and hybrid score and why rejected, if so.

    Accepted candidates are numbered per source in chapter order.
    """
    items, _ = parse_replies(replies)
    flat = items.select(
        KEY, "chapter_ix", "item_ix", "item.clip_title", "item.start", "item.end", "item.anchor_start_text", "item.anchor_end_text",
        "item.padding", "item.virality_metrics", "item.reasoning",
    )
    m = F.col("virality_metrics")
    flat = flat.withColumns(
        {
            "narrative": scoring.narrative_score(m.hook_strength, m.payoff_satisfaction, m.retention_potential),
            "duration": F.col("end") - F.col("start"),
            "ident": F.struct("chapter_ix", "item_ix"),
        }
    )
    flat = flat.withColumn("status", scoring.duration_status(F.col("duration"), min_s, max_s))
    flat = scan(
        flat.withColumn("__ok", (F.col("status") == "accepted").cast("bigint")),
        [KEY], ["chapter_ix", "item_ix"], {"__n": running_sum(F.col("__ok"))}, pos="chapter_ix", width=256,
    )
    # read three times below: replies are parsed and numbered once
    flat = cut_lineage(flat.drop("__ok"))
    ok = flat.where("status = 'accepted'")
    screens = count_screens(ok, screen_text, ident="ident", start="start", end="end")
    lines = count_lines(ok, transcript, ident="ident", start="start", end="end")
    zero = F.lit(0)
    scored = flat.join(screens, [KEY, "ident"], "left").join(lines, [KEY, "ident"], "left").withColumn(
        "hybrid_score",
        F.when(
            F.col("status") == "accepted",
            scoring.hybrid_score(
                F.col("narrative"), F.col("duration"), F.coalesce("screens", zero), F.coalesce("lines", zero),
                F.coalesce("loud", zero), F.coalesce("fast", zero),
            ),
        ),
    )
    return scored.select(
        KEY, "chapter_ix", "item_ix",
        F.when(F.col("status") == "accepted", F.col("__n") - 1).alias("clip_no"),
        F.when(F.col("status") == "accepted", F.concat(F.lit("clip_"), (F.col("__n") - 1).cast("string"))).alias("clip_id"),
        "clip_title", "start", "end", "duration", "anchor_start_text", "anchor_end_text", "padding",
        F.round("narrative", 2).alias("narrative_score"), "hybrid_score", "status", "reasoning",
    )


def anchor_matches(
    candidates: DataFrame, transcript: DataFrame, *, anchor: str, target: str, ident: str = "clip_no",
    radius_s: float = 15.0, fuzzy: bool = True, above: float = -1.0,
) -> DataFrame:
    """Similarity of each candidate's anchor text to the transcript lines near its time.

    A line that contains the anchor scores 1; the slow ratio is worked out only for the rest, and of
    these only for pairs whose lengths allow a ratio ``above`` the given one.  Others are left out.
    """
    asks = candidates.where(T.has_anchor(F.col(anchor))).select(
        KEY, ident, F.col(target).alias("__at"), T.anchor_key(F.col(anchor)).alias("__want"),
        (F.col(target) - radius_s).alias("__lo"), (F.col(target) + radius_s).alias("__hi"),
    )
    lines = transcript.select(
        KEY, "ix", F.col("start").alias("__s"), F.col("end").alias("__e"), T.anchor_key(F.col("text")).alias("__line")
    )
    near = points_in_intervals(lines, asks, t="__s", start="__lo", end="__hi", start_open=True, end_open=True)
    holds = F.contains(F.col("__line"), F.col("__want"))
    a, b = F.length("__want"), F.length("__line")
    # no more than the shorter text can match
    most = 2.0 * F.least(a, b) / F.greatest(a + b, F.lit(1)) if fuzzy else 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))
    possible = near.where(holds | (most > above))
    measure = fuzzy_ratio if fuzzy else edit_ratio
    slow = measure(F.when(~holds, F.col("__want")), F.when(~holds, F.col("__line")))
    return possible.withColumn("ratio", F.when(holds, F.lit(1.0)).otherwise(slow))


def snap_to_text(
    candidates: DataFrame, transcript: DataFrame, *, anchor: str, target: str, ident: str = "clip_no",
    radius_s: float = 15.0, min_ratio: float = 0.4, is_end: bool = False, name: str = "snapped", fuzzy: bool = True,
) -> DataFrame:
    """Move a time to the best matching line's start (or end); unmatched times stay.

    Lines lie within ``radius_s`` (strictly); the ratio must exceed ``min_ratio``; on equal
    ratios the first line wins.
    """
    found = anchor_matches(
        candidates, transcript, anchor=anchor, target=target, ident=ident, radius_s=radius_s, fuzzy=fuzzy, above=min_ratio
    ).where(F.col("ratio") > min_ratio)
    best = found.groupBy(KEY, ident).agg(
        F.max_by("__e" if is_end else "__s", F.struct(F.col("ratio"), -F.col("ix"))).alias("__best")
    )
    return candidates.join(best, [KEY, ident], "left").withColumn(name, F.coalesce("__best", target)).drop("__best")


def select_candidates(selection: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected candidates, and selections whose id is unknown."""
    known = selection.join(candidates, [KEY, "clip_id"])
    unknown = selection.join(candidates.select(KEY, "clip_id"), [KEY, "clip_id"], "left_anti")
    return known, unknown


_NOTES = ("viral_archetype", "engagement_trigger", "selection_reason")


def parse_selection(replies: DataFrame) -> DataFrame:
    """Choices of an editor's reply per source (one reply each): pick_no from 1, clip_id, title, notes."""
    items, _ = parse_replies(replies, SELECTION)
    title = F.coalesce(F.nullif("item.clip_title", F.lit("")), F.nullif("item.title", F.lit("")))
    return items.select(
        KEY, (F.col("item_ix") + 1).cast("bigint").alias("pick_no"), "item.clip_id", title.alias("title"), *[f"item.{n}" for n in _NOTES]
    )


def offered_candidates(candidates: DataFrame, *, dedupe_iou: float = 0.5) -> DataFrame:
    """Accepted candidates that an editor is shown: of near-equal spans the best one."""
    accepted = cut_lineage(candidates.where("status = 'accepted'"))
    return suppress_overlaps(accepted, score="hybrid_score", threshold=dedupe_iou, ident="clip_no")


def build_manifest(
    selection: DataFrame, candidates: DataFrame, transcript: DataFrame, *, max_clips: int = 20, fuzzy: bool = True,
) -> DataFrame:
    """Selected, repaired, snapped, padded and named clips.

    ``selection`` has ``pick_no`` (order of choice, from 1) and ``clip_id`` per source, and may
    have a title and an editor's notes.  The first ``max_clips`` choices count; their ids are
    looked up among all accepted candidates, and unknown ones are left out.
    Recording length is the end of the last transcript line.
    """
    accepted = cut_lineage(candidates.where("status = 'accepted'"))
    # read for both ends and for the length: lines are placed once
    transcript = cut_lineage(transcript.select(KEY, "ix", "start", "end", "text"))
    chosen = selection.select(KEY, "pick_no", "clip_id", *[
        (F.col(c) if c in selection.columns else F.lit(None)).cast("string").alias(c) for c in ("title", *_NOTES)
    ])
    capped = scan(chosen, [KEY], ["pick_no"], {"__n": row_number()}, pos="pick_no", width=1024).where(
        F.col("__n") <= max_clips
    )
    known, _ = select_candidates(capped.drop("__n"), accepted)
    fixed = known.withColumn("end", scoring.repaired_end(F.col("start"), F.col("end")))
    fixed = cut_lineage(fixed)
    a = snap_to_text(fixed, transcript, anchor="anchor_start_text", target="start", name="true_start", fuzzy=fuzzy)
    a = cut_lineage(a)
    b = snap_to_text(a, transcript, anchor="anchor_end_text", target="end", is_end=True, name="true_end", fuzzy=fuzzy)
    length = transcript.groupBy(KEY).agg(F.max("end").alias("__length"))
    pad = F.col("padding")
    s, e = scoring.padded_span(
        F.col("true_start"), F.col("true_end"), pad.start_buffer, pad.end_buffer, F.col("__length")
    )
    out = b.join(length, KEY, "left").withColumns({"__s": s, "__e": e})
    title = F.coalesce("title", "clip_title", F.concat(F.lit("clip_"), F.col("pick_no").cast("string")))
    return out.select(
        KEY, "clip_id", "pick_no",
        T.clip_file_name(F.col("pick_no"), title).alias("file_name"),
        title.alias("title"),
        F.round("__s", 3).alias("start"), F.round("__e", 3).alias("end"),
        F.round(F.col("__e") - F.col("__s"), 3).alias("duration"),
        scoring.clamp_padding(pad.start_buffer, 0.3).alias("start_padding"),
        scoring.clamp_padding(pad.end_buffer, 1.5).alias("end_padding"),
        "anchor_start_text", "anchor_end_text",
        F.struct(F.col("narrative_score").alias("narrative"), F.col("hybrid_score").alias("hybrid")).alias("scores"),
        *_NOTES,
    )


def chapter_context(
    chapters: DataFrame, transcript: DataFrame, *, reach_s: float = 45.0, screen_text: DataFrame | None = None
) -> DataFrame:
    """Previous, current and upcoming lines of each chapter, as text.

    Each text spans one chapter and ``reach_s`` on both sides, so its size is bounded by
    the longest chapter.  A chapter without lines of its own is dropped.
    """
    c = chapters.select(
        KEY, "chapter_ix", F.col("start").alias("c_start"), F.col("end").alias("c_end"),
        F.greatest(F.lit(0.0), F.col("start") - reach_s).alias("__lo"), (F.col("end") + reach_s).alias("__hi"),
    )
    lines = transcript.select(
        KEY, "ix", F.col("start").alias("__s"),
        T.transcript_line(F.col("start"), F.col("end"), F.col("loudness"), F.col("pace"), F.col("text")).alias("line"),
    )
    near = points_in_intervals(lines, c, t="__s", start="__lo", end="__hi")
    part = (
        F.when(F.col("__s") < F.col("c_start"), "previous").when(F.col("__s") > F.col("c_end"), "upcoming").otherwise("current")
    )

    def joined(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(part == name, F.struct("ix", "line"))))
        return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")

    texts = near.groupBy(KEY, "chapter_ix", "c_start", "c_end").agg(
        joined("previous").alias("previous"), joined("current").alias("current"), joined("upcoming").alias("upcoming")
    ).where(T.strip(F.col("current")) != "")
    out = texts.select(
        KEY, "chapter_ix", F.col("c_start").alias("start"), F.col("c_end").alias("end"),
        F.when(F.col("previous") == "", NO_BEFORE).otherwise(F.col("previous")).alias("previous"),
        "current",
        F.when(F.col("upcoming") == "", NO_AFTER).otherwise(F.col("upcoming")).alias("upcoming"),
    )
    if screen_text is None:
        return out
    shots = screen_text.select(
        KEY, F.col("t").alias("__t"), F.concat(F.lit("["), F.format_string("%.1f", "t"), F.lit("s] "), F.col("text")).alias("shot")
    )
    seen = points_in_intervals(shots, c.select(KEY, "chapter_ix", "__lo", "__hi"), t="__t", start="__lo", end="__hi")
    shown = seen.groupBy(KEY, "chapter_ix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__t", "shot"))), lambda r: r["shot"]), "\n").alias("screens")
    )
    return out.join(shown, [KEY, "chapter_ix"], "left").withColumn("screens", F.coalesce("screens", F.lit("")))


def prompt_table(contexts: DataFrame, template: str, *, min_s: float = 15.0, max_s: float = 90.0) -> DataFrame:
    """Fill a template per chapter and report its size in characters and rough tokens.

    Placeholders: {label} {previous} {current} {upcoming} {screens} {min_dur} {max_dur}.
    """
    label = F.concat(
        F.lit("Chapter "), (F.col("chapter_ix") + 1).cast("string"), F.lit(" ("), mmss(F.col("start")),
        F.lit(" to "), mmss(F.col("end")), F.lit(")"),
    )
    screens = F.col("screens") if "screens" in contexts.columns else F.lit("")
    fills = {
        "label": label, "previous": F.col("previous"), "current": F.col("current"),
        "upcoming": F.col("upcoming"), "screens": screens,
        "min_dur": F.lit(f"{min_s}"), "max_dur": F.lit(f"{max_s}"),
    }
    # placeholders are cut out of the template first, so inserted text is never searched
    parts, rest = [], template
    while rest:
        spots = [(rest.find("{" + k + "}"), k) for k in fills if "{" + k + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, k = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(fills[k])
        rest = rest[at + len(k) + 2:]
    prompt = F.concat(*parts) if parts else F.lit("")
    out = contexts.select(KEY, "chapter_ix", label.alias("label"), "current", prompt.alias("prompt"))
    return out.select(
        KEY, "chapter_ix", "label", "prompt",
        F.length("current").alias("transcript_chars"),
        F.length("prompt").alias("total_chars"),
        F.floor(F.length("prompt") / 4).cast("bigint").alias("approx_tokens"),
    )


def rolling_summary(batches: DataFrame, *, ident: str = "clip_id", batch: str = "batch_ix", line: str = "line") -> DataFrame:
    """Text of all earlier batches of the same search, in order.

    A search covers at most a minute of frames, so it holds few batches.
    """
    w = Window.partitionBy(KEY, ident).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("summary", F.array_join(F.collect_list(line).over(w), "\n"))


def pick_candidates(
    results: DataFrame, *, entry: bool, ident: str = "clip_id", batch: str = "batch_ix", value: str = "candidate",
    first: str = "first_t", last: str = "last_t",
) -> DataFrame:
    """One time per search from its batch results.

    None found: first (entry) or last (exit) frame at 0.5; one: itself at 0.75; several:
    the latest (entry) or earliest (exit) at 0.7.
    """
    agg = results.groupBy(KEY, ident).agg(
        F.count(value).alias("found"), F.max(value).alias("hi"), F.min(value).alias("lo"),
        F.min(first).alias("t0"), F.max(last).alias("t1"),
    )
    edge = F.col("t0") if entry else F.col("t1")
    many = F.col("hi") if entry else F.col("lo")
    return agg.select(
        KEY, ident, "found",
        F.when(F.col("found") == 0, edge).otherwise(many).alias("safe_t"),
        F.when(F.col("found") == 0, 0.5).when(F.col("found") == 1, 0.75).otherwise(0.7).alias("confidence"),
    )
