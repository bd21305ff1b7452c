"""Signal operators: framing, energy, smoothing, percentile gates, onsets and offsets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rangejoin import points_in_intervals
from tidemark.operators.scan import BIN, range_over, running_sum, scan, with_halo
from tidemark.session import cut_lineage

COMBAT_LABELS = (
    # fixed values: classifier labels that count as combat
    "Gunshot, gunfire",
    "Explosion",
    "Fusillade",
    "Artillery fire",
    "Machine gun",
    "Breaking",
    "Shatter",
    "Smash, crash",
    "Bang",
    "Burst, pop",
)



def silence_steps(gap_s: float, resolution_s: float) -> int:
    """Quiet samples in a row whose steps, added up one by one as doubles, first exceed ``gap_s``."""
    steps, passed = 0, 0.0
    while passed <= gap_s:
        passed += resolution_s
        steps += 1
    return steps


# the gaps allowed are seconds; on samples of 0.2 s they are so many steps
SILENCE_BEFORE, SILENCE_AFTER = silence_steps(2.0, 0.2), silence_steps(3.0, 0.2)

Frames = Callable[[DataFrame, str, str], DataFrame]
"""(ranges, start column, end column) -> one row per range and frame: columns of the range, ``t`` and measures."""


def frame_rms(signal: DataFrame, *, length: int, stride: int, key: Sequence[str] = ("source_id", "chunk_ix")) -> DataFrame:
    """Frames of ``length`` samples every ``stride``: frame number and its energy.

    A chunk shorter than a frame gives none.  Only the energy leaves the array functions.
    """
    n = F.size("samples")
    values = F.transform(
        F.sequence(F.lit(0), F.floor((n - length) / stride).cast("int")),
        lambda i: frame_energy(F.slice("samples", i * stride + 1, length)),
    )
    return signal.where(n >= length).select(*key, F.posexplode(values).alias("frame_ix", "rms"))


def frame_energy(samples: Column) -> Column:
    """Root mean square of an array."""
    squares = F.aggregate(
        samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares / F.size(samples))


def smooth_width(smooth_s: float, chunk_s: float) -> int:
    return int(smooth_s / (chunk_s / 2))


def moving_average(
    profile: DataFrame, *, rows: int, value: str = "rms", ix: str = "ix", name: str = "smoothed",
    key: str = "source_id", width: int = 4096,
) -> DataFrame:
    """Centred mean of ``rows`` values with zeros beyond the ends.

    ``ix`` numbers the rows of a source without holes.  Bins of ``width`` rows see their
    neighbours' edges, so no source is sorted in one task.
    """
    back = rows // 2
    ahead = rows - 1 - back
    halo = with_halo(profile, F.col(ix), width=max(width, rows), before=back, after=ahead)
    w = Window.partitionBy(key, BIN).orderBy(ix).rangeBetween(-back, ahead)
    out = halo.withColumn(name, F.sum(value).over(w) / rows)
    return out.where("__own").drop(BIN, "__own")


def exact_quantiles(
    df: DataFrame, value: str, at: Mapping[str, float], *, key: str = "source_id", buckets: int = 256
) -> DataFrame:
    """Exact linear-interpolated quantiles per key (name to p), all from one scan.

    Equal values are counted first.  Each key's values are cut into ``buckets`` cells at
    approximate quantiles, so that cells hold like numbers of values however these are
    spread; a scan over cell counts ranks the values, and those around the ranks are read off.
    """
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    bounds = df.groupBy(key).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, 10 * buckets).alias("cuts"), F.count(value).alias("n")
    )
    # The cell is the number of cuts below the value, found by halving.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((buckets - 1).bit_length()))])
    cell = F.aggregate(
        steps, F.lit(0), lambda done, step: done + F.when(F.get("cuts", done + step - 1) < F.col("v"), step).otherwise(0)
    )
    ranked = scan(
        counts.join(bounds, key).withColumn("cell", cell.cast("double")).drop("cuts"),
        [key], ["v"], {"upto": running_sum(F.col("c"))}, pos="cell", width=1.0, even=True,
    )
    covers = lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c"))
    wanted, sides, out = F.lit(False), [], []
    for name, p in at.items():
        rank = (F.col("n") - 1) * p
        below, above = F.floor(rank), F.ceil(rank)
        wanted = wanted | covers(below) | covers(above)
        a, b, w = (f"__{side}_{name}" for side in "abw")
        sides += [
            F.max(F.when(covers(below), F.col("v"))).alias(a), F.max(F.when(covers(above), F.col("v"))).alias(b),
            F.max(rank - below).alias(w),
        ]
        out.append((F.col(a) + (F.col(b) - F.col(a)) * F.col(w)).alias(name))
    return ranked.where(wanted).groupBy(key).agg(*sides).select(key, *out)


def exact_quantile(
    df: DataFrame, value: str, p: float, *, key: str = "source_id", name: str = "quantile", buckets: int = 256
) -> DataFrame:
    """One exact quantile per key."""
    return exact_quantiles(df, value, {name: p}, key=key, buckets=buckets)


def quiet_gate(
    chunks: DataFrame, profile: DataFrame, *, chunk_s: float, p: float = 0.7, key: str = "source_id",
    t: str = "t", ix: str = "ix", value: str = "smoothed",
) -> DataFrame:
    """Drop chunks whose profile slot ``int(t / (chunk / 2))`` is below the quantile ``p``.

    A chunk past the end of the profile passes.  One quantile per source is joined.
    """
    gate = exact_quantile(profile, value, p, key=key, name="gate")
    slots = profile.select(key, F.col(ix).alias("slot"), F.col(value).alias("level"))
    with_slot = chunks.withColumn("slot", F.floor(F.col(t) / (chunk_s / 2)).cast("bigint"))
    joined = with_slot.join(slots, [key, "slot"], "left").join(gate, key, "left")
    return joined.where(~F.coalesce(F.col("level") < F.col("gate"), F.lit(False))).drop("slot")


def chunk_scores(
    labels: DataFrame, *, allowed: Sequence[str] = COMBAT_LABELS, top: int = 20,
    chunk: Sequence[str] = ("source_id", "chunk_ix"), tie: str = "label",
) -> DataFrame:
    """Sum of allowed labels among the ``top`` highest scored of a chunk, capped at 1.

    The rank limit is applied before the shuffle too, so a task sends at most ``top`` rows
    per chunk.
    """
    w = Window.partitionBy(*chunk).orderBy(F.col("score").desc(), tie)
    best = labels.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    hit = F.when(F.col("label").isin(*allowed), F.col("score")).otherwise(0.0)
    return best.groupBy(*chunk).agg(F.least(F.sum(hit), F.lit(1.0)).alias("score"))


def in_ranges(
    profile: DataFrame, ranges: DataFrame, *, start: str, end: str, t: str = "t",
    half_chunk: float = 0.0, key: str = "source_id", width: float = 60.0,
) -> DataFrame:
    """Profile rows whose whole window lies in a range (one copy per range)."""
    spans = ranges.withColumns(
        {"__lo": F.col(start) + half_chunk, "__hi": F.col(end) - half_chunk}
    )
    return points_in_intervals(profile, spans, t=t, start="__lo", end="__hi", key=[key], width=width).drop(
        "__lo", "__hi"
    )


def range_frames(
    signal: DataFrame, ranges: DataFrame, *, start: str, end: str, rate: float, chunk_samples: int, window_s: float,
    resolution_s: float, measures: Mapping[str, Callable[[Column], Column]] | None = None, key: str = "source_id",
) -> DataFrame:
    """Frames of ``window_s`` every ``resolution_s`` that begin at each range's own start and end within it.

    ``signal`` has rows (key, chunk_ix, samples), all chunks but the last of ``chunk_samples``.  The
    chunks that a range meets are laid end to end, and the frames are slices of that one array, so that a
    row is as large as a range, never as a source.  ``measures`` name what is worked out of a frame's
    samples (its energy as ``rms`` by default).  A range with a chunk missing, or shorter than
    a frame, has no frames.
    """
    measures = measures or {"rms": frame_energy}
    length, stride = max(1, int(window_s * rate)), max(1, int(resolution_s * rate))
    sizes = signal.groupBy(key).agg(F.max(F.col("chunk_ix") * chunk_samples + F.size("samples")).alias("__len"))
    first = F.floor(F.col(start) * rate).cast("bigint")
    stop = F.least(F.floor(F.col(end) * rate).cast("bigint"), F.col("__len"))
    spans = ranges.withColumn("__id", F.monotonically_increasing_id()).join(sizes, key)
    spans = spans.withColumns({"__first": first, "__room": stop - first - length}).where(F.col("__room") >= 0).drop("__len")
    spans = spans.withColumn("__n", F.floor(F.col("__room") / stride).cast("int") + 1)
    spans = spans.withColumns({
        "__from": F.floor(F.col("__first") / chunk_samples).cast("bigint"),
        "__to": F.floor((F.col("__first") + (F.col("__n") - 1) * stride + length - 1) / chunk_samples).cast("bigint"),
    })
    # one row per range, read twice below: the running number must be the same both times
    spans = cut_lineage(spans)
    asked = spans.select(key, "__id", F.explode(F.sequence("__from", "__to")).alias("chunk_ix"))
    met = asked.join(signal.select(key, "chunk_ix", "samples"), [key, "chunk_ix"]).groupBy("__id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_ix", "samples"))).alias("__chunks")
    )
    whole = spans.join(met, "__id").where(F.size("__chunks") == F.col("__to") - F.col("__from") + 1)
    whole = whole.withColumn("__all", F.flatten(F.transform("__chunks", lambda c: c["samples"])))
    base = (F.col("__first") - F.col("__from") * chunk_samples).cast("int")

    def frame(i: Column) -> Column:
        samples = F.slice("__all", base + i * stride + 1, F.lit(length))
        at = (F.col("__first") + i * stride) / F.lit(float(rate)) + window_s / 2
        return F.struct(at.alias("t"), *[f(samples).alias(n) for n, f in measures.items()])

    frames = whole.withColumn("__f", F.explode(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), frame)))
    return frames.select(*ranges.columns, "__f.*")


def signal_frames(signal: DataFrame, *, key: str = "source_id", **settings) -> Frames:
    """Frames for :func:`onset` and :func:`offset`, cut from the signal at each range's start."""
    return lambda ranges, start, end: range_frames(signal, ranges, start=start, end=end, key=key, **settings)


def _frames(source: DataFrame | Frames, ranges: DataFrame, *, start: str, end: str, half_chunk: float, key: str) -> DataFrame:
    """Frames of each range: cut anew, or the rows of a profile whose window lies in the range."""
    if callable(source):
        return source(ranges, start, end)
    return in_ranges(source, ranges, start=start, end=end, half_chunk=half_chunk, key=key)


def lowest_dip(
    profile: DataFrame, ranges: DataFrame, *, start: str, end: str, ident: str = "clip_id",
    value: str = "smoothed", t: str = "t", key: str = "source_id",
) -> DataFrame:
    """Time of the lowest value in each range, the earliest on ties."""
    rows = in_ranges(profile, ranges.select(key, ident, start, end), start=start, end=end, t=t, key=key)
    return rows.groupBy(key, ident).agg(
        F.min_by(t, F.struct(F.col(value), F.col(t))).alias("dip_t"), F.min(value).alias("dip_value")
    )


def peaks(
    rows: DataFrame, *, ident: str = "clip_id", score: str = "score", t: str = "t", key: str = "source_id",
    floor: float = 0.1,
) -> DataFrame:
    """Highest sample per range, earliest on ties; none below ``floor``."""
    best = rows.groupBy(key, ident).agg(
        F.max_by(t, F.struct(F.col(score), -F.col(t))).alias("peak_t"), F.max(score).alias("peak_score")
    )
    return best.where(F.col("peak_score") >= floor)


def anchor_threshold(score_threshold: float = 0.30) -> float:
    return max(0.5 * score_threshold, 0.1)


def last_anchor(
    rows: DataFrame, *, ident: str = "clip_id", score: str = "score", t: str = "t",
    key: str = "source_id", threshold: float = 0.15,
) -> DataFrame:
    """Latest sample at or above the anchor threshold."""
    return rows.where(F.col(score) >= threshold).groupBy(key, ident).agg(
        F.max(t).alias("anchor_t"), F.max_by(score, t).alias("anchor_score")
    )


def local_gate(
    rows: DataFrame, *, ident: str = "clip_id", p: float = 0.3, rms: str = "rms", score: str = "score",
    key: str = "source_id",
) -> DataFrame:
    """Zero the score of samples below the range's own quantile of energy.

    A range is one clip's search window, at most a minute or so of samples, so a window
    over it is of bounded size and the steps after it need no further shuffle.
    """
    whole = Window.partitionBy(key, ident)
    gated = rows.withColumn("gate", F.percentile(rms, F.lit(p)).over(whole))
    return gated.withColumn(
        "gated_score", F.when(F.col(rms) < F.col("gate"), F.lit(0.0)).otherwise(F.col(score))
    )


def _range_anchors(
    ranges: DataFrame, scores: DataFrame | Frames, *, start: str, end: str, ident: str, key: str, half_chunk: float,
    threshold: float, min_rows: int,
) -> DataFrame:
    """Peak and last sample at the threshold of each range, on locally gated scores."""
    spans = ranges.select(key, ident, F.col(start).alias("__ws"), F.col(end).alias("__we"))
    rows = _frames(scores, spans, start="__ws", end="__we", half_chunk=half_chunk, key=key)
    s, t = F.col("gated_score"), F.col("t")
    high = F.when(s >= threshold, t)
    found = local_gate(rows, ident=ident, key=key).groupBy(key, ident).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.max("__ws").alias("__ws"),
        F.max("__we").alias("__we"),
        F.max_by(t, F.struct(s, -t)).alias("peak_t"),
        F.max(s).alias("peak_score"),
        F.max(high).alias("late_t"),
        F.max_by(s, high).alias("late_score"),
    )
    return found.where(F.col("__rows") >= min_rows)


def _trace(
    anchors: DataFrame, profile: DataFrame | Frames, *, lo: Column, hi: Column, forward: bool, silence_n: int,
    factor: float, floor: float, ident: str, key: str, half_chunk: float,
) -> DataFrame:
    # one row per range, read twice below
    anchors = cut_lineage(anchors)
    spans = anchors.select(key, ident, lo.alias("__a"), hi.alias("__b"))
    levels = profile if callable(profile) else profile.select(key, "t", "rms")
    rows = _frames(levels, spans, start="__a", end="__b", half_chunk=half_chunk, key=key)
    whole = Window.partitionBy(key, ident)
    walk = whole.orderBy(F.col("t").asc() if forward else F.col("t").desc())
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    level = F.greatest(F.percentile("rms", F.lit(0.2)).over(whole) * factor, F.lit(floor))
    last_loud = F.coalesce(F.max(F.when(F.col("__loud"), F.col("__n"))).over(upto), F.lit(0))
    walked = (
        rows.withColumn("__loud", F.col("rms") > level)
        .withColumn("__n", F.row_number().over(walk))
        .withColumn("__quiet", F.col("__n") - last_loud)
        .withColumn("__stopped", F.max((F.col("__quiet") >= silence_n).cast("int")).over(upto))
    )
    reach = F.max("t") if forward else F.min("t")
    found = walked.where(F.col("__loud") & (F.col("__stopped") == 0)).groupBy(key, ident).agg(reach.alias("__t"))
    return anchors.join(found, [key, ident], "left")


def _confidence(moved: Column) -> Column:
    lifted = F.when(moved, F.greatest(F.col("anchor_score"), F.lit(0.7))).otherwise(F.col("anchor_score"))
    return F.least(F.greatest(lifted, F.lit(0.0)), F.lit(1.0)).alias("confidence")


def onset(
    ranges: DataFrame, scores: DataFrame | Frames, profile: DataFrame | Frames, *, start: str, end: str,
    ident: str = "clip_id", key: str = "source_id", silence_n: int = SILENCE_BEFORE, factor: float = 2.0,
    floor: float = 0.005, score_threshold: float = 0.30, half_chunk: float = 0.0, min_rows: int = 4,
) -> DataFrame:
    """Where the noise before the last combat sample of a range began.

    From the anchor walk back while samples are loud (above ``factor`` times the 20th
    percentile), allowing fewer than ``silence_n`` quiet samples in a row.  A found lead-up
    lifts the confidence to at least 0.7.  Ranges with too few samples or no anchor give none.
    ``scores`` (t, rms, score) and ``profile`` (t, rms) are profiles of whole sources, or frames cut at
    each range (:func:`signal_frames`), as a rule every 0.5 s and every 0.2 s.
    """
    found = _range_anchors(
        ranges, scores, start=start, end=end, ident=ident, key=key, half_chunk=half_chunk,
        threshold=anchor_threshold(score_threshold), min_rows=min_rows,
    )
    anchors = found.where(F.col("late_t").isNotNull()).select(
        key, ident, "__ws", F.col("late_t").alias("anchor_t"), F.col("late_score").alias("anchor_score")
    )
    out = _trace(
        anchors, profile, lo=F.col("__ws"), hi=F.col("anchor_t"), forward=False, silence_n=silence_n,
        factor=factor, floor=floor, ident=ident, key=key, half_chunk=half_chunk,
    )
    t = F.least(F.coalesce("__t", "anchor_t"), F.col("anchor_t"))
    return out.select(key, ident, "anchor_t", t.alias("onset_t"), _confidence(t < F.col("anchor_t")))


def offset(
    ranges: DataFrame, scores: DataFrame | Frames, profile: DataFrame | Frames, *, start: str, end: str,
    ident: str = "clip_id", key: str = "source_id", silence_n: int = SILENCE_AFTER, factor: float = 2.5,
    floor: float = 0.005, score_threshold: float = 0.30, half_chunk: float = 0.0, min_rows: int = 4,
    min_peak: float = 0.1,
) -> DataFrame:
    """Where the noise after the last combat sample of a range died down (see :func:`onset`).

    The anchor is the last sample after the peak that reaches the threshold, else the peak.
    """
    found = _range_anchors(
        ranges, scores, start=start, end=end, ident=ident, key=key, half_chunk=half_chunk,
        threshold=anchor_threshold(score_threshold), min_rows=min_rows,
    )
    later = F.coalesce(F.col("late_t") > F.col("peak_t"), F.lit(False))
    anchors = found.where(F.col("peak_score") >= min_peak).select(
        key, ident, "__we",
        F.when(later, F.col("late_t")).otherwise(F.col("peak_t")).alias("anchor_t"),
        F.when(later, F.col("late_score")).otherwise(F.col("peak_score")).alias("anchor_score"),
    )
    out = _trace(
        anchors, profile, lo=F.col("anchor_t"), hi=F.col("__we"), forward=True, silence_n=silence_n,
        factor=factor, floor=floor, ident=ident, key=key, half_chunk=half_chunk,
    )
    t = F.greatest(F.coalesce("__t", "anchor_t"), F.col("anchor_t"))
    return out.select(key, ident, "anchor_t", t.alias("offset_t"), _confidence(t > F.col("anchor_t")))
