"""Gap splitting, burst clustering and interval merging.

All of them are "island" problems: sort, start a new island where a row does not reach
back to the ones before it, aggregate each island.  Island formation is associative, so
it is done twice: first inside (source, time bin, piece), which collapses the data next to where
it lies, then per source over the islands that are left.  Pieces bound the rows of a bin
(see ``scan``).  Two islands of one piece are further apart than the allowed gap, so a source
keeps at most ``timeline / gap + timeline / bin width + pieces`` islands, whatever its row count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rangejoin import points_in_intervals
from tidemark.operators.scan import (
    BIN, PIECE, alike, key_columns, last_value, plain_keys, running_max, running_sum, scan, with_pieces,
)

SPIKE = "audio_combat_spike"

JoinRule = Callable[[Column, Column, Column, Column], Column]
"""(running end, previous row's tail, this start, this head) -> does this row join?"""


@dataclass(frozen=True)
class Agg:
    """An aggregate of rows that can also be aggregated again."""

    first: Column
    again: Callable[[Column], Column]


def total(col: Column) -> Agg:
    return Agg(F.sum(col), F.sum)


def count() -> Agg:
    return Agg(F.count(F.lit(1)), F.sum)


def highest(col: Column) -> Agg:
    return Agg(F.max(col), F.max)


def lowest(col: Column) -> Agg:
    return Agg(F.min(col), F.min)


def label_set(col: Column) -> Agg:
    """Distinct labels; bounded by the detector's class list."""
    return Agg(F.collect_set(col), lambda c: F.array_distinct(F.flatten(F.collect_set(c))))


def _number(df: DataFrame, part: Sequence[str], order: Sequence[str], rule: JoinRule) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"__reach": F.max("__end").over(earlier), "__ptail": F.lag("__tail").over(w)})
    joins = rule(F.col("__reach"), F.col("__ptail"), F.col("__start"), F.col("__head"))
    fresh = F.when(F.col("__reach").isNull() | ~joins, 1).otherwise(0)
    return df.withColumn("__fresh", fresh).withColumn(
        "__isl", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def _number_far(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: JoinRule, width: float) -> DataFrame:
    """As :func:`_number` for sources with any number of rows: two scans instead of one window."""
    renamed = {BIN: "__home", PIECE: "__part", **{k: f"__own{k}" for k in keys}}
    home = df.withColumnsRenamed(renamed)
    order, keys = [renamed.get(c, c) for c in order], [renamed[k] for k in keys]
    seen = scan(
        home, keys, order,
        {"__reach": running_max(F.col("__end"), inclusive=False), "__ptail": last_value(F.col("__tail"), inclusive=False)},
        pos="__start", width=width,
    )
    joins = rule(F.col("__reach"), F.col("__ptail"), F.col("__start"), F.col("__head"))
    fresh = F.when(F.col("__reach").isNull() | ~joins, 1).otherwise(0)
    out = scan(
        seen.withColumn("__fresh", fresh), keys, order, {"__isl": running_sum(F.col("__fresh"))}, pos="__start", width=width
    )
    return out.withColumnsRenamed({new: old for old, new in renamed.items()})


def islands(
    df: DataFrame,
    rule: JoinRule,
    aggs: dict[str, Agg],
    *,
    start: Column,
    end: Column,
    head: Column | None = None,
    tail: Column | None = None,
    tie: Sequence[str] = (),
    key: str | Sequence[str] = "source_id",
    width: float = 600.0,
    number: str = "island_ix",
    apart: bool = True,
    even: bool = False,
) -> DataFrame:
    """Merge rows into islands; one row each with start, end, aggregates and a number from 0.

    ``apart`` says that the rule leaves a gap between islands, which bounds their number per
    source; without it the second step scans in wider bins instead of one window.  ``even``
    says that the rows of a bin are bounded as they stand.

    ``head`` / ``tail`` are carried from an island's first / last row for rules that look
    at more than time.  ``tie`` orders rows of equal start.
    """
    names = [key] if isinstance(key, str) else list(key)
    none = F.lit(None).cast("string")
    keyed, keys = plain_keys(df, names)
    rows = keyed.withColumns(
        {"__start": start, "__end": end, "__head": none if head is None else head, "__tail": none if tail is None else tail}
    )
    order = ["__start", *tie]
    # equal places are told apart by their ends where no tie is named
    rows = with_pieces(rows, keys, [*order, "__end"], F.col("__start"), width, even=even)
    near = _number(rows, [*keys, BIN, PIECE], [*order, "__end"], rule)
    place = F.struct(*order, "__end")
    small = near.groupBy(*keys, BIN, PIECE, F.col("__isl").alias("__near")).agg(
        F.min("__start").alias("__s"),
        F.max("__end").alias("__e"),
        F.min_by("__head", place).alias("__head"),
        F.max_by("__tail", place).alias("__tail"),
        *[a.first.alias(n) for n, a in aggs.items()],
    ).withColumnsRenamed({"__s": "__start", "__e": "__end"})
    far = ["__start", BIN, PIECE, "__near"]
    wide = _number(small, keys, far, rule) if apart else _number_far(small, keys, far, rule, 16 * width)
    out = wide.groupBy(*keys, "__isl").agg(
        F.min("__start").alias("start"),
        F.max("__end").alias("end"),
        *[a.again(F.col(n)).alias(n) for n, a in aggs.items()],
    )
    return out.select(*key_columns(names), (F.col("__isl") - 1).cast("bigint").alias(number), "start", "end", *aggs)


def time_points(events: DataFrame, *, key: str = "source_id", t: str = "timestamp_s",
                label: str = "label", tie: str = "event_id", **extra: Column) -> DataFrame:
    """Collapse events of equal time: count, first and last label, any extra aggregate."""
    return events.groupBy(key, F.coalesce(F.col(t), F.lit(0.0)).alias("t")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(label, tie).alias("first_label"),
        F.max_by(label, tie).alias("last_label"),
        *[c.alias(n) for n, c in extra.items()],
    )


def _gap_rule(gap_s: float, bridge_s: float, audio_label: str) -> JoinRule:
    wide_gap = max(gap_s, bridge_s)

    def rule(reach: Column, ptail: Column, start: Column, head: Column) -> Column:
        beside = (ptail == audio_label) | (head == audio_label)
        limit = F.when(F.coalesce(beside, F.lit(False)), wide_gap).otherwise(gap_s)
        return (start - reach) < limit

    return rule


def gap_segments(
    events: DataFrame,
    *,
    gap_s: float = 30.0,
    bridge_s: float = 60.0,
    audio_label: str = SPIKE,
    key: str = "source_id",
    width: float = 600.0,
    points: DataFrame | None = None,
    aggs: dict[str, Agg] | None = None,
) -> DataFrame:
    """Split at gaps ``>= gap_s``, or ``>= max(gap_s, bridge_s)`` beside an audio spike.

    Returns one row per segment: segment_id (from 1), start, end, n_events.
    """
    pts = points if points is not None else time_points(events, key=key)
    out = islands(
        pts, _gap_rule(gap_s, bridge_s, audio_label), {"n_events": total(F.col("n")), **(aggs or {})},
        start=F.col("t"), end=F.col("t"), head=F.col("first_label"), tail=F.col("last_label"),
        key=key, width=width, number="segment_ix", even=True,  # one row per time of two decimals
    )
    return out.select(key, (F.col("segment_ix") + 1).alias("segment_id"), "start", "end", "n_events",
                      *(aggs or {}))


def number_segments(
    events: DataFrame, *, counted: Column, gap_s: float = 30.0, bridge_s: float = 60.0, audio_label: str = SPIKE,
    key: str = "source_id", t: str = "timestamp_s", tie: str = "event_id", width: float = 600.0,
) -> DataFrame:
    """Every event with its segment and its place in it, from one shuffle of the events.

    Adds segment_id, segment_events, ``ix`` (position in the segment, from 1) and ``rank``
    (running number of events that meet ``counted``).  Positions are counted inside
    (source, bin, piece); each island of a piece leaves one row, and the islands' running totals
    give the offset between a place in the piece and a place in the segment.  An event
    without a time counts as one at 0.
    """
    keyed, keys = plain_keys(events, [key])
    time = F.coalesce(F.col(t), F.lit(0.0))
    rows = keyed.withColumns(
        {"__start": time, "__end": time, "__head": F.col("label"), "__tail": F.col("label"),
         "__c": F.coalesce(counted, F.lit(False)).cast("bigint")}
    )
    order = ["__start", tie]
    cell = [*keys, BIN, PIECE]
    rows = with_pieces(rows, keys, order, F.col("__start"), width).repartition(*cell)
    rule = _gap_rule(gap_s, bridge_s, audio_label)
    upto = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = _number(rows, cell, order, rule).withColumns(
        {"__at": F.count(F.lit(1)).over(upto), "__seen": F.sum("__c").over(upto)}
    )
    place = F.struct(*order)
    small = (
        near.groupBy(*cell, F.col("__isl").alias("__near"))
        .agg(
            F.min("__start").alias("__s"), F.max("__end").alias("__e"), F.min_by("__head", place).alias("__head"),
            F.max_by("__tail", place).alias("__tail"), F.count(F.lit(1)).alias("__n"), F.sum("__c").alias("__k"),
            alike(events.columns).alias("__alike"),
        )
        .where(F.col("__alike") >= 0)
        .withColumnsRenamed({"__s": "__start", "__e": "__end"})
    )
    wide = _number(small, keys, ["__start", BIN, PIECE, "__near"], rule)
    before = Window.unboundedPreceding, -1
    whole = Window.partitionBy(*keys, "__isl")
    in_seg = whole.orderBy("__start", BIN, PIECE, "__near").rowsBetween(*before)
    in_bin = Window.partitionBy(*cell).orderBy("__near").rowsBetween(*before)

    def shift(c: str) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.sum(c).over(in_seg), zero) - F.coalesce(F.sum(c).over(in_bin), zero)

    place_of = wide.select(
        *cell, F.col("__near").alias("__isl"), F.col("__isl").alias("segment_id"),
        F.sum("__n").over(whole).alias("segment_events"), shift("__n").alias("__ix0"), shift("__k").alias("__rank0"),
    )
    return near.join(place_of, [*cell, "__isl"]).select(
        *events.columns, "segment_id", "segment_events",
        (F.col("__at") + F.col("__ix0")).alias("ix"), (F.col("__seen") + F.col("__rank0")).alias("rank"),
    )


def assign_segments(events: DataFrame, segments: DataFrame, *, key: str = "source_id",
                    t: str = "timestamp_s", width: float = 600.0, salt: int = 1) -> DataFrame:
    """Give every event its segment (segments are disjoint, so at most one matches)."""
    return points_in_intervals(
        events, segments.withColumnsRenamed({"start": "segment_start", "end": "segment_end", "n_events": "segment_events"}),
        t=t, start="segment_start", end="segment_end", key=[key], width=width, salt=salt,
        salt_by=["event_id"],
    )


def bursts(
    events: DataFrame, *, anchor_label: str = "ELIMINATED Text", gap_s: float = 30.0,
    key: str = "source_id", width: float = 600.0,
) -> DataFrame:
    """Cluster anchor events: a gap of at most ``gap_s`` joins."""
    pts = events.where(F.col("label") == anchor_label).groupBy(key, F.col("timestamp_s").alias("t")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return islands(
        pts, lambda reach, tail, start, head: start - reach <= gap_s,
        {"elim_count": total(F.col("n"))},
        start=F.col("t"), end=F.col("t"), key=key, width=width, number="burst_ix", even=True,
    )


def scan_windows(points: DataFrame, *, pad_s: float = 15.0, t: str = "timestamp_s",
                 key: str = "source_id", width: float = 600.0) -> DataFrame:
    """``[t - pad, t + pad]`` windows merged where they touch; start clamped at 0 on output."""
    pts = points.groupBy(key, F.col(t).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    out = islands(
        pts, lambda reach, tail, start, head: start <= reach,
        {"n_points": total(F.col("n"))},
        start=F.col("t") - pad_s, end=F.col("t") + pad_s, key=key, width=width, number="window_ix", even=True,
    )
    return out.withColumn("start", F.greatest(F.lit(0.0), F.col("start")))


def merge_intervals(
    df: DataFrame, aggs: dict[str, Agg], *, slack_s: float = 0.0, start: str = "start_time",
    end: str = "end_time", tie: Sequence[str] = (), key: str | Sequence[str] = "source_id",
    width: float = 600.0, number: str = "island_ix",
) -> DataFrame:
    """Merge intervals whose start is at most ``slack_s`` past the running end."""
    return islands(
        df, lambda reach, tail, s, head: s <= reach + F.lit(slack_s), aggs,
        start=F.col(start), end=F.col(end), tie=tie, key=key, width=width, number=number, apart=slack_s > 0,
    )
