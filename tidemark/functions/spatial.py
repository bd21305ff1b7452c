"""Boxes, crop geometry and frame numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PORTRAIT = 9 / 16


def parse_ratio(ratio: Column) -> Column:
    """``W:H`` as a number; anything else is 9/16."""
    parts = F.split(ratio, ":")
    w = F.get(parts, F.lit(0)).try_cast("int")
    h = F.get(parts, F.lit(1)).try_cast("int")
    good = (F.size(parts) == 2) & w.isNotNull() & h.isNotNull() & (h != 0)
    return F.when(good, w / h).otherwise(F.lit(PORTRAIT))


def even_size(height: Column, ratio: Column) -> tuple[Column, Column]:
    """Output width and height, both rounded up to even."""
    h = height + F.pmod(height, F.lit(2))
    w = F.floor(h * parse_ratio(ratio)).cast("bigint")
    return w + F.pmod(w, F.lit(2)), h


def crop_box(x1: Column, x2: Column, frame_w: Column, frame_h: Column, ratio: float = PORTRAIT) -> Column:
    """Full-height crop around a target's centre, pushed back inside left, then right."""
    width = (frame_h * F.lit(ratio)).cast("int")
    centre = (x1 + x2) / 2
    left, right = (centre - width / 2).cast("int"), (centre + width / 2).cast("int")
    l1 = F.when(left < 0, F.lit(0)).otherwise(left)
    r1 = F.when(left < 0, width).otherwise(right)
    l2 = F.when(r1 > frame_w, frame_w - width).otherwise(l1)
    r2 = F.when(r1 > frame_w, frame_w).otherwise(r1)
    return F.array(l2.cast("int"), F.lit(0), r2.cast("int"), frame_h.cast("int"))


def crop_strategy(people: Column, group_width: Column, frame_h: Column, ratio: float = PORTRAIT) -> Column:
    """Follow one person, or a group narrower than the crop; otherwise letterbox."""
    return (
        F.when(people == 0, "LETTERBOX")
        .when(people == 1, "TRACK")
        .when(group_width < frame_h * F.lit(ratio), "TRACK")
        .otherwise("LETTERBOX")
    )


def sampled_frames(start_s: Column, end_s: Column, fps: Column, interval_s: Column, frames: Column) -> Column:
    """Frame numbers every ``int(fps * interval)``, the start aligned down, the end exclusive."""
    stride = F.floor(fps * interval_s).cast("bigint")
    first = F.floor(start_s * fps).cast("bigint")
    last = F.least(F.floor(end_s * fps).cast("bigint"), frames) - 1
    aligned = first - F.pmod(first, stride)
    return F.when(aligned <= last, F.sequence(aligned, last, stride)).otherwise(F.array().cast("array<bigint>"))
