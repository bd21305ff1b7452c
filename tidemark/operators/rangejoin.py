"""Joins between points and intervals, binned so that no source meets itself whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import BIN, bin_of, last_value, range_over, scan, with_halo


def spread(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """One copy of an interval per bin it touches (none when it ends before it starts)."""
    lo, hi = bin_of(start, width), bin_of(end, width)
    return df.where(end >= start).withColumn(BIN, F.explode(F.sequence(lo, hi)))


def _salted(points: DataFrame, spans: DataFrame, salt: int, by: Sequence[str]):
    if salt <= 1:
        return points, spans, []
    points = points.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salt)).cast("int"))
    spans = spans.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salt)])))
    return points, spans, ["__salt"]


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    *,
    t: str,
    start: str,
    end: str,
    key: Sequence[str] = ("source_id",),
    width: float = 60.0,
    salt: int = 1,
    salt_by: Sequence[str] | None = None,
    how: str = "inner",
    start_open: bool = False,
    end_open: bool = False,
) -> DataFrame:
    """Row-level containment join ``start <= t <= end``.

    A point lies in one bin, an interval in every bin it touches, so each pair meets
    once.  ``salt`` splits the points of one hot bin over that many tasks.
    """
    key = list(key)
    left = points.withColumn(BIN, bin_of(F.col(t), width))
    right = spread(intervals, F.col(start), F.col(end), width)
    left, right, extra = _salted(left, right, salt, salt_by or points.columns)
    on = [*key, BIN, *extra]
    p, i = left.alias("p"), right.alias("i")
    cond = F.col(f"p.{on[0]}") == F.col(f"i.{on[0]}")
    for c in on[1:]:
        cond &= F.col(f"p.{c}") == F.col(f"i.{c}")
    cond &= (F.col(f"p.{t}") > F.col(f"i.{start}")) if start_open else (F.col(f"p.{t}") >= F.col(f"i.{start}"))
    cond &= (F.col(f"p.{t}") < F.col(f"i.{end}")) if end_open else (F.col(f"p.{t}") <= F.col(f"i.{end}"))
    out = p.join(i, cond, how)
    cols = [F.col(f"p.{c}") for c in points.columns]
    if how not in ("left_semi", "left_anti"):
        cols += [F.col(f"i.{c}") for c in intervals.columns if c not in key]
    return out.select(*cols)


def overlaps(
    left: DataFrame,
    right: DataFrame,
    *,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    key: Sequence[str] = ("source_id",),
    width: float = 60.0,
    prefix: str = "r_",
) -> DataFrame:
    """Pairs with ``right.end > left.start AND right.start < left.end``.

    Both sides are spread over their bins; a pair is emitted only in the first bin the
    two share, so it appears once.  Columns of ``right`` get ``prefix``.
    """
    key = list(key)
    (ls, le), (rs, re_) = left_span, right_span
    a = spread(left, F.col(ls), F.col(le), width)
    b = spread(right, F.col(rs), F.col(re_), width)
    b = b.select(
        *[F.col(k).alias(f"__k_{k}") for k in key],
        F.col(BIN).alias("__rbin"),
        *[F.col(c).alias(prefix + c) for c in right.columns if c not in key],
    )
    cond = F.col(BIN) == F.col("__rbin")
    for k in key:
        cond &= F.col(k) == F.col(f"__k_{k}")
    rs, re_ = prefix + rs, prefix + re_
    cond &= (F.col(re_) > F.col(ls)) & (F.col(rs) < F.col(le))
    cond &= F.col(BIN) == bin_of(F.greatest(F.col(ls), F.col(rs)), width)
    return a.join(b, cond, "inner").drop(BIN, "__rbin", *[f"__k_{k}" for k in key])


def nearest_spikes(
    queries: DataFrame,
    spikes: DataFrame,
    *,
    start: str,
    end: str,
    spike_t: str,
    lookback: float,
    lookahead: float,
    key: str = "source_id",
    width: float | None = None,
) -> DataFrame:
    """Earliest spike in ``[start-lookback, start]`` and latest in ``[end, end+lookahead]``.

    No join: both ends of a query and all spike times form one stream per (source, bin),
    with spikes copied into the neighbouring bin where a look may cross the border, and
    two range windows read the answer.  Spike times are first made distinct.
    """
    width = width or max(4 * (lookback + lookahead), 60.0)
    times = spikes.select(key, F.col(spike_t).alias("__t")).distinct()
    halo = with_halo(times, F.col("__t"), width=width, before=lookback, after=lookahead)
    ids = [c for c in queries.columns if c != key]
    # equal queries stay apart by a running number
    packed = queries.withColumn("__u", F.monotonically_increasing_id()).select(key, F.struct(*ids, "__u").alias("__q"))
    ends = packed.select(
        key,
        "__q",
        F.explode(F.array(F.lit("s"), F.lit("e"))).alias("__side"),
    ).withColumn(
        "__t", F.when(F.col("__side") == "s", F.col(f"__q.{start}")).otherwise(F.col(f"__q.{end}"))
    )
    stream = halo.select(
        key, BIN, "__t", F.col("__t").alias("__spike"), F.lit(None).alias("__side"),
        F.lit(None).cast(ends.schema["__q"].dataType).alias("__q"),
    ).unionByName(
        ends.select(
            key, bin_of(F.col("__t"), width).alias(BIN), "__t",
            F.lit(None).cast("double").alias("__spike"), "__side", "__q",
        )
    )
    seen = stream.withColumns(
        {
            "__first": range_over("min(__spike)", [key, BIN], "__t", back=lookback),
            "__last": range_over("max(__spike)", [key, BIN], "__t", ahead=lookahead),
        }
    ).where(F.col("__side").isNotNull())
    return (
        seen.groupBy(key, "__q")
        .agg(
            F.max(F.when(F.col("__side") == "s", F.col("__first"))).alias("spike_before"),
            F.max(F.when(F.col("__side") == "e", F.col("__last"))).alias("spike_after"),
        )
        .select(key, "__q.*", "spike_before", "spike_after")
        .drop("__u")
    )


def asof_last(
    rows: DataFrame, marks: DataFrame, *, pos: str, mark_pos: str, value: Column, name: str,
    key: str = "source_id", width: float = 600.0, tie: str,
) -> DataFrame:
    """Value of the last mark at or before each row (as-of join by union and scan)."""
    packed = rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias("__r"))
    left = packed.select(
        key, F.col(f"__r.{pos}").cast("double").alias("__p"), F.lit(1).alias("__o"),
        F.col(f"__r.{tie}").cast("bigint").alias("__tie"), "__r", F.lit(None).alias("__v"),
    )
    right = marks.select(
        key, F.col(mark_pos).cast("double").alias("__p"), F.lit(0).alias("__o"),
        F.lit(0).cast("bigint").alias("__tie"),
        F.lit(None).cast(packed.schema["__r"].dataType).alias("__r"), value.alias("__v"),
    )
    stream = right.unionByName(left)
    out = scan(
        stream, [key], ["__p", "__o", "__tie"], {name: last_value(F.col("__v"))}, pos="__p", width=width
    )
    return out.where(F.col("__r").isNotNull()).select(key, "__r.*", name)
