"""Ordered scans and halos that split every source into bins of a bounded share of the rows.

A plain ``Window.partitionBy(source)`` puts one whole source into one task, and one
source may hold a third of all rows.  Here the window runs over (source, bin, piece), each
piece leaves one summary row, the summaries are scanned per source and the carried
values are joined back.

A bin is a stretch of time.  Time alone does not bound it, as one instant of one source may hold
most rows.  So bins are cut into pieces by rank: of a sample of the rows, drawn by a hash of
their place in the order, every ``DRAWN``-th is a border.  A piece then holds about one
part in ``MIN_PIECES`` (or in the number of shuffle partitions, if that is greater) of all rows at
most, whatever their times.  The borders are a table of that many rows, and so may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BIN, PIECE = "__bin", "__piece"

#: Least number of pieces that all rows are cut into, and sampled rows per piece.
MIN_PIECES, DRAWN = 32, 16

#: Bin of rows without a position; they come first, as nulls do in ascending order.
_FIRST = -(1 << 62)


def bin_of(pos: Column, width: float) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


@dataclass(frozen=True)
class Fold:
    """One scanned value: inside a bin, summed over a bin, over earlier bins, and joined."""

    local: Callable[[WindowSpec], Column]
    total: Callable[[list[str]], Column]
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


_UP, _NOW = Window.unboundedPreceding, Window.currentRow


def running_sum(col: Column, inclusive: bool = True) -> Fold:
    stop = _NOW if inclusive else -1
    zero = F.lit(0)
    return Fold(
        local=lambda w: F.coalesce(F.sum(col).over(w.rowsBetween(_UP, stop)), zero),
        total=lambda order: F.coalesce(F.sum(col), zero),
        carry=lambda c, w: F.sum(c).over(w),
        merge=lambda here, before: here + F.coalesce(before, zero),
    )


def row_number() -> Fold:
    """1-based position in the scan order."""
    return running_sum(F.lit(1).cast("bigint"))


def running_max(col: Column, inclusive: bool = True) -> Fold:
    stop = _NOW if inclusive else -1
    return Fold(
        local=lambda w: F.max(col).over(w.rowsBetween(_UP, stop)),
        total=lambda order: F.max(col),
        carry=lambda c, w: F.max(c).over(w),
        merge=lambda here, before: F.greatest(here, before),
    )


def last_value(col: Column, inclusive: bool = True) -> Fold:
    """Latest non-null value so far (with ``inclusive=False``: of earlier rows only)."""
    stop = _NOW if inclusive else -1
    return Fold(
        local=lambda w: F.last(col, ignorenulls=True).over(w.rowsBetween(_UP, stop)),
        total=lambda order: F.max_by(
            F.when(col.isNotNull(), col), F.when(col.isNotNull(), F.struct(*order))
        ),
        carry=lambda c, w: F.last(c, ignorenulls=True).over(w),
        merge=lambda here, before: F.coalesce(here, before),
    )


def next_value(col: Column, inclusive: bool = True) -> Fold:
    """Next non-null value at or after this row (``inclusive=False``: of later rows only)."""
    begin = _NOW if inclusive else 1
    after = Window.unboundedFollowing
    return Fold(
        local=lambda w: F.first(col, ignorenulls=True).over(w.rowsBetween(begin, after)),
        total=lambda order: F.min_by(
            F.when(col.isNotNull(), col), F.when(col.isNotNull(), F.struct(*order))
        ),
        carry=lambda c, w: F.first(c, ignorenulls=True).over(w),
        merge=lambda here, later: F.coalesce(here, later),
    )


def alike(columns: Sequence[str]) -> Column:
    """Count of every column, for a filter that always holds (``>= 0``) on a summary branch.

    It keeps the columns of a detail and a summary branch alike; with the not-null filters
    a join would infer stated on both, Spark reads and shuffles their common input once and
    reuses the exchange.
    """
    return sum((F.count(F.col(c)) for c in columns), F.lit(0))


_BLANK = {"string": "", "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01"}


def plain_keys(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that stand for the key and are never null, so that joins keep null keys."""
    kinds, made, absent = dict(df.dtypes), {}, F.lit(0)
    for i, k in enumerate(key):
        made[f"__k{i}"] = F.coalesce(F.col(k), F.lit(_BLANK.get(kinds[k], 0)).cast(kinds[k]))
        absent = absent + F.when(F.col(k).isNull(), 1 << i).otherwise(0)
    return df.withColumns(made | {"__absent": absent}), [*made, "__absent"]


def key_columns(key: Sequence[str]) -> list[Column]:
    """The key again, from the columns of :func:`plain_keys`."""
    return [F.when(F.col("__absent").bitwiseAND(1 << i) == 0, F.col(f"__k{i}")).alias(k) for i, k in enumerate(key)]


def _piece(order: Sequence[str], pieces: int) -> Column:
    """Number of borders (``__cuts``, ascending) below the row, found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(pieces.bit_length()))])
    place = F.struct(*order)
    below = F.aggregate(
        steps, F.lit(0), lambda done, step: done + F.when(F.get("__cuts", done + step - 1) < place, step).otherwise(0)
    )
    return F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(below)


def with_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column, width: float, *, even: bool = False
) -> DataFrame:
    """Add BIN and PIECE, which rise with ``order`` within ``keys`` (columns that are never null).

    ``even`` says that bins are bounded as they stand; they are not cut then.
    """
    binned = df.withColumn(BIN, F.coalesce(bin_of(position, width), F.lit(_FIRST)))
    if even:
        return binned.withColumn(PIECE, F.lit(0))
    keys = list(keys)
    pieces = max(MIN_PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.struct(*order).alias("__place")
    # The sample and its one window have DRAWN * pieces rows, whatever the input.
    drawn = binned.select(*keys, BIN, place).orderBy(F.xxhash64(*keys, "__place")).limit(DRAWN * pieces)
    ranked = drawn.withColumn("__r", F.row_number().over(Window.orderBy(*keys, BIN, "__place")))
    cuts = ranked.where(F.col("__r") % DRAWN == 0).groupBy(*keys, BIN).agg(
        F.array_sort(F.collect_set("__place")).alias("__cuts")
    )
    return binned.join(F.broadcast(cuts), [*keys, BIN], "left").select(*binned.columns, _piece(order, pieces).alias(PIECE))


def scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    folds: dict[str, Fold],
    *,
    pos: str | Column,
    width: float,
    backward: bool = False,
    even: bool = False,
) -> DataFrame:
    """Add one column per fold, scanning each ``key`` in ``order``.

    ``pos`` must rise with ``order``; it places a row in its bin of ``width``.  Rows whose
    position is null come first; a null key is a key of its own.  ``even`` says that the rows
    of a bin are bounded as they stand, see :func:`with_pieces`.
    ``backward`` takes the carried value from later bins (for :func:`next_value`).
    """
    order = list(order)
    position = F.col(pos) if isinstance(pos, str) else pos
    keyed, keys = plain_keys(df, list(key))
    cell = [*keys, BIN, PIECE]
    binned = with_pieces(keyed, keys, order, position, width, even=even).repartition(*cell)
    inside = Window.partitionBy(*cell).orderBy(*order)
    local = binned.withColumns({f"__l_{n}": f.local(inside) for n, f in folds.items()})
    totals = (
        binned.groupBy(*cell)
        .agg(*[f.total(order).alias(f"__t_{n}") for n, f in folds.items()], alike(df.columns).alias("__alike"))
        .where(F.col("__alike") >= 0)
    )
    across = Window.partitionBy(*keys).orderBy(BIN, PIECE)
    across = (
        across.rowsBetween(1, Window.unboundedFollowing)
        if backward
        else across.rowsBetween(_UP, -1)
    )
    carried = totals.select(
        *cell, *[f.carry(F.col(f"__t_{n}"), across).alias(f"__c_{n}") for n, f in folds.items()]
    )
    # every piece has one summary row
    joined = local.join(carried, cell)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[f.merge(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, f in folds.items()],
    )


def with_halo(
    df: DataFrame, pos: Column, *, width: float, before: float = 0.0, after: float = 0.0
) -> DataFrame:
    """Copy each row into every bin that must see it.

    A bin sees its own rows plus those up to ``before`` ahead of its start and ``after``
    past its end.  ``__own`` marks the copy that belongs to the bin.  With a width of at
    least ``before + after`` a row is copied at most three times.
    """
    first = F.floor((pos - F.lit(after)) / F.lit(width)).cast("bigint")
    last = F.floor((pos + F.lit(before)) / F.lit(width)).cast("bigint")
    return df.withColumn(BIN, F.explode(F.sequence(first, last))).withColumn(
        "__own", F.col(BIN) == bin_of(pos, width)
    )


def range_over(
    agg: str, part: Sequence[str], order: str, back: float | None = None, ahead: float | None = None
) -> Column:
    """``agg`` over rows whose ``order`` lies in [here - back, here + ahead] (bounds as doubles)."""
    lo = f"{float(back)!r}D PRECEDING" if back else "CURRENT ROW"
    hi = f"{float(ahead)!r}D FOLLOWING" if ahead else "CURRENT ROW"
    keys = ", ".join(f"`{p}`" for p in part)
    return F.expr(f"{agg} OVER (PARTITION BY {keys} ORDER BY `{order}` RANGE BETWEEN {lo} AND {hi})")
