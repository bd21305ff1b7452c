"""Overlapping intervals: suppression by IoU, pushing apart, and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import iou
from tidemark.functions.similarity import edit_ratio, fold_changed
from tidemark.operators.intervals import count, merge_intervals
from tidemark.operators.rangejoin import overlaps, points_in_intervals, spread
from tidemark.operators.scan import BIN, next_value, row_number, running_max, scan
from tidemark.session import cut_lineage

MAX_FOLD = 2048


def conflicting_pairs(
    intervals: DataFrame, *, threshold: float, ident: str = "id", start: str = "start", end: str = "end",
    key: str = "source_id", width: float = 60.0,
) -> DataFrame:
    """Self join: pairs with IoU above ``threshold`` (smaller id first).

    The output is the answer asked for, so it is as large as the number of conflicts;
    suppression below does not use it.
    """
    side = intervals.select(key, ident, start, end)
    pairs = overlaps(side, side, left_span=(start, end), right_span=(start, end), key=[key], width=width)
    return pairs.where(F.col(ident) < F.col(f"r_{ident}")).withColumn(
        "iou", iou(F.col(start), F.col(end), F.col(f"r_{start}"), F.col(f"r_{end}"))
    ).where(F.col("iou") > threshold)


def overlaps_earlier(
    intervals: DataFrame, *, ident: str = "id", start: str = "start", end: str = "end",
    key: str = "source_id", width: float = 600.0,
) -> DataFrame:
    """Does an interval overlap one that comes before it (by start, id)?  A running maximum."""
    out = scan(
        intervals, [key], [start, ident],
        {"__reach": running_max(F.col(end), inclusive=False)}, pos=start, width=width,
    )
    hit = F.coalesce(F.col("__reach") > F.col(start), F.lit(False))
    return out.withColumn("overlaps_earlier", hit).drop("__reach")


def _keep_short(members: DataFrame, group: Sequence[str], threshold: float) -> DataFrame:
    packed = members.groupBy(*group).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("__score")).alias("o"), "__id", "__s", "__e"))
        ).alias("__rows")
    )
    empty = F.slice(F.col("__rows"), 1, 0)
    kept = F.aggregate(
        "__rows",
        empty,
        lambda acc, x: F.when(
            F.exists(acc, lambda k: iou(k["__s"], k["__e"], x["__s"], x["__e"]) > threshold), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return packed.select(group[0], F.explode(kept).alias("k")).select(group[0], F.col("k.__id").alias("__id"))


def _keep_rounds(members: DataFrame, key: str, threshold: float, width: float) -> DataFrame:
    """Keep local winners, drop what they suppress, repeat: no pairs, one winner per bin."""
    left = cut_lineage(members.select(key, "__id", "__s", "__e", "__score"))
    kept: DataFrame | None = None
    while not left.isEmpty():
        cells = spread(left, F.col("__s"), F.col("__e"), width)
        rank = F.struct(F.col("__score").alias("a"), (-F.col("__id")).alias("b"))
        best = cells.groupBy(key, BIN).agg(F.max_by("__id", rank).alias("__best"))
        marked = cells.join(best, [key, BIN])
        won = marked.groupBy(key, "__id").agg(
            F.min((F.col("__id") == F.col("__best")).cast("int")).alias("w")
        ).where("w = 1").select(key, "__id")
        winners = cut_lineage(left.join(won, [key, "__id"]))
        won = winners.select(key, "__id")
        # written each round, so that the plan does not grow with the rounds
        kept = cut_lineage(won if kept is None else kept.unionByName(won))
        wide = spread(winners, F.col("__s"), F.col("__e"), width).select(
            key, BIN, F.col("__id").alias("w_id"), F.col("__s").alias("w_s"), F.col("__e").alias("w_e")
        )
        hit = cells.join(wide, [key, BIN]).where(
            (F.col("__id") == F.col("w_id")) | (iou(F.col("__s"), F.col("__e"), F.col("w_s"), F.col("w_e")) > threshold)
        ).select(key, "__id").distinct()
        left = cut_lineage(left.join(hit, [key, "__id"], "left_anti"))
    return kept if kept is not None else members.select(key, "__id").limit(0)


def suppress_overlaps(
    intervals: DataFrame, *, score: str = "score", threshold: float = 0.6, ident: str = "id",
    start: str = "start", end: str = "end", key: str = "source_id", width: float = 60.0,
    max_fold: int = MAX_FOLD,
) -> DataFrame:
    """Greedy suppression: by score (ties: smaller id), keep unless IoU with a kept one is above.

    Equal intervals collapse to their best row first (their IoU is 1).  Overlap components
    are independent: small ones are folded natively, large ones settle in rounds of local
    winners.  Both give the same kept set.
    """
    if threshold >= 1.0:
        return intervals
    rows = intervals.select(
        key, F.col(ident).alias("__id"), F.col(start).alias("__s"), F.col(end).alias("__e"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("__score"),
    )
    proper = rows.where(F.col("__e") > F.col("__s"))
    rank = F.struct(F.col("__score").alias("a"), (-F.col("__id")).alias("b"))
    unique = proper.groupBy(key, "__s", "__e").agg(
        F.max_by("__id", rank).alias("__id"), F.max("__score").alias("__score")
    )
    groups = merge_intervals(
        unique, {"__n": count()}, start="__s", end="__e", tie=["__e"], key=key, number="__group"
    ).withColumnsRenamed({"start": "__g_s", "end": "__g_e"})
    # components can touch at one instant only when merged, so a start lies in exactly one
    placed = cut_lineage(
        points_in_intervals(unique, groups, t="__s", start="__g_s", end="__g_e", key=[key], width=600.0)
    )
    longest = placed.agg(F.max("__n")).first()[0] or 0
    if longest <= max_fold:
        kept = _keep_short(placed, [key, "__group"], threshold)
    else:
        kept = _keep_short(placed.where(F.col("__n") <= max_fold), [key, "__group"], threshold).unionByName(
            _keep_rounds(placed.where(F.col("__n") > max_fold), key, threshold, width)
        )
    kept = kept.unionByName(rows.where(F.col("__e") <= F.col("__s")).select(key, "__id"))
    return intervals.join(kept.withColumnRenamed("__id", ident), [key, ident], "left_semi")


def deoverlap(
    clips: DataFrame, *, order: Sequence[str] = ("start_time", "clip_id"), start: str = "start",
    end: str = "end", push_s: float = 1.0, key: str = "source_id", pos: str | None = None,
    width: float = 600.0,
) -> DataFrame:
    """Push a start past the first earlier clip it overlaps; adds new_start, adjusted, valid.

    A start only ever moves to ``push_s`` after the end of an earlier clip, and ends never
    move.  For clips longer than ``push_s`` that start before every later clip ends (any
    padded clip list), the first earlier clip that still overlaps is therefore the first
    whose end lies past this start - the first record of the running maximum of ends - and
    no chain of decisions is left to follow.
    """
    pos = pos or order[0]
    # read for the records, the questions and the result: written once
    numbered = cut_lineage(scan(
        clips, [key], list(order),
        {"__n": row_number(), "__before": running_max(F.col(end), inclusive=False)}, pos=pos, width=width,
    ))
    records = numbered.where(F.col("__before").isNull() | (F.col(end) > F.col("__before"))).select(
        key, F.col(end).alias("__p"), F.lit(0).alias("__o"), F.col("__n").alias("__tie"),
        F.lit(None).cast("bigint").alias("__row"), F.struct(F.col(end).alias("e")).alias("__m"),
    )
    asks = numbered.where(F.col("__before") > F.col(start)).select(
        key, F.col(start).alias("__p"), F.lit(1).alias("__o"), F.col("__n").alias("__tie"),
        F.col("__n").alias("__row"), F.lit(None).cast(records.schema["__m"].dataType).alias("__m"),
    )
    found = scan(
        records.unionByName(asks), [key], ["__p", "__o", "__tie"], {"__hit": next_value(F.col("__m"))},
        pos="__p", width=width, backward=True,
    ).where(F.col("__row").isNotNull())
    moved = found.select(key, F.col("__row").alias("__n"), (F.col("__hit.e") + push_s).alias("__new"))
    out = numbered.join(moved, [key, "__n"], "left")
    return out.select(
        *clips.columns,
        F.coalesce("__new", start).alias("new_start"),
        F.col("__new").isNotNull().alias("adjusted"),
        (F.coalesce("__new", start) < F.col(end)).alias("valid"),
    )


def changed_texts(
    lines: DataFrame, *, min_chars: int = 4, similarity: float = 0.8, key: str = "source_id",
    t: str = "t", text: str = "text", tie: str = "event_id", width: float = 600.0, page_rows: int = 2048, fuzzy: bool = True,
) -> DataFrame:
    """Keep a text when it is longer than ``min_chars`` and unlike the last text kept.

    Likeness is the fuzzy ratio (in Python), or with ``fuzzy=False`` the edit ratio, whose fold
    over a page is a built-in function.

    A source is cut into pages of ``page_rows`` rows; each is folded on its own from the
    text it enters with.  The text a page leaves with becomes the next page's entry; only
    pages whose entry changed are folded again, until nothing changes.  A page that keeps
    nothing passes its entry on.
    """
    long = lines.where(F.length(F.trim(text)) > min_chars).select(key, t, tie, text)
    rows = scan(long, [key], [t, tie], {"__n": row_number()}, pos=t, width=width)
    rows = rows.withColumn(BIN, F.floor((F.col("__n") - 1) / page_rows).cast("bigint")).drop("__n")
    # a text equal to the one before it is never kept, so runs of copies collapse here
    inside = Window.partitionBy(key, BIN).orderBy(t, tie)
    rows = rows.withColumn("__same", F.trim(text) == F.lag(F.trim(text)).over(inside)).where(
        ~F.coalesce("__same", F.lit(False))
    )
    rows = cut_lineage(rows)
    if not fuzzy:
        row = F.struct(F.col(t).alias("t"), F.col(tie).alias("tie"), F.trim(text).alias("text"))
        paged = cut_lineage(rows.groupBy(key, BIN).agg(F.array_sort(F.collect_list(row)).alias("__rows")))
    schema = f"{key} BIGINT, {BIN} BIGINT, __ids ARRAY<BIGINT>, __exit STRING, __entry STRING"

    def fold(entries: DataFrame) -> DataFrame:
        empty = F.transform(F.slice("__rows", 1, 0), lambda x: x["tie"])
        walked = F.aggregate(
            "__rows", F.struct(F.col("__entry").alias("last"), empty.alias("ids")),
            lambda acc, x: F.when(
                edit_ratio(acc["last"], x["text"]) < similarity,
                F.struct(x["text"].alias("last"), F.concat(acc["ids"], F.array(x["tie"])).alias("ids")),
            ).otherwise(acc),
        )
        folded = paged.join(entries, [key, BIN]).withColumn("__w", walked)
        left = F.when(F.size("__w.ids") > 0, F.col("__w.last"))
        return folded.select(key, BIN, F.col("__w.ids").alias("__ids"), left.alias("__exit"), "__entry")

    def run(entries: DataFrame) -> DataFrame:
        if not fuzzy:
            return fold(entries)
        todo = rows.select(key, BIN, F.col(t).alias("t"), F.col(tie).alias("tie"), F.trim(text).alias("text")).join(
            entries, [key, BIN]
        )
        # pages are many and may be short: a task folds its pages one after the other, in order
        ordered = todo.repartition(key, BIN).sortWithinPartitions(key, BIN, "t", "tie")
        return ordered.select(key, BIN, F.col("tie").cast("bigint").alias("tie"), "text", "__entry").mapInArrow(fold_changed(similarity, key, BIN), schema)

    state = cut_lineage(run(rows.select(key, BIN).distinct().withColumn("__entry", F.lit(""))))
    while True:
        w = Window.partitionBy(key).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
        wanted = state.withColumn("__want", F.coalesce(F.last("__exit", ignorenulls=True).over(w), F.lit("")))
        stale = cut_lineage(
            wanted.where(F.col("__want") != F.col("__entry")).select(key, BIN, F.col("__want").alias("__entry"))
        )
        if stale.isEmpty():
            break
        fresh = run(stale)
        state = cut_lineage(state.join(stale.select(key, BIN), [key, BIN], "left_anti").unionByName(fresh))
    kept = state.select(key, F.explode("__ids").alias(tie))
    return lines.join(kept, [key, tie], "left_semi")
