"""Decision-dependent sequences: where the next step depends on the last one taken.

Every such rule is first turned into data: a row's ``next`` row depends on the row alone,
so range windows and forward as-of scans compute it for all rows at once.  What is left
is following the pointers from the first row, in pages of ``PAGE_ROWS`` places:

1. a page works out where each of its rows leaves it (a map entry to exit);
2. the maps are composed in a tree of doublings over the rows at which a page can be entered;
   a chain enters a page once at most;
3. every page that is entered is followed once from its entry.

One path serves chains of any length: a chain inside one page needs no doubling at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rangejoin import points_in_intervals
from tidemark.operators.scan import last_value, next_value, row_number, running_max, scan
from tidemark.session import cut_lineage

TRIGGER_LABELS = (
    # fixed values: labels that may open a window
    "Victory",
    "ELIMINATED Text",
    "Floating Damage Numbers",
    "loating Damage Numbers",
    "Directional Damage Indicators",
    "audio_combat_spike",
)

PAGE_ROWS = 256


def _exits(pages: DataFrame) -> DataFrame:
    """Add ``__exits``: for each row of a page (``__nodes``, ascending) the row outside the page that its chain comes to, or null."""
    ixs, nexts = F.transform("__nodes", lambda x: x["ix"]), F.transform("__nodes", lambda x: x["next_ix"])
    # 1-based place of the next row in the page, 0 for one outside
    places = F.transform(nexts, lambda n: F.array_position(F.col("__ixs"), n).cast("int"))
    n = F.size("__ixs")
    folded = F.aggregate(
        F.sequence(n, F.lit(1), F.lit(-1)),
        F.slice("__nexts", 1, 0),
        # what is folded so far are the exits of the rows after ``i``
        lambda done, i: F.concat(
            F.array(
                F.when(F.get("__places", i - 1) > 0, F.get(done, F.get("__places", i - 1) - i - 1)).otherwise(F.get("__nexts", i - 1))
            ),
            done,
        ),
    )
    return (
        pages.withColumns({"__ixs": ixs, "__nexts": nexts}).withColumn("__places", places).withColumn("__exits", folded)
    )


def _entries(maps: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows at which the chain of each group enters a page: its first row, and what follows from the page maps."""
    steps = maps.select(*group, F.explode(F.arrays_zip(F.col("__ixs").alias("ix"), F.col("__exits").alias("to"))).alias("s"))
    steps = steps.select(*group, "s.ix", "s.to")
    firsts = maps.groupBy(*group).agg(F.min(F.get("__ixs", F.lit(0))).alias("ix"))
    # only rows that some page leads to can be entered, beside the first
    doors = steps.where(F.col("to").isNotNull()).select(*group, F.col("to").alias("ix")).union(firsts).distinct()
    reached = cut_lineage(firsts)
    jump = cut_lineage(steps.join(doors, [*group, "ix"], "left_semi").where(F.col("to").isNotNull()))
    while not jump.isEmpty():
        more = reached.join(jump, [*group, "ix"]).select(*group, F.col("to").alias("ix"))
        reached = cut_lineage(reached.union(more).distinct())
        hop = jump.select(*group, F.col("ix").alias("to"), F.col("to").alias("__then"))
        jump = cut_lineage(jump.join(hop, [*group, "to"]).select(*group, "ix", F.col("__then").alias("to")))
    return reached


def follow_chain(nodes: DataFrame, group: Sequence[str], *, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Nodes visited from each group's first ``ix`` along ``next_ix`` (null ends the chain).

    ``nodes`` holds group columns, ``ix``, ``next_ix > ix``, where ``next_ix`` is the ``ix``
    of another node, and any narrow columns to keep.  ``ix`` is not repeated in a group.
    """
    group = list(group)
    rest = [c for c in nodes.columns if c not in (*group, "ix", "next_ix")]
    paged = nodes.groupBy(*group, F.floor(F.col("ix") / page_rows).cast("bigint").alias("__page")).agg(
        F.array_sort(F.collect_list(F.struct("ix", "next_ix", *rest))).alias("__nodes")
    )
    paged = cut_lineage(paged)
    entries = _entries(_exits(paged).select(*group, "__ixs", "__exits"), group)
    entered = paged.join(
        entries.select(*group, F.floor(F.col("ix") / page_rows).cast("bigint").alias("__page"), F.col("ix").alias("__entry")),
        [*group, "__page"],
    )
    seed = F.struct(F.col("__entry").alias("want"), F.slice("__nodes", 1, 0).alias("got"))
    walked = F.aggregate(
        "__nodes",
        seed,
        lambda acc, x: F.when(
            x["ix"] == acc["want"],
            F.struct(x["next_ix"].alias("want"), F.concat(acc["got"], F.array(x)).alias("got")),
        ).otherwise(acc),
        lambda acc: acc["got"],
    )
    return entered.select(*group, F.explode(walked).alias("__x")).select(*group, "__x.*").select(nodes.columns)


def trigger_nodes(
    ranked: DataFrame, *, window_s: float = 60.0, triggers: Sequence[str] = TRIGGER_LABELS,
    key: str = "source_id", width: float = 600.0,
) -> DataFrame:
    """Trigger rows with the window they open and the next trigger to try.

    A window holds the events of the segment from the trigger up to ``window_s`` later; the
    next try is ``max(1, n // 2)`` rows on, or the first trigger after that.
    """
    group = [key, "segment_id"]
    at, is_trigger = F.col("timestamp_s"), F.col("label").isin(*triggers)
    none = F.lit(None).cast("bigint")
    # The last row of a window is the greatest place up to its end: one scan over rows and the ends asked for,
    # rows of equal time first.
    marks = ranked.select(*group, at.alias("__p"), F.lit(0).alias("__o"), F.col("ix").alias("__tie"), F.col("ix").alias("__mark"), none.alias("__q"))
    asks = ranked.where(is_trigger).select(
        *group, (at + window_s).alias("__p"), F.lit(1).alias("__o"), F.col("ix").alias("__tie"), none.alias("__mark"), F.col("ix").alias("__q")
    )
    ends = scan(
        marks.unionByName(asks), group, ["__p", "__o", "__tie"], {"last_ix": running_max(F.col("__mark"))}, pos="__p", width=width
    ).where(F.col("__q").isNotNull()).select(*group, F.col("__q").alias("ix"), "last_ix")
    n = F.col("last_ix") - F.col("ix") + 1
    opened = (
        ranked.where(is_trigger).select(*group, "timestamp_s", "event_id", "ix", "rank").join(ends, [*group, "ix"])
        .withColumn("n_window", n)
        .withColumn("try_ix", F.col("ix") + F.greatest(F.lit(1), F.floor(n / 2)))
    )
    # rows before try_ix hold this many triggers, so the next trigger has that rank + 1
    passed = ranked.select(*group, (F.col("ix") + 1).alias("try_ix"), F.col("rank").alias("__passed"))
    return opened.join(passed, [*group, "try_ix"], "left").select(
        *group, F.col("rank").alias("ix"), F.col("ix").alias("row_ix"), "last_ix", "n_window",
        "event_id", F.col("timestamp_s").alias("window_start"),
        (F.col("__passed") + 1).cast("bigint").alias("next_ix"),
    )


def trigger_windows(
    ranked: DataFrame, *, window_s: float = 60.0, triggers: Sequence[str] = TRIGGER_LABELS,
    key: str = "source_id", width: float = 600.0, page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Windows opened by the trigger chain: first and last row of each, per segment."""
    group = [key, "segment_id"]
    nodes = trigger_nodes(ranked, window_s=window_s, triggers=triggers, key=key, width=width)
    visited = follow_chain(nodes, group, page_rows=page_rows)
    return visited.select(*group, "event_id", "row_ix", "last_ix", "n_window", "window_start")


def _earliest(start: Column, length: float) -> Column:
    """The least double ``x`` with ``x - start >= length``; ``start + length`` may round to a neighbour of it."""
    at = start + length
    half = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(at), F.lit(length)))) - 53)
    near = F.array(*[at + half * k for k in range(-8, 9)])
    return F.array_min(F.filter(near, lambda x: x - start >= length))


def _chapter_cuts(
    linked: DataFrame, key: str, width: float, min_length: float, max_length: float
) -> DataFrame:
    """For a chapter starting at each line: ``ix`` of the line that would cut it.

    Ends and previous ends rise, so "first line with previous end >= x" answers all three
    conditions, and one backward scan over lines (marks) and asked times reads it:
    at start + min for any and for a cut line, at start + max for the length limit
    (the line before the one found, or the last line when its own end reaches).  A limit is
    met when the difference of the times reaches it, see :func:`_earliest`.
    """
    marks = linked.select(
        key, F.col("last_end").alias("__p"), F.lit(1).alias("__o"), F.col("ix").alias("__tie"),
        F.lit(None).cast("bigint").alias("__row"), F.lit(None).cast("string").alias("__ask"),
        F.col("ix").alias("__any"), F.when(F.col("cut"), F.col("ix")).alias("__cut"),
    )
    asked = F.explode(
        F.array(
            F.struct(F.lit("min").alias("ask"), _earliest(F.col("start"), min_length).alias("p")),
            F.struct(F.lit("max").alias("ask"), _earliest(F.col("start"), max_length).alias("p")),
        )
    )
    none = F.lit(None).cast("bigint")
    asks = linked.withColumn("__q", asked).select(
        key, F.col("__q.p").alias("__p"), F.lit(0).alias("__o"), F.col("ix").alias("__tie"),
        F.col("ix").alias("__row"), F.col("__q.ask").alias("__ask"), none.alias("__any"), none.alias("__cut"),
    )
    seen = scan(
        marks.unionByName(asks), [key], ["__p", "__o", "__tie", "__ask"],
        {"next_any": next_value(F.col("__any")), "next_cut": next_value(F.col("__cut"))},
        pos="__p", width=width, backward=True,
    ).where(F.col("__row").isNotNull())
    is_min = F.col("__ask") == "min"
    return seen.groupBy(key, F.col("__row").alias("ix")).agg(
        F.max(F.when(is_min, F.col("next_cut"))).alias("soft"),
        F.max(F.when(is_min, F.col("next_any"))).alias("enough"),
        F.max(F.when(~is_min, F.col("next_any"))).alias("past"),
    )


def chapters(
    transcript: DataFrame,
    screen_text: DataFrame | None = None,
    *,
    min_length: float = 45.0,
    max_length: float = 180.0,
    pause_threshold: float = 2.0,
    tail_s: float = 10.0,
    key: str = "source_id",
    width: float = 600.0,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Cut transcript lines into chapters at pauses, screen changes or the maximum length.

    Line times rise within a source.  A chapter that starts at line i is cut at the first
    later line that (a) follows a pause or a screen change, or ends ``max_length`` past the
    chapter's start, and (b) whose predecessor ends at least ``min_length`` past it; all
    three are lookups on rising values.  A start of exactly 0 moves to the next line.
    """
    lines = transcript.where(F.col("start") != -1.0).select(key, "ix", "start", "end")
    linked = scan(
        lines, [key], ["ix"],
        {"last_end": last_value(F.col("end"), inclusive=False)}, pos="start", width=width,
    ).withColumn("last_end", F.coalesce("last_end", F.lit(0.0)))
    pause = ((F.col("start") - F.col("last_end")) >= pause_threshold) & (F.col("last_end") > 0)
    if screen_text is not None:
        shots = screen_text.select(key, "t").distinct()
        near = linked.withColumns(
            {"__lo": F.col("last_end") - 1.0, "__hi": F.col("start") + 1.0}
        )
        changed = (
            points_in_intervals(shots, near, t="t", start="__lo", end="__hi", key=[key], width=60.0)
            .select(key, "ix").distinct().withColumn("__shot", F.lit(True))
        )
        linked = linked.join(changed, [key, "ix"], "left")
        cut = pause | F.coalesce(F.col("__shot"), F.lit(False))
    else:
        cut = pause
    # read by three lookups and the chain: written once
    linked = cut_lineage(linked.select(key, "ix", "start", "end", "last_end", cut.alias("cut")))
    cuts = _chapter_cuts(linked, key, width, min_length, max_length)
    lasts = linked.groupBy(key).agg(F.max("ix").alias("__last"), F.max("end").alias("__close"))
    reaches_end = F.col("__close") - F.col("start") >= max_length
    long = F.coalesce(F.col("past") - 1, F.when(reaches_end, F.col("__last")))
    hard = F.when(long.isNotNull() & F.col("enough").isNotNull(), F.greatest(long, F.col("enough")))
    nodes = linked.join(cuts, [key, "ix"]).join(lasts, key).withColumn("next_ix", F.least(F.col("soft"), hard))
    # a chain may not begin on a line that starts at exactly 0 unless it is the only line
    begin = linked.groupBy(key).agg(
        F.coalesce(F.min(F.when(F.col("start") != 0.0, F.col("ix"))), F.max("ix")).alias("__first")
    )
    nodes = cut_lineage(
        nodes.join(begin, key).where(F.col("ix") >= F.col("__first")).select(key, "ix", "start", "next_ix")
    )
    starts = follow_chain(nodes, [key], page_rows=page_rows)
    ends = linked.groupBy(key).agg(F.max("end").alias("__close"))
    closed = starts.join(
        linked.select(key, F.col("ix").alias("next_ix"), F.col("last_end").alias("__cut_end")),
        [key, "next_ix"], "left",
    ).join(ends, key)
    out = closed.select(
        key, "start", F.coalesce("__cut_end", "__close").alias("end"),
        F.col("next_ix").isNull().alias("is_tail"),
    ).where(~F.col("is_tail") | (F.col("end") - F.col("start") > tail_s))
    return scan(out, [key], ["start"], {"chapter": row_number()}, pos="start", width=max(width, 10 * min_length)).select(
        key, (F.col("chapter") - 1).alias("chapter_ix"), "start", "end"
    )
