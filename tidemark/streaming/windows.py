"""Streaming forms of the batch operators.  Every plan also runs on a batch DataFrame.

The event time column is ``ts``.  The watermark delay should be at least the longest
look-back or look-ahead in use (30 s by default).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scoring import intensity
from tidemark.operators.intervals import SPIKE

DELAY = "30 seconds"


def label_intensity(
    events: DataFrame, *, window: str = "60 seconds", slide: str | None = None, delay: str = DELAY, weights=None
) -> DataFrame:
    """Events and intensity per source, label and tumbling or sliding window."""
    score = intensity(F.col("label"), F.col("confidence"), F.col("text"), weights)
    return (
        events.withWatermark("ts", delay)
        .groupBy("source_id", "label", F.window("ts", window, slide))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("intensity"))
    )


def session_bursts(
    events: DataFrame, *, anchor_label: str = "ELIMINATED Text", gap: str = "30 seconds", delay: str = DELAY
) -> DataFrame:
    """Bursts of anchor events as sessions: a gap of at most ``gap`` joins.

    The filter names the event time so that it stays above the watermark: all events move
    the watermark, not just anchors, and the last burst closes without waiting for another.
    """
    anchor = F.when(F.col("ts").isNotNull(), F.col("label") == anchor_label)
    return (
        events.withWatermark("ts", delay)
        .where(anchor)
        .groupBy("source_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


def dedupe(events: DataFrame, *, delay: str = DELAY) -> DataFrame:
    """Drop repeated (source, time, label, text) within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_id", "ts", "label", "text"])


def anchored_pairs(
    anchors: DataFrame, spikes: DataFrame, *, lookback: str = "30 seconds", lookahead: str = "30 seconds",
    delay: str = DELAY,
) -> DataFrame:
    """Anchor events with the spikes around them: an interval join of two streams.

    Both sides carry a watermark and the time condition bounds the state kept.
    """
    a = anchors.withWatermark("ts", delay).select("source_id", "event_id", F.col("ts").alias("anchor_ts")).alias("a")
    s = spikes.withWatermark("ts", delay).select(F.col("source_id").alias("s_source"), F.col("ts").alias("spike_ts")).alias("s")
    near = (F.col("source_id") == F.col("s_source")) & F.expr(
        f"spike_ts >= anchor_ts - INTERVAL {lookback} AND spike_ts <= anchor_ts + INTERVAL {lookahead}"
    )
    return a.join(s, near, "inner").drop("s_source")


def nearest_spikes(
    anchors: DataFrame, spikes: DataFrame, *, lookback: str = "30 seconds", lookahead: str = "30 seconds", delay: str = DELAY
) -> DataFrame:
    """One row per anchor event with spikes around it: the earliest before, the latest after, and how many.

    Two stateful steps in a chain, an interval join and an aggregate by a window of the anchor's time;
    a row leaves when the watermark has passed both.
    """
    pairs = anchored_pairs(anchors, spikes, lookback=lookback, lookahead=lookahead, delay=delay)
    before, after = F.col("spike_ts") <= F.col("anchor_ts"), F.col("spike_ts") >= F.col("anchor_ts")
    return (
        pairs.groupBy("source_id", "event_id", F.window("anchor_ts", "1 second"))
        .agg(
            F.min(F.when(before, F.col("spike_ts"))).alias("spike_before"),
            F.max(F.when(after, F.col("spike_ts"))).alias("spike_after"), F.count(F.lit(1)).alias("n_spikes"),
        )
        .drop("window")
    )


def run_available(stream: DataFrame, folder: str) -> None:
    """Run a stream over what its source holds now, appending to ``folder``/out; a later call goes on from there."""
    (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )


class GapSegments(StatefulProcessor):
    """Split a source's stream at gaps whose limit depends on both neighbours' labels.

    Kept per source: last time, last label and the running segment number.  Rows of one
    batch are taken in time order; a row older than the last one joins the open segment.
    """

    def __init__(self, gap_s: float = 30.0, bridge_s: float = 60.0, audio_label: str = SPIKE):
        self.gap_s, self.bridge_s, self.audio_label = gap_s, bridge_s, audio_label

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "t DOUBLE, label STRING, segment BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self._last.get() if self._last.exists() else None
        last_t, last_label, segment = state if state else (None, None, 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        numbers = []
        for ts, label in zip(frame["ts"], frame["label"]):
            t = ts.timestamp()
            if last_t is None:
                segment = 1
            else:
                beside = self.audio_label in (last_label, label)
                if t - last_t >= (max(self.gap_s, self.bridge_s) if beside else self.gap_s):
                    segment += 1
            if last_t is None or t >= last_t:
                last_t, last_label = t, label
            numbers.append(segment)
        self._last.update((last_t, last_label, segment))
        yield pd.DataFrame(
            {"source_id": frame["source_id"], "event_id": frame["event_id"], "segment_id": numbers}
        )

    def close(self) -> None:
        pass


def gap_segments(events: DataFrame, *, gap_s: float = 30.0, bridge_s: float = 60.0, audio_label: str = SPIKE) -> DataFrame:
    """Segment number per event of a stream (needs the RocksDB state store)."""
    return (
        events.select("source_id", "event_id", "ts", "label")
        .groupBy("source_id")
        .transformWithStateInPandas(
            statefulProcessor=GapSegments(gap_s, bridge_s, audio_label),
            outputStructType="source_id BIGINT, event_id BIGINT, segment_id BIGINT",
            outputMode="Append",
            timeMode="None",
        )
    )


def late_after(delay: timedelta, *, lookback_s: float = 30.0, lookahead_s: float = 30.0) -> str:
    """Watermark delay that never cuts a look short."""
    need = max(lookback_s, lookahead_s, delay.total_seconds())
    return f"{need:g} seconds"
