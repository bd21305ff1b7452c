"""Paths for hot sources: results do not depend on bins, partitions or fold limits."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, intervals
from tidemark.operators.conflicts import changed_texts, deoverlap, suppress_overlaps
from tidemark.operators.scan import last_value, next_value, row_number, running_max, running_sum, scan
from tidemark.operators.select import hash_split
from tidemark.operators.signal import exact_quantile, moving_average
from tidemark.plans import highlights

LABELS = ["audio_combat_spike", "ELIMINATED Text", "Floating Damage Numbers", "Teammate"]


@pytest.fixture(scope="module")
def skewed(spark):
    """One source with most rows, many of them copies at the same time."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        source = 1 if rng.random() < 0.7 else rng.randint(2, 5)
        t = 100.0 if rng.random() < 0.2 else round(rng.uniform(0, 1500), 2)
        rows.append((source, i, t, rng.choice(LABELS), round(rng.random(), 3), rng.choice([None, "+50", "squad wipe"])))
    return spark.createDataFrame(
        rows, "source_id BIGINT, event_id BIGINT, timestamp_s DOUBLE, label STRING, confidence DOUBLE, text STRING"
    ).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scan_equals_one_window(skewed):
    pdf = skewed.toPandas().sort_values(["source_id", "timestamp_s", "event_id"])
    v = F.when(F.col("confidence") > 0.7, F.col("event_id"))
    fw = scan(
        skewed, ["source_id"], ["timestamp_s", "event_id"],
        {"n": row_number(), "s": running_sum(F.col("event_id")), "m": running_max(F.col("confidence"), inclusive=False), "l": last_value(v)},
        pos="timestamp_s", width=37.0,
    ).toPandas().sort_values(["source_id", "timestamp_s", "event_id"])
    assert (fw["n"].values == (pdf.groupby("source_id").cumcount() + 1).values).all()
    assert (fw["s"].values == pdf.groupby("source_id")["event_id"].cumsum().values).all()
    prior = pdf.groupby("source_id")["confidence"].transform(lambda x: x.cummax().shift())
    assert np.allclose(fw["m"].values, prior.values, equal_nan=True)
    want = pdf["event_id"].where(pdf["confidence"] > 0.7).groupby(pdf["source_id"]).ffill()
    assert np.allclose(fw["l"].values.astype(float), want.values, equal_nan=True)
    bw = scan(
        skewed, ["source_id"], ["timestamp_s", "event_id"], {"x": next_value(v, inclusive=False)},
        pos="timestamp_s", width=37.0, backward=True,
    ).toPandas().sort_values(["source_id", "timestamp_s", "event_id"])
    later = pdf["event_id"].where(pdf["confidence"] > 0.7).groupby(pdf["source_id"]).transform(lambda x: x.bfill().shift(-1))
    assert np.allclose(bw["x"].values.astype(float), later.values, equal_nan=True)


def test_segments_do_not_depend_on_bins_or_partitions(spark, skewed):
    base = rows(intervals.gap_segments(skewed, gap_s=2.0, bridge_s=4.0, width=1e6))
    assert base == rows(intervals.gap_segments(skewed, gap_s=2.0, bridge_s=4.0, width=25.0))
    assert sum(r[4] for r in base) == skewed.count()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "33"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert base == rows(intervals.gap_segments(skewed, gap_s=2.0, bridge_s=4.0, width=25.0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def chain_model(ev, window):
    """Plain statement of the trigger walk for one segment's sorted (t, label) list."""
    out, i = [], 0
    while i < len(ev):
        if ev[i][1] not in chains.TRIGGER_LABELS:
            i += 1
            continue
        n = sum(1 for t, _ in ev[i:] if t <= ev[i][0] + window)
        out.append((i + 1, i + n))
        i += max(1, n // 2)
    return out


def test_trigger_chain_equals_the_walk_on_both_paths(skewed):
    ranked = highlights.segmented_events(skewed, gap_s=5.0, bridge_s=8.0, width=60.0).cache()
    want = []
    pdf = ranked.toPandas().sort_values(["source_id", "segment_id", "ix"])
    for (s, g), part in pdf.groupby(["source_id", "segment_id"]):
        want += [(s, g, a, b) for a, b in chain_model(list(zip(part["timestamp_s"], part["label"])), 20.0)]
    for limit in (4096, 3):
        got = chains.trigger_windows(ranked, window_s=20.0, page_rows=limit, width=60.0)
        assert rows(got.select("source_id", "segment_id", "row_ix", "last_ix")) == sorted(want, key=repr)


def test_sliding_clips_do_not_depend_on_bins(skewed):
    cols = ["source_id", "start_time", "end_time", "event_count", "combat_events", "segment_id", "segment_events"]
    a = highlights.sliding_clips(skewed, gap_s=5.0, bridge_s=8.0, window_s=20.0, merge_s=3.0, width=1e6).select(cols)
    b = highlights.sliding_clips(skewed, gap_s=5.0, bridge_s=8.0, window_s=20.0, merge_s=3.0, width=40.0, page_rows=5).select(cols)
    assert rows(a) == rows(b)


def test_merge_without_slack_equals_the_walk(spark):
    rng = random.Random(4)
    data = [(1, i, s, s + rng.choice([0.5, 3.0, 40.0])) for i, s in enumerate(round(rng.uniform(0, 3000), 1) for _ in range(300))]
    want = []
    for _, _, s, e in sorted(data, key=lambda r: r[2]):
        if want and s <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
        else:
            want.append((s, e, 1))
    df = spark.createDataFrame(data, "source_id BIGINT, id BIGINT, start DOUBLE, end DOUBLE")
    got = intervals.merge_intervals(df, {"n": intervals.count()}, start="start", end="end", tie=["id"], width=20.0)
    assert [(r.start, r.end, r.n) for r in got.orderBy("island_ix").collect()] == want
    assert [r.island_ix for r in got.orderBy("start").collect()] == list(range(len(want)))


def iou(a, b):
    x = max(0.0, min(a[3], b[3]) - max(a[2], b[2]))
    u = (a[3] - a[2]) + (b[3] - b[2]) - x
    return x / u if u > 0 else 0.0


def test_suppression_equals_the_greedy_rule_on_both_paths(spark):
    rng = random.Random(3)
    data = []
    for i in range(300):
        s = round(rng.uniform(0, 200), 1)
        e = s + rng.choice([5.0, 8.0, 13.0, 0.0])
        data.append((1 if i % 3 else 2, i, s, e, float(rng.randint(1, 9))))
    data += [(1, 1000 + k, 50.0, 60.0, 9.0) for k in range(100)]  # copies
    kept = []
    for c in sorted(data, key=lambda r: (-r[4], r[1])):
        if not any(k[0] == c[0] and iou(c, k) > 0.4 for k in kept):
            kept.append(c)
    want = sorted(k[1] for k in kept)
    df = spark.createDataFrame(data, "source_id BIGINT, id BIGINT, start DOUBLE, end DOUBLE, score DOUBLE")
    for limit in (2048, 4):
        got = suppress_overlaps(df, threshold=0.4, max_fold=limit, width=7.0)
        assert sorted(r.id for r in got.collect()) == want


def test_pushing_apart_equals_the_ordered_rule(spark):
    rng = random.Random(5)
    data, t = [], 0.0
    for i in range(200):
        t += rng.choice([3.0, 20.0, 70.0])
        data.append((1, i, t, max(0.0, t - rng.choice([4.0, 10.0, 60.0])), t + rng.choice([6.0, 30.0, 50.0])))
    done, want = [], {}
    for _, i, _, s, e in data:
        for ps, pe in done:
            if not (e <= ps or s >= pe):
                if s < pe:
                    s = pe + 1.0
                break
        done.append((s, e))
        want[i] = s
    df = spark.createDataFrame(data, "source_id BIGINT, clip_id BIGINT, start_time DOUBLE, start DOUBLE, end DOUBLE")
    got = {r.clip_id: r.new_start for r in deoverlap(df, width=100.0).collect()}
    assert got == want


def test_changed_texts_equal_the_walk(spark):
    rng = random.Random(11)
    words = ["match point", "match paint", "game over", "game ovar", "loading", "abc"]
    data = [(1 if i % 4 else 2, i, round(i * 1.5, 2), rng.choice(words)) for i in range(160)]
    want = []
    for s in (1, 2):
        last = ""
        for _, i, _, x in (r for r in data if r[0] == s):
            if len(x) > 4 and SequenceMatcher(None, last, x).ratio() < 0.8:
                want.append(i)
                last = x
    df = spark.createDataFrame(data, "source_id BIGINT, event_id BIGINT, t DOUBLE, text STRING")
    for page in (2048, 9):
        assert sorted(r.event_id for r in changed_texts(df, width=50.0, page_rows=page).collect()) == sorted(want)


def test_chapters_equal_the_walk_on_both_paths(spark):
    rng = random.Random(2)
    data, shots, want = [], [], []
    for s in (1, 2):
        t, lines = 0.0, []
        for i in range(120):
            t = round(t + rng.choice([0.0, 0.5, 2.0, 3.0]), 1) if i else 0.0
            end = round(t + rng.choice([2.0, 9.0, 30.0]), 1)
            lines.append((s, i, t, end))
            t = end
        times = [round(rng.uniform(0, t), 2) for _ in range(6)]
        shots += [(s, x) for x in times]
        data += lines
        cur, last, chapters = 0.0, 0.0, []
        for _, _, a, b in lines:
            if cur == 0.0 and not chapters:
                cur = a
            pause = a - last >= 2.0 and last > 0
            shot = any(last - 1.0 <= x <= a + 1.0 for x in times)
            if (pause or shot or b - cur >= 180) and last - cur >= 45:
                chapters.append((cur, last))
                cur = a
            last = b
        if last - cur > 10:
            chapters.append((cur, last))
        want += [(s, k, a, b) for k, (a, b) in enumerate(chapters)]
    tr = spark.createDataFrame(data, "source_id BIGINT, ix BIGINT, start DOUBLE, end DOUBLE")
    sc = spark.createDataFrame(shots, "source_id BIGINT, t DOUBLE")
    for limit, width in ((4096, 600.0), (2, 90.0)):
        got = chains.chapters(tr, sc, page_rows=limit, width=width)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_quantile_equals_numpy(skewed):
    pdf = skewed.toPandas()
    for p in (0.2, 0.3, 0.7):
        got = {r.source_id: r.quantile for r in exact_quantile(skewed, "confidence", p, buckets=16).collect()}
        for s, part in pdf.groupby("source_id"):
            assert abs(got[s] - np.percentile(part["confidence"], p * 100)) < 1e-12


def test_moving_average_equals_convolution(spark):
    x = np.random.default_rng(1).random(500)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "source_id BIGINT, ix BIGINT, rms DOUBLE")
    for width in (5, 10):
        got = [r.smoothed for r in moving_average(df, rows=width, width=64).orderBy("ix").collect()]
        assert np.allclose(got, np.convolve(x, np.ones(width) / width, mode="same"))


def test_split_sizes_are_exact_and_repeatable(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    a = hash_split(df, "k").cache()
    assert a.where("split = 'train'").count() == int(1001 * 0.8)
    assert rows(a) == rows(hash_split(df.repartition(7), "k"))
