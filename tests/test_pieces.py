"""Bins bounded by rows: 90 % of all rows at one instant of one source, null times and keys, long chains."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, intervals, scan, select
from tidemark.plans import highlights

DDL = "source_id BIGINT, event_id BIGINT, timestamp_s DOUBLE, label STRING, confidence DOUBLE, text STRING"


@pytest.fixture(scope="module")
def hot(spark):
    """9,000 of 10,000 events at one instant of source 1; some without time, some without source."""
    rng = random.Random(5)
    labels = ["ELIMINATED Text", "audio_combat_spike", "Victory", "other"]
    rows = []
    for i in range(10_000):
        source, t = (1, 77.5) if i % 10 else (rng.choice([1, 2, 3, None]), rng.choice([None, round(rng.uniform(0, 400), 2)]))
        rows.append((source, i, t, rng.choice(labels), 0.5, "x"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DDL).repartition(7).cache()


def test_largest_piece_is_bounded(spark, hot):
    keyed, keys = scan.plain_keys(hot, ["source_id"])
    cut = scan.with_pieces(keyed, keys, ["timestamp_s", "event_id"], F.col("timestamp_s"), 600.0)
    sizes = [r["count"] for r in cut.groupBy(*keys, scan.BIN, scan.PIECE).count().collect()]
    assert sum(sizes) == hot.count() and max(sizes) <= 3 * hot.count() / scan.MIN_PIECES
    # pieces rise with the order
    rows = sorted(
        (r[scan.BIN], r["timestamp_s"] is not None, r["timestamp_s"] or 0, r["event_id"], r[scan.PIECE]) for r in cut.where("source_id = 1").collect()
    )
    assert all(a[4] <= b[4] for a, b in zip(rows, rows[1:]) if a[0] == b[0])


def plain_order(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source_id"], []).append(r)
    for k in by:
        by[k].sort(key=lambda r: (r["timestamp_s"] is not None, r["timestamp_s"] or 0, r["event_id"]))
    return by


@pytest.mark.parametrize("width", [600.0, 35.0])
def test_scans_keep_null_times_and_keys(hot, width):
    spike = F.when(F.col("label") == "Victory", F.col("event_id"))
    folds = {
        "n": scan.row_number(), "last": scan.last_value(spike), "before": scan.last_value(spike, inclusive=False),
        "top": scan.running_max(F.col("event_id")),
    }
    got = scan.scan(hot, ["source_id"], ["timestamp_s", "event_id"], folds, pos="timestamp_s", width=width).collect()
    back = scan.scan(
        hot, ["source_id"], ["timestamp_s", "event_id"], {"next": scan.next_value(spike, inclusive=False)},
        pos="timestamp_s", width=width, backward=True,
    ).collect()
    want = {}
    for rows in plain_order(hot.collect()).values():
        last = top = None
        for n, r in enumerate(rows, 1):
            before = last
            last = r["event_id"] if r["label"] == "Victory" else last
            top = r["event_id"] if top is None else max(top, r["event_id"])
            want[r["event_id"]] = [n, last, before, top]
        ahead = None
        for r in reversed(rows):
            want[r["event_id"]].append(ahead)
            ahead = r["event_id"] if r["label"] == "Victory" else ahead
    assert {r["event_id"]: [r["n"], r["last"], r["before"], r["top"]] for r in got} == {k: v[:4] for k, v in want.items()}
    assert {r["event_id"]: r["next"] for r in back} == {k: v[4] for k, v in want.items()}


def test_batches_of_a_hot_instant(hot):
    sizes = select.batches(hot.where("source_id = 1"), 100, ["timestamp_s", "event_id"], pos="timestamp_s").groupBy("batch_ix").count().collect()
    n = hot.where("source_id = 1").count()
    assert sorted(r["count"] for r in sizes) == sorted([100] * (n // 100) + ([n % 100] if n % 100 else []))


def test_segments_of_a_hot_instant(hot):
    got = intervals.number_segments(hot, counted=F.col("label") == "Victory", gap_s=3.0, bridge_s=5.0, width=60.0).collect()
    at = {r["event_id"]: (r["segment_id"], r["segment_events"], r["ix"], r["rank"]) for r in got}
    spike = "audio_combat_spike"
    rows = hot.collect()
    for source in {r["source_id"] for r in rows}:
        own = sorted((r for r in rows if r["source_id"] == source), key=lambda r: (r["timestamp_s"] or 0.0, r["event_id"]))
        segments = []
        for r in own:
            t = r["timestamp_s"] or 0.0
            if segments:
                prev = segments[-1][-1]
                limit = 5.0 if spike in (prev["label"], r["label"]) else 3.0
                if t - (prev["timestamp_s"] or 0.0) < limit:
                    segments[-1].append(r)
                    continue
            segments.append([r])
        for k, seg in enumerate(segments, 1):
            rank = 0
            for i, r in enumerate(seg, 1):
                rank += r["label"] == "Victory"
                assert at[r["event_id"]] == (k, len(seg), i, rank)


def test_merges_of_a_hot_instant(spark):
    rng = random.Random(8)
    rows = [(1, i, 50.0, 50.0 + rng.choice([1.0, 2.5])) for i in range(4000)]
    rows += [(1, 5000 + i, s, s + rng.uniform(0.1, 4)) for i, s in enumerate(rng.uniform(0, 300) for _ in range(400))]
    df = spark.createDataFrame(rows, "source_id BIGINT, id BIGINT, start_time DOUBLE, end_time DOUBLE")
    for slack in (0.0, 1.5):
        want = []
        for _, _, s, e in sorted(rows, key=lambda r: (r[2], r[3])):
            if want and s <= want[-1][1] + slack:
                want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
            else:
                want.append((s, e, 1))
        got = intervals.merge_intervals(df, {"n": intervals.count()}, slack_s=slack, width=20.0).orderBy("start").collect()
        assert [(r["start"], r["end"], r["n"]) for r in got] == want


@pytest.mark.parametrize("page", [256, 16, 1])
def test_chains_of_short_and_long_jumps(spark, page):
    rng = random.Random(page)
    rows, want = [], set()
    for g, reach in enumerate((1, 3, 40, 900)):
        ids = sorted(rng.sample(range(3000), 1200))
        nxt = {x: (ids[i + rng.randint(1, reach)] if i + reach < len(ids) else None) for i, x in enumerate(ids)}
        nxt[ids[-3]] = 5000  # a row that isn't there ends the chain
        rows += [(g, x, nxt[x], f"p{x}") for x in ids]
        x = ids[0]
        while x in nxt:
            want.add((g, x))
            x = nxt[x]
    df = spark.createDataFrame(rows, "g INT, ix BIGINT, next_ix BIGINT, name STRING")
    got = chains.follow_chain(df, ["g"], page_rows=page).collect()
    assert {(r["g"], r["ix"]) for r in got} == want and len(got) == len(want)
    assert all(r["name"] == f"p{r['ix']}" for r in got)


def test_windows_of_a_hot_instant(hot):
    ranked = highlights.segmented_events(hot, gap_s=5.0, bridge_s=8.0, width=60.0).cache()
    got = {(r["source_id"], r["segment_id"], r["row_ix"], r["last_ix"]) for r in chains.trigger_windows(ranked, window_s=20.0, width=60.0).collect()}
    rows = {}
    for r in ranked.collect():
        rows.setdefault((r["source_id"], r["segment_id"]), []).append((r["ix"], r["timestamp_s"], r["label"]))
    want = set()
    for key, seg in rows.items():
        seg.sort()
        if any(t is None for _, t, _ in seg) or key[0] is None:
            got = {x for x in got if x[:2] != key}
            continue
        i = 0
        while i < len(seg):
            if seg[i][2] not in chains.TRIGGER_LABELS:
                i += 1
                continue
            n = sum(1 for _, t, _ in seg[i:] if t <= seg[i][1] + 20.0)
            want.add((*key, i + 1, i + n))
            i += max(1, n // 2)
    assert got == want
