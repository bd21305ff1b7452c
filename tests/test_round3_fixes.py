"""Faults found in the third round: each of these failed before its change."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.operators import chains
from tidemark.sources import readers, sinks


def test_packed_logs_are_few_files(spark, tmp_path):
    """the number of files does not grow with the logs, and every document is judged as a file of its own is."""
    texts = ['[{"timestamp_s": 1.5, "label": "x"}]', "[{broken", "{}", "", " ", "[]"]
    docs = spark.createDataFrame([(i, 0, texts[i % 6]) for i in range(600)], "log INT, page INT, value STRING")
    folder = str(tmp_path / "packs")
    sinks.write_packs(docs.coalesce(2), folder)
    assert len([f for f in (tmp_path / "packs").iterdir() if f.suffix == ".parquet"]) <= 2
    names = docs.select(F.concat(F.lit(f"{folder}/log="), "log").alias("file"), F.col("log").cast("bigint").alias("source_id"))
    read = readers.event_logs(spark, folder, names, packed=True)
    assert sorted(r.source_id for r in read.rows.collect()) == list(range(0, 600, 6))
    assert {(r.reason, r["count"]) for r in read.unreadable.groupBy("reason").count().collect()} == {("not JSON", 100), ("not a list", 100), ("empty", 200)}


def test_packed_pages_keep_their_order(spark, make_events, tmp_path):
    """F13, F16: paged documents in packs give the rows that the files give."""
    ev = make_events([(i * 0.5, "x", f"t{i}") for i in range(25)])
    sinks.write_event_arrays(ev, str(tmp_path / "packs"), page_rows=10, packed=True)
    assert not list((tmp_path / "packs").glob("log=*"))
    rows = readers.read_event_logs(spark, str(tmp_path / "packs"), packed=True).orderBy("event_id").collect()
    assert [r.text for r in rows] == [f"t{i}" for i in range(25)]
    au = ev.select("source_id", "timestamp_s", "label", F.lit(0.25).alias("score"))
    sinks.write_audio_arrays(au, str(tmp_path / "audio"), page_rows=10, packed=True)
    assert not list((tmp_path / "audio").glob("log=*"))
    assert readers.read_audio_events(spark, str(tmp_path / "audio"), packed=True).count() == 25


def test_chapter_limits_hold_for_differences(spark):
    """F2: 64.1 - 19.1 falls short of 45, though 19.1 + 45 rounds to 64.1."""
    assert 64.1 - 19.1 < 45 and 64.1 >= 19.1 + 45 and 256.4 - 76.4 < 180 and 256.4 >= 76.4 + 180
    rows = [(1, 0, 19.1, 64.1), (1, 1, 70.0, 90.0), (2, 0, 76.4, 200.0), (2, 1, 200.1, 256.4), (2, 2, 256.5, 300.0)]
    lines = spark.createDataFrame(rows, "source_id BIGINT, ix BIGINT, start DOUBLE, end DOUBLE")
    got = {(r.source_id, r.start, r.end) for r in chains.chapters(lines).collect()}
    assert got == {(1, 19.1, 90.0), (2, 76.4, 256.4), (2, 256.5, 300.0)}


def test_every_labelled_document_has_its_file(spark, tmp_path):
    """one file per labelled document is listed, not one per shard."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0,)], "doc_id BIGINT").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["s08_file_list"](spark, str(tmp_path)).collect()
    assert sorted(r.stem for r in got) == sorted(f"frame_{i}" for i in range(150))


@pytest.mark.parametrize("name, times", [("a08_median_frames", 0), ("a09_mean_boxes", 1), ("e09_crop_plan", 1), ("a11_strategy_counts", 1)])
def test_boxes_are_shuffled_once(spark, name, times):
    """single boxes pass one shuffle at most, and none where frames are only counted."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    text = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert moved
    assert len([m for m in moved if "l_partkey" in m or re.search(r"person_box#\d+[,\]]|person_box#\d+$", m)]) == times
