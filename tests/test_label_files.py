"""Label files: a file per row, made and listed by tasks."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.sources import readers, sinks


def test_files_are_made_by_many_tasks_and_bear_their_stem(spark, tmp_path):
    """one task made all files, and Hadoop's local store started processes for each."""
    folder = tmp_path / "out"
    docs = spark.range(500).select(F.concat(F.lit("frame_"), F.col("id").cast("string")).alias("stem"), (F.col("id") % 3).alias("value"))
    sinks.write_texts(docs, str(folder))
    made = [p for p in folder.rglob("*") if p.is_file()]
    assert {p.name: p.read_text() for p in made} == {f"frame_{i}.txt": f"{i % 3}\n" for i in range(500)}
    assert len(made) == 500 and len({p.parent for p in made}) > 32
    assert not [p for p in folder.iterdir() if p.name.startswith("_")]
    with pytest.raises(FileExistsError):
        sinks.write_texts(docs, str(folder))


def test_listing_holds_no_file_on_the_driver(spark, tmp_path):
    """F1: Spark's index of 1.2 million files did not fit a driver of 750 MB."""
    for name in ("a.txt", "b.TXT", "sub/deep/c.txt", "sub/d.jpg", "_part-1-7/e.txt", ".f.txt", "stem=x/part-0.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1\n")
    (tmp_path / "empty.txt").touch()
    os.symlink(tmp_path / "nothing", tmp_path / "gone.txt")
    found = readers.list_files(spark, str(tmp_path), [".txt"], kind="label")
    assert {(r.stem, r.ext, r.path, r.length, r.kind) for r in found.collect()} == {
        (stem, ".txt", f"file:{tmp_path}/{name}", 2, "label")
        for stem, name in [("a", "a.txt"), ("b", "b.TXT"), ("c", "sub/deep/c.txt"), ("x", "stem=x/part-0.txt")]
    }
    assert found.inputFiles() == []
    by_pattern = readers.list_files(spark, f"{tmp_path}/s*", [".txt"])
    assert {r.stem for r in by_pattern.collect()} == {"c", "x"}


def test_other_stores_get_their_files_by_spark(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.labels.link./out", f"file://{tmp_path}")
    docs = spark.createDataFrame([("u", "1"), ("v", "0"), ("v", None)], "stem STRING, value STRING")
    sinks.write_texts(docs, "viewfs://labels/out/texts")
    found = readers.list_files(spark, "viewfs://labels/out/texts", [".txt"])
    assert sorted(r.stem for r in found.collect()) == ["u", "v", "v"]
    assert sorted(p.read_text() for p in Path(tmp_path).rglob("*.txt")) == ["\n", "0\n", "1\n"]


def test_a_second_attempt_at_a_task_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("u", "1"), ("u", "2"), ("v", "0")], "stem STRING, value STRING").coalesce(1).sortWithinPartitions("stem", "value")
    for _ in range(2):
        assert docs.mapInArrow(sinks._one_file_each(str(tmp_path)), "n long").agg(F.sum("n")).first()[0] == 3
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.txt")} == {"part-0/u.txt", "part-0/copy-1/u.txt", "part-0/v.txt"}


def test_each_label_row_is_listed(spark, tmp_path):
    """Two labels of one document, and labels of none, are rows of the SQL statement too."""
    ids = [1, 2, 2, None, None, 3]
    spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0,)], "doc_id BIGINT").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.stem for r in QUERIES["s08_file_list"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([None if i is None else f"frame_{i}" for i in ids], key=str)
