"""Labelled training sets: uncertain frames, answers, sampling, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import yes_no
from tidemark.operators.scan import next_value, scan
from tidemark.operators.select import hash_split, sample_negatives
from tidemark.session import cut_lineage

KEY = "source_id"


def uncertain_frames(detections: DataFrame, *, low: float = 0.20, high: float = 0.75, frame: str = "frame", step: int = 5) -> DataFrame:
    """Scanned frames with at least one box of middling confidence."""
    hit = F.col("confidence").between(low, high) & (F.pmod(F.col(frame), F.lit(step)) == 0)
    return detections.where(hit).select(KEY, frame).distinct()


def next_uncertain(frames: DataFrame, uncertain: DataFrame, *, frame: str = "frame", width: float = 4096) -> DataFrame:
    """For each frame the next uncertain frame after it, if any."""
    at = F.col(frame).alias("__at")
    asks = frames.select(KEY, at, F.lit(True).alias("__ask"), F.lit(None).cast("bigint").alias("__m"))
    marks = uncertain.select(KEY, at, F.lit(False).alias("__ask"), F.col(frame).cast("bigint").alias("__m"))
    # read twice by the scan, to draw its borders and to number: written once
    both = cut_lineage(asks.unionByName(marks).groupBy(KEY, "__at").agg(F.bool_or("__ask").alias("__ask"), F.max("__m").alias("__m")))
    out = scan(
        both, [KEY], ["__at"], {"next_uncertain": next_value(F.col("__m"), inclusive=False)},
        pos="__at", width=width, backward=True,
    )
    return out.where("__ask").select(KEY, F.col("__at").alias(frame), "next_uncertain")


def answered(frames: DataFrame, answers: DataFrame, *, stem: str = "stem") -> DataFrame:
    """Frames with their reply class; missing replies are unexpected."""
    return frames.join(answers, stem, "left").withColumn("reply_class", yes_no(F.col("answer")))


def curate_dataset(
    frames: DataFrame, answers: DataFrame, labels: DataFrame, *, ratio: float = 0.8, negatives_percent: int = 10,
    stem: str = "stem",
) -> DataFrame:
    """Positives and a sample of negatives, label attached where there is one, split."""
    seen = answered(frames, answers, stem=stem).where(F.col("reply_class") != "UNEXPECTED")
    kept = sample_negatives(seen, F.col("reply_class") == "NO", stem, percent=negatives_percent)
    paired = kept.join(labels.withColumn("has_label", F.lit(True)), stem, "left").withColumn(
        "has_label", F.coalesce("has_label", F.lit(False))
    )
    return hash_split(paired, stem, ratio=ratio)


def split_counts(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("has_label")).alias("labelled")
    )


def dataset_text(root: str, classes: DataFrame) -> DataFrame:
    """Lines of the dataset description: paths and the class map, in order."""
    spark = classes.sparkSession
    head = spark.createDataFrame(
        [(-4, f"path: {root}"), (-3, "train: images/train"), (-2, "val: images/val"), (-1, "names:")],
        "ix BIGINT, line STRING",
    )
    body = classes.select(
        F.col("ix").cast("bigint").alias("ix"),
        F.concat(F.lit("  "), F.col("ix").cast("string"), F.lit(": '"), F.col("name"), F.lit("'")).alias("line"),
    )
    return head.unionByName(body)
