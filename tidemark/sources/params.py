"""Scenario parameters: layered sections, rule tables as dimensions."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULTS: dict[str, dict] = {
    # fixed values: defaults of every section
    "detection": {"interval_seconds": 1.0, "min_confidence": 0.5, "enable_ocr": True, "target_labels": [], "label_weights": {}},
    "scoring": {
        "points_system": {"elimination": 100, "victory": 500, "damage": 10, "special_event": 200},
        "multipliers": {"streak_bonus": 1.5, "accuracy_bonus": 1.2, "speed_bonus": 1.1},
    },
    "audio": {"enabled": True, "chunk_sec": 1.0, "threshold": 0.30, "merge_to_events": True, "pruning_padding": 15.0},
    "clumping": {
        "mode": "elimination", "elim_merge_gap": 30.0, "audio_lookback": 30.0, "audio_lookahead": 30.0, "end_buffer": 5.0,
        "clip_merge_gap": 60.0, "window_seconds": 60, "min_intensity": 3.0, "gap_threshold": 30.0, "intensity_weights": {},
    },
    "safe_entry_exit": {"enabled": True, "entry_buffer": 1.2, "exit_buffer": 1.5},
}


def layered(*layers: Mapping[str, Mapping]) -> dict[str, dict]:
    """Later layers replace whole sections; missing keys then take the section's default."""
    chosen: dict[str, dict] = {k: dict(v) for k, v in DEFAULTS.items()}
    for layer in layers:
        for section, values in layer.items():
            chosen[section] = dict(values)
    for section, values in DEFAULTS.items():
        chosen[section] = {**values, **chosen[section]}
    return chosen


def read_params(spark: SparkSession, path: str) -> dict[str, dict]:
    """One scenario file (a few kB of settings), layered over the defaults."""
    text = spark.read.text(path, wholetext=True).first()
    return layered(json.loads(text[0]) if text else {})


def layer_rows(rows: DataFrame) -> DataFrame:
    """The same layering on a table of ``scenario, layer, section, key, value``.

    Per scenario and section the highest layer wins whole; keys it lacks come from layer 0.
    """
    w = Window.partitionBy("scenario", "section")
    marked = rows.withColumn("__top", F.max("layer").over(w))
    order = Window.partitionBy("scenario", "section", "key").orderBy(F.col("layer").desc())
    return (
        marked.where((F.col("layer") == F.col("__top")) | (F.col("layer") == 0))
        .withColumn("__r", F.row_number().over(order))
        .where("__r = 1")
        .select("scenario", "section", "key", "value")
    )


def label_dimension(spark: SparkSession, values: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Rule maps as one row per label and a column per map; as small as the rules."""
    labels = sorted({lb for m in values.values() for lb in m})
    rows = [(lb, *[None if lb not in m else float(m[lb]) for m in values.values()]) for lb in labels]
    return spark.createDataFrame(rows, "label STRING, " + ", ".join(f"`{n}` DOUBLE" for n in values))


def with_label_values(events: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach a label dimension; unknown labels get 0."""
    names = [c for c in dimension.columns if c != "label"]
    out = events.join(F.broadcast(dimension), "label", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
