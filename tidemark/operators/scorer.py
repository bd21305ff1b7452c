"""Hook for user-supplied scorers that work on batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def score_batches(
    df: DataFrame, scorer: Callable[[pd.DataFrame], Sequence], *, keep: Sequence[str], batch_size: int = 128,
    value_type: str = "DOUBLE",
) -> DataFrame:
    """Run ``scorer`` on fixed-size batches; one result row per input row.

    The scorer returns one value per row.  A row whose value is an exception, and every row
    of a batch that raises, becomes an error row; the job goes on.  Filter and prune before
    calling this: Spark does not push filters through it.
    """
    kept = {f.name: f for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kept[c].dataType.simpleString()}" for c in keep)
    schema += f", value {value_type}, error STRING"
    keep = list(keep)

    def describe(err: Exception) -> str:
        return f"{type(err).__name__}: {err}"

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            results = list(scorer(batch))
        except Exception as err:  # a failing batch is data, not a failed job
            results = [err] * len(batch)
        out = batch[keep].copy()
        out["value"] = [None if isinstance(r, Exception) else r for r in results]
        out["error"] = [describe(r) if isinstance(r, Exception) else None for r in results]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                yield one(frame.iloc[at : at + batch_size].reset_index(drop=True))

    return df.mapInPandas(run, schema)
