"""Fuzzy text similarity: the one scalar that has no built-in form."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts (not symmetric); null in, null out.

    The function is wrapped when called, as a session must exist by then.
    """
    return F.pandas_udf(_ratios, "double")(a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    """Native stand-in: 1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def fold_changed(similarity: float, key: str, bin_col: str):
    """Fold for change detection, for ``mapInArrow``: rows of a bin stand together, in order.

    The upper bounds of the ratio, by length and by characters, are asked before the ratio
    itself, and a pair of texts is judged once as long as it is remembered.
    """

    def unlike(a: str, b: str) -> bool:
        match = SequenceMatcher(None, a, b)
        return match.real_quick_ratio() < similarity or match.quick_ratio() < similarity or match.ratio() < similarity

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[key, bin_col, "__ids", "__exit", "__entry"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = lru_cache(1 << 14)(unlike)
        now, out = None, []
        for batch in batches:
            names = [key, bin_col, "tie", "text", "__entry"]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for source, place, ident, text, entry in zip(*columns):
                if now != (source, place):
                    if now is not None:
                        out.append((*now, kept, left, begun))
                    now, kept, left, begun, last = (source, place), [], None, entry, entry
                if judged(last, text):
                    kept.append(ident)
                    last = left = text
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([(*now, kept, left, begun)])

    return run
