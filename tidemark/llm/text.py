"""Shared helpers: the documents table, Arrow batches of bounded size, hashes of words.

A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and
carriage return.  Hashes have 64 bits and depend on the word alone, so that they agree on
every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

#: Bytes of text that numpy works on at once; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_rows(docs: DataFrame, *extra: str) -> DataFrame:
    """The columns an operator reads, under fixed names; a null text is kept as null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def where_made(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are costly to make.

    The optimizer moves a plain filter below the projections that make its columns and so has
    them made again, once per mention; it leaves a filter on a running number where it is.
    """
    fence = "__fence"
    return df.withColumn(fence, F.monotonically_increasing_id()).where(condition & (F.col(fence) >= 0)).drop(fence)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _STEP)]), dtype=np.uint64)
    return _powers


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) with at most ``limit`` bytes, one text at least."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def words_of(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the number of words of each text, and each word's first byte in its text."""
    buf = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    word = ~_IS_SPACE[buf]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(b) + 1 for b in encoded])
    count = np.diff(np.searchsorted(begin, ends), prepend=0)
    if not len(begin):
        return np.zeros(0, np.uint64), count, begin
    at = np.flatnonzero(word)
    length = end - begin
    inside = at - np.repeat(begin, length)
    part = (buf[at].astype(np.uint64) + np.uint64(1)) * _power(int(length.max()))[inside]
    sums = np.add.reduceat(part, np.concatenate([[0], np.cumsum(length)[:-1]]))
    return mix(sums + length.astype(np.uint64)), count, begin - np.repeat(ends - [len(b) + 1 for b in encoded], count)


_TAPS = np.cumprod(np.full(64, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)


def grams(hashes: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and the number of windows of each text.

    A text of fewer than ``n`` words, but at least one, has one window: all its words.
    """
    full = len(hashes) - n + 1
    sums = np.zeros(max(full, 0), np.uint64)
    for k in range(n if full > 0 else 0):
        sums += hashes[k : k + full] * _TAPS[k]
    first = np.cumsum(count) - count
    out, sizes = [], np.where(count >= n, count - n + 1, np.minimum(count, 1))
    if (count < n).any() or full <= 0:
        for f, c in zip(first.tolist(), count.tolist(), strict=True):
            if c >= n:
                out.append(sums[f : f + c - n + 1])
            elif c:
                out.append((hashes[f : f + c] * _TAPS[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c))
        return (mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)), sizes
    keep = np.ones(len(sums), bool)
    for e in np.cumsum(count)[:-1].tolist():
        keep[max(0, e - n + 1) : e] = False
    return mix(sums[keep]), sizes


def parted(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def string_column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
