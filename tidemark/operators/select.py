"""Numbering, limits, samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import row_number, running_sum, scan


def numbered(df: DataFrame, order: Sequence[str], *, pos: str, width: float = 600.0,
             key: str = "source_id", name: str = "n") -> DataFrame:
    """1-based position per key without sorting a key in one task."""
    return scan(df, [key], list(order), {name: row_number()}, pos=pos, width=width)


def batches(df: DataFrame, size: int, order: Sequence[str], *, pos: str, width: float = 600.0,
            key: str = "source_id") -> DataFrame:
    """Fixed-size batches in order: ``batch_ix`` from 0."""
    return numbered(df, order, pos=pos, width=width, key=key, name="__n").withColumn(
        "batch_ix", F.floor((F.col("__n") - 1) / size).cast("bigint")
    ).drop("__n")


def cap_per_key(df: DataFrame, k: int, order: Sequence[Column], *, key: str = "source_id") -> DataFrame:
    """First ``k`` rows per key; Spark prunes to ``k`` per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def even_subsample(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int = 6) -> DataFrame:
    """Every ``n // k``-th row of a group up to ``k``; groups of at most ``k`` stay whole.

    A group is one clip's search window, so its size is bounded by the window length.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    whole = Window.partitionBy(*group)
    step = F.when(F.col("__n") > k, F.floor(F.col("__n") / k)).otherwise(F.lit(1))
    return (
        df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(whole)})
        .where((F.pmod(F.col("__i"), step) == 0) & (F.floor(F.col("__i") / step) < k))
        .drop("__i", "__n")
    )


def hash_split(
    df: DataFrame, key: str, *, ratio: float = 0.8, name: str = "split", hex_digits: int = 3
) -> DataFrame:
    """Exact train / val split of sizes ``int(n * ratio)`` and the rest, in md5 order.

    Rows are counted per md5 prefix (at most 16**hex_digits counts).  A prefix wholly below
    or above the cut decides its rows without moving them.  Only the prefix that holds the
    cut is ranked, by a scan in pieces of bounded rows, so that no task ranks it alone even
    where one repeated key fills it; rows of one key are ordered by a hash of all columns.
    """
    code = F.md5(F.col(key).cast("string"))
    rows = df.withColumns({"__h": code, "__p": F.substring(code, 1, hex_digits)})
    per = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    # at most 16**hex_digits rows: one task may sum them
    w = Window.orderBy("__p")
    cuts = per.withColumns(
        {"__upto": F.sum("__c").over(w), "__all": F.sum("__c").over(Window.partitionBy())}
    ).withColumn("__take", F.floor(F.col("__all") * ratio).cast("bigint"))
    cuts = cuts.select("__p", (F.col("__upto") - F.col("__c")).alias("__from"), "__upto", "__take")
    # a null key has no md5, and is a prefix of its own
    placed = rows.join(F.broadcast(cuts.withColumnRenamed("__p", "__q")), F.col("__p").eqNullSafe(F.col("__q"))).drop("__q")
    clear = placed.where((F.col("__upto") <= F.col("__take")) | (F.col("__from") >= F.col("__take")))
    edge = placed.where((F.col("__upto") > F.col("__take")) & (F.col("__from") < F.col("__take")))
    # the next 32 bits of the code deal the prefix over 64 bins
    next_bits = F.conv(F.substring("__h", hex_digits + 1, 8), 16, 10).cast("double")
    tie = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    edge = scan(
        edge.withColumns({"__row": tie, "__bits": next_bits}), ["__p"], ["__h", key, "__row"], {"__rank": row_number()},
        pos="__bits", width=float(1 << 26),
    )
    edge = edge.withColumn("__at", F.col("__from") + F.col("__rank")).drop("__row", "__bits", "__rank")
    done = clear.withColumn("__at", F.col("__upto")).unionByName(edge)
    return done.select(
        *df.columns, F.when(F.col("__at") <= F.col("__take"), "train").otherwise("val").alias(name)
    )


def sample_negatives(df: DataFrame, is_negative: Column, key: str, *, percent: int = 10) -> DataFrame:
    """All positives and a fixed ``percent`` of negatives, chosen by md5: same rows every run."""
    code = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.where(~is_negative | (code % 100 < percent))


def edge_texts(
    members: DataFrame, group: Sequence[str], order: Sequence[str], *, text: str = "text", k: int = 3
) -> DataFrame:
    """First and last ``k`` texts of a group, blanks dropped, in order.

    Two rank limits leave at most ``k`` rows per group and task before anything moves.
    """
    asc = Window.partitionBy(*group).orderBy(*order)
    desc = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    narrow = members.select(*group, *[c for c in order if c not in group], text)
    place = F.struct(*order)

    def pick(w, name: str) -> DataFrame:
        near = narrow.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
        kept = F.array_sort(F.collect_list(F.struct(place.alias("o"), F.coalesce(text, F.lit("")).alias("v"))))
        return near.groupBy(*group).agg(
            F.filter(F.transform(kept, lambda x: x["v"]), lambda v: F.trim(v) != "").alias(name)
        )

    return pick(asc, "first_texts").join(pick(desc, "last_texts"), list(group), "full")


__all__ = [
    "batches", "cap_per_key", "edge_texts", "even_subsample", "hash_split", "numbered",
    "running_sum", "sample_negatives",
]
