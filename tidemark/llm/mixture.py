"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words.  Source weights share the total; no target exceeds three times its source
(``source_targets``).  The total is cut into blocks of equal words, and the blocks go to the
sources by the highest quotients target / (2 k + 1).  Sources are dealt into shards by a hash
of document id and text, and a source's blocks go to its shards in the same way, which leaves every
shard an integer quota.  A shard reads its documents in seeded order, so many times whole as
the quota holds, and the rest as a run of blocks from a seeded block on.  Blocks are never
rows: the words of a document inside the run are plain arithmetic on its running offset.

At scale: one narrow staged table (id, source, size); windows run over (source, shard) only,
and a shard holds about ``shard_words`` words or ``shard_rows`` rows, whatever a source's share of the
rows; only equal rows (id and text) stay together.  The
quotient ranking reads a few rows per shard; one row per source passes a window of its own, so
the number of distinct sources must stay in the millions.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last
in order; repeated rows are separate documents; an empty table gives no rows; extra columns of
the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import WORD
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)  # repeating, by source in code point order; divisors of 6
    max_repeats: int = 3
    seed: str = "mix-1"
    #: Words of a block, at any size of the input; blocks are arithmetic, so that small ones cost nothing.
    block_words: int = 64
    #: A shard has about so many words or rows, whichever are reached first, and there are at most ``max_shards`` of a source or so.
    shard_words: int = 1 << 16
    shard_rows: int = 1 << 14
    max_shards: int = 1 << 16


DEFAULT = MixParams()

_HEX = 7  # hex digits of md5 read as a number


def _number(*parts: Column) -> Column:
    """A whole number under 2**28 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX), 16, 10).cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def sizes(docs: DataFrame, p: MixParams = DEFAULT) -> DataFrame:
    """doc_id, source, size and the seeded order key of every row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # the text takes part, so that rows of one id, or of none, are dealt over shards as well
    key = F.md5(F.concat_ws("|", F.lit(p.seed), blank("doc_id"), F.md5(blank("text"))))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("seeded"),
    )


def source_targets(sized: DataFrame, p: MixParams = DEFAULT) -> DataFrame:
    """One row per source: its rank, weight, size, cap and target.

    Sources below their cap share what the capped ones leave.  In the order of cap / weight the
    capped sources come first, so that running sums decide which they are.
    """
    unit = 6  # the weights divide it, which keeps the order key whole
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_fill = every.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(w) for w in p.weights])
    base = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ranked = base.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.get(weights, (F.col("rank") - 1) % len(p.weights)).cast("long")
    )
    ranked = (
        ranked.withColumn("cap", F.col("source_size") * p.max_repeats)
        .withColumn("fill", F.col("source_size") * (F.lit(unit) / F.col("weight")).cast("long"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_weights", F.sum("weight").over(every))
    )
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("capped", _wide(left) * _wide(F.col("weight")) > _wide(F.col("cap")) * _wide(left_weight))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    rest_weight = F.col("all_weights") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (rest * F.col("weight")).cast("double") / rest_weight.cast("double")
    )
    block = F.lit(p.block_words).cast("long")
    return ranked.withColumn("target", target).withColumn("block", block).select(
        "source", "rank", "weight", "source_size", "source_rows", "cap", "target", "total", "block"
    )


def apportion(parties: DataFrame, votes: str, seats: str, group: list[str], order: list[str], into: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` (one value per group) among the rows of a group by highest quotients.

    Ties go by ``order``.  A party's seats differ from its rounded share by no more than
    1 + share * parties / 2, so only quotients within that reach are ranked: a few per
    party, not one per seat.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.col(votes).cast("double") / F.sum(F.col(votes).cast("double")).over(w)
    df = parties.withColumn("__share", F.coalesce(F.when(F.sum(F.col(votes)).over(w) > 0, share), F.lit(0.0)))
    df = df.withColumn("__near", F.floor(F.col("__share") * F.col(seats)).cast("long"))
    df = df.withColumn("__reach", (F.ceil(F.col("__share") * F.count(F.lit(1)).over(w)) + 2).cast("long"))
    df = df.withColumn("__sure", F.greatest(F.lit(0), F.col("__near") - F.col("__reach")).cast("long"))
    df = df.withColumn("__open", F.col(seats) - F.sum("__sure").over(w))
    tried = df.withColumn("__k", F.explode(F.sequence(F.col("__sure"), F.col("__near") + F.col("__reach"))))
    tried = tried.withColumn("__q", F.col(votes).cast("double") / (F.col("__k") * 2 + 1).cast("double"))
    ranked = tried.withColumn(
        "__place", F.row_number().over(w.orderBy(F.col("__q").desc(), *[F.col(c).asc_nulls_last() for c in order], "__k"))
    )
    won = (F.col("__place") <= F.col("__open")) & (F.col(votes) > 0)
    keep = [F.first(c).alias(c) for c in parties.columns if c not in {*group, *order}]
    return ranked.groupBy(*group, *order).agg(
        *keep, (F.first("__sure") + F.sum(F.when(won, 1).otherwise(0))).cast("long").alias(into)
    )


def mixture(docs: DataFrame, p: MixParams = DEFAULT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``."""
    sized = cut_lineage(sizes(docs, p))
    return _take(sized, p)


def _take(sized: DataFrame, p: MixParams) -> DataFrame:
    targets = source_targets(sized, p)
    n_blocks = F.round(F.col("total") / F.col("block")).cast("long")
    quotas = apportion(targets.withColumn("n_blocks", n_blocks), "target", "n_blocks", [], ["rank"], "blocks")
    per_shard = F.greatest(F.lit(p.shard_words), F.floor(F.col("total") / p.max_shards))
    most_rows = F.greatest(F.lit(p.shard_rows), F.floor(F.col("source_rows") / p.max_shards))
    quotas = quotas.withColumn(
        "n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard), F.ceil(F.col("source_rows") / most_rows)).cast("long")
    )
    quotas = cut_lineage(quotas.select("rank", "source", "source_size", "cap", "target", "block", "blocks", "n_shards"))

    shard = (F.conv(F.substring("seeded", 8, _HEX), 16, 10).cast("long") % F.col("n_shards")).alias("shard")
    joined = sized.join(quotas.select("source", "rank", "n_shards"), sized["source"].eqNullSafe(quotas["source"])).select(
        sized["doc_id"], sized["source"], "size", "seeded", "rank", shard
    )
    cells = joined.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    cells = cells.join(quotas.drop("source"), "rank")
    cells = apportion(cells, "shard_size", "blocks", ["rank"], ["shard"], "shard_blocks")
    n = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    quota = F.least(F.col("shard_blocks") * F.col("block"), F.col("shard_size") * p.max_repeats)
    start = F.col("block") * (_number(F.lit(p.seed), F.col("rank"), F.col("shard")) % F.greatest(n, F.lit(1)))
    cells = cells.select(
        "rank", "shard", "shard_size", "source_size", "target",
        F.when(F.col("shard_size") > 0, F.floor(quota / F.col("shard_size"))).otherwise(0).cast("long").alias("passes"),
        F.when(F.col("shard_size") > 0, quota % F.col("shard_size")).otherwise(0).cast("long").alias("rest"),
        start.alias("start"),
    )
    order = Window.partitionBy("rank", "shard").orderBy("seeded", F.col("doc_id").asc_nulls_last(), "size")
    placed = joined.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = placed.join(cells, ["rank", "shard"])
    a, b, s = F.col("stop") - F.col("size"), F.col("stop"), F.col("start")

    def inside(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(b, high) - F.greatest(a, low))

    e = s + F.col("rest")
    taken = F.col("passes") * F.col("size") + inside(s, e) + inside(s - F.col("shard_size"), e - F.col("shard_size"))
    return full.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, p: MixParams = DEFAULT) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, rounded to whole documents.

    Rows are matched by id, source and size; rows alike in all three share what they take.
    """
    names = docs.columns
    key = "__row"
    while key in names:
        key += "_"
    takes = mixture(docs, p)
    spread = takes.groupBy("doc_id", "source", "size").agg(
        F.sum("taken").alias("__taken"), F.count(F.lit(1)).alias("__rows")
    )
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    left = docs.withColumn(key, size)
    joined = left.join(
        spread,
        left["doc_id"].cast("long").eqNullSafe(spread["doc_id"])
        & left["source"].cast("string").eqNullSafe(spread["source"])
        & (left[key] == spread["size"]),
    )
    times = F.when(left[key] > 0, F.floor(F.col("__taken") / (left[key] * F.col("__rows")) + F.lit(0.5))).otherwise(0)
    return joined.select(
        *[left[f"`{c}`"].alias(c) for c in names], F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias(key)
    ).drop(key)


# --- the query -------------------------------------------------------------------------------


def source_mix(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.text import documents

    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


_P = DEFAULT
_W = "CASE (rank - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"


def _hexnum(expr: str, begin: int) -> str:
    return f"CAST('0x' || substr(md5({expr}), {begin}, {_HEX}) AS BIGINT)"


_SEEDED = f"'{_P.seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))"

SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                  md5({_SEEDED}) AS seeded, {_hexnum(_SEEDED, 8)} AS dealt FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows, row_number() OVER (ORDER BY source NULLS LAST) AS rank
      FROM d GROUP BY source),
r AS (SELECT *, {_W} AS weight, 3 * source_size AS cap, source_size * (6 // {_W}) AS fill,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
f AS (SELECT *, CAST(sum(weight) OVER () AS HUGEINT) AS all_weights,
             coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before FROM r
      WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - cap_before) * weight > cap * (all_weights - weight_before) AS capped FROM f),
t AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE)
        ELSE CAST((total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * weight AS DOUBLE)
             / CAST(all_weights - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS DOUBLE) END AS target,
        {_P.block_words} AS block, greatest({_P.shard_words}, total // {_P.max_shards}) AS per_shard,
        greatest({_P.shard_rows}, source_rows // {_P.max_shards}) AS most_rows FROM c),
n AS (SELECT *, CAST(round(total / block) AS BIGINT) AS n_blocks,
             CAST(greatest(1, ceil(source_size / per_shard), ceil(source_rows / most_rows)) AS BIGINT) AS n_shards FROM t),
q AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place, n_blocks
      FROM n, unnest(generate_series(0, n_blocks)) AS g(k) WHERE target > 0),
a AS (SELECT n.*, coalesce(x.blocks, 0) AS blocks FROM n LEFT JOIN
        (SELECT rank, count(*) AS blocks FROM q WHERE place <= n_blocks GROUP BY rank) x USING (rank)),
j AS (SELECT d.*, a.rank, d.dealt % a.n_shards AS shard FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
h AS (SELECT j.rank, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(a.blocks) AS blocks,
             any_value(block) AS block, any_value(source_size) AS source_size, any_value(target) AS target
      FROM j JOIN a USING (rank) GROUP BY j.rank, shard),
hq AS (SELECT rank, shard, blocks, row_number() OVER (PARTITION BY rank ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
       FROM h, unnest(generate_series(0, blocks)) AS g(k) WHERE shard_size > 0),
hb AS (SELECT h.*, coalesce(x.got, 0) AS got FROM h LEFT JOIN
        (SELECT rank, shard, count(*) AS got FROM hq WHERE place <= blocks GROUP BY rank, shard) x USING (rank, shard)),
p AS (SELECT *, least(got * block, 3 * shard_size) AS quota,
        block * ({_hexnum(f"'{_P.seed}|' || rank || '|' || shard", 1)} % greatest(CAST(ceil(shard_size / block) AS BIGINT), 1)) AS s0 FROM hb),
o AS (SELECT doc_id, source, size, rank, shard,
        sum(size) OVER (PARTITION BY rank, shard ORDER BY seeded, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS stop FROM j)
SELECT doc_id, size, source_size, target, source,
  CAST(CASE WHEN shard_size = 0 THEN 0 ELSE (quota // shard_size) * size
    + greatest(0, least(stop, s0 + quota % shard_size) - greatest(stop - size, s0))
    + greatest(0, least(stop, s0 + quota % shard_size - shard_size) - greatest(stop - size, s0 - shard_size)) END AS BIGINT) AS taken
FROM o JOIN p USING (rank, shard)
"""
