"""Near copies of embeddings by lattice hashing.

Unit vectors are projected by random normal matrices to groups of eight numbers; every group is
decoded to the nearest point of the E8 lattice.  In each of several tables the points of all
groups together are a cell.  A vector goes to its own cell and to the ``probes`` nearest ones among
the cells that differ in one group by one of the 240 shortest lattice steps.  Vectors of equal label
that meet in any cell are compared by cosine in double precision.

* Copies: equal vectors of a label are one node with a weight, by a map-side aggregation before
  anything else, so that a group of exact copies is one row.
* Cells that hold the same vectors are compared once.
* A pair is counted in the least of the cells that its two vectors share, so that sums are exact
  although vectors meet in many cells; no pair is written out.
* A cell of any size is compared block by block: a task holds two blocks of bounded size, adds up
  the links of each vector and ties vectors that belong together.
* Components of ties come from distributed star rounds (``graph``).

The cell width grows with the chord of the threshold.  At the threshold itself two vectors share a
cell of a table with probability 0.90 at least (measured on random pairs of 64 numbers), so that
five tables miss one pair in 10^5; nearer pairs are missed less.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite numbers, and one without
label or id, has no links and is a component of its own (null for a null id); vectors of unlike
length are not compared; rows that repeat an id count as vectors of their own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.text import mix
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class LatticeParams:
    threshold: float = 0.98
    tables: int = 5
    #: Lattice points that make a cell.
    groups: int = 2
    probes: int = 3
    #: Cell width in chords of the threshold.
    width: float = 9.0
    #: Vectors of a block, about.
    block: int = 512
    seed: int = 29

    @property
    def scale(self) -> float:
        return self.width * float(np.sqrt(2 * (1 - self.threshold)))


DEFAULT = LatticeParams()


# --- the lattice -----------------------------------------------------------------------------


def _even_points(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def lattice_points(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: those of even sum, or those moved by a half in every place."""
    whole, half = _even_points(x), _even_points(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


def shortest_steps() -> np.ndarray:
    """The 240 shortest points of E8."""
    pairs = [
        np.eye(8)[i] * s + np.eye(8)[j] * t
        for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)
    ]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


_STEPS = shortest_steps()
_TAPS = np.cumprod(np.full(64, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)


def cell_keys(unit: np.ndarray, label: np.ndarray, p: LatticeParams) -> np.ndarray:
    """Keys (rows x tables * (1 + probes)) of the cells that every vector goes to."""
    n, dim = unit.shape
    out = []
    for table in range(p.tables):
        draw = np.random.default_rng([p.seed, table, dim])
        points, gains = [], []
        for _ in range(p.groups):
            y = unit @ draw.normal(size=(dim, 8)) / p.scale
            point = lattice_points(y)
            points.append(point)
            gains.append((y - point) @ _STEPS.T)
        # Doubled coordinates are whole numbers; a cell's hash is a sum, so that a step changes it by a sum too.
        taps = _TAPS[: 8 * p.groups]
        own = (2 * np.concatenate(points, 1)).astype(np.int64).astype(np.uint64) @ taps
        moves = np.concatenate([(2 * _STEPS).astype(np.int64).astype(np.uint64) @ taps[8 * g : 8 * g + 8] for g in range(p.groups)])
        gain = np.concatenate(gains, 1)
        nearest = np.argsort(-gain, axis=1, kind="stable")[:, : p.probes]
        cells = np.concatenate([own[:, None], own[:, None] + moves[nearest]], 1)
        out.append(mix(cells ^ mix(label + np.uint64(table * 1_000_003 + dim))[:, None]))
    return np.concatenate(out, 1).view(np.int64)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # The largest number comes out first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# --- nodes and cells -------------------------------------------------------------------------


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label_hash, h1, h2 and vec (null where the vector can't have links)."""
    vec = F.col("embedding")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & whole
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.xxhash64(F.col("label").cast("string"), F.lit(3)).alias("label_hash"),
        F.when(usable, F.xxhash64("label", vec)).alias("h1"), F.when(usable, F.xxhash64(F.lit(17), vec, "label")).alias("h2"),
        F.when(usable, vec).alias("vec"),
    )


def _packed(kind: str, p: LatticeParams):
    """Vectors as bytes, with the keys of their cells; vectors of one length are worked on at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                raw = [np.asarray(v, kind).tobytes() for v in batch.column("vec").to_pylist()]
                labels = batch.column("label_hash").to_numpy(zero_copy_only=False).view(np.uint64)
                keys: list[list[int]] = [[]] * len(raw)
                size = np.array([len(r) for r in raw])
                for length in np.unique(size).tolist():
                    at = np.flatnonzero(size == length)
                    for i, found in zip(at.tolist(), cell_keys(_unit([raw[i] for i in at.tolist()], kind), labels[at], p).tolist(), strict=True):
                        keys[i] = found
                columns = [batch.column(c) for c in ("node", "least", "n_rows", "h1", "h2", "label_hash")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["node", "least", "n_rows", "h1", "h2", "label_hash", "vec", "keys"],
                )

    return run


_NODE = "node long, least long, n_rows long, h1 long, h2 long, label_hash long, vec binary, keys array<long>"


def _nodes(found: DataFrame, kind: str, p: LatticeParams) -> DataFrame:
    """One row per distinct vector of a label: node number, least vec_id, rows, bytes and cells."""
    one = found.where(F.col("vec").isNotNull()).groupBy("h1", "h2", "label_hash").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n_rows"), F.first("vec").alias("vec")
    )
    numbered = cut_lineage(one.withColumn("node", F.monotonically_increasing_id()))
    return cut_lineage(numbered.mapInArrow(_packed(kind, p), _NODE))


def _cells(nodes: DataFrame) -> DataFrame:
    """node, kept: the cells with company that a vector is compared in, each with its number of vectors."""
    at = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"))
    kept = sizes.where(F.col("n") > 1).groupBy("n", "who").agg(F.min("key").alias("key")).select("key", "n")
    # A vector has at most tables * (1 + probes) cells.
    return at.join(kept, "key").groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("kept"))


def _requests(cells: DataFrame, p: LatticeParams) -> DataFrame:
    """task, key, side, node: the two blocks of a cell that each task compares; side 2 stands for both."""
    one = cells.select("node", F.explode("kept").alias("c")).select("node", "c.key", F.ceil(F.col("c.n") / p.block).cast("int").alias("blocks"))
    own = one.withColumn("i", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    each = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    return each.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("task"), "key", side.alias("side"), "node")


# --- comparison ------------------------------------------------------------------------------


def _shared_before(keys: list[list[int]], key: int) -> np.ndarray:
    """Which rows share a cell of a lesser key."""
    flat = np.array([k for ks in keys for k in ks if k < key], np.int64)
    owner = np.repeat(np.arange(len(keys)), [sum(k < key for k in ks) for ks in keys])
    values, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1
    keep = often[column] > 1
    table = np.zeros((len(keys), int((often > 1).sum())), np.float32)
    table[owner[keep], rank[column[keep]]] = 1
    return (table @ table.T) > 0


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index of the component of every row."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None], len(root)).min(1, initial=len(root)))
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def links(unit: np.ndarray, labels: np.ndarray, side: np.ndarray, keys: list[list[int]], key: int, threshold: float) -> np.ndarray:
    """Which rows of two blocks are linked and not counted in a lesser cell."""
    linked = (unit @ unit.T >= threshold) & (labels[:, None] == labels)
    linked &= (side[:, None] != side) | (side[:, None] == 2)
    np.fill_diagonal(linked, False)
    return linked & ~_shared_before(keys, key) if linked.any() else linked


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            for row in whole.slice(first, 1000).to_pylist():
                if held and held[-1]["task"] != row["task"]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _compare(kind: str, p: LatticeParams):
    """node, tied (the least node of its links in the task) and weight (rows linked) of every linked vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for group in _tasks(batches):
            by_cell: dict[tuple[int, int], list[dict]] = {}
            for r in group:
                by_cell.setdefault((r["key"], len(r["vec"])), []).append(r)
            for (key, _), rows in by_cell.items():
                if len(rows) < 2:
                    continue
                rows.sort(key=lambda r: r["node"])
                linked = links(
                    _unit([r["vec"] for r in rows], kind), np.array([r["label_hash"] for r in rows]),
                    np.array([r["side"] for r in rows]), [r["cells"] for r in rows], key, p.threshold,
                )
                weight, roots = linked @ np.array([r["n_rows"] for r in rows], np.int64), _roots(linked)
                out += [(rows[i]["node"], rows[roots[i]]["node"], int(weight[i])) for i in np.flatnonzero(linked.any(1)).tolist()]
            if len(out) > 50_000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    return run


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "tied", "weight"])


def near_vectors(rows: DataFrame, p: LatticeParams = DEFAULT) -> DataFrame:
    """vec_id, n_links, component_id of every row (vec_id, embedding, label)."""
    kind = "<f4" if "array<float>" in rows.select("embedding").schema["embedding"].dataType.simpleString() else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = vectors(rows)
    nodes = _nodes(found, kind, p)
    cells = cut_lineage(_cells(nodes))
    wanted = nodes.select("node", "label_hash", "n_rows", "vec").join(
        cells.select("node", F.transform("kept", lambda c: c["key"]).alias("cells")), "node"
    )
    fetched = _requests(cells, p).join(wanted, "node")
    compared = cut_lineage(
        fetched.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(kind, p), "node long, tied long, weight long")
    )
    sums = compared.groupBy("node").agg(F.sum("weight").alias("weight"))
    roots = components(compared.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    known = nodes.select("node", "least", "n_rows", "h1", "h2", "label_hash").join(roots, "node", "left").join(sums, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select(
        "h1", "h2", "label_hash", "component_id", (F.col("n_rows") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links")
    )
    zero = F.lit(0).cast("long")
    return found.select("vec_id", "h1", "h2", "label_hash").join(known, ["h1", "h2", "label_hash"], "left").select(
        "vec_id", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )


# --- the query -------------------------------------------------------------------------------


def embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
    label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
pairs AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM vecs a JOIN vecs b ON a.label = b.label AND a.r <> b.r
  WHERE a.ok AND b.ok AND len(a.v) = len(b.v)
    AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
walk AS (
  SELECT r AS a, r AS b FROM vecs
  UNION
  SELECT w.a, p.b FROM walk w JOIN pairs p ON p.a = w.b),
roots AS (SELECT w.a, min(v.vec_id) AS component_id FROM walk w JOIN vecs v ON v.r = w.b GROUP BY w.a)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.r) AS n_links, o.component_id, coalesce(v.vec_id = o.component_id, false) AS kept
FROM vecs v JOIN roots o ON o.a = v.r
"""
