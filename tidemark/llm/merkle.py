"""Merkle manifest of a dataset: a content-addressed graph, and proofs by descent from its root.

Every row is a leaf.  The leaves of a group (a language) ascend by id; every two nodes in a row
become their parent until one is left.  The groups' tops, in the order of the groups, are the
leaves of one more tree, whose top is the root of the dataset.

* Build: leaves get exact ranks from one range shuffle and per-partition counts (``ranked``).  A page
  is an aligned subtree of ``2 ** page_bits`` nodes: one task makes its levels and stores them as
  one record, digest of its top to all nodes below.  The tops of pages are the nodes of the
  next round, so that rounds grow with the logarithm of the table.
* Descent: a request is (group, rank).  Requests with the same prefix of rank digits go down
  together, one row per page and never one per leaf, so that the root's record is read once.  In a
  page the digits of a rank select one child after the other; the unselected ones are collected.
  Segments are put one after the other from the root down and reversed at the end.
* Verification folds a leaf and its siblings back to a root, with built-in functions.

A digest is sha256; inputs are concatenated, digests as lowercase hex text.

Defined cases: null values of a row hash as ``-``; null ids come first; rows of equal ids stand in the
order of their digests; equal rows are leaves of their own, with equal digests and their own ranks;
a null group comes first; a group of one row has its leaf as top; an empty table has no
records, no tops and no paths; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import documents
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class ManifestParams:
    #: Levels of the tree in one stored record.
    page_bits: int = 8


DEFAULT = ManifestParams()

_STEP = "array<struct<left: binary, right: binary>>"
_INDEX = (1 << 33) - 1


def coded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Binary digest of coded values."""
    return F.unhex(F.sha2(F.concat(*[coded(v) for v in values]).cast("binary"), 256))


def hex_of(value: Column) -> Column:
    return F.lower(F.hex(value))


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, long) and ``n`` (rows of the key) by one range shuffle.

    The rows are written once, as their places must not change between the two reads; a running
    number breaks ties, so that equal rows spread over tasks too.
    """
    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(key, *order, "__tie").sortWithinPartitions(key, *order, "__tie").drop("__tie")
    placed = cut_lineage(spread.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    borders = placed.groupBy(F.col(key).alias("__key"), part.alias("__part")).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(F.col("__at").bitwiseAND(_INDEX)).alias("__first")
    )
    whole = Window.partitionBy("__key")
    borders = borders.withColumn("__before", F.sum("__rows").over(whole.orderBy("__part")) - F.col("__rows")).withColumn(
        "n", F.sum("__rows").over(whole)
    )
    joined = placed.join(borders, (F.col(key) == F.col("__key")) & (part == F.col("__part")))
    rank = F.col("__before") + F.col("__at").bitwiseAND(_INDEX) - F.col("__first")
    return joined.select(*rows.columns, rank.alias("rank"), "n")


# --- pages -----------------------------------------------------------------------------------


def sizes_of(count: int, height: int) -> list[int]:
    """Nodes of every level of a page, from the bottom up."""
    return [-(-count >> j) if j else count for j in range(height + 1)]


def page_levels(bottom: Sequence[bytes], height: int) -> list[list[bytes]]:
    """All levels of a page, from the bottom up."""
    levels = [list(bottom)]
    for _ in range(height):
        below = [d.hex() for d in levels[-1]]
        levels.append([sha256("".join(below[i : i + 2]).encode()).digest() for i in range(0, len(below), 2)])
    return levels


def _height(count: int, pages: int, bits: int) -> int:
    """A page that is alone in its group ends where one node is left; others have full height."""
    return bits if pages > 1 else (count - 1).bit_length()


def _pages(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, heights, counts, nodes = [], [], [], []
            for n, bottom in zip(batch.column("n").to_pylist(), batch.column("bottom").to_pylist(), strict=True):
                height = _height(len(bottom), -(-n >> bits), bits)
                levels = page_levels([b["digest"] for b in bottom], height)
                tops.append(levels[-1][0])
                heights.append(height)
                counts.append(len(bottom))
                nodes.append(b"".join(d for level in levels for d in level))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("page"), batch.column("n"), pa.array(tops, pa.binary()),
                 pa.array(heights, pa.int32()), pa.array(counts, pa.int32()), pa.array(nodes, pa.binary())],
                names=["key", "page", "n", "digest", "height", "count", "nodes"],
            )

    return run


@dataclass(frozen=True)
class Tree:
    """``tops``: key, n, depth (rounds of pages), digest.  ``records``: by round, digest to the nodes of a page."""

    tops: DataFrame
    records: list[DataFrame]
    bits: int


def grow(nodes: DataFrame, p: ManifestParams = DEFAULT) -> Tree:
    """The trees of all keys over rows (key, rank, n, digest)."""
    bits = p.page_bits
    left = nodes.agg(F.max("n")).first()[0] or 0
    now = nodes.select("key", "rank", "n", "digest")
    tops, records = None, []
    while True:
        done = now.where(F.col("n") == 1).select("key", F.lit(len(records)).alias("depth"), "digest")
        tops = done if tops is None else tops.union(done)
        if left <= 1:
            break
        page = F.shiftright("rank", bits).alias("page")
        bottom = F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("bottom")
        full = now.where(F.col("n") > 1).groupBy("key", page, "n").agg(bottom)
        full = cut_lineage(
            full.select("key", "page", "n", "bottom").mapInArrow(
                _pages(bits), "key string, page long, n long, digest binary, height int, count int, nodes binary"
            )
        )
        # Equal subtrees have equal records: one of each is kept.
        records.append(full.select("digest", "height", "count", "nodes").dropDuplicates(["digest"]))
        fewer = F.shiftright(F.col("n") + ((1 << bits) - 1), bits)
        now = full.select("key", F.col("page").alias("rank"), fewer.alias("n"), "digest")
        left = -(-left >> bits)
    return Tree(tops, records, bits)


# --- descent ---------------------------------------------------------------------------------


def descend_page(nodes: bytes, count: int, height: int, digit: int) -> list[tuple[bytes | None, bytes | None]]:
    """Unselected children from the page's top down to the node ``digit`` of its bottom level."""
    sizes = sizes_of(count, height)
    first = [0]
    for s in sizes:
        first.append(first[-1] + s)
    out = []
    for level in range(height - 1, -1, -1):
        at = digit >> level
        other = at ^ 1
        found = None
        if other < sizes[level]:
            begin = 32 * (first[level] + other)
            found = nodes[begin : begin + 32]
        out.append((found, None) if at & 1 else (None, found))
    return out


_DOWN = ["key", "page", "root", "top", "path"]


def _down(bits: int, carried: pa.DataType | None = None) -> Callable:
    """One row for every wanted child of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.struct([("left", pa.binary()), ("right", pa.binary())])
        for batch in batches:
            wants = batch.column("wants")
            flat = wants.flatten()
            digits, owners = flat.field("digit").to_pylist(), pa.compute.list_parent_indices(wants)
            nodes, counts, heights = (batch.column(c).to_pylist() for c in ("nodes", "count", "height"))
            offsets, left, right, below = [0], [], [], []
            for digit, owner in zip(digits, owners.to_pylist(), strict=True):
                blob = nodes[owner]
                for a, b in descend_page(blob, counts[owner], heights[owner], digit):
                    left.append(a)
                    right.append(b)
                offsets.append(len(left))
                below.append(blob[32 * digit : 32 * digit + 32])
            segment = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], fields=list(step)),
            )
            held = [batch.column(c).take(owners) for c in _DOWN]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array(digits, pa.int64()), pa.array(below, pa.binary()), segment, flat.field("carry")],
                names=[*_DOWN, "digit", "digest", "segment", "carry"],
            )

    return run


def descend(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """key, rank, carry, root, top, digest, path of every request (key, rank, carry: a struct).

    ``starts`` has (key, root, top, path): the path that already leads from the root to the key's
    top.  ``path`` lists the steps from the leaf up: the siblings left or right of the node, none
    where it has no sibling.  A (key, rank) may be asked for once.
    """
    bits = tree.bits
    begun = tree.tops.join(starts, "key")
    kind = requests.schema["carry"].dataType.simpleString()
    depth = len(tree.records)
    state = None
    for s in range(depth - 1, -1, -1):
        fresh = begun.where(F.col("depth") == s + 1).select("key", F.lit(0).cast("long").alias("page"), "root", "top", "path", "digest")
        state = fresh if state is None else state.union(fresh)
        if s:
            asked = requests.select("key", F.shiftright("rank", bits * s).alias("node")).distinct().withColumn("carry", F.lit(None).cast("struct<x:int>"))
        else:
            asked = requests.select("key", F.col("rank").alias("node"), "carry")
        digit = F.col("node").bitwiseAND((1 << bits) - 1).cast("int").alias("digit")
        wants = asked.groupBy("key", F.shiftright("node", bits).alias("page")).agg(
            F.collect_list(F.struct(digit, "carry")).alias("wants")
        )
        opened = state.join(tree.records[s], "digest").join(wants, ["key", "page"])
        carry = kind if s == 0 else "struct<x:int>"
        went = opened.select(*_DOWN, "nodes", "count", "height", "wants").mapInArrow(
            _down(bits), f"key string, page long, root binary, top binary, path {_STEP}, digit long, digest binary, segment {_STEP}, carry {carry}"
        )
        node = F.shiftleft(F.col("page"), bits) + F.col("digit")
        path = F.concat("path", "segment").alias("path")
        if s:
            state = went.select("key", node.alias("page"), "root", "top", path, "digest")
        else:
            state = went.select("key", node.alias("rank"), "carry", "root", "top", "digest", path)
    lone = begun.where(F.col("depth") == 0).join(requests, "key").select("key", "rank", "carry", "root", "top", "digest", "path")
    found = lone if state is None else state.union(lone)
    return found.withColumn("path", F.reverse("path"))


def fold(leaf: Column, path: Column) -> Column:
    """Hex root that a leaf and the steps above it give."""
    side = lambda x: F.coalesce(hex_of(x), F.lit(""))
    return F.aggregate(path, hex_of(leaf), lambda node, step: F.sha2(F.concat(side(step["left"]), node, side(step["right"])).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """Hex digests of all siblings, from the leaf up, as one text."""
    return F.array_join(F.transform(path, lambda s: hex_of(F.coalesce(s["left"], s["right"]))), "")


# --- manifest of documents -------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """``leaves``: key (coded group), rank, n, id, leaf, changed.  Two trees: within groups, over their tops."""

    leaves: DataFrame
    groups: Tree
    whole: Tree
    ordinals: DataFrame


#: A group's key: null first, then by bytes.
def group_key(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(leaves: DataFrame, p: ManifestParams = DEFAULT) -> Manifest:
    """Manifest of rows (key, id, leaf, ...); what else they hold goes along with the leaves."""
    placed = ranked(leaves, "key", "id", "leaf")
    groups = grow(placed.withColumnRenamed("leaf", "digest"), p)
    tops = groups.tops.select(F.lit("").alias("all"), F.col("key").alias("group"), "digest")
    ordinals = ranked(tops, "all", "group")
    whole = grow(ordinals.withColumnRenamed("all", "key"), p)
    return Manifest(placed, groups, whole, ordinals)


def proofs(m: Manifest, requests: DataFrame) -> DataFrame:
    """Rows of ``descend`` for requests (key, rank, carry) against the whole manifest."""
    none = F.array().cast(_STEP)
    root = m.whole.tops.select("key", F.col("digest").alias("root"), F.col("digest").alias("top"), none.alias("path"))
    keys = m.ordinals.select(F.col("all").alias("key"), "rank", F.struct("group").alias("carry"))
    starts = descend(m.whole, root, keys).select(
        F.col("carry.group").alias("key"), "root", F.col("digest").alias("top"), F.reverse("path").alias("path")
    )
    return descend(m.groups, cut_lineage(starts), requests)


def document_leaves(docs: DataFrame) -> DataFrame:
    """key, id, leaf, changed: ``changed`` is the leaf after tampering, null where there is none."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select(*fields)
    plain = [F.col(f) for f in fields]
    other = [*plain[:3], F.col("n_chars") + 1, plain[4]]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return rows.select(
        group_key(F.col("lang")).alias("key"), F.col("doc_id").cast("long").alias("id"), digest(*plain).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), digest(*other)).alias("changed"),
    )


def proved_documents(docs: DataFrame, p: ManifestParams = DEFAULT) -> DataFrame:
    """doc_id, lang, rank, leaf, changed, top, root, path of every row."""
    m = manifest(document_leaves(docs), p)
    carry = F.struct("id", "leaf", "changed").alias("carry")
    found = proofs(m, m.leaves.select("key", "rank", carry))
    return found.select(
        F.col("carry.id").alias("doc_id"), F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("lang"),
        "rank", F.col("carry.leaf").alias("leaf"), F.col("carry.changed").alias("changed"), "top", "root", "path",
    )


# --- the query -------------------------------------------------------------------------------


def merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found = proved_documents(documents(spark, sf_dir))
    proof = F.sha2(siblings(F.col("path")).cast("binary"), 256)
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = found.select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("top")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        proof.alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(count: int) -> str:
    """Statements of all levels of the trees ``base`` (tree, rank, n, h) for up to 2 ** count rows."""
    steps = ["lv0 AS MATERIALIZED (SELECT tree, rank, n, h FROM base)"]
    for k in range(1, count + 1):
        steps.append(
            f"lv{k} AS MATERIALIZED (SELECT tree, rank // 2 AS rank, any_value((n + 1) // 2) AS n, "
            f"sha256(string_agg(h, '' ORDER BY rank)) AS h FROM lv{k - 1} WHERE n > 1 GROUP BY tree, rank // 2)"
        )
    return ",\n".join(steps)


def _statement(levels: int = 40, upper: int = 12) -> str:
    code = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda n: "sha256(" + " || ".join(code(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    nodes = " UNION ALL ".join(f"SELECT {k} AS level, tree, rank, n, h FROM lv{k}" for k in range(levels + 1))
    above = _levels(upper).replace("lv", "up").replace("base", "tops")
    upper_nodes = " UNION ALL ".join(f"SELECT {k} AS level, tree, rank, n, h FROM up{k}" for k in range(upper + 1))
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {row("n_chars")} AS leaf,
    list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [ascii(c)::UBIGINT, 1000::UBIGINT, 1000::UBIGINT, 1000::UBIGINT, 1000::UBIGINT, 1000::UBIGINT, 1000::UBIGINT, 1000::UBIGINT, 1000::UBIGINT]))),
      lambda c, e: CASE WHEN e < 1000 THEN xor(c, e) ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1)) END) AS crc,
    {row("n_chars + 1")} AS other, n_chars
  FROM documents),
marked AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, leaf,
    CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
base AS (SELECT tree, rank, n, leaf AS h FROM marked),
{_levels(levels)},
nodes AS MATERIALIZED ({nodes}),
subroots AS MATERIALIZED (SELECT tree, level, h FROM nodes WHERE n = 1),
tops AS MATERIALIZED (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n, h, tree AS lang, level AS height FROM subroots),
{above},
upper_nodes AS MATERIALIZED ({upper_nodes}),
top_root AS (SELECT h AS root, level AS rounds FROM upper_nodes WHERE n = 1),
climb AS (
  SELECT m.tree, m.rank AS at, m.doc_id, m.leaf, m.rank, 0 AS step, m.shown AS h, '' AS proof, t.h AS subroot, t.rank AS ordinal, t.height, r.root, r.rounds
  FROM marked m JOIN tops t ON t.lang = m.tree, top_root r
  UNION ALL
  SELECT c.tree, c.at, c.doc_id, c.leaf, (CASE WHEN c.step + 1 = c.height THEN c.ordinal * 2 ELSE c.rank END) // 2, c.step + 1,
    sha256(CASE WHEN c.rank % 2 = 1 THEN coalesce(x.h, u.h, '') || c.h ELSE c.h || coalesce(x.h, u.h, '') END),
    c.proof || coalesce(x.h, u.h, ''), c.subroot, c.ordinal, c.height, c.root, c.rounds
  FROM (SELECT * REPLACE (CASE WHEN step = 0 AND height = 0 THEN ordinal ELSE rank END AS rank) FROM climb) c
  LEFT JOIN nodes x ON c.step < c.height AND x.level = c.step AND x.tree = c.tree AND x.rank = xor(c.rank, 1)
  LEFT JOIN upper_nodes u ON c.step >= c.height AND u.level = c.step - c.height AND u.rank = xor(c.rank, 1)
  WHERE c.step < c.height + c.rounds)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM climb WHERE step = height + rounds
"""


SQL = _statement()
