"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles.  In every run each set samples those of its
tokens whose hash is below branch / (threshold x size); sets that sample the same token share
a bucket.  Two sets of Jaccard similarity s >= threshold share branch * s / threshold sampled
tokens of a run on average.  A bucket of more than ``small`` sets is split again: every set goes to
the ``children`` least of its sampled tokens (of all runs), in an order that the bucket draws;
small buckets are compared by brute force.  The number of runs follows from the target recall of
the first level.

* Copies: documents with the same set are one node with a number of documents and of texts, made
  by a map-side aggregation before anything else, so that a group of exact copies is one row.
* A bucket is not split on tokens that are common in it, such as those of the passage that all its
  sets share: they would lead the same sets to another bucket.  Every part has about half of the
  sets at most.  Keys that no other set holds meet nothing and are not split on either.
* Near copies: a set most of whose tokens are common in its bucket is dense there.  Each dense set
  gets one home, the largest of its buckets, and homes that meet in a bucket are compared block by
  block, every pair once.  A task holds two blocks of bounded size; it adds up the links of each
  set and ties sets that belong together, so that rows grow with the sets, not with the pairs.
* Two sets of similarity 0.8 that are not dense have at least half of their other tokens in common.
* Buckets of the same sets are compared once and split ``copies`` times.
* Small buckets first compare 64-byte sketches; only sets with a likely partner are fetched.
* Every link is checked on the full sets.  No bucket, partner or candidate is capped.

The result has one row per document: its class (least id of the connected documents) and its
number of links: other documents, and other texts, of similarity ``threshold`` or more.

Defined cases: null, empty and blank texts have no shingles, no links and a class of their own;
texts of one to four words are one shingle; words are compared as they stand; repeated rows
count as documents; a null doc_id gets a null class and no links and is no partner; rows that
share an id but not the text are documents of their own, with classes of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.text import doc_rows, documents, grams, mix, parted, slices, string_column, words_of
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    threshold: float = 0.8
    branch: float = 2.0
    target_recall: float = 0.9999
    min_runs: int = 8
    small: int = 64
    #: A key is common in a bucket that holds it in a greater share of its sets.
    common_share: float = 0.5
    #: Sets of a bucket, about, that its common keys are told from.
    probe_sets: int = 128
    #: A set is dense in a bucket where so great a share of its keys is common.
    dense: float = 0.6
    #: Parts of a large bucket that each of its sets goes to, and buckets of the same sets that are split.
    children: int = 2
    copies: int = 6
    block_sets: int = 512
    block_tokens: int = 400_000
    #: Sketch similarity below which a pair is not fetched: ``sketch_deviations`` under the threshold, this at most.
    sketch_floor: float = 0.5
    sketch_deviations: float = 5.0
    seed: int = 11

    @property
    def runs(self) -> int:
        return max(self.min_runs, math.ceil(-math.log(1 - self.target_recall) / self.branch))


DEFAULT = JoinParams()
BINS = 64


def shingle_sets(encoded: list[bytes], p: JoinParams) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    hashes, count, _ = words_of(encoded)
    flat, sizes = grams(hashes, count, p.words)
    ends = np.cumsum(sizes)
    return [np.unique(flat[e - n : e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(58)).astype(np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One byte per 64th of the hash space, from its least token; 0 where there is none."""
    at = np.searchsorted(tokens, _EDGES)
    full = np.append(at[1:], len(tokens)) > at
    out = np.zeros(BINS, np.uint8)
    out[full] = (mix(tokens[at[full]]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def sampled(tokens: np.ndarray, run: int, p: JoinParams) -> np.ndarray:
    """Bucket keys of the tokens that the set samples in a run."""
    draw = mix(tokens ^ mix(np.array([p.seed * 1000 + run], np.uint64)))
    bar = p.branch / (p.threshold * len(tokens))
    chosen = draw if bar >= 1 else draw[draw < np.uint64(int(bar * 2**64))]
    return mix(chosen + np.uint64(run)).view(np.int64)


def _signed(x: np.ndarray) -> int:
    return int(np.asarray(x, np.uint64).view(np.int64))


_SIGNATURE = (
    "doc_id long, text_hash long, s1 long, s2 long, n_set long, sketch binary, keys array<long>"
)


def _signatures(p: JoinParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            hashes = batch.column(batch.schema.get_field_index("text_hash"))
            for first, encoded in slices(string_column(batch, "text")):
                rows = []
                for tokens in shingle_sets(encoded, p):
                    rows.append((
                        _signed(tokens.sum(dtype=np.uint64)), _signed(mix(tokens ^ np.uint64(p.seed)).sum(dtype=np.uint64)),
                        len(tokens), sketch(tokens).tobytes(),
                        [key for k in range(p.runs) for key in sampled(tokens, k, p).tolist()] if len(tokens) else [],
                    ))
                s1, s2, n, sk, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(encoded)), hashes.slice(first, len(encoded)), pa.array(s1, pa.int64()),
                     pa.array(s2, pa.int64()), pa.array(n, pa.int64()), pa.array(sk, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "s1", "s2", "n_set", "sketch", "keys"],
                )

    return run


_SET = ["s1", "s2", "n_set"]


def _nodes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: node (a hash of the set), its least (doc_id, text_hash), documents and texts."""
    usable = signed.where((F.col("n_set") > 0) & F.col("doc_id").isNotNull())
    per_text = usable.groupBy(*_SET, "text_hash").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")
    )
    return per_text.groupBy(*_SET).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.sum("n_docs").alias("n_docs"),
        F.count(F.lit(1)).alias("n_texts"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"),
    ).select(F.xxhash64(*_SET).alias("node"), "least", *_SET, "n_docs", "n_texts", "sketch", "keys")


def _met_keys(big: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_keys, keys of the sets of large buckets: how many keys a set has, and those that another set holds too."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key")
    rows = rows.join(big.select("node").distinct(), "node", "left_semi").join(met, "key", "left_semi")
    held = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))
    return cut_lineage(nodes.select("node", F.size("keys").alias("n_keys")).join(held, "node"))


def _common(big: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """first, common: the keys that more than ``common_share`` of a bucket's sets hold, from about ``probe_sets`` of them."""
    some = big.where((F.col("path") == F.col("first")) & (F.pmod(F.xxhash64("node", "path"), F.ceil(F.col("n") / p.probe_sets)) == 0))
    held = some.join(nodes.select("node", "keys"), "node").groupBy("first").agg(
        F.sort_array(F.flatten(F.collect_list("keys"))).alias("each"), F.floor(F.count(F.lit(1)) * p.common_share).cast("int").alias("bar")
    )
    # A key stands more than ``bar`` times in the sorted keys where the one ``bar`` places on is the same.
    often = F.filter("each", lambda x, i: F.get("each", i + F.col("bar")) == x)
    return held.select("first", F.array_distinct(often).alias("common"))


def _buckets(nodes: DataFrame, p: JoinParams) -> tuple[DataFrame, DataFrame | None]:
    """Rows (path, node, n) of small buckets, and of the dense sets of large ones.

    A large bucket is split on keys that are not common in it: its parts have about half of its
    sets at most, so that the loop ends after the logarithm of the largest bucket.
    """
    rows = nodes.select("node", F.explode("keys").alias("path"))
    small, dense, met = [], [], None
    while True:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"))
        # Buckets of the same sets: one is compared, ``copies`` are split, each in its own order.  A set's keys bound their number.
        alike = Window.partitionBy("n", "who").orderBy("path")
        sizes = sizes.where(F.col("n") > 1).withColumn("copy", F.row_number().over(alike)).withColumn("first", F.first("path").over(alike))
        sizes = sizes.where((F.col("copy") == 1) | ((F.col("n") > p.small) & (F.col("copy") <= p.copies)))
        rows = cut_lineage(rows.join(sizes.select("path", "n", "first"), "path").select("path", "first", "node", "n"))
        small.append(rows.where(F.col("n") <= p.small).select("path", "node", "n"))
        big = rows.where(F.col("n") > p.small)
        if big.isEmpty():
            break
        if met is None:
            met = _met_keys(big, nodes)
        held = big.join(_common(big, met, p), "first").join(met, "node")
        own = F.array_except("keys", "common")
        alone = F.col("n_keys") - F.size("keys")
        parts = cut_lineage(held.select("path", "first", "node", "n", own.alias("own"), (F.size(own) + alone < (1 - p.dense) * F.col("n_keys")).alias("stays")))
        dense.append(parts.where(F.col("stays") & (F.col("path") == F.col("first"))).select("path", "node", "n"))
        ordered = F.array_sort(F.transform("own", lambda k: F.xxhash64("path", k)))
        # read twice: for the sizes and for the rows of the parts
        rows = cut_lineage(parts.select("node", F.explode(F.slice(ordered, 1, p.children)).alias("path")))
    whole = small[0]
    for s in small[1:]:
        whole = whole.union(s)
    if not dense:
        return whole, None
    rest = dense[0]
    for d in dense[1:]:
        rest = rest.union(d)
    return whole, cut_lineage(rest)


def _runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows in order of ``key``, one list for each of its values."""
    held: list[dict] = []
    for batch in parted(batches):
        for row in batch.to_pylist():
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _likely(p: JoinParams):
    """(path, node) of sets that have a likely partner in a small bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, nodes = [], []
        for rows in _runs_of(batches, "path"):
            marks = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), BINS)
            n = np.array([r["n_set"] for r in rows], float)
            same = ((marks[:, None] == marks[None]) & (marks[:, None] > 0)).sum(2)
            either = ((marks[:, None] > 0) | (marks[None] > 0)).sum(2)
            # Short sets fill few bytes, and the fewer there are the more their share varies.
            varies = p.sketch_deviations * np.sqrt(p.threshold * (1 - p.threshold) / np.maximum(either, 1))
            floor = np.minimum(p.sketch_floor, p.threshold - varies)
            fits = (np.minimum(n[:, None], n) >= p.threshold * np.maximum(n[:, None], n)) & (same >= floor * either)
            np.fill_diagonal(fits, False)
            for i in np.flatnonzero(fits.any(1)).tolist():
                paths.append(rows[i]["path"]), nodes.append(rows[i]["node"])
            if len(paths) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(nodes)], names=["path", "node"])
                paths, nodes = [], []
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(nodes)], names=["path", "node"])

    return run


def _homes(dense: DataFrame, nodes: DataFrame, p: JoinParams) -> tuple[DataFrame, DataFrame]:
    """Home of every set of dense buckets, and the pairs of homes that meet (h1 <= h2) with their numbers of blocks."""
    home = cut_lineage(
        dense.groupBy("node").agg(F.max(F.struct("n", "path"))["path"].alias("home")).join(nodes.select("node", "n_set"), "node")
    )
    load = home.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("n_set").alias("tokens")).select(
        "home", F.greatest(F.ceil(F.col("n") / p.block_sets), F.ceil(F.col("tokens") / p.block_tokens)).cast("int").alias("blocks")
    )
    at = dense.join(home, "node").select("path", "home").distinct()
    meets = at.alias("x").join(at.alias("y"), "path").where("x.home <= y.home").select(
        F.col("x.home").alias("h1"), F.col("y.home").alias("h2")
    ).distinct()
    meets = meets.join(load.select(F.col("home").alias("h1"), F.col("blocks").alias("b1")), "h1")
    meets = meets.join(load.select(F.col("home").alias("h2"), F.col("blocks").alias("b2")), "h2")
    return home, cut_lineage(meets)


def _block_requests(home: DataFrame, meets: DataFrame) -> DataFrame:
    """(key, side, node): the two blocks that each task compares; side 2 stands for both."""
    one = home.join(meets.withColumnRenamed("h1", "home"), "home")
    block = lambda b: F.pmod(F.xxhash64("node", F.lit(5)), F.col(b)).cast("int")
    left = one.withColumn("i", block("b1")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b2") - 1)))
    left = left.where((F.col("home") != F.col("h2")) | (F.col("i") <= F.col("j")))
    left = left.select(F.xxhash64("home", "i", "h2", "j").alias("key"), "node",
                       F.when((F.col("home") == F.col("h2")) & (F.col("i") == F.col("j")), 2).otherwise(0).alias("side"))
    two = home.join(meets.withColumnRenamed("h2", "home"), "home")
    right = two.withColumn("j", block("b2")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b1") - 1)))
    right = right.where((F.col("home") != F.col("h1")) | (F.col("i") < F.col("j")))
    right = right.select(F.xxhash64("h1", "i", "home", "j").alias("key"), "node", F.lit(1).alias("side"))
    return left.union(right).withColumn("dense", F.lit(True))


def _to_sets(p: JoinParams):
    """Texts of requests as sets; rows of one document stand together and are worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = None, b""
        for batch in parted(batches):
            texts = string_column(batch, "text")
            rest = batch.drop_columns(["text"])
            for a in range(0, len(texts), 500):
                found = []
                for t in texts[a : a + 500]:
                    if t != last:
                        last, made = t, shingle_sets([(t or "").encode()], p)[0].tobytes()
                    found.append(made)
                part = rest.slice(a, len(found))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, "tokens"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: incidence over tokens that stand in two sets or more, by columns."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    rank = np.cumsum(often) - 1
    keep = often[column]
    column, owner = rank[column[keep]], owner[keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[lo:hi], column[lo:hi] - a] = 1
        total += table @ table.T
    return total


def _similar(rows: list[dict], p: JoinParams) -> np.ndarray:
    """Which rows are linked."""
    sets = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
    n = np.array([len(s) for s in sets], np.float64)
    common = _overlaps(sets).astype(np.float64)
    linked = common >= p.threshold * (n[:, None] + n - common) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index of the component of every row."""
    root = np.arange(len(linked))
    while True:
        around = np.where(linked, root[None], len(root)).min(1, initial=len(root))
        low = np.minimum(root, around)
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


_FOUND = "kind int, a long, b long, a_docs long, a_texts long, b_docs long, b_texts long"
PAIR, TIE, SUM = 0, 1, 2


def _compare(p: JoinParams):
    """Links of each small bucket as pairs; of each pair of blocks as sums and ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _runs_of(batches, "key"):
            rows = [*{(r["node"], r["tokens"]): r for r in sorted(group, key=lambda r: r["node"])}.values()]
            if len(rows) < 2:
                continue
            linked = _similar(rows, p)
            if not rows[0]["dense"]:
                for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
                    a, b = rows[i], rows[j]
                    out.append((PAIR, a["node"], b["node"], a["n_docs"], a["n_texts"], b["n_docs"], b["n_texts"]))
            else:
                side = np.array([r["side"] for r in rows])
                linked &= (side[:, None] != side) | (side[:, None] == 2)
                weight = np.array([[r["n_docs"], r["n_texts"]] for r in rows], np.int64)
                sums, roots = linked @ weight, _roots(linked)
                for i in np.flatnonzero(linked.any(1)).tolist():
                    out.append((SUM, rows[i]["node"], None, 0, 0, *sums[i].tolist()))
                    out.append((TIE, rows[i]["node"], rows[roots[i]]["node"], 0, 0, 0, 0))
            if len(out) > 50_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 6]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _hashed(docs: DataFrame) -> DataFrame:
    return doc_rows(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def classes(docs: DataFrame, p: JoinParams = DEFAULT) -> DataFrame:
    """doc_id, text_hash, least (doc_id and text_hash that stand for the class), n_links, n_text_links of every row.

    ``least`` is null for rows that have a class of their own.
    """
    hashed = _hashed(docs)
    signed = cut_lineage(hashed.mapInArrow(_signatures(p), _SIGNATURE))
    nodes = cut_lineage(_nodes(signed))
    small, dense = _buckets(nodes, p)

    marked = small.join(nodes.select("node", "n_set", "sketch"), "node").select("path", "node", "n_set", "sketch")
    likely = marked.repartition("path").sortWithinPartitions("path").mapInArrow(_likely(p), "path long, node long")
    requests = likely.select(F.col("path").alias("key"), "node", F.lit(0).alias("side"), F.lit(False).alias("dense"))
    meets = home = None
    if dense is not None:
        home, meets = _homes(dense, nodes, p)
        requests = requests.union(_block_requests(home, meets).select("key", "node", "side", "dense"))
    wanted = requests.join(nodes.select("node", "least", "n_docs", "n_texts"), "node")
    fetched = hashed.join(
        wanted.select("key", "side", "dense", "node", "n_docs", "n_texts", F.col("least.doc_id").alias("at"), F.col("least.text_hash").alias("wanted")),
        (F.col("doc_id") == F.col("at")) & (F.col("text_hash") == F.col("wanted")),
    ).select("key", "side", "dense", "node", "n_docs", "n_texts", "text")
    made = fetched.mapInArrow(
        _to_sets(p), "key long, side int, dense boolean, node long, n_docs long, n_texts long, tokens binary"
    )
    found = cut_lineage(made.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(p), _FOUND))

    pairs = found.where(F.col("kind") == PAIR).drop("kind").distinct()
    if home is not None:
        # Pairs whose homes are compared block by block are counted there.
        at = home.select("node", "home")
        pairs = pairs.join(at.select(F.col("node").alias("a"), F.col("home").alias("ha")), "a", "left")
        pairs = pairs.join(at.select(F.col("node").alias("b"), F.col("home").alias("hb")), "b", "left")
        pairs = pairs.withColumn("h1", F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), F.least("ha", "hb")))
        pairs = pairs.withColumn("h2", F.when(F.col("h1").isNotNull(), F.greatest("ha", "hb")))
        pairs = pairs.join(meets.select("h1", "h2"), ["h1", "h2"], "left_anti")
    sums = found.where(F.col("kind") == SUM).select(F.col("a").alias("node"), F.col("b_docs").alias("docs"), F.col("b_texts").alias("texts"))
    sums = sums.union(pairs.select(F.col("a").alias("node"), F.col("b_docs").alias("docs"), F.col("b_texts").alias("texts")))
    sums = sums.union(pairs.select(F.col("b").alias("node"), F.col("a_docs").alias("docs"), F.col("a_texts").alias("texts")))
    sums = sums.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    roots = components(found.where(F.col("kind") != SUM).select("a", "b"))

    tied = nodes.select(*_SET, "node", "least", "n_docs", "n_texts").join(sums, "node", "left").join(roots, "node", "left")
    tied = tied.withColumn("root", F.coalesce("root", "node"))
    first = tied.groupBy("root").agg(F.min("least").alias("first"))
    of_set = tied.join(first, "root").select(
        *_SET, F.col("first").alias("least"),
        (F.col("n_docs") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        (F.col("n_texts") - 1 + F.coalesce("texts", F.lit(0))).alias("n_text_links"),
    )
    known = signed.select("doc_id", "text_hash", *[F.when(F.col("doc_id").isNotNull() & (F.col("n_set") > 0), F.col(c)).alias(c) for c in _SET])
    zero = F.lit(0).cast("long")
    return known.join(of_set, _SET, "left").select(
        "doc_id", "text_hash", "least", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links")
    )


def near_duplicates(docs: DataFrame, p: JoinParams = DEFAULT) -> DataFrame:
    """doc_id, class_id, n_links (other documents), n_text_links (other texts), for every row of ``docs``."""
    return classes(docs, p).select("doc_id", F.coalesce("least.doc_id", "doc_id").alias("class_id"), "n_links", "n_text_links")


def deduplicated(docs: DataFrame, p: JoinParams = DEFAULT) -> DataFrame:
    """``docs`` with one row of each class: that of the least (doc_id, hash of the text).

    Of rows with that id and text the one stays whose other columns, as text, come first.  Rows
    without id, and of texts without words, stay, the latter once for each id and text.
    """
    rows = classes(docs, p)
    stay = rows.select(
        F.coalesce("least.doc_id", "doc_id").alias("__id"), F.coalesce("least.text_hash", "text_hash").alias("__text")
    ).where(F.col("__id").isNotNull()).distinct()
    key, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(stay, (key == F.col("__id")) & (text == F.col("__text")), "left_semi")
    order = F.struct(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"], F.col("text").isNull())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.groupBy(key.alias("__id"), text.alias("__text")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return one.union(docs.where(F.col("doc_id").isNull()))


# --- the query -------------------------------------------------------------------------------


def ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
