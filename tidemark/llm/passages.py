"""Substring dedup: shared k-mer seeds, collinear chains through a Fenwick tree, aligned passages.

Seeds are the minimizers of a text: of each ``window`` neighbouring k-word windows the one of
least hash, so that two texts that share window + k - 1 words in a row share a seed.  A seed
that stands in several documents ties each of them to the first (least id): one match per
occurrence, however many documents share it.  The matches of a document with one other are
chained: a chain's matches rise in both, and a step costs ``gap_cost`` per word it skips in
either; the best predecessor is a prefix maximum in a Fenwick tree over the other document's
places.  Chains are aligned word by word from seed to seed and beyond, over substitutions,
insertions and deletions of a few words.  Where the whole of a chain is too unlike, each of its
longest pieces that are alike enough stands for itself.  A passage is reported when the aligned stretches of
its document that overlap or touch it cover ``min_words`` words.

At scale: a first pass counts in how many documents each seed stands, by packed hashes in hash
partitions, and gives every task a bitmap of fixed size; seeds of one document never leave the
tasks that read them.  The others are aggregated on the map side (three numbers per seed) and joined back, so a
seed that a third of all documents share is spread over tasks; anchors are grouped by pairs of
documents, which a text's length bounds; words of the chains alone are fetched for alignment.

Result rows: doc_id, other_id, word ranges in both, matched words, identity.  Defined cases:
null, empty and short texts have no seeds; rows with a null id are left out; rows that share
an id are one document; repeats inside one document are not reported; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.collocations import HASH_BITS, bitmap, hit, packed, partitions, summed, unpacked
from tidemark.llm.text import doc_rows, documents, mix, parted, slices, string_column, words_of
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class PassageParams:
    k: int = 5
    window: int = 6
    #: Seeds that a task counts before it hands them on, and words of text per hash partition, about.
    flush: int = 4_000_000
    part_words: int = 1 << 22
    #: Size of the bitmap of seeds that stand in several documents, as a power of two.
    filter_bits: int = 27
    gap_cost: float = 0.05
    max_gap: int = 40
    min_words: int = 50
    min_identity: float = 0.8
    #: Words by which an edit may shift, and matching words that end an edit.
    shift: int = 8
    resume: int = 3
    margin: int = 24


DEFAULT = PassageParams()

_TAPS = np.cumprod(np.full(32, np.uint64(0x9FB21C651E98DF25)), dtype=np.uint64)


def seeds(words: np.ndarray, p: PassageParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the minimizers of one text; runs of one hash are thinned."""
    n = len(words) - p.k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(n, np.uint64)
    for j in range(p.k):
        sums += words[j : j + n] * _TAPS[j]
    h = mix(sums)
    if n <= p.window:
        at = np.array([int(h.argmin())])
    else:
        # a place is the least of a window of its own where the greatest least around it is its hash
        views = n - p.window + 1
        least = h[:views]
        for j in range(1, p.window):
            least = np.minimum(least, h[j : j + views])
        around = np.zeros(n, np.uint64)
        for j in range(p.window):
            np.maximum(around[j : j + views], least, out=around[j : j + views])
        at = np.flatnonzero(around == h)
        if ((h[at[1:]] == h[at[:-1]]) & (np.diff(at) < p.window)).any():  # of equal ones in a window the first
            at = np.unique(np.lib.stride_tricks.sliding_window_view(h, p.window).argmin(1) + np.arange(views))
    found = h[at]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (np.diff(at) > p.window)])
    if new.all():
        return found, at
    first = at[np.flatnonzero(new)][np.cumsum(new) - 1]
    keep = (at - first) % p.window == 0
    return found[keep], at[keep]


def _seed_counts(n_parts: int, p: PassageParams):
    """(part, entries): in how many of its documents a task has met the hash of a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in parted(batches):
            for _, encoded in slices(string_column(batch, "text")):
                words, count, _ = words_of(encoded)
                for e, n in zip(np.cumsum(count).tolist(), count.tolist(), strict=True):
                    own = np.unique(seeds(words[e - n : e], p)[0] >> np.uint64(64 - HASH_BITS))
                    held.append(own)
                    size += len(own)
                if size > p.flush:
                    yield counted(held, n_parts)
                    held, size = [], 0
        if size:
            yield counted(held, n_parts)

    return run


def counted(held: list[np.ndarray], n_parts: int) -> pa.RecordBatch:
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    # whether a seed stands in one document or in more is all that is asked
    counts = np.minimum(counts, 2).astype(np.uint64)
    part = partitions(keys, n_parts)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    blobs = [packed(keys[a:b], counts[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(blobs, pa.binary())], names=["part", "entries"])


def _in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that two documents or more hold; a partition's entries are summed as they come."""
    now, keys, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in parted(batches, 200):
        for part, entries in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            if part != now:
                if (counts > 1).any():
                    yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 1].astype(np.int64))], names=["hash"])
                now, keys, counts = part, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            more, times = unpacked(entries)
            keys, counts = summed(np.concatenate([keys, more]), np.concatenate([counts, times]))
    if (counts > 1).any():
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 1].astype(np.int64))], names=["hash"])


def shared_seeds(docs: DataFrame, p: PassageParams = DEFAULT) -> bytes:
    """Bitmap of the seeds that stand in several documents, of one size whatever the input; false hits change nothing."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * p.part_words)))
    made = docs.select("text").mapInArrow(_seed_counts(n_parts, p), "part long, entries binary")
    found = made.repartition("part").sortWithinPartitions("part").mapInArrow(_in_several, "hash long")
    return bitmap(found, p)


def _seed_rows(shared, p: PassageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = np.frombuffer(shared.value, np.uint8)
        for batch in parted(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for first, encoded in slices(string_column(batch, "text")):
                words, count, _ = words_of(encoded)
                hashes, places, owners = [], [], []
                for i, (e, n) in enumerate(zip(np.cumsum(count).tolist(), count.tolist(), strict=True)):
                    h, at = seeds(words[e - n : e], p)
                    some = hit(several, h, p.filter_bits)
                    h, at = h[some], at[some]
                    if not len(h):
                        continue
                    # The first occurrence in the document keeps its place, later ones are marked.
                    _, where = np.unique(h, return_index=True)
                    later = np.ones(len(h), bool)
                    later[where] = False
                    hashes.append(h), places.append(np.where(later, -1 - at, at)), owners.append(np.full(len(h), ids[first + i]))
                if hashes:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(owners).astype(np.int64)),
                         pa.array(np.concatenate(places).astype(np.int32))],
                        names=["seed", "doc_id", "place"],
                    )

    return run


def anchors(docs: DataFrame, p: PassageParams = DEFAULT) -> DataFrame:
    """doc_id, other_id, x, y: places of shared seeds in a document and in the first that has them."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_seeds(docs, p))
    # read twice below: written once, as seeds cost more than their rows
    rows = cut_lineage(docs.mapInArrow(_seed_rows(shared, p), "seed long, doc_id long, place int"))
    first = rows.groupBy("seed").agg(
        F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last_id"),
        F.min_by("place", F.when(F.col("place") >= 0, F.col("doc_id"))).alias("y"),
    ).where(F.col("other_id") != F.col("last_id")).drop("last_id")
    x = F.when(F.col("place") >= 0, F.col("place")).otherwise(-1 - F.col("place"))
    return rows.join(first, "seed").where(F.col("doc_id") != F.col("other_id")).select("doc_id", "other_id", x.alias("x"), "y")


def chains(x: list[int], y: list[int], p: PassageParams) -> list[list[int]]:
    """Chains of anchors, each a list of indices; the anchors come in order of (x, y).

    f(j) = k + max(0, max over i before j in both of f(i) - cost * (x_j - x_i + y_j - y_i)): with
    g(i) = f(i) + cost * (x_i + y_i) the maximum is that of a prefix of y, which the tree holds.
    """
    n = len(x)
    ranks = {v: r + 1 for r, v in enumerate(sorted(set(y)))}
    size = len(ranks)
    top, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    j = 0
    while j < n:
        stop = j
        while stop < n and x[stop] == x[j]:  # equal places do not chain with one another
            at, best, link = ranks[y[stop]] - 1, -1e18, -1
            while at > 0:
                if top[at] > best:
                    best, link = top[at], who[at]
                at &= at - 1
            gain = best - p.gap_cost * (x[stop] + y[stop])
            score[stop], before[stop] = (p.k + gain, link) if gain > 0 else (float(p.k), -1)
            stop += 1
        for i in range(j, stop):
            value, at = score[i] + p.gap_cost * (x[i] + y[i]), ranks[y[i]]
            while at <= size:
                if value > top[at]:
                    top[at], who[at] = value, i
                at += at & -at
        j = stop
    taken, out = [False] * n, []
    for end in sorted(range(n), key=lambda i: -score[i]):
        chain, i = [], end
        while i >= 0 and not taken[i]:
            taken[i] = True
            if chain and max(x[chain[-1]] - x[i], y[chain[-1]] - y[i]) > p.max_gap + p.k:
                out.append(chain[::-1])
                chain = []
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


_CHAIN = "doc_id long, other_id long, x0 int, x1 int, y0 int, y1 int, links binary"


def _chain_rows(p: PassageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: tuple | None = None
        out: list[tuple] = []

        def close() -> None:
            table = np.concatenate(held, 1)
            x, y = table[2].tolist(), table[3].tolist()
            for c in chains(x, y, p):
                links = np.array([[x[i] for i in c], [y[i] for i in c]], np.int32)
                out.append((*last, *(int(v) for v in (links[0, 0], links[0, -1] + p.k, links[1, 0], links[1, -1] + p.k)), links.tobytes()))

        for batch in parted(batches):
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not table.shape[1]:
                continue
            cut = np.flatnonzero((table[0, 1:] != table[0, :-1]) | (table[1, 1:] != table[1, :-1])) + 1
            for part in np.split(table, cut, 1):
                key = (int(part[0, 0]), int(part[1, 0]))
                if last is not None and key != last:
                    close()
                    held = []
                held, last = [*held, part], key
            if len(out) > 20_000:
                yield _rows(out, _CHAIN)
                out = []
        if held:
            close()
        if out:
            yield _rows(out, _CHAIN)

    return run


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*[c.split() for c in ddl.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names]
    )


_SLICE = "key long, doc_id long, other_id long, x0 int, y0 int, side int, begin int, words binary, links binary"


def _word_slices(p: PassageParams):
    """The words that a request asks for; requests of one text stand together and share its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, last = None, np.zeros(0, np.uint32)
        for batch in parted(batches, 2000):
            # one copy of texts that stand together
            runs = pc.run_end_encode(batch.column(batch.schema.get_field_index("text")))
            values, known = runs.values.to_pylist(), []
            fresh = values[1:] if values[0] == text else values
            if len(fresh) < len(values):
                known.append(last)
            for _, encoded in slices(fresh):
                words, count, _ = words_of(encoded)
                short = (words >> np.uint64(32)).astype(np.uint32)
                known += [short[e - n : e] for e, n in zip(np.cumsum(count).tolist(), count.tolist(), strict=True)]
            text, last = values[-1], known[-1].copy()
            ends = runs.run_ends.to_numpy()
            which = np.searchsorted(ends, np.arange(batch.num_rows), side="right").tolist()
            low, high = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("low", "high"))
            begin = np.maximum(0, low - p.margin).astype(np.int32)
            parts = [known[w][s:e].tobytes() for w, s, e in zip(which, begin.tolist(), (high + p.margin).tolist(), strict=True)]
            made = {"begin": pa.array(begin, pa.int32()), "words": pa.array(parts, pa.binary())}
            names = [c.split()[0] for c in _SLICE.split(", ")]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    return run


def _follow(a: np.ndarray, b: np.ndarray, a3: np.ndarray, b3: np.ndarray, i: int, j: int, p: PassageParams) -> list[tuple[int, int, int]]:
    """Equal runs (place in ``a``, place in ``b``, words) of the alignment that goes on from (i, j)."""
    runs = []
    while True:
        n = min(len(a) - i, len(b) - j)
        differs = np.flatnonzero(a[i : i + n] != b[j : j + n])
        run = int(differs[0]) if len(differs) else n
        if run:
            runs.append((i, j, run))
            i, j = i + run, j + run
        s, t = a3[i : i + p.shift + 1], b3[j : j + p.shift + 1]
        if not len(s) or not len(t):
            return runs
        di, dj = np.nonzero(s[:, None] == t[None])
        if not len(di):
            return runs
        best = int(np.lexsort((di + dj, np.maximum(di, dj)))[0])
        i, j = i + int(di[best]), j + int(dj[best])


def _grams(a: np.ndarray, n: int) -> np.ndarray:
    m = max(len(a) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += a[k : k + m].astype(np.uint64) * _TAPS[k + 1]
    return out


def _back(a: np.ndarray, b: np.ndarray, p: PassageParams) -> list[tuple[int, int, int]]:
    """Equal runs of the alignment that goes back from the ends of both, in order."""
    back_a, back_b = a[::-1], b[::-1]
    runs = _follow(back_a, back_b, _grams(back_a, p.resume), _grams(back_b, p.resume), 0, 0, p)
    return [(len(a) - i - n, len(b) - j - n, n) for i, j, n in runs[::-1]]


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, p: PassageParams) -> list[tuple[int, int, int, int, int]]:
    """(start, end) in ``a`` and in ``b`` and the matched words of the chain's passages, stretched as far as they go.

    One passage, or else all pieces of ``min_identity`` that no longer one holds; an equal run is such a piece.
    """
    a3, b3 = _grams(a, p.resume), _grams(b, p.resume)
    i, j = int(xs[0]), int(ys[0])
    runs = _back(a[:i], b[:j], p) + _follow(a, b, a3, b3, i, j, p)
    if not runs:  # two seeds of one hash
        return []
    for x, y in zip(xs[1:].tolist(), ys[1:].tolist(), strict=True):
        i, j = runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]
        if x >= i and y >= j:
            runs += [(i + u, j + v, n) for u, v, n in _back(a[i:x], b[j:y], p)] + _follow(a, b, a3, b3, x, y, p)
    at_a, at_b, size = np.array(runs, np.int64).T
    end_a, end_b, total = at_a + size, at_b + size, np.cumsum(size)
    out, far = [], -1
    for u in range(len(runs)):
        matched = total[u:] - total[u] + size[u]
        span = np.maximum(end_a[u:] - at_a[u], end_b[u:] - at_b[u])
        v = u + int(np.flatnonzero(matched / span >= p.min_identity)[-1])
        if v > far:
            out.append((int(at_a[u]), int(end_a[v]), int(at_b[u]), int(end_b[v]), int(matched[v - u])))
            far = v
        if far == len(runs) - 1:
            break
    return out


_PASSAGE = "doc_id long, other_id long, start_word int, end_word int, other_start int, other_end int, matched int, identity double"


def _align_rows(p: PassageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        last = None
        out: list[tuple] = []

        def close() -> None:
            if len(held) < 2:
                return
            (a0, a, links), (b0, b, _) = held[0], held[1]
            xs, ys = np.frombuffer(links, np.int32).reshape(2, -1)
            for s, e, t, f, matched in align(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), xs - a0, ys - b0, p):
                out.append((last[0], last[1], a0 + s, a0 + e, b0 + t, b0 + f, matched, matched / max(e - s, f - t)))

        for batch in parted(batches):
            of = lambda *names: zip(*(string_column(batch, c) for c in names), strict=True)
            for key, (side, *row) in zip(of("doc_id", "other_id", "x0", "y0"), of("side", "begin", "words", "links"), strict=True):
                if key != last:
                    close()
                    held, last = {}, key
                held.setdefault(side, row)
            if len(out) > 20_000:
                yield _rows(out, _PASSAGE)
                out = []
        close()
        if out:
            yield _rows(out, _PASSAGE)

    return run


def _covering(p: PassageParams):
    """Passages whose stretch of overlapping or touching passages of the document is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        low = high = 0
        for batch in parted(batches):
            out = []
            for r in batch.to_pylist():
                row = tuple(r.values())
                if held and (held[-1][0] != row[0] or row[2] > high + 1):
                    out += held if high - low >= p.min_words else []
                    held = []
                if not held:
                    low, high = row[2], row[3]
                held.append(row)
                high = max(high, row[3])
            if out:
                yield _rows(out, _PASSAGE)
        if held and high - low >= p.min_words:
            yield _rows(held, _PASSAGE)

    return run


def shared_passages(docs: DataFrame, p: PassageParams = DEFAULT) -> DataFrame:
    """One row per passage of a document that stands, perhaps with edits, in an earlier one."""
    source = doc_rows(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = anchors(source, p).repartition("doc_id", "other_id").sortWithinPartitions("doc_id", "other_id", "x", "y")
    chained = cut_lineage(found.mapInArrow(_chain_rows(p), _CHAIN))
    key = F.xxhash64("doc_id", "other_id", "x0", "y0").alias("key")
    ask = ["key", "doc_id", "other_id", "x0", "y0", "side", "low", "high", "links"]
    own = chained.select(key, "*", F.lit(0).alias("side"), F.col("x0").alias("low"), F.col("x1").alias("high"))
    other = chained.select(key, "*", F.lit(1).alias("side"), F.col("y0").alias("low"), F.col("y1").alias("high"))
    asked = own.select(F.col("doc_id").alias("at"), *ask).union(
        other.select(F.col("other_id").alias("at"), *[F.lit(None).cast("binary").alias("links") if c == "links" else c for c in ask])
    )
    texts = source.select(F.col("doc_id").alias("at"), "text")
    words = asked.join(texts, "at").select(*ask, "text").mapInArrow(_word_slices(p), _SLICE)
    paired = words.repartition("key").sortWithinPartitions("key", "doc_id", "other_id", "x0", "y0", "side")
    aligned = paired.mapInArrow(_align_rows(p), _PASSAGE)
    sorted_rows = aligned.repartition("doc_id").sortWithinPartitions("doc_id", "start_word", "end_word", "other_id", "other_start")
    return sorted_rows.mapInArrow(_covering(p), _PASSAGE)


# --- the query -------------------------------------------------------------------------------


def substring_dedup(spark, sf_dir: str) -> DataFrame:
    return shared_passages(documents(spark, sf_dir))
