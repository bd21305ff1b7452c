"""Phrase collocations: frequent phrases by Misra-Gries summaries, then exact counts and scores.

A text is lower-cased (A to Z), split at punctuation and line ends into pieces, and pieces at blanks into
words.  Everything is per language.

* First pass, once for words and pairs and once for longer phrases: every task counts the hashes of its
  phrases in bounded steps.  These counts are summaries without error; they are dealt by hash
  partition and merged.  A merged summary of more entries than its capacity takes the count of
  the first entry too many off all entries and drops what is left without.  The capacity exceeds
  the partition's mass divided by ``min_count``, so that the error stays below ``min_count`` and
  every frequent phrase survives.  The masses of a partition come first in its shuffle order, so
  that its capacity is known before its summaries are merged.  The number of partitions grows
  with the bytes of text, so that a summary's size stays the same.
* Phrases of three words or more are only summarised where each pair of words in them survived; no
  frequent phrase holds a rare pair.  The survivors' hashes reach the tasks as a bitmap of fixed
  size (``filter_bits``): a false hit costs a little work and changes nothing.
* Second pass: phrases whose hashes survived are counted by their words, exactly, and those below
  ``min_count`` go.  Both parts of every cut of a frequent phrase are frequent, so that their
  counts are in the same table.
* Scores are decimals of 38 digits; ranks come from one range shuffle, as one language may hold most phrases.

Within a task of the second pass equal phrases are found by 64-bit hashes, between tasks by their words.

Defined cases: null and empty texts and pieces without words have no phrases; a null language is
``und``; repeated rows count each; ties stand as the ranking says; a long text is worked on in
slices that end at piece ends; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.merkle import ranked
from tidemark.llm.text import SLICE_BYTES, documents, mix, parted, string_column
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class PhraseParams:
    max_words: int = 5
    min_count: int = 100
    #: A phrase goes if a longer one that holds it has this percentage of its count.
    contained_percent: int = 100
    first: int = 2000
    #: Phrases that a task counts before it hands its summary on.
    flush: int = 4_000_000
    #: A summary's capacity in masses divided by ``min_count``: its error stays below ``min_count / slack``.
    slack: int = 4
    #: Entries of a summary, about, for which partitions are made.
    capacity: int = 1 << 20
    #: Size of the bitmaps that say which hashes survived, as a power of two.
    filter_bits: int = 27
    #: Different phrases that a task of the second pass holds before it hands them on.
    held: int = 200_000


DEFAULT = PhraseParams()

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_TAPS = np.cumprod(np.full(16, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
HASH_BITS = 48


@dataclass
class Words:
    """The words of a slice: hashes, piece numbers, owners (index of the text), and places in ``buf``."""

    hashes: np.ndarray
    piece: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    buf: np.ndarray

    def phrase(self, at: int, n: int) -> str:
        return " ".join(self.buf[b:e].tobytes().decode() for b, e in zip(self.begin[at : at + n], self.end[at : at + n], strict=True))


def words(encoded: list[bytes]) -> Words:
    buf = _LOWER[np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)]
    kind = _CLASS[buf]
    edge = np.diff((kind == _WORD).astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.flatnonzero(kind == _BREAK)
    ends = np.cumsum([len(b) + 1 for b in encoded])
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, begin, end, buf)
    at = np.flatnonzero(kind == _WORD)
    length = end - begin
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()) - 1, _STEP)]), dtype=np.uint64)
    part = (buf[at].astype(np.uint64) + np.uint64(1)) * powers[at - np.repeat(begin, length)]
    sums = np.add.reduceat(part, np.concatenate([[0], np.cumsum(length)[:-1]]))
    return Words(mix(sums + length.astype(np.uint64)), np.searchsorted(breaks, begin), np.searchsorted(ends, begin, "right"), begin, end, buf)


def language_salt(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def phrase_hashes(w: Words, starts: np.ndarray, n: int, salts: np.ndarray) -> np.ndarray:
    """Hashes of the phrases of ``n`` words at ``starts``; a language's phrases have hashes of their own."""
    sums = salts[w.owner[starts]] + np.uint64(n)
    for k in range(n):
        sums = sums + w.hashes[starts + k] * _TAPS[k]
    return mix(sums)


def _whole(w: Words, n: int) -> np.ndarray:
    """Starts of all phrases of ``n`` words that stay in a piece."""
    if len(w.hashes) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.piece[n - 1 :] == w.piece[: len(w.piece) - n + 1])


def hit(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = (hashes >> np.uint64(64 - HASH_BITS)) & np.uint64((1 << bits) - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def living(w: Words, salts: np.ndarray, sizes: range, bitmaps: dict[int, np.ndarray], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, hashes) of the phrases of each size whose parts, and themselves where a bitmap tells, survived."""
    alive: np.ndarray | None = None
    for n in range(1, sizes.stop):
        starts = _whole(w, n)
        if alive is not None:
            inside = alive[starts] & alive[starts + 1]
            starts = starts[inside]
        hashes = phrase_hashes(w, starts, n, salts) if n in sizes or n in bitmaps else None
        if n in bitmaps:
            there = hit(bitmaps[n], hashes, bits)
            starts, hashes = starts[there], hashes[there]
        if n in sizes:
            yield n, starts, hashes
        if bitmaps:
            alive = np.zeros(len(w.hashes) + 1, bool)
            alive[starts] = True


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of a text that end at piece ends, of about ``limit`` bytes."""
    first = 0
    while len(text) - first > limit:
        at = first + limit
        breaks = np.flatnonzero(_CLASS[np.frombuffer(text, np.uint8, min(limit, len(text) - at), at)] == _BREAK)
        while not len(breaks) and at + limit < len(text):
            at += limit
            breaks = np.flatnonzero(_CLASS[np.frombuffer(text, np.uint8, min(limit, len(text) - at), at)] == _BREAK)
        if not len(breaks):
            break
        yield text[first : at + int(breaks[0]) + 1]
        first = at + int(breaks[0]) + 1
    yield text[first:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Words of about a megabyte of text at a time, with the salt and the language of each of its texts."""
    held: list[bytes] = []
    langs: list[str] = []
    size = 0

    def made():
        return words(held), np.array([salt.setdefault(x, language_salt(x)) for x in langs], np.uint64), langs

    salt: dict[str, int] = {}
    for batch in parted(batches):
        for text, lang in zip(string_column(batch, "text"), string_column(batch, "lang"), strict=True):
            for part in _cut((text or "").encode(), SLICE_BYTES):
                if held and size + len(part) > SLICE_BYTES:
                    yield made()
                    held, langs, size = [], [], 0
                held.append(part)
                langs.append(lang)
                size += len(part)
    if held:
        yield made()


# --- summaries -------------------------------------------------------------------------------


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences and counts, byte plane by byte plane, empty planes left out."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    many = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    planes = [int(x.any(1).cumsum().argmax()) + 1 for x in (step, many)]  # up to the last that is not empty
    head = np.array([len(keys), *planes], "<u8").tobytes()
    return head + step[: planes[0]].tobytes() + many[: planes[1]].tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, a, b = np.frombuffer(blob, "<u8", 3).tolist()
    planes = np.zeros((16, n), np.uint8)
    body = np.frombuffer(blob, np.uint8, n * (a + b), 24).reshape(a + b, n)
    planes[:a], planes[8 : 8 + b] = body[:a], body[a:]
    step, many = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in (planes[:8], planes[8:]))
    return np.cumsum(step, dtype=np.uint64), many


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """A Misra-Gries summary that takes other summaries in.

    Counts are too low by ``error`` at most, and ``error`` stays below mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def take(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._size += len(keys)
        if self._size > self.capacity:
            self.settle()

    def settle(self) -> None:
        self._waiting.append((self.keys, self.counts))
        keys, counts = summed(*(np.concatenate(x) for x in zip(*self._waiting, strict=True)))
        self._waiting, self._size = [], 0
        if len(keys) > self.capacity:
            off = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            self.error += int(off)
            stay = counts > off
            keys, counts = keys[stay], counts[stay] - off
        self.keys, self.counts = keys, counts


_MASS, _ENTRIES = 0, 1


def partitions(keys: np.ndarray, n: int) -> np.ndarray:
    """Hash partition of ascending keys of HASH_BITS bits; ascending as well."""
    return ((keys >> np.uint64(HASH_BITS - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _summaries(sizes: range, n_parts: int, shared, p: PhraseParams):
    """(part, kind, mass, entries): the summaries of a task, and their masses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = unfold(shared, p)
        held: list[np.ndarray] = []
        size = 0
        for w, salts, _ in _slices(batches):
            for _, _, hashes in living(w, salts, sizes, bitmaps, p.filter_bits):
                held.append(hashes >> np.uint64(64 - HASH_BITS))
                size += len(hashes)
            if size > p.flush:
                yield _flushed(held, n_parts)
                held, size = [], 0
        if size:
            yield _flushed(held, n_parts)

    return run


def _flushed(held: list[np.ndarray], n_parts: int) -> pa.RecordBatch:
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    part = partitions(keys, n_parts)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    last = [*first[1:].tolist(), len(keys)]
    parts, masses = part[first], np.add.reduceat(counts, first)
    blobs = [packed(keys[a:b], counts[a:b].astype(np.uint64)) for a, b in zip(first.tolist(), last, strict=True)]
    n = len(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.tile(parts, 2)), pa.array([_MASS] * n + [_ENTRIES] * n, pa.int32()),
         pa.array(np.tile(masses, 2), pa.int64()), pa.array([None] * n + blobs, pa.binary())],
        names=["part", "kind", "mass", "entries"],
    )


def _merged(p: PhraseParams):
    """Hashes of the survivors of each partition; its masses come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None

        def survivors() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                summary.settle()
                stay = summary.keys[summary.counts + np.uint64(summary.error) >= p.min_count]
                yield pa.RecordBatch.from_arrays([pa.array(stay.astype(np.int64))], names=["hash"])

        for batch in parted(batches, 200):
            for part, kind, m, entries in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "mass", "entries")), strict=True):
                if part != now:
                    yield from survivors()
                    now, mass, summary = part, 0, None
                if kind == _MASS:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(p.slack * mass // p.min_count + 1)
                summary.take(*unpacked(entries))
        yield from survivors()

    return run


def candidates(texts: DataFrame, sizes: range, n_parts: int, shared, p: PhraseParams = DEFAULT) -> DataFrame:
    """Hashes of all phrases of ``sizes`` words with ``min_count`` occurrences or more, and of some others."""
    made = texts.mapInArrow(_summaries(sizes, n_parts, shared, p), "part long, kind int, mass long, entries binary")
    dealt = made.repartition("part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(_merged(p), "hash long")


def bitmap(hashes: DataFrame, p=DEFAULT) -> bytes:
    """Which places of a table of ``2 ** filter_bits`` bits the hashes take: as many bytes at any size of the input."""
    place = F.col("hash").bitwiseAND((1 << p.filter_bits) - 1) + 1  # the built-in numbers places from 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = bytearray(1 << (p.filter_bits - 3))
    for row in rows.toLocalIterator():
        first = (row.bucket - 1) * 4096
        out[first : first + 4096] = bytes(row.bits)[: len(out) - first]
    return bytes(out)


def unfold(shared, p: PhraseParams) -> dict[int, np.ndarray]:
    """Bitmaps by number of words."""
    if shared is None:
        return {}
    low, high = shared.value
    first = np.frombuffer(low, np.uint8)
    rest = {} if high is None else {n: np.frombuffer(high, np.uint8) for n in range(3, p.max_words + 1)}
    return {1: first, 2: first} | rest


# --- exact counts ----------------------------------------------------------------------------


class Tally:
    """Counts of phrases by hash; the words of a phrase are read off where it is first met."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.phrases: list[tuple[str, str, int]] = []
        self.words: dict[str, int] = {}

    def take(self, w: Words, langs: list[str], n: int, starts: np.ndarray, hashes: np.ndarray) -> None:
        keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        self.counts[at[known]] += counts[known]
        fresh = starts[first[~known]]
        place = np.arange(len(self.phrases), len(self.phrases) + len(fresh))
        self.phrases += [(langs[o], w.phrase(i, n), n) for i, o in zip(fresh.tolist(), w.owner[fresh].tolist(), strict=True)]
        self.keys = np.insert(self.keys, at[~known], keys[~known])
        self.counts = np.insert(self.counts, at[~known], counts[~known])
        self.place = np.insert(self.place, at[~known], place)

    def batch(self, n_parts: int) -> pa.RecordBatch:
        """One row per hash partition that the phrases fall in, with lists of them; the words of languages go to the first."""
        part = partitions(self.keys >> np.uint64(64 - HASH_BITS), n_parts)
        first = np.searchsorted(part, np.unique(part))
        rows = [[(*self.phrases[i], c) for i, c in zip(self.place[u:v].tolist(), self.counts[u:v].tolist(), strict=True)]
                for u, v in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)]
        parts = part[first].tolist()
        rows.append([(lang, "", 0, count) for lang, count in self.words.items()])
        parts.append(0)
        lists = [[[r[k] for r in row] for row in rows] for k in range(4)]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int64()), *[pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds, strict=True)]], names=["part", *_COUNTS]
        )


_COUNTS = ("lang", "phrase", "n_words", "count")


def _counted(n_parts: int, shared, p: PhraseParams):
    """Lists of (lang, phrase, n_words, count) of what survived, by hash partition; n_words 0 stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = unfold(shared, p)
        tally = Tally()
        for w, salts, langs in _slices(batches):
            for lang, count in zip(langs, np.bincount(w.owner, minlength=len(langs)).tolist(), strict=True):
                if count:
                    tally.words[lang] = tally.words.get(lang, 0) + count
            for n, starts, hashes in living(w, salts, range(1, p.max_words + 1), bitmaps, p.filter_bits):
                tally.take(w, langs, n, starts, hashes)
            if len(tally.keys) > p.held:
                yield tally.batch(n_parts)
                tally = Tally()
        if tally.words:
            yield tally.batch(n_parts)

    return run


def _added(p: PhraseParams):
    """lang, phrase, n_words, f of the frequent phrases of each hash partition, added up by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def frequent() -> Iterator[pa.RecordBatch]:
            rows = [(*k, f) for k, f in held.items() if k[2] == 0 or f >= p.min_count]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n_words", "f"])

        for batch in parted(batches, 200):
            for part, *lists in zip(*(batch.column(c).to_pylist() for c in ("part", *_COUNTS)), strict=True):
                if part != now:
                    yield from frequent()
                    now, held = part, {}
                for lang, phrase, n, count in zip(*lists, strict=True):
                    key = (lang, phrase, n)
                    held[key] = held.get(key, 0) + count
        yield from frequent()

    return run


def frequent_phrases(docs: DataFrame, p: PhraseParams = DEFAULT) -> DataFrame:
    """lang, phrase, n_words, f of all phrases with ``min_count`` occurrences; n_words 0 counts all words of a language."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word takes two bytes at least, so that this bounds the mass of two or three sizes of phrases.
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 2 * p.slack // (p.min_count * p.capacity)))
    short = cut_lineage(candidates(texts, range(1, 3), n_parts, None, p))
    low = bitmap(short, p)
    shared = spark.sparkContext.broadcast((low, None))
    long = cut_lineage(candidates(texts, range(3, p.max_words + 1), n_parts, shared, p))
    shared = spark.sparkContext.broadcast((low, bitmap(long, p)))
    lists = "part long, lang array<string>, phrase array<string>, n_words array<int>, count array<long>"
    counts = texts.mapInArrow(_counted(n_parts, shared, p), lists)
    dealt = counts.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(_added(p), "lang string, phrase string, n_words int, f long")


# --- scores ----------------------------------------------------------------------------------


def collocations(docs: DataFrame, p: PhraseParams = DEFAULT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of every language."""
    known = cut_lineage(frequent_phrases(docs, p))
    total = known.where("n_words = 0").select("lang", F.col("f").alias("n"))
    parts = known.where("n_words > 0").select("lang", "phrase", "f")
    found = known.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"))

    word = F.split("phrase", " ")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("front"),
                     F.array_join(F.slice(word, F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("back"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("front"), F.col("f").alias("l")), ["lang", "front"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("back"), F.col("f").alias("r")), ["lang", "back"]).join(total, "lang")
    big = lambda c: f"cast({c} as decimal(18, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = found.where("n_words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice(word, F.col("at"), F.col("size")), " ").alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(around, ["lang", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (100 * F.col("longer") < p.contained_percent * F.col("a")))
    rows = left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("n").alias("words"),
                       F.col("best.score").alias("score"), (-F.col("best.score")).alias("s"), (-F.col("a")).alias("o"))
    placed = ranked(rows, "lang", "s", "o", "phrase").where(F.col("rank") < p.first)
    return placed.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


# --- the query -------------------------------------------------------------------------------


def phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def _statement(p: PhraseParams = DEFAULT) -> str:
    phrases = " UNION ALL ".join(
        f"SELECT lang, {k} AS n_words, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS phrase FROM "
        f"(SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)"
        for k in range(1, p.max_words + 1)
    )
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
f AS MATERIALIZED (SELECT lang, phrase, any_value(n_words) AS n_words, count(*) AS f FROM ({phrases}) GROUP BY lang, phrase HAVING count(*) >= {p.min_count}),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
found AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, n_words, f AS a FROM f WHERE n_words > 1),
cuts AS (SELECT lang, phrase, a, w, k, n_words FROM (SELECT *, unnest(range(1, n_words)) AS k FROM found)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, c.k + 1, c.n_words), ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
left_over AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.lang = b.lang AND o.n_words > len(string_split(b.phrase, ' '))
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.a >= {p.contained_percent} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over QUALIFY rank <= {p.first}
"""


SQL = _statement()
