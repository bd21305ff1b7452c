"""Document fingerprints by consistent weighted sampling.

Terms of a text are its words and its pairs of neighbouring words, weighted by how often they
stand in it.  Sample k of a weighted term (w) draws r and c from Gamma(2, 1) and b from U(0, 1),
all fixed by the term and k, and gives t = floor(ln w / r + b), y = exp(r (t - b)) and
a = c / (y exp(r)); the term with the least a is the sample, together with its t.  Two texts agree
in a sample with the probability of their generalised Jaccard similarity (sum of minima over sum of
maxima), so the share of equal samples estimates it.

Terms are hashed into ``2**term_bits`` places, for which r, c and b are drawn once per Python
worker from a seeded generator; the gammas of a term are then a row of a table.  Two terms
share a place with probability 2**-term_bits, which adds about n / 2**term_bits to the
similarity of texts of n terms.

Each text is also compared with an edited copy, whose last half is replaced by the start of
the next document, and with the next document.  For this the rows are dealt by ranges of
doc_id.  The range borders are ids of the table (at most ``ranges`` come to the driver), so each
range also gets the first row of the next one, and the last gets the first of all; within a
range, rows are read in order, one at a time.  One shuffle moves each text once.

Defined cases: null and empty texts have no terms and share the fingerprint of nothing, which is
like itself (1.0) and like no other (0.0); a null doc_id sorts first; repeated ids are
ordered by text, null first; one single row is its own next; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import doc_rows, documents, mix, parted, string_column, words_of


@dataclass(frozen=True)
class FingerprintParams:
    samples: int = 64
    term_bits: int = 17
    seed: int = 7


DEFAULT = FingerprintParams()

_tables: dict = {}


def _table(p: FingerprintParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c, b, and ln a at weight 1, for every place and sample; kept while the worker lives."""
    if p not in _tables:
        rng = np.random.Generator(np.random.Philox(p.seed))
        shape = (1 << p.term_bits, p.samples)

        def draw() -> np.ndarray:
            return rng.random(shape, np.float32) * np.float32(1 - 2e-7) + np.float32(1e-7)

        r = -np.log(draw() * draw())
        c = np.log(-np.log(draw() * draw()))
        b = rng.random(shape, np.float32)
        _tables[p] = (r, c, b, c - r * (1 - b))
    return _tables[p]


def terms(text: bytes, p: FingerprintParams = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the terms of one text, places ascending."""
    words, _, _ = words_of([text])
    pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
    places = np.concatenate([words, pairs]) >> np.uint64(64 - p.term_bits)
    return np.unique(places.astype(np.int64), return_counts=True)


def sample(places: np.ndarray, weights: np.ndarray, p: FingerprintParams = DEFAULT) -> np.ndarray:
    """One 32-bit signature per sample, from the chosen place and its t."""
    if not len(places):
        return np.zeros(p.samples, np.uint32)
    r, c, b, at_one = _table(p)
    best = np.full(p.samples, np.inf, np.float32)
    chosen = np.zeros(p.samples, np.int64)
    level = np.zeros(p.samples, np.int64)
    column = np.arange(p.samples)
    for part, heavy in ((places[weights == 1], False), (places[weights > 1], True)):
        w = np.log(weights[weights > 1]).astype(np.float32)[:, None] if heavy else None
        for i in range(0, len(part), 4096):
            at = part[i : i + 4096]
            if heavy:
                t = np.floor(w[i : i + 4096] / r[at] + b[at])
                score = c[at] - r[at] * (t - b[at] + 1)
            else:
                score = at_one[at]
            row = score.argmin(0)
            low = score[row, column]
            better = low < best
            best = np.where(better, low, best)
            chosen = np.where(better, at[row], chosen)
            if heavy:
                level = np.where(better, t[row, column].astype(np.int64), level)
            else:
                level = np.where(better, 0, level)
    key = (chosen.astype(np.uint64) << np.uint64(32)) ^ level.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return (mix(key + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (code points, rounded down) replaced by as many of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, p: FingerprintParams = DEFAULT) -> DataFrame:
    """``docs`` (doc_id, text) with a ``fingerprint`` of every text, hexadecimal; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            found = [sample(*terms((t or "").encode(), p), p).tobytes().hex() for t in string_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(found, pa.string())],
                names=["doc_id", "fingerprint"],
            )

    return doc_rows(docs).mapInArrow(run, "doc_id long, fingerprint string")


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def with_neighbours(docs: DataFrame, p: FingerprintParams = DEFAULT) -> DataFrame:
    """One row per row of ``docs``: fingerprints of the text and of its edited copy, and likenesses."""
    spark = docs.sparkSession
    rows = doc_rows(docs).withColumn("text", F.coalesce("text", F.lit("")))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / ranges for k in range(ranges)]
    borders = rows.agg(F.percentile_approx(key, F.array(*[F.lit(x) for x in steps]), 100 * ranges)).first()[0]
    if borders is None:
        return spark.createDataFrame([], _SCHEMA)
    least = rows.agg(F.min(key)).first()[0]
    borders = sorted({least, *borders})
    last = len(borders) - 1
    # The range of a row is the number of borders at or below it, less one.
    where = F.size(F.filter(F.lit(borders), lambda b: b <= key)) - 1
    ranged = rows.withColumn("__range", where)
    # The rows on a border are also read after the range before it; the first range follows the last.
    place = F.when(
        F.array_contains(F.lit(borders), key),
        F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("after")),
                F.struct(F.when(F.col("__range") == 0, last).otherwise(F.col("__range") - 1).alias("r"), F.lit(1).alias("after"))),
    ).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("after"))))
    dealt = ranged.withColumn("__to", F.explode(place)).select("__to.r", "__to.after", "doc_id", "text")
    dealt = dealt.repartitionById(last + 1, F.col("r").cast("int")).sortWithinPartitions(
        "after", F.col("doc_id").asc_nulls_first(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        closed = False
        for batch in parted(batches):
            ids, after, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "after", "text"))
            out = []
            for doc_id, late, text in zip(ids, after, texts, strict=True):
                if closed:
                    break
                mark = sample(*terms(text.encode(), p), p)
                if held is not None:
                    out.append(_compare(*held, text, mark, p))
                held, closed = (doc_id, text, mark), late == 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=_arrow)

    return dealt.mapInArrow(run, _SCHEMA)


_arrow = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compare(doc_id, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray, p: FingerprintParams) -> tuple:
    copy = edited(text, following).encode()
    copy_mark = sample(*terms(copy, p), p)
    return (
        doc_id, len(text), hashlib.sha256(copy).hexdigest(), mark.tobytes().hex(), copy_mark.tobytes().hex(),
        likeness(mark, copy_mark), likeness(mark, next_mark),
    )


# --- the query -------------------------------------------------------------------------------


def document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_neighbours(documents(spark, sf_dir))
