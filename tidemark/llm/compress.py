"""Compression classifiers: zstandard with raw-content dictionaries per class.

A class is known by a dictionary, which is text of that class as it stands.  A text is cut into
pieces of ``piece_bytes``, each piece is compressed with every dictionary on its own, and the
sizes are summed: the whole text counts, and a long text does not become its own dictionary.

* ``train_languages`` / ``predict_language``: smallest size wins; narrow margins are marked.
* ``train_quality`` / ``score_quality``: the normalised difference of the sizes with the bad and
  the good dictionary, turned into a probability by a logistic curve fitted on labelled rows
  that are in neither dictionary.

Training reads a bounded sample of labelled rows, ``rows_per_class`` of each class at most,
chosen by a hash of the id; only that sample comes to the driver, cut to ``row_bytes`` a row.
Prediction is one narrow pass over all rows with the dictionaries in the task closure (their
size is classes x ``dict_bytes``).

Defined cases: a null or empty text, or one without letters, is ``und`` with score 0; it gets a
quality score from the curve at difference 0.  Equal texts get equal results.  Ties go to the
label with more training rows.  Without labelled rows every language is ``und`` and every quality score
is 0.5.  Rows with a null id are not trained on and not held out.  Labels that disagree on one
id leave it out of training.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import doc_rows, documents, parted, string_column


@dataclass(frozen=True)
class CompressParams:
    level: int = 6
    dict_bytes: int = 256 << 10
    piece_bytes: int = 512
    rows_per_class: int = 800
    row_bytes: int = 4096
    #: Languages: below this share of the size between best and second the answer is marked as rejected.
    narrow: float = 0.01
    #: Languages: size difference, as a share, at which the best class is e times likelier.
    temperature: float = 0.02


DEFAULT = CompressParams()
SEED = 20_240_101


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; the held-out part has 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_sample(rows: DataFrame, label: str, p: CompressParams) -> dict:
    """Label to texts, the most frequent label first: at most ``rows_per_class`` rows per class of ``rows`` (doc_id, label, text).

    Classes are counted first; a hash of the id then lets through about one and a half times
    what is wanted, which is ordered and cut on the driver.
    """
    unit = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)).alias("__u")
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return {}
    pick = F.lit(False)
    for value, n in sorted(counts.items()):
        pick = pick | ((F.col(label) == value) & (F.col("__u") < 1.5 * p.rows_per_class / max(n, 1)))
    # A slice of each text, from a place that the hash chooses, so that no row is larger than row_bytes.
    span = F.greatest(F.length("text") - p.row_bytes // 2, F.lit(0))
    start = F.floor(span * F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 20)) / (1 << 20)).cast("int")
    cut = F.substring(F.col("text"), start + 1, F.lit(p.row_bytes // 2))
    found = rows.withColumn("__u", unit).where(pick).select(label, "__u", "doc_id", cut.alias("cut")).collect()
    kept: dict = {}
    for r in sorted(found, key=lambda r: (r["__u"], r["doc_id"], r["cut"])):
        part = kept.setdefault(r[label], [])
        if len(part) < p.rows_per_class:
            part.append(r["cut"].encode())
    return {k: kept[k] for k in sorted(kept, key=lambda k: (-counts[k], k))}


def dictionary(texts: list[bytes], p: CompressParams) -> bytes:
    return b"\n".join(texts)[-p.dict_bytes :]


class Sizer:
    """Sizes of whole texts under several dictionaries; built once per task."""

    def __init__(self, dictionaries: list[bytes], p: CompressParams):
        self.step = p.piece_bytes
        self.tools = []
        for d in dictionaries:
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=p.level)
            self.tools.append(
                zstandard.ZstdCompressor(level=p.level, dict_data=made, write_content_size=False, write_dict_id=False)
            )

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i : i + self.step] for i in range(0, len(text), self.step)]
        return [sum(len(t.compress(x)) for x in pieces) for t in self.tools]


def folded(text: str | None) -> bytes:
    """Lower case, so that a text in capitals meets the same dictionary."""
    return (text or "").lower().encode()


# --- languages -------------------------------------------------------------------------------


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    dictionaries: list[bytes]


def train_languages(rows: DataFrame, p: CompressParams = DEFAULT) -> LanguageModel:
    """``rows``: doc_id, text, lang of the training part; null languages and texts are left out."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    parts = labelled_sample(usable, "lang", p)
    return LanguageModel([*parts], [dictionary([folded(b.decode()) for b in v], p) for v in parts.values()])


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def predict_language(docs: DataFrame, model: LanguageModel, p: CompressParams = DEFAULT) -> DataFrame:
    """doc_id, lang_pred, score, rejected (margin below ``narrow``) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.dictionaries, p)
        for batch in parted(batches):
            names, scores, narrow = [], [], []
            for text in string_column(batch, "text"):
                if not model.labels or not _has_letter(text):
                    names.append("und"), scores.append(0.0), narrow.append(True)
                    continue
                size = np.array(sizer.sizes(folded(text)), float)
                share = (size - size.min()) / size.min()
                best = int(size.argmin())
                names.append(model.labels[best])
                scores.append(float(1 / np.exp(-share / p.temperature).sum()))
                narrow.append(len(share) > 1 and float(np.partition(share, 1)[1]) < p.narrow)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return doc_rows(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def _held_out() -> Column:
    return F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))


def language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    train = doc_rows(docs, "lang").where(remainder(F.col("doc_id")) != 1)
    found = predict_language(docs, train_languages(train))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


# --- quality ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _difference(good: int, bad: int, size: int) -> float:
    """Bytes saved by the good dictionary over the bad one, per byte of text."""
    return (bad - good) / max(size, 1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's steps, held back by a weak prior."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 1e-4 * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2), grad)
        beta += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train_quality(rows: DataFrame, p: CompressParams = DEFAULT) -> QualityModel | None:
    """``rows``: doc_id, text, quality (0 or 1) of the training part.

    Of each class the even picks fill the dictionary and the odd ones fit the curve.
    """
    usable = rows.where(F.col("quality").isin(0, 1) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    picks = labelled_sample(usable, "quality", p)
    if len(picks) < 2:
        return None
    fill = {k: dictionary(v[::2], p) for k, v in picks.items()}
    sizer = Sizer([fill[1], fill[0]], p)
    fit = [(_difference(*sizer.sizes(b), len(b)), k) for k, v in picks.items() for b in (v[1::2] or v)]
    slope, offset = _logistic(np.array([x for x, _ in fit]), np.array([float(k) for _, k in fit]))
    return QualityModel(fill[1], fill[0], slope, offset)


def score_quality(docs: DataFrame, model: QualityModel | None, p: CompressParams = DEFAULT) -> DataFrame:
    """doc_id, score and the size difference for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer([model.good, model.bad], p) if model else None
        for batch in parted(batches):
            texts = [(t or "").encode() for t in string_column(batch, "text")]
            diffs = np.array([_difference(*sizer.sizes(b), len(b)) if sizer else 0.0 for b in texts], float)
            z = model.slope * diffs + model.offset if model else diffs
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(diffs)],
                names=["doc_id", "score", "difference"],
            )

    return doc_rows(docs).mapInArrow(run, "doc_id long, score double, difference double")


def training_labels(labels: DataFrame) -> DataFrame:
    """One row per id whose labels agree."""
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    agreed = one.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("__other"))
    return agreed.where(F.col("quality") == F.col("__other")).drop("__other")


def quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    train = doc_rows(docs).where(remainder(F.col("doc_id")) != 1).join(labels, "doc_id")
    found = score_quality(docs, train_quality(train))
    return found.select(
        "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference"
    )
