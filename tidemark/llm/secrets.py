"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the bytes of token characters are trained from labelled samples:
``random`` from values that the patterns mark as secrets and, in equal parts, from generated
random strings, and ``ordinary`` from all other text.  Counts cover every row; they are summed per Arrow batch, so that
one small matrix per batch is shuffled and 2 x K x K numbers reach the driver, whatever the
input.  A candidate is a run of ``min_chars`` token characters or more outside the pattern
spans; it is reported as kind ``random`` when its log-likelihood ratio is at least ``min_total``
and ``min_each`` per character.

Defined cases: a null text is empty and has no spans; equal rows give equal rows; an empty table
trains empty models, which report nothing; other columns of the input are ignored.  Offsets are
code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import doc_rows, parted, string_column

# The patterns of the base kinds, in the order of listing.  They work on UTF-8
# bytes: every character that they name is ASCII, and so is every letter taken in either case.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")  # a first match that is too short leaves no longer one in its run
_HEX = re.compile(rb"[0-9a-f]{24,}")  # the same holds for runs

_TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(_TOKEN) + 1  # class 0: any other byte, which stands before and after a token
_CLASS = np.zeros(256, np.int64)
_CLASS[list(_TOKEN)] = np.arange(1, K)


@dataclass(frozen=True)
class SecretParams:
    min_chars: int = 16
    min_total: float = 16.0
    min_each: float = 0.6
    #: Per step, for a stretch inside a run.
    inner_each: float = 1.0
    smoothing: float = 0.5
    #: Generated random strings of 32 characters; they weigh as much as the values found in the corpus.
    generated: int = 4096


DEFAULT = SecretParams()


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the pattern matches, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _pair_counts(pieces: list[bytes]) -> np.ndarray:
    """Transitions between classes over the pieces, each with the edge class on both sides."""
    codes = _CLASS[np.frombuffer(b"\n".join([b"", *pieces, b""]), np.uint8)]
    return np.bincount(codes[:-1] * K + codes[1:], minlength=K * K)


def _random_string(seed: bytes) -> bytes:
    """32 characters over digits and letters in one of three cases, drawn from a hash of the seed."""
    draw = hashlib.blake2b(seed).digest()
    signs = (_TOKEN[:62], _TOKEN[26:62], _TOKEN[:26] + _TOKEN[52:62])[draw[0] % 3]
    return bytes(signs[b % len(signs)] for b in draw[1:33])


def _train(p: SecretParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, K * K), np.int64)
        for batch in parted(batches):
            for text in string_column(batch, "text"):
                b = (text or "").encode()
                found = base_spans(b)
                secret = []
                for s, kind, e in found:
                    m = _ASSIGN.match(b, s) if kind == 0 else None
                    secret.append(m[2] if m else b[s:e])
                if secret:
                    totals[1] += _pair_counts(secret)
                at, rest = 0, []
                for s, _, e in found:
                    rest.append(b[at:s])
                    at = max(at, e)
                rest.append(b[at:])
                totals[0] += _pair_counts(rest)
        label, pair = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(totals[label, pair])],
            names=["label", "pair", "n"],
        )

    return run


def transition_counts(docs: DataFrame, p: SecretParams = DEFAULT) -> DataFrame:
    """label (1 random, 0 ordinary), pair (class * K + next class), n: over all rows."""
    parts = doc_rows(docs).select("text").mapInArrow(_train(p), "label int, pair int, n long")
    return parts.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def ratio_matrix(counts: list, p: SecretParams = DEFAULT) -> np.ndarray | None:
    """Log-likelihood ratio of every transition, or None when there is no ordinary text."""
    table = np.zeros((3, K, K))
    for label, pair, n in counts:
        table[label, pair // K, pair % K] = n
    table[2] = _pair_counts([_random_string(b"%d" % i) for i in range(p.generated)]).reshape(K, K)
    table[:, 0, 0] = 0  # between tokens nothing is told
    if table[0].sum() == 0 or table[1:].sum() == 0:
        return None
    seen = table.sum(axis=(1, 2)) > 0
    # Transitions are smoothed towards how frequent the next class is at all, so that a character
    # that a model never saw is judged by what follows it elsewhere.
    single = table.sum(axis=1, keepdims=True) + p.smoothing
    table += p.smoothing * K * single / single.sum(axis=2, keepdims=True)
    share = table / table.sum(axis=2, keepdims=True)
    return np.log(share[1:][seen[1:]].mean(axis=0)) - np.log(share[0])


def _stretches(ratios: np.ndarray, p: SecretParams) -> list[tuple[int, int]]:
    """Character ranges of ``min_chars`` or more whose ratios, less ``inner_each`` for a step, sum up highest.

    ``ratios`` belong to the steps between characters.  What lies left and right of the best range is searched again.
    """
    out, todo = [], [(0, len(ratios) + 1)]
    least = p.min_chars - 1
    while todo:
        a, b = todo.pop()
        if b - a < p.min_chars:
            continue
        sums = np.concatenate([[0.0], np.cumsum(ratios[a : b - 1] - p.inner_each)])
        low = np.minimum.accumulate(sums[: len(sums) - least])
        j = int((sums[least:] - low).argmax())
        i = int(sums[: j + 1].argmin())
        s, e = a + i, a + least + j + 1
        if ratios[s : e - 1].sum() < max(p.min_total, p.inner_each * (e - s - 1)):
            continue
        out.append((s, e))
        todo += [(a, s), (e, b)]
    return out


def random_spans(text: bytes, base: list, ratio: np.ndarray, p: SecretParams, finder: re.Pattern) -> list:
    """Runs of token characters that look random as a whole, and random stretches inside the others.

    What base spans leave of a run is judged by its stretches.
    """
    out, k = [], 0
    for m in finder.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][2] <= s:
            k += 1
        taken, i = [], k
        while i < len(base) and base[i][0] < e:
            taken.append(base[i])
            i += 1
        codes = _CLASS[np.frombuffer(text[s:e], np.uint8)]
        steps = ratio[codes[:-1], codes[1:]]
        total = ratio[0, codes[0]] + steps.sum() + ratio[codes[-1], 0]
        if not taken and total >= p.min_total and total >= p.min_each * (e - s):
            out.append((s, 3, e))
            continue
        at = s
        for low, high in [*((b[0], b[2]) for b in taken), (e, e)]:
            if low - at >= p.min_chars:
                out += [(at + x, 3, at + y) for x, y in _stretches(steps[at - s : low - s - 1], p)]
            at = max(at, high)
    return sorted(out)


def _to_points(text: bytes, spans: list) -> list[tuple[int, int, int]]:
    """Byte offsets as code points, in one pass over the text."""
    if text.isascii():
        return spans
    points, at, n = {}, 0, 0
    for offset in sorted({x for s in spans for x in (s[0], s[2])}):
        n += len(text[at:offset].decode())
        points[offset], at = n, offset
    return [(points[s], kind, points[e]) for s, kind, e in spans]


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _scan(ratio: np.ndarray | None, p: SecretParams):
    finder = re.compile(b"[" + re.escape(_TOKEN) + b"]{%d,}" % p.min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            sums, joined, numbers = [], [], np.zeros((4, batch.num_rows), np.int64)
            for i, text in enumerate(string_column(batch, "text")):
                b = (text or "").encode()
                base = base_spans(b)
                more = random_spans(b, base, ratio, p, finder) if ratio is not None else []
                for s in (*base, *more):
                    numbers[s[1], i] += 1
                sums.append(hashlib.sha256(_joined(_to_points(b, base)).encode()).hexdigest())
                joined.append(_joined(_to_points(b, sorted([*base, *more]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *[pa.array(x) for x in numbers[:3]],
                 pa.array(sums, pa.string()), pa.array(joined, pa.string()), pa.array(numbers[3])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    return run


def learn(docs: DataFrame, p: SecretParams = DEFAULT) -> np.ndarray | None:
    """The ratio matrix trained on ``docs``; at most 2 K K counts come to the driver."""
    return ratio_matrix([(r["label"], r["pair"], r["n"]) for r in transition_counts(docs, p).collect()], p)


def scan_secrets(docs: DataFrame, ratio: np.ndarray | None, p: SecretParams = DEFAULT) -> DataFrame:
    """One row per row of ``docs``: counts per base kind, digest of base spans, all spans."""
    return doc_rows(docs).mapInArrow(_scan(ratio, p), _SCHEMA)


def redact(docs: DataFrame, ratio: np.ndarray | None, p: SecretParams = DEFAULT, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping spans become one mark.

    All other columns, and ``text`` of rows without a span, are left as they are.
    """
    finder = re.compile(b"[" + re.escape(_TOKEN) + b"]{%d,}" % p.min_chars)
    sign = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            k, out = batch.schema.get_field_index("text"), []
            for text in batch.column(k).to_pylist():
                b = (text or "").encode()
                base = base_spans(b)
                more = random_spans(b, base, ratio, p, finder) if ratio is not None else []
                if not base and not more:
                    out.append(text)
                    continue
                parts, at = [], 0
                for s, _, e in sorted([*base, *more]):
                    if s >= at:
                        parts += [b[at:s], sign]
                    at = max(at, e)
                out.append((b"".join([*parts, b[at:]])).decode())
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


# --- the query -------------------------------------------------------------------------------


def secret_scan(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.text import documents

    docs = documents(spark, sf_dir)
    return scan_secrets(docs, learn(docs))
