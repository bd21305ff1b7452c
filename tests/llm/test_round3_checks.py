"""Steps that the check of round 3 found too costly, against plain statements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm import ngram_join, passages
from tidemark.llm.text import words_of


def test_large_buckets_are_split_on_keys_that_another_set_holds(spark):
    """Key 1 is in all sets, key 1000 + i in two, the others in one set each: every split pair meets again."""
    rows = [(v, [1, 1000 + v // 2, *[10_000 + 100 * v + j for j in range(12)]]) for v in range(200)]
    nodes = spark.createDataFrame(rows, "node long, keys array<long>")
    small, _ = ngram_join._buckets(nodes, ngram_join.DEFAULT)
    given = {k for _, keys in rows for k in keys}
    parts: dict[int, set[int]] = {}
    for r in small.collect():
        if r["path"] not in given:
            parts.setdefault(r["path"], set()).add(r["node"])
    assert sorted(sorted(p) for p in parts.values()) == [[v, v + 1] for v in range(0, 200, 2)]


def test_common_keys_of_large_buckets_are_told_without_a_row_for_each_key(spark):
    """Key 1 is in all sets, 2 in two of three, 3 in half (not common), the others in one; a bucket of the same sets is not probed."""
    rows = [(v, [1, *([2] if v % 3 else []), *([3] if v % 2 else []), *[1000 + 10 * v + j for j in range(8)]]) for v in range(120)]
    nodes = spark.createDataFrame(rows, "node long, keys array<long>")
    held = [(path, first, v, 120) for path, first in [(7, 7), (8, 7)] for v in range(120)] + [(9, 9, v, 70) for v in range(0, 70)]
    big = spark.createDataFrame([*held, (11, 11, 500, 90)], "path long, first long, node long, n long")
    common = ngram_join._common(big, nodes, ngram_join.DEFAULT)
    assert {r["first"]: sorted(r["common"]) for r in common.collect()} == {7: [1, 2], 9: [1, 2]}
    assert "Generate" not in common._jdf.queryExecution().optimizedPlan().toString()


def test_word_slices_hash_a_text_once_for_all_its_requests(monkeypatch):
    """Texts of rows that stand together are hashed once, within a batch and across two; slices are those of the rule."""
    p = passages.DEFAULT
    texts = [f"{k} " + " ".join(f"w{k}x{i % 7}" for i in range(60 + 40 * k)) for k in range(4)]
    rows = [(10 * k + r, k, 0, r, r, 0, 5 * r, 5 * r + 20, bytes([r]), texts[k]) for k in range(4) for r in range(5)]
    names = ["key", "doc_id", "other_id", "x0", "y0", "side", "low", "high", "links", "text"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.binary(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)
    asked: list[bytes] = []

    def counted(encoded):
        asked.extend(encoded)
        return words_of(encoded)

    monkeypatch.setattr(passages, "words_of", counted)
    made = [r for b in passages._word_slices(p)(iter([batch.slice(0, 8), batch.slice(8)])) for r in b.to_pylist()]
    assert len(asked) == len(texts)
    for r, row in zip(made, rows, strict=True):
        begin = max(0, row[6] - p.margin)
        plain = (words_of([row[9].encode()])[0][begin : row[7] + p.margin] >> np.uint64(32)).astype(np.uint32)
        assert (r["key"], r["begin"], r["words"], r["links"]) == (row[0], begin, plain.tobytes(), row[8])


def test_seeds_are_the_first_least_of_every_window():
    rng = np.random.default_rng(5)
    p = passages.DEFAULT
    for n in [1, 4, 5, 9, 10, 11, 12, 40, 400]:
        for kinds in [1, 2, 5, 1000]:
            words = rng.integers(0, kinds, n).astype(np.uint64)
            hashes, places = passages.seeds(words, p)
            size = n - p.k + 1
            if size <= 0:
                assert not len(places)
                continue
            h = passages.mix(sum((words[j : j + size] * passages._TAPS[j] for j in range(p.k)), np.zeros(size, np.uint64)))
            least = {a + int(h[a : a + p.window].argmin()) for a in range(max(size - p.window + 1, 1))}
            assert set(places.tolist()) <= least and np.array_equal(hashes, h[places])
            if kinds == 1000:  # no runs of one hash to thin
                assert set(places.tolist()) == least
