"""Change detection folds pages one after the other in a task (F19)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa

from tidemark.functions.similarity import fold_changed


def test_pages_are_folded_in_order_across_batches():
    texts = ["alpha beta", "alpha betb", "gamma", "gamma ray", "", "delta delta", "delta delta", "alpha beta"] * 3
    rows = [(i // 9, i // 5, i, t, "gamma" if i // 5 == 2 else "") for i, t in enumerate(texts)]
    names = ["source_id", "bin", "tie", "text", "__entry"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    run = fold_changed(0.8, "source_id", "bin")
    made = [tuple(r.values()) for b in run(iter([batch.slice(0, 7), batch.slice(7, 6), batch.slice(13)])) for r in b.to_pylist()]
    plain: dict = {}
    for source, place, ident, text, entry in rows:
        ids, left, begun = plain.setdefault((source, place), ([], None, entry))
        last = left if left is not None else begun
        if SequenceMatcher(None, last, text).ratio() < 0.8:
            plain[source, place] = ([*ids, ident], text, begun)
    assert made == [(*k, *v) for k, v in plain.items()]
