"""The corpus pipeline, stage by stage, against what each stage promises."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm import mixture, ngram_join, pieces, quality, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(input, output) of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns(steps):
    names = steps[0][0].columns
    assert all(after.columns == names for _, after in steps[:-1])


def test_quality_stage(steps):
    before, after = steps[0]
    want = [r for r in quality.ledger(before).collect() if r["ledger"]["failure_bits"] & quality.mask(quality.CURRENT) == 0]
    assert sorted(r["doc_id"] for r in want) == sorted(r["doc_id"] for r in after.collect())


def test_duplicates_stage(steps):
    before, after = steps[1]
    classes = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(before).collect()}
    kept = [r["doc_id"] for r in after.collect()]
    assert sorted(kept) == sorted(set(classes.values())) and len(kept) < len(classes)


def test_secrets_stage(steps):
    before, after = steps[2]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)
    for r in after.collect():
        assert not pattern.search(r["text"])
        assert r["text"] == texts[r["doc_id"]] or secrets.base_spans(texts[r["doc_id"]].encode())
    assert len(texts) == after.count()


def test_mix_stage(steps):
    before, after = steps[3]
    taken = Counter()
    for r in mixture.mixture(before).collect():
        taken[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5)
    assert Counter(r["doc_id"] for r in after.collect()) == +taken


def test_pieces_stage(spark, steps):
    before, after = steps[4]
    assert after.count() == before.count() and all(r["round_trip"] for r in after.collect())
    back = pieces.decode(after, pieces.PieceModel.load())
    assert rows(back) == rows(before.select("doc_id", "text"))
