"""Pattern spans, Markov stretches, term statistics, compression sizes and passages against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import compress, mixture, passages, pii, secrets
from test_llm_operators import DDL, WORD, words

SECRET_BITS = ["password", "Passwd", "secret", "TOKEN", "api_key", "apikey", ":", "=", '"', "'", " ", "AKIA", "ABCDEFGHIJKLMNOP", "f0" * 12, "a" * 23, "é", "日本", "xyz-", "/", "q7ZxV9kL", "\n", "_", "."]
PRIVATE_BITS = ["a@b", ".com", "x.y", "@", "..", "12.34", ".56.7", "256.1.1.1", "8.8.8.8", "4111 1111 1111 1111", "4111111111111112", "-", "+1", " (020) ", "555-1234", "5.", "é", "日", " ", "\n", "0", "99", "foo", "+", "%"]


def texts_of(bits, seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def digest(spans, kinds):
    rows = sorted(((s, kinds.index(k), e) for k, s, e in spans))
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in rows).encode()).hexdigest()


def test_base_spans_of_secrets(spark):
    kinds = ["assign", "access", "hex"]
    assign = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
    data = texts_of(SECRET_BITS, 1)
    docs = spark.createDataFrame([*enumerate(data)], "doc_id BIGINT, text STRING")
    for r in secrets.scan_secrets(docs, None).collect():
        t = data[r["doc_id"]]
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r["base_sha256"] == digest(spans, kinds), t
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in kinds]


def test_transitions_and_stretches_of_secrets(spark):
    p = secrets.DEFAULT
    rng = np.random.default_rng(4)
    ratios = rng.normal(0.4, 1.2, 60)
    for s, e in secrets._stretches(ratios, p):
        own = ratios[s : e - 1]
        assert e - s >= p.min_chars and own.sum() >= p.min_total and own.sum() >= p.inner_each * len(own)
    high = np.concatenate([np.full(20, -1.0), np.full(25, 3.0), np.full(20, -1.0)])
    assert secrets._stretches(high, p) == [(20, 46)]
    prose = " ".join(words(3, 3000))
    key = "q7ZxV9kLm2PwR4tYb8NcJd5HsGf1"
    texts = {
        1: f"{prose} path/to/some/ordinary/folder/{key}", 2: f"{prose} {'0123456789abcdef' * 2}{key}",
        3: prose, 4: f"{prose} path/to/some/ordinary/folder/of/kalana/peruso",
    }
    docs = spark.createDataFrame([*texts.items()], "doc_id BIGINT, text STRING")
    ratio = secrets.learn(docs.where("doc_id in (3, 4)"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs, ratio).collect()}
    for k in (1, 2):  # in a long path, and beside a hex run
        at = texts[k].index(key)
        found = [tuple(map(int, x.split(":")[1:])) for x in spans[k].split(",") if x.startswith("random")]
        assert any(min(e, at + len(key)) - max(s, at) >= len(key) - 4 for s, e in found), spans[k]
    assert spans[3] == "" and "random" not in spans[4]


def luhn(d):
    return sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def test_base_spans_of_personal_data(spark):
    kinds = ["email", "ip", "card", "phone"]
    data = texts_of(PRIVATE_BITS, 2)
    docs = spark.createDataFrame([*enumerate(data)], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(data):
        spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"[^0-9]", "", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        assert sorted((s["s"], s["kind"], s["e"]) for s in got[i]) == sorted((s, kinds.index(k), e) for k, s, e in spans), t


def test_short_names_disclose(spark):
    """A name of three letters, and one of two ideographs, that stand beside one address only."""
    rng = random.Random(6)
    filler = [f"{a}{b}" for a in ("ka", "mo", "ri") for b in ("lan", "per", "tor")]
    line = lambda: " ".join(rng.choice(filler) for _ in range(6))
    rows = [(i, line()) for i in range(300)]
    rows += [(1000 + i, f"{line()} Kim wrote from kk@example.org {line()}") for i in range(6)]
    rows += [(2000 + i, f"{line()} 李明 ist 10.1.2.3 {line()}") for i in range(6)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    texts = dict(rows)
    told = {}
    for r in found:
        for s in r["all_spans"]:
            if s["kind"] == 4:
                told.setdefault(r["doc_id"] // 1000, set()).add(texts[r["doc_id"]][s["s"] : s["e"]])
    assert "Kim" in told[1] and "李明" in told[2] and 0 not in told


def test_passages_of_edited_copies(spark):
    """Passages of 60 words with an edit every 6 to 12 words are found in nine of ten cases and more."""
    rng, rows, planted = np.random.default_rng(2), [], []
    for k in range(160):
        every = 6 + k % 7
        base = words(50_000 + k, 60)
        copy = [f"edit{k}x{i}" if i % every == every - 1 else w for i, w in enumerate(base)]
        rows.append((2 * k, " ".join(words(1000 + k, 70) + base + words(2000 + k, 40))))
        rows.append((2 * k + 1, " ".join(words(3000 + k, int(rng.integers(20, 90))) + copy + words(4000 + k, 50))))
        if (60 - 60 // every) / 60 >= passages.DEFAULT.min_identity:
            planted.append(2 * k + 1)
    found = {r["doc_id"]: r["other_id"] for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert sum(found.get(k) == k - 1 for k in planted) >= 0.9 * len(planted)
    assert all(k % 2 and v == k - 1 for k, v in found.items())


def test_passages_cover_repeated_windows(spark):
    """Where a copy's earlier holder changes, up to ``k + window - 2`` words at the change can be without a seed."""
    rng, n = random.Random(9), 120
    texts = {}
    for i in range(n):
        w = words(100 + i, rng.randint(60, 200))
        for _ in range(rng.randint(0, 2)):
            if i:
                src = WORD.findall(texts[rng.randrange(i)])
                at, size = rng.randrange(max(len(src) - 60, 1)), rng.randint(50, 70)
                cut = rng.randrange(len(w))
                w[cut:cut] = src[at : at + size]
        texts[i] = " ".join(w)
    rows = passages.shared_passages(spark.createDataFrame([*texts.items()], "doc_id BIGINT, text STRING")).collect()
    covered = {}
    for r in rows:
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    seen, windows, hit = set(), 0, 0
    for i in range(n):
        w = WORD.findall(texts[i])
        own = {at: tuple(w[at : at + 50]) for at in range(len(w) - 49)}
        for at, g in own.items():
            if g in seen:
                windows += 1
                hit += set(range(at, at + 50)) <= covered.get(i, set())
        seen |= set(own.values())
    assert windows > 1000 and hit >= 0.99 * windows


def test_compressed_sizes(spark):
    """The sizes that a prediction rests on are those of one plain call per text and dictionary."""
    langs = {"aa": "ka mo ri ", "bb": "xu yo ze ", "cc": "12 34 56 "}
    rows = [(i, (t * (3 + i % 5)) + f"tail{i}", x) for i in range(30) for x, t in langs.items()]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    got = compress.predict_language(docs, compress.train_languages(docs)).collect()
    truth = {}
    for i, t, x in rows:
        truth.setdefault(i, []).append(x)
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= set(langs)
    assert sum(r["lang_pred"] in truth[r["doc_id"]] for r in got) == len(rows)
    small = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"ka mo ri " * 50, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    plain = zstandard.ZstdCompressor()
    assert len(small.compress(b"ka mo ri ka mo ri")) < len(plain.compress(b"ka mo ri ka mo ri"))


def test_shards_of_empty_and_repeated_rows(spark):
    """10^5 empty texts of one source, and rows of one id, are dealt over shards by rows."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("a").alias("source"))
    rows = rows.union(spark.range(40_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source")))
    p = mixture.MixParams(shard_rows=1000)
    sized = mixture.sizes(rows, p)
    deal = F.conv(F.substring("seeded", 8, mixture._HEX), 16, 10).cast("long") % 100
    per = [r["count"] for r in sized.groupBy(deal.alias("s")).count().collect()]
    assert len(per) == 100 and max(per) < 1500
    got = mixture.mixture(rows, p)
    assert got.count() == 100_000 and got.agg(F.sum("taken")).first()[0] == 40_000
