"""Collocations, Merkle manifests and embedding copies against plain statements of their rules."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import collocations, lattice, merkle, ngram_join

from test_llm_operators import DDL, WORD, awkward, empty, odd, words  # noqa: F401

# --- collocations -----------------------------------------------------------------------------


def plain_collocations(rows, least, first, most=5):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        longer = [v for (x, y), v in found.items() if x == lang and len(y) > len(w) and any(y[i : i + len(w)] == w for i in range(len(y) - len(w) + 1))]
        if any(100 * v >= 100 * a for v in longer):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0].encode(), -r[6], -r[2], r[1].encode()))
    ranked = []
    for lang, group in itertools.groupby(out, key=lambda r: r[0]):
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(group, 1) if i <= first]
    return sorted(ranked)


def phrase_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÄÖ", "日本", "a-b", "x'y", "AbC"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for k in range(120):
        w = [vocabulary[i] for i in rng.choice(len(vocabulary), int(rng.integers(0, 120)), p=weights / weights.sum())]
        marks = rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ; "], len(w))
        text = "".join(a + b for a, b in zip(w, marks))
        if k % 3 == 0:
            text += " New York City Hall is big" * 2
        rows.append((text, [None, "en", "und", "fr"][k % 4] if k % 8 else "en"))
    return [*rows, (None, "en"), ("", None), (" \n.,", "xx"), ("hot hot hot hot hot hot " * 300, "de")]


@pytest.mark.parametrize("least, first, flush", [(3, 2000, 4_000_000), (8, 15, 500)])
def test_collocations(spark, least, first, flush):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, x, None, None) for i, (t, x) in enumerate(rows)], DDL).withColumn("phrase", F.lit(1)).repartition(5)
    p = collocations.PhraseParams(min_count=least, first=first, flush=flush, held=50)
    got = [tuple(r) for r in collocations.collocations(docs, p).collect()]
    assert sorted(got) == plain_collocations(rows, least, first)


def test_collocations_of_odd_and_empty_tables(spark, odd, empty):  # noqa: F811
    p = collocations.PhraseParams(min_count=2)
    got = sorted(tuple(r) for r in collocations.collocations(odd, p).collect())
    assert got == plain_collocations([(r[1], r[2]) for r in awkward()], 2, 2000)
    assert collocations.collocations(empty, p).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=8), st.integers(1, 6), st.data())
def test_summaries_keep_every_frequent_key(parts, threshold, data):
    mass = sum(map(len, parts))
    summary = collocations.Summary(mass // threshold + 1)
    for part in parts:
        keys, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        summary.take(*collocations.unpacked(collocations.packed(keys, counts.astype(np.uint64))))
    summary.settle()
    true = collections.Counter(x for part in parts for x in part)
    left = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert summary.error < threshold and len(left) <= summary.capacity
    assert all(left[k] <= true[k] <= left[k] + summary.error for k in left)
    assert {k for k, v in true.items() if v >= threshold} <= {k for k, v in left.items() if v + summary.error >= threshold}


def test_small_summaries_drop_and_still_keep():
    rng = np.random.default_rng(1)
    stream = np.concatenate([rng.integers(1000, 1 << 40, 50_000), np.repeat(np.arange(5), 600)]).astype(np.uint64)
    rng.shuffle(stream)
    summary = collocations.Summary(len(stream) // 500 + 1)
    for part in np.array_split(stream, 40):
        keys, counts = np.unique(part, return_counts=True)
        summary.take(keys, counts.astype(np.uint64))
    summary.settle()
    assert 0 < summary.error < 500 and len(summary.keys) <= summary.capacity
    assert set(range(5)) <= set(summary.keys.tolist())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.\n\t", max_size=200), st.integers(1, 30))
def test_cuts_end_at_piece_ends(text, limit):
    parts = list(collocations._cut(text.encode(), limit))
    assert b"".join(parts) == text.encode()
    assert all(p[-1:] in b".\n" for p in parts[:-1])


# --- Merkle manifests -------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root, and per leaf its siblings with their sides, from the leaf up."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            b = a ^ 1
            steps[i].append(None if b >= len(level) else (b < a, level[b]))
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [a // 2 for a in at]
    return level[0], steps


def plain_manifest(rows):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(code, r))
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        r = (doc_id, source, lang, n_chars, text)
        changed = r if doc_id is None or n_chars is None or zlib.crc32(str(doc_id).encode()) % 7 else (*r[:3], n_chars + 1, text)
        groups[lang].append((doc_id, leaf(r), leaf(changed)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, bytes.fromhex(x[1])))
        trees[lang] = plain_tree([x[1] for x in groups[lang]])
    root, upper = plain_tree([trees[x][0] for x in order])
    out = []
    for lang, above in zip(order, upper):
        for (doc_id, original, changed), steps in zip(groups[lang], trees[lang][1]):
            path = [*steps, *above]
            node = changed
            for s in path:
                node = sha(node) if s is None else sha(s[1], node) if s[0] else sha(node, s[1])
            proof = sha(*[s[1] for s in path if s is not None])
            out.append((doc_id, original, trees[lang][0], root, proof, node, node == root))
    return sorted(out, key=str)


def found_manifest(spark, rows, p):
    docs = spark.createDataFrame(rows, DDL).withColumn("key", F.lit("x")).withColumn("rank", F.lit(1)).repartition(4)
    found = merkle.proved_documents(docs, p)
    proof = F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256)
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    hexed = [merkle.hex_of(F.col(c)) for c in ("leaf", "top", "root")]
    got = found.select("doc_id", *hexed, proof.alias("proof"), folded.alias("folded"), (folded == hexed[2]).alias("ok"))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest(spark, bits):
    langs = [None, "", "en", "de", "zz", "日本", "~"]
    sizes = [5, 1, 37, 64, 2, 3, 300 if bits == 8 else 9]
    rows = [(1000 * k + i, f"text {i}", lang, None if i % 5 == 0 else "s", None if i % 4 == 0 else i) for k, (lang, n) in enumerate(zip(langs, sizes)) for i in range(n)]
    rows += [(7, "same id", "en", "s", 1), (7, "same id, other text", "en", "s", 1), (7, "same id", "en", "s", 1)]
    assert found_manifest(spark, rows, merkle.ManifestParams(bits)) == plain_manifest(rows)


def test_manifest_of_odd_and_empty_tables(spark, empty):  # noqa: F811
    rows = awkward()
    assert found_manifest(spark, rows, merkle.DEFAULT) == plain_manifest(rows)
    assert found_manifest(spark, [(1, "alone", "en", "a", 1)], merkle.DEFAULT) == plain_manifest([(1, "alone", "en", "a", 1)])
    assert merkle.proved_documents(empty).count() == 0


def test_paths_of_some_leaves(spark):
    rows = [(i, f"t{i}", "ab"[i % 2], "s", i) for i in range(100)]
    m = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, DDL)), merkle.ManifestParams(3))
    asked = m.leaves.where("id % 20 = 3").select("key", "rank", F.struct("id").alias("carry"))
    got = {r["id"]: r["up"] for r in merkle.proofs(m, asked).select("carry.id", merkle.fold(F.col("digest"), F.col("path")).alias("up")).collect()}
    assert set(got) == {3, 23, 43, 63, 83} and set(got.values()) == {plain_manifest(rows)[0][3]}


def test_ranks_of_equal_rows(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "hot").otherwise("cold").alias("key"), (F.col("id") % 2).alias("x")).repartition(6)
    got = merkle.ranked(rows, "key", "x").collect()
    for key, n in (("hot", 5000), ("cold", 1000)):
        own = sorted((r["rank"], r["x"]) for r in got if r["key"] == key)
        assert [r for r, _ in own] == list(range(n)) and [x for _, x in own] == sorted(x for _, x in own)
        assert {r["n"] for r in got if r["key"] == key} == {n}


# --- embedding copies -------------------------------------------------------------------------


def plain_near(rows, threshold):
    unit = []
    for vec_id, v, label in rows:
        ok = vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    linked = collections.defaultdict(set)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = unit[i], unit[j]
        if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
            linked[i].add(j), linked[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in linked[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        least = None if vec_id is None else min(rows[k][0] for k in seen)
        out.append((vec_id, len(linked[i]), least))
    return sorted(out, key=str)


def near_rows(rng, dim=24):
    rows, k = [], 0
    for label in (1, 2, None):
        centre = rng.normal(size=dim)
        for spread, n in ((0.1, 60), (0.02, 30), (0, 25)):
            base = centre if spread == 0.1 else rng.normal(size=dim)
            for _ in range(n):
                rows.append((k, (base + spread * rng.normal(size=dim)).tolist(), label))
                k += 1
    rows += [(k + i, rng.normal(size=dim).tolist(), 1) for i in range(80)]
    odd_rows = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0] * 3, [2.0] * 3, [1e-30] * dim, [1e30] * dim]
    rows += [(9000 + i, v, 1) for i, v in enumerate(odd_rows)]
    return rows + [(None, rows[0][1], 1), (0, rows[0][1], 1), (0, rows[0][1], 1), (5, rows[200][1], 1)]


@pytest.mark.parametrize("block, kind", [(512, "double"), (7, "float")])
def test_near_vectors(spark, block, kind):
    rows = near_rows(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    if kind == "float":
        df = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
        rows = [tuple(r) for r in df.collect()]
    for clash in ("node", "key", "vec", "root", "n_links", "side"):
        df = df.withColumn(clash, F.lit("x"))
    p = lattice.LatticeParams(block=block)
    got = sorted(map(tuple, lattice.near_vectors(df.repartition(3), p).collect()), key=str)
    assert got == plain_near(rows, p.threshold)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    assert lattice.near_vectors(df).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * 2
    found = lattice.lattice_points(x)
    steps = lattice.shortest_steps()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    twice = 2 * found
    assert np.array_equal(twice, np.rint(twice)) and (found.sum(1) % 2 == 0).all()
    near = ((x - found) ** 2).sum(1)
    assert (near <= 1 + 1e-9).all()  # the covering radius
    assert (near[:, None] <= ((x[:, None] - found[:, None] - steps[None]) ** 2).sum(2) + 1e-9).all()


def test_recall_of_cells():
    """Random pairs at the threshold itself share a cell of the five tables nearly always, others hardly ever."""
    rng, p, n = np.random.default_rng(8), lattice.DEFAULT, 3000
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(n, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = p.threshold * a + np.sqrt(1 - p.threshold**2) * side
    label = np.zeros(n, np.uint64)
    x, y = (lattice.cell_keys(v, label, p) for v in (a, b))
    share = lambda u, v: (u[:, :, None] == v[:, None]).any((1, 2)).mean()
    assert share(x, y) > 0.999
    assert share(x, np.roll(x, 1, 0)) < 0.002


# --- n-gram join: groups that share a passage --------------------------------------------------


def plain_links(texts, threshold=0.8):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for token in s:
            holders[token].append(k)
    common = collections.Counter(pair for ks in holders.values() for pair in itertools.combinations(sorted(ks), 2))
    linked = collections.defaultdict(set)
    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            linked[a].add(b), linked[b].add(a)
    out = {}
    for k in texts:
        seen, todo = {k}, [k]
        while todo:
            for x in linked[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        out[k] = (min(seen), len(linked[k]))
    return out


@pytest.mark.parametrize("n", [500, 1000])
def test_passage_in_many_unlike_texts(spark, n, monkeypatch):
    """Unlike texts that share a passage, and pairs of near copies among them, end in small buckets."""
    passage = words(1, 60)
    texts = {i: " ".join(words(10 + i, 33) + passage + words(10_000 + i, 33)) for i in range(n)}
    for i in range(0, n, 25):
        w = texts[i].split()
        w[3], w[-2] = f"edit{i}", f"edit{i + 1}"
        texts[20_000 + i] = " ".join(w)
    kept = []
    real = ngram_join._buckets

    def watched(nodes, p):
        small, dense = real(nodes, p)
        kept.append((small.count(), 0 if dense is None else dense.groupBy("path").count().agg(F.max("count")).first()[0] or 0))
        return small, dense

    monkeypatch.setattr(ngram_join, "_buckets", watched)
    docs = spark.createDataFrame([*texts.items()], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == plain_links(texts)
    assert kept[0][1] < n / 3


@pytest.mark.parametrize("n", [300])
def test_near_copies_beside_a_shared_passage(spark, n):
    base, passage = words(77, 150), words(1, 60)
    texts = {}
    for i in range(n):
        w = list(base)
        for k in range(i % 5):
            w[(13 * i + 31 * k) % len(w)] = f"edit{i}x{k}"
        texts[i] = " ".join(w + passage[: 20 * (i % 2)])
        texts[1000 + i] = " ".join(words(500 + i, 80) + passage)
    docs = spark.createDataFrame([*texts.items()], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == plain_links(texts)


def test_rows_of_one_id_with_other_texts(spark):
    a, b = " ".join(words(1, 50)), " ".join(words(2, 50))
    rows = [(1, a, "en", "y", 1), (1, b, "en", "x", 1), (1, a, "en", "x", 1), (2, b, "de", "x", 2), (3, None, "en", "x", 0), (3, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, DDL)
    got = collections.Counter((r["doc_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == {(1, 1): 3, (2, 1): 1, (3, 0): 2}
    left = [tuple(r) for r in ngram_join.deduplicated(docs).collect()]
    assert len(left) == 3 and (1, a, "en", "x", 1) in left and (1, b, "en", "x", 1) in left
