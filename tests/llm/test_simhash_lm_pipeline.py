import importlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from stepfield.llm import graph, lm, q_lm, q_simhash, secrets, simhash


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def test_masks_cover_every_difference():
    masks = simhash.covering_masks()
    assert len(masks) == 31
    rng = np.random.default_rng(0)
    for _ in range(3000):
        bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & bits == 0 for m in masks)


def test_spanning_links():
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 60, 5, dtype=np.int64)]
    for _ in range(60):
        fps.append(fps[int(rng.integers(len(fps)))] ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(1, 6)), replace=False)))
    fps = list(dict.fromkeys(fps))
    links = simhash.spanning_links(np.array(fps, np.int64), 4)
    assert len(links) < len(fps) and all((a ^ b).bit_count() <= 4 for a, b in links)
    at = {f: k for k, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(at[a])] = root(at[b])
    want = slow_components(list(range(len(fps))), fps)
    assert len({root(k) for k in range(len(fps))}) == len(set(want))


def test_components(spark, shared):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (7, 7), (300, 5)]
    got = {r.a: r.b for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(1, 41), 300]} | {200: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs, empty, shared, sf):
    rows = simhash.near_duplicates(docs).collect()
    texts = docs.collect()
    fps = [slow_fingerprint(r.text or "") for r in texts]
    want = sorted((r.doc_id if r.doc_id is not None else -1, f, c) for r, f, c in zip(texts, fps, slow_components([r.doc_id for r in texts], fps), strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in rows if r.component_id is not None) == [w for w in want if w[2] is not None]
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicate_query(spark, sf, shared):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], zip(fps, slow_components([r.doc_id for r in docs], fps), strict=True), strict=True))
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in q_simhash.op7_simhash_near_dedup(spark, sf).collect()} == want


def test_large_buckets_take_the_exact_way(spark, shared):
    rng = np.random.default_rng(2)
    fps = [int(rng.integers(0, 1 << 62))]
    for _ in range(120):
        fps.append(fps[int(rng.integers(len(fps)))] ^ sum(1 << int(b) for b in rng.choice(62, 4, replace=False)))
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(0, f) for f in fps], "f int, fp long")
    sizes = []
    for limit in (2, 4096):
        found = graph.connected_components(simhash.links(df, bucket_limit=limit).select("a", "b")).collect()
        sizes.append(sorted((r.a, r.b) for r in found))
    assert sizes[0] == sizes[1]


def slow_lm(texts):
    tokens = {i: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens.items()}, tokens, train, c, n, v


@pytest.mark.parametrize("bits", [8, 2])
def test_language_model(spark, sf, shared, monkeypatch, bits):
    """With two bits a level, totals pass through several levels."""
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 5000)
    monkeypatch.setattr(lm, "BITS", bits)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    base, tokens, train, c, n, v = slow_lm(texts)
    seen = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda events, types: seen.setdefault("w", learn(events, types)))
    rows = q_lm.op6_lm_scoring(spark, sf).collect()
    pairs = Counter(p for i in train for p in zip([None, *tokens[i]], tokens[i], strict=False))
    assert len(rows) == len(texts)
    for r in rows:
        k, known, total, score = base[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (k, known, total) and abs(r.base_score - score) < 1e-6
        want = 0.0
        for h, w in zip([None, *tokens[r.doc_id]], tokens[r.doc_id], strict=False):
            w2, w1, w0 = seen["w"][int(lm.context_bucket(np.array([c[h]]))[0])]
            want += math.log10(w2 * pairs[h, w] / max(1, c[h]) + w1 * c[w] / n + w0 / (v + 1))
        assert abs(r.score - want) < 1e-6
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    np.testing.assert_allclose(seen["w"].sum(1), 1)


def parts(counts, ems=(False,)):
    keys = np.array([5, 9, 1 << 63], np.uint64)
    rows = [(1, 0, 0, k, em, lm._pack(np.diff(keys, prepend=np.uint64(0))), lm._pack(np.array(c, np.uint64)), None) for k, (c, em) in enumerate(zip(counts, ems, strict=True))]
    return lm._table(rows, lm.PARTS)


def test_counts_above_32_bits():
    big = 3_000_000_000
    sums, *rows = lm._answer(parts([[big, 1, 0], [big, 0, 0], [big, 2, 0]], [False, True, False])).to_pylist()
    assert (sums["tokens"], sums["types"], sums["em_tokens"]) == (3 * big + 3, 2, big)
    assert all(lm._unpack(r["total"], "<u8").tolist() == [3 * big, 3, 0] for r in rows)
    node = lm._merge(parts([[big, 1, 0], [big, 0, 0]], [False, True])).to_pylist()[0]
    assert lm._unpack(node["counts"], "<u8").tolist() == [2 * big, 1, 0] and lm._unpack(node["em_counts"], "<u8").tolist() == [big, 0, 0]


def test_rows_sent_grow_with_the_input(spark, shared, monkeypatch):
    """Twice the chunks, twice the rows, on both levels."""
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 60)
    monkeypatch.setattr(lm, "BITS", 2)
    sent = []
    for docs in (400, 800):
        rows = [(i, " ".join(f"w{(i * 7 + k * k) % 311}" for k in range(59))) for i in range(docs)]
        chunked = lm.written(lm.chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "lm-chunks")
        groups = -(-chunked.count() >> lm.BITS)
        first = chunked.mapInArrow(lm._send(groups), lm.PARTS)
        nodes = first.groupBy("kind", "range", "parent").applyInArrow(lm._merge, lm.NODES)
        sent.append((first.count(), nodes.mapInArrow(lm._send_on(2), lm.PARTS).count()))
    assert all(b <= 2.1 * a for a, b in zip(*sent, strict=True))


def test_language_model_edges(spark, docs, empty, shared):
    rows = q_lm.lm.score(docs).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    assert q_lm.lm.score(empty).count() == 0
    assert zlib.crc32(b"3") % 5 == 1
    row = q_lm.lm.score(spark.createDataFrame([(3, "a b")], "doc_id long, text string")).first()  # no training rows
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score <= 0


def test_pipeline(spark, sf, shared):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, rows = docs, {}
    for name, stage in pipeline.STAGES:
        at = stage(spark, at, sf)
        at.write.parquet(f"{shared}/{name}")
        at = spark.read.parquet(f"{shared}/{name}")
        rows[name] = at.collect()
        if name != pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
    names = [n for n, _ in pipeline.STAGES]
    counts = [len({r.doc_id for r in rows[n]}) for n in names]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows[names[0]]}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95
    assert len({r.text for r in rows[names[1]]}) == len(rows[names[1]])
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(b in r.text for b in bench for r in rows[names[2]])
    assert not any(secrets.HEX.search(r.text) for r in rows[names[3]]) and all(r.n_chars == len(r.text) for r in rows[names[3]])
    assert {(r.doc_id, r.piece) for r in rows[names[4]]} == {(r.doc_id, r.piece) for r in pipeline.run(spark, sf).collect()}
