import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from stepfield.llm import importance, lines, periodic, q_importance, q_lines, q_periodic

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# lines


def slow_lines(rows, least_chars=40, least_docs=5):
    """(doc_id, n_lines, n_dropped, kept text) by rows (doc_id, text)."""
    holders = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    rank = lambda i: -1 if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(rank(i))
    shared = {k: max(v) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if shared.get(key(x), rank(i)) == rank(i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def line_fixture():
    rng = random.Random(3)
    common = [f"A line that many documents share, number {k} of them all" for k in range(6)]
    exact = ["x" * 40, "x" * 39, "É" * 40, "é" * 40]  # the last two differ: only A-Z is lower-cased
    rows = []
    for i in range(60):
        own = [f"own line {i}.{j}" for j in range(rng.randrange(4))]
        own += [rng.choice([c, c.upper(), "\t " + c + "\r", c + " "]) for c in common if rng.random() < 0.3]
        own += [e for e in exact if rng.random() < 0.5]
        rng.shuffle(own)
        rows.append((i * 7 % 61, "\n".join(own)))
    rows += [(100, common[0] + "\n" + common[0] + "\n"), (101, "\n\n"), (102, ""), (103, None), (None, common[1]), (None, common[1] + "\n" + common[2])]
    rows += [rows[5], (104, "\n".join([common[3]] * 3000 + ["end"])), (104, common[4])]
    return rows


@pytest.mark.parametrize("heavy_rows", [1000, 3])
def test_line_dedup(spark, shared, heavy_rows):
    rows = line_fixture()
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), heavy_rows=heavy_rows)
    got = sorted(map(str, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect())))
    assert got == sorted(map(str, slow_lines(rows)))
    assert any(r[2] for r in slow_lines(rows))


def test_line_bitmaps(spark, shared):
    shared_line = "this very line stands in five documents of the table"
    rows = [(i, "\n".join([shared_line, "a", "b", shared_line, shared_line, "c"])) for i in range(5)]
    bitmaps = lines.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_dropped, r.runs) for r in bitmaps.collect()} == {i: (3, [0, 1, 2, 2]) for i in range(4)}


def test_line_edges(spark, docs, empty, shared):
    clash = docs.withColumnsRenamed({"fp": "_id", "score": "_runs", "lang": "kept_text", "source": "n_lines"})
    found = lines.dedup_lines(clash)
    assert found.columns == ["doc_id", "text", "n_chars", "_id", "_runs", "n_lines", "n_dropped", "kept_text"]
    want = slow_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(str, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()))) == sorted(map(str, want))
    assert lines.dedup_lines(empty).count() == 0


def test_line_query_is_native(spark, sf, shared):
    plan = q_lines.op13_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


# periodic runs


def slow_runs(ids, least=24, power=3):
    """All maximal stretches by every period."""
    ids, found = np.asarray(ids), {}
    for q in range(1, len(ids) // power + 1):
        flags = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(flags))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + q >= max(least, power * q):
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    """Numbers with runs of many periods, runs side by side, runs within runs, gaps of one word."""
    alphabet = rng.choice([1, 2, 3, 50])
    out = []
    for _ in range(rng.randrange(1, 6)):
        root = [rng.randrange(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
        if rng.random() < 0.3:
            root = root * rng.randrange(2, 6) + [99]
        size = int(len(root) * rng.uniform(1.5, 6)) + rng.randrange(30)
        out += [root[k % len(root)] for k in range(size)]
        out += [rng.randrange(alphabet + 3) for _ in range(rng.choice([0, 0, 1, 2, 20]))]
    return out


def test_runs_of_random_texts():
    rng, seen = random.Random(11), 0
    for _ in range(600):
        ids = periodic_text(rng)
        want = slow_runs(ids)
        assert periodic.find_runs(np.array(ids, np.int32)) == want
        seen += len(want)
    assert seen > 600


def test_runs_of_special_texts():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 700:
        fibonacci, before = fibonacci + before, fibonacci
    thue = [bin(k).count("1") % 2 for k in range(1024)]
    two = ([0, 1] * 200 + [2]) * 4
    for ids in (fibonacci, thue, two, [0] * 500, [0] * 23, [0] * 24, [0, 1, 2, 3, 4, 5, 6, 7] * 3, list(range(9)) * 2 + list(range(8)), []):
        assert periodic.find_runs(np.array(ids, np.int32)) == slow_runs(ids)


def test_runs_of_long_texts_take_near_linear_time():
    import time

    one = np.zeros(200_000, np.int32)
    gaps = np.tile(np.array([0, 1], np.int32), 100_000)
    gaps[100_001] = 2
    again = np.tile(np.arange(50_000, dtype=np.int32), 4)
    for ids, runs in ((one, [(0, 200_000, 1)]), (gaps, [(0, 100_001, 2), (100_002, 99_998, 2)]), (again, [(0, 200_000, 50_000)])):
        began = time.time()
        assert periodic.find_runs(ids) == runs
        assert time.time() - began < 20


def slow_looped(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def slow_row(doc_id, text):
    words = slow_looped(doc_id, text)
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = slow_runs([numbers[w] for w in words])
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_periodic_query_against_every_period(spark, sf):
    found = q_periodic.op12_periodic_runs(spark, sf)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(slow_row(r.doc_id, r.text) for r in rows)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_periodic_edges(spark, docs, empty, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = q_periodic.op12_periodic_runs(spark, str(tmp_path))
    want = [slow_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert periodic.periodic_runs(empty).count() == 0
    monkeypatch.setattr(periodic, "PIECE", 7)
    assert [w for w in map(periodic.numbered(b"ab cd\n ab\tlongerword ef ab")[1].__getitem__, periodic.numbered(b"ab cd\n ab\tlongerword ef ab")[0])] == [b"ab", b"cd", b"ab", b"longerword", b"ef", b"ab"]


# importance resampling


def slow_features(text, longest=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in runs]


def slow_resample(docs, target, longest=2):
    made = [(i, *slow_features(t, longest)) for i, t in docs]
    of = [b for t in target for b in slow_features(t, longest)[1]]
    own = [b for _, _, f in made for b in f]
    s, t = np.bincount(own, minlength=10000).tolist(), np.bincount(of, minlength=10000).tolist()
    gain = [math.floor(1000 * math.log((y + 1) * (len(own) + 10000) / ((x + 1) * (len(of) + 10000)))) for x, y in zip(s, t, strict=True)]
    out, able = [], []
    for i, words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= 20:
                able.append((-score, i))
        out.append([i, len(f), weight, score, None])
    for rank, (_, i) in enumerate(sorted(able)[: 25 * len(able) // 100], 1):
        next(r for r in out if r[0] == i and r[4] is None)[4] = rank
    return out


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_crc_ring(longest):
    words = "a small  Test, of é漢 ring".translate(LOWER).replace(",", " ").encode().split()
    want = sorted(zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    assert sorted(importance.crc_ring(words, longest)) == want


def test_resampling(spark, docs, empty, shared):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "漢字", "A", "x_y"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([19, 20, 21, 60])))) for k in range(200)]
    rows += [(1000 + i if i is not None else None, t) for i, t in ((r.doc_id, r.text) for r in docs.distinct().collect())]
    target = [" ".join(rng.choices(vocabulary[:9], k=30)) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS weight")
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    found = importance.resample(frame, goal).select("doc_id", "n_features", "weight", "score", "rank")
    want = slow_resample(rows, target)
    assert sorted(map(str, map(list, found.collect()))) == sorted(map(str, want))
    assert sum(r[4] is not None for r in want) >= 30
    assert importance.resample(empty, goal).count() == 0
    assert importance.resample(frame, empty).count() == len(rows)


def test_equal_scores_are_ranked_by_doc_id(spark):
    scored = spark.createDataFrame([(i, 30, i // 10) for i in range(40)] + [(99, 3, 50), (None, 30, None)], "doc_id long, n_words long, score long")
    got = {r.doc_id: r["rank"] for r in importance.draw(scored, 35).collect()}
    order = [*range(30, 40), *range(20, 24)]
    assert {k: v for k, v in got.items() if v} == {i: k for k, i in enumerate(order, 1)}


def test_resampling_query_counts_all(spark, sf, shared):
    found = q_importance.op11_importance_resampling(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(list, found.collect()), key=lambda r: r[0]) == sorted(slow_resample([tuple(r) for r in docs], target))
