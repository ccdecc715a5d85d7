"""Near copies against brute force, in every way that links are found and verified."""

import numpy as np
import pytest

from stepfield.llm import nearcopies

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = nearcopies.plain_words((text or "").encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited_texts():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmn"), rng.integers(3, 9))) for _ in range(3000)]
    rows = []
    for i in range(150):
        base = rng.choice(words, 110).tolist()
        rows.append((2 * i, " ".join(base)))
        for at in rng.choice(110, 2, replace=False):
            base[at] = str(rng.choice(words))
        rows.append((2 * i + 1, " ".join(base)))
    return rows


def test_every_pair_of_similarity_is_linked(spark, shared):
    rows = edited_texts()
    sets = [shingles(t) for _, t in rows]
    alike = [i for i in range(0, len(rows), 2) if similarity(sets[i], sets[i + 1]) >= 0.8]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(alike) > 100 and sum(got[i] == got[i + 1] for i in alike) >= 0.98 * len(alike)
    assert all(got[i] == i for i in range(0, len(rows), 2))


@pytest.mark.parametrize("limit", [4, 1024])
def test_components_in_slices(spark, shared, limit):
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], "other", *base[i + 1 :]])) for i in range(0, 200, 5)] + [(900, ""), (901, None), (902, "no copy of these at all")]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA), bucket_limit=limit, group_limit=limit).collect()}
    assert got == {i: 0 for i in range(0, 200, 5)} | {900: 900, 901: 900, 902: 902}


def test_links_do_not_depend_on_the_limit(spark, shared):
    """Chains in which only near ones agree, shuffled, and pairs that agree in 70 % without a common band: the same sets at any limit, those of brute force."""
    rng = np.random.default_rng(4)
    sigs = [(0, row) for chain in range(2) for row in [rng.integers(0, 256, nearcopies.HASHES)]]
    for k in range(80):
        c, row = sigs[-2]
        row = row.copy()
        row[24 + rng.choice(104, 9, replace=False)] = rng.integers(0, 256, 9)
        sigs.append((0, row))
    for k in range(5):
        row = rng.integers(0, 256, nearcopies.HASHES)
        other = row.copy()
        other[:: nearcopies.BAND] ^= 1
        sigs += [(1 + k, row), (1 + k, other)]
    nodes = rng.permutation(len(sigs))
    rows = [(int(n), c, bytearray(r.astype(np.uint8).tobytes())) for n, (c, r) in zip(nodes, sigs, strict=True)]

    def sets(links):
        least = {n: n for n, _, _ in rows}
        for _ in rows:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    m = {n: (c, np.frombuffer(s, np.uint8)) for n, c, s in rows}
    banded = lambda x, y: (x == y).reshape(-1, nearcopies.BAND).all(1).any()
    pairs = [(a, b) for a in m for b in m if a < b and m[a][0] == m[b][0] and banded(m[a][1], m[b][1]) and (m[a][1] == m[b][1]).mean() >= nearcopies.AGREE]
    df = spark.createDataFrame(rows, "node long, component long, sig binary")
    for limit in (4, 1024):
        assert sets([(r.a, r.b) for r in nearcopies.verified_links(df, limit).collect()]) == sets(pairs)


def test_recall_and_precision_on_a_table(spark, shared):
    """sf0.01: every pair of similarity 0.8 is in one component, and what a component holds besides is linked through pairs above 0.6."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    sets, places = {i: shingles(t) for i, t in texts.items()}, {}
    for i, s in sets.items():
        for x in s:
            places.setdefault(x, []).append(i)
    near, parent = set(), {i: i for i in texts}
    for same in places.values():
        near |= {(same[0], j) for j in same[1:]} if len(same) > 60 else {(i, j) for k, i in enumerate(same) for j in same[k + 1 :]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    alike = {p: similarity(sets[p[0]], sets[p[1]]) for p in near}
    wanted = [p for p, s in alike.items() if s >= 0.8]
    assert wanted and all(got[a] == got[b] for a, b in wanted)
    for (a, b), s in alike.items():
        if s >= 0.6:
            parent[root(a)] = root(b)
    assert all(root(i) == root(c) for i, c in got.items())
    kept = {r.doc_id for r in nearcopies.keep_one(docs).collect()}
    assert kept == set(got.values())


def test_rows_of_one_id_nulls_and_repeats(spark, docs, empty, shared):
    rows = [(1, "a text of one id"), (1, "another text of that id"), (2, "a text, of one id!"), (None, "a text of one id"), (None, "only here"), (None, "only here"), (3, "#### ####"), (4, "$$ $$"), (5, ""), (6, None), (7, " \n ")]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "a text of one id"), (1, "another text of that id"), (None, "only here"), (3, "#### ####"), (4, "$$ $$"), (5, "")], key=str)
    once = nearcopies.keep_one(docs)
    assert once.columns == docs.columns and once.schema == docs.schema
    assert sorted(r.text or "" for r in once.collect()) == sorted({r.text or "": 0 for r in docs.collect() if (r.text or "").strip() or r.text == ""})
    assert nearcopies.keep_one(empty).count() == 0 and nearcopies.near_copies(empty).count() == 0


def test_fingerprints_and_hashes_of_short_texts():
    for words in ([], [b"a"], [b"a", b"b", b"c"]):
        h = np.array([hash(w) % (1 << 63) for w in words], np.uint64)
        assert nearcopies.word_fingerprints(h).shape == (nearcopies.KINDS,) and nearcopies.minimum_hashes(h).shape == (nearcopies.HASHES,)
