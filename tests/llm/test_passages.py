"""Short, repetitive and common passages against brute force."""

import time

import numpy as np
import pytest

from stepfield.llm import decontaminate, q_decontaminate
from tests.llm.test_text_operators import edit_distance_in


def found(items, texts):
    index = decontaminate.build_index([(i, decontaminate.normalise(x)) for i, x in enumerate(items)])
    return {(t, i): e for t, i, e, _ in decontaminate.find(texts, index)}, index


def wanted(items, texts, index):
    out = {}
    for t, text in enumerate(texts):
        plain = decontaminate.normalise(text)
        for i, x in enumerate(items):
            item = decontaminate.normalise(x)
            if len(item) < decontaminate.LEAST_BYTES:
                if f" {item.decode()} " in f" {plain.decode()} ":
                    out[t, i] = 0
            elif (d := edit_distance_in(item, plain)) <= index.budget[i]:
                out[t, i] = d
    return out


def test_short_passages_are_found_whole():
    items = ["What is the capital of Peru?", "42", "ab", "x y", "Éa!", "What is the capital of Peru", "sixteen letters!", "a" * 20]
    texts = ["so: what is the Capital of PERU", "what is the capital of perus", "142 42 ", "abc ab", "x  y", "y x y x", "éA", "", None, "sixteen lettersx", "sixteen letters", "a" * 21, "a" * 20 + " b", "42"]
    got, index = found(items, texts)
    assert got == wanted(items, texts, index) and (0, 0) in got and (0, 5) in got and (1, 0) not in got
    assert [w for t, i, _, w in decontaminate.find(["one 42 two 42"], index) if i == 1] == [1]


@pytest.mark.parametrize("hot,repeats,rows", [(64, 16, 1 << 21), (2, 16, 50), (1, 3, 7)])
def test_repetitive_and_common_passages(monkeypatch, hot, repeats, rows):
    monkeypatch.setattr(decontaminate, "HOT", hot)
    monkeypatch.setattr(decontaminate, "REPEATS", repeats)
    monkeypatch.setattr(decontaminate, "SLICE", rows)
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abc"), 5)) for _ in range(12)]
    say = lambda k: " ".join(rng.choice(words, k))
    common = "which of the following statements is right "
    items = ["z" * 60, "ab" * 40, "one two " * 12, *(common + say(6) for _ in range(6)), say(14), "q" * 33]

    def damaged(x, edits):
        s = list(x)
        for at in rng.choice(len(s), edits, replace=False):
            s[at] = rng.choice(["", "k", s[at] + "k"])
        return "".join(s)

    texts = [f"{say(5)} {damaged(x, e)} {say(4)}" for x in items for e in (0, 3, 6, 9)] + ["z" * 200, "z" * 30 + " " + "z" * 29, "q" * 32, "ab" * 39 + "a", common, ""]
    got, index = found(items, texts)
    assert got == wanted(items, texts, index)


def test_equal_letters_take_little_time():
    index = decontaminate.build_index([(1, b"a" * 400), (2, b"xy" * 200)])
    for text in ("a" * 100_000, ("a" * 390 + " ") * 250, "xy" * 50_000, "xya" * 30_000):
        began = time.process_time()
        decontaminate.find([text], index)
        assert time.process_time() - began < 1


def test_query_against_brute_force(spark, sf):
    """Every passage of the benchmark with every text that shares eight of its words in a row, or a sixth of its length without an edit."""
    docs = {r.doc_id: decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in q_decontaminate.op3_benchmark_decontamination(spark, sf).collect()}
    want = {}
    for i, item in bench.items():
        k = len(item) // 10
        pieces = [item[len(item) * j // (k + 1) : len(item) * (j + 1) // (k + 1)] for j in range(k + 1)]  # one of k + 1 pieces is unharmed by k edits
        for d, text in docs.items():
            if any(p in text for p in pieces):
                edits, _ = decontaminate._best_place(item, text)
                if edits <= k:
                    want[d, i] = edits
    assert got == want and got


def test_best_place_is_the_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = ("".join(rng.choice(list("ab "), n)).encode() for n in (9, 40))
        assert decontaminate._best_place(item, text)[0] == edit_distance_in(item, text)


def table_of_costs(item, text):
    """(least edits, first end) by the whole table."""
    t, slope = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    cost = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item, 1):
        new = cost + 1
        np.minimum(new[1:], cost[:-1] + (t != c), out=new[1:])
        new[0] = i
        cost = np.minimum.accumulate(new - slope) + slope
    return int(cost.min()), int(cost.argmin())


@pytest.mark.parametrize("often", [0, 8])
def test_long_passages_against_the_whole_table(monkeypatch, often):
    """With few edits tried first, on narrowed diagonals: the least edits and the first end, up to the budget and never below it."""
    monkeypatch.setattr(decontaminate, "LONG", 30)
    monkeypatch.setattr(decontaminate, "OFTEN", often)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(words, k))
    for n in range(120):
        item = say(rng.integers(20, 200)) if n % 4 else "ab" * int(rng.integers(20, 200))
        k, s = len(item) // 10, list(item)
        for at in rng.choice(len(s), rng.integers(0, k + 3), replace=False):
            s[at] = rng.choice(["", "k", s[at] + "k"])
        twice = "".join(s) if n % 3 == 0 else ""
        text = f"{say(rng.integers(0, 90))} {''.join(s)} {say(rng.integers(0, 90))} {twice}".encode()
        want, got = table_of_costs(item.encode(), text), decontaminate._best_place(item.encode(), text, k)
        assert got == want if want[0] <= k else got[0] > k


def test_edited_copies_of_a_long_passage_take_little_time():
    """Passages of 20 and 100 kB, copies with a word in sixty changed, and unrelated texts of the same words."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(2, 9))) for _ in range(5000)])
    p = 1 / np.arange(1, 5001)
    for n, copies, seconds in ((3000, 8, 4), (17000, 4, 8)):
        passage = rng.choice(words, n, p=p / p.sum())
        texts = [" ".join(rng.choice(words, n, p=p / p.sum()))]
        for _ in range(copies):
            copy = passage.copy()
            copy[rng.choice(n, n // 60, replace=False)] = rng.choice(words, n // 60)
            texts.append("before " + " ".join(copy) + " behind")
        index = decontaminate.build_index([(1, decontaminate.normalise(" ".join(passage)))])
        began = time.process_time()
        got = decontaminate.find(texts, index)
        assert time.process_time() - began < seconds
        assert [t for t, *_ in got] == list(range(1, copies + 1)) and all(0 < e <= n // 60 * 9 and w == n for _, _, e, w in got)
