"""Periodic runs of words: all maximal stretches that repeat with a smallest period, found by block matching.

A text's words become numbers. At every scale B (8, 16, 32, ...) the aligned blocks of B words are the integer-sequence keys of an
Aho-Corasick automaton, which is run over the text; an occurrence of a block at a distance from B to 2 B - 1 behind it (1 to 15 at the
first scale) seeds an extension to both sides, word by word, which gives the maximal stretch of that period. A run of length
max(LEAST, POWER * period) or more holds an aligned block of its scale and the block's next occurrence, so none is missed. At larger scales a key's
letters are names of stretches of B / 8 words, doubled from scale to scale, as the automaton takes time in proportion to a key's length at each letter
where texts repeat.

What keeps a text's work near n log n: only stretches whose every eight words recur somewhere in the text are searched (a run's do);
seeds within one run of a shorter period are skipped, as their stretch is that run again; of seeds between two such runs only those
that bring the runs' starts or ends together are extended, as others break off too early; a seed within a stretch just found is skipped.

One map pass over documents, no shuffle; a text's numbers take some 60 bytes a word while it is at work.
Words are cut at ASCII white space and compared as they are. Defined cases: null or empty text has no words, no runs and an empty collapsed
text; texts count whole; repeated rows give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.common import bounded_batches

LEAST, POWER, BASE, RADIX = 24, 3, 8, 64
PIECE = 4 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The text's words as numbers, and the words of the numbers. Long texts are cut at white space, a piece at a time."""
    words, parts, at = _Words(), [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        piece = data[at:end].split()
        parts.append(np.fromiter(map(words.__getitem__, piece), np.int32, len(piece)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(words)


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def recurring(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of at least `least` words in which every BASE successive words recur somewhere in the text (or seem to, by their hash)."""
    m = len(ids) - BASE + 1
    if m + BASE - 1 < least:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = np.zeros(m, np.uint64)
    for j in range(BASE):
        grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[j : m + j]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(m, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return [(a, b + BASE - 1) for a, b in _stretches(again) if b - a >= least - BASE + 1]


def _matches(names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of BASE * step words, by the names that their places' stretches of `step` words have. -> for every place, the number of the aligned block
    that occurs there, or -1; and the numbers of the aligned blocks in their order.

    A key is a block's BASE names, step apart, so that it is short at all scales; the text is read in `step` rows of names step apart. A name is
    written as digits below RADIX, as the automaton looks through a node's children one by one; matches that start within a name don't count."""
    block, top = BASE * step, int(names.max()) + 1
    size, columns = 1, -(-len(names) // step) + 1
    while RADIX**size <= top:
        size += 1
    rows = np.full(columns * step, top, np.int64)  # no key holds `top`, which ends the rows
    rows[: len(names)] = names
    rows = rows.reshape(columns, step).T.ravel()
    digits = lambda x: tuple(np.stack([x // RADIX**k % RADIX for k in range(size)], 1).ravel().tolist())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    aligned = np.arange(0, len(names) - block + step, block)
    for k, p in enumerate(aligned.tolist()):
        automaton.add_word(digits(names[p : p + block : step]), k)  # the last of equal blocks names them
    automaton.make_automaton()
    found = np.array(list(automaton.iter(digits(rows))), np.int64).reshape(-1, 2)
    found = found[found[:, 0] % size == size - 1]
    row, column = np.divmod(found[:, 0] // size - BASE + 1, columns)
    at = np.full(len(names), -1, np.int64)
    at[column * step + row] = found[:, 1]
    return at, at[aligned]


def _doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of the stretches of 2 * step words from those of step words: equal names, equal words."""
    return np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True)[1]


def _seeds(names: np.ndarray, step: int, nearest: int, farthest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of aligned blocks and their occurrences from nearest to farthest behind them."""
    at, aligned = _matches(names, step)
    block, width = BASE * step, len(names) + 2 * farthest + 1
    places = np.flatnonzero(at >= 0)
    keys = at[places] * width + places
    keys.sort()
    own = np.arange(len(aligned)) * block
    first = np.searchsorted(keys, aligned * width + own + nearest)
    count = np.searchsorted(keys, aligned * width + own + farthest, "right") - first
    place = np.repeat(own, count)
    hit = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    return place, keys[hit] % width - place


def _reach(seq: np.ndarray, p: int, d: int) -> tuple[int, int]:
    """The maximal range of places i around p with seq[i] == seq[i + d]."""
    n, step, hi = len(seq) - d, 32, p
    while hi < n:
        off = np.flatnonzero(seq[hi : min(n, hi + step)] != seq[hi + d : min(n, hi + step) + d])
        if len(off):
            hi += int(off[0])
            break
        hi, step = min(n, hi + step), step * 2
    step, lo = 32, p
    while lo > 0:
        a = max(0, lo - step)
        off = np.flatnonzero(seq[a:lo] != seq[a + d : lo + d])
        if len(off):
            lo = a + int(off[-1]) + 1
            break
        lo, step = a, step * 2
    return lo, hi


def _search(seq: np.ndarray, least: int, power: int) -> dict[tuple[int, int], int]:
    """(start, end) of the runs of seq -> smallest period."""
    runs, names, step = {}, seq, 1
    while (1 if step == 1 else BASE * step) * power <= len(seq):
        block = BASE * step
        nearest, farthest = 1 if step == 1 else block, min(2 * block - 1, len(seq) // power)
        place, distance = _seeds(names, step, nearest, farthest)
        short = [(s, e) for (s, e), q in runs.items() if 2 * q <= block and e - s >= block]
        if short:  # two such runs never share a block
            start, end = np.array([*short, (-1, -1)]).T
            within = np.full(len(seq), -1, np.int64)
            for k, (s, e) in enumerate(short):
                within[s : e - block + 1] = k
            one, two = within[place], within[place + distance]
            free = (one < 0) | (two < 0)
            keep = free | ((one != two) & ((distance == end[two] - end[one]) | (distance == start[two] - start[one])))
            place, distance = place[keep], distance[keep]
        order = np.lexsort((place, distance))
        last, until = 0, 0
        for p, d in zip(place[order].tolist(), distance[order].tolist(), strict=True):
            if d == last and p < until:
                continue
            lo, hi = _reach(seq, p, d)
            last, until = d, hi
            if hi + d - lo >= max(least, power * d):
                runs.setdefault((lo, hi + d), d)  # the same stretch by a shorter period came before
        names, step = _doubled(names, step), 2 * step
    return runs


def find_runs(ids: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches with smallest period q and length of at least max(least, power * q), by start, then
    period. `least` is 3 * BASE or more and `power` 3 or more."""
    if least < 3 * BASE or power < 3:
        raise ValueError("runs are searched from 24 words and three periods on")
    found = []
    for a, b in recurring(ids, least):
        own = np.unique(ids[a:b], return_inverse=True)[1]
        found += [(a + s, e - s, q) for (s, e), q in _search(own, least, power).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Flags of the n words that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """docs (doc_id, text) -> FOUND: a text's runs, and the text with every run cut down to its first period, words joined by one space."""
    bounded_batches(docs.sparkSession)

    def one(data: bytes) -> tuple[int, list, bytes]:
        ids, words = numbered(data)
        runs = find_runs(ids, least, power)
        kept = ids[kept_words(len(ids), runs)] if runs else ids
        return len(ids), runs, b" ".join(map(words.__getitem__, kept.tolist()))

    def run(batches):
        for b in batches:
            sizes, found, texts = [], [], []
            for data in b.column(1).cast(pa.binary()).to_pylist():
                n, runs, text = one(data or b"")
                sizes.append(n)
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)
