"""Benchmark decontamination by the q-gram lemma.

A passage of m bytes that occurs in a text with at most k edits (a tenth of m) leaves at least m + 1 - q (k + 1) of its q-grams
unharmed, on diagonals (text place minus passage place) no more than k apart. So q-grams shared with a text are counted in bands of
2k diagonals that begin every k diagonals; a band that reaches the bound is a region, and banded alignment of the passage
in and around the region decides. Texts are compared lower-cased, with every run of other characters than letters and
digits as one blank; q-grams are 8 bytes of UTF-8, so a q-gram is one 64-bit integer and needs no hashing.

Three exact ways keep frequent q-grams from multiplying rows. Of q-grams with over HOT places, a passage leaves out as many as its
bound can be lowered by, to no less than half. A passage that repeats a q-gram more than REPEATS times is counted by text place
alone, without diagonals, and aligned with whole stretches of the text. Passages of LONG bytes or more are aligned by integers of a bit a diagonal, on the
diagonals that unharmed pieces leave for 8 edits, then for more, so that they cost their length times the edits they have, not their square. Shared q-grams are counted in slices of SLICE rows. Passages of
under `least` bytes, too short for the lemma, are looked up whole, at word boundaries and without edits, by one automaton.

The passages are a query set: texts are never shuffled or compared with each other, each task looks its texts up in an
index of passages. The passages' size is measured first; beyond `block_bytes` they are split into blocks by hash, each of
which passes over the texts in turn, so no index exceeds the bound. The driver holds the passages of all blocks.

Defined cases: null and empty texts match nothing; null passages, and those of no letter or digit, are not searched; equal passages
of several items are each reported; repeated rows are reported alike; a null doc_id stays null; of several places of a passage the
one of fewest edits counts, then the first; empty tables give no rows; further columns are ignored by `find_contamination` and kept by `drop_contaminated`.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.common import bounded_batches

Q = 8
#: Share of a passage's bytes that may be edited, and the bytes below which a passage must occur whole.
EDITS, LEAST_BYTES = 0.1, 32
#: Places beyond which a q-gram may be left out, repeats of a q-gram within a passage beyond which diagonals are not counted, and rows counted at a time.
HOT, REPEATS, SLICE = 64, 16, 1 << 21
#: Bytes from which a passage is aligned by itself instead of with others, few edits first, and places of one of its pieces beyond which the piece counts everywhere.
LONG, OFTEN = 1024, 8
BLOCK_BYTES = 8 << 20
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 22)
MATCHES = "doc_id long, item_id long, edits int, last_word long"


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(_PLAIN).split())


def _grams(data: bytes) -> np.ndarray:
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)) if len(data) >= Q else np.zeros(0, "<u8")


@dataclass
class Places:
    """For each key a run of (item, place) entries."""

    runs: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def slices(self, at: np.ndarray, slot: np.ndarray):
        """(text place, item, passage place) of all hits, SLICE rows at a time or those of one hit."""
        run = self.runs[slot + 1] - self.runs[slot]
        at, slot, run = at[run > 0], slot[run > 0], run[run > 0]
        ends, first = np.cumsum(run), 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, side="right")))
            r = run[first:last]
            entry = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + np.repeat(self.runs[slot[first:last]], r)
            yield np.repeat(at[first:last], r), self.item[entry], self.place[entry]
            first = last


@dataclass
class Index:
    """q-grams of a block of passages: sorted distinct keys, with the places of passages and the items of repetitive passages; short passages."""

    ids: list[int]
    items: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    places: Places
    repetitive: Places
    known: np.ndarray
    short: dict[str, list[int]]
    automaton: object = None

    def short_places(self, plain: bytes) -> dict[int, int]:
        """Item -> end of its first place, of the short passages."""
        if not self.short:
            return {}
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for text, own in self.short.items():
                self.automaton.add_word(f" {text} ", (text, own))
            self.automaton.make_automaton()
        text, seen = f" {plain.decode()} ", {}
        for end, (_, own) in self.automaton.iter(text):
            if own[0] not in seen:
                place = len(text[1:end].encode())
                seen |= dict.fromkeys(own, place)
        return seen


def _places(every: np.ndarray, item: np.ndarray, place: np.ndarray, keys: np.ndarray) -> Places:
    order = np.argsort(every, kind="stable")
    return Places(np.searchsorted(every[order], np.append(keys, keys[-1:] + np.uint64(1)) if len(keys) else keys, side="left").astype(np.int64), item[order], place[order])


def build_index(passages: list[tuple[int, bytes]], edits: float = EDITS, least: int = LEAST_BYTES) -> Index:
    """passages: (id, normalised text), none empty."""
    ids, items = [i for i, _ in passages], [x for _, x in passages]
    m = np.array([len(x) for x in items], np.int64)
    budget = (m * edits).astype(np.int64)
    least = max(least, 2 * Q)
    lost = (m >= least) & (m + 1 - Q * (budget + 1) < 1)
    if lost.any():
        raise ValueError(f"{edits} edits a byte are too many for q-grams of {Q} bytes")
    budget[m < least] = 0
    bound = np.maximum(1, m + 1 - Q * (budget + 1))
    short: dict[str, list[int]] = {}
    for k in np.flatnonzero(m < least).tolist():
        short.setdefault(items[k].decode(), []).append(k)
    grams = [_grams(x) if len(x) >= least else np.zeros(0, "<u8") for x in items]
    every = np.concatenate([*grams, np.zeros(0, "<u8")])
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
    keys, key, total = np.unique(every, return_inverse=True, return_counts=True)
    pairs, pair, own = np.unique(np.stack([item, key], 1), axis=0, return_inverse=True, return_counts=True)
    repeats = np.zeros(len(items), bool)
    repeats[pairs[own > REPEATS, 0]] = True
    spare = bound - np.maximum(1, (bound + 1) // 2)
    hot = np.flatnonzero((total[key] > HOT) & ~repeats[item])
    hot = hot[np.lexsort((place[hot], -total[key[hot]], item[hot]))]
    nth = np.arange(len(hot)) - np.searchsorted(item[hot], item[hot])
    out = hot[nth < spare[item[hot]]]
    bound -= np.bincount(item[out], minlength=len(items))
    kept = ~repeats[item]
    kept[out] = False
    once = np.zeros(len(every), bool)
    once[np.unique(pair.ravel(), return_index=True)[1]] = True
    once &= repeats[item]
    known = np.zeros(1 << 22, bool)
    known[(every[kept | once] * _MIX) >> _SHIFT] = True
    return Index(ids, items, budget, bound, keys, *(_places(every[x], item[x], place[x], keys) for x in (kept, once)), known, short)


def _hits(buffer: bytes, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(text place, key) of the q-grams that are in the index."""
    grams = _grams(buffer)
    at = np.flatnonzero(index.known[(grams * _MIX) >> _SHIFT])
    slot = np.minimum(np.searchsorted(index.keys, grams[at]), max(0, len(index.keys) - 1))
    hit = index.keys[slot] == grams[at] if len(index.keys) else np.zeros(len(at), bool)
    return at[hit], slot[hit]


def _regions(at: np.ndarray, slot: np.ndarray, starts: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """(text, item, first diagonal of the band) of every band that reaches the item's bound."""

    def rows():
        for place, item, own in index.places.slices(at, slot):
            width = np.maximum(1, index.budget)[item]
            diagonal = place - own
            place, item, band = np.tile(place, 2), np.tile(item, 2), np.concatenate([diagonal // width, diagonal // width - 1])
            cell = (((band * len(index.items) + item).astype(np.uint64) * _MIX) >> np.uint64(64 - 21)).astype(np.int64)
            yield place, item, band, cell

    tally, parts = np.zeros(1 << 21, np.int64), []
    for *_, cell in rows():
        tally += np.bincount(cell, minlength=1 << 21)
    if not tally.any():
        return []
    for place, item, band, cell in rows():
        kept = tally[cell] >= index.bound[item]  # bands may share a cell: none is missed
        text = np.searchsorted(starts, place[kept], side="right") - 1
        parts.append(np.unique(np.stack([text, item[kept], band[kept]], 1), axis=0, return_counts=True))
    regions, at_region = np.unique(np.concatenate([r for r, _ in parts]), axis=0, return_inverse=True)
    counts = np.bincount(at_region.ravel(), np.concatenate([n for _, n in parts]), len(regions))
    regions = regions[counts >= index.bound[regions[:, 1]]]
    return [(int(t), int(i), int(b * max(1, index.budget[i]))) for t, i, b in regions]


def _stretches(at: np.ndarray, slot: np.ndarray, starts: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(text, item, from, to): stretches that hold as many q-grams of a repetitive passage, within its length, as it needs."""
    out = []
    parts = [(place, item) for place, item, _ in index.repetitive.slices(at, slot)]
    if not parts:
        return out
    place, item = (np.concatenate(c) for c in zip(*parts, strict=True))
    text = np.searchsorted(starts, place, side="right") - 1
    order = np.lexsort((place, text, item))
    place, item, text = place[order], item[order], text[order]
    cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(text) != 0)) + 1
    for own, i, t in zip(np.split(place, cuts), item[np.concatenate([[0], cuts])].tolist(), text[np.concatenate([[0], cuts])].tolist(), strict=True):
        need, m, k = int(index.bound[i]), len(index.items[i]), int(index.budget[i])
        if len(own) < need:
            continue
        first = np.flatnonzero(own[need - 1 :] - own[: len(own) - need + 1] <= m + k)
        if not len(first):
            continue
        low, high = own[first] - m - k, own[first + need - 1] + m + k + Q
        breaks = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1]) + 1
        for a, b in zip(np.concatenate([[0], breaks]), np.append(breaks, len(low)), strict=True):
            out.append((t, i, int(low[a] - starts[t]), int(high[a:b].max() - starts[t])))
    return out


def _number(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _costs(left: int, up: int, down: int, width: int) -> np.ndarray:
    """The costs of a row from the one at its left end and the steps by +1 and -1 to its right."""
    bits = [np.unpackbits(np.frombuffer(x.to_bytes(-(-width // 8), "little"), np.uint8), count=width, bitorder="little").astype(np.int32) for x in (up, down)]
    return np.concatenate([[left], left + np.cumsum(bits[0] - bits[1])])


def _band(item: bytes, window: bytes, width: int, most: int) -> tuple[int, int]:
    """The least edits of an item in a window, over alignments on its first `width` diagonals that may begin on any of them, and the first end of such a
    place; stops, with minus the bytes done as the end, when all cost more than `most`. A row of the table is two integers of a bit a diagonal (steps of +1 and of -1), advanced by
    arithmetic on whole integers, a byte of the item at a time."""
    m, full = len(item), (1 << width) - 1
    codes = np.frombuffer(window[: m + width].ljust(m + width, b"\0"), np.uint8)
    up = down = left = 0
    block = min(m, max(1024, width))
    for base in range(0, m, block):
        part = item[base : base + block]
        near = codes[base : base + len(part) + width]
        equal = {c: _number(near == c) for c in set(part)}
        for i, c in enumerate(part):
            same = equal[c] >> i
            straight = ((((same & up) + up) ^ up) | same | down) & full
            rise, fall = down | (full ^ (straight | up)), straight & up
            left += 1 - (straight & 1)
            straight >>= 1
            up, down = fall | (full ^ (straight | rise)), rise & straight
            if i & 1023 == 1023 and _costs(left, up, down, width).min() > most:
                return most + 1, -(base + i + 1)
    cost = _costs(left, up, down, width)
    return int(cost.min()), m + int(cost.argmin())


def _spans(item: bytes, text: bytes, edits: int) -> list[tuple[int, int]]:
    """Ranges of diagonals that hold every alignment of the item with at most so many edits. Of 2 edits + 1 pieces of the item more than half are unharmed, their
    diagonals lie no farther apart than the edits, and the alignment leaves them by no more than the edits. Pieces with over OFTEN places count everywhere."""
    size = len(item) // (2 * edits + 1)
    pieces: dict[bytes, list[int]] = {}
    for own in range(0, size * (2 * edits + 1), size):
        pieces.setdefault(item[own : own + size], []).append(own)
    heads = np.frombuffer(b"".join(x[:Q] for x in pieces), "<u8")
    places: dict[bytes, list[int]] = {}
    for at in np.flatnonzero(np.isin(_grams(text), heads)).tolist():
        if (piece := text[at : at + size]) in pieces:
            places.setdefault(piece, []).append(at)
    need = edits + 1 - sum(len(pieces[x]) for x, at in places.items() if len(at) > OFTEN)
    if need < 1:
        return [(-edits, len(text) + edits + 1)]
    diagonals = np.sort(np.array([t - own for x, at in places.items() if len(at) <= OFTEN for t in at for own in pieces[x]], np.int64))
    last = np.searchsorted(diagonals, diagonals + edits, side="right")
    spans: list[tuple[int, int]] = []
    for first in np.flatnonzero(last - np.arange(len(last)) >= need).tolist():
        low, high = int(diagonals[first]) - edits, int(diagonals[last[first] - 1]) + edits + 1
        spans[-1:] = [(spans[-1][0], high)] if spans and spans[-1][1] >= low else [*spans[-1:], (low, high)]
    return spans


def _best_place(item: bytes, text: bytes, budget: int | None = None) -> tuple[int, int]:
    """The least edits of an item at any place of a text, and the first end of such a place; if they exceed the budget, any number above it. Few edits are
    tried first, on the diagonals that pieces of the item leave for them, so a long passage costs its length times the edits that it has."""
    if (at := text.find(item)) >= 0:
        return 0, at + len(item)
    most = len(item) if budget is None else budget
    edits = 8 if len(item) >= LONG else most
    while True:
        few = edits < most and len(item) // (2 * edits + 1) >= Q
        edits = edits if few else most
        best, guess = (edits + 1, 0), 4 * edits
        for low, high in _spans(item, text, edits) if few else [(-edits, len(text) + edits + 1)]:
            got, end = _band(item, b"\0" * max(0, -low) + text[max(0, low) : high + len(item)], high - low, edits)
            if end < 0:  # stopped at byte -end: about as many edits a byte are expected of the rest
                guess = min(guess, max(2 * edits, edits * 5 * len(item) // (4 * -end)))
            elif got > edits:
                guess = min(guess, got)
            best = min(best, (got, max(0, min(low + end, len(text)))))
        if best[0] <= edits or not few:
            return best
        edits = max(edits + 1, guess)


def _align(windows: list[bytes], items: list[bytes], bands: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least edits of its item in it, over alignments that stay within the band's diagonals, and the
    place in the window where the best one ends. Columns are diagonals; all windows advance together, a passage byte at a time."""
    m, width = np.array([len(x) for x in items]), max(bands)
    rows = int(m.max())
    a = np.zeros((len(items), rows), np.uint8)
    w = np.zeros((len(items), rows + width + 1), np.uint8)
    for r, (item, window) in enumerate(zip(items, windows, strict=True)):
        a[r, : len(item)] = np.frombuffer(item, np.uint8)
        w[r, : len(window)] = np.frombuffer(window, np.uint8)
    slope = np.arange(width, dtype=np.int32)
    cost = np.where(slope[None, :] < np.array(bands)[:, None], 0, 30_000).astype(np.int32)
    edits, ends = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(rows):
        new = cost + (w[:, i : i + width] != a[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - slope, axis=1) + slope
        if len(over := np.flatnonzero(m == i + 1)):
            best = cost[over].argmin(1)
            edits[over], ends[over] = cost[over, best], best + i + 1
    return edits, ends


def find(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, last word) for every passage found in every text; of several places the best, then the first."""
    plain = [normalise(t) for t in texts]
    starts = np.cumsum([0, *(len(p) + 1 for p in plain)])[:-1]
    buffer = b"\x01".join(plain)
    at, slot = _hits(buffer, index)
    best: dict[tuple[int, int], tuple[int, int]] = {(t, i): (0, end) for t, p in enumerate(plain) for i, end in index.short_places(p).items()}
    for text, item, low, high in _stretches(at, slot, starts, index):
        edits, end = _best_place(index.items[item], plain[text][max(0, low) : high], int(index.budget[item]))
        if edits <= index.budget[item]:
            best[text, item] = min(best.get((text, item), (1 << 30, 0)), (edits, max(0, low) + end))
    open_regions, long_regions = [], {}
    for text, item, diagonal in _regions(at, slot, starts, index):
        k, m = int(max(1, index.budget[item])), len(index.items[item])
        low, start, size = diagonal - k, int(starts[text]), len(plain[text])
        exact = buffer.find(index.items[item], max(start, low), min(start + size, low + m + 5 * k))
        if exact >= 0:
            best[text, item] = min(best.get((text, item), (1 << 30, 0)), (0, exact + m - start))
        elif m >= LONG:
            long_regions.setdefault((text, item), []).append(low - start)
        else:
            open_regions.append((text, item, low - start))
    for (text, item), lows in long_regions.items():
        k, m = int(index.budget[item]), len(index.items[item])
        lows = np.unique(lows)
        cuts = np.flatnonzero(np.diff(lows) > 4 * k) + 1
        for own in np.split(lows, cuts):  # bands that overlap are one stretch
            low = max(0, int(own[0]))
            edits, end = _best_place(index.items[item], plain[text][low : max(0, int(own[-1]) + m + 4 * k)], k)
            if edits <= k:
                best[text, item] = min(best.get((text, item), (1 << 30, 0)), (edits, low + end))
    for b in range(0, len(open_regions), 1024):
        part = [r for r in open_regions[b : b + 1024] if (r[0], r[1]) not in best or best[r[0], r[1]][0] > 0]
        if not part:
            continue
        windows, items, bands = [], [], []
        for text, item, low in part:
            k, m = int(max(1, index.budget[item])), len(index.items[item])
            windows.append(b"\0" * max(0, -low) + plain[text][max(0, low) : max(0, low + m + 4 * k)])
            items.append(index.items[item])
            bands.append(4 * k)
        for (text, item, low), edits, end in zip(part, *_align(windows, items, bands), strict=True):
            if edits <= index.budget[item]:
                best[text, item] = min(best.get((text, item), (1 << 30, 0)), (int(edits), int(low + end)))
    return [(t, i, e, plain[t].count(b" ", 0, max(0, min(end, len(plain[t]))))) for (t, i), (e, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_bytes: int, least: int, edits: float):
    """Indexes of blocks of the passages, none over the bound but for a single larger passage."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-int(total) // (block_bytes // 2)) if total > block_bytes else 1
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        passages = [(r.item_id, x) for r in mine.collect() if (x := normalise(r.text))]
        if passages:
            yield build_index(sorted(passages, key=lambda p: (p[0] is None, p[0] or 0, p[1])), edits, least)


def find_contamination(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) and benchmark (item_id, text) -> MATCHES, one row per document row and passage that occurs in it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = spark.createDataFrame([], MATCHES)
    for index in _blocks(benchmark, block_bytes, least, edits):

        def search(batches, index=index):
            for b in batches:
                got = find(b.column(1).to_pylist(), index)
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, *_ in got], pa.int64()), pa.array([index.ids[i] for _, i, *_ in got], pa.int64()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int64())], names=["doc_id", "item_id", "edits", "last_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(search, MATCHES))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows in whose text a passage occurs. One pass per block, no shuffle."""
    bounded_batches(docs.sparkSession)
    column = docs.columns.index("text")
    for index in _blocks(benchmark, block_bytes, least, edits):

        def keep(batches, index=index):
            for b in batches:
                dirty = {t for t, *_ in find(b.column(column).to_pylist(), index)}
                yield b.filter(pa.array([t not in dirty for t in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
