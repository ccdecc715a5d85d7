"""Best-fit packing: hierarchical residual packing of token sequences into bins of a fixed length.

`tokenize` turns whole texts into pieces of at most `capacity` tokens. `pack` fits pieces into bins: each partition packs
its own items best-fit in order of decreasing length; bins that are nearly full are done and are written out, underfull
bins become items of the next round, in which `fan_in` partitions merge into one, until one partition's worth is left. A
bin carries its members (at most `capacity`, since each has a token), so no join restores them, and only underfull bins
are shuffled. A partition of the last round holds a bounded number of bins.

Defined cases: null text is empty and is one token long (the end id); texts of any length are cut only at multiples of the
capacity; repeated rows and null ids are packed like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stepfield.llm.common import bounded_batches, written

CAPACITY = 2048
#: A bin with at most this share of its capacity free is done before the last round.
SLACK = 1 / 256
#: Bytes of text tokenised at once.
TEXT_BYTES = 8 << 20
#: Texts a task packs at once, and rounds' limits: bins that one task of the last round may hold, partitions merged into one.
GROUP_ITEMS, LAST_ITEMS, FAN_IN = 100_000, 100_000, 8
#: Word parts whose ids a Python worker remembers, before it forgets all.
REMEMBERED = 500_000
#: Punctuation that the vocabulary's pattern always parts from a letter before it.
TAIL = ".,!?;:*#$%&"
#: The parting is only used behind Latin letters below this, whose normal and lower-case forms are letters.
LETTERS = "\u0180"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))
BINS = f"bin_length long, done boolean, members array<{MEMBER}>"


class _Ids(dict):
    """Ids (little-endian 32-bit, as bytes) of texts without blanks or line ends, by the tokenizer. The vocabulary lower-cases
    and cuts at white space, and between a letter and the punctuation TAIL, so such parts are encoded once each."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters alone, each of which ends with one word-end token: one call for all, cut at those tokens."""
        ids = self.encode(" ".join(words))
        ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
        if len(ends) == len(words):
            data = ids.tobytes()
            self.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends], ends, strict=False))
        else:
            self.update((w, self.encode(w).tobytes()) for w in words)

    def _learn(self, parts: set[str]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        cut = {}
        for part in parts:
            low = _lower(part)
            core = low.rstrip(TAIL)
            cut[part] = (core, low[len(core) :]) if core[-1:].isalpha() and core[-1] < LETTERS and core[-1].lower().isalpha() else (low, "")
        new = {x for pair in cut.values() for x in pair} - self.keys()
        words = [x for x in new if x.isalpha()]
        for at in range(0, len(words), 1000):
            self._encode_words(words[at : at + 1000])
        self.update((x, self.encode(x).tobytes()) for x in new if not x.isalpha())
        self.update((part, self[core] + self[tail]) for part, (core, tail) in cut.items())

    def of(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text. A batch's distinct parts are looked up once, and spread over the texts by index."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        missing = set(distinct) - self.keys()
        if missing:
            self._learn(missing if len(self) <= REMEMBERED else set(distinct))
        known = [self[p] for p in distinct]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[at])
        spread = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - sizes[at]), sizes[at])]
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        out = [spread[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist():
            text = texts[k].as_py()
            if any(s in text for s in self.special):
                out[k] = self.encode(text).tobytes()
        return out


def _lower(part: str) -> str:
    """A-Z, and in texts of Latin-1 all letters, lower-cased; not where that may make a special token."""
    if "<|" in part:
        return part
    if part.isascii():
        return part.lower()
    try:
        part.encode("latin-1")
    except UnicodeEncodeError:
        return part.translate(_LOWER)
    return part.lower()


@cache
def _vocabulary(path: str) -> _Ids:
    return _Ids(path)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items to bins, best-fit in order of decreasing length (ties: in the order given): lists of item indexes.

    The open bins are kept by room: a stack for each amount of room and a sorted list of the amounts in use."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(rooms, lengths[i])
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(i)
        if left := room - lengths[i]:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def _fit(items: list[tuple[int, list]], capacity: int, last: bool) -> pa.RecordBatch:
    """Items (length, members) packed into bins, as a batch of BINS."""
    lengths = [n for n, _ in items]
    sizes, done, members = [], [], []
    for b in best_fit(lengths, capacity):
        at, placed = 0, []
        for doc, piece, start, length, crc, *_ in (m for i in b for m in items[i][1]):
            placed.append({"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "offset": at})
            at += length
        sizes.append(at)
        done.append(last or at >= capacity * (1 - SLACK))
        members.append(placed)
    return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(done, pa.bool_()), pa.array(members, _MEMBERS)], names=["bin_length", "done", "members"])


def _packed(items: list, capacity: int, last: bool, step: int = 2000) -> Iterator[pa.RecordBatch]:
    made = _fit(items, capacity, last)
    for k in range(0, made.num_rows, step):
        yield made.slice(k, step)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Batches joined until their texts have TEXT_BYTES: the more texts, the fewer of their parts are distinct."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.column(1).nbytes for x in held) >= TEXT_BYTES:
            yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))
            held = []
    if held:
        yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))


def tokenize_and_pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) -> BINS of the first round. Each task cuts its texts into pieces and packs them; full pieces are bins of their own."""
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        ids, items = _vocabulary(vocabulary), []
        for docs_ids, texts in _grouped(batches):
            for doc, data in zip(docs_ids.to_pylist(), ids.of(pc.fill_null(texts, "")), strict=True):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    items.append((len(part) // 4, [(doc, piece, at // 4, len(part) // 4, zlib.crc32(part))]))
            if len(items) >= GROUP_ITEMS:
                yield from _packed(items, capacity, False)
                items = []
        yield from _packed(items, capacity, False)

    return docs.select("doc_id", "text").mapInArrow(run, BINS)


def _merge(capacity: int, last: bool):
    def run(batches):
        items: list = []
        for batch in batches:
            for size, members in zip(batch.column("bin_length").to_pylist(), batch.column("members").to_pylist(), strict=True):
                items.append((size, [tuple(m.values()) for m in members]))
            if len(items) >= GROUP_ITEMS and not last:
                yield from _packed(items, capacity, last)
                items = []
        yield from _packed(items, capacity, last)

    return run


def pack(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rounds over the underfull bins of `bins`, until one task can hold what is left, or until as many tasks as are needed
    to hold it have each packed their share. Every round is written: later rounds read it, and a lost executor costs
    tasks of one round only."""
    rounds, parts = [written(bins, "packing-round")], 0
    while (left := rounds[-1].where("not done").count()) > 0:
        least = -(-left // LAST_ITEMS)
        parts = max(least, parts // FAN_IN if parts else (least * FAN_IN if least > 1 else 1))
        last = parts == least
        merged = rounds[-1].where("not done").repartition(parts).mapInArrow(_merge(capacity, last), BINS)
        rounds.append(written(merged, "packing-round"))
        if last:
            break
    out = rounds[0].where("done")
    for r in rounds[1:]:
        out = out.unionByName(r.where("done"))
    return out


def place(bins: DataFrame) -> DataFrame:
    """BINS -> one row per piece: its sequence, and its place there, gapless from 0."""
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id")
