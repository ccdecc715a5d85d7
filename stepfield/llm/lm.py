"""Language-model scoring by deleted interpolation.

P(w | h) = l2 f(w | h) + l1 f(w) + l0 / (V + 1), with maximum-likelihood estimates f from counts over all training tokens,
and weights l for each bucket of the context's frequency (powers of two), learned by expectation-maximisation: counts of
the training documents outside one fold are held against the events of that fold.

Scale: texts become chunks of about `CHUNK_TOKENS` tokens. A chunk's distinct n-grams are sent, as sorted 64-bit keys with counts
that are cut by the keys' first BITS bits, to nodes that each take one range of keys from about 2^BITS chunks. Where there are more
chunks than that, a node adds up what it gets and acts as a chunk of its range on the next level, cut by the next BITS bits; totals
come back the same way. So every level sends 2^BITS rows a chunk at most, whose number grows with the input, and no node holds more
n-grams than a chunk. A key costs one entry per chunk however often it occurs, no key is hot, and nothing passes through the driver
but the number of tokens, of types, and a table of events by quantised estimates whose size is fixed by its bins. Chunks, answers
and their join are written or shuffled in compressed runs; lost executors cost tasks only. Counts have 64 bits.

Tokens: A-Z lower-cased, words cut at ASCII white space, then one end per text; the end also stands for the start of a text
as a context. Keys are XXH64 values mixed in pairs; of n keys, n^2 / 2^65 pairs are confused on average.
Defined cases: null text is empty (one token); texts of any length count whole; repeated rows count and are scored each;
a document of null doc_id is a training document; an empty table gives no rows; without training rows V and N are 0; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.llm.common import bounded_batches, written

FOLDS, TEST_FOLD, EM_FOLD = 5, 1, 2
CHUNK_TOKENS, BITS = 2_000_000, 8
#: Bins of the events' estimates: steps per power of two, and the smallest power.
STEPS, SMALLEST = 4, -48
CONTEXT_BUCKETS = 32
CHUNKS = "chunk long, em boolean, tokens long, doc_ids array<bigint>, folds array<int>, lengths array<bigint>, sequence binary, hashes binary"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
UNIGRAM, BIGRAM = 1, 2


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)).cast("int")


def _pack(a: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> CHUNKS. A chunk's documents are all of the EM fold, or all of other folds. No shuffle."""
    bounded_batches(docs.sparkSession)

    class Open:
        def __init__(self):
            self.words, self.parts, self.tokens, self.docs = _Words({b"": 0}), [], 0, []

    def close(c: Open, em: bool, number: int) -> pa.RecordBatch:
        ids, folds, lengths = zip(*c.docs, strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, c.words), np.uint64, len(c.words))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        row = ((TaskContext.get().partitionId() << 32) + number, em, c.tokens, ids, folds, lengths, _pack(np.concatenate(c.parts)), _pack(hashes))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "em", "tokens", "doc_ids", "folds", "lengths", "sequence", "hashes"])

    def run(batches):
        open_chunks, number = {}, 0
        for b in batches:
            for doc, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                em = part == EM_FOLD
                c = open_chunks.setdefault(em, None) or Open()
                open_chunks[em] = c
                words = (data or b"").lower().split()
                seq = np.fromiter(map(c.words.__getitem__, words), np.uint32, len(words))
                c.parts += [seq, np.zeros(1, np.uint32)]
                c.docs.append((doc, part, len(words) + 1))
                c.tokens += len(words) + 1
                if c.tokens >= CHUNK_TOKENS:
                    yield close(c, em, number)
                    number, open_chunks[em] = number + 1, None
        for em, c in open_chunks.items():
            if c is not None:
                yield close(c, em, number)
                number += 1

    return docs.select(F.col("doc_id").cast("long"), fold(F.col("doc_id")).alias("fold"), "text").mapInArrow(run, CHUNKS)


@dataclass
class _Grams:
    """What a chunk's sequence holds: its tokens, its distinct bigrams (context, word), each token's bigram, and the keys of words and of bigrams."""

    seq: np.ndarray
    context: np.ndarray
    word: np.ndarray
    bigram: np.ndarray
    keys: dict[int, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _grams(sequence: bytes, hashes: bytes) -> _Grams:
    seq, h = _unpack(sequence, "<u4"), _unpack(hashes, "<u8")
    before = np.concatenate([np.zeros(1, np.uint32), seq[:-1]])  # a text ends with 0, which is also the next one's start
    codes, bigram = np.unique(before.astype(np.uint64) << np.uint64(32) | seq, return_inverse=True)
    context, word = (codes >> np.uint64(32)).astype(np.int32), (codes & np.uint64(0xFFFFFFFF)).astype(np.int32)
    return _Grams(seq, context, word, bigram.astype(np.int32), {UNIGRAM: _mixed(h), BIGRAM: _mixed(_mixed(h[context] * _A) + h[word])})


def _cut(keys: np.ndarray, bits: int) -> tuple[list[int], list[int], list[int]]:
    """(range, start, end) of the ranges of sorted keys: those of the same first bits."""
    first = keys >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], first[1:] != first[:-1]]))
    return first[starts].astype(np.int64).tolist(), starts.tolist(), np.append(starts[1:], len(keys)).tolist()


def _rows(batch: pa.RecordBatch):
    """One row at a time as a dict: a chunk's arrays take a hundred times the space of its row."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


PARTS = "kind int, range long, parent long, child long, em boolean, keys binary, counts binary, em_counts binary"
NODES = "kind int, range long, child long, keys binary, counts binary, em_counts binary"
ANSWERS = "kind int, range long, child long, em boolean, total binary, em_total binary, tokens long, types long, em_tokens long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _schema(ddl)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _send(groups: int):
    """Chunks -> PARTS. A chunk of the EM fold is marked; its counts are those of the EM fold too."""
    bits = BITS

    def run(batches):
        for b in batches:
            for row in _rows(b):
                g = _grams(row["sequence"], row["hashes"])
                trains = np.repeat(np.array(row["folds"]) != TEST_FOLD, row["lengths"])
                parent = int(_mixed(np.array([row["chunk"]], np.uint64) * _A)[0] >> np.uint64(32)) % groups
                for kind, at in ((UNIGRAM, g.seq), (BIGRAM, g.bigram)):
                    order = np.argsort(g.keys[kind])
                    keys, counts = g.keys[kind][order], np.bincount(at[trains], minlength=len(order)).astype(np.uint64)[order]
                    out = [(kind, r, parent, row["chunk"], row["em"], _pack(np.diff(keys[x:y], prepend=np.uint64(0))), _pack(counts[x:y]), None) for r, x, y in zip(*_cut(keys, bits), strict=True)]
                    yield from _table(out, PARTS).to_batches()

    return run


def _send_on(level: int):
    """NODES of the level before -> PARTS of this one."""
    fan, bits = BITS, BITS * level

    def run(batches):
        for b in batches:
            for row in _rows(b):
                keys = np.cumsum(_unpack(row["keys"], "<u8"), dtype=np.uint64)
                counts, em = _unpack(row["counts"], "<u8"), _unpack(row["em_counts"], "<u8")
                out = [(row["kind"], r, row["child"] >> fan, row["child"], True, _pack(np.diff(keys[x:y], prepend=np.uint64(0))), _pack(counts[x:y]), _pack(em[x:y])) for r, x, y in zip(*_cut(keys, bits), strict=True)]
                yield from _table(out, PARTS).to_batches()

    return run


@dataclass
class _Sum:
    """The distinct keys of some PARTS, their totals, and for each part its keys' places among them."""

    keys: np.ndarray
    total: np.ndarray
    em_total: np.ndarray
    places: list[np.ndarray]


def _keys(parts: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(_unpack(k, "<u8"), dtype=np.uint64) for k in parts.column("keys").to_pylist()]


def _sum(parts: pa.Table) -> _Sum:
    keys = _keys(parts)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total, em_total = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
    places = np.split(at.ravel(), np.cumsum([len(k) for k in keys])[:-1])
    for mine, counts, em, em_counts in zip(places, *(parts.column(c).to_pylist() for c in ("counts", "em", "em_counts")), strict=True):
        own = _unpack(counts, "<u8")
        total[mine] += own  # a part's keys are distinct
        if em:
            em_total[mine] += own if em_counts is None else _unpack(em_counts, "<u8")
    return _Sum(distinct, total, em_total, places)


def _told(parts: pa.Table, places: list[np.ndarray], total: np.ndarray, em_total: np.ndarray) -> list[tuple]:
    named = zip(*(parts.column(c).to_pylist() for c in ("kind", "range", "child", "em")), places, strict=True)
    return [(kind, r, child, em, _pack(total[mine]), _pack(em_total[mine]) if em else None, None, None, None) for kind, r, child, em, mine in named]


def _answer(parts: pa.Table) -> pa.Table:
    """All PARTS of a range -> ANSWERS: the totals of each part's keys in their order; one more row has the range's sums."""
    s = _sum(parts)
    sums = (parts.column("kind")[0].as_py(), parts.column("range")[0].as_py(), None, None, None, None, int(s.total.sum()), int((s.total > 0).sum()), int(s.em_total.sum()))
    return _table([sums, *_told(parts, s.places, s.total, s.em_total)], ANSWERS)


def _merge(parts: pa.Table) -> pa.Table:
    """PARTS of one parent and range -> its row of NODES."""
    s = _sum(parts)
    kind, r, parent = (parts.column(c)[0].as_py() for c in ("kind", "range", "parent"))
    return _table([(kind, r, parent, _pack(np.diff(s.keys, prepend=np.uint64(0))), _pack(s.total), _pack(s.em_total))], NODES)


def _tell(parts: pa.Table, node: pa.Table) -> pa.Table:
    """PARTS of a node, and the node's keys with the answers it got -> ANSWERS to the parts."""
    if not parts.num_rows:
        return _table([], ANSWERS)
    keys, got = _keys(node)[0], sorted(node.column("answers")[0].as_py(), key=lambda a: a["range"])
    total, em_total = (np.concatenate([_unpack(a[c], "<u8") for a in got]) for c in ("total", "em_total"))
    return _table(_told(parts, [np.searchsorted(keys, k) for k in _keys(parts)], total, em_total), ANSWERS)


def _totals_of(parts: DataFrame, groups: int, level: int = 1) -> tuple[DataFrame, DataFrame]:
    """PARTS whose parents are numbered below `groups` -> (answers to them, sums of the ranges)."""
    if groups == 1:
        answers = written(parts.groupBy("kind", "range").applyInArrow(_answer, ANSWERS), "lm-answers")
        return answers.where("child is not null"), answers.where("child is null")
    nodes = written(parts.groupBy("kind", "range", "parent").applyInArrow(_merge, NODES), "lm-nodes")
    answers, sums = _totals_of(nodes.mapInArrow(_send_on(level + 1), PARTS), -(-groups >> BITS), level + 1)
    told = answers.groupBy("kind", F.shiftright("range", BITS).alias("range"), "child").agg(F.collect_list(F.struct("range", "total", "em_total")).alias("answers"))
    ready = nodes.select("kind", "range", "child", "keys").join(told, ["kind", "range", "child"]).withColumnRenamed("child", "parent")
    by = ["kind", "range", "parent"]
    return written(parts.groupBy(*by).cogroup(ready.groupBy(*by)).applyInArrow(_tell, ANSWERS), "lm-answers"), sums


def _with_answers(chunked: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with its answers; a chunk's answers are as many as its distinct n-grams at most."""
    told = answers.groupBy(F.col("child").alias("chunk")).agg(F.collect_list(F.struct("kind", "range", "total", "em_total")).alias("answers"))
    return chunked.join(told.hint("shuffle_hash"), "chunk")


def _totals(row: dict, g: _Grams, column: str) -> dict[int, np.ndarray]:
    out = {}
    for kind, keys in g.keys.items():
        mine = sorted((a for a in row["answers"] if a["kind"] == kind), key=lambda a: a["range"])
        out[kind] = np.empty(len(keys), np.int64)
        out[kind][np.argsort(keys)] = np.concatenate([_unpack(a[column], "<u8") for a in mine])
    return out


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts not seen, else 1 + floor(log2(count))."""
    return np.where(count > 0, np.minimum(CONTEXT_BUCKETS - 1, 1 + np.log2(np.maximum(1, count)).astype(np.int64)), 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """Bin of an estimate; -1 for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(0, np.rint((np.log2(p) - SMALLEST) * STEPS)), -1).astype(np.int64)


def bin_value(b: np.ndarray) -> np.ndarray:
    return np.where(b >= 0, 2.0 ** (b / STEPS + SMALLEST), 0.0)


def _events(tokens: int):
    """Held-out events by (context bucket, bin of f(w | h), bin of f(w)), from counts without the EM fold."""

    def run(batches):
        for b in batches:
            for row in _rows(b):
                g = _grams(row["sequence"], row["hashes"])
                every, own = _totals(row, g, "total"), _totals(row, g, "em_total")
                one, two = every[UNIGRAM] - own[UNIGRAM], every[BIGRAM] - own[BIGRAM]
                seen = one[g.context]
                events = np.stack([context_bucket(seen), _bin(two / np.maximum(1, seen)), _bin(one[g.word] / max(1, tokens))], 1)
                kinds, at = np.unique(events, axis=0, return_inverse=True)
                n = np.bincount(at.ravel(), np.bincount(g.bigram, minlength=len(two)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in kinds.T), pa.array(n.astype(np.int64))], names=["h", "b2", "b1", "n"])

    return run, "h long, b2 long, b1 long, n long"


def learn_weights(events: np.ndarray, types: int, rounds: int = 100) -> np.ndarray:
    """(CONTEXT_BUCKETS, 3): weights of f(w | h), f(w) and the uniform estimate, by expectation-maximisation on rows (h, b2, b1, n)."""
    weights = np.tile([0.3, 0.6, 0.1], (CONTEXT_BUCKETS, 1))
    for h in range(CONTEXT_BUCKETS):
        rows = events[events[:, 0] == h]
        if not len(rows):
            continue
        f = np.stack([bin_value(rows[:, 1]), bin_value(rows[:, 2]), np.full(len(rows), 1 / (types + 1))], 1)
        for _ in range(rounds):
            share = f * weights[h]
            share *= (rows[:, 3] / share.sum(1))[:, None]
            weights[h] = np.maximum(share.sum(0) / rows[:, 3].sum(), 1e-6)
            weights[h] /= weights[h].sum()
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(tokens: int, types: int, weights: np.ndarray):
    def run(batches):
        for b in batches:
            for row in _rows(b):
                g = _grams(row["sequence"], row["hashes"])
                total = _totals(row, g, "total")
                one, two = total[UNIGRAM], total[BIGRAM]
                seen = one[g.context]
                w = weights[context_bucket(seen)]
                p = w[:, 0] * two / np.maximum(1, seen) + w[:, 1] * one[g.word] / max(1, tokens) + w[:, 2] / (types + 1)
                starts = np.concatenate([[0], np.cumsum(row["lengths"])[:-1]])
                base = np.log10((one + 0.5) / (tokens + 0.5 * (types + 1)))
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array([f == TEST_FOLD for f in row["folds"]]), pa.array(row["lengths"], pa.int64()), pa.array(np.add.reduceat((one > 0)[g.seq].astype(np.int64), starts)),
                        pa.array([tokens] * n, pa.int64()), pa.array(np.add.reduceat(base[g.seq], starts)), pa.array(np.add.reduceat(np.log10(p)[g.bigram], starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run, SCORES


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> SCORES, one row per document."""
    chunked = written(chunks(docs), "lm-chunks")
    groups = max(1, -(-chunked.count() >> BITS))
    answers, sums = _totals_of(chunked.mapInArrow(_send(groups), PARTS), groups)
    sums = sums.where(f"kind = {UNIGRAM}").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "em_tokens"))).first()
    run, schema = _events(sums.tokens - sums.em_tokens)
    events = _with_answers(chunked.where("em"), answers.where("em")).mapInArrow(run, schema).groupBy("h", "b2", "b1").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([tuple(r) for r in events], np.float64).reshape(-1, 4), sums.types)
    run, schema = _scores(sums.tokens, sums.types, weights)
    return _with_answers(chunked, answers).mapInArrow(run, schema)
