"""Near copies: SimHash candidates by covering tables, verified by the similarity of five-word shingles.

Texts are compared by their words: lower-cased, cut at white space, without punctuation at their ends (a text of punctuation
alone keeps it). Texts of equal words form a class. A class has KINDS SimHashes of its distinct words, by as many hash functions;
classes are candidates if one of these pairs of fingerprints is within the radius. At a five-word similarity of 0.8 about one word
in forty-five differs, so a fingerprint differs in 3.4 bits on average (measured) and all KINDS of them seldom in over 4.

Candidates are not links yet: within each candidate component, classes are linked if their minimum hashes of five-word shingles
(HASHES of them, a byte each) agree in AGREE of all, which two of similarity 0.8 miss with a chance of 0.3 %. They are compared in buckets
of classes that share a band of BAND hashes (two of similarity 0.8 share none with a chance of 5e-8), whatever the component's size. A bucket
of more than `group_limit` is compared in slices, each with the bucket's least class; what hangs together with that one is one set, and
the rest is compared with every slice, so the result is that of the whole bucket. Every set of linked classes keeps one row: the smallest doc_id's.

Defined cases: null text is empty, and empty texts are copies of each other; fewer than five words are one shingle; texts count
whole; of repeated rows one stays; rows of one doc_id and different texts are texts like others; a null doc_id is larger than any,
so such a row stays if no other of its group has a doc_id; a component without one has a null component_id; ties of doc_id go to the
class seen first; an empty table gives no rows; further columns are kept by `keep_one` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.llm.common import bounded_batches, free_name, written
from stepfield.llm.graph import connected_components
from stepfield.llm.simhash import BUCKET_LIMIT, RADIUS, links

KINDS, HASHES, BAND, AGREE, WORDS = 6, 128, 4, 0.7, 5
GROUP_LIMIT = 1024
PUNCTUATION = b".,!?;:*#$%&\"'()|"
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, HASHES, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, HASHES, np.uint64)[:, None]
_PLACES = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_KIND_FACTORS = _RNG.integers(0, 1 << 63, KINDS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
ROWS = "row long, doc_id long, tk long, h1 long, h2 long, " + ", ".join(f"f{k} long" for k in range(KINDS)) + ", sig binary"


def plain_words(data: bytes) -> list[bytes]:
    raw = data.lower().split()
    return [w for w in (x.strip(PUNCTUATION) for x in raw) if w] or raw


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """KINDS SimHashes of the distinct word hashes."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return np.zeros(KINDS, np.int64)
    ones = np.zeros((KINDS, 64), np.int64)
    for at in range(0, len(distinct), 4096):
        part = _mixed(_mixed(distinct[at : at + 4096]) * _KIND_FACTORS)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(KINDS, -1, 8), axis=2, bitorder="little").sum(1, np.int64)
    return np.packbits(2 * ones > len(distinct), axis=1, bitorder="little").view("<i8").ravel()


def minimum_hashes(hashes: np.ndarray) -> np.ndarray:
    """The low byte of each of the HASHES minimum hashes of five-word shingles."""
    k = min(WORDS, len(hashes))
    mixed = _mixed(sum((hashes[i : len(hashes) - k + 1 + i] * _PLACES[i] for i in range(k)), np.zeros(1, np.uint64)))
    mixed, least = np.unique(mixed), np.full(HASHES, (1 << 32) - 1, np.uint64)
    for at in range(0, len(mixed), 2048):
        least = np.minimum(least, ((mixed[at : at + 2048] * _FACTORS + _TERMS) >> np.uint64(32)).min(1))
    return _mixed(least).astype(np.uint8)


def text_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> ROWS: a number of the row, a hash of the text, and of its words, its fingerprints and minimum hashes. No shuffle."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            numbers, sigs = [], []
            for data in b.column(2).cast(pa.binary()).to_pylist():
                words = plain_words(data or b"")
                both = xxhash.xxh3_128_intdigest(b" ".join(words))
                h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                numbers.append([(both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63), *word_fingerprints(h).tolist()])
                sigs.append(minimum_hashes(h).tobytes())
            table = np.array(numbers, np.int64).reshape(-1, 2 + KINDS)
            own = np.arange(number, number + b.num_rows, dtype=np.int64)
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0), b.column(1), *(pa.array(c) for c in table.T), pa.array(sigs, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text").mapInArrow(run, ROWS)


def text_classes(rows: DataFrame) -> DataFrame:
    """ROWS -> (node, root, tk, copies, f0...): one row per class of equal words. node is its least row, root its smallest doc_id,
    tk a text of that one and copies how many rows are alike in both. Classes of many rows are counted before the shuffle."""
    kinds = [f"f{k}" for k in range(KINDS)]
    one = rows.groupBy("h1", "h2", "doc_id", "tk").agg(F.min("row").alias("node"), F.count("*").alias("copies"), *(F.min(k).alias(k) for k in kinds))
    first = one.groupBy("h1", "h2", "doc_id").agg(F.min("node").alias("least"), F.min_by("tk", "node").alias("tk"), F.min_by("copies", "node").alias("copies"), *(F.min(k).alias(k) for k in kinds))
    by = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    return first.groupBy("h1", "h2").agg(F.min("least").alias("node"), F.min("doc_id").alias("root"), F.min_by("tk", by).alias("tk"), F.min_by("copies", by).alias("copies"), *(F.min(k).alias(k) for k in kinds))


def candidates(classes: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Classes (node, f0...) -> (node, component) of those that share, directly or through others, a fingerprint up to the radius."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"f{k}").alias("fp")) for k in range(KINDS))))
    members = classes.select("node", kinds.alias("x")).select("node", "x.f", "x.fp")
    values = written(members.groupBy("f", "fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fingerprint-classes")
    shared = values.where("n > 1").select("f", "fp", "first")
    same = members.join(shared, ["f", "fp"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near, of = links(values.select("f", "fp"), radius, bucket_limit), values.select("fp", "first")
    near = near.join(of.select(F.col("fp").alias("a"), F.col("first").alias("na")), "a").join(of.select(F.col("fp").alias("b"), F.col("first").alias("nb")), "b")
    found = connected_components(same.unionByName(near.select(F.col("na").alias("a"), F.col("nb").alias("b"))))
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


_GROUP = ["component", "t", "key"]
_FOUND = "component long, t int, key long, a long, b long, rest boolean"


def _agreeing(batches):
    """(component, t, key, cut, nodes, sigs) of a group -> links that connect whatever nodes whose hashes agree in AGREE of all connect. Of a slice (cut) also
    its nodes that don't hang together with the bucket's least node, as rows of `rest`."""
    for b in batches:
        out, keys = [np.zeros((0, 3), np.int64)], []
        for g, (cut, nodes, sigs) in enumerate(zip(b.column(3).to_pylist(), b.column(4), b.column(5), strict=True)):
            ids, at = np.unique(nodes.values.to_numpy(), return_index=True)
            m = np.frombuffer(b"".join(sigs.as_py()), np.uint8).reshape(-1, HASHES)[at]
            free, held, first = np.arange(len(ids)), len(out), True
            while len(free):
                if cut and not first:
                    break
                stack, free = [int(free[0])], free[1:]
                while stack and len(free):
                    u = stack.pop()
                    near = (m[free] == m[u]).sum(1) >= AGREE * HASHES
                    out.append(np.stack([np.full(int(near.sum()), ids[u]), ids[free[near]], np.zeros(int(near.sum()), np.int64)], 1))
                    stack += free[near].tolist()
                    free = free[~near]
                first = False
            if cut:
                out.append(np.stack([ids[free], ids[free], np.ones(len(free), np.int64)], 1))
            keys.append(np.full(sum(map(len, out[held:])), g))
        found = np.concatenate(out)
        of = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in range(3)), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2] > 0)], names=[c.split()[0] for c in _FOUND.split(", ")])


def _compared(members: DataFrame, sigs: DataFrame, by: list[str], cut: Column) -> DataFrame:
    """members (component, t, key, ..., node) compared within groups of `by`."""
    groups = members.join(sigs, "node").groupBy(*_GROUP, *by).agg(F.collect_list("node").alias("nodes"), F.collect_list("sig").alias("sigs"))
    return groups.select(*_GROUP, cut.alias("cut"), "nodes", "sigs").mapInArrow(_agreeing, _FOUND)


def verified_links(grouped: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(node, component, sig) -> links (a, b) that connect what pairs of nodes connect that are of one component, share a band and agree in AGREE of all hashes.
    `group_limit` only says how many are held at once."""
    bounded_batches(grouped.sparkSession)
    grouped = written(grouped.select("component", "node", "sig"), "candidates")
    sigs, zero = grouped.select("node", "sig"), F.lit(0).cast("bigint")
    keys = F.array(*(F.xxhash64("component", F.substring("sig", 1 + BAND * t, BAND)) for t in range(HASHES // BAND)))
    dealt = grouped.select("component", "node", F.posexplode(keys).alias("t", "key"))
    slices = F.ceil(F.col("n") / group_limit).cast("bigint")
    buckets = written(dealt.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").withColumn("slices", slices), "band-sizes")
    own = dealt.join(buckets, _GROUP).where("node <> hub").select(*_GROUP, "slices", F.pmod(F.xxhash64("node", "t"), F.col("slices")).alias("slice"), "node")
    hubs = buckets.select(*_GROUP, "slices", F.explode(F.sequence(zero, F.col("slices") - 1)).alias("slice"), F.col("hub").alias("node"))
    sliced = own.unionByName(hubs)
    found = written(_compared(sliced, sigs, ["slices", "slice"], F.col("slices") > 1), "band-links")
    # what a slice leaves over is compared with every slice of its bucket
    rest = found.where("rest").select(*_GROUP, F.col("a").alias("node"))
    blocks = written(rest.groupBy(*_GROUP).agg(F.ceil(F.count("*") / group_limit).cast("bigint").alias("blocks")), "band-rests")
    every = sliced.join(blocks, _GROUP).select(*_GROUP, "slice", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "node")
    left = rest.join(blocks, _GROUP).join(buckets.select(*_GROUP, "slices"), _GROUP).select(*_GROUP, F.explode(F.sequence(zero, F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("block"), "node")
    again = _compared(every.unionByName(left), sigs, ["slice", "block"], F.lit(False))
    return found.where("not rest").unionByName(again).select("a", "b")


def labelled_classes(docs: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT, group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): ROWS of docs, and classes with `label`, the least node of the set they are linked in."""
    rows = written(text_rows(docs), "text-rows")
    classes = written(text_classes(rows), "text-classes")
    grouped = candidates(classes, radius, bucket_limit).join(rows.select(F.col("row").alias("node"), "sig"), "node")
    found = connected_components(verified_links(grouped, group_limit))
    return rows, classes.join(found.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_copies(docs: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, component_id: for every row the smallest doc_id of the copies and near copies it is linked with."""
    rows, classes = labelled_classes(docs, radius, bucket_limit, group_limit)
    least = classes.groupBy("label").agg(F.min("root").alias("component_id"))
    of = rows.groupBy("h1", "h2").agg(F.min("row").alias("node")).join(classes.select("node", "label"), "node").join(least, "label")
    return rows.join(of.select("h1", "h2", "component_id"), ["h1", "h2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """docs with one row of every set of copies and near copies, the smallest doc_id's. Texts are shuffled once, by a hash of the text
    and doc_id, so copies of one text spread; what stays is a build side of three numbers a row."""
    _, classes = labelled_classes(docs, radius, bucket_limit, group_limit)
    linked = classes.withColumn("_last", F.col("root").isNull())
    best = linked.groupBy("label").agg(F.min(F.struct("_last", "root", "node")).alias("b"), F.count("*").alias("n")).where("n > 1").select("label", F.col("b.node").alias("winner"))
    key, tk, root, copies = (free_name(docs, c) for c in ("_key", "_tk", "_root", "_copies"))
    kept = classes.join(best, "label", "left").where("winner is null or winner = node").select(F.col("tk").alias(tk), F.col("root").alias(root), F.col("copies").alias(copies))
    marked = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    held = marked.join(kept.hint("shuffle_hash"), (F.col(key) == F.col(tk)) & F.col("doc_id").cast("long").eqNullSafe(F.col(root)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = held.where(F.col(copies) == 1).select(own)
    return once.unionByName(held.where(F.col(copies) > 1).dropDuplicates(["doc_id", key]).select(own))
