"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit places has a vector of radius + 1 bits; the table of a non-zero vector v looks at the places whose
vector has an odd product with v. At most `radius` differing places give at most `radius` linear conditions on radius + 1
unknowns, so some v is even with all of them, and two fingerprints within the radius agree on every bit which that table
looks at: no pair is missed.

Equal fingerprints are merged first, so copies cost one row. Rows are dealt and sorted by bucket once; a bucket of at most
`bucket_limit` distinct fingerprints is compared as it passes by, and gives a spanning forest of its links (all links, in buckets
of `SMALL_RUN`), not all pairs. Larger buckets
take an exact way whose rows grow with the bucket's size, not its square: every fingerprint is dealt to its neighbours within
half the radius on the bits that the table doesn't look at. Two fingerprints within the radius share such a neighbour, and
any two that share one are within the radius, so each neighbour links its fingerprints in a star.

Words: A-Z lower-cased, cut at ASCII white space. Defined cases: null text is empty; a text of no words has fingerprint zero and
is linked like others; fewer than four words are one shingle; texts of any length count whole; repeated rows stay and are
linked; a null doc_id stays null and counts for no component_id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.common import bounded_batches, narrow_batches, written
from stepfield.llm.graph import connected_components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Distinct fingerprints that are compared within one row.
BUCKET_LIMIT = 4096
#: Fingerprints of a bucket up to which all of them are compared in one vectorised step.
SMALL_RUN = 8


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the fingerprint's bits as a signed long). No shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x or b"", shingle) for x in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bit masks of the 2^(radius + 1) - 1 tables. Places get the non-zero vectors in turn."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what all of them connect."""
    values, links = np.unique(fps.view(np.uint64)), []
    free = np.ones(len(values), bool)
    for s in range(len(values)):
        if not free[s]:
            continue
        free[s], stack = False, [s]
        while stack:
            u = stack.pop()
            others = np.flatnonzero(free)
            near = others[np.bitwise_count(values[others] ^ values[u]) <= radius]
            free[near] = False
            stack += near.tolist()
            links += [(u, int(v)) for v in near]
    signed = values.view(np.int64)
    return [(int(signed[u]), int(signed[v])) for u, v in links]


def _run_links(radius: int, limit: int):
    """Rows (key, fp) in order of key -> (big, a, b): links of every bucket of at most `limit` fingerprints, or (True, key, fp) for
    each fingerprint of a larger one. A batch's last bucket waits for the next batch, so no more than `limit` rows are held back."""
    names, none = ["big", "a", "b"], np.zeros(0, np.int64)

    def pack(big: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), big)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

    def whole(k: np.ndarray, f: np.ndarray):
        """Buckets that are complete."""
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1]) if len(k) else none
        sizes = np.diff(np.append(starts, len(k)))
        few = np.repeat((sizes > 1) & (sizes <= min(SMALL_RUN, limit)), sizes)
        ks, fs = k[few], f[few]
        for d in range(1, SMALL_RUN):
            at = np.flatnonzero(ks[d:] == ks[:-d])
            if not len(at):
                break
            at = at[np.bitwise_count((fs[at] ^ fs[at + d]).view(np.uint64)) <= radius]
            if len(at):
                yield pack(False, fs[at], fs[at + d])
        for r in np.flatnonzero((sizes > SMALL_RUN) | (sizes > limit)).tolist():
            part = slice(starts[r], starts[r] + sizes[r])
            if sizes[r] > limit:
                yield pack(True, k[part], f[part])
            elif found := spanning_links(f[part], radius):
                yield pack(False, *np.array(found, np.int64).T)

    def run(batches):
        k, f, over = none, none, None
        for b in batches:
            nk, nf = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if over is not None:
                n = int(np.searchsorted(nk, over, side="right"))
                if n:
                    yield pack(True, nk[:n], nf[:n])
                nk, nf = nk[n:], nf[n:]
                if not len(nk):
                    continue
                over = None
            k, f = np.concatenate([k, nk]), np.concatenate([f, nf])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            yield from whole(k[:last], f[:last])
            k, f = k[last:], f[last:]
            if len(k) > limit:
                yield pack(True, k, f)
                k, f, over = none, none, int(k[0])
        yield from whole(k, f)

    return run


def _dealt(masks: list[int], radius: int):
    """(key, fp) -> (key, mid, fp): the neighbours of fp within half the radius on the bits that the key's table doesn't look at."""
    flips = []
    for m in masks:
        away = [1 << i for i in range(64) if not m >> i & 1]
        flips.append(np.array([sum(c) for k in range(radius // 2 + 1) for c in combinations(away, k)], np.uint64))

    def run(batches):
        for b in batches:
            keys, fps = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for at in range(0, len(keys), 64):
                k, f = keys[at : at + 64], fps[at : at + 64]
                own = [flips[int(x) & (2 << radius) - 1] for x in k]
                mids = np.concatenate([o ^ x for o, x in zip(own, f.view(np.uint64), strict=True)]).view(np.int64)
                sizes = [len(o) for o in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, sizes)), pa.array(mids), pa.array(np.repeat(f, sizes))], names=["key", "mid", "fp"])

    return run


def links(values: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct (f, fp) -> links (a, b) that connect whatever fingerprints of the same f within the radius connect. f numbers the
    kinds of fingerprints where texts have several. The radius must be even. One shuffle of (key, fp), sorted by key; a key's
    low bits are its table's number."""
    spark, masks = values.sparkSession, covering_masks(radius)
    keys = [F.xxhash64("f", F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))).bitwiseAND(F.lit(-(2 << radius))).bitwiseOR(F.lit(t)) for t, m in enumerate(masks)]
    dealt = values.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    narrow_batches(spark)
    found = written(dealt.mapInArrow(_run_links(radius, bucket_limit), "big boolean, a long, b long"), "bucket-links")
    near, big = found.where("not big").select("a", "b"), found.where("big").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if big.isEmpty():
        bounded_batches(spark)
        return near
    middle = written(big.mapInArrow(_dealt(masks, radius), "key long, mid long, fp long"), "bucket-middles")
    bounded_batches(spark)
    hubs = middle.groupBy("key", "mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.unionByName(middle.join(hubs, ["key", "mid"]).where("a <> fp").select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id (the smallest doc_id reachable over links, its own included)."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("root")), "classes")
    found = connected_components(links(classes.select(F.lit(0).alias("f"), "fp"), radius, bucket_limit))
    return marked.join(_least(classes.withColumnRenamed("fp", "node"), found).withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", "component_id")


def _least(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) and (a, b) of connected_components -> (node, component_id): the least root of the node's component."""
    labelled = classes.join(found, F.col("node") == F.col("a"), "left").select("node", "root", F.coalesce("b", "node").alias("label"))
    return labelled.join(labelled.groupBy("label").agg(F.min("root").alias("component_id")), "label").select("node", "component_id")
