"""Importance resampling towards a target distribution, on hashed n-grams of words.

A streaming CRC ring makes a text's features in one scan: the zlib states of the features that started at the last words are
extended by a space and the next word, which gives the checksums of all runs of 1 to `longest` words without building one. A feature's bucket is
its checksum modulo `buckets`. A bucket's gain is the thousandfold logarithm of how much likelier it is in the target texts, a document's
weight the mean gain of its features, and its score the weight with Gumbel noise that a hash of doc_id fixes; the highest scores are a draw
without replacement in proportion to exp(weight / 1000).

Scale: features are written once, two bytes each, and read for counts and for weights. Counts are added up by task before the shuffle; the driver
gets at most `buckets` rows of each side. Scores are integers in a narrow range (no gain exceeds 2^17 in size, no noise either), so their histogram, of
at most 2^19 rows, ranks them: the driver adds it up, and only documents of equal score that are drawn are sorted, a score at a time.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. Defined cases: null text has no words; a text without words has
weight 0; texts count whole; repeated rows count each, and ties between them are broken either way; a row of null doc_id counts in the statistics, but has no
noise, so its score is null and it isn't drawn nor counted among those drawn from; an empty table gives no rows; an empty target leaves gains by the counts of
documents alone; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.llm.common import bounded_batches, written

LONGEST, BUCKETS, SEED = 2, 10_000, 7
LEAST_WORDS, PERCENT = 20, 25
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"
_PLAIN = bytes.maketrans(
    ascii_uppercase.encode() + bytes(i for i in range(128) if not chr(i).isalnum()), ascii_lowercase.encode() + b" " * sum(not chr(i).isalnum() for i in range(128))
)


def crc_ring(words: list[bytes], longest: int) -> array:
    """zlib's checksums of all runs of 1 to `longest` words, joined by spaces, by their last word, longer ones first."""
    crc, out, ring = zlib.crc32, array("I"), []
    for w in words:
        if len(ring) == longest:
            del ring[0]
        spaced = b" " + w
        ring = [crc(spaced, state) for state in ring]
        ring.append(crc(w))
        out.extend(ring)
    return out


def features(texts: DataFrame, doc_id: str | None = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """texts (doc_id, text) -> FEATURES; doc_id=None for texts without. One scan, no shuffle."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("from 1 to 65536 buckets")
    bounded_batches(texts.sparkSession)

    def run(batches):
        for b in batches:
            n_words, n_features, found = [], [], []
            for data in b.column(1).cast(pa.binary()).to_pylist():
                words = (data or b"").translate(_PLAIN).split()
                sums = np.frombuffer(crc_ring(words, longest), np.uint32)
                n_words.append(len(words))
                n_features.append(len(sums))
                found.append((sums % np.uint32(buckets)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    own = F.col(doc_id) if doc_id else F.lit(None)
    return texts.select(own.cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """FEATURES -> how often each bucket occurs, in 64 bits, summed by task first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data, "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of every bucket."""
    own, of = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * own / ((s + 1.0) * of))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """FEATURES -> doc_id, n_words, n_features, weight: the mean gain, rounded down."""

    def run(batches):
        for b in batches:
            sums = [int(gain[np.frombuffer(d, "<u2")].sum()) for d in b.column(3).to_pylist()]
            sizes = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s // n if n else 0 for s, n in zip(sums, sizes, strict=True)], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.select(*(c.split()[0] for c in FEATURES.split(", "))).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel), fixed by the seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with `rank`: 1, 2, ... for the highest `percent` of those with least_words words, ties to smaller
    doc_id; null for others."""
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = sorted(((r.score, r.n) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    before, starts = 0, []
    for score, n in counts:
        if before >= wanted:
            break
        starts.append((score, before))
        before += n
    cut = starts[-1][0] if starts else None
    taken = able & (F.col("score") >= cut) if starts else F.lit(False)
    base = scored.sparkSession.createDataFrame(starts, "score long, base long")
    among = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = scored.where(taken).withColumn("rank", among.cast("long")).join(F.broadcast(base), "score").withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~F.coalesce(taken, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) and target (text) -> doc_id, n_words, n_features, weight, score, rank of every document."""
    found = written(features(docs, "doc_id", longest, buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, None, longest, buckets), buckets))
    scored = written(weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    return draw(scored, percent, least_words)
