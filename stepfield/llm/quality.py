"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text come from one histogram of its bytes, its words and its lines; label, language, source and id
never enter. The forest is trained on at most `train_rows` labelled documents, those of the smallest hash of doc_id (a
documented bound: training needs no more), and is applied to every whole text by numpy traversal inside Arrow batches;
no row is shuffled.

Defined cases: null text is empty; an empty text gets the score of its all-zero statistics; labels null are left out;
labels of unknown documents have no effect; repeated rows are scored alike; without labels every score is 0.5; an empty
table gives no rows; further columns are ignored, or kept by `add_scores`, but one of the new column's name is replaced; of rows of one
doc_id those of the least statistics count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.llm import gbt
from stepfield.llm.common import bounded_batches

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
NAMES = (
    "log_bytes", "entropy", "upper", "lower", "digit", "space", "newline", "punct", "bang", "pipe", "symbol", "high", "log_words", "word_mean", "word_std",
    "distinct_words", "symbol_end", "upper_words", "short_words", "log_lines", "line_mean", "repeated_lines", "stop_lines", "top_word",
)

_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b".,;:?\"'()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 10
_SYMBOLS = tuple(b"!#$%&*|")


def statistics(data: bytes) -> list[float]:
    """The statistics NAMES of a text in UTF-8."""
    n = len(data)
    if n == 0:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    kinds = np.bincount(_KIND, counts, 11)[1:] / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    w, m = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally: dict = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    return [
        np.log1p(n), float(-(p * np.log2(p)).sum()), *kinds[:10],
        np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(tally) / w,
        sum(c for x, c in tally.items() if x[-1] in _SYMBOLS) / w, sum(c for x, c in tally.items() if len(x) > 1 and x.isupper()) / w, float((lengths <= 3).mean()),
        np.log1p(len(lines)), n / m, 1 - len(set(lines)) / m, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m, max(tally.values(), default=0) / w,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(x or b"") for x in column.cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(NAMES))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> gbt.Forest:
    """A forest from labels (doc_id, quality) outside the held-out rows."""
    bounded_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)

    def measure(batches):
        for b in batches:
            x = _matrix(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    measured = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(measure, "doc_id long, quality int, x array<double>")
    rows = measured.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()  # repeated rows count once, so at most train_rows
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    return gbt.train(np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.quality for r in rows]))


def add_scores(docs: DataFrame, forest: gbt.Forest, column: str = "score") -> DataFrame:
    """docs with the probability of quality 1. No shuffle."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(column)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.predict(_matrix(b.column(b.schema.get_field_index("text")))), pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double")
