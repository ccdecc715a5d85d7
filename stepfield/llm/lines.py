"""Lines that many documents share, dropped from all but the last document that holds them; DataFrame expressions only.

Lines become rows (key hash, document, position) without their text. They are range-partitioned by the hash and sorted within by hash,
document (largest first) and position; one stream over each range meets a key's documents in order, so the first of them keeps its lines
and, if enough follow, the others lose theirs. What comes back to a text is its keep bitmap, compressed as run lengths
(kept, dropped, kept, ...), never a line.

Scale: a key that holds more than 1 / HEAVY_KEYS of all rows would make its range too long. There are at most HEAVY_KEYS such keys; they are found
by a count that is aggregated before it is shuffled, and their rows are judged where they lie, beside a table of at most HEAVY_KEYS rows.
Line rows and bitmaps are written to the shared folder. Texts are shuffled once, beside the bitmaps.

A key is the line without ASCII white space at both ends, A-Z lower-cased, compared by 128 bits of hash. Defined cases: null text is empty, and
an empty text is one empty line; texts of any length count whole; rows of one doc_id are one document, also if repeated; all rows of null doc_id are one
document, before any other; an empty table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.llm.common import free_name, written

LEAST_CHARS, LEAST_DOCS = 40, 5
HEAVY_KEYS, HEAVY_ROWS = 4096, 1000
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line trimmed, A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def line_rows(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs (doc_id, text) -> (h1, h2, doc_id, th, pos): a row per line whose key has least_chars code points. th is a hash of the text. No shuffle."""
    lines = _texts(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.char_length("line") >= least_chars)
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "th", "pos")


def heavy_keys(rows: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(h1, h2) of the keys with more than heavy_rows and more than 1 / HEAVY_KEYS of all rows: at most HEAVY_KEYS of them."""
    least = max(heavy_rows, rows.count() // HEAVY_KEYS)
    return written(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > least).select("h1", "h2"), "heavy-lines")


def dropped_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """line_rows -> (doc_id, th, pos) of the lines that go."""
    by = ["h1", "h2"]
    heavy = heavy_keys(rows, heavy_rows)
    ranged = rows.join(F.broadcast(heavy), by, "left_anti").repartitionByRange(*by).sortWithinPartitions(*by, F.desc_nulls_last("doc_id"), "pos")
    met = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("doc_id")))
    streamed = ranged.withColumn("nth", met).withColumn("docs", F.max("nth").over(Window.partitionBy(*by))).where((F.col("nth") > 1) & (F.col("docs") >= least_docs))
    hot = rows.join(F.broadcast(heavy), by)
    last = hot.select(*by, "doc_id").distinct().groupBy(*by).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= least_docs)
    beside = hot.join(F.broadcast(last), by).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return streamed.select("doc_id", "th", "pos").unionByName(beside.select("doc_id", "th", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, th, n_dropped, runs): a row per text that loses lines. runs are the lengths of the stretches of
    kept and dropped lines in turn, the first of them kept (perhaps 0); lines behind the last are kept."""
    rows = written(line_rows(docs, least_chars), "line-rows")
    gone = dropped_lines(rows, least_docs, heavy_rows).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    i = F.col("at")
    starts = F.filter(i, lambda x, k: F.coalesce(F.get(i, k - 1) != x - 1, F.lit(True)))
    ends = F.filter(i, lambda x, k: F.coalesce(F.get(i, k + 1) != x + 1, F.lit(True)))
    ended = gone.select("doc_id", "th", F.size("at").cast("long").alias("n_dropped"), starts.alias("starts"), ends.alias("ends"))
    run = lambda s, k: F.array(s - F.coalesce(F.get(F.col("ends"), k - 1) + 1, F.lit(0)), F.get(F.col("ends"), k) + 1 - s)
    return written(ended.select("doc_id", "th", "n_dropped", F.flatten(F.transform("starts", run)).alias("runs")), "keep-bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; columns of these names are replaced."""
    rest = docs.drop("n_lines", "n_dropped", "kept_text")
    names = {}
    for c in ("id", "th", "lines", "gone", "runs", "line_th", "line_id"):
        names[c] = free_name(rest, f"_{c}")
    text = F.coalesce("text", F.lit(""))
    marked = rest.withColumns({names["id"]: F.col("doc_id").cast("long"), names["th"]: F.xxhash64(text)})
    right = bitmaps.select(F.col("doc_id").alias(names["line_id"]), F.col("th").alias(names["line_th"]), F.col("n_dropped").alias(names["gone"]), F.col("runs").alias(names["runs"]))
    same = F.col(names["id"]).eqNullSafe(F.col(names["line_id"])) & (F.col(names["th"]) == F.col(names["line_th"]))
    held = marked.join(right.hint("shuffle_hash"), same, "left").withColumn(names["lines"], F.split(text, "\n"))
    flags = F.flatten(F.transform(names["runs"], lambda n, k: F.array_repeat(k % 2 == 0, n)))
    pairs = F.zip_with(names["lines"], flags, lambda line, keep: F.struct(line.alias("line"), F.coalesce(keep, F.lit(True)).alias("keep")))
    kept = F.array_join(F.transform(F.filter(pairs, lambda p: p["keep"]), lambda p: p["line"]), "\n")
    return held.select(
        *(F.col(f"`{c}`") for c in rest.columns), F.size(names["lines"]).cast("long").alias("n_lines"), F.coalesce(names["gone"], F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col(names["runs"]).isNull(), text).otherwise(kept).alias("kept_text")
    )


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: keys of at least least_chars code points in at least least_docs documents stay in
    the one of the largest doc_id only."""
    return apply_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs, heavy_rows))
