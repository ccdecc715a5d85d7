"""URL filter: path rules first, then gradient-boosted trees on lexical features.

`split_url` and `decide` are column expressions. `fit` trains the trees on labelled URLs (url, label) - at most `train_rows` distinct
ones, those of the smallest hash, a documented bound. Label rates of host suffixes (the last label, and the last two) are counted over all
labelled URLs. A training row's rates leave out the URLs of its own host, so trees learn what a suffix tells of hosts not seen.

Suffixes of at least one labelled URL in COMMON are a table of at most 2 COMMON rows, which goes to the tasks; rows of other suffixes, of
which none is frequent, look their rates up in a join. Defined cases: a null url, or one without `://`, has an empty host and path and is
scored like any other; an empty table gives no rows; repeated rows are judged alike; of conflicting labels of one url the larger counts;
without labels the method's probability is 0.5; further columns are kept, but one of the new column's name is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.llm import gbt
from stepfield.llm.common import bounded_batches, free_name, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRAIN_ROWS = 20_000
#: Share of the labelled URLs that makes a suffix common, inverted, and the weight of the prior in a rate.
COMMON, WEIGHT = 1000, 10
NAMES = (
    "length", "host_length", "path_length", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "params", "param_length", "dots", "hyphens", "host_hyphens", "labels", "longest_label", "escapes", "https", "port", "fragment",
    "vowel_ratio", "top_rate", "top_log_count", "site_rate", "site_log_count",
)


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host ends before the first `/`, `?` or `#` behind `://`, the path before `?` or `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def decide(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits the host or a parent domain and begins the path; else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, action = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.action).otherwise(action)
    return rule, action


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


_SPLIT = re.compile(r"([^:/?#]*)(?:://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(#.*)?", re.S)


def lexical(url: str | None) -> list[float]:
    """The features of NAMES that the url alone gives."""
    url = url or ""
    scheme, host, path, query, fragment = (x or "" for x in _SPLIT.match(url).groups())
    host = host.lower()
    name, _, port = host.partition(":")
    parts = name.split(".")
    out = [
        len(url), len(host), len(path), sum(map(bool, path.split("/"))), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)), _entropy(url), _entropy(host),
        sum(map(bool, re.split("[&;]", query))), len(query), url.count("."), url.count("-"), host.count("-"), len(parts), max(map(len, parts)), url.count("%"), scheme == "https", bool(port), bool(fragment),
        sum(c in "aeiou" for c in name) / max(1, len(name)),
    ]
    return [float(v) for v in out]


@dataclass
class UrlModel:
    """A forest, the share of label 1, the label counts (ones, all) of common suffixes, and a table (suffix, ones, n) of all."""

    forest: gbt.Forest
    prior: float = 0.5
    common: dict[str, tuple[int, int]] = field(default_factory=dict)
    suffixes: DataFrame | None = None


def _rates(ones: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    return np.stack([(ones + WEIGHT * prior) / (n + WEIGHT), np.log1p(n)], -1)


def _matrix(urls: list[str | None], counts: np.ndarray, prior: float) -> np.ndarray:
    """Features from urls and, for each, (ones, n) of its two suffixes."""
    alone = np.array([lexical(u) for u in urls], np.float64).reshape(-1, len(NAMES) - 4)
    return np.concatenate([alone, _rates(counts[:, :, 0], counts[:, :, 1], prior).reshape(-1, 4)], 1)


def suffix_columns(url: Column) -> tuple[Column, Column]:
    """The last label of the url's host name, and its last two."""
    name = F.substring_index(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[^:/?#]*://([^/?#]*)", 1), ":", 1)
    return F.substring_index(name, ".", -1), F.concat(F.lit("."), F.substring_index(name, ".", -2))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> UrlModel:
    """A model from labelled (url, label 0 or 1; 1: block). Suffixes are counted by host first, so no suffix is hot."""
    top, two = suffix_columns(F.col("url"))
    host = F.regexp_extract(F.lower("url"), r"^[^:/?#]*://([^/?#]*)", 1)
    known = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max(F.col("label").cast("int")).alias("label")).select("url", "label", host.alias("host"), F.array(top, two).alias("own"))
    known = written(known, "url-labels")
    by_host = written(known.select("label", "host", F.explode("own").alias("suffix")).groupBy("suffix", "host").agg(F.sum("label").alias("ones"), F.count("*").alias("n")), "url-hosts")
    suffixes = written(by_host.groupBy("suffix").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")), "url-suffixes")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    sample = known.orderBy(F.xxhash64("url"), "url").limit(train_rows)
    rows = sample.select("url", "label", "host", F.posexplode("own").alias("place", "suffix"))  # at most twice train_rows
    rates = suffixes.join(F.broadcast(rows), "suffix").join(by_host.select("suffix", "host", F.col("ones").alias("own_ones"), F.col("n").alias("own_n")), ["suffix", "host"])
    got = {(r.url, r.place): (r.label, r.ones - r.own_ones, r.n - r.own_n) for r in rates.collect()}
    urls = sorted(u for u, place in got if place == 0)
    prior = (ones + 0.5) / (n + 1)
    counts = np.array([[got[u, place][1:] for place in (0, 1)] for u in urls], np.float64).reshape(-1, 2, 2)
    forest = gbt.train(_matrix(urls, counts, prior), np.array([got[u, 0][0] for u in urls], np.float64), trees=40)
    common = {r.suffix: (r.ones, r.n) for r in suffixes.where(F.col("n") * COMMON >= n).collect()}
    return UrlModel(forest, prior, common, suffixes)


def add_probability(df: DataFrame, model: UrlModel, column: str = "block_probability") -> DataFrame:
    """df (with a column url) with the model's probability of label 1. Only rows of a suffix that is not common are shuffled."""
    bounded_batches(df.sparkSession)
    df = df.drop(column)
    width, forest, prior, common = len(df.columns), model.forest, model.prior, model.common
    at = [c.lower() for c in df.columns].index("url")
    top, two = suffix_columns(F.col("url"))
    own, key, far, found = (free_name(df, c) for c in ("_suffix", "_key", "_far", "_found"))
    marked = df.select("*", F.struct(top.alias("top"), two.alias("two")).alias(own))
    none = F.lit(None).cast("struct<ones:bigint,n:bigint>")
    names = {k: free_name(df, f"_{k}") for k in ("top", "two")}
    usual = F.col(f"{own}.top").isin(list(common)) & F.col(f"{own}.two").isin(list(common)) if common else F.lit(model.suffixes is None)
    parts = marked.where(usual).select("*", *(none.alias(c) for c in names.values()))
    if model.suffixes is not None:
        other = marked.where(~usual)
        for k, name in names.items():
            rare = model.suffixes.where(~F.col("suffix").isin(list(common)) if common else F.lit(True)).select(F.col("suffix").alias(far), F.struct("ones", "n").alias(found))
            suffix = F.col(f"{own}.{k}")
            held = F.when(suffix.isin(list(common)) if common else F.lit(False), F.concat(F.lit(" "), F.xxhash64("url").cast("string"))).otherwise(suffix)  # common ones match nothing, apart
            other = other.withColumn(key, held).join(rare, F.col(key) == F.col(far), "left").drop(key, far).withColumnRenamed(found, name)
        parts = parts.unionByName(other)

    def score(batches):
        for b in batches:
            counts = np.zeros((b.num_rows, 2, 2))
            own = b.column(width).to_pylist()
            for place, k in enumerate(("top", "two")):
                for r, (suffix, rare) in enumerate(zip(own, b.column(width + 1 + place).to_pylist(), strict=True)):
                    counts[r, place] = common.get(suffix[k], (rare["ones"], rare["n"]) if rare else (0, 0))
            p = forest.predict(_matrix(b.column(at).to_pylist(), counts, prior))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(p, pa.float64())], names=[*b.schema.names[:width], column])

    return parts.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{column}` double")
