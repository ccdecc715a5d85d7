"""Scaling: centres and factors fitted once, in one aggregation, then applied as literals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Scaler:
    """Per column a centre and a factor; columns of `euclidean` share a factor."""

    center: dict[str, float] = field(default_factory=dict)
    factor: dict[str, float] = field(default_factory=dict)
    euclidean: tuple[str, ...] = ()

    def _with(self, df, names, make):
        return df.withColumns({c: make(c) for c in names or self.factor})

    def scale_points(self, df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
        return self._with(df, names, lambda c: (F.col(c) - self.center[c]) / self.factor[c])

    def unscale_points(self, df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
        return self._with(df, names, lambda c: F.col(c) * self.factor[c] + self.center[c])

    def scale_vectors(self, df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
        return self._with(df, names, lambda c: F.col(c) / self.factor[c])

    def unscale_vectors(self, df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
        return self._with(df, names, lambda c: F.col(c) * self.factor[c])

    def scale_size(self, size: float, dim: int = 1) -> float:
        """A length, area or volume in scaled units; the euclidean columns' factors must agree."""
        factors = {self.factor[c] for c in self.euclidean or self.factor}
        if len(factors) != 1:
            raise ValueError("factors differ")
        return size / factors.pop() ** dim


def whiten(df: DataFrame, columns: Sequence[str], euclidean: Sequence[str] = ()) -> Scaler:
    """Zero mean and unit standard deviation (of the population). Euclidean columns: the deviation of all their values about their joint mean."""
    one = df.agg(*(f(c).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop), ("q", lambda c: F.avg(F.col(c) * F.col(c)))))).first()
    center, factor = {c: one[f"{c}_m"] for c in columns}, {c: one[f"{c}_s"] for c in columns}
    if euclidean:
        mean = sum(center[c] for c in euclidean) / len(euclidean)
        joint = (sum(one[f"{c}_q"] for c in euclidean) / len(euclidean) - mean**2) ** 0.5
        factor |= dict.fromkeys(euclidean, joint)
    return Scaler(center, factor, tuple(euclidean))


def unit_range(df: DataFrame, columns: Sequence[str], euclidean: Sequence[str] = ()) -> Scaler:
    """From 0 to 1; euclidean columns share the range of all their values."""
    one = df.agg(*(f(c).cast("double").alias(f"{c}_{k}") for c in columns for k, f in (("a", F.min), ("b", F.max)))).first()
    center, factor = {c: one[f"{c}_a"] for c in columns}, {c: one[f"{c}_b"] - one[f"{c}_a"] for c in columns}
    if euclidean:
        factor |= dict.fromkeys(euclidean, max(one[f"{c}_b"] for c in euclidean) - min(one[f"{c}_a"] for c in euclidean))
    return Scaler(center, factor, tuple(euclidean))


def clip(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """A column held between two of its quantiles."""
    a, b = df.agg(F.percentile(column, F.lit(low)), F.percentile(column, F.lit(high))).first()
    return df.withColumn(column, F.least(F.greatest(F.col(column), F.lit(a)), F.lit(b)))
