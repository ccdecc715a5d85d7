"""Column expressions on coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

COORDS = ("x", "y")


def along(*by: str) -> WindowSpec:
    """Rows of a trajectory in order of time; row_id breaks ties."""
    return Window.partitionBy(*(by or ("n",))).orderBy("t", "row_id")


def squared(names: Sequence[str]) -> Column:
    """Sum of squares of columns."""
    out = F.lit(0.0)
    for c in names:
        out = out + F.col(c) * F.col(c)
    return out


def euclidean(names: Sequence[str]) -> Column:
    return F.sqrt(squared(names))


def chebyshev(names: Sequence[str]) -> Column:
    return F.greatest(*(F.abs(F.col(c)) for c in names)) if len(names) > 1 else F.abs(F.col(names[0]))


def in_box(lower: dict[str, float], upper: dict[str, float]) -> Column:
    """Closed at both ends in every dimension."""
    out = F.lit(True)
    for c in lower:
        out = out & F.col(c).between(F.lit(float(lower[c])), F.lit(float(upper[c])))
    return out


def polar(dx: str = "dx", dy: str = "dy") -> tuple[Column, Column]:
    """(angle, radius) of a planar vector."""
    return F.atan2(dy, dx), F.hypot(dx, dy)


def spherical(dx: str, dy: str, dz: str) -> tuple[Column, Column, Column]:
    """(azimuth, elevation, radius) of a vector in space."""
    flat = F.hypot(dx, dy)
    return F.atan2(dy, dx), F.atan2(F.col(dz), flat), F.hypot(flat, F.col(dz))


def nan_to_null(names: Sequence[str]) -> dict[str, Column]:
    """Missing values are null in this library; floating NaN is not."""
    return {c: F.when(~F.isnan(c), F.col(c)) for c in names}


def jump_bound(diffusivity: float, dt: float) -> float:
    """Radius that a step of a diffusing particle seldom exceeds."""
    return 2.0 * (2.0 * diffusivity * dt) ** 0.5


def squared_error(sigma: float | None = None, sigma2: float | None = None, default: float = 0.03) -> float:
    """The localisation error's variance from either of its forms."""
    if sigma is not None and sigma2 is not None:
        raise ValueError("give sigma or sigma2, not both")
    return sigma2 if sigma2 is not None else (default if sigma is None else sigma) ** 2
