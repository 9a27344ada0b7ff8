"""Closed-form economics of pattern trades as column functions.

f is the fee fraction, r = 1 - f; sigma is the victim's size and eps the front-run's, both as shares of
the pool's reserve of the token that goes in; alpha is added liquidity over pool liquidity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from blocktape.functions.scalars import finite


def impact_x2y(r: float, sigma: Column) -> Column:
    u = 1.0 + r * sigma
    return 1.0 / (u * u) - 1.0


def impact_y2x(r: float, sigma: Column) -> Column:
    u = 1.0 + r * sigma
    return u * u - 1.0


def backrun_threshold(r: float) -> float:
    return (1.0 / math.sqrt(r) - 1.0) / r


def backrun_best(base: Column, r: float, sigma: Column) -> Column:
    """Largest back-run profit in units of base; NULL where 1 + r sigma is not positive.  Not cut off below the threshold."""
    u = 1.0 + r * sigma
    t = math.sqrt(r) * u - 1.0
    return F.when(u > 0, base * (t * t) / (r * u))


def backrun_profit(r: float, sigma: Column) -> Column:
    """The same per unit of base, and 0 below the threshold."""
    return F.when(sigma < backrun_threshold(r), 0.0).otherwise(backrun_best(F.lit(1.0), r, sigma))


def eps_cap(sigma: Column, gamma: float, r: float) -> Column:
    """Largest front-run within the victim's slippage tolerance; 0 for a missing sigma."""
    if gamma >= 1:
        return F.lit(float("inf"))
    s = r * sigma
    root = F.sqrt(s * s + 4.0 * (1.0 + s) / (1.0 - max(gamma, 0.0)))
    return F.coalesce(F.greatest(F.lit(0.0), ((root - s) / 2.0 - 1.0) / r), F.lit(0.0))


def eps_cap_jit(sigma: Column, gamma: float, r: float, alpha: Column) -> Column:
    """The same while the pool is scaled by 1 + alpha; NULL for a missing or negative sigma."""
    if gamma >= 1:
        return F.lit(float("inf"))
    a = F.greatest(F.coalesce(finite(alpha), F.lit(0.0)), F.lit(0.0))
    s = r * sigma
    scale = 1.0 + a
    root = F.sqrt(s * s + 4.0 * (1.0 + s) * (scale * scale) / (1.0 - max(gamma, 0.0)))
    return F.when(sigma >= 0, F.greatest(F.lit(0.0), ((root - s) / (2.0 * scale) - 1.0) / r))


def sandwich_profit(eps: Column, sigma: Column, r: float) -> Column:
    """Normalized profit of a sandwich of size eps; NULL for a negative eps or a vanishing denominator."""
    t = 1.0 + r * eps + r * sigma
    den = (1.0 + r * eps) + r * r * eps * t
    return F.when((eps >= 0) & (den != 0), r * r * eps * (t * t) / den - eps)


def sandwich_best(sigma: Column, cap: Column, r: float, grid: int = 128) -> Column:
    """struct(eps, profit): the first maximum over an even grid on [0, cap]; (0, 0) without room.

    ``cap`` should be a column already, for it is read at every point.  The grid stays inside the row and
    is never exploded into rows.
    """
    n = max(8, int(grid))
    at = lambda j: F.when(j == n - 1, cap).otherwise(j * (cap / float(n - 1)))
    profits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: sandwich_profit(at(j), sigma, r))
    best = F.transform(F.array(profits), lambda p: F.struct(at(F.array_position(p, F.array_max(p)).cast("int") - 1).alias("eps"), F.array_max(p).alias("profit")))[0]
    zero = F.struct(F.lit(0.0).alias("eps"), F.lit(0.0).alias("profit"))
    return F.when((cap > 0) & (cap < float("inf")) & sigma.isNotNull(), best).otherwise(zero)


def backrun_vs_jit(f: float, phi: float, r: float) -> float | None:
    """Size at which the best back-run and full just-in-time liquidity earn the same."""
    g = f - phi
    a, b = r - g, g - 2.0 * math.sqrt(r)
    disc = b * b - 4.0 * a
    if a == 0 or disc < 0:
        return None
    return ((math.sqrt(disc) - b) / (2.0 * a) - 1.0) / r


def sandwich_onset(r: float) -> float:
    return (1.0 - r) / (r * r)


def jit_profit(sigma: Column, f: float, r: float, alpha: Column) -> Column:
    s = F.greatest(sigma, F.lit(0.0))
    value = alpha / (1.0 + alpha) * s * (f + r) - alpha * r * s / (1.0 + alpha + r * s)
    return F.when(alpha <= 0, 0.0).otherwise(value)


def theta(eps: Column, alpha: Column, sigma: Column, r: float, clip: bool = True) -> Column:
    """Share of the second token that a self-funded bundle gets back for its back-run."""
    d = 1.0 + r * eps
    den = d * (1.0 + alpha) + r * sigma
    value = F.when(d == 0, 0.0).otherwise(r / d * (eps - F.when(den == 0, 0.0).otherwise(alpha * sigma / den)))
    return F.greatest(value, F.lit(0.0)) if clip else value


def funded_from(alpha: Column, sigma: Column, r: float | Column) -> Column:
    """The front-run at which theta, which grows with it, is 0: the positive root of r (1 + alpha) e^2 + (1 + alpha + r sigma) e = alpha sigma."""
    b = (1.0 + alpha) + r * sigma
    return 2.0 * (alpha * sigma) / (b + F.sqrt(b * b + 4.0 * (r * (1.0 + alpha)) * (alpha * sigma)))


def mixed_profit(eps: Column, alpha: Column, sigma: Column, r: float, clip: bool = True, th: Column | None = None) -> Column:
    """Profit of the bundle; ``th`` is its theta where that is a column already."""
    th = theta(eps, alpha, sigma, r, clip) if th is None else th
    t = (1.0 + r * eps) * (1.0 + alpha) + r * sigma
    den = (1.0 + alpha) * ((1.0 + alpha) + t * r * th)
    return F.when(den != 0, t * t * r * th / den).otherwise(0.0) - eps + alpha * sigma / (1.0 + alpha)


def rational_profit(eps: Column, alpha: Column, sigma: Column, f: float, r: float) -> Column:
    """The mixed bundle where its back-run is funded, else just-in-time liquidity alone."""
    return F.when(theta(eps, alpha, sigma, r, clip=False) > 0, mixed_profit(eps, alpha, sigma, r, clip=False)).otherwise(jit_profit(sigma, f, r, alpha))
