"""Significance rules and the Student t distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from adgauge.functions.text import as_col

# Fixed values: |t| above the bound -> p of the step table; p below the bound -> stars.
STEP_P = ((2.576, 0.001), (1.96, 0.01), (1.645, 0.05))
STEP_P_ELSE = 0.10
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
Z_95, Z_99 = 1.96, 2.576


def step_p(t) -> Column:
    size = F.abs(as_col(t))
    ladder = F.when(F.lit(False), F.lit(None).cast("double"))
    for bound, p in STEP_P:
        ladder = ladder.when(size > bound, F.lit(p))
    return ladder.otherwise(F.lit(STEP_P_ELSE))


def stars(p) -> Column:
    c = as_col(p)
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for bound, mark in STARS:
        ladder = ladder.when(c < bound, mark)
    return ladder.otherwise("ns")


def round_even(value, places: int) -> Column:
    """Half-even rounding of the scaled double, as the IEEE operation does it."""
    scale = F.lit(float(10**places))
    return F.rint(as_col(value) * scale) / scale


def mean_ci(mean, sd, n, confidence: float = 0.95) -> tuple[Column, Column]:
    """Normal interval of a mean, rounded half-even to 2; below two values it is the mean."""
    m = as_col(mean)
    margin = F.lit(Z_95 if confidence == 0.95 else Z_99) * F.try_divide(
        as_col(sd), F.sqrt(as_col(n).cast("double"))
    )
    small = as_col(n) < 2
    return (
        F.when(small, m).otherwise(round_even(m - margin, 2)),
        F.when(small, m).otherwise(round_even(m + margin, 2)),
    )


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10."""
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        low = z < 10
        shift = np.where(low, shift + np.log(np.where(low, z, 1.0)), shift)
        z = np.where(low, z + 1, z)
    inv = 1 / z
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680 + inv**9 / 1188
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, modified Lentz form; NaN where it has not converged."""
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, rounds + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for coefficient in (even, odd):
            d = 1 / guard(1 + coefficient * d)
            c = guard(1 + coefficient / c)
            value = value * d * c
            step = d * c
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return np.where(np.abs(step - 1) < 1e-9, value, np.nan)


def two_sided_t(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for df degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if not ok.any():
        return np.where(np.isinf(t) & (df > 0), 0.0, out)
    t2, v = t[ok] ** 2, df[ok]
    a, b = v / 2, np.full_like(v, 0.5)
    x, y = v / (v + t2), t2 / (v + t2)
    log_front = (
        _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
        - a * np.log1p(t2 / v) + b * np.log(np.where(y > 0, y, 1.0))
    )
    front = np.exp(log_front)
    # The fraction converges fast only on one side of the mean; use symmetry on the other.
    direct = x < (a + 1) / (a + b + 2)
    tail = np.where(
        direct,
        front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a,
        1 - front * _beta_fraction(b, a, np.where(direct, 0.0, y)) / b,
    )
    out[ok] = np.where(t2 == 0, 1.0, np.clip(tail, 0.0, 1.0))
    return np.where(np.isinf(t) & (df > 0), 0.0, out)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic; runs on aggregated rows only, one per metric or segment."""
    p = pd.Series(two_sided_t(t.to_numpy(float), df.to_numpy(float)))
    return p.astype(object).where(p.notna(), None)


@F.pandas_udf(DoubleType())
def _two_sided_normal(z: pd.Series) -> pd.Series:
    p = [math.erfc(abs(x) / math.sqrt(2)) if x == x else None for x in z.to_numpy(float)]
    return pd.Series(p, dtype=object)


def normal_pvalue(z) -> Column:
    """Two-sided p of a standard normal statistic; for aggregated rows, one per metric or segment."""
    return _two_sided_normal(as_col(z))
