"""Statistics on counts: chi-square, smoothing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2(a: Column, b: Column, c: Column, d: Column, yates: str | bool = "auto", cochran: bool = True) -> Column:
    """Chi-square of the 2x2 table with rows (a, b) and (c, d).

    ``yates``: True, False, or "auto": the continuity correction is applied if an
    expected value is below 1 or a margin below 5. Where a margin is 0 it is 0.
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n, r1, r2, c1, c2 = a + b + c + d, a + b, c + d, a + c, b + d
    gap = a * d - b * c
    plain = n * gap * gap / (c1 * c2 * r1 * r2)
    corrected = n * F.pow(F.abs(gap) - n / 2, F.lit(2.0)) / (c1 * c2 * r1 * r2)
    if yates == "auto":
        expected = F.least(r1 * c1, r1 * c2, r2 * c1, r2 * c2) / n
        x = F.when((expected < 1) | (F.least(r1, r2, c1, c2) < 5), corrected).otherwise(plain)
    else:
        x = corrected if yates else plain
    zero = (c1 * c2 * r1 * r2) == 0
    return F.when(zero, F.lit(0.0)).otherwise(x)


def laplace(freq: Column, over, add: float = 0.5) -> Column:
    """Additive smoothing: the share of each row's frequency over the window ``over``."""
    return (freq + add) / F.sum(freq + add).over(over)


def simple_good_turing(freq: list[int]) -> dict[int, float] | None:
    """Simple Good-Turing: frequency to smoothed probability of one type with it; None if it can't be fitted.

    Only the frequencies of frequencies go in, which are few, so this runs on the driver.
    """
    counts: dict[int, int] = {}
    for f in freq:
        if f > 0:
            counts[f] = counts.get(f, 0) + 1
    r = sorted(counts)
    if len(r) < 2 or counts.get(1, 0) == 0:
        return None
    total = sum(x * counts[x] for x in r)
    z = [counts[x] / (0.5 * ((r[k + 1] if k + 1 < len(r) else 2 * x - (r[k - 1] if k else 0)) - (r[k - 1] if k else 0))) for k, x in enumerate(r)]
    slope, intercept = np.polyfit(np.log(r), np.log(z), 1)
    smooth = lambda x: math.exp(intercept + slope * math.log(x))
    adjusted, turing = {}, True
    for x in r:
        y = (x + 1) * smooth(x + 1) / smooth(x)
        if turing and x + 1 in counts:
            t = (x + 1) * counts[x + 1] / counts[x]
            sd = math.sqrt((x + 1) ** 2 * counts[x + 1] / counts[x] ** 2 * (1 + counts[x + 1] / counts[x]))
            if abs(t - y) > 1.96 * sd:
                adjusted[x] = t
                continue
        turing = False
        adjusted[x] = y
    p0 = counts[1] / total
    mass = sum(counts[x] * adjusted[x] for x in r)
    return {x: (1 - p0) * adjusted[x] / mass for x in r}
