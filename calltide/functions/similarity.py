"""Name similarity: Jaro-Winkler without a threshold on its prefix, and its mix with Dice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import dice, event_series


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j, t in enumerate(taken) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro, moved towards 1 by a tenth for each of up to four equal first letters."""
    a, b = a or "", b or ""
    j, n = jaro(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + n * 0.1 * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def title_similarity(a: Column, b: Column) -> Column:
    """0.55 Jaro-Winkler and 0.45 Dice of the series texts."""
    x, y = event_series(a), event_series(b)
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))
    return jaro_winkler_udf(x, y) * 0.55 + dice(words(x), words(y)) * 0.45
