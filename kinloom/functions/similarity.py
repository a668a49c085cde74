"""Similarity of values as column expressions; string alignment as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _pair(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(float("nan"))).otherwise(value.cast("double"))


def _common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda x, e: F.size(F.filter(x, lambda y: y == e))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, e: n + F.least(count(a, e), count(b, e)))


def hamming_distance(a: Column, b: Column) -> Column:
    """Places where the strings differ; missing places of the shorter one differ."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1)))
    return _pair(a, b, F.aggregate(places, F.lit(0), lambda n, i: n + (a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))).cast("int")))


def edit_distance(a: Column, b: Column) -> Column:
    return _pair(a, b, F.levenshtein(a, b))


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length: 0 for equal strings."""
    return _pair(a, b, F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Multiset intersection over union of two arrays; 0 where both are empty."""
    both = _common(a, b)
    return _pair(a, b, F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)))


def set_jaccard(a: Column, b: Column) -> Column:
    return _pair(a, b, F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the binary vectors of two arrays."""
    return _pair(a, b, F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.sqrt(F.size(F.array_distinct(a)) * F.size(F.array_distinct(b)))), F.lit(0.0)))


def overlap_count(a: Column, b: Column) -> Column:
    return _pair(a, b, _common(a, b))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return _pair(a, b, F.coalesce(F.try_divide(_common(a, b), F.least(F.size(a), F.size(b))), F.lit(0.0)))


def dice(a: Column, b: Column) -> Column:
    return _pair(a, b, F.coalesce(F.try_divide(2 * _common(a, b), F.size(a) + F.size(b)), F.lit(0.0)))


def exact_match(a: Column, b: Column) -> Column:
    return _pair(a, b, (a == b).cast("int"))


def relative_difference(a: Column, b: Column) -> Column:
    """``2 |a - b| / (a + b)``, 0 where both are 0, NaN where one is no number."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return _pair(x, y, F.when((x == 0) & (y == 0), 0.0).otherwise(F.try_divide(2 * F.abs(x - y), x + y)))


def absolute_norm(a: Column, b: Column) -> Column:
    """``1 - |a - b| / max(|a|, |b|)``; differences up to 1e-4 count as none, and two zeros give 0."""
    x, y = a.try_cast("double"), b.try_cast("double")
    apart = F.when(F.abs(x - y) <= 1e-4, 0.0).otherwise(F.abs(x - y))
    return _pair(x, y, F.when((x == 0) & (y == 0), 0.0).otherwise(1 - F.try_divide(apart, F.greatest(F.abs(x), F.abs(y)))))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            left.append(c)
    if not left:
        return 0.0
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _winkler(a: str, b: str, weight: float = 0.1) -> float:
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return _jaro(a, b) + same * weight * (1 - _jaro(a, b))


def _global(a: str, b: str, gap: float = -1.0, match: float = 1.0, differ: float = -1.0) -> float:
    row = [gap * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], gap * i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(last + (match if x == y else differ), row[j] + gap, row[j - 1] + gap)
    return row[-1]


def _local(a: str, b: str, gap: float = -1.0, match: float = 1.0, differ: float = -1.0) -> float:
    row, best = [0.0] * (len(b) + 1), 0.0
    for x in a:
        last = 0.0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(0.0, last + (match if x == y else differ), row[j] + gap, row[j - 1] + gap)
            best = max(best, row[j])
    return best


def _batched(kernel, a: Column, b: Column) -> Column:
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if v is None or w is None else float(kernel(v, w)) for v, w in zip(x, y, strict=True)])

    return F.coalesce(F.pandas_udf(score, "double")(a, b), F.lit(float("nan")))


def jaro(a: Column, b: Column) -> Column:
    return _batched(_jaro, a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _batched(_winkler, a, b)


def needleman_wunsch(a: Column, b: Column) -> Column:
    """Score of the best global alignment: 1 for a match, -1 for a difference or a gap."""
    return _batched(_global, a, b)


def smith_waterman(a: Column, b: Column) -> Column:
    """Score of the best local alignment: 1 for a match, -1 for a difference or a gap."""
    return _batched(_local, a, b)
