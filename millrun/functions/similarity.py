"""String and vector similarity helpers.

Edit distance and set / vector cosine are built-in expressions. Jaro-Winkler is not in Spark,
so it is an Arrow-batched pandas UDF; callers apply it to blocked candidate pairs only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values of the Jaro-Winkler rule: prefix weight 0.1 over at most 4 characters,
# applied when the Jaro score exceeds 0.7.
JW_PREFIX_WEIGHT = 0.1
JW_MAX_PREFIX = 4
JW_BOOST_THRESHOLD = 0.7


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two strings (1.0 for two empty strings)."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    window = max(max(la, lb) // 2 - 1, 0)
    a_used = [False] * la
    b_used = [False] * lb
    matches = 0
    for i, ch in enumerate(a):
        lo, hi = max(0, i - window), min(lb, i + window + 1)
        for j in range(lo, hi):
            if not b_used[j] and b[j] == ch:
                a_used[i] = b_used[j] = True
                matches += 1
                break
    if matches == 0:
        return 0.0
    a_m = [a[i] for i in range(la) if a_used[i]]
    b_m = [b[j] for j in range(lb) if b_used[j]]
    # transpositions are half the out-of-order matches, halved with integer division as in the
    # original strcmp95 definition
    transpositions = sum(x != y for x, y in zip(a_m, b_m)) // 2
    jaro = (matches / la + matches / lb + (matches - transpositions) / matches) / 3.0
    if jaro <= JW_BOOST_THRESHOLD:
        return jaro
    prefix = 0
    for x, y in zip(a[:JW_MAX_PREFIX], b[:JW_MAX_PREFIX]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * JW_PREFIX_WEIGHT * (1.0 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Vectorised over an Arrow batch of candidate pairs."""
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def char_trigrams(s: Column) -> Column:
    """Distinct character trigrams of a string; shorter non-empty strings are one token."""
    n = F.length(s)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(s, i, F.lit(3)))
    return (
        F.when(n >= 3, F.array_distinct(grams))
        .when(n > 0, F.array(s))
        .otherwise(F.array().cast("array<string>"))
    )


def set_cosine(a: Column, b: Column) -> Column:
    """Ochiai coefficient |A n B| / sqrt(|A| |B|); two empty sets are identical."""
    sa, sb = F.size(a), F.size(b)
    return (
        F.when((sa == 0) & (sb == 0), F.lit(1.0))
        .when((sa == 0) | (sb == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(sa * sb))
    )


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
