"""String similarities between 0 and 1, in vectorised Python functions: Spark has none that counts common subsequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORERS = ("ratio", "token_sort", "token_set", "max3")


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of the dynamic program as the bits of a number."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 1.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0,)))


def similarity(a: str | None, b: str | None, scorer: str = "ratio") -> float:
    """0 for nulls and empty strings."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer: {scorer}")
    if not a or not b:
        return 0.0
    if scorer == "max3":
        return max(ratio(a, b), token_sort(a, b), token_set(a, b))
    return {"ratio": ratio, "token_sort": token_sort, "token_set": token_set}[scorer](a, b)


def fuzzy_score(a, b, scorer: str = "ratio") -> Column:
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer: {scorer}")

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q, scorer) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def fuzzy_match(a, b, scorer: str = "ratio", threshold: float = 0.95) -> Column:
    return fuzzy_score(a, b, scorer) >= threshold


def fuzzy_tuple_match(a, b, scorer: str = "ratio", threshold: float = 0.95) -> Column:
    """Arrays of equal length whose items all match."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer: {scorer}")

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        same = lambda p, q: p is not None and q is not None and len(p) == len(q) and all(similarity(i, j, scorer) >= threshold for i, j in zip(p, q, strict=True))
        return pd.Series([same(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    return run(a, b)
