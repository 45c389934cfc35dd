"""Name similarity 0..100 as vectorised UDFs, applied to blocked pairs only.

The base score is 200 * LCS / (len a + len b), the insert/delete similarity;
the built-in edit distance counts substitutions and is a different measure.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# executors get the functions themselves, whether or not they can import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - bin(row).count("1")


def plain(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common(a, b) / total if total else 100.0


def partial(a: str, b: str) -> float:
    """Best score of the shorter text against any window of the longer one, cut windows at its ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    best = 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start):start + n]
        best = max(best, plain(short, window))
        if best == 100.0:
            break
    return best


def token_sort(a: str, b: str) -> float:
    return plain(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (not x - y or not y - x):
        return 100.0
    head = " ".join(sorted(both))
    left = " ".join(filter(None, [head, " ".join(sorted(x - y))]))
    right = " ".join(filter(None, [head, " ".join(sorted(y - x))]))
    scores = [plain(left, right)]
    if both:
        scores += [plain(head, left), plain(head, right)]
    return max(scores)


def _vector(score):
    @pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return apply


def ratio(a, b) -> Column:
    return _vector(plain)(a, b)


def partial_ratio(a, b) -> Column:
    return _vector(partial)(a, b)


def token_sort_ratio(a, b) -> Column:
    return _vector(token_sort)(a, b)


def token_set_ratio(a, b) -> Column:
    return _vector(token_set)(a, b)
