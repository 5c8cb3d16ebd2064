"""Text similarity: 2 * LCS / (len a + len b), the normalised indel ratio."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Executors need not have this package installed: what runs there travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by the bit-vector recurrence (one big-integer step per character)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if total == 0 else 2.0 * lcs_length(a, b) / total


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = indel_ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Ratio of two texts, NULL when either is NULL.

    Row-local, so a pair that a third of all rows share costs nothing extra: no join on the
    texts is needed, and a repeated pair is computed once per batch. Equal texts are settled
    before the call and reach Python only as NULLs.
    """
    differs = a != b
    # Made on use: a vectorised UDF needs a running session. Not deterministic in name only:
    # a filter on the result would otherwise be pushed below the call and call it twice.
    udf = pandas_udf(_ratios, "double").asNondeterministic()
    ratio = udf(F.when(differs, a), F.when(differs, b))
    return F.when(a == b, F.lit(1.0)).otherwise(ratio)
