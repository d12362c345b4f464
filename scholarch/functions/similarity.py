"""Matching-blocks ratio of two strings (Arrow-batched) and the code similarity built on it.

Callers score DISTINCT pairs only and join the scores back.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2*M/T over recursively found longest matching blocks; 0 when either side is null."""
    pairs = zip(left, right)
    return pd.Series(
        [
            difflib.SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else 0.0
            for a, b in pairs
        ],
        dtype="float64",
    )


def code_similarity(left: Column, right: Column, ratio: Column | None = None) -> Column:
    """Ratio + 0.05 for the same first character + 0.03 for lengths within one, at most 1."""
    ratio = sequence_ratio(left, right) if ratio is None else ratio
    first = F.when(F.substring(left, 1, 1) == F.substring(right, 1, 1), 0.05).otherwise(0.0)
    near = F.when(F.abs(F.length(left) - F.length(right)) <= 1, 0.03).otherwise(0.0)
    empty = left.isNull() | right.isNull() | (left == "") | (right == "")
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), ratio + first + near))


@lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _code_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    bonus = 0.05 * (a[0] == b[0]) + 0.03 * (abs(len(a) - len(b)) <= 1)
    return min(1.0, _ratio(a, b) + bonus)


# fixed values: least scores for a code and for a name to count as the same
MIN_CODE_SCORE = 0.72
MIN_NAME_RATIO = 0.75


@F.pandas_udf(ArrayType(IntegerType()))
def assign_remaining(wanted: pd.Series, exact: pd.Series, index: pd.Series, code: pd.Series) -> pd.Series:
    """Complete an exact assignment greedily: leftovers in order, best open code, earliest on ties."""

    def row(want, have, idx, left):
        if want is None or have is None:
            return None
        taken = {w: p for w, p in zip(want, have) if p >= 0}
        free = [w for w in dict.fromkeys(want) if w and w not in taken]
        for i, c in zip(idx if idx is not None else [], left if left is not None else []):
            scored = [(_code_score(c, w), w) for w in free]
            best = max(scored, key=lambda t: t[0], default=(0.0, None))
            if best[0] >= MIN_CODE_SCORE:
                taken[best[1]] = i
                free.remove(best[1])
        return [int(taken.get(w, -1)) for w in want]

    return pd.Series([row(*values) for values in zip(wanted, exact, index, code)])


_REPAIR = StructType([StructField("names", ArrayType(StringType())), StructField("n_fixed", IntegerType())])


@F.pandas_udf(_REPAIR)
def repaired_names(names: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Names moved to close reference names, with the number of changes."""

    def row(mine, ref):
        if mine is None or ref is None:
            return None, 0
        ref, out, fixed = list(ref), list(mine), 0
        for at, name in enumerate(out):
            if len(out) == len(ref):
                near = name.upper() != ref[at] and _ratio(name.upper(), ref[at]) >= MIN_NAME_RATIO
                hit = ref[at] if near else None
            else:
                hit = next(iter(difflib.get_close_matches(name.upper(), ref, n=1, cutoff=MIN_NAME_RATIO)), None) if name else None
            if hit is not None:
                out[at], fixed = hit, fixed + 1
        return out, fixed

    return pd.DataFrame([row(*values) for values in zip(names, reference)], columns=["names", "n_fixed"])
