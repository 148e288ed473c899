"""Functions that no composition of Spark's own can express, as vectorised pandas UDFs."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series(pd.NA, a.index, dtype="Int64")
    out[known] = np.gcd(a[known].astype("int64"), b[known].astype("int64"))
    return out


def lcm(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series(pd.NA, a.index, dtype="Int64")
    out[known] = np.lcm(a[known].astype("int64"), b[known].astype("int64"))
    return out


def lgamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.lgamma(v) if v is not None and v > 0 else None).astype(float)


def nextafter(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.astype(float), y.astype(float)), x.index)


def jaro_score(a: str, b: str) -> float:
    """Share of characters that match within half the longer length, less transpositions."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if at is not None:
            free[at] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    m, swapped = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_score(x, y) for x, y in zip(a, b, strict=True)], a.index, dtype=float)


def merged(a, b):
    """RFC 7396: members of b replace those of a, nulls remove them."""
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def merge_patch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else json.dumps(merged(json.loads(x), json.loads(y)), separators=(",", ":")) for x, y in zip(a, b, strict=True)], a.index, dtype=object)


#: Result types by name.
FUNCTIONS = {"gcd": (gcd, "long"), "lcm": (lcm, "long"), "lgamma": (lgamma, "double"), "nextafter": (nextafter, "double"), "jaro": (jaro, "double"), "merge_patch": (merge_patch, "string")}


def register(spark: SparkSession) -> None:
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(f"millrace_{name}", pandas_udf(function, kind))
