"""Sequence similarity and unified diffs; Python's difflib, batched through Arrow."""

from __future__ import annotations

from difflib import SequenceMatcher, unified_diff

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def ratio(a: str | None, b: str | None) -> float | None:
    """Matching characters times two by both lengths; two empty texts are equal. Order matters."""
    if a is None or b is None:
        return None
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def diff(original: str | None, corrected: str | None) -> str | None:
    """Unified diff with three lines of context; empty for equal texts."""
    if original is None or corrected is None:
        return None
    if original == corrected:
        return ""
    return "".join(unified_diff(original.splitlines(keepends=True), corrected.splitlines(keepends=True), fromfile="original", tofile="corrected", n=3))


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def unified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([diff(x, y) for x, y in zip(a, b)], dtype="object")
