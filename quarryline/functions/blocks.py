"""Common blocks of two texts, by windows of equal hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

BASE = 0x9E3779B97F4A7C15 | 1


def _windows(text: str, n: int) -> np.ndarray:
    """Hashes of all n consecutive characters, modulo 2**64."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power = np.multiply.accumulate(np.concatenate([[1], np.full(len(code), BASE, np.uint64)]).astype(np.uint64))
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * power[:-1])])
    # Windows at i and j are compared as h * BASE**(last - i): the same power for all.
    return (h[n:] - h[:-n]) * power[len(code) - n :: -1][: len(code) - n + 1]


def holds_block(part: str, text: str, n: int) -> bool:
    """Whether n consecutive characters of part stand in text; time grows with the lengths' sum."""
    if n < 1:
        return True
    if min(len(part), len(text)) < n:
        return False
    # One joined text, so that both have the same powers.
    all_of = _windows(part + text, n)
    own, other = all_of[: len(part) - n + 1], all_of[len(part) :]
    return any(part[i : i + n] in text for i in np.flatnonzero(np.isin(own, other)))


def mostly_in(share: float):
    """(quote, text) -> whether a block of more than `share` of the quote stands in the text; null where either is null."""

    @F.pandas_udf(BooleanType())
    def judged(quote: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or t is None else bool(q) and holds_block(q, t, int(share * len(q)) + 1) for q, t in zip(quote, text, strict=True)], dtype=object)

    return judged
