"""Rows of Arrow batches as Python texts, and record ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(df: DataFrame, table: str, key: str, text: str) -> DataFrame:
    """(rec_table, rec_key, text) of one table; rows without key or text are left out, they can't be named or compared."""
    return df.select(F.lit(table).alias("rec_table"), F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text")).where("rec_key IS NOT NULL AND text IS NOT NULL")


def fresh(batches: Iterator[pa.RecordBatch], keys: list[str], text: str) -> Iterator[tuple[list[tuple], list[str]]]:
    """Keys and texts of the rows, each row that repeats an earlier one of the same task (same keys, same text) left out.

    A repeat in another task stays; who uses this must treat equal rows as one. That saves a shuffle of all texts:
    repeats mostly stand near each other."""
    seen: set[int] = set()
    for b in batches:
        cols, texts = [b.column(k).to_pylist() for k in keys], b.column(text).to_pylist()
        own, out = [], []
        for row in zip(*cols, texts, strict=True):
            if (h := hash(row)) not in seen:
                seen.add(h)
                own.append(row[:-1])
                out.append(row[-1])
        if len(seen) > 2_000_000:
            seen.clear()
        if own:
            yield own, out
