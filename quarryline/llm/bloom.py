"""A Bloom filter of fixed size as a table in the shared folder.

Its size doesn't depend on what it holds: 2**BITS bits, at most 16 MB, which is what each worker loads. With more values only
more of the others pass, and what passes is joined exactly afterwards, so there is one plan at every size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import kernel as K
from quarryline.shared import scratch_path

BITS = 27


def write_filter(values: DataFrame, bits: int = BITS) -> str:
    """The path of the filter of a table of one column, `value` (long): two bits of each, collected by words of 64."""
    places = F.explode(F.array(*[F.expr(f"shiftrightunsigned(value, {64 - bits - s * bits}) & {(1 << bits) - 1}L") for s in range(2)])).alias("place")
    words = values.select(places).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63L as int))")).alias("bits"))
    path = scratch_path(values.sparkSession, "bloom")
    words.write.option("compression", "zstd").parquet(path)
    return path


@lru_cache(maxsize=4)
def read_filter(path: str, bits: int = BITS) -> np.ndarray:
    """The words of the filter, in a worker."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    out = np.zeros(1 << (bits - 6), np.uint64)
    where, at = fs.FileSystem.from_uri(path)
    for b in ds.dataset(at, filesystem=where, format="parquet").to_batches():
        out[b.column("word").to_numpy(zero_copy_only=False)] = b.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
    return out


def passing(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Indexes of the 64-bit values that the filter may hold; all that it holds are among them."""
    at, bits = np.arange(len(values)), len(words).bit_length() + 5
    for s in range(2):
        place = (values[at] >> K.U64(64 - bits - s * bits)) & K.U64((1 << bits) - 1)
        at = at[((words[(place >> K.U64(6)).astype(np.int64)] >> (place & K.U64(63))) & K.U64(1)).astype(bool)]
    return at
