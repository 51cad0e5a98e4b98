"""Cutting texts into chunks with exact offsets: fixed windows in the JVM, and a recursive splitter in Arrow batches.

Tokens are taken as four characters (text.ntok), so sizes in tokens are sizes in code points, unless a tokenizer is handed in: a
function from a text to the ends of its tokens in code points. Null and empty texts give no chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T

# Separators from the coarsest on, and the configurations of (name, most tokens, overlap).
SEPARATORS = ("\n\n", "\n", ". ", " ")
CONFIGS = (("256-fixed", 256, 32), ("512-fixed", 512, 64), ("512-recursive", 512, 64))
PER_TOKEN = 4


Tokenizer = Callable[[str], list[int]]
ROWS = "key {}, chunk_no int, char_start int, char_end int, content string"


def tokens(length: int) -> int:
    return max(1, round(length / PER_TOKEN))


def _cut(docs: DataFrame, key: str, text: str, places: Callable[[str], Iterator[tuple[int, int]]]) -> DataFrame:
    """(key, chunk_no, char_start, char_end, content) of the places of each text, in Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for doc, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows += [(doc, k, s, e, t[s:e]) for k, (s, e) in enumerate(places(t))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [b.schema.field("key").type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "chunk_no", "char_start", "char_end", "content"])

    rows = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ROWS.format(kind)).withColumnRenamed("key", key)


def _token_windows(text: str, most: int, overlap: int, tokenizer: Tokenizer) -> Iterator[tuple[int, int]]:
    ends = [0, *tokenizer(text)]
    n = len(ends) - 1
    for at in range(0, max(n, 1), most - overlap):
        yield ends[at], ends[min(at + most, n)]
        if at + most >= n:
            return


def fixed(docs: DataFrame, key: str, text: str, most: int, overlap: int, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(key, chunk_no, char_start, char_end, content): windows of `most` tokens, each `most - overlap` after the one before, until
    one reaches the end."""
    if tokenizer is not None:
        return _cut(docs, key, text, lambda t: _token_windows(t, most, overlap, tokenizer))
    width, stride = most * PER_TOKEN, (most - overlap) * PER_TOKEN
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - width) / F.lit(stride))).cast("int") * stride
    rows = docs.where(n > 0).select(key, text, F.posexplode(F.sequence(F.lit(0), last, F.lit(stride))).alias("chunk_no", "char_start"))
    return rows.select(key, "chunk_no", "char_start", F.least(F.col("char_start") + width, n).alias("char_end"), F.expr(f"substring({text}, char_start + 1, {width})").alias("content"))


def _count(text: str, tokenizer: Tokenizer | None) -> Callable[[int, int], int]:
    """The number of tokens of a part of the text; with a tokenizer of the part as a text of its own."""
    return (lambda a, b: tokens(b - a)) if tokenizer is None else (lambda a, b: len(tokenizer(text[a:b])))


def parts(text: str, low: int, high: int, most: int, level: int = 0, tokenizer: Tokenizer | None = None) -> Iterator[tuple[int, int]]:
    """Places that each hold at most `most` tokens: [low, high) cut after each separator of the level, and what is still too
    long after those of the next; after the last level into blocks. Parts adjoin, separators stay with what is before them."""
    if _count(text, tokenizer)(low, high) <= most:
        yield low, high
    elif level == len(SEPARATORS):
        if tokenizer is None:
            for at in range(low, high, most * PER_TOKEN):
                yield at, min(at + most * PER_TOKEN, high)
        else:
            yield from ((low + a, low + b) for a, b in _token_windows(text[low:high], most, 0, tokenizer))
    else:
        sep, at = SEPARATORS[level], low
        while at < high:
            found = text.find(sep, at, high)
            to = high if found < 0 else found + len(sep)
            yield from parts(text, at, to, most, level + 1, tokenizer)
            at = to


def merged(pieces: list[tuple[int, int]], most: int, overlap: int, count: Callable[[int, int], int] = lambda a, b: tokens(b - a)) -> Iterator[tuple[int, int]]:
    """Neighbouring parts joined up to `most` tokens. A chunk begins with the trailing parts of the one before that together
    hold at most `overlap`; that is not counted against `most` again, so a chunk may be larger by as much."""
    first = 0
    for k, (_, high) in enumerate(pieces):
        if k > first and count(pieces[first][0], high) > most:
            yield pieces[first][0], pieces[k - 1][1]
            back, held = k, 0
            while back > first and held + (t := count(*pieces[back - 1])) <= overlap:
                back, held = back - 1, held + t
            first = back
    if pieces:
        yield pieces[first][0], pieces[-1][1]


def recursive(docs: DataFrame, key: str, text: str, most: int, overlap: int, tokenizer: Tokenizer | None = None) -> DataFrame:
    """As fixed(), cut at the coarsest separators that keep chunks within `most` tokens."""
    return _cut(docs, key, text, lambda t: merged(list(parts(t, 0, len(t), most, 0, tokenizer)), most, overlap, _count(t, tokenizer)))


def build(docs: DataFrame, key: str, text: str, configs=CONFIGS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(config, id, key, char_start, char_end, token_count, content) of all configurations."""
    counted = T.ntok(F.col("content"))
    if tokenizer is not None:

        @F.pandas_udf("int")
        def size(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: len(tokenizer(t)))

        counted = size("content")
    out = None
    for name, most, overlap in configs:
        chunks = (recursive if name.endswith("recursive") else fixed)(docs, key, text, most, overlap, tokenizer)
        one = chunks.select(F.lit(name).alias("config"), F.concat_ws("_", F.col(key).cast("string"), "chunk_no").alias("id"), key, "char_start", "char_end", counted.alias("token_count"), "content")
        out = one if out is None else out.unionByName(one)
    return out


def verify(chunks: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(config, key, wrong, uncovered): of each document's chunks, how many differ from the text at their place, and how many of
    its code points no chunk holds."""
    seen = F.coalesce(F.max("char_end").over(Window.partitionBy("config", key).orderBy("char_start", "char_end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = chunks.join(docs.select(key, F.col(text).alias("__text")), key).withColumn("__gap", F.greatest(F.lit(0), F.col("char_start") - seen))
    differs = F.expr("substring(__text, char_start + 1, char_end - char_start)") != F.col("content")
    return (
        both.groupBy("config", key)
        .agg(F.count_if(differs).alias("wrong"), F.sum("__gap").alias("gaps"), F.max("char_end").alias("to"), F.max(F.length("__text")).alias("n"))
        .select("config", key, "wrong", (F.col("gaps") + F.col("n") - F.col("to")).cast("long").alias("uncovered"))
    )
