"""Splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over WINDOW characters marks landmarks. A piece ends at the natural boundary nearest to the first
landmark that lies between the least and the greatest piece size: a paragraph's end near it, else a sentence's, a
line's, a word's; only where there is none it ends at the landmark or the limit itself. Landmarks depend on the
characters around them alone, so after an edit the old cuts come back within a piece or two.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import kernel as K

LIMIT, OVERLAP, WINDOW, SPACING, NEAR = 2048, 256, 48, 384, 192
#: Places after which a piece may end, the most natural first; each match's end is a boundary.
LEVELS = [
    re.compile(r"\n[^\S\n]*(?:\n\s*)|\r\n[^\S\n]*(?:\r\n\s*)"),
    re.compile(r"[.!?…؟۔।]['\"”’»)\]]*\s+|[。！？｡．][」』”’）]*\s*"),
    re.compile(r"\r\n|[\n\r ]"),
    re.compile(r"\s+|[、，；：]"),
]


def boundaries(text: str) -> list[np.ndarray]:
    return [np.fromiter((m.end() for m in level.finditer(text)), np.int64) for level in LEVELS]


def landmarks(text: str) -> np.ndarray:
    """Ends of windows whose hash is a landmark's, one in SPACING on average."""
    if len(text) < WINDOW:
        return np.empty(0, np.int64)
    h = K.prefix_hash(K.char_table("noise")[K.code_points(text)])
    at = np.arange(len(text) - WINDOW + 1)
    return np.flatnonzero(K.span_hash(h, at, at + WINDOW) % K.U64(SPACING) == 0) + WINDOW


def _between(sorted_places: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places in [low, high]."""
    return sorted_places[np.searchsorted(sorted_places, low) : np.searchsorted(sorted_places, high, "right")]


def _whole(text: str, at: int, step: int) -> int:
    """The nearest place from `at` on, in steps of 1 or -1, that parts neither a line end nor a letter from its marks."""
    for place in range(at, at + 16 * step, step):
        c = text[place] if place < len(text) else ""
        mark = c and (c in "\u200d\ufe0f" or K.char_table("marked")[ord(c)] and not K.char_table("alnum")[ord(c)])
        if not mark and not (c == "\n" and text[place - 1] == "\r"):
            return place
    return at


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the pieces: one for a text within the limit, none for an empty one. Together they hold each
    character; a piece has at most `limit` of them and begins at most `overlap` before the end of the one before."""
    n, least = len(text), max(overlap + 1, limit // 3)
    if n <= limit:
        return [(0, n)] if n else []
    marks, levels = landmarks(text), boundaries(text)
    out, s = [], 0
    while n - s > limit:
        low, high = s + least, s + limit
        found = _between(marks, low, high)
        aim = int(found[0]) if len(found) else high
        end = 0
        for near in (NEAR, limit):
            for places in levels:
                own = _between(places, max(low, aim - near), min(high, aim + near))
                if len(own):
                    end = int(own[np.abs(own - aim).argmin()])
                    break
            if end:
                break
        end = end or _whole(text, aim, -1)
        out.append((s, end))
        s = min(_whole(text, end - overlap, 1), end)
        for places, far in ((levels[0], overlap // 2), (levels[1], overlap // 2), (levels[2], overlap // 4), (levels[3], overlap // 4)):
            own = _between(places, end - overlap, end - overlap + far)
            if len(own):
                s = int(own[0])
                break
    out.append((s, n))
    return out


SCHEMA = "key string, base long, piece_no int, piece_start int, piece_end int, piece string"


def _cut(limit: int, overlap: int):
    def run(batches):
        for b in batches:
            rows = []
            for key, base, text in zip(*(b.column(c).to_pylist() for c in ("key", "base", "text")), strict=True):
                rows += [(key, base, k, s, e, text[s:e]) for k, (s, e) in enumerate(split(text, limit, overlap))]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                names = ["key", "base", "piece_no", "piece_start", "piece_end", "piece"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def pieces(df: DataFrame, key: str, text: str, start: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, piece_start, piece_end, char_start, piece) of each distinct key whose text exceeds `limit` code points.

    Sizes come from the text alone. char_start is the piece's place in the document: the column `start` plus piece_start,
    null where that is null. Repeated rows of a key count once; should its texts differ, the least one is cut. Null keys
    and null, empty and short texts give no pieces, nor does an empty table.
    """
    base = F.col(start).cast("long") if start else F.lit(0).cast("long")
    over = df.select(F.col(key).cast("string").alias("key"), base.alias("base"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") > limit))
    once = over.groupBy("key").agg(F.min(F.struct("text", "base")).alias("row")).select("key", "row.base", "row.text")
    return once.mapInArrow(_cut(limit, overlap), SCHEMA).select("key", "piece_no", "piece_start", "piece_end", (F.col("base") + F.col("piece_start")).alias("char_start"), "piece")
