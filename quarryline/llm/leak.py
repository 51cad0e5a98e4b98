"""Evaluation items that appear in a corpus, whole or in part, by a prefix-filtered set join.

A leak is a run of RUN consecutive words of an item (for items without word gaps, UNITS letters and digits) in a document.
Every window of that length in an item is a set of shingles, all of which the document must hold. The shingles are ordered
by how many documents hold them; of each window only the rarest, its necessary prefix for full containment, is joined
with the documents. Of a document's shingles only those leave their task that a Bloom filter of the wanted ones lets pass: all
in a first pass, to count the documents that hold them, and the rarest, with the words around them, in a second.
A hit's place in the window bounds where the window lies in the document, by position and by what is
left of the document on either side; the words there are compared with the window's one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import kernel as K
from quarryline.llm.bloom import BITS, passing, read_filter, write_filter
from quarryline.shared import written

#: Words and shingle of items with words; letters or digits and shingle of items in languages without word gaps.
MODES = {"word": (12, 5), "unit": (30, 15)}
UNSPACED = ["zh", "ja"]


def _hashes(mode: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return K.word_hashes(texts, "marked") if mode == "word" else K.unit_hashes(texts)


def item_windows(items: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(item, mode, at, words, shingles) of every window of every item: its first word's place, the hashes of its
    words and of its shingles. An item shorter than a window has none: it can't leak."""

    def run(batches):
        for b in batches:
            rows = []
            for item, t, mode in zip(*(b.column(c).to_pylist() for c in ("item", "text", "mode")), strict=True):
                n, k = MODES[mode]
                words, bounds = _hashes(mode, [t])
                shingles, _ = K.shingle_hashes(words, bounds, k)
                rows += [(item, mode, at, words[at : at + n].view(np.int64).tolist(), shingles[at : at + n - k + 1].view(np.int64).tolist()) for at in range(len(words) - n + 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field("item").type, pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item", "mode", "at", "words", "shingles"])

    kind = items.schema[key].dataType.simpleString()
    mode = F.when(F.lower(F.col(lang)).isin(UNSPACED), "unit").otherwise("word")
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text"), mode.alias("mode")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    return rows.mapInArrow(run, f"item {kind}, mode string, at int, words array<long>, shingles array<long>")


def _looked_up(batches, wanted: tuple[str, int]):
    """Document keys, texts and, by mode, word hashes, bounds, shingles that the filter `wanted` lets pass and their owners."""
    words_of = read_filter(*wanted)
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        keys = b.column("doc")
        for i, j in K.chunks(texts):
            for mode in MODES:
                words, bounds = _hashes(mode, texts[i:j])
                shingles, at = K.shingle_hashes(words, bounds, MODES[mode][1])
                hit = passing(shingles, words_of)
                shingles, at = shingles[hit], at[hit]
                yield keys, i, mode, words, bounds, shingles, at, np.searchsorted(bounds, at, "right") - 1


def _counter(wanted: tuple[str, int]):
    def run(batches):
        for *_, mode, _words, _bounds, shingles, _at, owner in _looked_up(batches, wanted):
            order = np.lexsort((owner, shingles))
            s, o = shingles[order], owner[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
            values, counts = np.unique(s[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([mode] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["mode", "shingle", "docs"])

    return run


def _hits(wanted: tuple[str, int]):
    def run(batches):
        for keys, first, mode, words, bounds, shingles, at, owner in _looked_up(batches, wanted):
            n, k = MODES[mode]
            # What may belong to a window around the hit, cut to its document; `left` words of it stand before the hit.
            low, high = np.maximum(bounds[owner], at - n + k), np.minimum(bounds[owner + 1], at + n)
            ok = high - low >= n
            low, high, at, shingles, owner = (x[ok] for x in (low, high, at, shingles, owner))
            ends = np.append(0, np.cumsum(high - low))
            places = np.arange(ends[-1]) + np.repeat(low - ends[:-1], high - low)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(owner + first)), pa.array([mode] * len(at), pa.string()), pa.array(shingles.view(np.int64)), pa.array((at - low).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words[places].view(np.int64))),
                ],
                names=["doc", "mode", "shingle", "left", "around"],
            )

    return run


def leaks(items: DataFrame, docs: DataFrame, item_key: str, item_text: str, lang: str, doc_key: str, doc_text: str, bits: int = BITS) -> DataFrame:
    """(item_key, doc_key): each item and document that share a run of at least 12 consecutive words, for items in
    UNSPACED languages of 30 consecutive letters and digits. Words are runs of letters, combining marks and digits; case,
    punctuation, gaps and line ends don't count.

    Null keys and null texts share nothing; repeated rows count once; either table may be empty; texts are read whole.
    bits: the logarithm of the filter's size; it changes what is shuffled, not what is found.
    """
    windows = written(item_windows(items, item_key, item_text, lang), "leak-windows")
    shingled = windows.select("item", "mode", "at", "words", F.posexplode("shingles").alias("k", "shingle"))
    kind = docs.schema[doc_key].dataType.simpleString()
    corpus = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")

    def filter_of(rows: DataFrame) -> tuple[str, int]:
        return write_filter(rows.select(F.col("shingle").alias("value")), bits), bits

    wanted = shingled.select("mode", "shingle").distinct()
    counts = corpus.mapInArrow(_counter(filter_of(wanted)), "mode string, shingle long, docs long")
    # What the filter let pass without being wanted finds no partner in the join below.
    held = counts.groupBy("mode", "shingle").agg(F.sum("docs").alias("docs"))
    # A window with a shingle that no document holds can't be in any; of the others, the rarest shingle.
    rarest = Window.partitionBy("item", "mode", "at").orderBy("docs", "shingle", "k")
    size = {m: n - k + 1 for m, (n, k) in MODES.items()}
    prefix = (
        shingled.join(held, ["mode", "shingle"])
        .withColumns({"rank": F.row_number().over(rarest), "found": F.count("*").over(Window.partitionBy("item", "mode", "at"))})
        .where("rank = 1")
        .where((F.col("mode") == "word") & (F.col("found") == size["word"]) | (F.col("mode") == "unit") & (F.col("found") == size["unit"]))
        .select("item", "mode", "words", "k", "shingle")
    )
    prefix = written(prefix, "leak-prefix")
    hits = corpus.mapInArrow(_hits(filter_of(prefix)), f"doc {kind}, mode string, shingle long, left int, around array<long>")
    found = hits.join(prefix, ["mode", "shingle"]).where("left >= k AND slice(around, left - k + 1, size(words)) = words")
    return found.select(F.col("item").alias(item_key), F.col("doc").alias(doc_key)).distinct()
