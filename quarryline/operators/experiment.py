"""Retrieval runs: every query against the chunks of every configuration, in every mode.

What computes vectors and what reranks is handed in, as functions of columns: a Spark expression or a pandas UDF.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import words
from quarryline.operators import search
from quarryline.operators.postings import list_rows
from quarryline.operators.runs import POOL
from quarryline.shared import written

MODES = ("bm25", "dense", "hybrid", "hybrid+rerank")


def word_counts(lists: pa.Array, size: int) -> pa.Array:
    """Of each list of words their counts by hash, damped; null for null. Each different word is hashed once."""
    length, row = list_rows(lists)
    words_of = lists.flatten().dictionary_encode()
    places = np.fromiter((zlib.crc32(w.encode("utf-8")) % size for w in words_of.dictionary.to_pylist()), np.int64, len(words_of.dictionary))
    n = np.bincount(row * size + places[words_of.indices.to_numpy()], minlength=len(length) * size)
    at = pa.array(np.arange(len(length) + 1, dtype=np.int32) * size)
    return pa.ListArray.from_arrays(at, pa.array(np.log1p(n).astype(np.float32)), mask=lists.is_null())


def hashed_words(size: int = 64) -> Callable[[Column], Column]:
    """An embedder that needs no model: counts of words by hash, in `size` dimensions, damped."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        return word_counts(texts, size)

    return lambda text: embed(words(text))


def shared_words(question: Column, content: Column) -> Column:
    """A reranker that needs no model: the share of the question's words that the content holds."""
    asked = F.array_distinct(words(question))
    return F.round(F.size(F.array_intersect(asked, words(content))) / F.greatest(F.lit(1), F.size(asked)), 6)


def produce(
    queries: DataFrame, query_id: str, query: str, chunks: DataFrame, configs: list[str], embedder: Callable[[Column], Column] | None = None, reranker: Callable[[Column, Column], Column] = shared_words, pool: int = POOL
) -> DataFrame:
    """(config, mode, query_id, rank, id, doc_id, char_start, char_end, token_count, search_score, rerank_score) of the first `pool`
    results of each query in each configuration and mode. chunks: (config, id, doc_id, char_start, char_end, token_count, content).

    hybrid fuses the keyword and the vector list; hybrid+rerank puts the same pool in the order of the reranker's scores, null
    last. Configurations are few and are searched one after another; null queries find nothing. Repeated queries count once."""
    embed = embedder or hashed_words()
    asked = queries.where(F.col(query_id).isNotNull() & F.col(query).isNotNull()).groupBy(F.col(query_id).alias("query_id")).agg(F.min(query).alias("question"))
    asked = written(asked.withColumn("v", embed(F.col("question"))), "asked")
    out = None
    for config in configs:
        own = written(chunks.where(F.col("config") == config).withColumn("v", embed(F.col("content"))), "chunks")
        by_word = search.bm25(asked, "query_id", "question", own, "id", "content", pool)
        by_vector = search.nearest_to(asked, "query_id", "v", own, "id", "v", pool)
        both = written(by_word.withColumn("mode", F.lit("bm25")).unionByName(by_vector.withColumn("mode", F.lit("dense"))), "lists")
        fused = written(search.fuse(both, ["query_id"], "id", "rank", pool), "fused")
        place = own.select("id", "doc_id", "char_start", "char_end", "token_count", "content")
        scored = fused.join(place.select("id", "content"), "id").join(asked.select("query_id", "question"), "query_id").withColumn("rerank_score", reranker(F.col("question"), F.col("content")))
        again = search.rerank(scored, ["query_id"], "rerank_score", "rank").select("query_id", "id", "score", F.col("new_rank").alias("rank"), "rerank_score")
        lists = both.unionByName(fused.withColumn("mode", F.lit("hybrid"))).withColumn("rerank_score", F.lit(None).cast("double")).unionByName(again.withColumn("mode", F.lit("hybrid+rerank")))
        one = lists.join(place.drop("content"), "id").select(F.lit(config).alias("config"), "mode", "query_id", "rank", "id", "doc_id", "char_start", "char_end", "token_count", F.col("score").alias("search_score"), "rerank_score")
        out = one if out is None else out.unionByName(one)
    return out
