"""Keyword and vector search, fusion and reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import words
from quarryline.operators import postings
from quarryline.shared import scratch_path, written

K1, B, RRF = 1.2, 0.75, 60
#: Queries that a task of keyword search holds, at least and at most.
LEAST, SHARE = 64, 4096
#: Query vectors that a task holds at a time.
BLOCK = 4096


def _top(scored: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, query_id: str, query: str, docs: DataFrame, doc_id: str, text: str, k: int = 20) -> DataFrame:
    """(query_id, doc_id, score, rank): Okapi BM25 over words, each query word once, the best k, ties by doc_id.

    Exact. The asked words of each document, counted, are a table in the shared folder, in the order of ids. Each task holds a share of
    the queries and reads that table once (postings.best), so that neither scores nor candidates are shuffled. The number of
    documents and their mean length go through the driver. A doc_id stands in one row of docs; null ids and null texts take no part."""
    spark = docs.sparkSession
    vocabulary, frequency, ordered = (scratch_path(spark, name) for name in ("vocabulary", "frequency", "postings"))
    query_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (docs, doc_id)))
    terms = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(F.col(query)))).alias("term"))
    asked = written(terms.groupBy("query_id").agg(F.collect_set("term").alias("terms")), "asked")
    asked.select(F.explode("terms").alias("term")).distinct().write.parquet(vocabulary)
    split = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("key"), words(F.col(text)).alias("w"))
    counted = written(split.mapInArrow(postings.counts(vocabulary), f"key {doc_type}, len int, terms array<int>, tfs array<int>"), "counts")
    n, avg_len = counted.agg(F.count("*"), F.avg("len")).first()
    counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(frequency)
    counted.where(F.size("terms") > 0).repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(ordered)
    cores = spark.sparkContext.defaultParallelism
    n_asked = asked.count()
    tasks = min(-(-n_asked // LEAST), cores * -(-n_asked // (SHARE * cores)))
    found = asked.repartition(max(1, tasks)).mapInArrow(postings.best(vocabulary, frequency, ordered, n, avg_len or 1.0, k, K1, B), f"query_id {query_type}, key {doc_type}, score double, rank int")
    return found.select(F.col("query_id").alias(query_id), F.col("key").alias(doc_id), "score", "rank")


def _unit(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).distinct()


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors, from the batch's own buffers; vectors of length zero are left out."""
    of, lists = batch.column("key").to_numpy(zero_copy_only=False), batch.column("v")
    v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
    size = np.linalg.norm(v, axis=1)
    return of[size > 0], v[size > 0] / size[size > 0, None]


def nearest_to(asked: DataFrame, asked_key: str, asked_vector: str, vectors: DataFrame, key: str, vector: str, k: int = 20, others: bool = False) -> DataFrame:
    """(query_id, key, score, rank): of every asked row the k vectors of greatest cosine, ties by key. Exhaustive: the asked rows are
    a table in the shared folder that each task reads in blocks of fixed size against its own rows, of which it passes on the best
    k of each; nothing goes through the driver. Null vectors and vectors of length zero have no neighbours and are none. With
    `others` a row is no neighbour of the asked row of the same key."""
    path = scratch_path(vectors.sparkSession, "queries")
    _unit(asked, asked_key, asked_vector).write.parquet(path)
    own_rows = _unit(vectors, key, vector)
    asked_type, key_type = (df.schema[c].dataType.simpleString() for df, c in ((asked, asked_key), (vectors, key)))

    def run(batches):
        import pyarrow.dataset as ds
        from pyarrow import fs

        kind, own = None, []
        for b in batches:
            kind = b.schema.field("key").type
            if b.num_rows:
                own.append(_matrix(b))
        own = [x for x in own if len(x[0])]
        if not own:
            return
        keys, v = (np.concatenate([x[i] for x in own]) for i in (0, 1))
        where, at = fs.FileSystem.from_uri(path)
        n = min(k + (1 if others else 0), len(keys))
        for block in ds.dataset(at, filesystem=where, format="parquet").to_batches(batch_size=BLOCK):
            of, q = _matrix(block) if block.num_rows else ((), ())
            for i in range(0, len(of), 64):
                score = np.round(q[i : i + 64] @ v.T, 6)
                if others:
                    score[of[i : i + 64, None] == keys[None, :]] = -2
                # Equal scores at the border are kept whole, so that ties are settled by key afterwards.
                least = np.partition(score, len(keys) - n, axis=1)[:, len(keys) - n]
                row, col = np.nonzero((score >= least[:, None]) & (score > -2))
                yield pa.RecordBatch.from_arrays([pa.array(of[i + row], block.schema.field("key").type), pa.array(keys[col], kind), pa.array(score[row, col])], names=["query_id", "key", "score"])

    found = own_rows.mapInArrow(run, f"query_id {asked_type}, key {key_type}, score double").withColumnRenamed("key", key)
    return _top(found, ["query_id"], key, k)


def nearest(vectors: DataFrame, key: str, vector: str, asked: Column, k: int = 20) -> DataFrame:
    """(query_id, key, score, rank): of every row that is asked for the k others of greatest cosine. As nearest_to()."""
    return nearest_to(vectors.where(asked), key, vector, vectors, key, vector, k, others=True)


def fuse(lists: DataFrame, by: list[str], item: str, rank: str, k: int = 20) -> DataFrame:
    """(...by, item, score, rank): reciprocal rank fusion of all lists of a group, an item that a list lacks counting nothing
    there; the best k, ties by item."""
    scored = lists.groupBy(*by, item).agg(F.round(F.sum(1.0 / (RRF + F.col(rank))), 6).alias("score"))
    return _top(scored, by, item, k)


def rerank(lists: DataFrame, by: list[str], score: str, rank: str) -> DataFrame:
    """lists with new_rank: the same results by score, greatest first and null last, ties in their order before."""
    return lists.withColumn("new_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), rank)))
