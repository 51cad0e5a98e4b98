"""Queries of the operators in this folder, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, leak, leximin, lookalike, minhash, pieces, sentences, spans
from quarryline.llm.records import records
from quarryline.sources.tables import table


#: The scores that count in a query's ranking: mode and column.
P1_SOURCES = {"bm25": "search_score", "dense": "search_score", "hybrid+rerank": "rerank_score"}


def _p1_vectors(spark: SparkSession, d: str) -> DataFrame:
    score = F.coalesce(*[F.when(F.col("mode") == mode, F.col(column)) for mode, column in P1_SOURCES.items()])
    scores = table(spark, d, "retrieve").select(F.col("query_id").alias("grp"), F.col("id").alias("item"), F.col("mode").alias("source"), score.alias("score"))
    return leximin.percentile_vectors(scores, list(P1_SOURCES))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return leximin.first_of(_p1_vectors(spark, d)).select(F.col("grp").alias("query_id"), F.col("item").alias("id"))


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = leximin.ranking(_p1_vectors(spark, d))
    return ranked.select(F.col("grp").alias("query_id"), F.col("item").alias("id"), *[F.col("vector")[k].alias(f"p{k + 1}") for k in range(3)], "rank_no")


def _p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "retrieve"), "id", "content", "char_start")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_pieces(spark, d).select(F.col("key").alias("id")).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p2_pieces(spark, d).withColumnRenamed("key", "id")


def _p3_batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """The cross references, then the chunks of each configuration (an id is of one), as they would arrive one after another;
    null is a configuration of its own. With a fanout of 2 the runs are compacted on the way."""
    rows, other = table(spark, d, "retrieve"), F.coalesce(~F.col("config").isin("256-fixed", "512-fixed"), F.lit(True))
    return [records(table(spark, d, "cross_references"), "cross_references", "edge_id", "context")] + [
        records(rows.where(part), "retrieve", "id", "content") for part in (F.col("config") == "256-fixed", F.col("config") == "512-fixed", other)
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.records_sharing(_p3_batches(spark, d), fanout=2)


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(_p3_batches(spark, d), fanout=2)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_pairs(table(spark, d, "retrieve"), "id", "content", 0.70)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_groups(table(spark, d, "retrieve"), "id", "content", 0.70)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alikes(
        table(spark, d, "api"), "citation_id", "source_quote", table(spark, d, "designed_slice_final"), "query_id", "answer_passage"
    )


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every quote and passage with its consistent form."""
    quotes = table(spark, d, "api").select(F.lit("api").alias("rec_table"), F.col("citation_id").cast("long").alias("rec_id"), F.col("source_quote").alias("text"))
    passages = table(spark, d, "designed_slice_final").select(F.lit("designed_slice_final").alias("rec_table"), F.col("query_id").cast("long").alias("rec_id"), F.col("answer_passage").alias("text"))
    both = quotes.unionByName(passages).distinct()
    return lookalike.canonical(both, "text", "form", lookalike.rewriting(lookalike.frequencies(both))).select("rec_table", "rec_id", "form")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "lang", "doc_id", "text")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item that leaked, with the number of documents that hold a part of it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), "doc_id", "text", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_pieces, p3_found, p3_shared, p4_found, p4_forms, p5_found, p5_groups, p6_ids, p7_found, p7_leaked_items, p8_found)}


def oracle_sql() -> dict[str, str]:
    from quarryline.llm.sql import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
