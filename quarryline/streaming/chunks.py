"""Chunks of documents that keep arriving: an addition to the batch operators, with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarryline.operators import chunking


def chunk_stream(docs: DataFrame, to: str, checkpoint: str, most: int = 512, overlap: int = 64) -> StreamingQuery:
    """Cut every arriving document (doc_id, text) into fixed windows and append them to the table at `to`; each document is cut
    once, also after a restart from the checkpoint. Stateless: no document waits for another."""
    chunks = chunking.fixed(docs, "doc_id", "text", most, overlap)
    return chunks.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_document_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
