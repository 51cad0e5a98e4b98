"""Retrieval runs in long form: one row for each retrieved chunk, query, mode and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import ntok

#: Results that a run keeps of a query: the feature of the retrieval pool.
POOL = 20
LIST = ["config", "mode", "query_id"]


def ranked(rows: DataFrame, pool: int = POOL, keep: list[str] | None = None) -> DataFrame:
    """(config, mode, query_id, rank, id, doc_id, char_start, char_end, token_count, search_score, rerank_score, ...keep):
    the first `pool` results of each list, rank being the position in the list from 1.

    A result that was delivered again counts once, its latest delivery; the window that numbers a list keeps at most `pool` rows of a
    list in each task. Where rows have their content, of which only the length goes further unless it is kept, a null char_end is
    filled from it and token_count, which sources get wrong, is taken from it; without content a null token_count is 0.
    """
    cols = [*LIST, "rank_no", "id", "doc_id", "char_start", "char_end", "token_count", "search_score", "rerank_score", *(keep or [])]
    content = F.col("content") if "content" in rows.columns else F.lit(None).cast("string")
    filled = rows.withColumns({"char_end": F.coalesce("char_end", F.col("char_start") + F.length(content)), "token_count": F.coalesce(ntok(content), "token_count", F.lit(0))})
    last = Window.partitionBy(*LIST, "rank_no", "id").orderBy(F.col("loaded_at").desc_nulls_last())
    once = filled.select(*cols, "loaded_at").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "loaded_at")
    order = Window.partitionBy(*LIST).orderBy(F.col("rank_no").asc_nulls_last(), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).drop("rank_no")
