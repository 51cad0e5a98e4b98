"""One ranking from several differently-scaled scores, by leximin ordering of percentiles.

Each score becomes the share of the group's other items that stand below it in that list, so only the order within a list
counts and no scale does. An item's percentiles sorted from the weakest on are compared lexicographically: the
better weakest score wins, then the next, so a strong score can't mask a weak one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ranking import positions, running_sum
from quarryline.shared import written


def percentile_vectors(scores: DataFrame, sources: list[str]) -> DataFrame:
    """Of scores (grp, item, source, score): (grp, item, vector), the vector ascending, one percentile for each source.

    Candidates of a group are all its items, whatever their source; a score that is missing, null or NaN stands last in
    its list, equal to all others that are missing there; equal scores are equal. Of repeated rows the greatest score
    counts. Rows with a null group or item are left out. A single candidate has percentiles 0.
    """
    rows = scores.where("grp IS NOT NULL AND item IS NOT NULL")
    best = rows.groupBy("grp", "item", "source").agg(F.max(F.expr("if(isnan(score), NULL, score)")).alias("score"))
    best = written(best, "leximin-scores")
    sizes = best.groupBy("grp", "item").agg(F.lit(1).alias("one")).groupBy("grp").agg(F.count("*").alias("n"))
    listed = best.where(F.col("source").isin(sources) & F.col("score").isNotNull())
    distinct = listed.groupBy("grp", "source", "score").agg(F.count("*").alias("ties"))
    totals = listed.groupBy("grp", "source").agg(F.count("*").alias("total"))
    below = running_sum(distinct, ["grp", "source"], [F.col("score")], "ties", "upto")
    percent = (
        below.join(totals, ["grp", "source"])
        .join(sizes, "grp")
        .select("grp", "source", "score", ((F.col("n") - F.col("total") + F.col("upto") - F.col("ties")) / F.greatest(F.lit(1), F.col("n") - 1)).alias("p"))
    )
    scored = listed.join(percent, ["grp", "source", "score"])
    each = [F.coalesce(F.max(F.when(F.col("source") == s, F.col("p"))), F.lit(0.0)) for s in sources]
    everyone = scored.select("grp", "item", "source", "p").unionByName(best.select("grp", "item").distinct().withColumns({"source": F.lit(None).cast("string"), "p": F.lit(None).cast("double")}))
    return everyone.groupBy("grp", "item").agg(F.array_sort(F.array(*each)).alias("vector"))


def first_of(vectors: DataFrame) -> DataFrame:
    """(grp, item): the first of each group; of equal vectors the least item. Reduced on both sides of the shuffle."""
    size = F.transform("vector", lambda p: -p)
    return vectors.groupBy("grp").agg(F.min(F.struct(size.alias("v"), "item")).alias("top")).select("grp", "top.item")


def ranking(vectors: DataFrame) -> DataFrame:
    """(grp, item, vector, rank_no): all items of each group from 1 on; equal vectors in the order of items."""
    return positions(vectors, ["grp"], [F.transform("vector", lambda p: -p), F.col("item")], "rank_no")
