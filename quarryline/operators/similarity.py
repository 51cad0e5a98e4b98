"""Similar sets by a prefix filter that knows both sizes.

Tokens of a set are ordered from the rarest on. Sets of nx and ny tokens with a Jaccard similarity of at least t share
alpha = ceil(t / (1 + t) * (nx + ny)) of them, so one of the first n - alpha + 1 of either side. Sizes are parted into
classes of a constant ratio, and a set joins each class of partners with the prefix that this class asks for: against
sets of its own size that is n * (1 - t) / (1 + t), not n * (1 - t), so text that all records have in common, up to just
the share that makes them similar, stands behind every prefix and joins nothing.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.shared import written

#: The ratio of the greatest to the least size of a class.
RATIO = 1 + 1 / 16


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: candidate pairs of items of (item, tokens), with none at or above the threshold left out. tokens: an
    array without repeats. Empty and null sets pair with nothing; an item must stand in one row.

    A pair is kept at a token that can be their first common one: what follows it on either side must suffice for alpha.
    """
    t, step = float(threshold), log(RATIO)
    one = sets.select("item", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # Tokens of one set only come first in its order; their number is enough, they take no part in the join.
    own = Window.partitionBy("item")
    placed = (
        one.join(often, "token")
        .withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")))
        .where(F.expr(f"at <= n - ceil({t}D * n - 1e-9D) + 1"))
    )
    # Both sides of the join read the prefixes; they are a part of the sets and are made once.
    placed = written(placed, "prefixes")
    cls = lambda n: f"cast(floor(ln({n}) / {step}D) as int)"
    least = f"greatest(ceil({t}D * n - 1e-9D), 1)"
    each = placed.select(
        "item", "n", "token", "at", F.expr(cls("n")).alias("own"), F.explode(F.expr(f"sequence({cls(least)}, {cls(f'greatest(floor(n / {t}D + 1e-9D), 1)')})")).alias("other")
    )
    # The least size that a partner of the class can have asks for the longest prefix.
    partner = f"greatest(ceil(pow({RATIO}D, other) * (1 - 1e-9D)), {least})"
    each = each.where(F.expr(f"at <= n - ceil({t / (1 + t)}D * (n + {partner}) - 1e-9D) + 1"))
    low = each.where("own <= other").select("token", F.col("own").alias("lo"), F.col("other").alias("hi"), F.col("item").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    high = each.where("own >= other").select("token", F.col("other").alias("lo"), F.col("own").alias("hi"), F.col("item").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    enough = f"1 + least(nx - ax, ny - ay) >= ceil({t / (1 + t)}D * (nx + ny) - 1e-9D)"
    met = low.join(high, ["token", "lo", "hi"]).where(F.expr(f"x <> y AND (lo < hi OR x < y) AND {enough}"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of items of (item, tokens) whose Jaccard similarity is at least threshold."""
    side = lambda x: sets.select(F.col("item").alias(x), F.col("tokens").alias(f"t{x}"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .withColumn("shared", F.size(F.array_intersect("ta", "tb")))
        .select("a", "b", (F.col("shared") / (F.size("ta") + F.size("tb") - F.col("shared"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
