"""Retrieval metrics over runs in long form: coverage of gold spans, recall, paired tests and quantiles.

Every metric is an aggregate of outcomes(), one row for each list of a gold query. Spans are half-open places of code points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ranking import positions
from quarryline.operators.runs import LIST

#: The share of a span that must be covered.
ENOUGH = 0.8


def gold(rows: DataFrame) -> DataFrame:
    """(query_id, query_type, require, spans) of verified queries, each once; a missing `require` means all, missing spans none."""
    spans = F.coalesce("gold_spans", F.array().cast("array<struct<doc_id:string,span_start:int,span_end:int>>"))
    return rows.where("verified AND query_id IS NOT NULL").select("query_id", "query_type", F.coalesce("require", F.lit("all")).alias("require"), spans.alias("spans")).distinct()


def _first_enough() -> Column:
    """Of the parts (lo, hi, rank) of one span, at most as many as a list is long: the first rank at which their union covers
    enough. Between neighbouring ends of parts the coverage is the same, so each such segment counts from the least rank on."""
    return F.expr(f"""
        array_min(filter(transform(ranks, r -> if(aggregate(transform(sequence(1, size(ends) - 1), i -> if(
            exists(parts, p -> p.rank <= r AND p.lo <= ends[i - 1] AND p.hi >= ends[i]), ends[i] - ends[i - 1], 0)), 0, (a, x) -> a + x)
            / cast(greatest(1, span_end - span_start) AS double) >= {ENOUGH}D, r, NULL)), r -> r IS NOT NULL))""")


def outcomes(lists: DataFrame, gold_queries: DataFrame) -> DataFrame:
    """(config, mode, query_id, query_type, results, rank, budget) for each list of ranked() whose query is gold: the first rank at
    which enough of all (or of any) of its spans is covered by the union of the results so far, and the tokens up to there;
    null where that is never. With no spans, `all` is satisfied at rank 1 and `any` never; an empty span is never covered.
    """
    asked = lists.join(gold_queries.select("query_id"), "query_id")
    sizes = asked.groupBy(*LIST).agg(F.count("*").alias("results"), F.array_sort(F.collect_list(F.struct("rank", F.coalesce("token_count", F.lit(0)).alias("tokens")))).alias("costs"))
    spans = gold_queries.select("query_id", F.posexplode("spans").alias("span_no", "s")).select("query_id", "span_no", "s.*")
    low, high = F.greatest("char_start", "span_start"), F.least("char_end", "span_end")
    parts = (
        asked.select(*LIST, "rank", "doc_id", "char_start", "char_end")
        .join(spans, ["query_id", "doc_id"])
        .where(high > low)
        .groupBy(*LIST, "span_no", "span_start", "span_end")
        .agg(F.collect_list(F.struct(low.alias("lo"), high.alias("hi"), "rank")).alias("parts"))
        .withColumn("ends", F.expr("array_sort(array_distinct(flatten(array(parts.lo, parts.hi))))"))
        .withColumn("ranks", F.array_sort(F.array_distinct("parts.rank")))
        .select(*LIST, "span_no", _first_enough().alias("at"))
        .groupBy(*LIST)
        .agg(F.count("at").alias("met"), F.max("at").alias("last"), F.min("at").alias("first"))
    )
    rank = F.when(F.col("require") == "any", F.col("first")).when(F.size("spans") == 0, F.lit(1)).when(F.col("met") == F.size("spans"), F.col("last"))
    budget = F.expr("aggregate(filter(costs, c -> c.rank <= rank), 0L, (a, c) -> a + c.tokens)")
    return (
        sizes.join(parts, LIST, "left")
        .join(gold_queries, "query_id")
        .withColumn("rank", rank.cast("int"))
        .select(*LIST, "query_type", F.col("results").cast("int").alias("results"), "rank", F.when(F.col("rank").isNotNull(), budget).alias("budget"))
    )


def hit(limit: int, column: str = "rank") -> Column:
    """Whether the list is satisfied within the limit."""
    return F.coalesce(F.col(column) <= limit, F.lit(False))


def recall(out: DataFrame, by: list[str], limit: int, column: str = "rank") -> DataFrame:
    """(...by, hits, n, recall)."""
    hits = F.count_if(hit(limit, column))
    return out.groupBy(*by).agg(hits.alias("hits"), F.count("*").alias("n"), F.round(hits / F.count("*"), 6).alias("recall"))


def exact_binomial(less: Column, more: Column) -> Column:
    """Two-sided exact p of `less` against `more` discordant pairs at even odds; 1 where there are none. In logarithms, so
    large counts neither overflow nor vanish."""
    n, m = less + more, F.least(less, more)
    term = F.struct((n * F.lit(-float(np.log(2)))).cast("double").alias("t"), F.exp(n * F.lit(-float(np.log(2)))).cast("double").alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    steps = F.when(m >= 1, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(steps, term, add)["s"])


def mcnemar(out: DataFrame, side: str | list[str], pairs: list[tuple], limit: int) -> DataFrame:
    """(a, b, both, a_only, b_only, neither, p) for each pair of values of the column `side` (of several columns: tuples of
    values, named with " / " between), over the queries that have an outcome with either value; a pair that no query has
    outcomes of gives zeros and p 1. One pass over the outcomes for all pairs."""
    columns = [side] if isinstance(side, str) else side
    named = lambda v: v if isinstance(v, str) else " / ".join(v)
    pairs = [(named(a), named(b)) for a, b in pairs]
    values = sorted({v for pair in pairs for v in pair})
    of = F.concat_ws(" / ", *columns)
    wide = out.groupBy("query_id").agg(*[F.max(F.when(of == v, hit(limit))).alias(f"__{i}") for i, v in enumerate(values)])
    col = lambda v: F.col(f"__{values.index(v)}")
    counts = []
    for i, (a, b) in enumerate(pairs):
        x, y = col(a), col(b)
        counts += [F.count_if(cell).alias(f"{name}{i}") for name, cell in (("both", x & y), ("a_only", x & ~y), ("b_only", ~x & y), ("neither", ~x & ~y))]
    four = wide.agg(*counts)
    names = ("both", "a_only", "b_only", "neither")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"{n}{i}").alias(n) for n in names]) for i, (a, b) in enumerate(pairs)]))
    return four.select(each.alias("s")).select("s.*").withColumn("p", F.round(exact_binomial(F.col("a_only"), F.col("b_only")), 6))


def bootstrap_interval(counts: DataFrame, by: list[str], resamples: int = 5000, seed: int = 0) -> DataFrame:
    """counts (...by, hits, n) with the 2.5 and 97.5 per cent points of the resampled mean; 0 and 0 for n = 0. The mean of n draws
    with replacement from n hits and misses is binomial, so a resample is one draw, whatever n is."""

    def points(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for h, k in zip(hits, n, strict=True):
            means = np.sort(np.random.default_rng(seed).binomial(k, h / k, resamples) / k) if k else np.zeros(resamples)
            rows.append((float(means[int(resamples * 0.025)]), float(means[min(resamples - 1, int(resamples * 0.975))])))
        return pd.DataFrame(rows, columns=["low", "high"])

    points.__annotations__ = {"hits": pd.Series, "n": pd.Series, "return": pd.DataFrame}
    ci = F.pandas_udf(points, "low double, high double")("hits", "n")
    return counts.withColumn("__ci", ci).select(*by, "hits", "n", F.col("__ci.low").alias("low"), F.col("__ci.high").alias("high"))


def floor_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(...by, n, ...points): of each group's sorted values the one at index min(n - 1, int(p * n)); nulls are left out.

    Rows are numbered by ranges of values, so a group may hold any share of them."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")).withColumn("__tie", F.monotonically_increasing_id())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    placed = positions(rows, by, [F.col("__v"), F.col("__tie")], "__at").join(sizes, by)
    wanted = [F.max(F.when(F.col("__at") == F.least(F.col("n"), F.floor(F.lit(p) * F.col("n")) + 1), F.col("__v"))).alias(name) for name, p in points.items()]
    return placed.groupBy(*by, "n").agg(*wanted)
