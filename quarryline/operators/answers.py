"""Checks of answers and their citations, of gold queries, and of measures against thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.blocks import mostly_in
from quarryline.functions.text import norm_text
from quarryline.functions.unicode import fold
from quarryline.shared import written

# What is wrong with a citation, in the order of the tests.
UNKNOWN, EMPTY, ABSENT = "cites a chunk that was not retrieved", "empty quote", "quote does not appear in the cited chunk"
# Why an answer is refused, in the order of the tests.
NOTHING, NO_CALL, NO_JSON, TOO_LITTLE = "nothing retrieved", "model returned no tool call", "tool arguments were not valid JSON", "insufficient context"
NONE_LEFT, SOME_FAILED = "no citation survived verification", "some citations failed verification"
REFUSALS = (NOTHING, NO_CALL, NO_JSON, TOO_LITTLE, NONE_LEFT, SOME_FAILED)
# Causes of failed citations.
CAUSES = ("unicode only", "spans two chunks", "near miss", "not present")
# Thresholds as (section, name, bound, limit, on_breach).
THRESHOLDS = [
    ("retrieval", "recall_at_5", "min", 0.90, "block"),
    ("retrieval", "recall_at_20", "min", 0.94, "warn"),
    ("generation", "groundedness", "min", 0.88, "block"),
    ("generation", "answered_without_source", "max", 0.08, "block"),
    ("generation", "refusal_rate", "max", 0.20, "warn"),
    ("generation", "gate3_rejection_rate", "max", 0.15, "warn"),
]


def citations(api: DataFrame) -> DataFrame:
    """Citations once each: of a citation delivered again, the latest."""
    cols = ["answer_id", "question", "answered", "answer", "refusal_reason", "chunk_id", "doc_id", "source_quote", "char_start", "char_end", "elapsed_ms"]
    last = F.max_by(F.struct(*cols), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")))
    return api.where("citation_id IS NOT NULL").groupBy("citation_id").agg(last.alias("c")).select("citation_id", "c.*")


def chunks(retrieve: DataFrame) -> DataFrame:
    """Retrieved chunks once each."""
    return retrieve.where("id IS NOT NULL").groupBy(F.col("id").alias("chunk_id")).agg(F.min("content").alias("content"), F.min("char_start").alias("chunk_start"), F.coalesce(F.min("char_end"), F.min(F.col("char_start") + F.length("content"))).alias("chunk_end"))


def quoted_again(cites: DataFrame, retrieved: DataFrame) -> DataFrame:
    """citations() with each quote that isn't blank replaced by the text that now stands at its place, where that lies within the
    cited chunk; the others stay. What an index that was built anew makes of citations of the one before."""
    cols = cites.columns
    both = cites.join(retrieved.select("chunk_id", F.col("content").alias("__content"), F.col("chunk_start").alias("__start")), "chunk_id", "left")
    held = F.expr("char_start >= __start AND char_end <= __start + length(__content) AND char_start < char_end") & (norm_text(F.col("source_quote")) != "")
    now = F.when(held, F.expr("substring(__content, char_start - __start + 1, char_end - char_start)")).otherwise(F.col("source_quote"))
    return both.withColumn("source_quote", now).select(*cols)


def verified(cites: DataFrame, retrieved: DataFrame) -> DataFrame:
    """citations() with problem (null if good), quote_start and quote_end: of a good quote its place, or the chunk's if the quote
    stands there with other white space or case only."""
    both = cites.join(retrieved, "chunk_id", "left")
    quote, content = norm_text(F.col("source_quote")), norm_text(F.col("content"))
    problem = (
        F.when(F.col("content").isNull(), UNKNOWN).when(F.coalesce(quote, F.lit("")) == "", EMPTY).when(~F.contains(content, quote), ABSENT)
    )
    at = F.expr("instr(content, source_quote)")
    start = F.when(at > 0, F.col("chunk_start") + at - 1).otherwise(F.col("chunk_start"))
    end = F.when(at > 0, F.col("chunk_start") + at - 1 + F.length("source_quote")).otherwise(F.col("chunk_end"))
    good = lambda c: F.when(F.col("problem").isNull(), c).cast("int")
    return both.withColumn("problem", problem).withColumns({"quote_start": good(start), "quote_end": good(end)})


def decisions(cites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(...by, good, bad, answered, refusal_reason) of verified(), by answer_id unless told: an answer stands if it has a citation
    and all survive. The refusals of a model that gave no citations are told in answering.answers()."""
    by = by or ["answer_id"]
    good, bad = F.count_if(F.col("problem").isNull()), F.count_if(F.col("problem").isNotNull())
    found = F.count_if(F.coalesce(F.col("problem"), F.lit("")) != UNKNOWN)
    counts = cites.groupBy(*by).agg(good.alias("good"), bad.alias("bad"), found.alias("found"))
    reason = F.when(F.col("found") == 0, NOTHING).when(F.col("good") == 0, NONE_LEFT).when(F.col("bad") > 0, SOME_FAILED)
    return counts.withColumn("refusal_reason", reason).select(*by, "good", "bad", F.col("refusal_reason").isNull().alias("answered"), "refusal_reason")


def causes(cites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(citation_id, cause) of the citations of verified() whose quote is absent or whose chunk is unknown: "unicode only" if the
    folded quote stands in the cited chunk, "spans two chunks" if it stands in the answer's chunks joined, "near miss" if a block
    of more than 0.7 of it is in the chunk, else "not present". An answer's chunks are those that it cites, by `by` (answer_id);
    each chunk and each quote is folded once, each answer's chunks are joined folded."""
    by = by or ["answer_id"]
    texts = cites.where("content IS NOT NULL").select(*by, "chunk_id", "content").distinct()
    folded = written(texts.select(*by, "chunk_id", fold(F.col("content")).alias("c")), "folded-chunks")
    joined = folded.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "c"))), lambda x: x["c"]), " ").alias("a"))
    failed = cites.where(F.col("problem").isin(UNKNOWN, ABSENT)).select("citation_id", *by, "chunk_id", fold(F.col("source_quote")).alias("q"))
    rows = failed.join(folded, [*by, "chunk_id"], "left").join(joined, by, "left")
    easy = F.when(F.col("c").isNull(), CAUSES[3]).when(F.contains("c", "q"), CAUSES[0]).when(F.contains("a", "q"), CAUSES[1])
    placed = written(rows.select("citation_id", *by, easy.alias("cause"), F.when(easy.isNull(), F.col("q")).alias("q"), F.when(easy.isNull(), F.col("c")).alias("c")), "placed")
    near = F.when(mostly_in(0.7)("q", "c"), CAUSES[2]).otherwise(CAUSES[3])
    out = ["citation_id", *[x for x in by if x != "answer_id"]]
    return placed.where("cause IS NOT NULL").select(*out, "cause").unionByName(placed.where("cause IS NULL").select(*out, near.alias("cause")))


def generations(cites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(...by, doc_id, answered, refusal_reason, citations, bad_citations, retrieval_hit, grounded) of verified(),
    by answer_id unless told.

    retrieval_hit: whether a cited place lies in the cited chunk's, null where no place is known; grounded: whether no quote is
    absent from its chunk, null where all quotes are empty or the answer was refused. Both stand in for a judge's verdict.
    """
    inside = (F.col("char_start") < F.col("chunk_end")) & (F.col("char_end") > F.col("chunk_start"))
    quoted = F.coalesce(F.col("problem"), F.lit("")) != EMPTY
    return cites.groupBy(*(by or ["answer_id"])).agg(
        F.min("doc_id").alias("doc_id"), F.max("answered").alias("answered"), F.min("refusal_reason").alias("refusal_reason"), F.count("*").alias("citations"),
        F.count_if(F.col("problem").isNotNull()).alias("bad_citations"), F.max(inside).alias("retrieval_hit"),
        F.when(F.max("answered"), F.min(F.when(quoted, F.col("problem").isNull()))).alias("grounded"),
    )


def measured() -> Column:
    """Measures of generations() by name, as a map: an aggregate."""
    share = lambda part, whole: F.round(F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0)), 6)
    yes = F.col("answered") & F.lit(True)
    values = {
        "groundedness": share(yes & F.col("grounded"), yes & F.col("grounded").isNotNull()),
        "answered_without_source": share(yes & (F.col("retrieval_hit") == F.lit(False)), F.lit(True)),
        "refusal_rate": share(~yes, F.lit(True)),
        "gate3_rejection_rate": share(F.col("bad_citations") > 0, F.lit(True)),
    }
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))


def threshold_table(spark: SparkSession, thresholds=THRESHOLDS) -> DataFrame:
    return spark.createDataFrame(thresholds, "section string, name string, bound string, limit double, on_breach string")


def verdicts(measures: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(section, name, value, bound, limit, verdict): measures (name, value) against their thresholds; a measure without a threshold
    and a threshold without a measure are left out."""
    within = F.when(F.col("bound") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return measures.where("value IS NOT NULL").join(thresholds, "name").select("section", "name", "value", "bound", "limit", F.when(within, "pass").otherwise(F.col("on_breach")).alias("verdict"))


def overall(verdicts_: DataFrame, problems: DataFrame) -> DataFrame:
    """One row (passed, blocked, warned, problems) of verdicts() and gold_problems(): it passes without a block and a problem."""
    counts = verdicts_.agg(F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "warn").alias("warned"))
    both = counts.crossJoin(problems.agg(F.count("*").alias("problems")))  # one row each
    return both.select(((F.col("blocked") == 0) & (F.col("problems") == 0)).alias("passed"), "blocked", "warned", "problems")


def gold_problems(rows: DataFrame, circulars: DataFrame, extents: DataFrame) -> DataFrame:
    """(query_id, problem): ids of several rows, verified queries without spans, spans in unknown documents, and spans that
    end beyond their document or are empty. extents: (doc_id, n_chars)."""
    once = rows.select("query_id", "query_text", "verified", "gold_spans").distinct()
    twice = rows.where("query_id IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("duplicate id").alias("problem"))
    bare = once.where("verified AND coalesce(size(gold_spans), 0) <= 0").select("query_id", F.lit("no spans").alias("problem"))
    spans = once.where("verified").select("query_id", F.explode("gold_spans").alias("s")).select("query_id", "s.*")
    lost = spans.join(circulars.select(F.col("circular_id").alias("doc_id")), "doc_id", "left_anti").select("query_id", F.lit("missing document").alias("problem"))
    out = spans.join(extents, "doc_id").where("span_end > n_chars OR span_start >= span_end").select("query_id", F.lit("bad bounds").alias("problem"))
    return twice.unionByName(bare).unionByName(lost).unionByName(out).distinct()
