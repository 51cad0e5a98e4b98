"""Decisions on gold queries folded into the records: reviews, their history, changed spans, replaced records.

A log of events is the input, not a dialogue. Each event is (query_id, seq, kind, reason, text, span, at, by), seq its order
within the query. Kinds: accept, reject (with a reason), edit (text: the new question), widen (span: one more), respan (span: the
only one, text: its passage), new (text: a question that takes this one's place, span: its span; needs new_id and new_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "query_id int, seq int, kind string, reason string, text string, span struct<doc_id:string,span_start:int,span_end:int>, at timestamp, by string, new_id int, new_type string"
# What an event is called among a review's changes.
CHANGE = {"edit": "edited_query", "widen": "added_span", "respan": "respanned"}
DECIDING = ("accept", "reject", "new")
REVIEW = "struct<decision:string,reason:string,changes:array<string>,at:timestamp,by:string>"


def folded(events: DataFrame) -> DataFrame:
    """One row a query that has events: reviews (in their order, each with the changes since the first event, as a decision carries
    earlier changes on), pending changes after the last decision, and what the events leave: text, spans, require, passage.

    A query's events are a person's decisions on one record; they are gathered. Events of other kinds are left out."""
    known = events.where(F.col("kind").isin(*CHANGE, *DECIDING) & F.col("query_id").isNotNull())
    fields = ["seq", "kind", "reason", "text", "span", "at", "by", "new_id"]
    rows = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    change = F.create_map(*[F.lit(x) for kv in CHANGE.items() for x in kv])

    def upto(seq: Column) -> Column:
        own = F.filter("e", lambda x: (x["seq"] <= seq) & x["kind"].isin(*CHANGE))
        return F.transform(own, lambda x: F.element_at(change, x["kind"]))

    def review(x: Column) -> Column:
        decision = F.when(x["kind"] == "accept", "accept").otherwise("reject")
        reason = F.when(x["kind"] == "new", "replaced").when(x["kind"] == "reject", x["reason"])
        return F.struct(decision.alias("decision"), reason.alias("reason"), upto(x["seq"]).alias("changes"), x["at"].alias("at"), x["by"].alias("by"))

    decided = F.filter("e", lambda x: x["kind"].isin(*DECIDING))
    last = lambda kind, field: F.get(F.reverse(F.transform(F.filter("e", lambda x: x["kind"] == kind), lambda x: x[field])), F.lit(0))
    respan = F.coalesce(F.array_max(F.transform(F.filter("e", lambda x: x["kind"] == "respan"), lambda x: x["seq"])), F.lit(-1))
    wider = F.transform(F.filter("e", lambda x: (x["kind"] == "widen") & (x["seq"] > F.col("respan_seq"))), lambda x: x["span"])
    rows = rows.withColumn("respan_seq", respan)
    return rows.select(
        "query_id", F.transform(decided, review).cast(f"array<{REVIEW}>").alias("reviews"), upto(F.lit(2**31 - 1)).alias("changes"), last("edit", "text").alias("new_query"),
        F.when(F.col("respan_seq") >= 0, last("respan", "span")).alias("new_span"), last("respan", "text").alias("new_passage"), wider.alias("wider"), last("new", "new_id").alias("replaced_by"),
    )


def apply(gold: DataFrame, events: DataFrame) -> DataFrame:
    """gold (query_id, query_text, query_type, query_source, verified, gold_spans, require, answer_passage, reference_answer, and
    review and review_history if it has them) after the events.

    The last decision is the review, earlier ones go to review_history, also that which the record had; verified says whether the
    last one accepts. An edit keeps the first original_query; a new span takes the place of all, asks for all of it and keeps the
    first original_spans and original_answer_passage; spans added after it make any of them enough. A replaced record is
    rejected and named by the record that is added. Records without events stay as they are; repeated records count once."""
    cols = ["query_id", "query_text", "query_type", "query_source", "verified", "gold_spans", "require", "answer_passage", "reference_answer"]
    kept = {"review": REVIEW, "review_history": f"array<{REVIEW}>", "original_query": "string", "original_spans": "array<struct<doc_id:string,span_start:int,span_end:int>>",
            "original_answer_passage": "string", "replaces": "int", "replaced_by": "int", "twin_span_added": "boolean"}
    rows = gold.select(*cols, *[(F.col(c) if c in gold.columns else F.lit(None).cast(t)).alias(c) for c, t in kept.items()]).dropDuplicates(["query_id"])
    f = folded(events).withColumnsRenamed({"replaced_by": "__replaced_by", "reviews": "__reviews"})
    both = rows.join(f, "query_id", "left")
    before = F.coalesce(F.array_compact(F.array("review")), F.array().cast(f"array<{REVIEW}>"))
    all_reviews = F.concat(F.coalesce("review_history", F.array().cast(f"array<{REVIEW}>")), before, F.coalesce("__reviews", F.array().cast(f"array<{REVIEW}>")))
    both = both.withColumn("__all", all_reviews)
    newest = F.get("__all", F.size("__all") - 1)
    moved, edited = F.col("new_span").isNotNull(), F.col("new_query").isNotNull()
    spans = F.concat(F.when(moved, F.array("new_span")).otherwise(F.coalesce("gold_spans", F.array().cast(kept["original_spans"]))), F.coalesce("wider", F.array().cast(kept["original_spans"])))
    out = both.select(
        "query_id", F.coalesce("new_query", "query_text").alias("query_text"), "query_type", "query_source",
        F.when(F.size("__reviews") > 0, newest["decision"] == "accept").otherwise(F.col("verified")).alias("verified"), spans.alias("gold_spans"),
        F.when(F.size("wider") > 0, "any").when(moved, "all").otherwise(F.col("require")).alias("require"),
        F.when(moved, F.col("new_passage")).otherwise(F.col("answer_passage")).alias("answer_passage"), "reference_answer",
        newest.alias("review"), F.slice("__all", F.lit(1), F.greatest(F.size("__all") - 1, F.lit(0))).alias("review_history"),
        F.when(edited, F.coalesce("original_query", "query_text")).otherwise(F.col("original_query")).alias("original_query"),
        F.when(moved, F.coalesce("original_spans", "gold_spans")).otherwise(F.col("original_spans")).alias("original_spans"),
        F.when(moved, F.coalesce("original_answer_passage", "answer_passage")).otherwise(F.col("original_answer_passage")).alias("original_answer_passage"),
        "replaces", F.coalesce("__replaced_by", "replaced_by").alias("replaced_by"), F.when(~moved, F.col("twin_span_added")).alias("twin_span_added"),
    )
    new = events.where("kind = 'new' AND new_id IS NOT NULL")
    stamped = F.struct(F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("reason"), F.array(F.lit("human_authored")).alias("changes"), F.col("at").alias("at"), F.col("by").alias("by"))
    added = new.select(
        F.col("new_id").alias("query_id"), F.col("text").alias("query_text"), F.col("new_type").alias("query_type"), F.lit("human_authored").alias("query_source"), F.lit(True).alias("verified"),
        F.array("span").alias("gold_spans"), F.lit("all").alias("require"), F.col("reason").alias("answer_passage"), F.lit(None).cast("string").alias("reference_answer"),
        stamped.cast(REVIEW).alias("review"), F.array().cast(f"array<{REVIEW}>").alias("review_history"), F.lit(None).cast("string").alias("original_query"), F.lit(None).cast(kept["original_spans"]).alias("original_spans"),
        F.lit(None).cast("string").alias("original_answer_passage"), F.col("query_id").alias("replaces"), F.lit(None).cast("int").alias("replaced_by"), F.lit(None).cast("boolean").alias("twin_span_added"),
    )
    return out.unionByName(added)


def stats(records: DataFrame) -> DataFrame:
    """(measure, value, n) of apply(): reviewed and remaining; decisions; reasons of rejected, types, sources and changes of
    accepted records."""
    accepted = F.col("review.decision") == "accept"
    pairs = F.array(
        F.struct(F.lit("progress").alias("measure"), F.when(F.col("review").isNull(), "remaining").otherwise("reviewed").alias("value")),
        F.struct(F.lit("decision").alias("measure"), F.col("review.decision").alias("value")),
        F.struct(F.lit("reason").alias("measure"), F.when(~accepted, F.coalesce("review.reason", F.lit("none"))).alias("value")),
        F.struct(F.lit("type").alias("measure"), F.when(accepted, F.col("query_type")).alias("value")),
        F.struct(F.lit("source").alias("measure"), F.when(accepted, F.coalesce("query_source", F.lit("?"))).alias("value")),
    )
    changes = F.when(accepted, F.transform("review.changes", lambda c: F.struct(F.lit("change").alias("measure"), c.alias("value"))))
    each = records.select(F.explode(F.concat(pairs, F.coalesce(changes, F.array().cast("array<struct<measure:string,value:string>>")))).alias("x")).select("x.*")
    return each.where("value IS NOT NULL").groupBy("measure", "value").agg(F.count("*").alias("n"))


def queue(records: DataFrame, start: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """(place, query_id): what is to be reviewed. With ids those that exist, in the order given, reviewed or not; else records without a
    review, from `start` on, by id."""
    if ids is not None:
        wanted = records.sparkSession.createDataFrame(list(enumerate(ids, 1)), "place int, query_id int")
        return wanted.join(records.select("query_id").distinct(), "query_id").select("place", "query_id")
    from quarryline.operators.ranking import positions

    pending = records.where(F.col("review").isNull() & (F.lit(True) if start is None else F.col("query_id") >= start)).select("query_id").distinct()
    return positions(pending, [], [F.col("query_id")], "place").select(F.col("place").cast("int").alias("place"), "query_id")


def listing(records: DataFrame) -> DataFrame:
    """(query_id, status, query_type, query): a line a record; status is the decision with its reason, or pending."""
    status = F.when(F.col("review").isNull(), "pending").otherwise(F.concat_ws(" ", "review.decision", "review.reason"))
    return records.select("query_id", status.alias("status"), "query_type", F.substring("query_text", 1, 70).alias("query"))


def respanned(records: DataFrame, texts: DataFrame) -> DataFrame:
    """apply() with the passage of each record that was ever given a new span put right: the text of its first span, the passage before
    kept once. texts: (query_id, text) of that span."""
    ever = F.array_contains(F.concat(F.coalesce("review.changes", F.array().cast("array<string>")), F.flatten(F.coalesce(F.transform("review_history", lambda r: r["changes"]), F.array().cast("array<array<string>>")))), "respanned")
    both = records.join(texts.select("query_id", F.col("text").alias("__text")).dropDuplicates(["query_id"]), "query_id", "left")
    wrong = ever & F.col("__text").isNotNull() & ~F.col("answer_passage").eqNullSafe(F.col("__text"))
    kept = F.when(wrong, F.coalesce("original_answer_passage", "answer_passage")).otherwise(F.col("original_answer_passage"))
    both = both.withColumns({"fixed": F.coalesce(wrong, F.lit(False)), "__kept": kept})
    passage = F.when(F.col("fixed"), F.col("__text")).otherwise(F.col("answer_passage"))
    return both.withColumns({"original_answer_passage": F.col("__kept"), "answer_passage": passage}).drop("__text", "__kept")


def with_twins(records: DataFrame, twins: DataFrame) -> DataFrame:
    """records with the twin of their only span as a second one, either of which is enough. twins: (query_id, doc_id, twin_start,
    twin_end). Rejected records, those that have a twin already and those of several spans stay as they are."""
    span = F.struct(F.col("doc_id").alias("doc_id"), F.col("twin_start").cast("int").alias("span_start"), F.col("twin_end").cast("int").alias("span_end"))
    both = records.join(twins.select("query_id", span.alias("__twin")).dropDuplicates(["query_id"]), "query_id", "left")
    open_ = F.col("__twin").isNotNull() & (F.size("gold_spans") == 1) & ~F.coalesce(F.col("twin_span_added"), F.lit(False)) & (F.coalesce("review.decision", F.lit("")) != "reject")
    both = both.withColumn("__open", open_)
    return both.withColumns(
        {
            "gold_spans": F.when(F.col("__open"), F.concat("gold_spans", F.array("__twin"))).otherwise(F.col("gold_spans")),
            "require": F.when(F.col("__open"), "any").otherwise(F.col("require")), "twin_span_added": F.when(F.col("__open"), True).otherwise(F.col("twin_span_added")),
        }
    ).drop("__open", "__twin")
