"""From questions to checked answers: retrieval lists are laid before an answerer, and what it gives passes the gates.

The answerer is handed in: a function of columns that gives what a model would, the arguments of a tool call as JSON, or null
for no call. A scripted one is a Spark expression, a real one a pandas UDF around a client.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import norm_text, strip_fences
from quarryline.operators.answers import ABSENT, EMPTY, NO_CALL, NO_JSON, NONE_LEFT, NOTHING, SOME_FAILED, TOO_LITTLE, UNKNOWN

#: Chunks laid before the answerer: the feature of the answering path.
TOP = 5
ARGUMENTS = "struct<sufficient_context: boolean, answer: string, citations: array<struct<chunk_id: string, source_quote: string>>>"
CHUNKS = "array<struct<label: string, rank: int, id: string, doc_id: string, char_start: int, char_end: int, content: string>>"


def with_chunks(questions: DataFrame, lists: DataFrame, key: str, top: int = TOP) -> DataFrame:
    """questions with `chunks`, the first `top` results of each in the list (key, rank, id, doc_id, char_start, char_end, content),
    labelled chunk_1 and so on; an empty array where nothing was retrieved."""
    label = F.concat(F.lit("chunk_"), F.col("rank").cast("string")).alias("label")
    first = lists.where(F.col("rank") <= top).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", label, "id", "doc_id", "char_start", "char_end", "content"))).alias("c"))
    each = F.transform("c", lambda x: F.struct(*[x[n].alias(n) for n in ("label", "rank", "id", "doc_id", "char_start", "char_end", "content")]))
    return questions.join(first, key, "left").withColumn("chunks", F.coalesce(each, F.array()).cast(CHUNKS)).drop("c")


def prompt(chunks: Column) -> Column:
    """The chunks as they are laid before a model."""
    return F.array_join(F.transform(chunks, lambda x: F.concat(F.lit("["), x["label"], F.lit("] (circular "), x["doc_id"], F.lit(")\n"), x["content"])), "\n\n")


def _checked(citation: Column, chunks: Column) -> Column:
    """A citation with its problem or, if it holds, its place: the quote's, else the chunk's."""

    def judged(c: Column) -> Column:
        quote, content = norm_text(citation["source_quote"]), norm_text(c["content"])
        problem = F.when(c.isNull(), UNKNOWN).when(F.coalesce(quote, F.lit("")) == "", EMPTY).when(~F.contains(content, quote), ABSENT)
        at = F.coalesce(F.position(citation["source_quote"], c["content"]), F.lit(0))
        start = F.when(problem.isNull(), F.when(at > 0, c["char_start"] + at - 1).otherwise(c["char_start"]))
        end = F.when(problem.isNull(), F.when(at > 0, c["char_start"] + at - 1 + F.length(citation["source_quote"])).otherwise(c["char_end"]))
        return F.struct(
            citation["chunk_id"].alias("chunk_id"), citation["source_quote"].alias("source_quote"), F.when(problem.isNull(), c["doc_id"]).alias("doc_id"),
            start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), problem.alias("problem"),
        )

    named = F.filter(chunks, lambda c: c["label"] == citation["chunk_id"])
    return F.get(F.transform(F.array(F.get(named, F.lit(0))), judged), F.lit(0))


def answers(asked: DataFrame, answerer: Callable[[Column, Column], Column], question: str = "question") -> DataFrame:
    """with_chunks() with answered, answer, refusal_reason, citations, bad_citations and retrieved (doc ids in order of rank).

    The tests are, in this order: something was retrieved; the answerer made a call; its arguments are JSON (a code fence around
    them is taken off); it says that the context suffices; a citation survives; none fails. A refused answer is empty.
    """
    raw = strip_fences(answerer(F.col(question), F.col("chunks")))
    rows = asked.withColumn("__raw", raw).withColumn("__p", F.from_json("__raw", ARGUMENTS))
    rows = rows.withColumn("__c", F.transform(F.coalesce(F.col("__p.citations"), F.array().cast("array<struct<chunk_id:string,source_quote:string>>")), lambda c: _checked(c, F.col("chunks"))))
    good, bad = F.filter("__c", lambda c: c["problem"].isNull()), F.filter("__c", lambda c: c["problem"].isNotNull())
    reason = (
        F.when(F.size("chunks") == 0, NOTHING).when(F.col("__raw").isNull(), NO_CALL).when(F.get_json_object("__raw", "$").isNull(), NO_JSON)
        .when(~F.coalesce(F.col("__p.sufficient_context"), F.lit(False)), TOO_LITTLE)
    )
    rows = rows.withColumns({"__early": reason, "__good": good, "__bad": bad})
    late = F.coalesce("__early", F.when(F.size("__good") == 0, NONE_LEFT).when(F.size("__bad") > 0, SOME_FAILED))
    shown = lambda c: F.when(F.col("__early").isNull(), F.col(c)).otherwise(F.filter(c, lambda x: F.lit(False)))
    return rows.withColumns(
        {
            "refusal_reason": late, "answered": late.isNull(), "answer": F.when(late.isNull(), F.coalesce("__p.answer", F.lit(""))).otherwise(""),
            "citations": shown("__good"), "bad_citations": shown("__bad"), "retrieved": F.transform("chunks", lambda c: c["doc_id"]),
        }
    ).drop("__raw", "__p", "__c", "__early", "__good", "__bad", "chunks")


def ask(questions: DataFrame, lists: DataFrame, answerer: Callable[[Column, Column], Column], key: str = "query_id", question: str = "question", top: int = TOP) -> DataFrame:
    """answers() of questions of 3 to 500 characters; others, and null ones, are left out, as a service would turn them away."""
    fit = questions.where(F.length(question).between(3, 500))
    return answers(with_chunks(fit, lists, key, top), answerer, question)


def judged(answered: DataFrame, judge: Callable[[Column, Column], Column], question: str = "question") -> DataFrame:
    """answers() with verdict (grounded, unsupported_claim) of the answered ones: what a judge that is handed in, a function of question and
    answer, says as JSON; null where it says nothing or no JSON, so an answer without a verdict counts as neither."""
    said = F.when(F.col("answered"), strip_fences(judge(F.col(question), F.col("answer"))))
    verdict = F.when(F.get_json_object(said, "$").isNotNull(), F.from_json(said, "struct<grounded: boolean, unsupported_claim: string>"))
    return answered.withColumn("verdict", verdict)


def examples(answered: DataFrame, key: str = "query_id") -> DataFrame:
    """(outcome, key): for a report one case of every outcome, an answer or a kind of refusal: the least key."""
    return answered.groupBy(F.coalesce("refusal_reason", F.lit("answered")).alias("outcome")).agg(F.min(key).alias(key))


def health(settings: dict[str, str | None], needed: list[str]) -> dict:
    """Whether all settings that an answerer needs are there; their values are not shown."""
    missing = [n for n in needed if not settings.get(n)]
    return {"status": "misconfigured" if missing else "ok", "missing": missing}
