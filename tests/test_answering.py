import difflib
import random

from pyspark.sql import functions as F

from quarryline.functions.blocks import holds_block
from quarryline.operators import answering as N
from quarryline.operators import answers as A

LIST = "query_id int, rank int, id string, doc_id string, char_start int, char_end int, content string"
TEXT = "The cap is 5.\nIt  applies from May."
CALLS = {
    1: '```json\n{"sufficient_context": true, "answer": "Five.", "citations": [{"chunk_id": "chunk_1", "source_quote": "The cap is 5."}]}\n```',
    2: None, 3: "no json", 4: '{"sufficient_context": false}', 5: '{"answer": "x"}',
    6: '{"sufficient_context": true, "citations": [{"chunk_id": "chunk_7", "source_quote": "The cap"}, {"chunk_id": "chunk_1", "source_quote": " "}]}',
    7: '{"sufficient_context": true, "answer": "x", "citations": [{"chunk_id": "chunk_1", "source_quote": "5. it applies"}, {"chunk_id": "chunk_1", "source_quote": "never said"}]}',
    9: '{"sufficient_context": true, "citations": []}', 10: '{"sufficient_context": true, "citations": null, "answer": null}',
}


def answered(spark):
    asked = spark.createDataFrame([(k, f"question {k}", CALLS.get(k), "own") for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] + [(11, "no", None, ""), (12, None, None, ""), (13, "x" * 501, None, "")], "query_id int, question string, call string, retrieved string")
    lists = [(k, r, f"c{r}", "d1" if r < 3 else "d2", 100, 140, TEXT if r == 1 else "other") for k in (1, 2, 3, 4, 5, 6, 7, 9, 10) for r in range(1, 8)]
    out = N.ask(asked.drop("retrieved"), spark.createDataFrame(lists, LIST), lambda q, c: F.col("call"))
    return {r["query_id"]: r for r in out.collect()}


def test_all_refusals_in_their_order(spark):
    got = answered(spark)
    assert {k: r["refusal_reason"] for k, r in got.items()} == {
        1: None, 2: A.NO_CALL, 3: A.NO_JSON, 4: A.TOO_LITTLE, 5: A.TOO_LITTLE, 6: A.NONE_LEFT, 7: A.SOME_FAILED, 8: A.NOTHING, 9: A.NONE_LEFT, 10: A.NONE_LEFT,
    }
    assert got[1]["answered"] and got[1]["answer"] == "Five." and got[1]["retrieved"] == ["d1", "d1", "d2", "d2", "d2"]
    c = got[1]["citations"][0]
    assert (c["doc_id"], c["char_start"], c["char_end"]) == ("d1", 100, 113)
    assert [x["problem"] for x in got[6]["bad_citations"]] == [A.UNKNOWN, A.EMPTY]
    c = got[7]["citations"][0]  # stands there with other white space and case only: the chunk's place
    assert (c["char_start"], c["char_end"]) == (100, 140) and [x["problem"] for x in got[7]["bad_citations"]] == [A.ABSENT]
    assert got[7]["answer"] == "" and got[8]["retrieved"] == [] and not got[2]["citations"]


def test_judge_and_examples(spark):
    rows = [(1, "q", True, "a", None), (2, "q", True, "b", None), (3, "q", True, "c", None), (4, "q", False, "", A.NOTHING), (5, "q", True, "d", None)]
    df = spark.createDataFrame(rows, "query_id int, question string, answered boolean, answer string, refusal_reason string")
    says = F.when(F.col("answer") == "a", '{"grounded": true}').when(F.col("answer") == "b", '```json\n{"grounded": false, "unsupported_claim": "x"}\n```').when(F.col("answer") == "c", "no json")
    got = {r["query_id"]: r["verdict"] for r in N.judged(df, lambda q, a: says).collect()}
    assert got[1]["grounded"] is True and (got[2]["grounded"], got[2]["unsupported_claim"]) == (False, "x") and got[3] is got[4] is got[5] is None
    assert {tuple(r) for r in N.examples(df).collect()} == {("answered", 1), (A.NOTHING, 4)}
    assert N.health({"a": "1", "b": ""}, ["a", "b"]) == {"status": "misconfigured", "missing": ["b"]}


def test_no_questions(spark):
    none = spark.createDataFrame([], "query_id int, question string")
    assert N.ask(none, spark.createDataFrame([], LIST), lambda q, c: F.lit("x")).count() == 0


def test_quotes_taken_again(spark):
    cites = spark.createDataFrame([(1, "c", "old", 2, 6), (2, "c", "\xa0", 2, 6), (3, "c", "out", 8, 99), (4, "x", "gone", 0, 1), (5, "c", None, 2, 6)], "citation_id int, chunk_id string, source_quote string, char_start int, char_end int")
    chunks = spark.createDataFrame([("c", "abcdefghij", 0, 10)], "chunk_id string, content string, chunk_start int, chunk_end int")
    assert {r["citation_id"]: r["source_quote"] for r in A.quoted_again(cites, chunks).collect()} == {1: "cdef", 2: "\xa0", 3: "out", 4: "gone", 5: None}


def test_blocks_against_difflib():
    rnd = random.Random(1)
    for _ in range(300):
        q, t = ("".join(rnd.choices("abé😀", k=rnd.randint(0, 12))) for _ in range(2))
        block = difflib.SequenceMatcher(None, q, t, autojunk=False).find_longest_match().size
        for n in range(0, 14):
            assert holds_block(q, t, n) == (block >= n), (q, t, n)


def test_overall_verdict(spark):
    v = lambda *x: spark.createDataFrame([(y,) for y in x], "verdict string")
    bad, none = spark.createDataFrame([(1, "no spans")], "query_id int, problem string"), spark.createDataFrame([], "query_id int, problem string")
    cases = [(v("pass", "warn"), none, (True, 0, 1, 0)), (v("pass", "block"), none, (False, 1, 0, 0)), (v("pass"), bad, (False, 0, 0, 1)), (v(), none, (True, 0, 0, 0))]
    for verdicts, problems, want in cases:
        assert tuple(A.overall(verdicts, problems).first()) == want
