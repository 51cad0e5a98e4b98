from datetime import datetime

from quarryline.operators import review as R

SPAN = "struct<doc_id:string,span_start:int,span_end:int>"
GOLD = f"query_id int, query_text string, query_type string, query_source string, verified boolean, gold_spans array<{SPAN}>, require string, answer_passage string, reference_answer string"
A, B, C = ("d", 0, 5), ("e", 3, 9), ("f", 1, 2)
T = datetime(2030, 1, 1)


def row(k, kind="natural", spans=(A,)):
    return (k, f"q{k}", kind, "made", None, list(spans), "all", "p", None)


def event(k, seq, kind, reason=None, text=None, span=None, new_id=None, new_type=None):
    return (k, seq, kind, reason, text, span, T, "me", new_id, new_type)


def applied(spark):
    events = [
        event(1, 1, "accept"), event(2, 1, "edit", text="first"), event(2, 2, "edit", text="second"), event(2, 3, "reject", "unclear"), event(2, 4, "accept"),
        event(3, 1, "widen", span=C), event(3, 2, "respan", text="five", span=B), event(3, 3, "accept"), event(4, 1, "respan", text="five", span=B), event(4, 2, "widen", span=C), event(4, 3, "accept"),
        event(5, 1, "new", "passage", "anew", C, 50, "keyword"), event(7, 1, "edit", text="undecided"), event(8, 1, "look"), event(None, 1, "accept"), event(99, 1, "accept"),
    ]
    gold = spark.createDataFrame([row(k) for k in (1, 1, 2, 3, 4, 5, 6, 7, 8)], GOLD)
    return R.apply(gold, spark.createDataFrame(events, R.EVENT))


def test_fold(spark):
    got = {r["query_id"]: r for r in applied(spark).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 50}
    assert got[1]["verified"] and got[1]["review"]["decision"] == "accept" and got[1]["review_history"] == []
    two = got[2]
    assert (two["query_text"], two["original_query"], two["verified"]) == ("second", "q2", True)
    assert two["review"]["changes"] == ["edited_query", "edited_query"] and [h["reason"] for h in two["review_history"]] == ["unclear"]
    assert [tuple(s) for s in got[3]["gold_spans"]] == [B] and got[3]["require"] == "all" and got[3]["answer_passage"] == "five" and [tuple(s) for s in got[3]["original_spans"]] == [A] and got[3]["original_answer_passage"] == "p"
    assert [tuple(s) for s in got[4]["gold_spans"]] == [B, C] and got[4]["require"] == "any"
    five, new = got[5], got[50]
    assert (five["verified"], five["review"]["decision"], five["review"]["reason"], five["replaced_by"]) == (False, "reject", "replaced", 50)
    assert (new["query_text"], new["query_type"], new["query_source"], new["replaces"], new["verified"], new["review"]["changes"]) == ("anew", "keyword", "human_authored", 5, True, ["human_authored"])
    assert got[6]["review"] is None and got[6]["verified"] is None and got[7]["query_text"] == "undecided" and got[7]["review"] is None and got[8]["review"] is None


def test_a_second_log_keeps_the_history(spark):
    again = R.apply(applied(spark), spark.createDataFrame([event(2, 1, "reject", "late"), event(4, 1, "edit", text="x")], R.EVENT))
    got = {r["query_id"]: r for r in again.collect()}
    assert [h["decision"] for h in got[2]["review_history"]] == ["reject", "accept"] and got[2]["review"]["reason"] == "late" and got[2]["original_query"] == "q2"
    assert got[4]["review"]["decision"] == "accept" and got[4]["original_query"] == "q4" and got[4]["original_answer_passage"] == "p"


def test_stats_queue_listing(spark):
    records = applied(spark)
    got = {(r["measure"], r["value"]): r["n"] for r in R.stats(records).collect()}
    assert got == {
        ("progress", "reviewed"): 6, ("progress", "remaining"): 3, ("decision", "accept"): 5, ("decision", "reject"): 1, ("reason", "replaced"): 1, ("type", "natural"): 4, ("type", "keyword"): 1,
        ("source", "made"): 4, ("source", "human_authored"): 1, ("change", "edited_query"): 2, ("change", "added_span"): 2, ("change", "respanned"): 2, ("change", "human_authored"): 1,
    }
    assert [tuple(r) for r in R.queue(records).orderBy("place").collect()] == [(1, 6), (2, 7), (3, 8)]
    assert [tuple(r) for r in R.queue(records, start=7).orderBy("place").collect()] == [(1, 7), (2, 8)]
    assert [tuple(r) for r in R.queue(records, ids=[8, 404, 1]).orderBy("place").collect()] == [(1, 8), (3, 1)]
    status = {r["query_id"]: r["status"] for r in R.listing(records).collect()}
    assert status[1] == "accept" and status[5] == "reject replaced" and status[6] == "pending"
    none = R.apply(spark.createDataFrame([], GOLD), spark.createDataFrame([], R.EVENT))
    assert none.count() == 0 and R.stats(none).count() == 0 and R.queue(none).count() == 0


def test_passages_of_new_spans_and_twins(spark):
    records = applied(spark)
    texts = spark.createDataFrame([(3, "right"), (4, "five"), (1, "other")], "query_id int, text string")
    got = {r["query_id"]: r for r in R.respanned(records, texts).collect()}
    assert (got[3]["answer_passage"], got[3]["original_answer_passage"], got[3]["fixed"]) == ("right", "p", True)
    assert not got[4]["fixed"] and not got[1]["fixed"] and got[1]["answer_passage"] == "p"
    twins = spark.createDataFrame([(k, "d", 20, 30) for k in (1, 4, 5, 6)], "query_id int, doc_id string, twin_start int, twin_end int")
    once = R.with_twins(records, twins)
    got = {r["query_id"]: r for r in once.collect()}
    assert [tuple(s) for s in got[1]["gold_spans"]] == [A, ("d", 20, 30)] and got[1]["require"] == "any" and got[1]["twin_span_added"] and len(got[6]["gold_spans"]) == 2
    assert len(got[4]["gold_spans"]) == 2 and not got[4]["twin_span_added"] and len(got[5]["gold_spans"]) == 1
    assert [len(r["gold_spans"]) for r in R.with_twins(once, twins).orderBy("query_id").collect()] == [len(r["gold_spans"]) for r in once.orderBy("query_id").collect()]
