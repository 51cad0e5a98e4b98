import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import metrics as M
from quarryline.operators import search
from quarryline.operators.ranking import positions
from quarryline.operators.runs import ranked

RUN = "config string, mode string, query_id int, rank int, id string, doc_id string, char_start int, char_end int, token_count int, search_score double, rerank_score double"
GOLD = "query_id int, query_type string, require string, verified boolean, gold_spans array<struct<doc_id:string,span_start:int,span_end:int>>"


def brute(results, spans, require):
    """(rank, tokens) by sets of covered places."""
    covered, tokens = [set() for _ in spans], 0
    for k, (doc, s, e, n) in enumerate(results, 1):
        tokens += n
        for c, (d, a, b) in zip(covered, spans):
            if d == doc:
                c |= set(range(max(s, a), min(e, b)))
        met = [len(c) / max(1, b - a) >= 0.8 for c, (_, a, b) in zip(covered, spans)]
        if all(met) if require == "all" else any(met):
            return k, tokens
    return None


def outcomes(spark, cases):
    runs = [("c", "m", q, k, f"{q}_{k}", *r, None, None) for q, (results, *_) in enumerate(cases) for k, r in enumerate(results, 1)]
    gold = [(q, "t", require, True, spans) for q, (_, spans, require) in enumerate(cases)]
    out = M.outcomes(spark.createDataFrame(runs, RUN), M.gold(spark.createDataFrame(gold, GOLD))).collect()
    return {r["query_id"]: (r["rank"], r["budget"]) if r["rank"] else None for r in out}


def test_hand_made_cases(spark):
    a = [("d", 0, 5, 300), ("d", 5, 10, 300)]
    cases = [
        (a, [("d", 0, 10)], "all"),
        ([("d", 0, 8, 1)], [("d", 0, 10)], "all"),
        ([("d", 0, 7, 1), ("d", 0, 7, 1)], [("d", 0, 10)], "all"),
        ([("d", 0, 9, 1), ("x", 0, 9, 1), ("x", 0, 9, 1), ("e", 0, 9, 1)], [("d", 0, 9), ("e", 0, 9)], "all"),
        ([("d", 0, 9, 1), ("x", 0, 9, 1), ("x", 0, 9, 1), ("e", 0, 9, 1)], [("d", 0, 9), ("e", 0, 9)], "any"),
        (a, [], "all"), (a, [], "any"), (a, [("d", 4, 4)], "all"), ([("other", 0, 10, 1)], [("d", 0, 10)], "all"),
    ]
    got = outcomes(spark, cases)
    assert [got[k] and got[k][0] for k in range(len(cases))] == [2, 1, None, 4, 1, 1, None, None, None]
    assert got[0] == (2, 600)


def test_against_sets_of_places(spark):
    rnd = random.Random(7)
    cases = []
    for _ in range(150):
        results = [(rnd.choice("de"), s := rnd.randint(0, 40), s + rnd.randint(1, 25), rnd.randint(0, 9)) for _ in range(rnd.randint(1, 8))]
        spans = [(rnd.choice("de"), s := rnd.randint(0, 40), s + rnd.randint(0, 20)) for _ in range(rnd.randint(0, 3))]
        cases.append((results, spans, rnd.choice(["all", "any"])))
    got = outcomes(spark, cases)
    for k, case in enumerate(cases):
        assert got[k] == brute(*case), case


@pytest.mark.parametrize("a,b,p", [(1, 13, 0.002), (4, 11, 0.118), (19, 3, 0.001), (4, 17, 0.007), (7, 2, 0.180), (8, 5, 0.581), (0, 0, 1.0)])
def test_published_p_values(spark, a, b, p):
    row = spark.createDataFrame([(a, b)], "a bigint, b bigint").select(M.exact_binomial(F.col("a"), F.col("b")).alias("p")).first()
    assert round(row["p"], 3) == p


def test_large_counts_do_not_vanish(spark):
    row = spark.createDataFrame([(2000, 2100)], "a bigint, b bigint").select(M.exact_binomial(F.col("a"), F.col("b")).alias("p")).first()
    assert 0.1 < row["p"] < 0.13


def test_mcnemar_counts(spark):
    rows = [("a", 1, 1), ("b", 1, None), ("a", 2, None), ("b", 2, 3), ("a", 3, 9), ("b", 3, 2), ("a", 4, 1)]
    r = M.mcnemar(spark.createDataFrame(rows, "mode string, query_id int, rank int"), "mode", [("a", "b")], 5).first()
    assert (r["both"], r["a_only"], r["b_only"], r["neither"]) == (0, 1, 2, 0)


def test_mcnemar_of_several_columns(spark):
    rows = [("c", "a", 1, 1), ("c", "b", 1, None), ("x", "a", 2, 1)]
    out = M.mcnemar(spark.createDataFrame(rows, "config string, mode string, query_id int, rank int"), ["config", "mode"], [(("c", "a"), ("c", "b")), (("c", "a"), ("x", "a"))], 5)
    assert {(r["a"], r["b"]): (r["a_only"], r["b_only"], r["neither"], r["p"]) for r in out.collect()} == {("c / a", "c / b"): (1, 0, 0, 1.0), ("c / a", "x / a"): (0, 0, 0, 1.0)}


def test_floor_quantile_rule(spark):
    df = spark.createDataFrame([("x", v) for v in (4.0, 1.0, 3.0, 2.0)] + [("y", None), ("y", 5.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["m"], r["top"]) for r in M.floor_quantiles(df, ["g"], "v", {"m": 0.5, "top": 1.0}).collect()}
    assert got == {"x": (4, 3.0, 4.0), "y": (1, 5.0, 5.0)}
    assert M.floor_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_bootstrap(spark):
    r = M.bootstrap_interval(spark.createDataFrame([(160, 200), (0, 0)], "hits bigint, n bigint"), []).collect()
    assert 0.73 < r[0]["low"] < 0.76 and 0.84 < r[0]["high"] < 0.87 and (r[1]["low"], r[1]["high"]) == (0.0, 0.0)


def test_positions_of_a_hot_group(spark):
    rows = [("hot", i % 7, i) for i in range(3000)] + [(None, 0, 1), ("cold", 5, 2)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(8)
    got = positions(df, ["k"], [F.col("v"), F.col("i")], "at").collect()
    hot = sorted((r["v"], r["i"], r["at"]) for r in got if r["k"] == "hot")
    assert [at for *_, at in hot] == list(range(1, 3001))
    assert {r["k"]: r["at"] for r in got if r["k"] != "hot"} == {None: 1, "cold": 1}


def test_ranked_takes_repeats_once(spark):
    rows = [("c", "m", 1, 2, "b", "d", 0, 1, 1, 0.5, None, 1), ("c", "m", 1, 2, "b", "d", 0, 1, 1, 0.5, None, 2), ("c", "m", 1, 1, "a", "d", 0, 1, None, 0.9, None, None)]
    df = spark.createDataFrame(rows, RUN.replace("rank int", "rank_no int") + ", loaded_at int")
    assert [(r["rank"], r["id"]) for r in ranked(df).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_fusion_and_rerank(spark):
    lists = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "y", 1)], "query_id int, id string, rank int")
    assert [r["id"] for r in search.fuse(lists, ["query_id"], "id", "rank").orderBy("rank").collect()] == ["y", "x"]
    scored = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, 2.0), (1, "c", 3, 2.0)], "query_id int, id string, rank int, s double")
    assert [r["id"] for r in search.rerank(scored, ["query_id"], "s", "rank").orderBy("new_rank").collect()] == ["b", "c", "a"]


def test_bm25_prefers_rare_words(spark):
    docs = spark.createDataFrame([("1", "the margin of the pool"), ("2", "the the the"), ("3", None), ("4", "")], "id string, content string")
    q = spark.createDataFrame([(7, "the margin")], "query_id int, query string")
    assert [r["id"] for r in search.bm25(q, "query_id", "query", docs, "id", "content").orderBy("rank").collect()] == ["1", "2"]


def test_nearest(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = search.nearest(v, "vec_id", "embedding", F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]
    assert search.nearest(v.limit(0), "vec_id", "embedding", F.col("vec_id") == 0).count() == 0
