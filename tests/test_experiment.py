import math
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import chunking as C
from quarryline.operators import experiment, search
from quarryline.operators.runs import ranked


def okapi(docs, question):
    words = {k: t.split() for k, t in docs}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    scores = {}
    for w in set(question.split()):
        df = sum(w in own for own in words.values())
        for k, own in words.items():
            if tf := own.count(w):
                scores[k] = scores.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / avg))
    return sorted((-round(s, 6), k) for k, s in scores.items())


@pytest.mark.parametrize("k", [1, 3, 20])
def test_bm25_against_brute_force(spark, k):
    """Words from common to rare, so that most of a question's words are not essential."""
    rnd = random.Random(k)
    pool = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choices(pool, [1 / (i + 1) for i in range(40)], k=n))
    docs = [(f"d{i:03}", text(rnd.randint(1, 60))) for i in range(150)]
    asked = [(i, text(9)) for i in range(25)] + [(90, "unheard of"), (91, None), (92, "")]
    got = {}
    for r in search.bm25(spark.createDataFrame(asked, "query_id int, q string"), "query_id", "q", spark.createDataFrame(docs, "id string, content string"), "id", "content", k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    assert got == {q: okapi(docs, t)[:k] for q, t in asked if t and okapi(docs, t)}


def test_runs_of_all_configurations_and_modes(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(400))) for i in range(12)] + [(99, None)], "doc_id int, text string")
    chunks = C.build(docs, "doc_id", "text")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (1, "w1 w2 w3"), (2, "w50"), (3, None)], "query_id int, q string")
    rows = experiment.produce(asked, "query_id", "q", chunks, [c for c, *_ in C.CONFIGS], pool=5).collect()
    lists = {}
    for r in rows:
        lists.setdefault((r["config"], r["mode"], r["query_id"]), []).append(r)
    assert set(lists) == {(c, m, q) for c, *_ in C.CONFIGS for m in experiment.MODES for q in (1, 2)}
    for (config, mode, q), own in lists.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 5 and len({r["id"] for r in own}) == len(own)
        if mode == "hybrid+rerank":
            assert {r["id"] for r in own} == {r["id"] for r in lists[config, "hybrid", q]} and [r["rerank_score"] for r in own] == sorted((r["rerank_score"] for r in own), reverse=True)


def test_nearest_to_other_rows(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, v array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0])], "qid int, v array<float>")
    got = search.nearest_to(q, "qid", "v", v, "id", "v", 2).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, "a"), (1, "c")]


def test_lists_are_filled_from_their_content(spark):
    rows = [("c", "m", 1, 1, "a", "d", 10, None, None, None, None, 1, "x" * 10), ("c", "m", 1, 2, "b", "d", 0, 7, 9999, None, None, 1, "y" * 6), ("c", "m", 1, 3, "e", "d", 5, None, None, None, None, 1, None)]
    df = spark.createDataFrame(rows, "config string, mode string, query_id int, rank_no int, id string, doc_id string, char_start int, char_end int, token_count int, search_score double, rerank_score double, loaded_at int, content string")
    assert [(r["char_end"], r["token_count"]) for r in ranked(df).orderBy("rank").collect()] == [(20, 2), (7, 2), (None, 0)]


def test_chunks_by_a_tokenizer(spark):
    def words_end(text):
        return [i + 1 for i in range(len(text)) if i + 1 == len(text) or text[i + 1] == " "]

    text = " ".join(f"word{i}" for i in range(25)) + "\n\n" + " ".join("ab" for _ in range(9)) + ". end"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id int, text string")
    configs = (("words-fixed", 8, 2), ("words-recursive", 8, 2))
    chunks = C.build(docs, "doc_id", "text", configs, words_end)
    rows = chunks.collect()
    for r in rows:
        own = {1: text, 4: "one"}[r["doc_id"]]
        assert own[r["char_start"] : r["char_end"]] == r["content"] and r["token_count"] == len(words_end(r["content"])) and r["token_count"] <= 10
    bad = C.verify(chunks, docs, "doc_id", "text").where("wrong + uncovered > 0")
    assert bad.count() == 0
    fixed = sorted(r["char_start"] for r in rows if r["config"] == "words-fixed" and r["doc_id"] == 1)
    ends = [0, *words_end(text)]
    assert fixed == [ends[i] for i in range(0, len(ends) - 1, 6)][: len(fixed)] and len(fixed) == math.ceil((len(ends) - 1 - 2) / 6)


def test_embedder_and_reranker_take_nulls(spark):
    df = spark.createDataFrame([("a b", "a x"), (None, "a"), ("a", None), ("", "")], "q string, c string")
    got = df.select(experiment.hashed_words(8)(F.col("q")).alias("v"), experiment.shared_words(F.col("q"), F.col("c")).alias("s")).collect()
    assert [r["s"] for r in got] == [0.5, None, None, 0.0] and got[1]["v"] is None and len(got[0]["v"]) == 8
