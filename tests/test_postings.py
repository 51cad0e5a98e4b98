"""Keyword search over several blocks of documents, and what it writes to the shared folder."""

import os
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.operators import experiment, search
from quarryline.plans import registry
from quarryline.shared import scratch, shared_dir
from test_experiment import okapi

DATA = Path("/root/testdata/sf0.001")
WORDS = [f"w{i}" for i in range(30)]


def _size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def _got(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    return got


def test_ties_and_rare_words_over_blocks(spark):
    """Few different texts, so that most scores are equal, and words that few documents have."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(WORDS, k=6)) for _ in range(300)]
    docs = [(f"d{i}", rnd.choice(texts) + (f" rare{i // 7}" if i % 50 == 0 else "")) for i in range(20_000)]
    asked = [(i, " ".join(rnd.sample(WORDS, 5))) for i in range(6)] + [(i, f"w1 w2 rare{rnd.randrange(0, 20_000, 350) // 7}") for i in range(6, 10)] + [(10, "w3"), (11, "nowhere")]
    found = search.bm25(spark.createDataFrame(asked, "query_id int, q string"), "query_id", "q", spark.createDataFrame(docs, "id string, content string").repartition(3), "id", "content", 25)
    assert _got(found) == {q: okapi(docs, t)[:25] for q, t in asked if q != 11}


def test_no_ids_and_empty_tables(spark):
    docs, asked = spark.createDataFrame([(5, "a b"), (3, "b a"), (None, "a"), (7, None), (9, "")], "id long, content string"), spark.createDataFrame([("x", "A a"), (None, "a"), ("y", "c")], "query_id string, q string")
    of = lambda q, d: [(r["query_id"], r["id"], r["rank"]) for r in search.bm25(q, "query_id", "q", d, "id", "content").orderBy("rank").collect()]
    assert of(asked, docs) == [("x", 3, 1), ("x", 5, 2)]
    assert of(asked.limit(0), docs) == of(asked, docs.limit(0)) == []


def test_disk_is_less_than_the_texts(spark):
    """bm25_topk at 1 GB: postings, candidates and words of all queries were written, several times the input."""
    rnd = random.Random(1)
    docs = [(f"d{i:05}", " ".join(rnd.choices(WORDS, k=20))) for i in range(5000)]
    asked = [(i, " ".join(rnd.sample(WORDS, 12))) for i in range(100)]
    with scratch(spark):
        before = _size(shared_dir(spark).removeprefix("file://"))
        rows = search.bm25(spark.createDataFrame(asked, "query_id int, q string"), "query_id", "q", spark.createDataFrame(docs, "id string, content string"), "id", "content").collect()
        assert len(rows) == 2000
        assert _size(shared_dir(spark).removeprefix("file://")) - before < sum(len(t) for _, t in docs)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_every_question_is_searched(spark):
    asked = spark.read.parquet(str(DATA / "designed_slice_final.parquet")).where(F.col("query_id").isNotNull() & (F.length("query_text") > 20))
    found = registry.queries()["bm25_topk"](spark, str(DATA))
    assert {r[0] for r in asked.select("query_id").collect()} == {r[0] for r in found.select("query_id").distinct().collect()}


def test_a_word_is_hashed_once_a_batch(monkeypatch):
    """produce_runs: every word of every chunk was hashed on its own."""
    rnd, hashed = random.Random(2), []
    lists = [None, [], *(rnd.choices(WORDS, k=rnd.randrange(40)) for _ in range(200)), None]
    crc = zlib.crc32
    monkeypatch.setattr(experiment.zlib, "crc32", lambda w: hashed.append(w) or crc(w))
    got = experiment.word_counts(pa.array(lists, pa.list_(pa.string()))[1:], 8)
    assert len(hashed) == len(set(hashed)) == len(WORDS)
    want = [None if w is None else np.log1p(np.bincount([crc(x.encode()) % 8 for x in w], minlength=8)).astype(np.float32).tolist() for w in lists[1:]]
    assert got.to_pylist() == want
