import json

import pytest

from quarryline.sources import files
from quarryline.sources import files as S
from quarryline.streaming import chunks as ST


def test_texts(spark, tmp_path):
    (tmp_path / "A-1.txt").write_text("é\nx", encoding="utf-8")
    assert [tuple(r) for r in S.read_texts(spark, f"{tmp_path}/*.txt").collect()] == [("A-1", "é\nx")]


def test_runs_number_places_and_refuse_repeats(spark, tmp_path):
    line = {"config": "c", "mode": "m", "query_id": 1, "results": [{"id": "b"}, {"id": "a"}]}
    (tmp_path / "r.jsonl").write_text(json.dumps(line) + "\n\n")
    assert sorted((r["rank"], r["id"]) for r in S.read_runs(spark, f"{tmp_path}/r.jsonl").collect()) == [(1, "b"), (2, "a")]
    (tmp_path / "s.jsonl").write_text(2 * (json.dumps(line) + "\n"))
    with pytest.raises(Exception, match="twice"):
        S.read_runs(spark, f"{tmp_path}/s.jsonl").collect()


def test_thresholds(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("retrieval:  # x\n  recall_at_5:\n    min: 0.90\n    on_breach: block\ngeneration:\n  refusal_rate:\n    max: 0.2\n    on_breach: warn\n")
    assert sorted(map(tuple, S.read_thresholds(spark, str(tmp_path / "t.yaml")).collect())) == [("generation", "refusal_rate", "max", 0.2, "warn"), ("retrieval", "recall_at_5", "min", 0.9, "block")]


def test_replace_reads_what_it_replaces(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    S.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_index_and_lines(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "d", "x y x", 0, 5)], "id string, doc_id string, content string, char_start int, char_end int")
    S.write_index(chunks, f"{tmp_path}/i")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/i/postings").collect())) == [("x", "a", 2), ("y", "a", 1)]
    with pytest.raises(ValueError):
        S.write_index(chunks.union(chunks), f"{tmp_path}/j")
    S.write_lines(chunks, f"{tmp_path}/l")
    assert S.read_lines(spark, f"{tmp_path}/l", "id string, char_end int").first()["char_end"] == 5
    assert "| a | d |" in S.markdown(chunks, "T")


def test_stream_cuts_each_document_once(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 3000)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ST.chunk_stream(ST.read_document_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_documents_logs_and_reports(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert files.read_document(spark, f"{at}/none.json", "a int").count() == 0
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": ["é"]\n}', encoding="utf-8")
    assert files.read_document(spark, f"{at}/one.json", "a int, b array<string>").first()["b"] == ["é"]
    edges, short = spark.createDataFrame([("x", None)], "a string, b date"), spark.createDataFrame([], "doc string")
    files.write_document(spark, f"{at}/doc", citations=edges, short=short)
    back = files.read_document_folder(spark, f"{at}/doc")
    assert set(back) == {"citations", "short"} and back["citations"].collect() == edges.collect() and back["short"].count() == 0
    assert files.read_document_folder(spark, f"{at}/nowhere") == {}
    files.write_log(spark.createDataFrame([("b ok",), ("a short",)], "line string"), "line", f"{at}/log", "2030-01-01")
    lines = [x for p in sorted((tmp_path / "log").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == ["# run 2030-01-01", "# 2 rows", "", "a short", "b ok"]
    many = spark.range(5).selectExpr("id", "if(id = 0, 'a|b', NULL) AS t")
    text = files.write_report(spark, f"{at}/report.md", "Title", {"Some": many, "None": many.limit(0)}, most=3)
    assert (tmp_path / "report.md").read_text() == text and "2 more rows." in text and "a\\|b" in text and "| - |" in text and text.count("None.") == 1


def test_index_with_vectors(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarryline.operators.experiment import hashed_words

    at = f"file://{tmp_path}"
    chunks = spark.createDataFrame([("a", "d", "one two", 0, 7), ("b", "d", "", 7, 7)], "id string, doc_id string, content string, char_start int, char_end int")
    files.write_index(chunks, f"{at}/index", hashed_words(16), 16)
    assert {r["id"]: len(r["vector"]) for r in spark.read.parquet(f"{at}/index/vectors").collect()} == {"a": 16, "b": 16}
    with pytest.raises(ValueError, match="dimensions"):
        files.write_index(chunks, f"{at}/other", hashed_words(16), 1536)
    with pytest.raises(ValueError, match="dimensions"):
        files.write_index(chunks, f"{at}/third", lambda c: F.when(c != "", F.array(F.lit(1.0))))
    with pytest.raises(ValueError, match="twice"):
        files.write_index(chunks.union(chunks), f"{at}/fourth")


def test_failed_swap_keeps_the_table(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(at)
    real, calls = files.move, []

    def second_fails(s, a, b):
        calls.append(a)
        return False if len(calls) == 2 else real(s, a, b)

    monkeypatch.setattr(files, "move", second_fails)
    with pytest.raises(OSError):
        files.replace_table(spark.range(9), at)
    assert spark.read.parquet(at).count() == 3


def test_scratch_is_removed(spark):
    from quarryline import shared

    with shared.scratch(spark):
        df = shared.written(spark.range(3), "x")
        path = df.inputFiles()[0]
        assert df.count() == 3
    assert not shared.exists(spark, path)
