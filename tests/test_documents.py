import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions.unicode import fold
from quarryline.operators import answers as A
from quarryline.operators import chunking as C
from quarryline.operators import documents as D


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,date", [
    ("Circular\nMarch 7, 2025 and May 1, 2024", datetime.date(2025, 3, 7)), ("May 1 2024", datetime.date(2024, 5, 1)), ("x" * 801 + "May 1, 2024", None), ("may 1, 2024", None), ("", None), (None, None),
])
def test_doc_date(spark, text, date):
    assert one(spark, text, T.doc_date) == date


@pytest.mark.parametrize("text,subject", [
    ("Ref 1\nSub: Position  Limits..\nbody", "position limits"), ("Subject : A", "a"), ("To,\nAll Members\n\nRevision of Lots.\nx", "revision of lots"),
    ("All Members\nMembers are informed", None), ("All Members\n" + "x" * 161, None), ("Nothing", None), ("", None),
])
def test_doc_subject(spark, text, subject):
    assert one(spark, text, T.doc_subject) == subject


def test_words_of_any_script(spark):
    assert one(spark, "déjà vu", T.words) == ["déjà", "vu"]
    assert one(spark, "a b c d", T.shingles) == [] and one(spark, "a b c d e", T.shingles) == ["a b c d e"] and one(spark, None, T.shingles) is None


@pytest.mark.parametrize("n,tokens", [(0, 1), (2, 1), (6, 2), (10, 2), (14, 4)])
def test_ntok_rounds_half_to_even(spark, n, tokens):
    assert one(spark, "x" * n, T.ntok) == tokens == C.tokens(n)


def test_lines_and_labels(spark):
    assert one(spark, "a \nPage 1 of 2\n\nContinuation Sheet\nb", T.clean_lines) == "a\nb"
    assert one(spark, "\n\na\n\n\n\nb ", T.collapse_blank_lines) == "a\n\nb\n"
    row = spark.range(1).select(T.table_row_labelled([F.lit("h"), F.lit("i"), F.lit("j")], [F.lit("1"), F.lit(""), F.lit("3")]).alias("x")).first()["x"]
    assert row == "  h: 1; j: 3"
    assert one(spark, "Time: 7:30; Lot: 50", T.canon_tokens) == ["7:30", "50"] and one(spark, "7:30 50", T.canon_tokens) == ["7:30", "50"]
    assert one(spark, "Ａ’s  “x”–", fold) == "a's \"x\"-"
    got = D.lines(spark.createDataFrame([(1, "😀a\nb"), (2, None), (3, "")], "doc_id int, text string"), "doc_id", "text").orderBy("doc_id", "line_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 2, "😀a"), (1, 1, 3, 4, "b"), (3, 0, 0, 0, "")]


def test_citations_are_whole_runs_of_digits(spark):
    docs = spark.createDataFrame([(1, "A-1", "see 127650 and no. 2765x"), (2, "A-2", "127650"), (3, "B-2765", "2765"), (4, "A-3", None)], "doc_id int, circular_id string, text string")
    serials = spark.createDataFrame([("B-2765", "2765"), ("C-122", "122")], "circular_id string, serial string")
    assert [tuple(r) for r in D.citation_edges(docs, "doc_id", "circular_id", "text", serials).collect()] == [(1, "A-1", "B-2765", 19, "see 127650 and no. 2765x")]


def test_duplicates_and_families(spark):
    docs = spark.createDataFrame([(3, "a  b"), (1, "a b"), (2, "a b\n"), (4, None), (5, "c")], "doc_id int, text string")
    assert sorted(map(tuple, D.exact_duplicates(docs, "doc_id", "text").collect())) == [(2, 1), (3, 1)]
    base = " ".join(f"w{i}" for i in range(60))
    near = spark.createDataFrame([(1, base), (2, base + " x"), (3, base), (4, "y " * 60), (5, "")], "doc_id int, text string")
    assert [tuple(r)[:2] + tuple(r)[3:] for r in D.near_duplicates(near, "doc_id", "text").collect()] == [(1, 2, 2, 1)]
    fam = spark.createDataFrame([("a", "s", None), ("b", "s", None), ("c", "t", None), ("d", None, None)], "id string, subject string, on date")
    assert [tuple(r) for r in D.subject_families(fam, "id", "subject", "on").collect()] == [("s", 2, "b")]


def test_members_and_edges_in_order(spark):
    day = datetime.date
    rows = [("a", "s", day(2030, 1, 2)), ("b", "s", None), ("c", "s", day(2030, 1, 1)), ("c", "s", day(2030, 1, 1)), ("d", "s", None), ("e", "t", None), ("f", None, None)]
    fam = spark.createDataFrame(rows, "id string, subject string, on date").repartition(3)
    assert [tuple(r)[:3] for r in D.family_members(fam, "id", "subject", "on").orderBy("member_no").collect()] == [("s", 1, "b"), ("s", 2, "d"), ("s", 3, "c"), ("s", 4, "a")]
    assert [r["id"] for r in D.in_date_order(fam.distinct(), "on", ["id"]).orderBy("place").collect()] == ["b", "d", "e", "f", "c", "a"]
    assert D.family_members(fam.limit(0), "id", "subject", "on").count() == 0


def test_locate_passages(spark):
    rows = [("😀 the pool\n of x.y", "the pool"), ("😀 the pool\n of x.y", " pool of x.y "), ("a  b", "a b"), ("abc", "abd"), ("abc", " "), ("abc", None), (r"a\Eb  c", r"a\Eb c")]
    got = D.locate_passages(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()
    assert [(r["span_start"], r["span_end"]) for r in got] == [(2, 10), (6, 18), (0, 4), (None, None), (None, None), (None, None), (0, 7)]


def test_table_twins(spark):
    text = "Head: x\nSymbol: ABC; Lot\nSize: 50; Old: 7:30; New: 8\nother\n  ABC 50 7:30 8\nend"
    start = text.index("  ABC") + 2
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    spans = spark.createDataFrame([("s", 1, start, start + len("ABC 50 7:30 8"))], "span_key string, doc_id int, span_start int, span_end int")
    (r,) = D.table_twins(spans, docs, "doc_id", "text").collect()
    assert text[r["twin_start"] : r["twin_end"]] == "Symbol: ABC; Lot\nSize: 50; Old: 7:30; New: 8"


def chunk_reference(text, most, overlap):
    """The recursive splitter over strings, token by token of its description."""

    def cut(t, level):
        if C.tokens(len(t)) <= most:
            return [t]
        if level == 4:
            return [t[i : i + most * 4] for i in range(0, len(t), most * 4)]
        parts = t.split(C.SEPARATORS[level])
        parts = [p + C.SEPARATORS[level] for p in parts[:-1]] + parts[-1:]
        return [x for p in parts if p for x in cut(p, level + 1)]

    chunks, held = [], []
    for p in cut(text, 0):
        if held and C.tokens(len("".join(held) + p)) > most:
            chunks.append("".join(held))
            back = []
            while held and sum(C.tokens(len(x)) for x in [held[-1], *back]) <= overlap:
                back.insert(0, held.pop())
            held = back
        held.append(p)
    return chunks + (["".join(held)] if held else [])


def test_recursive_chunks(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["word ", "x" * 30, ". ", "\n", "\n\n", "é"]) for _ in range(rnd.randint(0, 300))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (98, ""), (99, None)], "doc_id int, text string")
    got = C.recursive(docs, "doc_id", "text", 32, 8).orderBy("doc_id", "chunk_no").collect()
    for k, t in enumerate(texts):
        own = [r for r in got if r["doc_id"] == k]
        assert [r["content"] for r in own] == (chunk_reference(t, 32, 8) if t else [])
        assert all(t[r["char_start"] : r["char_end"]] == r["content"] for r in own)
    built = C.build(docs, "doc_id", "text", (("a-fixed", 32, 8), ("b-recursive", 32, 8)))
    assert C.verify(built, docs, "doc_id", "text").agg(F.sum("wrong"), F.sum("uncovered")).first() == (0, 0)


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 100), (2, "x" * 128), (3, "x" * 129)], "doc_id int, text string")
    got = sorted((r["doc_id"], r["char_start"], r["char_end"]) for r in C.fixed(docs, "doc_id", "text", 32, 8).collect())
    assert got == [(1, 0, 100), (2, 0, 128), (3, 0, 128), (3, 96, 129)]


def test_answers(spark):
    cites = spark.createDataFrame(
        [(1, 1, True, "k", "the POOL\nof"), (2, 1, True, "k", "lost"), (3, 2, True, "gone", "x"), (4, 3, True, "k", " "), (5, 4, True, "k", "pool of"), (6, 5, True, "k", None)],
        "citation_id int, answer_id int, answered boolean, chunk_id string, source_quote string",
    )
    chunks = spark.createDataFrame([("k", "😀 the pool of", 100, 113)], "chunk_id string, content string, chunk_start int, chunk_end int")
    v = A.verified(cites, chunks)
    got = {r["citation_id"]: (r["problem"], r["quote_start"], r["quote_end"]) for r in v.collect()}
    assert got == {1: (None, 100, 113), 2: (A.ABSENT, None, None), 3: (A.UNKNOWN, None, None), 4: (A.EMPTY, None, None), 5: (None, 106, 113), 6: (A.EMPTY, None, None)}
    reasons = {r["answer_id"]: r["refusal_reason"] for r in A.decisions(v).collect()}
    assert reasons == {1: "some citations failed verification", 2: "nothing retrieved", 3: "no citation survived verification", 4: None, 5: "no citation survived verification"}
    assert {r["citation_id"]: r["cause"] for r in A.causes(v).collect()} == {2: "not present", 3: "not present"}


def test_thresholds_skip_what_is_not_measured(spark):
    m = spark.createDataFrame([("recall_at_5", 0.95), ("refusal_rate", 0.3), ("unknown", 1.0), ("groundedness", None)], "name string, value double")
    assert {r["name"]: r["verdict"] for r in A.verdicts(m, A.threshold_table(spark)).collect()} == {"recall_at_5": "pass", "refusal_rate": "warn"}
