import random

from pyspark.sql import functions as F

from quarryline.llm import leximin as L
from quarryline.llm import pieces as P

SCHEMA = "grp int, item string, source string, score double, vector string"


def scores(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows, sources):
    best = {}
    for g, i, s, x in rows:
        if g is not None and i is not None:
            best.setdefault(g, {}).setdefault(i, {})
            if x is not None and x == x:
                best[g][i][s] = max(x, best[g][i].get(s, x))
    out = {}
    for g, items in best.items():
        n, vectors = len(items), {}
        for i in items:
            below = [sum(items[o].get(s, float("-inf")) < items[i].get(s, float("-inf")) for o in items) for s in sources]
            vectors[i] = sorted(b / max(1, n - 1) for b in below)
        out[g] = [i for i, _ in sorted(vectors.items(), key=lambda kv: ([-v for v in kv[1]], kv[0]))]
    return out


def test_weak_scores_are_not_masked(spark):
    rows = [(1, i, s, x) for i, xs in {"strong": (900.0, 0.1, 5.0), "even": (40.0, 0.6, 4.0), "weak": (1.0, 0.9, -9.0)}.items() for s, x in zip("abc", xs)]
    assert L.first_of(L.percentile_vectors(scores(spark, rows), list("abc"))).first()["item"] == "even"


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice("uvwxyz"), rnd.choice("abcd"), rnd.choice([None, float("nan"), 1.0, 2.0, rnd.random()])) for _ in range(150)]
    rows += rows[:20] + [(4, "only", "d", 1.0), (5, None, "a", 1.0)]
    want = brute(rows, "abc")
    v = L.percentile_vectors(scores(spark, rows), list("abc"))
    got = {}
    for r in L.ranking(v).orderBy("grp", "rank_no").collect():
        got.setdefault(r["grp"], []).append(r["item"])
    assert got == want
    assert {r["grp"]: r["item"] for r in L.first_of(v).collect()} == {g: items[0] for g, items in want.items()}
    assert L.ranking(L.percentile_vectors(scores(spark, []), list("abc"))).count() == 0


def prose(rnd, n):
    return "".join(" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(rnd.randint(4, 18))) + rnd.choice([". ", "! ", ".\n", ".\r\n", ".\n\n", "。"]) for _ in range(n))


def check(text, limit=400, overlap=50):
    cuts = P.split(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (s, e), (t, f) in zip(cuts, cuts[1:]):
        assert s < t <= e < f and e - t <= overlap
    assert all(0 < e - s <= limit for s, e in cuts)
    assert not any(text[e - 1 : e + 1] == "\r\n" for _, e in cuts)
    return cuts


def test_pieces_hold_the_text():
    rnd = random.Random(1)
    for n in (1, 5, 40, 200):
        check(prose(rnd, n))
    check("x" * 5000)
    check("a\r\n" * 900)
    check("é" * 1500)
    assert P.split("") == [] and P.split("x" * 2048) == [(0, 2048)]


def test_pieces_end_at_boundaries():
    text = prose(random.Random(2), 400)
    ends = [text[:e] for _, e in P.split(text)[:-1]]
    assert sum(t[-1].isspace() or t[-1] == "。" for t in ends) == len(ends)
    assert sum(t.rstrip()[-1] in ".!。" for t in ends) > 0.7 * len(ends)


def test_an_edit_alters_only_neighbours():
    text = prose(random.Random(3), 600)
    edited = text[:3000] + "an inserted remark. " + text[3000:]
    a, b = ({t[s:e] for s, e in P.split(t)} for t in (text, edited))
    assert len(b - a) <= 4 and len(a) > 15


def test_pieces_operator(spark):
    long = prose(random.Random(4), 80)
    rows = [("a", long, 7, "x"), ("a", long, 7, "x"), ("b", "short", 0, "x"), ("c", None, 0, "x"), ("d", "", 0, "x"), (None, long, 0, "x"), ("e", long, None, "x")]
    df = spark.createDataFrame(rows, "id string, content string, char_start int, piece string")
    got = P.pieces(df, "id", "content", "char_start").collect()
    assert {r["key"] for r in got} == {"a", "e"}
    for r in got:
        assert r["piece"] == long[r["piece_start"] : r["piece_end"]] and r["char_start"] == (7 + r["piece_start"] if r["key"] == "a" else None)
    assert sorted(r["piece_no"] for r in got if r["key"] == "a") == list(range(len(P.split(long))))
    assert P.pieces(df.limit(0), "id", "content").count() == 0
    assert df.where(F.length("content") > 2048).select("id").distinct().count() == 3
