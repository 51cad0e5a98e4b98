import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline.llm import minhash as M
from quarryline.llm import queries
from quarryline.llm import spans as S
from quarryline.llm.records import records


def texts(rnd, n=60):
    out = [" ".join(f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(3, 120))) for _ in range(n)]
    for k in range(0, n, 2):
        words = out[k].split()
        for _ in range(rnd.randint(0, 4)):
            words.insert(rnd.randint(0, len(words)), f"new{rnd.randint(0, 9)}")
        out.append(" ".join(words))
    return out


def sets(t):
    w = re.findall(r"\w+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def pairs_of(rows, threshold):
    own = {k: sets(t) for k, t in rows}
    return {(a, b) for a in own for b in own if a < b and own[a] and own[b] and len(own[a] & own[b]) / len(own[a] | own[b]) >= threshold}


@pytest.mark.parametrize("bucket", [64, 2])
def test_pairs_against_brute_force(spark, bucket):
    """With buckets of two at most, nearly all go the exact way for full buckets."""
    rnd = random.Random(bucket)
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts(rnd))]
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper())] + [(f"hot{i}", rows[1][1] + f" end{i}") for i in range(12)]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows + rows[:9]] + [(None, "x y z u v w", 1, ""), ("null", None, 1, ""), ("empty", "", 1, "")], "id string, content string, cls int, rec_key string")
    got = {(r["id_a"], r["id_b"]) for r in M.near_pairs(df, "id", "content", 0.7, bucket=bucket).collect()}
    assert got == pairs_of(rows, 0.7)


@pytest.mark.parametrize("copies, again, bucket, parts", [(70, 1, 64, 4), (2, 8, 2, 4), (400, 1, 64, 4), (2, 400, 64, 100)])
def test_class_of_many_rows_hides_no_variant(spark, copies, again, bucket, parts):
    """Copies of one text under more ids than a bucket holds, or one id delivered again in other tasks, beside variants."""
    rnd = random.Random(72)  # the copied text is the least class of all
    words = [f"w{rnd.randint(0, 300)}" for _ in range(80)]
    rows = [(f"copy{i:03}", " ".join(words)) for i in range(copies)]
    rows += [(f"near{i:02}", " ".join(words[: 5 * i] + [f"new{i}"] + words[5 * i :])) for i in range(14)]
    df = spark.createDataFrame(rows * again, "id string, content string").repartition(parts)
    want = pairs_of(rows, 0.7)
    got = {(r["id_a"], r["id_b"]) for r in M.near_pairs(df, "id", "content", 0.7, bucket=bucket).collect()}
    assert got == want and ("copy000", "near13") in want
    links = {k: sum(k in p for p in want) for k, _ in rows}
    got = {r["id"]: (r["group_id"], r["links"]) for r in M.near_groups(df, "id", "content", 0.7, bucket=bucket).collect()}
    assert got == {k: ("copy000", n) for k, n in links.items()}


@pytest.mark.parametrize("share, near", [(0.75, 0), (0.9, 30)])
def test_boilerplate_in_hot_buckets(spark, share, near):
    """3,000 texts with most of their words in common: all bands of the common part are full. Nothing similar is lost, and what
    is looked at doesn't grow with the square of the texts unless they are similar."""
    rnd = random.Random(7)
    common = [f"c{i}" for i in range(int(200 * share))]
    rows = []
    for i in range(3000 if not near else 60):
        own = [f"t{i // 2 if i < 20 else i}_{k}" for k in range(200 - len(common))]
        rows.append((f"k{i:04}", " ".join(common + own + ([f"x{i}"] if i < 20 else []))))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, content string")
    got = {(r["id_a"], r["id_b"]) for r in M.near_pairs(df, "id", "content", 0.8, bucket=16).collect()}
    pairs = {(f"k{i:04}", f"k{i + 1:04}") for i in range(0, 20, 2)}
    assert got == pairs if not near else got == pairs_of(rows, 0.8) and len(got) > 1000


def test_id_with_two_texts(spark):
    """Each of the two texts is compared as the one it is."""
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "vw")
    rows = [("a", one), ("a", two), ("y", one + " x"), ("z", two + " x")]
    got = M.near_pairs(spark.createDataFrame(rows, "id string, content string"), "id", "content", 0.7).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == {("a", "y"), ("a", "z")}


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("c", base), ("a", base), ("b", base + " x y"), ("d", "z " * 9), ("e", "too few words"), ("f", "other " + " ".join(f"v{i}" for i in range(30)))]
    got = {r["id"]: (r["group_id"], r["links"]) for r in M.near_groups(spark.createDataFrame(rows, "id string, content string"), "id", "content").collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2), "d": ("d", 0), "e": ("e", 0), "f": ("f", 0)}


def test_components_of_a_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(i, f"n{i:02}") for i in range(n + 1)], "node bigint, least string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)], "a bigint, b bigint")
    got = {r["node"]: r["least"] for r in M.components(nodes, edges).collect()}
    assert set(got.values()) == {"n00", f"n{n:02}"} and got[n] == f"n{n:02}"


def test_components_of_a_long_chain(spark):
    """Least labels at one end, while all others grow from the other end on."""
    n = 5000
    nodes = spark.createDataFrame([(i, "n" if i == 0 else f"n{n - i:04}") for i in range(n)], "node bigint, least string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)], "a bigint, b bigint")
    assert {r["least"] for r in M.components(nodes, edges).collect()} == {"n"}


def shares(recs, span):
    own = {}
    for k, t in recs:
        for i in range(len(t) - span + 1):
            own.setdefault(t[i : i + span], set()).add(k)
    out = {}
    for k, t in recs:
        held = set()
        for i in range(len(t) - span + 1):
            if len(own[t[i : i + span]]) > 1:
                held |= set(range(i, i + span))
        out[k] = len(held)
    return out


def test_spans_against_brute_force(spark, monkeypatch):
    from quarryline.llm import kernel

    monkeypatch.setattr(kernel, "CHUNK", 1 << 18)
    rnd = random.Random(9)
    random_text = lambda n: "".join(rnd.choices("abcdé😀 \n", k=n))
    common, boiler = [random_text(n) for n in (20, 29, 30, 31, 45, 90)], random_text(50)
    rows = []
    for i in range(50):
        t = "".join(x for _ in range(rnd.randint(0, 3)) for x in (random_text(rnd.randint(0, 60)), rnd.choice(common)))
        rows.append((f"r{i}", t + (boiler + random_text(9) if i % 3 == 0 else "")))
    rows += [("twice", common[5] * 2), ("repeat", (u := random_text(40)) + u), ("long", random_text(3000)), ("empty", "")]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows + rows[:7]] + [(None, common[5], 5), ("none", None, 5)], "id string, content string, rec int").repartition(3)
    halves = [records(df.where(F.crc32("id") % 2 == k), "t", "id", "content") for k in (0, 1)]
    want = shares(rows, 30)
    got = {r["rec_key"]: r["shared_chars"] for r in S.shared_shares(halves, 30, 12).collect()}
    assert got == want
    assert {r["rec_key"] for r in S.records_sharing(halves, 30, 12).collect()} == {k for k, n in want.items() if n}


@pytest.mark.parametrize("span, gram", [(160, 96), (30, 12)])
def test_passage_repeated_in_equal_surroundings(spark, span, gram):
    """Each place of the passage counts, in one row of the index or in rows of several batches."""
    rnd = random.Random(span)
    a, p, b, x, c, d = ("".join(rnd.choices("abcdefgh", k=n)) for n in (span, span + 20, span, 50, 70, 70))
    rows = [("r", a + p + b + x + a + p + b), ("s", c + p + d), ("t", d[:20] + x[:9] + c[:20])]
    df = spark.createDataFrame(rows + rows[:1], "id string, content string")
    want = shares(rows, span)
    assert want["r"] == 2 * want["s"] >= 2 * len(p) and want["t"] == 0
    for batches in ([df], [df.where("id = 's'"), df.where("id <> 's'")]):
        got = S.shared_shares([records(x, "t", "id", "content") for x in batches], span, gram).collect()
        assert {r["rec_key"]: r["shared_chars"] for r in got} == want


def test_span_index_takes_batches_and_compacts(spark, tmp_path):
    """Each batch is taken by an index that was opened anew; what a batch shares with a compacted one is found."""
    base = "".join(random.Random(1).choices("abcdefgh", k=300))
    found, at = [], f"file://{tmp_path}/index"
    for k in range(5):
        batch = spark.createDataFrame([("t", f"{k}", base if k in (1, 3, 4) else f"{k}" * 300)], "rec_table string, rec_key string, text string")
        index = S.SpanIndex(spark, at, fanout=2)
        found.append({r["rec"] for r in index.append(S.keyed(batch)).collect()})
        assert len(index.runs) <= 2 and len(list((tmp_path / "index" / "runs").iterdir())) == len(index.runs)
    assert [len(x) for x in found] == [0, 0, 0, 2, 3]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quarryline")]
    none = records(spark.createDataFrame([], "id string, content string"), "t", "id", "content")
    assert S.records_sharing([none, none]).count() == 0 and S.shared_shares([none]).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_passage_of_a_third_of_all_records(spark, monkeypatch, parts):
    """Rows with many places leave their fingerprint's bucket; in a first batch, in a later one, and in both."""
    rnd = random.Random(parts)
    text = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    passage = text(200)
    rows = [(f"r{i:04}", text(40) + (passage if i % 3 == 0 else text(200)) + text(30)) for i in range(900)] + [("one", "x" + passage[:170]), ("none", passage[:150])]
    df = spark.createDataFrame(rows, "id string, content string").repartition(parts, "id")
    want = {k for k, n in shares(rows, 160).items() if n}
    assert len(want) == 301
    for key in ("id = 'one'", "id <> 'one'", "crc32(id) % 2 = 0"):
        batches = [records(x, "t", "id", "content") for x in (df.where(key), df.where(f"NOT ({key})"))]
        assert {r["rec_key"] for r in S.records_sharing(batches).collect()} == want


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    df = queries.queries()[name](spark, str(DATA))
    rows = lambda data: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in data)
    assert sorted(df.columns) == sorted(cols) and rows(df.select(*cols).collect()) == rows(want.fetchall())
