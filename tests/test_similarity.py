import random

import pytest

from quarryline.operators.similarity import prefix_pairs, similar_pairs


def sets_of(rnd, n):
    """Sets of unlike sizes, many of them a part of another, with some tokens that all hold."""
    out = []
    for _ in range(n):
        base = rnd.choice(out) if out and rnd.random() < 0.7 else rnd.sample(range(1000), rnd.choice([1, 2, 3, 7, 20, 60, 61, 64, 100]))
        own = [x for x in base if rnd.random() > rnd.choice([0, 0.02, 0.1, 0.3])] + rnd.sample(range(1000), rnd.choice([0, 0, 1, 3, 9]))
        out.append(sorted({*own, *range(2000, 2000 + rnd.choice([0, 0, 5]))}))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_no_similar_pair_is_left_out(spark, threshold):
    own = sets_of(random.Random(threshold), 220)
    df = spark.createDataFrame([*enumerate(own), (900, []), (901, None)], "item int, tokens array<int>")
    got = similar_pairs(df, prefix_pairs(df, threshold), threshold).collect()
    similar = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if similar(own[i], own[j]) >= threshold}
    assert {(r["a"], r["b"]) for r in got} == want and want
    assert prefix_pairs(df.limit(0), threshold).count() == 0


def test_boilerplate_in_all_sets(spark):
    """Three quarters of every set are common to all 20,000, a similarity of 0.6: nothing but true pairs is looked at."""
    df = spark.range(20000).selectExpr("cast(id as int) as item", "concat(sequence(0L, 74L), transform(sequence(0L, 24L), k -> 1000 + (id div 2) * 100 + k + if(k < 3, (id % 2) * 50, 0))) as tokens")
    pairs = prefix_pairs(df, 0.8).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(i, i + 1) for i in range(0, 20000, 2)]
    got = prefix_pairs(df, 0.7).count()
    assert got == 10000
