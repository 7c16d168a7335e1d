"""Nearest neighbours of repeated query rows."""

import numpy as np

from canopy.llm import ann


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 8)).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    one = df.filter("vec_id % 20 = 0")
    want = sorted(map(tuple, ann.search(df, one).collect()))
    assert want == sorted(map(tuple, ann.search(df, one.union(one).union(one.filter("vec_id = 40"))).collect()))
    assert len(want) == 15 * 20 and len({(q, v) for q, _, v, _ in want}) == len(want)


def test_id_with_two_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 8)).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    ask = lambda *v: sorted(tuple(r)[1:] for r in ann.search(df, spark.createDataFrame([(1000, q) for q in v], "vec_id long, embedding array<float>")).collect())
    assert ask(x[5], x[6]) == sorted(ask(x[5]) + ask(x[6])) and len(ask(x[5], x[6])) == 40
