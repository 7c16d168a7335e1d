"""Rows without an id in the pipeline's near-copy stage."""

from tests.llm.test_llm import docs_of


def test_one_row_of_near_copies_without_ids(spark):
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(80)]
    near = [" ".join([*words[:-1], f"end{k}"]) for k in range(4)]
    df = docs_of(spark, [*near, "one other text", "", None, ""], [None] * 8)
    kept = P.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(repr(r["text"]) for r in kept.collect()) == sorted(map(repr, [near[0], "one other text", "", None]))
