import pytest

from quillgrid.llm import topk


def test_large_finite_vectors_take_part(spark):
    kind = "vec_id bigint, embedding array<double>"
    big = float(1 << 33)
    df = spark.createDataFrame([(0, [1.0] * 40), (1, [big] + [0.0] * 39), (2, [2.0] * 40), (50, [big] + [1.0] * 39)], kind)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id = 0")).collect()}
    assert got == {(0, 1): (50, (1 << 49) + 39 * 65536), (0, 2): (1, 1 << 49), (0, 3): (2, 40 * 2 * 65536)}
    with pytest.raises(Exception, match="64 bits"):
        huge = spark.createDataFrame([(0, [1e30]), (1, [1.0])], kind)
        topk.top_k(huge, huge).collect()
