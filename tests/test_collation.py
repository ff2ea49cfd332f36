import json
import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import collation as C

ORDERED = ["null", "false", "true", "1", "2", "3.0", "4", '"a"', '"A"', '"aa"', '"b"', '"B"', '"ba"', '"bb"', '["a"]', '["b"]', '["b","c"]', '["b","c","a"]', '["b","d"]', '["b","d","e"]', '{"a":1}', '{"a":2}', '{"b":1}', '{"b":2}', '{"b":2,"a":1}', '{"b":2,"c":2}']
NUMBERS = ["-1.7976931348623157e308", "-1000000", "-3.5", "-1", "-0.0001", "0", "1e-300", "0.5", "1", "2", "10", "1000000000000000000000", "1.7976931348623157e308"]


def sorted_by_key(spark, texts):
    shuffled = list(enumerate(texts))
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "n int, t string")
    return [r["t"] for r in df.withColumn("k", C.json_key(F.col("t"))).orderBy("k").collect()]


@pytest.mark.parametrize("texts", [ORDERED, NUMBERS])
def test_documented_order(spark, texts):
    assert sorted_by_key(spark, texts) == texts


def test_equal_keys(spark):
    df = spark.createDataFrame([("0",), ("-0.0",), ('"\\u00e9"',), ('"e\\u0301"',)], "t string").withColumn("k", C.json_key(F.col("t")))
    assert df.groupBy("k").count().count() == 2


def test_not_json_and_out_of_range(spark):
    df = spark.createDataFrame([("nope",), ("1e999",), (None,)], "t string").withColumn("k", C.json_key(F.col("t")))
    assert df.where("k is null").count() == 3


def some_value(rng, depth):
    pick = rng.randrange(7 if depth else 5)
    if pick < 2:
        return rng.choice([None, True, False])
    if pick == 2:
        return rng.choice([-2, -1, 0, 0.5, 1, 3, 10, 1e15])
    if pick < 5:
        return rng.choice(["", "a", "b", "aa", "ab", "z"])
    if pick == 5:
        return [some_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc"): some_value(rng, depth - 1) for _ in range(rng.randrange(3))}


@pytest.mark.parametrize("members", [False, True])
def test_agrees_with_the_plain_comparator(spark, members):
    rng = random.Random(42)
    values = [some_value(rng, 3) for _ in range(1500)]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string")
    got = [json.loads(r["t"]) for r in df.withColumn("k", C.json_key(F.col("t"), members)).orderBy("k").collect()]
    compare = lambda a, b: C.compare(a, b, lambda x, y: (x > y) - (x < y), members)
    assert all(compare(a, b) == 0 for a, b in zip(got, sorted(values, key=cmp_to_key(compare)), strict=True))


def test_typed_keys_equal_json_keys(spark):
    df = spark.createDataFrame([(1, "x", [1.0, 2.0], None), (None, "y", [], True)], "n int, s string, a array<double>, b boolean")
    both = df.select(
        (C.typed_key(F.col("n"), T.IntegerType()) == C.json_key(F.to_json(F.struct("n"), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct("n"), {"ignoreNullFields": "false"})) - 6))).alias("n"),
        (C.typed_key(F.col("a"), T.ArrayType(T.DoubleType())) == C.json_key(F.to_json("a"))).alias("a"),
    )
    assert all(r["n"] and r["a"] for r in both.collect())


@pytest.mark.parametrize(("value", "level", "wanted"), [(["a", "b", "c"], 1, ["a"]), (["a", "b", "c"], 2, ["a", "b"]), (["a", "b", "c"], 5, ["a", "b", "c"]), (["a"], 0, []), ("scalar", 1, "scalar"), (["a", "b"], -1, ["a", "b"])])
def test_truncation(value, level, wanted):
    assert C.truncate(value, level) == wanted


def test_rendered_numbers(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (1e16,)], "x double")
    assert [r[0] for r in df.select(C.rendered(F.col("x"))).collect()] == ["1", "1.5", "1.0E16"]
