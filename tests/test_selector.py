"""Selectors: random ones in variant mode against a plain evaluator, typed mode on columns."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.errors import SelectorError
from quillgrid.functions.collation import TYPE_NAMES, compare, rank_of
from quillgrid.plans.compile import Row, Variant, compile_selector, project, project_value
from quillgrid.plans.selector import normalize, parse, ranges

GARDEN = {
    "fern": {"light": "shade", "height": 40, "zones": [4, 5, 6], "water": {"days": 3, "rain": True}},
    "cactus": {"light": "sun", "height": 15.5, "zones": [], "water": {"days": 30}, "spines": True},
    "ivy": {"light": ["shade", "half"], "height": 300, "zones": [5], "climbs": {"wall": 1, "tree": 2}},
    "moss": {"light": None, "height": 2, "water": {"days": 1, "rain": {"least": 10}}},
    "rose": {"light": "sun", "height": 120, "zones": ["five", 6, None], "spines": True, "names": [{"tag": "red", "year": 1901}, {"tag": "tea", "year": 1867}]},
    "reed": {"height": "tall", "zones": [[4, 5], [6]], "water": "pond", "spines": False},
    "bulb": {"light": "half", "height": 0, "names": [{"tag": "tea"}], "water": {}},
    "": {},
}
PATHS = ["light", "height", "zones", "water", "water.days", "water.rain", "water.rain.least", "spines", "climbs", "names", "nothing"]
VALUES = [None, True, False, 0, 2, 5, 6, 15.5, 40, 120, "sun", "shade", "half", "tea", "red", "pond", [], [5], [4, 5, 6], [4, 5], {}, {"days": 3, "rain": True}, {"days": 30}, {"wall": 1, "tree": 2}, ["shade", "half"]]


def order(a, b):
    return compare(a, b, lambda x, y: (x > y) - (x < y), True)


def at(doc, path):
    for name in path.split("."):
        if not isinstance(doc, dict) or name not in doc:
            return ...
        doc = doc[name]
    return doc


def value_holds(cond, v):
    """Several operators on a value that is there must all hold; written from the rules, not from the compiler."""
    import re

    same = lambda x, y: order(x, y) == 0
    within = lambda xs: any(same(x, v) for x in xs) or (isinstance(v, list) and any(same(x, e) for x in xs for e in v))
    sign = {"$lt": lambda c: c < 0, "$lte": lambda c: c <= 0, "$gt": lambda c: c > 0, "$gte": lambda c: c >= 0}
    for op, arg in cond.items():
        one = arg if isinstance(arg, dict) and arg and all(k.startswith("$") for k in arg) else {"$eq": arg}
        ok = {
            "$eq": lambda: same(v, arg),
            "$ne": lambda: not same(v, arg),
            "$in": lambda: within(arg),
            "$nin": lambda: not within(arg),
            "$exists": lambda: arg,
            "$type": lambda: arg in TYPE_NAMES and rank_of(v) in TYPE_NAMES[arg],
            "$size": lambda: isinstance(v, list) and len(v) == arg,
            "$mod": lambda: isinstance(v, int) and not isinstance(v, bool) and v % arg[0] == arg[1],
            "$regex": lambda: isinstance(v, str) and re.search(arg, v) is not None,
            "$all": lambda: isinstance(v, list) and all(any(same(x, e) for e in v) for x in arg),
            "$not": lambda: not value_holds(one, v),
            "$and": lambda: all(value_holds(c, v) for c in arg),
            "$or": lambda: any(value_holds(c, v) for c in arg),
            "$nor": lambda: not any(value_holds(c, v) for c in arg),
            "$keyMapMatch": lambda: isinstance(v, dict) and any(value_holds(one, k) for k in v),
            "$elemMatch": lambda: isinstance(v, list) and any(element_holds(arg, e) for e in v),
            "$allMatch": lambda: isinstance(v, list) and all(element_holds(arg, e) for e in v),
        }.get(op, lambda: sign[op](order(v, arg)))()
        if not ok:
            return False
    return True


def element_holds(arg, e):
    return value_holds(arg, e) if arg and all(k.startswith("$") for k in arg) else holds(arg, e)


def holds(selector, doc):
    for name, arg in selector.items():
        if name == "$not":
            ok = not holds(arg, doc)
        elif name in ("$and", "$or", "$nor"):
            each = [holds(x, doc) for x in arg]
            ok = all(each) if name == "$and" else any(each) if name == "$or" else not any(each)
        elif arg == {"$exists": False}:
            ok = at(doc, name) is ...
        elif isinstance(arg, dict) and arg and not any(k.startswith("$") for k in arg):
            ok = holds({f"{name}.{k}": x for k, x in arg.items()}, doc)
        else:
            v = at(doc, name)
            ok = v is not ... and value_holds(arg if isinstance(arg, dict) and arg else {"$eq": arg}, v)
        if not ok:
            return False
    return True


def random_condition(rng, deep=2):
    plain = [
        lambda: {rng.choice(["$eq", "$ne", "$lt", "$lte", "$gt", "$gte"]): rng.choice(VALUES)},
        lambda: {rng.choice(["$in", "$nin", "$all"]): rng.sample(VALUES, rng.randrange(3))},
        lambda: {"$type": rng.choice([*TYPE_NAMES, "plant"])},
        lambda: {"$size": rng.randrange(4)},
        lambda: {"$mod": [rng.choice([2, 3, 5]), rng.randrange(3)]},
        lambda: {"$regex": rng.choice(["^s", "a", "l+$", "[0-9]"])},
        lambda: {"$gte": rng.choice(VALUES), "$lt": rng.choice(VALUES)},
        lambda: {"$exists": True},
    ]
    nested = [
        lambda: {"$not": random_condition(rng, deep - 1)},
        lambda: {rng.choice(["$and", "$or", "$nor"]): [random_condition(rng, deep - 1) for _ in range(rng.randrange(3))]},
        lambda: {rng.choice(["$elemMatch", "$allMatch"]): rng.choice([{"$gt": 4}, {"$in": ["five", 6]}, {"tag": "tea"}, {"tag": {"$gt": "red"}, "year": {"$lt": 1900}}])},
        lambda: {"$keyMapMatch": rng.choice([{"$eq": "wall"}, {"$regex": "^d"}])},
    ]
    return rng.choice(plain + nested if deep else plain)()


def random_selector(rng, deep=2):
    kind = rng.random()
    if deep and kind < 0.25:
        return {rng.choice(["$and", "$or", "$nor"]): [random_selector(rng, deep - 1) for _ in range(rng.randrange(1, 3))]}
    if deep and kind < 0.35:
        return {"$not": random_selector(rng, deep - 1)}
    if kind < 0.45:
        return {rng.choice(PATHS): rng.choice([v for v in VALUES if not isinstance(v, dict) or not v])}
    if kind < 0.55:
        return {rng.choice(PATHS): {"$exists": False}}
    return {rng.choice(PATHS): random_condition(rng) for _ in range(rng.randrange(1, 3))}


@pytest.fixture(scope="module")
def garden(spark):
    rows = [(k, json.dumps(v)) for k, v in GARDEN.items()]
    return spark.createDataFrame(rows, "id string, body string").withColumn("v", F.parse_json("body")).cache()


@pytest.mark.parametrize("seed", range(4))
def test_random_selectors(garden, seed):
    rng = random.Random(seed)
    cases = [random_selector(rng) for _ in range(60)]
    doc = Variant(F.col("v"))
    rows = garden.select("id", *[compile_selector(s, doc).alias(f"c{i}") for i, s in enumerate(cases)]).collect()
    for i, selector in enumerate(cases):
        got = {r["id"]: r[f"c{i}"] for r in rows}
        assert got == {name: holds(selector, body) for name, body in GARDEN.items()}, selector


def test_empty_combinations(garden):
    for selector, wanted in (({}, len(GARDEN)), ({"$and": []}, len(GARDEN)), ({"$or": []}, 0), ({"$nor": []}, len(GARDEN))):
        assert garden.where(compile_selector(selector, Variant(F.col("v")))).count() == wanted


@pytest.mark.parametrize(
    ("selector", "error"),
    [
        ({"height": {"$near": 3}}, "invalid_operator"),
        ({"$xor": [{"height": 1}]}, "invalid_operator"),
        ({"height": {"$mod": [0, 1]}}, "bad_arg"),
        ({"height": {"$mod": "2"}}, "bad_arg"),
        ({"zones": {"$size": 1.5}}, "bad_arg"),
        ({"zones": {"$all": 4}}, "bad_arg"),
        ({"light": {"$type": 3}}, "bad_arg"),
        ({"$or": {"light": "sun"}}, "bad_arg"),
        ({"$not": []}, "bad_arg"),
        ("light", "invalid_selector_json"),
        ({"water": {"$exists": True, "days": 3}}, "invalid_operator"),
        ({"light": {"$regex": "(s)\\1"}}, "bad_arg"),
        ({"light": {"$regex": "["}}, "bad_arg"),
    ],
)
def test_errors(selector, error):
    with pytest.raises(SelectorError) as bad:
        parse(selector)
    assert bad.value.error == error


def test_ranges():
    got = ranges(parse({"a": 1, "b": {"$gt": 2, "$lte": 10}, "$or": [{"c": 3}], "d.e": {"$exists": True}}))
    assert got["a"].has_eq and got["a"].eq == 1
    assert got["b"].low == (2, False) and got["b"].high == (10, True)
    assert "c" not in got and "d.e" in got
    tight = ranges(parse({"$and": [{"x": {"$gt": 1}}, {"x": {"$gte": 3}}, {"x": {"$lt": 9}}, {"x": {"$lte": 9}}]}))["x"]
    assert tight.low == (3, True) and tight.high == (9, False)


def test_normal_form():
    assert normalize({"a": 1}) == {"a": {"$eq": 1}}
    assert normalize({"a": {"b": {"$gt": 1, "$lt": 3}}}) == {"$and": [{"a.b": {"$gt": 1}}, {"a.b": {"$lt": 3}}]}


def test_projection():
    doc = {"_id": "x", "a": {"b": {"c": 7}, "z": 1}, "top": 2}
    assert project_value(doc, [["a", "b", "c"], ["_id"], ["missing"]]) == {"_id": "x", "a": {"b": {"c": 7}}}


def test_typed_mode(spark):
    df = spark.createDataFrame([("p", 1, ["x", "y"], True, (7, "k")), ("q", None, ["y"], False, (8, None)), ("r", 3, [], None, None)], "id string, n int, tags array<string>, flag boolean, s struct<c:int,d:string>")
    cases = [
        ({"n": {"$gt": 0}}, {"p", "r"}),
        ({"n": {"$ne": 1}}, {"r"}),
        ({"$not": {"n": 1}}, {"q", "r"}),
        ({"n": {"$gt": "text"}}, set()),
        ({"n": {"$lt": "text"}}, {"p", "r"}),
        ({"tags": {"$size": 0}}, {"r"}),
        ({"tags": {"$allMatch": {"$eq": "zzz"}}}, {"r"}),
        ({"tags": {"$in": ["x"]}}, {"p"}),
        ({"flag": True}, {"p"}),
        ({"flag": {"$lt": True}}, {"q"}),
        ({"s.c": 7}, {"p"}),
        ({"s": {"d": {"$exists": False}}}, {"q", "r"}),
        ({"missing": {"$exists": False}}, {"p", "q", "r"}),
        ({"s": {"$keyMapMatch": {"$eq": "d"}}}, {"p"}),
        ({"n": {"$mod": [3, 0]}}, {"r"}),
    ]
    for selector, wanted in cases:
        assert {r["id"] for r in df.where(compile_selector(selector, Row(df))).collect()} == wanted, selector
    assert project(df, ["id", "s.d", "nope"]).schema.simpleString() == "struct<id:string,s:struct<d:string>>"


def test_typed_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as double) as score").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = df.where(compile_selector({"id": {"$gt": 90}, "score": {"$lte": 95}}, Row(df))).select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(id,90)" in plan and "LessThanOrEqual(score,95.0)" in plan
