"""Update operators on single documents."""

import pytest

from brindle.errors import InvalidRequest
from brindle.operators.find import to_document
from brindle.operators.update import apply_update
from brindle.plans.updates import parse_update


@pytest.fixture(scope="module")
def docs(spark):
    kind = "_id int, n int, x double, s string, sub struct<a int, b string>, arr array<int>, subs array<struct<k string, v int>>"
    rows = [
        (1, 10, 1.5, "t", (1, "p"), [3, 1, 2, 3], [("x", 1), ("y", 2)]),
        (2, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, kind)


def run(docs, update, filter=None, array_filters=None):
    out = apply_update(docs, parse_update(update, array_filters), filter or {}).orderBy("_id").collect()
    return [to_document(r) for r in out]


CASES = [
    ({"$set": {"n": 5}}, "n", 5, 5),
    ({"$set": {"new.deep": "z"}}, "new", {"deep": "z"}, {"deep": "z"}),
    ({"$set": {"sub.c": 1}}, "sub", {"a": 1, "b": "p", "c": 1}, {"c": 1}),
    ({"$setOnInsert": {"n": 1}, "$set": {"s": "q"}}, "n", 10, None),
    ({"$unset": {"n": ""}}, "n", None, None),
    ({"$unset": {"sub.a": ""}}, "sub", {"b": "p"}, None),
    ({"$unset": {"arr.1": ""}}, "arr", [3, None, 2, 3], None),
    ({"$inc": {"n": 2}}, "n", 12, 2),
    ({"$inc": {"n": 0.5}}, "n", 10.5, 0.5),
    ({"$inc": {"fresh": 4}}, "fresh", 4, 4),
    ({"$mul": {"x": 2}}, "x", 3.0, 0.0),
    ({"$mul": {"fresh": 4}}, "fresh", 0, 0),
    ({"$min": {"n": 3}}, "n", 3, 3),
    ({"$max": {"n": 3}}, "n", 10, 3),
    ({"$rename": {"n": "m"}}, "m", 10, None),
    ({"$rename": {"sub.a": "m"}}, "sub", {"b": "p"}, None),
    ({"$bit": {"n": {"and": 6, "xor": 1}}}, "n", 3, 1),
    ({"$addToSet": {"arr": 9}}, "arr", [3, 1, 2, 3, 9], [9]),
    ({"$addToSet": {"arr": {"$each": [3, 7, 7]}}}, "arr", [3, 1, 2, 3, 7], [3, 7]),
    ({"$push": {"arr": 4}}, "arr", [3, 1, 2, 3, 4], [4]),
    ({"$push": {"arr": {"$each": [8, 9], "$position": -1}}}, "arr", [3, 1, 2, 8, 9, 3], [8, 9]),
    ({"$push": {"arr": {"$each": [0], "$sort": 1}}}, "arr", [0, 1, 2, 3, 3], [0]),
    ({"$push": {"arr": {"$each": [0], "$sort": -1, "$slice": 2}}}, "arr", [3, 3], [0]),
    ({"$push": {"arr": {"$each": [5], "$slice": 0}}}, "arr", [], []),
    ({"$push": {"arr": {"$each": [5], "$slice": -2}}}, "arr", [3, 5], [5]),
    ({"$push": {"subs": {"$each": [{"k": "w", "v": 0}], "$sort": {"v": 1}}}}, "subs", [{"k": "w", "v": 0}, {"k": "x", "v": 1}, {"k": "y", "v": 2}], [{"k": "w", "v": 0}]),
    ({"$pop": {"arr": 1}}, "arr", [3, 1, 2], None),
    ({"$pop": {"arr": -1}}, "arr", [1, 2, 3], None),
    ({"$pull": {"arr": 3}}, "arr", [1, 2], None),
    ({"$pull": {"arr": {"$gte": 2}}}, "arr", [1], None),
    ({"$pull": {"subs": {"k": "x", "v": {"$lt": 5}}}}, "subs", [{"k": "y", "v": 2}], None),
    ({"$pullAll": {"arr": [3, 2]}}, "arr", [1], None),
    ({"$set": {"arr.5": 7}}, "arr", [3, 1, 2, 3, None, 7], [None, None, None, None, None, 7]),
    ({"$inc": {"arr.$[]": 1}}, "arr", [4, 2, 3, 4], None),
    ({"$set": {"subs.$[].v": 0}}, "subs", [{"k": "x", "v": 0}, {"k": "y", "v": 0}], None),
]


@pytest.mark.parametrize(("update", "name", "first", "second"), CASES)
def test_operator(docs, update, name, first, second):
    a, b = run(docs, update)
    assert (a.get(name), b.get(name)) == (first, second)


def test_only_selected_rows_change(docs):
    a, b = run(docs, {"$set": {"n": 5}, "$inc": {"x": 1}}, {"_id": 1})
    assert (a["n"], a["x"], b) == (5, 2.5, {"_id": 2})


def test_array_filters(docs):
    a, _ = run(docs, {"$set": {"subs.$[e].v": 9}}, None, [{"e.k": "y"}])
    assert a["subs"] == [{"k": "x", "v": 1}, {"k": "y", "v": 9}]
    a, _ = run(docs, {"$mul": {"arr.$[e]": 10}}, None, [{"e": {"$gte": 2}}])
    assert a["arr"] == [30, 1, 20, 30]


@pytest.mark.parametrize(
    "update",
    [
        {}, {"a": 1}, {"$what": {"a": 1}}, {"$set": 1}, {"$set": {"a": 1, "a.b": 2}}, {"$set": {"a.$": 1}}, {"$inc": {"a": "x"}}, {"$pop": {"a": 2}},
        {"$bit": {"a": {"nand": 1}}}, {"$bit": {"a": 1}}, {"$push": {"a": {"$slice": 1}}}, {"$rename": {"a": 1}}, {"$set": {"a.$[e]": 1}}, {"$pullAll": {"a": 1}},
        {"$set": {"_id": 3}}, {"$currentDate": {"a": 1}}, {"$rename": {"a": "a"}}, {"$set": {}},
    ],
)
def test_bad_update(update):
    with pytest.raises(InvalidRequest):
        parse_update(update)


def test_bad_array_filters():
    for filters in ([{"x": 1}], [{"e": 1}, {"e": 2}], [{"E": 1}]):
        with pytest.raises(InvalidRequest):
            parse_update({"$set": {"a.$[e]": 1}}, filters)


@pytest.mark.parametrize("update", [{"$push": {"n": 1}}, {"$inc": {"s": 1}}, {"$set": {"n": "x"}}, {"$set": {"n.a": 1}}, {"$bit": {"x": {"or": 1}}}, {"$set": {"n.$[]": 1}}])
def test_wrong_types(docs, update):
    with pytest.raises(InvalidRequest):
        run(docs, update)


def test_nan_is_the_least_number(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, [2.0, nan, 1.0]), (2, 5.0, [nan]), (3, None, None)], "_id int, x double, arr array<double>")

    def image(update):
        return [repr(r[0]) for r in apply_update(df, parse_update(update), {}).orderBy("_id").select(next(iter(next(iter(update.values()))))).collect()]

    assert image({"$max": {"x": 1.0}}) == ["1.0", "5.0", "1.0"]
    assert image({"$min": {"x": 1.0}}) == ["nan", "1.0", "1.0"]
    assert image({"$max": {"x": nan}}) == ["nan", "5.0", "nan"]
    assert image({"$min": {"x": nan}}) == ["nan", "nan", "nan"]
    assert image({"$push": {"arr": {"$each": [0.5], "$sort": 1}}}) == ["[nan, 0.5, 1.0, 2.0]", "[nan, 0.5]", "[0.5]"]
