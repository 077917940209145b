"""Filters, projections and sorts on the harbour."""

import pytest
from harbour import BOATS

from brindle import find, open_database
from brindle.errors import InvalidRequest
from brindle.operators.find import Find
from brindle.plans.filters import parse_filter
from brindle.plans.projections import parse_projection, parse_sort


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    c = open_database(spark, f"file://{tmp_path_factory.mktemp('db')}").create_collection("boats")
    c.insert_many(BOATS)
    return c.frame().cache()


EVERY = [11, 12, 13, 14, 15, 16, 17, 18]
FILTERS = [
    # Equality and bounds.
    ({"rig": "brig"}, [14, 16]),
    ({"crew": {"$gte": 12}}, [12, 14, 16]),
    ({"crew": {"$gt": 6.5, "$lt": 18.0}}, [12, 13]),
    ({"rig": "sloop", "crew": {"$lte": 4}}, [11, 15]),
    ({"hull.unit": "ft"}, [12, 13]),
    ({"hull": {"$eq": {"length": 9.5, "unit": "m"}}}, [11]),
    ({"crew": {"$gt": 9, "$lt": 3}}, []),
    ({"crew": {}}, EVERY),
    ({}, EVERY),
    ({"sail": 1}, []),
    # A bound of another type: all numbers stand below all texts.
    ({"crew": {"$lt": "z"}}, [11, 12, 13, 14, 15, 16]),
    ({"crew": {"$gt": "z"}}, []),
    # Missing fields.
    ({"crew": None}, [17, 18]),
    ({"crew": {"$ne": None}}, [11, 12, 13, 14, 15, 16]),
    ({"stays": {"$exists": True}}, [14, 15, 16]),
    ({"hull": {"$exists": False}}, [15, 17, 18]),
    # Lists of values.
    ({"rig": {"$in": ["ketch", "brig", 5, None]}}, [12, 14, 16]),
    ({"rig": {"$nin": ["ketch", "brig"]}}, [11, 13, 15]),
    ({"_id": {"$in": [18, 40, 12, 15], "$lte": 15}}, [12, 15]),
    # Logic; a missing field passes neither a bound nor its opposite.
    ({"$or": [{"crew": {"$lt": 4}}, {"hull.length": {"$gt": 30}}]}, [12, 13, 15]),
    ({"$and": [{"rig": "sloop"}, {"$or": [{"crew": 7}, {"crew": 1}]}]}, [13, 15]),
    ({"$nor": [{"rig": "sloop"}, {"crew": {"$gte": 18}}]}, [12]),
    ({"$not": {"crew": {"$lt": 12}}}, [12, 14, 16]),
    ({"$not": {"crew": {"$gte": 4, "$lte": 12}}}, [14, 15, 16]),
    # Types.
    ({"name": {"$type": "string"}}, EVERY),
    ({"crew": {"$type": "number"}}, [11, 12, 13, 14, 15, 16]),
    ({"crew": {"$type": 2}}, []),
    # Arrays: one element passes all bounds together.
    ({"gear": "lamp"}, [12, 13]),
    ({"gear.0": "oar"}, [11, 15]),
    ({"depths": {"$gt": 4.5, "$lt": 6}}, [16]),
    ({"gear": {"$size": 2}}, [11, 16]),
    ({"gear": {"$all": ["oar", "net"]}}, [11, 12, 16]),
    ({"gear": {"$all": []}}, [11, 12, 13, 14, 15, 16]),
    ({"$not": {"gear": {"$all": ["net"]}}}, [13, 14, 15, 17, 18]),
    ({"gear": {"$elemMatch": {}}}, [11, 12, 13, 15, 16]),
    ({"gear": {"$elemMatch": {"$gte": "m", "$lt": "o"}}}, [11, 12, 16]),
    ({"stays": {"$elemMatch": {"days": {"$gte": 11}}}}, [14, 16]),
    ({"stays": {"$elemMatch": {"port": "P1", "days": {"$gt": 2}}}}, [14]),
    ({"stays": {"$elemMatch": {"$or": [{"days": 20}, {"port": "P2"}]}}}, [14, 15, 16]),
    ({"tours": {"$elemMatch": {"legs": {"$elemMatch": {"days": {"$gt": 5}}}}}}, [17]),
    ({"tours": {"$elemMatch": {"legs": {"$size": 0}}}}, [18]),
]


@pytest.mark.parametrize(("filter", "ids"), FILTERS)
def test_filter(items, filter, ids):
    assert [d["_id"] for d in find(items, filter).execute()] == ids


@pytest.mark.parametrize(
    "filter",
    [
        {"a": {"$regex": "x"}}, {"a": {"b": 1}}, {"a": {"$not": {"$gt": 1}}}, {"$or": {}}, {"$not": 1}, {"a.$": 1}, {"": 1}, {"a..b": 1},
        {"a": {"$exists": 1}}, {"a": {"$size": "1"}}, {"a": {"$all": 1}}, {"a": {"$type": 77}}, {"a": {"$in": 3}}, {"$where": 1}, {"x" * 256: 1}, [],
    ],
)
def test_bad_filter(filter):
    with pytest.raises(InvalidRequest):
        parse_filter(filter)


def test_sort_skip_limit(items):
    q = find(items, {"crew": {"$exists": True}}).sort({"crew": -1}).skip(1).limit(3)
    assert [d["crew"] for d in q.execute()] == [18, 12, 7]
    assert [d["_id"] for d in find(items, {"_id": {"$gte": 16}}).sort({"_id": -1}).execute()] == [18, 17, 16]
    assert [d["_id"] for d in find(items).sort({"crew": 1, "_id": -1}).limit(3).execute()] == [18, 17, 15]
    assert find(items, {"_id": 13}).projection({"rig": 1}).execute_one() == {"_id": 13, "rig": "sloop"}
    assert find(items, {"_id": 33}).execute_one() is None


def test_results_are_lazy(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(rows):
        for r in rows:
            seen.add(1)
            yield r

    df = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(400)], 40).mapPartitions(mark), "_id long")
    found = Find(df, {"_id": {"$gte": 0}})
    found.frame = lambda: df.where("_id >= 0")  # no sort, which would read everything first
    rows = found.execute()
    assert next(rows) == {"_id": 0} and seen.value < 400
    assert len(list(rows)) == 399


def test_nan_sorts_below_numbers(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, float("-inf"))], "_id long, x double")
    assert [d["_id"] for d in find(df).sort({"x": 1}).execute()] == [3, 2, 4, 1]
    assert [d["_id"] for d in find(df).sort({"x": -1}).execute()] == [1, 4, 2, 3]
    assert [d["_id"] for d in find(df, {"x": {"$lt": 0}}).execute()] == [2, 4]
    assert [d["_id"] for d in find(df, {"x": {"$gte": 0}}).execute()] == [1]


PROJECTIONS = [
    ({"name": 1}, {"_id": 21, "name": "Gyda"}),
    ({"crew": 1, "_id": 0}, {"crew": 6}),
    ({"hull.unit": 1}, {"_id": 21, "hull": {"unit": "m"}}),
    ({"crew": 0, "hull.length": 0, "soundings": 0, "stays": 0}, {"_id": 21, "name": "Gyda", "hull": {"unit": "m"}}),
    ({"soundings": {"$slice": 3}}, {"_id": 21, "soundings": [7, 5, 3]}),
    ({"soundings": {"$slice": -1}}, {"_id": 21, "soundings": [2]}),
    ({"soundings": {"$slice": -12}}, {"_id": 21, "soundings": [7, 5, 3, 2]}),
    ({"soundings": {"$slice": [2, 5]}}, {"_id": 21, "soundings": [3, 2]}),
    ({"crew": {"$slice": 2}}, {"_id": 21}),
    ({"stays": {"$elemMatch": {"days": {"$lt": 5}}}}, {"_id": 21, "stays": [{"port": "P1", "days": 4}, {"port": "P7", "days": 1}]}),
    ({"soundings": {"$elemMatch": {"$gt": 70}}}, {"_id": 21, "soundings": []}),
    ({"soundings.0": 1, "soundings.2": 1}, {"_id": 21, "soundings": {"0": 7, "2": 3}}),
]


@pytest.fixture(scope="module")
def one(spark):
    kind = "_id int, name string, crew int, hull struct<length double, unit string>, soundings array<int>, stays array<struct<port string, days int>>"
    return spark.createDataFrame([(21, "Gyda", 6, (12.5, "m"), [7, 5, 3, 2], [("P1", 4), ("P6", 9), ("P7", 1)])], kind)


@pytest.mark.parametrize(("projection", "doc"), PROJECTIONS)
def test_projection(one, projection, doc):
    assert list(find(one).projection(projection).execute()) == [doc]


@pytest.mark.parametrize("doc", [{}, {"a": 1, "b": 0}, {"a": 2}, {"a": {"$slice": 0}}, {"a": {"$x": 1}}, {"a": {"$slice": 1, "$elemMatch": {}}}, {"a": 1, "a.b": 1}, {"a.$": 1}, {"a": {"$slice": [1, -1]}}])
def test_bad_projection(doc):
    with pytest.raises(InvalidRequest):
        parse_projection(doc)


def test_bad_sort():
    with pytest.raises(InvalidRequest):
        parse_sort({"a": 2})


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id AS _id", "id AS a", "id AS b").write.parquet(f"{tmp_path}/t")
    df = find(spark.read.parquet(f"{tmp_path}/t"), {"a": {"$gt": 5}, "b": 3}).projection({"a": 1}).frame(ordered=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,5)" in plan and "EqualTo(b,3)" in plan and "Python" not in plan
