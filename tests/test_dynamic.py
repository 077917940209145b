"""Dynamic mode: documents without a schema in a VARIANT column."""

import json

import pytest

from brindle import find
from pyspark.sql import functions as F

DOCS = [
    {"_id": 1, "who": "Una", "mark": 3.5, "keys": ["k1", "k4"]},
    {"_id": 2, "who": "Ole", "mark": 8, "keys": ["k2"], "home": {"floor": 2}, "bills": [{"no": "b1", "sum": 40}, {"no": "b2", "sum": 15}]},
    {"_id": 3, "who": "Una", "mark": 8.0},
    {"_id": 4, "who": "Siv", "mark": None, "keys": [], "home": {}},
    {"_id": 5, "who": "Kai", "mark": 12, "keys": ["k4", "k2"]},
    {"_id": 6, "who": False, "mark": "late", "keys": [7, None, "k1", [5]], "wide": 9007199254740995},
]
FILTERS = [
    # Null stands below numbers, numbers below texts.
    ({"d.mark": {"$lt": 8}}, [1, 4]),
    ({"d.mark": {"$lte": 8.0}}, [1, 2, 3, 4]),
    ({"d.mark": {"$gt": 8}}, [5, 6]),
    ({"d.mark": {"$gte": 3.5, "$lt": 12}}, [1, 2, 3]),
    ({"d.mark": {"$gte": None}}, [1, 2, 3, 4, 5, 6]),
    ({"d.mark": 8}, [2, 3]),
    ({"d.mark": {"$ne": 8}}, [1, 4, 5, 6]),
    ({"d.wide": 9007199254740995}, [6]),
    ({"d.wide": 9007199254740996}, []),
    # Null and missing.
    ({"d.mark": None}, [4]),
    ({"d.home": None}, [1, 3, 5, 6]),
    ({"d.home.floor": {"$ne": None}}, [2]),
    ({"d.mark": {"$exists": True}}, [1, 2, 3, 4, 5, 6]),
    ({"d.keys": {"$exists": False}}, [3]),
    # Lists of values.
    ({"d.mark": {"$in": [12, "late", None]}}, [4, 5, 6]),
    ({"d.mark": {"$nin": [12, "late"]}}, [1, 2, 3, 4]),
    ({"d.home": {"$nin": [2]}}, [2, 4]),
    # Documents.
    ({"d.home": {"$eq": {"floor": 2}}}, [2]),
    ({"d.home": {"$eq": {}}}, [4]),
    # Types.
    ({"d.mark": {"$type": "null"}}, [4]),
    ({"d.mark": {"$type": "string"}}, [6]),
    ({"d.who": {"$type": "bool"}}, [6]),
    ({"d.wide": {"$type": "long"}}, [6]),
    ({"d.home.floor": {"$type": "int"}}, [2]),
    ({"$not": {"d.keys": {"$type": "array"}}}, [3]),
    # Arrays.
    ({"d.keys": {"$size": 2}}, [1, 5]),
    ({"d.keys": "k1"}, [1, 6]),
    ({"d.keys": None}, [3, 6]),
    ({"d.keys": {"$eq": [5]}}, [6]),
    ({"d.keys": {"$all": ["k1", 7]}}, [6]),
    ({"d.keys": {"$all": []}}, [1, 2, 4, 5, 6]),
    ({"d.keys.1": "k2"}, [5]),
    ({"d.keys": {"$elemMatch": {"$gt": "k1", "$lte": "k3"}}}, [2, 5]),
    ({"d.keys": {"$elemMatch": {}}}, [1, 2, 5, 6]),
    ({"d.bills.sum": 40}, []),
    ({"d.bills": {"$elemMatch": {"no": "b2", "sum": {"$lt": 20}}}}, [2]),
    ({"d.bills": {"$elemMatch": {"no": "b1", "sum": 15}}}, []),
    # Logic.
    ({"$nor": [{"d.mark": {"$gte": 8}}, {"d.who": "Siv"}]}, [1]),
    ({"$or": [{"d.mark": "late"}, {"d.home.floor": 2}]}, [2, 6]),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d["_id"], json.dumps(d)) for d in DOCS], "_id long, text string")
    return df.select("_id", F.parse_json("text").alias("d")).cache()


@pytest.mark.parametrize("filter,ids", FILTERS, ids=[str(f) for f, _ in FILTERS])
def test_filters(docs, filter, ids):
    assert [r["_id"] for r in find(docs, filter).projection({"_id": 1}).execute()] == ids


def test_sort_orders_all_types(docs):
    assert [r["_id"] for r in find(docs).sort({"d.mark": 1, "_id": 1}).execute()] == [4, 1, 2, 3, 5, 6]
    assert [r["_id"] for r in find(docs).sort({"d.who": -1, "_id": 1}).execute()] == [6, 1, 3, 4, 2, 5]
    assert [r["_id"] for r in find(docs).sort({"d.home.floor": 1, "_id": 1}).skip(4).execute()] == [6, 2]


def test_documents_come_back_whole(docs):
    assert [r["d"] for r in find(docs).execute()][1:] == [json.loads(json.dumps(d)) for d in DOCS[1:]]
    assert list(find(docs.limit(0), {"d.mark": 1}).execute()) == []


PROJECTIONS = [
    ({"d.who": 1, "d.home.floor": 1}, 2, {"who": "Ole", "home": {"floor": 2}}),
    ({"d.mark": 1}, 4, {"mark": None}),
    ({"d.absent": 1}, 1, {}),
    ({"d.who.x": 1}, 1, {}),
    ({"d.keys.0": 1, "d.keys.3": 1}, 6, {"keys": {"0": 7, "3": [5]}}),
    ({"d.keys": {"$slice": -2}}, 6, {"keys": ["k1", [5]]}),
    ({"d.keys": {"$slice": [1, 2]}}, 6, {"keys": [None, "k1"]}),
    ({"d.mark": {"$slice": 1}}, 1, {}),
    ({"d.bills": {"$elemMatch": {"sum": {"$gt": 20}}}}, 2, {"bills": [{"no": "b1", "sum": 40}]}),
    ({"d.keys": 0, "d.mark": 0}, 1, {"_id": 1, "who": "Una"}),
    ({"d.home.floor": 0, "d.keys": 0, "d.bills": 0}, 2, {"_id": 2, "who": "Ole", "mark": 8, "home": {}}),
    ({"d.who.x": 0, "d.keys": 0}, 4, {"_id": 4, "who": "Siv", "mark": None, "home": {}}),
]


@pytest.mark.parametrize("projection,key,expected", PROJECTIONS, ids=[str(p) for p, _, _ in PROJECTIONS])
def test_projections(docs, projection, key, expected):
    assert [r["d"] for r in find(docs, {"_id": key}).projection(projection).execute()] == [expected]
