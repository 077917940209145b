"""Collections: writes, catalog, versions and conflicts."""

import pytest
from harbour import BOATS

from brindle import IdStrategy, Options, ReturnDocument, open_database
from brindle.errors import (
    CollectionAlreadyExists,
    CollectionNotFound,
    DuplicateKey,
    IndexNotFound,
    IndexOptionsConflict,
    InvalidRequest,
    VersionConflict,
)


@pytest.fixture
def db(spark, tmp_path):
    return open_database(spark, f"file://{tmp_path}/db")


def ids(c, filter=None):
    return [d["_id"] for d in c.find(filter).execute()]


def test_catalog(db):
    with pytest.raises(CollectionNotFound):
        db.collection("a").find().execute()
    assert list(db.collection("a").create_if_missing().find().execute()) == []
    assert db.collection("a").create_if_missing().estimated_document_count() == 0
    a = db.create_collection("a")
    with pytest.raises(CollectionAlreadyExists):
        db.create_collection("a")
    a.insert_one({"x": 1})
    b = a.rename("b")
    assert [c.name for c in db.list_collections()] == ["b"] and b.estimated_document_count() == 1
    db.create_collection("c")
    with pytest.raises(CollectionAlreadyExists):
        b.rename("c")
    with pytest.raises(CollectionNotFound):
        db.rename_collection("z", "y")
    b.drop()
    db.drop_collection("b")
    assert db.create_collection("b").estimated_document_count() == 0


def test_indexes(db):
    c = db.create_collection("a")
    assert c.create_index({"x": 1, "y.z": -1}) == "x_1_y.z_-1"
    assert c.create_index({"x": 1, "y.z": -1}) == "x_1_y.z_-1"
    with pytest.raises(IndexOptionsConflict):
        c.create_index({"x": 1, "y.z": -1}, "other")
    for keys in ({}, {"a.0": 1}, {"a": 1, "a.b": 1}, {"a": 3}):
        with pytest.raises(InvalidRequest):
            c.create_index(keys)
    assert [i.fields for i in c.list_indexes()] == [[("x", 1), ("y.z", -1)]]
    c.drop_index("x_1_y.z_-1")
    with pytest.raises(IndexNotFound):
        c.drop_index("x_1_y.z_-1")


def test_inserts(db):
    c = db.create_collection("a")
    assert c.insert_many([]).inserted_ids == []
    one = c.insert_one({"x": 1}).inserted_id
    assert isinstance(one, int)
    with pytest.raises(DuplicateKey):
        c.insert_many([{"_id": 5}, {"_id": one}])
    with pytest.raises(DuplicateKey):
        c.insert_many([{"_id": 5}, {"_id": 5}])
    c.insert_many([{"_id": 6, "x": 2.5, "tags": ["a"]}, {"_id": 7, "sub": {"k": 1}}])
    assert c.estimated_document_count() == 3
    assert c.find_one({"_id": 6}) == {"_id": 6, "x": 2.5, "tags": ["a"]}
    with pytest.raises(InvalidRequest):
        db.create_collection("g", IdStrategy.GENERATED).insert_one({"_id": 1})
    with pytest.raises(InvalidRequest):
        db.create_collection("m", IdStrategy.MANUAL).insert_one({"x": 1})


def test_updates(db):
    c = db.create_collection("boats")
    c.insert_many(BOATS)
    r = c.update_many({"rig": "sloop"}, {"$inc": {"crew": 2}})
    assert (r.matched_count, r.modified_count) == (3, 3)
    assert [d["crew"] for d in c.find({"rig": "sloop"}).execute()] == [6, 9, 3]
    assert c.update_one({"rig": "brig"}, {"$set": {"name": "Old"}}, sort={"crew": 1}).matched_count == 1
    assert c.find_one({"_id": 16})["name"] == "Old"
    assert c.update_one({"_id": 99}, {"$set": {"a": 1}}).matched_count == 0
    up = c.update_one({"_id": 99, "hull.unit": "yd"}, {"$set": {"crew": 4}, "$setOnInsert": {"rig": "cat"}}, upsert=True)
    assert up.upserted_id == 99
    assert c.find_one({"_id": 99}) == {"_id": 99, "crew": 4, "hull": {"unit": "yd"}, "rig": "cat"}
    assert c.estimated_document_count() == 9


def test_find_and_modify(db):
    c = db.create_collection("boats")
    c.insert_many(BOATS)
    before = c.find_one_and_update({"_id": 12}, {"$set": {"crew": 0}}, projection={"crew": 1})
    assert before == {"_id": 12, "crew": 12}
    after = c.find_one_and_update({"_id": 12}, {"$inc": {"crew": 3}}, return_document=ReturnDocument.AFTER)
    assert after["crew"] == 3
    assert c.find_one_and_update({"_id": 77}, {"$set": {"crew": 0}}, upsert=True) is None
    assert c.find_one_and_delete({"rig": "brig"}, sort={"crew": 1})["_id"] == 16
    assert c.find_one_and_delete({"rig": "none"}) is None
    new = c.find_one_and_replace({"_id": 13}, {"name": "r"}, return_document=ReturnDocument.AFTER)
    assert new == {"_id": 13, "name": "r"}
    assert c.replace_one({"_id": 500}, {"name": "u"}, upsert=True).upserted_id == 500
    for bad in ({"_id": 3, "a": 1}, {"$set": 1}, {"a.b": 1}):
        with pytest.raises(InvalidRequest):
            c.replace_one({"_id": 13}, bad)


def test_deletes_keep_untouched_files(db):
    c = db.create_collection("boats")
    c.insert_many(BOATS[:4])
    c.insert_many(BOATS[4:])
    files = set(c._table().version().files)
    assert c.delete_many({"rig": "ketch"}).deleted_count == 1
    assert set(c._table().version().files) & files
    assert c.delete_one({"rig": "sloop"}).deleted_count == 1
    assert ids(c) == [13, 14, 15, 16, 17, 18] and c.estimated_document_count() == 6
    assert c.delete_many({}).deleted_count == 6 and ids(c) == []


def test_insert_evaluates_once_and_checks_what_it_wrote(spark, db):
    from pyspark.sql import functions as F

    c = db.create_collection("a")
    calls = spark.sparkContext.accumulator(0)

    def pick(batches):
        import pandas as pd

        for b in batches:
            calls.add(len(b))
            yield pd.DataFrame({"_id": range(int(b["id"].min()), int(b["id"].max()) + 1)})

    assert c.insert_frame(spark.range(50).coalesce(1).mapInPandas(pick, "_id long")) == 50 and calls.value == 50
    before = set(c._table().store.names("data"))
    with pytest.raises(InvalidRequest):
        c.insert_frame(spark.range(100, 103).select(F.when(F.col("id") > 100, F.col("id")).alias("_id")))
    with pytest.raises(DuplicateKey):
        c.insert_frame(spark.range(49, 60).withColumnRenamed("id", "_id"))
    assert set(c._table().store.names("data")) == before and c.estimated_document_count() == 50


def test_zones_leave_files_out(spark, db):
    c = db.create_collection("a")
    for lo in (0, 100, 200):
        c.insert_frame(spark.range(lo, lo + 100).selectExpr("id AS _id", "id % 100 AS x", "struct(cast(id AS string) AS s, float('nan') AS f) AS sub").coalesce(1))
    count = lambda f: len(c.frame(filter=f).inputFiles())
    assert count({"_id": 150}) == 1 and count({"_id": {"$gt": 150}}) == 2 and count({"_id": {"$in": [5, 250]}}) == 2 and count({"_id": 999}) == 0
    assert count({"x": 150}) == 3 and count({"$or": [{"_id": 5}, {"x": 5}]}) == 3
    c.create_index({"x": 1})
    c.create_index({"sub.s": 1, "sub.f": -1})
    assert count({"x": 150}) == 0 and count({"x": {"$ne": 150}}) == 3 and count({"x": {"$lt": "a"}}) == 3 and count({"x": None}) == 3
    assert count({"sub.s": {"$gte": "3", "$lt": "9"}}) == 1 and count({"sub.f": {"$lt": 1.0}}) == 3
    assert count({"$or": [{"_id": 5}, {"x": 150}]}) == 1 and count({"$not": {"_id": {"$lt": 200}}}) == 1
    c.compact("x_1")
    assert 0 < count({"x": {"$lt": 5}}) < len(c._table().version().files)
    assert len(list(c.find({"x": {"$lt": 5}}).execute())) == 15
    with pytest.raises(IndexNotFound):
        c.compact("y_1")
    m = db.metrics
    assert m["index_scans"] > 0 and m["point_scans"] > 0 and m["files_skipped"] > 0 and m["rows_returned"] == 15
    assert m.seconds["find"].n == 1 and m.seconds["find"].quantile(0.5) > 0
    c.update_many({"x": {"$lt": 3}}, {"$inc": {"x": 500}})
    assert sorted(d["x"] for d in c.find({"x": {"$gt": 400}}).execute()) == [500] * 3 + [501] * 3 + [502] * 3


def test_manifests_are_whole_or_absent(db):
    store = db.store
    assert store.create("m.json", {"a": 1}) and not store.create("m.json", {"a": 2}) and store.read("m.json") == {"a": 1}
    assert not any(n.endswith(".tmp") for n in store.names())


def test_vacuum_spares_what_is_recent(spark, db):
    c = db.create_collection("a")
    c.insert_frame(spark.range(5).withColumnRenamed("id", "_id"))
    pending = c._table().write(spark.range(5, 9).withColumnRenamed("id", "_id"))
    assert c.vacuum() == 0 and c._table().store.names(pending[0].rsplit("/", 1)[0])
    assert c.vacuum(0) == 1


def test_ids_of_many_processes_differ():
    import subprocess
    import sys

    code = "from brindle.sources.database import new_id; print(*[new_id() for _ in range(2000)])"
    runs = [subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, text=True) for _ in range(4)]
    got = [int(x) for r in runs for x in r.communicate()[0].split()]
    assert len(set(got)) == 8000


def test_versions_and_conflicts(db):
    c = db.create_collection("a")
    c.insert_many([{"_id": i, "x": i} for i in range(5)])
    old = c.version()
    table, seen = c._table(), c._table().version()
    c.delete_one({"_id": 0})
    assert c.frame(old).count() == 5 and c.frame().count() == 4
    with pytest.raises(VersionConflict):
        table.commit(seen, seen.schema, 0, [])
    c.compact()
    assert ids(c) == [1, 2, 3, 4] and c.vacuum(0) >= 1 and ids(c) == [1, 2, 3, 4]


def test_reopen(spark, db):
    db.create_collection("people").insert_many([{"_id": 1, "name": "a", "age": 3}])
    again = open_database(spark, db.root, Options.high_query_load())
    assert again.collection("people").find_one({"age": {"$gt": 2}}) == {"_id": 1, "name": "a", "age": 3}


def test_stream(spark, tmp_path):
    from brindle.streaming import transform_stream

    spark.range(10).selectExpr("id AS _id", "id % 3 AS x").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("_id long, x long").parquet(f"{tmp_path}/in")
    out = transform_stream(stream, {"x": {"$gte": 1}}, {"x": 1}, {"$inc": {"x": 10}})
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["x"] for r in spark.table("streamed").collect()) == [11, 11, 11, 12, 12, 12]
