"""The reference operators as registered queries, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.find import find
from brindle.operators.update import apply_update
from brindle.plans.updates import parse_update
from brindle.sources.database import Collection, Database, IdStrategy, ReturnDocument, open_database
from brindle.sources.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _find(name: str, table: str, key: str, filter: dict, columns: list[str], sql: str, sort=None, skip=None, limit=None, derive=None) -> None:
    """Register one find over a table: filter, sort, skip, limit and an including projection."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = derive(spark, sf_dir) if derive else _table(spark, sf_dir, table)
        q = find(df, filter, key).projection({c: 1 for c in columns} | ({} if key in columns else {"_id": 0}))
        if sort:
            q.sort(sort)
        if skip is not None:
            q.skip(skip)
        if limit is not None:
            q.limit(limit)
        return q.frame(ordered=False)

    QUERIES[name], SQL[name] = query, sql


def _update(name: str, table: str, key: str, filter: dict, update: dict, columns: list[str], sql: str, derive=None, array_filters=None) -> None:
    """Register the image of a table after an update."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = derive(spark, sf_dir) if derive else _table(spark, sf_dir, table)
        return apply_update(df, parse_update(update, array_filters), filter, key).selectExpr(*columns)

    QUERIES[name], SQL[name] = query, sql


# Derived inputs: missing fields, nested documents, arrays.


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with c_mktsegment missing where it is BUILDING."""
    return _table(spark, sf_dir, "customer").withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with props as a document."""
    return _table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k int"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a conversation: turns as an array of documents, roles and turn numbers as arrays."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("int").alias("size"))))
    df = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return df.withColumn("roles", F.transform("turns", lambda t: t["role"])).withColumn("nums", F.transform("turns", lambda t: t["turn"]))


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with props as a variant: by type of event it lacks k, or k is null, text or an array."""
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_type") == "view", F.lit("{}"))
        .when(F.col("event_type") == "click", F.lit('{"k": null}'))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"k": "'), k, F.lit('"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"k": [1, '), k, F.lit("]}")))
        .otherwise(F.col("props"))
    )
    return _table(spark, sf_dir, "events").withColumn("d", F.parse_json(text))


#: The same in SQL: t is the type of k (null: missing), n its number, s its text, a the array's second element.
LOOSE = """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 l AS (SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'null' WHEN 'purchase' THEN 'text' WHEN 'signup' THEN 'array' ELSE 'number' END AS t,
 k AS n, CAST(k AS VARCHAR) AS s, k AS a FROM e) """
CHATS = """WITH chats AS (SELECT conv_id, list({'turn': turn, 'role': role, 'size': length(text)::INTEGER} ORDER BY turn, role, length(text)) AS turns,
 list(role ORDER BY turn, role, length(text)) AS roles, list(turn ORDER BY turn, role, length(text)) AS nums FROM conversations GROUP BY conv_id) """
SEGS = "WITH c AS (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) "
ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE "


def _orders(name: str, filter: dict, condition: str) -> None:
    _find(name, "orders", "o_orderkey", filter, ORDER_COLUMNS, ORDERS + condition)


_orders("f_eq", {"o_orderstatus": {"$eq": "F"}}, "o_orderstatus = 'F'")
_orders("f_implicit_eq", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_orders("f_implicit_and", {"o_orderstatus": "F", "o_totalprice": {"$gte": 100000, "$lt": 200000.5}}, "o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice < 200000.5")
_orders("f_ne", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'")
_orders("f_gt", {"o_totalprice": {"$gt": 250000}}, "o_totalprice > 250000")
_orders("f_gte", {"o_totalprice": {"$gte": 250000}}, "o_totalprice >= 250000")
_orders("f_lt", {"o_totalprice": {"$lt": 50000}}, "o_totalprice < 50000")
_orders("f_lte", {"o_totalprice": {"$lte": 50000}}, "o_totalprice <= 50000")
_orders("f_range", {"o_totalprice": {"$gt": 100000, "$lte": 120000}}, "o_totalprice > 100000 AND o_totalprice <= 120000")
_orders("f_in", {"o_orderstatus": {"$in": ["F", "P", "X"]}}, "o_orderstatus IN ('F', 'P', 'X')")
_orders("f_nin", {"o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderstatus NOT IN ('F', 'P')")
_orders("f_and", {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 200000}}]}, "o_orderstatus = 'O' AND o_totalprice > 200000")
_orders("f_or", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 20000}}]}, "o_orderstatus = 'P' OR o_totalprice < 20000")
_orders("f_nor", {"$nor": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gte": 200000}}]}, "o_orderstatus <> 'O' AND o_totalprice < 200000")
_orders("f_not", {"$not": {"o_totalprice": {"$gte": 100000}}}, "o_totalprice < 100000")
_orders("f_not_range", {"$not": {"o_totalprice": {"$gt": 50000, "$lt": 400000}}}, "o_totalprice <= 50000 OR o_totalprice >= 400000")
_orders("f_empty", {}, "true")
_orders("f_contradiction", {"o_totalprice": {"$gt": 5, "$lt": 3}}, "o_totalprice > 5 AND o_totalprice < 3")
_orders("f_in_empty", {"o_orderstatus": {"$in": []}}, "false")
_orders("f_cross_type", {"o_totalprice": {"$lt": "text"}}, "true")
_orders("s_point", {"_id": 77}, "o_orderkey = 77")
_orders("s_multipoint", {"_id": {"$in": [1, 5, 99, 100000000]}}, "o_orderkey IN (1, 5, 99, 100000000)")
_orders("s_pk_range", {"_id": {"$gt": 100, "$lte": 300}}, "o_orderkey > 100 AND o_orderkey <= 300")

_C = ["c_custkey", "seg"]
for _n, _f, _s in (
    ("f_ne_missing", {"seg": {"$ne": "MACHINERY"}}, "seg IS NULL OR seg <> 'MACHINERY'"),
    ("f_nin_missing", {"seg": {"$nin": ["MACHINERY"]}}, "seg IS NOT NULL AND seg <> 'MACHINERY'"),
    ("f_exists_true", {"seg": {"$exists": True}}, "seg IS NOT NULL"),
    ("f_exists_false", {"seg": {"$exists": False}}, "seg IS NULL"),
    ("f_eq_null", {"seg": None}, "seg IS NULL"),
    ("f_ne_null", {"seg": {"$ne": None}}, "seg IS NOT NULL"),
    ("f_type", {"seg": {"$type": "string"}}, "seg IS NOT NULL"),
    ("f_not_missing", {"$not": {"seg": {"$gte": "F"}}}, "seg < 'F'"),
    ("f_nor_missing", {"$nor": [{"seg": "FURNITURE"}, {"c_acctbal": {"$lt": 0}}]}, "(seg IS NULL OR seg <> 'FURNITURE') AND c_acctbal >= 0"),
    ("f_unknown_field", {"nothing": {"$exists": True}}, "false"),
):
    _find(_n, "customer", "c_custkey", _f, _C, SEGS + f"SELECT c_custkey, seg FROM c WHERE {_s}", derive=_segments)

_find("f_nested_path", "events", "event_id", {"props.k": {"$gt": 50}}, ["event_id", "event_type"],
      "SELECT event_id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50", derive=_events)

for _n, _f, _s in (
    ("f_size", {"turns": {"$size": 4}}, "len(turns) = 4"),
    ("f_all", {"nums": {"$all": [0, 3]}}, "list_has_all(nums, [0, 3])"),
    ("f_array_eq", {"roles": "system"}, "list_contains(roles, 'system')"),
    ("f_array_range", {"nums": {"$gt": 4, "$lt": 6}}, "len(list_filter(nums, lambda x: x > 4 AND x < 6)) > 0"),
    ("f_array_ne", {"roles": {"$ne": "user"}}, "len(list_filter(roles, lambda x: x <> 'user')) > 0"),
    ("f_array_index", {"roles.0": "system"}, "roles[1] = 'system'"),
    ("f_elem_match_scalar", {"nums": {"$elemMatch": {"$gte": 5, "$lt": 7}}}, "len(list_filter(nums, lambda x: x >= 5 AND x < 7)) > 0"),
    ("f_elem_match_doc", {"turns": {"$elemMatch": {"role": "user", "size": {"$gt": 400}}}}, "len(list_filter(turns, lambda x: x.role = 'user' AND x.size > 400)) > 0"),
    ("f_elem_match_or", {"turns": {"$elemMatch": {"$or": [{"size": {"$lt": 20}}, {"turn": 6}]}}}, "len(list_filter(turns, lambda x: x.size < 20 OR x.turn = 6)) > 0"),
    ("f_elem_match_empty", {"turns": {"$elemMatch": {}}}, "len(turns) > 0"),
    ("f_not_elem_match", {"$not": {"turns": {"$elemMatch": {"size": {"$gt": 400}}}}}, "len(list_filter(turns, lambda x: x.size > 400)) = 0"),
):
    _find(_n, "conversations", "conv_id", _f, ["conv_id"], CHATS + f"SELECT conv_id FROM chats WHERE {_s}", derive=_chats)

# Projections, sorts and limits.

_find("p_include", "orders", "o_orderkey", {}, ["o_orderstatus"], "SELECT o_orderkey, o_orderstatus FROM orders")
QUERIES["p_include"] = lambda spark, d: find(_table(spark, d, "orders"), {}, "o_orderkey").projection({"o_orderstatus": 1}).frame(False)
_find("p_include_no_id", "orders", "o_orderkey", {"o_orderstatus": "P"}, ["o_totalprice"], "SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P'")
QUERIES["p_exclude"] = lambda spark, d: find(_table(spark, d, "supplier"), {}, "s_suppkey").projection({"s_name": 0, "s_acctbal": 0}).frame(False)
SQL["p_exclude"] = "SELECT s_suppkey, s_nationkey FROM supplier"


def _chat_projection(projection: dict, *columns: str) -> Query:
    return lambda spark, d: find(_chats(spark, d), {}, "conv_id").projection(projection).frame(False).selectExpr("conv_id", *columns)


for _n, _p, _e, _s in (
    ("p_slice_pos", {"nums": {"$slice": 2}}, "array_join(nums, ',') AS v", "array_to_string(nums[1:2], ',') AS v"),
    ("p_slice_neg", {"nums": {"$slice": -3}}, "array_join(nums, ',') AS v", "array_to_string(nums[greatest(len(nums) - 2, 1):], ',') AS v"),
    ("p_slice_skip", {"nums": {"$slice": [1, 2]}}, "array_join(nums, ',') AS v", "array_to_string(nums[2:3], ',') AS v"),
    ("p_elem_match", {"turns": {"$elemMatch": {"size": {"$gt": 200}}}}, "size(turns) AS v", "len(list_filter(turns, lambda x: x.size > 200))::INTEGER AS v"),
    ("p_array_elements", {"roles.0": 1, "roles.2": 1}, "concat_ws('|', roles.`0`, roles.`2`) AS v", "concat_ws('|', roles[1], roles[3]) AS v"),
):
    QUERIES[_n], SQL[_n] = _chat_projection(_p, _e), CHATS + f"SELECT conv_id, {_s} FROM chats"

QUERIES["p_nested"] = lambda spark, d: find(_events(spark, d), {}, "event_id").projection({"props.k": 1}).frame(False).selectExpr("event_id", "props.k AS k")
SQL["p_nested"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"

_find("t_sort_multi", "customer", "c_custkey", {"c_nationkey": {"$lt": 10}}, ["c_custkey", "c_nationkey", "c_acctbal"],
      "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 10", sort={"c_nationkey": 1, "c_acctbal": -1, "c_custkey": 1})
_find("t_topk", "orders", "o_orderkey", {"o_orderstatus": "F"}, ["o_orderkey", "o_totalprice"],
      "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
      sort={"o_totalprice": -1, "o_orderkey": 1}, limit=20)
_find("t_skip_limit", "orders", "o_orderkey", {}, ["o_orderkey", "o_totalprice"],
      "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30 OFFSET 15",
      sort={"o_totalprice": 1, "o_orderkey": 1}, skip=15, limit=30)
_find("t_find_one", "part", "p_partkey", {"p_size": {"$gt": 40}}, ["p_partkey", "p_size"],
      "SELECT p_partkey, p_size FROM part WHERE p_size > 40 ORDER BY p_partkey LIMIT 1", limit=1)
_find("t_default_order", "part", "p_partkey", {}, ["p_partkey", "p_name"], "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25", limit=25)
_find("t_sort_missing", "customer", "c_custkey", {}, ["c_custkey", "seg"],
      SEGS + "SELECT c_custkey, seg FROM c ORDER BY seg NULLS FIRST, c_custkey LIMIT 400", sort={"seg": 1, "c_custkey": 1}, limit=400, derive=_segments)
_find("s_reverse", "supplier", "s_suppkey", {}, ["s_suppkey"], "SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 10", sort={"_id": -1}, limit=10)

# Updates: the image of the table afterwards.


def _customers(name: str, filter: dict, update: dict, column: str, value: str, condition: str, default: str | None = None, derive=None) -> None:
    otherwise = default or column
    _update(name, "customer", "c_custkey", filter, update, ["c_custkey", f"{column} AS v"],
            SEGS + f"SELECT c_custkey, CASE WHEN {condition} THEN {value} ELSE {otherwise} END AS v FROM c", derive or _segments)


_customers("u_set", {"c_nationkey": 3}, {"$set": {"seg": "NEW"}}, "seg", "'NEW'", "c_nationkey = 3")
_customers("u_set_new_field", {"c_nationkey": 3}, {"$set": {"flag": "x"}}, "flag", "'x'", "c_nationkey = 3", "NULL")
_customers("u_set_nested", {"c_nationkey": {"$lt": 5}}, {"$set": {"a.b": 7}}, "a.b", "7", "c_nationkey < 5", "NULL")
_customers("u_unset", {"c_nationkey": {"$gte": 10}}, {"$unset": {"seg": ""}}, "seg", "NULL", "c_nationkey >= 10")
_customers("u_inc", {"c_acctbal": {"$lt": 0}}, {"$inc": {"c_acctbal": 100.5}}, "c_acctbal", "c_acctbal + 100.5::DOUBLE", "c_acctbal < 0")
_customers("u_inc_int", {"c_acctbal": {"$lt": 0}}, {"$inc": {"c_nationkey": 5}}, "c_nationkey", "c_nationkey::BIGINT + 5", "c_acctbal < 0", "c_nationkey::BIGINT")
_customers("u_mul", {"c_nationkey": 1}, {"$mul": {"c_acctbal": 2}}, "c_acctbal", "c_acctbal * 2", "c_nationkey = 1")
_customers("u_min", {}, {"$min": {"c_acctbal": 500.0}}, "c_acctbal", "least(c_acctbal, 500.0::DOUBLE)", "true")
_customers("u_max", {}, {"$max": {"seg": "HOUSEHOLD"}}, "seg", "greatest(coalesce(seg, 'HOUSEHOLD'), 'HOUSEHOLD')", "true")
def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with a balance that is NaN below -500 and missing below 0."""
    bal = F.when(F.col("c_acctbal") < -500, F.lit(float("nan"))).when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return _table(spark, sf_dir, "customer").select("c_custkey", bal.alias("bal"))


for _n, _op, _new in (("u_min_nan", "$min", "CASE WHEN isnan(b) THEN b ELSE least(b, 1000) END"), ("u_max_nan", "$max", "CASE WHEN isnan(b) THEN 1000 ELSE greatest(b, 1000) END")):
    _update(_n, "customer", "c_custkey", {}, {_op: {"bal": 1000.0}}, ["c_custkey", "cast(bal AS string) = 'NaN' AS odd", "if(isnan(bal), 0, bal) AS v"],
            f"WITH c AS (SELECT c_custkey, coalesce(CASE WHEN c_acctbal < -500 THEN 'nan'::DOUBLE WHEN c_acctbal >= 0 THEN c_acctbal END, 1000) AS b FROM customer) SELECT c_custkey, isnan({_new}) AS odd, CASE WHEN isnan({_new}) THEN 0 ELSE {_new} END AS v FROM c",
            _balances)

_customers("u_rename", {"c_nationkey": {"$lt": 12}}, {"$rename": {"seg": "market"}}, "market", "seg", "c_nationkey < 12", "NULL")
_customers("u_bit", {"c_nationkey": {"$gt": 4}}, {"$bit": {"c_nationkey": {"and": 12, "or": 1, "xor": 3}}}, "c_nationkey", "xor((c_nationkey & 12) | 1, 3)", "c_nationkey > 4")
_customers("u_many_operators", {"c_nationkey": 7}, {"$set": {"seg": "Z"}, "$inc": {"c_acctbal": 1.5}}, "concat(coalesce(seg, '-'), '/', cast(c_acctbal > 0 as string))",
           "'Z/' || (c_acctbal + 1.5 > 0)::VARCHAR", "c_nationkey = 7", "coalesce(seg, '-') || '/' || (c_acctbal > 0)::VARCHAR")
QUERIES["u_current_date"] = lambda spark, d: apply_update(
    _segments(spark, d), parse_update({"$currentDate": {"seen": True}}), {"c_nationkey": 3}, "c_custkey"
).selectExpr("c_custkey", "seen IS NOT NULL AS v")
SQL["u_current_date"] = "SELECT c_custkey, c_nationkey = 3 AS v FROM customer"


def _arrays(name: str, update: dict, value: str, column: str = "nums", filter: dict | None = None, condition: str = "true", array_filters=None) -> None:
    joined = f"array_join({column}, ',', '-') AS v"
    _update(name, "conversations", "conv_id", filter or {}, update, ["conv_id", joined],
            CHATS + f"SELECT conv_id, array_to_string(CASE WHEN {condition} THEN {value} ELSE {column} END, ',') AS v FROM chats", _chats, array_filters)


_arrays("u_push", {"$push": {"nums": 99}}, "list_append(nums, 99)", filter={"nums": {"$size": 4}}, condition="len(nums) = 4")
_arrays("u_push_each_position", {"$push": {"nums": {"$each": [70, 71], "$position": 1}}}, "nums[1:1] || [70, 71]::BIGINT[] || nums[2:]")
_arrays("u_push_sort_slice", {"$push": {"nums": {"$each": [70, -1], "$sort": -1, "$slice": 3}}}, "list_sort(nums || [70, -1]::BIGINT[], 'DESC')[1:3]")
_arrays("u_push_slice_tail", {"$push": {"nums": {"$each": [50], "$slice": -2}}}, "(nums || [50]::BIGINT[])[-2:]")
_arrays("u_add_to_set", {"$addToSet": {"nums": {"$each": [0, 88, 88]}}}, "CASE WHEN list_contains(nums, 0) THEN nums || [88]::BIGINT[] ELSE nums || [0, 88]::BIGINT[] END")
_arrays("u_pop_last", {"$pop": {"nums": 1}}, "nums[1:len(nums) - 1]")
_arrays("u_pop_first", {"$pop": {"nums": -1}}, "nums[2:]")
_arrays("u_pull", {"$pull": {"nums": {"$gte": 3}}}, "list_filter(nums, lambda x: x < 3)")
_arrays("u_pull_value", {"$pull": {"roles": "user"}}, "list_filter(roles, lambda x: x <> 'user')", "roles")
_arrays("u_pull_all", {"$pullAll": {"nums": [1, 2]}}, "list_filter(nums, lambda x: x NOT IN (1, 2))")
_arrays("u_positional_all", {"$inc": {"nums.$[]": 10}}, "list_transform(nums, lambda x: x + 10)")
_arrays("u_positional_filtered", {"$mul": {"nums.$[n]": 3}}, "list_transform(nums, lambda x: CASE WHEN x >= 2 THEN x * 3 ELSE x END)", array_filters=[{"n": {"$gte": 2}}])
_arrays("u_array_index", {"$set": {"nums.0": 42}}, "[42]::BIGINT[] || nums[2:]")

_update("u_positional_doc", "conversations", "conv_id", {}, {"$set": {"turns.$[t].role": "long"}},
        ["conv_id", "array_join(transform(turns, t -> t.role), ',') AS v"],
        CHATS + "SELECT conv_id, array_to_string(list_transform(turns, lambda t: CASE WHEN t.size > 300 THEN 'long' ELSE t.role END), ',') AS v FROM chats",
        _chats, [{"t.size": {"$gt": 300}}])
_update("u_pull_doc", "conversations", "conv_id", {}, {"$pull": {"turns": {"role": "user", "size": {"$gt": 100}}}},
        ["conv_id", "array_join(transform(turns, t -> t.turn), ',') AS v"],
        CHATS + "SELECT conv_id, array_to_string(list_transform(list_filter(turns, lambda t: NOT (t.role = 'user' AND t.size > 100)), lambda t: t.turn), ',') AS v FROM chats",
        _chats)

# Writes: the collection afterwards.

SUPPLIERS = "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS bal FROM supplier"


def _database(spark: SparkSession) -> Database:
    return open_database(spark, f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}")


def _suppliers(spark: SparkSession, sf_dir: str) -> Collection:
    suppliers = _database(spark).create_collection("suppliers")
    suppliers.insert_frame(_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS _id", "s_name AS name", "s_nationkey AS nation", "s_acctbal AS bal"))
    return suppliers


def _written(work: Callable[[Collection], None]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        suppliers = _suppliers(spark, sf_dir)
        work(suppliers)
        return suppliers.frame().withColumnRenamed("_id", "id")

    return query


def _answered(name: str, schema: str, work: Callable[[Collection], list[tuple]], sql: str) -> None:
    """Register what calls on the collection of suppliers return, as rows."""
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(work(_suppliers(spark, sf_dir)), schema)
    SQL[name] = sql


for _n, _w, _s in (
    ("w_insert_frame", lambda c: None, SUPPLIERS),
    ("w_insert_many", lambda c: c.insert_many([{"_id": -1, "name": "a", "nation": 1, "bal": 0.5}, {"_id": -2, "name": "b"}]),
     SUPPLIERS + " UNION ALL VALUES (-1, 'a', 1, 0.5), (-2, 'b', NULL, NULL)"),
    ("w_update_one_sort", lambda c: c.update_one({"nation": {"$lt": 10}}, {"$set": {"name": "top"}}, sort={"bal": -1, "_id": 1}),
     f"SELECT id, CASE WHEN id = (SELECT id FROM ({SUPPLIERS}) WHERE nation < 10 ORDER BY bal DESC, id LIMIT 1) THEN 'top' ELSE name END AS name, nation, bal FROM ({SUPPLIERS})"),
    ("w_update_many", lambda c: c.update_many({"nation": {"$gt": 12}}, {"$inc": {"bal": 10.0}}),
     f"SELECT id, name, nation, CASE WHEN nation > 12 THEN bal + 10 ELSE bal END AS bal FROM ({SUPPLIERS})"),
    ("w_replace_one", lambda c: c.replace_one({"_id": 7}, {"name": "new", "nation": 2}),
     f"SELECT id, CASE WHEN id = 7 THEN 'new' ELSE name END AS name, CASE WHEN id = 7 THEN 2 ELSE nation END AS nation, CASE WHEN id = 7 THEN NULL ELSE bal END AS bal FROM ({SUPPLIERS})"),
    ("w_delete_one", lambda c: c.delete_one({"nation": {"$gte": 3}}),
     f"SELECT * FROM ({SUPPLIERS}) WHERE id <> (SELECT min(id) FROM ({SUPPLIERS}) WHERE nation >= 3)"),
    ("w_delete_many", lambda c: c.delete_many({"bal": {"$lt": 2000}}), f"SELECT * FROM ({SUPPLIERS}) WHERE bal >= 2000"),
    ("w_upsert", lambda c: c.update_one({"_id": -5, "name": "up"}, {"$setOnInsert": {"nation": 9}, "$set": {"bal": 1.25}}, upsert=True),
     SUPPLIERS + " UNION ALL VALUES (-5, 'up', 9, 1.25)"),
    ("w_find_one_and_update", lambda c: c.find_one_and_update({"_id": 3}, {"$mul": {"bal": 2.0}}),
     f"SELECT id, name, nation, CASE WHEN id = 3 THEN bal * 2 ELSE bal END AS bal FROM ({SUPPLIERS})"),
    ("w_find_one_and_delete", lambda c: c.find_one_and_delete({}, sort={"bal": 1, "_id": 1}),
     f"SELECT * FROM ({SUPPLIERS}) WHERE id <> (SELECT id FROM ({SUPPLIERS}) ORDER BY bal, id LIMIT 1)"),
    ("w_find_one_and_replace", lambda c: c.find_one_and_replace({"_id": 4}, {"name": "r"}),
     f"SELECT id, CASE WHEN id = 4 THEN 'r' ELSE name END AS name, CASE WHEN id = 4 THEN NULL ELSE nation END AS nation, CASE WHEN id = 4 THEN NULL ELSE bal END AS bal FROM ({SUPPLIERS})"),
    ("w_compact", lambda c: c.compact(), SUPPLIERS),
    ("w_insert_one", lambda c: c.insert_one({"_id": -9, "name": "one", "bal": 2.5}), SUPPLIERS + " UNION ALL VALUES (-9, 'one', NULL, 2.5)"),
    ("w_replace_upsert", lambda c: c.replace_one({"_id": -6}, {"name": "r", "nation": 4}, upsert=True), SUPPLIERS + " UNION ALL VALUES (-6, 'r', 4, NULL)"),
    ("w_compact_index", lambda c: (c.create_index({"nation": 1, "bal": -1}), c.compact("nation_1_bal_-1"), c.update_many({"nation": 5}, {"$set": {"bal": 0.0}})),
     f"SELECT id, name, nation, CASE WHEN nation = 5 THEN 0 ELSE bal END AS bal FROM ({SUPPLIERS})"),
):
    QUERIES[_n], SQL[_n] = _written(_w), _s


def _image(doc: dict | None) -> list[tuple]:
    return [(doc["_id"], doc.get("name"), doc.get("nation"), doc.get("bal"))] if doc else []


def _counts(c: Collection) -> tuple:
    """What an update and a delete report, and what remains."""
    done = c.update_many({"nation": {"$lt": 9}}, {"$set": {"name": "x"}})
    return done.matched_count, done.modified_count, c.delete_many({"name": "x"}).deleted_count, c.estimated_document_count()


_DOC = "id long, name string, nation int, bal double"
_TOP = f"(SELECT id FROM ({SUPPLIERS}) WHERE nation = 3 ORDER BY bal DESC, id LIMIT 1)"
_BY_BAL = {"bal": -1, "_id": 1}

_answered("r_update_before", _DOC, lambda c: _image(c.find_one_and_update({"nation": 3}, {"$inc": {"bal": 100.0}}, sort=_BY_BAL)),
          f"SELECT * FROM ({SUPPLIERS}) WHERE id = {_TOP}")
_answered("r_update_after", _DOC, lambda c: _image(c.find_one_and_update({"nation": 3}, {"$inc": {"bal": 100.0}}, sort=_BY_BAL, return_document=ReturnDocument.AFTER)),
          f"SELECT id, name, nation, bal + 100 AS bal FROM ({SUPPLIERS}) WHERE id = {_TOP}")
_answered("r_update_projection", "id long, name string", lambda c: [x[:2] for x in _image(c.find_one_and_update({"nation": 3}, {"$set": {"name": "n"}}, {"name": 1}, _BY_BAL))],
          f"SELECT id, name FROM ({SUPPLIERS}) WHERE id = {_TOP}")
_answered("r_replace_after", _DOC, lambda c: _image(c.find_one_and_replace({"nation": 3}, {"name": "r"}, sort=_BY_BAL, return_document=ReturnDocument.AFTER)),
          f"SELECT {_TOP} AS id, 'r' AS name, NULL::INTEGER AS nation, NULL::DOUBLE AS bal")
_answered("r_delete", _DOC, lambda c: _image(c.find_one_and_delete({"nation": 3}, sort=_BY_BAL)), f"SELECT * FROM ({SUPPLIERS}) WHERE id = {_TOP}")
_answered("r_counts", "matched long, modified long, deleted long, remain long", lambda c: [_counts(c)],
          f"SELECT count(*) FILTER (nation < 9) AS matched, count(*) FILTER (nation < 9) AS modified, count(*) FILTER (nation < 9) AS deleted, count(*) FILTER (nation >= 9) AS remain FROM ({SUPPLIERS})")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older version stays as it was, whatever is written after it."""
    c = _suppliers(spark, sf_dir)
    seen = c.version()
    c.delete_many({"nation": {"$gt": 4}})
    c.update_many({}, {"$set": {"name": "later"}})
    return c.frame(seen).withColumnRenamed("_id", "id")


def _index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of an indexed field, over files sorted by that index: the others' zones rule them out."""
    c = _suppliers(spark, sf_dir)
    c.create_index({"nation": 1})
    c.compact("nation_1")
    return c.find({"nation": {"$gte": 7, "$lt": 12}, "bal": {"$gt": 0}}).frame(ordered=False).withColumnRenamed("_id", "id")


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection that does not exist is empty to a lenient handle, and an insert creates it."""
    c = _database(spark).collection("nations").create_if_missing()
    before = len(list(c.find().execute()))
    c.insert_frame(_table(spark, sf_dir, "nation").selectExpr("n_nationkey AS _id", "n_name AS name"))
    return c.frame().select("_id", "name", F.lit(before).alias("before")).withColumnRenamed("_id", "id")


QUERIES["s_snapshot"], SQL["s_snapshot"] = _snapshot, SUPPLIERS
QUERIES["s_index_scan"], SQL["s_index_scan"] = _index_scan, f"SELECT * FROM ({SUPPLIERS}) WHERE nation >= 7 AND nation < 12 AND bal > 0"
QUERIES["s_create_if_missing"], SQL["s_create_if_missing"] = _missing, "SELECT n_nationkey AS id, n_name AS name, 0 AS before FROM nation"


def _regions(spark: SparkSession, sf_dir: str) -> Database:
    """One collection of nations for each region."""
    db = _database(spark)
    nations = _table(spark, sf_dir, "nation").selectExpr("n_nationkey AS _id", "n_name AS name", "n_regionkey AS region")
    for k in range(5):
        db.create_collection(f"region{k}", IdStrategy.MANUAL).insert_frame(nations.where(F.col("region") == k))
    return db


def _sizes(db: Database) -> list[tuple]:
    return [(c.name, db.collection(c.name).estimated_document_count()) for c in db.list_collections()]


def _catalog_query(name: str, schema: str, work: Callable[[Database], list[tuple]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(work(_regions(spark, sf_dir)), schema)
    SQL[name] = sql


_BY_REGION = "SELECT 'region' || n_regionkey AS name, count(*) AS n FROM nation GROUP BY n_regionkey"
_catalog_query("d_list", "name string, n long", _sizes, _BY_REGION)
_catalog_query("d_drop", "name string, n long", lambda db: (db.drop_collection("region2"), db.drop_collection("none"), _sizes(db))[-1], f"SELECT * FROM ({_BY_REGION}) WHERE name <> 'region2'")
_catalog_query("d_rename", "name string, n long", lambda db: (db.collection("region3").rename("third"), _sizes(db))[-1], f"SELECT replace(name, 'region3', 'third') AS name, n FROM ({_BY_REGION})")
_catalog_query("d_recreate", "name string, n long", lambda db: (db.drop_collection("region1"), db.create_collection("region1"), _sizes(db))[-1],
               f"SELECT name, CASE WHEN name = 'region1' THEN 0 ELSE n END AS n FROM ({_BY_REGION})")
_catalog_query("d_reopen", "name string, n long", lambda db: _sizes(open_database(db.spark, db.root)), _BY_REGION)
_catalog_query("d_count", "n long", lambda db: [(sum(n for _, n in _sizes(db)),)], "SELECT count(*) AS n FROM nation")


def _indexes(db: Database) -> list[tuple]:
    c = db.collection("region0")
    for keys in ({"name": 1}, {"region": -1, "name": 1}, {"sub.x": 1}):
        c.create_index(keys)
    c.create_index({"name": 1})
    c.drop_index("sub.x_1")
    return [(i.name, path, way) for i in c.list_indexes() for path, way in i.fields]


_catalog_query("d_indexes", "name string, path string, way int", _indexes, "SELECT * FROM (VALUES ('name_1', 'name', 1), ('region_-1_name_1', 'region', -1), ('region_-1_name_1', 'name', 1)) v(name, path, way)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, projection, sort and limit over orders."""
    wanted = {"o_orderstatus": "F", "o_totalprice": {"$gte": 200000}}
    q = find(_table(spark, sf_dir, "orders"), wanted, "o_orderkey").projection({"o_orderkey": 1, "o_totalprice": 1})
    return q.sort({"o_totalprice": -1, "o_orderkey": 1}).limit(10).frame()


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"


# Dynamic mode: a variant column, in which missing, null and mixed types are told apart.


def _dynamic(name: str, filter: dict, sql: str, sort=None, limit=None) -> None:
    _find(name, "events", "event_id", filter, ["event_id"], LOOSE + f"SELECT event_id FROM l {sql}", sort=sort, limit=limit, derive=_loose)


_dynamic("v_eq", {"d.k": 7}, "WHERE (t = 'number' AND n = 7) OR (t = 'array' AND (a = 7 OR 1 = 7))")
_dynamic("v_eq_null", {"d.k": None}, "WHERE t IS NULL OR t = 'null'")
_dynamic("v_ne", {"d.k": {"$ne": 7}}, "WHERE NOT coalesce(t = 'number' AND n = 7, false)")
_dynamic("v_range", {"d.k": {"$gt": 10, "$lt": 40}}, "WHERE t IN ('number', 'array') AND n > 10 AND n < 40")
_dynamic("v_lt_null", {"d.k": {"$lt": 5}}, "WHERE t = 'null' OR (t = 'number' AND n < 5) OR t = 'array'")
_dynamic("v_gt_types", {"d.k": {"$gt": 50}}, "WHERE t = 'text' OR (t IN ('number', 'array') AND n > 50)")
_dynamic("v_in", {"d.k": {"$in": [3, "4", None]}}, "WHERE t = 'null' OR (t = 'number' AND n = 3) OR (t = 'text' AND s = '4')")
_dynamic("v_nin", {"d.k": {"$nin": [3, "4"]}}, "WHERE t IS NOT NULL AND NOT (t = 'number' AND n = 3) AND NOT (t = 'text' AND s = '4')")
_dynamic("v_exists", {"d.k": {"$exists": False}}, "WHERE t IS NULL")
_dynamic("v_type", {"d.k": {"$type": "string"}}, "WHERE t = 'text'")
_dynamic("v_size", {"d.k": {"$size": 2}}, "WHERE t = 'array'")
_dynamic("v_all", {"d.k": {"$all": [1, 9]}}, "WHERE t = 'array' AND a = 9")
_dynamic("v_elem_match", {"d.k": {"$elemMatch": {"$gte": 20, "$lt": 30}}}, "WHERE t = 'array' AND a >= 20 AND a < 30")
_dynamic("v_index", {"d.k.1": {"$gte": 90}}, "WHERE t = 'array' AND a >= 90")
_dynamic(
    "v_topk", {}, "ORDER BY CASE t WHEN 'array' THEN 5 WHEN 'text' THEN 3 WHEN 'number' THEN 2 ELSE 1 END, CASE t WHEN 'number' THEN n END, CASE t WHEN 'text' THEN s END, event_id LIMIT 4000",
    sort={"d.k": 1, "event_id": 1}, limit=4000,
)
