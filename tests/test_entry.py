"""The registered queries and their SQL."""

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_engine_query_has_sql():
    from brindle import queries

    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", ["f_not", "f_elem_match_doc", "p_slice_neg", "t_skip_limit", "u_push_sort_slice", "w_update_one_sort", "flagship"])
def test_sql_agrees(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    out = db.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(out, key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice"]
