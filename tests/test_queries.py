"""Every registered library query against its SQL in DuckDB over the same tables."""

import datetime
import math
import os

import duckdb
import pytest
from conftest import SF
from ordolith.plans import catalogue


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


def test_indexes_hold_every_user(spark, tmp_path):
    rows = [(1, 0, 1.5), (2, 200, 2.0), (3, 201, 3.0), (4, 5000, 4.0), (5, 5000, -6.0), (6, None, 7.0)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    reduced = {r.user_id: (r.n, r.total) for r in catalogue.QUERIES["reduce_to_index"](spark, str(tmp_path)).collect()}
    assert sorted(reduced) == list(range(5051))
    assert {k: v for k, v in reduced.items() if v[0]} == {0: (1, 150), 200: (1, 200), 201: (1, 300), 5000: (2, -200)}
    last = {r.user_id: r.last_value for r in catalogue.QUERIES["group_to_index"](spark, str(tmp_path)).collect()}
    assert sorted(last) == list(range(5051))
    assert {k: v for k, v in last.items() if v != -1} == {0: 150, 200: 200, 201: 300, 5000: -600}


def test_lines_of_empty_texts(spark, tmp_path):
    texts = ["", None, "\n", "a", "a\n", "\n\n", "a\n\nb", "\r\n", "é\n"]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(catalogue.ORACLE_SQL["line_count"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert want == [(11,)]
    assert [tuple(r) for r in catalogue.QUERIES["line_count"](spark, str(tmp_path)).collect()] == want


def test_queries_without_sql(spark):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"bernoulli_random", "sample", "bisecting_kmeans", "lcp", "bfs_trees", "zipf_graph"}
    events = spark.read.parquet(f"{SF}/events.parquet")
    n = events.count()
    ids = {r.event_id for r in events.collect()}
    kept = [r.event_id for r in catalogue.QUERIES["bernoulli_random"](spark, SF).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= ids and abs(len(kept) - 0.1 * n) < 6 * math.sqrt(0.09 * n)
    drawn = [r.event_id for r in catalogue.QUERIES["sample"](spark, SF).collect()]
    assert len(drawn) == len(set(drawn)) == min(100, n) and set(drawn) <= ids
    clusters = catalogue.QUERIES["bisecting_kmeans"](spark, SF).collect()
    assert sum(r.n for r in clusters) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and len(clusters) == 4


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
