"""Every catalogue query runs, and equals its DuckDB form where there is one."""

import random

import duckdb
import pytest

from feloom.catalogue import ORACLES, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    return value


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()]
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in sorted(columns)]
        expected = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_combine_features_takes_users_of_all_orders(spark, tmp_path):
    """A user whose orders are all in other states than 'P' stays, as in SQL; one without an order goes."""
    spark.createDataFrame([(u, k, 1.5 * u) for u in (1, 2, 3) for k in ("click", "view", "buy")], "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "F"), (2, "P"), (2, "O")], "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, QUERIES["combine_features"](spark, str(tmp_path)).collect()))
    assert got == [(1, "11", 1.5), (1, "12", 1.5), (2, "11", 3.0), (2, "12", 3.0)]
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["combine_features"]).fetchall())


def test_export_features_sums_in_order_of_events(spark, tmp_path):
    """Sums that end at a half round as in SQL, which adds in the events' order, however the rows are split."""
    rnd = random.Random(3)
    events = []
    for user in range(400):
        cents = [rnd.randrange(1, 12_000) for _ in range(11)]
        cents.append(100 + (50 - sum(cents)) % 100)
        events += [(user, "click" if user % 3 else "view", c / 100) for c in cents]
    rows = [(i, *e) for i, e in enumerate(sorted(events, key=lambda e: rnd.random()))]
    whole, split = tmp_path / "whole", tmp_path / "split"
    schema = "event_id long, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{whole}/events.parquet")
    for part in range(5):
        spark.createDataFrame(rows[part::5][::-1], schema).coalesce(1).write.mode("append").parquet(f"{split}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{whole}/events.parquet/*.parquet')")
    expected = sorted(con.execute(ORACLES["export_features"]).fetchall())
    assert len(expected) == 400
    for place in (whole, split):
        got = QUERIES["export_features"](spark, str(place)).select("user", "`num:m`")
        assert sorted(map(tuple, got.collect())) == expected


def test_export_features_writes_large_sums_in_full(spark, tmp_path):
    spark.createDataFrame([(i, 2, "view", 5e6 + i) for i in range(9)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(QUERIES["export_features"](spark, str(tmp_path)).first()) == ("vk:2", "2:45000036.0")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
