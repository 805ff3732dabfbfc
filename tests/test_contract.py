"""Every query that has SQL against DuckDB on the smallest tables."""

import calendar
import datetime
import math
from pathlib import Path

import pytest

from freshet.plans import contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver's tables")


@pytest.fixture
def duck():
    """A connection for each test: an error inside the engine ends one test, not all that follow."""
    import duckdb

    with duckdb.connect(config={"threads": 4}) as connection:
        for name in TABLES.split():
            connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
        yield connection


def plain(value):
    return str(value)[:10] if isinstance(value, (datetime.date, datetime.datetime)) else value


def rows_of(rows, columns):
    """Rows in the order of what is not a double, then of the doubles."""
    values = [[plain(r[c]) for c in columns] for r in rows]
    return sorted(values, key=lambda v: ([repr(x) for x in v if not isinstance(x, float)], [x for x in v if isinstance(x, float)]))


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(contract.ORACLES))
def test_query(spark, duck, name):
    df = contract.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = rows_of(df.collect(), columns)
    relation = duck.sql(contract.ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    assert len(relation.columns) == len(columns)
    expected = rows_of(relation.fetchall(), at)
    assert len(got) == len(expected) and got
    assert all(same(x, y) for a, b in zip(got, expected) for x, y in zip(a, b))


def test_every_query_has_sql():
    assert set(contract.QUERIES) == set(contract.ORACLES)


@pytest.mark.parametrize("name", ["vaa_join_routed", "vaa_join_permanent"])
def test_a_braid_with_a_comid_of_the_tree_keeps_its_own_row(spark, monkeypatch, name):
    rows = [(7, 7.0, 3.0, 7.0, 1.0), (7, 2.0, 1.0, 1.5, 1.0)]
    monkeypatch.setattr(contract.inputs, "segments", lambda spark, sf_dir: spark.createDataFrame(rows, "comid long, fromnode double, tonode double, hydroseq double, areasqkm double"))
    got = sorted(tuple(r) for r in contract.QUERIES[name](spark, "").collect())
    assert got == sorted((7, "P7", *r[1:4]) for r in rows)


def test_a_model_run_keeps_the_kinds_of_segments_apart(spark, duck, tmp_path):
    """Some segments of the tree have comids of braids, others lie outside the basin; all of these have none above or below, so the SQL is asked without the first."""
    where = "case when p_partkey < 190 then p_partkey when p_partkey < 195 then 999810 + p_partkey else 1999802 + p_partkey end"
    duck.sql("create table parts as select * replace (" + where + f" as p_partkey) from '{SF_DIR}/part.parquet'")
    duck.sql(f"copy parts to '{tmp_path}/part.parquet' (format parquet)")
    for name in ("nation", "supplier", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF_DIR}/{name}.parquet")
    both = "p_partkey between 999999 and 1100000"
    duck.sql(f"create or replace view part as select * from parts where not {both}")
    meet = duck.sql(f"select p_partkey + 1 as comid, p_size, p_partkey * 7919 % 1009 as x, p_partkey * 104729 % 2003 as y from parts where {both}").fetchall()
    columns = ["date", "comid", "flow_cms", "lat", "lon"]
    expected = [list(map(plain, r)) for r in duck.sql(f"select {', '.join(columns)} from ({contract.ORACLES['model_run']})").fetchall()]
    for day in sorted({r[0] for r in expected}):
        seconds = calendar.monthrange(*map(int, day.split("-")[:2]))[1] * 86400
        for comid, size, x, y in meet:
            flow = contract.COEFFICIENT * size * 1e6 / seconds
            expected.append([day, comid, flow, round(26.0003 + y * 64 / 16384, 3), round(-102 + x * 128 / 16384 + 0.0052, 3)])
    got = [[plain(r[c]) for c in columns] for r in contract.QUERIES["model_run"](spark, str(tmp_path)).collect()]
    order = lambda r: (r[0], r[1], r[3], r[4])
    got, expected = sorted(got, key=order), sorted(expected, key=order)
    assert len(meet) == 5 and len(got) == len(expected) == 12 * (190 + 5 + 2 + 10)
    assert all(same(x, y) for a, b in zip(got, expected) for x, y in zip(a, b))
