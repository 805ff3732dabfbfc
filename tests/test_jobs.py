"""The jobs: reruns, growing input on copies, periods one after another, command lines."""

import logging
import shutil
from pathlib import Path

import duckdb
import pytest

from jobs import common, delivery_intake, gage_report, queries

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver's tables")
ROW = "  G1   {year}   " + "  ".join(str(v) for v in range(100, 112))
DOCS = "doc_id long, text string, source string, lang string"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def intake(spark, tmp_path):
    config = delivery_intake.Config(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    delivery_intake.run(spark, config)
    return {r.doc_id: (r.n_lines, r.n_rows, r.n_short, r.n_bad, r.copy_of, r.status, r.source) for r in delivery_intake.result(spark, config.out).collect()}


def test_growing_deliveries(spark, tmp_path, caplog):
    two = ROW.format(year=1999) + "\n" + ROW.format(year=2000) + " more\n"
    bad = two + ROW.format(year="199x")
    deliver(spark, tmp_path / "in", [(1, two, "a", "en"), (2, bad, "a", None), (3, None, None, "en"), (4, "G1 1999 1 2 3", "b", "en"), (6, two, "b", "en"), (None, ROW.format(year=1980), "b", "en")])
    first = intake(spark, tmp_path)
    assert first == {
        1: (3, 2, 0, 0, None, "usable", "a"),
        2: (3, 3, 0, 1, None, "broken", "a"),
        3: (1, 0, 0, 0, None, "empty", None),
        4: (1, 0, 1, 0, None, "empty", "b"),
        6: (3, 2, 0, 0, 1, "copy", "b"),
        None: (1, 1, 0, 0, None, "usable", "b"),
    }
    held = spark.read.parquet(str(tmp_path / "out" / "observations"))
    assert held.where("doc_id = 1").count() == 24 and held.where("doc_id is null").count() == 12 and held.count() == 36
    assert {str(r.date): r.acft for r in held.where("doc_id = 1 and year = 1999").collect()}["1999-12-01"] == 111.0
    # Nothing new: nothing changes, and no batch runs.
    assert intake(spark, tmp_path) == first and held.count() == 36
    # New files: an old text again, under a smaller id, and a new one; only these are read.
    deliver(spark, tmp_path / "in", [(0, two, "c", "en"), (9, ROW.format(year=2005), "a", "en")])
    with caplog.at_level(logging.INFO, "jobs.delivery_intake"):
        second = intake(spark, tmp_path)
    assert any("read 2 deliveries, wrote 2 rows" in r.getMessage() for r in caplog.records)
    assert second == first | {0: (3, 2, 0, 0, 1, "copy", "c"), 9: (1, 1, 0, 0, None, "usable", "a")}
    assert spark.read.parquet(str(tmp_path / "out" / "observations")).count() == 48


def test_a_batch_taken_again_changes_nothing(spark, tmp_path):
    deliver(spark, tmp_path / "in", [(1, ROW.format(year=1999), "a", "en"), (2, "x", "b", "en"), (3, ROW.format(year=1999), "b", "en")])
    first = intake(spark, tmp_path)
    batch = spark.read.parquet(str(tmp_path / "in"))
    delivery_intake.take(spark, batch, 0, str(tmp_path / "out"))
    assert intake(spark, tmp_path) == first
    assert spark.read.parquet(str(tmp_path / "out" / "observations")).count() == 12


def test_many_copies(spark, tmp_path):
    deliver(spark, tmp_path / "in", [(i, "same" if i % 3 == 0 else f"t{i}", "a", "en") for i in range(300)])
    found = intake(spark, tmp_path)
    assert len(found) == 300 and sum(v[4] == 0 for v in found.values()) == 99 and {v[5] for v in found.values()} == {"empty"}


def test_no_deliveries_yet(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "in"))
    assert intake(spark, tmp_path) == {}


@needs_tables
def test_report_by_periods(spark, tmp_path, caplog):
    """Two periods that overlap, one after the other, give what one run over both gives; the rest of the output stays."""
    config = lambda out, start, end: gage_report.Config(SF_DIR, str(tmp_path / out), start, end)
    rows = lambda out: sorted(map(repr, gage_report.result(spark, str(tmp_path / out)).collect()))
    gage_report.run(spark, config("whole", "1995-02-01", "1996-12-01"))
    with caplog.at_level(logging.INFO, "jobs.gage_report"):
        for period in (("1995-02-01", "1996-03-01"), ("1995-11-01", "1996-12-01"), ("1995-11-01", "1996-12-01")):
            gage_report.run(spark, config("parts", *period))
    assert rows("parts") == rows("whole") and rows("whole")
    assert sum("read" in r.getMessage() for r in caplog.records) == 3 and sum("wrote" in r.getMessage() for r in caplog.records) == 6
    assert (tmp_path / "parts" / "months" / "year=1995" / "month=2").is_dir() and list((tmp_path / "parts" / "gages").glob("grade=*"))


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else str(value)[:10] if hasattr(value, "year") else value


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("part", "supplier", "nation", "lineitem", "documents"):
        duck.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    relation = duck.sql(queries.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want and want


def test_options(tmp_path):
    file = tmp_path / "c.toml"
    shutil.copy(Path(gage_report.__file__).with_suffix(".toml"), file)
    held = common.options(gage_report.Config, ["--config", str(file), "--tables", "t", "--out", "o", "--high", "3"], "x")
    assert (held.tables, held.out, held.high, held.low, held.start) == ("t", "o", 3.0, 0.5, "1995-02-01")
    held = common.options(delivery_intake.Config, ["--config", str(Path(delivery_intake.__file__).with_suffix(".toml")), "--deliveries", "d", "--out", "o", "--checkpoint", "c"], "x")
    assert held.files_per_batch == 1000
    file.write_text("oops = 1\n")
    for argv in (["--config", str(file), "--tables", "t", "--out", "o"], ["--tables", "t"]):
        with pytest.raises(SystemExit):
            common.options(gage_report.Config, argv, "x")
