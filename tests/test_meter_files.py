"""A tree of meter files is <year>/<uid>.csv: no folder for each meter, and every row comes back."""

from __future__ import annotations

import pytest

from wattweave import queries
from wattweave.sources import ingest, sinks

DATA = "/root/testdata/sf0.001"


def test_tree_and_back(spark, tmp_path):
    rows = [(2012, "a", "2012-01-01 00:00:00", 1.5, "x, \"y\""), (2012, "a", "2012-01-02 00:00:00", None, None), (2013, "a", "2013-01-01 00:00:00", 2.5, "z"), (2013, None, None, None, None), (None, "b", None, 4.0, "w")]
    df = spark.createDataFrame(rows, "year int, uid string, localminute string, kw double, note string").repartition(3)
    assert sinks.write_meter_tree(df, f"file://{tmp_path}/t") == 4
    assert sorted(str(f.relative_to(tmp_path / "t")) for f in (tmp_path / "t").rglob("*.csv")) == ["2012/a.csv", "2013/a.csv", "2013/null.csv", "null/b.csv"]
    back = ingest.read_meter_tree(spark, f"{tmp_path}/t", "localminute string, kw double, note string", r"(\d{4}|null)/([^/]+)\.csv$")
    got = [(r["year"], r["uid"], r["localminute"], r["kw"], r["note"]) for r in back.collect()]
    assert sorted(got, key=repr) == sorted([(y, u or "null", *rest) for y, u, *rest in rows], key=repr)
    assert sinks.write_meter_tree(df.where("false"), f"{tmp_path}/none") == 0
    with pytest.raises(Exception, match="no file name"):
        sinks.write_meter_tree(df.selectExpr("year", "'../a' AS uid", "kw"), f"{tmp_path}/u")


def test_query_makes_no_folder_for_a_meter(spark, monkeypatch):
    paths, read = [], ingest.read_meter_tree
    monkeypatch.setattr(ingest, "read_meter_tree", lambda s, path, *a: paths.append(path) or read(s, path, *a))
    assert queries.read_meter_tree(spark, DATA).count() == 15
    files = read(spark, paths[0], "line string").inputFiles()
    assert len(files) == 15 and len({f.rsplit("/", 1)[0] for f in files}) == 1
