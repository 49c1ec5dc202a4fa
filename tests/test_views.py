"""The views against plain SQL on readings with odd rows, and what their plans shuffle."""

from __future__ import annotations

import datetime as dt

import pytest
from compare import connection, difference
from pyspark.sql import functions as F

from wattweave import views


def _events(spark, folder, rows):
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spark.createDataFrame([(i, at(h), u, "click", v, "") for i, (h, u, v) in enumerate(rows)], kind).coalesce(1).write.parquet(f"{folder}/parts")
    spark.read.parquet(f"{folder}/parts").toPandas().to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize(
    "rows",
    [
        [(2.5, 1, 3.0), (2.7, 1, 4.0), (5.1, 1, None), (9.9, 2, 1.0), (None, 2, 7.0), (None, 3, 2.0), (4.0, None, 8.0), (0.2, 4, 5.0), (None, 4, 6.0)],
        [(3.0, 1, 2.0)],
        [(None, 1, 2.0), (None, None, 1.0)],
    ],
)
def test_hours_of_odd_readings(spark, tmp_path, rows):
    d = _events(spark, tmp_path, rows)
    assert difference(views.hourly(spark, d), connection(d), views.SQL + "SELECT * FROM hourly") == ""


def test_what_is_done_by_user_shuffles_no_hours(spark, tmp_path):
    d = _events(spark, tmp_path, [(float(h), u, 1.0) for h in (0, 700) for u in range(50)])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more readings than are broadcast
    try:
        summed = views.hourly(spark, d).groupBy("uid").agg(F.count("obs").alias("n"), F.sum("obs").alias("s"))
        plan = summed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan[: plan.index("explode(")]  # a plan prints its last step first
        assert summed.where("n = 701 AND s = 2").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
