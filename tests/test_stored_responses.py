"""Enrolment reads the stored responses: hours are made once, not for each step that asks for them."""

from __future__ import annotations

from wattweave import queries

DATA = "/root/testdata/sf0.001"


def test_goal_match_makes_hours_once(spark):
    assert "events.parquet" not in queries.goal_match(spark, DATA)._jdf.queryExecution().toString()
