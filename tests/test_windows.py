"""Windows on counts and fractions that double precision rounds."""

from __future__ import annotations

import pytest

from wattweave.operators import windows


@pytest.mark.parametrize("n, train", [(90, 63), (10, 7), (700, 490), (719, 503)])
def test_split_takes_the_fraction_as_written(spark, n, train):
    rows = spark.range(n).selectExpr("1 AS uid", "id AS ts")
    assert windows.train_test_split_by_time(rows, 0.7).where("is_train").count() == train
