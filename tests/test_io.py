"""Sources and sinks, streaming, and jobs whose result depends on the schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wattweave.operators import clean, resample
from wattweave.plans import interpret
from wattweave.sources import ingest, sinks
from wattweave.streaming import hourly_stream


def test_meter_tree(spark, tmp_path):
    for year, uid in ((2012, "a"), (2013, "b")):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / f"{uid}.csv").write_text("localminute,use\n2012-01-01 00:00:00,1.5\n")
    rows = ingest.read_meter_tree(spark, str(tmp_path), "localminute timestamp, use double").collect()
    assert sorted((r["year"], r["uid"], r["use"]) for r in rows) == [(2012, "a", 1.5), (2013, "b", 1.5)]


def test_device_channels(spark, tmp_path):
    for house, labels in (("house_1", "1 mains\n2 ac\n3 light\n"), ("house_2", "1 mains\n2 light\n")):
        (tmp_path / house).mkdir()
        (tmp_path / house / "labels.dat").write_text(labels)
        for ch in (1, 2):
            (tmp_path / house / f"channel_{ch}.dat").write_text(f"100 {ch}.5\n101 2.0\n")
    rows = ingest.redd_channels(spark, str(tmp_path), ["ac"]).collect()
    assert sorted({(r["house"], r["ch"], r["label"]) for r in rows}) == [("house_1", 1, "mains"), ("house_1", 2, "ac")] and len(rows) == 4


def test_usage_and_models_come_back(spark, tmp_path):
    df = spark.createDataFrame([("hour", 2012, 1.0), ("hour", 2013, 2.0)], "grain string, year int, kw double")
    path = f"{tmp_path}/usage"
    sinks.write_usage(df, path)
    sinks.write_usage(df.where("year = 2013").withColumn("kw", F.lit(5.0)), path)
    assert sorted((r["year"], r["kw"]) for r in spark.read.parquet(path).collect()) == [(2012, 1.0), (2013, 5.0)]
    sinks.save_models({"model_init": df}, f"{tmp_path}/models")
    assert sinks.load_models(spark, f"{tmp_path}/models", ["model_init"])["model_init"].count() == 2
    new = sinks.write_new_tables_only(df, f"{tmp_path}/zips", "year")
    assert new.count() == 2 and sinks.write_new_tables_only(df, f"{tmp_path}/zips", "year").count() == 0
    assert spark.read.parquet(f"{tmp_path}/zips").count() == 2
    filled = sinks.fill_states(spark.createDataFrame([(1, 2, 0.5)], "uid int, state int, pi double"), 3, ["pi"])
    assert sorted((r["state"], r["pi"]) for r in filled.collect()) == [(1, 0.0), (2, 0.5), (3, 0.0)]


def test_hourly_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 10), 2.0), (1, dt.datetime(2024, 1, 1, 0, 50), 3.0), (1, dt.datetime(2024, 1, 1, 9), 1.0)]
    df = spark.createDataFrame(rows, "uid int, ts timestamp, kw double")
    df.write.parquet(f"{tmp_path}/in")
    stream = hourly_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["uid"], r["obs"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 5.0, 2)]


def test_imputation_fills_what_can_be_told(spark):
    rows = [(float(i), float(2 * i) if i % 7 else None, None) for i in range(1, 80)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = clean.impute_regression(df, ["a", "b"], rounds=1, trees=5)
    assert out.where("b IS NULL").count() == 0 and out.columns == df.columns
    assert clean.impute_regression(df, ["b"], method="none").where("b IS NULL").count() == 11
    left = clean.drop_sparse_columns(df, 0.5)
    assert left.columns == ["a", "b"] and clean.drop_sparse_columns(df.where("false"), 0.5).columns == []


def test_weather_to_grids(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), 50.0 + i if i != 3 else 999.0, i) for i in range(13)]
    df = spark.createDataFrame(rows, "station string, ts timestamp, temperature double, seq long")
    out = {(r["grain"], r["ts"].hour, r["ts"].minute): r["temperature"] for r in resample.weather_to_grids(df, ["temperature"], {"temperature": (2, 125)}, order="seq").collect()}
    assert abs(out["15min", 0, 30] - (53 + 0.7)) < 1e-6 and ("hour", 1, 0) in out


def test_profiles_of_models(spark):
    k = [(1, i, j, 0.0, 0.0) for i in (1, 2) for j in (1, 2)]
    models = {
        "model_transition": spark.createDataFrame(k, "uid int, from int, to int, b0 double, b1 double"),
        "model_init": spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "uid int, state int, pi double"),
        "model_response": spark.createDataFrame([(1, 1, 1.0, 2.0, 0.1, 0.2), (1, 2, 3.0, 4.0, 0.1, 0.2)], "uid int, state int, intercept double, slope double, sd double, se_slope double").withColumn("se_intercept", F.lit(0.3)),
    }
    forecast = spark.createDataFrame([(h, 10.0 + h) for h in range(3)], "hour int, t double")
    got = {(r["kind"], r["hour"]): r["mu"] for r in interpret.compute_profiles(models, forecast).collect()}
    assert len(got) == 9 and got["volatility", 1] == 0.0 and abs(got["slope", 0] - 3.0) < 1e-9 and abs(got["baseload", 2] - 2.0) < 1e-9


def test_jdbc_slices_and_weather_tables(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/meters;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, float(i), i % 3) for i in range(9)], "id int, kw double, part int")
    df.write.jdbc(url, "readings", properties={"driver": driver})
    rows = ingest.read_jdbc_slice(spark, url, "readings", ['"part" = 0', '"part" = 1'], ['"id"', '"kw"', '"part"'], driver=driver)
    assert rows.rdd.getNumPartitions() == 2 and sorted(r["id"] for r in rows.collect()) == [0, 1, 3, 4, 6, 7]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS place LOCATION '{tmp_path}/place'")
    sinks.write_weather_table(df.withColumnRenamed("part", "zip"), "place.weather")
    sinks.write_weather_table(df.where("part = 1").withColumnRenamed("part", "zip"), "place.weather")
    assert {r["zip"] for r in spark.table("place.weather").collect()} == {1}
    spark.sql("DROP DATABASE place CASCADE")


def test_pushed_filter_and_kept_partitions(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/orders;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, float(i), i % 3) for i in range(9)], "id int, kw double, part int")
    df.write.jdbc(url, "readings", properties={"driver": driver})
    rows = ingest.read_jdbc_slice(spark, url, "readings", ['"id" < 5', '"id" >= 5'], ['"id"', '"kw"'], driver=driver).where("kw > 3")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(kw), *GreaterThan(kw,3.0)]" in plan and "part" not in plan
    assert sorted(r["id"] for r in rows.collect()) == [4, 5, 6, 7, 8]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path}/kept'")
    table = df.withColumnRenamed("part", "zip")
    files = lambda z: sorted(p.name for p in (tmp_path / "kept" / "weather" / f"zip={z}").glob("*.parquet"))
    sinks.write_weather_table(table, "kept.weather", replace="partitions")
    before = {z: files(z) for z in range(3)}
    sinks.write_weather_table(table.where("zip = 1").withColumn("kw", F.col("kw") + 100), "kept.weather", replace="partitions")
    assert files(0) == before[0] and files(2) == before[2] and files(1) != before[1]
    assert {(r["zip"], r["kw"] >= 100) for r in spark.table("kept.weather").collect()} == {(0, False), (1, True), (2, False)}
    spark.sql("DROP DATABASE kept CASCADE")


def test_consumers_keep_all_their_rows(spark):
    info = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (2, "b", 10), (1, "b", 12), (None, "a", 13)], "per int, sp string, zip int")
    ids = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a")], "per int, sp string")
    kept = ingest.consumer_key_table(ids, info, ["per", "sp"])
    assert sorted(r["zip"] for r in kept.collect()) == [10, 10, 11] and sorted(r["zip"] for r in ingest.consumer_places(kept).collect()) == [10, 11]


def test_holidays(spark):
    from wattweave.functions import calendar as T

    years = spark.createDataFrame([(y,) for y in (1997, 2000, 2021, 2022, 2024, 2025, None, 2024)], "year int")
    got = {(r["name"], r["day"].year): str(r["day"]) for r in T.holidays(years).collect()}
    want = {
        ("good_friday", 2000): "2000-04-21", ("good_friday", 2024): "2024-03-29", ("good_friday", 2025): "2025-04-18", ("good_friday", 2021): "2021-04-02",
        ("memorial", 2024): "2024-05-27", ("thanksgiving", 2024): "2024-11-28", ("labor", 2025): "2025-09-01", ("presidents", 2022): "2022-02-21", ("king", 2000): "2000-01-17",
        ("independence", 2021): "2021-07-05", ("christmas", 2021): "2021-12-24", ("christmas", 2022): "2022-12-26", ("juneteenth", 2022): "2022-06-20", ("new_year", 2000): None,
        ("king", 1997): None, ("juneteenth", 2021): None,
    }
    for key, day in want.items():
        assert got.get(key) == day, key
