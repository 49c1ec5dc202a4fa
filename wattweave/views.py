"""Meter, weather and state views over the ``events`` table, in Spark and, as a prefix of oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# circuit -> end-use category; a circuit may count in two.
CIRCUITS = (("click", "user"), ("click", "scheduled"), ("view", "C"), ("purchase", "H"), ("signup", "lights"), ("error", "always_on"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, ts, circuit, kw, seq."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("uid"), "ts", F.col("event_type").alias("circuit"), F.col("value").alias("kw"), F.col("event_id").alias("seq"))


def circuit_category(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CIRCUITS, "circuit string, category string")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = readings(spark, sf_dir).agg(F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("uid", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("kw").alias("obs"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, ts of every hour of every user."""
    span = readings(spark, sf_dir).agg(F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b"))  # one row
    users = readings(spark, sf_dir).select("uid").distinct().crossJoin(F.broadcast(span))
    return users.select("uid", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))


def hourly_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, ts, obs of every hour of every user: null in an hour without readings.

    Only hours with readings are shuffled; each then fills the hours up to the
    user's next one, so a user's hours stand in one partition and what is done by
    user needs no further shuffle. An hour without a place, and readings without
    a user, count nowhere, but their user has all hours.
    """
    hour, rows = F.date_trunc("hour", "ts"), readings(spark, sf_dir)
    span = rows.agg(F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b"))  # one row
    known = F.col("uid").isNotNull() & F.col("ts").isNotNull()
    sums = rows.crossJoin(F.broadcast(span)).groupBy("uid", F.coalesce(hour, "a").alias("ts"), "a", "b").agg(F.sum(F.when(known, F.col("kw"))).alias("kw"))
    step = F.expr("interval 1 hour")
    by = Window.partitionBy("uid").orderBy("ts")
    begin = F.when(F.lag("ts").over(by).isNull(), F.col("a")).otherwise(F.col("ts"))
    end = F.coalesce(F.lead("ts").over(by) - step, "b")
    dealt = sums.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid")
    filled = dealt.select("uid", F.col("ts").alias("at"), "kw", F.sequence(begin, end, step).alias("hours")).select("uid", F.explode("hours").alias("ts"), "at", "kw")
    return filled.select("uid", "ts", F.when(F.col("ts") == F.col("at"), F.col("kw")).alias("obs"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, ts, obs without gaps: an hour without readings is 0."""
    return hourly_gaps(spark, sf_dir).withColumn("obs", F.coalesce("obs", F.lit(0.0)))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, temperature_f: 40..100 by an integer formula of day and hour."""
    return hours(spark, sf_dir).withColumn("temperature_f", (40 + (F.dayofmonth("ts") * 7 + F.hour("ts") * 5) % 61).cast("double"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, ts, obs, temperature_f, state by level of load."""
    level = F.when(F.col("obs") < 1, 1).when(F.col("obs") < 300, 2).otherwise(3)
    return hourly(spark, sf_dir).join(weather(spark, sf_dir), "ts").withColumn("state", level)


SQL = """
WITH readings AS (SELECT user_id AS uid, ts, event_type AS circuit, value AS kw, event_id AS seq FROM events),
circuit_category AS (SELECT * FROM (VALUES ('click','user'),('click','scheduled'),('view','C'),('purchase','H'),('signup','lights'),('error','always_on')) t(circuit, category)),
hours AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS ts),
gappy AS (SELECT uid, date_trunc('hour', ts) AS ts, sum(kw) AS obs FROM readings GROUP BY 1, 2),
grid AS (SELECT u.uid, h.ts FROM (SELECT DISTINCT uid FROM readings) u CROSS JOIN hours h),
hourly AS (SELECT g.uid, g.ts, coalesce(y.obs, 0.0) AS obs FROM grid g LEFT JOIN gappy y ON y.uid = g.uid AND y.ts = g.ts),
weather AS (SELECT ts, CAST(40 + (day(ts) * 7 + hour(ts) * 5) % 61 AS DOUBLE) AS temperature_f FROM hours),
states AS (SELECT h.uid, h.ts, h.obs, w.temperature_f, CASE WHEN h.obs < 1 THEN 1 WHEN h.obs < 300 THEN 2 ELSE 3 END AS state FROM hourly h JOIN weather w ON w.ts = h.ts)
"""
