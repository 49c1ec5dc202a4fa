"""Queries over the given tables, one or more for each operator, with DuckDB SQL for the same rows.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattweave import views as V
from wattweave.functions import calendar as T
from wattweave.functions.vectors import square_distance
from wattweave.operators import clean as C
from wattweave.operators import describe as A
from wattweave.operators import joins as J
from wattweave.operators import resample as R
from wattweave.operators import reshape as S
from wattweave.operators import windows as W
from wattweave.plans import chains, curves, families, interpret, ranking, regimes, segments, selection
from wattweave.sources import ingest, sinks
from wattweave.spread import ordered_rank
from wattweave.storage import cut_lineage, shared_path
from wattweave.streaming import rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a function under its name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if base and text.startswith("WITH RECURSIVE "):
                text = V.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + text[15:]
            elif base:
                text = V.SQL + (", " + text[5:] if text[:5].upper() == "WITH " else text)
            ORACLES[f.__name__] = text
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# ---- flagship -------------------------------------------------------------------------------------------------------


@query("""
SELECT uid, CASE WHEN hour(h.ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(h.ts) BETWEEN 12 AND 18 THEN 'Afternoon' WHEN hour(h.ts) BETWEEN 19 AND 21 THEN 'Evening' ELSE 'Night' END AS time_of_day,
       dayofweek(h.ts) IN (0, 6) AS is_holiday, count(*) AS n_hours, round(avg(obs), 6) AS mean_obs, round(regr_slope(obs, temperature_f - 65), 6) AS slope
FROM hourly h JOIN weather w ON h.ts = w.ts GROUP BY ALL
""")
def load_by_time_of_day(spark, d):
    rows = T.calendar_features(J.join_weather(V.hourly(spark, d), V.weather(spark, d)))
    rows = rows.withColumns({"t_d": T.degree_offset(F.col("temperature_f")), "time_of_day": T.time_of_day(F.col("ts"))})
    return rows.groupBy("uid", "time_of_day", "is_holiday").agg(
        F.count(F.lit(1)).alias("n_hours"), r6(F.avg("obs"), "mean_obs"), r6(F.regr_slope("obs", "t_d"), "slope")
    )


# ---- sources --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30)", base=False)
def pending_entities(spark, d):
    todo = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    done = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.pending_entities(todo, done, ["o_orderkey"])


@query("SELECT DISTINCT uid FROM readings")
def distinct_entities(spark, d):
    return ingest.distinct_entities(V.readings(spark, d))


@query("SELECT uid, ts, kw, CAST(NULL AS VARCHAR) AS circuit, 2023 AS year FROM readings WHERE kw < 200 UNION ALL SELECT uid, ts, kw, circuit, 2024 FROM readings WHERE kw >= 200")
def union_years(spark, d):
    rows = V.readings(spark, d).drop("seq")
    return ingest.union_years({2024: rows.where("kw >= 200"), 2023: rows.where("kw < 200").drop("circuit")})


@query("""
WITH i AS (SELECT uid, row_number() OVER (ORDER BY uid) n FROM (SELECT DISTINCT uid FROM readings)), m AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) n FROM (SELECT DISTINCT n_name FROM nation))
SELECT uid, name FROM i JOIN m USING (n)
""")
def assign_display_names(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"))
    return ingest.assign_display_names(V.readings(spark, d), names)


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", base=False)
def consumer_key_table(spark, d):
    """Orders of customers with a balance: an info table with several rows for a key."""
    info = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    ids = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return ingest.consumer_key_table(ids, info, ["o_custkey"])


@query("SELECT DISTINCT c_nationkey AS zip FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", base=False)
def consumer_places(spark, d):
    info = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("zip"))
    ids = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return ingest.consumer_places(ingest.consumer_key_table(ids, info, ["c_custkey"]))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 50000 GROUP BY 1", base=False)
def read_jdbc_slice(spark, d):
    """Orders stored in an embedded database (of this JVM: a local master) and read in four slices of their keys; filter and columns go to the database."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    orders.coalesce(1).write.jdbc(url, "orders", properties={"driver": driver})
    lo, hi = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    cuts = [lo + (hi + 1 - lo) * i // 4 for i in range(5)] if lo is not None else [0, 1]
    slices = [f'"o_orderkey" >= {a} AND "o_orderkey" < {b}' for a, b in zip(cuts, cuts[1:], strict=False)]
    rows = ingest.read_jdbc_slice(spark, url, "orders", slices, ['"o_orderkey"', '"o_custkey"', '"o_totalprice"'], driver=driver)
    return rows.where("o_totalprice > 50000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CAST(day(ts) % 5 AS INTEGER) AS zip, count(*) AS n, round(sum(temperature_f + CASE WHEN day(ts) % 5 = 2 THEN 1 ELSE 0 END), 3) AS total FROM weather GROUP BY 1")
def write_weather_table(spark, d):
    """Weather as a catalog table by place; then one place is written anew, and all are read back by name."""
    name = f"wattweave_{uuid.uuid4().hex}"
    rows = V.weather(spark, d).withColumn("zip", F.dayofmonth("ts") % 5)
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_path(spark, 'weather')}'")
    try:
        sinks.write_weather_table(rows, f"{name}.weather", replace="partitions")
        sinks.write_weather_table(rows.where("zip = 2").withColumn("temperature_f", F.col("temperature_f") + 1), f"{name}.weather", replace="partitions")
        back = cut_lineage(spark.table(f"{name}.weather"))
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return back.groupBy("zip").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("temperature_f"), 3).alias("total"))


@query("SELECT DISTINCT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM readings), (SELECT max(CAST(ts AS DATE)) FROM readings), INTERVAL 1 DAY)) AS DATE) AS day")
def date_calendar(spark, d):
    a, b = V.readings(spark, d).agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return ingest.date_calendar(spark, str(a), str(b), range(1, 13))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="(\w+)"', 1) AS station, regexp_extract_all(html, '<a href="/([^"]+)"', 1) AS links, try_cast(nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') AS DOUBLE) AS lat,
             try_cast(nullif(regexp_extract(html, '<!-- ad (\d+) -->', 1), '') AS DOUBLE) AS lon, try_cast(nullif(regexp_extract(html, 'charset="utf-(\d+)"', 1), '') AS DOUBLE) AS elev FROM pages),
u AS (SELECT page_id, station, lat, lon, elev, unnest(links) AS nearby, generate_subscripts(links, 1) AS i FROM p), f AS (SELECT page_id, station, lat, lon, elev, nearby, min(i) AS i FROM u GROUP BY ALL)
SELECT page_id, nullif(station, '') AS station, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, nearby, lat, lon, elev FROM f
UNION ALL SELECT page_id, nullif(station, ''), NULL, NULL, lat, lon, elev FROM p WHERE len(links) = 0
""", base=False)
def station_pages_extract(spark, d):
    return ingest.station_pages_extract(
        spark.read.parquet(f"{d}/pages.parquet"), r'<html lang="(\w+)"', r'<a href="/([^"]+)"', r"track\((\d+)\)", r"<!-- ad (\d+) -->", r'charset="utf-(\d+)"'
    )


@query(r"""
WITH t AS (SELECT uid AS page_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || CAST(seq AS VARCHAR) || ',', chr(10) ORDER BY seq) AS body FROM readings GROUP BY 1 HAVING count(*) >= 5)
SELECT uid AS page_id, date_trunc('second', ts) AS ts, CAST(seq AS DOUBLE) AS seq FROM readings WHERE uid IN (SELECT page_id FROM t)
""")
def station_day_parse(spark, d):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.col("seq").cast("string"), F.lit(",<br />"))
    pages = V.readings(spark, d).groupBy(F.col("uid").alias("page_id")).agg(F.concat(F.lit("Time,seq,<br />\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
    return ingest.station_day_parse(pages, ["seq"])


@query("SELECT uid, CAST(day AS DATE) AS day, priority FROM (SELECT uid, CAST(ts AS DATE) AS day, seq AS priority, row_number() OVER (PARTITION BY uid, CAST(ts AS DATE) ORDER BY seq) AS n FROM readings WHERE length(circuit) > 4) WHERE n = 1")
def station_failover(spark, d):
    pages = V.readings(spark, d).select("uid", F.to_date("ts").alias("day"), F.col("seq").alias("priority"), "circuit")
    return ingest.station_failover(pages, 4, ["uid", "day"], "priority", "circuit").drop("circuit")


# ---- cleaning -------------------------------------------------------------------------------------------------------


@query("SELECT seq, CASE WHEN kw BETWEEN 5 AND 400 THEN kw END AS kw FROM readings")
def null_out_of_range(spark, d):
    return C.null_out_of_range(V.readings(spark, d).select("seq", "kw"), {"kw": (5, 400)})


@query("""
WITH q AS (SELECT uid, quantile_cont(kw, 0.05) AS a, quantile_cont(kw, 0.95) AS b FROM readings GROUP BY 1)
SELECT seq, r.uid, CASE WHEN kw BETWEEN a AND b THEN kw END AS kw FROM readings r JOIN q ON q.uid = r.uid
""")
def trim_quantiles(spark, d):
    return C.trim_quantiles(V.readings(spark, d).select("seq", "uid", "kw"), ["kw"], "uid", 0.05, 0.95)


@query("SELECT seq, CASE WHEN kw <= 100 THEN kw END AS kw FROM readings")
def cap_to_null(spark, d):
    return C.cap_to_null(V.readings(spark, d).select("seq", "kw"), ["kw"])


@query("""
WITH c AS (SELECT uid, circuit FROM readings GROUP BY 1, 2 HAVING max(abs(kw)) > 0), u AS (SELECT uid FROM c GROUP BY 1 HAVING count(*) >= 5)
SELECT seq, uid, circuit FROM readings r WHERE EXISTS (SELECT 1 FROM c WHERE c.uid = r.uid AND c.circuit = r.circuit) AND uid IN (SELECT uid FROM u)
""")
def drop_empty_columns(spark, d):
    return C.drop_empty_columns(V.readings(spark, d), 5).select("seq", "uid", "circuit")


@query("SELECT avg(CASE WHEN kw > 100 THEN 1.0 ELSE 0.0 END) > 0.5 AS kw_dropped, stddev_samp(uid) > 0 AS uid_kept, count(*) AS n FROM readings")
def drop_columns(spark, d):
    rows = C.cap_to_null(V.readings(spark, d), ["kw"]).withColumn("one", F.lit(1.0))
    left = C.drop_constant_columns(C.drop_sparse_columns(rows, 0.5), ["uid", "one"])
    return left.agg(F.lit("kw" not in left.columns).alias("kw_dropped"), F.lit("uid" in left.columns and "one" not in left.columns).alias("uid_kept"), F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT seq, CASE WHEN kw <= 100 THEN kw END AS kw, CASE WHEN uid <= 50 THEN uid END AS uid FROM readings) SELECT count(*) FILTER (kw IS NOT NULL OR uid IS NOT NULL) AS some, count(*) FILTER (kw IS NOT NULL AND uid IS NOT NULL) AS complete FROM t")
def complete_cases(spark, d):
    t = C.cap_to_null(V.readings(spark, d), ["kw"]).withColumn("uid", F.when(F.col("uid") <= 50, F.col("uid")))
    some = C.drop_all_null_rows(t, ["kw", "uid"]).agg(F.count(F.lit(1)).alias("some"))
    return some.crossJoin(C.complete_cases(t, ["kw", "uid"]).agg(F.count(F.lit(1)).alias("complete")))


@query("SELECT uid, date_trunc('hour', ts) AS hour, arg_min(kw, seq) AS kw, min(seq) AS seq FROM readings GROUP BY 1, 2")
def dedupe_timestamps(spark, d):
    rows = V.readings(spark, d).select("uid", F.date_trunc("hour", "ts").alias("hour"), "kw", "seq")
    return C.dedupe_timestamps(rows, ["uid", "hour"], "seq")


@query("SELECT uid, seq FROM readings WHERE uid IN (SELECT uid FROM readings GROUP BY 1 HAVING count(*) >= 66)")
def min_history(spark, d):
    return C.min_history(V.readings(spark, d).select("uid", "seq"), "uid", 66)


@query("""
WITH c AS (SELECT r.uid, r.seq, k.category FROM readings r JOIN circuit_category k USING (circuit))
SELECT uid, seq, category FROM c WHERE uid IN (SELECT uid FROM c WHERE category IN ('C', 'H')) AND uid IN (SELECT uid FROM c WHERE category = 'user')
""")
def require_hvac(spark, d):
    rows = V.readings(spark, d).join(V.circuit_category(spark), "circuit").select("uid", "seq", "category")
    return C.require_hvac(rows, total="user")


@query("WITH g AS (SELECT uid, CAST(ts AS DATE) AS day, kw, seq FROM readings), ok AS (SELECT uid FROM g GROUP BY 1 HAVING max(kw) > min(kw)) SELECT uid, seq FROM g WHERE uid IN (SELECT uid FROM ok)")
def reject_degenerate(spark, d):
    return C.reject_degenerate(V.readings(spark, d), "uid", "kw").select("uid", "seq")


@query("SELECT seq FROM readings WHERE dayofweek(ts) NOT IN (0, 6) AND month(ts) NOT BETWEEN 4 AND 10")
def select_data(spark, d):
    return C.select_data(V.readings(spark, d), include_weekends=False, seasons=["Winter"]).select("seq")


@query("SELECT ts, temperature_f AS \"TemperatureF\" FROM weather")
def rename_covariates(spark, d):
    return C.rename_covariates(V.weather(spark, d), {"temperature_f": "TemperatureF"})


@query("""
WITH s AS (SELECT g.uid, g.ts, y.obs, row_number() OVER (PARTITION BY g.uid ORDER BY g.ts) AS i FROM grid g LEFT JOIN gappy y ON y.uid = g.uid AND y.ts = g.ts),
k AS (SELECT *, last_value(CASE WHEN obs IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value(obs IGNORE NULLS) OVER b AS va,
      first_value(CASE WHEN obs IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib, first_value(obs IGNORE NULLS) OVER f AS vb FROM s
      WINDOW b AS (PARTITION BY uid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY uid ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT uid, ts, round(coalesce(obs, CASE WHEN ib - ia - 1 <= 12 THEN va + (vb - va) * (i - ia) / (ib - ia) END), 6) AS obs FROM k
WHERE coalesce(obs, CASE WHEN ib - ia - 1 <= 12 THEN va + (vb - va) * (i - ia) / (ib - ia) END) IS NOT NULL
""")
def gap_fill(spark, d):
    return C.gap_fill(V.hourly_gaps(spark, d), "obs").select("uid", "ts", r6("obs", "obs"))


@query("""
WITH RECURSIVE s AS MATERIALIZED (SELECT g.uid, g.ts, y.obs, row_number() OVER (PARTITION BY g.uid ORDER BY g.ts) AS i FROM grid g LEFT JOIN gappy y ON y.uid = g.uid AND y.ts = g.ts),
k AS MATERIALIZED (SELECT uid, i, obs, row_number() OVER w AS n, count(*) OVER (PARTITION BY uid) AS total, i - lag(i) OVER w AS h0, lead(i) OVER w - i AS h1, (obs - lag(obs) OVER w) / (i - lag(i) OVER w) AS s0, (lead(obs) OVER w - obs) / (lead(i) OVER w - i) AS s1
      FROM s WHERE obs IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY i)),
fw AS (SELECT uid, n, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS rt FROM k WHERE n = 1
  UNION ALL SELECT k.uid, k.n, h1 / (2 * (h0 + h1) - h0 * up), (6 * (s1 - s0) - h0 * rt) / (2 * (h0 + h1) - h0 * up) FROM fw JOIN k ON k.uid = fw.uid AND k.n = fw.n + 1 WHERE k.n < total),
fm AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT uid, n, CAST(0 AS DOUBLE) AS m FROM k WHERE n = total UNION ALL SELECT fm.uid, fm.n, rt - up * m FROM bw JOIN fm ON fm.uid = bw.uid AND fm.n = bw.n - 1),
b AS (SELECT k.uid, k.i, m FROM k JOIN bw ON bw.uid = k.uid AND bw.n = k.n),
j AS (SELECT s.*, m FROM s LEFT JOIN b ON b.uid = s.uid AND b.i = s.i),
v AS (SELECT *, last_value(CASE WHEN obs IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, last_value(obs IGNORE NULLS) OVER a AS va, last_value(m IGNORE NULLS) OVER a AS ma,
      first_value(CASE WHEN obs IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib, first_value(obs IGNORE NULLS) OVER f AS vb, first_value(m IGNORE NULLS) OVER f AS mb FROM j
      WINDOW a AS (PARTITION BY uid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY uid ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, (i - ia) / (ib - ia) AS t FROM v)
SELECT uid, ts, round(coalesce(obs, va + (vb - va) * t + ((pow(1 - t, 3) - (1 - t)) * ma + (pow(t, 3) - t) * mb) * pow(ib - ia, 2) / 6), 4) AS obs FROM c WHERE obs IS NOT NULL OR ib - ia - 1 <= 12
""")
def gap_fill_spline(spark, d):
    return C.gap_fill(V.hourly_gaps(spark, d), "obs", method="spline").select("uid", "ts", F.round("obs", 4).alias("obs"))


@query("""
WITH o AS (SELECT circuit AS station, date_trunc('hour', ts) AS ts, avg(kw) AS v FROM readings GROUP BY 1, 2), n AS (SELECT *, lead(ts) OVER (PARTITION BY station ORDER BY ts) AS nt, lead(v) OVER (PARTITION BY station ORDER BY ts) AS nv FROM o),
g AS (SELECT station, v, nv, ts AS t0, nt, unnest(generate_series(ts, coalesce(nt - INTERVAL 1 SECOND, ts), INTERVAL 15 MINUTE)) AS ts FROM n)
SELECT station, ts, round(CASE WHEN ts = t0 THEN v ELSE v + (nv - v) * (epoch(ts) - epoch(t0)) / (epoch(nt) - epoch(t0)) END + 1e-9, 6) AS v FROM g
""")
def interpolate_to_grid(spark, d):
    rows = V.readings(spark, d).groupBy(F.col("circuit").alias("station"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("kw").alias("v"))
    return C.interpolate_to_grid(rows, ["v"], 900).withColumn("v", r6(F.col("v") + 1e-9))  # off the ties of rounding


@query("SELECT uid, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(*) FILTER (kw > 100) AS nulls_kw, round(count(*) FILTER (kw > 100) / count(*), 6) AS null_share FROM readings GROUP BY 1")
def missingness_report(spark, d):
    return C.missingness_report(C.cap_to_null(V.readings(spark, d), ["kw"]), "uid", ["kw"]).withColumn("null_share", r6("null_share"))


@query("""
WITH t AS (SELECT 'original' AS stage, kw FROM readings UNION ALL SELECT 'cleaned', kw FROM readings WHERE kw <= 100)
SELECT 'kw' AS covariate, stage, CAST(CASE WHEN kw < 0 THEN 0 WHEN kw >= 500 THEN 11 ELSE floor(kw / 50) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM t GROUP BY ALL
""")
def before_after_distribution(spark, d):
    rows = V.readings(spark, d).select("kw")
    return C.before_after_distribution(rows, C.cap_to_null(rows, ["kw"]), ["kw"], 0, 500, 10)


@query("SELECT seq, round(greatest(kw - 100, 0.0), 6) AS rate FROM readings")
def clip_negative_rates(spark, d):
    return C.clip_negative_rates(V.readings(spark, d).select("seq", (F.col("kw") - 100).alias("rate")), "rate").withColumn("rate", r6("rate"))


# ---- calendar -------------------------------------------------------------------------------------------------------


@query("SELECT seq, strftime(ts, '%a') AS day_of_week, CAST(month(ts) - 1 AS INTEGER) AS month0, CAST(hour(ts) AS INTEGER) AS hour, dayofweek(ts) IN (0, 6) AS is_holiday FROM readings")
def calendar_features(spark, d):
    return T.calendar_features(V.readings(spark, d)).select("seq", "day_of_week", "month0", "hour", "is_holiday")


def _sql_nth(month: int, weekday: int, n: int) -> str:
    """The nth weekday (0 Sunday .. 6) of a month of year y in DuckDB; the last for n = -1."""
    if n > 0:
        return f"make_date(y, {month}, 1) + CAST(({weekday} - dayofweek(make_date(y, {month}, 1)) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"
    return f"last_day(make_date(y, {month}, 1)) - CAST((dayofweek(last_day(make_date(y, {month}, 1))) - {weekday} + 7) % 7 AS INTEGER)"


def _sql_observed(month: int, day: int, saturday: str = "make_date(y, {m}, {d}) - 1") -> str:
    date = f"make_date(y, {month}, {day})"
    return f"CASE dayofweek({date}) WHEN 0 THEN {date} + 1 WHEN 6 THEN {saturday.format(m=month, d=day)} ELSE {date} END"


@query(f"""
WITH y AS (SELECT DISTINCT CAST(year(ts) AS INTEGER) + s AS y FROM readings, (SELECT unnest(generate_series(-30, 30)) AS s)),
c AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM c),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h), e AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM l),
d AS (SELECT {_sql_observed(1, 1, "NULL")} AS day FROM y UNION ALL SELECT {_sql_nth(1, 1, 3)} FROM y WHERE y >= 1998 UNION ALL SELECT {_sql_nth(2, 1, 3)} FROM y UNION ALL SELECT make_date(y, n // 31, n % 31 + 1) - 2 FROM e
  UNION ALL SELECT {_sql_nth(5, 1, -1)} FROM y UNION ALL SELECT {_sql_observed(6, 19)} FROM y WHERE y >= 2022 UNION ALL SELECT {_sql_observed(7, 4)} FROM y UNION ALL SELECT {_sql_nth(9, 1, 1)} FROM y
  UNION ALL SELECT {_sql_nth(11, 4, 4)} FROM y UNION ALL SELECT {_sql_observed(12, 25)} FROM y)
SELECT seq, s AS shift, dayofweek(t) IN (0, 6) OR CAST(t AS DATE) IN (SELECT day FROM d WHERE day IS NOT NULL) AS is_holiday
FROM (SELECT seq, s * 6 AS s, ts + to_years(CAST(s * 6 AS INTEGER)) + to_days(CAST(s * 37 AS INTEGER)) AS t FROM readings, (SELECT unnest(generate_series(-4, 4)) AS s))
""")
def holiday_features(spark, d):
    """Weekends and exchange holidays of all readings, as they are and moved through the seasons of sixty years."""
    rows = V.readings(spark, d).select("seq", "ts", F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("s"))
    rows = rows.withColumns({"shift": F.col("s") * 6, "ts": F.col("ts") + F.make_interval(years=F.col("s") * 6) + F.make_interval(days=F.col("s") * 37)})
    years = rows.select(F.year("ts").alias("year")).distinct()
    return T.calendar_features(rows, holidays=T.holidays(years)).select("seq", F.col("shift").cast("long").alias("shift"), "is_holiday")


@query("""
SELECT seq, CASE WHEN hour(ts) BETWEEN 6 AND 10 THEN 'Morning' WHEN hour(ts) BETWEEN 11 AND 18 THEN 'Afternoon' WHEN hour(ts) BETWEEN 19 AND 22 THEN 'Evening' ELSE 'Night' END AS long_night,
       CASE WHEN month(ts) BETWEEN 3 AND 11 THEN 'Summer' ELSE 'Winter' END AS season FROM readings
""")
def time_and_season(spark, d):
    return V.readings(spark, d).select("seq", T.time_of_day(F.col("ts"), "long_night").alias("long_night"), T.season(F.col("ts"), "mar_nov").alias("season"))


@query("SELECT ts, temperature_f - 65 AS t_d, CASE WHEN month(ts) IN (1, 2, 3, 10, 11, 12) THEN temperature_f - 65 ELSE 0.0 END AS winter_t_d FROM weather")
def degree_offset(spark, d):
    t = F.col("temperature_f")
    return V.weather(spark, d).select("ts", T.degree_offset(t).alias("t_d"), T.degree_offset(t, 65, F.col("ts"), (1, 2, 3, 10, 11, 12)).alias("winter_t_d"))


@query("SELECT seq, CAST(circuit = 'view' AS INTEGER) AS circuit_view, CAST(circuit = 'error' AS INTEGER) AS circuit_error FROM readings")
def dummy_code(spark, d):
    return T.dummy_code(V.readings(spark, d), "circuit", ["click", "view", "error"]).select("seq", "circuit_view", "circuit_error")


@query("SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS c_acctbal FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING max(least(greatest(c_acctbal, 0), 5000)) - min(least(greatest(c_acctbal, 0), 5000)) > 1e-6)", base=False)
def clamp_box(spark, d):
    return T.clamp_box(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal"), {"c_acctbal": (0.0, 5000.0)}, "c_nationkey").select("c_custkey", "c_acctbal")


# ---- resampling and reshaping ---------------------------------------------------------------------------------------


@query("SELECT uid, date_trunc('hour', ts) AS ts, round(CASE WHEN count(*) = count(*) FILTER (kw <= 100) THEN avg(kw) END, 6) AS kw FROM readings GROUP BY 1, 2")
def to_hourly(spark, d):
    return R.to_hourly(C.cap_to_null(V.readings(spark, d), ["kw"]), ["kw"]).withColumn("kw", r6("kw"))


@query("SELECT uid, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(avg(kw), 6) AS kw FROM readings GROUP BY 1, 2")
def to_xmin(spark, d):
    return R.to_xmin(V.readings(spark, d), ["kw"], 15).withColumn("kw", r6("kw"))


@query("SELECT seq, CAST(to_timestamp(ceil((floor(epoch(ts) / 60) - 7.5) / 15) * 900) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts FROM readings")
def snap_nearest(spark, d):
    return R.snap_nearest(V.readings(spark, d)).select("seq", "ts")


@query("WITH q AS (SELECT uid, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(kw) AS kw FROM readings GROUP BY 1, 2) SELECT uid, date_trunc('hour', ts) AS ts, round(avg(kw), 6) AS kw FROM q GROUP BY 1, 2")
def rollup_mean_of_means(spark, d):
    return R.rollup_mean_of_means(V.readings(spark, d), ["kw"]).withColumn("kw", r6("kw"))


def _channels(spark, d):
    ch = F.when(F.col("circuit") == "click", 1).when(F.col("circuit") == "view", 2).otherwise(3)
    return V.readings(spark, d).select((F.col("uid") % 7).alias("house"), ch.alias("ch"), F.unix_timestamp("ts").alias("utc"), (F.col("kw") * 100).cast("decimal(18,4)").alias("watt"))  # decimals add up alike in any order


_CHANNELS = "WITH channel AS (SELECT uid % 7 AS house, CASE circuit WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS ch, CAST(floor(epoch(ts)) AS BIGINT) AS utc, ts, CAST(kw * 100 AS DECIMAL(18, 4)) AS watt FROM readings), kwh AS (SELECT house, ch, date_trunc('hour', ts) AS hour, CAST(sum(watt) AS DOUBLE) / 3.6e6 AS kwh FROM channel GROUP BY 1, 2, 3) "


@query(_CHANNELS + "SELECT house, ch, hour, round(kwh + 1e-10, 6) AS kwh FROM kwh")
def watts_to_kwh(spark, d):
    return R.watts_to_kwh(_channels(spark, d)).withColumn("kwh", r6(F.col("kwh") + 1e-10))  # off the ties of rounding


@query(_CHANNELS + """, n AS (SELECT house, count(DISTINCT ch) AS n FROM kwh GROUP BY 1)
SELECT k.house, hour, round(sum(kwh) FILTER (ch = 1) + 1e-10, 6) AS ch_1, round(sum(kwh) FILTER (ch = 2) + 1e-10, 6) AS ch_2, round(sum(kwh) FILTER (ch = 3) + 1e-10, 6) AS ch_3 FROM kwh k JOIN n USING (house) GROUP BY k.house, hour, n.n HAVING count(DISTINCT ch) = n.n""")
def align_devices(spark, d):
    out = R.align_devices(R.watts_to_kwh(_channels(spark, d)), [1, 2, 3])
    return out.select("house", "hour", *[r6(F.col(f"ch_{c}") + 1e-10, f"ch_{c}") for c in (1, 2, 3)])


@query("SELECT date_trunc('hour', ts) AS ts, round(avg(kw), 6) AS temperature, round(avg(uid), 6) AS pressure FROM readings WHERE kw <= 100 GROUP BY 1")
def weather_hourly_pair(spark, d):
    feed = C.cap_to_null(V.readings(spark, d), ["kw"]).select("ts", F.col("kw").alias("temperature"), F.col("uid").cast("double").alias("pressure"))
    return R.weather_hourly_pair(feed).select("ts", r6("temperature", "temperature"), r6("pressure", "pressure"))


@query("SELECT uid, ts, round(obs, 6) AS value FROM hourly WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM hours GROUP BY 1 HAVING count(*) = 24)")
def wide_day_to_long(spark, d):
    days = S.long_to_day_profile(V.hourly(spark, d), "obs")
    wide = days.select("uid", "day", *[F.get("v", F.lit(h)).alias(f"hkw{h + 1}") for h in range(24)])
    return S.wide_day_to_long(wide).withColumn("value", r6("value"))


@query("SELECT uid, CAST(ts AS DATE) AS day, round(sum(obs), 6) AS total, round(max(obs) FILTER (hour(ts) = 18), 6) AS at_18 FROM hourly GROUP BY 1, 2 HAVING count(*) = 24")
def long_to_day_profile(spark, d):
    days = S.long_to_day_profile(V.hourly(spark, d), "obs")
    return days.select("uid", "day", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), "total"), r6(F.get("v", F.lit(18)), "at_18"))


_CATEGORIES = "WITH wide AS (SELECT r.uid, r.ts, max(r.kw) AS total, " + ", ".join(f"sum(r.kw) FILTER (k.category = '{c}') AS {c}" for c in S.CATEGORIES) + " FROM readings r JOIN circuit_category k USING (circuit) GROUP BY r.uid, r.ts, r.seq), cat AS (SELECT uid, ts, sum(total) AS total, " + ", ".join(f"sum({c}) AS {c}" for c in S.CATEGORIES) + " FROM wide GROUP BY 1, 2) "
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("total", *S.CATEGORIES))


@query(_CATEGORIES + f'SELECT uid, ts, {_ROUNDED}, round(total - coalesce(C, 0) - coalesce(H, 0), 6) AS "nonHVAC" FROM cat')
def to_categories(spark, d):
    out = S.to_categories(V.readings(spark, d), V.circuit_category(spark))
    return out.select("uid", "ts", *[r6(c, c) for c in ("total", *S.CATEGORIES, "nonHVAC")])


@query(_CATEGORIES + "SELECT uid, ts, round(total, 6) AS total, round(total - coalesce(C, 0) - coalesce(H, 0) - coalesce(lights, 0) - coalesce(always_on, 0) - coalesce(scheduled, 0), 6) AS user FROM cat")
def to_categories_residual_user(spark, d):
    return S.to_categories(V.readings(spark, d), V.circuit_category(spark), "user").select("uid", "ts", r6("total", "total"), r6("user", "user"))


@query(_CATEGORIES + "SELECT uid, ts, v.variable, round(v.value, 6) AS value FROM cat, LATERAL (VALUES ('C', C), ('H', H)) v(variable, value)")
def melt(spark, d):
    rows = S.to_categories(V.readings(spark, d), V.circuit_category(spark)).select("uid", "ts", "C", "H")
    return S.melt(rows, ["uid", "ts"]).withColumn("value", r6("value"))


@query("SELECT uid, round(sum(kw) FILTER (circuit = 'view'), 6) AS view, round(sum(kw) FILTER (circuit = 'error'), 6) AS error FROM readings GROUP BY 1")
def cast(spark, d):
    out = S.cast(V.readings(spark, d), ["uid"], "circuit", "kw", ["view", "error"])
    return out.select("uid", r6("view", "view"), r6("error", "error"))


@query(_CATEGORIES + "SELECT uid, ts, round(coalesce(C, 0) + coalesce(lights, 0), 6) AS s FROM cat")
def sum_columns(spark, d):
    rows = S.to_categories(V.readings(spark, d), V.circuit_category(spark))
    return rows.select("uid", "ts", r6(S.sum_columns(rows, ["C", "lights", "no_such"]), "s"))


@query("SELECT uid, ts, kw, CAST(NULL AS DOUBLE) AS temperature_f FROM readings UNION ALL SELECT NULL, ts, NULL, temperature_f FROM weather")
def concat_align_schema(spark, d):
    return S.concat_align_schema([V.readings(spark, d).select("uid", "ts", "kw"), V.weather(spark, d)])


@query("WITH t AS (SELECT seq, v.n, v.x FROM readings, LATERAL (VALUES ('kw', kw), ('uid', CAST(uid AS DOUBLE))) v(n, x)) SELECT a.seq, a.n AS xvar, b.n AS yvar, a.x, b.x AS y FROM t a JOIN t b ON a.seq = b.seq")
def pairwise_columns(spark, d):
    return S.pairwise_columns(V.readings(spark, d), ["kw", "uid"], ["seq"])


# ---- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT y.uid, y.ts, round(y.obs, 6) AS obs, w.temperature_f FROM gappy y JOIN weather w ON w.ts = y.ts WHERE y.obs <= 400")
def align_covariates(spark, d):
    obs = C.cap_to_null(V.gappy(spark, d), ["obs"], 400).withColumn("seq", F.lit(1))
    twice = obs.unionByName(obs.withColumn("seq", F.lit(2)))
    return J.align_covariates(twice, V.weather(spark, d), "seq").withColumn("obs", r6("obs"))


@query("WITH top AS (SELECT uid FROM gappy GROUP BY 1 HAVING max(obs) > 480) SELECT count(*) FILTER (uid IN (SELECT uid FROM top)) AS semi, count(*) FILTER (uid NOT IN (SELECT uid FROM top)) AS anti FROM readings")
def membership(spark, d):
    top = V.gappy(spark, d).where("obs > 480").select("uid")
    rows = V.readings(spark, d)
    n = lambda how, name: rows.join(top, "uid", how).agg(F.count(F.lit(1)).alias(name))
    return n("left_semi", "semi").crossJoin(n("left_anti", "anti"))


@query("SELECT y.uid, y.ts, c.c_nationkey AS zip, w.temperature_f FROM gappy y JOIN customer c ON c.c_custkey = y.uid JOIN weather w ON w.ts = y.ts")
def lookup_zip_weather(spark, d):
    zips = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("zip"))
    places = zips.select("zip").distinct()
    return J.lookup_zip_weather(V.gappy(spark, d).select("uid", "ts"), zips, V.weather(spark, d).crossJoin(places)).select("uid", "ts", "zip", "temperature_f")


@query("WITH g AS (SELECT unnest(generate_series(45, 95)) AS grid) SELECT CAST(grid AS INTEGER) AS grid, count(*) AS n, round(avg(obs), 6) AS mean_obs FROM states JOIN g ON temperature_f BETWEEN grid - 1 AND grid + 1 GROUP BY 1")
def band_join(spark, d):
    near = J.band_join(V.states(spark, d), "temperature_f", 45, 95, 1)
    return near.groupBy("grid").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("obs"), "mean_obs"))


@query("SELECT a.o_orderkey, a.o_totalprice AS o_totalprice_x, b.o_totalprice AS o_totalprice_y FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey", base=False)
def join_on_keys(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.join_on_keys(orders, orders, ["o_orderkey", "o_custkey"]).drop("o_custkey")


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query(_CATEGORIES + "SELECT uid, CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 'Summer' ELSE 'Winter' END AS season, CAST(hour(ts) AS INTEGER) AS hour, v.variable, round(avg(v.value), 6) AS mean FROM cat, LATERAL (VALUES ('C', C), ('H', H), ('lights', lights)) v(variable, value) GROUP BY ALL")
def mean_by_hour_season(spark, d):
    rows = S.to_categories(V.readings(spark, d), V.circuit_category(spark)).withColumns({"season": T.season(F.col("ts")), "hour": F.hour("ts")})
    return A.mean_by(rows, ["uid", "season", "hour"], ["C", "H", "lights"]).withColumn("mean", r6("mean"))


_HOURCAT = "WITH hc AS (SELECT uid, date_trunc('hour', ts) AS ts, sum(kw) AS total, sum(kw) FILTER (circuit = 'view') AS C, sum(kw) FILTER (circuit = 'purchase') AS H, sum(kw) FILTER (circuit = 'signup') AS lights FROM readings GROUP BY 1, 2) "


def _hourcat(spark, d):
    rows = V.readings(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return S.to_categories(rows, V.circuit_category(spark))


@query(_HOURCAT + "SELECT uid, v.variable, round(avg(v.value), 6) AS mean FROM hc, LATERAL (VALUES ('C', C), ('total', total)) v(variable, value) WHERE C IS NOT NULL AND total IS NOT NULL GROUP BY ALL")
def mean_complete_cases(spark, d):
    return A.mean_by(_hourcat(spark, d), ["uid"], ["C", "total"], complete_cases=True).withColumn("mean", r6("mean"))


@query(_HOURCAT + "SELECT uid, ts, round(total - coalesce(C, 0) - coalesce(H, 0) - coalesce(lights, 0), 6) AS residual FROM hc")
def residual_nonhvac(spark, d):
    return A.residual_nonhvac(_hourcat(spark, d), ("lights",)).select("uid", "ts", r6("residual", "residual"))


@query(_HOURCAT + "SELECT CAST(hour(ts) AS INTEGER) AS hour, round(avg(CAST(coalesce(C, 0) > 50 AS INTEGER)), 6) AS \"C_on\", round(avg(CAST(coalesce(H, 0) > 50 AS INTEGER)), 6) AS \"H_on\", round(avg(CAST(coalesce(C, 0) > 50 AND coalesce(H, 0) > 50 AS INTEGER)), 6) AS both_on FROM hc GROUP BY 1")
def on_fraction(spark, d):
    rows = _hourcat(spark, d).select(F.hour("ts").alias("hour"), *[(F.coalesce(c, F.lit(0.0)) - 50).alias(c) for c in ("C", "H")])
    out = A.on_fraction(rows, ["hour"])
    return out.select("hour", *[r6(c, c) for c in ("C_on", "H_on", "both_on")])


@query(_HOURCAT + """, m AS (SELECT uid, CASE WHEN day(ts) <= 15 THEN 'Summer' ELSE 'Winter' END AS season, v.variable, avg(v.value) AS mean FROM hc, LATERAL (VALUES ('C', C), ('H', H)) v(variable, value) GROUP BY ALL),
w AS (SELECT variable, avg(mean) FILTER (season = 'Winter') AS winter, avg(mean) FILTER (season = 'Summer') AS summer FROM m GROUP BY 1)
SELECT variable, round(winter, 6) AS winter, round(summer, 6) AS summer, round(winter / summer, 6) AS ratio, CASE WHEN winter / summer < 0.8 THEN 'summer' WHEN winter / summer > 1.2 THEN 'winter' ELSE 'even' END AS side FROM w""")
def seasonal_ratio(spark, d):
    half = F.when(F.dayofmonth("ts") <= 15, "Summer").otherwise("Winter")
    means = A.mean_by(_hourcat(spark, d).withColumn("season", half), ["uid", "season"], ["C", "H"])
    out = A.seasonal_ratio(means)
    return out.select("variable", *[r6(c, c) for c in ("winter", "summer", "ratio")], "side")


@query("SELECT category, count(DISTINCT uid) AS n_users, round(count(DISTINCT uid) / (SELECT count(DISTINCT uid) FROM readings), 6) AS share FROM readings JOIN circuit_category USING (circuit) GROUP BY 1")
def end_use_coverage(spark, d):
    return A.end_use_coverage(V.readings(spark, d).join(V.circuit_category(spark), "circuit")).withColumn("share", r6("share"))


@query("SELECT uid, CAST(state AS INTEGER) AS state, round(count(*) / sum(count(*)) OVER (PARTITION BY uid), 6) AS share FROM states GROUP BY uid, state")
def state_share(spark, d):
    return A.state_share(V.states(spark, d)).withColumn("share", r6("share"))


@query("""
WITH n AS (SELECT uid, CAST(hour(ts) AS INTEGER) AS key, CAST(state AS INTEGER) AS state, count(*) AS n FROM states GROUP BY ALL), c AS (SELECT * FROM (SELECT DISTINCT uid, key FROM n) JOIN (SELECT DISTINCT uid, state FROM n) USING (uid))
SELECT c.uid, c.key, c.state, round(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) OVER (PARTITION BY c.uid, c.key), 6) AS share FROM c LEFT JOIN n ON n.uid = c.uid AND n.key = c.key AND n.state = c.state
""")
def state_share_by_hour(spark, d):
    return A.state_share_by(V.states(spark, d), F.hour("ts")).withColumn("share", r6("share"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 'Summer' ELSE 'Winter' END AS season, CAST(state AS INTEGER) AS state, count(*) AS n FROM states GROUP BY ALL")
def state_breakdown(spark, d):
    return A.state_breakdown(V.states(spark, d), F.hour("ts"), T.season(F.col("ts")))


@query("SELECT uid, CAST(ts AS DATE) AS day, " + ", ".join(f"round(avg(obs) FILTER (hour(ts) = {h}), 6) AS h{h}" for h in range(24)) + " FROM hourly GROUP BY 1, 2")
def state_heatmap(spark, d):
    return A.state_heatmap(V.hourly(spark, d), "obs").select("uid", "day", *[r6(f"h{h}", f"h{h}") for h in range(24)])


_PARAMS = "WITH est AS (SELECT uid, state, count(*) AS n, avg(temperature_f - 65) AS mx, avg(obs) AS my, regr_sxx(obs, temperature_f - 65) AS sxx, regr_sxy(obs, temperature_f - 65) AS sxy, regr_syy(obs, temperature_f - 65) AS syy FROM states GROUP BY 1, 2), par AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx END AS slope, my - sxy / CASE WHEN sxx > 0 THEN sxx END * mx AS intercept, CASE WHEN n > 2 THEN greatest(syy - sxy * sxy / CASE WHEN sxx > 0 THEN sxx END, 0) / (n - 2) END AS v FROM est) "


def _params(spark, d):
    rows = V.states(spark, d).withColumn("t_d", T.degree_offset(F.col("temperature_f")))
    return rows, interpret.state_standard_errors(rows, "t_d", "obs")


@query(_PARAMS + "SELECT uid, CAST(state AS INTEGER) AS state, n, round(intercept + 1e-9, 6) AS intercept, round(slope + 1e-9, 6) AS slope, round(sqrt(v * (1 / n + mx * mx / sxx)), 5) AS se_intercept, round(sqrt(v / sxx), 5) AS se_slope, round(sqrt(v), 5) AS sigma FROM par")
def state_standard_errors(spark, d):
    out = _params(spark, d)[1]
    return out.select("uid", "state", "n", *[r6(F.col(c) + 1e-9, c) for c in ("intercept", "slope")], *[F.round(c, 5).alias(c) for c in ("se_intercept", "se_slope", "sigma")])


@query(_PARAMS + "SELECT s.uid, CASE WHEN month(ts) BETWEEN 5 AND 9 THEN 'Summer' ELSE 'Winter' END AS season, CAST(hour(ts) AS INTEGER) AS hour, v.covariate, round(avg(v.x), 5) AS contribution FROM states s JOIN par p USING (uid, state), LATERAL (VALUES ('intercept', p.intercept), ('t_d', p.slope * (s.temperature_f - 65))) v(covariate, x) WHERE p.slope IS NOT NULL GROUP BY ALL")
def contributions(spark, d):
    rows, par = _params(spark, d)
    par = par.where("slope IS NOT NULL")
    long = par.select("uid", "state", F.lit("intercept").alias("covariate"), F.col("intercept").alias("beta")).unionByName(par.select("uid", "state", F.lit("t_d").alias("covariate"), F.col("slope").alias("beta")))
    rows = rows.withColumns({"season": T.season(F.col("ts"), "may_sep"), "hour": F.hour("ts")})
    return A.contributions(rows, long, ["t_d"], ["season", "hour"]).withColumn("contribution", F.round("contribution", 5))


@query("""
WITH t AS (SELECT uid, state = 3 AS m, obs > 250 AS t FROM states), n AS (SELECT uid, count(*) FILTER (m AND t) AS tp, count(*) FILTER (NOT m AND t) AS fn, count(*) FILTER (NOT m AND NOT t) AS tn, count(*) FILTER (m AND NOT t) AS fp FROM t GROUP BY 1)
SELECT uid, tp, fn, tn, fp, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM n
""")
def confusion_metrics(spark, d):
    rows = V.states(spark, d).select("uid", (F.col("state") == 3).alias("m"), (F.col("obs") > 250).alias("t"))
    return A.confusion_metrics(rows, "m", "t", ["uid"]).withColumn("balanced_accuracy", r6("balanced_accuracy"))


@query("""
WITH t AS (SELECT temperature_f > 70 AS a, obs > 250 AS b, state = 1 AS m FROM states), c AS (SELECT * FROM (VALUES (false), (true)) x(first) CROSS JOIN (VALUES (false), (true)) y(second))
SELECT first, second, round(count(*) FILTER (a = first AND b = second) / count(*), 6) AS share, round(count(*) FILTER (a = first AND b = second AND m) / nullif(count(*) FILTER (a = first AND b = second), 0), 6) AS match_rate FROM c CROSS JOIN t GROUP BY 1, 2
""")
def joint_state_tables(spark, d):
    rows = V.states(spark, d).select((F.col("temperature_f") > 70).alias("a"), (F.col("obs") > 250).alias("b"), (F.col("state") == 1).alias("m"))
    return A.joint_state_tables(rows, "a", "b", "m").select("first", "second", r6("share", "share"), r6("match_rate", "match_rate"))


@query("""
WITH g AS (SELECT m, t FROM (VALUES (0.5), (1.0), (2.0)) x(m) CROSS JOIN (VALUES (0.25), (0.5), (0.9)) y(t)), q AS (SELECT uid, quantile_cont(obs, [0.25, 0.5, 0.9]) AS q FROM gappy GROUP BY 1),
s AS (SELECT y.uid, CAST(m AS DOUBLE) AS m, CAST(t AS DOUBLE) AS t, y.obs / 100 > m AS a, y.obs > CASE t WHEN 0.25 THEN q[1] WHEN 0.5 THEN q[2] ELSE q[3] END AS b FROM gappy y JOIN q USING (uid) CROSS JOIN g)
SELECT uid, m AS theta_m, t AS theta_t, round((count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0) + count(*) FILTER (NOT a AND NOT b) / nullif(count(*) FILTER (NOT b), 0)) / 2, 6) AS balanced_accuracy FROM s GROUP BY 1, 2, 3
""")
def detection_sweep(spark, d):
    rows = V.gappy(spark, d).select("uid", (F.col("obs") / 100).alias("ratio"), F.col("obs").alias("kwh"))
    return A.detection_sweep(rows, [0.5, 1.0, 2.0], [0.25, 0.5, 0.9]).withColumn("balanced_accuracy", r6("balanced_accuracy"))


_RESIDUALS = """
WITH s AS (SELECT {keys}, obs, temperature_f AS fit, obs - temperature_f AS r FROM states), c AS (SELECT *, r - avg(r) OVER (PARTITION BY {keys}) AS d, obs - avg(obs) OVER (PARTITION BY {keys}) AS o FROM s),
m AS (SELECT {keys}, count(*) AS n, avg(abs(r / fit)) AS mape, sum(r * r) AS sse, sum(o * o) AS sst, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY ALL)
SELECT {told}, n, round(mape, 6) AS mape, CASE WHEN sst > 1e-9 THEN round(1 - sse / sst, 3) END AS r2, round(sqrt(sse / n), 6) AS rmse,
       CASE WHEN m2 > 1e-9 THEN round(n / 6.0 * (m3 * m3 / (m2 * m2 * m2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 3) END AS jarque_bera FROM m
"""


def _residuals(spark, d, keys):
    out = interpret.residual_summary(V.states(spark, d).withColumn("fit", F.col("temperature_f")), keys=keys)
    return out.select(*keys, "n", r6("mape", "mape"), F.round("r2", 3).alias("r2"), r6("rmse", "rmse"), F.round("jarque_bera", 3).alias("jarque_bera"))


@query(_RESIDUALS.format(keys="uid", told="uid"))
def residual_summary(spark, d):
    return _residuals(spark, d, ["uid"])


@query(_RESIDUALS.format(keys="uid, state", told="uid, CAST(state AS INTEGER) AS state"))
def residual_summary_by_state(spark, d):
    return _residuals(spark, d, ["uid", "state"])


@query("SELECT circuit, count(kw) AS n, round(avg(kw), 6) AS mean, round(stddev_samp(kw), 6) AS sd, round(quantile_cont(kw, 0.05), 6) AS q05, round(quantile_cont(kw, 0.25), 6) AS q25, round(quantile_cont(kw, 0.5), 6) AS q50, round(quantile_cont(kw, 0.75), 6) AS q75, round(quantile_cont(kw, 0.95), 6) AS q95 FROM readings GROUP BY 1")
def distribution_summary(spark, d):
    out = A.distribution_summary(V.readings(spark, d), ["circuit"], "kw")
    return out.select("circuit", "n", r6("mean", "mean"), r6("sd", "sd"), *[r6(F.col("q")[i], n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))])


@query("""
WITH b AS (SELECT circuit, CAST(greatest(least(floor(kw / 10), 49), 0) AS INTEGER) AS b, count(*) AS n FROM readings WHERE kw IS NOT NULL GROUP BY 1, 2), t AS (SELECT circuit, sum(n) AS total FROM b GROUP BY 1), g AS (SELECT CAST(unnest(generate_series(0, 49)) AS INTEGER) AS bin)
SELECT t.circuit, bin, CAST(coalesce(sum(n) FILTER (b = bin), 0) AS BIGINT) AS n, round(sum(n * exp(-0.5 * pow((bin - b) * 10 / 20.0, 2))) / (any_value(total) * 20 * sqrt(2 * pi())), 9) AS density FROM t CROSS JOIN g JOIN b ON b.circuit = t.circuit GROUP BY 1, 2""")
def densities(spark, d):
    out = A.densities(V.readings(spark, d), ["circuit"], "kw", 0.0, 500.0, 50)
    return out.select("circuit", "bin", "n", F.round("density", 9).alias("density"))


@query("SELECT circuit, count(kw) AS n, round(avg(kw), 6) AS mean, round(stddev_samp(kw), 6) AS sd, true AS within FROM readings WHERE kw IS NOT NULL GROUP BY 1")
def merged_summaries(spark, d):
    """Summaries by circuit and day, merged to circuits; whether the sketch's median and outer quantiles are within 3 % of the ranks."""
    rows = V.readings(spark, d).where("kw IS NOT NULL")
    told = A.read_summaries(A.merge_summaries(A.summary_parts(rows.withColumn("day", F.to_date("ts")), ["circuit", "day"], "kw"), ["circuit"]), ["circuit"], [0.05, 0.5, 0.95])
    share = lambda i: F.avg((F.col("kw") <= F.col("q")[i]).cast("double"))
    near = rows.join(F.broadcast(told.select("circuit", "q")), "circuit").groupBy("circuit").agg(*[share(i).alias(f"r{i}") for i in range(3)])
    off = [F.abs(F.col(f"r{i}") - p) <= 0.03 + 1 / F.col("n") for i, p in enumerate((0.05, 0.5, 0.95))]
    return told.join(near, "circuit").select("circuit", "n", r6("mean", "mean"), r6("sd", "sd"), (off[0] & off[1] & off[2]).alias("within"))


@query("WITH n AS (SELECT uid, circuit, count(*) AS n FROM readings GROUP BY 1, 2), p AS (SELECT uid, n / sum(n) OVER (PARTITION BY uid) AS p FROM n) SELECT uid, round(-sum(p * log2(p)), 6) AS entropy, round(log2(count(*)), 6) AS random_entropy FROM p GROUP BY 1")
def entropies(spark, d):
    rows = V.readings(spark, d)
    return A.shannon_entropy(rows, "uid", "circuit").join(A.random_entropy(rows, "uid", "circuit"), "uid").select("uid", r6("entropy", "entropy"), r6("random_entropy", "random_entropy"))


@query("""
WITH RECURSIVE n AS (SELECT uid, circuit, count(*) AS n FROM readings GROUP BY 1, 2), p AS (SELECT uid, n / sum(n) OVER (PARTITION BY uid) AS p FROM n),
e AS (SELECT uid, -sum(p * log2(p)) AS e, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT uid, e, n, 1.0 / n AS lo, CAST(1.0 AS DOUBLE) AS hi, 0 AS i FROM e WHERE n > 1
      UNION ALL SELECT uid, e, n, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END, i + 1 FROM (
        SELECT *, -(mid * log2(mid) + CASE WHEN mid < 1 THEN (1 - mid) * log2(1 - mid) ELSE 0 END) + (1 - mid) * log2(n - 1) > e AS over FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 60)))
SELECT uid, round((lo + hi) / 2, 6) AS bound FROM b WHERE i = 60 UNION ALL SELECT uid, 1.0 FROM e WHERE n < 2
""")
def predictability_bound(spark, d):
    rows = V.readings(spark, d)
    n = rows.groupBy("uid").agg(F.countDistinct("circuit").alias("n"))
    e = A.shannon_entropy(rows, "uid", "circuit").join(n, "uid")
    return e.select("uid", r6(A.predictability_bound(F.col("entropy"), F.col("n")), "bound"))


@query("WITH g AS (SELECT unnest(generate_series(1, 120)) AS grid), n AS (SELECT uid, grid, state, count(*) AS n FROM states JOIN g ON temperature_f BETWEEN grid - 1 AND grid + 1 GROUP BY ALL) SELECT uid, CAST(grid AS INTEGER) AS grid, CAST(state AS INTEGER) AS state, round(n / sum(n) OVER (PARTITION BY uid, grid), 6) AS share FROM n")
def temperature_state_profile(spark, d):
    return interpret.temperature_state_profile(V.states(spark, d)).withColumn("share", r6("share"))


@query("SELECT uid, count(DISTINCT state) AS n_states FROM states GROUP BY 1")
def states_per_user(spark, d):
    return A.states_per_user(V.states(spark, d))


@query("SELECT label AS cluster, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM embeddings GROUP BY 1", base=False)
def cluster_membership_share(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("cluster"))
    return A.cluster_membership_share(rows).withColumn("percent", r6("percent"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, round(avg(temperature_f) + 25, 6) AS temperature_f FROM weather GROUP BY 1")
def hourly_forecast_profile(spark, d):
    return A.hourly_forecast_profile(V.weather(spark, d), "temperature_f", 25).withColumn("temperature_f", r6("temperature_f"))


@query("SELECT c_nationkey, round(avg(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY 1", base=False)
def mean_by_group_id(spark, d):
    return A.mean_by_group_id(spark.read.parquet(f"{d}/customer.parquet"), "c_nationkey", ["c_acctbal"]).withColumn("c_acctbal", r6("c_acctbal"))


# ---- windows and sets -----------------------------------------------------------------------------------------------


@query("SELECT uid, ts, row_number() OVER (PARTITION BY uid ORDER BY ts) <= floor(count(*) OVER (PARTITION BY uid) * 0.7) AS is_train, CAST(row_number() OVER (PARTITION BY uid ORDER BY ts) % 2 AS INTEGER) AS fold FROM gappy")
def splits(spark, d):
    return W.odd_even_split(W.train_test_split_by_time(V.gappy(spark, d), 0.7)).select("uid", "ts", "is_train", "fold")


@query("""
WITH f AS (SELECT uid, ts, obs, temperature_f AS fit, row_number() OVER (PARTITION BY uid ORDER BY ts) AS i, count(*) OVER (PARTITION BY uid) AS n FROM states), p AS (SELECT *, CAST(floor((i - 1) * 4 / n) + 1 AS INTEGER) AS period FROM f),
s AS (SELECT uid, period, sum(abs((obs - fit) / fit)) AS a, count(*) AS na, sum((obs - fit) * (obs - fit)) AS sse, sum(obs) AS s, sum(obs * obs) AS ss FROM p GROUP BY 1, 2)
SELECT uid, period, round(sum(a) OVER w / sum(na) OVER w, 6) AS mape, round(1 - sum(sse) OVER w / (sum(ss) OVER w - sum(s) OVER w * sum(s) OVER w / sum(na) OVER w), 5) AS r2 FROM s WINDOW w AS (PARTITION BY uid ORDER BY period ROWS UNBOUNDED PRECEDING)
""")
def expanding_horizon_metrics(spark, d):
    out = W.expanding_horizon_metrics(V.states(spark, d).withColumn("fit", F.col("temperature_f")), 4)
    return out.select("uid", "period", r6("mape", "mape"), F.round("r2", 5).alias("r2"))


@query("SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 25", base=False)
def top_k(spark, d):
    return W.top_k(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal"), "c_acctbal", 25, "c_custkey")


@query("""
WITH u AS (SELECT uid, CAST(ts AS DATE) AS day, sum(obs) AS truth, max(obs) AS model FROM gappy GROUP BY 1, 2), m AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY model DESC, uid) AS n, sum(truth) OVER (PARTITION BY day ORDER BY model DESC, uid ROWS UNBOUNDED PRECEDING) AS cm FROM u),
t AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY truth DESC, uid) AS n, sum(truth) OVER (PARTITION BY day ORDER BY truth DESC, uid ROWS UNBOUNDED PRECEDING) AS ct FROM u)
SELECT day, CAST(n AS INTEGER) AS n, round(cm, 5) AS cum_model, round(ct, 5) AS cum_truth, round((ct - cm) / ct, 6) AS rel_err FROM m JOIN t USING (day, n)
""")
def cumulative_contribution(spark, d):
    rows = V.gappy(spark, d).groupBy("uid", F.to_date("ts").alias("day")).agg(F.sum("obs").alias("truth"), F.max("obs").alias("model"))
    out = W.cumulative_contribution(rows, "model", "truth", ["day"])
    return out.select("day", F.col("n").cast("int").alias("n"), F.round("cum_model", 5).alias("cum_model"), F.round("cum_truth", 5).alias("cum_truth"), r6("rel_err", "rel_err"))


@query("""
WITH c AS (SELECT CAST(temperature_f AS INTEGER) AS grid, uid, avg(obs) AS f FROM states GROUP BY 1, 2), x AS (SELECT *, f - lag(f) OVER (PARTITION BY uid ORDER BY grid) AS dd FROM c)
SELECT uid, grid, round(coalesce(last_value(dd IGNORE NULLS) OVER (PARTITION BY uid ORDER BY grid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(dd IGNORE NULLS) OVER (PARTITION BY uid ORDER BY grid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS slope FROM x
""")
def temperature_gradient(spark, d):
    rows = V.states(spark, d).groupBy(F.col("temperature_f").cast("int").alias("grid"), "uid").agg(F.avg("obs").alias("f"))
    return W.temperature_gradient(rows, "f").select("uid", "grid", r6("slope", "slope"))


@query("""
WITH f AS (SELECT CAST(hour(ts) AS INTEGER) AS h, avg(temperature_f) AS g FROM weather GROUP BY 1), x AS (SELECT uid, CAST(ts AS DATE) AS day, sqrt(sum((obs - g) * (obs - g))) AS distance FROM hourly JOIN f ON f.h = hour(ts) GROUP BY 1, 2 HAVING count(*) = 24)
SELECT uid, day, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY uid ORDER BY distance, day) AS INTEGER) AS rank FROM x QUALIFY rank <= 5
""")
def similar_days(spark, d):
    forecast = S.long_to_day_profile(A.hourly_forecast_profile(V.weather(spark, d), "temperature_f").select(F.lit(0).alias("uid"), F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), "temperature_f"), "temperature_f")
    days = S.long_to_day_profile(V.hourly(spark, d), "obs").crossJoin(F.broadcast(forecast.select(F.col("v").alias("g"))))
    return W.similar_days(days, F.col("g"), 5).withColumn("distance", r6("distance"))


@query("""
WITH c AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY ts) AS i, obs - avg(obs) OVER (PARTITION BY uid) AS x FROM hourly), t AS (SELECT uid, sum(x * x) AS c0, count(*) AS n FROM c GROUP BY 1), l AS (SELECT unnest(generate_series(1, 6)) AS lag)
SELECT a.uid, CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / any_value(c0), 6) AS acf, abs(sum(a.x * b.x) / any_value(c0)) > 1.96 / sqrt(any_value(t.n)) AS significant FROM c a CROSS JOIN l JOIN c b ON b.uid = a.uid AND b.i = a.i - lag JOIN t ON t.uid = a.uid GROUP BY 1, 2
""")
def acf(spark, d):
    return W.acf(V.hourly(spark, d), "obs", 6).withColumn("acf", r6("acf"))


@query("""
WITH RECURSIVE c AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY ts) AS i, obs - avg(obs) OVER (PARTITION BY uid) AS x FROM hourly), t AS (SELECT uid, sum(x * x) AS c0 FROM c GROUP BY 1), l AS (SELECT unnest(generate_series(1, 6)) AS lag),
a AS (SELECT a.uid, lag, sum(a.x * b.x) / any_value(c0) AS r FROM c a CROSS JOIN l JOIN c b ON b.uid = a.uid AND b.i = a.i - lag JOIN t ON t.uid = a.uid GROUP BY 1, 2),
r AS (SELECT uid, list(r ORDER BY lag) AS r FROM a GROUP BY 1),
d AS (SELECT uid, r, 1 AS k, [r[1]] AS phi, r[1] AS p FROM r
      UNION ALL SELECT uid, r, k + 1, list_append(list_transform(generate_series(1, k), lambda i: phi[i] - new * phi[k + 1 - i]), new), new FROM (
        SELECT *, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k]))) / (1 - list_dot_product(phi, r[1:k])) AS new FROM d WHERE k < 6))
SELECT uid, CAST(k AS INTEGER) AS lag, round(p, 6) AS pacf FROM d
""")
def pacf(spark, d):
    return W.pacf(W.acf(V.hourly(spark, d), "obs", 6)).withColumn("pacf", r6("pacf"))


@query("SELECT uid, min(ts) AS first_ts, max(ts) AS last_ts FROM readings GROUP BY 1")
def first_last_observation(spark, d):
    return W.first_last_observation(V.readings(spark, d), "uid")


@query("SELECT seq, ts FROM readings WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def interval_slice(spark, d):
    return W.interval_slice(V.readings(spark, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00").select("seq", "ts")


@query("WITH v AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM readings WHERE circuit = 'view'), c AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM readings WHERE circuit = 'error') SELECT ts, 'both' AS kind FROM (SELECT ts FROM v INTERSECT SELECT ts FROM c) UNION ALL SELECT ts, 'only_view' FROM (SELECT ts FROM v EXCEPT SELECT ts FROM c)")
def set_operations(spark, d):
    at = lambda c: V.readings(spark, d).where(F.col("circuit") == c).select(F.date_trunc("hour", "ts").alias("ts")).distinct()
    v, e = at("view"), at("error")
    return v.intersect(e).withColumn("kind", F.lit("both")).unionByName(v.subtract(e).withColumn("kind", F.lit("only_view")))


# ---- interpretation, curves, chains ---------------------------------------------------------------------------------

_MOVES = """moves AS (SELECT uid, lag(state) OVER (PARTITION BY uid ORDER BY ts) AS i, state AS j FROM states), cnt AS (SELECT uid, i, j, count(*) AS n FROM moves WHERE i IS NOT NULL GROUP BY ALL), three AS (SELECT unnest([1, 2, 3]) AS s),
everyone AS (SELECT DISTINCT uid FROM states), tran AS (SELECT u.uid, x.s AS "from", y.s AS "to", ln(coalesce(n, 0) + 1) AS b0, 0.01 * (y.s - 2) AS b1 FROM everyone u CROSS JOIN three x CROSS JOIN three y LEFT JOIN cnt ON cnt.uid = u.uid AND cnt.i = x.s AND cnt.j = y.s) """
_TRAN = "WITH " + _MOVES + """, g AS (SELECT DISTINCT temperature_f - 65 AS t FROM weather), z AS (SELECT uid, t, "from", "to", exp(b0 + b1 * t) AS e FROM tran CROSS JOIN g), p AS (SELECT uid, t, "from", "to", e / sum(e) OVER (PARTITION BY uid, t, "from") AS p FROM z) """


def _moves(spark, d):
    """uid, from, to, b0, b1 of three states: logits of counted moves, plus one, and a fixed slope on temperature."""
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("from"), F.lit(j).alias("to")) for i in (1, 2, 3) for j in (1, 2, 3)]))
    every = V.readings(spark, d).select("uid").distinct().select("uid", one.alias("m")).select("uid", "m.*")
    counts = chains.transition_counts(V.states(spark, d))
    return every.join(counts, ["uid", "from", "to"], "left").select("uid", "from", "to", F.log(F.coalesce("n", F.lit(0)) + 1.0).alias("b0"), (0.01 * (F.col("to") - 2)).alias("b1"))


def _transition(spark, d):
    grid = V.weather(spark, d).select((F.col("temperature_f") - 65).alias("t")).distinct()
    return interpret.transition_matrix_at(_moves(spark, d), grid)


@query(_TRAN + 'SELECT uid, t, CAST("from" AS INTEGER) AS "from", CAST("to" AS INTEGER) AS "to", round(p, 6) AS p FROM p')
def transition_matrix_at(spark, d):
    return _transition(spark, d).withColumn("p", r6("p"))


@query(_TRAN + 'SELECT uid, t, CAST("from" AS INTEGER) AS state, round(1 / (1 - p), 6) AS tau FROM p WHERE "from" = "to"')
def expected_duration(spark, d):
    return interpret.expected_duration(_transition(spark, d)).withColumn("tau", r6("tau"))


@query(_TRAN + """, w AS (SELECT uid, t, max(p) FILTER ("from" = 1 AND "to" = 1) a, max(p) FILTER ("from" = 1 AND "to" = 2) b, max(p) FILTER ("from" = 1 AND "to" = 3) c, max(p) FILTER ("from" = 2 AND "to" = 1) d, max(p) FILTER ("from" = 2 AND "to" = 2) e, max(p) FILTER ("from" = 2 AND "to" = 3) f, max(p) FILTER ("from" = 3 AND "to" = 1) g, max(p) FILTER ("from" = 3 AND "to" = 2) h, max(p) FILTER ("from" = 3 AND "to" = 3) i FROM p GROUP BY 1, 2),
m AS (SELECT uid, t, (1 - e) * (1 - i) - f * h AS x, (1 - a) * (1 - i) - c * g AS y, (1 - a) * (1 - e) - b * d AS z FROM w)
SELECT uid, t, s.state, round(CASE s.state WHEN 1 THEN x WHEN 2 THEN y ELSE z END / (x + y + z), 6) AS pi FROM m CROSS JOIN (VALUES (1), (2), (3)) s(state)""")
def stationary_distribution(spark, d):
    return interpret.stationary_distribution(_transition(spark, d)).withColumn("pi", r6("pi"))


@query(_PARAMS + ", q AS (SELECT uid, state, round(slope, 9) AS slope, round(intercept, 9) AS intercept, round(sqrt(v), 9) AS sd FROM par WHERE v IS NOT NULL) SELECT uid, CAST(state AS INTEGER) AS state, CASE WHEN slope >= 2 THEN 'C.Hi' WHEN slope >= 0.025 THEN 'C.Lo' WHEN slope >= -0.025 THEN 'N' WHEN slope >= -2 THEN 'H.Lo' ELSE 'H.Hi' END AS thermal, CASE WHEN sd / nullif(intercept, 0) > 0.5 THEN 'High' ELSE 'Low' END AS activity FROM q")
def regime_labels(spark, d):
    par = _params(spark, d)[1].where("sigma IS NOT NULL")  # rounded to nine places on both sides, so that bounds mean the same
    return interpret.regime_labels(par.select("uid", "state", *[F.round(c, 9).alias(n) for c, n in (("slope", "slope"), ("intercept", "intercept"), ("sigma", "sd"))]))


@query("""
WITH g AS (SELECT unnest(generate_series(45, 95)) AS grid), n AS (SELECT uid, grid, pow(1 - pow(abs(temperature_f - grid) / 10.0, 3), 3) AS w, temperature_f - grid AS x, obs AS y FROM states JOIN g ON abs(temperature_f - grid) < 10),
s AS (SELECT uid, grid, sum(w) s0, sum(w * x) s1, sum(w * x * x) s2, sum(w * y) t0, sum(w * x * y) t1 FROM n GROUP BY 1, 2)
SELECT uid, CAST(grid AS INTEGER) AS grid, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 5) AS fit, round((s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1), 5) AS slope FROM s
""")
def truth_response_curve(spark, d):
    out = curves.truth_response_curve(V.states(spark, d), "obs", "temperature_f", 45, 95)
    return out.select("uid", "grid", F.round("fit", 5).alias("fit"), F.round("slope", 5).alias("slope"))


def _lowess(rounds: int) -> str:
    """CTEs of robust local regression: sums by temperature, the nearest two thirds, bisquare weights by the median residual; the last fit is f{rounds}."""
    out = [
        "r0 AS (SELECT uid, round(temperature_f) AS x, obs AS y, 1.0 AS r FROM states)",
        "m0 AS (SELECT uid, x, count(*) AS n FROM r0 GROUP BY 1, 2)",
        "u0 AS (SELECT uid, greatest(least(floor(sum(n) * (2.0 / 3) + 1e-7), sum(n)), 2) AS k, 0.001 * (max(x) - min(x)) AS least FROM m0 GROUP BY 1)",
        "h0 AS (SELECT uid, x, min(d) AS h FROM (SELECT a.uid, a.x, abs(b.x - a.x) AS d, sum(b.n) OVER (PARTITION BY a.uid, a.x ORDER BY abs(b.x - a.x)) AS upto FROM m0 a JOIN m0 b ON b.uid = a.uid) JOIN u0 USING (uid) WHERE upto >= k GROUP BY 1, 2)",
    ]
    for i in range(rounds + 1):
        out += [
            f"c{i} AS (SELECT uid, x, sum(r) AS w, sum(r * y) AS wy FROM r{i} GROUP BY 1, 2)",
            f"k{i} AS (SELECT h0.uid, h0.x, c.x - h0.x AS z, w, wy, CASE WHEN abs(c.x - h0.x) <= 0.001 * h THEN 1.0 WHEN abs(c.x - h0.x) <= 0.999 * h THEN pow(1 - pow(abs(c.x - h0.x) / h, 3), 3) ELSE 0.0 END AS q FROM h0 JOIN c{i} c ON c.uid = h0.uid)",
            f"s{i} AS (SELECT uid, x, sum(q * w) AS s0, sum(q * w * z) / sum(q * w) AS m, sum(q * w * z * z) / sum(q * w) AS v, sum(q * wy) / sum(q * w) AS y, sum(q * wy * z) / sum(q * w) AS t FROM k{i} GROUP BY 1, 2)",
            f"f{i} AS MATERIALIZED (SELECT uid, x, CASE WHEN sqrt(greatest(v - m * m, 0)) > least THEN y - m / (v - m * m) * (t - m * y) ELSE y END AS fit FROM s{i} JOIN u0 USING (uid))",
        ]
        if i < rounds:
            out += [
                f"e{i} AS (SELECT r.uid, r.x, y, r, abs(y - fit) AS e FROM r{i} r JOIN f{i} f ON f.uid = r.uid AND f.x = r.x)",
                f"a{i} AS (SELECT uid, 6 * median(e) AS six, avg(e) AS mean FROM e{i} GROUP BY 1)",
                f"r{i + 1} AS MATERIALIZED (SELECT uid, x, y, CASE WHEN six < 1e-7 * mean THEN r WHEN e <= 0.001 * six THEN 1.0 WHEN e <= 0.999 * six THEN pow(1 - pow(e / six, 2), 2) ELSE 0.0 END AS r FROM e{i} JOIN a{i} USING (uid))",
            ]
    return ", ".join(out)


@query(f"""
WITH {_lowess(3)}, b AS (SELECT uid, min(x) AS lo, max(x) AS hi FROM f3 GROUP BY 1), g AS (SELECT b.uid, lo, hi, CAST(g AS INTEGER) AS grid, greatest(least(g, hi), lo) AS here, greatest(least(g, hi), lo + 1) AS up FROM b CROSS JOIN (SELECT unnest(generate_series(1, 120)) AS g)),
z AS (SELECT uid, x, fit, lead(x) OVER w AS x2, lead(fit) OVER w AS fit2 FROM f3 WINDOW w AS (PARTITION BY uid ORDER BY x)),
p AS (SELECT q.uid, d, z.fit + CASE WHEN z.x < d THEN (fit2 - fit) * (d - z.x) / (x2 - z.x) ELSE 0 END AS fit FROM (SELECT DISTINCT uid, unnest([here, up, up - 1]) AS d FROM g) q ASOF JOIN z ON z.uid = q.uid AND q.d >= z.x)
SELECT g.uid, grid, round(i.fit, 4) AS fit, round(j.fit - k.fit, 4) AS slope FROM g JOIN p i ON i.uid = g.uid AND i.d = here LEFT JOIN p j ON j.uid = g.uid AND j.d = up AND up <= hi LEFT JOIN p k ON k.uid = g.uid AND k.d = up - 1
""")
def robust_response_curve(spark, d):
    out = curves.robust_response_curve(V.states(spark, d), "obs", "temperature_f", 1, 120)
    return out.select("uid", "grid", F.round("fit", 4).alias("fit"), F.round("slope", 4).alias("slope"))


@query("""
WITH c AS (SELECT unnest([50, 55, 60, 65, 70, 75, 80, 85, 90]) AS c), r AS (SELECT uid, c, obs AS y, least(temperature_f - c, 0.0) AS u, greatest(temperature_f - c, 0.0) AS v FROM states CROSS JOIN c),
s AS (SELECT uid, c, count(*) AS n, regr_sxx(y, u) / count(*) AS uu, regr_sxx(y, v) / count(*) AS vv, -avg(u) * avg(v) AS uv, covar_pop(y, u) AS uy, covar_pop(y, v) AS vy, var_pop(y) AS yy FROM r GROUP BY 1, 2),
k AS (SELECT *, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS b, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS d FROM s WHERE uu * vv - uv * uv > 1e-9),
e AS (SELECT *, n * (yy - b * uy - d * vy) AS sse, row_number() OVER (PARTITION BY uid ORDER BY n * (yy - b * uy - d * vy), c) AS i FROM k)
SELECT u.uid, CAST(c AS DOUBLE) AS break_at, round(coalesce(b, 0.0), 4) AS slope_below, round(coalesce(d, 0.0), 4) AS slope_above, round(sse, 2) AS sse FROM (SELECT DISTINCT uid FROM states) u LEFT JOIN e ON e.uid = u.uid AND i = 1
""")
def breakpoint_response(spark, d):
    out = curves.breakpoint_response(V.states(spark, d), "obs", "temperature_f", [50, 55, 60, 65, 70, 75, 80, 85, 90])
    return out.select("uid", "break_at", *[F.round(c, n).alias(c) for c, n in (("slope_below", 4), ("slope_above", 4), ("sse", 2))])


@query("WITH m AS (SELECT uid, lag(state) OVER (PARTITION BY uid ORDER BY ts) AS \"from\", state AS \"to\" FROM states) SELECT uid, CAST(\"from\" AS INTEGER) AS \"from\", CAST(\"to\" AS INTEGER) AS \"to\", count(*) AS n FROM m WHERE \"from\" IS NOT NULL GROUP BY 1, 2, 3")
def transition_counts(spark, d):
    return chains.transition_counts(V.states(spark, d))


# The five structures of three states, each row alike over its moves, under the six numberings of the states.
_CHAINS = """WITH m AS (SELECT uid, lag(state) OVER (PARTITION BY uid ORDER BY ts) AS i, state AS j FROM states), o AS (SELECT uid, i, j, count(*) AS n FROM m WHERE i IS NOT NULL GROUP BY ALL), t AS (SELECT uid, i, sum(n) AS total FROM o GROUP BY 1, 2),
a AS (SELECT * FROM (VALUES ('identity', 1, [1, 0, 0]), ('identity', 2, [0, 1, 0]), ('identity', 3, [0, 0, 1]), ('complete', 1, [1, 1, 1]), ('complete', 2, [1, 1, 1]), ('complete', 3, [1, 1, 1]),
  ('telescope', 1, [1, 1, 0]), ('telescope', 2, [1, 1, 1]), ('telescope', 3, [1, 0, 1]), ('fwdjump', 1, [1, 1, 1]), ('fwdjump', 2, [0, 1, 1]), ('fwdjump', 3, [1, 0, 1]), ('outlier', 1, [1, 1, 1]), ('outlier', 2, [1, 1, 1]), ('outlier', 3, [1, 1, 1])) v(template, i, w)),
q AS (SELECT * FROM (VALUES ([1, 2, 3]), ([1, 3, 2]), ([2, 1, 3]), ([2, 3, 1]), ([3, 1, 2]), ([3, 2, 1])) v(perm)),
e AS (SELECT template, array_to_string(perm, ' ') AS perm, perm[a.i] AS i, perm[j] AS j, greatest(w[j] / list_sum(w), 1e-6) AS p FROM a CROSS JOIN q CROSS JOIN (SELECT unnest([1, 2, 3]) AS j)),
c AS (SELECT t.uid, template, perm, coalesce(o.n, 0) AS n, total * p AS x FROM t JOIN e ON e.i = t.i LEFT JOIN o ON o.uid = t.uid AND o.i = e.i AND o.j = e.j),
s AS (SELECT uid, template, perm, sum((n - x) * (n - x) / x) AS chi2, sum(CASE WHEN n > 0 THEN 2 * n * ln(n / x) ELSE 0 END) AS lr FROM c GROUP BY 1, 2, 3),
b AS (SELECT uid, template, arg_min(perm, (round({stat}, 4), perm)) AS perm, arg_min({stat}, (round({stat}, 4), perm)) AS stat FROM s GROUP BY 1, 2) """
_CHI2_6 = "CASE WHEN stat <= 0 THEN 0.0 ELSE 1 - exp(-stat / 2) * (1 + stat / 2 + stat * stat / 8) END"


@query(_CHAINS.format(stat="chi2") + ", g AS (SELECT uid, arg_min(template, (round(stat, 4), template)) AS template FROM b GROUP BY 1) SELECT * FROM g")
def chain_type(spark, d):
    counts = chains.transition_counts(V.states(spark, d))
    return chains.chain_type(chains.chain_chi2(counts, chains.chain_templates(spark, 3)))


@query(_CHAINS.format(stat="chi2") + f"SELECT uid, template, perm, round(stat, 4) AS chi2, 6 AS df, round({_CHI2_6}, 6) AS p FROM b")
def chain_chi2(spark, d):
    counts = chains.transition_counts(V.states(spark, d))
    return chains.chain_chi2(counts, chains.chain_templates(spark, 3)).withColumns({"chi2": F.round("chi2", 4), "p": r6("p")})


@query(_CHAINS.format(stat="lr") + f"SELECT uid, template, perm, round(stat, 4) AS lr, 6 AS df, round({_CHI2_6}, 6) AS p FROM b")
def chain_lr(spark, d):
    counts = chains.transition_counts(V.states(spark, d))
    return chains.chain_lr(counts, chains.chain_templates(spark, 3)).withColumns({"lr": F.round("lr", 4), "p": r6("p")})


@query("""
WITH q AS (SELECT uid, quantile_cont(obs, 0.5) AS q FROM states GROUP BY 1), l AS (SELECT uid, ts, obs, state, CAST(state AS DOUBLE) AS sd, temperature_f FROM states)
SELECT l.uid, l.ts, sd > 2 * min(sd) OVER (PARTITION BY l.uid) AS home, abs(temperature_f) > 2 * min(abs(temperature_f)) OVER (PARTITION BY l.uid) AS hvac_on, obs > q AS home_true, obs > q AS hvac_true FROM l JOIN q USING (uid)
""")
def detect_state_labels(spark, d):
    rows = V.states(spark, d).select("uid", "ts", F.col("state").cast("double").alias("sd"), F.col("temperature_f").alias("slope"), F.col("obs").alias("user"), F.col("obs").alias("hvac"))
    return interpret.detect_state_labels(rows, 2.0, 0.5).select("uid", "ts", "home", "hvac_on", "home_true", "hvac_true")


# ---- segments, ranking, selection -----------------------------------------------------------------------------------


def _profiles(spark, d):
    """id, label, v, s of the embeddings: the first half of each vector, and errors from the second half."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    v = F.transform(F.slice("embedding", F.lit(1), half), lambda x: x.cast("double"))
    s = F.transform(F.slice("embedding", half + 1, half), lambda x: 0.01 + F.abs(x.cast("double")))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", v.alias("v"), s.alias("s"))


@query("""
WITH h AS (SELECT *, len(embedding) // 2 AS h FROM embeddings), v AS (SELECT vec_id, label, unnest(embedding[1:h]) AS x, unnest(embedding[h + 1:2 * h]) AS e, generate_subscripts(embedding[1:h], 1) AS i FROM h),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS mu FROM v GROUP BY 1, 2)
SELECT vec_id AS id, c.label AS cluster, round(sum((x - mu) * (x - mu) / (0.01 + abs(CAST(e AS DOUBLE)))), 5) AS distance FROM v JOIN c USING (i) GROUP BY 1, 2
""", base=False)
def pairwise_distance(spark, d):
    p = _profiles(spark, d)
    mu = p.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = mu.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda q: q["m"]).alias("mu"))
    return segments.pairwise_distance(p, centres).withColumn("distance", F.round("distance", 5))


@query()
def kerror_cluster(spark, d):
    members, centres = segments.kerror_cluster(_profiles(spark, d), 4)
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 2).alias("objective"))


def _day_covariances(spark, d):
    """uid, h1, h2, w: covariance over days between the hours of a user's load."""
    days = S.long_to_day_profile(V.hourly(spark, d), "obs")
    each = days.select("uid", "day", "v", F.posexplode("v").alias("h1", "x1")).select("uid", "h1", "x1", F.posexplode("v").alias("h2", "x2"))
    return each.groupBy("uid", "h1", "h2").agg((F.covar_pop("x1", "x2") / 1e5).alias("w"))


@query()
def kerror_cluster_full(spark, d):
    """Mean day profiles with the covariance between their hours (and a little on its diagonal)."""
    spread = segments.covariances(S.long_to_day_profile(V.hourly(spark, d), "obs"))
    cells = F.transform("w", lambda w, i: w / 1e5 + F.when(i % 25 == 0, 0.05).otherwise(0.0))
    points = _response(spark, d).select("uid", "a").join(spread.select("uid", cells.alias("s")), "uid")
    members, _ = segments.kerror_cluster(points, 3, key="uid", vector="a", error="s", full=True)
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 3).alias("objective"))


@query()
def kmeans_labels(spark, d):
    labels, centres = segments.kmeans_labels(_profiles(spark, d), 4)
    return labels.join(centres.select("cluster", "n"), "cluster")


@query()
def fuzzy_cmeans(spark, d):
    return segments.fuzzy_cmeans(_profiles(spark, d), 3)[0].withColumn("membership", F.round("membership", 4))


@query()
def kmeans_elbow(spark, d):
    return segments.elbow_table(segments.kmeans_sweep(_profiles(spark, d), [1, 2, 4, 8])).select("k", *[F.round(c, 3).alias(c) for c in ("within_ss", "explained", "change")])


@query()
def kerror_elbow(spark, d):
    """The error-aware objective of 2, 4 .. 40 clusters of mean day profiles."""
    told = segments.kerror_sweep(_response(spark, d), list(range(2, 41, 2)), key="uid", vector="a", error="w")
    return segments.elbow_table(told, "objective").select("k", F.round("objective", 3).alias("objective"), F.round("change", 4).alias("change"))


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'kmeans' AS method, n, 0 AS wrong FROM n UNION ALL SELECT 'fuzzy', n, 0 FROM n UNION ALL SELECT 'kerror', n, 0 FROM n", base=False)
def segments_hold(spark, d):
    """What clusters must meet: no other centre is nearer than a point's own, memberships add up to one. Counts of points and of those that don't."""
    p = _profiles(spark, d)
    one = p.select("id", "v", F.transform("v", lambda _: F.lit(1.0)).alias("s"))
    told = []
    for name, (labels, centres), points in (("kmeans", segments.kmeans_labels(p, 4), one), ("kerror", segments.kerror_cluster(p, 4), p)):
        every = segments.pairwise_distance(points, centres).groupBy("id").agg(F.min("distance").alias("least"), F.collect_list(F.struct("cluster", "distance")).alias("all"))
        own = F.filter("all", lambda c: c["cluster"] == F.col("mine"))[0]["distance"]
        wrong = every.join(labels.select("id", F.col("cluster").alias("mine")), "id", "left").select((own <= F.col("least") * (1 + 1e-9)).alias("good"))
        told.append(wrong.agg(F.lit(name).alias("method"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("wrong")))
    shares = segments.fuzzy_cmeans(p, 3)[0].groupBy("id").agg((F.abs(F.sum("membership") - 1) < 1e-9).alias("good"))
    told.append(shares.agg(F.lit("fuzzy").alias("method"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("wrong")))
    return told[0].unionByName(told[1]).unionByName(told[2])


_TAU = """
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY abs(m) DESC, uid) AS r FROM u), k AS (SELECT unnest([5, 10, 20, 50, 100]) AS k), p AS (SELECT a.{by}, k, sum(sign(b.m - a.m) * sign(b.t - a.t)) AS s FROM r a JOIN k ON a.r <= k JOIN r b ON b.{by} = a.{by} AND b.r > a.r AND b.r <= k GROUP BY 1, 2),
n AS (SELECT {by}, k, least(k, count(*)) AS n FROM r CROSS JOIN k GROUP BY 1, 2), w AS (SELECT n.{by}, n.k, n, CASE WHEN n > 1 THEN s / (n * (n - 1) / 2.0) END AS tau FROM n LEFT JOIN p ON p.{by} = n.{by} AND p.k = n.k),
x AS (SELECT *, abs(3 * tau * sqrt(n * (n - 1)) / sqrt(2.0 * (2 * n + 5))) / sqrt(2.0) AS x FROM w), y AS (SELECT *, 1 / (1 + 0.5 * x) AS y FROM x),
z AS (SELECT *, y * exp(-x * x - 1.26551223 + y * (1.00002368 + y * (0.37409196 + y * (0.09678418 + y * (-0.18628806 + y * (0.27886807 + y * (-1.13520398 + y * (1.48851587 + y * (-0.82215223 + y * 0.17087277))))))))) AS p FROM y)
SELECT {told}, CAST(k AS INTEGER) AS k, n, round(CASE WHEN p <= 0.05 THEN tau WHEN tau IS NOT NULL THEN 0.0 END, 6) AS tau, round(p, 6) AS p FROM z
"""


@query("WITH u AS (SELECT CAST(ts AS DATE) AS day, uid, max(obs) AS m, sum(obs) AS t FROM gappy GROUP BY 1, 2)," + _TAU.format(by="day", told="day"))
def kendall_tau_at_k(spark, d):
    rows = V.gappy(spark, d).groupBy(F.to_date("ts").alias("day"), "uid").agg(F.max("obs").alias("model"), F.sum("obs").alias("truth"))
    return ranking.kendall_tau_at_k(rows, [5, 10, 20, 50, 100], by=["day"]).select("day", "k", "n", r6("tau", "tau"), r6("p", "p"))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts) % 2 AS fold FROM states), u AS (SELECT CAST(temperature_f AS INTEGER) AS grid, uid, round(avg(obs) FILTER (fold = 1), 6) AS m, round(avg(obs) FILTER (fold = 0), 6) AS t FROM f GROUP BY 1, 2 HAVING m IS NOT NULL AND t IS NOT NULL)," + _TAU.format(by="grid", told="grid"))
def kendall_temperature_sweep(spark, d):
    """At each temperature, the ranking by response on odd rows against that on even rows."""
    fold = lambda k: r6(F.avg(F.when(F.col("fold") == k, F.col("obs"))))
    rows = W.odd_even_split(V.states(spark, d)).groupBy(F.col("temperature_f").cast("int").alias("grid"), "uid").agg(fold(1).alias("model"), fold(0).alias("truth"))
    return ranking.kendall_tau_at_k(rows.where("model IS NOT NULL AND truth IS NOT NULL"), [5, 10, 20, 50, 100], by=["grid"]).select("grid", "k", "n", r6("tau", "tau"), r6("p", "p"))


@query("SELECT uid, CASE WHEN m < 0.33 THEN 'low' WHEN m < 0.6 THEN 'medium' ELSE 'high' END AS tier, round(m, 6) AS relative FROM (SELECT uid, sum(obs) / max(sum(obs)) OVER () AS m FROM gappy GROUP BY 1)")
def response_tiers(spark, d):
    rows = V.gappy(spark, d).groupBy("uid").agg(F.sum("obs").alias("x"))
    return ranking.response_tiers(ranking.normalise_rows(rows, "x"), "relative").select("uid", "tier", r6("relative", "relative"))


def _response(spark, d):
    """uid, a[24], w[24]: mean and variance of load by hour."""
    m = V.hourly(spark, d).groupBy("uid", F.hour("ts").alias("h")).agg((F.avg("obs") / 100).alias("a"), (F.var_pop("obs") / 1e5).alias("w"))
    cells = F.array_sort(F.collect_list(F.struct("h", "a", "w")))
    return m.groupBy("uid").agg(cells.alias("c")).where("size(c) = 24").select("uid", F.transform("c", lambda x: x["a"]).alias("a"), F.transform("c", lambda x: x["w"]).alias("w"))


_GOAL = [float(5 + h) for h in range(24)]
_RATE = [rate for rate, n in selection.TOU for _ in range(n)]


def _goal_within_reach(p, share=0.1):
    """A share of what all households together use in each hour: 24 sums."""
    told = dict(p.select(F.posexplode("a").alias("h", "a")).groupBy("h").agg(F.sum("a").alias("a")).collect())
    return [share * told.get(h, 0.0) for h in range(24)]


_RESPONSE = "WITH resp AS (SELECT uid, hour(ts) AS h, avg(obs) / 100 AS a, var_pop(obs) / 1e5 AS w FROM hourly GROUP BY 1, 2), tou AS (SELECT h, CASE WHEN h < 10 THEN 0.10074 WHEN h < 21 THEN 0.28719 ELSE 0.17528 END AS q, CAST(5 + h AS DOUBLE) AS g FROM (SELECT unnest(generate_series(0, 23)) AS h)), sched AS (SELECT s, h, CASE WHEN (h - e + 24) % 24 < 6 THEN 1.0 ELSE 0.0 END AS u FROM (VALUES (0, 0), (1, 8), (2, 21)) x(s, e) CROSS JOIN (SELECT h FROM tou)) "


@query(_RESPONSE + "SELECT CAST(h AS INTEGER) AS hour, round(sum(a * u), 6) AS delta, round(sum(w * u * u), 6) AS var FROM resp JOIN sched USING (h) WHERE s = 1 GROUP BY 1")
def aggregate_reduction(spark, d):
    sched = selection.square_wave_schedules(spark, [0, 8, 21], 6).where("schedule = 1")
    p = _response(spark, d)
    out = selection.aggregate_reduction(p, p.select("uid").crossJoin(F.broadcast(sched)).select("uid", "u"))
    return out.select("hour", r6("delta", "delta"), r6("var", "var"))


@query(_RESPONSE + ", s AS (SELECT h, sum(a * u) AS d, sum(w * u * u) AS v FROM resp JOIN sched USING (h) WHERE s = 2 GROUP BY 1) SELECT round(sum(q * ((d - g) * (d - g) + v)), 4) AS cost FROM s JOIN tou USING (h)")
def expected_cost(spark, d):
    sched = selection.square_wave_schedules(spark, [0, 8, 21], 6).where("schedule = 2")
    p = _response(spark, d)
    tou, goal = selection.tariff_and_goal_tables(spark, _GOAL)
    return selection.expected_cost(p, p.select("uid").crossJoin(F.broadcast(sched)).select("uid", "u"), goal, tou).select(F.round("cost", 4).alias("cost"))


@query(_RESPONSE + "SELECT uid, s AS schedule, round(-sum(q * (u * u * (w + a * a) - 2 * g * u * a)), 5) AS gain FROM resp JOIN sched USING (h) JOIN tou USING (h) GROUP BY 1, 2")
def candidate_gains(spark, d):
    rows = _response(spark, d).crossJoin(F.broadcast(selection.square_wave_schedules(spark, [0, 8, 21], 6)))
    return selection.candidate_gains(rows, [0.0] * 24, _GOAL, _RATE).select("uid", "schedule", F.round("gain", 5).alias("gain"))


@query(_RESPONSE + """, days AS (SELECT uid, CAST(ts AS DATE) AS day, hour(ts) AS h, obs FROM hourly WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM hours GROUP BY 1 HAVING count(*) = 24)),
cov AS (SELECT a.uid, a.h AS h1, b.h AS h2, covar_pop(a.obs, b.obs) / 1e5 AS w FROM days a JOIN days b ON b.uid = a.uid AND b.day = a.day GROUP BY 1, 2, 3)
SELECT CAST(h1 AS INTEGER) AS h1, CAST(h2 AS INTEGER) AS h2, round(sum(x.u * y.u * w), 4) AS var FROM cov JOIN sched x ON x.h = h1 AND x.s = 1 JOIN sched y ON y.h = h2 AND y.s = 1 GROUP BY 1, 2""")
def reduction_covariance(spark, d):
    sched = selection.square_wave_schedules(spark, [0, 8, 21], 6).where("schedule = 1")
    u = V.readings(spark, d).select("uid").distinct().crossJoin(F.broadcast(sched)).select("uid", "u")
    return selection.reduction_covariance(_day_covariances(spark, d), u).withColumn("var", F.round("var", 4))


@query()
def greedy_select(spark, d):
    p = cut_lineage(_response(spark, d))
    out = selection.greedy_select(p, selection.square_wave_schedules(spark, [0, 8, 16], 6), _goal_within_reach(p), _RATE)
    return out.select("step", "uid", "schedule", F.round("gain", 3).alias("gain"), F.round("cost", 3).alias("cost"), "added", "kept")


@query()
def allocate_effort(spark, d):
    out = selection.allocate_effort(_response(spark, d), _GOAL, _RATE, 6.0)
    return out.select("uid", "n_enrolled", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 4).alias("effort"))


@query(_RESPONSE + """, gain AS (SELECT uid, s, round(-sum(q * (u * u * (w + a * a) - 2 * g * u * a)), 6) AS gain FROM resp JOIN sched USING (h) JOIN tou USING (h) GROUP BY 1, 2),
best AS (SELECT uid, arg_min(s, (-gain, s)) AS s, max(gain) AS gain FROM gain GROUP BY 1), place AS (SELECT uid, s, row_number() OVER (ORDER BY -gain, uid) AS place, count(*) OVER () AS n FROM best),
pc AS (SELECT unnest([25.0, 50.0, 100.0]) AS percent)
SELECT CAST(percent AS DOUBLE) AS percent, CAST(h AS INTEGER) AS hour, round(sum(a * u), 6) AS delta, round(sqrt(sum(w * u * u)), 6) AS sd, any_value(g) AS g
FROM place JOIN pc ON 100.0 * place / n <= percent JOIN resp USING (uid) JOIN sched USING (s, h) JOIN tou USING (h) GROUP BY 1, 2""")
def goal_match(spark, d):
    """Users enrolled in the order of the gain of their best single schedule."""
    p, sched = cut_lineage(_response(spark, d)), selection.square_wave_schedules(spark, [0, 8, 21], 6)
    gains = selection.candidate_gains(p.crossJoin(F.broadcast(sched)), [0.0] * 24, _GOAL, _RATE).withColumn("gain", r6("gain"))
    best = gains.groupBy("uid").agg(F.min(F.struct(-F.col("gain"), F.col("schedule"))).alias("b")).select("uid", F.col("b.schedule").alias("schedule"), F.col("b").getField("col1").alias("step"))
    _, goal = selection.tariff_and_goal_tables(spark, _GOAL)
    out = selection.goal_match(best, p, sched, goal, [25.0, 50.0, 100.0])
    return out.select("percent", "hour", r6("delta", "delta"), r6("sd", "sd"), "g")


@query()
def budget_sweep(spark, d):
    """All lengths of effort from one hour to twenty."""
    p = cut_lineage(_response(spark, d))
    out = selection.budget_sweep(p, list(range(1, 21)), [0, 8, 16], _goal_within_reach(p), _RATE)
    return out.select("beta", "step", "uid", "schedule", F.round("cost", 3).alias("cost"), "added", "kept")


@query()
def schedule_counts(spark, d):
    """How many of those that the selection for six hours chooses are asked for effort in each hour."""
    sched = selection.square_wave_schedules(spark, [0, 8, 16], 6)
    p = cut_lineage(_response(spark, d))
    return selection.schedule_counts(selection.greedy_select(p, sched, _goal_within_reach(p), _RATE), sched)


@query()
def cluster_schedule_apply(spark, d):
    p = _response(spark, d)
    members, centres = segments.kerror_cluster(p, 3, key="uid", vector="a", error="w")
    tou, goal = selection.tariff_and_goal_tables(spark, _GOAL)
    return selection.cluster_schedule_apply(members.select("uid", "cluster"), centres, p, goal, tou, 6.0).select(F.round("cost", 3).alias("cost"), "n_users")


@query()
def segment_profile(spark, d):
    members, centres = segments.kerror_cluster(_response(spark, d), 3, key="uid", vector="a", error="w")
    out = segments.segment_profile(centres, members)
    return out.select("cluster", "hour", *[F.round(c, 4).alias(c) for c in ("mu", "low", "high", "percent")])


@query("""
WITH f AS (SELECT CAST(hour(ts) AS INTEGER) AS h, avg(temperature_f) AS g FROM weather GROUP BY 1), x AS (SELECT uid, CAST(ts AS DATE) AS day, sqrt(sum((obs - g) * (obs - g))) AS dist FROM hourly JOIN f ON f.h = hour(ts) GROUP BY 1, 2 HAVING count(*) = 24),
m AS (SELECT uid, day, row_number() OVER (PARTITION BY uid ORDER BY dist, day) AS r FROM x QUALIFY r <= 3), v AS (SELECT m.uid, m.r, CAST(hour(y.ts) AS INTEGER) AS hour, y.obs FROM m JOIN hourly y ON y.uid = m.uid AND CAST(y.ts AS DATE) = m.day)
SELECT a.uid AS ui, b.uid AS uj, a.hour, round(avg(a.obs * b.obs), 4) AS m FROM v a JOIN v b ON a.r = b.r AND a.hour = b.hour AND a.uid <= b.uid GROUP BY 1, 2, 3
""")
def response_cross_moment(spark, d):
    forecast = S.long_to_day_profile(A.hourly_forecast_profile(V.weather(spark, d), "temperature_f").select(F.lit(0).alias("uid"), F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), "temperature_f"), "temperature_f")
    days = S.long_to_day_profile(V.hourly(spark, d), "obs")
    matches = W.similar_days(days.crossJoin(F.broadcast(forecast.select(F.col("v").alias("g")))), F.col("g"), 3)
    return selection.response_cross_moment(days, matches).withColumn("m", F.round("m", 4))


def _heated(spark, d):
    return V.hourly(spark, d).join(V.weather(spark, d), "ts").withColumn("t_d", T.degree_offset(F.col("temperature_f")))


@query()
def fit_regimes(spark, d):
    fits = regimes.fit_regimes(_heated(spark, d))
    return fits.select("uid", "kind", "state", "to_state", *[F.round(c, 4).alias(c) for c in ("a", "b", "sd", "loglik")], "iterations")


_ONE = "one AS (SELECT uid, count(*) AS n, regr_intercept(obs, temperature_f - 65) AS a, regr_slope(obs, temperature_f - 65) AS b, sqrt((regr_syy(obs, temperature_f - 65) - regr_sxy(obs, temperature_f - 65) * regr_sxy(obs, temperature_f - 65) / regr_sxx(obs, temperature_f - 65)) / count(*)) AS sd FROM states GROUP BY 1)"


@query("WITH " + _ONE + " SELECT uid, round(a, 4) AS a, round(b, 4) AS b, round(sd, 4) AS sd, round(-n / 2.0 * ln(2 * pi() * sd * sd) - n / 2.0, 3) AS loglik FROM one")
def fit_one_regime(spark, d):
    fits = regimes.fit_regimes(_heated(spark, d), ks=[1]).where("kind = 'response'")
    return fits.select("uid", *[F.round(c, 4).alias(c) for c in ("a", "b", "sd")], F.round("loglik", 3).alias("loglik"))


@query()
def select_model_size(spark, d):
    """Sizes 1 to 3 by even rows, and the likelihood of the chosen size, fitted again on all rows."""
    rows = _heated(spark, d)
    sizes = regimes.cut_lineage(regimes.select_model_size(rows))
    again = regimes.refit_chosen(rows, sizes).where("kind = 'init' AND state = 1").select("uid", "k", F.round("loglik", 3).alias("loglik"), "iterations")
    return sizes.select("uid", "k", F.round("r2", 4).alias("r2"), F.round("mape", 4).alias("mape"), "chosen").join(again, ["uid", "k"], "left")


# Parameters that SQL has too: lines of the level states, their moves, alike starts. Then the passes over time, step by step.
_TABLES = _PARAMS + ", " + _MOVES + """, resp AS (SELECT u.uid, s AS state, coalesce(p.intercept, 0) AS a, coalesce(p.slope, 0) AS b, greatest(coalesce(sqrt(p.v), 1), 1) AS sd, coalesce(sqrt(p.v * (1 / p.n + mx * mx / sxx)), 0) AS se_a, coalesce(sqrt(p.v / sxx), 0) AS se_b FROM everyone u CROSS JOIN three LEFT JOIN par p ON p.uid = u.uid AND p.state = s AND p.slope IS NOT NULL) """
_PASSES = _TABLES.replace("WITH est AS", "WITH RECURSIVE est AS", 1) + """,
r AS MATERIALIZED (SELECT uid, ts, obs, temperature_f - 65 AS t, row_number() OVER (PARTITION BY uid ORDER BY ts) AS n FROM states),
e AS (SELECT r.uid, n, ts, state, -0.5 * pow((obs - a - b * t) / sd, 2) - ln(sd) - 0.5 * ln(2 * pi()) AS l FROM r JOIN resp ON resp.uid = r.uid),
ew AS (SELECT uid, n, ts, max(l) AS top, max(l) FILTER (state = 1) AS l1, max(l) FILTER (state = 2) AS l2, max(l) FILTER (state = 3) AS l3 FROM e GROUP BY 1, 2, 3),
z AS (SELECT r.uid, n, "from" AS i, "to" AS j, exp(b0 + b1 * t) AS q FROM r JOIN tran ON tran.uid = r.uid), zs AS (SELECT uid, n, i, sum(q) AS s FROM z GROUP BY 1, 2, 3),
zw AS (SELECT z.uid, z.n, """ + ", ".join(f"max(q / s) FILTER (z.i = {i} AND j = {j}) AS p{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + """ FROM z JOIN zs ON zs.uid = z.uid AND zs.n = z.n AND zs.i = z.i GROUP BY 1, 2),
w AS MATERIALIZED (SELECT ew.*, exp(l1 - top) AS e1, exp(l2 - top) AS e2, exp(l3 - top) AS e3, """ + ", ".join(f"p{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + """ FROM ew LEFT JOIN zw ON zw.uid = ew.uid AND zw.n = ew.n - 1),
last AS (SELECT uid, max(n) AS n FROM w GROUP BY 1)"""
_FORWARD = """,
f AS (SELECT uid, n, x1 / (x1 + x2 + x3) AS a1, x2 / (x1 + x2 + x3) AS a2, x3 / (x1 + x2 + x3) AS a3, x1 + x2 + x3 AS c FROM (SELECT uid, n, e1 / 3 AS x1, e2 / 3 AS x2, e3 / 3 AS x3 FROM w WHERE n = 1)
  UNION ALL SELECT uid, n, x1 / (x1 + x2 + x3), x2 / (x1 + x2 + x3), x3 / (x1 + x2 + x3), x1 + x2 + x3 FROM (
    SELECT w.uid, w.n, (a1 * p11 + a2 * p21 + a3 * p31) * e1 AS x1, (a1 * p12 + a2 * p22 + a3 * p32) * e2 AS x2, (a1 * p13 + a2 * p23 + a3 * p33) * e3 AS x3 FROM f JOIN w ON w.uid = f.uid AND w.n = f.n + 1)),
ll AS (SELECT f.uid, sum(ln(c)) + sum(top) AS loglik, count(*) AS nobs FROM f JOIN w ON w.uid = f.uid AND w.n = f.n GROUP BY 1)"""
_BACKWARD = """,
wf AS MATERIALIZED (SELECT w.*, f.c, a1, a2, a3 FROM w JOIN f ON f.uid = w.uid AND f.n = w.n),
k AS (SELECT uid, n, CAST(1 AS DOUBLE) AS b1, CAST(1 AS DOUBLE) AS b2, CAST(1 AS DOUBLE) AS b3 FROM last
  UNION ALL SELECT k.uid, k.n - 1, (p11 * e1 * b1 + p12 * e2 * b2 + p13 * e3 * b3) / c, (p21 * e1 * b1 + p22 * e2 * b2 + p23 * e3 * b3) / c, (p31 * e1 * b1 + p32 * e2 * b2 + p33 * e3 * b3) / c
    FROM k JOIN wf ON wf.uid = k.uid AND wf.n = k.n WHERE k.n > 1)"""
_VITERBI = """,
y AS (SELECT uid, n, l1 - top AS s1, l2 - top AS s2, l3 - top AS s3, 0 AS k1, 0 AS k2, 0 AS k3 FROM w WHERE n = 1
  UNION ALL SELECT uid, n, m1 + l1 - h, m2 + l2 - h, m3 + l3 - h, k1, k2, k3 FROM (SELECT *, greatest(m1 + l1, m2 + l2, m3 + l3) AS h FROM (
    SELECT w.uid, w.n, l1, l2, l3, """ + ", ".join(f"greatest(s1 + ln(p1{j}), s2 + ln(p2{j}), s3 + ln(p3{j})) AS m{j}, CASE WHEN s1 + ln(p1{j}) >= greatest(s2 + ln(p2{j}), s3 + ln(p3{j})) THEN 1 WHEN s2 + ln(p2{j}) >= s3 + ln(p3{j}) THEN 2 ELSE 3 END AS k{j}" for j in (1, 2, 3)) + """ FROM y JOIN w ON w.uid = y.uid AND w.n = y.n + 1))),
ym AS MATERIALIZED (SELECT * FROM y),
g AS (SELECT l.uid, l.n, CASE WHEN s1 >= greatest(s2, s3) THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS state FROM last l JOIN ym ON ym.uid = l.uid AND ym.n = l.n
  UNION ALL SELECT g.uid, g.n - 1, CASE g.state WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END FROM g JOIN ym ON ym.uid = g.uid AND ym.n = g.n WHERE g.n > 1)"""


def _table_models(spark, d):
    """Models as tables: of each state its line and residual spread (1 at least) with standard errors, of each move its logit, starts alike."""
    par = _params(spark, d)[1].where("slope IS NOT NULL")
    every = V.readings(spark, d).select("uid").distinct().withColumn("state", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    resp = every.join(par, ["uid", "state"], "left").select("uid", "state", zero("intercept"), zero("slope"), F.greatest(F.coalesce("sigma", F.lit(1.0)), F.lit(1.0)).alias("sd"), zero("se_intercept"), zero("se_slope"))
    return {"model_response": resp, "model_transition": _moves(spark, d), "model_init": every.withColumn("pi", F.lit(1 / 3))}


def _table_fits(models):
    """The tables as one long table of fits, three states for each user."""
    row = lambda df, kind, state, to, a, b, sd: df.select(
        "uid", F.lit(3).alias("k"), F.lit(kind).alias("kind"), F.col(state).alias("state"), to.alias("to_state"), a.alias("a"), b.alias("b"), sd.alias("sd"), F.lit(None).cast("double").alias("loglik"), F.lit(0).alias("iterations")
    )
    none, c = F.lit(0.0), F.col
    return (
        row(models["model_response"], "response", "state", F.lit(0), c("intercept"), c("slope"), c("sd"))
        .unionByName(row(models["model_init"], "init", "state", F.lit(0), c("pi"), none, none))
        .unionByName(row(models["model_transition"], "transition", "from", c("to"), c("b0"), c("b1"), none))
    )


@query(_PASSES + _VITERBI + " SELECT g.uid, CAST(g.state AS INTEGER) AS state, count(*) AS n, round(avg(a + b * t), 4) AS fit FROM g JOIN r ON r.uid = g.uid AND r.n = g.n JOIN resp ON resp.uid = g.uid AND resp.state = g.state GROUP BY 1, 2")
def decode_states(spark, d):
    decoded = regimes.decode_states(_heated(spark, d), _table_fits(_table_models(spark, d)))
    return decoded.groupBy("uid", "state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fit_max"), 4).alias("fit"))


@query(_PASSES + _FORWARD + _BACKWARD + """, h AS (SELECT wf.uid, ts, a1 * b1 AS g1, a2 * b2 AS g2, a3 * b3 AS g3 FROM wf JOIN k ON k.uid = wf.uid AND k.n = wf.n)
SELECT uid, ts, CAST(s AS INTEGER) AS state, round(CASE s WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END / (g1 + g2 + g3), 5) AS gamma FROM h CROSS JOIN three""")
def smooth_states(spark, d):
    shares, _ = regimes.smooth_states(_heated(spark, d), _table_fits(_table_models(spark, d)))
    return shares.withColumn("gamma", F.round("gamma", 5))


@query(_PASSES + _VITERBI + """, v AS (SELECT y.uid, y.n, ts, t, exp(s1) AS d1, exp(s2) AS d2, exp(s3) AS d3, g.state FROM ym y JOIN r ON r.uid = y.uid AND r.n = y.n JOIN g ON g.uid = y.uid AND g.n = y.n),
o AS (SELECT uid, max(a) FILTER (state = 1) AS a1, max(a) FILTER (state = 2) AS a2, max(a) FILTER (state = 3) AS a3, max(b) FILTER (state = 1) AS b1, max(b) FILTER (state = 2) AS b2, max(b) FILTER (state = 3) AS b3 FROM resp GROUP BY 1)
SELECT v.uid, ts, round(CASE state WHEN 1 THEN a1 + b1 * t WHEN 2 THEN a2 + b2 * t ELSE a3 + b3 * t END, 4) AS map_response, round((d1 * (a1 + b1 * t) + d2 * (a2 + b2 * t) + d3 * (a3 + b3 * t)) / (d1 + d2 + d3), 4) AS mean_response FROM v JOIN o ON o.uid = v.uid""")
def map_and_mean_response(spark, d):
    models, rows = _table_models(spark, d), _heated(spark, d)
    decoded = regimes.decode_states(rows, _table_fits(models), inputs=True)
    out = interpret.map_and_mean_response(decoded, models["model_response"].select("uid", "state", "intercept", "slope"))
    return out.select("uid", "ts", F.round("map_response", 4).alias("map_response"), F.round("mean_response", 4).alias("mean_response"))


def _scored(spark, d, rows):
    """The table models with the likelihood that the forward pass gives them."""
    fits = _table_fits(_table_models(spark, d))
    return regimes.model_scores(fits.drop("loglik").join(regimes.log_likelihoods(rows, fits), "uid"), rows)


@query(_PASSES + _FORWARD + " SELECT uid, 3 AS k, 23 AS df, nobs, round(loglik, 2) AS loglik, round(-2 * loglik + 46, 2) AS aic, round(-2 * loglik + ln(nobs) * 23, 2) AS bic FROM ll")
def model_scores(spark, d):
    return _scored(spark, d, _heated(spark, d)).select("uid", "k", "df", "nobs", *[F.round(c, 2).alias(c) for c in ("loglik", "aic", "bic")])


@query(_PASSES + _FORWARD + ", " + _ONE + """, q AS (SELECT ll.uid, 2 * (loglik - (-n / 2.0 * ln(2 * pi() * sd * sd) - n / 2.0)) AS x FROM ll JOIN one ON one.uid = ll.uid)
SELECT uid, round(x, 2) AS statistic, 20 AS df, round(CASE WHEN x <= 0 THEN 1.0 WHEN x > 1400 THEN 0.0 ELSE exp(-x / 2) * list_sum([pow(x / 2, i) / factorial(CAST(i AS INTEGER)) for i in generate_series(0, 9)]) END, 6) AS p FROM q""")
def likelihood_ratio(spark, d):
    rows = _heated(spark, d)
    one = regimes.model_scores(regimes.fit_regimes(rows, ks=[1]), rows)
    out = regimes.likelihood_ratio(one.unionByName(_scored(spark, d, rows)), 1, 3)
    return out.select("uid", F.round("statistic", 2).alias("statistic"), "df", r6("p", "p"))


_PROPAGATED = _TABLES.replace("WITH est AS", "WITH RECURSIVE est AS", 1) + """, fc AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, avg(temperature_f) - 65 AS t FROM weather GROUP BY 1),
z AS (SELECT uid, hour, "from" AS i, "to" AS j, exp(b0 + b1 * t) AS q FROM tran CROSS JOIN fc), zs AS (SELECT uid, hour, i, sum(q) AS s FROM z GROUP BY 1, 2, 3),
zw AS MATERIALIZED (SELECT z.uid, z.hour, """ + ", ".join(f"max(q / s) FILTER (z.i = {i} AND j = {j}) AS p{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + """ FROM z JOIN zs ON zs.uid = z.uid AND zs.hour = z.hour AND zs.i = z.i GROUP BY 1, 2),
dist AS (SELECT uid, -1 AS hour, 1 / 3.0::DOUBLE AS d1, 1 / 3.0::DOUBLE AS d2, 1 / 3.0::DOUBLE AS d3 FROM everyone
  UNION ALL SELECT zw.uid, zw.hour, d1 * p11 + d2 * p21 + d3 * p31, d1 * p12 + d2 * p22 + d3 * p32, d1 * p13 + d2 * p23 + d3 * p33 FROM dist JOIN zw ON zw.uid = dist.uid AND zw.hour = dist.hour + 1),
o AS (SELECT uid""" + "".join(f", max({c}) FILTER (state = {i}) AS {n}{i}" for n, c in (("a", "a"), ("b", "b"), ("y", "sd"), ("ea", "se_a"), ("eb", "se_b")) for i in (1, 2, 3)) + " FROM resp GROUP BY 1)"


def _forecast(spark, d):
    return A.hourly_forecast_profile(V.weather(spark, d), "temperature_f").select("hour", T.degree_offset(F.col("temperature_f")).alias("t"))


@query(_PROPAGATED + " SELECT uid, hour, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM dist WHERE hour >= 0")
def propagate_state_distribution(spark, d):
    _, dist = interpret.propagated(_table_models(spark, d), _forecast(spark, d))
    return dist.select("uid", "hour", *[r6(F.element_at("dist", i), f"d{i}") for i in (1, 2, 3)])


def _moments(kind: str, m: str, e: str) -> str:
    mu = " + ".join(f"d{i} * {m.format(i=i)}" for i in (1, 2, 3))
    second = " + ".join(f"d{i} * ({m.format(i=i)} * {m.format(i=i)} + {e}{i} * {e}{i})" for i in (1, 2, 3))
    return f"SELECT dist.uid, hour, '{kind}' AS kind, round({mu}, 4) AS mu, round(sqrt(greatest({second} - ({mu}) * ({mu}), 0)), 3) AS sd FROM dist JOIN o ON o.uid = dist.uid WHERE hour >= 0"


@query(_PROPAGATED + " " + " UNION ALL ".join(_moments(*x) for x in (("slope", "b{i}", "eb"), ("baseload", "a{i}", "ea"), ("volatility", "(0 * a{i})", "y"))))
def compute_profiles(spark, d):
    out = interpret.compute_profiles(_table_models(spark, d), _forecast(spark, d))
    return out.select("uid", "hour", "kind", F.round("mu", 4).alias("mu"), F.round("sd", 3).alias("sd"))


def _spans(name: str, m: str) -> str:
    """Recursion of mean-weighted and plain state shares from each hour on."""
    step = lambda v: ", ".join(f"{v}1 * p1{j} + {v}2 * p2{j} + {v}3 * p3{j}" for j in (1, 2, 3))
    return f""", {name} AS (SELECT dist.uid, hour AS h1, hour AS h2, d1 * {m}1 AS v1, d2 * {m}2 AS v2, d3 * {m}3 AS v3, d1, d2, d3, d1 * {m}1 + d2 * {m}2 + d3 * {m}3 AS mu FROM dist JOIN o ON o.uid = dist.uid WHERE hour >= 0
  UNION ALL SELECT s.uid, h1, h2 + 1, {step("v")}, {step("d")}, mu FROM {name} s JOIN zw ON zw.uid = s.uid AND zw.hour = h2 + 1)"""


def _spread(kind: str, name: str, m: str, e: str) -> str:
    later = f"(v1 * {m}1 + v2 * {m}2 + v3 * {m}3) - mu * (d1 * {m}1 + d2 * {m}2 + d3 * {m}3)"
    own = " + ".join(f"d{i} * ({m}{i} * {m}{i} + {e}{i} * {e}{i})" for i in (1, 2, 3))
    return f"SELECT s.uid, '{kind}' AS kind, CAST(h1 AS BIGINT) AS h1, CAST(h2 AS BIGINT) AS h2, round(CASE WHEN h1 < h2 THEN {later} ELSE greatest({own} - mu * mu, 0) END, 3) AS cov FROM {name} s JOIN o ON o.uid = s.uid"


@query(_PROPAGATED + _spans("sb", "b") + _spans("sa", "a") + " " + _spread("slope", "sb", "b", "eb") + " UNION ALL " + _spread("baseload", "sa", "a", "ea"))
def profile_covariances(spark, d):
    out = interpret.compute_profile_covariances(_table_models(spark, d), _forecast(spark, d))
    return out.select("uid", "kind", "h1", "h2", F.round("cov", 3).alias("cov"))


@query(_TABLES + """, gr AS (SELECT DISTINCT temperature_f - 65 AS t FROM weather), z AS (SELECT uid, t, "from", "to", exp(b0 + b1 * t) AS e FROM tran CROSS JOIN gr), p AS (SELECT uid, t, "from", "to", e / sum(e) OVER (PARTITION BY uid, t, "from") AS p FROM z),
w AS (SELECT uid, t, max(p) FILTER ("from" = 1 AND "to" = 2) b, max(p) FILTER ("from" = 1 AND "to" = 3) c, max(p) FILTER ("from" = 2 AND "to" = 1) d, max(p) FILTER ("from" = 2 AND "to" = 3) f, max(p) FILTER ("from" = 3 AND "to" = 1) g, max(p) FILTER ("from" = 3 AND "to" = 2) h FROM p GROUP BY 1, 2),
m AS (SELECT uid, t, d * g + d * h + f * g AS x, b * g + b * h + c * h AS y, b * f + c * d + c * f AS z FROM w),
pi AS (SELECT uid, t, s AS state, CASE s WHEN 1 THEN x WHEN 2 THEN y ELSE z END / (x + y + z) AS pi FROM m CROSS JOIN three)
SELECT pi.uid, t, round(sum(pi * b), 5) AS mean_response, round(sum(pi * se_b), 5) AS mean_se, round(arg_min(b, (-round(pi, 9), pi.state)), 5) AS map_response, round(arg_min(se_b, (-round(pi, 9), pi.state)), 5) AS map_se FROM pi JOIN resp ON resp.uid = pi.uid AND resp.state = pi.state GROUP BY 1, 2""")
def response_by_degree(spark, d):
    out = interpret.response_by_degree(interpret.stationary_distribution(_transition(spark, d)), _table_models(spark, d)["model_response"])
    return out.select("uid", "t", *[F.round(c, 5).alias(c) for c in ("mean_response", "mean_se", "map_response", "map_se")])


@query()
def fitted_profiles(spark, d):
    """Profiles of fitted regimes: fit, decode, standard errors of the decoded states, propagate over the mean day."""
    rows = _heated(spark, d)
    fits = regimes.cut_lineage(regimes.fit_regimes(rows))
    models = regimes.split_models(fits)
    decoded = regimes.decode_states(rows, fits).select("uid", "ts", "state").join(rows, ["uid", "ts"])
    errors = interpret.state_standard_errors(decoded, "t_d", "obs").select("uid", "state", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("se_intercept", "se_slope")])
    full = models["model_response"].join(errors, ["uid", "state"], "left").fillna(0.0, ["se_intercept", "se_slope"])
    out = interpret.compute_profiles(models | {"model_response": full}, _forecast(spark, d))
    return out.select("uid", "hour", "kind", F.round("mu", 3).alias("mu"), F.round("sd", 3).alias("sd"))


@query()
def fit_mixture(spark, d):
    rows = V.gappy(spark, d).join(V.weather(spark, d), "ts").withColumn("t_d", T.degree_offset(F.col("temperature_f")))
    return regimes.fit_mixture(rows, 2).select("state", *[F.round(c, 4).alias(c) for c in ("weight", "intercept", "slope", "sd")])


@query()
def fit_families(spark, d):
    """Two classes of readings by several responses at once: size (gamma), circuit (multinomial), a large one or not (binomial), hour and log size (jointly normal), day number (Poisson)."""
    rows = V.readings(spark, d).select("kw", "circuit", (F.col("kw") > 250).cast("double").alias("large"), F.hour("ts").cast("double").alias("hour"), F.log("kw").alias("log_kw"), F.dayofmonth("ts").cast("double").alias("day"))
    responses = [families.Gamma("kw"), families.Multinomial("circuit", ["click", "error", "purchase", "signup", "view"]), families.Binomial("large"), families.Normal("hour", "log_kw"), families.Poisson("day")]
    return families.fit_families(rows, 2, responses).withColumn("value", F.round("value", 4))


def _irls(name: str, table: str, start: str, mean: str, weight: str, rounds: int = 12) -> str:
    """CTEs of reweighted least squares, round by round, on (x, y, m rows)."""
    out, at = [], f"(SELECT *, {start} AS eta FROM {table})"
    for i in range(rounds):
        out.append(f"""{name}{i} AS (SELECT (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS a, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b FROM (
  SELECT sum(m * w) AS s0, sum(m * w * x) AS s1, sum(m * w * x * x) AS s2, sum(m * w * (eta + (y - mu) / w)) AS t0, sum(m * w * x * (eta + (y - mu) / w)) AS t1 FROM (SELECT *, {weight} AS w FROM (SELECT *, {mean} AS mu FROM {at}))))""")
        at = f"(SELECT t.*, a + b * x AS eta FROM {table} t CROSS JOIN {name}{i})"
    return ", ".join(out)


@query(f"""
WITH c AS (SELECT (temperature_f - 65) / 10 AS x, CAST(n AS DOUBLE) AS y, count(*) AS m FROM (SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM readings GROUP BY 1) JOIN weather USING (ts) GROUP BY 1, 2),
o AS (SELECT (temperature_f - 65) / 10 AS x, CAST(obs > 0 AS DOUBLE) AS y, count(*) AS m FROM states GROUP BY 1, 2),
{_irls("p", "c", "ln(y + 0.1)", "exp(eta)", "mu")}, {_irls("l", "o", "ln((y + 0.5) / (1.5 - y))", "1 / (1 + exp(-eta))", "mu * (1 - mu)")}
SELECT 'readings' AS response, round(a, 5) AS intercept, round(b, 5) AS slope FROM p11 UNION ALL SELECT 'on', round(a, 5), round(b, 5) FROM l11
""")
def fit_regressions(spark, d):
    """Counts of readings an hour, and whether a household uses any load, on temperature: Poisson and binomial regressions."""
    x = ((F.col("temperature_f") - 65) / 10).alias("x")
    counts = V.readings(spark, d).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("readings")).join(V.weather(spark, d), "ts").select(x, "readings")
    used = V.states(spark, d).select(x, (F.col("obs") > 0).cast("double").alias("on"))
    fits = [families.fit_families(rows, 1, [families.Regression(y, ["x"], kind)], iterations=50, tol=1e-15) for rows, y, kind in ((counts, "readings", "poisson"), (used, "on", "binomial"))]
    pick = lambda name: F.round(F.max(F.when(F.col("parameter") == name, F.col("value"))), 5)
    return fits[0].unionByName(fits[1]).groupBy("response").agg(pick("(intercept)").alias("intercept"), pick("x").alias("slope"))


@query()
def impute_regression(spark, d):
    rows = V.gappy(spark, d).withColumns({"hour": F.hour("ts"), "obs": F.when(F.col("obs") <= 400, F.col("obs"))}).join(V.weather(spark, d), "ts")
    return C.impute_regression(cut_lineage(rows), ["obs", "temperature_f"], ["hour"]).select("uid", "ts", F.round("obs", 3).alias("obs"))


@query("""
WITH r AS (SELECT uid, ts, CASE WHEN obs <= 400 THEN obs END AS y, temperature_f AS t, CAST(hour(ts) AS DOUBLE) AS h FROM gappy JOIN weather USING (ts)),
m AS (SELECT avg(y) AS y, avg(t) AS t, avg(h) AS h, var_pop(t) AS tt, var_pop(h) AS hh, covar_pop(t, h) AS th, covar_pop(t, y) AS ty, covar_pop(h, y) AS hy FROM r WHERE y IS NOT NULL),
c AS (SELECT *, (hh * ty - th * hy) / (tt * hh - th * th) AS b, (tt * hy - th * ty) / (tt * hh - th * th) AS d FROM m)
SELECT uid, ts, round(coalesce(r.y, c.y + b * (r.t - c.t) + d * (r.h - c.h)), 4) AS obs FROM r CROSS JOIN c""")
def impute_linear(spark, d):
    rows = V.gappy(spark, d).withColumns({"hour": F.hour("ts"), "obs": F.when(F.col("obs") <= 400, F.col("obs"))}).join(V.weather(spark, d), "ts")
    return C.impute_regression(rows, ["obs"], ["temperature_f", "hour"], method="regression").select("uid", "ts", F.round("obs", 4).alias("obs"))


@query("""
WITH f AS (SELECT circuit AS station, date_trunc('minute', ts) AS ts, CASE WHEN kw BETWEEN 2 AND 400 THEN kw END AS v, row_number() OVER (PARTITION BY circuit, date_trunc('minute', ts) ORDER BY seq) AS n FROM readings),
o AS (SELECT station, ts, v FROM f WHERE n = 1), k AS (SELECT * FROM o WHERE v IS NOT NULL),
g AS (SELECT station, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) AS ts FROM o GROUP BY 1),
b AS (SELECT g.station, g.ts, k.ts AS t0, k.v AS v0 FROM g ASOF LEFT JOIN k ON k.station = g.station AND g.ts >= k.ts),
a AS (SELECT b.*, k.ts AS t1, k.v AS v1 FROM b ASOF LEFT JOIN k ON k.station = b.station AND b.ts <= k.ts),
m AS (SELECT station, ts, coalesce(v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / greatest(epoch(t1) - epoch(t0), 1), v0, v1) AS v FROM a)
SELECT station, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, '15min' AS grain, round(avg(v) + 1e-9, 6) AS temperature FROM m GROUP BY 1, 2 UNION ALL SELECT station, date_trunc('hour', ts), 'hour', round(avg(v) + 1e-9, 6) FROM m GROUP BY 1, 2
""")
def weather_to_grids(spark, d):
    feed = V.readings(spark, d).select(F.col("circuit").alias("station"), F.date_trunc("minute", "ts").alias("ts"), F.col("kw").alias("temperature"), "seq")
    out = R.weather_to_grids(feed, ["temperature"], {"temperature": (2, 400)}, order="seq")
    return out.withColumn("temperature", r6(F.col("temperature") + 1e-9))  # off the ties of rounding


@query()
def drank(spark, d):
    """Daily peaks as replicated scores, against the ranking by total load: its first 5, 10, 25 and 50 users."""
    daily = V.hourly(spark, d).groupBy(F.to_date("ts").alias("rep"), "uid").agg(F.max("obs").alias("score"))
    total = V.gappy(spark, d).groupBy("uid").agg(F.sum("obs").alias("x"))
    truth = ordered_rank(total, [F.col("x").desc(), F.col("uid")]).select("uid", "rank")
    return ranking.drank(daily, truth, [5, 10, 25, 50]).select("k", r6("distance", "distance"), r6("p", "p"))


# ---- detections, autocorrelation of models, orders ------------------------------------------------------------------


@query("""
WITH q AS (SELECT uid, quantile_cont(obs, [0.25, 0.5]) AS q, quantile_cont(temperature_f, [0.25, 0.5]) AS p FROM states GROUP BY 1), g AS (SELECT m, t FROM (VALUES (1.0), (2.0)) x(m) CROSS JOIN (VALUES (1), (2)) y(t)),
s AS (SELECT s.uid, CAST(m AS DOUBLE) AS m, CASE t WHEN 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS t, obs / 100 > m AS m0, temperature_f / 40 > m AS m1, obs > q[t] AS t0, temperature_f > p[t] AS t1 FROM states s JOIN q USING (uid) CROSS JOIN g),
c AS (SELECT * FROM (VALUES (false), (true)) x(first) CROSS JOIN (VALUES (false), (true)) y(second)),
u AS (SELECT uid, m, t, first, second, count(*) FILTER (m0 = first AND m1 = second) / count(*) AS model, count(*) FILTER (t0 = first AND t1 = second) / count(*) AS truth,
             count(*) FILTER (m0 = first AND m1 = second AND t0 = first AND t1 = second) / nullif(count(*) FILTER (t0 = first AND t1 = second), 0) AS match FROM s CROSS JOIN c GROUP BY 1, 2, 3, 4, 5)
SELECT m AS theta_m, t AS theta_t, first, second, round(avg(model), 6) AS model, round(avg(truth), 6) AS truth, round(avg(match), 6) AS match FROM u GROUP BY 1, 2, 3, 4
""")
def detection_tables(spark, d):
    rows = V.states(spark, d).select("uid", (F.col("obs") / 100).alias("load"), "obs", (F.col("temperature_f") / 40).alias("heat"), "temperature_f")
    out = A.detection_tables(rows, [1.0, 2.0], [0.25, 0.5], [("load", "obs"), ("heat", "temperature_f")])
    return out.select("theta_m", "theta_t", "first", "second", *[r6(c, c) for c in ("model", "truth", "match")])


@query("""
WITH q AS (SELECT uid, quantile_cont(obs, [0.25, 0.5, 0.9]) AS q FROM gappy GROUP BY 1), g AS (SELECT m, t FROM (VALUES (1), (2)) x(m) CROSS JOIN (VALUES (1), (2), (3)) y(t)),
s AS (SELECT y.uid, m, t, y.obs / 100 > m AS a, y.obs > q[t] AS b FROM gappy y JOIN q USING (uid) CROSS JOIN g),
u AS (SELECT uid, m, t, (count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0) + count(*) FILTER (NOT a AND NOT b) / nullif(count(*) FILTER (NOT b), 0)) / 2 AS x FROM s GROUP BY 1, 2, 3)
SELECT CAST([0.25, 0.5, 0.9][t] AS DOUBLE) AS theta_t, round(avg(x) FILTER (m = 1), 6) AS m_1, round(avg(x) FILTER (m = 2), 6) AS m_2 FROM u GROUP BY 1
""")
def detection_pivot(spark, d):
    rows = V.gappy(spark, d).select("uid", (F.col("obs") / 100).alias("ratio"), F.col("obs").alias("kwh"))
    out = A.sweep_pivot(A.detection_sweep(rows, [1.0, 2.0], [0.25, 0.5, 0.9]), [1.0, 2.0])
    return out.select("theta_t", r6("m_1", "m_1"), r6("m_2", "m_2"))


@query("""
WITH v AS (SELECT uid, ts, 'own' AS kind, obs AS x FROM states UNION ALL SELECT uid, ts, 'model', temperature_f FROM states), c AS (SELECT uid, kind, row_number() OVER (PARTITION BY uid, kind ORDER BY ts) AS i, x - avg(x) OVER (PARTITION BY uid, kind) AS x FROM v),
t AS (SELECT uid, kind, sum(x * x) AS c0, count(*) AS n FROM c GROUP BY 1, 2), l AS (SELECT unnest(generate_series(1, 6)) AS lag),
a AS (SELECT a.uid, a.kind, lag, sum(a.x * b.x) / any_value(c0) AS acf, any_value(n) AS n FROM c a CROSS JOIN l JOIN c b ON b.uid = a.uid AND b.kind = a.kind AND b.i = a.i - lag JOIN t ON t.uid = a.uid AND t.kind = a.kind GROUP BY 1, 2, 3)
SELECT o.uid, CAST(o.lag AS INTEGER) AS lag, round(o.acf, 6) AS acf, round(m.acf, 6) AS acf_model, abs(o.acf) > 1.96 / sqrt(o.n) AS significant FROM a o JOIN a m ON m.uid = o.uid AND m.lag = o.lag WHERE o.kind = 'own' AND m.kind = 'model'
""")
def acf_against_model(spark, d):
    out = W.acf_against_model(V.states(spark, d), "obs", "temperature_f", 6)
    return out.select("uid", "lag", r6("acf", "acf"), r6("acf_model", "acf_model"), "significant")


@query("SELECT uid, ts, seq, row_number() OVER (ORDER BY uid, ts, seq) AS place FROM readings")
def sort_rows(spark, d):
    return W.sort_rows(V.readings(spark, d).select("uid", "ts", "seq"), "uid", "ts", "seq")


@query("WITH v AS (SELECT c_nationkey AS region, avg(c_acctbal) AS value FROM customer GROUP BY 1) SELECT s_nationkey AS region, s_suppkey, round(value, 6) AS value, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS place FROM supplier JOIN v ON region = s_nationkey", base=False)
def regions_with_values(spark, d):
    values = A.mean_by_group_id(spark.read.parquet(f"{d}/customer.parquet"), "c_nationkey", ["c_acctbal"]).select(F.col("c_nationkey").alias("region"), F.col("c_acctbal").alias("value"))
    points = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("region"), "s_suppkey")
    return J.regions_with_values(points, values, "region", "s_suppkey").withColumn("value", r6("value"))


# ---- files: written below the shared folder and read again ----------------------------------------------------------


@query("SELECT uid, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, round(sum(CAST(kw AS DECIMAL(18, 4))), 4) AS kw FROM readings GROUP BY 1, 2")
def read_meter_tree(spark, d):
    """The readings as a tree of CSV files, <year>/<uid>.csv, and that tree read as one table."""
    path = shared_path(spark, "meters")
    rows = V.readings(spark, d).select(F.year("ts").alias("year"), "uid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("localminute"), "kw")
    schema = "localminute timestamp, kw double"
    if not sinks.write_meter_tree(rows, path):  # no folder either
        return spark.createDataFrame([], "uid long, year int, n long, kw double")
    tree = ingest.read_meter_tree(spark, path, schema, r"(\d{4}|null)/([^/]+)\.csv$")
    return tree.groupBy(F.col("uid").try_cast("long").alias("uid"), "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("kw").cast("decimal(18,4)")), 4).cast("double").alias("kw"))


@query("SELECT 'hour' AS grain, CAST(year(ts) AS INTEGER) AS year, uid, date_trunc('hour', ts) AS ts, round(avg(kw), 6) AS kw FROM readings GROUP BY uid, date_trunc('hour', ts), year(ts)")
def write_usage(spark, d):
    """Hourly means, written by grain and year twice over (the second write replaces its partition alone), and read again."""
    path = shared_path(spark, "usage")
    rows = R.to_hourly(V.readings(spark, d), ["kw"]).select(F.lit("hour").alias("grain"), F.year("ts").alias("year"), "uid", "ts", r6("kw", "kw"))
    sinks.write_usage(rows.unionByName(rows.withColumn("year", F.col("year") - 1).withColumn("kw", F.lit(0.0))), path)
    sinks.write_usage(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.join(rows.select("year").distinct(), "year", "left_semi").select("grain", "year", "uid", "ts", "kw")


@query("SELECT circuit, count(*) AS n FROM readings GROUP BY 1")
def write_new_tables_only(spark, d):
    """Circuits a to p first, then all: the second write appends those that are new."""
    path, rows = shared_path(spark, "circuits"), V.readings(spark, d)
    sinks.write_new_tables_only(rows.where("circuit < 'q'"), path, "circuit")
    sinks.write_new_tables_only(rows, path, "circuit")
    return spark.read.schema(rows.schema).parquet(path).groupBy("circuit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.uid, state, round(slope, 6) AS slope FROM (" + "SELECT uid, state FROM (SELECT DISTINCT uid FROM states) CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS state)" + ") s LEFT JOIN (SELECT uid, state AS st, regr_slope(obs, temperature_f - 65) AS slope FROM states GROUP BY 1, 2 HAVING regr_sxx(obs, temperature_f - 65) > 0) p ON p.uid = s.uid AND p.st = s.state")
def save_models(spark, d):
    """Tables of models saved and loaded; states without a line have none."""
    path = shared_path(spark, "models")
    par = _params(spark, d)[1].select("uid", F.col("state").cast("int").alias("state"), "slope")
    every = V.readings(spark, d).select("uid").distinct().withColumn("state", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    sinks.save_models({"model_response": every.join(par, ["uid", "state"], "left")}, path)
    return sinks.load_models(spark, path, ["model_response"])["model_response"].select("uid", "state", r6("slope", "slope"))


@query(_TABLES + """
SELECT 'model_response' AS part, count(*) AS n, round(sum(CASE WHEN isfinite(slope) THEN slope ELSE 0 END), 4) AS total FROM (SELECT u.uid, s, coalesce(p.slope, 0) AS slope FROM everyone u CROSS JOIN three LEFT JOIN (SELECT * FROM par WHERE slope IS NOT NULL) p ON p.uid = u.uid AND p.state = s)
UNION ALL SELECT 'model_transition', count(*), round(sum(b0), 4) FROM tran UNION ALL SELECT 'model_init', count(*), round(sum(1 / 3.0), 4) FROM everyone CROSS JOIN three
UNION ALL SELECT 'model_perf', count(*), round(sum(CAST(n AS DOUBLE)), 4) FROM (SELECT uid, count(*) AS n FROM states GROUP BY 1) UNION ALL SELECT 'decoded', count(*), round(sum(CAST(state AS DOUBLE)), 4) FROM states
UNION ALL SELECT 'contributions', count(*), round(sum(share), 4) FROM (SELECT uid, state, CAST(count(*) AS DOUBLE) / any_value(n) AS share FROM states JOIN (SELECT uid, count(*) AS n FROM states GROUP BY 1) USING (uid) GROUP BY 1, 2)""")
def model_tables(spark, d):
    """Six model tables saved and loaded by name, states without a line filled with zeros: rows and a sum of each."""
    path, models, rows = shared_path(spark, "models"), _table_models(spark, d), V.states(spark, d)
    lines = _params(spark, d)[1].where("slope IS NOT NULL").select("uid", F.col("state").cast("int").alias("state"), "slope")
    empty = models["model_init"].select("uid", "state").join(lines, ["uid", "state"], "left")
    counts = cut_lineage(rows.groupBy("uid", "state").agg(F.count(F.lit(1)).alias("_c")))
    sizes = counts.groupBy("uid").agg(F.sum("_c").alias("n"))
    shares = counts.join(sizes, "uid").select("uid", "state", (F.col("_c") / F.col("n")).alias("share"))
    tables = {"model_response": empty, "model_transition": models["model_transition"], "model_init": models["model_init"], "model_perf": sizes, "decoded": rows.select("uid", "ts", "state"), "contributions": shares}
    sinks.save_models(tables, path)
    back = sinks.load_models(spark, path, list(tables))
    back["model_response"] = sinks.fill_states(back["model_response"], 3, ["slope"])
    summed = {"model_response": "slope", "model_transition": "b0", "model_init": "pi", "model_perf": "n", "decoded": "state", "contributions": "share"}
    parts = [back[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(c).cast("double")), 4).alias("total")) for name, c in summed.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(_CHANNELS + """SELECT CAST(house AS VARCHAR) AS house, CAST(ch AS INTEGER) AS ch, CASE ch WHEN 1 THEN 'mains' WHEN 2 THEN 'ac' ELSE 'light' END AS label, count(*) AS n, CAST(sum(watt) AS DOUBLE) AS watt FROM channel WHERE ch < 3 AND house IN (SELECT house FROM channel WHERE ch = 2) GROUP BY 1, 2, 3""")
def redd_channels(spark, d):
    """The readings as folders of device channels with their labels, and those of one device and the mains read again."""
    path, rows = shared_path(spark, "channels"), _channels(spark, d)
    labels = rows.select("house", "ch").distinct().select(F.col("house").cast("string"), F.concat_ws(" ", "ch", F.when(F.col("ch") == 1, "mains").when(F.col("ch") == 2, "ac").otherwise("light")).alias("value"), F.lit("labels.dat").alias("file"))
    data = rows.select(F.col("house").cast("string"), F.concat_ws(" ", "utc", F.col("watt").cast("string")).alias("value"), F.format_string("channel_%d.dat", F.col("ch").cast("int")).alias("file"))
    labels.unionByName(data).repartition("house", "file").write.partitionBy("house", "file").text(path)
    out = ingest.redd_channels(spark, path, ["ac"], file=r"house=([^/]+)/file=([^/]+)/[^/]+$")
    return out.groupBy("house", "ch", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("watt").cast("decimal(18,4)")).cast("double").alias("watt"))


@query("""
WITH e AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM readings) SELECT uid, date_trunc('hour', ts) AS ts, round(sum(kw), 6) AS obs, count(*) AS n FROM readings GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', mark) FROM e)
""")
def hourly_stream(spark, d):
    """The readings as a stream, until nothing is left: the hours that the watermark has passed."""
    source, out = shared_path(spark, "arriving"), shared_path(spark, "hours")
    rows = V.readings(spark, d).select("uid", F.col("ts").cast("timestamp").alias("ts"), "kw")
    rows.write.parquet(source)
    stream = rollup.hourly_stream(spark.readStream.schema(rows.schema).parquet(source))
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).withColumn("obs", r6("obs"))
