"""Calendar labels, temperature offsets and dummy columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hour ranges (first, last) of each label; hours outside all of them are Night.
TIME_OF_DAY = {
    "quarters": {"Morning": (5, 11), "Afternoon": (12, 18), "Evening": (19, 21)},
    "long_night": {"Morning": (6, 10), "Afternoon": (11, 18), "Evening": (19, 22)},
}
# Months of summer in the definitions that occur.
SUMMER = {
    "apr_sep": (4, 5, 6, 7, 8, 9),
    "mar_nov": (3, 4, 5, 6, 7, 8, 9, 10, 11),
    "may_oct": (5, 6, 7, 8, 9, 10),
    "may_sep": (5, 6, 7, 8, 9),
    "apr_oct": (4, 5, 6, 7, 8, 9, 10),
}


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the computus."""
    div = lambda a, n: F.floor(a / n)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + w - 7 * div(a + 11 * h + 22 * w, 451) + 114
    return F.make_date(year, div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The nth ``weekday`` (1 Sunday .. 7 Saturday) of a month; the last for n = -1."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, F.pmod(weekday - F.dayofweek(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(F.dayofweek(last) - weekday, F.lit(7)))


def observed(day: Column, saturdays: bool = True) -> Column:
    """A day that falls on a Sunday is kept on the Monday after, one on a Saturday on the Friday before (or, without ``saturdays``, not at all: null)."""
    moved = F.date_sub(day, 1) if saturdays else F.lit(None).cast("date")
    return F.when(F.dayofweek(day) == 1, F.date_add(day, 1)).when(F.dayofweek(day) == 7, moved).otherwise(day)


def holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """day, name of the exchange holidays of each distinct year: moved fixed dates, nth weekdays, and the Friday before Easter.

    Rules hold from the years they were kept: the third Monday of January from 1998, 19 June from 2022.
    """
    y = F.col("y")
    fixed = lambda month, day, **k: observed(F.make_date(y, F.lit(month), F.lit(day)), **k)
    rules = {
        "new_year": fixed(1, 1, saturdays=False), "king": F.when(y >= 1998, nth_weekday(y, 1, 2, 3)), "presidents": nth_weekday(y, 2, 2, 3), "good_friday": F.date_sub(easter(y), 2),
        "memorial": nth_weekday(y, 5, 2, -1), "juneteenth": F.when(y >= 2022, fixed(6, 19)), "independence": fixed(7, 4), "labor": nth_weekday(y, 9, 2, 1),
        "thanksgiving": nth_weekday(y, 11, 5, 4), "christmas": fixed(12, 25),
    }
    each = F.array(*[F.struct(day.alias("day"), F.lit(name).alias("name")) for name, day in rules.items()])
    days = years.select(F.col(year).cast("int").alias("y")).where("y IS NOT NULL").distinct()
    return days.select(F.explode(each).alias("h")).select("h.day", "h.name").where("day IS NOT NULL")


def calendar_features(df: DataFrame, ts: str = "ts", holidays: DataFrame | None = None) -> DataFrame:
    """Adds day_of_week (three letters), month0 (from 0), hour, and is_holiday: a weekend, or a day of ``holidays(day)``.

    A null timestamp gives null labels and no holiday.
    """
    t = F.col(ts)
    out = df.withColumns({"day_of_week": F.date_format(t, "E"), "month0": F.month(t) - 1, "hour": F.hour(t)})
    weekend = F.coalesce(F.dayofweek(t).isin(1, 7), F.lit(False))
    if holidays is None:
        return out.withColumn("is_holiday", weekend)
    days = holidays.select(F.col("day").alias("_holiday")).distinct()
    return (
        out.join(days, F.to_date(t) == F.col("_holiday"), "left")
        .withColumn("is_holiday", weekend | F.col("_holiday").isNotNull())
        .drop("_holiday")
    )


def time_of_day(ts: Column, scheme: str = "quarters") -> Column:
    out = F.when(ts.isNull(), F.lit(None).cast("string"))
    for label, (first, last) in TIME_OF_DAY[scheme].items():
        out = out.when(F.hour(ts).between(first, last), label)
    return out.otherwise("Night")


def season(ts: Column, summer_months: Sequence[int] | str = "apr_sep") -> Column:
    months = SUMMER[summer_months] if isinstance(summer_months, str) else tuple(summer_months)
    return F.when(F.month(ts).isin(*months), "Summer").when(ts.isNotNull(), "Winter")


def degree_offset(t: Column, base: float = 65.0, ts: Column | None = None, months: Sequence[int] | None = None) -> Column:
    """``t - base``; with ``months``, 0 outside them (months are those of ``ts``)."""
    offset = t - F.lit(base)
    return offset if months is None else offset * F.month(ts).isin(*months).cast("double")


def dummy_code(df: DataFrame, col: str, levels: Sequence) -> DataFrame:
    """A 0/1 column ``col_level`` for each level but the first; all 0 for the first level, null for null."""
    return df.withColumns(
        {f"{col}_{x}": F.when(F.col(col).isNotNull(), (F.col(col) == F.lit(x)).cast("int")) for x in levels[1:]}
    )


def clamp_box(df: DataFrame, box: dict[str, tuple[float, float]], group: str, least_extent: float = 1e-6) -> DataFrame:
    """Clips coordinates to a box and drops groups that are then thinner than ``least_extent`` in some coordinate."""
    clipped = df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in box.items()})
    thick = [(F.max(c) - F.min(c) > least_extent) for c in box]
    keep = clipped.groupBy(group).agg(*[t.alias(f"_t{i}") for i, t in enumerate(thick)])
    for i in range(len(thick)):
        keep = keep.where(f"_t{i}")
    return clipped.join(keep.select(group), group, "left_semi")
