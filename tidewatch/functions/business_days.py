"""Holidays, business days, months and local days as small date dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: holidays on a fixed day (month, day) per country
FIXED_HOLIDAYS = {
    "se": [(1, 1), (1, 6), (5, 1), (6, 6), (12, 24), (12, 25), (12, 26), (12, 31)],
    "fi": [(1, 1), (1, 6), (5, 1), (12, 6), (12, 24), (12, 25), (12, 26)],
}
# fixed values: days from Easter Sunday, in both countries
EASTER_OFFSETS = [-2, 0, 1, 39, 49]


def with_easter(years: DataFrame) -> DataFrame:
    """Adds ``easter``: the Sunday after the Paschal full moon of each ``year``.

    Gregorian computus by epact, with the solar and lunar corrections as columns of their own,
    so that no step is repeated inside another one.
    """
    steps = {
        "_century": "year div 100 + 1",
        "_golden": "year % 19 + 1",
        "_leap": "_century * 3 div 4 - 12",
        "_letter": "year * 5 div 4 - _leap - 10",
        "_raw": "pmod(_golden * 11 + 20 + (_century * 8 + 5) div 25 - 5 - _leap, 30)",
        "_epact": "_raw + int((_raw = 25 AND _golden > 11) OR _raw = 24)",
        "_moon": "44 - _epact + if(_epact > 23, 30, 0)",
        "_sunday": "_moon + 7 - pmod(_letter + _moon, 7)",
        # counted as a day of March, which may run into April
        "easter": "date_add(make_date(int(year), 3, 1), int(_sunday) - 1)",
    }
    # a later column of one select may use an earlier one
    return years.selectExpr("year", *[f"{e} AS {n}" for n, e in steps.items()]).select(
        "year", "easter"
    )


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(country, date) for every day off in the years given."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").alias("year"))

    def on(month: int, day: int) -> str:
        return f"make_date(int(year), {month}, {day})"

    def on_or_after(date: str, weekday: int) -> str:
        return f"date_add({date}, pmod({weekday} - dayofweek({date}), 7))"

    # midsummer's eve is a Friday, all saints' a Saturday
    moving = [f"date_add(easter, {n})" for n in EASTER_OFFSETS]
    moving += ["_midsummer", "date_add(_midsummer, 1)", on_or_after(on(10, 31), 7)]
    per_country = ", ".join(
        f"'{country}', array({', '.join([*moving, *(on(m, d) for m, d in days)])})"
        for country, days in FIXED_HOLIDAYS.items()
    )
    return (
        with_easter(years)
        .selectExpr("*", f"{on_or_after(on(6, 19), 6)} AS _midsummer")
        .selectExpr(f"explode(map({per_country})) AS (country, dates)")
        .selectExpr("country", "explode(array_distinct(dates)) AS date")
    )


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date).isin(1, 7)


def business_days(dates: DataFrame, calendar: list[str], years: tuple[int, int]) -> DataFrame:
    """The rows of ``dates(date)`` that are business days in every country of the calendar."""
    if not calendar:
        return dates
    off = holidays(dates.sparkSession, *years)
    off = off.where(F.col("country").isin(*calendar)).select("date")
    # a few dozen days a year
    return dates.where(~is_weekend(F.col("date"))).join(F.broadcast(off), "date", "left_anti")


def local_midnight(date: Column, zone: str) -> Column:
    return F.to_utc_timestamp(date.cast("timestamp"), zone)


def month_bounds(at: Column, zone: str) -> Column:
    """The first instant of the local month an instant falls in, and of the next month."""
    first = F.trunc(F.from_utc_timestamp(at, zone), "month")
    return F.struct(
        local_midnight(first, zone).alias("from"),
        local_midnight(F.add_months(first, 1), zone).alias("to"),
    )


def local_days(spark: SparkSession, start: str, end: str, zone: str) -> DataFrame:
    """(day, starts, ends): the period cut at local midnights, ends clipped to the period."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    first = F.to_date(F.from_utc_timestamp(a, zone))
    last = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.unix_micros(b) - 1), zone))
    day = F.col("day")
    return (
        spark.range(1)
        .select(F.explode(F.sequence(first, last)).alias("day"))
        .select(
            "day",
            F.greatest(local_midnight(day, zone), a).alias("starts"),
            F.least(local_midnight(F.date_add(day, 1), zone), b).alias("ends"),
        )
    )
