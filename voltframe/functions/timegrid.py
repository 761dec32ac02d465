"""Market-local calendar and delivery-grid columns. All instants are UTC ``timestamp`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.schemas import DELIVERY_TIMEZONE, FIXED_HOLIDAYS, MARKET_TIMEZONES

QUARTER_SECONDS = 900


def utc(ts: Column | str) -> Column:
    """Read a zone-less column as UTC (the session zone is UTC)."""
    return F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")


def market_timezone(country_code: str) -> str:
    try:
        return MARKET_TIMEZONES[country_code.upper()]
    except KeyError:
        raise ValueError(f"unsupported country_code: {country_code}") from None


def market_timezone_column(country: Column) -> Column:
    """Time zone of each row's country; raises on an unknown country."""
    zones = F.create_map(*[F.lit(x) for item in MARKET_TIMEZONES.items() for x in item])
    known = F.try_element_at(zones, F.upper(country))
    message = F.concat(F.lit("unsupported country_code: "), F.coalesce(country, F.lit("null")))
    return F.coalesce(known, F.raise_error(message).cast("string"))


def floor_to(ts: Column, seconds: int) -> Column:
    micros, width = F.unix_micros(ts), F.lit(seconds * 1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros, width))


def floor_quarter_hour(ts: Column) -> Column:
    return floor_to(ts, QUARTER_SECONDS)


def local_time(ts: Column, zone: str | Column) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_delivery_date(ts: Column, zone: str | Column = DELIVERY_TIMEZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def offset_minutes(ts: Column, zone: str | Column = DELIVERY_TIMEZONE) -> Column:
    return ((F.unix_seconds(local_time(ts, zone)) - F.unix_seconds(ts)) / F.lit(60)).cast("int")


def _midnight_utc(day: Column, zone: str | Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def delivery_starts(day: Column, zone: str | Column = DELIVERY_TIMEZONE) -> Column:
    """Array of the UTC quarter-hour starts of a local day: 96, or 92/100 when clocks change."""
    return F.sequence(
        _midnight_utc(day, zone),
        _midnight_utc(F.date_add(day, 1), zone) - F.expr("INTERVAL 1 MICROSECOND"),
        F.expr("INTERVAL 15 MINUTES"),
    )


def explode_delivery_day(df: DataFrame, day: str, zone: str | Column = DELIVERY_TIMEZONE) -> DataFrame:
    """One row per delivery interval with its 1-based number and [valid_from, valid_to)."""
    return df.select(
        "*", F.posexplode(delivery_starts(F.col(day), zone)).alias("_i", "valid_from")
    ).select(
        *[F.col(c) for c in df.columns],
        (F.col("_i") + 1).alias("interval_number"),
        "valid_from",
        (F.col("valid_from") + F.expr("INTERVAL 15 MINUTES")).alias("valid_to"),
    )


def interval_number(ts: Column, zone: str | Column = DELIVERY_TIMEZONE, *, strict: bool = True) -> Column:
    """1-based quarter hour within the local delivery day, from two instants (no list scan)."""
    start = _midnight_utc(local_delivery_date(ts, zone), zone)
    elapsed = F.unix_micros(ts) - F.unix_micros(start)
    step = F.lit(QUARTER_SECONDS * 1_000_000)
    number = (elapsed / step).cast("int") + 1
    aligned = F.pmod(elapsed, step) == 0
    if not strict:
        return F.when(aligned, number)
    message = F.lit("timestamp is not aligned to a 15-minute delivery interval")
    return F.when(aligned, number).otherwise(F.raise_error(message).cast("int"))


def expand_to_quarters(df: DataFrame, start: str = "interval_start", end: str = "interval_end") -> DataFrame:
    """Repeat each interval row once per quarter hour it covers, as ``valid_time``."""
    last = F.col(end) - F.expr("INTERVAL 1 MICROSECOND")
    covered = df.filter(F.col(start) < F.col(end))
    return covered.withColumn(
        "valid_time", F.explode(F.sequence(F.col(start), last, F.expr("INTERVAL 15 MINUTES")))
    )


def calendar_columns(ts: Column, country_code: str = "ES") -> dict[str, Column]:
    """Calendar, peak, cyclic and holiday features on the market's local clock."""
    local = local_time(ts, market_timezone(country_code))
    hour, dow, doy = F.hour(local), F.weekday(local), F.dayofyear(local)
    month, day = F.month(local), F.dayofmonth(local)
    if country_code.upper() == "ES":
        holiday = (month * 100 + day).isin([m * 100 + d for m, d in FIXED_HOLIDAYS]).cast("int")
    else:
        holiday = F.lit(0)

    def wave(function, value: Column, period: float) -> Column:
        return function(value * F.lit(2 * math.pi) / F.lit(period))

    return {
        "hour": hour,
        "quarter": F.floor(F.minute(local) / 15).cast("int"),
        "day_of_week": dow,
        "day_of_year": doy,
        "month": month,
        "is_weekend": (dow >= 5).cast("int"),
        "is_holiday": holiday,
        "is_morning_peak": hour.between(8, 11).cast("int"),
        "is_evening_peak": hour.between(19, 22).cast("int"),
        "sin_hour": wave(F.sin, hour, 24.0),
        "cos_hour": wave(F.cos, hour, 24.0),
        "sin_day_of_week": wave(F.sin, dow, 7.0),
        "cos_day_of_week": wave(F.cos, dow, 7.0),
        "sin_day_of_year": wave(F.sin, doy, 365.25),
        "cos_day_of_year": wave(F.cos, doy, 365.25),
    }


def calendar_features(df: DataFrame, column: str = "valid_time", *, country_code: str = "ES") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(column), country_code))


def live_calendar(df: DataFrame, column: str = "valid_time", zone: str = DELIVERY_TIMEZONE) -> DataFrame:
    """The smaller calendar set of the live model."""
    local = local_time(F.col(column), zone)
    return df.withColumns(
        {
            "hour": F.hour(local),
            "quarter": F.floor(F.minute(local) / 15).cast("int"),
            "day_of_week": F.weekday(local),
            "month": F.month(local),
            "is_weekend": (F.weekday(local) >= 5).cast("int"),
        }
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .otherwise("Autumn")
    )


def forecast_intervals(df: DataFrame, target: str, issue_time: str = "issue_time") -> DataFrame:
    """Intervals to forecast per issue: next 24 quarter hours, or tomorrow's local day for prices."""
    issue = F.col(issue_time)
    if target == "demand":
        first = floor_quarter_hour(issue) + F.expr("INTERVAL 15 MINUTES")
        starts = F.transform(
            F.sequence(F.lit(0), F.lit(23)),
            lambda k: F.timestamp_micros(
                F.unix_micros(first) + k.cast("long") * F.lit(QUARTER_SECONDS * 1_000_000)
            ),
        )
    else:
        starts = delivery_starts(F.date_add(local_delivery_date(issue), 1))
    return df.select("*", F.posexplode(starts).alias("_i", "valid_from")).select(
        *[F.col(c) for c in df.columns],
        (F.col("_i") + 1).alias("horizon_step"),
        "valid_from",
        (F.col("valid_from") + F.expr("INTERVAL 15 MINUTES")).alias("valid_to"),
    )
