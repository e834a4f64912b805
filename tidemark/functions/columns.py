"""Column functions: derived trip measures, bins, calendar parts, coercion, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import MAD_FLOOR, Z_SCALE, resolution_seconds

# ---- fixed values -----------------------------------------------------------
EPS_DIVISOR = 0.001
EMPTY_MARK = "—"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
# ---- end of fixed values ----------------------------------------------------


# -- derived trip measures ----------------------------------------------------

def trip_duration_minutes(pickup="tpep_pickup_datetime", dropoff="tpep_dropoff_datetime") -> Column:
    """Whole seconds between the two timestamps, in minutes."""
    elapsed = (F.col(dropoff) - F.col(pickup)).cast("interval second").cast("bigint")
    return elapsed / F.lit(60.0)


def _ratio(top: Column, bottom: Column, mode: str) -> Column:
    if mode == "null":
        return F.when(bottom > 0, top / bottom)
    if mode == "eps":
        return top / F.when(bottom > 0, bottom).otherwise(F.lit(EPS_DIVISOR))
    raise ValueError(f"mode must be 'null' or 'eps', not {mode!r}")


def trip_speed_mph(mode="null", distance="trip_distance", minutes="trip_duration_minutes") -> Column:
    """Distance per hour; without a positive duration NULL, or per 0.001 h with ``eps``."""
    return _ratio(F.col(distance), F.col(minutes) / F.lit(60.0), mode)


def price_per_distance(mode="null", total="total_amount", distance="trip_distance") -> Column:
    """Total amount per distance unit; same rule for non-positive distances."""
    return _ratio(F.col(total), F.col(distance), mode)


def entry_speed(distance="trip_distance", minutes="trip_duration_minutes") -> Column:
    """Speed of an entered record: NULL when an input is missing, zero or negative."""
    d, m = F.col(distance), F.col(minutes)
    return F.when((d != 0) & (m > 0), d / (m / F.lit(60.0)))


def entry_price_per_distance(total="total_amount", distance="trip_distance") -> Column:
    """Price per distance of an entered record, with the same zero rule."""
    t, d = F.col(total), F.col(distance)
    return F.when((t != 0) & (d > 0), t / d)


# -- time ---------------------------------------------------------------------

def seconds_of_day(ts: str | Column = "ts") -> Column:
    """Seconds since midnight."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def bin_floor(ts: str | Column, width: int | Column) -> Column:
    """Start of the bin holding a naive timestamp; bins of any width are counted from 1970.

    ``width`` is seconds, or a column of seconds that divide a day.  A width that
    divides a day is floored within the day, which is the same.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    if isinstance(width, int) and 86400 % width:
        epoch = F.lit("1970-01-01").cast("date")
        second = F.datediff(F.to_date(ts), epoch).cast("bigint") * 86400 + seconds_of_day(ts)
        second = second - F.pmod(second, F.lit(width))
        days = F.floor(second / 86400).cast("int")
        return F.date_add(epoch, days).cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.pmod(second, F.lit(86400)).cast("decimal(18,6)"))
    width = F.lit(width) if isinstance(width, int) else width
    second = seconds_of_day(ts)
    second = second - second % width
    midnight = F.to_date(ts).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))


def bin_to(ts: str | Column, resolution: str) -> Column:
    """:func:`bin_floor` by resolution code."""
    return bin_floor(ts, resolution_seconds(resolution))


def trunc_minute(ts: str | Column) -> Column:
    return bin_floor(ts, 60)


def trunc_hour(ts: str | Column) -> Column:
    return bin_floor(ts, 3600)


def trunc_day(ts: str | Column) -> Column:
    return bin_floor(ts, 86400)


def weekday_sunday0(ts: str | Column = "ts") -> Column:
    return F.dayofweek(ts) - 1


def time_features(ts: str | Column = "ts") -> list[Column]:
    """Weekday (Sunday=0), hour, minute and second."""
    return [
        weekday_sunday0(ts).alias("wd"),
        F.hour(ts).alias("hour"),
        F.minute(ts).alias("minute"),
        F.second(ts).alias("second"),
    ]


def seconds_from(value: Column, is_text: bool) -> Column:
    """Seconds of the day from an ``HH:mm:ss`` text or an integer."""
    if not is_text:
        return value.cast("int")
    part = F.split(value, ":")
    hms = [F.coalesce(F.get(part, i).try_cast("double"), F.lit(0.0)) for i in range(3)]
    return F.floor(hms[0] * 3600 + hms[1] * 60 + hms[2]).cast("int")


def day_name(ts: str | Column) -> Column:
    """Full English weekday name."""
    return F.date_format(ts, "EEEE")


def is_us_holiday(day: str | Column, first_year: int = 2014, last_year: int = 2019) -> Column:
    """Whether a date is a US federal holiday, observed days included.

    Written as calendar rules, so it needs no table and no join.
    """
    day = F.to_date(day)

    def fixed(d):
        m, n = F.month(d), F.dayofmonth(d)
        return (
            ((m == 1) & (n == 1)) | ((m == 7) & (n == 4))
            | ((m == 11) & (n == 11)) | ((m == 12) & (n == 25))
        )

    month, of_month, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)

    def nth(m, wd, low):
        return (month == m) & (weekday == wd) & of_month.between(low, low + 6)

    floating = [nth(1, 0, 15), nth(2, 0, 15), nth(5, 0, 25), nth(9, 0, 1), nth(10, 0, 8), nth(11, 3, 22)]
    observed = [
        (weekday == 4) & fixed(F.date_add(day, 1)),
        (weekday == 0) & fixed(F.date_sub(day, 1)),
    ]
    flag = reduce(lambda a, b: a | b, [fixed(day), *floating, *observed])
    return flag & F.year(day).between(first_year, last_year)


def calendar_features(day: str | Column = "day", first_year=2014, last_year=2019) -> list[Column]:
    """Weekday (Monday=0), month, day, weekend flag and holiday flag of a date."""
    return [
        F.weekday(day).alias("weekday"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day_of_month"),
        (F.weekday(day) >= 5).cast("int").alias("weekend"),
        is_us_holiday(day, first_year, last_year).cast("int").alias("holiday"),
    ]


# -- coercion and text --------------------------------------------------------

def _filled(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(text) != "", F.trim(text))


def coerce_float(text: str | Column) -> Column:
    """Text to double; blank or bad input is NULL."""
    return _filled(text).try_cast("double")


def coerce_int(text: str | Column) -> Column:
    """Text to bigint by way of double, cutting the fraction; bad input is NULL."""
    value = coerce_float(text)
    whole = F.when(~F.isnan(value) & (F.abs(value) < 9.2e18), value)
    return whole.cast("bigint")


def parse_pickup(text: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm`` from the first 16 characters, ``T`` read as a space."""
    head = F.substring(F.replace(_filled(text), F.lit("T"), F.lit(" ")), 1, 16)
    shaped = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), head)
    return F.try_to_timestamp(shaped, F.lit(MINUTE_FORMAT)).cast("timestamp_ntz")


def finite_or_zero(value: str | Column) -> Column:
    """NULL, NaN and infinities become 0."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def display_number(value: str | Column, digits: int = 2) -> Column:
    """Number rounded for display, NULL as empty text."""
    return F.coalesce(F.round(value, digits).cast("string"), F.lit(""))


def display_fixed(value: str | Column, digits: int = 2) -> Column:
    """Number with a fixed count of decimals, NULL as empty text."""
    return F.coalesce(F.format_string(f"%.{digits}f", value), F.lit(""))


def display_time(ts: str | Column) -> Column:
    """Timestamp to the minute, NULL as empty text."""
    return F.coalesce(F.date_format(ts, MINUTE_FORMAT), F.lit(""))


def entry_summary() -> Column:
    """One-line description of an entered record."""
    mark = F.lit(EMPTY_MARK)
    return F.concat(
        F.lit("#"), F.col("id"),
        F.lit(" · "), F.date_format("tpep_pickup_datetime", MINUTE_FORMAT),
        F.lit(" · vendor "), F.coalesce(F.when(F.col("vendorid") != "", F.col("vendorid")), mark),
        F.lit(" · fare "), F.coalesce(F.col("fare_amount").cast("string"), mark),
    )


def series_id(metric="metric", resolution="resolution", vendor="vendor") -> Column:
    return F.concat_ws("__", metric, resolution, vendor)


# -- scores -------------------------------------------------------------------

def robust_z(value: Column, median: Column, mad: Column, zero_mad: str = "floor") -> Column:
    """0.6745 (x - median) / MAD; a MAD of 0 is 1e-9, or gives NULL with ``"null"``."""
    spread = F.when(mad != 0, mad)
    if zero_mad == "floor":
        spread = F.when(mad == 0, F.lit(MAD_FLOOR)).otherwise(mad)
    return F.lit(Z_SCALE) * (value - median) / spread


def clip_lower(value: Column, floor: float = 0.0) -> Column:
    """``max(value, floor)`` that keeps NULL."""
    return F.when(value < floor, F.lit(floor)).otherwise(value)


def outside_band(actual="actual", lower="lower", upper="upper") -> Column:
    """Whether a value lies outside its band; missing values are not outside."""
    y, lo, hi = F.col(actual), F.col(lower), F.col(upper)
    known = ~F.isnan(y.cast("double")) & ~F.isnan(lo) & ~F.isnan(hi)
    return F.coalesce(((y < lo) | (y > hi)) & known, F.lit(False))
