"""Column functions for trigger clock text, days, zones and cron text."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.config import CRON_WEEKDAY, DAY_CODES, DAY_CODES_SUNDAY_FIRST

# Fixed value: accepted clock text (layout 15:04:05 -- hour with one or two
# digits, minute and second with two, optional fractional seconds).
CLOCK_PATTERN = r"^([0-9]|[01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])([.,][0-9]+)?$"

# Fixed value: accepted date text (layout 2006-01-02).
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def clock_ok(text: Column) -> Column:
    """True when the text is a valid clock; NULL/empty are invalid."""
    return F.coalesce(text.rlike(CLOCK_PATTERN), F.lit(False))


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight (seconds dropped); NULL when the text is invalid."""
    h = F.regexp_extract(text, CLOCK_PATTERN, 1).try_cast("int")
    m = F.regexp_extract(text, CLOCK_PATTERN, 2).try_cast("int")
    return F.when(clock_ok(text), h * 60 + m)


def clock_hour(text: Column) -> Column:
    return F.when(clock_ok(text), F.regexp_extract(text, CLOCK_PATTERN, 1).try_cast("int"))


def clock_minute(text: Column) -> Column:
    return F.when(clock_ok(text), F.regexp_extract(text, CLOCK_PATTERN, 2).try_cast("int"))


def clock_text(hour: Column, minute: Column) -> Column:
    """``HH:MM:00``."""
    return F.format_string("%02d:%02d:00", hour, minute)


def in_window(cur: Column, start: Column, end: Column) -> Column:
    """Half-open window, wrapping midnight when start > end; start = end never matches."""
    return F.when(start <= end, (cur >= start) & (cur < end)).otherwise((cur >= start) | (cur < end))


def day_list_codes(days: Column) -> Column:
    """Array of day numbers (Mon = 0) -> ascending CSV of day codes."""
    codes = F.array(*[F.lit(c) for c in DAY_CODES])
    return F.array_join(F.transform(F.array_sort(days), lambda d: F.element_at(codes, d + 1)), ",")


def recurring_codes(recurring: Column) -> Column:
    """Recurring CSV -> trimmed codes."""
    return F.transform(F.split(recurring, ","), lambda x: F.trim(x))


def local_day_code(local_ts: Column) -> Column:
    """Day code of a local wall-clock timestamp (uses Sunday-first code table)."""
    codes = F.array(*[F.lit(c) for c in DAY_CODES_SUNDAY_FIRST])
    return F.element_at(codes, F.dayofweek(local_ts))


def cron_weekdays(recurring: Column) -> Column:
    """Known codes -> cron weekday numbers in list order; none left (or no recurrence) -> ``*``."""
    m = F.create_map(*[x for k, v in CRON_WEEKDAY.items() for x in (F.lit(k), F.lit(str(v)))])
    nums = F.filter(F.transform(recurring_codes(recurring), lambda c: F.try_element_at(m, c)), lambda x: x.isNotNull())
    return F.when(F.coalesce(recurring, F.lit("")) == "", F.lit("*")) \
        .when(F.size(nums) == 0, F.lit("*")) \
        .otherwise(F.array_join(nums, ","))


def cron_text(clock: Column, recurring: Column) -> Column:
    """``M H * * days`` for a valid clock, else NULL."""
    return F.when(clock_ok(clock), F.format_string("%d %d * * %s", clock_minute(clock),
                                                   clock_hour(clock), cron_weekdays(recurring)))


@lru_cache(maxsize=1)
def _zone_names(java_zones: tuple) -> tuple:
    import zoneinfo

    return tuple(sorted(set(java_zones) & set(zoneinfo.available_timezones())))


def valid_zones(spark: SparkSession) -> DataFrame:
    """One row per zone name that both the tz database and the JVM know (bounded, ~600 rows)."""
    jz = tuple(str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    names = _zone_names(jz)
    return spark.createDataFrame([(z,) for z in names], "zone_name string")


def with_zone(df: DataFrame, spark: SparkSession, zone_col: str = "timezone",
              out: str = "zone") -> DataFrame:
    """Resolve a zone column: unknown or empty names become UTC (guard before from_utc_timestamp)."""
    z = F.broadcast(valid_zones(spark))
    return (df.join(z, df[zone_col] == z["zone_name"], "left")
              .withColumn(out, F.coalesce(F.col("zone_name"), F.lit("UTC")))
              .drop("zone_name"))


def date_text_ok(text: Column) -> Column:
    return F.coalesce(text.rlike(DATE_PATTERN) & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(),
                      F.lit(False))
