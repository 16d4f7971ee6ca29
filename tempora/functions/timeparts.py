"""Column functions on instants and sample values (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_ts(epoch: Column) -> Column:
    """Epoch seconds (number or numeric text) -> TIMESTAMP (session zone UTC)."""
    return F.timestamp_seconds(epoch.cast("double"))


def text_to_value(text: Column) -> Column:
    """Numeric text -> DOUBLE; junk, empty and NaN become NULL."""
    d = text.cast("string").try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def series_id(labels: Column) -> Column:
    """Labels sorted by key, ``k=v`` joined by ``_``."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(labels)),
                    lambda e: F.concat(e["key"], F.lit("="), e["value"])),
        "_")


def bucket(ts: Column, step_minutes: int) -> Column:
    """Floor an instant to a fixed step aligned on the epoch."""
    step = step_minutes * 60
    return F.timestamp_seconds((F.floor(F.unix_seconds(ts) / step) * step))
