"""Epoch and clock conversions, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp; zone-less ones are read in the session zone (UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def hour_minute(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")
