"""Time helpers independent of the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_instant(text: str) -> Column:
    """TIMESTAMP literal for a UTC wall-clock string ``YYYY-MM-DD HH:MM:SS``."""
    t = dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(int(t.timestamp()) * 1_000_000))


def utc_wall_clock(col, spark) -> Column:
    """TIMESTAMP_NTZ holding the UTC wall-clock time of an instant."""
    c = F.col(col) if isinstance(col, str) else col
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), c.cast("timestamp_ntz"))
