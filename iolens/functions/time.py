"""Time columns (P1, P2, P10, P11, P12). Timestamps are epoch microseconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin widths in microseconds for the named units.
UNIT_MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
LABEL_FORMAT = "MMdd_HH"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_micros(unit) -> int:
    """Width of a bin: 'second' | 'minute' | 'hour' | a number of seconds."""
    if isinstance(unit, (int, float)) and not isinstance(unit, bool):
        if unit <= 0:
            raise ValueError("bin width must be positive")
        return int(round(unit * 1_000_000))
    if unit in UNIT_MICROS:
        return UNIT_MICROS[unit]
    raise ValueError(f"no bin width called {unit!r}; use second, minute, hour or a number of seconds")


def micros_to_datetime(c) -> Column:
    """Epoch us -> 'YYYY-MM-DD HH:MM:SS.ffffff' (UTC session)."""
    return F.date_format(F.timestamp_micros(_c(c)), DATETIME_FORMAT)


def datetime_to_micros(c) -> Column:
    """Text (with or without fraction) -> epoch us; unparsable -> null."""
    return F.unix_micros(F.try_to_timestamp(_c(c)))


def time_floor(c, unit) -> Column:
    """P10: floor an epoch-us column to a bin start (exact integer arithmetic)."""
    w = unit_micros(unit)
    c = _c(c)
    return (c - F.pmod(c, F.lit(w))).cast("long")


def range_label(min_ts, max_ts, short: bool = False) -> Column:
    """P11: 'MMDD_HH-MMDD_HH' (or 'MMDD_HH-HH') from a min and a max timestamp."""
    left = F.date_format(F.timestamp_micros(_c(min_ts)), LABEL_FORMAT)
    right = F.date_format(F.timestamp_micros(_c(max_ts)), "HH" if short else LABEL_FORMAT)
    return F.concat(left, F.lit("-"), right)


def parse_micros(c) -> Column:
    """P12 helper: text epoch-us -> bigint, unparsable -> null."""
    return F.expr(f"try_cast({c} as bigint)") if isinstance(c, str) else c.try_cast("bigint")


def drop_bad_ts(df, col: str = "timestamp"):
    """Coerce unparsable timestamps to null and drop those rows."""
    return df.withColumn(col, parse_micros(col)).na.drop(subset=[col])
