"""Rounding timestamps up to a grid of N minutes that restarts every hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def ceil_to_grid(ts: Column | str, minutes: int | Column = 15) -> Column:
    """Round `ts` up to the next multiple of `minutes` counted from the top of its hour.

    A timestamp on the grid stays put and NULL stays NULL. The type (with or
    without time zone) is kept. A step that does not divide 60 starts again each
    hour and may carry into the next one.

    The gap to the next grid point is computed in whole microseconds, so the
    expression stays inside whole-stage codegen and needs no Python worker.
    """
    if not isinstance(minutes, Column) and (isinstance(minutes, bool) or minutes < 1):
        raise ValueError(f"grid step must be a positive number of minutes, got {minutes!r}")
    ts = F.col(ts) if isinstance(ts, str) else ts
    step = F.lit(minutes).cast("bigint") * F.lit(MICROS_PER_MINUTE)
    seconds_into_hour = F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
    micros_into_hour = (seconds_into_hour * 1_000_000).cast("bigint")
    return ts + F.expr("INTERVAL '0.000001' SECOND") * F.pmod(-micros_into_hour, step)


def ceil_to_grid_seconds(ts: Column | str, minutes: int | Column = 15) -> Column:
    """The grid point as 64-bit seconds since 1970 on the same wall clock."""
    return wall_clock_seconds(ceil_to_grid(ts, minutes))


def wall_clock_seconds(ts: Column | str) -> Column:
    """Whole seconds between 1970-01-01 00:00:00 and the clock reading of `ts`."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    micros = F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))
    return ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("bigint")


def seconds_to_timestamp(seconds: Column | str, with_zone: bool = True) -> Column:
    """Epoch seconds to a timestamp: an instant, or a zone-free clock reading."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    if with_zone:
        return F.timestamp_seconds(seconds)
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.expr("INTERVAL '1' SECOND") * seconds
