"""Time expressions: source epoch, local time, date operands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_EPOCH_MICROS = 978_307_200_000_000  # 2001-01-01 UTC
MIN_YEAR, MAX_YEAR = 1990, 2200


def from_source_nanos(column: str) -> Column:
    """Named column of nanoseconds since 2001 to a timestamp; NULL stays NULL."""
    return F.timestamp_micros(F.expr(f"{column} div 1000") + F.lit(SOURCE_EPOCH_MICROS))


def local(ts: Column, tz: str) -> Column:
    """Wall-clock time in ``tz``, exact at DST changes."""
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(local(ts, tz))


def midnight(day: Column, tz: str) -> Column:
    """Instant at which the local ``day`` starts."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def date_operand(value: Column, tz: str) -> tuple[Column, Column]:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` (also with slashes) as [start, end) instants.

    Both are NULL when the value is no valid date in the accepted years.
    """
    parts = F.split(value, "[-/]")
    n = F.size(parts)

    def number(i: int) -> Column:
        part = F.get(parts, F.lit(i))
        return F.when(part.rlike(r"^\d{1,9}$"), part.cast("int"))

    year = number(0)
    month = F.when(n >= 2, number(1)).otherwise(F.lit(1))
    day = F.when(n >= 3, number(2)).otherwise(F.lit(1))
    start = F.when(
        (n <= 3) & year.between(MIN_YEAR, MAX_YEAR),
        F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date"),
    )
    end = F.when(n == 1, F.add_months(start, 12)).when(n == 2, F.add_months(start, 1)).otherwise(F.date_add(start, 1))
    return midnight(start, tz), midnight(end, tz)
