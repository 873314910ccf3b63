"""Time buckets with an origin and a zone, and ISO-8601 periods."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    months: int = 0
    micros: int = 0


def period(text: str) -> Period:
    """An ISO-8601 period such as ``P1D``, ``PT48H``, ``P2W``, ``P1M``, ``P1DT1H``; calendar and clock parts may be mixed."""
    m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m or text in ("P", "PT") or text.endswith("T"):
        raise ValueError(f"not an ISO-8601 period: {text!r}")
    y, mo, w, d, h, mi = (int(x or 0) for x in m.groups()[:6])
    return Period(12 * y + mo, round(((((7 * w + d) * 24 + h) * 60 + mi) * 60 + float(m[7] or 0)) * 1_000_000))


def bucket_start(time: Column, length: Period, origin: Column | None = None, zone: str = "UTC") -> Column:
    """The start of the time's bucket. Fixed periods count from the origin in local time; months from the calendar's.

    A period of months is aligned to the month in which the origin lies, whatever its day.
    """
    local = F.from_utc_timestamp(time, zone)
    base = F.from_utc_timestamp(origin if origin is not None else F.lit("2000-01-03 00:00:00").cast("timestamp"), zone)
    if length.months:
        if length.micros:
            raise ValueError("a bucket is of months or of a fixed length")
        index = F.year(local) * 12 + F.month(local) - 1
        start = F.year(base) * 12 + F.month(base) - 1 if origin is not None else F.lit(2000 * 12)
        month = start + F.floor((index - start) / length.months) * length.months
        local_start = F.make_timestamp(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    else:
        lo = F.unix_micros(base)
        local_start = F.timestamp_micros(lo + F.floor((F.unix_micros(local) - lo) / F.lit(length.micros)).cast("long") * F.lit(length.micros))
    return F.to_utc_timestamp(local_start, zone)


def bucket_end(start: Column, length: Period) -> Column:
    """The start plus the period, months by the calendar."""
    moved = F.add_months(F.to_date(start), length.months).cast("timestamp") if length.months else start
    if length.months:
        moved = F.timestamp_micros(F.unix_micros(moved) + F.unix_micros(start) - F.unix_micros(F.to_date(start).cast("timestamp")))
    return F.timestamp_micros(F.unix_micros(moved) + F.lit(length.micros))
