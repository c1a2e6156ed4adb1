"""Zone-free time arithmetic on timestamp_ntz columns.

timestampdiff and date_trunc detour through the session time zone; subtraction,
interval addition and window() do not.
"""

from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def _seconds(interval):
    return interval.cast("interval second").cast("decimal(18,6)")


def seconds_between(start, end):
    """Seconds from start to end as decimal(18,6)."""
    return _seconds(_column(end) - _column(start))


def hour_of(column):
    return F.window(column, "1 hour")["start"]


def minute_of(column):
    return F.window(column, "1 minute")["start"]


def as_instant(column):
    """Wall clock read as UTC: the timestamp that withWatermark accepts."""
    return F.timestamp_seconds(_seconds(_column(column) - F.expr(_EPOCH)))


def as_wall_clock(column):
    """The inverse of as_instant."""
    seconds = (F.unix_micros(column) / 1_000_000).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds)


def event_text(column):
    """The landing format of a time, yyyy-MM-dd HH:mm:ss."""
    return F.substring(_column(column).cast("string"), 1, 19)


def ratio(part, whole):
    """part / whole as double, null when whole is zero."""
    return F.try_divide(_column(part).cast("double"), _column(whole).cast("double"))
