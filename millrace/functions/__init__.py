from millrace.functions.cleaning import as_money, event_date, lowered, parse_event_time, tidy
from millrace.functions.timekeeping import (
    as_instant,
    as_wall_clock,
    event_text,
    hour_of,
    minute_of,
    ratio,
    seconds_between,
)

__all__ = [
    "as_instant",
    "as_money",
    "as_wall_clock",
    "event_date",
    "event_text",
    "hour_of",
    "lowered",
    "minute_of",
    "parse_event_time",
    "ratio",
    "seconds_between",
    "tidy",
]
