from millrace.sources.events import Zones, after, between, layout_zones, of_dates, read_events
from millrace.sources.jdbc import Database
from millrace.sources.landing import malformed, read_landing, stream_landing

__all__ = [
    "Database",
    "Zones",
    "after",
    "between",
    "layout_zones",
    "malformed",
    "of_dates",
    "read_events",
    "read_landing",
    "stream_landing",
]
