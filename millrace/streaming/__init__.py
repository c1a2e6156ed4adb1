from millrace.streaming.dedup import event_clock, stream_dedup
from millrace.streaming.ingest import Pipeline
from millrace.streaming.monitor import Monitor, processed_files
from millrace.streaming.trends import Trends, hourly_stream, minute_stream

__all__ = [
    "Monitor",
    "Pipeline",
    "Trends",
    "event_clock",
    "hourly_stream",
    "minute_stream",
    "processed_files",
    "stream_dedup",
]
