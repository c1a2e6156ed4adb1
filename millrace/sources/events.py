"""The stored event table."""

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.model import STORED, nullable
from millrace.session import existing, read_text

# Rows and times by date, beside the files of a layout.
ZONES_FILE = "_zones.json"


def read_events(spark, path, dates=None):
    """Stored events, with dates only the folders of those are listed and read."""
    reader = spark.read.schema(nullable(STORED))
    if dates is None:
        return reader.parquet(path)
    folders = existing(spark, [f"{path}/event_date={date}" for date in dates])
    if not folders:
        return spark.createDataFrame([], nullable(STORED))
    return reader.option("basePath", path).parquet(*folders)


def between(events, start, end, time="event_timestamp"):
    """start <= event_timestamp < end. On a stored table the date is restricted
    as well, so that whole partitions are skipped.

    start and end are datetime values or timestamp_ntz columns without references.
    """
    start, end = (_moment(x) for x in (start, end))
    kept = events.where((F.col(time) >= start) & (F.col(time) < end))
    if "event_date" in events.columns:
        kept = kept.where(F.col("event_date").between(F.to_date(start), F.to_date(end)))
    return kept


def after(events, start, time="event_timestamp"):
    """start < event_timestamp, on a stored table with the matching dates only."""
    start = _moment(start)
    kept = events.where(F.col(time) > start)
    if "event_date" in events.columns:
        kept = kept.where(F.col("event_date") >= F.to_date(start))
    return kept


@dataclass(frozen=True)
class Zones:
    """Rows, first and last time of each date of a stored table: what decides which dates a report
    has to read, without listing or opening a file."""

    dates: dict

    @classmethod
    def of(cls, found):
        """From (date, rows, first, last) with times as ISO text, several for a date or none."""
        dates = {}
        for date, rows, first, last in found:
            first, last = datetime.fromisoformat(first), datetime.fromisoformat(last)
            n, a, b = dates.get(date, (0, first, last))
            dates[date] = n + rows, min(a, first), max(b, last)
        return cls(dict(sorted(dates.items())))

    def newest(self, n):
        """The latest dates that together hold n rows."""
        rows, chosen = 0, []
        for date in reversed(self.dates):
            if rows >= n:
                break
            rows += self.dates[date][0]
            chosen.append(date)
        return sorted(chosen)

    def within(self, start, end):
        """The dates with events from start to before end, or close to it."""
        return [d for d, (_, first, last) in self.dates.items() if first < end and last >= start]

    def last(self):
        """The latest event time, None if there is none."""
        return max((last for _, _, last in self.dates.values()), default=None)

    def rows(self):
        return sum(n for n, _, _ in self.dates.values())


def layout_zones(spark, path):
    """The zones that write_report_layout has left."""
    return Zones.of(json.loads(read_text(spark, f"{path}/{ZONES_FILE}")))


def of_dates(events, dates):
    """The events of some dates; a stored table is read in the folders of those only."""
    return events.where(F.col("event_date").isin([F.lit(d).cast("date") for d in dates]))


def _moment(value):
    if isinstance(value, datetime):
        return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")
    if isinstance(value, Column):
        return value
    raise TypeError("give a datetime or a column")
