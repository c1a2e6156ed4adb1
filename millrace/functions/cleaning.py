"""Column expressions that normalise one landing field."""

from pyspark.sql import functions as F

from millrace.model import MONEY

# Fixed value: the landing timestamp format, yyyy-MM-dd HH:mm:ss.
EVENT_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def tidy(column, blank_is_null=True):
    """Trimmed text; nothing but blanks counts as missing."""
    text = F.trim(column)
    return F.nullif(text, F.lit("")) if blank_is_null else text


def lowered(column, blank_is_null=True):
    return F.lower(tidy(column, blank_is_null))


def parse_event_time(column):
    """Event time as a zone-free timestamp, null unless the text fits the format.

    A guarded try_cast instead of try_to_timestamp: the latter goes through the
    session time zone and moves times that fall into a daylight-saving gap.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.rlike(EVENT_TIME), column.try_cast("timestamp_ntz"))


def as_money(column):
    """decimal(10,2), null if the number does not fit."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast(MONEY)


def event_date(column="event_timestamp"):
    return F.to_date(column)
