"""Events out to landing files."""

from pyspark.sql import functions as F

from millrace.functions.timekeeping import event_text
from millrace.model import LANDING_COLUMNS


def export_landing(df, path, rows_per_file=None, mode="append"):
    """Write the landing columns as CSV files with a header; returns the path.

    A frame with event_timestamp but no timestamp text gets the text from it.
    Files appear under their final name only when complete.
    """
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", event_text("event_timestamp"))
    writer = df.select(*[F.col(c) for c in LANDING_COLUMNS]).write.mode(mode)
    writer = writer.options(
        header="true",
        escape='"',
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    )
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)
    return path
