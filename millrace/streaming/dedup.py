"""Deduplication with bounded state while the events are still a stream."""

from pyspark.sql import functions as F

from millrace.functions.timekeeping import as_instant

CLOCK = "event_instant"


def event_clock(stream, delay, time="event_timestamp"):
    """Add the event time as an instant and let it drive the watermark."""
    return stream.withColumn(CLOCK, as_instant(time)).withWatermark(CLOCK, delay)


def stream_dedup(stream, key="event_id", spread=16):
    """Drop re-deliveries that come within the watermark delay of event_clock.

    Later ones pass; the stored table's insert_absent still refuses them. With
    spread > 1 the copies of one id are first thinned out in that many tasks, so
    that a much repeated id does not end up in a single one; the second stage
    alone decides.
    """
    if spread > 1:
        stream = (
            stream.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
            .dropDuplicatesWithinWatermark([key, "_salt"])
            .drop("_salt")
        )
    return stream.dropDuplicatesWithinWatermark([key])
