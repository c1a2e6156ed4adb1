"""Reports about the pipeline itself: throughput, latency, integrity, batches."""

from pyspark.sql import functions as F

from millrace.functions.timekeeping import ratio, seconds_between

MAX_LATENCY_SECONDS = 30  # targets of the pipeline
MIN_SUCCESS_RATE = 0.99


def throughput_stats(events):
    """Number of events, first and last event time and the seconds between."""
    stats = events.agg(
        F.count("*").alias("total_events"),
        F.min("event_timestamp").alias("first_event"),
        F.max("event_timestamp").alias("last_event"),
    )
    span = seconds_between("first_event", "last_event").cast("double")
    return stats.withColumn("duration_seconds", span)


def _latency():
    return seconds_between("event_timestamp", "created_at")


def latency_stats(events):
    """Mean, longest and shortest time in seconds from the event to its storing."""
    latency = _latency()
    return events.where(F.col("created_at").isNotNull()).agg(
        F.avg(latency.cast("double")).alias("avg_latency"),
        F.max(latency).cast("double").alias("max_latency"),
        F.min(latency).cast("double").alias("min_latency"),
    )


def slo_report(landed, stored, max_latency=MAX_LATENCY_SECONDS, min_success=MIN_SUCCESS_RATE):
    """Success rate (stored / landed) and latency against their targets."""
    both = landed.select(F.lit(1).alias("landed"), F.lit(None).alias("latency")).unionByName(
        stored.select(F.lit(0).alias("landed"), _latency().alias("latency"))
    )
    measured = F.col("landed") == 0
    counts = both.agg(
        F.count_if(~measured).alias("landed"),
        F.count_if(measured).alias("stored"),
        F.count_if(measured & (F.col("latency") < max_latency)).alias("in_time"),
        F.max("latency").cast("double").alias("max_latency"),
    )
    return counts.select(
        "landed",
        "stored",
        ratio("stored", "landed").alias("success_rate"),
        (ratio("stored", "landed") >= min_success).alias("success_met"),
        ratio("in_time", "stored").alias("in_time_rate"),
        "max_latency",
        (F.col("max_latency") < max_latency).alias("latency_met"),
    )


def integrity_report(landed, stored, rejected, key="event_id"):
    """Whether each landed id is stored once or rejected; rows without an id are counted apart.

    One grouping by id over the three inputs; copies of an id are combined before
    the shuffle, so a much repeated id does no harm.
    """
    tagged = (
        landed.select(key, F.lit(1).alias("l"), F.lit(0).alias("s"), F.lit(0).alias("r"))
        .unionByName(stored.select(key, F.lit(0).alias("l"), F.lit(1).alias("s"), F.lit(0).alias("r")))
        .unionByName(rejected.select(key, F.lit(0).alias("l"), F.lit(0).alias("s"), F.lit(1).alias("r")))
    )
    ids = tagged.groupBy(key).agg(*[F.sum(c).alias(c) for c in "lsr"])
    known = F.col(key).isNotNull()
    return ids.agg(
        F.sum("l").alias("landed_rows"),
        F.sum(F.when(known, 0).otherwise(F.col("l"))).alias("landed_without_id"),
        F.count_if(known & (F.col("l") > 0)).alias("landed_ids"),
        F.sum("s").alias("stored_rows"),
        F.sum(F.when(known & (F.col("s") > 1), F.col("s") - 1).otherwise(0)).alias("duplicates"),
        F.count_if(known & (F.col("r") > 0)).alias("rejected_ids"),
        F.count_if(known & (F.col("l") > 0) & (F.col("s") == 0) & (F.col("r") == 0))
        .alias("lost_ids"),
    )


def batch_counts(judged, batch):
    """Received, valid, invalid and kept (distinct valid ids) rows per batch."""
    return judged.groupBy(batch).agg(
        F.count("*").alias("received"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_distinct(F.when(F.col("is_valid"), F.col("event_id"))).alias("kept"),
    )
