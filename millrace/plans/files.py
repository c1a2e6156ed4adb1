"""Profiles of landing files and of a whole run."""

from pyspark.sql import functions as F

from millrace.functions.cleaning import as_money
from millrace.functions.timekeeping import ratio, seconds_between
from millrace.model import EVENT_TYPES
from millrace.operators.ordering import running, write_and_read
from millrace.plans.reports import money_mean


def file_profile(landing, file="source_file"):
    """Rows, rows per event type, mean price and time range of each file."""
    kind = F.col("event_type")
    return (
        landing.withColumn("price", as_money("price"))
        .groupBy(file)
        .agg(
            F.count("*").alias("events"),
            *[F.count_if(kind == t).alias(f"{t}_events") for t in EVENT_TYPES],
            money_mean().alias("avg_price"),
            F.min("event_timestamp").alias("first_event"),
            F.max("event_timestamp").alias("last_event"),
        )
    )


def file_running_totals(profile, file="source_file", pin=write_and_read):
    """Files and events so far and events per second so far, in file order."""
    totals = running(
        profile.select(file, "events", "first_event", "last_event").withColumn("one", F.lit(1)),
        [file],
        {
            "files_so_far": ("sum", "one"),
            "total_events": ("sum", "events"),
            "_first": ("min", "first_event"),
            "_last": ("max", "last_event"),
        },
        pin=pin,
    )
    elapsed = seconds_between("_first", "_last").cast("double")
    return totals.select(
        file,
        "events",
        "files_so_far",
        "total_events",
        elapsed.alias("elapsed_seconds"),
        F.try_divide(F.col("total_events").cast("double"), elapsed).alias("events_per_second"),
    )


def run_summary(profile):
    """Events, files, seconds and events per second of a whole run."""
    totals = profile.agg(
        F.sum("events").alias("total_events"),
        F.count("*").alias("total_files"),
        seconds_between(F.min("first_event"), F.max("last_event"))
        .cast("double")
        .alias("elapsed_seconds"),
    )
    return totals.withColumn("events_per_second", ratio("total_events", "elapsed_seconds"))
