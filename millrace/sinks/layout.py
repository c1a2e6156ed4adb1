"""Table layouts that let reports skip data."""

import json

from pyspark.sql import functions as F

from millrace.functions.cleaning import event_date
from millrace.functions.timekeeping import hour_of
from millrace.session import write_text
from millrace.sources.events import ZONES_FILE

# Bits of a dimension that curve() interleaves.
CURVE_BITS = 10


def curve(*columns, bits=CURVE_BITS):
    """The place on a Z-order curve through the hashes of some columns: their first bits in turn.
    Rows near each other on it share the first bits of every column's hash."""
    place = F.lit(0).cast("bigint")
    hashes = [F.xxhash64(c) for c in columns]
    for bit in range(bits):
        for h in hashes:
            place = F.shiftleft(place, 1).bitwiseOR(
                F.shiftrightunsigned(h, 63 - bit).bitwiseAND(F.lit(1)))
    return place


def clustered(events):
    """Stored events by date, in tasks of equal size, so that the rows of a user, or of a product,
    are in few files and row groups: about the square root of a date's. Bloom filters name them."""
    # A column, so that the sort compares numbers instead of hashing the texts at each comparison.
    order = ["event_date", "_curve", "event_timestamp", "event_id"]
    placed = events.withColumn("_curve", curve("user_id", "product_id"))
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_curve")


def write_report_layout(events, path, mode="overwrite"):
    """Rewrite events by date, each file sorted by type and time, with the rows and times of each
    date beside them.

    Ranges over (date, type, time, id) give tasks of equal size even if one date
    or type holds most of the rows; the sort makes Parquet statistics selective.
    """
    order = ["event_date", "event_type", "event_timestamp", "event_id"]
    dated = {"event_hour": hour_of("event_timestamp"), "event_date": event_date()}
    (
        events.withColumns(dated)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "static")
        .partitionBy("event_date")
        .parquet(path)
    )
    spark = events.sparkSession
    found = spark.read.parquet(path).groupBy("event_date").agg(
        F.count("*").alias("rows"), F.min("event_timestamp").alias("first"),
        F.max("event_timestamp").alias("last")).collect()
    rows = [[str(r["event_date"]), r["rows"], str(r["first"]), str(r["last"])]
            for r in found if r["event_date"] is not None]
    write_text(spark, f"{path}/{ZONES_FILE}", json.dumps(rows))


def save_bucketed(events, table, buckets, by="user_id", mode="overwrite"):
    """A catalog table in buckets of one column, so that grouping or joining by it
    needs no shuffle. Number the buckets for files of a few hundred megabytes."""
    (
        events.write.mode(mode)
        .format("parquet")
        .bucketBy(buckets, by)
        .sortBy(by)
        .saveAsTable(table)
    )
