"""Partial results of the reports, kept beside a table and put together at read."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from millrace.functions.timekeeping import hour_of
from millrace.session import existing, remove_folders

VALUE = "decimal(38,2)"
# Registers of a sketch: 2 to this power. The error is about 1.04 over the root of their number.
SKETCH_BITS = 12
USERS = ["event_hour", "event_type", "user_id"]
PRODUCTS = ["product_id", "product_name", "category"]
PARTS = {
    "users": (USERS, f"event_hour timestamp_ntz, event_type string, user_id string, "
                     f"events bigint, value {VALUE}"),
    "products": (PRODUCTS, f"product_id string, product_name string, category string, "
                           f"events bigint, value {VALUE}"),
    "sketches": (["event_hour"], "event_hour timestamp_ntz, users binary"),
}


def of_events(events, part):
    """The partial results of some events: events and their value per user, type and hour;
    purchases and revenue per product; or a sketch of the users per hour."""
    if part == "products":
        events = events.where(F.col("event_type") == "purchase")
    else:
        events = events.withColumn("event_hour", hour_of("event_timestamp"))
    if part == "sketches":
        return events.groupBy("event_hour").agg(
            F.hll_sketch_agg("user_id", F.lit(SKETCH_BITS)).alias("users"))
    return _combined(events.withColumns({"events": F.lit(1), "value": F.col("price")}), part)


def _combined(rows, part):
    """Partial results of one part put together."""
    rows = rows.groupBy(*PARTS[part][0])
    if part == "sketches":
        return rows.agg(F.hll_union_agg("users").alias("users"))
    return rows.agg(
        F.sum("events").cast("bigint").alias("events"), F.sum("value").cast(VALUE).alias("value"))


@dataclass(frozen=True)
class States:
    """A run of each part per segment of the table's journal. Distinct users stay exact: a user
    is a row of an hour and type, however many events there are."""

    path: str

    def _run(self, part, name):
        return f"{self.path}/{part}/run={name}"

    def _write(self, rows, part, name):
        rows.write.mode("overwrite").parquet(self._run(part, name))

    def write(self, events, name):
        for part in PARTS:
            self._write(of_events(events, part), part, name)

    def read(self, spark, part, names):
        runs = existing(spark, [self._run(part, n) for n in names])
        schema = PARTS[part][1]
        return spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)

    def merge(self, spark, names, name):
        """One run of several."""
        for part in PARTS:
            self._write(_combined(self.read(spark, part, names), part), part, name)

    def remove(self, spark, name):
        for part in PARTS:
            remove_folders(spark, self._run(part, name))
