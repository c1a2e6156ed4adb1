"""Event data with deterministic dirt, derived from the test tables events and part.

raw is a landing frame, dup adds re-deliveries, user_events is what a correct
pipeline stores. The same derivation as SQL is in oracles.py.
"""

from pyspark.sql import functions as F

from millrace.functions.timekeeping import event_text
from millrace.operators import clean, judge, keep_first, to_event_columns, valid


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def as_landing(events, parts):
    """Landing rows from the event table, static or streaming."""
    number = F.col("event_id")
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    product = F.concat(F.lit("prod_"), F.col("p_partkey").cast("string"))
    written = event_text("ts")
    part = F.get_json_object("props", "$.k").cast("bigint")
    # Lines that a query breaks on purpose keep a price that prints alike everywhere.
    plain = (number % 41 != 0) & (number % 43 != 0) & (number % 47 != 0)
    joined = events.join(
        parts.select("p_partkey", "p_name", "p_type"), part == F.col("p_partkey")
    )
    return joined.select(
        F.when(number % 101 == 0, None)
        .when(number % 149 == 0, F.lpad(number.cast("string"), 60, "0"))
        .otherwise(number.cast("string"))
        .alias("event_id"),
        F.when(number % 97 == 0, None)
        .when(number % 89 == 0, F.concat(F.lit("  "), user, F.lit(" ")))
        .when(number % 127 == 0, F.rpad(user, 60, "0"))
        .otherwise(user)
        .alias("user_id"),
        F.when(number % 107 == 0, None)
        .when(number % 139 == 0, F.rpad(product, 60, "0"))
        .otherwise(product)
        .alias("product_id"),
        F.when(number % 109 == 0, "  ")
        .when(number % 131 == 0, F.rpad("p_name", 300, "x"))
        .otherwise(F.col("p_name"))
        .alias("product_name"),
        F.when(number % 113 == 0, None)
        .when(number % 137 == 0, F.rpad("p_type", 120, "x"))
        .otherwise(F.col("p_type"))
        .alias("category"),
        F.when(number % 53 == 0, None)
        .when(number % 59 == 0, -F.col("value"))
        .when(plain & (number % 157 == 0), F.lit(float("inf")))
        .when(plain & (number % 163 == 0), F.lit(1e8))
        .otherwise(F.col("value"))
        .alias("price"),
        F.when(number % 61 == 0, None)
        .when(number % 167 == 0, "wishlist")
        .when(F.col("event_type") == "click", " ADD_TO_CART ")
        .when(F.col("event_type") == "view", "View")
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        F.when(number % 71 == 0, "not-a-date")
        .when(number % 73 == 0, F.replace(written, F.lit(" "), F.lit("T")))
        .when(number % 79 == 0, F.concat(F.lit(" "), written))
        .when(number % 173 == 0, None)
        .otherwise(written)
        .alias("timestamp"),
    )


def with_redeliveries(landing):
    """Every twentieth event arrives twice; one scan serves both deliveries."""
    again = F.col("event_id").cast("bigint") % 20 == 0
    deliveries = F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return landing.withColumn("delivery", F.explode(deliveries))


def raw(spark, sf_dir):
    return as_landing(events(spark, sf_dir), parts(spark, sf_dir))


def dup(spark, sf_dir):
    return with_redeliveries(raw(spark, sf_dir))


def cleaned(spark, sf_dir):
    return clean(dup(spark, sf_dir))


def judged(spark, sf_dir):
    return judge(cleaned(spark, sf_dir))


def user_events(spark, sf_dir):
    return to_event_columns(keep_first(valid(judged(spark, sf_dir)), ["delivery"]))


def with_created_at(stored):
    """Stored at the next full ten seconds after the event; some without a time."""
    second = F.second("event_timestamp")
    wait = F.make_dt_interval(secs=(F.lit(10) - second % 10).cast("decimal(18,6)"))
    unknown = F.col("event_id").cast("bigint") % 83 == 0
    return stored.withColumn(
        "created_at", F.when(~unknown, F.col("event_timestamp") + wait))


def unreadable_price():
    """The price as text, not a number for some events."""
    number = F.col("event_id").cast("bigint")
    return F.when(number % 41 == 0, "invalid_price").otherwise(F.col("price").cast("string"))


def nonconforming(events):
    """Stored rows that break the contract in every way; half of the ids look like UUIDs."""
    number = F.col("event_id").cast("bigint")
    digest = F.md5("event_id")
    uuid = F.concat_ws("-", *[F.substring(digest, i, n) for i, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return events.withColumns({
        "event_id": F.when(number % 2 == 0, uuid).otherwise(F.col("event_id")),
        "event_type": F.when(number % 7 == 0, "other").otherwise(F.col("event_type")),
        "price": F.when(number % 11 == 0, -F.col("price")).otherwise(F.col("price")),
        "event_timestamp": F.when(number % 13 == 0, None).otherwise(F.col("event_timestamp")),
        "product_name": F.when(number % 17 == 0, None).otherwise(F.col("product_name")),
        "category": F.when(number % 19 == 0, F.rpad("category", 101, "x")).otherwise(
            F.col("category")),
    })


def with_losses(events):
    """Stored events of which some are missing and some are there twice."""
    number = F.col("event_id").cast("bigint")
    kept = events.where(number % 31 != 0)
    return kept.unionByName(kept.where(number % 37 == 0))


def file_number():
    """Which landing file an event is in: 500 events each."""
    return F.expr("cast(event_id as bigint) div 500")
