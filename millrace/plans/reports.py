"""Reports over stored events. Each takes and returns a DataFrame.

Times have second precision and tie, so every order ends in a unique column.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.timekeeping import hour_of, minute_of, ratio, seconds_between
from millrace.sources.events import after, of_dates

CENTS = "decimal(18,2)"


def money_sum(column="price"):
    return F.sum(column).cast(CENTS)


def money_mean(column="price"):
    """The mean to the cent, from an exact quotient."""
    return F.round(F.try_divide(F.sum(column), F.count(column)), 2).cast(CENTS)


def event_count(events):
    return events.agg(F.count("*").alias("total_events"))


def events_by_type(events):
    return events.groupBy("event_type").agg(F.count("*").alias("event_count"))


def event_summary(events):
    """Events, distinct users, mean price and total value per event type."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("total_events"),
        F.count_distinct("user_id").alias("unique_users"),
        money_mean().alias("avg_price"),
        money_sum().alias("total_value"),
    )


def _hour(events):
    """The hour of each event; a stored table has it as a column, whose statistics let a scan pass
    over files."""
    return F.col("event_hour") if "event_hour" in events.columns else hour_of("event_timestamp")


def hourly_events(events, dates=None):
    """Events and distinct users per hour and type, newest hour first.

    dates, for a stored table, are the dates it holds (see Zones): a join with their hours, which
    drops nothing, leads a condition on event_hour to the folders of its dates.
    """
    hour = _hour(events)
    if dates is not None:
        days = events.sparkSession.createDataFrame([(str(d),) for d in dates], "day string")
        day = F.to_date("day")
        hours = days.select(day.alias("event_date"), F.explode(F.expr(
            "transform(sequence(0, 23), h -> cast(to_date(day) AS timestamp_ntz)"
            " + make_dt_interval(0, h))")).alias("event_hour"))
        # 24 small rows a date.
        events = events.join(F.broadcast(hours), ["event_date", "event_hour"])
    return (
        events.groupBy(hour.alias("event_hour"), "event_type")
        .agg(F.count("*").alias("event_count"), F.count_distinct("user_id").alias("unique_users"))
        .orderBy(F.desc("event_hour"), "event_type")
    )


def last_hours(events, hours=24, now=None):
    """hourly_events of the hours that begin less than so many hours before now.

    now is a timestamp_ntz column without references or a scalar subquery, by
    default the current time.
    """
    now = F.localtimestamp() if now is None else now
    start = now - F.make_dt_interval(hours=F.lit(hours))
    # An hour that begins after start has only events after start.
    return hourly_events(after(events, start)).where(F.col("event_hour") > start)


def newest(events, zones=None):
    """The latest event time: from the zones of a stored table, else as a scalar subquery."""
    if zones is not None and zones.last() is not None:
        return F.lit(str(zones.last())).cast("timestamp_ntz")
    return events.agg(F.max("event_timestamp")).scalar()


def purchase_funnel(events):
    """Views, cart additions and purchases per user."""
    is_type = F.col("event_type")
    return events.groupBy("user_id").agg(
        F.count_if(is_type == "view").alias("views"),
        F.count_if(is_type == "add_to_cart").alias("cart_adds"),
        F.count_if(is_type == "purchase").alias("purchases"),
    )


def funnel_buyers(events):
    return purchase_funnel(events).where("purchases > 0")


def _product_revenue(events):
    return (
        events.where(F.col("event_type") == "purchase")
        .groupBy("product_id", "product_name", "category")
        .agg(F.count("*").alias("purchase_count"), money_sum().alias("total_revenue"))
    )


def top_products(events, n=None):
    """Purchases and revenue per product, highest revenue first."""
    ranked = _product_revenue(events).orderBy(
        F.desc("total_revenue"), "product_id", "product_name", "category"
    )
    return ranked.limit(n) if n is not None else ranked


def _newest_dates(events, n, zones):
    return events if zones is None else of_dates(events, zones.newest(n))


def recent_activity(events, n=100, zones=None):
    """The newest events; with the zones of a stored table only the dates that hold them are read."""
    return (
        _newest_dates(events, n, zones)
        .orderBy(F.desc("event_timestamp"), "event_id")
        .select("event_id", "user_id", "product_name", "event_type", "price", "event_timestamp")
        .limit(n)
    )


def recent_events(events, n=10, zones=None):
    """The newest events with all their columns."""
    latest = _newest_dates(events, n, zones)
    return latest.orderBy(F.desc("event_timestamp"), "event_id").limit(n)


def events_per_minute(events, latest=None):
    """Events per minute, newest first; latest keeps that many minutes."""
    minutes = (
        events.groupBy(minute_of("event_timestamp").alias("minute"))
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("minute"))
    )
    return minutes.limit(latest) if latest is not None else minutes


def event_mix(events):
    """Count, share of all events and price range per type."""
    counts = events.groupBy("event_type").agg(
        F.count("*").alias("event_count"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    # The window sees one row per event type, of which the table allows three.
    total = F.sum("event_count").over(Window.partitionBy())
    return counts.withColumn("share", ratio("event_count", total))


def sample_by_id(events, n=5):
    """A repeatable sample: the events with the smallest hashed ids."""
    return events.orderBy(F.md5("event_id"), "event_id").limit(n)


def events_of(events, column, value):
    """The events of a user or product, newest first. In compacted dates Bloom filters name the
    row groups that may have them."""
    return events.where(F.col(column) == value).orderBy(F.desc("event_timestamp"), "event_id")


def events_of_user(events, user_id):
    return events_of(events, "user_id", user_id)


def events_of_product(events, product_id):
    return events_of(events, "product_id", product_id)


# ---- from the partial results of a stored table (EventTable.states) ---------------


def summary_from_states(users):
    """event_summary from the part ``users``."""
    total = F.sum("value")
    return users.groupBy("event_type").agg(
        F.sum("events").alias("total_events"),
        F.count_distinct("user_id").alias("unique_users"),
        F.round(F.try_divide(total, F.sum("events")), 2).cast(CENTS).alias("avg_price"),
        total.cast(CENTS).alias("total_value"),
    )


def hourly_from_states(users):
    """hourly_events from the part ``users``."""
    return (
        users.groupBy("event_hour", "event_type")
        .agg(F.sum("events").alias("event_count"), F.count_distinct("user_id").alias("unique_users"))
        .orderBy(F.desc("event_hour"), "event_type")
    )


def funnel_from_states(users):
    """purchase_funnel from the part ``users``."""
    def of(kind):
        return F.sum(F.when(F.col("event_type") == kind, F.col("events")).otherwise(0))

    return users.groupBy("user_id").agg(
        of("view").alias("views"), of("add_to_cart").alias("cart_adds"),
        of("purchase").alias("purchases"))


def products_from_states(products, n=None):
    """top_products from the part ``products``."""
    ranked = (
        products.groupBy("product_id", "product_name", "category")
        .agg(F.sum("events").alias("purchase_count"), F.sum("value").cast(CENTS).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "product_id", "product_name", "category")
    )
    return ranked.limit(n) if n is not None else ranked


def span_users(sketches, start, end):
    """About how many different users there were from start to before end, whole hours: the
    sketches of the hours are united, no event and no user is read."""
    hours = sketches.where((F.col("event_hour") >= start) & (F.col("event_hour") < end))
    return hours.agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def _spans(frame, hours, **totals):
    """Totals by hour over the rows that count in it: each counts in its own hour and in those
    after it, ``hours`` in all. Hours without a row of their own are left out."""
    after = F.posexplode(F.transform(
        F.sequence(F.lit(0), hours - 1),
        lambda h: F.col("event_hour") + F.make_dt_interval(hours=h))).alias("_after", "_hour")
    return (
        frame.select("*", after).groupBy(F.col("_hour").alias("event_hour"))
        .agg(F.min("_after").alias("_after"), *[v.alias(k) for k, v in totals.items()])
        .where("_after = 0").drop("_after")
    )


def rolling_users(sketches, hours=24):
    """The same for the ``hours`` up to and with each hour: a sketch is small and goes, one for
    each hour, to the spans it is in."""
    hourly = sketches.groupBy("event_hour").agg(F.hll_union_agg("users").alias("users"))
    return _spans(
        hourly, F.lit(hours), users=F.hll_sketch_estimate(F.hll_union_agg("users")))


def rolling_users_exact(users, hours=24):
    """rolling_users exactly, from the part ``users``.

    A user counts in a span by the last of the user's hours in it, which is an hour's for as many
    spans as there are hours to the user's next one. Users are counted by hour and that number
    first, so that a few rows an hour go to the spans, not every user to every span.
    """
    seen = users.select("event_hour", "user_id").distinct()
    following = F.lead("event_hour").over(Window.partitionBy("user_id").orderBy("event_hour"))
    gap = (seconds_between("event_hour", following) / 3600).cast("int")
    counts = seen.withColumn(
        "gap", F.least(F.coalesce(gap, F.lit(hours)), F.lit(hours))
    ).groupBy("event_hour", "gap").agg(F.count("*").alias("users"))
    return _spans(counts, F.col("gap"), unique_users=F.sum("users"))


def random_sample(events, n=5, seed=None):
    return events.orderBy(F.rand(seed)).limit(n)
