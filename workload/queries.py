"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

import datetime
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.model import CORRUPT, EVENT_COLUMNS, LANDING_COLUMNS
from millrace.operators.ordering import write_and_read
from millrace.plans import files, health, reports
from millrace.plans.views import register_views
from millrace.session import SETTINGS, new_folder
from millrace.sinks import EventTable, Ledger, export_landing, read_rejected, write_report_layout
from millrace.sources import between, layout_zones, malformed, read_landing, stream_landing
from millrace.sources.landing import SOURCE_FILE, SOURCE_TIME
from millrace.streaming import Pipeline, Trends, event_clock, processed_files, stream_dedup
from workload import fixtures as fx

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# ---- scans, cleaning, verdicts -------------------------------------------------


@query
def events_scan(spark, sf_dir):
    return fx.user_events(spark, sf_dir)


@query
def clean_events(spark, sf_dir):
    return fx.cleaned(spark, sf_dir)


@query
def valid_events(spark, sf_dir):
    return op.valid(fx.judged(spark, sf_dir))


@query
def invalid_events(spark, sf_dir):
    return op.rejected(fx.judged(spark, sf_dir))


@query
def null_verdict_rows(spark, sf_dir):
    """Rows a plain conjunction would lose: no rule is false, one is unknown."""
    price, kind = F.col("price"), F.col("event_type")
    plain = (
        F.col("event_id").isNotNull()
        & F.col("user_id").isNotNull()
        & F.col("product_id").isNotNull()
        & kind.isin("view", "add_to_cart", "purchase")
        & (price > 0)
        & F.col("event_timestamp").isNotNull()
    )
    return fx.cleaned(spark, sf_dir).where(plain.isNull())


@query
def rule_violations(spark, sf_dir):
    return op.rule_violations(fx.cleaned(spark, sf_dir))


@query
def basic_rule_violations(spark, sf_dir):
    return op.rule_violations(fx.cleaned(spark, sf_dir), strict=False)


@query
def conformance_report(spark, sf_dir):
    return op.conformance_report(fx.nonconforming(fx.user_events(spark, sf_dir)))


def _broken_lines(spark, sf_dir):
    """The landing rows as CSV lines, some with a bad price, too few or too many fields."""
    number = F.col("event_id").cast("bigint")
    fields = [fx.unreadable_price() if c == "price" else F.col(c) for c in LANDING_COLUMNS]
    full = [F.coalesce(f, F.lit("")) for f in fields]
    line = (
        F.when(number % 43 == 0, F.concat_ws(",", *full[:3]))
        .when(number % 47 == 0, F.concat_ws(",", *full, F.lit("surplus")))
        .otherwise(F.concat_ws(",", *full))
    )
    path = new_folder(spark, "lines")
    fx.raw(spark, sf_dir).select(line.alias("line")).write.text(path)
    return path


@query
def malformed_rows(spark, sf_dir):
    landing = read_landing(spark, _broken_lines(spark, sf_dir), header=False)
    return malformed(landing).select("event_id", F.col(CORRUPT).alias("line"))


@query
def malformed_reasons(spark, sf_dir):
    """How many of those lines are quarantined, by reason."""
    landing = read_landing(spark, _broken_lines(spark, sf_dir), header=False)
    return op.split(landing)[1].groupBy("reasons").agg(F.count("*").alias("rejected_rows"))


@query
def export_roundtrip(spark, sf_dir):
    path = export_landing(fx.user_events(spark, sf_dir), new_folder(spark, "export"))
    return read_landing(spark, path).select(*LANDING_COLUMNS)


# ---- one row per event ---------------------------------------------------------


@query
def dedup_events(spark, sf_dir):
    return op.keep_first(op.valid(fx.judged(spark, sf_dir)), ["delivery"])


def _already_stored(events):
    return events.where(F.col("event_id").cast("bigint") % 3 == 0)


@query
def insert_if_absent(spark, sf_dir):
    events = fx.user_events(spark, sf_dir)
    return op.absent_from(events, _already_stored(events))


@query
def table_insert(spark, sf_dir):
    """The same through the Parquet table: some events first, then all of them."""
    table = EventTable(new_folder(spark, "table"))
    events = fx.user_events(spark, sf_dir)
    first = table.insert_absent(_already_stored(events), batch_id=0)
    table.insert_absent(events, batch_id=1, last_id=first)
    return table.read(spark).select("id", *EVENT_COLUMNS, "batch_id")


@query
def surrogate_ids(spark, sf_dir):
    return op.number_rows(fx.user_events(spark, sf_dir), ["event_timestamp", "event_id"])


# ---- reports -------------------------------------------------------------------


def _report(name, build):
    QUERIES[name] = lambda spark, sf_dir: build(fx.user_events(spark, sf_dir))


def _last_day(events, zones=None):
    return reports.last_hours(events, 24, reports.newest(events, zones))


def _january_days(events):
    return between(events, datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 20))


_report("event_count", reports.event_count)
_report("events_by_type", reports.events_by_type)
_report("event_summary", reports.event_summary)
_report("hourly_events", reports.hourly_events)
_report("hourly_events_last_24h", _last_day)
_report("purchase_funnel", reports.purchase_funnel)
_report("funnel_buyers", reports.funnel_buyers)
_report("top_products", reports.top_products)
_report("top_10_products", lambda events: reports.top_products(events, 10))
_report("recent_activity", reports.recent_activity)
_report("recent_10", reports.recent_events)
_report("events_per_minute", reports.events_per_minute)
_report("latest_minutes", lambda events: reports.events_per_minute(events, 10))
_report("event_mix", reports.event_mix)
_report("sample_events", reports.sample_by_id)
_report("date_range", _january_days)
_report("throughput_stats", health.throughput_stats)
_report("latency_stats", lambda events: health.latency_stats(fx.with_created_at(events)))


@query
def stored_date_range(spark, sf_dir):
    """date_range over a table laid out by date, type and time."""
    return _january_days(_laid_out(spark, sf_dir)[0]).select(*EVENT_COLUMNS)


def _laid_out(spark, sf_dir):
    """A table laid out by date and its zones."""
    path = new_folder(spark, "layout")
    write_report_layout(fx.user_events(spark, sf_dir), path)
    return spark.read.parquet(path), layout_zones(spark, path)


@query
def stored_recent_activity(spark, sf_dir):
    """recent_activity over a table laid out by date: only the newest dates are read."""
    events, zones = _laid_out(spark, sf_dir)
    return reports.recent_activity(events, zones=zones)


@query
def stored_recent_10(spark, sf_dir):
    events, zones = _laid_out(spark, sf_dir)
    return reports.recent_events(events, zones=zones).select(*EVENT_COLUMNS)


@query
def stored_last_24h(spark, sf_dir):
    return _last_day(*_laid_out(spark, sf_dir))


@query
def slo_report(spark, sf_dir):
    stored = fx.with_created_at(fx.user_events(spark, sf_dir))
    return health.slo_report(fx.raw(spark, sf_dir), stored)


@query
def integrity_report(spark, sf_dir):
    """Over a table that lost some events and holds others twice."""
    judged = fx.judged(spark, sf_dir)
    stored = fx.with_losses(fx.user_events(spark, sf_dir))
    return health.integrity_report(judged, stored, op.rejected(judged))


@query
def batch_ledger(spark, sf_dir):
    judged = fx.judged(spark, sf_dir).withColumn("batch", fx.file_number())
    return health.batch_counts(judged, "batch")


def _profile(spark, sf_dir):
    landing = op.clean(fx.raw(spark, sf_dir)).withColumn("file_no", fx.file_number())
    return files.file_profile(landing, "file_no")


@query
def file_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query
def file_running_totals(spark, sf_dir):
    return files.file_running_totals(_profile(spark, sf_dir), "file_no")


@query
def run_summary(spark, sf_dir):
    return files.run_summary(_profile(spark, sf_dir))


# ---- the reports as SQL views --------------------------------------------------

VIEW_SQL = {
    "view_event_summary": "SELECT * FROM v_event_summary",
    "view_hourly_events": "SELECT * FROM v_hourly_events",
    "view_purchase_funnel": "SELECT * FROM v_purchase_funnel WHERE purchases > 0",
    "view_top_products": "SELECT * FROM v_top_products LIMIT 10",
    "view_recent_activity": "SELECT * FROM v_recent_activity",
}


def _view(name, sql):
    def run(spark, sf_dir):
        register_views(fx.user_events(spark, sf_dir))
        return spark.sql(sql)

    QUERIES[name] = run


for _name, _sql in VIEW_SQL.items():
    _view(_name, _sql)


# The trailing hours of the view over a stored table.
VIEW_LAST_DAY = """
SELECT event_hour, event_type, event_count, unique_users FROM v_hourly_events
WHERE event_hour > {newest} - INTERVAL '24' HOUR"""


@query
def view_hourly_last_24h(spark, sf_dir):
    """The condition is on the hour alone; the zones turn it into one on dates."""
    events, zones = _laid_out(spark, sf_dir)
    register_views(events, zones=zones)
    return spark.sql(VIEW_LAST_DAY.format(newest="(SELECT max(event_timestamp) FROM user_events)"))


@query
def view_hourly_since(spark, sf_dir):
    """The same with the newest time as a value."""
    events, zones = _laid_out(spark, sf_dir)
    register_views(events, zones=zones)
    return spark.sql(VIEW_LAST_DAY.format(newest=f"timestamp_ntz'{zones.last()}'"))


# ---- the stored table ------------------------------------------------------------

STRETCHES = 3


def _derived(spark, sf_dir):
    """The events as a working table, for queries that deliver them several times."""
    return write_and_read(fx.user_events(spark, sf_dir))


def _filled(events, table, stretches=STRETCHES):
    """All events in some batches of one stream; the table settles after every two."""
    last = 0
    for n in range(stretches):
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(stretches)) == n)
        last += table.insert_absent(part, n, last_id=last, stream_id="fill", first=n == 0)
    return table


def _table(spark, **options):
    return EventTable(new_folder(spark, "table"), settle_every=2, **options)


@query
def reindexed_insert(spark, sf_dir):
    """A table filled with few ids per index file, opened with more, then with fewer, each time
    with all events delivered again: nothing is stored twice."""
    events = _derived(spark, sf_dir)
    table = _filled(events, _table(spark, ids_per_file=64))
    for n, size in enumerate((1 << 18, 16)):
        table = replace(table, ids_per_file=size)
        table.insert_absent(events, n, stream_id="again", first=n == 0)
        table.settle(spark)
    single = events.where(F.col("event_id").cast("bigint") % 97 == 0)
    table.insert_absent(single, 2, stream_id="again", first=False)
    return table.read(spark).select(*EVENT_COLUMNS)


class _NotRecorded(EventTable):
    """A table whose last batch breaks off after its files are written."""

    def _write(self, *args):
        super()._write(*args)
        raise RuntimeError("injected failure")


@query
def committed_events(spark, sf_dir):
    """Half of the events stored, the others written by a batch that broke off: what the
    reports see is the first half alone."""
    events = fx.user_events(spark, sf_dir)
    table = _table(spark)
    table.insert_absent(_already_stored(events), batch_id=0)
    try:
        _NotRecorded(table.path).insert_absent(events, batch_id=1)
    except RuntimeError:
        pass
    return table.read(spark).select(*EVENT_COLUMNS)


@query
def table_newest(spark, sf_dir):
    """The newest 100 events of the stored table, its dates chosen from the journal."""
    table = _filled(_derived(spark, sf_dir), _table(spark))
    return reports.recent_activity(table.newest(spark, 100))


@query
def table_date_range(spark, sf_dir):
    table = _filled(_derived(spark, sf_dir), _table(spark))
    start, end = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 20)
    return between(table.within(spark, start, end), start, end).select(*EVENT_COLUMNS)


_settled_tables = {}


def _settled(spark, sf_dir):
    """A table with compacted dates, settled batches, a replay and open batches; the queries of a
    session that read it share it."""
    known = spark.sparkContext.applicationId, sf_dir
    if known not in _settled_tables:
        _settled_tables[known] = _settle(spark, sf_dir)
    return _settled_tables[known]


def _settle(spark, sf_dir):
    events = _derived(spark, sf_dir)
    table = _filled(events, _table(spark))
    table.compact(spark, datetime.date(2024, 1, 15))
    last = F.pmod(F.xxhash64("event_id"), F.lit(STRETCHES)) == STRETCHES - 1
    before = table.last_id(spark, STRETCHES - 1, "fill")
    table.insert_absent(events.where(last), STRETCHES - 1, last_id=before, stream_id="fill")
    return table


@query
def summary_from_states(spark, sf_dir):
    """event_summary from the partial results of a table."""
    return reports.summary_from_states(_settled(spark, sf_dir).states(spark))


@query
def hourly_from_states(spark, sf_dir):
    return reports.hourly_from_states(_settled(spark, sf_dir).states(spark))


@query
def funnel_from_states(spark, sf_dir):
    return reports.funnel_from_states(_settled(spark, sf_dir).states(spark))


@query
def products_from_states(spark, sf_dir):
    return reports.products_from_states(_settled(spark, sf_dir).states(spark, "products"), 10)


@query
def rolling_users(spark, sf_dir):
    """Users of the day up to each hour, exactly from the part ``users``, and whether the united
    sketches come within five percent (their stated error is 1.6) or two users of it."""
    table = _settled(spark, sf_dir)
    estimate = reports.rolling_users(table.states(spark, "sketches"))
    exact = reports.rolling_users_exact(table.states(spark))
    apart = F.abs(F.col("users") - F.col("unique_users"))
    return estimate.join(exact, "event_hour").select(
        "event_hour", "unique_users",
        (apart <= F.greatest(F.lit(2), F.col("unique_users") * 0.05)).alias("within"))


def _first_value(events, column):
    return events.agg(F.min(column)).first()[0]


@query
def events_of_user(spark, sf_dir):
    """All events of one user in a table with compacted dates."""
    events = _settled(spark, sf_dir).read(spark)
    user = _first_value(events, "user_id")
    return reports.events_of_user(events, user).select(*EVENT_COLUMNS)


@query
def events_of_product(spark, sf_dir):
    events = _settled(spark, sf_dir).read(spark)
    product = _first_value(events, "product_id")
    return reports.events_of_product(events, product).select(*EVENT_COLUMNS)


# ---- streams -------------------------------------------------------------------


def _stream_session(spark):
    """A session whose settings the stateful streams may pin in their checkpoints."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.streaming.stateStore."):
            session.conf.set(key, value)
    return session


class _Landing:
    """Landing files of the test events: the originals first, the re-deliveries later.

    With corrupt, some prices are not numbers, so that their lines do not parse.
    """

    def __init__(self, session, sf_dir, corrupt=False):
        self.session, self.folder = session, new_folder(session, "landing")
        rows = fx.dup(session, sf_dir)
        if corrupt:
            rows = rows.withColumn("price", fx.unreadable_price())
        self.rows = rows
        # Two files are a micro-batch below, so the originals come in several.
        self.files = max(8, session.sparkContext.defaultParallelism)

    def deliver(self, number):
        part = self.rows.where(F.col("delivery") == number).drop("delivery")
        export_landing(part.repartition(self.files), self.folder)

    def stream(self):
        return stream_landing(self.session, self.folder, max_files=2)

    def run(self, start):
        """start(stream) begins a query that works off what has landed: once after the
        originals and, on the same checkpoint, once more after the re-deliveries."""
        for number in (0, 1):
            self.deliver(number)
            start(self.stream()).awaitTermination()


def _pipeline(session):
    base = new_folder(session, "stream")
    target = EventTable(f"{base}/events")
    return Pipeline(target, f"{base}/rejected", Ledger(f"{base}/ledger")), f"{base}/checkpoint"


def _run(query):
    """Wait for an availableNow query and raise what it raised."""
    query.awaitTermination()


def _ingested(spark, sf_dir, corrupt=False):
    session = _stream_session(spark)
    pipeline, checkpoint = _pipeline(session)
    _Landing(session, sf_dir, corrupt).run(
        lambda stream: pipeline.start(stream, checkpoint, available_now=True))
    return pipeline


@query
def stream_parquet(spark, sf_dir):
    return _ingested(spark, sf_dir).target.read(spark).select(*EVENT_COLUMNS)


@query
def stream_ledger(spark, sf_dir):
    """Counts over all batches, with lines that do not parse."""
    counts = ("received", "corrupt", "valid", "invalid", "kept", "written")
    ledger = _ingested(spark, sf_dir, corrupt=True).ledger.read(spark)
    return ledger.agg(
        *[F.sum(c).alias(c) for c in counts], (F.count("*") >= 4).alias("several_batches"))


@query
def stream_quarantine(spark, sf_dir):
    """The rejected rows read back, with the raw text of lines that do not parse."""
    pipeline = _ingested(spark, sf_dir, corrupt=True)
    columns = [*LANDING_COLUMNS, "raw_line", SOURCE_FILE, SOURCE_TIME, "event_timestamp", "reasons"]
    rows = read_rejected(spark, pipeline.quarantine, columns)
    return rows.select("event_id", "user_id", "timestamp", "raw_line", "reasons")


@query
def stream_new_checkpoint(spark, sf_dir):
    """The originals with one checkpoint, the re-deliveries and what came last with another,
    into the same table: nothing stored is lost, ids go on."""
    session = _stream_session(spark)
    pipeline, checkpoint = _pipeline(session)
    landing = _Landing(session, sf_dir)
    last = F.coalesce(F.col("timestamp") > "2024-01-20", F.lit(False)) | (F.col("delivery") == 1)
    for number, part in enumerate((landing.rows.where(~last), landing.rows.where(last))):
        # The second stream starts anew and takes the folder's earlier files again as well.
        export_landing(part.repartition(landing.files), landing.folder)
        _run(pipeline.start(landing.stream(), f"{checkpoint}-{number}", available_now=True))
    stored = pipeline.target.read(spark)
    written = pipeline.ledger.read(spark).agg(F.sum("written"))
    return stored.agg(
        F.count("*").alias("stored_rows"), F.count_distinct("event_id").alias("stored_ids"),
        F.count_distinct("id").alias("numbers"), F.max("id").alias("last_number"),
        F.count_distinct("stream_id").alias("streams"),
    ).withColumn("written", written.scalar())


@query
def compacted_table(spark, sf_dir):
    """A table of many batches, its closed dates rewritten, with re-deliveries after that."""
    session = _stream_session(spark)
    pipeline, checkpoint = _pipeline(session)
    landing = _Landing(session, sf_dir)
    for number in (0, 1):
        landing.deliver(number)
        _run(pipeline.start(landing.stream(), checkpoint, available_now=True))
        pipeline.target.compact(session, datetime.date(2024, 1, 20))
    return pipeline.target.read(spark).select(*EVENT_COLUMNS)


class _FailsOnce(EventTable):
    """A table whose first second batch breaks off after it was written."""

    broken = False

    def insert_absent(self, events, batch_id, **known):
        written = super().insert_absent(events, batch_id, **known)
        if batch_id == 1 and not _FailsOnce.broken:
            _FailsOnce.broken = True
            raise RuntimeError("injected failure")
        return written


@query
def stream_restart(spark, sf_dir):
    """CSV files in, a failure in the second batch, a restart on the same checkpoint
    after a part of the events was delivered again in new files."""
    session = _stream_session(spark)
    healthy, checkpoint = _pipeline(session)
    landing = _Landing(session, sf_dir)
    landing.deliver(0)
    _FailsOnce.broken = False
    failing = replace(healthy, target=_FailsOnce(healthy.target.path), attempts=1)
    try:
        _run(failing.start(landing.stream(), checkpoint, available_now=True))
    except StreamingQueryException:
        pass
    landing.deliver(1)
    _run(healthy.start(landing.stream(), checkpoint, available_now=True))
    return healthy.target.read(spark).select(*EVENT_COLUMNS)


def _valid(stream):
    """The valid events of a landing stream; the test events' times are a month apart."""
    judged = op.judge(op.clean(stream))
    return event_clock(op.to_event_columns(op.valid(judged)), "31 days")


@query
def stream_dedup_events(spark, sf_dir):
    session = _stream_session(spark)
    base = new_folder(session, "stream")

    def start(stream):
        events = stream_dedup(_valid(stream)).select(*EVENT_COLUMNS)
        writer = events.writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", f"{base}/out")
        return writer.option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start()

    _Landing(session, sf_dir).run(start)
    return spark.read.schema(fx.user_events(spark, sf_dir).schema).parquet(f"{base}/out")


def _trends(spark, sf_dir):
    """Folded after every second batch; the test events are a month apart, so many come late."""
    session = _stream_session(spark)
    base = new_folder(session, "trends")
    trends = Trends(f"{base}/counts", delay="1 day", fold_every=2)
    _Landing(session, sf_dir).run(lambda stream: trends.start(
        stream_dedup(_valid(stream)), f"{base}/checkpoint", available_now=True))
    return trends


@query
def stream_hourly(spark, sf_dir):
    return _trends(spark, sf_dir).hourly(spark)


@query
def stream_minutes(spark, sf_dir):
    return _trends(spark, sf_dir).minutes(spark)


@query
def stream_files(spark, sf_dir):
    """What a checkpoint has down as taken: files, and the most in a batch."""
    session = _stream_session(spark)
    pipeline, checkpoint = _pipeline(session)
    landing = _Landing(session, sf_dir)
    landing.run(lambda stream: pipeline.start(stream, checkpoint, available_now=True))
    taken = processed_files(session, checkpoint)
    landed = read_landing(session, landing.folder).select(SOURCE_FILE).distinct()
    per_batch = taken.groupBy("batch_id").count().agg(F.max("count").alias("most"))
    return taken.agg(
        (F.count("*") == landed.agg(F.count("*")).scalar()).alias("all_landed"),
        (F.count_distinct("batch_id") > 1).alias("several_batches"),
    ).withColumn("most_in_a_batch", per_batch.scalar())


@query
def stream_without_valid_rows(spark, sf_dir):
    """Batches of rejected rows alone: nothing is stored, all of them are counted."""
    session = _stream_session(spark)
    pipeline, checkpoint = _pipeline(session)
    folder = new_folder(session, "landing")
    rejects = op.rejected(fx.judged(session, sf_dir)).select(*LANDING_COLUMNS)
    export_landing(rejects.repartition(4), folder)
    _run(pipeline.start(
        stream_landing(session, folder, max_files=2), checkpoint, available_now=True))
    counts = pipeline.ledger.read(session).agg(
        *[F.sum(c).alias(c) for c in ("received", "invalid", "written")])
    return counts.withColumn("stored", pipeline.target.read(session).agg(F.count("*")).scalar())


@query
def stored_stamps(spark, sf_dir):
    """Rows by the time they were stored at."""
    events = fx.user_events(spark, sf_dir)
    table = _table(spark)
    first = table.insert_absent(
        _already_stored(events), 0, created_at=datetime.datetime(2026, 1, 1, 12))
    table.insert_absent(
        events, 1, last_id=first, first=False, created_at=datetime.datetime(2026, 1, 2))
    return table.read(spark).groupBy("created_at").agg(F.count("*").alias("stored_rows"))
