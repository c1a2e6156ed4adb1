"""Time the ingestion and the reports; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. The reports run over the table the ingestion has written, as
they would in use, and their whole result is computed.
"""

import datetime
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from millrace import operators as op  # noqa: E402
from millrace.model import EVENT_COLUMNS  # noqa: E402
from millrace.plans import files, health, reports  # noqa: E402
from millrace.session import build_session, new_folder  # noqa: E402
from millrace.sinks import EventTable, Ledger, export_landing, write_report_layout  # noqa: E402
from millrace.sources import between, read_landing, stream_landing  # noqa: E402
from millrace.streaming import Pipeline  # noqa: E402
from workload import fixtures as fx  # noqa: E402
from workload import queries as wl  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3

REPORTS = {
    "event_count": reports.event_count,
    "events_by_type": reports.events_by_type,
    "event_summary": reports.event_summary,
    "hourly_events": reports.hourly_events,
    "hourly_events_last_24h": wl._last_day,
    "purchase_funnel": reports.purchase_funnel,
    "funnel_buyers": reports.funnel_buyers,
    "top_products": reports.top_products,
    "top_10_products": lambda e: reports.top_products(e, 10),
    "recent_activity": reports.recent_activity,
    "recent_10": reports.recent_events,
    "events_per_minute": reports.events_per_minute,
    "latest_minutes": lambda e: reports.events_per_minute(e, 10),
    "event_mix": reports.event_mix,
    "sample_events": reports.sample_by_id,
    "date_range": wl._january_days,
    "throughput_stats": health.throughput_stats,
    "latency_stats": health.latency_stats,
    "conformance_report": op.conformance_report,
}


def run(df):
    df.write.format("noop").mode("overwrite").save()


def timed(action):
    began = time.perf_counter()
    result = action()
    return time.perf_counter() - began, result


def best(action):
    action()
    return min(timed(action)[0] for _ in range(REPEATS))


def pipeline(spark):
    base = new_folder(spark, "bench")
    return Pipeline(EventTable(f"{base}/events"), f"{base}/rejected", Ledger(f"{base}/ledger")), base


def ingest(spark, landing, **options):
    target, base = pipeline(spark)
    stream = stream_landing(spark, landing, **options)
    target.start(stream, f"{base}/checkpoint", available_now=True).awaitTermination()
    return target


def small_batches(spark):
    """Seconds per warm micro-batch of 10 files with 10 rows each."""
    landing = new_folder(spark, "small")
    rows = fx.events(spark, SF_DIR).limit(1500)
    export_landing(fx.as_landing(rows, fx.parts(spark, SF_DIR)).coalesce(1), landing, 10)
    ledger = ingest(spark, landing, max_files=10).ledger.read(spark)
    warm = ledger.where("batch_id >= 5").select("total_seconds", "received").collect()
    return statistics.median(r.total_seconds for r in warm), sum(r.received for r in warm) / sum(
        r.total_seconds for r in warm
    )


def growing_table(spark):
    """Median write seconds of the batches 10 to 19 and 50 to 59 into one table."""
    target, base = pipeline(spark)
    rows = fx.user_events(spark, SF_DIR).limit(6000)
    rows = op.number_rows(rows, ["event_timestamp", "event_id"]).cache()
    rows.count()
    took, last = [], 0
    for n in range(60):
        batch = rows.where((F.col("id") > 100 * n) & (F.col("id") <= 100 * (n + 1))).drop("id").cache()
        batch.count()
        spent, written = timed(lambda: target.target.insert_absent(
            batch, n, last_id=last, stream_id="bench", first=n == 0, rows=100))
        last += written
        took.append(spent)
        batch.unpersist()
    rows.unpersist()
    return statistics.median(took[10:20]), statistics.median(took[50:60])


def main():
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.shuffle.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, extra = {}, {}

    # Ingestion: the dirty landing rows through every stage into the table.
    landing = export_landing(fx.dup(spark, SF_DIR), new_folder(spark, "landing"), 5000)
    landed = read_landing(spark, landing)
    seconds["clean_and_judge"] = best(lambda: run(op.split(landed)[0]))
    seconds["rule_violations"] = best(lambda: run(op.rule_violations(op.clean(landed))))
    seconds["dedup_events"] = best(lambda: run(op.keep_first(op.split(landed)[0], ["source_file"])))
    ingest(spark, landing, max_files=None)
    seconds["stream_ingest"], done = timed(lambda: ingest(spark, landing, max_files=None))
    received = done.ledger.read(spark).agg(F.sum("received")).first()[0]
    extra["stream_rows_per_second"] = round(received / seconds["stream_ingest"], 1)
    seconds["microbatch_100_rows"], extra["microbatch_rows_per_second"] = small_batches(spark)
    early, late = growing_table(spark)
    seconds["microbatch_10_to_19"], seconds["microbatch_50_to_59"] = early, late

    # Reports over the stored table.
    layout = new_folder(spark, "layout")
    seconds["write_report_layout"], _ = timed(
        lambda: write_report_layout(done.target.read(spark).select("id", *EVENT_COLUMNS, "created_at"), layout)
    )
    stored = spark.read.parquet(layout)
    for name, report in REPORTS.items():
        seconds[name] = best(lambda: run(report(stored)))
    batch = between(stored, datetime.datetime(2024, 1, 15), datetime.datetime(2024, 2, 1))
    older = stored.where("event_date < date'2024-01-25'")
    seconds["insert_if_absent"] = best(lambda: run(op.absent_from(batch, older)))
    profile = files.file_profile(op.clean(landed))
    seconds["file_profile"] = best(lambda: run(profile))
    seconds["file_running_totals"] = best(lambda: run(files.file_running_totals(profile)))
    seconds["surrogate_ids"] = best(
        lambda: run(op.number_rows(stored.drop("id"), ["event_timestamp", "event_id"]))
    )

    # Stateful streams.
    for name in ("stream_hourly", "stream_minutes", "stream_dedup_events", "stream_restart"):
        seconds[name], _ = timed(lambda name=name: run(wl.QUERIES[name](spark, SF_DIR)))
    for name in ("table_insert", "integrity_report", "slo_report"):
        seconds[name], _ = timed(lambda name=name: run(wl.QUERIES[name](spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total seconds of all timed steps",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows_landed": received,
                **{k: round(v, 1) for k, v in extra.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
