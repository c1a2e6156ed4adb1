"""spark-submit entry: ingest landing files, or show a report view."""

import argparse
import logging

from millrace.plans.views import VIEWS, register_views
from millrace.session import build_session
from millrace.sinks import EventTable, JdbcEvents, Ledger
from millrace.sources import Database, stream_landing
from millrace.streaming import Pipeline


def _arguments(argv=None):
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="stream landing files into the event table")
    for name in ("landing", "quarantine", "ledger", "checkpoint"):
        ingest.add_argument(f"--{name}", required=True)
    target = ingest.add_mutually_exclusive_group(required=True)
    target.add_argument("--table", help="folder of the Parquet event table")
    target.add_argument("--jdbc", metavar="NAME", help="table of the database in POSTGRES_*")
    ingest.add_argument("--format", choices=["csv", "parquet"], default="csv")
    ingest.add_argument("--trigger", default="10 seconds")
    ingest.add_argument("--max-files", type=int, default=10)
    ingest.add_argument("--max-bytes", help="admit this many bytes per batch instead of files")
    ingest.add_argument("--clean-source", choices=["delete", "archive"])
    ingest.add_argument("--archive", help="folder for archived landing files")
    ingest.add_argument("--once", action="store_true", help="end when all files are read")
    report = commands.add_parser("report", help="a report view over a Parquet event table")
    report.add_argument("--table", required=True)
    report.add_argument("--view", choices=sorted(VIEWS), required=True)
    report.add_argument("--out", help="folder for the whole report as CSV; else its head is shown")
    return parser.parse_args(argv)


def ingest(spark, args):
    if args.jdbc:
        database = Database.from_environment()
        if not database.reachable(spark):
            raise SystemExit(f"cannot reach {database.url}")
        target = JdbcEvents(database, args.jdbc)
    else:
        target = EventTable(args.table)
    stream = stream_landing(
        spark,
        args.landing,
        args.format,
        max_files=args.max_files,
        max_bytes=args.max_bytes,
        clean_source=args.clean_source,
        archive=args.archive,
    )
    pipeline = Pipeline(target, args.quarantine, Ledger(args.ledger))
    query = pipeline.start(stream, args.checkpoint, args.trigger, available_now=args.once)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()


def report(spark, args):
    table = EventTable(args.table)
    register_views(table.read(spark), zones=table.zones(spark) if table.journal.exists(spark) else None)
    if args.out:
        spark.table(args.view).write.mode("overwrite").option("header", "true").csv(args.out)
    else:
        spark.table(args.view).show(truncate=False)


def main(argv=None):
    args = _arguments(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = build_session(f"millrace-{args.command}")
    try:
        {"ingest": ingest, "report": report}[args.command](spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
