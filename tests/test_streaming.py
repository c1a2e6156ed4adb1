import glob
import os
import shutil
from dataclasses import replace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.model import EVENT_COLUMNS
from millrace.plans import reports
from millrace.sinks import EventTable, Ledger
from millrace.sources import stream_landing
from millrace.streaming import (
    Monitor,
    Pipeline,
    Trends,
    event_clock,
    hourly_stream,
    minute_stream,
    processed_files,
    stream_dedup,
)
from workload import fixtures as fx

SF = "/root/testdata/sf0.001"
HEADER = "event_id,user_id,product_id,product_name,category,price,event_type,timestamp\n"


def line(event_id, time="2026-01-15 10:00:00", user="u", kind="view"):
    return f"{event_id},{user},p,n,c,1.50,{kind},{time}\n"


class Landing:
    """Files put in place whole, each younger than the one before."""

    def __init__(self, folder):
        self.folder, self.count = folder, 0
        os.makedirs(folder)

    def put(self, *lines):
        self.count += 1
        aside = f"{self.folder}/../part"
        with open(aside, "w") as out:
            out.write(HEADER + "".join(lines))
        os.utime(aside, (1.7e9 + self.count, 1.7e9 + self.count))
        shutil.move(aside, f"{self.folder}/events_{self.count:03d}.csv")


@pytest.fixture
def landing(tmp_path):
    return Landing(str(tmp_path / "landing"))


@pytest.fixture
def pipeline(tmp_path):
    return Pipeline(
        EventTable(str(tmp_path / "events")),
        str(tmp_path / "rejected"),
        Ledger(str(tmp_path / "ledger")),
        retry_delay=0,
    )


def run(spark, pipeline, landing, tmp_path, **options):
    stream = stream_landing(spark, landing.folder, **options)
    pipeline.start(stream, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()


def ids(spark, pipeline):
    return sorted(r.event_id for r in pipeline.target.read(spark).select("event_id").collect())


def test_ingestion(spark, pipeline, landing, tmp_path):
    landing.put(line("a"), line("b"), line("b", "2026-01-15 09:00:00"), "short,u\n")
    landing.put(line("c"), line("d", kind=""), line("e", kind="click"))
    run(spark, pipeline, landing, tmp_path, max_files=1)
    stored = pipeline.target.read(spark)
    assert ids(spark, pipeline) == ["a", "b", "c"]
    assert stored.where("event_id = 'b'").first().event_timestamp.hour == 9
    assert [r.id for r in stored.orderBy("id").collect()] == [1, 2, 3]
    rejects = spark.read.option("header", True).csv(pipeline.quarantine)
    assert {(r.batch_id, r.event_id, r.reasons) for r in rejects.collect()} == {
        (0, "short", "corrupt_record"), (1, "d", "event_type_null"), (1, "e", "event_type_unknown"),
    }
    assert rejects.where("batch_id = 0").first().raw_line == "short,u"
    rows = {r.batch_id: r for r in pipeline.ledger.read(spark).collect()}
    columns = ("received", "corrupt", "valid", "invalid", "kept", "written", "last_id")
    assert [rows[0][c] for c in columns] == [4, 1, 3, 1, 2, 2, 2]
    assert [rows[1][c] for c in columns] == [3, 0, 1, 2, 1, 1, 3]
    assert rows[0].total_seconds > 0 and rows[0].valid_rate == 0.75


def test_redelivery_in_a_new_file_is_refused(spark, pipeline, landing, tmp_path):
    landing.put(line("a"), line("b"))
    run(spark, pipeline, landing, tmp_path)
    run(spark, pipeline, landing, tmp_path)  # nothing new
    landing.put(line("b"), line("c"))
    run(spark, pipeline, landing, tmp_path)
    assert ids(spark, pipeline) == ["a", "b", "c"]
    rows = {r.batch_id: (r.kept, r.written) for r in pipeline.ledger.read(spark).collect()}
    assert rows == {0: (2, 2), 1: (2, 1)}


class Breaks(EventTable):
    """Breaks off after writing, as often as told."""

    left = 0

    def insert_absent(self, events, batch_id, **known):
        written = super().insert_absent(events, batch_id, **known)
        if Breaks.left > 0:
            Breaks.left -= 1
            raise OSError("injected failure")
        return written


def test_restart_after_a_failure(spark, pipeline, landing, tmp_path):
    landing.put(line("a"), line("b"))
    Breaks.left = 3
    broken = replace(pipeline, target=Breaks(pipeline.target.path))
    with pytest.raises(StreamingQueryException, match="injected failure"):
        run(spark, broken, landing, tmp_path)
    assert Breaks.left == 0
    landing.put(line("c"), line("a"))
    run(spark, pipeline, landing, tmp_path)
    assert ids(spark, pipeline) == ["a", "b", "c"]
    assert pipeline.ledger.read(spark).agg(F.sum("written")).first()[0] == 3


def test_restart_in_the_same_process_after_a_later_batch_failed(spark, pipeline, landing, tmp_path):
    landing.put(line("a"))
    run(spark, pipeline, landing, tmp_path)
    landing.put(line("b"), line("c"))
    Breaks.left = 1
    broken = replace(pipeline, target=Breaks(pipeline.target.path), attempts=1)
    with pytest.raises(StreamingQueryException):
        run(spark, broken, landing, tmp_path)
    run(spark, pipeline, landing, tmp_path)
    assert ids(spark, pipeline) == ["a", "b", "c"]


def test_a_failed_write_is_retried(spark, pipeline, landing, tmp_path):
    landing.put(line("a"), line("b"))
    Breaks.left = 2
    run(spark, replace(pipeline, target=Breaks(pipeline.target.path)), landing, tmp_path)
    assert ids(spark, pipeline) == ["a", "b"]
    assert glob.glob(f"{pipeline.quarantine}/*/batch_id=*") == []  # nothing was rejected


def test_a_batch_without_valid_rows(spark, pipeline, landing, tmp_path):
    landing.put(line("a", "never"))
    landing.put()
    run(spark, pipeline, landing, tmp_path, max_files=1)
    assert ids(spark, pipeline) == []
    assert [(r.received, r.written) for r in pipeline.ledger.read(spark).collect()] == [(1, 0)]


def test_admission_and_source_cleaning(spark, pipeline, landing, tmp_path):
    for name in "abcde":
        landing.put(line(name))
    run(
        spark, pipeline, landing, tmp_path, max_files=2, clean_source="archive",
        archive=str(tmp_path / "archive"),
    )
    ledger = pipeline.ledger.read(spark).orderBy("batch_id")
    assert [r.received for r in ledger.collect()] == [2, 2, 1]
    assert ids(spark, pipeline) == list("abcde")
    assert len(os.listdir(landing.folder)) < 5


def test_an_id_with_a_third_of_the_rows(spark, pipeline, landing, tmp_path):
    rows = [line(f"e{i}" if i % 3 else "hot", f"2026-01-15 10:{i % 60:02d}:00") for i in range(9000)]
    landing.put(*rows)
    landing.put(*rows[::-1])
    run(spark, pipeline, landing, tmp_path, max_files=1)
    assert pipeline.target.read(spark).count() == 6001
    counts = {r.batch_id: (r.kept, r.written) for r in pipeline.ledger.read(spark).collect()}
    assert counts == {0: (6001, 6001), 1: (6001, 0)}


def test_new_and_stored_events_in_one_batch(spark, pipeline, landing, tmp_path):
    landing.put(*[line(f"a{i}") for i in range(50)])
    landing.put(*[line(f"a{i}") for i in range(25, 100)])
    run(spark, pipeline, landing, tmp_path, max_files=1)
    stored = pipeline.target.read(spark)
    assert sorted(r.id for r in stored.select("id").collect()) == list(range(1, 101))
    assert stored.select("event_id").distinct().count() == 100


def test_a_new_checkpoint_keeps_what_is_stored(spark, pipeline, landing, tmp_path):
    """Another stream starts its batch numbers at 0 again, after source files are gone."""
    landing.put(line("a"), line("b"), "short,u\n")
    landing.put(line("b"))
    run(spark, pipeline, landing, tmp_path, max_files=1, clean_source="delete")
    os.remove(f"{landing.folder}/events_002.csv")
    landing.put(line("c"), line("a"), line("d", kind="?"))
    stream = stream_landing(spark, landing.folder)
    fresh = replace(pipeline, ledger=Ledger(pipeline.ledger.path))
    fresh.start(stream, str(tmp_path / "another"), available_now=True).awaitTermination()
    assert ids(spark, pipeline) == ["a", "b", "c"]
    stored = pipeline.target.read(spark)
    assert sorted(r.id for r in stored.select("id").collect()) == [1, 2, 3]
    assert stored.select("stream_id").distinct().count() == 2
    ledger = pipeline.ledger.read(spark).collect()
    assert len(ledger) == 3 and sum(r.written for r in ledger) == 3
    rejects = spark.read.option("header", True).csv(pipeline.quarantine).collect()
    assert sorted(r.reasons for r in rejects) == ["corrupt_record", "event_type_unknown"]


def test_ids_go_on_after_a_batch_that_was_never_recorded(spark, pipeline, landing, tmp_path):
    landing.put(line("a"), line("b"))
    Breaks.left = 9
    broken = replace(pipeline, target=Breaks(pipeline.target.path))
    with pytest.raises(StreamingQueryException):
        run(spark, broken, landing, tmp_path)
    landing.put(line("c"))
    stream = stream_landing(spark, landing.folder)
    pipeline.start(stream, str(tmp_path / "another"), available_now=True).awaitTermination()
    Breaks.left = 0
    stored = pipeline.target.read(spark).collect()
    assert sorted((r.event_id, r.id) for r in stored) == [("a", 1), ("b", 2), ("c", 3)]


def test_a_price_the_table_cannot_hold_does_not_stop_the_stream(spark, pipeline, landing, tmp_path):
    landing.put(line("a"), line("b").replace("1.50", "100000000"), line("c").replace("1.50", "NaN"))
    run(spark, replace(pipeline, strict=False), landing, tmp_path)
    assert ids(spark, pipeline) == ["a"]
    rejects = spark.read.option("header", True).csv(pipeline.quarantine).collect()
    assert sorted((r.event_id, r.reasons) for r in rejects) == [
        ("b", "price_range"), ("c", "price_not_finite")]


def test_processing_time_trigger(spark, pipeline, landing, tmp_path):
    landing.put(line("a"))
    stream = stream_landing(spark, landing.folder)
    query = pipeline.start(stream, str(tmp_path / "checkpoint"), trigger="200 milliseconds")
    try:
        query.processAllAvailable()
        landing.put(line("b"), line("a"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert ids(spark, pipeline) == ["a", "b"]
    assert query.exception() is None and not query.isActive


def test_parquet_landing(spark, pipeline, tmp_path):
    folder = str(tmp_path / "in")
    fx.dup(spark, SF).drop("delivery").write.parquet(folder)
    stream = stream_landing(spark, folder, "parquet")
    pipeline.start(stream, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert pipeline.target.read(spark).count() == fx.user_events(spark, SF).count()


def landing_events(spark, landing):
    from millrace import operators as op

    judged = op.judge(op.clean(stream_landing(spark, landing.folder, max_files=1)))
    return op.to_event_columns(op.valid(judged))


def to_files(spark, stream, folder):
    (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("spread", [1, 4])
def test_stream_dedup(spark, landing, tmp_path, spread):
    hot = [line("hot")] * 50
    landing.put(*hot, line("a"))
    landing.put(*hot, line("a"), line("b", "2026-01-15 10:30:00"))
    landing.put(line("c", "2026-01-15 10:40:00"), line("b", "2026-01-15 10:35:00"))
    stream = stream_dedup(event_clock(landing_events(spark, landing), "1 hour"), spread=spread)
    got = to_files(spark, stream.select(*EVENT_COLUMNS), tmp_path)
    assert sorted(r.event_id for r in got.collect()) == ["a", "b", "c", "hot"]


@pytest.mark.parametrize("exact", [True, False])
def test_hourly_stream_equals_the_report_for_closed_hours(spark, landing, tmp_path, exact):
    users = ["u1", "u1", "u2", "u3"]
    hours = [(f"{h}-{i}", f"2026-01-15 {h:02d}:{i:02d}:00", u)
             for h in range(8, 13) for i, u in enumerate(users)]
    for h in range(8, 13):
        landing.put(*[line(e, t, u) for e, t, u in hours if e.startswith(f"{h}-")])
    stream = event_clock(landing_events(spark, landing), "30 minutes")
    got = to_files(spark, hourly_stream(stream, exact), tmp_path)
    rows = sorted((r.event_hour.hour, r.event_count, r.unique_users) for r in got.collect())
    assert rows == [(h, 4, 3) for h in (8, 9, 10)]  # 11:00 is open until 12:30


def trend_rows(trends, spark):
    rows = trends.hourly(spark).collect()
    return sorted((r.event_hour.hour, r.event_count, r.unique_users) for r in rows)


@pytest.mark.parametrize("fold_every", [1, 2, 100])
def test_trends_are_complete_at_any_time(spark, landing, tmp_path, fold_every):
    trends = Trends(str(tmp_path / "trends"), "30 minutes", fold_every)
    hours = [(f"{h}-{i}", f"2026-01-15 {h:02d}:{i:02d}:00", u)
             for h in range(8, 13) for i, u in enumerate(["u1", "u1", "u2", "u3"])]
    for h in range(8, 13):
        landing.put(*[line(e, t, u) for e, t, u in hours if e.startswith(f"{h}-")])
    landing.put(line("more", "2026-01-15 12:00:30", "u4"))

    def count(checkpoint):
        events = landing_events(spark, landing)
        trends.start(events, str(tmp_path / checkpoint), available_now=True).awaitTermination()
        return trend_rows(trends, spark)

    complete = [(h, 4, 3) for h in (8, 9, 10, 11)] + [(12, 5, 4)]
    assert count("checkpoint") == complete
    assert count("checkpoint") == complete  # nothing new
    landing.put(line("again", "2026-01-15 12:00:40", "u4"))
    landing.put(line("late", "2026-01-15 08:00:00", "u9"))  # a correction of a closed window
    complete = [(8, 5, 4), *complete[1:-1], (12, 6, 4)]
    assert count("checkpoint") == complete
    minutes = {r.minute.strftime("%H:%M"): r.event_count for r in trends.minutes(spark).collect()}
    assert minutes["12:00"] == 3 and minutes["08:00"] == 2 and sum(minutes.values()) == 23
    trends.fold(spark)
    assert trend_rows(trends, spark) == complete
    assert trends.late(spark) == 1


def test_reading_trends_does_not_grow_with_the_batches(spark, tmp_path):
    trends = Trends(str(tmp_path / "trends"), "2 hours", 4)
    events = fx.user_events(spark, SF).where("event_timestamp < timestamp_ntz'2024-01-03 00:00:00'")
    for n in range(30):
        trends._store(events.where(F.pmod(F.xxhash64("event_id"), F.lit(30)) == n), n)
    files = glob.glob(f"{trends.path}/new/*/*") + [
        f for t in ("hours", "minutes", "open") for f in glob.glob(f"{trends.path}/{t}/*")]
    assert len(files) <= 5 + 3 + 3 + 1
    want = reports.hourly_events(events)
    assert sorted(trends.hourly(spark).collect()) == sorted(want.collect())
    assert sorted(trends.minutes(spark).collect()) == sorted(reports.events_per_minute(events).collect())


@pytest.mark.parametrize("at", ["write_text", "_remove_spent"])
def test_a_fold_that_broke_off_is_finished(spark, tmp_path, monkeypatch, at):
    from millrace.streaming import trends as module

    trends = Trends(str(tmp_path / "trends"), "2 hours", 100)
    events = fx.user_events(spark, SF).where("event_timestamp < timestamp_ntz'2024-01-02 00:00:00'")
    want = sorted(reports.hourly_events(events).collect())

    def fails(*args):
        raise OSError("broke off")

    for n in range(6):
        trends._store(events.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == n), n)
        if n in (2, 4):
            with monkeypatch.context() as m:
                m.setattr(module if at == "write_text" else Trends, at, fails)
                with pytest.raises(OSError):
                    trends.fold(spark)
    assert sorted(trends.hourly(spark).collect()) == want
    trends._store(events.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == 5), 5)  # a replay
    trends.fold(spark)
    assert sorted(trends.hourly(spark).collect()) == want


def test_a_slow_batch_is_flagged_while_the_query_runs(spark, pipeline, landing, tmp_path):
    import time

    class Slow(EventTable):
        def insert_absent(self, *args, **known):
            time.sleep(1.5)
            return super().insert_absent(*args, **known)

    monitor = Monitor(max_seconds=1.0)
    spark.streams.addListener(monitor)
    landing.put(line("a"), line("b"), line("c", kind="?"))
    slow = replace(pipeline, target=Slow(pipeline.target.path))
    query = slow.start(
        stream_landing(spark, landing.folder), str(tmp_path / "checkpoint"), trigger="200 milliseconds")
    try:
        query.processAllAvailable()
        for _ in range(100):
            if monitor.slow:
                break
            time.sleep(0.1)
        assert monitor.slow and query.isActive
    finally:
        query.stop()
        spark.streams.removeListener(monitor)
    ledger = {(r.stream_id, r.batch_id): r for r in pipeline.ledger.read(spark).collect()}
    seen = {(r.stream_id, r.batch_id): r for r in monitor.progress(spark).collect() if r.input_rows}
    assert seen.keys() == ledger.keys()
    for key, r in seen.items():
        assert r.slow and r.seconds > ledger[key].total_seconds and r.input_rows >= ledger[key].received


def test_processed_files(spark, pipeline, landing, tmp_path):
    for name in "abc":
        landing.put(line(name))
    run(spark, pipeline, landing, tmp_path, max_files=2)
    taken = processed_files(spark, str(tmp_path / "checkpoint")).collect()
    assert sorted((os.path.basename(r.path), r.batch_id) for r in taken) == [
        ("events_001.csv", 0), ("events_002.csv", 0), ("events_003.csv", 1)]


def test_minute_stream(spark, landing, tmp_path):
    landing.put(line("a", "2026-01-15 10:00:05"), line("b", "2026-01-15 10:00:59"))
    landing.put(line("c", "2026-01-15 10:05:00"))
    stream = event_clock(landing_events(spark, landing), "1 minute")
    got = to_files(spark, minute_stream(stream), tmp_path)
    assert [(r.minute.minute, r.event_count) for r in got.collect()] == [(0, 2)]


def test_late_events_are_dropped_after_the_watermark(spark, landing, tmp_path):
    for name, time in (("a", "09:00:00"), ("b", "12:00:00"), ("c", "12:01:00"), ("late", "09:05:00")):
        landing.put(line(name, f"2026-01-15 {time}"))
    stream = event_clock(landing_events(spark, landing), "30 minutes")
    got = to_files(spark, hourly_stream(stream), tmp_path)
    assert [(r.event_hour.hour, r.event_count) for r in got.collect()] == [(9, 1)]


def test_ingested_table_gives_the_batch_reports(spark, pipeline, tmp_path):
    """The whole dirty landing through the stream, then a report over the table."""
    from millrace.sinks import export_landing

    folder = str(tmp_path / "in")
    export_landing(fx.dup(spark, SF), folder, rows_per_file=200)
    stream = stream_landing(spark, folder)
    pipeline.start(stream, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    stored = pipeline.target.read(spark)
    expected = reports.event_summary(fx.user_events(spark, SF)).collect()
    assert sorted(reports.event_summary(stored).collect()) == sorted(expected)
    ledger = pipeline.ledger.read(spark).agg(
        *[F.sum(c).alias(c) for c in ("received", "valid", "invalid", "written")]
    ).first()
    assert ledger.received == ledger.valid + ledger.invalid == fx.dup(spark, SF).count()
    assert ledger.written == stored.count()
