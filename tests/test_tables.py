import datetime
import glob
import os
import shutil
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.model import EVENT_COLUMNS, STORED, table_ddl
from millrace.plans import reports
from millrace.plans.views import VIEWS, register_views
from millrace.sinks import (
    EventTable,
    JdbcEvents,
    Ledger,
    export_landing,
    read_rejected,
    save_bucketed,
    with_retry,
    write_rejected,
    write_report_layout,
)
from millrace.sinks.jdbc import merge_statement
from millrace.sources import Database, between, layout_zones, read_events, read_landing
from workload import fixtures as fx

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return fx.user_events(spark, SF).cache()


@pytest.fixture(scope="module")
def few(events):
    """The events of two days."""
    return events.where("event_timestamp < timestamp_ntz'2024-01-03 00:00:00'").coalesce(2).cache()


def test_replaying_a_batch_changes_nothing(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    half = events.where("cast(event_id as bigint) % 2 = 0")
    first = table.insert_absent(half, 0)
    assert first == half.count()
    for _ in range(2):
        assert table.insert_absent(events, 1, last_id=first) == events.count() - first
    stored = table.read(spark)
    assert stored.count() == events.count() == stored.select("event_id").distinct().count()
    assert stored.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first() == (
        1, events.count(), events.count(),
    )
    assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in STORED]


def test_a_replay_that_shrinks_leaves_no_old_rows(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(events.where("cast(event_id as bigint) % 2 = 0"), 0)
    table.insert_absent(events, 1)
    few = events.where("event_timestamp < timestamp_ntz'2024-01-10 00:00:00'")
    written = table.insert_absent(few, 1)
    stored = table.read(spark)
    assert stored.where("batch_id = 1").count() == written
    late = events.subtract(few).where("cast(event_id as bigint) % 2 = 0")
    assert stored.count() == few.count() + late.count()


def test_ids_go_on_in_event_order(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(events, 0, last_id=7)
    rows = table.read(spark).orderBy("id").select("id", "event_timestamp", "event_id").collect()
    assert [r.id for r in rows] == list(range(8, 8 + events.count()))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert table.last_id(spark, 1) == rows[-1].id and table.last_id(spark, 0) == 0


def test_batches_of_two_streams_do_not_touch_each_other(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    half = events.where("cast(event_id as bigint) % 2 = 0")
    first = table.insert_absent(half, 0, stream_id="one")
    rest = table.insert_absent(events, 0, last_id=first, stream_id="two")
    assert first + rest == table.read(spark).count() == events.count()
    assert table.read(spark).select("id").distinct().count() == events.count()
    assert table.insert_absent(events, 0, last_id=first, stream_id="two") == rest  # a replay


def test_dates_are_read_alone(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(events, 0)
    day = between(events, datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 6))
    dates = [datetime.date(2024, 1, 5), datetime.date(1999, 1, 1)]
    files = read_events(spark, table.path, dates).inputFiles()
    assert files and all("event_date=2024-01-05/stream_id=direct/batch_id=0" in f for f in files)
    assert read_events(spark, table.path, dates).count() == day.count()
    assert read_events(spark, table.path, dates[1:]).count() == 0


def test_an_event_that_changed_its_day_is_still_refused(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(events, 0)
    moved = events.withColumn("event_timestamp", F.expr("event_timestamp + interval 9 days"))
    assert table.insert_absent(moved, 1) == 0


def _batches(spark, events, table, stream, n=6):
    """The events in n batches of one stream."""
    last = table.last_id(spark, 0, stream)
    for i in range(n):
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i)
        last += table.insert_absent(part, i, last_id=last, stream_id=stream, first=i == 0)


def scans(df):
    """(partitions, rows) that each scan of an executed plan has read."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName():
            read = [node.metrics().get(m) for m in ("numPartitions", "numOutputRows")]
            found.append(tuple(m.get().value() if m.isDefined() else None for m in read))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


def made_up(spark, first, last):
    """Events that no table has."""
    return spark.range(first, last).select(
        F.concat(F.lit("made-up-"), "id").alias("event_id"), F.lit("u").alias("user_id"),
        F.lit("p").alias("product_id"), F.lit("n").alias("product_name"),
        F.lit("c").alias("category"), F.lit(1).cast("decimal(10,2)").alias("price"),
        F.lit("view").alias("event_type"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 86400)")
        .alias("event_timestamp"),
    )


def test_a_small_batch_reads_a_small_part_of_a_large_index(spark, tmp_path):
    from millrace.sinks.ids import IdIndex, keyed

    index = IdIndex(str(tmp_path / "ids"))
    index.write(keyed(made_up(spark, 0, 10**6)), "run")
    batch = made_up(spark, 10**6 - 50, 10**6 + 50).cache()
    near = index.near(batch, ["run"])
    ((_, rows),) = scans(near)
    assert rows < 10**5
    found = near.join(batch, "event_id", "left_semi")
    assert found.count() == 50


def test_a_batch_of_many_ids_opens_only_its_files(spark, tmp_path, monkeypatch):
    from millrace.sinks import ids

    index = ids.IdIndex(str(tmp_path / "ids"), ids_per_file=32)
    index.write(ids.keyed(made_up(spark, 0, 2000)), "run")
    assert len(glob.glob(f"{index.path}/run=run/bits=6/bucket=*")) == 64
    monkeypatch.setattr(ids, "LOOKUPS", 10)
    batch = made_up(spark, 1980, 2020).cache()
    near = index.near(batch, ["run"])
    assert len(near.inputFiles()) < 50
    assert near.join(batch, "event_id", "left_semi").count() == 20


def test_the_files_of_a_run_do_not_grow_with_its_ids(spark, tmp_path):
    from millrace.sinks.ids import FILE_IDS, MOST_BITS, IdIndex, keyed

    index = IdIndex(str(tmp_path / "ids"), ids_per_file=1)
    index.write(keyed(made_up(spark, 0, 3000)), "run")
    assert len(glob.glob(f"{index.path}/run=run/bits=*/bucket=*")) <= 1 << MOST_BITS
    batch = made_up(spark, 2000, 4000).cache()
    near = index.near(batch, ["run"])
    assert near.join(batch, "event_id", "left_semi").count() == 1000
    assert [index._bits(n) for n in (0, 1, 40, FILE_IDS << 8)] == [0, 1, MOST_BITS, 9]
    assert IdIndex("").ids_per_file == FILE_IDS


def test_a_batch_is_written_by_all_cores_before_tasks_grow():
    from millrace.sinks.events import SPREAD_ROWS, TASK_ROWS, write_tasks

    assert [write_tasks(n, 8) for n in (0, 1, SPREAD_ROWS, 4 * SPREAD_ROWS, TASK_ROWS)] == [
        1, 1, 1, 4, 8]
    assert write_tasks(20 * TASK_ROWS, 8) == 20


def test_the_clustering_sort_hashes_no_text(spark, events):
    from millrace.sinks.layout import clustered

    sorts = [line for line in physical(clustered(events.withColumn(
        "event_date", F.to_date("event_timestamp")))).split("\n") if "Sort [event_date" in line]
    assert len(sorts) == 1 and "xxhash64" not in sorts[0]


def test_an_insert_computes_its_events_once(spark, few, tmp_path):
    table = EventTable(str(tmp_path / "t"), settle_every=1)
    for n in range(2):
        table.insert_absent(few.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == n), n, first=n == 0)
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert table.insert_absent(few.mapInArrow(note, few.schema), 2, first=False) == 0
    assert seen.value == few.count()


def test_any_ids_per_file_finds_all_ids(spark, few, tmp_path):
    table = EventTable(str(tmp_path / "t"), ids_per_file=2, settle_every=3)
    _batches(spark, few, table, "s")
    assert len(glob.glob(f"{table.path}/_ids/run=*/bits=*/bucket=*")) > 4
    for n, size in enumerate((1, 1 << 18)):
        reopened = EventTable(table.path, ids_per_file=size, settle_every=3)
        assert reopened.insert_absent(few.limit(3), 2 * n, stream_id="other") == 0
        assert reopened.insert_absent(few, 2 * n + 1, stream_id="other", first=False) == 0
        reopened.settle(spark)
    assert table.read(spark).count() == few.count()


def test_segments_are_put_together(spark, few, tmp_path):
    table = EventTable(str(tmp_path / "t"), settle_every=1)
    _batches(spark, few, table, "s", 7)  # six settled: four become one
    levels = sorted(s.level for s in table.journal.segments(spark))
    assert levels == [0, 0, 1]
    assert len(glob.glob(f"{table.path}/_ids/run=*")) == 3
    assert len(glob.glob(f"{table.path}/_states/users/run=*")) == 3
    assert table.zones(spark).rows() == few.count()
    assert table.insert_absent(few, 0, stream_id="other") == 0


@pytest.mark.parametrize("at", ["write_segment", "remove_segments", "drop"])
def test_a_settlement_that_broke_off_is_finished(spark, few, tmp_path, monkeypatch, at):
    from millrace.sinks.journal import Journal

    table = EventTable(str(tmp_path / "t"), settle_every=100)
    _batches(spark, few, table, "s", 5)
    expected = sorted(reports.event_summary(few).collect())

    def check():
        assert table.read(spark).count() == few.count()
        summary = reports.summary_from_states(table.states(spark))
        assert sorted(summary.collect()) == expected
        assert table.insert_absent(few.limit(50), 0, stream_id="other") == 0
        assert table.zones(spark).rows() == few.count()

    whole = getattr(Journal, at)

    def fails(self, *args, **known):
        raise OSError("broke off")

    monkeypatch.setattr(Journal, at, fails)
    try:
        table.settle(spark)
    except OSError:
        pass
    monkeypatch.setattr(Journal, at, whole)
    check()
    table.settle(spark)
    check()


def test_a_settled_batch_is_not_replaced(spark, few, tmp_path):
    table = EventTable(str(tmp_path / "t"), settle_every=2)
    _batches(spark, few, table, "s", 4)
    with pytest.raises(ValueError, match="settled"):
        table.insert_absent(few, 0, stream_id="s")
    assert table.read(spark).count() == few.count()


def test_a_batch_that_broke_off_is_not_seen(spark, events, tmp_path, monkeypatch):
    from millrace.sinks.journal import Journal

    table = EventTable(str(tmp_path / "t"))
    half = events.where("cast(event_id as bigint) % 2 = 0").cache()
    first = table.insert_absent(half, 0, stream_id="s")

    def everything():
        stored = table.read(spark)
        return [sorted(map(str, report(stored).collect())) for report in VIEWS.values()] + [
            sorted(map(str, reports.summary_from_states(table.states(spark)).collect())),
            table.zones(spark), table.last_id(spark, 7, "s")]

    before = everything()
    with monkeypatch.context() as broken:
        broken.setattr(Journal, "commit", lambda *args: (_ for _ in ()).throw(OSError("broke off")))
        with pytest.raises(OSError):
            table.insert_absent(events, 1, last_id=first, stream_id="s")
    assert read_events(spark, table.path).count() == events.count()  # the files are there
    assert everything() == before
    assert table.insert_absent(events, 1, last_id=first, stream_id="s") == events.count() - first
    assert table.read(spark).count() == events.count()
    assert everything() != before


def test_what_a_dead_stream_left_is_removed(spark, events, tmp_path, monkeypatch):
    from millrace.sinks.journal import Journal

    table = EventTable(str(tmp_path / "t"))
    with monkeypatch.context() as broken:
        broken.setattr(Journal, "commit", lambda *args: (_ for _ in ()).throw(OSError("broke off")))
        with pytest.raises(OSError):
            table.insert_absent(events, 5, stream_id="dead")
    assert table.insert_absent(events, 0, stream_id="next") == events.count()
    assert table.read(spark).count() == read_events(spark, table.path).count() == events.count()


def test_a_table_without_a_journal_is_not_written(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(events, 0)
    shutil.rmtree(f"{table.path}/_journal")
    with pytest.raises(ValueError, match="no journal"):
        table.insert_absent(events, 1)
    assert table.read(spark).count() == events.count()


def test_the_last_batch_of_a_stream_can_run_again(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"), settle_every=2)
    _batches(spark, events, table, "s", 4)
    table.settle(spark)
    table.settle(spark)  # safe to repeat
    last = events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == 3)
    assert table.insert_absent(last, 3, stream_id="s") == last.count()
    assert table.read(spark).count() == events.count()


def test_compaction_keeps_rows_and_replays(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    _batches(spark, events, table, "s")
    rows = sorted(table.read(spark).select("id", "event_id").collect())
    before = len(glob.glob(f"{table.path}/event_date=2024-01-0*/*/*"))
    table.compact(spark, datetime.date(2024, 1, 10))
    assert sorted(table.read(spark).select("id", "event_id").collect()) == rows
    after = glob.glob(f"{table.path}/event_date=2024-01-0*/*/*")
    assert len(after) < before and any("stream_id=compacted/batch_id=0" in f for f in after)
    last = events.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == 5)
    assert table.insert_absent(last, 5, stream_id="s", last_id=len(rows) - last.count()) == last.count()
    assert table.insert_absent(events, 0, stream_id="new") == 0
    moved = os.stat(after[0]).st_mtime
    table.compact(spark, datetime.date(2024, 1, 10))  # nothing to do: the folders stay
    assert os.stat(after[0]).st_mtime == moved
    assert sorted(table.read(spark).select("id", "event_id").collect()) == rows


def test_an_interrupted_compaction_is_finished(spark, events, tmp_path, monkeypatch):
    table = EventTable(str(tmp_path / "t"))
    _batches(spark, events, table, "s")
    count = table.read(spark).count()
    install = EventTable._install
    calls = []

    def fails(self, spark, aside):
        calls.append(aside)
        if len(calls) == 2:
            raise OSError("broke off")
        return install(self, spark, aside)

    monkeypatch.setattr(EventTable, "_install", fails)
    with pytest.raises(OSError):
        table.compact(spark, datetime.date(2024, 2, 1))
    assert table.read(spark).count() == count
    table.compact(spark, datetime.date(2024, 2, 1))
    assert table.read(spark).count() == table.read(spark).select("event_id").distinct().count() == count
    assert not os.path.exists(f"{table.path}/_compacting")


@pytest.mark.parametrize("step", [1, 2, 4])
def test_an_installation_that_broke_off_is_finished(spark, few, tmp_path, monkeypatch, step):
    """The moves and journal files of a compaction fail one after the other."""
    from millrace.sinks import events as module
    from millrace.sinks.journal import Journal

    table = EventTable(str(tmp_path / "t"), settle_every=2)
    _batches(spark, few, table, "s", 2)
    left = [step]

    def counted(whole):
        def run(*args, **known):
            left[0] -= 1
            if left[0] == 0:
                raise OSError("broke off")
            return whole(*args, **known)
        return run

    install = EventTable._install

    def watched(self, spark, aside):
        if not os.path.exists(f"{aside}/ready"):
            return install(self, spark, aside)
        with monkeypatch.context() as m:
            m.setattr(module, "ensure_folder", counted(module.ensure_folder))
            m.setattr(Journal, "write_segment", counted(Journal.write_segment))
            return install(self, spark, aside)

    with monkeypatch.context() as m:
        m.setattr(EventTable, "_install", watched)
        try:
            table.compact(spark, datetime.date(2024, 1, 3))
        except OSError:
            pass
    table.compact(spark, datetime.date(2024, 1, 3))
    assert table.read(spark).count() == table.zones(spark).rows() == few.count()
    assert sorted(reports.summary_from_states(table.states(spark)).collect()) == sorted(
        reports.event_summary(few).collect())
    assert table.insert_absent(few, 0, stream_id="other") == 0


def test_created_at_is_given_at_write(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    stamp = datetime.datetime(2026, 1, 1, 12)
    table.insert_absent(events, 0, created_at=stamp)
    assert table.read(spark).select("created_at").distinct().collect() == [(stamp,)]


def test_date_ranges_prune_partitions(spark, events, tmp_path):
    write_report_layout(events, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    start, end = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 12)
    kept = between(stored, start, end)
    plan = physical(kept)
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(event_timestamp" in plan
    assert kept.count() == between(events, start, end).count()
    days = {p.name for p in (tmp_path / "t").glob("event_date=*")}
    assert len(days) == events.select(F.to_date("event_timestamp")).distinct().count()


def scanned_partitions(df):
    """Partitions the scans of an executed plan have read, largest scan last."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numPartitions") if "Scan" in node.nodeName() else None
        if metric is not None and metric.isDefined():
            found.append(metric.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return sorted(found)


def test_newest_events_come_from_the_newest_dates(spark, events, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    path = str(tmp_path / "t")
    write_report_layout(events, path)
    stored, zones = spark.read.parquet(path), layout_zones(spark, path)
    per_date = stored.groupBy("event_date").count().orderBy(F.desc("event_date")).collect()
    assert zones.rows() == events.count() and zones.last() == events.agg(F.max("event_timestamp")).first()[0]
    monkeypatch.setattr(DataFrame, "inputFiles", None)
    few = reports.recent_events(stored, 10, zones)
    assert scanned_partitions(few) == [1]
    assert few.select(*EVENT_COLUMNS).collect() == reports.recent_events(events, 10).collect()
    many = reports.recent_activity(stored, per_date[0]["count"] + 1, zones)
    assert scanned_partitions(many) == [2]
    assert reports.recent_activity(stored, 10**6, zones).count() == events.count()
    assert reports.recent_activity(stored.where("event_id = ''"), 5, zones).count() == 0


def test_a_table_chooses_its_dates_from_the_journal(spark, few, tmp_path):
    table = EventTable(str(tmp_path / "t"), settle_every=2)
    _batches(spark, few, table, "s", 3)
    for _ in range(2):
        newest = table.newest(spark, 10)
        dates = {f.split("event_date=")[1].split("/")[0] for f in newest.inputFiles()}
        assert dates == {max(table.zones(spark).dates)}
        recent = reports.recent_events(newest, 10).select(*EVENT_COLUMNS)
        assert recent.collect() == reports.recent_events(few, 10).collect()
        start, end = datetime.datetime(2024, 1, 1, 6), datetime.datetime(2024, 1, 2)
        some = table.within(spark, start, end)
        assert {f.split("event_date=")[1].split("/")[0] for f in some.inputFiles()} == {
            "2024-01-01"}
        assert between(some, start, end).count() == between(few, start, end).count()
        table.compact(spark, datetime.date(2024, 2, 1))
    assert EventTable(str(tmp_path / "none")).newest(spark, 5).count() == 0


def test_last_hours_read_only_their_dates(spark, events, tmp_path):
    path = str(tmp_path / "t")
    write_report_layout(events, path)
    stored = spark.read.parquet(path)
    last = reports.last_hours(stored, 24, reports.newest(stored, layout_zones(spark, path)))
    assert scanned_partitions(last) == [2]
    newest = events.agg(F.max("event_timestamp")).first()[0]
    hourly = reports.hourly_events(events)
    expected = hourly.where(F.col("event_hour") > F.lit(newest - datetime.timedelta(days=1)))
    assert sorted(last.collect()) == sorted(expected.collect()) != []


def test_rolling_users_by_their_last_hour_in_a_span(spark):
    start = datetime.datetime(2024, 1, 1)
    hours = {"a": [0, 1, 23, 24, 25, 80], "b": [0, 24], "c": [3, 28], "d": [47], "e": [100, 123]}
    rows = [(start + datetime.timedelta(hours=h), kind, u)
            for u, hs in hours.items() for h in hs for kind in ("view", "purchase")]
    users = spark.createDataFrame(rows, "event_hour timestamp_ntz, event_type string, user_id string")
    for length in (1, 2, 24):
        got = reports.rolling_users_exact(users, length)
        assert sorted(map(tuple, got.collect())) == [
            (start + datetime.timedelta(hours=h),
             sum(any(h - length < x <= h for x in hs) for hs in hours.values()))
            for h in sorted({h for hs in hours.values() for h in hs})]


def test_rolling_users_sends_no_user_to_every_span(spark, tmp_path):
    """Counts by hour go to the spans: their rows do not grow with the users."""
    from workload.queries import rolling_users

    lines = physical(rolling_users(spark, SF)).split("\n")
    spans = [n for n, line in enumerate(lines) if "Generate" in line]
    assert len(spans) == 2
    for n in spans:
        assert "user_id" not in lines[n]
        # Put together by hour just below.
        assert any("Aggregate" in line for line in lines[n + 1:n + 4])


def test_states_leave_settled_events_alone(spark, few, tmp_path):
    table = EventTable(str(tmp_path / "t"), settle_every=2)
    _batches(spark, few, table, "s")
    table.compact(spark, datetime.date(2024, 2, 1))
    users = table.states(spark)
    last = table.read(spark).where("stream_id = 's' AND batch_id = 5").count()
    assert [n for parts, n in scans(users) if parts] == [last]  # of the few the last batch alone
    for report, from_states in ((reports.event_summary, reports.summary_from_states),
                                (reports.hourly_events, reports.hourly_from_states),
                                (reports.purchase_funnel, reports.funnel_from_states)):
        assert sorted(from_states(users).collect()) == sorted(report(few).collect())
    products = reports.products_from_states(table.states(spark, "products"))
    assert products.collect() == reports.top_products(few).collect()


def test_a_user_or_product_is_in_few_row_groups(spark, tmp_path):
    """A date of 200 users and 200 products: the files hold a small part of each."""
    rows = made_up(spark, 0, 60000).withColumns({
        "event_timestamp": F.expr("timestamp_ntz'2024-01-01 00:00:00'"),
        "user_id": F.concat(F.lit("u"), F.pmod(F.xxhash64("event_id"), F.lit(200))),
        "product_id": F.concat(F.lit("p"), F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(200))),
    })
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(rows, 0)
    table.insert_absent(made_up(spark, 60000, 60001), 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.compact(spark, datetime.date(2024, 2, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = table.read(spark)
    for report, column, value in ((reports.events_of_user, "user_id", "u7"),
                                  (reports.events_of_product, "product_id", "p7")):
        mine = report(stored, value)
        assert mine.count() == rows.where(F.col(column) == value).count() > 100
        assert sum(n for _, n in scans(mine)) < 60000 / 2


def test_reports_read_only_their_columns(spark, events, tmp_path):
    write_report_layout(events, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = physical(reports.event_summary(stored))
    assert "ReadSchema: struct<user_id:string,price:decimal(10,2),event_type:string>" in plan
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in physical(
        reports.top_products(stored)
    )


def test_grouping_a_bucketed_table_needs_no_shuffle(spark, events, tmp_path):
    save_bucketed(events, "events_by_user", 4)
    funnel = reports.purchase_funnel(spark.table("events_by_user"))
    assert "Exchange" not in physical(funnel)
    assert sorted(funnel.collect()) == sorted(reports.purchase_funnel(events).collect())


def test_views(spark, events):
    register_views(events)
    for name, report in VIEWS.items():
        assert sorted(map(str, spark.table(name).collect())) == sorted(
            map(str, report(events).collect())
        )
    register_views(events.limit(0))  # replaces
    assert spark.table("v_event_summary").count() == 0


def test_views_of_a_stored_table(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(events, 0)
    for zones in (None, table.zones(spark)):
        register_views(table.read(spark), zones=zones)
        for name, report in VIEWS.items():
            assert sorted(map(str, spark.table(name).collect())) == sorted(
                map(str, report(events).collect())
            )


def test_a_condition_on_the_hour_of_the_view_reads_only_its_dates(spark, events, tmp_path):
    table = EventTable(str(tmp_path / "t"))
    table.insert_absent(events, 0)
    register_views(table.read(spark), zones=table.zones(spark))
    text = "SELECT * FROM v_hourly_events WHERE event_hour > timestamp_ntz'{}'"
    newest = max(table.zones(spark).dates)
    last = spark.sql(text.format(f"{newest} 05:00:00"))
    assert "GreaterThan(event_hour" in physical(last)
    assert max(n for n, _ in scans(last) if n is not None) == 1
    want = reports.hourly_events(events).where(f"event_hour > timestamp_ntz'{newest} 05:00:00'")
    assert sorted(last.collect()) == sorted(want.collect()) != []


def test_a_predicate_on_a_view_reaches_the_scan(spark, events, tmp_path):
    write_report_layout(events, str(tmp_path / "t"))
    register_views(spark.read.parquet(str(tmp_path / "t")))
    plan = physical(spark.sql("select * from v_event_summary where event_type = 'view'"))
    assert "EqualTo(event_type,view)" in plan


def test_table_definition(spark, tmp_path):
    spark.sql(table_ddl("stored_events", str(tmp_path / "t")))
    table = spark.table("stored_events")
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in STORED]
    comments = {r.col_name: r.comment for r in spark.sql("describe stored_events").collect()}
    assert comments["event_id"].startswith("Unique id")
    spark.sql("drop table stored_events")


def test_random_sample(events):
    assert reports.random_sample(events, 5, seed=1).count() == 5


def test_export_files(spark, events, tmp_path):
    path = export_landing(events.coalesce(1), str(tmp_path / "out"), rows_per_file=100)
    files = sorted((tmp_path / "out").glob("*.csv"))
    assert len(files) == -(-events.count() // 100)
    header = "event_id,user_id,product_id,product_name,category,price,event_type,timestamp"
    assert all(f.read_text().startswith(header + "\n") for f in files)
    assert sum(len(f.read_text().splitlines()) - 1 for f in files) == events.count()
    assert read_landing(spark, path).count() == events.count()


def test_export_keeps_blanks_and_quotes(spark, tmp_path):
    row = (" e ", "u", "p", 'a "b", c', "c", 1.5, " VIEW ", "2026-01-01 00:00:00")
    from millrace.model import LANDING

    path = export_landing(spark.createDataFrame([row], LANDING), str(tmp_path / "out"))
    assert tuple(read_landing(spark, path).select(*LANDING.fieldNames()).first()) == row


def test_rejected_rows_are_replaced(spark, tmp_path):
    df = spark.range(3).selectExpr("cast(id as string) event_id", "'x' reasons")
    for _ in range(2):
        write_rejected(df, str(tmp_path / "r"), 7)
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert back.count() == 3 and back.select("batch_id").distinct().collect() == [(7,)]


def test_rejected_text_is_kept_as_it_came(spark, tmp_path):
    rows = [(" 2026-01-15 10:00:00", "timestamp_unparsable", None), (None, "corrupt_record", "  short,u  "),
            ("", 'quo"te', "a,b")]
    df = spark.createDataFrame(rows, "timestamp string, reasons string, _corrupt_record string")
    write_rejected(df, str(tmp_path / "r"), 1, stream_id="s")
    back = read_rejected(spark, str(tmp_path / "r"), ["timestamp", "reasons", "raw_line"])
    got = [(r.timestamp or "", r.reasons, r.raw_line) for r in back.collect()]
    assert sorted(got) == sorted((t or "", x, raw) for t, x, raw in rows)
    assert {(r.stream_id, r.batch_id) for r in back.collect()} == {("s", 1)}


def test_ledger_continues_ids(spark, tmp_path):
    path = str(tmp_path / "l")
    ledger = Ledger(path)
    assert ledger.last_id(spark, 0) == 0
    counts = dict(received=1, corrupt=0, valid=1, invalid=0, kept=1, written=1)
    for batch_id, last_id in ((0, 10), (1, 25)):
        ledger.record(spark, batch_id, {**counts, "last_id": last_id})
    assert ledger.last_id(spark, 2) == Ledger(path).last_id(spark, 2) == 25
    assert ledger.last_id(spark, 1) == 10  # a replay of batch 1 ignores its own row
    assert ledger.last_id(spark, 0, "another") == 25  # a new stream goes on after the others
    ledger.record(spark, 0, {**counts, "last_id": 30}, "another")
    assert ledger.read(spark).count() == 3
    assert Ledger(path).last_id(spark, 2) == 30


def test_retry():
    calls, waits = [], []

    def write():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "done"

    assert with_retry(write, 3, 5.0, waits.append) == "done"
    assert len(calls) == 3 and waits == [5.0, 5.0]
    calls.clear()
    with pytest.raises(OSError):
        with_retry(write, 2, 0, waits.append)


def test_merge_statement_inserts_only_new_ids():
    con = duckdb.connect()
    columns = ", ".join(f"{c} varchar" for c in EVENT_COLUMNS)
    con.execute(f"create table t (id integer, {columns})")
    con.execute(f"create table s ({columns})")
    rest = ", ".join("'x'" for _ in EVENT_COLUMNS[1:])
    con.execute(f"insert into t values (1, 'a', {rest})")
    con.execute(f"insert into s values ('a', {rest}), ('b', {rest})")
    for _ in range(2):  # safe to repeat
        con.execute(merge_statement("t", "s"))
        assert con.execute("select event_id from t order by 1").fetchall() == [("a",), ("b",)]


class Connection:
    """A JDBC connection's methods on a DuckDB connection; notes what is asked of it."""

    def __init__(self, con, fails_at=None):
        self.con, self.calls, self.fails_at = con, [], fails_at

    def setAutoCommit(self, on):
        assert not on
        self.con.execute("begin")

    def createStatement(self):
        return self

    def setQueryTimeout(self, seconds):
        self.calls.append(("timeout", seconds))

    def executeUpdate(self, sql):
        if self.fails_at and self.fails_at in sql:
            raise OSError("connection lost")
        rows = self.con.execute(sql).fetchall()
        return rows[0][0] if rows else 0

    def executeQuery(self, sql):
        rows = iter(self.con.execute(sql).fetchall())
        found = SimpleNamespace(row=None)

        def step():
            found.row = next(rows, None)
            return found.row is not None

        return SimpleNamespace(next=step, getLong=lambda i: found.row[i - 1])

    def commit(self):
        self.calls.append("commit")
        self.con.execute("commit")

    def rollback(self):
        self.calls.append("rollback")
        self.con.execute("rollback")

    def close(self):
        self.calls.append("close")


@pytest.fixture
def staged():
    """A table that holds one of two staged events."""
    con = duckdb.connect()
    columns = ", ".join(f"{c} varchar" for c in EVENT_COLUMNS)
    con.execute(f"create table user_events ({columns})")
    rest = ", ".join("'x'" for _ in EVENT_COLUMNS[1:])
    con.execute(f"insert into user_events values ('a', {rest})")

    def stage():
        con.execute(f"create or replace table s ({columns})")
        con.execute(f"insert into s values ('a', {rest}), ('b', {rest})")

    stage()
    return con, stage


def move(connection, batch_id=3):
    properties = SimpleNamespace(setProperty=lambda key, value: None)
    jvm = SimpleNamespace(
        java=SimpleNamespace(
            util=SimpleNamespace(Properties=lambda: properties),
            sql=SimpleNamespace(
                DriverManager=SimpleNamespace(getConnection=lambda url, properties: connection)
            ),
        )
    )
    target = JdbcEvents(Database("jdbc:x", "u", "p", query_timeout=9))
    return target._move(SimpleNamespace(_jvm=jvm), "s", "stream-1", batch_id)


def test_staged_rows_move_in_one_transaction(staged):
    con, _ = staged
    connection = Connection(con)
    assert move(connection) == 1
    assert connection.calls == [("timeout", 9), "commit", "close"]
    assert con.execute("select event_id from user_events order by 1").fetchall() == [("a",), ("b",)]
    assert con.execute("select * from user_events_batches").fetchall() == [("stream-1", 3, 1)]


def test_a_repeat_after_a_lost_answer_returns_what_was_stored(staged):
    con, stage = staged
    assert move(Connection(con)) == 1
    stage()
    assert move(Connection(con)) == 1
    stage()
    assert move(Connection(con), batch_id=4) == 0
    assert con.execute("select sum(written) from user_events_batches").fetchone() == (1,)


def test_a_failed_move_is_rolled_back(staged):
    con, _ = staged
    connection = Connection(con, fails_at="DROP TABLE")
    with pytest.raises(OSError):
        move(connection)
    assert connection.calls[-2:] == ["rollback", "close"]
    assert con.execute("select count(*) from user_events").fetchone() == (1,)


def test_database_settings(spark, monkeypatch):
    for name in ("PASSWORD", "DB", "USER"):
        monkeypatch.delenv(f"POSTGRES_{name}", raising=False)
    monkeypatch.setenv("POSTGRES_HOST", "db")
    with pytest.raises(ValueError, match="POSTGRES_DB, POSTGRES_USER"):
        Database.from_environment()
    monkeypatch.setenv("POSTGRES_DB", "shop")
    monkeypatch.setenv("POSTGRES_USER", "writer")
    database = Database.from_environment()
    assert database.options() == {
        "url": "jdbc:postgresql://db:5432/shop",
        "driver": "org.postgresql.Driver",
        "user": "writer",
    }
    assert "secret" not in repr(Database("jdbc:x", password="secret"))
    assert not database.reachable(spark)  # the driver is not on the class path
    assert JdbcEvents(database).name == "user_events"
