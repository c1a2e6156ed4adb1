"""The stored event table as partitioned Parquet."""

import json
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import functions as F

from millrace.functions.cleaning import event_date
from millrace.functions.timekeeping import hour_of
from millrace.model import DIRECT, EVENT_COLUMNS
from millrace.operators.dedup import absent_from
from millrace.operators.ordering import numbered, ordered
from millrace.session import ensure_folder, existing, filesystem, read_text, remove_folders, write_text
from millrace.sinks.ids import IdIndex, keyed
from millrace.sinks.journal import Journal, Zone, shown
from millrace.sinks.layout import clustered
from millrace.sinks.states import States, of_events
from millrace.sources.events import Zones, read_events

# The name under which compact() stores what many batches have stored.
COMPACTED = "compacted"
# Segments of one level before they become one of the next.
FANOUT = 4
# Rows that a task of a batch orders and writes; fewer, down to the second number, as long as
# there are cores without a task.
TASK_ROWS = 1 << 18
SPREAD_ROWS = 1 << 15


@dataclass(frozen=True)
class EventTable:
    """A table with one writer at a time. Each micro-batch of a stream owns the folders
    stream_id=<s>/batch_id=<n> below the dates and replaces them, so that a replayed batch
    does not repeat rows and another stream's batch of that number is left alone.

    A batch is shown when the journal has its file, which is written last: readers never see a
    part of it. The journal also holds the rows and times of each date, so that reports choose their
    dates without listing or reading.

    After settle_every batches those that cannot run again become a segment: their ids go to an
    index by hash, their partial results beside it. Segments of one size are put together, so their
    number grows with the logarithm of the table. A batch compares its ids with the unsettled
    batches and with the index files, or pages, that its own hashes fall into.
    """

    path: str
    ids_per_file: int = 1 << 18
    settle_every: int = 50

    @property
    def ids(self):
        return IdIndex(f"{self.path}/_ids", self.ids_per_file)

    @property
    def journal(self):
        return Journal(f"{self.path}/_journal")

    @property
    def partials(self):
        return States(f"{self.path}/_states")

    # ---- reading -----------------------------------------------------------------

    def read(self, spark, dates=None):
        """The rows of all recorded batches, of all dates or of some."""
        ensure_folder(spark, self.path)
        rows = read_events(spark, self.path, dates)
        if not self.journal.exists(spark):
            return rows
        return rows.where(shown({(z.stream_id, z.batch_id) for z in self.journal.zones(spark)}))

    def zones(self, spark):
        """Rows and times by date of what read() shows, from the journal."""
        return Zones.of(
            (z.event_date, z.rows, z.first, z.last) for z in self.journal.zones(spark) if z.rows)

    def newest(self, spark, n):
        """The rows of the latest dates that hold n rows; no other folder is listed."""
        return self.read(spark, self.zones(spark).newest(n))

    def within(self, spark, start, end):
        """The rows of the dates that have events from start to before end."""
        return self.read(spark, self.zones(spark).within(start, end))

    def states(self, spark, part="users"):
        """Partial results (see States) of all rows: stored ones of the settled batches, and those
        of the open ones' events."""
        names = [s.data for s in self.journal.segments(spark)]
        stored = self.partials.read(spark, part, names)
        waiting = self._rows_of(spark, self.journal.unsettled(spark))
        return stored.unionByName(of_events(waiting, part))

    def _rows_of(self, spark, zones):
        """The rows of some open batches; only their dates are listed."""
        dates = {z.event_date for z in zones if z.rows}
        rows = read_events(spark, self.path, sorted(dates))
        return rows.where(shown({(z.stream_id, z.batch_id) for z in zones}))

    def last_id(self, spark, batch_id, stream_id=DIRECT):
        """The highest id that other batches have stored, 0 if there is none."""
        return max((z.last_id for z in self.journal.zones(spark)
                    if (z.stream_id, z.batch_id) != (stream_id, batch_id)), default=0)

    # ---- writing -----------------------------------------------------------------

    def _clear(self, spark, batch_id, stream_id):
        """Remove what the batch, or one that broke off and never came back, has left."""
        ensure_folder(spark, self.path)
        if not self.journal.exists(spark):
            if existing_batches(spark, self.path):
                raise ValueError(f"{self.path} has batches but no journal: write its rows anew")
            ensure_folder(spark, self.journal.path)
        self.journal.withdraw(spark, stream_id, batch_id)
        recorded = {(z.stream_id, z.batch_id) for z in self.journal.zones(spark)}
        for stream, batch in existing_batches(spark, self.path) - recorded:
            remove_folders(spark, f"{self.path}/event_date=*/stream_id={stream}/batch_id={batch}")

    def insert_absent(
        self, events, batch_id, last_id=0, created_at=None, stream_id=DIRECT, first=True, rows=None
    ):
        """Store the events whose id no other batch has stored.

        events must have unique ids. Returns the number of rows written. Ids continue
        after last_id in event order. first=False says that this process has stored the
        stream's batch before, and that this one has not been tried yet: nothing is
        left over then that had to be looked for. rows is the number of events, if known.
        """
        spark = events.sparkSession
        if first:
            self._clear(spark, batch_id, stream_id)
        pinned = []

        def pin(df):
            # Recomputed from the same shuffle if an executor is lost.
            pinned.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return pinned[-1]

        try:
            batch = events.select(*EVENT_COLUMNS)
            if rows is None:
                # The lookup in the index, the comparison and the rows themselves read it.
                batch = pin(batch)
                rows = batch.count()
            # Pinned as well, since ordering looks at the rows before it deals them out.
            fresh = pin(self._absent(batch, batch_id, stream_id, rows))
            # The order of the ids also puts neighbouring dates into the same tasks,
            # and a busy date into many.
            tasks = write_tasks(rows, spark.sparkContext.defaultParallelism)
            rows_in_order = ordered(fresh, ["event_timestamp", "event_id"], pin, tasks)
            # A row per task and date: neighbouring dates are in the same tasks.
            found = rows_in_order.groupBy("_part", event_date().alias("event_date")).agg(
                F.count("*").alias("rows"), F.min("event_timestamp").alias("first"),
                F.max("event_timestamp").alias("last")).collect()
            written = sum(r["rows"] for r in found)
            if written:
                self._write(rows_in_order, found, last_id, batch_id, stream_id, created_at)
            zones = _zones(found, stream_id, batch_id, last_id + written)
            self.journal.commit(spark, stream_id, batch_id, zones)
        finally:
            for df in pinned:
                df.unpersist()
        if batch_id % self.settle_every == self.settle_every - 1:
            self.settle(spark)
        return written

    def _absent(self, events, batch_id, stream_id, rows):
        """The events that no other recorded batch has stored."""
        spark = events.sparkSession
        names = [s.data for s in self.journal.segments(spark)]
        others = [z for z in self.journal.unsettled(spark)
                  if (z.stream_id, z.batch_id) != (stream_id, batch_id)]
        stored = self._rows_of(spark, others).select("event_id")
        if names:
            stored = stored.unionAll(self.ids.near(events, names, rows).select("event_id"))
        return absent_from(events, stored)

    def _write(self, rows, found, last_id, batch_id, stream_id, created_at):
        parts = {}
        for r in found:
            parts[r["_part"]] = parts.get(r["_part"], 0) + r["rows"]
        stamp = F.lit(created_at) if created_at is not None else F.current_timestamp()
        (
            numbered(rows, sorted(parts.items()), start=last_id)
            .select("id", *EVENT_COLUMNS)
            .withColumns(
                {
                    "created_at": stamp.cast("timestamp_ntz"),
                    "event_hour": hour_of("event_timestamp"),
                    "event_date": event_date(),
                    "stream_id": F.lit(stream_id),
                    "batch_id": F.lit(batch_id),
                }
            )
            # The order that the writer needs, and within it the one that statistics like.
            .sortWithinPartitions(
                "event_date", "stream_id", "batch_id", "event_type", "event_timestamp")
            .write.mode("append")
            .partitionBy("event_date", "stream_id", "batch_id")
            .parquet(self.path)
        )

    # ---- maintenance -------------------------------------------------------------

    def settle(self, spark):
        """Make a segment of the batches that cannot run again: all but the last of each stream.

        Everything is written under the segment's name before its journal file counts; what
        breaks off leaves unused files and is done again by the next call.
        """
        ended = {(stream, z.batch_id) for stream, zones in self.journal.open(spark).items()
                 for z in zones if z.batch_id < zones[-1].batch_id}
        zones = [z for z in self.journal.unsettled(spark) if (z.stream_id, z.batch_id) in ended]
        if zones:
            data = uuid.uuid4().hex
            rows = self._rows_of(spark, zones)
            self.ids.write(keyed(rows), data)
            self.partials.write(rows, data)
            self.journal.write_segment(spark, 0, zones, data)
        self.journal.drop(spark, ended)
        for level in range(1 << 8):
            alike = [s for s in self.journal.segments(spark) if s.level == level]
            if len(alike) < FANOUT:
                break
            self._merge(spark, alike, level + 1, [z for s in alike for z in s.zones])

    def _merge(self, spark, segments, level, zones):
        """One segment of several."""
        data = uuid.uuid4().hex
        self.ids.merge(spark, [s.data for s in segments], data)
        self.partials.merge(spark, [s.data for s in segments], data)
        merged = self.journal.write_segment(spark, level, zones, data, replaces=segments)
        self.journal.remove_segments(spark, segments)
        for segment in segments:
            self.ids.remove(spark, segment.data)
            self.partials.remove(spark, segment.data)
        return merged

    def compact(self, spark, before):
        """Rewrite the dates before a date into few files each, clustered by hour, user and product.

        The last batch of each stream stays as it is, so that a replay finds it. All new files
        are written to the side first; then, date by date, they are moved in and the old
        folders removed. compact() finishes what an earlier call has left undone. To be
        run while no batch and no report runs.
        """
        aside = f"{self.path}/_compacting"
        self._install(spark, aside)
        self.settle(spark)
        zones = [z for s in self.journal.segments(spark) for z in s.zones if z.rows]
        dates = sorted({z.event_date for z in zones
                        if z.stream_id != COMPACTED and z.event_date < str(before)})
        if not dates:
            return
        closed = read_events(spark, self.path, dates).where(
            shown({(z.stream_id, z.batch_id) for z in zones}))
        run = max((z.batch_id for z in zones if z.stream_id == COMPACTED), default=-1) + 1
        staged = f"{aside}/{uuid.uuid4().hex}"
        (
            clustered(closed.withColumns({"stream_id": F.lit(COMPACTED), "batch_id": F.lit(run)}))
            .write.options(**bloom_filters()).partitionBy("event_date", "stream_id", "batch_id")
            .parquet(staged)
        )
        found = read_events(spark, staged).groupBy("event_date").agg(
            F.count("*").alias("rows"), F.min("event_timestamp").alias("first"),
            F.max("event_timestamp").alias("last"), F.max("id").alias("last_id")).collect()
        plan = [dict(event_date=str(r["event_date"]), rows=r["rows"], first=r["first"].isoformat(),
                     last=r["last"].isoformat(), last_id=r["last_id"]) for r in found]
        write_text(spark, f"{aside}/plan.json", json.dumps(dict(run=run, zones=plan)))
        # From here on the staged folder counts.
        fs, source = filesystem(spark, staged)
        fs.rename(source, filesystem(spark, f"{aside}/ready")[1])
        self._install(spark, aside)

    def _install(self, spark, aside):
        """Move staged dates in, each with the removal of what it stands for.

        The journal shows the new batch from the start, so that no row is hidden in between,
        and forgets the old ones at the end.
        """
        if existing(spark, [f"{aside}/ready"]):
            plan = json.loads(read_text(spark, f"{aside}/plan.json"))
            run = plan["run"]
            new = [Zone(COMPACTED, run, **z) for z in plan["zones"]]
            dates = {z.event_date for z in new}
            segments = self.journal.segments(spark)
            old = [z for s in segments for z in s.zones]
            if len(segments) > 1 or (COMPACTED, run) not in {(z.stream_id, z.batch_id) for z in old}:
                both = [*old, Zone(COMPACTED, run, None, 0, None, None, 0)]
                segments = [self._merge(spark, segments, max(s.level for s in segments), both)]
            for z in old:
                if z.event_date in dates and (z.stream_id, z.batch_id) != (COMPACTED, run):
                    remove_folders(spark, f"{self.path}/event_date={z.event_date}/"
                                          f"stream_id={z.stream_id}/batch_id={z.batch_id}")
            for date in sorted(dates):
                inner = f"event_date={date}/stream_id={COMPACTED}"
                ensure_folder(spark, f"{self.path}/{inner}")
                source = f"{aside}/ready/{inner}/batch_id={run}"
                if existing(spark, [source]):
                    fs, place = filesystem(spark, source)
                    fs.rename(place, filesystem(spark, f"{self.path}/{inner}/batch_id={run}")[1])
            kept = [z for z in old
                    if z.event_date not in dates and (z.stream_id, z.batch_id) != (COMPACTED, run)]
            self.journal.write_segment(
                spark, segments[0].level, [*kept, *new], segments[0].data, replaces=segments)
            self.journal.remove_segments(spark, segments)
        remove_folders(spark, aside)


def write_tasks(rows, cores):
    """How many tasks order and write a batch."""
    return max(1, -(-rows // TASK_ROWS), min(cores, -(-rows // SPREAD_ROWS)))


def bloom_filters():
    """Parquet options by which a reader passes over row groups without a user or product."""
    return {f"parquet.bloom.filter.enabled#{c}": "true"
            for c in ("event_id", "user_id", "product_id")}


def _zones(found, stream_id, batch_id, last_id):
    """Zones of a batch from its rows per task and date."""
    dates = {}
    for r in found:
        rows, first, last = dates.get(r["event_date"], (0, r["first"], r["last"]))
        dates[r["event_date"]] = (
            rows + r["rows"], min(first, r["first"]), max(last, r["last"]))
    return [Zone(stream_id, batch_id, str(date), rows, first.isoformat(), last.isoformat(), last_id)
            for date, (rows, first, last) in sorted(dates.items())]


def existing_batches(spark, path):
    """(stream_id, batch_id) of all folders of a table, recorded or not."""
    fs, pattern = filesystem(spark, f"{path}/event_date=*/stream_id=*/batch_id=*")
    found = set()
    for status in fs.globStatus(pattern) or []:
        place = status.getPath()
        found.add((place.getParent().getName().removeprefix("stream_id="),
                   int(place.getName().removeprefix("batch_id="))))
    return found
