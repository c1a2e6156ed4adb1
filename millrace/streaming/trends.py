"""Windowed counts of a stream, for a stream with event_clock."""

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from millrace.functions.timekeeping import as_wall_clock, hour_of, minute_of
from millrace.model import DIRECT
from millrace.session import filesystem, read_text, remove_folders, write_text
from millrace.streaming.dedup import CLOCK


def hourly_stream(stream, exact=True):
    """Events and distinct users per hour and type, once the hour has closed.

    exact counts per user first and then the users, so the state is one small row
    per hour, type and user and no task holds the users of a whole hour. Otherwise
    a sketch of fixed size estimates them, which also allows update mode.
    """
    hour = F.window(CLOCK, "1 hour")
    if exact:
        per_user = stream.groupBy(hour, "event_type", "user_id").agg(F.count("*").alias("n"))
        hourly = per_user.groupBy(
            F.window(F.window_time("window"), "1 hour"), "event_type"
        ).agg(F.sum("n").alias("event_count"), F.count("*").alias("unique_users"))
    else:
        hourly = stream.groupBy(hour, "event_type").agg(
            F.count("*").alias("event_count"),
            F.approx_count_distinct("user_id").alias("unique_users"),
        )
    return hourly.select(
        as_wall_clock(F.col("window.start")).alias("event_hour"),
        "event_type",
        "event_count",
        "unique_users",
    )


def minute_stream(stream):
    """Events per minute, once the minute has closed."""
    minutes = stream.groupBy(F.window(CLOCK, "1 minute")).agg(F.count("*").alias("event_count"))
    return minutes.select(as_wall_clock(F.col("window.start")).alias("minute"), "event_count")


# Runs of a tier before they are put together.
FANOUT = 4
COUNTS = "event_type string, user_id string, n bigint"
TIERS = {
    "hours": (["event_hour", "event_type", "user_id"], f"event_hour timestamp_ntz, {COUNTS}"),
    "minutes": (["minute"], "minute timestamp_ntz, n bigint"),
    "open": (["minute", "event_type", "user_id"], f"minute timestamp_ntz, {COUNTS}"),
}


@dataclass(frozen=True)
class Trends:
    """Counts per window that are complete at any time, open windows included.

    A micro-batch adds its own counts per minute, type and user, in a folder that a replay replaces;
    no state is kept. After fold_every batches fold() adds up those that cannot run again: windows
    that ended ``delay`` before the newest event are closed and go to the tables of hours (per user,
    so that distinct users stay exact) and minutes, the others stay open. Rows that come later than
    that are corrections: they count in their window like any other, and late() tells how many.
    So a read takes the unfolded batches, the open windows and a few runs of each tier.

    The tables of one fold stand in one small file; what breaks off before it leaves unused files.
    """

    path: str
    delay: str = "1 hour"
    fold_every: int = 20

    def start(self, events, checkpoint, trigger="10 seconds", available_now=False):
        """Count a stream of events."""
        writer = (
            events.writeStream.foreachBatch(self._store)
            .option("checkpointLocation", checkpoint)
        )
        writer = (
            writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime=trigger)
        )
        return writer.start()

    def _store(self, batch, batch_id):
        spark = batch.sparkSession
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT
        minute = minute_of("event_timestamp").alias("minute")
        counts = batch.groupBy(minute, "event_type", "user_id").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(
            f"{self.path}/new/stream_id={stream_id}/batch_id={batch_id}")
        if batch_id % self.fold_every == self.fold_every - 1:
            self.fold(spark)

    # ---- what stands where ---------------------------------------------------------

    def _notes(self, spark):
        """The last fold's file: batches folded by stream, runs by tier, the end of the closed
        windows, late rows; and its number."""
        fs, pattern = filesystem(spark, f"{self.path}/folds/*.json")
        files = sorted(s.getPath().toString() for s in fs.globStatus(pattern) or [])
        if not files:
            return dict(folded={}, runs={t: [] for t in TIERS}, closed=None, late=0), -1
        return json.loads(read_text(spark, files[-1])), int(files[-1][-17:-5])

    def _new(self, spark, notes):
        """(stream, batch) of the folders that no fold has taken."""
        fs, pattern = filesystem(spark, f"{self.path}/new/stream_id=*/batch_id=*")
        places = [s.getPath().toString().split("/")[-2:] for s in fs.globStatus(pattern) or []]
        found = [(s.removeprefix("stream_id="), int(b.removeprefix("batch_id="))) for s, b in places]
        return sorted((s, b) for s, b in found if b > notes["folded"].get(s, -1))

    def _folder(self, stream, batch):
        return f"{self.path}/new/stream_id={stream}/batch_id={batch}"

    def _rows(self, spark, tier, folders):
        schema = TIERS[tier][1]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*folders)

    def _runs(self, spark, notes, tier):
        return self._rows(spark, tier, [f"{self.path}/{tier}/{r}" for r in notes["runs"][tier]])

    def _unclosed(self, spark, notes):
        """New batches and open windows: n per minute, event_type and user_id."""
        new = self._rows(spark, "open", [self._folder(*b) for b in self._new(spark, notes)])
        return new.unionAll(self._runs(spark, notes, "open"))

    # ---- folding -------------------------------------------------------------------

    def _write(self, rows, tier, run):
        keys = TIERS[tier][0]
        rows.groupBy(*keys).agg(F.sum("n").alias("n")).write.parquet(f"{self.path}/{tier}/{run}")
        return run

    def fold(self, spark):
        """Put the batches that cannot run again, all but the last of each stream, into the tiers."""
        notes, number = self._notes(spark)
        new = self._new(spark, notes)
        last = dict(new)
        taken = [(s, b) for s, b in new if b < last[s]]
        if not taken:
            return
        added = self._rows(spark, "open", [self._folder(*b) for b in taken])
        rows = added.unionAll(self._runs(spark, notes, "open"))
        before = F.lit(notes["closed"]).cast("timestamp_ntz")
        late = added.where(F.col("minute") < before).agg(F.sum("n")).first()[0] or 0
        newest = rows.agg(F.max("minute")).first()[0]
        closed = notes["closed"] if newest is None else self._end_of_closed(spark, newest, before)
        is_closed = F.coalesce(
            F.col("minute") < F.lit(closed).cast("timestamp_ntz"), F.lit(False))
        run = uuid.uuid4().hex
        ended = rows.where(is_closed)
        runs = dict(notes["runs"])
        runs["open"] = [self._write(rows.where(~is_closed), "open", run)]
        runs["minutes"] = [*runs["minutes"], self._write(ended, "minutes", run)]
        hours = ended.withColumn("event_hour", hour_of("minute"))
        runs["hours"] = [*runs["hours"], self._write(hours, "hours", run)]
        for tier in ("hours", "minutes"):
            if len(runs[tier]) >= FANOUT:
                merged = self._runs(spark, dict(runs=runs), tier)
                runs[tier] = [self._write(merged, tier, uuid.uuid4().hex)]
        folded = {**notes["folded"], **dict(taken)}
        after = dict(folded=folded, runs=runs, closed=closed, late=notes["late"] + late)
        write_text(spark, f"{self.path}/folds/{number + 1:012d}.json", json.dumps(after))
        self._remove_spent(spark, after, number)

    def _end_of_closed(self, spark, newest, before):
        """The hour that ended ``delay`` before the newest minute, as text; it never goes back."""
        passed = F.lit(str(newest)).cast("timestamp_ntz") - F.expr(f"interval {self.delay}")
        hour = spark.range(1).select(passed.alias("at")).select(
            F.greatest(hour_of("at"), before).cast("string").alias("at"))
        return hour.first()["at"]

    def _remove_spent(self, spark, notes, number):
        for stream, batch in notes["folded"].items():
            fs, pattern = filesystem(spark, f"{self.path}/new/stream_id={stream}/batch_id=*")
            for status in fs.globStatus(pattern) or []:
                if int(status.getPath().getName().removeprefix("batch_id=")) <= batch:
                    fs.delete(status.getPath(), True)
        for tier, runs in notes["runs"].items():
            fs, pattern = filesystem(spark, f"{self.path}/{tier}/*")
            for status in fs.globStatus(pattern) or []:
                if status.getPath().getName() not in runs:
                    fs.delete(status.getPath(), True)
        remove_folders(spark, f"{self.path}/folds/{number:012d}.json")

    # ---- reading -------------------------------------------------------------------

    def hourly(self, spark):
        """Events and distinct users per hour and type."""
        notes, _ = self._notes(spark)
        unclosed = self._unclosed(spark, notes).select(
            hour_of("minute").alias("event_hour"), "event_type", "user_id", "n")
        rows = self._runs(spark, notes, "hours").unionAll(unclosed)
        return rows.groupBy("event_hour", "event_type").agg(
            F.sum("n").alias("event_count"), F.count_distinct("user_id").alias("unique_users"))

    def minutes(self, spark):
        """Events per minute."""
        notes, _ = self._notes(spark)
        rows = self._runs(spark, notes, "minutes").unionAll(
            self._unclosed(spark, notes).select("minute", "n"))
        return rows.groupBy("minute").agg(F.sum("n").alias("event_count"))

    def late(self, spark):
        """Rows that came after their window was closed."""
        notes, _ = self._notes(spark)
        closed = F.lit(notes["closed"]).cast("timestamp_ntz")
        new = self._rows(spark, "open", [self._folder(*b) for b in self._new(spark, notes)])
        return notes["late"] + (new.where(F.col("minute") < closed).agg(F.sum("n")).first()[0] or 0)
