"""The ingestion stream: landing files in, each event stored once."""

import itertools
import logging
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.model import CORRUPT, DIRECT, EVENT_COLUMNS
from millrace.operators.dedup import keep_first
from millrace.operators.quality import clean, judge, rejected, to_event_columns, valid
from millrace.session import remove_folders
from millrace.sinks.events import EventTable
from millrace.sinks.jdbc import JdbcEvents
from millrace.sinks.ledger import Ledger
from millrace.sinks.quarantine import write_rejected
from millrace.sinks.retry import with_retry
from millrace.sources.landing import SOURCE_FILE, SOURCE_TIME

log = logging.getLogger("millrace")


@dataclass(frozen=True)
class Pipeline:
    """Where a stream's events, rejected rows and batch counts go.

    foreachBatch may run a batch again after a failure. Each write is keyed by the
    stream (the id Spark keeps in the checkpoint) and the batch id and replaces itself, in
    the order rejects, events, ledger. A new checkpoint is another stream.
    """

    target: EventTable | JdbcEvents
    quarantine: str
    ledger: Ledger
    strict: bool = True
    attempts: int = 3
    retry_delay: float = 5.0
    quarantine_format: str = "csv"

    def start(self, stream, checkpoint, trigger="10 seconds", available_now=False, name=None):
        """Start the query. available_now works off what has landed and ends."""
        writer = (
            stream.writeStream.foreachBatch(self.process)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
        )
        if name:
            writer = writer.queryName(name)
        writer = (
            writer.trigger(availableNow=True)
            if available_now
            else writer.trigger(processingTime=trigger)
        )
        return writer.start()

    def process(self, batch, batch_id):
        """Clean, judge, deduplicate and store one micro-batch."""
        spark = batch.sparkSession
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT
        began = time.monotonic()
        judged = judge(clean(batch, self.strict), self.strict)
        row = self._reject(judged, batch_id, stream_id)
        if row["received"] == 0:
            log.info("batch %d: empty", batch_id)
            return
        checked = time.monotonic()
        try:
            row.update(self._store(judged, batch_id, stream_id, row["valid"], spark))
        except Exception:
            # This process may run the batch again, on what this run has left.
            self.ledger.forget()
            raise
        total = time.monotonic() - began
        row.update(
            validate_seconds=checked - began,
            total_seconds=total,
            rows_per_second=row["written"] / total,
            valid_rate=row["valid"] / row["received"],
            finished_at="current_timestamp()",
        )
        self.ledger.record(spark, batch_id, row, stream_id)
        log.info("batch %d: %s", batch_id, row)

    def _reject(self, judged, batch_id, stream_id):
        """Write the rejects; the same pass counts the batch."""
        counts = Observation()
        corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in judged.columns else F.lit(False)
        judged = judged.observe(
            counts,
            F.count("*").alias("received"),
            F.count_if(corrupt).alias("corrupt"),
            F.count_if("is_valid").alias("valid"),
            F.count_if(~F.col("is_valid")).alias("invalid"),
        )
        rejects = rejected(judged, self.strict)
        path = write_rejected(
            rejects, self.quarantine, batch_id, self.quarantine_format, stream_id)
        if counts.get["invalid"] == 0:
            remove_folders(judged.sparkSession, path)
        return dict(counts.get)

    def _store(self, judged, batch_id, stream_id, valid_rows, spark):
        last_id = self.ledger.last_id(spark, batch_id, stream_id)
        first = not self.ledger.knows(batch_id, stream_id)
        if first:
            # A batch of another stream may have been stored and never recorded.
            last_id = max(last_id, self.target.last_id(spark, batch_id, stream_id))
        if valid_rows == 0:
            return dict(kept=0, written=0, last_id=last_id, dedup_seconds=0.0, write_seconds=0.0)
        began = time.monotonic()
        survivors = _survivors(judged).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            kept = survivors.count()  # computes and keeps them
            deduped = time.monotonic()
            tries = itertools.count()
            written = with_retry(
                lambda: self.target.insert_absent(
                    survivors, batch_id, last_id=last_id, stream_id=stream_id,
                    first=first or next(tries) > 0, rows=kept,
                ),
                self.attempts,
                self.retry_delay,
            )
            return dict(
                kept=kept,
                written=written,
                last_id=last_id + written,
                dedup_seconds=deduped - began,
                write_seconds=time.monotonic() - deduped,
            )
        finally:
            survivors.unpersist()


def _survivors(judged):
    """The first delivery of each valid event, as table columns."""
    arrival = [c for c in (SOURCE_TIME, SOURCE_FILE) if c in judged.columns]
    first = keep_first(valid(judged), [*arrival, F.xxhash64(*EVENT_COLUMNS)])
    return to_event_columns(first)
