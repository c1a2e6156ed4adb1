"""What a running stream reports about itself, against the pipeline's targets."""

import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from millrace.plans.health import MAX_LATENCY_SECONDS

PROGRESS = ("stream_id string, batch_id bigint, input_rows bigint, seconds double, "
            "rows_per_second double, watermark string, late_rows bigint, slow boolean")


@dataclass
class Monitor(StreamingQueryListener):
    """A listener that keeps the progress of the last batches and flags the slow ones while the
    query runs: a batch that takes longer than max_seconds makes its rows wait that long.

    spark.streams.addListener(monitor) starts it. input_rows are Spark's own count, which has a row
    once for each pass over the batch; the ledger has the landed rows.
    """

    max_seconds: float = MAX_LATENCY_SECONDS
    keep: int = 1000
    batches: list = field(default_factory=list)
    failures: list = field(default_factory=list)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = json.loads(event.progress.json)
        seconds = progress["durationMs"].get("triggerExecution", 0) / 1000
        operators = progress.get("stateOperators", [])
        self.batches.append((
            progress["id"], progress["batchId"], progress["numInputRows"], seconds,
            progress.get("processedRowsPerSecond", 0.0),
            progress.get("eventTime", {}).get("watermark"),
            sum(o.get("numRowsDroppedByWatermark", 0) for o in operators),
            seconds > self.max_seconds,
        ))
        del self.batches[:-self.keep]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.failures.append((str(event.id), event.exception))

    @property
    def slow(self):
        """Whether a kept batch missed the target."""
        return any(b[-1] for b in self.batches)

    def progress(self, spark):
        """The kept batches as a frame, at most ``keep`` rows."""
        return spark.createDataFrame([(*b[:4], float(b[4]), *b[5:]) for b in self.batches], PROGRESS)


def processed_files(spark, checkpoint):
    """path and batch_id of the landing files that a stream's checkpoint has down as taken."""
    lines = spark.read.option("pathGlobFilter", "[0-9]*").text(f"{checkpoint}/sources/*")
    entry = "path string, timestamp bigint, batchId bigint"
    return (
        lines.where(F.col("value").startswith("{"))
        .select(F.from_json("value", entry).alias("e"))
        .select(F.col("e.path").alias("path"), F.col("e.batchId").alias("batch_id"))
        .distinct()
    )
