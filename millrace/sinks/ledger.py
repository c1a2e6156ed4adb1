"""One row of counts and times per micro-batch."""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from millrace.model import DIRECT
from millrace.session import ensure_folder

ROW = {
    **dict.fromkeys(
        ("received", "corrupt", "valid", "invalid", "kept", "written", "last_id"), "bigint"
    ),
    **dict.fromkeys(
        (
            "validate_seconds",
            "dedup_seconds",
            "write_seconds",
            "total_seconds",
            "rows_per_second",
            "valid_rate",
        ),
        "double",
    ),
    "finished_at": "timestamp",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in {**ROW, "stream_id": "string", "batch_id": "bigint"}.items())


@dataclass(frozen=True)
class Ledger:
    path: str
    _last_ids: dict = field(default_factory=dict, repr=False, compare=False)

    def read(self, spark):
        ensure_folder(spark, self.path)
        return spark.read.schema(SCHEMA).parquet(self.path)

    def record(self, spark, batch_id, row, stream_id=DIRECT):
        """Replace the row of a stream's batch. The row is made of counts, not of data."""
        values = ", ".join(
            f"CAST({row.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in ROW.items()
        )
        spark.sql(f"SELECT {values}").write.mode("overwrite").parquet(
            f"{self.path}/stream_id={stream_id}/batch_id={batch_id}"
        )
        self._last_ids.clear()
        self._last_ids[stream_id, batch_id] = row["last_id"]

    def last_id(self, spark, batch_id, stream_id=DIRECT):
        """The highest id given by other batches, 0 if there is none. The ledger is read
        only if this process has not recorded the stream's batch before."""
        if self.knows(batch_id, stream_id):
            return self._last_ids[stream_id, batch_id - 1]
        others = self.read(spark).where(
            ~((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)))
        return others.agg(F.max("last_id")).first()[0] or 0

    def forget(self):
        """After a failure nothing is taken as known."""
        self._last_ids.clear()

    def knows(self, batch_id, stream_id=DIRECT):
        """Whether this process recorded the batch before this one."""
        return (stream_id, batch_id - 1) in self._last_ids
