"""The event table in a JDBC database."""

from dataclasses import dataclass

from millrace.model import DIRECT, EVENT_COLUMNS
from millrace.sources.jdbc import Database


def merge_statement(table, stage, columns=EVENT_COLUMNS, key="event_id"):
    """INSERT of the staged rows whose key the table does not have."""
    names = ", ".join(columns)
    staged = ", ".join(f"s.{c}" for c in columns)
    return (
        f"INSERT INTO {table} ({names}) SELECT {staged} FROM {stage} s "
        f"WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t.{key} = s.{key})"
    )


@dataclass(frozen=True)
class JdbcEvents:
    """Writes to a table that gives id and created_at itself.

    connections bounds the parallel writers, batch_rows the rows per round trip.
    """

    database: Database
    name: str = "user_events"
    connections: int = 8
    batch_rows: int = 5000

    def _writer(self, df, table):
        return (
            df.select(*EVENT_COLUMNS)
            .write.format("jdbc")
            .options(**self.database.options())
            .option("dbtable", table)
            .option("stringtype", "unspecified")
            .option("numPartitions", self.connections)
            .option("batchsize", self.batch_rows)
        )

    def append(self, df):
        """Plain append. Spark commits each task on its own, so after a failure
        some rows may be stored; insert_absent is the safe way."""
        self._writer(df, self.name).mode("append").save()

    def last_id(self, spark, batch_id, stream_id=DIRECT):
        """The table gives ids itself."""
        return 0

    def insert_absent(
        self, events, batch_id, last_id=0, created_at=None, stream_id=DIRECT, first=True, rows=None
    ):
        """Stage the batch, then move the new events in one transaction; safe to
        repeat. Returns the number of rows the table took.

        The same transaction notes that number in the table <name>_batches, so that a
        repeat after a lost answer returns what the first run stored.
        """
        stage = f"{self.name}_stage_{stream_id.replace('-', '')}_{batch_id}"
        self._writer(events, stage).mode("overwrite").save()
        return self._move(events.sparkSession, stage, stream_id, batch_id)

    def _move(self, spark, stage, stream_id, batch_id):
        """Move staged rows on one driver-side connection; the rows of the batch."""
        noted = f"{self.name}_batches"
        mine = f"stream_id = '{stream_id}' AND batch_id = {batch_id}"
        jvm = spark._jvm
        properties = jvm.java.util.Properties()
        for key in ("user", "password"):
            value = getattr(self.database, key)
            if value is not None:
                properties.setProperty(key, value)
        # The staging write has made the driver class known to the DriverManager.
        connection = jvm.java.sql.DriverManager.getConnection(self.database.url, properties)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            if self.database.query_timeout:
                statement.setQueryTimeout(self.database.query_timeout)
            statement.executeUpdate(
                f"CREATE TABLE IF NOT EXISTS {noted} (stream_id VARCHAR(64), batch_id BIGINT, "
                "written BIGINT, PRIMARY KEY (stream_id, batch_id))")
            found = statement.executeQuery(f"SELECT written FROM {noted} WHERE {mine}")
            written = found.getLong(1) if found.next() else None
            if written is None:
                written = statement.executeUpdate(merge_statement(self.name, stage))
                statement.executeUpdate(
                    f"INSERT INTO {noted} VALUES ('{stream_id}', {batch_id}, {written})")
            statement.executeUpdate(f"DROP TABLE {stage}")
            connection.commit()
            return written
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()
