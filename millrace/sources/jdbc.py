"""A JDBC database as source and as target of the event table."""

import os
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError


@dataclass(frozen=True)
class Database:
    """Where a database is. The password comes from the caller or the environment."""

    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str = "org.postgresql.Driver"
    query_timeout: int = 0  # seconds, 0 waits for ever

    @classmethod
    def from_environment(cls):
        """PostgreSQL as named by POSTGRES_HOST, _DB and _USER, which must be set, _PORT
        and _PASSWORD."""
        env = os.environ
        missing = [n for n in ("HOST", "DB", "USER") if not env.get(f"POSTGRES_{n}")]
        if missing:
            raise ValueError("not set: " + ", ".join(f"POSTGRES_{n}" for n in missing))
        port = env.get("POSTGRES_PORT", "5432")
        return cls(
            url=f"jdbc:postgresql://{env['POSTGRES_HOST']}:{port}/{env['POSTGRES_DB']}",
            user=env["POSTGRES_USER"],
            password=env.get("POSTGRES_PASSWORD"),
        )

    def options(self):
        """Options shared by the JDBC reader and writer."""
        options = {"url": self.url, "driver": self.driver}
        if self.user is not None:
            options["user"] = self.user
        if self.password is not None:
            options["password"] = self.password
        if self.query_timeout:
            options["queryTimeout"] = str(self.query_timeout)
        return options

    def query(self, spark, sql):
        """The result of one SQL query, read over a single connection."""
        return spark.read.format("jdbc").options(**self.options()).option("query", sql).load()

    def table(self, spark, name, split_by=None, lower=None, upper=None, parts=None):
        """A whole table; with split_by its id range is read by that many tasks."""
        reader = spark.read.format("jdbc").options(**self.options()).option("dbtable", name)
        if split_by:
            reader = reader.options(
                partitionColumn=split_by,
                lowerBound=str(lower),
                upperBound=str(upper),
                numPartitions=str(parts),
            )
        return reader.load()

    def reachable(self, spark):
        """Whether a trivial query runs."""
        try:
            self.query(spark, "SELECT CURRENT_TIMESTAMP AS answered_at").collect()
            return True
        except (PySparkException, Py4JJavaError):
            return False
