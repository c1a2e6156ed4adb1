"""Landing files as a batch or as a stream."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import CORRUPT, LANDING, LANDING_COLUMNS

PERMISSIVE = "PERMISSIVE"
SOURCE_FILE = "source_file"
SOURCE_TIME = "source_time"


def _options(mode, enforce_schema, header=True):
    options = {
        "header": str(header).lower(),
        "mode": mode,
        "escape": '"',  # a quote inside a quoted field is doubled
        "enforceSchema": str(enforce_schema).lower(),
        # With pruning, a line that is too long or too short goes unnoticed
        # whenever a query does not need all of its columns.
        "columnPruning": "false",
    }
    if mode == PERMISSIVE:
        options["columnNameOfCorruptRecord"] = CORRUPT
    return options


def _load(reader, path, fmt, mode, enforce_schema, header=True):
    if fmt == "csv":
        reader = reader.options(**_options(mode, enforce_schema, header))
    marks = fmt == "csv" and mode == PERMISSIVE
    fields = [T.StructField(CORRUPT, T.StringType())] if marks else []
    rows = reader.format(fmt).schema(T.StructType(LANDING.fields + fields)).load(path)
    columns = [F.col(c) for c in LANDING_COLUMNS]
    if marks:
        # A bad number is only noticed when the number is read, so the marker
        # depends on the price and no projection can prune one without the other.
        marker = F.when(F.col("price").isNull(), F.col(CORRUPT)).when(
            F.col(CORRUPT).isNotNull(), F.col(CORRUPT)
        )
        columns.append(marker.alias(CORRUPT))
    return rows.select(
        *columns,
        F.col("_metadata.file_path").alias(SOURCE_FILE),
        F.col("_metadata.file_modification_time").alias(SOURCE_TIME),
    )


def read_landing(spark, path, fmt="csv", mode=PERMISSIVE, enforce_schema=True, header=True):
    """All landing files under a path, CSV or Parquet. PERMISSIVE keeps CSV lines
    that do not parse in _corrupt_record; DROPMALFORMED drops them."""
    return _load(spark.read, path, fmt, mode, enforce_schema, header)


def stream_landing(
    spark,
    path,
    fmt="csv",
    mode=PERMISSIVE,
    enforce_schema=True,
    max_files=10,
    max_bytes=None,
    clean_source=None,
    archive=None,
):
    """Landing files as they arrive, each once.

    At most max_files, or max_bytes instead, per micro-batch. clean_source is
    None, "delete" or "archive" (with the archive folder) and takes effect after
    a later batch has committed.
    """
    reader = spark.readStream
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    return _load(reader, path, fmt, mode, enforce_schema)


def malformed(landing):
    """The lines that do not fit the schema, with the fields that did parse."""
    return landing.where(F.col(CORRUPT).isNotNull())
