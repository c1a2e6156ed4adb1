"""Rejected rows, one directory per micro-batch."""

from millrace.model import CORRUPT, DIRECT


CSV = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_rejected(df, path, batch_id, fmt="csv", stream_id=DIRECT):
    """Replace the rejected rows of a stream's batch, so that a replay does not repeat them.
    Text is kept as it came, with blanks at its ends; null and empty stay apart.
    A failure is raised: the batch must not commit without its rejects.

    A line that did not parse is in raw_line; readers of CSV would take a column
    with the reserved name for their own. Returns the directory.
    """
    target = f"{path}/stream_id={stream_id}/batch_id={batch_id}"
    (
        df.withColumnRenamed(CORRUPT, "raw_line")
        .write.mode("overwrite")
        .format(fmt)
        .options(**(CSV if fmt == "csv" else {}))
        .save(target)
    )
    return target


def read_rejected(spark, path, columns):
    """The rejected rows of all CSV batches as text, with stream_id and batch_id."""
    fields = ", ".join(f"{c} string" for c in (*columns, "stream_id"))
    return spark.read.options(**CSV, enforceSchema="true").schema(
        f"{fields}, batch_id bigint").csv(path)
