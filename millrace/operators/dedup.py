"""One row per event, within a frame and against rows already stored."""

from pyspark.sql import Window
from pyspark.sql import functions as F

def keep_first(df, tie_break=(), key="event_id", order="event_timestamp"):
    """The earliest row per key. tie_break (columns) decides between equal times;
    without it the row's hash does, which reads every column. Either way the
    survivor does not depend on the partitioning.

    row_number() = 1 lets the planner cut each map task to one row per key before
    the shuffle, so one id that holds much of the data does not fill one task.
    """
    if not tie_break:
        tie_break = [F.xxhash64(*[c for c in df.columns if c != key])]
    by = Window.partitionBy(key).orderBy(order, *tie_break)
    return df.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")


def absent_from(df, stored, key="event_id"):
    """The rows of df whose key is not stored yet. df must have unique keys.

    The stored keys are cut to those with a hash in df first, then compared by key. The
    hashes of df are 8 bytes each whatever the length of a key; if the planner knows that they
    are below its broadcast threshold, as for a cached micro-batch, the one column of the stored
    table is read but neither shuffled nor sorted.
    """
    hashes = df.select(F.xxhash64(key).alias("_hash"))
    keys = stored.select(key, F.xxhash64(key).alias("_hash"))
    matches = keys.join(hashes, "_hash", "left_semi").select(key)
    return df.join(matches, key, "left_anti")
