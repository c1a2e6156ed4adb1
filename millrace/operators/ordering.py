"""Row numbers and running values over a total order, without a one-task window.

The rows are range-partitioned and sorted, each partition works on its own, and
only one summary row per partition is combined and joined back. The frame is
pinned in between, so that both passes see the same partitions.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.session import new_folder

_BITS = 33  # monotonically_increasing_id keeps the row within its partition here


def write_and_read(df):
    """Pin a frame as a table in the shared folder."""
    path = new_folder(df.sparkSession, "ordered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df, order_by, pin, tasks=None):
    """df in order, each row with its partition and its place in there; in so many tasks, by
    default as many as there are shuffle partitions."""
    ranges = [tasks] if tasks else []
    rows = (
        df.repartitionByRange(*ranges, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return pin(rows).withColumns(
        {
            "_part": F.shiftright("_at", _BITS),
            "_place": F.col("_at").bitwiseAND((1 << _BITS) - 1),
        }
    )


def numbered(rows, parts, name="id", start=0):
    """Number ordered() rows after start; parts has each partition and its number of rows, in
    order."""
    before, offsets = start, []
    for part, n in parts:
        offsets.append((part, before))
        before += n
    # One row per partition of the shuffle.
    values = ", ".join(f"({part}L, {n}L)" for part, n in offsets)
    offsets = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(_part, _before)")
    number = F.col("_before") + F.col("_place") + 1
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, number)


def number_rows(df, order_by, name="id", start=0, pin=write_and_read):
    """Add start + 1, start + 2, … in the order given, which must be total.

    pin keeps the ordered frame for the second pass; the default writes it.
    """
    rows = ordered(df, order_by, pin)
    # One row per partition of the shuffle: a window over them and a broadcast are bounded.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    number = F.lit(start) + F.col("_before") + F.col("_place") + 1
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, number.cast("bigint"))
        .select(name, *df.columns)
    )


_RUNNING = {"sum": F.sum, "min": F.min, "max": F.max}
# Two running values put together; either may be null for want of rows.
_EARLIER = {
    "sum": lambda before, here: F.coalesce(before + here, before, here),
    "min": F.least,
    "max": F.greatest,
}


# Rows of a partition that are summed up by one task.
_STRETCH = 1 << 16


def running(df, order_by, values, pin=write_and_read):
    """Add running values in the order given, which must be total.

    values maps a new column to (sum | min | max, input column). A partition falls into
    stretches, so that the rows spread evenly over the tasks that finish them.
    """
    rows = ordered(df, order_by, pin).withColumn(
        "_stretch", F.floor(F.col("_place") / _STRETCH))
    parts, stretch = ["_part"], ["_part", "_stretch"]

    def totals(frame, by, source):
        return frame.groupBy(*by).agg(
            *[_RUNNING[how](source(name, column)).alias(f"_all_{name}")
              for name, (how, column) in values.items()])

    def earlier(window, name, how):
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return _RUNNING[how](f"_all_{name}").over(before)

    stretches = totals(rows, stretch, lambda name, column: column)
    by_part = totals(stretches, parts, lambda name, column: f"_all_{name}")
    # One row per partition of the shuffle: a window over them and a broadcast are bounded.
    whole = by_part.select(
        "_part", *[earlier(Window.orderBy("_part"), name, how).alias(f"_part_{name}")
                   for name, (how, _) in values.items()])
    in_part = Window.partitionBy("_part").orderBy("_stretch")
    before = stretches.join(F.broadcast(whole), "_part").select(
        *stretch,
        *[_EARLIER[how](F.col(f"_part_{name}"), earlier(in_part, name, how)).alias(f"_before_{name}")
          for name, (how, _) in values.items()],
    )
    within = (
        Window.partitionBy(*stretch).orderBy("_place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = {
        name: _EARLIER[how](F.col(f"_before_{name}"), _RUNNING[how](column).over(within))
        for name, (how, column) in values.items()
    }
    return rows.join(before, stretch).withColumns(here).select(*df.columns, *values)
