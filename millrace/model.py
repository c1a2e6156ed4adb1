"""The fixed schemas and limits of the event data."""

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# Fixed values of the event format: columns, order, types, lengths, event types.
LANDING = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
EVENT_TYPES = ("view", "add_to_cart", "purchase")
TEXT_LIMITS = {
    "event_id": 50,
    "user_id": 50,
    "product_id": 50,
    "product_name": 255,
    "category": 100,
    "event_type": 20,
}
MONEY = T.DecimalType(10, 2)

LANDING_COLUMNS = LANDING.fieldNames()
TEXT_COLUMNS = list(TEXT_LIMITS)


def _field(name, dtype, nullable=True, comment=None):
    return T.StructField(name, dtype, nullable, {"comment": comment} if comment else None)


# What the pipeline hands to a table: everything except id and created_at.
EVENT = T.StructType(
    [
        _field("event_id", T.StringType(), False, "Unique id of the event, the dedup key"),
        _field("user_id", T.StringType(), False, "Who acted"),
        _field("product_id", T.StringType(), False, "Product acted on"),
        _field("product_name", T.StringType(), False),
        _field("category", T.StringType(), False),
        _field("price", MONEY, False),
        _field("event_type", T.StringType(), False, "One of: " + ", ".join(EVENT_TYPES)),
        _field("event_timestamp", T.TimestampNTZType(), False, "When the event happened"),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()

# The stored table. event_date, stream_id and batch_id are its partition directories.
STORED = T.StructType(
    [_field("id", T.LongType(), False, "Running number given at write")]
    + EVENT.fields
    + [
        _field("created_at", T.TimestampNTZType(), True, "When the row was stored"),
        _field("event_hour", T.TimestampNTZType(), True, "Hour of event_timestamp, for statistics"),
        _field("event_date", T.DateType(), False, "Date of event_timestamp, for pruning"),
        _field("stream_id", T.StringType(), False, "Stream that stored the row"),
        _field("batch_id", T.LongType(), False, "Micro-batch that stored the row"),
    ]
)
# What writes without a stream goes under this name.
DIRECT = "direct"
TABLE_COMMENT = "Cleaned user events, one row per event_id"


def nullable(schema):
    """The same schema with every field nullable, as file readers want it."""
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


def table_ddl(name, location=None):
    """CREATE TABLE text for the stored table, partitioned for pruning."""
    columns = []
    for f in STORED:
        text = f"{f.name} {f.dataType.simpleString()}"
        if not f.nullable:
            text += " NOT NULL"
        if "comment" in f.metadata:
            text += f" COMMENT '{f.metadata['comment']}'"
        columns.append(text)
    place = f" LOCATION '{location}'" if location else ""
    return (
        f"CREATE TABLE IF NOT EXISTS {name} (\n  " + ",\n  ".join(columns) + "\n) "
        f"USING parquet PARTITIONED BY (event_date, stream_id, batch_id)"
        f" COMMENT '{TABLE_COMMENT}'{place}"
    )
