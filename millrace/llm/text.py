"""Text helpers shared by the operators: null rules, white space, words, working tables."""

from pyspark.sql import functions as F

from millrace.session import new_folder

# The six white-space characters [\x20\x09-\x0D].
WHITE = " \t\n\u000b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text):
    """The text, null read as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text):
    """A-Z lowered, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text):
    """The maximal runs of characters outside WHITE; an empty array if there are none."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, WHITE_RUN)
    )


def utf8_bytes(text):
    return F.octet_length(text).cast("bigint")


def written(frame, label):
    """The frame as a table in the shared folder: computed once, read again after a loss."""
    spark = frame.sparkSession
    path = new_folder(spark, label)
    schema = frame.schema
    frame.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
