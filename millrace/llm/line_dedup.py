"""Line dedup: lines repeated over documents go, except in the last document that has them.

A text is split at line feeds.  A line's key is the line without white space at its ends and
with A-Z lowered.  Keys of ``min_chars`` code points or more that ``min_docs`` documents or more
hold lose all their lines, save in the largest doc_id among them.

Null or empty texts are one empty line.  Rows with one doc_id count as one document for the
counting, each is judged for itself.  Rows without doc_id keep their text and are not counted.
Columns other than doc_id and text pass through untouched.

Keys are held as 128-bit digests.  A key that a third of all lines have is combined to one row
per task before the shuffle; the join that finds its lines is an equi-join whose heavy partitions
adaptive execution may split.
"""

from pyspark.sql import functions as F

from millrace.llm.text import WHITE, ascii_lower, whole, written

MIN_CHARS = 40
MIN_DOCS = 5


def _key(line):
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _digest(text):
    return F.unhex(F.md5(text))


def line_keys(docs, min_chars=MIN_CHARS):
    """doc_id, text_key, position and the digest of each line long enough to count."""
    lines = F.split(whole(F.col("text")), "\n")
    keyed = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("position"), _key(line).alias("key"))),
        lambda x: F.length(x["key"]) >= min_chars,
    )
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(keyed).alias("line"))
        .select("doc_id", "text_key", "line.position", _digest(F.col("line.key")).alias("key"))
    )


def repeated_keys(keys, min_docs=MIN_DOCS):
    """key and the document that keeps it, for keys of min_docs documents or more."""
    return (
        keys.groupBy("key")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper")
    )


def _marked(docs, min_chars, min_docs):
    """docs with __lines and the positions to drop, __drop (null: none)."""
    keys = written(line_keys(docs, min_chars), "line-keys")
    # As a table, so that the join may split a key that many documents have.
    repeated = written(repeated_keys(keys, min_docs), "repeated-lines")
    drops = (
        keys.join(repeated, "key")
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"))
        .agg(F.collect_set("position").alias("__drop"))
    )
    return docs.join(
        drops,
        (F.col("doc_id") == F.col("__doc_id")) & (F.xxhash64("text") == F.col("__text_key")),
        "left",
    ).withColumn("__lines", F.split(whole(F.col("text")), "\n"))


def _left():
    """The text without the marked lines."""
    lines, drop = F.col("__lines"), F.col("__drop")
    # Positions are taken away by hash, not by search, and lines fetched by index.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.when(drop.isNull(), whole(F.col("text"))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )


def _columns(names):
    return [_left().alias(c) if c == "text" else F.col(f"`{c}`") for c in names]


def dedup_lines(docs, min_chars=MIN_CHARS, min_docs=MIN_DOCS):
    """docs with the shortened text, n_lines (before) and n_dropped.

    Columns of docs named n_lines or n_dropped are replaced.
    """
    passed = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _marked(docs, min_chars, min_docs).select(
        *_columns(passed),
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def shorten(docs, min_chars=MIN_CHARS, min_docs=MIN_DOCS):
    """docs with the shortened text and all else as it was."""
    return _marked(docs, min_chars, min_docs).select(*_columns(docs.columns))


def digests(deduped):
    """The contract's columns."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
