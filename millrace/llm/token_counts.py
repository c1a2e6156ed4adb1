"""Token counts through a cache of digests: only texts not counted before are encoded.

The cache is a Parquet table of (tokenizer, digest, n_tokens).  ``tokenizer`` is the digest of
the tokenizer's file, library version and settings; ``digest`` that of a text's normal form.
The normal form may only join texts that have the same count: null is read as empty, all else
stays, since any other change can alter the tokens.  A count looks digests up, encodes one text
of each missing digest, appends those counts, and joins every document to the cache.

Digests, not texts, are grouped and joined; a text is shuffled once, by (digest, holder), so
copies of one text never meet in one task.  Empty texts have 0 tokens; repeated rows and ids
each give their row; columns other than doc_id and text are ignored; an empty table gives none.
"""

import hashlib
import uuid

import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm.text import utf8_bytes, whole, written
from millrace.session import existing

# Texts are handed to the library in groups of so many characters, to bound the ids in memory.
GROUP_CHARS = 1 << 20

_processors = {}


def processor(path):
    """The sentencepiece model of a file, loaded once in each worker."""
    if path not in _processors:
        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def tokenizer_version(path):
    """Digest of all that decides a count: file, library version, settings."""
    with open(path, "rb") as file:
        content = hashlib.file_digest(file, "sha256").digest()
    return hashlib.sha256(
        content + f"sentencepiece {sentencepiece.__version__} plain".encode()
    ).hexdigest()


def text_digest(text):
    return F.unhex(F.sha2(whole(text), 256))


class DigestCache:
    """Stored counts. Each count run appends one folder of its own, so a repeat after a
    failure adds rows only to a new folder; equal rows of several runs count once."""

    def __init__(self, path):
        self.path = path.rstrip("/")

    def read(self, spark, tokenizer):
        """digest and n_tokens of one tokenizer, one row per digest."""
        stored = f"{self.path}/tokenizer={tokenizer}"
        if not existing(spark, [stored]):
            return spark.createDataFrame([], "digest binary, n_tokens bigint")
        rows = spark.read.schema("digest binary, n_tokens bigint").option(
            "recursiveFileLookup", "true").parquet(stored)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts, tokenizer):
        counts.write.parquet(f"{self.path}/tokenizer={tokenizer}/{uuid.uuid4().hex}")


def _groups(texts):
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _encoder(path):
    def encode(batches):
        model = processor(path)
        for batch in batches:
            counts = []
            for group in _groups(x or "" for x in batch.column("text").to_pylist()):
                counts += map(len, model.encode(group, num_threads=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def missing_texts(docs, cached):
    """digest and text, for one holder of each digest the cache lacks."""
    keyed = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), "text")
    wanted = (
        keyed.groupBy("digest").agg(F.min("doc_id").alias("holder"))
        .join(cached.select("digest"), "digest", "left_anti")
        .withColumnRenamed("digest", "wanted")
    )
    return keyed.join(
        wanted,
        (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("holder")),
    ).select("digest", "text")


def count_tokens(docs, model_path, cache, limit=4096):
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    tokenizer = tokenizer_version(model_path)
    texts = missing_texts(docs, cache.read(spark, tokenizer))
    cache.append(
        texts.mapInArrow(_encoder(model_path), "digest binary, n_tokens bigint"), tokenizer)
    counted = docs.select(
        "doc_id", utf8_bytes(whole(F.col("text"))).alias("n_bytes"),
        text_digest(F.col("text")).alias("digest"),
    ).join(written(cache.read(spark, tokenizer), "counts"), "digest", "left")
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
