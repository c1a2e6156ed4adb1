"""Quality classifier: hashed subword vectors averaged per document, softmax output.

A document's features are its words, the character n-grams of its words (with a mark at either
end) and its pairs of neighbouring words, hashed into ``2 ** BUCKET_BITS`` buckets; in a pair, a
word equal to its neighbour is shown by a sign of its own.  Each bucket has a learned vector.
The vectors are averaged over all features of the whole text and a softmax layer gives the
class.  Training is stochastic gradient descent in numpy over at most ``MAX_TRAIN`` labelled
documents, chosen by a seeded hash of doc_id, whose features are written as a table.  An epoch is
a task that reads the model and then the examples, in a seeded order of its own and a batch at a
time, and writes the model, so neither driver nor task holds the examples, however long their
texts, and the vectors never come to the driver.  Scoring covers every document.

As the output is linear in the averaged vector, scoring folds vectors and layer into one number
per bucket, which is all that is sent to the executors.

Null and empty texts have no feature and get the score of the bias; long texts are read whole, in
pieces.  Repeated rows get equal scores.  A null doc_id is not held out.  Labels without doc_id or quality are left out, of several for one doc_id the largest
counts.  Without labels of both classes every score is the share of class 1, or 0.5 without any.
Columns other than doc_id and text are never read for a score.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm.hashing import Spans, mix
from millrace.llm.text import written
from millrace.session import scratch

BUCKET_BITS = 17
GRAMS = (3, 4, 5)
DIMENSIONS = 16
MAX_TRAIN = 4000
EPOCHS = 12
RATE = 0.5
SEED = 8
THRESHOLD = 0.7

# Bytes of normalised text hashed at once.
CHUNK_BYTES = 1 << 20

_SPACE = ord(" ")


def _bucket(hashes, kind):
    """Buckets of 64-bit hashes; ``kind`` separates words, pairs and n-gram lengths."""
    return (mix(hashes + np.uint64(kind)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _stream_features(stream):
    """Buckets and byte positions of the features of " word word ... " bytes."""
    data = np.frombuffer(stream, np.uint8)
    space = data == _SPACE
    spans = Spans(data)
    buckets, places = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        starts = len(data) - n + 1
        inner = np.zeros(starts, bool)
        for k in range(1, n - 1):
            inner |= space[k:k + starts]
        at = np.flatnonzero(~inner)
        buckets.append(_bucket(spans.hash(at, at + n), n))
        places.append(at)
    # Words: from a space that no space follows to the next space.
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = spans.hash(start, stop)
    buckets.append(_bucket(words, 1))
    places.append(start)
    # Neighbours within one document: exactly one space between them.
    next_to = np.flatnonzero(start[1:] == stop[:-1] + 1)
    first, second = words[next_to], words[next_to + 1]
    second = np.where(first == second, np.uint64(0), second)
    first = np.where(second == 0, np.uint64(0), first)
    buckets.append(_bucket(first * np.uint64(3) + second, 2))
    places.append(start[next_to])
    return np.concatenate(buckets), np.concatenate(places)


def _pieces(texts):
    """(streams, owners): runs of whole words of at most about CHUNK_BYTES, by document."""
    stream, owner, size = [], [], 0
    for number, text in enumerate(texts):
        words = (text or b"").lower().split()
        at = 0
        while at < len(words):
            taken = words[at:at + CHUNK_BYTES // 8]
            at += len(taken)
            piece = b" " + b" ".join(taken) + b" "
            stream.append(piece)
            owner.append((number, len(piece)))
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield b"".join(stream), owner
                stream, owner, size = [], [], 0
    if stream:
        yield b"".join(stream), owner


def _owned(texts):
    """(buckets, document numbers) of all features of the texts, piece by piece."""
    for stream, owner in _pieces(texts):
        buckets, places = _stream_features(stream)
        ends = np.cumsum([n for _, n in owner])
        numbers = np.array([d for d, _ in owner])
        yield buckets, numbers[np.searchsorted(ends, places, side="right")]


@dataclass
class Model:
    """Log-odds of class 1: ``bias`` plus the mean of ``weights`` over a text's features."""

    weights: np.ndarray
    bias: float

    def scores(self, texts):
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, number in _owned(texts):
            total += np.bincount(number, self.weights[buckets], len(texts))
            count += np.bincount(number, minlength=len(texts))
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))


@dataclass
class Trainee:
    """Vectors of the buckets and the softmax layer, between two epochs."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    done: int = 0

    @classmethod
    def start(cls, zeros, ones, seed=SEED):
        """For so many documents of either class, at least one of each."""
        random = np.random.default_rng(seed)
        vectors = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
        return cls(vectors / DIMENSIONS, np.zeros((2, DIMENSIONS), np.float32),
                   np.log(np.array([zeros, ones]) / (zeros + ones)).astype(np.float32))

    def step(self, buckets, shares, label, steps, rate=RATE):
        """One document, of ``steps`` in all epochs."""
        pace = rate * (1 - self.done / steps)
        self.done += 1
        mean = shares @ self.vectors[buckets]
        logits = self.layer @ mean + self.bias
        error = np.exp(logits - logits.max())
        error /= error.sum()
        error[label] -= 1
        back = error @ self.layer
        self.layer -= pace * np.outer(error, mean)
        self.bias -= pace * 0.1 * error
        # Shares add up to 1; a document's step is spread over its features' vectors.
        self.vectors[buckets] -= (pace * len(buckets) ** 0.5) * shares[:, None] * back

    def odds(self):
        """The weight of each bucket and the bias of Model, as bytes."""
        difference = self.layer[1] - self.layer[0]
        return np.append(self.vectors @ difference, self.bias[1] - self.bias[0]).astype(
            np.float32).tobytes()

    def to_bytes(self):
        return b"".join(a.tobytes() for a in (self.vectors, self.layer, self.bias))

    @classmethod
    def from_bytes(cls, content, done):
        values, parts, at = np.frombuffer(content, np.float32).copy(), [], 0
        for shape in ((1 << BUCKET_BITS, DIMENSIONS), (2, DIMENSIONS), (2,)):
            size = int(np.prod(shape))
            parts.append(values[at:at + size].reshape(shape))
            at += size
        return cls(*parts, done)


def _epoch(zeros, ones, seed, epochs, epoch):
    """The task of an epoch: the model comes first, then all examples in order."""
    n = zeros + ones

    def run(batches):
        trainee = None
        for batch in batches:
            first = 0
            if trainee is None:
                content = batch.column("content")[0].as_py()
                trainee = (Trainee.from_bytes(content, epoch * n) if content
                           else Trainee.start(zeros, ones, seed))
                first = 1
            columns = (batch.column(c).slice(first) for c in ("label", "buckets", "shares"))
            for label, buckets, shares in zip(*columns):
                trainee.step(np.asarray(buckets.values), np.asarray(shares.values),
                             label.as_py(), epochs * n)
        if trainee is not None:
            last = trainee.odds() if epoch + 1 == epochs else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([trainee.to_bytes()], pa.binary()), pa.array([last], pa.binary())],
                ["content", "odds"])

    return run


def train(examples, epochs=EPOCHS, seed=SEED):
    """The model from a table of doc_id, label, buckets and shares."""
    counts = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    zeros, ones = counts.get(0, 0), counts.get(1, 0)
    if not zeros or not ones:
        share = np.clip(ones / (zeros + ones), 1e-6, 1 - 1e-6) if zeros + ones else 0.5
        flat = np.zeros(1 << BUCKET_BITS, np.float32)
        return Model(flat, float(np.log(share / (1 - share))))
    spark = examples.sparkSession
    kinds = dict(place="bigint", tie="string", label="int", buckets="array<int>",
                 shares="array<float>")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    trainee, spent = spark.sql("SELECT CAST(NULL AS binary) AS content"), None
    for epoch in range(epochs):
        # At most max_train rows: one task takes them one after the other, the model first.
        rows = examples.select(
            F.xxhash64("doc_id", F.lit(seed + epoch)).alias("place"),
            F.col("doc_id").cast("string").alias("tie"), "label", "buckets", "shares",
            F.lit(None).cast("binary").alias("content"))
        rows = trainee.select(*none, "content").unionAll(rows)
        with scratch(spark) as tables:
            trainee = written(
                rows.coalesce(1).sortWithinPartitions(F.asc_nulls_first("place"), "tie")
                .mapInArrow(_epoch(zeros, ones, seed, epochs, epoch), "content binary, odds binary"),
                "trainee")
        if spent is not None:
            spent.remove()
        spent = tables
    odds = np.frombuffer(bytes(trainee.select("odds").first()["odds"]), np.float32)
    return Model(odds[:-1].copy(), float(odds[-1]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _shares(batches):
    """Each text's buckets and their shares among its features, for training."""
    for batch in batches:
        buckets, shares = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            count = np.zeros(1 << BUCKET_BITS, np.int64)
            for found, _ in _owned([text]):
                count += np.bincount(found, minlength=len(count))
            used = np.flatnonzero(count)
            buckets.append(used.astype(np.int32))
            shares.append((count[used] / max(count.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"),
             pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["doc_id", "label", "buckets", "shares"])


def fit(docs, labels, max_train=MAX_TRAIN, seed=SEED):
    """The model, from at most ``max_train`` labelled documents that are not held out."""
    kind = dict(labels.dtypes)["doc_id"]
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "doc_id")
        .limit(max_train)
    )
    # At most max_train rows of two numbers: a proven bound for the broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy(
        "doc_id", "label").agg(F.min("text").alias("text"))
    with scratch(docs.sparkSession) as tables:
        examples = written(chosen.select("doc_id", "label", "text").mapInArrow(
            _shares, f"doc_id {kind}, label int, buckets array<int>, shares array<float>"), "examples")
        model = train(examples.where("size(buckets) > 0"), seed=seed)
    tables.remove()
    return model


def score(docs, model):
    """docs with score and predicted; columns of those names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            scores = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(scores, pa.float64())],
                [*names, "score"])

    schema = docs.select(*[f"`{c}`" for c in names]).schema.add("score", "double")
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs, labels, threshold=THRESHOLD):
    """The rows of docs whose score reaches the threshold, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(batch.column("text").cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digests(docs, labels):
    """The contract's columns."""
    model = fit(docs, labels)
    # The text stays in the tasks: only ids and scores come back.
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
