"""LM scoring: masked pseudo-likelihood from a bidirectional window network in numpy.

Tokens are words (A-Z lowered).  The network predicts a token from the ``SIDE`` tokens on either
side of it: their vectors are averaged, one softmax gives the token's class and a second one the
token within its class.  A document's score is the sum over all its tokens of the logarithm of
that probability.

1. All words of all documents are counted.  The number of ids grows with the root of the number of
   different words, so do classes and slots with its root; the most frequent words have ids of
   their own, the others share a sixth of the ids by hash, which start from the sums of their
   counts; of words of one count the first in order go first.
2. Every document becomes ids, once, in a table of its own.
3. The documents fall into shards by a hash, of about ``SHARD_TOKENS`` tokens whatever the number
   of documents, each in the order of that hash.  Starting from the counts (as biases) and seeded
   vectors, a network is trained on every token of each shard, and the shards' changes are averaged
   by their tokens.  So what is gathered grows with the corpus, the network that comes to the driver
   and back has the size of its ids, and scores do not depend on how the table is partitioned.
4. Every token of every document is scored.  All matrix products have one shape, so that equal
   texts score alike wherever they stand.

Null and empty texts have no tokens and a score of 0.  Texts are taken whole, however long.  Words
above ``LONGEST`` bytes have no id of their own.  Repeated rows are trained on and scored each; an
empty table gives no row.  Columns other than doc_id and text are ignored.
"""

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm.text import written

# Ids for each unit of the root of the number of different words, and the fewest ids.
IDS_PER_ROOT, LEAST_IDS = 2, 64
DIMENSIONS = 16
SIDE = 2
LONGEST = 64
RATE = 0.1
SEED = 4
# Tokens of a shard; of a training step; scored at once; rows of each product within a class.
SHARD_TOKENS = 1 << 22
TRAIN_BATCH = 1 << 14
SCORE_BATCH = 1 << 14
ROWS = 64
# Logits beyond this are cut, so that a softmax needs no maximum.
LARGEST = 60.0

# Different words counted before a task hands them on; tokens laid out at once.
COUNT_WORDS = 1 << 18
CHUNK_TOKENS = 1 << 20


def _words(text):
    return (text or b"").lower().split()


@dataclass(frozen=True)
class Ids:
    """How many ids there are: classes * slots, the last ``unknown`` of them shared."""

    classes: int
    slots: int
    unknown: int

    @classmethod
    def of(cls, different):
        """For a number of different words."""
        ids = max(LEAST_IDS, IDS_PER_ROOT * isqrt(different))
        classes = isqrt(ids)
        slots = -(-ids // classes)
        return cls(classes, slots, classes * slots // 6)

    @property
    def all(self):
        return self.classes * self.slots

    @property
    def own(self):
        return self.all - self.unknown


def word_counts(docs):
    """word (bytes; null if above LONGEST), its hash and count over all documents."""

    def run(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen.update(_words(text))
                if len(seen) > COUNT_WORDS:
                    yield _rows(seen)
                    seen = Counter()
        yield _rows(seen)

    def _rows(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array([w if len(w) <= LONGEST else None for w in seen], pa.binary()),
             pa.array([zlib.crc32(w) for w in seen], pa.int64()),
             pa.array(seen.values(), pa.int64())], ["word", "crc", "n"])

    counts = docs.select("text").mapInArrow(run, "word binary, crc bigint, n bigint")
    return counts.groupBy("word", "crc").agg(F.sum("n").alias("n"))


def vocabulary(docs):
    """(Ids, the most frequent words in order, their counts, the counts of the shared ids).

    The least count is found from the numbers of words of each count, so no task meets all words;
    of the words of that count the first in order have ids.
    """
    counts = written(word_counts(docs), "word-counts")
    ids = Ids.of(counts.count())
    named = counts.where("word IS NOT NULL")
    alike = named.groupBy("n").agg(F.count("*").alias("words"))
    frequent = alike.orderBy(F.col("n").desc()).limit(ids.own).collect()  # at most a row per id
    others = np.zeros(ids.unknown, np.int64)
    shared = F.pmod("crc", F.lit(ids.unknown)).alias("shared")
    for r in counts.groupBy(shared).agg(F.sum("n").alias("n")).collect():
        others[r["shared"]] = r["n"]
    if not frequent:
        return ids, [], np.zeros(0, np.int64), others
    upto = accumulate(r["words"] for r in frequent)
    least = next(
        (r["n"] for r, total in zip(frequent, upto) if total >= ids.own), frequent[-1]["n"])
    top = named.where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(ids.own).toArrow()
    words, often = top["word"].to_pylist(), np.array(top["n"].to_pylist(), np.int64)
    np.subtract.at(others, [zlib.crc32(w) % ids.unknown for w in words], often)
    return ids, words, often, others


class _Lookup(dict):
    """Ids of words; those without one of their own share by hash."""

    def __init__(self, words, ids):
        super().__init__((w, i) for i, w in enumerate(words))
        self.first, self.unknown = ids.own, ids.unknown

    def __missing__(self, word):
        return self.first + zlib.crc32(word) % self.unknown


@dataclass
class Network:
    """Vectors of tokens as neighbours, and the two layers. Token t is slot t // classes of
    class t % classes; the last row of ``vectors`` stands for no neighbour."""

    ids: Ids
    words: list
    vectors: np.ndarray
    class_layer: np.ndarray
    class_bias: np.ndarray
    slot_layer: np.ndarray
    slot_bias: np.ndarray
    lookup: _Lookup = field(default=None, repr=False, compare=False)

    @classmethod
    def start(cls, ids, words, counts, others, seed=SEED):
        random = np.random.default_rng(seed)
        n = np.ones(ids.all)
        n[:len(counts)] += counts
        n[ids.own:] += others
        table = n.reshape(ids.slots, ids.classes).T
        vectors = random.normal(0, 0.1, (ids.all + 1, DIMENSIONS)).astype(np.float32)
        vectors[-1] = 0
        return cls(
            ids, words, vectors,
            np.zeros((ids.classes, DIMENSIONS), np.float32),
            np.log(table.sum(axis=1) / table.sum()).astype(np.float32),
            np.zeros((ids.classes, ids.slots, DIMENSIONS), np.float32),
            np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))

    def arrays(self):
        return [self.vectors, self.class_layer, self.class_bias, self.slot_layer, self.slot_bias]

    def flat(self):
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(np.float64)

    def moved(self, flat):
        """The network with other parameters."""
        parts, at = [], 0
        for a in self.arrays():
            parts.append(flat[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(self.ids, self.words, *parts)

    def token_type(self):
        return np.uint16 if self.ids.all < 1 << 16 else np.uint32

    def tokens(self, text):
        if self.lookup is None:
            self.lookup = _Lookup(self.words, self.ids)
        found = map(self.lookup.__getitem__, _words(text))
        return np.fromiter(found, self.token_type())

    def _means(self, row, at):
        """Averaged vectors of the neighbours of places in a padded row of tokens."""
        near = [row[at + k] for k in range(-SIDE, SIDE + 1) if k]
        total = np.take(self.vectors, near[0], axis=0)
        count = (near[0] != self.ids.all).astype(np.float32)
        for n in near[1:]:
            total += np.take(self.vectors, n, axis=0)
            count += n != self.ids.all
        count = np.maximum(count, 1)[:, None]
        total /= count
        return total, near, count

    def _class_logits(self, mean):
        logits = mean @ self.class_layer.T
        logits += self.class_bias
        return _cut(logits)

    def _in_blocks(self, mean, group):
        """The rows in blocks of one class each: (rows, place of each token, class of each block)."""
        count = np.bincount(group, minlength=self.ids.classes)
        blocks = -(-count // ROWS)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        shift = (np.cumsum(blocks) - blocks) * ROWS - (np.cumsum(count) - count)
        place = np.empty(len(group), np.int64)
        place[order] = np.arange(len(group)) + np.repeat(shift, count)
        of = np.repeat(np.arange(self.ids.classes), blocks)
        rows = np.zeros((len(of) * ROWS, DIMENSIONS), np.float32)
        rows[place] = mean
        return rows.reshape(len(of), ROWS, DIMENSIONS), place, of

    def _slot_logits(self, rows, of):
        logits = rows @ self.slot_layer.transpose(0, 2, 1)[of]
        logits += self.slot_bias[of][:, None]
        return _cut(logits.reshape(-1, self.ids.slots))

    def log_probabilities(self, row, at):
        """Of the tokens at some places. Rows are padded, so that every product has one shape."""
        n = len(at)
        at = np.concatenate([at, np.full(-n % SCORE_BATCH, at[0] if n else 0)])
        mean, _, _ = self._means(row, at)
        token = row[at[:n]].astype(np.int64)
        group, slot = token % self.ids.classes, token // self.ids.classes
        logits = self._class_logits(mean)
        result = logits[np.arange(n), group].astype(np.float64)
        result -= np.log(_exp_sums(logits)[:n])
        rows, place, of = self._in_blocks(mean[:n], group)
        logits = self._slot_logits(rows, of)
        result += logits[place, slot]
        result -= np.log(_exp_sums(logits)[place])
        return result

    def train(self, row, at, past):
        """One step on the places ``at``; ``past`` holds sums of squared gradients."""
        mean, near, count = self._means(row, at)
        token = row[at].astype(np.int64)
        group, slot = token % self.ids.classes, token // self.ids.classes
        n = np.float32(len(at))
        error = self._class_logits(mean)
        error *= (1 / _exp_sums(error))[:, None]
        error[np.arange(len(at)), group] -= 1
        back = error @ self.class_layer
        class_step, class_bias_step = error.T @ mean / n, _column_sums(error) / n
        rows, place, of = self._in_blocks(mean, group)
        error = self._slot_logits(rows, of)
        used = np.zeros(len(error), np.float32)
        used[place] = 1
        error *= (used / _exp_sums(error))[:, None]
        error[place, slot] -= 1
        error = error.reshape(len(of), ROWS, -1)
        back += np.take((error @ self.slot_layer[of]).reshape(-1, DIMENSIONS), place, axis=0)
        heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        seen = of[heads]
        # A column of ones beside the rows gives the steps of the biases.
        rows = np.concatenate([rows, np.ones((len(of), ROWS, 1), np.float32)], axis=2)
        steps = np.add.reduceat(error.transpose(0, 2, 1) @ rows, heads, axis=0) / n
        _adagrad(self.class_layer, class_step, past[1])
        _adagrad(self.class_bias, class_bias_step, past[2])
        _adagrad(self.slot_layer, steps[:, :, :-1], past[3], seen)
        _adagrad(self.slot_bias, steps[:, :, -1], past[4], seen)
        back /= count * n
        flat = np.concatenate(near)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        heads = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        summed = np.add.reduceat(np.take(back, order % len(at), axis=0), heads, axis=0)
        real = flat[heads] != self.ids.all
        _adagrad(self.vectors, summed[real], past[0], flat[heads][real])


def _cut(logits):
    if logits.size and max(logits.max(), -logits.min()) > LARGEST:
        np.clip(logits, -LARGEST, LARGEST, out=logits)
    return logits


def _exp_sums(logits):
    """Sums of the exponentials of each row, which take the logits' place."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


def _column_sums(values):
    return np.ones(len(values), np.float32) @ values


def _adagrad(values, step, past, rows=slice(None)):
    past[rows] += step * step
    values[rows] -= RATE * step / (np.sqrt(past[rows]) + 1e-6)


def _laid_out(network, documents):
    """(row, owners): tokens of documents with gaps between, about CHUNK_TOKENS at a time."""
    kind = network.token_type()
    gap, none = np.full(SIDE, network.ids.all, kind), np.full(SIDE, -1)

    def laid(parts, owners):
        return (np.concatenate([gap, *(x for p in parts for x in (p, gap))]),
                np.concatenate([none, *(x for o, p in zip(owners, parts)
                                        for x in (np.full(len(p), o), none))]))

    parts, owners, size = [], [], 0
    for number, tokens in enumerate(documents):
        parts.append(tokens)
        owners.append(number)
        size += len(tokens)
        if size >= CHUNK_TOKENS:
            yield laid(parts, owners)
            parts, owners, size = [], [], 0
    if parts:
        yield laid(parts, owners)


def scores(network, documents):
    """(tokens, summed log-probability) of documents as arrays of tokens."""
    total, count = np.zeros(len(documents)), np.zeros(len(documents), np.int64)
    for row, owner in _laid_out(network, documents):
        at = np.flatnonzero(owner >= 0)
        for i in range(0, len(at), SCORE_BATCH):
            part = at[i:i + SCORE_BATCH]
            total += np.bincount(
                owner[part], network.log_probabilities(row, part), minlength=len(documents))
        count += np.bincount(owner[at], minlength=len(documents))
    return count, total


def encoded(docs, shared, shards):
    """doc_id, shard, key (the order within a shard) and ids of every document, as a table."""

    def run(batches):
        network = shared.value
        for batch in batches:
            ids = [network.tokens(t).tobytes()
                   for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "shard", "key")), pa.array(ids, pa.binary())],
                ["doc_id", "shard", "key", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    key = F.xxhash64("doc_id", "text")
    return written(docs.select(
        "doc_id", F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(shards)).cast("int").alias("shard"),
        key.alias("key"), "text",
    ).mapInArrow(run, f"doc_id {kind}, shard int, key bigint, ids binary"), "token-ids")


def train_shard(start, documents):
    """(network, tokens) after one pass over a shard's documents."""
    network = start.moved(start.flat())
    past = [np.zeros_like(a) for a in network.arrays()]
    trained = 0
    for row, owner in _laid_out(network, documents):
        at = np.flatnonzero(owner >= 0)
        for i in range(0, len(at), TRAIN_BATCH):
            network.train(row, at[i:i + TRAIN_BATCH], past)
        trained += len(at)
    return network, trained


def _trainer(shared):
    def rows(batches):
        for batch in batches:
            yield from zip(batch.column("shard").to_pylist(), batch.column("ids"))

    def run(batches):
        start = shared.value
        found = rows(batches)
        pair = next(found, None)
        while pair is not None:
            shard = pair[0]

            def documents():
                nonlocal pair
                while pair is not None and pair[0] == shard:
                    yield np.frombuffer(pair[1].as_py(), start.token_type())
                    pair = next(found, None)

            network, trained = train_shard(start, documents())
            if trained:
                change = (network.flat() - start.flat()) * trained
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(change), dtype=np.int32)), pa.array(change),
                     pa.array(np.full(len(change), trained, np.int64))],
                    ["place", "change", "trained"])

    return run


def fit(docs):
    """(network, table of the documents' ids), trained on all documents."""
    ids, words, counts, others = vocabulary(docs)
    start = Network.start(ids, words, counts, others)
    shared = docs.sparkSession.sparkContext.broadcast(start)
    tokens = int(counts.sum() + others.sum())
    shards = max(1, -(-tokens // SHARD_TOKENS))
    table = encoded(docs, shared, shards)
    changes = (
        table.repartitionById(shards, "shard").sortWithinPartitions("shard", "key")
        .mapInArrow(_trainer(shared), "place int, change double, trained bigint")
        .groupBy("place")
        .agg((F.sum("change") / F.sum("trained")).alias("change"))
        .toArrow()  # a row for each parameter of the network
    )
    flat = start.flat()
    if changes.num_rows:
        flat[changes["place"].to_numpy()] += changes["change"].to_numpy()
    return start.moved(flat), table


def score(table, network):
    """doc_id, n_tokens, log_prob (sum) and mean_log_prob (0 without tokens) of ``encoded``
    documents."""
    shared = table.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        kind = shared.value.token_type()
        for batch in batches:
            documents = [np.frombuffer(x.as_py(), kind) for x in batch.column("ids")]
            count, total = scores(shared.value, documents)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count), pa.array(total),
                 pa.array(total / np.maximum(count, 1))],
                ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    kind = dict(table.dtypes)["doc_id"]
    return table.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, log_prob double, mean_log_prob double")


def scored(docs):
    """Every document's score by a network trained on all of them."""
    network, table = fit(docs)
    return score(table, network)
