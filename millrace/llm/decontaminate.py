"""Benchmark decontamination: a Wu-Manber search for windows of benchmark words.

Words are runs of digits, a-z (A-Z lowered) and non-ASCII characters.  A test string is ten
consecutive words of an item, or all words of a shorter item.  The search runs over words: a
shift table of two-word blocks tells how far a position can move without missing a test string,
most positions are skipped; where the shift is zero, the bucket of the block's hash and the
window's hash select test strings, and their bytes are compared with the document's.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` of text, each broadcast by itself and
held against all documents, so neither driver nor executor ever holds more than one block.
Every document is read once for each block and nothing but hits leaves a task.

Null texts have no words.  Items without words give no test string, items without item_id hit
words but are not listed, rows that repeat an item_id count as one item.  Rows that repeat a
doc_id are judged each for itself.  Without an item nothing is hit.
"""

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm.hashing import Spans, mix
from millrace.llm.text import ascii_lower, whole

WINDOW = 10
BLOCK_BYTES = 8 << 20

# Document text searched at once, and positions a cursor covers.
CHUNK_BYTES = 1 << 20
LANE = 256

# The characters that end a word, in lowered text.
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

_SPACE = ord(" ")
_CLASS = np.full(256, _SPACE, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _CLASS[_b] = _b
for _b in range(0x41, 0x5B):
    _CLASS[_b] = _b + 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some bytes: hashes, and the bytes as words with one space after each."""

    def __init__(self, data):
        mapped = _CLASS[np.frombuffer(data, np.uint8)]
        inside = np.concatenate(([False], mapped != _SPACE, [False]))
        self.start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        self.stop = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        self.hash = mix(Spans(mapped).hash(self.start, self.stop))
        last = np.flatnonzero(~inside[1:-1] & inside[:-2])
        keep = inside[1:-1].copy()
        keep[last] = True
        self.plain = mapped[keep].tobytes()
        ends = np.cumsum(self.stop - self.start + 1)
        self.plain_start = ends - (self.stop - self.start + 1)
        self.plain_stop = ends - 1

    def window_hash(self, first, n):
        total = np.zeros(len(first), np.uint64)
        for k in range(n):
            total = total * _STEP + self.hash[first + k]
        return mix(total)

    def bytes_of(self, first, n):
        return self.plain[self.plain_start[first]:self.plain_stop[first + n - 1]]


def _block(words, at):
    """Hash of the two words that end at ``at``."""
    return mix(words.hash[at - 1] * _STEP + words.hash[at])


class Search:
    """Shift table, buckets and test strings of one length."""

    def __init__(self, words, first, items, n):
        self.n, self.words = n, words
        self.width = min(2, n)
        key = self._key(words, first + n - 1)
        window = words.window_hash(first, n)
        order = np.lexsort((items, window, key))
        self.first, self.items = first[order], items[order]
        self.key = mix(key[order] ^ window[order])
        order = np.argsort(self.key, kind="stable")
        self.key, self.first, self.items = self.key[order], self.first[order], self.items[order]
        self.bits = max(12, int(4 * len(first)).bit_length())
        self.shift = np.full(1 << self.bits, n - self.width + 1, np.uint8)
        for back in range(n - self.width, -1, -1):  # the smallest shift is set last
            self.shift[self._slot(self._key(words, first + n - 1 - back))] = back

    def _key(self, words, at):
        return _block(words, at) if self.width == 2 else words.hash[at]

    def _slot(self, key):
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words, lane_first, lane_last):
        """(first word, item) of every occurrence; lanes are ranges of last-word positions."""
        at, last = lane_first, lane_last
        found = []
        while len(at):
            key = self._key(words, at)
            step = self.shift[self._slot(key)].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at <= last
            at, last = at[going], last[going]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        first = at - self.n + 1
        key = mix(self._key(words, at) ^ words.window_hash(first, self.n))
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        for f, i, j in zip(first[low < high], low[low < high], high[low < high]):
            text = words.bytes_of(f, self.n)
            for k in range(i, j):
                if self.words.bytes_of(self.first[k], self.n) == text:
                    yield f, self.items[k]


class Benchmark:
    """The test strings of a block of (item_id, text) rows, by length."""

    def __init__(self, rows, window):
        self.ids = [item_id for item_id, _ in rows]
        self.window = window
        text = "\n".join(text for _, text in rows).encode()
        words = Words(text)
        bounds = np.cumsum([len(t.encode()) + 1 for _, t in rows])
        owner = np.searchsorted(bounds, words.start, side="right")
        lengths = defaultdict(list)
        edges = np.searchsorted(owner, np.arange(len(rows) + 1))
        for item, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            n = int(min(window, b - a))
            if n:
                lengths[n].append(np.stack([np.arange(a, b - n + 1), np.full(b - a - n + 1, item)]))
        self.searches = [
            Search(words, *np.concatenate(parts, axis=1), n) for n, parts in lengths.items()
        ]

    def hits(self, words, bounds):
        """(document, first word in it, words, item) of every occurrence."""
        edges = np.searchsorted(words.start, bounds)
        for search in self.searches:
            first, last = edges[:-1] + search.n - 1, edges[1:] - 1
            lanes = np.maximum(-(-(last - first + 1) // LANE), 0)
            document = np.repeat(np.arange(len(first)), lanes)
            number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            begin = first[document] + number * LANE
            stop = np.minimum(begin + LANE - 1, last[document])
            for f, item in search.find(words, begin, stop):
                d = int(np.searchsorted(edges, f, side="right")) - 1
                yield d, int(f - edges[d]), search.n, item


def _chunks(texts, overlap):
    """(bytes, edges, numbers, words before): documents together, long ones in pieces.

    Pieces end between words and overlap by ``overlap`` words.
    """
    parts, numbers, before, size = [], [], [], 0
    for number, text in enumerate(texts):
        at, seen, span = 0, 0, CHUNK_BYTES
        while True:
            end = at + span
            while end < len(text) and _CLASS[text[end]] != _SPACE:
                end += 1
            parts.append(text[at:end])
            numbers.append(number)
            before.append(seen)
            size += len(parts[-1]) + 1
            if size < CHUNK_BYTES and end >= len(text):
                break
            piece = parts[-1]
            yield parts, numbers, before
            parts, numbers, before, size = [], [], [], 0
            if end >= len(text):
                break
            words = Words(piece)
            back = min(overlap, len(words.start))
            seen += len(words.start) - back
            start = at + int(words.start[-back]) if back else end
            span = span if start > at else 2 * span
            at = start
    if parts:
        yield parts, numbers, before


_compiled = {}


def _benchmark(name, shared, window):
    """The block's tables, made once in each worker; only the last block used stays."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = Benchmark(shared.value, window)
    return _compiled[name]


def _searcher(shared, number, window, ids):
    name = uuid.uuid4().hex

    def run(batches):
        benchmark = _benchmark(name, shared, window)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            spans, items = defaultdict(set), defaultdict(set)
            for parts, numbers, before in _chunks(texts, window - 1):
                words = Words(b"\n".join(parts))
                edges = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
                for d, first, n, item in benchmark.hits(words, edges):
                    spans[numbers[d]].add((before[d] + first, before[d] + first + n))
                    if benchmark.ids[item] is not None:
                        items[numbers[d]].add(benchmark.ids[item])
            rows = sorted(spans)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ids),
                 pa.array([number] * len(rows), pa.int32()),
                 pa.array([_merged(spans[r]) for r in rows],
                          pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array([sorted(items[r]) for r in rows], pa.list_(pa.string()))],
                [*ids, "block", "spans", "items"])

    return run


def _merged(spans):
    merged = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1]["stop"]:
            merged[-1]["stop"] = max(stop, merged[-1]["stop"])
        else:
            merged.append({"start": start, "stop": stop})
    return merged


def _blocks(benchmark, block_bytes):
    """Lists of (item_id, text) of about block_bytes, one in the driver at a time."""
    rows = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"].encode())
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def hits(docs, benchmark, window=WINDOW, block_bytes=BLOCK_BYTES):
    """doc_id, text_key, block, spans (ranges of hit words) and items, for documents with hits."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = (f"doc_id {kind}, text_key bigint, block int, "
              "spans array<struct<start:bigint,stop:bigint>>, items array<string>")
    found = None
    for number, block in enumerate(_blocks(benchmark, block_bytes)):
        shared = spark.sparkContext.broadcast(block)
        part = texts.mapInArrow(
            _searcher(shared, number, window, ["doc_id", "text_key"]), schema)
        found = part if found is None else found.unionAll(part)
    return found


def judged(docs, benchmark, window=WINDOW, block_bytes=BLOCK_BYTES):
    """doc_id, text_key, n_words, n_hit and items (sorted ids) of every row of docs."""
    # Copies of one row give the same hits for a block: one of them is merged.
    single = hits(docs, benchmark, window, block_bytes).dropDuplicates(
        ["doc_id", "text_key", "block"])
    merged = single.groupBy(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")
    ).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    state = "struct<stop:bigint,total:bigint>"
    n_hit = F.aggregate(
        "spans", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("total")).cast(state),
        lambda s, x: F.struct(
            F.greatest(s["stop"], x["stop"]).alias("stop"),
            (s["total"] + F.greatest(x["stop"] - F.greatest(s["stop"], x["start"]), F.lit(0)))
            .alias("total")).cast(state),
        lambda s: s["total"],
    )
    counted = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        F.regexp_count(ascii_lower(whole(F.col("text"))), F.lit(f"[^{NOT_WORD}]+"))
        .cast("bigint").alias("n_words"),
    )
    return counted.join(
        merged, counted["doc_id"].eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")),
        "left",
    ).select(
        "doc_id", "text_key", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digests(rows):
    """The contract's columns."""
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs, benchmark, window=WINDOW, block_bytes=BLOCK_BYTES):
    """docs without the rows that hold a test string."""
    found = hits(docs, benchmark, window, block_bytes).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    return docs.join(
        found.distinct(), docs["doc_id"].eqNullSafe(F.col("__id"))
        & (F.xxhash64(docs["text"]) == F.col("__key")), "left_anti")
