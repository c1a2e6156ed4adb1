"""Ranked lexical search: an Aho-Corasick automaton of all item terms reads the documents.

A term is a run of digits, letters a-z (A-Z lowered) and non-ASCII characters.  Each text becomes
bytes in which every other character is a blank; the automaton holds each item term with a blank on
either side, so that it finds whole terms only.  One pass over a text gives the frequencies of all
item terms in it: nothing is built over the documents, and words that no item asks for leave no
row.  The automaton's outputs are term numbers, which a table maps to items.

1. Every document is scanned: its number of terms, and the number and frequency of each item term.
2. The number of documents and of terms, and the documents holding each term, are summed up.
3. Every document's scores come from its frequencies alone; a task keeps the best of each item
   among its documents, and the best of those are ranked.  A score is a sum of integers.

Items are taken in blocks of about ``BLOCK_BYTES`` of text; one block at a time is in the driver
and in the executors, and the documents are read once for each.  A task keeps ``top`` rows of each
item in a block, whatever the number of documents.

Null and empty texts have no terms and match nothing, however long a text is it is read whole, in
pieces cut at blanks.  Rows that repeat a doc_id are documents of their own; equal scores are ranked
by doc_id, null last, and a document repeated whole stands as often as it has rows.  Rows of one
item_id (null is one) are one item with the terms of its different texts.  Without documents or
items there is no row.  doc_id is an integer; other columns are ignored.
"""

import math
import uuid
from collections import Counter
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.llm.text import written

TOP = 20
BLOCK_BYTES = 2 << 20

# Fixed values of the score.
SCALE, WEIGHT_SCALE, SLOPE, FLAT, PER_TERM = 1_000_000_000, 1000, 25, 75, 12

# Bytes of text read at once; scores held at once.
PIECE = 1 << 20
SCORES = 1 << 21

_KEPT = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TABLE = bytes(
    b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _plain(text):
    """The text's bytes with a blank for each character outside terms."""
    return (text or b"").translate(_TABLE)


def _pieces(plain):
    """Stretches of about PIECE bytes, cut at blanks, with a blank on either side."""
    at = 0
    while at < len(plain):
        end = at + PIECE
        if end < len(plain):
            end = plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        yield b" " + plain[at:end] + b" "
        at = end


class Items:
    """The terms of a block of (item_id, texts) rows, and the items that ask for each."""

    def __init__(self, rows):
        self.ids = [item_id for item_id, _ in rows]
        wanted = [Counter(chain.from_iterable(_plain(t.encode()).split() for t in texts))
                  for _, texts in rows]
        self.terms = sorted(set().union(*wanted))
        number = {t: i for i, t in enumerate(self.terms)}
        places = sorted(
            (number[t], item, n) for item, asked in enumerate(wanted) for t, n in asked.items())
        term, self.item, self.times = np.array(places, np.int64).reshape(-1, 3).T
        self.edges = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def automaton(self):
        """Finds " term " in a text of bytes read as Latin-1."""
        found = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", i)
        found.make_automaton()
        return found


_made = {}


def _once(name, make):
    """What a worker makes once of a broadcast block; only the last one stays."""
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


def _scanner(shared):
    name = uuid.uuid4().hex

    def run(batches):
        items = shared.value
        automaton = _once(name, items.automaton) if items.terms else None
        for batch in batches:
            n_terms, terms, counts, edges = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n, seen = 0, Counter()
                for piece in _pieces(_plain(text)):
                    n += len(piece.split())
                    if automaton is not None:
                        seen.update(map(itemgetter(1), automaton.iter(piece.decode("latin-1"))))
                n_terms.append(n)
                terms += seen.keys()
                counts += seen.values()
                edges.append(len(terms))
            edges = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_terms, pa.int64()),
                 pa.ListArray.from_arrays(edges, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(counts, pa.int64()))],
                ["doc_id", "n", "terms", "tf"])

    return run


def scanned(docs, shared):
    """doc_id, n (terms), and the numbers (terms) and frequencies (tf) of a block's terms."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _scanner(shared), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def weights(items, df, documents):
    """The weight of each term of a block."""
    return np.array(
        [math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1)))
         for i in range(len(items.terms))], np.int64)


def _ranges(start, stop):
    """start[0]..stop[0]-1, start[1]..stop[1]-1, … as one array."""
    size = stop - start
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _best(item, score, doc, missing, top):
    """The places of the best rows of each item, in order."""
    order = np.lexsort((doc, missing, -score, item))
    ranked = item[order]
    begin = np.searchsorted(ranked, ranked)
    return order[np.arange(len(order)) - begin < top]


def _scorer(shared, weight, documents, terms, top):
    def run(batches):
        items = shared.value
        width = len(items.ids)
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        least = np.ones(width, np.int64)  # a score has to reach this to be among the best
        for batch in batches:
            doc = batch.column("doc_id")
            missing = doc.is_null().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            many = batch.column("n").to_numpy()
            measure = FLAT + SLOPE * many * documents // terms
            lists, counts = batch.column("terms"), batch.column("tf")
            number = lists.flatten().to_numpy()
            tf = counts.flatten().to_numpy()
            edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            owner = np.repeat(np.arange(len(doc)), np.diff(edges))
            value = weight[number] * ((SCALE * tf) // (1000 * tf + PER_TERM * measure[owner]))
            step = max(1, SCORES // width)
            for a in range(0, len(doc), step):
                b = min(a + step, len(doc))
                mine = slice(edges[a], edges[b])
                start, stop = items.edges[number[mine]], items.edges[number[mine] + 1]
                asked = _ranges(start, stop)
                each = stop - start
                score = np.zeros((b - a) * width, np.int64)
                np.add.at(score, np.repeat((owner[mine] - a) * width, each) + items.item[asked],
                          np.repeat(value[mine], each) * items.times[asked])
                score = score.reshape(b - a, width)
                row, item = np.nonzero(score >= least)
                kept = [np.concatenate(x) for x in zip(
                    kept, (item, score[row, item], doc[a + row], missing[a + row]))]
                best = _best(*kept, top)
                kept = [x[best] for x in kept]
                full = np.bincount(kept[0], minlength=width) == top
                least[full] = kept[1][np.searchsorted(kept[0], np.flatnonzero(full), "right") - 1]
        item, score, doc, missing = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array([items.ids[i] for i in item], pa.string()),
             pa.array(doc, mask=missing), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def _blocks(items, block_bytes):
    """Items of about block_bytes of text, one block in the driver at a time."""
    rows = (
        items.where(F.col("text").isNotNull())
        .groupBy(F.col("item_id").cast("string").alias("item_id"))
        .agg(F.collect_set("text").alias("texts"))
    )
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["texts"]))
        size += sum(len(t.encode()) for t in row["texts"])
        if size >= block_bytes:
            yield Items(block)
            block, size = [], 0
    if block:
        yield Items(block)


def _block_best(docs, items, top):
    """The best documents of each item of a block in each task."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(items)
    found = written(scanned(docs, shared), "term-counts")
    totals = found.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    # A row for each term of the block.
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weight = weights(items, {r["term"]: r["count"] for r in holding}, totals["documents"])
    return found.where("size(terms) > 0").select("doc_id", "n", "terms", "tf").mapInArrow(
        _scorer(shared, weight, totals["documents"], totals["terms"], top),
        "item_id string, doc_id bigint, score bigint")


def search(docs, items, top=TOP, block_bytes=BLOCK_BYTES):
    """item_id, rank, doc_id, score: the ``top`` best documents of each item with a score above 0."""
    found = None
    for block in _blocks(items, block_bytes):
        best = _block_best(docs, block, top)
        found = best if found is None else found.unionAll(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id string, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    kind = dict(items.dtypes)["item_id"]
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
    )
