"""Suffix-array dedup: bytes covered by a long string that also starts earlier go.

A text is its UTF-8 bytes.  A byte is removed if some string of ``length`` bytes that covers it
also starts earlier in the corpus: in a document of smaller doc_id, or further ahead in the same
one.  Strings are judged on the input; matches never cross documents.

1. Every string of ``length`` bytes is filed under its smallest ``gram``-byte hash.  Strings that
   follow one another with the same gram form a stretch, so equal strings lie in stretches under
   one gram.  Grams of a single stretch end here; only digests, no bytes, are shuffled.
2. Equal stretches under a gram: all but the earliest go whole.
3. Different stretches under a gram are fetched from their texts and cut in two: strings with
   half of their other bytes or more before the gram, and the rest.  The former are filed anew
   under the bytes just before the gram, the latter under those just after it, which equal
   strings share as well; so a gram that very many texts have falls apart by what is around it.
4. The parts under one such key are sorted by ``suffix_array``; of each run of suffixes with
   ``length`` bytes in common all but the earliest go.

Whole keys are packed into blocks of bytes, so a task holds one block.  A key with more than
``MANY`` different parts is not held in one task: the strings of its parts are digested one by one
and grouped by digest, which combines in the tasks.

Null texts are empty.  Documents without doc_id come first.  Rows alike in doc_id and text are
one document; the others that share a doc_id follow each other by place as if they were one.
Texts shorter than ``length`` stay.  Columns other than doc_id and text are ignored.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from millrace.llm.hashing import Spans, mix
from millrace.llm.suffix_array import common_prefixes, suffix_order
from millrace.llm.text import whole, written

LENGTH = 100
GRAM = 32
MANY = 1 << 12

# Bytes hashed at once (positions must fit PLACE_BITS), and bytes sorted at once.
PLACE_BITS = 18
CHUNK_BYTES = (1 << PLACE_BITS) - 4096
BLOCK_BYTES = 1 << 20
# Documents whose stretches are cut out at once.
FETCH_ROWS = 256

_PLACE = np.uint64((1 << PLACE_BITS) - 1)
# A stretch's place packs its start, its gram's offset from there, and its length.
SIZE_BITS = 10


def _sliding_min(values, width):
    least, done = values, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[:done - width], least[width - done:])
    return least


def _chunks(texts, length):
    """(bytes, [(text number, start in text, start in bytes, strings)]): texts together, long
    ones in pieces that share no string."""
    parts, owners, size = [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK_BYTES // 2):
            strings = min(CHUNK_BYTES // 2, len(text) - length + 1 - at)
            if size + strings + length > CHUNK_BYTES:
                yield b"".join(parts), owners
                parts, owners, size = [], [], 0
            owners.append((number, at, size, strings))
            parts.append(text[at:at + strings + length - 1])
            size += len(parts[-1])
    if parts:
        yield b"".join(parts), owners


def _stretches(texts, length, gram):
    """(text number, gram hash, content digest, start, gram offset, size) arrays by chunk."""
    width = length - gram + 1
    for joined, owners in _chunks(texts, length):
        data = np.frombuffer(joined, np.uint8)
        spans = Spans(data)
        at = np.arange(len(data) - gram + 1)
        hashes = mix(spans.hash(at, at + gram))
        # The low bits hold the place: the leftmost of equal hashes wins and is known.
        least = _sliding_min((hashes & ~_PLACE) | at.astype(np.uint64), width)
        owner = np.array(owners)
        first, count = owner[:, 2], owner[:, 3]
        new = np.zeros(len(least) + 1, bool)
        new[1:-1] = least[1:] != least[:-1]
        new[first] = True
        new[np.minimum(first + count, len(least))] = True
        starts = np.flatnonzero(new)
        starts, stops = starts[:-1], starts[1:]
        number = np.searchsorted(first, starts, side="right") - 1
        valid = starts < first[number] + count[number]
        starts, stops, number = starts[valid], stops[valid], number[valid]
        size = stops - starts + length - 1
        content = mix(spans.hash(starts, starts + size) + size.astype(np.uint64))
        where = (least[starts] & _PLACE).astype(np.int64)
        start = starts - first[number] + owner[number, 1]
        yield owner[number, 0], hashes[where], content, start, where - starts, size


def stretches(docs, length=LENGTH, gram=GRAM):
    """h (gram), c (content), doc_id, text_key and place of every stretch."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for number, h, c, start, offset, size in _stretches(texts, length, gram):
                rows = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)),
                     batch.column("doc_id").take(rows), batch.column("text_key").take(rows),
                     pa.array((((start << SIZE_BITS) | offset) << SIZE_BITS) | size)],
                    ["h", "c", "doc_id", "text_key", "place"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"h bigint, c bigint, doc_id {kind}, text_key bigint, place bigint")


def _start():
    return F.shiftright("place", 2 * SIZE_BITS)


def _size():
    return F.col("place").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def _parts(text, h, place, length, gram):
    """(key, start, bytes) of a stretch's strings with half of their other bytes or more
    before the gram, and of the others."""
    size = place & (1 << SIZE_BITS) - 1
    start = place >> 2 * SIZE_BITS
    at = start + (place >> SIZE_BITS & (1 << SIZE_BITS) - 1)
    before = (length - gram) // 2
    after = length - gram - before + 1
    last, seed = start + size - length, h & (1 << 64) - 1
    if (stop := min(last, at - before)) >= start:
        key = xxhash.xxh64_intdigest(b"<" + text[at - before:at], seed)
        yield key, start, text[start:stop + length]
    if (first := max(start, at - before + 1)) <= last:
        key = xxhash.xxh64_intdigest(b">" + text[at + gram:at + gram + after], seed)
        yield key, first, text[first:last + length]


def repeated_stretches(docs, length=LENGTH, gram=GRAM):
    """The stretches of grams that have two or more, with ``mixed``: not all are equal."""
    rows = stretches(docs, length, gram)
    grams = (
        rows.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b"))
        .where(F.col("n") > 1).select("h", (F.col("a") != F.col("b")).alias("mixed"))
    )
    # Written tables on the small side let the join split a gram that many rows have.
    return written(rows.join(written(grams, "grams"), "h"), "stretches")


def _fetch(docs, wanted, length, gram):
    """key, doc_id, text_key, start and bytes of the wanted stretches (h, doc_id, text_key,
    place), in parts."""
    kind = dict(docs.dtypes)["doc_id"]
    lists = wanted.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.collect_list("h").alias("h"), F.collect_list("place").alias("place"))
    joined = docs.select("doc_id", "text").join(
        lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FETCH_ROWS):
                some = batch.slice(at, FETCH_ROWS)
                owner = np.repeat(
                    np.arange(some.num_rows), pc.list_value_length(some.column("h")).to_numpy())
                texts = some.column("text").cast(pa.binary()).to_pylist()
                rows, parts = [], []
                for o, h, place in zip(
                        owner.tolist(), some.column("h").flatten().to_pylist(),
                        some.column("place").flatten().to_pylist()):
                    for part in _parts(texts[o], h, place, length, gram):
                        rows.append(o)
                        parts.append(part)
                rows = pa.array(rows, pa.int64())
                keys, starts, cuts = zip(*parts) if parts else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)),
                     some.column("doc_id").take(rows), some.column("__key").take(rows),
                     pa.array(starts, pa.int64()), pa.array(cuts, pa.binary())],
                    ["key", "doc_id", "text_key", "start", "bytes"])

    return joined.select("doc_id", "__key", "text", "h", "place").mapInArrow(
        run, f"key bigint, doc_id {kind}, text_key bigint, start bigint, bytes binary")


def later_strings(parts, order, length=LENGTH):
    """(part, first, last) of the runs of strings in ``parts`` that also start earlier.

    ``parts`` are byte strings; ``order`` tells each one's place among all, as numbers that
    grow by one with each byte within a document.
    """
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    suffixes = suffix_order(text, length)
    shared = common_prefixes(text, suffixes, length)
    part = np.searchsorted(starts, suffixes, side="right") - 1
    offset = suffixes - starts[part]
    valid = offset + length <= sizes[part]
    run = np.cumsum(shared < length)[valid]
    key, place = (order[part] + offset)[valid], suffixes[valid]
    if not len(run):
        return (np.zeros(0, np.int64),) * 3
    heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    least = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(run))))
    later = np.sort(place[key > least])
    if not len(later):
        return (np.zeros(0, np.int64),) * 3
    part = np.searchsorted(starts, later, side="right") - 1
    new = np.concatenate(([True], (np.diff(later) > 1) | (np.diff(part) > 0)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(later)) - 1
    owner = part[first]
    return owner, later[first] - starts[owner], later[last] - starts[owner]


def _sorter(length):
    def block(table):
        key = table["key"].to_numpy()
        alike = key[1:] == key[:-1]
        # Alone under its key a part has nothing to be compared with.
        table = table.filter(pa.array(
            np.concatenate(([False], alike)) | np.concatenate((alike, [False]))))
        ids = table["doc_id"].combine_chunks()
        start = table["start"].to_numpy()
        # Documents in order of doc_id, null first; places within them by byte.
        ranks = ids.dictionary_encode()
        values = ranks.dictionary
        order = np.zeros(len(values), np.int64)
        order[pc.array_sort_indices(values).to_numpy()] = np.arange(1, len(values) + 1)
        codes = ranks.indices.fill_null(-1).to_numpy()
        document = np.where(codes < 0, 0, order[codes]) if len(values) else np.zeros(len(codes), int)
        part, first, last = later_strings(
            table["bytes"].to_pylist(), (document << 40) + start, length)
        rows = pa.array(part)
        return pa.RecordBatch.from_arrays(
            [ids.take(rows), table["text_key"].combine_chunks().take(rows),
             pa.array(start[part] + first), pa.array(start[part] + last + length)],
            ["doc_id", "text_key", "start", "stop"])

    def run(batches):
        rest, size = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            size += batch.nbytes
            if size < BLOCK_BYTES:
                continue
            key = rest["key"].to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(change):  # the last key may go on in the next batch
                cut = int(change[-1]) + 1
                yield block(rest.slice(0, cut))
                rest = rest.slice(cut).combine_chunks()
                size = rest.nbytes
        if rest is not None and rest.num_rows:
            yield block(rest)

    return run


def _digested(length):
    """Every string of a part as a 128-bit digest, for keys with many parts."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                data = one.column("bytes")[0].as_py()
                n = len(data) - length + 1
                same = pa.array(np.zeros(n, np.int64))
                start = one.column("start")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(data[i:i + length]) for i in range(n)]),
                     one.column("doc_id").take(same), one.column("text_key").take(same),
                     pa.array(np.arange(start, start + n))],
                    ["digest", "doc_id", "text_key", "start"])

    return run


def removed_ranges(docs, length=LENGTH, gram=GRAM, many=MANY):
    """doc_id, text_key, start and stop: ranges of bytes to remove; they may overlap."""
    kind = dict(docs.dtypes)["doc_id"]
    found = repeated_stretches(docs, length, gram)
    holder = F.struct("doc_id", "place", "text_key")
    firsts = written(found.groupBy("h", "c").agg(
        F.min(holder).alias("holder"), F.first("mixed").alias("mixed")), "firsts")
    copies = (
        found.join(firsts.select("h", "c", "holder"), ["h", "c"])
        .where(~F.struct("doc_id", "place").eqNullSafe(
            F.struct("holder.doc_id", "holder.place")))
        .select("doc_id", "text_key", _start().alias("start"), (_start() + _size()).alias("stop"))
    )
    fetched = written(_fetch(docs, firsts.where("mixed").select("h", "holder.*"), length, gram), "parts")
    large = written(fetched.groupBy("key").count().where(F.col("count") > many), "large")
    sorted_out = (
        fetched.join(large, "key", "left_anti")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_sorter(length), f"doc_id {kind}, text_key bigint, start bigint, stop bigint")
    )
    strings = fetched.join(large, "key", "left_semi").mapInArrow(
        _digested(length), f"digest binary, doc_id {kind}, text_key bigint, start bigint")
    earliest = written(
        strings.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("least")), "earliest")
    later = strings.join(earliest, "digest").where(
        ~F.struct("doc_id", "start").eqNullSafe(F.col("least"))
    ).select("doc_id", "text_key", "start", (F.col("start") + length).alias("stop"))
    # One table each: the join of the copies may then be split where one of them is frequent.
    parts = [("copies", copies), ("sorted", sorted_out), ("later", later)]
    first, *others = (written(part, f"ranges-{name}") for name, part in parts)
    for part in others:
        first = first.unionAll(part)
    return first


def _cut(text, starts, stops):
    """Kept bytes in pieces, number of removed runs, from overlapping ranges."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > stops[:-1])))
    starts, stops = starts[new], stops[np.append(new[1:], len(stops)) - 1]
    edges = zip(np.append(0, stops).tolist(), np.append(starts, len(text)).tolist())
    return [text[i:j] for i, j in edges], len(starts)


def remove_repeats(docs, length=LENGTH, gram=GRAM, many=MANY):
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    ranges = removed_ranges(docs, length, gram, many)
    lists = ranges.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    joined = docs.select("doc_id", whole(F.col("text")).alias("text"), F.xxhash64("text").alias("k")).join(
        lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__key")), "left")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kept, spans = [], []
            for text, start, stop in zip(texts, batch.column("start"), batch.column("stop")):
                if start.is_valid:
                    pieces, n = _cut(text, np.asarray(start.values), np.asarray(stop.values))
                else:
                    pieces, n = [text], 0
                kept.append(b"".join(pieces))
                spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text", "start", "stop").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digests(rows):
    """The contract's columns."""
    return rows.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
