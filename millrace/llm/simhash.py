"""SimHash near-dedup: 64-bit fingerprints, segment counts, a grid range join, components.

A fingerprint is cut into 32 segments of two bits, each mapped to its number of ones.  The
Manhattan distance of two such vectors is never above the Hamming distance of the fingerprints.
The segments form the coordinates of a grid, more of them for more fingerprints.  Two vectors within distance d differ in at
most d coordinates, so they share a cell in one of the projections on ``groups - d`` of them:
the range join is an equi-join on the cells of all projections.  In a cell, pairs are compared
by the Manhattan distance first and then by the exact Hamming distance; no link is lost.

Only different fingerprints are compared: copies meet in a grouping that combines in the tasks.
A cell gives at most one row per member (a forest of its links), never its pairs.  The task that
reads a cell compares within blocks of ``block`` members; the members of larger cells go on to
tasks that compare a pair of blocks each.

Null and empty texts have fingerprint 0 and are linked like any other; long texts are read whole.  Rows that repeat a
doc_id are fingerprinted by themselves.  component_id is the smallest doc_id of the component,
null ids left out; it is null only if the component has no other.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.text import written

BITS, SEGMENT_BITS, SEED = 64, 2, 42
DISTANCE, BLOCK = 4, 1024
WORDS = 4

# Rows of sorted cells that a task compares at once, and shingles whose bits it adds at once.
CHUNK_ROWS = 1 << 15
CHUNK_SHINGLES = 1 << 16

# Bits by which a segment's count tells fingerprints apart (at most 1.5), and the comparisons that
# cost as much as a row of a cell: what grid() weighs.
SEGMENT_INFORMATION, ROW_COST = 1.25, 50

_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text, words=WORDS):
    """The fingerprint of UTF-8 bytes as a signed 64-bit number."""
    tokens = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1)[words - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK_SHINGLES):
        part = hashes[at:at + CHUNK_SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs, words=WORDS):
    """doc_id, text_key (tells apart rows that repeat a doc_id) and the fingerprint fp."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = [fingerprint(t or b"", words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fps, pa.int64())],
                ["doc_id", "text_key", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key bigint, fp bigint")


def segment_counts(fps):
    """Ones in each two-bit segment, as a (n, 32) array."""
    pairs = (fps & _LOW) + ((fps >> _ONE) & _LOW)
    shifts = np.arange(0, BITS, SEGMENT_BITS, dtype=np.uint64)
    return ((pairs[:, None] >> shifts) & np.uint64(3)).astype(np.int64)


def manhattan(a, b):
    """Distance of the segment counts: a two-bit segment 01 against 10 counts 0, else as Hamming."""
    x = a ^ b
    swapped = x & (x >> _ONE) & (a ^ (a >> _ONE)) & _LOW
    return np.bitwise_count(x).astype(np.int64) - 2 * np.bitwise_count(swapped)


def _cell_keys(fps, groups, distance):
    """(n, projections) keys: the cell in every projection on groups - distance coordinates."""
    counts = segment_counts(fps)
    cells = [
        part @ (3 ** np.arange(part.shape[1], dtype=np.int64))
        for part in np.array_split(counts, groups, axis=1)
    ]
    width = 3 ** -(-(BITS // SEGMENT_BITS) // groups)
    keys = []
    for number, chosen in enumerate(combinations(range(groups), groups - distance)):
        key = np.full(len(fps), number, np.int64)
        for g in chosen:
            key = key * width + cells[g]
        keys.append(key)
    return np.stack(keys, axis=1)


def grid(n, distance=DISTANCE):
    """The number of groups that costs least for n fingerprints: each is in a cell of every
    projection, and is compared there with those that are in it by chance. No result depends on it."""
    segments = BITS // SEGMENT_BITS

    def cost(groups):
        bits = SEGMENT_INFORMATION * segments * (groups - distance) / groups
        return comb(groups, distance) * (1 + n / 2 ** bits / ROW_COST)

    return min(range(distance + 1, segments + 1), key=cost)


def cells(fps, groups, distance=DISTANCE):
    """fp and key, a row for each projection."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.column("fp").slice(at, CHUNK_ROWS)
                keys = _cell_keys(part.to_numpy(zero_copy_only=False).view(np.uint64),
                                  groups, distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.to_numpy(zero_copy_only=False), keys.shape[1])),
                     pa.array(keys.ravel())], ["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp bigint, key bigint")


def _near(a, b, distance):
    """Places where the fingerprints are near: by the lower bound, then exactly."""
    at = np.flatnonzero(manhattan(a, b) <= distance)
    return at[np.bitwise_count(a[at] ^ b[at]) <= distance]


def _forest(n, left, right):
    """Links (node, root) that join the same nodes as the links left-right."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        # Roots of links still apart are linked themselves.
        left, right = label[left], label[right]
    while True:
        up = label[label]
        if np.array_equal(up, label):
            break
        label = up
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _cell_links(fps, group, distance):
    """Links within groups of sorted rows, compared at growing offsets."""
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(new, len(group)))
    end = np.repeat(new + size, size)
    lefts, rights = [], []
    rows = np.arange(len(group))
    for offset in range(1, int(size.max(initial=1))):
        i = rows = rows[rows + offset < end[rows]]
        if not len(i):
            break
        near = i[_near(fps[i], fps[i + offset], distance)]
        lefts.append(near)
        rights.append(near + offset)
        if sum(map(len, lefts)) > CHUNK_ROWS * 16:
            node, root = _forest(len(group), np.concatenate(lefts), np.concatenate(rights))
            lefts, rights = [node], [root]
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(len(group), np.concatenate(lefts), np.concatenate(rights))


def _places(key, seen):
    """Each row's place in its cell; ``seen`` rows of the first cell went before."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    first = len(key) if len(starts) == 1 else starts[1]
    place[:first] += seen
    return place


def _numbered(*columns):
    """One number per row that changes where any of the columns of sorted rows does."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _within_blocks(carried, link, block):
    """Links a, b within the blocks of sorted cells. Rows of cells of several blocks are handed
    on as well, with their key and the number of their block, and a and b null."""

    def run(batches):
        rest, seen = None, 0  # rows of the last block, and rows of its cell before them
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < CHUNK_ROWS:
                continue
            key = rest["key"].to_numpy()
            place = _places(key, seen)
            last = int(np.flatnonzero(np.concatenate(
                ([True], (key[1:] != key[:-1]) | (place[1:] % block == 0))))[-1])
            if last:  # the last block may go on in the next batch
                yield compare(rest.slice(0, last), place[:last], key[last])
                rest, seen = rest.slice(last).combine_chunks(), int(place[last])
        if rest is not None and rest.num_rows:
            yield compare(rest, _places(rest["key"].to_numpy(), seen), None)

    def compare(rows, place, following):
        key, number = rows["key"].to_numpy(), place // block
        a, b = link(rows, _numbered(key, number))
        # A cell has several blocks if a row of a later one is in it.
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        several = np.repeat(number[ends - 1] > 0, ends - starts)
        if following is not None and key[-1] == following:
            several[starts[-1]:] = True
        on = pa.array(np.flatnonzero(several))

        def padded(first, last):
            return pa.concat_arrays([
                pa.nulls(len(a), pa.int64()) if first is None else pa.array(first),
                pa.nulls(len(on), pa.int64()) if last is None else last])

        return pa.RecordBatch.from_arrays(
            [padded(a, None), padded(b, None), padded(None, pa.array(number).take(on)),
             *(padded(None, rows[c].combine_chunks().take(on)) for c in ("key", *carried))],
            ["a", "b", "block", "key", *carried])

    return run


def _within_pairs(link):
    """Links a, b between the rows of each pair of blocks."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < CHUNK_ROWS:
                continue
            change = np.flatnonzero(np.diff(numbered(rest)))
            if len(change):  # the last pair may go on in the next batch
                yield compare(rest.slice(0, int(change[-1]) + 1))
                rest = rest.slice(int(change[-1]) + 1).combine_chunks()
        if rest is not None and rest.num_rows:
            yield compare(rest)

    def numbered(rows):
        return _numbered(rows["key"].to_numpy(), rows["part"].to_numpy())

    def compare(rows):
        a, b = link(rows, numbered(rows))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def cell_blocks(placed, carried, link, block):
    """Links of cells (key and carried columns, all bigint) by ``link``, which gets sorted rows
    and the number of each row's group; and the rows of cells above ``block`` rows."""
    columns = ", ".join(f"{c} bigint" for c in ("a", "b", "block", "key", *carried))
    done = written(
        placed.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_within_blocks(carried, link, block), columns),
        "cell-links",
    )
    return done.where("key IS NULL").select("a", "b"), done.where("key IS NOT NULL").drop("a", "b")


def pair_blocks(shared, carried, link):
    """Links between the blocks of large cells: each row goes to the pairs its block is in."""
    blocks = written(
        shared.groupBy("key").agg((F.max("block") + 1).alias("blocks")), "large-cells")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return (
        shared.join(blocks, "key").select("*", other).where("block != other")
        .select("key", *carried, (low * F.col("blocks") + high).alias("part"))
        .repartition("key", "part").sortWithinPartitions("key", "part")
        .mapInArrow(_within_pairs(link), "a bigint, b bigint")
    )


def links(fps, distance=DISTANCE, groups=None, block=BLOCK):
    """Links a, b that join all fingerprints within the distance, directly or by others.

    ``fps`` holds different fingerprints; ``groups`` must be above ``distance``, and follows from
    the number of fingerprints if it is not given.
    """
    groups = groups or grid(fps.count(), distance)

    def link(rows, group):
        fps = rows["fp"].to_numpy()
        node, root = _cell_links(fps.view(np.uint64), group, distance)
        return fps[node], fps[root]

    within, shared = cell_blocks(cells(fps, groups, distance), ["fp"], link, block)
    return within.unionAll(pair_blocks(shared, ["fp"], link))


def near_components(docs, words=WORDS, distance=DISTANCE, groups=None, block=BLOCK):
    """doc_id, text_key, fp, root (the component's smallest fingerprint) and component_id
    of every row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts, distance, groups, block))
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def digests(rows):
    """The contract's columns."""
    return rows.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs, rows):
    """docs with one row of each component of ``rows`` (of near_components or alike): that of
    the smallest doc_id, of rows that share it any one. Rows without doc_id stay only where
    their component has no other, as one."""
    kept = (
        rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("__kept"))
        .select(F.col("__kept.doc_id").alias("__id"), F.col("__kept.text_key").alias("__key"))
    )
    joined = docs.join(
        kept, docs["doc_id"].eqNullSafe(F.col("__id"))
        & (F.xxhash64(docs["text"]) == F.col("__key")))
    return joined.dropDuplicates(["__id", "__key"]).drop("__id", "__key")
