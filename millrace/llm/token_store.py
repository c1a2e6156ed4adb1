"""Token-id files: documents as ids, in order of doc_id, compressed by a grammar per shard.

A shard holds neighbouring documents of about ``SHARD_IDS`` ids (a longer document is a shard by
itself).  Frequent pairs of ids are replaced again and again (``grammar``); the shard stores the
rules, how many ids each stands for, and what remains of the sequence, so that one document, or any
stretch of ids, is decoded from the symbols that cover it.  The layout, little-endian::

    magic "IDRP", version (2 bytes), bytes per symbol (2), base, documents, rules (4 each),
    symbols, ids (8 each), crc32 of what follows (4),
    doc_ids (8 each), doc_id is null (1 each), end of each document in ids (8 each),
    left and right symbol of each rule, ids of each rule (8 each), symbols

Shards are values of a Parquet table that Spark commits (part, shard, start, n_ids, content): a
task that runs twice, or is lost, leaves no half-written file.  ``part`` is the place in the order
of the range of doc_ids a task wrote, ``start`` the ids before the shard in that range.

Each document ends with ``end_id``.  Null and empty texts have that id alone.  Documents of null
doc_id come first; rows of one doc_id are documents of their own, in the order of their texts'
hashes.  Texts are read whole, in pieces cut at white space.  Columns other than doc_id and text
are ignored; an empty table gives no row.

With ``by_word`` the library encodes each different word (bytes between ASCII white space, without
marks behind it and in lower case) once in a worker and the ids are put together.  That is exact for
tokenizers that lower A-Z, whose pieces neither hold white space nor depend on what stands beyond it,
and that part marks from words, as word_bpe_49k.json; for others turn it off.
"""

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.grammar import Grammar, compress, symbol_type

# Spark's tasks fill the cores; threads of the library would only add to them.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SHARD_IDS = 1 << 20
END_ID = 1

# Words kept by a worker, the longest of them, words of one library call's text, and bytes of text
# encoded at once.
KNOWN_WORDS = 1 << 20
LONGEST = 64
TOGETHER = 256
PIECE = 1 << 24

MAGIC, VERSION = b"IDRP", 1
_HEAD = struct.Struct("<4sHHIIIQQI")
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
# Marks that the tokenizer parts from a letter or digit before them.
TAIL = ".,;:!?"

FILES = "part int, shard int, start bigint, n_ids bigint, content binary"


class Encoder:
    """Ids of texts."""

    def __init__(self, path, by_word=True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word = by_word
        self.known = {}
        self.ends_word = self._word_ends() if by_word else None

    def _word_ends(self):
        """Whether each id ends a word; None if the tokenizer does not mark ends."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        ends = np.zeros(self.base, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            ends[number] = token.endswith(suffix)
        return ends

    def _encoded(self, texts):
        found = self.tokenizer.encode_batch_fast(
            [t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def ids(self, texts):
        """(the ids of all texts as one array, where each text's end)."""
        found, ends = [], np.zeros(len(texts), np.int64)
        for pieces, owners in _pieces(texts, self.by_word):
            ids, sizes = self._words(pieces) if self.by_word else _flat(self._encoded(pieces))
            found.append(ids)
            np.add.at(ends, owners, sizes)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum(ends)

    def _words(self, pieces):
        """Ids of stretches of text, and how many each has: every different word is looked up once."""
        words = pc.ascii_split_whitespace(pa.array(pieces, pa.binary()).cast(pa.string()))
        edges = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        flat, sizes = self._different(coded.dictionary)
        flat, sizes = _gathered(flat, sizes, coded.indices.to_numpy())
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return flat, np.diff(ends[edges])

    def _different(self, words):
        """Ids of different words, and how many each has. A word that ends in a letter or digit and
        some of TAIL is encoded without it: the library cuts there, and gives both cases of A-Z the
        same ids but within its special strings."""
        heads = pc.ascii_rtrim(words, characters=TAIL)
        heads = pc.if_else(pc.match_substring_regex(heads, "[0-9A-Za-z]$"), heads, words)
        behind = (pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy())
        heads = pc.if_else(pc.match_substring(heads, "<"), heads, pc.ascii_lower(heads))
        heads = heads.dictionary_encode()
        pieces = heads.dictionary.cast(pa.binary()).to_pylist()
        place = np.stack([heads.indices.to_numpy(), np.full(len(words), len(pieces))], axis=1)
        tails = {b"": len(pieces)}
        for n in np.unique(behind[behind > 0]).tolist():
            rows = np.flatnonzero(behind == n)
            marks = pc.binary_slice(words.take(pa.array(rows)).cast(pa.binary()), -n, None)
            marks = marks.dictionary_encode()
            numbers = [tails.setdefault(t, len(pieces) + len(tails))
                       for t in marks.dictionary.to_pylist()]
            place[rows, 1] = np.array(numbers)[marks.indices.to_numpy()]
        flat, sizes = _flat(self._looked_up([*pieces, *tails]))
        flat, sizes = _gathered(flat, sizes, place.ravel())
        return flat, sizes.reshape(-1, 2).sum(axis=1)

    def _looked_up(self, pieces):
        known = self.known
        found = list(map(known.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [pieces[i] for i in missing]
            known.update(self._new(new))
            for i, piece in zip(missing, new):
                found[i] = known[piece]
                if len(piece) > LONGEST:
                    del known[piece]
            if len(known) > KNOWN_WORDS:
                known.clear()
        return found

    def _new(self, pieces):
        """(piece, ids) of pieces. Letters alone are one word of the library, so many are encoded as
        one text and cut apart after the ids that end a word; if that does not give as many words
        as there are pieces, each is encoded by itself."""
        letters, others = [], []
        for piece in pieces:
            (letters if piece.decode().isalpha() else others).append(piece)
        if self.ends_word is None:
            letters, others = [], pieces
        groups = [letters[i:i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for group, ids in zip(groups, self._encoded([b" ".join(g) for g in groups])):
            after = np.flatnonzero(self.ends_word[np.frombuffer(ids, np.uint32)]) + 1
            if len(after) == len(group):
                edges = [0, *(4 * after).tolist()]
                yield from zip(group, map(ids.__getitem__, map(slice, edges, edges[1:])))
            else:
                others += group
        yield from zip(others, self._encoded(others))


def _gathered(flat, sizes, place):
    """The stretches of ``flat`` (of the given sizes, one after the other) at some places."""
    start, size = (np.cumsum(sizes) - sizes)[place], sizes[place]
    ends = np.cumsum(size)
    small = not len(ends) or ends[-1] < 1 << 31
    at = np.repeat((start - ends + size).astype(np.int32 if small else np.int64), size)
    at += np.arange(len(at), dtype=at.dtype)
    return np.take(flat, at), size


def _flat(encoded):
    """Ids given as bytes, together, and their numbers."""
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    return np.frombuffer(b"".join(encoded), np.uint32), sizes


def _pieces(texts, cut):
    """(stretches, the number of the text of each): about PIECE bytes; a longer text is cut at
    white space, if it may be."""
    pieces, owners, size = [], [], 0
    for number, text in enumerate(texts):
        at = 0
        while at < len(text):
            white = _WHITE.search(text, at + PIECE) if cut else None
            end = white.start() if white else len(text)
            pieces.append(text[at:end])
            owners.append(number)
            size += end - at
            at = end
            if size >= PIECE:
                yield pieces, owners
                pieces, owners, size = [], [], 0
    if pieces:
        yield pieces, owners


_encoders = {}


def encoder(path, by_word):
    """One per worker and file."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


class Shard:
    """Some documents (doc_id or None) and the grammar of their ids."""

    def __init__(self, doc_ids, ends, grammar):
        self.doc_ids, self.ends, self.grammar = doc_ids, ends, grammar

    @classmethod
    def of(cls, doc_ids, ids, ends, base):
        """From the documents' ids, one after the other, and where each ends."""
        return cls(doc_ids, np.asarray(ends, np.int64), compress(ids, base))

    def to_bytes(self):
        g = self.grammar
        body = b"".join([
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.array([d is None for d in self.doc_ids], np.uint8).tobytes(),
            self.ends.astype("<i8").tobytes(), g.left.tobytes(), g.right.tobytes(),
            g.length.astype("<i8").tobytes(), g.sequence.tobytes()])
        return _HEAD.pack(
            MAGIC, VERSION, g.sequence.itemsize, g.base, len(self.doc_ids), len(g.left),
            len(g.sequence), int(self.ends[-1]) if len(self.ends) else 0, zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, content):
        magic, version, width, base, docs, rules, symbols, ids, check = _HEAD.unpack_from(content)
        if magic != MAGIC or version != VERSION or zlib.crc32(content[_HEAD.size:]) != check:
            raise ValueError("not a shard of this format, or a damaged one")
        symbol, at = symbol_type(base), _HEAD.size
        if np.dtype(symbol).itemsize != width:
            raise ValueError(f"symbols of {width} bytes")

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(content, np.dtype(kind), n, at)
            at += found.nbytes
            return found

        doc_ids, missing, ends = take("<i8", docs), take(np.uint8, docs), take("<i8", docs)
        left, right = take(symbol, rules), take(symbol, rules)
        length = take("<i8", rules)
        grammar = Grammar(base, left, right, length, take(symbol, symbols))
        if (ends[-1] if docs else 0) != ids or grammar.widths(grammar.sequence).sum() != ids:
            raise ValueError("a shard whose lengths disagree")
        return cls([None if m else int(d) for d, m in zip(doc_ids, missing)], ends, grammar)

    def documents(self):
        """(doc_id, start in the shard, ids) of every document."""
        ids, start = self.grammar.ids(), 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist()):
            yield doc_id, start, ids[start:end]
            start = end

    def document(self, number):
        """The ids of one document; the others are not decoded."""
        return self.grammar.part(int(self.ends[number - 1]) if number else 0,
                                 int(self.ends[number]))


def _ended(ids, ends, end_id):
    """The ids with end_id after each document, and the ends after that."""
    after = ends + np.arange(1, len(ends) + 1)
    out = np.empty(len(ids) + len(ends), np.uint32)
    is_end = np.zeros(len(out), bool)
    is_end[after - 1] = True
    out[is_end] = end_id
    out[~is_end] = ids
    return out, after


def _writer(path, end_id, by_word, shard_ids):
    def run(batches):
        encode = encoder(path, by_word)
        base = max(encode.base, end_id + 1)
        part = TaskContext.get().partitionId()
        number = start = 0
        doc_ids, ids, ends = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def row(n):
            """The first n documents as a shard."""
            size = int(ends[n - 1])
            content = Shard.of(doc_ids[:n], ids[:size], ends[:n], base).to_bytes()
            return size, pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([content], pa.binary())],
                ["part", "shard", "start", "n_ids", "content"])

        for batch in batches:
            for some in _slices(batch):
                texts = [t or b"" for t in some.column("text").cast(pa.binary()).to_pylist()]
                new, new_ends = _ended(*encode.ids(texts), end_id)
                doc_ids += some.column("doc_id").to_pylist()
                ends = np.concatenate([ends, len(ids) + new_ends])
                ids = np.concatenate([ids, new])
                while len(ids) >= shard_ids:
                    n = int(np.searchsorted(ends, shard_ids)) + 1
                    size, shard = row(n)
                    yield shard
                    number, start = number + 1, start + size
                    doc_ids, ids, ends = doc_ids[n:], ids[size:], ends[n:] - size
        if doc_ids:
            yield row(len(doc_ids))[1]

    return run


def _slices(batch):
    """Rows of about PIECE bytes of text; a longer text is one by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    group = np.cumsum(sizes) // PIECE
    for first in np.flatnonzero(np.concatenate(([True], np.diff(group) > 0))).tolist() if len(group) else []:
        yield batch.slice(first, int(np.searchsorted(group, group[first], "right")) - first)


def write_ids(docs, path, tokenizer_path, end_id=END_ID, by_word=True, shard_ids=SHARD_IDS):
    """Write the documents' ids in ascending order of doc_id."""
    order = ["doc_id", F.xxhash64("text")]
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_writer(tokenizer_path, end_id, by_word, shard_ids), FILES)
        .write.option("parquet.block.size", 32 << 20).parquet(path)
    )


def _reader(batches):
    for batch in batches:
        columns = (batch.column(c) for c in ("before", "content"))
        for before, content in zip(*columns):
            found = list(Shard.from_bytes(content.as_py()).documents())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _, _ in found], pa.int64()),
                 pa.array([before.as_py() + s for _, s, _ in found], pa.int64()),
                 pa.array([ids.astype("<u4").tobytes() for *_, ids in found], pa.binary())],
                ["doc_id", "start", "ids"])


def read_ids(spark, path):
    """doc_id, start (ids of all documents before it) and ids (little-endian, 4 bytes each)."""
    files = spark.read.schema(FILES).parquet(path)
    # One row per part: a window over them and a broadcast are bounded by the tasks that wrote.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    return (
        files.join(F.broadcast(parts), "part")
        .select((F.col("earlier") + F.col("start")).alias("before"), "content")
        .mapInArrow(_reader, "doc_id bigint, start bigint, ids binary")
    )


def digests(rows):
    """The contract's columns."""
    return rows.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
