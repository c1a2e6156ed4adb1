import hashlib
import random

import numpy as np
import pytest
from fixture_docs import frame, hard_rows

from millrace.llm import suffix_dedup
from millrace.llm.suffix_array import common_prefixes, suffix_order


def brute(rows, length):
    """(doc_id, bytes, removed, runs, digest) of every row by holding all strings."""
    distinct = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    first = {}
    for known, doc, text in distinct:
        data = text.encode()
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            first[s] = min(first.get(s, (2, 0, 0)), (known, doc, i))
    out = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < (doc_id is not None, doc_id or 0, i):
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order_against_sorting():
    rng = random.Random(3)
    for _ in range(200):
        n, letters, depth = rng.randint(1, 150), rng.choice([1, 2, 3, 20]), rng.choice([8, 16, 24])
        text = bytes(rng.randint(0, letters) for _ in range(n))
        data = np.frombuffer(text, np.uint8)
        order = suffix_order(data, depth)
        keys = [text[i:i + depth].ljust(depth, b"\0") for i in order]
        assert sorted(order) == list(range(n)) and keys == sorted(keys)
        prefixes = common_prefixes(data, order, depth)
        for a, b, shared in zip(keys, keys[1:], prefixes[1:]):
            assert a[:shared] == b[:shared] and (shared == depth or a[shared] != b[shared])


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 1])
def test_against_brute_force(spark, many):
    rows = hard_rows()
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows), many=many))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 100)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
            .select("doc_id", "text", "source").collect()]
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 100)


def test_empty_table(spark):
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, [])))
    assert got.collect() == []
