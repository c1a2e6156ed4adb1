import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from fixture_docs import frame, hard_rows

from millrace.llm import simhash
from millrace.llm.components import components

WHITE = " \t\n\u000b\f\r"


def brute_print(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [words[i:i + width] for i in range(len(words) - width + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_links(fps, distance=4):
    fps = np.array(sorted(fps), np.uint64)
    return [(int(a), int(b)) for i, a in enumerate(fps)
            for b in fps[i + 1:][np.bitwise_count(fps[i + 1:] ^ a) <= distance]]


def brute(rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    fps = {fp for _, fp in prints}
    root = roots(fps, brute_links(fps))
    ids = defaultdict(list)
    for doc_id, fp in prints:
        if doc_id is not None:
            ids[root[fp]].append(doc_id)
    return sorted(
        ((d, f"{fp:016x}", min(ids[root[fp]], default=None)) for d, fp in prints), key=str)


def test_against_brute_force(spark):
    rows = hard_rows()
    got = simhash.digests(simhash.near_components(frame(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
            .select("doc_id", "text", "source").collect()]
    got = simhash.digests(simhash.near_components(frame(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_hashes_are_those_of_spark(spark):
    text = "one two three four"
    assert simhash.fingerprint(text.encode()) == spark.sql(
        f"SELECT xxhash64('{text}') AS h").first()["h"]


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_links_in_dense_clusters(spark, block):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint"), block=block)
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in links.distinct().collect()}
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    assert roots(fps, got) == roots(fps, brute_links(fps))


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)) ^ np.uint64(0xF0)
    bound = np.abs(simhash.segment_counts(a) - simhash.segment_counts(b)).sum(axis=1)
    assert np.array_equal(simhash.manhattan(a, b), bound)
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 60)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert {r.node: r.root for r in got} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert len(got) == len(nodes)


def test_one_of_each_group_stays(spark):
    rows = hard_rows()
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs, simhash.near_components(docs))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # A doc_id may name several documents, in components of their own.
    fps = {brute_print(r[1]) for r in rows}
    root = roots(fps, brute_links(fps))
    component = {fp: c for _, fp, c in brute(rows)}
    expected = [component[f"{r:016x}"] for r in set(root.values())]
    assert sorted(ids, key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    docs = frame(spark, [])
    assert simhash.digests(simhash.near_components(docs)).collect() == []
    assert simhash.keep_one(docs, simhash.near_components(docs)).count() == 0
