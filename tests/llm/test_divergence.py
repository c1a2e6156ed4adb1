"""Source divergence against plain arithmetic on whole tables."""

import re
from collections import Counter, defaultdict

import numpy as np
from fixture_docs import hard_rows

from millrace.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, value string, part string, n string"


def expected(rows, least, top):
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        groups[lang or "", source or ""].update(found)
        documents[lang or ""].update(found.keys())
    result = []
    for lang in documents:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        share = {}
        for name, c in [*mine.items(), (None, sum(mine.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            share[name] = [1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept]
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in mine.items():
            pairs = [(-sum(map(apart, share[s], share[o])), o) for o in mine if o != s]
            words = [(-apart(p, q), t) for t, p, q in zip(kept, share[s], share[None])
                     if c[t] and p > q]
            for part, values in (("pair", pairs), ("term", words)):
                values.sort(key=lambda x: (x[0], x[1].encode()))
                keep = values if part == "pair" else values[:top]
                result += [(lang, s, part, i, -v, k + 1) for k, (v, i) in enumerate(keep)]
    return sorted(result)


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(*r, *["clash"] * 3) for r in rows], SCHEMA).repartition(5)
    found = divergence.audit(docs, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def _rows(seed=1):
    langs = ["en", "fr", None, ""]
    rows = [(d, t, langs[i % 4], s) for i, (d, t, s) in enumerate(hard_rows(seed))]
    return rows + [(900, "1 2 3", "de", "src0"), (901, None, "de", "src1"), (902, "", "it", None)]


def test_hard_documents(spark):
    for least, top in ((10, 10), (1, 3)):
        assert audited(spark, _rows(), least=least, top=top) == expected(_rows(), least, top)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 4)
    assert audited(spark, _rows(3), least=2) == expected(_rows(3), 2, 10)


def test_hot_source_and_common_term(spark):
    rows = [(i, "common word " * 3 + f"own{i}", "en", "big" if i % 3 else f"s{i}") for i in range(300)]
    assert audited(spark, rows, least=2) == expected(rows, 2, 10)


def test_nothing_to_compare(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(1, "a b", "en", "only")]) == []
    assert audited(spark, [(1, None, None, "a"), (2, "x", None, "b")]) == [
        ("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_shares_of_large_counts():
    counts = [0, 5, 10 ** 12, 4 * 10 ** 15]
    total, terms = 4 * 10 ** 15 + 10 ** 13, 10 ** 6
    assert divergence.share(np.array(counts), total, terms).tolist() == [
        1 + 10 ** 9 * (c + 2) // (total + 2 * terms) for c in counts]
