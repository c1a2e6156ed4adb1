"""Ranked lexical search against a plain count of terms."""

import math
import re
from collections import Counter, defaultdict

from fixture_docs import frame, hard_rows

from millrace.llm import lexical_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ITEMS = [("a", "Waa wak, WBK; wck-wdl é"), ("b", "w1 \0 in it b b b a"), ("c", None), ("d", " ,. "),
         ("a", "changed waa"), ("a", "changed waa"), (None, "single x " + "é" * 300), ("e", "nowhere")]
ITEMS_SCHEMA = "item_id string, text string, score string, doc_id string, n string, terms string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(rows, items, top):
    found = [(d, Counter(terms(t))) for d, t, _ in rows]
    many = sum(bool(c) for _, c in found)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(terms(text))
    result = []
    for item, wanted in asked.items():
        scores = []
        for d, c in found:
            m = total and 75 + 25 * sum(c.values()) * many // total
            s = sum(n * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        result += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:top])]
    return result


def searched(spark, rows, items, **options):
    frame_ = spark.createDataFrame([(*i, *["clash"] * 4) for i in items], ITEMS_SCHEMA)
    found = lexical_search.search(frame(spark, rows).repartition(5), frame_, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in found.collect()]


def same(got, want):
    key = str
    return sorted(got, key=key) == sorted(want, key=key)


def test_hard_documents(spark):
    rows = hard_rows()
    assert same(searched(spark, rows, ITEMS), expected(rows, ITEMS, 20))
    assert same(searched(spark, rows, ITEMS, top=3), expected(rows, ITEMS, 3))


def test_items_in_several_blocks(spark):
    rows = hard_rows(2)
    items = ITEMS + [(f"x{i}", rows[i][1]) for i in range(12)]
    assert same(searched(spark, rows, items, block_bytes=300), expected(rows, items, 20))


def test_ties_are_ranked_by_doc_id(spark):
    rows = [(i, "same words here", "s") for i in reversed(range(100))] + [(500, "other", "s")] * 70
    got = searched(spark, rows, [("q", "words words")], top=30)
    assert sorted(got) == sorted(expected(rows, [("q", "words words")], 30))
    assert sorted(r[2] for r in got) == list(range(30))


def test_nothing_to_search(spark):
    assert searched(spark, [(1, None, "s"), (2, "", "s")], ITEMS) == []
    assert searched(spark, hard_rows(), [("c", None)]) == []
    assert searched(spark, hard_rows(), []) == []
    assert searched(spark, [], ITEMS) == []


def test_pieces_cut_at_blanks_only(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    plain = lexical_search._plain(b"One two,three " + b"x" * 40 + b" four")
    words = [w for piece in lexical_search._pieces(plain) for w in piece.split()]
    assert words == plain.split() == [b"one", b"two", b"three", b"x" * 40, b"four"]
