import numpy as np
from fixture_docs import frame, hard_rows

from millrace.llm import mixing

WHITE = " \t\n\u000b\f\r"


def brute_targets(sizes):
    """Water filling in rounds: source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    return target


def n_words(text):
    for c in WHITE[1:]:
        text = (text or "").replace(c, " ")
    return len([w for w in (text or "").split(" ") if w])


def check(rows, got):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + n_words(text)
    targets = brute_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted(
        (r[0], n_words(r[1])) for r in rows if r[0] is not None)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert np.isclose(r.target, targets[r.source])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        longest = max(n_words(r[1]) for r in rows if r[2] == s)
        assert abs(taken[s] - targets[s]) <= longest, s


def test_hard_rows(spark):
    rows = hard_rows()
    check(rows, mixing.mix(frame(spark, rows)).collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    mixed = mixing.mix(docs)
    got = mixed.collect()
    check(rows, got)
    sizes = {r.source: (r.source_size, r.target) for r in got}
    for source, (_, target) in sizes.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 2
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_large_group_of_one_length(spark):
    rows = [(i, "a b c", "x") for i in range(3000)] + [(5000 + i, "a " * i, "y") for i in range(90)]
    got = mixing.mix(frame(spark, rows)).collect()
    check(rows, got)


def test_counts_fit_the_budget():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 400, rng.integers(1, 60)))
        counts = rng.integers(1, 50, len(lengths))
        budget = int(rng.integers(0, lengths @ counts + 1))
        taken = mixing.take_counts(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        reach = {0}
        if lengths @ counts < 4000:
            for length, n in zip(lengths.tolist(), counts.tolist()):
                reach = {s + k * length for s in reach for k in range(n + 1) if s + k * length <= budget}
            assert lengths @ taken == max(reach)
        else:
            assert 0 <= budget - lengths @ taken <= lengths.min()


def test_budget_beyond_the_table():
    lengths, counts = np.array([30, 70, 500_000]), np.array([4_000_000, 90, 40])
    for budget in (10_000_000, 77_777_777, 139_000_001):
        taken = mixing.take_counts(lengths, counts, budget)
        assert (taken <= counts).all() and 0 <= budget - lengths @ taken < 70


def test_corpus_has_each_taken_row_once(spark):
    rows = hard_rows()
    docs = frame(spark, rows)
    corpus = mixing.mixed_corpus(docs).collect()
    total = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(r.taken for r in corpus) == total and all(r.copies > 0 for r in corpus)
    assert len({(r.doc_id, r.text, r.source) for r in corpus}) == len(corpus)


def test_empty_table(spark):
    docs = frame(spark, [])
    assert mixing.mix(docs).collect() == [] and mixing.mixed_corpus(docs).collect() == []


def test_few_long_texts_fit_the_budget():
    assert mixing.take_counts([60_000], [3], 130_000).tolist() == [2]
    rng = np.random.default_rng(4)
    for _ in range(500):
        lengths = np.unique(rng.integers(40_000, 200_000, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, lengths @ counts))
        taken = mixing.take_counts(lengths, counts, budget)
        rest = budget - int(lengths @ taken)
        assert (taken >= 0).all() and (taken <= counts).all() and 0 <= rest < lengths[-1]
        assert (lengths[taken < counts] > rest).all()  # no other document fits
