"""The trained operators: held-out accuracy, what training may see, and edge cases."""

import zlib

import numpy as np
import pytest
from fixture_docs import frame, hard_rows
from pyspark.sql import functions as F

from millrace.llm import pseudo_likelihood, quality_classifier

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scored(given):
    return {r.doc_id: r for r in quality_classifier.digests(*given).collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(given, scored):
    docs, labels = given
    assert len(scored) == docs.count()
    assert all(r.held_out == held_out(d) for d, r in scored.items())
    tested = [r for r in labels.collect() if held_out(r.doc_id) and r.doc_id in scored]
    right = [scored[r.doc_id].predicted == r.quality for r in tested]
    assert len(right) > 50 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())


def test_held_out_labels_are_never_read(given, scored):
    docs, labels = given
    turned = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")
    ).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    again = {r.doc_id: r.score for r in quality_classifier.digests(other, turned).collect()}
    assert again == {d: r.score for d, r in scored.items()}


def brute_features(text):
    """{bucket: share} of a text, feature by feature."""
    def spread(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2 ** 64
        return h ^ h >> 32

    def number(data):
        return sum((b + 1) * pow(0x5851F42D4C957F2D, i, 2 ** 64) for i, b in enumerate(data)) % 2 ** 64

    def bucket(h, kind):
        return spread((h + kind) % 2 ** 64) >> 64 - quality_classifier.BUCKET_BITS

    words = (text or "").encode().lower().split()
    found = []
    for i, word in enumerate(words):
        marked = b" " + word + b" "
        for n in quality_classifier.GRAMS:
            found += [bucket(number(marked[k:k + n]), n) for k in range(len(marked) - n + 1)]
        found.append(bucket(number(word), 1))
        if i:
            a, b = number(words[i - 1]), number(word)
            found.append(bucket((0 if a == b else a * 3 + b) % 2 ** 64, 2))
    return {b: found.count(b) / len(found) for b in set(found)}


TEXTS = ["One two two three", "a b", "", None, "é x é x", "same same same", " Tabs\tand\nlines  here "]


def test_features_against_single_ones():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"doc_id": range(len(TEXTS)), "label": [1] * len(TEXTS), "text": TEXTS})
    (rows,) = quality_classifier._shares([batch])
    for text, buckets, shares in zip(TEXTS, rows["buckets"].to_pylist(), rows["shares"].to_pylist()):
        want = brute_features(text)
        assert buckets == sorted(want)
        assert shares == pytest.approx([want[b] for b in buckets])


def test_scores_against_single_sums():
    weights = np.random.default_rng(0).normal(size=1 << quality_classifier.BUCKET_BITS)
    model = quality_classifier.Model(weights.astype(np.float32), -0.3)
    got = model.scores([t and t.encode() for t in TEXTS])
    for score, text in zip(got, TEXTS):
        odds = -0.3 + sum(n * weights[b] for b, n in brute_features(text).items())
        assert score == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-5)


def test_a_step_follows_the_gradient():
    """The step of the layer and vectors against the loss at shifted parameters."""
    trainee = quality_classifier.Trainee.start(3, 5)
    trainee.layer += np.random.default_rng(1).normal(0, 1, trainee.layer.shape).astype(np.float32)
    buckets, shares = np.array([3, 9, 70]), np.array([0.5, 0.25, 0.25], np.float32)

    def loss(vectors, layer):
        logits = layer @ (shares @ vectors[buckets]) + trainee.bias
        return np.log(np.exp(logits).sum()) - logits[1]

    vectors, layer = trainee.vectors.astype(float), trainee.layer.astype(float)
    want = []
    for place in ((0, 2), (1, 5)):
        moved = layer.copy()
        moved[place] += 1e-5
        want.append((loss(vectors, moved) - loss(vectors, layer)) / 1e-5)
    moved = vectors.copy()
    moved[9, 4] += 1e-5
    slope = (loss(moved, layer) - loss(vectors, layer)) / 1e-5
    trainee.step(buckets, shares, 1, steps=10**9, rate=0.1)
    got = [trainee.layer[p] - layer[p] for p in ((0, 2), (1, 5))]
    assert got == pytest.approx([-0.1 * w for w in want], rel=1e-2)
    assert trainee.vectors[9, 4] - vectors[9, 4] == pytest.approx(-0.1 * 3 ** 0.5 * slope, rel=1e-2)


def test_long_labelled_texts_stay_in_tasks(spark, monkeypatch):
    """Examples of many features: what comes to the driver is the model alone."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'good' if i % 2 else 'bad'}{n}" for n in rng.integers(0, 10**6, 20000))
             for i in range(12)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toArrow", None)
    model = quality_classifier.fit(docs, labels)
    scores = model.scores([t.encode() for t in texts])
    assert (scores[1::2] > 0.7).all() and (scores[::2] < 0.7).all()


def test_layout_of_the_tables_does_not_matter(spark, given):
    docs, labels = given
    one = quality_classifier.fit(docs.coalesce(1), labels.coalesce(1))
    many = quality_classifier.fit(docs.repartition(7), labels.repartition(5))
    assert one.bias == many.bias and (one.weights == many.weights).all()


def test_hard_rows_get_scores(spark, given):
    rows = hard_rows()
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (5, 0, 0), (7777, 1, 0)],
        "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows)
    got = quality_classifier.digests(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(r.held_out is (held_out(r.doc_id) if r.doc_id is not None else False) for r in got)
    empty = {r.score for r in got if r.doc_id in (201, 202)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in got)
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model)
    assert set(docs.columns) | {"predicted"} == set(scored.columns) and scored.count() == len(rows)


@pytest.mark.parametrize("quality", [[], [1, 1, 1]])
def test_without_labels_of_both_classes(spark, quality):
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)],
                                   "doc_id bigint, quality int, toxic int")
    got = quality_classifier.digests(frame(spark, hard_rows()), labels).collect()
    assert len({r.score for r in got}) == 1
    assert got[0].score == (pytest.approx(1, abs=1e-5) if quality else 0.5)


def test_no_documents_to_classify(spark, given):
    assert quality_classifier.digests(frame(spark, []), given[1]).collect() == []


def test_long_texts_are_scored_whole(monkeypatch):
    model = quality_classifier.Model(
        np.random.default_rng(0).normal(size=1 << quality_classifier.BUCKET_BITS), 0.1)
    text = b" ".join(b"word%d" % (i % 97) for i in range(4000))
    whole = model.scores([text])[0]
    monkeypatch.setattr(quality_classifier, "CHUNK_BYTES", 4096)
    pieces = model.scores([b"", text, None])
    assert pieces[1] == pytest.approx(whole, abs=1e-3)
    assert pieces[0] == pieces[2] == 1 / (1 + np.exp(-0.1))


# ---- masked pseudo-likelihood ----------------------------------------------------


def plain_network(ids, seed=0):
    """A network of random parameters."""
    rng = np.random.default_rng(seed)
    words = [b"w%d" % i for i in range(ids.own)]
    start = pseudo_likelihood.Network.start(
        ids, words, rng.integers(1, 50, ids.own), rng.integers(1, 50, ids.unknown))
    return start.moved(start.flat() + rng.normal(0, 0.3, start.flat().size) * (start.flat() != 0))


def brute_log_probabilities(net, tokens):
    """Token by token: the window's mean vector, then the two softmax layers."""
    result = []
    for i, token in enumerate(tokens):
        near = [t for j, t in enumerate(tokens) if j != i and abs(i - j) <= pseudo_likelihood.SIDE]
        mean = sum(net.vectors[t].astype(float) for t in near) / max(1, len(near))
        mean = mean + np.zeros(pseudo_likelihood.DIMENSIONS)
        group, slot = token % net.ids.classes, token // net.ids.classes
        first = net.class_layer.astype(float) @ mean + net.class_bias
        second = net.slot_layer[group].astype(float) @ mean + net.slot_bias[group]
        result.append(first[group] - np.log(np.exp(first).sum())
                      + second[slot] - np.log(np.exp(second).sum()))
    return np.array(result)


def laid(net, tokens):
    gap = [net.ids.all] * pseudo_likelihood.SIDE
    return np.array([*gap, *tokens, *gap]), np.arange(len(tokens)) + pseudo_likelihood.SIDE


SMALL = pseudo_likelihood.Ids(9, 8, 12)


def test_forward_pass_against_single_tokens():
    net = plain_network(SMALL)
    tokens = np.random.default_rng(2).integers(0, SMALL.all, 300)
    got = net.log_probabilities(*laid(net, tokens))
    assert got == pytest.approx(brute_log_probabilities(net, tokens), abs=1e-4)
    texts = [b"w1 W2 unknown w3", b"", None, b"w1", b"w5 " * 70]
    count, total = pseudo_likelihood.scores(net, [net.tokens(t) for t in texts])
    assert count.tolist() == [4, 0, 0, 1, 70]
    for text, n, t in zip(texts, count, total):
        assert t == pytest.approx(brute_log_probabilities(net, net.tokens(text)).sum(), abs=1e-3)


def test_a_training_step_against_the_gradient(monkeypatch):
    """One step moves every parameter by the gradient of the mean loss, scaled by its own size."""
    monkeypatch.setattr(pseudo_likelihood, "RATE", 1e-3)
    net = plain_network(SMALL, 3)
    tokens = np.random.default_rng(4).integers(0, SMALL.all, 40)
    flat = net.flat()
    past = [np.zeros_like(a) for a in net.arrays()]
    moved = net.moved(flat)
    moved.train(*laid(net, tokens), past)

    def loss(values):
        return -brute_log_probabilities(net.moved(values), tokens).mean()

    change = moved.flat() - flat
    for place in np.random.default_rng(5).choice(np.flatnonzero(change), 60, replace=False):
        shifted = flat.copy()
        shifted[place] += 1e-3
        slope = (loss(shifted) - loss(flat)) / 1e-3
        if abs(slope) > 1e-4:  # AdaGrad's first step has the gradient's sign and the rate's size
            assert change[place] == pytest.approx(-1e-3 * np.sign(slope), rel=0.05)
    sums = np.concatenate([a.ravel() for a in past])
    assert ((sums > 0) == (change != 0)).mean() > 0.999


@pytest.fixture(scope="module")
def fitted(given):
    return pseudo_likelihood.fit(given[0])


def test_probabilities_add_up(fitted):
    network = fitted[0]
    row, _ = laid(network, [5, 9, 17])
    total = 0.0
    for token in range(network.ids.all):
        row[3] = token
        total += np.exp(network.log_probabilities(row, np.array([3]))[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_training_raises_the_likelihood(given, fitted):
    """Also over the words alone, whose frequencies the start already has."""
    texts = [r.text.encode() for r in given[0].select("text").limit(200).collect() if r.text]
    start = pseudo_likelihood.Network.start(*pseudo_likelihood.vocabulary(given[0]))
    documents = [start.tokens(t) for t in texts]
    count, before = pseudo_likelihood.scores(start, documents)
    _, after = pseudo_likelihood.scores(fitted[0], documents)
    assert after.sum() / count.sum() > before.sum() / count.sum() + 0.1


def test_neighbours_of_both_sides_matter(fitted):
    def score(text):
        return pseudo_likelihood.scores(fitted[0], [fitted[0].tokens(text)])[1][0]

    a, b, c, d = fitted[0].words[:4]
    middle = [score(b" ".join(x)) for x in ([a, b, c], [d, b, c], [a, b, d])]
    assert len({round(m, 6) for m in middle}) == 3


def test_scores_do_not_depend_on_the_layout(spark, given, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_TOKENS", 60000)
    docs = given[0]
    found = [
        {r.doc_id: r.log_prob for r in pseudo_likelihood.scored(x).collect()}
        for x in (docs.coalesce(1), docs.repartition(8))]
    assert found[0].keys() == found[1].keys() and len(found[0]) == docs.count()
    for doc_id, value in found[0].items():
        assert value == pytest.approx(found[1][doc_id], rel=1e-6)


def test_every_shard_is_trained_alone(given, monkeypatch):
    """The mean of what single shards learn, by hand."""
    monkeypatch.setattr(pseudo_likelihood, "SHARD_TOKENS", 100000)
    network, table = pseudo_likelihood.fit(given[0])
    start = pseudo_likelihood.Network.start(*pseudo_likelihood.vocabulary(given[0]))
    shards = {}
    for r in table.orderBy("shard", "key").collect():
        shards.setdefault(r.shard, []).append(np.frombuffer(r.ids, start.token_type()))
    assert len(shards) > 2
    flat, total = np.zeros(start.flat().size), 0
    for documents in shards.values():
        trained, n = pseudo_likelihood.train_shard(start, iter(documents))
        assert n == sum(map(len, documents))
        flat += (trained.flat() - start.flat()) * n
        total += n
    assert network.flat() == pytest.approx(start.flat() + flat / total, abs=1e-5)


def test_scores_of_hard_rows(spark):
    rows = hard_rows()
    docs = frame(spark, rows)
    network, table = pseudo_likelihood.fit(docs)
    got = pseudo_likelihood.score(table, network).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    for r in got:
        assert (r.n_tokens == 0) == (r.log_prob == 0) and r.log_prob <= 0
        assert r.mean_log_prob == pytest.approx(r.log_prob / max(r.n_tokens, 1))
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_tokens, round(r.log_prob, 6)))
    assert len(by_id[3]) == 1 and by_id[201] == by_id[202] == {(0, 0.0)}
    copies = {x for d in range(100, 106) for x in by_id[d]}
    assert len(copies) == 1


def test_nothing_to_learn_from(spark):
    assert pseudo_likelihood.scored(frame(spark, [])).collect() == []
    docs = frame(spark, [(1, None, "a"), (2, "", "b")])
    got = pseudo_likelihood.scored(docs).collect()
    assert [(r.n_tokens, r.log_prob) for r in got] == [(0, 0.0)] * 2


def test_ids_grow_with_the_vocabulary():
    sizes = [pseudo_likelihood.Ids.of(n) for n in (0, 10**4, 10**6, 10**8)]
    assert all(3 * s.all >= 2 * pseudo_likelihood.LEAST_IDS for s in sizes)
    assert [round(s.all, -2) for s in sizes[1:]] == [200, 2000, 20000]
    assert all(abs(s.classes - s.slots) <= 2 and s.own + s.unknown == s.all for s in sizes)


def test_counts_of_all_words_start_the_network(spark):
    rows = [(i, " ".join(f"w{100 * i + j}" for j in range(100)), "s") for i in range(30)]
    rows.append((30, "x" * 100 + " w7 w7", "s"))
    ids, words, counts, others = pseudo_likelihood.vocabulary(frame(spark, rows))
    assert ids == pseudo_likelihood.Ids.of(3001)
    alike = sorted(f"w{i}".encode() for i in range(3000) if i != 7)
    assert words == [b"w7"] + alike[:ids.own - 1]  # ties at the cut by word
    assert counts.tolist() == [3] + [1] * (ids.own - 1)
    left = np.zeros(ids.unknown, int)
    for w in [*alike[ids.own - 1:], b"x" * 100]:
        left[zlib.crc32(w) % ids.unknown] += 1
    assert others.tolist() == left.tolist()
    network = pseudo_likelihood.Network.start(ids, words, counts, others)
    assert network.tokens(b"W7 w7 nothing").tolist()[:2] == [0, 0]
    assert network.tokens(b"nothing")[0] == ids.own + zlib.crc32(b"nothing") % ids.unknown
