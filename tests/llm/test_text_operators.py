"""Token counts, line dedup, decontamination, quality rules and chat formatting on hard rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixture_docs import frame, hard_rows
from pyspark.sql import types as T

from millrace.llm import chat_format, decontaminate, line_dedup, quality_rules, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WHITE = " \t\n\u000b\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---- token counts ----------------------------------------------------------------


def test_counts_equal_the_library(spark, tmp_path):
    rows = [*hard_rows(), (900, "<s> </s> <unk> [INST]", "src0"), (901, "zero​width ﬁ", "src0")]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cache = token_counts.DigestCache(str(tmp_path / "cache"))
    got = token_counts.count_tokens(frame(spark, rows), MODEL, cache).collect()
    expected = [
        (d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096)
        for d, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_only_new_texts_are_encoded(spark, tmp_path):
    rows = hard_rows()
    cache = token_counts.DigestCache(str(tmp_path / "cache"))
    version = token_counts.tokenizer_version(MODEL)
    token_counts.count_tokens(frame(spark, rows), MODEL, cache)
    stored = cache.read(spark, version).count()
    assert stored == len({r[1] or "" for r in rows})
    more = frame(spark, [*rows, (999, "a text not seen before", "src0")])
    assert token_counts.missing_texts(more, cache.read(spark, version)).count() == 1
    got = token_counts.count_tokens(more, MODEL, cache)
    assert got.count() == len(rows) + 1
    assert cache.read(spark, version).count() == stored + 1
    assert token_counts.missing_texts(more, cache.read(spark, "another")).count() > 1


def test_no_documents_to_count(spark, tmp_path):
    cache = token_counts.DigestCache(str(tmp_path / "cache"))
    assert token_counts.count_tokens(frame(spark, []), MODEL, cache).collect() == []


# ---- line dedup ------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return lowered(line.strip(WHITE))

    holders = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < min_docs
                or doc_id == max(holders[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    rows = hard_rows()
    docs = frame(spark, rows)
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    got = [(r.doc_id, int(r.n_lines), int(r.n_dropped), r.text) for r in got.collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows), key=str)
    assert any(x[2] for x in got)


def test_no_lines(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


# ---- decontamination -------------------------------------------------------------


def words_of(text):
    text = lowered(text or "")
    return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " "
                   for c in text).split(" ")


def brute_hits(rows, items, window=10):
    strings = {}
    for item_id, text in items:
        words = [w for w in words_of(text) if w]
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            strings.setdefault(tuple(words[i:i + n]), set()).add(item_id)
    out = []
    for doc_id, text, *_ in rows:
        words = [w for w in words_of(text) if w]
        hit, found = set(), set()
        for n in {len(s) for s in strings}:
            for i in range(len(words) - n + 1):
                ids = strings.get(tuple(words[i:i + n]))
                if ids is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def hard_items(rows):
    return [
        (1, " ".join(rows[0][1].split()[-25:]).upper()), (10, rows[4][1]), (2, "single"),
        (3, "w! changed, w"), (None, rows[8][1]), (4, None), (5, ""), (6, "?!"), (2, "also x"),
        (7, " ".join(rows[0][1].split()[-14:])), (8, " ".join(rows[-8][1].split()[:12] or ["b"])),
        (9, "char in"), (11, "é" * 300),
    ]


BENCHMARK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_hits(spark, block_bytes):
    rows = hard_rows()
    items = hard_items(rows)
    got = decontaminate.digests(decontaminate.judged(
        frame(spark, rows), spark.createDataFrame(items, BENCHMARK), block_bytes=block_bytes))
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == sorted(brute_hits(rows, items), key=str)
    assert sum(x[5] for x in got) > 10 and not all(x[5] for x in got)


def test_long_documents_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 64)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 300))).encode() for _ in range(40)]
    texts += [b"c" * 500 + b" a b a", b"", b"...", b"a" * 63 + b" " + b"b" * 64]
    items = [(1, "a b a a b b a b a a"), (2, "b b b"), (3, "a b a b b a a b a b b b a")]
    benchmark = decontaminate.Benchmark([(str(i), t) for i, t in items], 10)
    for number, text in enumerate(texts):
        found = set()
        for parts, _, before in decontaminate._chunks([text], 9):
            words = decontaminate.Words(b"\n".join(parts))
            edges = [0]
            for p in parts:
                edges.append(edges[-1] + len(p) + 1)
            for d, first, n, _ in benchmark.hits(words, np.array(edges)):
                found.update(range(before[d] + first, before[d] + first + n))
        expected = brute_hits([(number, text.decode())], items)[0]
        assert len(found) == expected[2], text


def test_clean_documents_stay(spark):
    rows = hard_rows()
    items = hard_items(rows)
    docs = frame(spark, rows)
    kept = decontaminate.keep_clean(docs, spark.createDataFrame(items, BENCHMARK))
    expected = [r[0] for r, x in zip(rows, brute_hits(rows, items)) if not x[5]]
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], BENCHMARK)
    rows = hard_rows()
    got = decontaminate.judged(frame(spark, rows), none).collect()
    assert len(got) == len(rows) and not any(r.n_hit for r in got)
    some = spark.createDataFrame([(1, "single")], BENCHMARK)
    assert decontaminate.judged(frame(spark, []), some).collect() == []


# ---- quality rules ---------------------------------------------------------------


def test_measures(spark):
    rows = hard_rows()
    got = {(r.doc_id, r.n_bytes): r for r in quality_rules.judged(frame(spark, rows)).collect()}
    assert len(got) <= len(rows)
    for doc_id, text, *_ in rows:
        text = text or ""
        r = got[doc_id, len(text.encode())]
        words = [w for w in text.translate(str.maketrans(WHITE, " " * 6)).split(" ") if w]
        triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        counts = {}
        for t in triples:
            counts[t] = counts.get(t, 0) + 1
        covered = {j for i, t in enumerate(triples) if counts[t] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_no_texts_to_judge(spark):
    assert quality_rules.judged(frame(spark, [])).collect() == []


# ---- chat formatting -------------------------------------------------------------

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("turns", T.StringType()), T.StructField("pieces", T.StringType())])


def test_texts_come_back(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "\n", " ", "a", "é", "<", "s>", "$1", "/"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])
            role = rng.choice(["user", "assistant", "assistant", "system", None, "<s>\n[INST]"])
            rows.append((conv, rng.choice([turn, turn, None]), role, text, "x", "y"))
    rows += [(None, 0, "assistant", "lost", "x", "y"), rows[0], rows[0]]
    rows += [(500, i, "assistant" if i % 2 else "user", "long " * 2000, "x", "y") for i in range(100)]
    expected = []
    for conv in {r[0] for r in rows}:
        turns = sorted(
            (((t is not None, t or 0), r or "", x or "") for c, t, r, x, *_ in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        expected.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)),
                         len(loss), sha(loss)))
    got = chat_format.digests(chat_format.formatted(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)


def test_adjacent_turns_share_a_block(spark):
    rows = [(1, 0, "user", "a", "", ""), (1, 1, "user", "b", "", ""), (1, 2, "assistant", "c", "", "")]
    got = chat_format.formatted(spark.createDataFrame(rows, TURNS)).first()
    assert got.formatted == "\n<s>user\n[INST]a\n[/INST]b\n</s>\n<s>assistant\n[INST]c\n</s>"
    assert [got.formatted[s.start:s.start + s.length] for s in got.loss_spans] == ["c"]


def test_loss_spans_in_characters_and_bytes(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"é{i}</s>日本", "", "") for i in range(3000)]
    got = chat_format.formatted(spark.createDataFrame(rows, TURNS)).first()
    whole = got.formatted.encode()
    texts = [got.formatted[s.start:s.start + s.length] for s in got.loss_spans]
    assert texts == [f"é{i}\\</s>日本" for i in range(3000) if i % 3]
    assert texts == [whole[s.byte_start:s.byte_start + s.byte_length].decode() for s in got.loss_spans]


def test_no_turns(spark):
    assert chat_format.digests(chat_format.formatted(spark.createDataFrame([], TURNS))).collect() == []
